"""Low-amount, legal and natural clients: raw tables to one feature table per population."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tamiz.functions.dates import as_date, year_bucket
from tamiz.functions.recodes import industry_group, savings_product
from tamiz.functions.text import norm_key, year_in_name
from tamiz.operators.consolidate import (
    income_columns,
    latest_per_key,
    referential_filter,
    replace_columns,
    standardise_places,
)
from tamiz.operators.features import behaviour, indicators
from tamiz.operators.route import LEGAL, LOW_AMOUNT, NATURAL

# Indicator columns and the group or state each one stands for.
INDUSTRY_FLAGS = {
    "comercio": "Comercio al por Mayor y por Menor",
    "construccion": "Construcción e Infraestructura",
    "ind_alimentaria": "Industria de Alimentos y Bebidas",
    "ind_manufacturera": "Industria Manufacturera",
    "no_clasificado": "No Clasificado",
    "otros_servicios": "Otros Servicios",
    "servicios_prof_tecn": "Servicios Profesionales y Técnicos",
}
STATE_FLAGS = {"activo": "A", "inactivo": "I"}
BALANCE = ("ingresos", "egresos", "activos", "pasivos")

# The flow columns of the feature tables.
PRODUCTS = ("Ahorro", "Credito", "CDT")
CHANNELS = ("Fisico", "Virtual")
TIERS = ("jurisdiccion_0", "jurisdiccion_3", "jurisdiccion_4", "jurisdiccion_5", "jurisdiccion_6")
FLOWS = ("Egreso", "Ingreso")
VIEWS = {"product": "tipo_prod", "channel": "tipo_canal", "tier": "jurisdiccion"}
VIEW_VALUES = {
    "product": [f"{p}_{f}" for p in PRODUCTS for f in FLOWS],
    "channel": [f"{c}_{f}" for c in CHANNELS for f in FLOWS],
    "tier": [f"{t}_{f}" for t in TIERS for f in FLOWS],
}
FLOW_COLUMNS = [n for v in VIEWS for n in VIEW_VALUES[v]]
LOW_AMOUNT_PRODUCT = "8"
LEGAL_DOCUMENT = "Nit"
REPLACED = ("ingresos_mens", "otros_ingresos", "egresos_mens", "total_activos", "total_pasivos", "valor_patrimoni")


def clean_clients(raw: DataFrame) -> DataFrame:
    """Latest row of each client with its industry group and balance columns."""
    year = F.col("year") if "year" in raw.columns else year_in_name(F.col("source_file"), "20[0-9]{2}")
    keyed = raw.withColumns({"normalized_id": norm_key(F.col("documento")), "year_value": year})
    ties = [F.col("source_file").desc_nulls_last()] if "source_file" in raw.columns else []
    latest = latest_per_key(keyed, F.col("normalized_id"), [F.col("year_value").desc_nulls_last(), *ties])
    shaped = replace_columns(latest, REPLACED, income_columns(latest.columns))
    return shaped.withColumn("ciiu_o", F.col("ciiu")).withColumn("ciiu", industry_group(F.col("ciiu")))


def clean_moves(raw: DataFrame, years: tuple[int, int] = (2022, 2024)) -> DataFrame:
    """Movements with an amount, made absolute, with standard place, tier and year bucket."""
    amount = F.col("monto").cast("double")
    kept = raw.where(F.col("monto").isNotNull() & (amount != 0)).withColumns(
        {
            "monto": F.abs(amount),
            "fecha_transac": as_date(raw.schema, "fecha_transac"),
            "normalized_id": norm_key(F.col("num_ident")),
        }
    )
    dated = kept.withColumn("calculated_year", year_bucket(F.col("fecha_transac"), *years))
    return standardise_places(dated, "jurisdiccion")


def clean_tables(raw_clients: DataFrame, raw_moves: DataFrame, dedupe: bool = True) -> tuple[DataFrame, DataFrame]:
    """Clients with movements and movements with a client."""
    return referential_filter(clean_clients(raw_clients), clean_moves(raw_moves), "normalized_id", dedupe)


def feature_tables(clients: DataFrame, moves: DataFrame, scale: int | None = None) -> DataFrame:
    """One row per client with its ``population`` and every feature of the three populations.

    A single pass over the movements serves all three: sums are kept apart for low-amount
    and other movements, and a client with any low-amount movement takes that side alone.
    Movements without a product name belong to neither side.
    """
    low = F.col("nombre_prod") == LOW_AMOUNT_PRODUCT
    product = F.when(low, F.col("tipo_prod")).otherwise(savings_product(F.col("tipo_prod")))
    sided = moves.where(F.col("nombre_prod").isNotNull()).select(
        "normalized_id",
        "fecha_transac",
        product.alias("tipo_prod"),
        "tipo_canal",
        "tipo_transac",
        "jurisdiccion",
        "monto",
        low.alias("low_side"),
    )
    sums = behaviour(
        sided, "normalized_id", F.col("fecha_transac"), VIEWS, "tipo_transac", "monto", VIEW_VALUES, scale, ["low_side"]
    )
    # Two rows per client at most; the low-amount side compares greater and wins.
    own_side = sums.groupBy("normalized_id").agg(
        F.max(F.struct("low_side", "num_transa", *FLOW_COLUMNS)).alias("side")
    ).select("normalized_id", "side.*")
    population = (
        F.when(F.col("low_side"), LOW_AMOUNT)
        .when(F.col("tipo_documento") == LEGAL_DOCUMENT, LEGAL)
        .otherwise(NATURAL)
    )
    wide = clients.join(own_side, "normalized_id", "left").withColumn("population", population)
    strict = {**indicators(F.col("ciiu"), INDUSTRY_FLAGS, "null"), **indicators(F.col("estado"), STATE_FLAGS, "null")}
    lenient = {
        **indicators(F.col("ciiu"), INDUSTRY_FLAGS, "zero", "no_clasificado"),
        **indicators(F.col("estado"), STATE_FLAGS, "null"),
    }
    legal = F.col("population") == LEGAL
    flags = {n: F.when(legal, strict[n]).otherwise(lenient[n]) for n in strict}
    return wide.withColumns(flags).select(
        F.col("normalized_id").alias("num_ident"), "population", *flags, *BALANCE, "num_transa", *FLOW_COLUMNS
    )


def population_table(features: DataFrame, population: str) -> DataFrame:
    """The columns one population is modelled on."""
    rows = features.where(F.col("population") == population)
    merged = [c for c in FLOW_COLUMNS if not c.startswith("CDT_")]
    if population == LOW_AMOUNT:
        return rows.select("num_ident", "num_transa", *FLOW_COLUMNS)
    if population in (LEGAL, NATURAL):
        return rows.select("num_ident", *INDUSTRY_FLAGS, *STATE_FLAGS, *BALANCE, "num_transa", *merged)
    raise ValueError(f"unknown population {population}")
