"""Associates: semester files of clients and movements to one feature table."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, functions as F

from tamiz.functions.dates import month_key, semester_bucket, years_between
from tamiz.functions.recodes import (
    activity_group,
    channel_group,
    contract_group,
    education_level,
    sector_group,
    stratum_group,
)
from tamiz.functions.text import file_base_name, norm_key
from tamiz.operators.consolidate import latest_per_key, referential_filter, semi_join
from tamiz.operators.features import behaviour, one_hot

REFERENCE_DATE = date(2024, 12, 31)

# The attribute levels that become columns, and the column names of the feature table.
LEVELS = {
    "tipo_contrato": ["Indefinido", "Otro"],
    "sector_economico": [
        "Sector Privado",
        "Sector Publico Administrativo",
        "Sector Publico Educacion",
        "Sector Publico Pensionado",
        "Sector Publico Salud",
    ],
    "actividad_economica": ["Asalariado", "Otro"],
}
SHORT_NAMES = {
    "tipo_contrato_Indefinido": "T_Contr_Indef",
    "tipo_contrato_Otro": "T_Contr_Otro",
    "sector_economico_Sector Privado": "Sec_Econ_Priv",
    "sector_economico_Sector Publico Administrativo": "Sec_Econ_Pub_Admon",
    "sector_economico_Sector Publico Educacion": "Sec_Econ_Pub_Edu",
    "sector_economico_Sector Publico Pensionado": "Sec_Econ_Pub_Pens",
    "sector_economico_Sector Publico Salud": "Sec_Econ_Pub_Salud",
    "actividad_economica_Asalariado": "Act_Eco_Asalar",
    "actividad_economica_Otro": "Act_Eco_Otro",
}
VIEWS = {"product": "tipo_prod", "channel": "tipo_canal"}
VIEW_VALUES = {
    "product": ["Ahorro_Egreso", "Ahorro_Ingreso", "Credito_Egreso", "Credito_Ingreso"],
    "channel": ["Electronico_Egreso", "Electronico_Ingreso", "Fisico_Egreso", "Fisico_Ingreso"],
}
BALANCE = ("ingresos", "egresos", "activos", "pasivos")
CONTINUOUS = ("num_transa", *BALANCE, *VIEW_VALUES["product"], *VIEW_VALUES["channel"])


def clean_tables(raw_clients: DataFrame, raw_moves: DataFrame, dedupe: bool = True) -> tuple[DataFrame, DataFrame]:
    """Latest semester row per client, movements with their own semester, each having its counterpart."""
    keyed = raw_clients.withColumn("normalized_id", norm_key(F.col("num_identificacion")))
    order = [F.col("semestre").desc_nulls_last(), F.col("source_file").desc_nulls_last()]
    clients = latest_per_key(keyed, F.col("normalized_id"), order)
    moves = raw_moves.withColumnRenamed("semestre", "semestre_archivo").withColumns(
        {
            "normalized_id": norm_key(F.col("num_identificacion")),
            "file_name": file_base_name(F.col("source_file")),
            "semestre": semester_bucket(F.col("fecha_transaccion")),
        }
    )
    return referential_filter(clients, moves, "normalized_id", dedupe)


def client_attributes(clients: DataFrame, reference: date = REFERENCE_DATE) -> DataFrame:
    """Recoded attributes; age and tenure are at hand but not modelled."""
    return clients.withColumns(
        {
            "edad": years_between(F.col("fecha_nacimiento"), reference),
            "antiguedad": years_between(F.col("fecha_ingreso"), reference),
            "tipo_contrato": contract_group(F.col("tipo_contrato"), F.col("actividad_economica")),
            "actividad_economica": activity_group(F.col("actividad_economica")),
            "nivel_escolaridad": education_level(F.col("nivel_escolaridad")),
            "sector_economico": sector_group(F.col("sector_economico")),
            "estrato": stratum_group(F.col("estrato")),
            "ingresos": F.col("salario_actual") + F.col("otros_ingresos"),
        }
    )


def feature_table(clients: DataFrame, moves: DataFrame, scale: int | None = None) -> DataFrame:
    """One row per associate with movements."""
    members = clients.where(F.col("rol") == "Asociado")
    members = semi_join(members, moves, "normalized_id")
    flat = moves.where(F.col("monto_transaccion") > 0).select(
        "normalized_id",
        month_key(F.col("fecha_transaccion")).alias("month_yr"),
        F.col("tipo_producto").alias("tipo_prod"),
        F.col("tipo_transaccion").alias("tipo_transac"),
        channel_group(F.col("tipo_canal_transaccion")).alias("tipo_canal"),
        F.col("monto_transaccion").alias("monto"),
    )
    sums = behaviour(flat, "normalized_id", F.col("month_yr"), VIEWS, "tipo_transac", "monto", VIEW_VALUES, scale)
    attributes = client_attributes(members).select("normalized_id", *LEVELS, *BALANCE)
    flags = one_hot(attributes, LEVELS).withColumnsRenamed(SHORT_NAMES)
    return flags.join(sums, "normalized_id", "left").select(
        F.col("normalized_id").alias("num_identificacion"), *SHORT_NAMES.values(), *CONTINUOUS
    )
