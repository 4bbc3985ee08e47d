"""Raw to clean tables: latest row per key, referential filters, aligned columns, lookups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import NumericType

from tamiz.data.jurisdictions import TIER_INTERNATIONAL, TIER_OF_CITY, TIER_OTHER, place_rows
from tamiz.functions.recodes import recode
from tamiz.functions.text import norm_key


def latest_per_key(df: DataFrame, key: Column, order: Sequence[Column]) -> DataFrame:
    """First row of every key under ``order``.

    Spark pushes the rank limit below the shuffle, so each task sends one row per key
    and a key that owns much of the table (missing ids, for one) stays small.
    """
    window = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("rn", F.row_number().over(window)).where(F.col("rn") == 1)


def referential_filter(
    clients: DataFrame, moves: DataFrame, key: str, dedupe: bool = True
) -> tuple[DataFrame, DataFrame]:
    """Clients that have movements and movements that have a client.

    ``dedupe`` also drops rows that repeat another one in every column.

    The movements meet the client keys on a copy of ``key`` that is dropped again. The planner then
    cannot reuse that partitioning for later steps, which would tie every row of a very large client
    to one task: the join may split such a client, and copies collapse inside the tasks before they
    are shuffled by all columns.
    """
    kept_clients = clients.join(moves.select(key).distinct(), key, "left_semi")
    copy = F.concat(F.col(key).cast("string"), F.lit("")).alias("__key")
    known = clients.select(copy).distinct()
    kept_moves = moves.select("*", copy).join(known, "__key", "left_semi").drop("__key")
    if dedupe:
        kept_clients, kept_moves = kept_clients.distinct(), kept_moves.distinct()
    return kept_clients, kept_moves


def semi_join(left: DataFrame, right: DataFrame, key: str, match_nulls: bool = False) -> DataFrame:
    """Rows of ``left`` whose key occurs in ``right``."""
    keys = right.select(F.col(key).alias("__key")).distinct()
    on = left[key].eqNullSafe(keys["__key"]) if match_nulls else left[key] == keys["__key"]
    return left.join(keys, on, "left_semi")


def anti_join(left: DataFrame, right: DataFrame, key: str, match_nulls: bool = False) -> DataFrame:
    """Rows of ``left`` whose key does not occur in ``right``."""
    keys = right.select(F.col(key).alias("__key")).distinct()
    on = left[key].eqNullSafe(keys["__key"]) if match_nulls else left[key] == keys["__key"]
    return left.join(keys, on, "left_anti")


def align_columns(df: DataFrame, expected: Mapping[str, str]) -> DataFrame:
    """Add each expected column that is absent, as nulls of its type."""
    missing = {n: F.lit(None).cast(t) for n, t in expected.items() if n not in df.columns}
    return df.withColumns(missing) if missing else df


def stack_by_name(*parts: DataFrame) -> DataFrame:
    """Rows of all parts; a column that a part lacks is null there."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def replace_columns(df: DataFrame, drop: Sequence[str], new: Mapping[str, Column]) -> DataFrame:
    """All columns but ``drop``, then the new ones."""
    kept = [F.col(c) for c in df.columns if c not in set(drop)]
    return df.select(*kept, *[expr.alias(name) for name, expr in new.items()])


def place_lookup(spark: SparkSession) -> DataFrame:
    """Place-name table, keyed by normalised spelling (a fixed list of 139 rows)."""
    rows = spark.createDataFrame(place_rows(), "original string, standardized string, internacional string")
    return rows.select(norm_key(F.col("original")).alias("place_key"), "standardized", "internacional")


def standardise_places(moves: DataFrame, place: str) -> DataFrame:
    """Add the standard name (``jurisdiccion_o``), the international flag and the risk tier (``jurisdiccion``)."""
    places = place_lookup(moves.sparkSession)
    lookup = F.broadcast(places.withColumn("__tier", risk_tier(F.col("standardized"), F.col("internacional"))))
    keyed = moves.withColumn("place_key", norm_key(F.col(place))).drop(place)
    named = keyed.join(lookup, "place_key", "left").drop("place_key").withColumnRenamed("standardized", "jurisdiccion_o")
    return named.withColumn("jurisdiccion", F.coalesce("__tier", F.lit(TIER_OTHER))).drop("__tier")


def risk_tier(place: Column, international: Column) -> Column:
    """Tier of a standard place name: abroad first, then the listed cities, then the rest."""
    return F.when(international == "I", TIER_INTERNATIONAL).otherwise(recode(place, TIER_OF_CITY, TIER_OTHER))


def income_columns(columns: Sequence[str]) -> dict[str, Column]:
    """Balance columns of a client from whichever source columns exist; absent ones give null."""
    have = set(columns)

    def total(*names: str) -> Column:
        present = [F.coalesce(F.col(n), F.lit(0.0)) for n in names if n in have]
        out = F.lit(None).cast("double")
        for i, part in enumerate(present):
            out = part if i == 0 else out + part
        return out

    return {
        "ingresos": total("ingresos_mens", "otros_ingresos"),
        "egresos": total("egresos_mens"),
        "activos": total("total_activos"),
        "pasivos": total("total_pasivos"),
    }


def update_where(df: DataFrame, column: str, condition: Column, value: Column) -> DataFrame:
    """Set ``column`` on the rows that meet ``condition``."""
    return df.withColumn(column, F.when(condition, value).otherwise(F.col(column)))


def common_numeric(first: DataFrame, second: DataFrame) -> list[str]:
    """Names that are numeric columns of both frames, in the order of the first."""
    numeric = [{f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)} for df in (first, second)]
    return [c for c in first.columns if c in numeric[0] & numeric[1]]
