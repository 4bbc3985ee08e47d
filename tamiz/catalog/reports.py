"""Queries behind profiles, alerts, radar tables and distribution plots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tamiz.catalog.base import query, table
from tamiz.catalog.features import _ROUTE_SQL, SCALE
from tamiz.catalog.cleaning import silver
from tamiz.operators import profile as prof

from tamiz.plans import populations

_SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
_PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
_PROFILED = ("ingresos", "activos", "num_transa", "Ahorro_Egreso", "Fisico_Ingreso")


def _type6(source: str, group: str, value: str) -> str:
    """SQL for the type-6 quartiles of ``value`` by ``group``."""
    def at(p: float) -> str:
        h = f"least(greatest((n + 1) * {p}, 1), n)"
        low = f"max(CASE WHEN rn = floor({h}) THEN v END)"
        high = f"max(CASE WHEN rn = least(floor({h}) + 1, n) THEN v END)"
        return f"{low} + (max({h}) - floor(max({h}))) * ({high} - {low})"

    return f"""SELECT g, {at(0.25)} AS q1, {at(0.75)} AS q3 FROM (
      SELECT {group} AS g, {value} AS v, row_number() OVER (PARTITION BY {group} ORDER BY {value}) AS rn,
        count(*) OVER (PARTITION BY {group}) AS n FROM {source} WHERE {value} IS NOT NULL) GROUP BY g"""


def _spread(groups, expr: str, prefix: str = "") -> str:
    return ", ".join(f"max(CASE WHEN g = '{g}' THEN {expr} END) AS \"{prefix}{g}\"" for g in groups)


def _alert_columns(groups) -> str:
    stats = (("q3", "q3"), ("iqr", "q3 - q1"), ("alert", "q3 + 1.5 * (q3 - q1)"))
    return ", ".join(
        f"round(max(CASE WHEN g = '{g}' THEN {e} END), 4) AS \"{g}_{n}\"" for g in groups for n, e in stats
    )


@query(
    "alert_thresholds",
    " UNION ALL ".join(
        f"SELECT '{v}' AS variable, {_alert_columns(_PRIORITIES)} FROM ({_type6('orders', 'o_orderpriority', v)})"
        for v in ("o_totalprice", "o_custkey")
    ),
)
def alert_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = prof.alert_thresholds(
        table(spark, sf_dir, "orders", spread=True), "o_orderpriority", _PRIORITIES, ["o_totalprice", "o_custkey"]
    )
    return out.select("variable", *[F.round(F.col(f"`{c}`"), 4).alias(c) for c in out.columns if c != "variable"])


@query(
    "alert_thresholds_movements",
    f"""SELECT 'l_extendedprice' AS variable, {_alert_columns(("A", "N", "R"))}
    FROM ({_type6("lineitem", "l_returnflag", "l_extendedprice")})""",
)
def alert_thresholds_movements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thresholds over the largest table: few groups, each a third of all rows."""
    out = prof.alert_thresholds(
        table(spark, sf_dir, "lineitem", spread=True), "l_returnflag", ("A", "N", "R"), ["l_extendedprice"]
    )
    return out.select("variable", *[F.round(F.col(f"`{c}`"), 4).alias(c) for c in out.columns if c != "variable"])


@query(
    "alert_names_split",
    """SELECT c_mktsegment, 'acctbal' AS variable, 'min' AS stat_type, min(c_acctbal) AS value FROM customer GROUP BY 1
    UNION ALL SELECT c_mktsegment, 'acctbal', 'max', max(c_acctbal) FROM customer GROUP BY 1""",
)
def alert_names_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns named ``variable_xstatistic`` turned into rows."""
    wide = table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(
        F.min("c_acctbal").alias("acctbal_xmin"), F.max("c_acctbal").alias("acctbal_xmax")
    )
    return prof.split_names(wide, "c_mktsegment", ["acctbal_xmin", "acctbal_xmax"])


@query(
    "cluster_profile",
    f"""WITH c AS (SELECT c_mktsegment AS g, c_acctbal AS balance, CAST(c_nationkey AS DOUBLE) AS nation,
      CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END AS overdrawn, CASE WHEN c_nationkey = 3 THEN 1 ELSE 0 END AS abroad
      FROM customer),
    s AS (SELECT g, avg(overdrawn) AS overdrawn, avg(abroad) AS abroad, quantile_cont(balance, 0.5) AS balance,
      quantile_cont(nation, 0.5) AS nation FROM c GROUP BY 1)
    """
    + " UNION ALL ".join(
        "SELECT '{0}' AS variable, {1} FROM s".format(
            v, ", ".join(f"max(CASE WHEN g = '{g}' THEN round({v}, 6) END) AS \"{g}\"" for g in _SEGMENTS)
        )
        for v in ("overdrawn", "abroad", "balance", "nation")
    ),
)
def cluster_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = table(spark, sf_dir, "customer").select(
        "c_mktsegment",
        F.col("c_acctbal").alias("balance"),
        F.col("c_nationkey").cast("double").alias("nation"),
        F.when(F.col("c_acctbal") < 0, 1).otherwise(0).alias("overdrawn"),
        F.when(F.col("c_nationkey") == 3, 1).otherwise(0).alias("abroad"),
    )
    out = prof.cluster_profile(people, "c_mktsegment", _SEGMENTS, ["overdrawn", "abroad"], ["balance", "nation"])
    return out.select("variable", *[F.round(F.col(s), 6).alias(s) for s in _SEGMENTS])


@query(
    "population_profile",
    f"""{_ROUTE_SQL} SELECT population, v AS variable, round(quantile_cont(x, 0.5), 6) AS median FROM (
    """
    + " UNION ALL ".join(
        f"SELECT population, '{c}' AS v, CAST(\"{c}\" AS DOUBLE) AS x FROM wide" for c in _PROFILED
    )
    + ") WHERE x IS NOT NULL GROUP BY 1, 2",
)
def population_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median features of the three populations."""
    features = populations.feature_tables(*silver(spark, sf_dir), SCALE)
    out = prof.group_medians(features, "population", _PROFILED)
    return out.select("population", "variable", F.round("value", 6).alias("median"))


@query(
    "radar_table",
    """WITH m AS (SELECT c_mktsegment AS segment, avg(c_acctbal) AS balance, avg(c_nationkey) AS nation, 1.0 AS constant
      FROM customer WHERE c_acctbal IS NOT NULL AND c_nationkey IS NOT NULL GROUP BY 1)
    """
    + " UNION ALL ".join(
        f"""SELECT segment, '{v}' AS variable, round({v}, 6) AS value,
        round(({v} - min({v}) OVER ()) / nullif(max({v}) OVER () - min({v}) OVER (), 0), 6) AS scaled FROM m"""
        for v in ("balance", "nation", "constant")
    ),
)
def radar_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = table(spark, sf_dir, "customer").select(
        F.col("c_mktsegment").alias("segment"),
        F.col("c_acctbal").alias("balance"),
        F.col("c_nationkey").alias("nation"),
        F.lit(1.0).alias("constant"),
    )
    out = prof.radar_table(people, "segment", ["balance", "nation", "constant"])
    return out.select(
        "segment", "variable", F.round("value", 6).alias("value"), F.round("scaled", 6).alias("scaled")
    )


@query(
    "five_number_summary",
    """SELECT o_orderpriority, 'o_totalprice' AS variable, min(o_totalprice) AS minimum,
      round(quantile_cont(o_totalprice, 0.25), 4) AS q1, round(quantile_cont(o_totalprice, 0.5), 4) AS median,
      round(quantile_cont(o_totalprice, 0.75), 4) AS q3, max(o_totalprice) AS maximum FROM orders GROUP BY 1""",
)
def five_number_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = prof.five_numbers(table(spark, sf_dir, "orders", spread=True), "o_orderpriority", ["o_totalprice"])
    return out.select(
        "o_orderpriority", "variable", *[F.round(c, 4).alias(c) for c in ("minimum", "q1", "median", "q3", "maximum")]
    )


_HISTOGRAM_SQL = " UNION ALL ".join(
    f"""SELECT '{v}' AS variable, CAST(least(floor((x - low) * 20 / (high - low)), 19) + 1 AS INTEGER) AS bin, count(*) AS n
    FROM (SELECT CAST({v} AS DOUBLE) AS x, min(CAST({v} AS DOUBLE)) OVER () AS low, max(CAST({v} AS DOUBLE)) OVER () AS high
      FROM orders) GROUP BY 2"""
    for v in ("o_totalprice", "o_custkey")
)


@query("histogram20", _HISTOGRAM_SQL)
def histogram20(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = prof.histogram(table(spark, sf_dir, "orders"), ["o_totalprice", "o_custkey"])
    return out.select("variable", "bin", "n")


@query(
    "transpose_summary",
    """WITH s AS (SELECT o_orderpriority AS g, count(*) AS orders, min(o_totalprice) AS smallest FROM orders GROUP BY 1)
    SELECT 'orders' AS measure, """
    + ", ".join(f"max(CASE WHEN g = '{p}' THEN CAST(orders AS DOUBLE) END) AS \"{p}\"" for p in _PRIORITIES)
    + " FROM s UNION ALL SELECT 'smallest', "
    + ", ".join(f"max(CASE WHEN g = '{p}' THEN smallest END) AS \"{p}\"" for p in _PRIORITIES)
    + " FROM s",
)
def transpose_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures as rows, priorities as columns."""
    rows = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("orders"), F.min("o_totalprice").alias("smallest")
    )
    out = prof.transpose(rows, "o_orderpriority", _PRIORITIES, ["orders", "smallest"], "measure")
    return out.select("measure", *[F.col(f"`{p}`").cast("double").alias(p) for p in _PRIORITIES])
