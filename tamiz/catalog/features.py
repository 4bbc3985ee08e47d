"""Queries that build per-client features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tamiz.catalog.base import query, table
from tamiz.catalog.cleaning import ASSOCIATE_SQL, SILVER_SQL, associate_silver, silver
from tamiz.functions import dates
from tamiz.functions.text import spaced_names
from tamiz.operators import features as feat
from tamiz.operators.quality import category_share, row_counts, zero_share
from tamiz.operators.route import LEGAL, LOW_AMOUNT, NATURAL, assign_population
from tamiz.plans import associates, populations

SCALE = 2  # amounts have two decimals


def _sql_sum(name: str, column: str, flow: str, amount: str, per: str | None = None) -> str:
    total = f"coalesce(sum(CASE WHEN coalesce({column}, 'NA') || '_' || {flow} = '{name}' THEN round({amount} * 100) END), 0) / 100.0"
    return f'{total}{" / " + per if per else ""} AS "{name}"'


def _orders_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        "o_custkey",
        F.col("o_orderdate").cast("date").alias("day"),
        F.col("o_orderstatus").alias("flow"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.substring("o_orderpriority", 3, 20)).alias("channel"),
        F.col("o_totalprice").alias("amount"),
    )


@query(
    "activity_summary_month",
    """SELECT o_custkey, count(*) AS n_moves, count(DISTINCT strftime(o_orderdate, '%Y-%m')) AS n_periods,
      round_even(count(*) / count(DISTINCT strftime(o_orderdate, '%Y-%m')), 0) AS num_transa FROM orders GROUP BY 1""",
)
def activity_summary_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feat.activity_summary(_orders_moves(spark, sf_dir), "o_custkey", dates.month_key(F.col("day")))


@query(
    "activity_summary_day",
    """WITH e AS (SELECT user_id, CASE WHEN event_type <> 'error' THEN CAST(ts AS DATE) END AS day FROM events)
    SELECT user_id, count(*) AS n_moves,
      count(DISTINCT day) + max(CASE WHEN day IS NULL THEN 1 ELSE 0 END) AS n_periods,
      round_even(count(*) / (count(DISTINCT day) + max(CASE WHEN day IS NULL THEN 1 ELSE 0 END)), 0) AS num_transa
    FROM e GROUP BY 1""",
)
def activity_summary_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error events carry no day, which counts as one more period."""
    day = F.when(F.col("event_type") != "error", F.col("ts").cast("date"))
    return feat.activity_summary(table(spark, sf_dir, "events"), "user_id", day)


def _item_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem", spread=True).select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice", "l_linestatus"
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    regions = table(spark, sf_dir, "region")
    joined = (
        items.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(regions, F.col("n_regionkey") == F.col("r_regionkey"))
    )
    return joined.select("o_custkey", "p_type", "r_name", "l_linestatus", F.col("l_extendedprice").alias("amount"))


_ITEMS_SQL = """FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
    JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey"""
_TYPES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")
_PRODUCT_KEYS = [f"{t}_{f}" for t in _TYPES for f in ("F", "O")]
_CHANNEL_KEYS = [f"{c}_{f}" for c in ("URGENT", "HIGH", "MEDIUM", "NOT SPECIFIED", "NA") for f in ("F", "O", "P")]


@query(
    "flow_matrix_product",
    f"""SELECT o_custkey, {", ".join(_sql_sum(n, "p_type", "l_linestatus", "l_extendedprice") for n in _PRODUCT_KEYS)}
    {_ITEMS_SQL} GROUP BY 1""",
)
def flow_matrix_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product by flow, with the column names found in the data."""
    moves = _item_moves(spark, sf_dir)
    return feat.flow_matrix(moves, "o_custkey", {"product": "p_type"}, "l_linestatus", "amount", scale=SCALE)


@query(
    "flow_matrix_channel",
    f"""WITH m AS (SELECT *, CASE WHEN o_orderpriority <> '5-LOW' THEN substring(o_orderpriority, 3, 20) END AS channel
      FROM orders)
    SELECT o_custkey, {", ".join(_sql_sum(n, "channel", "o_orderstatus", "o_totalprice") for n in _CHANNEL_KEYS)}
    FROM m GROUP BY 1""",
)
def flow_matrix_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channel by flow over declared names; a missing channel reads NA."""
    moves = _orders_moves(spark, sf_dir)
    values = {"channel": _CHANNEL_KEYS}
    return feat.flow_matrix(moves, "o_custkey", {"channel": "channel"}, "flow", "amount", values, SCALE)


@query(
    "flow_matrix_jurisdiction",
    f"""{SILVER_SQL} SELECT normalized_id, {", ".join(
        _sql_sum(n, "jurisdiccion", "tipo_transac", "monto") for n in populations.VIEW_VALUES["tier"])}
    FROM silver_moves GROUP BY 1""",
)
def flow_matrix_jurisdiction(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, moves = silver(spark, sf_dir)
    values = {"tier": populations.VIEW_VALUES["tier"]}
    return feat.flow_matrix(moves, "normalized_id", {"tier": "jurisdiccion"}, "tipo_transac", "monto", values, SCALE)


@query(
    "flow_per_period",
    """SELECT user_id, count(*) AS n_moves, count(DISTINCT CAST(ts AS DATE)) AS n_periods,
      round_even(count(*) / count(DISTINCT CAST(ts AS DATE)), 0) AS num_transa,
      sum(CASE WHEN event_type = 'click' THEN round(value * 100) ELSE 0 END) / 100.0
        / count(DISTINCT CAST(ts AS DATE)) AS click_in,
      sum(CASE WHEN event_type = 'error' THEN round(value * 100) ELSE 0 END) / 100.0
        / count(DISTINCT CAST(ts AS DATE)) AS error_in
    FROM events GROUP BY 1""",
)
def flow_per_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event value by type per active day."""
    events = table(spark, sf_dir, "events").withColumn("flow", F.lit("in"))
    names = ["click_in", "error_in"]
    return feat.behaviour(
        events, "user_id", F.col("ts").cast("date"), {"kind": "event_type"}, "flow", "value", {"kind": names}, SCALE
    )


@query(
    "one_hot_levels",
    """SELECT c_custkey, """
    + ", ".join(
        f"""CASE WHEN c_mktsegment = '{s}' THEN 1 ELSE 0 END AS "c_mktsegment_{s}" """
        for s in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
    )
    + " FROM customer",
)
def one_hot_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every level found in the data becomes a column."""
    return feat.one_hot(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), ["c_mktsegment"])


_LEVELS_SQL = """WITH long AS (
    SELECT p_partkey, 'p_name' AS "column", p_name AS level FROM part
    UNION ALL SELECT p_partkey, 'p_brand', CASE WHEN p_size > 5 THEN p_brand END FROM part),
  d AS (SELECT "column", level, row_number() OVER (ORDER BY "column", level) - 1 AS position
    FROM (SELECT DISTINCT "column", level FROM long WHERE level IS NOT NULL))"""


def _part_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    return parts.select("p_partkey", "p_name", F.when(F.col("p_size") > 5, F.col("p_brand")).alias("p_brand"))


@query("one_hot_long", f"""{_LEVELS_SQL} SELECT p_partkey, "column", level, 1 AS value FROM long WHERE level IS NOT NULL""")
def one_hot_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names have nearly as many levels as rows; some brands are missing."""
    return feat.one_hot_long(_part_levels(spark, sf_dir), "p_partkey", ["p_name", "p_brand"])


@query(
    "one_hot_sparse",
    f"""{_LEVELS_SQL}, f AS (SELECT p_partkey, string_agg(position, ' ' ORDER BY position) AS positions
      FROM long JOIN d ON long."column" = d."column" AND long.level = d.level GROUP BY p_partkey)
    SELECT p.p_partkey, coalesce(positions, '') AS positions FROM part p LEFT JOIN f ON f.p_partkey = p.p_partkey""",
)
def one_hot_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts, columns = _part_levels(spark, sf_dir), ["p_name", "p_brand"]
    out = feat.one_hot_sparse(parts, "p_partkey", columns, feat.level_dictionary(parts, columns))
    return out.withColumn("positions", F.array_join("positions", " "))


@query("spaced_headings", 'SELECT n_nationkey AS "n nationkey", n_name AS "n name", n_regionkey AS "n regionkey" FROM nation')
def spaced_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    return nations.toDF(*spaced_names(nations.columns))


@query(
    "dummies_null_policy",
    """WITH c AS (SELECT c_custkey, CASE WHEN c_nationkey > 2 THEN c_mktsegment END AS seg FROM customer)
    SELECT c_custkey, CAST(seg = 'BUILDING' AS INTEGER) AS strict_building, CAST(seg = 'OTHER' AS INTEGER) AS strict_other,
      CASE WHEN seg = 'BUILDING' THEN 1 ELSE 0 END AS lenient_building,
      CASE WHEN seg = 'OTHER' OR seg IS NULL THEN 1 ELSE 0 END AS lenient_other FROM c""",
)
def dummies_null_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg = F.when(F.col("c_nationkey") > 2, F.col("c_mktsegment"))
    strict = feat.indicators(seg, {"strict_building": "BUILDING", "strict_other": "OTHER"}, "null")
    lenient = feat.indicators(
        seg, {"lenient_building": "BUILDING", "lenient_other": "OTHER"}, "zero", "lenient_other"
    )
    rows = table(spark, sf_dir, "customer")
    return rows.select("c_custkey", *[e.alias(n) for n, e in {**strict, **lenient}.items()])


_ROUTE_SQL = f"""{SILVER_SQL},
low AS (SELECT DISTINCT normalized_id FROM silver_moves WHERE nombre_prod = '8'),
routed AS (SELECT c.*, CASE WHEN low.normalized_id IS NOT NULL THEN 'bajo_monto'
  WHEN tipo_documento = 'Nit' THEN 'persona_juridica' ELSE 'persona_natural' END AS population
  FROM silver_clients c LEFT JOIN low USING (normalized_id)),
sided AS (SELECT * REPLACE (CASE WHEN nombre_prod = '8' THEN tipo_prod WHEN tipo_prod = 'CDT' THEN 'Ahorro'
  ELSE tipo_prod END AS tipo_prod), nombre_prod = '8' AS low_side FROM silver_moves WHERE nombre_prod IS NOT NULL),
sums AS (SELECT normalized_id, low_side, count(DISTINCT fecha_transac) AS days,
  round_even(count(*) / count(DISTINCT fecha_transac), 0) AS num_transa,
  {", ".join(
      _sql_sum(n, populations.VIEWS[v], "tipo_transac", "monto", "count(DISTINCT fecha_transac)")
      for v in populations.VIEWS for n in populations.VIEW_VALUES[v])}
  FROM sided GROUP BY 1, 2),
wide AS (SELECT * FROM routed LEFT JOIN sums ON routed.normalized_id = sums.normalized_id
  AND sums.low_side = (routed.population = 'bajo_monto'))
"""


def _flag_sql(strict: bool) -> str:
    out = []
    for name, value in populations.INDUSTRY_FLAGS.items():
        if strict:
            out.append(f"CAST(ciiu = '{value}' AS INTEGER) AS {name}")
        else:
            missing = 1 if name == "no_clasificado" else 0
            out.append(f"CASE WHEN ciiu IS NULL THEN {missing} WHEN ciiu = '{value}' THEN 1 ELSE 0 END AS {name}")
    out += [f"CAST(estado = '{v}' AS INTEGER) AS {n}" for n, v in populations.STATE_FLAGS.items()]
    return ", ".join(out)


_MERGED = [c for c in populations.FLOW_COLUMNS if not c.startswith("CDT_")]
_BALANCE_SQL = ", ".join(populations.BALANCE)


@query(
    "segment_routing",
    f"""{_ROUTE_SQL} SELECT normalized_id, tipo_documento, population FROM routed""",
)
def segment_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    clients, moves = silver(spark, sf_dir)
    routed = assign_population(
        clients, moves, "normalized_id", F.col("nombre_prod") == "8", F.col("tipo_documento") == "Nit"
    )
    return routed.select("normalized_id", "tipo_documento", "population")


def population_features(spark: SparkSession, sf_dir: str, population: str) -> DataFrame:
    clients, moves = silver(spark, sf_dir)
    return populations.population_table(populations.feature_tables(clients, moves, SCALE), population)


def _population_sql(population: str, columns: str) -> str:
    return f"""{_ROUTE_SQL} SELECT routed_id AS num_ident, {columns} FROM
    (SELECT *, wide.normalized_id AS routed_id FROM wide) WHERE population = '{population}'"""


@query(
    "features_low_amount",
    _population_sql(LOW_AMOUNT, "num_transa, " + ", ".join(f'"{c}"' for c in populations.FLOW_COLUMNS)),
)
def features_low_amount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return population_features(spark, sf_dir, LOW_AMOUNT)


@query(
    "features_legal",
    _population_sql(LEGAL, f"{_flag_sql(True)}, {_BALANCE_SQL}, num_transa, " + ", ".join(f'"{c}"' for c in _MERGED)),
)
def features_legal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return population_features(spark, sf_dir, LEGAL)


@query(
    "features_natural",
    _population_sql(NATURAL, f"{_flag_sql(False)}, {_BALANCE_SQL}, num_transa, " + ", ".join(f'"{c}"' for c in _MERGED)),
)
def features_natural(spark: SparkSession, sf_dir: str) -> DataFrame:
    return population_features(spark, sf_dir, NATURAL)


_SECTOR = """CASE WHEN sector_economico IN ('Sector Privado Esal', 'Sector Privado Financiero Solidario')
  THEN 'Sector Privado' ELSE sector_economico END"""
_CONTRACT = """CASE WHEN actividad_economica IS NULL THEN NULL WHEN actividad_economica = 'Independiente' THEN 'Otro'
  WHEN tipo_contrato IS NULL THEN NULL WHEN tipo_contrato = 'Término Indefinido' THEN 'Indefinido' ELSE 'Otro' END"""
_ACTIVITY = """CASE WHEN actividad_economica = 'Asalariado' THEN 'Asalariado'
  WHEN actividad_economica IS NOT NULL THEN 'Otro' END"""
_ASSOCIATE_FLAGS = ", ".join(
    f"CAST({expr} = '{level}' AS INTEGER) AS {associates.SHORT_NAMES[f'{column}_{level}']}"
    for column, expr in (("tipo_contrato", _CONTRACT), ("sector_economico", _SECTOR), ("actividad_economica", _ACTIVITY))
    for level in associates.LEVELS[column]
)


@query(
    "client_features",
    f"""{ASSOCIATE_SQL},
    m AS (SELECT normalized_id, strftime(fecha_transaccion, '%Y-%m') AS month_yr, tipo_producto, tipo_transaccion,
      CASE WHEN tipo_canal_transaccion = 'Físico' THEN 'Fisico'
        WHEN tipo_canal_transaccion IS NOT NULL THEN 'Electronico' END AS canal, monto_transaccion
      FROM silver_moves WHERE monto_transaccion > 0),
    sums AS (SELECT normalized_id, round_even(count(*) / count(DISTINCT month_yr), 0) AS num_transa,
      {", ".join(_sql_sum(n, c, "tipo_transaccion", "monto_transaccion", "count(DISTINCT month_yr)")
        for v, c in (("product", "tipo_producto"), ("channel", "canal")) for n in associates.VIEW_VALUES[v])}
      FROM m GROUP BY 1)
    SELECT c.normalized_id AS num_identificacion, {_ASSOCIATE_FLAGS}, num_transa,
      salario_actual + otros_ingresos AS ingresos, egresos, activos, pasivos,
      {", ".join(f'"{n}"' for v in associates.VIEWS for n in associates.VIEW_VALUES[v])}
    FROM silver_clients c LEFT JOIN sums ON c.normalized_id = sums.normalized_id WHERE rol = 'Asociado'""",
)
def client_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The associate feature table."""
    return associates.feature_table(*associate_silver(spark, sf_dir), scale=SCALE)


@query(
    "category_share",
    """SELECT c_mktsegment, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM customer), 1) AS percentage
    FROM customer GROUP BY 1""",
)
def category_share_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return category_share(table(spark, sf_dir, "customer"), "c_mktsegment", 1)


_COUNTED = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
            "embeddings", "pages", "benchmark", "labels", "conversations")


@query(
    "table_row_counts",
    " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in _COUNTED),
)
def table_row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return row_counts({t: table(spark, sf_dir, t) for t in _COUNTED})


@query(
    "zero_share",
    """WITH c AS (SELECT count(*) AS n, count(*) FILTER (WHERE l_discount = 0) AS a, count(*) FILTER (WHERE l_tax = 0) AS b,
      count(*) FILTER (WHERE l_quantity = 0) AS d FROM lineitem)
    SELECT 'l_discount' AS variable, a AS zeros, round(a * 100.0 / n, 2) AS zero_percentage FROM c
    UNION ALL SELECT 'l_tax', b, round(b * 100.0 / n, 2) FROM c
    UNION ALL SELECT 'l_quantity', d, round(d * 100.0 / n, 2) FROM c
    UNION ALL SELECT 'partial', NULL, NULL""",
)
def zero_share_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").withColumn("partial", F.when(F.col("l_tax") > 0, F.col("l_tax")))
    return zero_share(items, ["l_discount", "l_tax", "l_quantity", "partial"])


@query(
    "column_minimums",
    """SELECT 'o_totalprice' AS variable, min(o_totalprice) AS minimum FROM orders
    UNION ALL SELECT 'o_custkey', CAST(min(o_custkey) AS DOUBLE) FROM orders""",
)
def column_minimums_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tamiz.operators.quality import column_minimums

    return column_minimums(table(spark, sf_dir, "orders"), ["o_totalprice", "o_custkey"])
