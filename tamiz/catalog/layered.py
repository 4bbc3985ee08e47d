"""Queries through the layer registry and the sinks: rows are written from the shared tables and read back by name."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from tamiz.catalog.base import query, table
from tamiz.operators.consolidate import semi_join
from tamiz.operators.quality import catalog_row_counts
from tamiz.session import scratch_path
from tamiz.sources import sinks
from tamiz.sources.layers import Layers

CLIENT = "c_custkey bigint, c_nationkey int, c_mktsegment string, c_acctbal double"
MOVE = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double"
TABLES = {
    "bronze.clients": CLIENT, "bronze.moves": MOVE, "silver.clients": CLIENT, "silver.moves": MOVE,
    "gold.client_totals": "c_custkey bigint, c_mktsegment string, n_moves bigint, total decimal(38,2)",
    "gold.status_totals": "o_orderstatus string, n_moves bigint, total decimal(38,2)",
}


def _as_declared(df: DataFrame, columns: str) -> DataFrame:
    return df.select(*[F.expr(f"CAST({c.split()[0]} AS {c.split()[1]})").alias(c.split()[0]) for c in columns.split(", ")])


def _bronze(spark: SparkSession, sf_dir: str) -> Layers:
    store = Layers(spark, scratch_path(spark, "layers"), TABLES)
    store.write("bronze.clients", _as_declared(table(spark, sf_dir, "customer"), CLIENT))
    store.write("bronze.moves", _as_declared(table(spark, sf_dir, "orders"), MOVE))
    return store


def _silver(store: Layers) -> None:
    """Clients with movements and movements of known clients with an amount, read by name from bronze."""
    store.require(["bronze.clients", "bronze.moves"])
    clients = store.read("bronze.clients")
    moves = store.read("bronze.moves").where("o_totalprice > 0")
    store.write("silver.moves", semi_join(moves, clients.withColumnRenamed("c_custkey", "o_custkey"), "o_custkey"))
    moving = store.read("silver.moves").withColumnRenamed("o_custkey", "c_custkey")
    store.write("silver.clients", semi_join(clients, moving, "c_custkey"))


def _gold(store: Layers) -> None:
    store.require(["silver.clients", "silver.moves"])
    clients, moves = store.read("silver.clients"), store.read("silver.moves")
    sums = [F.count(F.lit(1)).alias("n_moves"), F.sum(F.expr("CAST(o_totalprice AS DECIMAL(18,2))")).cast("decimal(38,2)").alias("total")]
    per_client = moves.groupBy(F.col("o_custkey").alias("c_custkey")).agg(*sums)
    store.write("gold.client_totals", clients.select("c_custkey", "c_mktsegment").join(per_client, "c_custkey"))
    store.write("gold.status_totals", moves.groupBy("o_orderstatus").agg(*sums))


_SILVER_SQL = """WITH m AS (SELECT * FROM orders WHERE o_totalprice > 0 AND o_custkey IN (SELECT c_custkey FROM customer)),
  c AS (SELECT * FROM customer WHERE c_custkey IN (SELECT o_custkey FROM m))"""


@query(
    "layers_bronze_to_gold",
    f"""{_SILVER_SQL} SELECT CAST(c_custkey AS BIGINT) AS c_custkey, c_mktsegment, count(*) AS n_moves,
      CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS total
    FROM c JOIN m ON o_custkey = c_custkey GROUP BY ALL""",
)
def layers_bronze_to_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every layer reads the one below by name; the result is read from gold."""
    store = _bronze(spark, sf_dir)
    _silver(store)
    _gold(store)
    return store.read("gold.client_totals")


@query(
    "layer_row_counts",
    f"""{_SILVER_SQL} SELECT 'gold.client_totals' AS table_name, count(*) AS row_count FROM c
    UNION ALL SELECT 'gold.status_totals', count(DISTINCT o_orderstatus) FROM m""",
)
def layer_row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _bronze(spark, sf_dir)
    _silver(store)
    _gold(store)
    return store.row_counts("gold")


_SWAP_SQL = """SELECT '{reader}' AS reader, o_orderstatus, count(*) AS n_moves,
  CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS total FROM orders WHERE {where} GROUP BY ALL"""


@query(
    "table_swap",
    " UNION ALL ".join(_SWAP_SQL.format(reader=r, where=w) for r, w in (("before", "true"), ("after", "o_orderstatus <> 'F'"))),
)
def table_swap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reader planned before the swap sees the old rows, one planned after it the filtered ones."""
    store = Layers(spark, scratch_path(spark, "layers"), TABLES)
    store.write("bronze.moves", _as_declared(table(spark, sf_dir, "orders"), MOVE))
    before = store.read("bronze.moves").withColumn("reader", F.lit("before"))
    store.swap("bronze.moves", lambda df: df.where("o_orderstatus <> 'F'"))
    after = store.read("bronze.moves").withColumn("reader", F.lit("after"))
    total = F.sum(F.expr("CAST(o_totalprice AS DECIMAL(18,2))")).cast("decimal(38,2)").alias("total")
    return before.unionByName(after).groupBy("reader", "o_orderstatus").agg(F.count(F.lit(1)).alias("n_moves"), total)


@query(
    "sink_modes",
    """SELECT 'appended' AS table_name, 2 * count(*) AS row_count FROM orders
    UNION ALL SELECT 'kept', count(*) FROM orders
    UNION ALL SELECT 'replaced', count(*) FROM orders WHERE o_orderstatus = 'F'
    UNION ALL SELECT 'swapped', count(*) FROM orders WHERE o_orderstatus <> 'F'""",
)
def sink_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared tables filled by append, overwrite, create-if-absent and swap, counted through the catalog."""
    prefix, root = f"gold_{uuid.uuid4().hex[:8]}_", scratch_path(spark, "sinks")
    moves = _as_declared(table(spark, sf_dir, "orders"), MOVE)
    for name in ("appended", "kept", "replaced", "swapped"):
        sinks.create_table(spark, prefix + name, MOVE, f"{root}/{name}")
        sinks.append(moves, prefix + name)
    sinks.append(moves, prefix + "appended")
    sinks.keep_existing(moves.limit(0), prefix + "kept")
    sinks.replace(moves.where("o_orderstatus = 'F'"), prefix + "replaced", path=f"{root}/replaced_anew")
    sinks.swap(spark.table(prefix + "swapped").where("o_orderstatus <> 'F'"), prefix + "swapped")
    counts = catalog_row_counts(spark, prefix)
    return counts.withColumn("table_name", F.substring("table_name", F.lit(len(prefix) + 1), F.lit(100)))


@query(
    "semi_join_null_keys",
    """WITH k AS (SELECT lang, source, doc_id FROM documents),
       keys AS (SELECT DISTINCT CASE WHEN source = (SELECT min(source) FROM documents) THEN NULL ELSE source END AS s FROM k),
       l AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE source END AS s FROM k)
       SELECT 'nulls match' AS mode, s, count(*) AS n FROM l WHERE EXISTS (SELECT 1 FROM keys WHERE keys.s IS NOT DISTINCT FROM l.s) GROUP BY ALL
       UNION ALL SELECT 'nulls differ', s, count(*) FROM l WHERE s IN (SELECT s FROM keys WHERE s IS NOT NULL) GROUP BY ALL""",
)
def semi_join_null_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with a missing key meet missing keys, or meet nothing, by mode. Both sides hold missing keys."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    first = docs.agg(F.min("source")).scalar()
    keys = docs.select(F.when(~F.col("source").eqNullSafe(first), F.col("source")).alias("s"))
    left = docs.select(F.when(F.col("doc_id") % 3 != 0, F.col("source")).alias("s"))
    parts = [
        semi_join(left, keys, "s", match_nulls=match).groupBy("s").agg(F.count(F.lit(1)).alias("n")).withColumn("mode", F.lit(mode))
        for mode, match in (("nulls match", True), ("nulls differ", False))
    ]
    return parts[0].unionByName(parts[1])


@query(
    "null_rows_deleted",
    """SELECT o_orderstatus, count(*) AS n FROM (SELECT CASE WHEN o_orderkey % 3 > 0 THEN o_orderstatus END AS o_orderstatus FROM orders)
    WHERE o_orderstatus IS NOT NULL AND o_orderstatus <> 'P' GROUP BY ALL""",
)
def null_rows_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without a status deleted from a stored table, then those of one status; a missing condition keeps a row."""
    store = Layers(spark, scratch_path(spark, "layers"), TABLES)
    moves = _as_declared(table(spark, sf_dir, "orders"), MOVE)
    store.write("bronze.moves", moves.withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderstatus"))))
    store.delete("bronze.moves", F.col("o_orderstatus") == "P")
    store.delete("bronze.moves", F.col("o_orderstatus").isNull())
    return store.read("bronze.moves").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
