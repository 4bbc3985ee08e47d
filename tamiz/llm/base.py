"""Registry of the training-data queries, table access and stage files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tamiz.session import scratch_path

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# A word ends at ASCII white space only; these six code points are space, tab, LF, VT, FF and CR.
SPACE_RUN = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def id_keys(id_col: str) -> list[Column]:
    """Two join keys, ``_id`` and ``_no_id``, that also match missing ids with each other."""
    column = F.col(id_col)
    return [F.coalesce(column, F.lit(0).cast("long")).alias("_id"), column.isNull().alias("_no_id")]


class Stages:
    """Intermediate tables below the shared checkpoint folder.

    ``keep`` writes a table and reads it back, so that a lost executor costs one task and not the lineage.
    ``drop`` removes tables that no later result reads; what a returned DataFrame still reads stays.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def keep(self, df: DataFrame) -> DataFrame:
        path = scratch_path(self.spark, "llm")
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.stage_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for df in tables:
            path = jvm.org.apache.hadoop.fs.Path(df.stage_path)
            path.getFileSystem(conf).delete(path, True)

    def release(self) -> None:
        """Let Spark delete the shuffle files of finished steps: it does so when the driver collects their handles."""
        self.spark._jvm.System.gc()
