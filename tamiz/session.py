"""Session settings, shared scratch folder, and size-checked driver hand-offs."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

# Ceiling for a table that an operator may turn into a broadcast.
SMALL_TABLE_ROWS = 100_000


def build_session(master: str = "local[8]", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """Session for tests and benchmarks; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(master)
        .appName("tamiz")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can reach: the cluster's own, else a local one on ``local[*]``."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    local = tempfile.mkdtemp(prefix="tamiz-")
    spark.conf.set("spark.checkpoint.dir", local)
    return local


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def spread_rows(scan: DataFrame) -> DataFrame:
    """Deal the rows of a file scan out to all cores when its files give fewer partitions than that."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` below the shared folder and read it back: a short plan that survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, "stage")
    df.write.parquet(path)
    return spread_rows(spark.read.schema(df.schema).parquet(path))


def keep_small(df: DataFrame, max_rows: int = SMALL_TABLE_ROWS) -> DataFrame:
    """Broadcast ``df`` when it has at most ``max_rows`` rows, else leave it to a shuffle join.

    At most ``max_rows + 1`` rows ever reach the driver, and the table is computed once.
    """
    rows = df.take(max_rows + 1)
    if len(rows) > max_rows:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))


def bounded_matrix(points: DataFrame, id_col: str, vec_col: str, max_items: int) -> tuple[list, np.ndarray]:
    """Ids and vectors of a table known to be small (micro-cluster centres), ordered by id.

    Raises above ``max_items``: pairwise work on more rows has to start from ``micro_cluster``.
    """
    rows = points.select(id_col, vec_col).take(max_items + 1)
    if len(rows) > max_items:
        raise ValueError(f"more than {max_items} rows: compress them with micro_cluster first")
    rows.sort(key=lambda r: r[0])
    ids = [r[0] for r in rows]
    dim = len(rows[0][1]) if rows else 0
    return ids, np.array([r[1] for r in rows], dtype=float).reshape(len(rows), dim)
