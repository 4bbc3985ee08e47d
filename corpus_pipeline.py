"""Corpus pipeline: quality rules, exact dedup, SimHash near-dedup, mixing to target weights, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs. All but the last return the columns of ``documents``, further columns of any name included.

Defined cases: a null text is an empty one and falls at the quality rules, like any text below their word count. Null and
repeated ids pass; copies and near copies are told by their texts, and the row with the smallest id of a group stays (null
last). Texts of any length go through whole. An empty table, or one of which nothing is left, gives no rows.

Stages hand texts to Python workers in batches bounded by bytes: a session whose Arrow batches may be larger than
``BATCH_BYTES`` gets that bound, so that what a worker and its task hold at once does not depend on the length of texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tamiz.llm import exact_dedup, mixing, packing, quality_rules, simhash
from tamiz.llm.base import Stages, read
from tamiz.llm.queries import packing_digest

BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def _bounded_batches(spark: SparkSession) -> None:
    most = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(_BATCH))
    if not 0 < most <= BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _bounded_batches(spark)
    return quality_rules.drop_rejected(docs)


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _bounded_batches(spark)
    return simhash.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _bounded_batches(spark)
    return packing_digest(packing.pack(docs))


STAGES = [
    ("quality_rules", keep_good),
    ("exact_dedup", drop_exact),
    ("simhash_near_dedup", drop_near),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]
# No SQL twin: the robust estimates, fingerprints and tokens cannot be said in SQL. Tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    stages, docs = Stages(spark), read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stages.keep(stage(spark, docs, sf_dir))
    return docs
