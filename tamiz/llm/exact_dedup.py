"""Exact duplicates by deterministic block naming, with built-in functions only.

A text (white-space runs made one space) is cut into blocks of a fixed number of bytes. Distinct blocks are sorted and
named by integers. Then adjacent names are paired, distinct pairs are sorted and named, and so on until one name is left
per row. Rows with as many blocks go through the same levels, so (blocks, last name) is equal exactly when the texts are.

Cost: block contents are shuffled once, as map-side distinct blocks. Occurrences look their name up by the block's SHA-256;
that no two different blocks share a digest is checked on the name table, so the look-up is exact. Every later level
moves integers only and halves them. Looked-up names meet many occurrences in plain sort-merge joins that AQE can split.

Defined cases: a null text is an empty one (one empty block). Rows with a null id lose against any other copy. Of rows
with the same smallest id and equal texts one stays. An empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tamiz.llm.base import SPACE_RUN, Stages, id_keys

BLOCK_BYTES = 1024


def normal_bytes(text: str) -> Column:
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), SPACE_RUN, " ").cast("binary")


def _blocks(docs: DataFrame, id_col: str, text_col: str, block_bytes: int) -> DataFrame:
    """One row per block: row, blocks, pos, block; the row's id and digest stand on its first block."""
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).alias("id"),
        normal_bytes(text_col).alias("body"),
    ).select(
        "row", "id", "body",
        F.sha2("body", 256).alias("sha"),
        F.greatest(F.lit(1), F.ceil(F.length("body") / block_bytes)).cast("int").alias("blocks"),
    )
    at = F.sequence(F.lit(0), F.col("blocks") - 1)
    cut = F.transform(at, lambda i: F.substring(F.col("body"), i * block_bytes + 1, F.lit(block_bytes)))
    first = F.col("pos") == 0
    return rows.select("row", "id", "sha", "blocks", F.posexplode(cut).alias("pos", "block")).select(
        "row", "blocks", "pos", "block", F.when(first, F.col("id")).alias("id"), F.when(first, F.col("sha")).alias("sha")
    )


def _named(distinct: DataFrame, *by: str) -> DataFrame:
    """Distinct rows, sorted within their hash partition and numbered."""
    return distinct.sortWithinPartitions(*by).withColumn("name", F.monotonically_increasing_id())


def identities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per input row: row, id, sha, blocks, name; equal (blocks, name) means equal normalised text."""
    stages = Stages(docs.sparkSession)
    blocks = _blocks(docs, id_col, text_col, block_bytes)
    digest = F.unhex(F.sha2("block", 256))
    names = stages.keep(_named(blocks.select("block").distinct(), "block").select(digest.alias("digest"), "name"))
    if not names.groupBy("digest").count().filter("count > 1").isEmpty():
        raise ValueError("two different blocks have the same SHA-256: use another block size")
    open_ = stages.keep(
        blocks.withColumn("digest", digest).drop("block").join(names, "digest")
        .select("row", "blocks", F.col("blocks").alias("left_over"), "pos", "name", "id", "sha")
    )
    stages.drop(names)
    heads = open_.filter("pos = 0").select("row", "id", "sha")
    ended = [open_.filter("left_over = 1").select("row", "blocks", "name")]
    longest = open_.agg(F.max("blocks")).first()[0] or 0
    while longest > 1:
        side = F.col("pos") % 2
        pairs = (
            open_.filter("left_over > 1")
            .groupBy("row", "blocks", "left_over", F.floor(F.col("pos") / 2).cast("int").alias("pos"))
            .agg(
                F.max(F.when(side == 0, F.col("name"))).alias("left"),
                F.coalesce(F.max(F.when(side == 1, F.col("name"))), F.lit(-1)).alias("right"),
            )
        )
        names = stages.keep(_named(pairs.select("left", "right").distinct(), "left", "right"))
        halved = F.floor((F.col("left_over") + 1) / 2).cast("int").alias("left_over")
        open_ = stages.keep(pairs.join(names, ["left", "right"]).select("row", "blocks", halved, "pos", "name"))
        stages.drop(names)
        ended.append(open_.filter("left_over = 1").select("row", "blocks", "name"))
        longest = (longest + 1) // 2
    done = ended[0]
    for more in ended[1:]:
        done = done.unionAll(more)
    return heads.join(done, "row")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256."""
    stages = Stages(docs.sparkSession)
    rows = stages.keep(identities(docs, id_col, text_col, block_bytes))
    best = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "row")).alias("best")
    groups = stages.keep(rows.groupBy("blocks", "name").agg(best, F.count(F.lit(1)).alias("group_size")))
    return rows.join(groups, ["blocks", "name"]).select(
        F.col("id").alias(id_col),
        F.col("best.id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("best.row")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns. Of repeated rows (same id and text) one stays."""
    kept = exact_groups(docs, id_col, text_col).filter("kept").select(*id_keys(id_col), F.col("text_sha256").alias("_sha"))
    rows = docs.select(F.struct("*").alias("_doc"), *id_keys(id_col), F.sha2(normal_bytes(text_col), 256).alias("_sha"))
    keys = ["_id", "_no_id", "_sha"]
    once = Window.partitionBy(*keys).orderBy(F.xxhash64("_doc"))
    stay = rows.join(kept, keys, "left_semi").withColumn("_nth", F.row_number().over(once))
    return stay.filter("_nth = 1").select("_doc.*")
