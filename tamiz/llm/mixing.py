"""Mixing sources to target weights by a low-discrepancy schedule, with built-in functions only.

Targets: sources in code-point order (null last) weigh 5, 2, 1, repeating, and share all words; a target stops at three
times its source's size and the excess is shared again by weight. Sorted by cap over weight the capped sources are a
prefix, so one running sum over the (few) sources gives the fixed point.

Schedule: slot i is the golden-ratio point frac(i / phi), looked up in the cumulated targets. The r-th slot of a source
takes block r of its shuffled documents, cut into blocks of equal word counts; after the last block the source starts
again, at most three times. Ranks and word offsets are two-level prefix sums (bounded chunks of slots, bounded buckets of
the shuffle hash), so no task sees a whole source.

Defined cases: a null text has no words and takes none. A null source is a source. Null and repeated ids keep one row
each; where documents are returned, rows with the same id share one decision. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tamiz.llm.base import WORD, Stages, id_keys

WEIGHTS = (5, 2, 1)
MAX_TIMES = 3
SEED = 20240601
# A block has up to BLOCK_WORDS words, fewer on small inputs so that there are about MIN_SLOTS slots.
BLOCK_WORDS, LEAST_WORDS, MIN_SLOTS = 1024, 16, 65_536
BUCKET_ROWS = 1_000
SLOT_CHUNK = 16  # log2 of the slots that are ranked together
BINS = 65_536
# 2^32 / golden ratio; a slot number below 2^31 times this stays below 2^63.
GOLDEN, UNIT = 2_654_435_769, 1 << 32


def words(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """``sizes(source, size)`` to one row per source: source, source_size, weight, target."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    per = per.withColumn("weight", F.get(F.array(*[F.lit(w) for w in WEIGHTS]), (rank - 1) % len(WEIGHTS)))
    cap = MAX_TIMES * F.col("source_size")
    order = Window.orderBy(cap / F.col("weight"), F.col("source").asc_nulls_last())
    before, all_ = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = F.sum("source_size").over(all_) - F.coalesce(F.sum(cap).over(before), F.lit(0))
    shares = F.sum("weight").over(all_) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    per = per.withColumn("_level", left / shares).withColumn("_at", F.row_number().over(order))
    fits = F.when(cap >= F.col("_level") * F.col("weight"), F.struct("_at", "_level"))
    level = F.min(fits).over(all_)["_level"]  # the first that is not capped, and with it all behind
    target = F.least(cap.cast("double"), level * F.col("weight"))
    return per.select("source", "source_size", "weight", target.alias("target"))


def _slots(targets: DataFrame, slots: int) -> DataFrame:
    """Slot i of 0..slots-1 with its source and its rank within the source."""
    spark = targets.sparkSession
    through = F.sum("target").over(Window.orderBy(F.col("source").asc_nulls_last()))
    total = F.sum("target").over(Window.partitionBy())
    edge = targets.withColumn("_to", through / total).withColumn("_from", F.col("_to") - F.col("target") / total)
    edge = edge.withColumn("_to", F.when(F.col("_to") > 1 - 1e-12, F.lit(2.0)).otherwise(F.col("_to"))).filter("target > 0")
    bins = F.sequence(F.floor(F.col("_from") * BINS), F.least(F.floor(F.col("_to") * BINS), F.lit(BINS - 1).cast("long")))
    edge = edge.select("source", "_from", "_to", F.explode(bins).alias("_bin"))
    point = ((F.col("id") % (1 << 31)) * F.lit(GOLDEN) % F.lit(UNIT)) / F.lit(UNIT)
    slot = spark.range(slots).select(F.col("id").alias("slot"), point.alias("_u")).withColumn("_bin", F.floor(F.col("_u") * BINS))
    return slot.join(edge, "_bin").filter("_u >= _from AND _u < _to").select("slot", "source")


def _ranked(slots: DataFrame, stages: Stages) -> DataFrame:
    slots = stages.keep(slots.withColumn("_chunk", F.shiftright("slot", SLOT_CHUNK)))
    before = Window.partitionBy("source").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = slots.groupBy("source", "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select("source", "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    within = F.row_number().over(Window.partitionBy("source", "_chunk").orderBy("slot")) - 1
    ranked = slots.withColumn("_within", within)
    same = ranked["source"].eqNullSafe(offsets["source"]) & (ranked["_chunk"] == offsets["_chunk"])
    return ranked.join(offsets, same).select(ranked["source"], "slot", (F.col("_within") + F.col("_offset")).alias("rank"))


def _offsets(rows: DataFrame, stages: Stages) -> DataFrame:
    """Word offset of each row in its source's shuffled order."""
    n = rows.count()
    rows = stages.keep(rows.withColumn("_bucket", F.shiftrightunsigned("shuffle", 32) % max(1, n // BUCKET_ROWS)))
    before = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("source", "_bucket").agg(F.sum("size").alias("_n"))
    starts = sums.select("source", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    order = Window.partitionBy("source", "_bucket").orderBy("shuffle", "id", "row").rowsBetween(Window.unboundedPreceding, -1)
    inner = rows.withColumn("_inner", F.coalesce(F.sum("size").over(order), F.lit(0)))
    same = inner["source"].eqNullSafe(starts["source"]) & (inner["_bucket"] == starts["_bucket"])
    out = inner.join(starts, same)
    return out.select("row", "id", inner["source"], "size", (F.col("_start") + F.col("_inner")).alias("offset"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED) -> DataFrame:
    """One row per input row: id, source, size, source_size, target, taken, slots.

    ``taken`` are the words that the mix takes from the row, repeats counted; ``slots`` are the (at most three) slots
    that take the block with the row's first word, in order.
    """
    stages = Stages(docs.sparkSession)
    rows = stages.keep(
        docs.select(
            F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(source_col).alias("source"),
            words(text_col).alias("size"), F.xxhash64(F.col(id_col), F.lit(seed)).alias("shuffle"),
        )
    )
    targets = stages.keep(source_targets(rows))
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    block = max(LEAST_WORDS, min(BLOCK_WORDS, total // MIN_SLOTS))
    blocks = F.ceil(F.col("source_size") / block)
    ranked = _ranked(_slots(targets, -(-total // block)), stages)
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    slots = ranked.join(targets.withColumn("blocks", blocks), same(ranked, targets)).filter(F.col("rank") < MAX_TIMES * F.col("blocks"))
    uses = stages.keep(
        slots.groupBy(ranked["source"], (F.col("rank") % F.col("blocks")).alias("block"))
        .agg(F.array_sort(F.collect_list("slot")).alias("slots"))  # three at most, by the filter above
    )
    placed = _offsets(rows.filter("size > 0"), stages)
    first, last = F.floor(F.col("offset") / block), F.floor((F.col("offset") + F.col("size") - 1) / block)
    pieces = placed.select("row", "source", "size", "offset", F.explode(F.sequence(first, last)).alias("block"))
    end = F.least(F.col("offset") + F.col("size"), (F.col("block") + 1) * block)
    pieces = pieces.select("row", "source", "block", (end - F.greatest(F.col("offset"), F.col("block") * block)).alias("part"),
                           (F.col("block") == F.floor(F.col("offset") / block)).alias("first"))
    joined = pieces.join(uses, same(pieces, uses) & (pieces["block"] == uses["block"]))
    taken = joined.groupBy("row").agg(
        F.sum(F.col("part") * F.size("slots")).alias("taken"), F.max(F.when(F.col("first"), F.col("slots"))).alias("slots")
    )
    out = rows.join(taken, "row", "left")
    out = out.join(targets, same(rows, targets))
    return out.select(
        F.col("id").alias(id_col), rows["source"].alias(source_col), "size", "source_size", "target",
        F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.coalesce("slots", F.array().cast("array<long>")).alias("slots"),
    )


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix as documents: each row as often as it is taken (nearest whole number), in the order of the slots."""
    plan = mix(docs, id_col, text_col, source_col).groupBy(*id_keys(id_col)).agg(
        F.round(F.sum("taken") / F.greatest(F.sum("size"), F.lit(1))).cast("int").alias("_times"), F.min("slots").alias("_slots")
    )
    plan = plan.filter("_times > 0").select("_id", "_no_id", F.posexplode(F.sequence(F.lit(1), "_times")).alias("_at", "_nth"), "_slots")
    at = F.coalesce(F.get("_slots", F.least(F.col("_at"), F.size("_slots") - 1)), F.lit(0).cast("long"))
    plan = plan.select("_id", "_no_id", at.alias("_slot"))
    out = docs.select(F.struct("*").alias("_doc"), *id_keys(id_col)).join(plan, ["_id", "_no_id"])
    return out.repartitionByRange("_slot").sortWithinPartitions("_slot", "_id").select("_doc.*")
