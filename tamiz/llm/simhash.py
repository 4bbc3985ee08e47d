"""SimHash near-duplicates: fingerprints, pigeonhole blocks, verified bit distance, components.

A fingerprint of 64 bits is cut into blocks. Two fingerprints that differ in at most d bits agree in all but d blocks,
so with n blocks they share at least one of the choose(n, d) keys made of the other n - d blocks. Distinct fingerprints
are dealt to their keys; keys with one fingerprint end there, keys with two are one comparison, fuller keys are compared
inside a task which gives back a spanning set of links (never all pairs). Keys above ``crowd`` fingerprints are not
compared: their members are dealt again with 16 blocks, where a key leaves only four bits per open block, so that a key
can hold no more than 2^(4 d) fingerprints whatever the input. That way is exact too, it only makes more keys per row.

Defined cases: null and empty texts have fingerprint zero and are linked like any other. Copies share a fingerprint and
are never compared. A null id takes part but is never the component's id unless all its ids are null.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.functions import pandas_udf

from tamiz.llm.base import Stages, id_keys
from tamiz.llm.components import components

SEED = 42
SHINGLE_WORDS = 3
MAX_BITS = 3
BLOCKS = 6
FINE_BLOCKS = 16
CROWD = 1024
CHUNK = 1 << 15


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """Unsigned 64-bit SimHash of the lower-cased word shingles; zero without a word."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    spans = zip(*(tokens[i:] for i in range(words))) if len(tokens) >= words else [tokens]
    hashes = map(xxhash.xxh64_intdigest, map(b" ".join, spans), repeat(SEED))
    total = max(1, len(tokens) - words + 1)
    ones, done = np.zeros(64, dtype=np.int64), 0
    while done < total:
        n = min(CHUNK, total - done)
        part = np.fromiter(hashes, dtype="<u8", count=n)
        ones += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(n, 64).sum(axis=0, dtype=np.int64)
        done += n
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def fingerprint_column(words: int = SHINGLE_WORDS):
    @pandas_udf("long")
    def prints(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, words) for t in texts], dtype=np.uint64).astype(np.int64))

    return prints


def block_masks(blocks: int, max_bits: int) -> list[int]:
    """Signed masks of every choice of ``blocks - max_bits`` blocks."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    parts = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(blocks)]
    masks = [sum(c) for c in combinations(parts, blocks - max_bits)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def spanning_links(values: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of the values of one key: each value is compared once with those not reached yet."""
    rest, out = values.astype(np.int64).view(np.uint64), []
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            head = queue.pop()
            near = np.bitwise_count(rest ^ head) <= max_bits
            found = rest[near]
            rest = rest[~near]
            queue.extend(found)
            out.extend(zip(np.full(len(found), head).view(np.int64).tolist(), found.view(np.int64).tolist()))
    return out


def _links(prints: DataFrame, blocks: int, max_bits: int, crowd: int | None, stages: Stages) -> DataFrame:
    masks = block_masks(blocks, max_bits)
    keyed = prints.select(
        "fp", F.posexplode(F.transform(F.array(*[F.lit(m) for m in masks]), lambda m: F.col("fp").bitwiseAND(m))).alias("part", "key")
    )
    full = stages.keep(
        keyed.groupBy("part", "key")
        .agg(F.count(F.lit(1)).alias("members"), F.min("fp").alias("a"), F.max("fp").alias("b"))
        .filter("members > 1")
    )
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits
    links = full.filter("members = 2").filter(close).select("a", "b")

    @pandas_udf("array<struct<a:long,b:long>>")
    def compare(groups: pd.Series) -> pd.Series:
        return pd.Series([[{"a": a, "b": b} for a, b in spanning_links(np.asarray(g), max_bits)] for g in groups])

    fits = F.col("members") > 2 if crowd is None else F.col("members").between(3, crowd)
    lists = keyed.join(full.filter(fits).select("part", "key"), ["part", "key"]).groupBy("part", "key").agg(F.collect_list("fp").alias("fps"))
    links = links.unionAll(lists.select(F.explode(compare("fps")).alias("l")).select("l.a", "l.b"))
    if crowd is not None:
        crowded = keyed.join(full.filter(F.col("members") > crowd).select("part", "key"), ["part", "key"]).select("fp").distinct()
        links = links.unionAll(_links(stages.keep(crowded), FINE_BLOCKS, max_bits, None, stages))
    return links


def near_links(prints: DataFrame, max_bits: int = MAX_BITS, blocks: int = BLOCKS, crowd: int = CROWD) -> DataFrame:
    """``prints(fp)``, distinct, to links ``(a, b)`` that connect exactly what the bit distance connects."""
    return _links(prints, blocks, max_bits, crowd, Stages(prints.sparkSession)).distinct()


def _components_of_prints(prints: DataFrame, max_bits: int, crowd: int) -> DataFrame:
    """``fp, root`` of distinct fingerprints."""
    roots = components(near_links(prints.select("fp"), max_bits, BLOCKS, crowd))
    return prints.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS,
                    max_bits: int = MAX_BITS, crowd: int = CROWD) -> DataFrame:
    """One row per input row: id, fp (signed long), component_id (smallest id that links reach)."""
    stages = Stages(docs.sparkSession)
    rows = stages.keep(docs.select(F.col(id_col).alias("id"), fingerprint_column(words)(text_col).alias("fp")))
    prints = stages.keep(rows.groupBy("fp").agg(F.min("id").alias("low")))
    rooted = _components_of_prints(prints, max_bits, crowd)
    lows = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    per_print = stages.keep(rooted.join(lows, "root").select("fp", "component_id"))
    return rows.join(per_print, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS,
                     max_bits: int = MAX_BITS) -> DataFrame:
    """One row of ``docs`` per component, with all its columns.

    It is the row with the smallest id (a null id comes last), then with the smallest hash of its text. Rows with equal
    id and text differ in other columns at most; the smallest hash of the whole row decides. Unrelated rows with null or
    repeated ids all stay, since components are found by fingerprint and not by id.
    """
    stages = Stages(docs.sparkSession)
    body = F.coalesce(F.col(text_col), F.lit(""))
    key = F.struct(*id_keys(id_col)[::-1], F.xxhash64(body).alias("_hash"), F.hash(body).alias("_more"))
    rows = stages.keep(docs.select(key.alias("key"), fingerprint_column(words)(text_col).alias("fp")))
    prints = stages.keep(rows.groupBy("fp").agg(F.min("key").alias("key")))
    stay = stages.keep(_components_of_prints(prints, max_bits, CROWD).groupBy("root").agg(F.min("key").alias("_key")).select("_key"))
    once = Window.partitionBy("_key").orderBy(F.xxhash64("_doc"))
    left = docs.select(F.struct("*").alias("_doc"), key.alias("_key")).join(stay, "_key", "left_semi")
    return left.withColumn("_nth", F.row_number().over(once)).filter("_nth = 1").select("_doc.*")
