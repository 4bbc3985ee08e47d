"""Repeated byte strings by prefix-free parsing: phrases, dictionary, suffixes of the dictionary in corpus order.

Parsing. A rolling hash of ``GRAM`` bytes is taken at every position. The trigger of a ``length``-byte string is the
position in it with the least hash (the first on ties), which depends on the string alone. Following starts with the same
trigger form one phrase, long enough to hold their whole strings, so phrases overlap by ``length - 1`` bytes and every
string of ``length`` bytes that occurs in a text lies in exactly one of its phrases, cut alike wherever it occurs.

Dictionary and parse. Phrases whose trigger content occurs once in the corpus cannot hold a repeated string and end there
(narrow rows only). The others are named by content; a name's first occurrence in corpus order is the only one that can
keep bytes. Suffixes: dictionary phrases that share a trigger with a different phrase are taken apart into their suffixes,
compared to the depth ``length`` (no phrase needs its neighbour for that, so the parse needs no suffix order of its own),
in corpus order. What is not first is covered and goes. Up to ``GROUP`` phrases of a trigger meet in one task, which reads
them in corpus order. Phrases of a trigger with more are cut into pieces of neighbouring starts; equal pieces are named, and
different ones meet by the bytes all their strings share, which leaves small groups again or is cut finer, at last into
single strings. All ways are exact, and a phrase gives a few pieces instead of a row for each of its strings.

Shuffles: trigger rows (about one per 35 bytes) twice, texts three times (to name phrases, to fetch those taken apart, to
cut), phrases whose trigger repeats as digests, contents only of those taken apart. Aggregates are map-side first and
look-ups are plain joins that AQE can split, so a passage in a third of all rows costs no single task. Steps are written
to the shared folder and old shuffles are released behind them; names are 128-bit digests.

Defined cases: a null text is empty; texts below ``length`` bytes lose nothing. Order is by id, missing ids last; rows that
share an id are ordered by their text's hash, and of repeated rows (same id and text) all but one are later ones and lose
every byte that such a string covers. Empty tables give no rows. Only the id and the text column are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tamiz.llm.base import Stages, id_keys

LENGTH = 100
GRAM = 32
SEGMENT = 1 << 18  # starts that are worked on at once
OUT_ROWS = 200_000
GROUP = 500  # phrases of one trigger that one task compares; those of triggers with more are cut into pieces
WIDTHS = (16, 4, 1)  # starts of the pieces, cut finer as long as too many different ones meet
PLACE = (("_no_id", pa.bool_()), ("_id", pa.int64()), ("hash", pa.int64()), ("start", pa.int64()))
PLACE_DDL = "_no_id boolean, _id long, hash long, start long"


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """Mixed rolling hash of the ``GRAM`` bytes from each position."""
    h, width, base = raw.astype(np.uint64) + np.uint64(1), 1, 0x9E3779B97F4A7C15
    while width < GRAM:
        h = h[:-width] * np.uint64(base) + h[width:]
        base = base * base % (1 << 64)
        width *= 2
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def phrases(text: bytes, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Trigger hash, trigger position, first start and number of starts of each phrase of a text."""
    raw, out = np.frombuffer(text, dtype=np.uint8), []
    span = length - GRAM + 1
    for a in range(0, len(raw) - length + 1, SEGMENT):
        part = raw[a : a + SEGMENT + length - 1]
        value = gram_hashes(part)
        index, width = np.arange(len(value), dtype=np.int32), 1
        low = value
        while width < span:  # minima of growing ranges; the first position wins ties
            step = min(width, span - width)
            later = low[step:] < low[:-step]
            index = np.where(later, index[step:], index[:-step])
            low = np.minimum(low[step:], low[:-step])
            width += step
        begin = np.flatnonzero(np.diff(index, prepend=-1))
        count = np.diff(begin, append=len(index))
        out.append((value[index[begin]].view(np.int64), index[begin].astype(np.int64) + a, begin + a, count))
    if not out:
        return (np.zeros(0, np.int64),) * 4
    return tuple(np.concatenate(c) for c in zip(*out))


def _raw(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _triggers(docs: DataFrame, length: int) -> DataFrame:
    schema = pa.schema([("seed", pa.int64()), ("_id", pa.int64()), ("_no_id", pa.bool_()), ("at", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0
            for i, (id_, no_id, text) in enumerate(zip(*batch.columns)):
                seeds, at, _, _ = phrases(_raw(text.as_py()), length)
                held.append((seeds, np.full(len(at), id_.as_py()), np.full(len(at), no_id.as_py()), at))
                size += len(at)
                if size >= OUT_ROWS or i == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), f.type) for c, f in zip(zip(*held), schema)], schema=schema)
                    held, size = [], 0

    return docs.select("_id", "_no_id", "text").mapInArrow(run, "seed long, _id long, _no_id boolean, at long")


def _phrase_rows(docs: DataFrame, length: int) -> DataFrame:
    """Phrases of ``docs(_no_id, _id, hash, text, at)`` whose trigger position is in ``at``: place, count, trigger, name."""
    schema = pa.schema([*PLACE, ("count", pa.int64()), ("seed", pa.int64()), ("name", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for no_id, id_, hash_, text, at in zip(*batch.columns):
                raw = _raw(text.as_py())
                seeds, spots, starts, counts = phrases(raw, length)
                keep = np.isin(spots, np.asarray(at.values))
                key = no_id.as_py(), id_.as_py(), hash_.as_py()
                for seed, start, count in zip(seeds[keep].tolist(), starts[keep].tolist(), counts[keep].tolist()):
                    rows.append((*key, start, count, seed, hashlib.md5(raw[start : start + count - 1 + length]).digest()))
                if len(rows) >= OUT_ROWS // 4:
                    yield _batch(rows, schema)
                    rows = []
            if rows:
                yield _batch(rows, schema)

    names = f"{PLACE_DDL}, count long, seed long, name binary"
    return docs.select("_no_id", "_id", "hash", "text", "at").mapInArrow(run, names)


def _bodies(docs: DataFrame, length: int) -> DataFrame:
    """Bytes of the phrases of ``docs(_no_id, _id, hash, text, parts)``; a part has start, count, seed and n."""
    schema = pa.schema([*PLACE, ("seed", pa.int64()), ("n", pa.int64()), ("body", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for no_id, id_, hash_, text, parts in zip(*batch.columns):
                raw, key = _raw(text.as_py()), (no_id.as_py(), id_.as_py(), hash_.as_py())
                for start, count, seed, n in zip(*[parts.values.field(k).to_pylist() for k in range(4)]):
                    rows.append((*key, start, seed, n, raw[start : start + count - 1 + length]))
                if len(rows) >= OUT_ROWS // 4:
                    yield _batch(rows, schema)
                    rows = []
            if rows:
                yield _batch(rows, schema)

    return docs.select("_no_id", "_id", "hash", "text", "parts").mapInArrow(run, f"{PLACE_DDL}, seed long, n long, body binary")


def _later_windows(bodies: DataFrame, length: int) -> DataFrame:
    """Covered ranges among the ``n`` different phrases of each small group, read in order of (group, place).

    A task holds the strings of one group at a time, at most ``GROUP`` phrases. A phrase holds no string twice.
    """
    schema = pa.schema([*PLACE, ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, last, seen, nth = None, None, set(), 0
        for batch in batches:
            rows = []
            for seed, no_id, id_, hash_, start, n, body in zip(*[c.to_pylist() for c in batch.columns]):
                if seed != current:
                    current, last, seen, nth = seed, None, set(), 0
                place = no_id, id_, hash_, start
                if place == last:  # the same phrase of a repeated row
                    continue
                last, nth = place, nth + 1
                parts = [body[i : i + length] for i in range(len(body) - length + 1)]
                if nth > 1 and not seen.isdisjoint(parts):
                    open_ = None
                    for i, part in enumerate(parts):
                        if part in seen:
                            open_ = i if open_ is None else open_
                        elif open_ is not None:
                            rows.append((no_id, id_, hash_, start + open_, start + i - 1 + length))
                            open_ = None
                    if open_ is not None:
                        rows.append((no_id, id_, hash_, start + open_, start + len(body)))
                if nth < n:
                    seen.update(parts)
            if rows:
                yield _batch(rows, schema)

    order = ["seed", "_no_id", "_id", "hash", "start"]
    return bodies.select(*order, "n", "body").repartition("seed").sortWithinPartitions(*order).mapInArrow(run, f"{PLACE_DDL}, end long")


def _finer(bodies: DataFrame, length: int, width: int) -> DataFrame:
    """Phrases cut into pieces whose strings have their trigger at one of ``width`` neighbouring offsets.

    ``seed`` becomes a digest of the bytes that every string of such offsets has in common with any equal one, so equal strings
    keep meeting under one ``seed``.
    """
    schema = pa.schema([*PLACE, ("seed", pa.int64()), ("name", pa.binary()), ("body", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for no_id, id_, hash_, start, body in zip(*[c.to_pylist() for c in batch.columns]):
                at = int(gram_hashes(np.frombuffer(body, np.uint8, length)).argmin())  # the trigger of the first string and all
                count = len(body) - length + 1
                for k in range((at - count + 1) // width, at // width + 1):
                    low, high = at - k * width - width + 1, at - k * width  # starts of the strings with these offsets
                    core = body[high : low + length]
                    a, z = max(low, 0), min(high, count - 1) + length
                    seed = int.from_bytes(hashlib.md5(b"%d %b" % (k, core)).digest()[:8], "little", signed=True)
                    rows.append((no_id, id_, hash_, start + a, seed, hashlib.md5(body[a:z]).digest(), body[a:z]))
                if len(rows) >= OUT_ROWS // 4:
                    yield _batch(rows, schema)
                    rows = []
            if rows:
                yield _batch(rows, schema)

    return bodies.select("_no_id", "_id", "hash", "start", "body").mapInArrow(run, f"{PLACE_DDL}, seed long, name binary, body binary")


def _later_pieces(stages: Stages, bodies: DataFrame, length: int, group: int, widths: Sequence[int] = WIDTHS) -> list[DataFrame]:
    """As ``_later_windows`` for groups of more phrases, in finer and finer pieces.

    Of equal pieces all but the first are covered. Different ones of a small group are compared in one task; a group that is still
    too large is cut again. Pieces of width 1 are single strings, where equal names say it all.
    """
    at, place = F.struct("_no_id", "_id", "hash", "start"), ["_no_id", "_id", "hash"]
    out, held = [], []
    for width in widths:
        if bodies.isEmpty():
            break
        pieces = stages.keep(_finer(bodies, length, width))
        named = stages.keep(pieces.groupBy("name").agg(F.min(at).alias("first"), F.any_value("seed").alias("group")))
        later = pieces.join(named.select("name", "first"), "name").filter(at != F.col("first"))
        out.append(stages.keep(later.select(*place, "start", (F.col("start") + F.length("body")).alias("end"))))
        if width == 1:
            break
        shared = named.groupBy("group").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        firsts = named.join(shared, "group").select("name", "first", "n")
        left = stages.keep(pieces.join(firsts, "name").filter(at == F.col("first")).select(*place, "start", "seed", "n", "body"))
        stages.drop(pieces, named, *held)
        held = [left]
        out.append(stages.keep(_later_windows(left.filter(F.col("n") <= group), length)))
        stages.release()
        bodies = left.filter(F.col("n") > group)
    return out


def repeated_spans(docs: DataFrame, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """Covered byte ranges of ``docs(_id, _no_id, hash, text)``: the keys and start, end (overlapping, unordered)."""
    stages = Stages(docs.sparkSession)
    place = ["_no_id", "_id", "hash"]
    triggers = stages.keep(_triggers(docs, length))
    twice = stages.keep(triggers.groupBy("seed").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("seed"))
    wanted = stages.keep(
        triggers.join(twice, "seed", "left_semi").groupBy("_id", "_no_id").agg(F.collect_list("at").alias("at"))
    )
    stages.drop(triggers, twice)
    stages.release()
    found = stages.keep(_phrase_rows(docs.join(wanted, ["_id", "_no_id"]), length))
    stages.drop(wanted)
    stages.release()
    at = F.struct(*place, "start")
    named = stages.keep(
        found.groupBy("name").agg(F.min(at).alias("first"), F.any_value("count").alias("count"), F.any_value("seed").alias("seed"))
    )
    whole = stages.keep(
        found.select("name", *place, "start", "count").join(named.select("name", "first"), "name").filter(at != F.col("first"))
        .select(*place, "start", (F.col("start") + F.col("count") - 1 + length).alias("end"))
    )
    stages.drop(found)
    stages.release()
    shared = stages.keep(named.groupBy("seed").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    apart = stages.keep(named.join(shared, "seed").select("first.*", "count", "seed", "n"))
    stages.drop(named, shared)
    stages.release()
    parts = F.collect_list(F.struct("start", "count", "seed", "n")).alias("parts")
    bodies = stages.keep(_bodies(docs.join(apart.groupBy(*place).agg(parts), place), length))
    stages.drop(apart)
    stages.release()
    few = stages.keep(_later_windows(bodies.filter(F.col("n") <= group), length))
    many = _later_pieces(stages, bodies.filter(F.col("n") > group), length, group)
    stages.drop(bodies)
    stages.release()
    return reduce(DataFrame.unionAll, [whole, few, *many])


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union of ranges; touching ranges are one run."""
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.ones(len(starts), dtype=bool)
    new[1:] = starts[1:] > reach[:-1]
    last = np.append(np.flatnonzero(new)[1:] - 1, len(starts) - 1)
    return starts[new], reach[last]


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, group: int = GROUP
) -> DataFrame:
    """One row per input row: id, n_bytes, n_removed, n_spans, kept (the remaining bytes)."""
    base = docs.select(
        *id_keys(id_col), F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    ).withColumn("hash", F.xxhash64("text"))
    keys = ["_no_id", "_id", "hash"]
    spans = repeated_spans(base, length, group).groupBy(*keys).agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(1)))
    rows = base.join(spans, keys, "left").withColumn("nth", nth).select("id", "text", "spans", (F.col("nth") > 1).alias("again"))
    names = "id long, n_bytes long, n_removed long, n_spans long, kept binary"
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    schema = pa.schema([(n.split()[0], k) for n, k in zip(names.split(", "), kinds)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for id_, text, spans, again in zip(*batch.columns):
                raw = _raw(text.as_py())
                if again.as_py() and len(raw) >= length:
                    out.append((id_.as_py(), len(raw), len(raw), 1, b""))
                    continue
                if not spans.is_valid:
                    out.append((id_.as_py(), len(raw), 0, 0, raw))
                    continue
                pairs = spans.values
                starts, ends = merged(np.asarray(pairs.field(0)), np.asarray(pairs.field(1)))
                edges = [0, *np.stack([starts, ends], axis=1).ravel().tolist(), len(raw)]
                rest = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))
                out.append((id_.as_py(), len(raw), int((ends - starts).sum()), len(starts), rest))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], schema=schema)

    return rows.mapInArrow(run, names).withColumnRenamed("id", id_col)
