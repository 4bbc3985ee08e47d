"""Exact token counts of every prefix of a text, by dynamic programming over its chunks.

tokens(prefix up to the end of chunk i) = tokens(prefix up to the end of chunk i - 1) + tokens(chunk i): the vocabulary
never merges across ASCII white space, so the recurrence is exact. The stored table has one entry per chunk (byte end,
token count); the total, the count of any stored prefix and the longest prefix within a budget are read from it without
encoding again.

Defined cases: null and empty texts have no entry and no token. Null ids, repeated rows and empty tables pass through.
Only the id and the text column are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tamiz.llm.vocabulary import Vocabulary, default_path, for_worker

LIMIT_TOKENS = 2048
SUB_BYTES = 8 << 20


def chunk_ends(raw: bytes) -> np.ndarray:
    """Byte offsets just behind each white-space-free chunk."""
    codes = np.frombuffer(raw, dtype=np.uint8)
    ink = np.empty(len(codes) + 1, dtype=bool)
    ink[:-1] = ((codes < 9) | (codes > 13)) & (codes != 32)
    ink[-1] = False
    return np.flatnonzero(ink[:-1] & ~ink[1:]) + 1


def prefix_table(text: str | None, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Byte ends of the chunks and exact token counts of the prefixes that end there."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    ids = vocabulary.chunk_ids(raw.split())
    counts = np.cumsum(np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) >> 2)
    return chunk_ends(raw), counts


def token_prefixes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """One row per document: id, n_bytes, prefix_bytes array<long>, prefix_tokens array<long>."""
    path = path or default_path()
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    schema = pa.schema(
        [("id", pa.int64()), ("n_bytes", pa.int64()), ("prefix_bytes", pa.list_(pa.int64())), ("prefix_tokens", pa.list_(pa.int64()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = for_worker(path)
        try:
            for batch in batches:
                rows, held = [], 0
                for id_, text in zip(batch.column(0), batch.column(1)):
                    text = text.as_py()
                    rows.append((id_.as_py(), len((text or "").encode("utf-8", "surrogatepass")), *prefix_table(text, vocabulary)))
                    held += rows[-1][1]
                    if held > SUB_BYTES:
                        yield _batch(rows, schema)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows, schema)
        finally:
            vocabulary.forget()

    return source.mapInArrow(run, "id long, n_bytes long, prefix_bytes array<long>, prefix_tokens array<long>").withColumnRenamed("id", id_col)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    edges = pa.array(np.concatenate([[0], np.cumsum([len(r[2]) for r in rows])]).astype(np.int32))
    lists = [pa.ListArray.from_arrays(edges, pa.array(np.concatenate([r[k] for r in rows]))) for k in (2, 3)]
    columns = [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), *lists]
    return pa.RecordBatch.from_arrays(columns, schema=schema)


def total_tokens() -> Column:
    """Tokens of the whole text."""
    return F.coalesce(F.element_at(F.when(F.size("prefix_tokens") > 0, F.col("prefix_tokens")), -1), F.lit(0)).cast("long")


def tokens_up_to(byte: Column) -> Column:
    """Tokens of the longest stored prefix of at most ``byte`` bytes."""
    fits = F.size(F.filter("prefix_bytes", lambda b: b <= byte))
    return F.coalesce(F.get("prefix_tokens", fits - 1), F.lit(0)).cast("long")


def bytes_within(budget: Column) -> Column:
    """Length in bytes of the longest stored prefix of at most ``budget`` tokens."""
    fits = F.size(F.filter("prefix_tokens", lambda n: n <= budget))
    return F.coalesce(F.get("prefix_bytes", fits - 1), F.lit(0)).cast("long")
