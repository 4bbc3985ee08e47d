"""Packing documents into token sequences by order-preserving dynamic programming.

The documents of a partition form one token stream in input order, worked off in blocks of about ``BLOCK_TOKENS``. A
sequence may end after a document (free), after a sentence (``SENTENCE_COST``) or, only inside a sentence longer than a
sequence, after any token (``TOKEN_COST``). With f the least cost up to a cut p, f(q) = min over cuts p with
q - p <= length of f(p) + padding(q - p) + cost(q). The padding is length - q + p, so the minimum of f(p) + p over a
sliding range is wanted, which a monotone queue gives in constant time per cut. The last sequence of a block is padded or,
where that is cheaper, split into lengths that are powers of two and need no padding.

The stream is never shuffled or sorted: a lost executor repeats its own partition with the same result, memory is bounded
by a block (or one document, if longer), and the few short sequences per block do not grow with the input.

Defined cases: a null or empty text is the end token alone. Null ids and repeated rows are packed like any other. An empty
table gives no rows. Only the id and the text column are read.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tamiz.llm.vocabulary import Vocabulary, default_path, for_worker

LENGTH = 2048
END_ID = 1
BLOCK_TOKENS = 1 << 20
SENTENCE_COST, TOKEN_COST = 4, 16
ENDS_SENTENCE = np.isin(np.arange(256), list(b".!?"))  # by a piece's last byte


def cuts_of(ends: list[int], costs: list[int], length: int = LENGTH) -> list[int]:
    """Ends of the sequences of a stream whose possible cuts are ``ends`` (rising, the last is the stream's end)."""
    spots, prices = [0], [0]
    for end, cost in zip(ends, costs):
        while end - spots[-1] > length:  # a stretch without a cut: any token may end a sequence
            spots.append(spots[-1] + 1)
            prices.append(TOKEN_COST)
        if end > spots[-1]:
            spots.append(end)
            prices.append(cost)
    best, came = [0] * len(spots), [0] * len(spots)
    queue: deque[int] = deque([0])
    for j in range(1, len(spots)):
        while spots[j] - spots[queue[0]] > length:
            queue.popleft()
        i = queue[0]
        came[j] = i
        best[j] = best[i] + spots[i] + length - spots[j] + prices[j]
        value = best[j] + spots[j]
        while queue and best[queue[-1]] + spots[queue[-1]] >= value:
            queue.pop()
        queue.append(j)
    last, tail = len(spots) - 1, []
    whole, price, at = spots[-1], None, 0
    for i in range(last - 1, -1, -1):
        rest = whole - spots[i]
        if rest > length:
            break
        split = best[i] + min(length - rest, TOKEN_COST * (rest.bit_count() - 1))
        if price is None or split < price:
            price, at = split, i
    rest = whole - spots[at]
    if TOKEN_COST * (rest.bit_count() - 1) < length - rest:
        end = spots[at]
        for bit in range(rest.bit_length() - 1, -1, -1):
            if rest >> bit & 1:
                end += 1 << bit
                tail.append(end)
    else:
        tail = [whole]
    out = []
    while at:
        out.append(spots[at])
        at = came[at]
    return out[::-1] + tail


def tokens_and_ends(text: str | None, vocabulary: Vocabulary) -> tuple[bytes, np.ndarray]:
    """Packed ids of the text and the end token; token counts at the ends of its sentences."""
    pieces = vocabulary.split((text or "").encode("utf-8", "surrogatepass"))
    ids = vocabulary.piece_ids(pieces)
    counts = np.cumsum(np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) >> 2)
    stops = ENDS_SENTENCE[np.fromiter(map(itemgetter(-1), pieces), dtype=np.uint8, count=len(pieces))]
    return b"".join(ids) + END_ID.to_bytes(4, "little"), counts[stops]


class _Block:
    def __init__(self):
        self.docs: list[tuple] = []  # id, packed ids, first token in the block
        self.ends: list[int] = []
        self.costs: list[int] = []
        self.size = 0

    def add(self, id_, ids: bytes, stops: np.ndarray) -> None:
        n = len(ids) >> 2
        inner = (stops[(stops > 0) & (stops < n - 1)] + self.size).tolist()
        self.docs.append((id_, ids, self.size))
        self.size += n
        self.ends += [*inner, self.size]
        self.costs += [SENTENCE_COST] * len(inner) + [0]

    def pieces(self, length: int, number: int) -> Iterator[tuple]:
        begin, d = 0, 0
        for end in cuts_of(self.ends, self.costs, length):
            while begin < end:
                pass_id, ids, first = self.docs[d]
                n = len(ids) >> 2
                start, offset = max(begin, first), max(begin, first) - begin
                stop = min(end, first + n)
                yield pass_id, start - first, stop - start, ids[4 * (start - first) : 4 * (stop - first)], n, number, offset
                if stop == first + n:
                    d += 1
                if stop == end:
                    break
            begin, number = end, number + 1


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, path: str | None = None) -> DataFrame:
    """One row per piece: id, start, length, ids (packed little-endian uint32), doc_tokens, sequence_id, offset."""
    path = path or default_path()
    schema = pa.schema(
        [("id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()),
         ("sequence_id", pa.int64()), ("offset", pa.int64())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, number = for_worker(path), TaskContext.get().partitionId() << 32

        def flush(block: _Block) -> pa.RecordBatch:
            nonlocal number
            rows = list(block.pieces(length, number))
            number = rows[-1][5] + 1
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        block = _Block()
        try:
            for batch in batches:
                for id_, text in zip(batch.column(0), batch.column(1)):
                    block.add(id_.as_py(), *tokens_and_ends(text.as_py(), vocabulary))
                    if block.size >= BLOCK_TOKENS:
                        yield flush(block)
                        block = _Block()
            if block.docs:
                yield flush(block)
        finally:
            vocabulary.forget()

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    out = source.mapInArrow(run, "id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
    return out.withColumnRenamed("id", id_col)
