"""Every row of a table against every other, in tasks of bounded size and without a row per pair.

A task holds a block of asking rows with what is known of each; the other rows pass by in batches and leave only sums,
extremes and the nearest few behind. Squared distances come from a matrix product; where it could lose digits, and for
every row that may be among the nearest, the plain differences count.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

TILE_ROWS = 1024
HELD_ROWS = 32_768
HELD_VALUES = 1 << 22  # bound of a block's rows times what is held for each
CLOSE = 1e-6  # of the squares: below it a difference of squares has too few digits
AT_ONCE = 1 << 16


def blocks_for(n: int, held: int, cores: int) -> int:
    """Number of blocks of asking rows: enough for all cores, and none with more than a task may hold."""
    most = max(1, min(HELD_ROWS, HELD_VALUES // max(held, 1)))
    return max(1, -(-n // most), min(2 * cores, -(-n // 64)))


def met(asking: DataFrame, members: DataFrame, blocks: int) -> DataFrame:
    """Asking rows (with their ``block``) and members (with the ``blocks`` that they pass), a block a partition, askers first."""
    sides = asking.withColumn("turn", F.lit(0)), members.withColumn("block", F.explode("blocks")).drop("blocks").withColumn("turn", F.lit(1))
    both = sides[0].unionByName(sides[1], allowMissingColumns=True)
    return both.repartitionById(blocks, F.col("block").cast("int"))


def matrix(column: pa.Array) -> np.ndarray:
    """Arrow lists of equally many numbers as a matrix."""
    if not len(column):
        return np.zeros((0, 0))
    values = column.flatten().to_numpy(zero_copy_only=False)
    if len(values) % len(column) or len(set(np.diff(column.offsets.to_numpy()).tolist())) > 1:
        raise ValueError("vectors of different length")
    return values.reshape(len(column), -1).astype(float)


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of paired rows, or of all rows to one vector, by plain differences."""
    gap = a - b
    return np.sqrt(np.einsum("ij,ij->i", gap, gap))


class Side:
    """Rows prepared for the matrix product, moved to a common origin."""

    def __init__(self, x: np.ndarray, origin: np.ndarray, left: bool):
        moved = x - origin
        self.x, self.square = x, np.einsum("ij,ij->i", moved, moved)
        one = np.ones(len(x))
        self.wide = np.column_stack([moved, self.square, one]) if left else np.column_stack([moved * -2.0, one, self.square])


def squares(a: Side, rows: slice | np.ndarray, b: Side) -> tuple[np.ndarray, float]:
    """Squared distances of some rows of ``a`` to all of ``b``, and how far a number can be off. Close rows are exact."""
    d2 = a.wide[rows] @ b.wide.T
    top = a.square[rows].max(initial=0.0) + b.square.max(initial=0.0)
    i, j = np.nonzero(d2 < CLOSE * top)
    mine = a.x[rows]
    for at in range(0, len(i), AT_ONCE):
        r, c = i[at : at + AT_ONCE], j[at : at + AT_ONCE]
        d2[r, c] = exact(mine[r], b.x[c]) ** 2
    return d2, 1e-15 * (a.x.shape[1] + 8) * top


class Nearest:
    """The k nearest of another key of every asking row, ties to the smaller id; ``tag`` is what else is known of them."""

    def __init__(self, n: int, k: int, reach: np.ndarray | None = None):
        self.k = k
        self.d, self.other = np.full((n, k), np.inf), np.full((n, k), np.iinfo(np.int64).max)
        self.tag = np.full((n, k), None, dtype=object)
        self.reach = np.full(n, np.inf) if reach is None else reach.astype(float)

    def take(self, a: Side, rows: np.ndarray, b: Side, ids: np.ndarray, tags: np.ndarray, d2: np.ndarray, off: float) -> None:
        """``d2`` holds infinity where a row must not count."""
        if not self.k:
            return
        limit = np.minimum(self.reach[rows], self.d[rows, -1]) ** 2 * (1 + 1e-12) + off
        i, j = np.nonzero(d2 <= limit[:, None])
        if len(i) > 4 * self.k * len(rows) and d2.shape[1] > self.k:
            limit = np.minimum(limit, np.partition(d2, self.k - 1, axis=1)[:, self.k - 1] + 2 * off)
            i, j = np.nonzero(d2 <= limit[:, None])
        some = np.isfinite(d2[i, j])
        i, j = i[some], j[some]
        if not len(i):
            return
        mine, d = rows[i], np.empty(len(i))
        for at in range(0, len(i), AT_ONCE):
            d[at : at + AT_ONCE] = exact(a.x[mine[at : at + AT_ONCE]], b.x[j[at : at + AT_ONCE]])
        known = np.unique(mine)
        row = np.concatenate([np.repeat(known, self.k), mine])
        dist = np.concatenate([self.d[known].ravel(), d])
        other = np.concatenate([self.other[known].ravel(), ids[j]])
        tag = np.concatenate([self.tag[known].ravel(), tags[j]])
        order = np.lexsort((other, dist, row))
        row = row[order]
        first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        rank = np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row))))
        kept = rank < self.k
        at, place, from_ = row[kept], rank[kept], order[kept]
        self.d[at, place], self.other[at, place], self.tag[at, place] = dist[from_], other[from_], tag[from_]


def same_key(sorted_keys: np.ndarray, order: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (asking row, member) of equal keys."""
    low, high = np.searchsorted(sorted_keys, keys, "left"), np.searchsorted(sorted_keys, keys, "right")
    n = high - low
    member = np.repeat(np.arange(len(keys)), n)
    at = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return order[at], member


class Profile:
    """Per asking row and group of members: sum, least and greatest distance; and the row's nearest few."""

    def __init__(self, keys: np.ndarray, x: np.ndarray, groups: int, k: int):
        self.origin = x.mean(axis=0)
        self.side = Side(x, self.origin, True)
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        self.total, self.far = np.zeros((len(x), groups)), np.zeros((len(x), groups))
        self.near = np.full((len(x), groups), np.inf)
        self.counts = np.zeros(groups, dtype=np.int64)
        self.nearest = Nearest(len(x), k)

    def take(self, keys: np.ndarray, ids: np.ndarray, x: np.ndarray, codes: np.ndarray) -> None:
        by_code = np.argsort(codes, kind="stable")
        keys, ids, codes = keys[by_code], ids[by_code], codes[by_code]
        other = Side(x[by_code], self.origin, False)
        used, starts, n = np.unique(codes, return_index=True, return_counts=True)
        self.counts[used] += n
        own, member = same_key(self.keys, self.order, keys)
        tags = codes.astype(object)
        for start in range(0, len(self.side.x), TILE_ROWS):
            rows = np.arange(start, min(start + TILE_ROWS, len(self.side.x)))
            d, off = squares(self.side, slice(start, start + TILE_ROWS), other)
            here = (own >= start) & (own <= rows[-1])
            me = own[here] - start, member[here]
            d[me] = np.inf
            self.nearest.take(self.side, rows, other, ids, tags, d, off)
            np.sqrt(np.maximum(d, 0.0, out=d), out=d)
            self.near[rows[:, None], used] = np.minimum(self.near[rows[:, None], used], np.minimum.reduceat(d, starts, axis=1))
            d[me] = 0.0
            self.total[rows[:, None], used] += np.add.reduceat(d, starts, axis=1)
            self.far[rows[:, None], used] = np.maximum(self.far[rows[:, None], used], np.maximum.reduceat(d, starts, axis=1))
