"""Exact top-k inner products by MaxScore over postings of integer components.

A component x becomes floor(256 * x). A term is a dimension with a sign; its postings are the rows whose component has
that sign, and its bound for a query is |query component| times the greatest such component of the shard. With the terms
in falling order of their bounds, those at the end whose bounds together stay below the query's threshold are
non-essential: a row in no essential posting list cannot reach the threshold. Rows of the essential lists get their
essential part first; the other terms are then probed a few at a time, and a row goes as soon as what it has plus the
bounds still open is below the threshold (components of the other sign only lower a score, so the bound holds).

The threshold of a query is its k-th best score among ``SEED_ROWS`` rows: a lower bound of its k-th best score overall,
from a set of fixed size. Rows are dealt to shards and queries to blocks of fixed sizes; every block meets every shard
once, in one task per pair, which returns at most k rows a query. The last step merges the shards' lists.

Defined cases: vectors that are null or hold null, NaN or infinite components take no part. Every row whose id is
divisible by ``every`` is a query of its own, repeated ids too, and every other row is its candidate, also one with the
same id. Rows with a null id are candidates only and lose ties. Missing trailing components count as zero. Ties go to
the smaller id. Scores beyond 63 bits are held at the end of the range. No query or no candidate: no row. Only the id
and the vector column are read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tamiz.llm.base import Stages

TOP = 5
EVERY = 50
SCALE = 256
SHARD_ROWS = 4096
BLOCK_QUERIES = 4096
SEED_ROWS = 1024
PROBE_TERMS = 8
FLOAT_EXACT = 2**53
LONG = 2**63 - 1
NO_FLOOR = -LONG


def usable(vector: Column) -> Column:
    """True where a vector is there and all its components are finite."""
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False))


def integer_rows(vectors: DataFrame, id_col: str, vec_col: str, scale: int = SCALE) -> DataFrame:
    """``row, id, no_id, x``: a number per usable row, its id (the greatest long where missing), its integer components."""
    known = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    whole = F.transform("v", lambda c: F.floor(c * F.lit(float(scale))))
    return known.filter(usable(F.col("v"))).select(
        F.monotonically_increasing_id().alias("row"), F.coalesce("id", F.lit(LONG)).alias("id"), F.col("id").isNull().alias("no_id"), whole.alias("x")
    )


def matrix(lists: pd.Series) -> np.ndarray:
    """Integer rows, zero behind their end, as int64."""
    width = max(map(len, lists), default=0)
    out = np.zeros((len(lists), width), dtype=np.int64)
    for at, row in enumerate(lists):
        out[at, : len(row)] = row
    return out


class Shard:
    """Postings of one shard: a line per dimension, and the greatest component of each sign."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, x: np.ndarray, exact_floats: bool):
        self.rows, self.ids = rows, ids
        self.lines = np.ascontiguousarray(x.T).astype(np.float64 if exact_floats else object)
        none = np.zeros(x.shape[1], dtype=np.int64)
        self.most = np.maximum(x.max(axis=0, initial=0), none).astype(self.lines.dtype)
        self.least = np.minimum(x.min(axis=0, initial=0), none).astype(self.lines.dtype)

    def search(self, query: np.ndarray, own: int, floor: int | None, top: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the best ``top`` rows but ``own`` that reach ``floor``."""
        width = min(len(query), len(self.lines))
        q = query[:width].astype(self.lines.dtype)
        bounds = np.where(q > 0, q * self.most[:width], q * self.least[:width])
        order = np.argsort(-bounds, kind="stable")
        order = order[q[order] != 0]
        open_bounds = np.append(np.cumsum(bounds[order][::-1])[::-1], 0)  # what the terms from here on can add
        if floor is None:
            live, split = np.arange(len(self.ids)), len(order)
        else:
            split = int(np.count_nonzero(open_bounds[:-1] >= floor))
            listed = np.zeros(len(self.ids), dtype=bool)
            for term in order[:split]:
                listed |= (self.lines[term] > 0) if q[term] > 0 else (self.lines[term] < 0)
                if listed.all():
                    break
            # With a floor of zero or less a row in no list can still reach it.
            live = np.flatnonzero(listed) if floor > 0 else np.arange(len(self.ids))
        essential = order[:split]
        scores = self._part(q, essential, live)
        for at in range(split, len(order), PROBE_TERMS):
            keep = scores + open_bounds[at] >= floor
            live, scores = live[keep], scores[keep]
            if not len(live):
                break
            scores = scores + self._part(q, order[at : at + PROBE_TERMS], live)
        fit = self.rows[live] != own
        if floor is not None:
            fit &= scores >= floor
        live, scores = live[fit], scores[fit]
        if scores.dtype == object:
            scores = np.clip(scores, -LONG, LONG)
        if len(live) > top:  # all that tie with the last place stay for the order by id
            kth = np.partition(scores, len(scores) - top)[len(scores) - top]
            live, scores = live[scores >= kth], scores[scores >= kth]
        best = np.lexsort((self.rows[live], self.ids[live], -scores))[:top]
        return live[best], scores[best]

    def _part(self, q: np.ndarray, terms: np.ndarray, live: np.ndarray) -> np.ndarray:
        if not len(terms):
            return np.zeros(len(live), dtype=self.lines.dtype)
        lines = self.lines[terms] if len(live) == len(self.ids) else self.lines[np.ix_(terms, live)]
        return q[terms] @ lines


def _search_shard(rows: pd.DataFrame, queries: pd.DataFrame, top: int) -> pd.DataFrame:
    x, y = matrix(rows["x"]), matrix(queries["query"])
    width = min(x.shape[1], y.shape[1])
    # Python integers: their product cannot wrap.
    reach = width * max(map(abs, (int(x.max(initial=0)), int(x.min(initial=0))))) * max(map(abs, (int(y.max(initial=0)), int(y.min(initial=0)))))
    shard = Shard(rows["row"].to_numpy(), rows["id"].to_numpy(), x, reach < FLOAT_EXACT)
    no_id = rows["no_id"].to_numpy()
    found = []
    for query_row, query_id, vector, floor in zip(queries["query_row"], queries["query_id"], y, queries["floor"].tolist()):
        places, scores = shard.search(vector, query_row, None if floor == NO_FLOOR else floor, top)
        for place, score in zip(places.tolist(), scores.tolist()):
            found.append((query_row, query_id, int(shard.rows[place]), int(shard.ids[place]), bool(no_id[place]), int(score)))
    return pd.DataFrame(found, columns=COLUMNS)


FOUND = "query_row long, query_id long, row long, vec_id long, no_id boolean, score long"
COLUMNS = [field.split()[0] for field in FOUND.split(", ")]


def _met(rows: DataFrame, queries: DataFrame, shards: int, blocks: int, top: int) -> DataFrame:
    """Every block of queries meets every shard of rows; ``FOUND`` rows of each meeting."""
    sides = [
        rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))),
        queries.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))),
    ]
    left, right = (side.groupBy("shard", "block") for side in sides)

    def meet(some: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(some) or not len(asked):
            return pd.DataFrame(columns=COLUMNS)
        return _search_shard(some, asked, top)

    return left.cogroup(right).applyInPandas(meet, FOUND)


def _best(found: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "no_id", "row")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def top_products(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", top: int = TOP, every: int = EVERY,
                 shard_rows: int = SHARD_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's ``top`` candidates by integer inner product."""
    stages = Stages(vectors.sparkSession)
    rows = stages.keep(integer_rows(vectors, id_col, vec_col))
    sizes = rows.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("id") % every == 0).alias("queries")).first()
    shards, blocks = (max(1, -(-n // size)) for n, size in ((sizes["rows"], shard_rows), (sizes["queries"], block_queries)))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int"))
    block = F.pmod(F.xxhash64("row", F.lit(1)), F.lit(blocks)).cast("int")
    asked = rows.filter(F.col("id") % every == 0).select(
        F.col("row").alias("query_row"), F.col("id").alias("query_id"), F.col("x").alias("query"), block.alias("block"), F.lit(NO_FLOOR).alias("floor")
    )

    seeds = rows.orderBy(F.xxhash64("row", F.lit(2)), "row").limit(SEED_ROWS).withColumn("shard", F.lit(0))
    seeded = _best(_met(seeds, asked, 1, blocks, top), top).groupBy("query_row").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("floor"))
    floors = seeded.filter(F.col("n") == top).select("query_row", "floor")
    asked = stages.keep(asked.drop("floor").join(floors, "query_row", "left").withColumn("floor", F.coalesce("floor", F.lit(NO_FLOOR))))

    found = _best(_met(dealt, asked, shards, blocks, top), top)
    return found.select("query_id", "rank", F.when(~F.col("no_id"), F.col("vec_id")).alias("vec_id"), "score")
