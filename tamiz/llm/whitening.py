"""Whitening of vectors from the singular values of their centred rows, never from a product of the matrix with itself.

Components become integers floor(64 * c) + 1000000. The fit list holds each distinct integer vector once. Its rows are
centred and reduced block by block to a triangle R by QR, and the triangles of the tasks are reduced again in rounds of
``FAN_IN`` until one is left. That one has as many rows as the vectors have dimensions; its Householder bidiagonal form
B goes through dqds (``qd.py``) for the singular values and through twisted factorisations for the right singular
vectors, which the reflectors carry back. With n rows, a singular value s is an eigenvalue s * s / n of the covariance.

Defined cases: rows whose vector is null or holds null, NaN or infinite entries are left out, and so are vectors shorter
than the longest (their missing entries are null). Entries whose 64-fold passes 2^52 are held there. Repeated rows, null
ids and ids used twice stay, each with its own result; in the fit list equal vectors count once. Components without
variance (n = 1, constant or dependent dimensions) have no whitened value and are left out, so a table without any
variance gives no row. Equal eigenvalues give some orthonormal set of their space. A deviation beyond 63 bits is null.
No usable row: no row. Only the id and the vector column are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tamiz.llm import qd
from tamiz.llm.base import Stages
from tamiz.llm.maxscore import usable

SCALE = 64
OFFSET = 1_000_000
COMPONENTS = 16
FAN_IN = 32
BLOCK_ROWS = 4096
WIDEST = 2**52


@dataclass(frozen=True)
class Fit:
    """What the fit list gives: its size, the sums per dimension, and the components by falling eigenvalue."""

    n: int
    sums: tuple[int, ...]
    span: int  # greatest absolute entry
    values: np.ndarray  # eigenvalues of the covariance that are above rounding
    vectors: np.ndarray  # one column per eigenvalue
    trace: float

    def moved(self, x: np.ndarray) -> np.ndarray:
        """n * x - sums, exactly."""
        wide = 2 * self.n * self.span >= 2**62
        return x.astype(object if wide else np.int64) * self.n - np.array(self.sums, dtype=object if wide else np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (self.moved(x) / self.n).astype(np.float64)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        moved = self.moved(x)
        reach = int(np.abs(moved).max(initial=0))
        if reach * reach * max(1, x.shape[1]) >= 2**63:
            moved = moved.astype(object)
        total = (moved * moved).sum(axis=1).tolist() if x.shape[1] else [0] * len(x)
        return [t if t < 2**63 else None for t in total]

    def whitened(self, x: np.ndarray, components: int) -> np.ndarray:
        k = min(components, len(self.values))
        return self.centred(x) @ self.vectors[:, :k] / np.sqrt(self.values[:k])


def integer_rows(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``id, x`` of the usable rows."""
    known = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v")).filter(usable(F.col("v")))
    edge = float(WIDEST)
    whole = F.transform("v", lambda c: F.floor(F.greatest(F.least(c * float(SCALE), F.lit(edge)), F.lit(-edge))) + F.lit(OFFSET))
    return known.select("id", whole.alias("x"))


def matrix(lists: pd.Series, width: int) -> np.ndarray:
    return np.array(lists.tolist(), dtype=np.int64).reshape(len(lists), width)


def triangle(rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(rows, mode="r")


def _reduce_rows(fit_rows: DataFrame, plain: Fit, width: int) -> DataFrame:
    """``part, r``: one triangle per task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = np.zeros((0, width))
        for batch in batches:
            for start in range(0, len(batch), BLOCK_ROWS):
                x = matrix(batch["x"].iloc[start : start + BLOCK_ROWS], width)
                held = triangle(np.vstack([held, plain.centred(x)]))
        if len(held):
            yield pd.DataFrame({"r": [held.ravel().tolist()]})

    return fit_rows.select("x").mapInPandas(run, "r array<double>").select(F.monotonically_increasing_id().alias("part"), "r")


def _merge_rounds(parts: DataFrame, width: int, stages: Stages) -> np.ndarray:
    """Triangles merged ``FAN_IN`` at a time until one task holds the last few."""

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("part")
        stacked = np.vstack([np.array(r).reshape(-1, width) for r in pdf["r"]])
        return pd.DataFrame({"part": pdf["part"].iloc[:1], "r": [triangle(stacked).ravel().tolist()]})

    kept = stages.keep(parts)
    left = kept.count()
    while left > 1:
        groups = -(-left // FAN_IN)
        merged = kept.groupBy(F.pmod(F.xxhash64("part"), F.lit(groups)).alias("g")).applyInPandas(merge, "part long, r array<double>")
        kept = stages.keep(merged)
        left = kept.count()
    last = kept.first()  # one row of at most width * width numbers
    return np.array(last["r"]).reshape(-1, width)


def fit_rows_of(rows: DataFrame) -> DataFrame:
    """Each distinct integer vector once."""
    return rows.select("x").distinct()


def fit(distinct: DataFrame, width: int, stages: Stages) -> Fit:
    """Components of a stored list ``x`` of distinct vectors of one width."""
    entries = distinct.select(F.posexplode("x").alias("at", "c"))
    totals = entries.groupBy("at").agg(F.sum(F.col("c").cast("decimal(38,0)")).alias("s"), F.max(F.abs("c")).alias("span")).orderBy("at").collect()
    n = distinct.count()
    sums, span = tuple(int(t["s"]) for t in totals), max((t["span"] for t in totals), default=0)
    plain = Fit(n, sums, span, np.zeros(0), np.zeros((width, 0)), 0.0)
    if not width or not n:
        return plain
    r = _merge_rounds(_reduce_rows(distinct, plain, width), width, stages)
    values, vectors = qd.right_singular(r)
    eigen = values * values / n
    lasting = values > max(r.shape) * np.finfo(float).eps * max(values.max(initial=0.0), 1e-300)
    return Fit(n, sums, span, eigen[lasting], vectors[:, lasting], float(eigen.sum()))


def identity_error(distinct: DataFrame, fitted: Fit, width: int, components: int) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity."""
    k = min(components, len(fitted.values))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, second = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            y = fitted.whitened(matrix(batch["x"], width), components)
            first += y.sum(axis=0)
            second += y.T @ y
        numbers = np.concatenate([first, second.ravel()])
        yield pd.DataFrame({"at": np.arange(len(numbers)), "v": numbers})

    parts = distinct.select("x").mapInPandas(run, "at long, v double").groupBy("at").agg(F.sum("v").alias("v"))
    numbers = np.array([r["v"] for r in parts.orderBy("at").collect()])  # k + k * k numbers
    mean, second = numbers[:k] / fitted.n, numbers[k:].reshape(k, k) / fitted.n
    return float(np.abs(second - np.outer(mean, mean) - np.eye(k)).max())


def whiten(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per usable row: id, n, deviation, and per component up to ``components`` arrays whitened, explained;
    identity_error."""
    stages = Stages(vectors.sparkSession)
    rows = stages.keep(integer_rows(vectors, id_col, vec_col))
    width = rows.agg(F.max(F.size("x"))).first()[0] or 0
    rows = rows.filter(F.size("x") == width)
    distinct = stages.keep(fit_rows_of(rows))
    fitted = fit(distinct, width, stages)
    k = min(components, len(fitted.values))
    error = identity_error(distinct, fitted, width, components) if k else None
    explained = (fitted.values[:k] / fitted.trace).tolist() if k else []

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = matrix(batch["x"], width)
            out = pd.DataFrame({"id": batch["id"], "deviation": pd.array(fitted.deviations(x), dtype="Int64")})
            out["whitened"] = list(fitted.whitened(x, components)) if k else [[]] * len(batch)
            yield out

    id_type = rows.schema["id"].dataType.simpleString()
    out = rows.mapInPandas(run, f"id {id_type}, deviation long, whitened array<double>")
    return out.select(
        F.col("id").alias(id_col), F.lit(fitted.n).cast("long").alias("n"), "deviation", "whitened",
        F.lit(explained).cast("array<double>").alias("explained") if explained else F.array().cast("array<double>").alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )


def by_component(whitened: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """One row per id and component, numbered from 1."""
    tall = whitened.select(id_col, "n", "deviation", "explained", "identity_error", F.posexplode("whitened").alias("at", "whitened"))
    explained = F.get("explained", F.col("at"))
    return tall.select(id_col, (F.col("at") + 1).alias("component"), "n", "deviation", "whitened", explained.alias("explained"), "identity_error")
