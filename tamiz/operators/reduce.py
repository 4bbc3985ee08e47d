"""Standardised principal components from a mergeable table of cross products."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

TIE = 1e-9  # lets the first of two loadings of equal size decide the sign


@dataclass(frozen=True)
class Components:
    """A fitted reduction: scaling of each kept column and the unit loadings of the kept components."""

    columns: tuple[str, ...]
    means: tuple[float, ...]
    scales: tuple[float, ...]
    eigenvalues: tuple[float, ...]
    loadings: np.ndarray  # columns x components, unit length


def _values(columns: Sequence[str]) -> Column:
    return F.array(*[F.col(f"`{c}`").cast("double") for c in columns])


def _matrix(rows: pa.Array, width: int) -> np.ndarray:
    """Arrow lists of ``width`` numbers as a matrix; missing numbers are NaN."""
    return rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), width)


def centred_products(df: DataFrame, columns: Sequence[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, means, and sums of products of deviations, a missing value standing at its column's mean.

    One pass. Every task adds up three square tables over its batches: products of shifted values, shifted sums over rows
    where the other column is present, and counts of rows with both. The tables add across tasks in one small aggregate, and
    means and deviations follow from them. The shift, the means of a few rows, only keeps numbers of like size; the result
    does not depend on it. What reaches the driver is bounded by the square of the number of columns.
    """
    width = len(columns)
    near = df.select(*[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(columns)]).limit(1000)
    shift = np.array([v or 0.0 for v in near.agg(*[F.avg(f"c{i}") for i in range(width)]).first()], dtype=float)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, (products, sums, both) = 0, np.zeros((3, width, width))
        for batch in batches:
            x = _matrix(batch.column(0), width) - shift
            there = ~np.isnan(x)
            x, mask = np.where(there, x, 0.0), there.astype(float)
            products += x.T @ x
            sums += x.T @ mask
            both += mask.T @ mask
            rows += len(x)
        if rows:
            i, j = np.divmod(np.arange(width * width), width)
            yield pa.RecordBatch.from_arrays(
                [pa.array(i, pa.int32()), pa.array(j, pa.int32()), *[pa.array(m.ravel()) for m in (products, sums, both)],
                 pa.array(np.where(i + j == 0, rows, 0), pa.int64())],
                names=["i", "j", "p", "s", "n", "rows"],
            )

    parts = df.select(_values(columns).alias("x")).mapInArrow(add_up, "i int, j int, p double, s double, n double, rows long")
    total = parts.groupBy("i", "j").agg(F.sum("p"), F.sum("s"), F.sum("n"), F.sum("rows")).collect()
    if not total:
        return 0, shift, np.zeros((width, width))
    p, s, n = (np.zeros((width, width)) for _ in range(3))
    for i, j, *found, _ in total:
        p[i, j], s[i, j], n[i, j] = found
    mean = np.diag(s) / np.maximum(np.diag(n), 1)
    deviations = p - mean[:, None] * s.T - mean[None, :] * s + np.outer(mean, mean) * n
    return sum(r[-1] for r in total), mean + shift, deviations


def pca_fit(df: DataFrame, columns: Sequence[str], n_components: int) -> Components:
    """Fit on standardised columns (population deviation, missing values at the mean).

    Columns without variance are left out. Each component points where its largest loading is positive.
    """
    rows, means, deviations = centred_products(df, columns)
    spread = np.diag(deviations)
    # Rounding can leave a constant column a spread of some units in the last place of its square sum.
    varies = spread > 1e-26 * rows * np.square(means)
    if not varies.any():
        raise ValueError("no column varies")
    scales = np.sqrt(spread[varies] / rows)
    correlations = deviations[np.ix_(varies, varies)] / rows / np.outer(scales, scales)
    values, vectors = np.linalg.eigh((correlations + correlations.T) / 2)
    values, vectors = np.maximum(values[::-1], 0.0), vectors[:, ::-1]
    kept = [c for c, v in zip(columns, varies) if v]
    loadings = vectors[:, : min(n_components, len(kept))]
    lead = np.argmax(np.abs(loadings) - TIE * np.arange(len(kept))[:, None], axis=0)
    signs = np.where(loadings[lead, np.arange(loadings.shape[1])] >= 0, 1.0, -1.0)
    return Components(
        tuple(kept), tuple(means[varies].tolist()), tuple(scales.tolist()), tuple(values.tolist()), loadings * signs
    )


def pca_scores(df: DataFrame, fit: Components, keep: Sequence[str]) -> DataFrame:
    """``keep`` columns and ``scores``, an array with one number per component."""
    means, weights = np.array(fit.means), fit.loadings / np.array(fit.scales)[:, None]

    @F.pandas_udf("array<double>")
    def scores(x: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=object)
        centred = np.stack(x.to_numpy()).astype(float) - means
        return pd.Series(list(np.where(np.isnan(centred), 0.0, centred) @ weights))

    return df.select(*keep, scores(_values(fit.columns)).alias("scores"))


def score_columns(scores: DataFrame, keep: Sequence[str], n_components: int) -> DataFrame:
    """The score array as columns ``dim_1``, ``dim_2``, ..."""
    return scores.select(*keep, *[F.col("scores")[i].alias(f"dim_{i + 1}") for i in range(n_components)])


def eigen_table(spark: SparkSession, fit: Components) -> DataFrame:
    """``component, eigenvalue, percentage, cumulative`` for all components."""
    values = np.array(fit.eigenvalues)
    share = 100 * values / values.sum()
    rows = [
        (i + 1, float(v), float(p), float(c)) for i, (v, p, c) in enumerate(zip(values, share, np.cumsum(share)))
    ]
    return spark.createDataFrame(rows, "component int, eigenvalue double, percentage double, cumulative double")


def variable_quality(spark: SparkSession, fit: Components) -> DataFrame:
    """``variable, component, coordinate, cos2``: correlation of each column with each kept component."""
    rows = []
    for i, c in enumerate(fit.columns):
        for j in range(fit.loadings.shape[1]):
            coordinate = float(fit.loadings[i, j] * max(fit.eigenvalues[j], 0.0) ** 0.5)
            rows.append((c, j + 1, coordinate, coordinate**2))
    return spark.createDataFrame(rows, "variable string, component int, coordinate double, cos2 double")
