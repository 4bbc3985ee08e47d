"""Clusterings: k-means compression, Ward, k-medoids, sampled k-medoids, and assignment.

Ward and k-medoids look at all pairs, so they take a bounded table: the centres that
``micro_cluster`` makes of any number of rows. The pairwise search is cut into blocks of
centres that Spark spreads over tasks; the driver keeps one number per centre, as the
k-means fit does.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

from tamiz.operators import kernels, lloyd
from tamiz.session import bounded_matrix, cut_lineage

MAX_ITEMS = 4000  # largest table for pairwise work
WARD_TAIL = 256  # live clusters below which merging needs no more tasks
LEVELS = ("Muy Bajo", "Bajo", "Moderado", "Alto", "Muy Alto")


def micro_cluster(
    scores: DataFrame,
    id_col: str,
    k: int = 3000,
    max_iter: int = 100,
    starts: int = 25,
    seed: int = 444,
    vec_col: str = "scores",
) -> tuple[DataFrame, DataFrame]:
    """Compress rows to at most ``k`` k-means centres, the best of several starts.

    Returns ``(center_id, center, size)`` and ``(id, center_id)``.
    """
    grid = lloyd.on_grid(scores, id_col, vec_col)
    found = lloyd.fit(grid, k, starts, seed, max_iter)
    placed = cut_lineage(lloyd.assign(grid, found, scores.schema[id_col].dataType.simpleString()))
    assigned = placed.select(F.col("id").alias(id_col), F.col("centre").alias("center_id"))
    sizes = assigned.groupBy("center_id").agg(F.count(F.lit(1)).alias("size"))
    centre_rows = [(i, [float(v) for v in c]) for i, c in enumerate(found)]
    centres = scores.sparkSession.createDataFrame(centre_rows, "center_id int, center array<double>")
    return centres.join(sizes, "center_id"), assigned


def kmeans(points: DataFrame, id_col: str, vec_col: str, k: int, seed: int = 444, max_iter: int = 100, starts: int = 1) -> DataFrame:
    """``id, cluster`` (1..k, in coordinate order of the centres) by k-means on any number of rows."""
    grid = lloyd.on_grid(points, id_col, vec_col)
    found = lloyd.fit(grid, k, starts, seed, max_iter)
    placed = lloyd.assign(grid, found, points.schema[id_col].dataType.simpleString())
    return placed.select(F.col("id").alias(id_col), (F.col("centre") + 1).cast("int").alias("cluster"))


def _over_blocks(spark: SparkSession, n: int, work: Callable[[np.ndarray], pd.DataFrame], schema: str) -> pd.DataFrame:
    """Run ``work`` on blocks of 0..n-1 in parallel; the results have a few numbers per index."""
    tasks = max(1, min(spark.sparkContext.defaultParallelism, -(-n // 64)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield work(batch["id"].to_numpy())

    return spark.range(0, n, 1, tasks).mapInPandas(run, schema).toPandas()


def ward_tree(spark: SparkSession, x: np.ndarray, sizes: np.ndarray | None = None) -> list[tuple[float, int, int]]:
    """Merges of the Ward tree over bounded centres.

    Each round finds every cluster's best partner in parallel and joins all mutual pairs.
    Ward heights never decrease along a chain, so this gives the same tree as one merge at a time.
    """
    centres = x.astype(float).copy()
    weight = np.ones(len(x)) if sizes is None else sizes.astype(float).copy()
    names = np.arange(len(x))
    merges: list[tuple[float, int, int]] = []
    while len(names) > WARD_TAIL:
        shared = spark.sparkContext.broadcast((centres, weight))

        def partner(rows: np.ndarray, shared=shared) -> pd.DataFrame:
            c, w = shared.value
            cost = kernels.ward_costs(rows, c, w)
            best = cost.argmin(axis=1)
            return pd.DataFrame({"id": rows, "partner": best, "cost": cost[np.arange(len(rows)), best]})

        found = _over_blocks(spark, len(names), partner, "id bigint, partner bigint, cost double").sort_values("id")
        shared.destroy()
        near, cost = found["partner"].to_numpy(), found["cost"].to_numpy()
        pairs = [(a, int(b)) for a, b in enumerate(near) if near[b] == a and a < b]
        for a, b in pairs:
            merges.append((float(cost[a]), int(names[a]), int(names[b])))
            total = weight[a] + weight[b]
            centres[a] = (weight[a] * centres[a] + weight[b] * centres[b]) / total
            weight[a] = total
        keep = np.ones(len(names), bool)
        keep[[b for _, b in pairs]] = False
        centres, weight, names = centres[keep], weight[keep], names[keep]
    tail = kernels.ward_merges(centres, weight)
    return merges + [(h, int(names[a]), int(names[b])) for h, a, b in tail]


def _labelled(points: DataFrame, id_col: str, ids: Sequence, labels: np.ndarray) -> DataFrame:
    schema = StructType([points.schema[id_col], StructField("cluster", IntegerType())])
    return points.sparkSession.createDataFrame([(i, int(v) + 1) for i, v in zip(ids, labels)], schema)


def ward(
    points: DataFrame, id_col: str, vec_col: str, k: int, size_col: str | None = None, max_items: int = MAX_ITEMS
) -> DataFrame:
    """``id, cluster`` (1..k) by Ward's criterion, numbered by first member in id order.

    ``size_col`` starts from weighted centres; by default each counts once.
    """
    ids, x = bounded_matrix(points, id_col, vec_col, max_items)
    sizes = None
    if size_col:
        _, w = bounded_matrix(points.select(id_col, F.array(size_col).alias("w")), id_col, "w", max_items)
        sizes = w[:, 0]
    merges = ward_tree(points.sparkSession, x, sizes)
    return _labelled(points, id_col, ids, kernels.cut_merges(len(x), merges, k))


def pam(points: DataFrame, id_col: str, vec_col: str, k: int, max_items: int = MAX_ITEMS) -> tuple[DataFrame, list]:
    """``id, cluster`` (1..k) and the medoid ids, by k-medoids on a bounded table.

    Candidates are scored in parallel, each against all points, for the greedy start and for every swap.
    """
    spark = points.sparkSession
    ids, x = bounded_matrix(points, id_col, vec_col, max_items)
    k = min(k, len(x))
    shared = spark.sparkContext.broadcast(x)
    medoids: list[int] = []
    nearest = np.full(len(x), np.inf)
    for _ in range(k):

        def gain(rows: np.ndarray, nearest=nearest) -> pd.DataFrame:
            return pd.DataFrame(
                {"id": rows, "total": kernels.build_gain(kernels.distances(shared.value[rows], shared.value), nearest)}
            )

        found = _over_blocks(spark, len(x), gain, "id bigint, total double")
        found = found[~found["id"].isin(medoids)].sort_values(["total", "id"])
        medoids.append(int(found["id"].iloc[0]))
        nearest = np.minimum(nearest, kernels.distances(x[medoids[-1:]], x)[0])
    while True:
        near, second, owner = kernels.medoid_view(kernels.distances(x, x[medoids]))

        def swaps(rows: np.ndarray, near=near, second=second, owner=owner) -> pd.DataFrame:
            block = kernels.distances(shared.value[rows], shared.value)
            delta = kernels.swap_deltas(block, near, second, owner, k)
            best = delta.argmin(axis=1)
            return pd.DataFrame({"id": rows, "medoid": best, "delta": delta[np.arange(len(rows)), best]})

        found = _over_blocks(spark, len(x), swaps, "id bigint, medoid bigint, delta double")
        found = found[~found["id"].isin(medoids)].sort_values(["delta", "id"])
        if found.empty or found["delta"].iloc[0] >= -1e-9:
            break
        medoids[int(found["medoid"].iloc[0])] = int(found["id"].iloc[0])
    shared.destroy()
    return _labelled(points, id_col, ids, kernels.first_seen(owner)), [ids[m] for m in medoids]


def clara(
    points: DataFrame, id_col: str, vec_col: str, k: int, samples: int = 5, seed: int = 444
) -> tuple[DataFrame, list[list[float]]]:
    """``id, cluster, distance`` for any number of rows, and the medoids: the best of several sampled fits.

    The rows are stored first, so that the Python work behind them is done once and never beside the passes here. One pass
    draws all samples, one task per sample fits it, one more pass costs every fit on all rows.
    """
    points = cut_lineage(points.select(id_col, vec_col))
    size = 40 + 2 * k

    drawn = points.select(
        F.col(id_col).cast("string").alias("id"),
        F.col(vec_col).alias("v"),
        F.explode(F.array(*[F.lit(s) for s in range(samples)])).alias("sample"),
    ).withColumn("h", F.xxhash64("id", "sample", F.lit(seed)))
    # Spark applies the rank limit inside each task, so only ``size`` rows per task and sample are shuffled.
    rank = Window.partitionBy("sample").orderBy("h", "id")
    sampled = drawn.withColumn("rn", F.row_number().over(rank)).where(F.col("rn") <= size)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h", "id"])
        x = np.array(pdf["v"].tolist(), dtype=float)
        chosen = kernels.pam_medoids(kernels.distances(x, x), min(k, len(x)))
        return pd.DataFrame({"sample": pdf["sample"].iloc[0], "medoids": [x[chosen].tolist()]})

    fitted = sampled.groupBy("sample").applyInPandas(fit, "sample int, medoids array<array<double>>").collect()
    options = [np.array(r["medoids"], dtype=float) for r in sorted(fitted, key=lambda r: r["sample"])]

    def cost(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = np.array(batch["v"].tolist(), dtype=float)
            if len(x):
                totals = [float(kernels.distances(x, m).min(axis=1).sum()) for m in options]
                yield pd.DataFrame({"option": range(len(options)), "cost": totals})

    costs = points.select(F.col(vec_col).alias("v")).mapInPandas(cost, "option int, cost double")
    totals = costs.groupBy("option").agg(F.sum("cost").alias("cost")).orderBy("cost", "option").first()
    medoids = options[totals["option"]]
    return assign_nearest(points, id_col, vec_col, medoids), medoids.tolist()


def assign_nearest(points: DataFrame, id_col: str, vec_col: str, centres: np.ndarray) -> DataFrame:
    """``id, cluster, distance`` to the nearest of a few centres (1..k)."""
    schema = StructType(
        [points.schema[id_col], StructField("cluster", IntegerType()), StructField("distance", DoubleType())]
    )

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                d = kernels.distances(np.array(batch["v"].tolist(), dtype=float), centres)
                yield pd.DataFrame({id_col: batch[id_col], "cluster": d.argmin(axis=1) + 1, "distance": d.min(axis=1)})

    return points.select(id_col, F.col(vec_col).alias("v")).mapInPandas(assign, schema)


def inherit_labels(assigned: DataFrame, centre_labels: DataFrame) -> DataFrame:
    """Give every row the cluster of its centre; the centre table is bounded by ``micro_cluster``."""
    return assigned.join(F.broadcast(centre_labels.select("center_id", "cluster")), "center_id")


def ordinal_levels(df: DataFrame, cluster: str, measure: str, names: Sequence[str] = LEVELS) -> DataFrame:
    """Add ``level`` and ``nivel_jurisdiccion``: clusters ordered by mean ``measure``, lowest first."""
    means = df.groupBy(cluster).agg(F.avg(measure).alias("__m")).orderBy("__m", cluster).take(len(names) + 1)
    if len(means) > len(names):
        raise ValueError(f"more clusters than the {len(names)} level names")
    schema = StructType([df.schema[cluster], StructField("level", IntegerType()), StructField("nivel_jurisdiccion", StringType())])
    ranked = [(r[cluster], i + 1, names[i]) for i, r in enumerate(means)]
    return df.join(F.broadcast(df.sparkSession.createDataFrame(ranked, schema)), cluster)
