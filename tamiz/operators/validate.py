"""Internal indices of clusterings of any size, and bootstrap stability of those of a bounded set of centres.

All pairs are looked at, yet none is ever a row: every task holds the bounded set, or a block
of a larger one, and reduces its own points to a few numbers each.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import IntegerType

from tamiz.operators import kernels, pairs
from tamiz.operators.profile import min_max
from tamiz.session import bounded_matrix, cut_lineage

MAX_ITEMS = 10_000
NEIGHBOURS = 10
METHODS = ("hierarchical", "kmeans", "pam", "clara")
K_RANGE = (2, 3, 4, 5, 6)
SHARED_SETS = 64  # of clusters that occur together, up to which configurations share one look at all pairs


def centre_table(points: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """``id, vec, label`` of a table, as ``point_profile`` and ``validation_grid`` take it.

    They look at all pairs. ``balls.connectivity``, ``balls.dunn`` and ``silhouette_squared`` get by with fewer.
    """
    return points.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"), F.col(label_col).alias("label"))


def silhouette_squared(points: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """``id, label, neighbour, width`` of every row of a table of any size, with squared Euclidean distances.

    The mean squared distance of a row to a cluster follows from the cluster's count, vector sum and sum of squares, so
    two passes with map-side sums and one small row per cluster are enough. Vectors are centred first, which keeps the
    squares small. A row alone in its cluster, or without another cluster, has width 0; rows without vector or label are
    left out.
    """
    rows = centre_table(points, id_col, vec_col, label_col).where(F.col("vec").isNotNull() & F.col("label").isNotNull())
    at_mean = rows.select(F.posexplode("vec").alias("at", "x")).groupBy("at").agg(F.avg("x").alias("m"))
    mean = at_mean.agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "m"))), lambda s: s["m"]).alias("mean"))
    moved = rows.withColumn("mean", mean.scalar()).select("id", "label", F.zip_with("vec", "mean", lambda x, m: x - m).alias("vec"))
    sums = moved.select("label", F.posexplode("vec").alias("at", "x")).groupBy("label", "at").agg(
        F.count(F.lit(1)).alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q")
    )
    parts = F.array_sort(F.collect_list(F.struct("at", "s")))
    clusters = sums.groupBy("label").agg(F.max("n").alias("n"), F.transform(parts, lambda p: p["s"]).alias("s"), F.sum("q").alias("q"))
    listed = clusters.agg(F.array_sort(F.collect_list(F.struct("label", "n", "s", "q"))).alias("clusters"))

    own_square = F.aggregate("vec", F.lit(0.0), lambda t, x: t + x * x)
    near = moved.select("id", "label", "vec", own_square.alias("square"), listed.scalar().alias("clusters"))

    def mean_square(c: Column, n: Column) -> Column:
        dot = F.aggregate(F.zip_with("vec", c["s"], lambda x, y: x * y), F.lit(0.0), lambda t, v: t + v)
        return F.greatest((c["n"] * F.col("square") - 2 * dot + c["q"]) / n, F.lit(0.0))

    own = F.filter("clusters", lambda c: c["label"] == F.col("label"))[0]
    others = F.filter("clusters", lambda c: c["label"] != F.col("label"))
    away = F.array_min(F.transform(others, lambda c: F.struct(mean_square(c, c["n"]).alias("b"), c["label"].alias("label"))))
    found = near.select(
        "id", "label", F.when(own["n"] > 1, mean_square(own, F.nullif(own["n"] - 1, F.lit(0)))).alias("a"), away.alias("other")
    )
    a, b = F.col("a"), F.col("other.b")
    width = F.coalesce((b - a) / F.nullif(F.greatest(a, b), F.lit(0.0)), F.lit(0.0))
    return found.select("id", "label", F.col("other.label").alias("neighbour"), F.when(a.isNull() | b.isNull(), 0.0).otherwise(width).alias("width"))


def point_profile(points: DataFrame, max_items: int | None = None, neighbours: int = NEIGHBOURS) -> DataFrame:
    """Per point and label of an ``(id, vec, label)`` table of any size: its distances to that label, summed up.

    Columns ``id, own, label, n, total, nearest, farthest`` (the point itself left out) and
    ``penalty``: the sum of 1/j over its j-th nearest neighbours that carry this other label. All pairs are looked at, so
    the work grows with the square of the table; a task holds a bounded block of points, past which the others go.
    With ``max_items`` a larger table is refused. Points with a missing component are far from none and near none.
    """
    stored = cut_lineage(points.select("id", F.col("vec").cast("array<double>").alias("vec"), "label").withColumn("no", F.monotonically_increasing_id()))
    facts = stored.agg(F.count(F.lit(1)), F.count("vec"), F.count("label"), F.max(F.size("vec"))).first()
    items, whole, width = facts[0], min(facts[1], facts[2]), facts[3] or 0
    if max_items is not None and items > max_items:
        raise ValueError(f"more than {max_items} rows: compress them with micro_cluster first")
    if whole < items:
        raise ValueError(f"{items - whole} rows without vector or label")
    # One row per label; what comes out has a row per point and label.
    names = stored.select("label").distinct()
    names = cut_lineage(names.select("label", (F.row_number().over(Window.orderBy("label")) - 1).alias("code")))
    groups = names.count()
    known = F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = cut_lineage(stored.join(names, "label").select("no", "id", "vec", "code", known.alias("known")))
    blocks = pairs.blocks_for(items, width + 3 * groups + 4 * neighbours, points.sparkSession.sparkContext.defaultParallelism)
    asking = rows.withColumn("block", F.pmod(F.xxhash64("no"), F.lit(blocks)).cast("int"))
    zeros = F.transform("vec", lambda v: F.lit(0.0))
    asking = asking.withColumn("vec", F.when(F.col("known"), F.col("vec")).otherwise(zeros))
    members = rows.where("known").withColumn("blocks", F.sequence(F.lit(0), F.lit(blocks - 1)))
    both = pairs.met(asking, members, blocks).select("turn", "no", "id", "vec", "code", "known").sortWithinPartitions("turn", "code")

    def table(held: pairs.Profile, ids: np.ndarray, own: np.ndarray, finite: np.ndarray) -> Iterator[pa.RecordBatch]:
        weights = 1.0 / np.arange(1, neighbours + 1)
        for start in range(0, len(ids), pairs.TILE_ROWS):
            at = np.arange(start, min(start + pairs.TILE_ROWS, len(ids)))
            n = np.where(finite[at, None], held.counts - (own[at, None] == np.arange(groups)), 0)
            penalty = np.zeros((len(at), groups))
            for j in range(neighbours):
                there = finite[at] & np.isfinite(held.nearest.d[at, j])
                np.add.at(penalty, (np.flatnonzero(there), held.nearest.tag[at[there], j].astype(np.int64)), weights[j])
            penalty[np.arange(len(at)), own[at]] = 0.0
            values = [np.repeat(ids[at], groups), np.repeat(own[at], groups), np.tile(np.arange(groups, dtype=np.int32), len(at)), n.ravel()]
            values += [np.where(n > 0, v[at], 0.0).ravel() for v in (held.total, held.near, held.far)] + [penalty.ravel()]
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in values], names=["id", "own", "code", "n", "total", "nearest", "farthest", "penalty"])

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, held, ids, own, finite = [], None, None, None, None
        for batch in batches:
            cut = int(np.searchsorted(batch.column("turn").to_numpy(), 1))
            if cut:
                waiting.append(batch.slice(0, cut))
            if cut == len(batch) or not waiting:
                continue
            if held is None:
                first = pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
                ids, own = first.column("id").to_numpy(zero_copy_only=False), first.column("code").to_numpy()
                finite = first.column("known").to_numpy(zero_copy_only=False)
                held = pairs.Profile(first.column("no").to_numpy(), pairs.matrix(first.column("vec")), groups, neighbours)
            for start in range(cut, len(batch), pairs.TILE_ROWS):
                some = batch.slice(start, pairs.TILE_ROWS)
                x = pairs.matrix(some.column("vec"))
                held.take(some.column("no").to_numpy(), some.column("id").to_numpy(), x, some.column("code").to_numpy())
        if held is not None:
            yield from table(held, ids, own, finite)

    schema = "id bigint, own int, code int, n bigint, total double, nearest double, farthest double, penalty double"
    raw = both.mapInArrow(profile, schema)
    own = names.select(F.col("code").alias("own"), F.col("label").alias("own_label"))
    named = raw.join(own, "own").join(names, "code")
    return named.select(
        "id", F.col("own_label").alias("own"), "label", "n", "total",
        F.when(F.col("n") > 0, F.col("nearest")).alias("nearest"),
        F.when(F.col("n") > 0, F.col("farthest")).alias("farthest"), "penalty",
    )


def silhouette_points(profile: DataFrame) -> DataFrame:
    """``id, label, neighbour, width`` of every point; a point alone in its cluster has width 0."""
    own = F.col("own") == F.col("label")
    mean = F.col("total") / F.col("n")
    per_point = profile.groupBy("id", "own").agg(
        F.max(F.when(own & (F.col("n") > 0), mean)).alias("a"),
        F.min(F.when(~own, F.struct(mean.alias("b"), F.col("label").alias("label")))).alias("other"),
    )
    a, b = F.col("a"), F.col("other.b")
    width = F.when(a.isNull(), 0.0).otherwise(F.coalesce((b - a) / F.nullif(F.greatest(a, b), F.lit(0.0)), F.lit(0.0)))
    return per_point.select("id", F.col("own").alias("label"), F.col("other.label").alias("neighbour"), width.alias("width"))


def silhouette_by_cluster(points: DataFrame) -> DataFrame:
    """``label, size, width`` from the widths of the points."""
    return points.groupBy("label").agg(
        F.count(F.lit(1)).alias("size"), F.avg("width").alias("width")
    )


def internal_indices(profile: DataFrame) -> DataFrame:
    """One row: ``connectivity, dunn, silhouette``."""
    own = F.col("own") == F.col("label")
    sums = profile.agg(
        F.sum("penalty").alias("connectivity"),
        (F.min(F.when(~own, F.col("nearest"))) / F.max(F.when(own, F.col("farthest")))).alias("dunn"),
    )
    mean = silhouette_points(profile).agg(F.avg("width").alias("silhouette"))
    return sums.select("connectivity", "dunn", mean.scalar().alias("silhouette"))


def parameter_grid(spark: SparkSession, methods: Sequence[str] = METHODS, ks: Sequence[int] = K_RANGE, replicates: int = 1) -> DataFrame:
    """``method, k, b``: every combination, by fanning out literal arrays."""
    base = spark.range(1).select(F.explode(F.array(*[F.lit(m) for m in methods])).alias("method"))
    base = base.select("method", F.explode(F.array(*[F.lit(k) for k in ks])).alias("k"))
    return base.select("method", "k", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("b"))


def _rng(seed: int, b: int) -> np.random.Generator:
    return np.random.default_rng([seed, b])


def cluster_grid(
    centres: DataFrame, id_col: str, vec_col: str, methods: Sequence[str] = METHODS, ks: Sequence[int] = K_RANGE,
    seed: int = 444, max_items: int = MAX_ITEMS,
) -> DataFrame:
    """``method, k, id, cluster`` of every configuration, one task each. A fit that fails gives no rows."""
    spark = centres.sparkSession
    ids, x = bounded_matrix(centres, id_col, vec_col, max_items)
    shared = spark.sparkContext.broadcast((np.array(ids), x))

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        all_ids, all_x = shared.value
        for batch in batches:
            for method, k in zip(batch["method"], batch["k"]):
                try:
                    labels = kernels.cluster_labels(method, all_x, int(k), _rng(seed, 0))
                except (ValueError, IndexError, np.linalg.LinAlgError):
                    continue
                yield pd.DataFrame({"method": method, "k": k, "id": all_ids, "cluster": labels + 1})

    grid = parameter_grid(spark, methods, ks).repartition(len(methods) * len(ks))
    return grid.select("method", "k").mapInPandas(fit, "method string, k int, id bigint, cluster int")


def bootstrap_overlaps(
    centres: DataFrame, id_col: str, vec_col: str, labels: DataFrame, methods: Sequence[str] = METHODS,
    ks: Sequence[int] = K_RANGE, replicates: int = 100, seed: int = 444, max_items: int = MAX_ITEMS,
) -> DataFrame:
    """Cluster resamples of the centres and count members shared with the original clusters.

    ``labels`` is ``cluster_grid`` output. Every (method, k, replicate) is a task of its own; replicate b
    draws the same points for all methods, each drawn point once. Rows: ``method, k, b, orig_cluster,
    boot_cluster, n_both, n_orig, n_boot`` over the drawn points.
    """
    spark = centres.sparkSession
    ids, x = bounded_matrix(centres, id_col, vec_col, max_items)
    place = {v: i for i, v in enumerate(ids)}
    original: dict[tuple[str, int], np.ndarray] = {}
    for r in labels.groupBy("method", "k").agg(F.collect_list(F.struct("id", "cluster")).alias("m")).toLocalIterator():
        lab = np.zeros(len(ids), dtype=int)
        for item in r["m"]:  # at most ``max_items`` centres
            lab[place[item["id"]]] = item["cluster"]
        original[(r["method"], r["k"])] = lab
    shared = spark.sparkContext.broadcast((x, original))

    def resample(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        all_x, known = shared.value
        for batch in batches:
            for method, k, b in zip(batch["method"], batch["k"], batch["b"]):
                first = known.get((method, int(k)))
                if first is None:
                    continue
                rng = _rng(seed, int(b))
                drawn = np.unique(rng.integers(len(all_x), size=len(all_x)))
                try:
                    again = kernels.cluster_labels(method, all_x[drawn], int(k), rng) + 1
                except (ValueError, IndexError, np.linalg.LinAlgError):
                    continue
                pair = pd.DataFrame({"orig_cluster": first[drawn], "boot_cluster": again})
                both = pair.value_counts().rename("n_both").reset_index()
                both["n_orig"] = both["orig_cluster"].map(pair["orig_cluster"].value_counts())
                both["n_boot"] = both["boot_cluster"].map(pair["boot_cluster"].value_counts())
                missing = sorted(set(first.tolist()) - set(pair["orig_cluster"]))
                lost = pd.DataFrame({"orig_cluster": missing, "boot_cluster": 0, "n_both": 0, "n_orig": 0, "n_boot": 1})
                yield pd.concat([both, lost]).assign(method=method, k=k, b=b)

    schema = "orig_cluster int, boot_cluster int, n_both bigint, n_orig bigint, n_boot bigint, method string, k int, b int"
    grid = parameter_grid(spark, methods, ks, replicates)
    tasks = min(len(methods) * len(ks) * replicates, max(4 * spark.sparkContext.defaultParallelism, 1))
    return grid.repartition(tasks).mapInPandas(resample, schema)


def jaccard(overlaps: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Best Jaccard similarity of each original cluster with any cluster of the other labelling."""
    similarity = F.col("n_both") / (F.col("n_orig") + F.col("n_boot") - F.col("n_both"))
    return overlaps.groupBy(*keys, "orig_cluster").agg(F.max(similarity).alias("jaccard"))


def overlap_counts(labels: DataFrame, first: str, second: str) -> DataFrame:
    """``orig_cluster, boot_cluster, n_both, n_orig, n_boot`` of two labellings of the same rows."""
    both = labels.groupBy(F.col(first).alias("orig_cluster"), F.col(second).alias("boot_cluster")).agg(
        F.count(F.lit(1)).alias("n_both")
    )
    left = both.groupBy("orig_cluster").agg(F.sum("n_both").alias("n_orig"))
    right = both.groupBy("boot_cluster").agg(F.sum("n_both").alias("n_boot"))
    return both.join(left, "orig_cluster").join(right, "boot_cluster")


def stability_by_cluster(overlaps: DataFrame) -> DataFrame:
    """``method, k, orig_cluster, jaccard, dissolved, recovered`` over the replicates."""
    best = jaccard(overlaps, ["method", "k", "b"])
    return best.groupBy("method", "k", "orig_cluster").agg(
        F.avg("jaccard").alias("jaccard"),
        F.count_if(F.col("jaccard") < 0.5).alias("dissolved"),
        F.count_if(F.col("jaccard") > 0.75).alias("recovered"),
    )


def stability_summary(by_cluster: DataFrame) -> DataFrame:
    """Per (method, k): least, mean and greatest cluster stability and the per-cluster counts as text."""
    def as_text(name: str):
        ordered = F.array_sort(F.collect_list(F.struct("orig_cluster", name)))
        return F.array_join(F.transform(ordered, lambda s: s[name].cast("string")), ", ").alias(name)

    return by_cluster.groupBy("method", "k").agg(
        F.min("jaccard").alias("jaccard_min"),
        F.avg("jaccard").alias("jaccard_mean"),
        F.max("jaccard").alias("jaccard_max"),
        as_text("dissolved"),
        as_text("recovered"),
    )


def _shared_profile(points: DataFrame, configs: Sequence[tuple]) -> tuple[DataFrame, list[dict]] | None:
    """``point_profile`` of the points by the clusters that they have in all configurations, and these clusters by its labels.

    One look at all pairs serves every configuration. It needs each point once in each of them, and few sets of clusters that
    occur together; otherwise there is none.
    """
    sets = points.groupBy("id").agg(
        F.count(F.lit(1)).alias("n"), F.first("vec").alias("vec"), F.array_sort(F.collect_list(F.struct("method", "k", "label"))).alias("set")
    )
    facts = points.agg(F.count(F.lit(1)), F.count("label")).first()
    known = cut_lineage(sets)
    whole = known.agg(F.count(F.lit(1)), F.count_if(F.size(F.array_distinct(F.transform("set", lambda s: F.struct(s["method"], s["k"])))) != len(configs))).first()
    found = known.select("set").distinct().limit(SHARED_SETS + 1).collect()
    if facts[0] != facts[1] or facts[0] != whole[0] * len(configs) or whole[1] or len(found) > SHARED_SETS:
        return None
    held = [{(c["method"], c["k"]): c["label"] for c in r["set"]} for r in found]
    codes = points.sparkSession.createDataFrame([(r["set"], i) for i, r in enumerate(found)], known.select("set").schema.add("label", IntegerType()))
    return cut_lineage(point_profile(known.join(F.broadcast(codes), "set").select("id", "vec", "label"))), held


def _spread_grid(centres: DataFrame, id_col: str, vec_col: str, labels: DataFrame) -> DataFrame:
    """``validation_grid`` for any number of rows. Rows of ``labels`` are the points; an id has one vector."""
    vectors = centres.groupBy(F.col(id_col).alias("id")).agg(F.first(vec_col).alias("vec"))
    points = cut_lineage(labels.join(vectors, "id").select("method", "k", "id", "vec", F.col("cluster").alias("label")))
    configs = sorted(map(tuple, points.select("method", "k").distinct().collect()))
    shared, out = _shared_profile(points, configs), None
    for method, k in configs:
        if shared:
            profile, held = shared
            names = sorted({h[(method, k)] for h in held})
            place = F.array(*[F.lit(names.index(h[(method, k)])) for h in held])
            own, label = (F.element_at(place, F.col(c) + 1) for c in ("own", "label"))
            per = profile.select("id", own.alias("own"), label.alias("label"), "n", "total", "nearest", "farthest", "penalty")
            profile = per.groupBy("id", "own", "label").agg(
                F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("nearest").alias("nearest"), F.max("farthest").alias("farthest"),
                F.sum(F.when(F.col("own") != F.col("label"), F.col("penalty")).otherwise(0.0)).alias("penalty"),
            )
        else:
            profile = cut_lineage(point_profile(points.where((F.col("method") == method) & (F.col("k") == k)).select("id", "vec", "label")))
        indices = internal_indices(profile).select(
            F.lit(method).alias("method"), F.lit(k).cast(points.schema["k"].dataType).alias("k"), "connectivity", "dunn", "silhouette"
        )
        out = indices if out is None else out.unionByName(indices)
    return out


def validation_grid(centres: DataFrame, id_col: str, vec_col: str, labels: DataFrame, max_items: int = MAX_ITEMS) -> DataFrame:
    """``method, k, connectivity, dunn, silhouette`` of every configuration in ``labels``.

    Up to ``max_items`` centres are broadcast and all configurations evaluated together; more are looked at
    by ``point_profile``, once for all configurations where these have the same points, else one after the other.
    """
    spark = centres.sparkSession
    if len(centres.select(id_col).take(max_items + 1)) > max_items:
        return _spread_grid(centres, id_col, vec_col, labels)
    ids, x = bounded_matrix(centres, id_col, vec_col, max_items)
    shared = spark.sparkContext.broadcast((np.array(ids), x))

    def partial(pdf: pd.DataFrame) -> pd.DataFrame:
        """Numbers of one block of points of one configuration, against all its points."""
        all_ids, all_x = shared.value
        pdf = pdf.sort_values("id")
        mine = pdf["mine"].to_numpy()
        lab = pdf["cluster"].to_numpy()
        x_all = all_x[np.searchsorted(all_ids, pdf["id"].to_numpy())]
        d = kernels.distances(x_all[mine], x_all)
        me = np.arange(len(d)), np.flatnonzero(mine)
        own = lab[mine][:, None] == lab[None, :]
        near = min(NEIGHBOURS, len(lab) - 1)
        d[me] = np.inf
        order = np.argsort(d, axis=1, kind="stable")[:, :near]
        penalty = ((lab[order] != lab[mine][:, None]) / np.arange(1, near + 1)).sum()
        between = np.where(own, np.inf, d).min()
        d[me] = 0.0
        within = np.where(own, d, 0.0).max()
        names, counts = np.unique(lab, return_counts=True)
        sums = np.stack([d[:, lab == v].sum(axis=1) for v in names], axis=1)
        home = np.searchsorted(names, lab[mine])
        n_own = counts[home] - 1
        a = sums[np.arange(len(d)), home] / np.maximum(n_own, 1)
        means = sums / counts[None, :]
        means[np.arange(len(d)), home] = np.inf
        b = means.min(axis=1)
        top = np.maximum(a, b)
        width = np.where((n_own > 0) & (top > 0), (b - a) / np.where(top > 0, top, 1.0), 0.0)
        return pd.DataFrame(
            {"method": pdf["method"].iloc[:1], "k": pdf["k"].iloc[:1], "penalty": penalty, "between": between,
             "within": within, "width": width.sum(), "n": len(d)}
        )

    blocks = max(1, min(8, -(-len(ids) // 512)))
    numbered = labels.withColumn("own_block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    copies = numbered.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    copies = copies.withColumn("mine", F.col("own_block") == F.col("block"))
    # A group is one configuration of the bounded centre table.
    used = copies.groupBy("method", "k", "block").applyInPandas(
        lambda pdf: partial(pdf) if pdf["mine"].any() else pd.DataFrame(),
        "method string, k int, penalty double, between double, within double, width double, n bigint",
    )
    return used.groupBy("method", "k").agg(
        F.sum("penalty").alias("connectivity"),
        (F.min("between") / F.max("within")).alias("dunn"),
        (F.sum("width") / F.sum("n")).alias("silhouette"),
    )


def summary_table(validation: DataFrame, stability: DataFrame, digits: int = 3) -> DataFrame:
    """Validation and stability by method and k, rounded and sorted."""
    numbers = ("connectivity", "dunn", "silhouette", "jaccard_min", "jaccard_mean", "jaccard_max")
    label = F.concat(F.upper(F.substring("method", 1, 1)), F.substr("method", F.lit(2)))
    joined = stability.join(validation, ["method", "k"], "left")
    return joined.select(
        label.alias("method"), "k", *[F.round(c, digits).alias(c) for c in numbers], "dissolved", "recovered"
    ).orderBy("method", "k")


def best_configuration(validation: DataFrame) -> DataFrame:
    """``measure, score, method, k``: lowest connectivity, highest Dunn index, highest silhouette."""
    wanted = {"connectivity": F.col("connectivity"), "dunn": -F.col("dunn"), "silhouette": -F.col("silhouette")}
    winners = [
        F.min_by(
            F.struct(F.lit(m).alias("measure"), F.col(m).alias("score"), "method", "k"), F.struct(order, "method", "k")
        )
        for m, order in wanted.items()
    ]
    return validation.agg(F.array(*winners).alias("r")).select(F.inline("r"))


def rescaled_metrics(table: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """``method, k, metric, value, scaled``: each metric scaled to 0..1 over all configurations."""
    tall = table.select("method", "k", *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(
        ["method", "k"], list(metrics), "metric", "value"
    )
    return min_max(tall, ["metric"])


def choose(table: DataFrame, keys: Mapping[str, object]) -> DataFrame:
    """Rows of one configuration."""
    out = table
    for name, value in keys.items():
        out = out.where(F.col(name) == value)
    return out
