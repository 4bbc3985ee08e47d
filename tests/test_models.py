"""Transforms, components, clusterings and indices against brute force."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tamiz.operators import balls, cluster, kernels, reduce, transform, validate
from tests.conftest import rows


def points_of(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id bigint, vec array<double>")


def blobs(n=60, k=3, d=2, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(scale=8, size=(k, d))
    return np.concatenate([c + rng.normal(size=(n // k, d)) for c in centres])


def naive_ward(x):
    """Merge heights one pair at a time."""
    groups = [([i], x[i]) for i in range(len(x))]
    heights = []
    while len(groups) > 1:
        def cost(p):
            (a, ca), (b, cb) = groups[p[0]], groups[p[1]]
            return 2 * len(a) * len(b) / (len(a) + len(b)) * ((ca - cb) ** 2).sum()

        i, j = min(itertools.combinations(range(len(groups)), 2), key=cost)
        heights.append(cost((i, j)))
        (a, ca), (b, cb) = groups[i], groups[j]
        groups = [g for n, g in enumerate(groups) if n not in (i, j)] + [(a + b, (len(a) * ca + len(b) * cb) / len(a + b))]
    return heights


def test_ward_heights_match_one_at_a_time(spark, monkeypatch):
    x = blobs(48)
    expected = sorted(naive_ward(x))
    assert np.allclose(sorted(h for h, _, _ in kernels.ward_merges(x, np.ones(len(x)))), expected)
    monkeypatch.setattr(cluster, "WARD_TAIL", 4)
    assert np.allclose(sorted(h for h, _, _ in cluster.ward_tree(spark, x)), expected)


def test_ward_cut_finds_the_groups(spark, monkeypatch):
    monkeypatch.setattr(cluster, "WARD_TAIL", 8)
    labels = [r[1] for r in rows(cluster.ward(points_of(spark, blobs()), "id", "vec", 3), "id")]
    assert labels == [1] * 20 + [2] * 20 + [3] * 20


def test_pairwise_work_refuses_large_tables(spark):
    with pytest.raises(ValueError):
        cluster.ward(points_of(spark, blobs()), "id", "vec", 3, max_items=10)


def test_pam_is_no_worse_than_any_single_swap(spark):
    x = blobs(30, seed=3)
    labels, medoids = cluster.pam(points_of(spark, x), "id", "vec", 3)
    d = kernels.distances(x, x)
    cost = d[:, medoids].min(axis=1).sum()
    for i, c in itertools.product(range(3), range(len(x))):
        other = [c if j == i else m for j, m in enumerate(medoids)]
        assert d[:, other].min(axis=1).sum() >= cost - 1e-9
    assert sorted(medoids) == sorted(kernels.pam_medoids(d, 3))
    assert labels.select("cluster").distinct().count() == 3


def test_clara_labels_every_row(spark):
    x = blobs(300, seed=2)
    labels, medoids = cluster.clara(points_of(spark, x), "id", "vec", 3)
    got = rows(labels, "id")
    assert len(got) == 300 and len(medoids) == 3
    nearest = kernels.distances(x, np.array(medoids)).argmin(axis=1) + 1
    assert [r[1] for r in got] == nearest.tolist()
    assert [len({r[1] for r in got[i : i + 100]}) for i in (0, 100, 200)] == [1, 1, 1]


def test_micro_cluster_keeps_every_row(spark):
    x = blobs(90, seed=5)
    pts = points_of(spark, x).withColumnRenamed("vec", "scores")
    centres, assigned = cluster.micro_cluster(pts, "id", k=10, starts=2)
    assert centres.agg(F.sum("size")).first()[0] == 90 == assigned.count()
    small, own = cluster.micro_cluster(pts, "id", k=200, starts=1)
    assert small.count() == 90 == own.select("center_id").distinct().count()


def naive_indices(x, lab):
    d = kernels.distances(x, x)
    n = len(x)
    same = lab[:, None] == lab[None, :]
    off = ~np.eye(n, dtype=bool)
    con = 0.0
    for i in range(n):
        order = [j for j in np.argsort(d[i], kind="stable") if j != i][:10]
        con += sum(1 / (r + 1) for r, j in enumerate(order) if lab[j] != lab[i])
    dunn = d[~same].min() / d[same].max()
    widths = []
    for i in range(n):
        own = same[i] & off[i]
        if not own.any():
            widths.append(0.0)
            continue
        a = d[i][own].mean()
        b = min(d[i][lab == v].mean() for v in set(lab) if v != lab[i])
        widths.append((b - a) / max(a, b))
    return con, dunn, widths


def test_indices_match_brute_force(spark):
    x = blobs(45, seed=7)
    lab = np.arange(45) % 3 + 1
    lab[0] = 9  # a cluster of one
    df = points_of(spark, x).join(spark.createDataFrame([(i, int(v)) for i, v in enumerate(lab)], "id bigint, label int"), "id")
    con, dunn, widths = naive_indices(x, lab)
    profile = validate.point_profile(df)
    assert tuple(validate.internal_indices(profile).first()) == pytest.approx((con, dunn, np.mean(widths)))
    got = [r["width"] for r in validate.silhouette_points(profile).orderBy("id").collect()]
    assert got == pytest.approx(widths)
    labels = df.select(F.lit("m").alias("method"), F.lit(4).alias("k"), "id", F.col("label").alias("cluster"))
    grid = validate.validation_grid(df, "id", "vec", labels).first()
    assert (grid["connectivity"], grid["dunn"], grid["silhouette"]) == pytest.approx((con, dunn, np.mean(widths)))


def test_row_scale_indices_agree_with_the_bounded_ones(spark):
    x = blobs(120, seed=9)
    df = points_of(spark, x).withColumn("label", (F.col("id") % 2).cast("int"))
    bounded = validate.internal_indices(validate.point_profile(df)).first()
    for rows_a_cell in (8, 1000):
        assert balls.connectivity(df, "id", "vec", "label", cell_rows=rows_a_cell).first()[0] == pytest.approx(bounded["connectivity"])
        assert balls.dunn(df, "id", "vec", "label", cell_rows=rows_a_cell).first()["dunn"] == pytest.approx(bounded["dunn"])
    with pytest.raises(ValueError):
        validate.point_profile(df, max_items=40)


def test_squared_silhouette_matches_brute_force(spark):
    x = blobs(45, seed=7) + 1e6
    lab = np.arange(45) % 3 + 1
    lab[0] = 9  # a cluster of one
    d = kernels.distances(x, x) ** 2
    want = []
    for i in range(45):
        own = (lab == lab[i]) & (np.arange(45) != i)
        means = {v: d[i][lab == v].mean() for v in set(lab.tolist()) if v != lab[i]}
        other = min(means, key=lambda v: (means[v], v))
        a = d[i][own].mean() if own.any() else None
        want.append((i, lab[i], other, 0.0 if a is None else (means[other] - a) / max(a, means[other])))
    df = spark.createDataFrame([(i, r.tolist(), int(v)) for i, (r, v) in enumerate(zip(x, lab))], "id bigint, vec array<double>, label int")
    got = rows(validate.silhouette_squared(df.unionByName(df.limit(1).withColumn("label", F.lit(None).cast("int"))), "id", "vec", "label"), "id")
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert [g[3] for g in got] == pytest.approx([w[3] for w in want])
    alone = rows(validate.silhouette_squared(df.where("label = 1"), "id", "vec", "label"))
    assert {g[2:] for g in alone} == {(None, 0.0)}


def test_bootstrap_is_stable_for_clear_groups(spark):
    x = blobs(60, seed=1)
    pts = points_of(spark, x)
    labels = validate.cluster_grid(pts, "id", "vec", ks=(3,))
    assert labels.groupBy("method").count().count() == 4
    overlaps = validate.bootstrap_overlaps(pts, "id", "vec", labels, ks=(3,), replicates=5)
    out = validate.stability_summary(validate.stability_by_cluster(overlaps)).collect()
    assert {r["method"] for r in out} == set(validate.METHODS)
    ward = next(r for r in out if r["method"] == "hierarchical")
    assert ward["jaccard_min"] == 1.0 and ward["dissolved"] == "0, 0, 0" and ward["recovered"] == "5, 5, 5"
    again = validate.bootstrap_overlaps(pts, "id", "vec", labels, ks=(3,), replicates=5)
    key = ["method", "b", "orig_cluster", "boot_cluster"]
    assert rows(overlaps, *key) == rows(again, *key)
    assert all(0 <= r["jaccard"] <= 1 for r in validate.jaccard(overlaps, ["method", "b"]).collect())


def test_parameter_grid(spark):
    assert validate.parameter_grid(spark, replicates=3).count() == 4 * 5 * 3


def loglik(x, lam):
    y = np.log(x) if lam == 0 else (x**lam - 1) / lam
    return -len(x) / 2 * np.log(y.var()) + (lam - 1) * np.log(x).sum()


def test_boxcox_exponent_is_the_maximum(spark):
    rng = np.random.default_rng(4)
    x = rng.gamma(3, 50, 500)
    df = spark.createDataFrame([(float(v), float(v) - 400, 7.0) for v in x], "a double, neg double, flat double")
    fit = {r["variable"]: r for r in transform.boxcox_fit(df, ["a", "neg", "flat"]).collect()}
    grid = np.arange(-1, 1, 0.001)
    best = grid[np.argmax([loglik(x, g) for g in grid])]
    assert fit["a"]["lambda_mle"] == pytest.approx(best, abs=2e-3)
    assert fit["a"]["shift"] == 0.0 and fit["flat"]["lambda"] is None
    low = (x - 400).min()
    assert fit["neg"]["shift"] == pytest.approx(abs(low) + 1)
    out = transform.boxcox_apply(df, transform.boxcox_fit(df, ["a", "flat"]))
    lam = fit["a"]["lambda"]
    expected = np.log(x) if lam == 0 else (x**lam - 1) / lam
    assert [r["a"] for r in out.collect()] == pytest.approx(expected.tolist())
    assert out.select("flat").distinct().collect()[0][0] == 7.0


def test_missing_values_stay_missing(spark):
    df = spark.createDataFrame([(1.0,), (None,), (9.0,)], "a double")
    fitted = spark.createDataFrame([("a", 0.0, 0.5, 0.5)], "variable string, shift double, lambda_mle double, lambda double")
    assert sorted(rows(transform.boxcox_apply(df, fitted)), key=repr) == [(0.0,), (4.0,), (None,)]
    assert transform.likelihood_grid(df, ["a"], [0.5]).first()["loglik"] == pytest.approx(-np.log(4.0) + -0.5 * np.log(9.0))


def test_conventional_exponent_inside_the_interval(spark):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(float(v),) for v in rng.lognormal(2, 1, 400)], "a double")
    assert transform.boxcox_fit(df, ["a"]).first()["lambda"] == 0.0


def loglik(x, lam):
    logs = np.log(x) - np.log(x).mean()
    y = logs if lam == 0 else np.expm1(lam * logs) / lam
    return -len(x) / 2 * np.log(y.var())


@pytest.mark.parametrize("seed", range(4))
def test_exponents_of_any_size_are_maxima(spark, seed):
    rng = np.random.default_rng(seed)
    columns = {
        "two": np.array([1.0] * 500 + [2.0]), "narrow": 1000 + rng.gamma(2.0, 1.0, 501), "wide": rng.lognormal(2, 3, 501),
        "steep": rng.lognormal(0, 0.01, 501) ** -3 + 5, "square": rng.normal(10, 1, 501) ** 0.5, "huge": rng.lognormal(300, 1, 501),
    }
    df = spark.createDataFrame([tuple(float(v) for v in r) for r in zip(*columns.values())], ", ".join(f"{c} double" for c in columns))
    for r in transform.boxcox_fit(df, list(columns)).collect():
        x, lam = columns[r["variable"]], r["lambda_mle"]
        step = 1e-3 * max(1.0, abs(lam))
        best = loglik(x, lam)
        assert best >= max(loglik(x, lam - step), loglik(x, lam + step)), r
        assert best >= max(loglik(x, v) for v in np.linspace(-6, 6, 49)) - 1e-6, r
    two = transform.boxcox_fit(df, ["two"]).first()
    assert two["lambda_mle"] < -100  # far beyond any grid
    assert np.isfinite(transform.boxcox_apply(df, transform.boxcox_fit(df, ["huge", "two"])).agg(F.var_pop("huge"), F.var_pop("two")).first()).all()



def test_components_match_eigh(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(80, 4)) @ rng.normal(size=(4, 4))
    x[3, 1] = np.nan
    df = spark.createDataFrame(
        [(i, *[None if np.isnan(v) else float(v) for v in r], 1.0) for i, r in enumerate(x)],
        "id int, a double, b double, c double, d double, flat double",
    )
    fit = reduce.pca_fit(df, ["a", "b", "c", "d", "flat"], 2)
    assert fit.columns == ("a", "b", "c", "d")
    filled = np.where(np.isnan(x), np.nanmean(x, axis=0), x)
    z = (filled - filled.mean(axis=0)) / filled.std(axis=0)
    values, vectors = np.linalg.eigh(z.T @ z / len(z))
    assert fit.eigenvalues == pytest.approx(values[::-1].tolist())
    scores = np.array([r["scores"] for r in reduce.pca_scores(df, fit, ["id"]).orderBy("id").collect()])
    expected = z @ vectors[:, ::-1][:, :2]
    assert np.allclose(np.abs(scores), np.abs(expected))
    assert (fit.loadings[np.abs(fit.loadings).argmax(axis=0), [0, 1]] > 0).all()
    table = reduce.eigen_table(spark, fit)
    assert table.agg(F.sum("eigenvalue")).first()[0] == pytest.approx(4)
    quality = reduce.variable_quality(spark, fit)
    assert quality.agg(F.max("cos2")).first()[0] <= 1 + 1e-9


def test_levels_follow_the_mean(spark):
    df = spark.createDataFrame([("a", 7, 9.0), ("b", 7, 8.0), ("c", 3, 1.0)], "d string, cluster int, rate double")
    out = cluster.ordinal_levels(df, "cluster", "rate").select("d", "level", "nivel_jurisdiccion")
    assert rows(out, "d") == [("a", 2, "Bajo"), ("b", 2, "Bajo"), ("c", 1, "Muy Bajo")]


def test_best_configuration(spark):
    df = spark.createDataFrame(
        [("kmeans", 2, 5.0, 0.1, 0.3), ("pam", 3, 9.0, 0.4, 0.2)], "method string, k int, connectivity double, dunn double, silhouette double"
    )
    assert rows(validate.best_configuration(df).select("measure", "method", "k"), "measure") == [
        ("connectivity", "kmeans", 2), ("dunn", "pam", 3), ("silhouette", "kmeans", 2)]


def test_profile_and_grid_of_more_rows_than_a_task_holds(spark, monkeypatch):
    monkeypatch.setattr("tamiz.operators.pairs.HELD_ROWS", 16)
    monkeypatch.setattr("tamiz.operators.pairs.TILE_ROWS", 8)
    x = np.concatenate([blobs(60, seed=3) + 1e3, np.tile([1e3, 1e3], (12, 1))])
    lab = np.arange(72) % 3 + 1
    lab[0] = 9  # a cluster of one
    df = spark.createDataFrame([(i, r.tolist(), int(v)) for i, (r, v) in enumerate(zip(x, lab))], "id bigint, vec array<double>, label int")
    con, dunn, widths = naive_indices(x, lab)
    d = kernels.distances(x, x)
    profile = validate.point_profile(df).collect()
    assert len(profile) == 72 * 4
    for r in profile:
        there = (lab == r["label"]) & (np.arange(72) != r["id"])
        assert r["own"] == lab[r["id"]] and r["n"] == there.sum()
        assert r["total"] == pytest.approx(d[r["id"]][there].sum())
        assert r["nearest"] == (pytest.approx(d[r["id"]][there].min()) if there.any() else None)
        assert r["farthest"] == (pytest.approx(d[r["id"]][there].max()) if there.any() else None)
    labels = df.select("id", F.explode(F.array(*[F.struct(F.lit(m).alias("method"), F.lit(4).alias("k"), c.alias("cluster")) for m, c in
                       (("given", F.col("label")), ("odd", F.col("label") % 2))])).alias("o")).select("o.method", "o.k", "id", "o.cluster")
    for most in (10, 100):  # refused above ``max_items`` before
        grid = validate.validation_grid(df, "id", "vec", labels, max_items=most).orderBy("method").collect()
        assert tuple(grid[0])[2:] == pytest.approx((con, dunn, np.mean(widths)))
        con_odd, dunn_odd, widths_odd = naive_indices(x, lab % 2)
        assert tuple(grid[1])[2:] == pytest.approx((con_odd, dunn_odd, np.mean(widths_odd)))


def test_profile_takes_more_rows_than_the_bound_of_centres(spark):
    rng = np.random.default_rng(1)
    near = rng.normal(size=(validate.MAX_ITEMS + 1, 2))
    df = spark.createDataFrame([(i, r.tolist(), i % 2) for i, r in enumerate(near)], "id bigint, vec array<double>, label int")
    got = validate.point_profile(df).where("id = 17 AND label = 0").first()
    assert got["n"] == 5001 and got["total"] == pytest.approx(kernels.distances(near[17:18], near[::2]).sum())


def test_configurations_of_the_same_points_share_one_look_at_all_pairs(spark, monkeypatch):
    x = blobs()
    df = spark.createDataFrame([(i, v.tolist(), i % 6) for i, v in enumerate(x)], "id bigint, vec array<double>, label int")
    given = [("given", F.col("label")), ("odd", F.col("label") % 2), ("thirds", F.col("label") % 3)]
    labels = df.select("id", F.explode(F.array(*[F.struct(F.lit(m).alias("method"), F.lit(4).alias("k"), c.alias("cluster")) for m, c in given])).alias("o"))
    labels = labels.select("o.method", "o.k", "id", "o.cluster")
    passes, profile = [], validate.point_profile
    monkeypatch.setattr(validate, "point_profile", lambda *a: passes.append(1) or profile(*a))
    grid = validate.validation_grid(df, "id", "vec", labels, max_items=10).orderBy("method").collect()
    assert len(passes) == 1
    for r, mod in zip(grid, (6, 2, 3)):
        con, dunn, widths = naive_indices(x, np.arange(len(x)) % mod)
        assert tuple(r)[2:] == pytest.approx((con, dunn, np.mean(widths)))
    fewer = labels.where("method != 'odd' OR id > 0")  # points differ: one after the other
    grid = validate.validation_grid(df, "id", "vec", fewer, max_items=10).orderBy("method").collect()
    con, dunn, widths = naive_indices(x[1:], np.arange(1, len(x)) % 2)
    assert len(passes) == 4 and tuple(grid[1])[2:] == pytest.approx((con, dunn, np.mean(widths)))


def test_grid_results_send_levels_and_not_customers_to_the_driver(spark, tmp_path, monkeypatch):
    from tamiz.catalog import models

    people = [(i, i % 25, f"S{i % 5}", float(i % 97)) for i in range(500)]
    spark.createDataFrame(people, "c_custkey bigint, c_nationkey int, c_mktsegment string, c_acctbal double").write.parquet(str(tmp_path / "customer.parquet"))
    monkeypatch.setattr(models.grid, "grid_results", lambda spark, evaluate, *_: evaluate("by_key", 2))
    plan = models.grid_results(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "rightHint=(strategy=broadcast)" in plan


def test_clara_works_out_its_rows_once(spark):
    x, seen = blobs(), spark.sparkContext.accumulator(0)

    @F.udf("array<double>")
    def counted(v):
        seen.add(1)
        return v

    points = points_of(spark, x).select("id", counted("vec").alias("vec"))
    assert cluster.clara(points, "id", "vec", 3)[0].count() == len(x) == seen.value
