"""k-means against its own conditions, and under different partitionings."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from tamiz.operators import cluster, lloyd
from tests.conftest import rows
from tests.test_models import blobs


def table(spark, x, parts):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id bigint, vec array<double>").repartition(parts)


@pytest.mark.parametrize("k, starts", [(3, 1), (12, 4)])
def test_partitions_do_not_matter(spark, k, starts):
    x = np.concatenate([blobs(150, 5, 3, seed=4), np.tile([1.0, 2.0, 3.0], (60, 1))])
    runs = [rows(cluster.kmeans(table(spark, x, p), "id", "vec", k, starts=starts), "id") for p in (1, 40)]
    assert runs[0] == runs[1]
    label = np.array([r[1] for r in runs[0]])
    assert set(label) == set(range(1, k + 1))
    means = np.array([x[label == c].mean(axis=0) for c in range(1, k + 1)])
    d = ((x[:, None] - means[None]) ** 2).sum(axis=2)
    assert (d[np.arange(len(x)), label - 1] <= d.min(axis=1) + 1e-6).all()


def test_more_starts_are_no_worse_and_clear_groups_are_found(spark):
    x = blobs(120, 4, 2, seed=8)
    grid = lloyd.on_grid(table(spark, x, 4), "id", "vec")
    cost = [lloyd._totals(grid, {0: lloyd.fit(grid, 4, starts=n)})[0][2] for n in (1, 6)]
    assert cost[1] <= cost[0]
    label = [r[1] for r in rows(cluster.kmeans(table(spark, x, 4), "id", "vec", 4, starts=6), "id")]
    assert [len(set(label[i : i + 30])) for i in range(0, 120, 30)] == [1] * 4


def test_few_different_rows_are_their_own_centres(spark):
    x = np.repeat(np.arange(5.0), 4)[:, None] * [1.0, -1.0]
    centres, assigned = cluster.micro_cluster(table(spark, x, 3).withColumnRenamed("vec", "scores"), "id", k=9, starts=3)
    assert sorted((r["center"][0], r["size"]) for r in centres.collect()) == [(float(i), 4) for i in range(5)]
    assert assigned.count() == 20
    none = cluster.micro_cluster(table(spark, x, 3).withColumnRenamed("vec", "scores").limit(0), "id", k=9, starts=3)
    assert none[0].count() == 0 == none[1].count()


def test_nearest_is_alike_for_any_batch():
    rng = np.random.default_rng(2)
    x, c = rng.normal(size=(300, 7)), rng.normal(size=(40, 7))
    c[3] = c[20] + 1e-13
    x[:50] = (c[3] + c[9]) / 2
    at, d = lloyd.nearest(x, c)
    single = [lloyd.nearest(x[i : i + 1], c) for i in range(300)]
    assert at.tolist() == [int(a[0]) for a, _ in single] and d.tolist() == [float(v[0]) for _, v in single]
    assert d == pytest.approx(((x[:, None] - c[None]) ** 2).sum(axis=2).min(axis=1))


def test_nearest_of_many_centres_needs_no_table_of_all_distances():
    rng = np.random.default_rng(5)
    x, c = rng.normal(size=(4096, 4)) + 1e4, rng.normal(size=(1500, 4)) + 1e4
    tracemalloc.start()
    at, d = lloyd.nearest(x, c)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30e6 and d == pytest.approx(((x - c[at]) ** 2).sum(axis=1))
    assert all(((x[i] - c) ** 2).sum(axis=1).min() == pytest.approx(d[i]) for i in range(0, 4096, 64))


def test_only_moved_centres_come_back_and_sums_are_whole(spark):
    x = np.array([[1.0, 1.0], [1.0, 1.0], [9.0, 5.0], [9.0, 7.0], [2.0**40, 0.0]])
    grid = lloyd.on_grid(table(spark, x, 3), "id", "vec")
    centres = np.array([[1.0, 1.0], [8.0, 6.0], [2.0**40, 0.0]])
    near = np.round(x * grid.scale) / grid.scale
    moved, cost = lloyd._moved(grid, {0: centres})[0]
    counts, means, same = lloyd._totals(grid, {0: centres})[0]
    where = lloyd.nearest(near, centres)[0]
    assert counts.tolist() == np.bincount(where, minlength=3).tolist() and cost == same
    for i in range(3):
        assert moved[i].tolist() == (means[i] if counts[i] else centres[i]).tolist()


def test_a_missing_component_does_not_stop_the_fit(spark):
    x = [(i, [float(i % 7), None if i % 50 == 3 else float(i % 3)]) for i in range(200)]
    points = spark.createDataFrame(x, "id bigint, vec array<double>").repartition(3)
    label = rows(cluster.kmeans(points, "id", "vec", 3, starts=2), "id")
    assert len(label) == 200 and {r[1] for r in label} <= {1, 2, 3}


def test_groups_of_rows_look_at_few_centres_and_find_the_same(monkeypatch):
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(size=(3000, 3)) ** 3, np.tile([0.5, 0.25, 0.125], (500, 1)), [[1e9, 0.0, 0.0]]])
    c = np.concatenate([x[rng.choice(3000, 900, replace=False)], [[0.5, 0.25, 0.0], [0.5, 0.25, 0.25], [-1e12, 0.0, 0.0]]])
    seen, here = [], lloyd._nearest_here
    monkeypatch.setattr(lloyd, "_nearest_here", lambda x, c, m: seen.append(len(x) * len(c)) or here(x, c, m))
    at, d = lloyd.nearest(x, c)
    apart = ((x[:, None] - c[None]) ** 2).sum(axis=2)
    assert at.tolist() == apart.argmin(axis=1).tolist() and d.tolist() == apart.min(axis=1).tolist()
    near = rng.normal(size=(4096, 2))
    seen.clear()
    assert lloyd.nearest(near, near[:900])[0][:900].tolist() == list(range(900))
    assert 0 < sum(seen) < 4096 * 900 / 5


def test_reduced_draws_as_with_all_distances(spark):
    rng = np.random.default_rng(3)
    x, w = rng.normal(size=(700, 9)) * 10.0 ** rng.integers(-3, 3, 9), rng.integers(0, 5, 700).astype(float)
    gen = np.random.default_rng(1)
    chosen = [int(np.searchsorted(np.cumsum(w), gen.random() * w.sum()))]
    for _ in range(59):
        load = np.cumsum(w * ((x[:, None] - x[chosen][None]) ** 2).sum(axis=2).min(axis=1))
        chosen.append(min(int(np.searchsorted(load, gen.random() * load[-1], side="right")), 699))
    assert lloyd._reduced(x, w, 60, np.random.default_rng(1)).tolist() == x[chosen].tolist()
    grid = lloyd.Grid(spark.range(1), 1.0, 9)
    found = lloyd._reduced_starts(grid, {0: x, 1: x[:40]}, {0: w, 1: w[:40]}, 60, 7)
    assert found[1].tolist() == np.unique(x[:40], axis=0).tolist()
    assert found[0].tolist() == np.unique(lloyd._reduced(x, w, 60, np.random.default_rng([7, 0])), axis=0).tolist()


def test_a_round_of_seeding_looks_at_its_new_candidates_only(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.integers(0, 40, size=(600, 2)).astype(float), np.tile([3.0, 4.0], (50, 1))])
    grid = lloyd.on_grid(table(spark, x, 5), "id", "vec")
    first, more = x[:1], lloyd._ordered(x[rng.choice(600, 60, replace=False)])
    more = {0: more[~(more == first).all(axis=1)], 1: x[:0]}
    rounds = [{0: first, 1: first}, {s: c[::2] for s, c in more.items()}, {s: c[1::2] for s, c in more.items()}]
    known, state = {0: x[:0], 1: x[:0]}, grid.rows
    for fresh in rounds:
        state = lloyd._joined(grid, state, known, fresh)
        known = {s: np.vstack([known[s], fresh[s]]) for s in known}
    found = state.toPandas().sort_values("id")
    whole = lloyd._ordered(known[0])
    at, d = lloyd.nearest(x, whole)
    places, apart = np.stack([np.frombuffer(v, np.int32) for v in found["at"]]), np.stack([np.frombuffer(v) for v in found["d"]])
    assert known[0][places[:, 0]].tolist() == whole[at].tolist()  # ties too
    assert apart[:, 0].tolist() == d.tolist() and set(places[:, 1]) == {0}
    counts = lloyd._weights(state, known)
    assert counts[0].tolist() == np.bincount(places[:, 0], minlength=len(known[0])).tolist() and counts[1].tolist() == [650]
    assert lloyd._spent(grid, state, 2)[0] == lloyd._totals(grid, {0: whole})[0][2]
    sizes, fitted = [], lloyd._joined
    monkeypatch.setattr(lloyd, "_joined", lambda g, r, t, f: sizes.append((len(t[0]), len(f[0]))) or fitted(g, r, t, f))
    centres = lloyd.seeded(grid, 9, 2, 444)
    assert all(len(c) == 9 for c in centres.values())
    assert len(sizes) == lloyd.SEED_ROUNDS + 1 and all(b[0] == a[0] + a[1] for a, b in zip(sizes, sizes[1:]))


def test_keys_become_names_as_by_the_formatter(spark):
    from tamiz.catalog.standin import _customer_name

    keys = spark.createDataFrame([(v,) for v in (0, 7, 999_999_999, 1_000_000_000, 2**62, -3, None)], "k bigint")
    found = keys.select(_customer_name(F.col("k")), F.format_string("customer#%09d", "k")).collect()
    assert all(a == b for a, b in found)


def test_rounds_with_bounds_find_the_same_and_look_at_few_rows(spark):
    rng = np.random.default_rng(12)
    x = np.concatenate([rng.normal(size=(2500, 6)), np.tile([0.5] * 6, (40, 1)), rng.normal(size=(3, 6)) * 1e5])
    grid = lloyd.on_grid(table(spark, x, 5), "id", "vec")
    centres = {s: lloyd._ordered(x[rng.choice(2500, 200, replace=False)]) for s in (0, 2)}
    rows, before, loads = grid.rows, {}, {s: lloyd._Load.none(200, 6) for s in centres}
    for turn in range(4):
        rows, before = lloyd._placed(grid, rows, centres, before), centres
        lloyd._changes(grid, rows, centres, loads)
        for s, (means, cost) in lloyd._moved(grid, centres).items():  # all rows looked at all centres
            assert lloyd._at_means(grid, centres[s], loads[s]).tolist() == means.tolist() and loads[s].cost / grid.scale == cost
            centres = centres | {s: means}
        if turn == 1:
            centres.pop(0)  # a start that ended is no longer looked at
    y = np.round(x * grid.scale) / grid.scale
    behind = np.zeros(len(y))
    at, d = lloyd.nearest(y, centres[2], None, behind)
    apart = np.sqrt(((y[:, None] - centres[2][None]) ** 2).sum(axis=2))
    apart[np.arange(len(y)), at] = np.inf
    assert (behind <= apart.min(axis=1) * (1 + 1e-9)).all() and (behind > np.sqrt(d) * (1 + 1e-4)).mean() > 0.9
    moves = np.full(200, 1e-4) * (np.arange(200) >= 100)
    moves[7] = 3.0
    step = rng.normal(size=(200, 6))
    new = centres[2] + step * (moves / np.sqrt((step**2).sum(axis=1)))[:, None]
    still, left = lloyd._still_nearest(y, new, moves, at, behind)
    apart = np.sqrt(((y[:, None] - new[None]) ** 2).sum(axis=2))
    assert (apart.argmin(axis=1) == at)[still].all() and still.mean() > 0.8
    apart[np.arange(len(y)), at] = np.inf
    assert (left <= apart.min(axis=1) * (1 + 1e-9))[still].all()


@pytest.mark.parametrize("width", [2, 7])
def test_fits_with_and_without_bounds_are_alike(spark, monkeypatch, width):
    x = np.random.default_rng(width).normal(size=(1500, width)) ** 3
    grid = lloyd.on_grid(table(spark, np.concatenate([x, x[:50]]), 4), "id", "vec")
    found = [lloyd.fit(grid, 150, 3, max_iter=25)]
    monkeypatch.setattr(lloyd, "MANY_CENTRES", 10_000)
    assert lloyd.fit(grid, 150, 3, max_iter=25).tolist() == found[0].tolist()
