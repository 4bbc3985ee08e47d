"""Neighbours and extreme distances against brute force, at sizes on both sides of every bound."""

import numpy as np
import pytest

from tamiz.operators import balls, kernels

SIZES = [{}, {"cell_rows": 7, "pivots": 5}, {"cell_rows": 3, "pivots": 1}]


def table(spark, x, labels):
    rows = [(i, [float(v) for v in r], None if l is None else int(l)) for i, (r, l) in enumerate(zip(x, labels))]
    return spark.createDataFrame(rows, "id bigint, vec array<double>, label int").repartition(4)


def sample(n=150, d=3, seed=0, copies=40):
    """Blobs, a third of the rows one and the same vector, and rows in a line."""
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(size=(n, d)) * 0.3 + rng.integers(-3, 4, size=(n, d)), np.tile(rng.normal(size=d), (copies, 1)), np.outer(np.arange(10), np.ones(d))])
    return x, rng.integers(0, 4, size=len(x))


def brute_near(x, k):
    d = kernels.distances(x, x)
    return [sorted((d[i, j], j) for j in range(len(x)) if j != i)[:k] for i in range(len(x))]


@pytest.mark.parametrize("sizes", SIZES)
def test_nearest_rows_match_brute_force(spark, sizes):
    x, labels = sample()
    got = balls.nearest_rows(table(spark, x, labels), "id", "vec", "label", 10, **sizes).orderBy("id", "rank").collect()
    want = brute_near(x, 10)
    assert len(got) == 10 * len(x)
    for r in got:
        d, j = want[r["id"]][r["rank"] - 1]
        assert r["other"] == j and r["d"] == pytest.approx(d) and r["other_label"] == labels[j]


def test_connectivity_matches_brute_force_and_few_rows(spark):
    x, labels = sample(seed=3)
    want = sum(1 / r for i, near in enumerate(brute_near(x, 10)) for r, (_, j) in enumerate(near, 1) if labels[i] != labels[j])
    for sizes in SIZES:
        got = balls.connectivity(table(spark, x, labels), "id", "vec", "label", **sizes).first()[0]
        assert got == pytest.approx(want)
    three = table(spark, x[:3], [1, None, 1])
    assert balls.connectivity(three, "id", "vec", "label").first()[0] == pytest.approx(
        sum(1 / r for i, near in enumerate(brute_near(x[:3], 10)) for r, (_, j) in enumerate(near, 1) if (i == 1) != (j == 1))
    )
    assert balls.connectivity(three.limit(0), "id", "vec", "label").first()[0] == 0
    assert balls.connectivity(three.limit(1), "id", "vec", "label").first()[0] == 0


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("sizes", [{}, {"cell_rows": 6, "fan_out": 3}])
def test_dunn_matches_brute_force(spark, sizes, seed):
    x, labels = sample(seed=seed)
    if seed == 2:
        x, labels = sample(60, seed=2, copies=0)
        labels = (x[:, 0] > 0).astype(int)
    d, same = kernels.distances(x, x), labels[:, None] == labels[None, :]
    got = balls.dunn(table(spark, x, labels), "id", "vec", "label", **sizes).first()
    assert got["diameter"] == pytest.approx(d[same].max()) and got["gap"] == pytest.approx(d[~same].min())


def test_dunn_without_pairs(spark):
    x = np.ones((5, 2))
    assert tuple(balls.dunn(table(spark, x, [1] * 5), "id", "vec", "label").first()) == (None, 0.0, None)
    assert tuple(balls.dunn(table(spark, x, [1, 1, 2, None, 2]), "id", "vec", "label").first()) == (0.0, 0.0, None)
    assert tuple(balls.dunn(table(spark, x, [None] * 5), "id", "vec", "label").first()) == (None, None, None)


def test_a_ball_of_near_copies_comes_apart(spark):
    x = np.concatenate([np.zeros((200, 2)), np.array([[1e-3, 0.0], [5.0, 5.0]])])
    labels = [1] * 201 + [2]
    got = balls.dunn(table(spark, x, labels), "id", "vec", "label", cell_rows=4, fan_out=2).first()
    assert got["diameter"] == pytest.approx(1e-3) and got["gap"] == pytest.approx(np.hypot(5 - 1e-3, 5))


def test_rows_pass_a_block_once_and_far_balls_not_at_all():
    centres = np.array([[0.0], [1.0], [100.0]])
    known = [{"ball": b, "n": 40, "cells": 2, "radius": 1.0} for b in range(3)]
    cells, passed = balls._blocks_of(known, {0: 0.5, 1: 0.5, 2: 0.5}, kernels.distances(centres, centres), 3)
    assert [c[2] for c in cells] == [0, 0, 1, 1, 2, 2] and passed == [(0, [0, 1]), (1, [0, 1]), (2, [2])]
    assert dict(balls._blocks_of(known, dict.fromkeys(range(3), np.inf), kernels.distances(centres, centres), 3)[1]) == dict.fromkeys(range(3), [0, 1, 2])


def test_nearest_rows_without_structure_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr("tamiz.operators.pairs.HELD_ROWS", 64)
    monkeypatch.setattr("tamiz.operators.pairs.TILE_ROWS", 16)
    x = np.random.default_rng(6).normal(size=(300, 24)) + 50.0
    x[200:220] = x[3]
    got = balls.nearest_rows(table(spark, x, np.arange(300) % 3), "id", "vec", "label", 5, pivots=7, cell_rows=20).orderBy("id", "rank").collect()
    want = brute_near(x, 5)
    assert len(got) == 1500 and all(r["other"] == want[r["id"]][r["rank"] - 1][1] for r in got)


@pytest.mark.parametrize("widest", [True, False])
def test_extreme_of_two_sets_by_product_is_that_by_differences(widest):
    rng = np.random.default_rng(8)
    a, b = rng.normal(size=(700, 5)) + 1e5, rng.normal(size=(900, 5)) + 1e5
    d = kernels.distances(a, b)
    assert balls._extreme_of(a, b, widest) == pytest.approx(d.max() if widest else d.min(), rel=1e-12)
    assert widest or balls._extreme_of(a, np.vstack([b, a[:3]]), widest) == 0.0
