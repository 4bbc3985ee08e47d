"""MaxScore search, collocations and whitening against brute force; edge cases of each."""

import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings, strategies as st

from tamiz.llm import collocations, maxscore, qd, whitening
from tests.llm.test_llm import SF, needs_tables, odd, odd_rows, empty  # noqa: F401
from tamiz.llm.base import read

VECTORS = "vec_id long, embedding array<float>, label int"
INF, NAN = float("inf"), float("nan")


def odd_vectors():
    """Nulls, non-finite components, other lengths, ties, repeated rows and ids."""
    rng = np.random.default_rng(3)
    rows = [(i, [float(v) for v in rng.normal(size=6).astype(np.float32)], 0) for i in range(120)]
    rows += [(50, rows[7][1], 1), (50, rows[50][1], 0), (None, rows[0][1], None), (None, rows[0][1], None), (200, rows[3][1], 1)]
    rows += [(300, None, 0), (301, [1.0, None, 0, 0, 0, 0], 0), (350, [NAN] * 6, 0), (400, [INF, 0, 0, 0, 0, 0], 0), (450, [0.0] * 6, 0)]
    return [(i, None if v is None else [None if c is None else float(c) for c in v], k) for i, v, k in rows]


def clean(rows):
    return [(i, [float(np.float32(c)) for c in v]) for i, v, _ in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]


# --- MaxScore


def brute_top(rows, top=5, every=50, scale=256):
    known = [(i, [int(np.floor(scale * c)) for c in v]) for i, v in clean(rows)]
    out = []
    for at, (i, x) in enumerate(known):
        if i is None or i % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(x, y)), j is None, j or 0) for other, (j, y) in enumerate(known) if other != at)
        out += [(i, rank, None if none else j, -s) for rank, (s, none, j) in enumerate(scored[:top], 1)]
    return sorted(out, key=repr)


def got_top(df, **kw):
    return sorted((tuple(r) for r in maxscore.top_products(df, **kw).select("query_id", "rank", "vec_id", "score").collect()), key=repr)


@pytest.mark.parametrize("sizes", [{}, {"shard_rows": 9, "block_queries": 2}])
def test_maxscore_equals_brute_force_on_odd_vectors(spark, sizes):
    rows = odd_vectors()
    assert got_top(spark.createDataFrame(rows, VECTORS), **sizes) == brute_top(rows)


def test_maxscore_few_rows_and_clashing_columns(spark):
    one = spark.createDataFrame([(50, [1.0], 1)], VECTORS)
    assert got_top(one) == [] == got_top(one.limit(0))
    two = spark.createDataFrame([(50, [1.0, 2.0], 1), (7, [1.0], 1)], VECTORS)
    assert got_top(two) == [(50, 1, 7, 65536)]  # the missing component counts as zero
    names = two.withColumnsRenamed({"label": "row"}).selectExpr("*", "1 AS score", "2 AS block", "3 AS shard", "4 AS floor", "5 AS x", "6 AS id")
    assert got_top(names) == [(50, 1, 7, 65536)]


def test_maxscore_huge_components_stay_exact(spark):
    rows = [(0, [2.0**20, 1.0], 0), (1, [2.0**26, 1.0], 0), (2, [2.0**26, 0.5], 0), (3, [2.0**100, 1.0], 0), (4, [2.0**101, 1.0], 0)]
    got = got_top(spark.createDataFrame(rows, VECTORS))
    assert [r[2:] for r in got] == [(3, 2**63 - 1), (4, 2**63 - 1), (1, 2**62 + 2**16), (2, 2**62 + 2**15)]


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 40), st.integers(1, 12), st.integers(-300, 300), st.integers(0, 2**32 - 1))
def test_shard_search_finds_what_reaches_the_floor(n, width, floor, seed):
    rng = np.random.default_rng(seed)
    x, q = rng.integers(-9, 10, size=(n, width)), rng.integers(-9, 10, size=width)
    shard = maxscore.Shard(np.arange(n), np.arange(n), x, True)
    places, scores = shard.search(q, -1, floor, 5)
    want = sorted((-int(s), i) for i, s in enumerate(x @ q) if s >= floor)[:5]
    assert [(-int(s), int(p)) for p, s in zip(places, scores)] == want


# --- collocations


def brute_collocations(rows, least, longest=4, top=2000):
    counts, total = defaultdict(Counter), Counter()
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for _, text, lang, _ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(low)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for n in range(1, longest + 1):
                for i in range(len(words) - n + 1):
                    counts[lang][tuple(words[i : i + n])] += 1
    out = []
    for lang, f in counts.items():
        cands = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        scored = []
        for p, a in cands.items():
            score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            inside = any(
                len(q) > len(p) and 100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
                for q, b in cands.items()
            )
            if not inside:
                scored.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


def got_collocations(df, **kw):
    out = collocations.collocations(df, **kw).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    assert dict(out.dtypes) == {"lang": "string", "phrase": "string"} | dict.fromkeys(["rank", "a", "l", "r", "n", "score"], "bigint")
    return sorted(tuple(r) for r in out.collect())


def phrase_rows(seed=0):
    rng = np.random.default_rng(seed)
    words = ["New", "york", "the", "été", "of", "a\x00b", "ÀB", "x" * 300, "a"]
    rows = []
    for i in range(150):
        text = "".join(rng.choice(words) + str(rng.choice([" ", " ", "  ", "\t", " ", ". ", "\n", "\x0b", ",", " "])) for _ in range(60))
        rows.append((i % 40 or None, text, ["en", None, "und", "fr"][i % 4], "s"))
    return rows + rows[:20] + [(1, None, "en", "s"), (1, "", None, "s"), (2, "...", "xx", "s"), (3, "a a a a a a", "en", "s")]


@pytest.mark.parametrize("least", [30, 5])
def test_collocations_equal_brute_force(spark, least):
    rows = phrase_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    assert got_collocations(df, least=least) == brute_collocations(rows, least)


def test_collocations_on_odd_documents(spark, odd, empty):  # noqa: F811
    assert got_collocations(odd, least=3, top=7) == brute_collocations(odd_rows(), 3, top=7)
    assert got_collocations(empty) == []
    named = odd.selectExpr("*", "1 AS block", "2 AS phrase", "3 AS size", "4 AS a", "'n' AS n")
    assert got_collocations(named, least=3, top=7) == brute_collocations(odd_rows(), 3, top=7)


def test_collocations_do_not_depend_on_partitions(spark, monkeypatch):
    rows = phrase_rows(1)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    want = sorted(tuple(r) for r in collocations.phrase_counts(df.repartition(1), "text", "lang", 9).collect())
    got = collocations.phrase_counts(df.repartition(7), "text", "lang", 9, partition_bytes=2000)
    assert sorted(tuple(r) for r in got.collect()) == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 60), max_size=80), max_size=8), st.integers(2, 12))
def test_summaries_lose_no_frequent_code(parts, least):
    full = Counter(c for p in parts for c in p)
    summary = collocations.Summary(sum(map(len, parts)) // least + 1)
    for part in parts:
        codes, counts = np.unique(np.array(part, dtype=np.uint32), return_counts=True)
        summary.merge(codes, counts.astype(np.int64))
        assert len(summary.codes) <= summary.capacity
    assert summary.error < least
    assert {c for c, n in full.items() if n >= least} <= set(summary.possible(least).tolist())


def test_long_texts_are_cut_between_pieces_only():
    text = "one two. three four, " * 500
    parts = list(collocations.slices([(0, "en", text)], size=100))
    assert len(parts) > 10 and max(len(p) for _, _, p in parts) <= 200
    assert b".".join(p for _, _, p in parts) == text.replace(",", ".").encode()
    whole = "word " * 200
    assert [p for _, _, p in collocations.slices([(0, "en", whole)], size=100)] == [whole.encode()]


# --- whitening


def brute_whitening(rows):
    known = [(i, [int(np.floor(64 * c)) + 1_000_000 for c in v]) for i, v in clean(rows)]
    width = max(len(x) for _, x in known)
    known = [(i, x) for i, x in known if len(x) == width]
    fit = sorted({tuple(x) for _, x in known})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[(n * c - s) / n for c, s in zip(x, sums)] for x in fit])
    e, v = np.linalg.eigh(centred.T @ centred / n)
    return known, n, sums, e[::-1], v[:, ::-1]


def check_whitening(df, rows, components=16):
    out = whitening.by_component(whitening.whiten(df, components=components))
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    got = out.toPandas()
    known, n, sums, e, v = brute_whitening(rows)
    k = min(components, int((e > 1e-12 * e[0]).sum()))
    assert len(got) == len(known) * k and set(got["n"]) == {n}
    assert got["identity_error"].nunique() == 1 and got["identity_error"].iloc[0] < 1e-9
    want = pd.DataFrame(
        [
            (i, j + 1, sum((n * c - s) ** 2 for c, s in zip(x, sums)), float(np.dot([(n * c - s) / n for c, s in zip(x, sums)], v[:, j]) / np.sqrt(e[j])), e[j] / e.sum())
            for i, x in known for j in range(k)
        ],
        columns=["vec_id", "component", "deviation", "whitened", "explained"],
    )
    for j in range(1, k + 1):
        a, b = (t[t["component"] == j].assign(i=lambda t: t["vec_id"].astype("float")).sort_values(["deviation", "i"]) for t in (got, want))
        assert a["deviation"].tolist() == b["deviation"].tolist()
        sign = np.sign((a["whitened"].to_numpy() * b["whitened"].to_numpy()).sum())
        np.testing.assert_allclose(sign * a["whitened"], b["whitened"], atol=1e-8)
        np.testing.assert_allclose(a["explained"], b["explained"], rtol=1e-10)


def test_whitening_equals_brute_force_on_odd_vectors(spark):
    rows = odd_vectors() + [(500, [1.0, 2.0], 0)]
    df = spark.createDataFrame(rows, VECTORS).repartition(5)
    check_whitening(df, rows)
    check_whitening(df.selectExpr("*", "1 AS x", "2 AS id", "3 AS n", "4 AS whitened"), rows, components=3)


@needs_tables
def test_whitening_on_the_shared_table(spark):
    table = read(spark, SF, "embeddings")
    check_whitening(table, [tuple(r) for r in table.select("vec_id", "embedding", "label").collect()])


def test_whitening_without_variance(spark):
    assert whitening.by_component(whitening.whiten(spark.createDataFrame([(1, [0.5, 1.0], 0), (2, [0.5, 1.0], 0)], VECTORS))).count() == 0
    assert whitening.by_component(whitening.whiten(spark.createDataFrame([], VECTORS))).count() == 0
    one = whitening.by_component(whitening.whiten(spark.createDataFrame([(1, [0.5, 1.0], 0), (2, [0.5, 2.0], 0)], VECTORS))).toPandas()
    assert one["component"].tolist() == [1, 1] and sorted(one["whitened"].round(9)) == [-1.0, 1.0] and set(one["explained"]) == {1.0}


def test_whitening_huge_entries_are_held(spark):
    df = spark.createDataFrame([(1, [1e30], 0), (2, [0.0], 0), (3, [-1e30], 0)], VECTORS)
    out = whitening.by_component(whitening.whiten(df)).toPandas()
    assert out["deviation"].isna().sum() == 2 and np.isfinite(out["whitened"]).all()


def cases():
    rng = np.random.default_rng(1)
    q = np.linalg.qr(rng.normal(size=(90, 12)))[0]
    turn = np.linalg.qr(rng.normal(size=(12, 12)))[0]
    x = rng.normal(size=(60, 5))
    yield rng.normal(size=(200, 24))
    yield rng.normal(size=(7, 10))
    yield rng.normal(size=(90, 12)) @ np.diag(10.0 ** -np.linspace(0, 12, 12))
    yield np.hstack([x, x, np.zeros((60, 2))])
    yield np.eye(8) * 3
    yield q @ np.diag(np.repeat([5.0, 4.0, 3.0], 4)) @ turn
    yield q @ np.diag(1 + 1e-9 * np.arange(12.0)) @ turn
    yield np.ones((5, 4))
    yield rng.normal(size=(9, 1))


@pytest.mark.parametrize("a", list(cases()))
def test_singular_vectors_are_accurate(a):
    r = np.linalg.qr(a, mode="r")
    s, v = qd.right_singular(r)
    want = np.linalg.svd(a, compute_uv=False)
    np.testing.assert_allclose(s[: len(want)], want, atol=1e-14 * want.max())
    np.testing.assert_allclose(v.T @ v, np.eye(len(s)), atol=1e-12)
    np.testing.assert_allclose(r.T @ (r @ v), v * s * s, atol=1e-13 * want.max() ** 2)


def test_dqds_keeps_small_values_to_full_accuracy():
    q, e = 10.0 ** -np.arange(0, 24, 2.0), 10.0 ** -np.arange(1, 23, 2.0) * 1e-3
    values = qd.dqds(q, e)
    b = np.diag(np.sqrt(q)) + np.diag(np.sqrt(e), 1)
    assert abs(np.prod(values) / np.prod(q) - 1) < 1e-13  # the determinant of B'B
    assert abs(values.sum() / (b * b).sum() - 1) < 1e-14
