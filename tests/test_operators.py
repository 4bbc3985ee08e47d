"""Consolidation, routing, features and reports on small hand-written frames."""

from datetime import date

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from tamiz.operators import bind, consolidate as con, features as feat, grid, profile as prof, quality, quantiles, route, transform
from tests.conftest import rows


def test_latest_row_wins_and_ties_are_stable(spark):
    df = spark.createDataFrame([("a", "2023", 1), ("a", "2024", 2), ("b", None, 3), ("b", "2022", 4), (None, "1", 5)], "k string, p string, v int")
    out = con.latest_per_key(df, F.col("k"), [F.col("p").desc_nulls_last(), F.col("v")])
    assert rows(out.select("k", "v"), "k") == [(None, 5), ("a", 2), ("b", 4)]


def test_referential_filter_removes_lonely_and_repeated_rows(spark):
    clients = spark.createDataFrame([("a", 1), ("b", 2)], "id string, x int")
    moves = spark.createDataFrame([("a", 10), ("a", 10), ("a", 11), ("c", 12)], "id string, m int")
    kept_clients, kept_moves = con.referential_filter(clients, moves, "id")
    assert rows(kept_clients.select("id", "x")) == [("a", 1)]
    assert rows(kept_moves.select("id", "m"), "m") == [("a", 10), ("a", 11)]
    assert con.referential_filter(clients, moves, "id", dedupe=False)[1].count() == 3


def test_semi_and_anti_join_null_rules(spark):
    left = spark.createDataFrame([("a",), (None,)], "k string")
    right = spark.createDataFrame([(None,), ("b",)], "k string")
    assert con.semi_join(left, right, "k").count() == 0
    assert con.semi_join(left, right, "k", match_nulls=True).count() == 1
    assert con.anti_join(left, right, "k").count() == 2


def test_places(spark):
    moves = spark.createDataFrame(
        [(1, "#N/D"), (2, "IBAGU?"), (3, "bogotá d.c. "), (4, "ESPAÑA"), (5, "Macondo"), (6, None)], "i int, p string"
    )
    out = con.standardise_places(moves, "p").select("i", "jurisdiccion_o", "internacional", "jurisdiccion")
    assert rows(out, "i") == [
        (1, None, None, "jurisdiccion_0"), (2, "IBAGUE", "N", "jurisdiccion_4"), (3, "BOGOTA", "N", "jurisdiccion_5"),
        (4, "ESPANA", "I", "jurisdiccion_6"), (5, None, None, "jurisdiccion_0"), (6, None, None, "jurisdiccion_0")]
    lookup = con.place_lookup(spark)
    assert lookup.count() == 139 == lookup.select("place_key").distinct().count()


def test_align_and_stack(spark):
    a, b = spark.createDataFrame([(1, 2)], "x int, y int"), spark.createDataFrame([(3,)], "x int")
    assert rows(con.stack_by_name(a, b), "x") == [(1, 2), (3, None)]
    assert con.align_columns(b, {"x": "int", "z": "string"}).columns == ["x", "z"]


def test_routing_is_disjoint_and_ordered(spark):
    clients = spark.createDataFrame([("a", "Nit"), ("b", "Nit"), ("c", "CC"), ("d", None)], "id string, doc string")
    moves = spark.createDataFrame([("a", "8"), ("a", "1"), ("b", "1"), ("c", None)], "id string, prod string")
    out = route.assign_population(clients, moves, "id", F.col("prod") == "8", F.col("doc") == "Nit")
    assert rows(out.select("id", "population"), "id") == [
        ("a", "bajo_monto"), ("b", "persona_juridica"), ("c", "persona_natural"), ("d", "persona_natural")]


MOVES = [
    ("a", date(2023, 1, 1), "Ahorro", "Ingreso", "Fisico", 10.0),
    ("a", date(2023, 1, 1), "Ahorro", "Egreso", "Virtual", 5.0),
    ("a", date(2023, 1, 2), "Credito", "Ingreso", "Fisico", 7.0),
    ("a", date(2023, 1, 2), "Ahorro", "Ingreso", "Fisico", 1.5),
    ("a", date(2023, 1, 2), "Ahorro", None, "Fisico", 2.0),
    ("b", None, "Ahorro", "Ingreso", "Virtual", 3.0),
]
MOVES_SCHEMA = "id string, day date, prod string, flow string, canal string, amount double"
VIEWS = {"p": "prod", "c": "canal"}


def test_activity_rounds_half_to_even(spark):
    out = feat.activity_summary(spark.createDataFrame(MOVES, MOVES_SCHEMA), "id", F.col("day"))
    assert rows(out, "id") == [("a", 5, 2, 2.0), ("b", 1, 1, 1.0)]  # 5 / 2 = 2.5 rounds to 2


def test_flow_matrix_and_behaviour_agree(spark):
    moves = spark.createDataFrame(MOVES, MOVES_SCHEMA)
    wide = feat.flow_matrix(moves, "id", VIEWS, "flow", "amount")
    assert set(wide.columns) == {
        "id", "Ahorro_Ingreso", "Ahorro_Egreso", "Credito_Ingreso", "Ahorro_NA", "Fisico_Ingreso", "Virtual_Egreso",
        "Virtual_Ingreso", "Fisico_NA"}
    names = {"p": ["Ahorro_Ingreso", "Credito_Ingreso", "CDT_Egreso"], "c": ["Fisico_Ingreso"]}
    for scale in (None, 2):
        out = feat.behaviour(moves, "id", F.col("day"), VIEWS, "flow", "amount", names, scale)
        assert rows(out, "id") == [("a", 5, 2, 2.0, 5.75, 3.5, 0.0, 9.25), ("b", 1, 1, 1.0, 3.0, 0.0, 0.0, 0.0)]
    total = wide.select(sum(F.col(c) for c in wide.columns if c.split("_")[0] in ("Ahorro", "Credito")).alias("t"))
    assert sum(r[0] for r in total.collect()) == sum(m[-1] for m in MOVES)


def test_one_hot_keeps_missing(spark):
    df = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "i int, c string")
    assert rows(feat.one_hot(df, ["c"]), "i") == [(1, 1, 0), (2, 0, 1), (3, None, None)]


def test_indicator_rules_for_missing(spark):
    df = spark.createDataFrame([("A",), (None,)], "c string")
    strict = feat.indicators(F.col("c"), {"a": "A", "none": "N"}, "null")
    lenient = feat.indicators(F.col("c"), {"a": "A", "none": "N"}, "zero", "none")
    assert rows(df.select(*strict.values())) == [(1, 0), (None, None)]
    assert rows(df.select(*lenient.values())) == [(1, 0), (0, 1)]


def test_rate_table_guards_population(spark):
    cases = spark.createDataFrame([("x", 2022, 5), ("x", 2023, 6), ("y", 2022, 1)], "area string, year int, n_cases bigint")
    people = spark.createDataFrame([("x", 2022, 1000), ("x", 2023, 0), ("y", 2022, None)], "area string, year int, total bigint")
    out = feat.rate_table(cases, people, "area", "year", [2022, 2023])
    assert rows(out, "area") == [("x", 5, 1000, 500.0, 6, 0, None), ("y", 1, None, None, None, None, None)]


def r_quantile(values, p, kind):
    v = np.sort(values)
    h = (len(v) + 1) * p if kind == 6 else (len(v) - 1) * p + 1
    h = min(max(h, 1), len(v))
    lo = int(np.floor(h))
    hi = min(lo + 1, len(v))
    return v[lo - 1] + (h - lo) * (v[hi - 1] - v[lo - 1])


def test_type6_quantile_of_four(spark):
    df = spark.createDataFrame([("g", float(v)) for v in (1, 2, 3, 4)], "g string, v double")
    out = quantiles.grouped_quantiles(df, ["g"], ["v"], [0.75], kind=6)
    assert rows(out.select("value")) == [(3.75,)]


@pytest.mark.parametrize("kind", [6, 7])
def test_quantiles_of_groups_of_any_size(spark, kind):
    """A third of the rows share one value, one group dominates, one key is missing, one group has near neighbours."""
    rng = np.random.default_rng(1)
    near = 1.0 + np.arange(40) * 2.0**-52  # told apart by the last bits only
    data = {"big": np.where(rng.random(6000) < 0.33, 0.0, rng.lognormal(3, 2, 6000)), "small": rng.normal(size=7), None: rng.normal(size=9), "near": near}
    df = spark.createDataFrame([(g, float(v)) for g, vs in data.items() for v in vs], "g string, v double").repartition(4)
    probs = [0.0, 0.25, 0.5, 0.75, 1.0]
    got = {(g, p): v for g, _, p, v in rows(quantiles.grouped_quantiles(df, ["g"], ["v"], probs, kind))}
    assert len(got) == 20
    for g, vs in data.items():
        for p in probs:
            assert got[(g, p)] == pytest.approx(r_quantile(vs, p, kind), rel=1e-15 if g == "near" else 1e-12, abs=0 if g == "near" else 1e-12)


def test_quantiles_of_infinite_and_odd_values(spark):
    inf, nan = float("inf"), float("nan")
    df = spark.createDataFrame([(v,) for v in (-inf, -0.0, 0.0, 5e-324, inf, inf, None, nan)], "v double")
    got = quantiles.quantile_columns(df, [], ["v"], {0.0: "a", 0.5: "m", 5 / 6: "b", 1.0: "z"}).first()
    assert (got["a"], got["m"], got["b"]) == (-inf, 5e-324, inf) and np.isnan(got["z"])
    assert quantiles.quantile_columns(df.limit(0), [], ["v"], {0.5: "m"}).count() == 0


def test_ordered_bits_equal_the_stored_form(spark):
    rng = np.random.default_rng(0)
    x = [0.0, 5e-324, 2.0**-1022, 1.7976931348623157e308, float("inf"), *(2.0 ** np.arange(-1074, 1024, dtype=float))]
    x += [float(np.nextafter(v, d)) for v in x[5:] for d in (0, 1e308)] + rng.lognormal(0, 50, 2000).tolist()
    x += [-v for v in x]
    got = spark.createDataFrame([(float(v),) for v in x], "x double").select("x", quantiles.ordered_bits(F.col("x")).alias("b")).collect()
    want = np.abs(np.array([r["x"] for r in got])).view(np.int64)
    assert [r["b"] for r in got] == [-w if r["x"] < 0 else w for r, w in zip(got, want.tolist())]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.integers(-5, 5)), min_size=1, max_size=12))
def test_median_matches_numpy(spark, values):
    df = spark.createDataFrame([(1, None if v is None else float(v)) for v in values], "g int, v double")
    known = [v for v in values if v is not None]
    got = rows(prof.group_medians(df, "g", ["v"]).select("value"))
    assert got == ([(float(np.median(known)),)] if known else [])


def test_alerts_and_profile_shapes(spark):
    df = spark.createDataFrame([(1, 1, 1.0), (1, 0, 2.0), (2, 1, 5.0), (2, 1, 9.0)], "cluster int, flag int, v double")
    out = prof.alert_thresholds(df, "cluster", [1, 2], ["v"])
    assert out.columns == ["variable", "1_q3", "1_iqr", "1_alert", "2_q3", "2_iqr", "2_alert"]
    assert rows(out) == [("v", 2.0, 1.0, 3.5, 9.0, 4.0, 15.0)]
    assert rows(prof.cluster_profile(df, "cluster", [1, 2], ["flag"], ["v"]), "variable") == [("flag", 0.5, 1.0), ("v", 1.5, 7.0)]


def test_radar_drops_incomplete_rows_and_constant_columns(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0), ("a", None, 99.0), ("b", 3.0, 1.0)], "g string, x double, y double")
    out = prof.radar_table(df, "g", ["x", "y"])
    assert rows(out, "variable", "g") == [("a", "x", 1.0, 0.0), ("b", "x", 3.0, 1.0), ("a", "y", 1.0, None), ("b", "y", 1.0, None)]


def test_histogram_conserves_rows(spark):
    df = spark.createDataFrame([(float(i), 1.0) for i in range(101)], "x double, y double")
    out = prof.histogram(df, ["x", "y"])
    assert out.where("variable = 'x'").agg(F.sum("n")).first()[0] == 101
    assert rows(out.where("variable = 'y'").select("bin", "n")) == [(1, 101)]
    assert out.where("variable = 'x'").agg(F.max("bin")).first()[0] == 20


def test_quality_counts(spark):
    df = spark.createDataFrame([(0, 1, "a"), (0, None, "a"), (2, 0, None)], "x int, y int, c string")
    assert rows(quality.zero_share(df, ["x", "y"]), "variable") == [("x", 2, 66.67), ("y", None, None)]
    assert rows(quality.count_unmapped(df, "c")) == [(3, 1)]
    share = quality.category_share(df, "c", 1)
    assert rows(share, "c") == [(None, 1, 33.3), ("a", 2, 66.7)]
    assert rows(quality.row_counts({"t": df})) == [("t", 3)]
    other = spark.createDataFrame([("b",)], "c string")
    assert rows(quality.key_difference(df.dropna(), other, "c"), "side") == [("a", "left"), ("b", "right")]


def test_levels_have_a_ceiling(spark, monkeypatch):
    monkeypatch.setattr(feat, "MAX_LEVELS", 2)
    df = spark.createDataFrame([("x",), ("y",), ("z",)], "c string")
    with pytest.raises(ValueError):
        feat.one_hot(df, ["c"])


def test_rows_are_numbered_in_their_own_order(spark):
    uneven = spark.sparkContext.parallelize(range(7), 5).flatMap(lambda i: [(i, j) for j in range(i * i % 5)])
    df = spark.createDataFrame(uneven, "a int, b int")
    got = sorted((r["position"], r["a"], r["b"]) for r in bind.numbered(df).collect())
    assert got == [(n, a, b) for n, (a, b) in enumerate([(i, j) for i in range(7) for j in range(i * i % 5)], 1)]
    assert bind.numbered(df.limit(0)).count() == 0


def test_frames_are_bound_by_position(spark):
    left = spark.range(0, 100, 1, 7).toDF("x").orderBy(F.desc("x"))
    right = spark.range(0, 200, 2, 3).toDF("y")
    assert sorted(rows(bind.bind_columns(left, right))) == sorted((99 - i, 2 * i) for i in range(100))
    with pytest.raises(ValueError):
        bind.bind_columns(left, right.limit(99))
    with pytest.raises(ValueError):
        bind.bind_columns(left, left)


def test_common_numeric_columns(spark):
    a = spark.createDataFrame([], "k string, x double, n int, d decimal(4,1), t date")
    b = spark.createDataFrame([], "d bigint, x string, n float, k string, t date")
    assert con.common_numeric(a, b) == ["n", "d"]


def test_sparse_flags_have_no_ceiling(spark, monkeypatch):
    monkeypatch.setattr(feat, "MAX_LEVELS", 2)
    df = spark.createDataFrame([(1, "b", 7), (2, None, 7), (3, "a", 8), (4, None, None), (5, "c", 7)], "i int, c string, d int")
    known = feat.level_dictionary(df.repartition(5), ["c", "d"])
    assert rows(known, "position") == [("c", "a", 0), ("c", "b", 1), ("c", "c", 2), ("d", "7", 3), ("d", "8", 4)]
    assert rows(feat.one_hot_sparse(df, "i", ["c", "d"], known), "i") == [(1, [1, 3]), (2, [3]), (3, [0, 4]), (4, []), (5, [2, 3])]
    fewer = known.where("level <> 'b'")
    assert rows(feat.one_hot_sparse(df, "i", ["c"], fewer), "i") == [(1, []), (2, []), (3, [0]), (4, []), (5, [2])]
    assert rows(feat.one_hot_long(df, "i", ["c"]), "i") == [(1, "c", "b", 1), (3, "c", "a", 1), (5, "c", "c", 1)]
    none = df.where("false")
    assert feat.one_hot_sparse(none, "i", ["c"], feat.level_dictionary(none, ["c"])).collect() == []


def test_failed_configurations_say_why(spark):
    def evaluate(method, k):
        if method == "unknown":
            raise ValueError("no such method\nmore")
        df = spark.range(k).select(F.lit(float(k)).alias("m"))
        if k == 3:
            df = df.select(F.raise_error("broken").cast("double").alias("m"))
        return df.where("m <> 4").limit(1) if k != 5 else df

    out = grid.grid_results(spark, evaluate, {"m": "double"}, ["a", "unknown"], [5, 4, 3, 2])
    got = [tuple(r) for r in out.collect()]
    assert [r[:3] for r in got[:4]] == [("a", 2, 2.0), ("a", 3, None), ("a", 4, None), ("a", 5, None)]
    assert [r[3] for r in got[2:]] == ["no row of metrics", "more than one row of metrics"] + ["no such method"] * 4
    assert got[0][3] is None and got[1][3]
    assert grid.succeeded(out).count() == 1 and grid.failed(out).count() == 7
    with pytest.raises(KeyError):  # a fault of the program
        grid.grid_results(spark, lambda method, k: {}[method], {"m": "double"}, ["a"], [2])


def test_boxcox_moments_of_any_partitions_and_missing_values(spark):
    rng = np.random.default_rng(4)
    x = np.column_stack([rng.lognormal(size=400), rng.lognormal(sigma=3, size=400), np.full(400, 2.5)])
    lists = [[None if (i + j) % 9 == 0 else float(v) for j, v in enumerate(r)] for i, r in enumerate(x)]
    lams, middles, shifts = [0.4, 1e-4, -2.0], [0.1, 0.0, 0.9], [0.0, 1.0, 0.0]
    for parts in (1, 7):
        df = spark.createDataFrame(lists, "x0 double, x1 double, x2 double").repartition(parts)
        got = transform._moments(df, [0, 1, 2], shifts, middles, lams)
        for j in range(3):
            v = np.log(np.array([r[j] for r in lists if r[j] is not None]) + shifts[j]) - middles[j]
            e = 1e-5

            def form(lam):
                return np.expm1(v * lam) / lam

            y, dy = form(lams[j]), (form(lams[j] + e) - form(lams[j] - e)) / (2 * e)
            assert got[j][0] == pytest.approx(y.var(), rel=1e-9, abs=1e-12)
            assert got[j][1] == pytest.approx(((y - y.mean()) * (dy - dy.mean())).mean(), rel=1e-4, abs=1e-9)
            assert got[j][2] == pytest.approx(dy.var(), rel=1e-4, abs=1e-9)
