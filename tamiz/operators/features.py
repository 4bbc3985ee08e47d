"""Per-client features: activity, flow matrices, one-hot attributes, yearly rates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tamiz.functions.numbers import distinct_periods, half_even, rate_per, safe_ratio
from tamiz.functions.text import composite_key
from tamiz.operators.bind import numbered

# One-hot columns and pivots become schema, so their number has a ceiling.
MAX_LEVELS = 1000


def levels(df: DataFrame, column: Column, what: str) -> list:
    """Sorted distinct non-null values of a column that is about to become a set of columns."""
    rows = df.select(column.alias("v")).where("v is not null").distinct().take(MAX_LEVELS + 1)
    if len(rows) > MAX_LEVELS:
        raise ValueError(f"{what} has more than {MAX_LEVELS} values")
    return sorted(r[0] for r in rows)


def activity_summary(moves: DataFrame, key: str, period: Column) -> DataFrame:
    """Movements, active periods and rounded movements per active period, by client."""
    counted = moves.groupBy(key).agg(F.count(F.lit(1)).alias("n_moves"), distinct_periods(period).alias("n_periods"))
    return counted.withColumn("num_transa", half_even(F.col("n_moves") / F.col("n_periods")))


def with_flow_keys(moves: DataFrame, views: Mapping[str, str], flow: str) -> DataFrame:
    """Add each view's ``value_flow`` name once per row, so that many sums can test it cheaply."""
    return moves.withColumns({f"__{v}": composite_key(F.col(c), F.col(flow)) for v, c in views.items()})


def flow_keys(keyed: DataFrame, views: Mapping[str, str]) -> dict[str, list[str]]:
    """The ``value_flow`` names found in the data, by view."""
    return {v: levels(keyed, F.col(f"__{v}"), f"view {v}") for v in views}


def quoted(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def flow_sums(amount: str, values: Mapping[str, Sequence[str]], scale: int | None = None) -> list[Column]:
    """Aggregates over keyed movements, one per ``value_flow`` name; names a client lacks sum to 0.

    With ``scale`` the sums are exact for amounts of that many decimals.
    """
    unit = 1.0 if scale is None else float(10**scale)
    measured = f"`{amount}`" if scale is None else f"cast(round(`{amount}` * {unit}d, 0) AS bigint)"
    return [
        F.expr(f"coalesce(sum(CASE WHEN `__{view}` = {quoted(name)} THEN {measured} END), 0) / {unit}d AS `{name}`")
        for view, names in values.items()
        for name in names
    ]


def flow_matrix(
    moves: DataFrame,
    key: str,
    views: Mapping[str, str],
    flow: str,
    amount: str,
    values: Mapping[str, Sequence[str]] | None = None,
    scale: int | None = None,
) -> DataFrame:
    """Amounts by client and ``value_flow``, all views in one pass over the movements."""
    keyed = with_flow_keys(moves, views, flow)
    return keyed.groupBy(key).agg(*flow_sums(amount, values or flow_keys(keyed, views), scale))


def per_period(df: DataFrame, columns: Sequence[str], periods: str) -> DataFrame:
    """Amount columns divided by the number of active periods."""
    return df.withColumns({c: safe_ratio(F.col(c), F.col(periods)) for c in columns})


def behaviour(
    moves: DataFrame,
    key: str,
    period: Column,
    views: Mapping[str, str],
    flow: str,
    amount: str,
    values: Mapping[str, Sequence[str]],
    scale: int | None = None,
    extra_keys: Sequence[str] = (),
) -> DataFrame:
    """Activity summary and per-period flow matrix from one pass over the movements.

    Movements are summed first under their full narrow key, which shrinks a client that owns
    a large share of them inside each task. What is left of a client, at most one row per
    period and combination of names, then meets in one place and is laid out wide there, so
    the wide rows are never shuffled.
    """
    names = [n for v in views for n in values[v]]
    keys = [key, *extra_keys]
    keyed = with_flow_keys(moves.withColumn("__period", period), views, flow)
    unit = 1.0 if scale is None else float(10**scale)
    measured = f"`{amount}`" if scale is None else f"cast(round(`{amount}` * {unit}d, 0) AS bigint)"
    narrow = keyed.groupBy(*keys, "__period", *[f"__{v}" for v in views]).agg(
        F.count(F.lit(1)).alias("__n"), F.expr(f"sum({measured}) AS __s")
    )
    by_period = narrow.repartition(key).groupBy(*keys, "__period").agg(
        F.sum("__n").alias("__n"),
        *[F.expr(f"sum(CASE WHEN `__{v}` = {quoted(n)} THEN __s END) AS `{n}`") for v in views for n in values[v]],
    )
    return by_period.groupBy(*keys).agg(
        F.sum("__n").alias("n_moves"),
        F.count(F.lit(1)).alias("n_periods"),
        F.expr("bround(sum(__n) / count(1), 0) AS num_transa"),
        *[F.expr(f"coalesce(sum(`{n}`), 0) / {unit}d / count(1) AS `{n}`") for n in names],
    )


def one_hot(df: DataFrame, levels_of: Mapping[str, Sequence[str]] | Sequence[str]) -> DataFrame:
    """One 0/1 column ``name_level`` per level, source columns dropped.

    Give the levels, or only column names to take every level found in the data. A null stays null.
    """
    if not isinstance(levels_of, Mapping):
        levels_of = {c: levels(df, F.col(c), c) for c in levels_of}
    flags = {f"{c}_{lv}": (F.col(c) == lv).cast("int") for c, lvs in levels_of.items() for lv in lvs}
    return df.withColumns(flags).drop(*levels_of)


def one_hot_long(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """``key, column, level, value``: one row of value 1 per present level, for any number of levels. A null gives no row."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("level")) for c in columns])
    long = df.select(key, F.inline(pairs)).where(F.col("level").isNotNull())
    return long.withColumn("value", F.lit(1))


def level_dictionary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``column, level, position``: every level found, numbered from 0 by column and level.

    Levels are made distinct, sorted over all tasks, and numbered from the sizes of the sorted parts.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("level")) for c in columns])
    found = df.select(F.inline(pairs)).where(F.col("level").isNotNull()).distinct()
    return numbered(found.orderBy("column", "level")).withColumn("position", F.col("position") - 1)


def one_hot_sparse(df: DataFrame, key: str, columns: Sequence[str], dictionary: DataFrame) -> DataFrame:
    """``key, positions``: the places of the ones in each row's flag vector, ascending; ``key`` must tell rows apart.

    A level outside the dictionary and a null have no place. Rows without any place have an empty list. The dictionary is
    joined by the planner's choice of side, so it may have more levels than a broadcast holds.
    """
    found = one_hot_long(df, key, columns).join(dictionary, ["column", "level"])
    places = found.groupBy(key).agg(F.array_sort(F.collect_list("position")).alias("positions"))
    empty = F.array().cast("array<bigint>")
    return df.select(key).join(places, key, "left").select(key, F.coalesce("positions", empty).alias("positions"))


def indicators(source: Column, names: Mapping[str, str], null_policy: str, null_name: str | None = None) -> dict[str, Column]:
    """0/1 columns for listed values under one of two rules for a missing source.

    ``"null"``: every column is null. ``"zero"``: every column is 0, and ``null_name`` is 1.
    """
    out = {}
    for name, value in names.items():
        hit = source == value
        if null_policy == "zero":
            hit = F.coalesce(hit, F.lit(name == null_name))
        out[name] = hit.cast("int")
    return out


def rate_table(
    cases: DataFrame, population: DataFrame, area: str, year: str, years: Sequence[int], per: float = 100000.0
) -> DataFrame:
    """``crimes``, ``pop`` and ``rate`` columns per year and area, from yearly totals.

    ``cases`` holds (area, year, n_cases), ``population`` (area, year, total).
    """
    both = (
        cases.where(F.col(year).isin(list(years)))
        .join(population.where(F.col(year).isin(list(years))), [area, year])
        .withColumn("rate", rate_per(F.col("n_cases"), F.col("total"), per))
    )
    columns = []
    for y in years:
        short = f"{y % 100:02d}"
        here = F.col(year) == y
        columns += [
            F.max(F.when(here, F.col("n_cases"))).alias(f"crimes{short}"),
            F.max(F.when(here, F.col("total"))).alias(f"pop{short}"),
            F.max(F.when(here, F.col("rate"))).alias(f"rate{short}"),
        ]
    return both.groupBy(area).agg(*columns)
