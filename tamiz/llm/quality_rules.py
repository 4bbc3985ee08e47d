"""Quality rules: fixed base rules, then robust multivariate outliers per language and source.

Four statistics of a text are transformed and compared with a minimum-covariance-determinant (MCD) estimate of its
language and source: the mean and covariance of the h = 75 % of rows that lie closest to them. Starting from medians and
absolute deviations, every C-step keeps the closest 75 % of each group and estimates again; a step never raises the
covariance determinant. A row is rejected when its squared Mahalanobis distance exceeds a chi-square quantile.

A C-step is two aggregations with map-side partials (a rank sketch for the 75 % distance, then sums and cross products),
so a source with a third of all rows is never gathered. Groups with fewer than ``MIN_GROUP`` rows use their language's
estimate, languages below that the estimate of all rows. Rows that fail the base rules do not take part in estimates.

Defined cases: a null text has no words and fails the base rules. Null language and null source are values of their own.
An empty table gives no rows. Statistics that are constant in a group have the variance floor, so that a
group of equal rows rejects no row of its own.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.functions import pandas_udf

from tamiz.llm.base import Stages

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
SYMBOLS = b"#*$%&|<>"

KEEP_SHARE = 0.75
STEPS = 6
MIN_GROUP = 100
# Chi-square with four degrees of freedom: the scale that makes the 75 % covariance consistent for normal rows, and
# the quantile at 1 - 1e-9 (long tails of clean text must stay; junk lies far beyond).
CONSISTENCY = 1.487
CUT = 47.5
# Smallest standard deviation of each transformed statistic.
FLOOR = (0.10, 0.35, 0.70, 0.70)
WIDTH = len(FLOOR)

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows of ``window`` words that occur at least twice."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    codes = np.fromiter(map(hash, words), dtype=np.int64, count=len(words)).view(np.uint64)
    rolled = np.zeros(n, dtype=np.uint64)
    for i in range(window):
        rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + codes[i : i + n]
    ranked = np.sort(rolled)
    twice = ranked[1:][ranked[1:] == ranked[:-1]]
    if not len(twice):
        return 0
    starts = np.flatnonzero(np.isin(rolled, twice)).tolist()
    seen = Counter(tuple(words[i : i + window]) for i in starts)  # the hash proposes, the words decide
    edges = np.zeros(len(words) + 1, dtype=np.int64)
    for i in starts:
        if seen[tuple(words[i : i + window])] > 1:
            edges[i] += 1
            edges[i + window] -= 1
    return int((np.cumsum(edges) > 0).sum())


def text_counts(text: str | None) -> tuple[int, int, int, int, int]:
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    spaces = len(raw) - sum(map(len, words))
    lines = [line for line in raw.split(b"\n") if line.strip()]
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    return len(words), len(text) - spaces, symbols, len(lines) - len(set(lines)), repeated_words(words)


@pandas_udf(T.StructType([T.StructField(c, T.LongType()) for c in COUNTS]))
def counts_column(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([text_counts(t) for t in texts], columns=list(COUNTS), dtype="int64")


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words)


def measured(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``docs`` with a struct ``_q``: counts, base verdict, ``x`` (transformed statistics), language and source.

    x: log mean word length; log percent of symbols; log repeated lines; log percent of repeated words.
    """
    count = {c: F.col(f"_c.{c}") for c in COUNTS}
    words = F.greatest(count["n_words"], F.lit(1))
    x = F.array(
        F.log(F.greatest(count["word_chars"], F.lit(1)) / words),
        F.log1p(100 * count["n_symbols"] / words),
        F.log1p(count["n_dup_lines"].cast("double")),
        F.log1p(100 * count["n_repeat_words"] / words),
    )
    failed = base_failed(count["n_words"], count["n_repeat_words"])
    q = F.struct("_c.*", failed.alias("base_failed"), x.alias("x"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"))
    return docs.withColumn("_c", counts_column(text_col)).withColumn("_q", q).drop("_c")


def _distance(x: str = "x") -> Column:
    gap = [F.get(x, F.lit(i)) - F.get("mu", F.lit(i)) for i in range(WIDTH)]
    terms = [F.get("inv", F.lit(i * WIDTH + j)) * gap[i] * gap[j] for i in range(WIDTH) for j in range(WIDTH)]
    return sum(terms[1:], terms[0])


@pandas_udf(T.ArrayType(T.DoubleType()))
def _inverse(covariances: pd.Series) -> pd.Series:
    floor = np.diag(np.square(FLOOR))
    return pd.Series([np.linalg.inv(np.array(c).reshape(WIDTH, WIDTH) + floor).ravel() for c in covariances])


def _moments(rows: DataFrame, scale: float) -> DataFrame:
    x = [F.get("x", F.lit(i)) for i in range(WIDTH)]
    sums = rows.groupBy("level", "part").agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*[F.avg(c) for c in x]).alias("mu"),
        F.array(*[scale * F.covar_pop(a, b) for a in x for b in x]).alias("cov"),
    )
    return sums.select("level", "part", "n", "mu", _inverse("cov").alias("inv"))


def _parts(level: int) -> Column:
    """Group key at a level: 0 language and source, 1 language, 2 all rows."""
    lang, source = F.col("lang"), F.col("source")
    return F.to_json(F.struct(*[lang.alias("l"), source.alias("s")][: 2 - level])) if level < 2 else F.lit("")


def fit(statistics: DataFrame, stages: Stages, min_group: int = MIN_GROUP) -> DataFrame:
    """MCD estimates from ``statistics(lang, source, x)`` of rows that pass the base rules: level, part, n, mu, inv."""
    levels = F.array(*[F.struct(F.lit(i).alias("level"), _parts(i).alias("part")) for i in range(3)])
    rows = stages.keep(statistics.select("x", F.explode(levels).alias("g")).select("g.level", "g.part", "x"))
    x = [F.get("x", F.lit(i)) for i in range(WIDTH)]
    middle = rows.groupBy("level", "part").agg(
        F.count(F.lit(1)).alias("n"), F.array(*[F.percentile_approx(c, 0.5, 10_000) for c in x]).alias("mu")
    )
    middle = stages.keep(middle.filter(F.col("n") >= F.when(F.col("level") == 2, 1).otherwise(min_group)))
    gaps = rows.join(middle, ["level", "part"]).select(
        "level", "part", F.transform(F.arrays_zip("x", "mu"), lambda z: F.abs(z["x"] - z["mu"])).alias("gap")
    )
    spread = gaps.groupBy("level", "part").agg(
        F.array(*[1.4826 * F.percentile_approx(F.get("gap", F.lit(i)), 0.5, 10_000) for i in range(WIDTH)]).alias("mad")
    )
    diagonal = F.array(*[F.get("mad", F.lit(i)) ** 2 if i == j else F.lit(0.0) for i in range(WIDTH) for j in range(WIDTH)])
    model = stages.keep(middle.join(spread, ["level", "part"]).select("level", "part", "n", "mu", _inverse(diagonal).alias("inv")))
    for _ in range(STEPS):
        near = rows.join(model.select("level", "part", "mu", "inv"), ["level", "part"]).select("level", "part", "x", _distance().alias("d"))
        cut = near.groupBy("level", "part").agg(F.percentile_approx("d", KEEP_SHARE, 10_000).alias("cut"))
        cut = stages.keep(cut)
        model = stages.keep(_moments(near.join(cut, ["level", "part"]).filter("d <= cut"), CONSISTENCY))
    return model


def verdicts(rows: DataFrame, model: DataFrame, q: str = "_q") -> DataFrame:
    """``rows`` with ``kept``: passes the base rules and lies within the cut of its finest estimate."""
    out = rows
    for level in range(3):
        at = model.filter(F.col("level") == level).select(
            F.col("part").alias(f"_part{level}"), F.struct("mu", "inv").alias(f"_model{level}")
        )
        part = F.to_json(F.struct(*[F.col(f"{q}.lang").alias("l"), F.col(f"{q}.source").alias("s")][: 2 - level])) if level < 2 else F.lit("")
        out = out.withColumn(f"_part{level}", part).join(at, f"_part{level}", "left")
    best = F.coalesce(*[F.col(f"_model{i}") for i in range(3)])
    gap = [F.get(f"{q}.x", F.lit(i)) - F.get(F.col("_best.mu"), F.lit(i)) for i in range(WIDTH)]
    terms = [F.get(F.col("_best.inv"), F.lit(i * WIDTH + j)) * gap[i] * gap[j] for i in range(WIDTH) for j in range(WIDTH)]
    distance = sum(terms[1:], terms[0])
    out = out.withColumn("_best", best).withColumn("distance", distance)
    kept = ~F.col(f"{q}.base_failed") & F.coalesce(F.col("distance") <= CUT, F.lit(True))
    return out.withColumn("kept", kept).drop("_best", *[f"_{k}{i}" for k in ("part", "model") for i in range(3)])


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
           source_col: str = "source") -> DataFrame:
    """One row per document: id, the counts, base_failed, distance (squared; null where no estimate exists), kept."""
    stages = Stages(docs.sparkSession)
    rows = stages.keep(measured(docs.select(id_col, text_col, lang_col, source_col), text_col, lang_col, source_col).select(id_col, "_q"))
    passed = rows.filter(~F.col("_q.base_failed")).select("_q.lang", "_q.source", "_q.x")
    out = verdicts(rows, fit(passed, stages))
    return out.select(id_col, *[f"_q.{c}" for c in COUNTS], "_q.base_failed", "distance", "kept")


def drop_rejected(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows of ``docs`` that are kept, all columns. One pass of Python over the text, stored with its counts, no shuffle of it."""
    stages = Stages(docs.sparkSession)
    rows = stages.keep(measured(docs.select(F.struct("*").alias("_doc")), *(f"_doc.{c}" for c in (text_col, lang_col, source_col))))
    passed = rows.filter(~F.col("_q.base_failed")).select("_q.lang", "_q.source", "_q.x")
    return verdicts(rows, fit(passed, stages)).filter("kept").select("_doc.*")
