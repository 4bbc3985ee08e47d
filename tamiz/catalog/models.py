"""Queries that transform, reduce, cluster and validate."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tamiz.catalog.areas import _rates
from tamiz.catalog.base import query, table
from tamiz.catalog.cleaning import ASSOCIATE_SQL, associate_silver
from tamiz.catalog.features import SCALE, population_features
from tamiz.operators import balls, bind, cluster, consolidate, grid, reduce, transform, validate
from tamiz.operators.features import level_dictionary
from tamiz.operators.quantiles import long_form
from tamiz.operators.route import LEGAL, LOW_AMOUNT, NATURAL
from tamiz.plans import associates, segmentation
from tamiz.session import cut_lineage, keep_small

# The bootstrap query fits every method 2,000 times, so it starts from fewer centres than the library's 3,000.
BOOTSTRAP_K, BOOTSTRAP_STARTS = 200, 2

# All pairs of the labelled vectors, for the SQL side only.
PAIRS_SQL = """WITH pairs AS (
  SELECT a.vec_id AS i, b.vec_id AS j, a.label AS li, b.label AS lj,
    list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS d
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id)
"""
_WIDTHS_SQL = f"""{PAIRS_SQL},
means AS (SELECT i, li, lj, avg(d) AS m FROM pairs GROUP BY 1, 2, 3),
ab AS (SELECT i, li, max(CASE WHEN li = lj THEN m END) AS a, min(CASE WHEN li <> lj THEN m END) AS b FROM means GROUP BY 1, 2),
widths AS (SELECT i, li, CASE WHEN a IS NULL THEN 0.0 ELSE (b - a) / greatest(a, b) END AS w FROM ab)
"""


def _labelled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, str, str, str]:
    return table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label"


def _profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.point_profile(validate.centre_table(*_labelled(spark, sf_dir)))


@query(
    "distance_profile",
    f"""{PAIRS_SQL} SELECT i AS id, li AS own, lj AS label, count(*) AS n, round(sum(d), 4) AS total,
    round(min(d), 6) AS nearest, round(max(d), 6) AS farthest FROM pairs GROUP BY 1, 2, 3""",
)
def distance_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances of every vector to each label, summed in the tasks instead of listed as pairs."""
    rounded = {"total": 4, "nearest": 6, "farthest": 6}
    out = _profile(spark, sf_dir).where(F.col("n") > 0)
    return out.select("id", "own", "label", "n", *[F.round(c, d).alias(c) for c, d in rounded.items()])


@query(
    "connectivity",
    f"""{PAIRS_SQL} SELECT round(sum(CASE WHEN li <> lj THEN 1.0 / r ELSE 0 END), 4) AS connectivity FROM (
      SELECT *, row_number() OVER (PARTITION BY i ORDER BY d, j) AS r FROM pairs) WHERE r <= 10""",
)
def connectivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over all rows, by an exact nearest-neighbour join."""
    return balls.connectivity(*_labelled(spark, sf_dir)).select(F.round("connectivity", 4).alias("connectivity"))


@query(
    "nearest_rows",
    f"""{PAIRS_SQL} SELECT i AS id, li AS label, CAST(r AS INTEGER) AS rank, j AS other, lj AS other_label, round(d, 6) AS d FROM (
      SELECT *, row_number() OVER (PARTITION BY i ORDER BY d, j) AS r FROM pairs) WHERE r <= 10""",
)
def nearest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest rows of every row."""
    return balls.nearest_rows(*_labelled(spark, sf_dir)).withColumn("d", F.round("d", 6))


@query(
    "dunn",
    f"""{PAIRS_SQL} SELECT round(min(CASE WHEN li <> lj THEN d END) / max(CASE WHEN li = lj THEN d END), 6) AS dunn
    FROM pairs""",
)
def dunn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over all rows, by bounds on pairs of balls."""
    return balls.dunn(*_labelled(spark, sf_dir)).select(F.round("dunn", 6).alias("dunn"))


@query(
    "extreme_distances",
    f"""{PAIRS_SQL} SELECT round(min(CASE WHEN li <> lj THEN d END), 6) AS gap, round(max(CASE WHEN li = lj THEN d END), 6) AS diameter
    FROM pairs""",
)
def extreme_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least distance between labels and greatest within one."""
    return balls.dunn(*_labelled(spark, sf_dir)).select(F.round("gap", 6).alias("gap"), F.round("diameter", 6).alias("diameter"))


@query("silhouette", f"{_WIDTHS_SQL} SELECT round(avg(w), 6) AS silhouette FROM widths")
def silhouette(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.internal_indices(_profile(spark, sf_dir)).select(F.round("silhouette", 6).alias("silhouette"))


@query(
    "silhouette_by_cluster",
    f"{_WIDTHS_SQL} SELECT li AS label, count(*) AS size, round(avg(w), 6) AS width FROM widths GROUP BY 1",
)
def silhouette_by_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = validate.silhouette_by_cluster(validate.silhouette_points(_profile(spark, sf_dir)))
    return out.select("label", "size", F.round("width", 6).alias("width"))


_SQUARED_SQL = _WIDTHS_SQL.replace("avg(d) AS m", "avg(d * d) AS m")


@query(
    "silhouette_squared",
    f"""{_SQUARED_SQL}, near AS (SELECT i, arg_min(lj, m) AS neighbour FROM means WHERE li <> lj GROUP BY 1)
    SELECT w.i AS id, li AS label, neighbour, round(w, 6) AS width FROM widths w LEFT JOIN near n ON w.i = n.i""",
)
def silhouette_squared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Width of every row with squared distances, from one aggregate per cluster."""
    return validate.silhouette_squared(*_labelled(spark, sf_dir)).withColumn("width", F.round("width", 6))


@query(
    "silhouette_squared_by_cluster",
    f"{_SQUARED_SQL} SELECT li AS label, count(*) AS size, round(avg(w), 6) AS width FROM widths GROUP BY 1",
)
def silhouette_squared_by_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = validate.silhouette_by_cluster(validate.silhouette_squared(*_labelled(spark, sf_dir)))
    return out.select("label", "size", F.round("width", 6).alias("width"))


# Three groupings of the given labels stand for three configurations.
_CONFIGS = (("given", 10, 10), ("odd", 2, 2), ("thirds", 3, 3))


def _configurations(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    cells = cut_lineage(validate.centre_table(*_labelled(spark, sf_dir)))
    options = F.array(
        *[
            F.struct(F.lit(m).alias("method"), F.lit(k).alias("k"), (F.col("label") % mod + 1).alias("cluster"))
            for m, k, mod in _CONFIGS
        ]
    )
    labels = cells.select("id", F.explode(options).alias("o")).select("o.method", "o.k", "id", "o.cluster")
    return cells, labels


_GRID_SQL = f"""{PAIRS_SQL},
conf AS (SELECT method, k, m, i, j, d, li % m AS li, lj % m AS lj FROM pairs,
  (VALUES {", ".join(f"('{m}', {k}, {mod})" for m, k, mod in _CONFIGS)}) AS c(method, k, m)),
ranked AS (SELECT method, k, li, lj, row_number() OVER (PARTITION BY method, k, i ORDER BY d, j) AS r FROM conf),
con AS (SELECT method, k, sum(CASE WHEN li <> lj THEN 1.0 / r ELSE 0 END) AS connectivity FROM ranked
  WHERE r <= 10 GROUP BY 1, 2),
dun AS (SELECT method, k, min(CASE WHEN li <> lj THEN d END) / max(CASE WHEN li = lj THEN d END) AS dunn
  FROM conf GROUP BY 1, 2),
means AS (SELECT method, k, i, li, lj, avg(d) AS v FROM conf GROUP BY 1, 2, 3, 4, 5),
ab AS (SELECT method, k, i, max(CASE WHEN li = lj THEN v END) AS a, min(CASE WHEN li <> lj THEN v END) AS b
  FROM means GROUP BY 1, 2, 3),
sil AS (SELECT method, k, avg((b - a) / greatest(a, b)) AS silhouette FROM ab GROUP BY 1, 2),
grid AS (SELECT method, k, connectivity, dunn, silhouette FROM con JOIN dun USING (method, k) JOIN sil USING (method, k))
"""


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, labels = _configurations(spark, sf_dir)
    return validate.validation_grid(cells, "id", "vec", labels)


@query(
    "validation_grid",
    f"""{_GRID_SQL} SELECT method, k, round(connectivity, 4) AS connectivity, round(dunn, 6) AS dunn,
    round(silhouette, 6) AS silhouette FROM grid""",
)
def validation_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rounded = {"connectivity": 4, "dunn": 6, "silhouette": 6}
    return _grid(spark, sf_dir).select("method", "k", *[F.round(c, d).alias(c) for c, d in rounded.items()])


@query(
    "best_configuration",
    f"""{_GRID_SQL} SELECT 'connectivity' AS measure, round(min(connectivity), 6) AS score,
      (list(method ORDER BY connectivity, method))[1] AS method, (list(k ORDER BY connectivity, method))[1] AS k FROM grid
    UNION ALL SELECT 'dunn', round(max(dunn), 6), (list(method ORDER BY dunn DESC, method))[1],
      (list(k ORDER BY dunn DESC, method))[1] FROM grid
    UNION ALL SELECT 'silhouette', round(max(silhouette), 6), (list(method ORDER BY silhouette DESC, method))[1],
      (list(k ORDER BY silhouette DESC, method))[1] FROM grid""",
)
def best_configuration(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = validate.best_configuration(_grid(spark, sf_dir))
    return best.select("measure", F.round("score", 6).alias("score"), "method", "k")


@query(
    "metric_rescale",
    f"{_GRID_SQL} "
    + " UNION ALL ".join(
        f"""SELECT method, k, '{m}' AS metric, round({m}, 4) AS value, round(({m} - min({m}) OVER ())
        / nullif(max({m}) OVER () - min({m}) OVER (), 0), 6) AS scaled FROM grid"""
        for m in ("connectivity", "dunn", "silhouette")
    ),
)
def metric_rescale(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = validate.rescaled_metrics(_grid(spark, sf_dir), ["connectivity", "dunn", "silhouette"])
    return out.select("method", "k", "metric", F.round("value", 4).alias("value"), F.round("scaled", 6).alias("scaled"))


_REPLICATES = (1, 2, 3, 4, 5)
_OVERLAP_SQL = f"""WITH drawn AS (
  SELECT b, label + 1 AS o, CASE WHEN embedding[b] > 0 THEN label ELSE (label + b) % 10 END + 1 AS r
  FROM embeddings, (VALUES {", ".join(f"({b})" for b in _REPLICATES)}) AS v(b)),
shared AS (SELECT b, o, r, count(*) AS n FROM drawn GROUP BY 1, 2, 3),
sized AS (SELECT *, sum(n) OVER (PARTITION BY b, o) AS n_o, sum(n) OVER (PARTITION BY b, r) AS n_r FROM shared),
jac AS (SELECT b, o, max(n / (n_o + n_r - n)) AS j FROM sized GROUP BY 1, 2),
by_cluster AS (SELECT o, avg(j) AS j, count(*) FILTER (WHERE j < 0.5) AS dissolved,
  count(*) FILTER (WHERE j > 0.75) AS recovered FROM jac GROUP BY 1)
"""


def _overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The given labels against relabellings that move part of each cluster."""
    vectors = table(spark, sf_dir, "embeddings")
    moved = F.array(
        *[
            F.struct(
                F.lit(b).alias("b"),
                (F.when(F.col("embedding")[b - 1] > 0, F.col("label")).otherwise((F.col("label") + b) % 10) + 1).alias("r"),
            )
            for b in _REPLICATES
        ]
    )
    drawn = vectors.select((F.col("label") + 1).alias("o"), F.explode(moved).alias("m")).select("o", "m.b", "m.r")
    both = drawn.groupBy("b", F.col("o").alias("orig_cluster"), F.col("r").alias("boot_cluster")).agg(
        F.count(F.lit(1)).alias("n_both")
    )
    orig = both.groupBy("b", "orig_cluster").agg(F.sum("n_both").alias("n_orig"))
    boot = both.groupBy("b", "boot_cluster").agg(F.sum("n_both").alias("n_boot"))
    sized = both.join(orig, ["b", "orig_cluster"]).join(boot, ["b", "boot_cluster"])
    return sized.withColumns({"method": F.lit("given"), "k": F.lit(10)})


@query(
    "jaccard_two_labelings",
    """WITH l AS (SELECT label AS o, CASE WHEN embedding[1] > 0 THEN label ELSE (label + 1) % 10 END AS r FROM embeddings),
    shared AS (SELECT o, r, count(*) AS n FROM l GROUP BY 1, 2),
    sized AS (SELECT *, sum(n) OVER (PARTITION BY o) AS n_o, sum(n) OVER (PARTITION BY r) AS n_r FROM shared)
    SELECT o AS orig_cluster, round(max(n / (n_o + n_r - n)), 6) AS jaccard FROM sized GROUP BY 1""",
)
def jaccard_two_labelings(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    labels = vectors.select(
        "label", F.when(F.col("embedding")[0] > 0, F.col("label")).otherwise((F.col("label") + 1) % 10).alias("moved")
    )
    out = validate.jaccard(validate.overlap_counts(labels, "label", "moved"), [])
    return out.select("orig_cluster", F.round("jaccard", 6).alias("jaccard"))


@query(
    "stability_by_cluster",
    f"""{_OVERLAP_SQL} SELECT 'given' AS method, 10 AS k, o AS orig_cluster, round(j, 6) AS jaccard, dissolved, recovered
    FROM by_cluster""",
)
def stability_by_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = validate.stability_by_cluster(_overlaps(spark, sf_dir))
    return out.withColumn("jaccard", F.round("jaccard", 6))


@query(
    "validation_summary",
    f"""{_GRID_SQL}, {_OVERLAP_SQL.replace("WITH ", "", 1)} SELECT 'Given' AS method, 10 AS k,
      round(any_value(connectivity), 3) AS connectivity, round(any_value(dunn), 3) AS dunn,
      round(any_value(silhouette), 3) AS silhouette, round(min(j), 3) AS jaccard_min, round(avg(j), 3) AS jaccard_mean,
      round(max(j), 3) AS jaccard_max, string_agg(CAST(dissolved AS VARCHAR), ', ' ORDER BY o) AS dissolved,
      string_agg(CAST(recovered AS VARCHAR), ', ' ORDER BY o) AS recovered
    FROM by_cluster, (SELECT * FROM grid WHERE method = 'given')""",
)
def validation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indices and stability of the given labels in one report row."""
    stability = validate.stability_summary(validate.stability_by_cluster(_overlaps(spark, sf_dir)))
    return validate.summary_table(_grid(spark, sf_dir), stability)


@query(
    "attach_labels_by_key",
    """SELECT vec_id, label, round(CAST(embedding[1] AS DOUBLE), 6) AS first FROM embeddings""",
)
def attach_labels_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores and labels from separate frames meet on the id, never on row order."""
    vectors = table(spark, sf_dir, "embeddings")
    scores = vectors.select("vec_id", F.round(F.col("embedding")[0].cast("double"), 6).alias("first"))
    return scores.join(vectors.select("vec_id", "label"), "vec_id").select("vec_id", "label", "first")


@query(
    "bind_by_position",
    """SELECT vec_id, label, round(list_sum(list_transform(embedding, lambda c: CAST(c AS DOUBLE) * CAST(c AS DOUBLE))), 6) AS square
    FROM embeddings""",
)
def bind_by_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of one frame beside the labels of another, by row order: the frames share no key and are cut differently."""
    vectors = table(spark, sf_dir, "embeddings")
    square = F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda s, x: s + x * x)
    scores = vectors.repartitionByRange(7, "vec_id").sortWithinPartitions("vec_id").select("vec_id", F.round(square, 6).alias("square"))
    labels = vectors.repartitionByRange(3, "vec_id").sortWithinPartitions("vec_id").select("label")
    return bind.bind_columns(scores, labels).select("vec_id", "label", "square")


@query(
    "common_numeric_columns",
    """WITH c AS (SELECT regexp_replace(column_name, '^[a-z]+_', '') AS name FROM (DESCRIBE customer)
      WHERE column_type IN ('DOUBLE', 'FLOAT', 'BIGINT', 'INTEGER', 'SMALLINT', 'TINYINT') OR column_type LIKE 'DECIMAL%'),
    s AS (SELECT regexp_replace(column_name, '^[a-z]+_', '') AS name FROM (DESCRIBE supplier)
      WHERE column_type IN ('DOUBLE', 'FLOAT', 'BIGINT', 'INTEGER', 'SMALLINT', 'TINYINT') OR column_type LIKE 'DECIMAL%')
    SELECT name, round(avg(v), 4) AS mean FROM (
      SELECT 'acctbal' AS name, c_acctbal AS v FROM customer UNION ALL SELECT 'acctbal', s_acctbal FROM supplier
      UNION ALL SELECT 'nationkey', c_nationkey FROM customer UNION ALL SELECT 'nationkey', s_nationkey FROM supplier)
    WHERE name IN (SELECT name FROM c) AND name IN (SELECT name FROM s) GROUP BY 1""",
)
def common_numeric_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means over both frames of the numeric columns that they share."""
    frames = [
        df.toDF(*[c.split("_", 1)[1] for c in df.columns]) for df in (table(spark, sf_dir, t) for t in ("customer", "supplier"))
    ]
    shared = consolidate.common_numeric(*frames)
    both = consolidate.stack_by_name(*[df.select(*shared) for df in frames])
    tall = long_form(both, [], shared)
    return tall.groupBy(F.col("variable").alias("name")).agg(F.round(F.avg("value"), 4).alias("mean"))


def _boxcox_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders", spread=True).select(F.col("o_totalprice").alias("price"))
    customers = table(spark, sf_dir, "customer").select(F.col("c_acctbal").alias("balance"))
    return orders.unionByName(customers, allowMissingColumns=True)


_SHIFTED_SQL = """x AS (
  SELECT 'price' AS variable, 0.0 AS shift, o_totalprice AS v FROM orders
  UNION ALL SELECT 'balance', abs(m) + 1, c_acctbal + abs(m) + 1 FROM customer, (SELECT min(c_acctbal) AS m FROM customer))"""


def _round_sql(name: str, step: float, half: float, centre: str) -> str:
    count = round(half / step)
    return f"""{name}_ll AS (
  SELECT variable, lam, -count(*) / 2.0 * ln(var_pop(CASE WHEN lam = 0 THEN ln(v) ELSE (power(v, lam) - 1) / lam END))
    + (lam - 1) * sum(ln(v)) AS ll
  FROM (SELECT x.variable, v, round(c.best + g.j * {step}, 8) AS lam FROM x JOIN {centre} c ON x.variable = c.variable,
    (SELECT unnest(generate_series(-{count}, {count})) AS j) g) GROUP BY 1, 2),
{name} AS (SELECT variable, arg_max(lam, ll) AS best FROM {name}_ll GROUP BY 1)"""


# Step and half-width of each round of the SQL's grid search; a parabola through its last three points is the result.
_ROUNDS = ((0.5, 3.0), (0.1, 0.5), (0.01, 0.1), (0.001, 0.01))


def _boxcox_sql() -> str:
    last = f"r{len(_ROUNDS)}"
    parts = [_SHIFTED_SQL, "r0 AS (SELECT DISTINCT variable, CAST(0 AS DOUBLE) AS best FROM x)"]
    for i, (step, half) in enumerate(_ROUNDS):
        parts.append(_round_sql(f"r{i + 1}", step, half, f"r{i}"))
    step = _ROUNDS[-1][0]
    parts.append(
        f"""ends AS (SELECT {last}.variable, best, max(CASE WHEN abs(lam - best) < {step / 10} THEN ll END) AS fb,
  max(CASE WHEN abs(lam - best + {step}) < {step / 10} THEN ll END) AS fa,
  max(CASE WHEN abs(lam - best - {step}) < {step / 10} THEN ll END) AS fc
  FROM {last} JOIN {last}_ll USING (variable) GROUP BY 1, 2),
mle AS (SELECT variable, best - (fc - fa) / (2 * {step}) / ((fa - 2 * fb + fc) / ({step} * {step})) AS m,
  {transform.Z95} / sqrt(-(fa - 2 * fb + fc) / ({step} * {step})) AS reach FROM ends)"""
    )
    rounded = " ".join(f"WHEN abs({v} - m) <= reach THEN {v}" for v in transform.CONVENTIONAL)
    return f"""WITH {", ".join(parts)} SELECT variable, round(any_value(shift), 4) AS shift, round(m, 3) AS lambda_mle,
    round(CASE {rounded} ELSE m END, 3) AS lambda FROM mle JOIN x USING (variable) GROUP BY variable, m, reach"""


@query("boxcox_lambda", _boxcox_sql())
def boxcox_lambda(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = transform.boxcox_fit(_boxcox_input(spark, sf_dir), ["price", "balance"])
    return out.select("variable", F.round("shift", 4).alias("shift"), *[F.round(c, 3).alias(c) for c in ("lambda_mle", "lambda")])


_EXPONENTS = (-1.0, -0.5, 0.0, 0.33, 0.5, 1.0, 2.0)


@query(
    "boxcox_likelihood",
    f"""WITH {_SHIFTED_SQL}, ll AS (
      SELECT variable, lam, -count(*) / 2.0 * ln(var_pop(CASE WHEN lam = 0 THEN ln(v) ELSE (power(v, lam) - 1) / lam END))
        + (lam - 1) * sum(ln(v)) AS ll
      FROM x, (VALUES {", ".join(f"(CAST({e} AS DOUBLE))" for e in _EXPONENTS)}) AS g(lam) GROUP BY 1, 2)
    SELECT variable, lam, round(ll, 2) AS loglik, row_number() OVER (PARTITION BY variable ORDER BY ll DESC) = 1 AS best
    FROM ll""",
)
def boxcox_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = _boxcox_input(spark, sf_dir)
    low = base.agg(F.min("balance")).first()[0]
    shifted = base.withColumn("balance", F.col("balance") + transform.shift_for(low))
    out = transform.likelihood_grid(shifted, ["price", "balance"], _EXPONENTS)
    return out.withColumn("loglik", F.round("loglik", 2))


@query(
    "boxcox_apply",
    """SELECT c_custkey, round((power(c_acctbal + 1000, 0.5) - 1) / 0.5, 6) AS c_acctbal,
      round(ln(CAST(c_nationkey AS DOUBLE) + 1), 6) AS c_nationkey, 1.0 AS constant FROM customer""",
)
def boxcox_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A given exponent table applied to three columns, one of them constant and left alone."""
    people = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_nationkey", F.lit(1.0).alias("constant"))
    fitted = spark.createDataFrame(
        [("c_acctbal", 1000.0, 0.5, 0.5), ("c_nationkey", 1.0, 0.0, 0.0), ("constant", 0.0, None, None)],
        "variable string, shift double, lambda_mle double, lambda double",
    )
    out = transform.boxcox_apply(people, fitted)
    return out.withColumns({c: F.round(c, 6) for c in ("c_acctbal", "c_nationkey")})


def _embedding_columns(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    names = [f"e{i}" for i in range(64)]
    vectors = table(spark, sf_dir, "embeddings")
    return vectors.select("vec_id", *[F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate(names)]), names


def _embedding_fit(spark: SparkSession, sf_dir: str, m: int = 10):
    wide, names = _embedding_columns(spark, sf_dir)
    return wide, reduce.pca_fit(wide, names, m)


# Segments numbered from 0; by_segment cannot give more groups than there are segments.
_GROUPINGS = ("by_balance", "by_key", "by_nation", "by_segment")
_GRID_SQL = """WITH seg AS (SELECT c_custkey, c_nationkey, c_acctbal, dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS s FROM customer),
  g AS (SELECT unnest(['by_balance', 'by_key', 'by_nation', 'by_segment']) AS method), k AS (SELECT unnest([2, 3, 4, 5, 6]) AS k),
  l AS (SELECT method, k, c_acctbal AS x, CAST(CASE method WHEN 'by_balance' THEN least(floor((c_acctbal + 1000) / 11000 * k), k - 1)
      WHEN 'by_key' THEN c_custkey % k WHEN 'by_nation' THEN c_nationkey % k ELSE least(s, k - 1) END AS INTEGER) AS label
    FROM seg, g, k WHERE NOT (method = 'by_segment' AND k = 6)),
  c AS (SELECT method, k, label, count(*) AS n, var_pop(x) * count(*) AS inner_ss FROM l GROUP BY ALL),
  t AS (SELECT var_pop(c_acctbal) * count(*) AS total_ss FROM customer),
  ok AS (SELECT method, k, count(*) AS clusters, round(1 - sum(inner_ss) / any_value(total_ss), 6) AS share FROM c, t GROUP BY ALL)"""


@query(
    "grid_results",
    f"""{_GRID_SQL} SELECT method, k, clusters, share, CASE WHEN clusters IS NULL THEN 'by_segment has 5 levels, 6 wanted' END AS error
    FROM g CROSS JOIN k LEFT JOIN ok USING (method, k)""",
)
def grid_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A 4 x 5 grid of groupings of all customers, one of which cannot be had: it keeps a row that says why."""
    people = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment", F.col("c_acctbal").alias("x"))
    segments = level_dictionary(people, ["c_mktsegment"]).select(F.col("level").alias("c_mktsegment"), "position")
    # The levels are few: without the bound on them a join may send the customers to the driver instead.
    people, n_segments = people.join(keep_small(segments), "c_mktsegment"), segments.count()

    def evaluate(method: str, k: int) -> DataFrame:
        if method == "by_segment" and k > n_segments:
            raise ValueError(f"by_segment has {n_segments} levels, {k} wanted")
        labels = {
            "by_balance": F.least(F.floor((F.col("x") + 1000) / 11000 * k), F.lit(k - 1).cast("long")),
            "by_key": F.col("c_custkey") % k, "by_nation": F.col("c_nationkey") % k,
            "by_segment": F.least("position", F.lit(k - 1).cast("long")),
        }
        n, mean = F.count(F.lit(1)), F.avg("x").alias("mean")
        per = people.groupBy(labels[method].alias("label")).agg(n.alias("n"), mean, (F.var_pop("x") * n).alias("inside"))
        total = F.sum("inside") + F.sum(F.col("n") * F.col("mean") ** 2) - F.sum(F.col("n") * F.col("mean")) ** 2 / F.sum("n")
        return per.agg(n.alias("clusters"), F.round(1 - F.sum("inside") / total, 6).alias("share"))

    return grid.grid_results(spark, evaluate, {"clusters": "bigint", "share": "double"}, _GROUPINGS)


@query("pca_scores")
def pca_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide, fit = _embedding_fit(spark, sf_dir)
    return reduce.score_columns(reduce.pca_scores(wide, fit, ["vec_id"]), ["vec_id"], 10)


@query("pca_eigen")
def pca_eigen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce.eigen_table(spark, _embedding_fit(spark, sf_dir)[1])


@query("pca_variable_quality")
def pca_variable_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce.variable_quality(spark, _embedding_fit(spark, sf_dir)[1])


_LONG_SQL = """WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
  s AS (SELECT i, avg(v) AS m, stddev_pop(v) AS sd FROM x GROUP BY i),
  z AS (SELECT vec_id, i, (v - m) / sd AS z FROM x JOIN s USING (i) WHERE sd > 0)"""


@query(
    "pca_rebuilds_correlations",
    f"""{_LONG_SQL} SELECT 'e' || a.i AS variable, 'e' || b.i AS other, round(avg(a.z * b.z), 6) AS correlation
    FROM z a JOIN z b ON a.vec_id = b.vec_id AND a.i <= b.i GROUP BY a.i, b.i""",
)
def pca_rebuilds_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coordinates of all 64 components multiplied back into the correlations, which SQL has on its own."""
    quality = reduce.variable_quality(spark, _embedding_fit(spark, sf_dir, 64)[1])
    place = F.substring("variable", 2, 9).cast("int")
    left = quality.select("component", "variable", place.alias("i"), "coordinate")
    right = quality.select("component", F.col("variable").alias("other"), place.alias("j"), F.col("coordinate").alias("c2"))
    pairs = left.join(right, "component").where("i <= j").groupBy("variable", "other")
    return pairs.agg(F.round(F.sum(F.col("coordinate") * F.col("c2")), 6).alias("correlation"))


@query("pca_score_norms", f"{_LONG_SQL} SELECT vec_id, round(sum(z * z), 5) AS norm FROM z GROUP BY vec_id")
def pca_score_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 64 scores of a row keep its squared length."""
    wide, fit = _embedding_fit(spark, sf_dir, 64)
    scores = reduce.pca_scores(wide, fit, ["vec_id"])
    return scores.select("vec_id", F.round(F.aggregate("scores", F.lit(0.0), lambda a, s: a + s * s), 5).alias("norm"))


@query(
    "pca_conditions",
    f"""{_LONG_SQL}, r AS (SELECT avg(a.z * b.z) AS r FROM z a JOIN z b ON a.vec_id = b.vec_id GROUP BY a.i, b.i),
      n AS (SELECT count(*) AS n FROM s WHERE sd > 0)
    SELECT 'trace' AS condition, CAST(n AS DOUBLE) AS value FROM n
    UNION ALL SELECT 'square sum', round(sum(r * r), 6) FROM r
    UNION ALL SELECT 'cos2 sum', CAST(n AS DOUBLE) FROM n
    UNION ALL SELECT 'score mean, largest', 0.0
    UNION ALL SELECT 'score variance against eigenvalue, largest gap', 0.0
    UNION ALL SELECT 'score correlation, largest', 0.0""",
)
def pca_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What eigenvalues, cos2 and scores of all 64 components must meet."""
    wide, fit = _embedding_fit(spark, sf_dir, 64)
    names = [f"dim_{i + 1}" for i in range(fit.loadings.shape[1])]
    scores = reduce.score_columns(reduce.pca_scores(wide, fit, ["vec_id"]), [], len(names))
    rows, means, deviations = reduce.centred_products(scores, names)
    values = np.array(fit.eigenvalues)
    cos2 = reduce.variable_quality(spark, fit).agg(F.sum("cos2")).scalar()
    facts = {
        "trace": values.sum(), "square sum": (values**2).sum(), "score mean, largest": np.abs(means).max(),
        "score variance against eigenvalue, largest gap": np.abs(np.diag(deviations) / rows - values).max(),
        "score correlation, largest": np.abs(deviations / rows - np.diag(np.diag(deviations)) / rows).max(),
    }
    out = spark.createDataFrame([(k, float(round(v, 6))) for k, v in facts.items()], "condition string, value double")
    last = spark.range(1).select(F.lit("cos2 sum").alias("condition"), F.round(cos2, 6).alias("value"))
    return out.unionByName(last)


# Two columns have a closed form: eigenvalues 1 +- |r|, scores (z1 +- z2) / sqrt(2).
_PAIR_SQL = """WITH s AS (SELECT avg(c_acctbal) AS ma, stddev_pop(c_acctbal) AS sa, avg(c_nationkey) AS mn,
    stddev_pop(c_nationkey) AS sn, corr(c_acctbal, c_nationkey) AS r FROM customer)"""


@query(
    "pca_pair_scores",
    f"""{_PAIR_SQL} SELECT c_custkey,
      round((z1 + sign(r) * z2) / sqrt(2.0), 5) AS dim_1, round((z1 - sign(r) * z2) / sqrt(2.0), 5) AS dim_2
    FROM (SELECT c_custkey, r, (c_acctbal - ma) / sa AS z1, (c_nationkey - mn) / sn AS z2 FROM customer, s)""",
)
def pca_pair_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_nationkey")
    fit = reduce.pca_fit(people, ["c_acctbal", "c_nationkey"], 2)
    out = reduce.score_columns(reduce.pca_scores(people, fit, ["c_custkey"]), ["c_custkey"], 2)
    return out.withColumns({c: F.round(c, 5) for c in ("dim_1", "dim_2")})


@query(
    "pca_pair_eigen",
    f"""{_PAIR_SQL} SELECT 1 AS component, round(1 + abs(r), 6) AS eigenvalue, round(50 * (1 + abs(r)), 4) AS percentage,
      round(50 * (1 + abs(r)), 4) AS cumulative FROM s
    UNION ALL SELECT 2, round(1 - abs(r), 6), round(50 * (1 - abs(r)), 4), 100.0 FROM s""",
)
def pca_pair_eigen(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = table(spark, sf_dir, "customer")
    out = reduce.eigen_table(spark, reduce.pca_fit(people, ["c_acctbal", "c_nationkey"], 2))
    rounded = {"eigenvalue": 6, "percentage": 4, "cumulative": 4}
    return out.select("component", *[F.round(c, d).alias(c) for c, d in rounded.items()])


def _associate_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = cut_lineage(associates.feature_table(*associate_silver(spark, sf_dir), scale=SCALE))
    return segmentation.reduce_features(features, "num_identificacion", segmentation.MODELS["associates"]).scores


def _micro(spark: SparkSession, sf_dir: str, **sizes: int) -> tuple[DataFrame, DataFrame]:
    return cluster.micro_cluster(_associate_scores(spark, sf_dir), "num_identificacion", **sizes)


@query("micro_cluster")
def micro_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    centres, _ = _micro(spark, sf_dir)
    return centres


@query("kmeans_segments")
def kmeans_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k-means straight on the scores of every client."""
    return cluster.kmeans(_associate_scores(spark, sf_dir), "num_identificacion", "scores", 5)


@query(
    "kmeans_conditions",
    "SELECT count(*) AS n, CAST(8 AS BIGINT) AS clusters, CAST(0 AS BIGINT) AS misplaced FROM orders",
)
def kmeans_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k-means of every order by price and customer: no row may be nearer to the mean of another cluster."""
    orders = table(spark, sf_dir, "orders", spread=True)
    most = orders.agg(F.max("o_custkey")).first()[0]
    vec = F.array(F.col("o_totalprice") / 1e5, F.col("o_custkey") * (5.0 / most))
    points = orders.select("o_orderkey", vec.alias("vec"))
    labelled = points.join(cluster.kmeans(points, "o_orderkey", "vec", 8, starts=3), "o_orderkey")
    means = labelled.groupBy("cluster").agg(F.array(F.avg(F.col("vec")[0]), F.avg(F.col("vec")[1])).alias("mean"))
    listed = means.agg(F.map_from_entries(F.collect_list(F.struct("cluster", "mean"))).alias("means"))

    def squared(m: Column) -> Column:
        return F.pow(F.col("vec")[0] - m[0], F.lit(2)) + F.pow(F.col("vec")[1] - m[1], F.lit(2))

    tried = labelled.withColumn("means", listed.scalar())
    least = F.array_min(F.transform(F.map_values("means"), squared))
    far = squared(F.element_at("means", F.col("cluster"))) > least + 1e-6
    return tried.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("cluster").alias("clusters"), F.count_if(far).alias("misplaced"))


@query(
    "nearest_centres",
    """SELECT vec_id, CAST(arg_min(c, (d, c)) + 1 AS INTEGER) AS cluster, round(min(d), 6) AS distance FROM (
      SELECT a.vec_id, b.vec_id AS c, list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS d
      FROM embeddings a, embeddings b WHERE b.vec_id < 6) GROUP BY 1""",
)
def nearest_centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector assigned to the nearest of six given ones, row by row."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    centres = np.array([r["v"] for r in vectors.where("vec_id < 6").orderBy("vec_id").collect()])
    return cluster.assign_nearest(vectors, "vec_id", "v", centres).withColumn("distance", F.round("distance", 6))


@query("ward_segments")
def ward_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ward on up to 4000 centres of the labelled vectors' table."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    centres, assigned = cluster.micro_cluster(vectors, "vec_id", k=cluster.MAX_ITEMS, starts=1, vec_col="v")
    return cluster.inherit_labels(assigned, cluster.ward(centres, "center_id", "center", 6)).select("vec_id", "cluster")


@query("pam_segments")
def pam_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    centres, assigned = _micro(spark, sf_dir)
    labels, _ = cluster.pam(centres, "center_id", "center", 4)
    return cluster.inherit_labels(assigned, labels).select("num_identificacion", "cluster")


@query("clara_segments")
def clara_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampled k-medoids on every client, no compression."""
    labels, _ = cluster.clara(_associate_scores(spark, sf_dir), "num_identificacion", "scores", 4)
    return labels


@query(
    "segments_conserve_rows",
    f"""{ASSOCIATE_SQL} SELECT count(*) AS n, count(DISTINCT normalized_id) AS ids, CAST(5 AS BIGINT) AS clusters
    FROM silver_clients WHERE rol = 'Asociado'""",
)
def segments_conserve_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every associate ends in exactly one of five segments."""
    features = associates.feature_table(*associate_silver(spark, sf_dir), scale=SCALE)
    segmented = segmentation.segment(features, "num_identificacion", segmentation.MODELS["associates"])
    return segmented.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("num_identificacion").alias("ids"),
        F.count_distinct("cluster").alias("clusters"),
    )


@query("department_levels")
def department_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Risk level of every department from clustered log rates."""
    return segmentation.department_levels(_rates(spark, sf_dir))


def _segmented(spark: SparkSession, sf_dir: str, population: str) -> DataFrame:
    features = population_features(spark, sf_dir, population)
    return segmentation.segment(features, "num_ident", segmentation.MODELS[population])


@query("segments_natural")
def segments_natural(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _segmented(spark, sf_dir, NATURAL).select("num_ident", "cluster")


@query("segments_legal")
def segments_legal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _segmented(spark, sf_dir, LEGAL).select("num_ident", "cluster")


@query("segments_low_amount")
def segments_low_amount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _segmented(spark, sf_dir, LOW_AMOUNT).select("num_ident", "cluster")


@query("segment_alerts")
def segment_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alert thresholds of the low-amount segments."""
    model = segmentation.MODELS[LOW_AMOUNT]
    return segmentation.segment_reports(cut_lineage(_segmented(spark, sf_dir, LOW_AMOUNT)), model)[1]


@query("segment_profile")
def segment_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profile of the low-amount segments."""
    model = segmentation.MODELS[LOW_AMOUNT]
    return segmentation.segment_reports(cut_lineage(_segmented(spark, sf_dir, LOW_AMOUNT)), model)[0]


@query("bootstrap_stability")
def bootstrap_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All methods, two to six clusters, 100 resamples each, on the centres of the associates."""
    centres, _ = _micro(spark, sf_dir, k=BOOTSTRAP_K, starts=BOOTSTRAP_STARTS)
    return segmentation.compare_methods(cut_lineage(centres))
