"""Queries on incident rates by area."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tamiz.catalog.base import query, table
from tamiz.catalog.standin import INCIDENTS_SQL, incidents, population
from tamiz.functions.recodes import department_name
from tamiz.operators.features import rate_table
from tamiz.operators.quality import key_difference, top_groups
from tamiz.plans.departments import clean_incidents, clean_population, log_rates, yearly_rates

# Department names as SQL, for rows that carry ``departamento`` (and ``municipio`` when asked).
_PLAIN = """translate(name, 'áÁéÉíÍóÓúÚñÑ', 'aaeeiioouunn')"""


def _canonical(source: str, first_cases: str) -> str:
    return f"""
  SELECT *, CASE lower(plain) WHEN 'bogota' THEN 'Bogota' WHEN 'bogota, d.c.' THEN 'Bogota'
              WHEN 'norte de santander' THEN 'Norte de Santander' WHEN 'san andres' THEN 'San Andres'
              ELSE upper(substring(plain, 1, 1)) || lower(substring(plain, 2)) END AS area
  FROM (SELECT *, {_PLAIN} AS plain FROM (
    SELECT *, CASE {first_cases} WHEN departamento = 'Bogota, D.C.' THEN 'Bogota'
                WHEN departamento = 'La Guajira' THEN 'Guajira' WHEN departamento = 'Valle del Cauca' THEN 'Valle'
                ELSE departamento END AS name FROM {source}))"""


CLEAN_SQL = f"""WITH {INCIDENTS_SQL},
named_cases AS ({_canonical("incidents", "WHEN municipio = 'Bogotá D.C. (CT)' THEN 'Bogota'")}),
named_people AS ({_canonical("population", "WHEN departamento LIKE 'Archipiélago de San Andrés%' THEN 'San Andres'")}),
cases AS (
  SELECT area AS departamento, CAST(year(fecha) AS INTEGER) AS year, CAST(sum(cantidad) AS BIGINT) AS n_cases
  FROM named_cases WHERE year(fecha) IN (2022, 2023, 2024) GROUP BY 1, 2),
people AS (
  SELECT area AS departamento, anio AS year, CAST(sum(total) AS BIGINT) AS total
  FROM named_people WHERE area_geografica = 'Total' GROUP BY 1, 2)
"""

RATES_SQL = f"""{CLEAN_SQL},
rates AS (
  SELECT departamento, year, n_cases, total, CASE WHEN total > 0 THEN n_cases * 100000.0 / total END AS rate
  FROM cases JOIN people USING (departamento, year)),
wide AS (
  SELECT departamento,
    {", ".join(
        f"max(CASE WHEN year = {y} THEN n_cases END) AS crimes{y % 100},"
        f" max(CASE WHEN year = {y} THEN total END) AS pop{y % 100},"
        f" max(CASE WHEN year = {y} THEN rate END) AS rate{y % 100}"
        for y in (2022, 2023, 2024))}
  FROM rates GROUP BY 1)
"""
_RATE_COLUMNS = ("rate22", "rate23", "rate24")


def _rounded(df: DataFrame, columns, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), digits) for c in columns})


def _rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return yearly_rates(incidents(spark, sf_dir), population(spark, sf_dir))


@query(
    "crime_rate_pivot",
    f"""WITH cases AS (
      SELECT n_name AS area, CAST(year(l_shipdate) AS INTEGER) AS year, count(*) AS n_cases
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
      JOIN nation ON c_nationkey = n_nationkey
      WHERE year(l_shipdate) IN (1996, 1997, 1998) GROUP BY 1, 2),
    people AS (SELECT n_name AS area, count(*) AS total FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1)
    SELECT area, {", ".join(
        f"max(CASE WHEN year = {y} THEN n_cases END) AS crimes{y % 100},"
        f" max(CASE WHEN year = {y} THEN total END) AS pop{y % 100},"
        f" round(max(CASE WHEN year = {y} AND total > 0 THEN n_cases * 100000.0 / total END), 6) AS rate{y % 100}"
        for y in (1996, 1997, 1998))}
    FROM cases JOIN people USING (area) GROUP BY area""",
)
def crime_rate_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items per nation and ship year over customers per nation, years as columns."""
    years = (1996, 1997, 1998)
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", F.year("l_shipdate").alias("year"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("area"))
    placed = (
        items.where(F.col("year").isin(*years))
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("c_nationkey", "year")
        .agg(F.count(F.lit(1)).alias("n_cases"))
    )
    cases = placed.join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select("area", "year", "n_cases")
    people = customers.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("total"))
    yearly = people.join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select(
        "area", F.explode(F.array(*[F.lit(y) for y in years])).alias("year"), "total"
    )
    out = rate_table(cases, yearly, "area", "year", years)
    return _rounded(out, ["rate96", "rate97", "rate98"]).orderBy("area")


@query(
    "top10_rate_nulls_last",
    f"""{RATES_SQL} SELECT departamento, crimes24, pop24, round(rate24, 2) AS rate24
    FROM wide ORDER BY wide.rate24 DESC NULLS LAST, departamento LIMIT 10""",
)
def top10_rate_nulls_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = _rates(spark, sf_dir).orderBy(F.col("rate24").desc_nulls_last(), "departamento").limit(10)
    return rates.select("departamento", "crimes24", "pop24", F.round("rate24", 2).alias("rate24"))


@query(
    "department_rates",
    f"""{RATES_SQL} SELECT departamento, crimes22, pop22, round(rate22, 6) AS rate22, crimes23, pop23,
    round(rate23, 6) AS rate23, crimes24, pop24, round(rate24, 6) AS rate24 FROM wide""",
)
def department_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_rates(spark, sf_dir), _RATE_COLUMNS).orderBy("departamento")


@query(
    "log_transform",
    f"""{RATES_SQL} SELECT departamento, {", ".join(f"round(ln({c}), 6) AS {c}" for c in _RATE_COLUMNS)} FROM wide""",
)
def log_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(log_rates(_rates(spark, sf_dir)), _RATE_COLUMNS)


@query("clean_incidents", f"{CLEAN_SQL} SELECT departamento, year, n_cases FROM cases")
def clean_incidents_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_incidents(incidents(spark, sf_dir)).orderBy("departamento", "year")


@query("clean_population", f"{CLEAN_SQL} SELECT departamento, year, total FROM people")
def clean_population_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_population(population(spark, sf_dir)).orderBy("departamento", "year")


@query(
    "area_difference",
    f"""{CLEAN_SQL}, a AS (SELECT DISTINCT departamento FROM cases), b AS (SELECT DISTINCT departamento FROM people)
    SELECT departamento, 'left' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b)
    UNION ALL SELECT departamento, 'right' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""",
)
def area_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas with incidents but no inhabitants, and the reverse."""
    return key_difference(
        clean_incidents(incidents(spark, sf_dir)), clean_population(population(spark, sf_dir)), "departamento"
    )


@query(
    "name_canonical",
    f"""WITH base AS (SELECT doc_id, text AS departamento, source AS municipio FROM documents),
    named AS ({_canonical("base", "WHEN departamento LIKE 'Archipiélago de San Andrés%' THEN 'San Andres'")})
    SELECT doc_id, md5(area) AS name_hash, CAST(length(area) AS INTEGER) AS name_length FROM named""",
)
def name_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The name rule over whole texts."""
    docs = table(spark, sf_dir, "documents")
    name = department_name(F.col("text"))
    return docs.select("doc_id", F.md5(name).alias("name_hash"), F.length(name).alias("name_length"))


@query(
    "top10_group_count",
    """SELECT o_custkey, count(*) AS record_count FROM orders
    GROUP BY 1 ORDER BY record_count DESC, o_custkey LIMIT 10""",
)
def top10_group_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_groups(table(spark, sf_dir, "orders"), "o_custkey", F.count(F.lit(1)), "record_count")


@query(
    "top10_group_sum",
    """SELECT c_nationkey, round(CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE), 2) AS total
    FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus IN ('F', 'O')
    GROUP BY 1 ORDER BY total DESC, c_nationkey LIMIT 10""",
)
def top10_group_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tamiz.functions.numbers import exact_sum

    orders = table(spark, sf_dir, "orders").where(F.col("o_orderstatus").isin("F", "O"))
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    joined = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    return top_groups(joined, "c_nationkey", F.round(exact_sum(F.col("o_totalprice"), 2), 2), "total")


@query(
    "ordinal_levels",
    f"""{RATES_SQL}, labelled AS (
      SELECT departamento, (rate22 + rate23 + rate24) / 3 AS mean_rate, length(departamento) % 5 AS cluster FROM wide),
    means AS (SELECT cluster, avg(mean_rate) AS m FROM labelled GROUP BY 1),
    ranked AS (SELECT cluster, row_number() OVER (ORDER BY m, cluster) AS level FROM means)
    SELECT departamento, CAST(cluster AS INTEGER) AS cluster, CAST(level AS INTEGER) AS level,
      ['Muy Bajo', 'Bajo', 'Moderado', 'Alto', 'Muy Alto'][level] AS nivel_jurisdiccion
    FROM labelled JOIN ranked USING (cluster)""",
)
def ordinal_levels_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered risk levels from given groups (by length of name), lowest mean rate first."""
    from tamiz.operators.cluster import ordinal_levels

    rates = _rates(spark, sf_dir)
    labelled = rates.withColumn("cluster", F.length("departamento") % 5).withColumn(
        "mean_rate", (F.col("rate22") + F.col("rate23") + F.col("rate24")) / 3
    )
    return ordinal_levels(labelled, "cluster", "mean_rate").select(
        "departamento", "cluster", "level", "nivel_jurisdiccion"
    )
