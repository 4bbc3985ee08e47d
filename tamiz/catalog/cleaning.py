"""Queries that consolidate, filter and recode tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F

from tamiz.catalog.base import query, table
from tamiz.catalog.standin import (
    ASSOCIATE_CLIENTS_SQL,
    ASSOCIATE_MOVES_SQL,
    CLIENTS_SQL,
    MOVES_SQL,
    associate_clients,
    associate_moves,
    clients,
    moves,
)
from tamiz.data.jurisdictions import PLACES, TIER_OF_CITY
from tamiz.functions import dates, numbers, recodes, text
from tamiz.operators import consolidate as con
from tamiz.operators.quality import category_share, count_unmapped, key_difference
from tamiz.plans import associates, populations

_PLACE_VALUES = ", ".join(
    "(" + ", ".join("NULL" if not v else "'" + v.replace("'", "''") + "'" for v in line.split("|")) + ")"
    for line in PLACES.strip().splitlines()
)
_TIER_CASES = " ".join(f"WHEN standardized = '{k}' THEN '{v}'" for k, v in TIER_OF_CITY.items())
INDUSTRY_CASE = (
    "CASE WHEN {c} IS NULL OR trim({c}) = '' THEN NULL "
    + " ".join(
        f"WHEN TRY_CAST(substring({{c}}, 1, 2) AS INTEGER) BETWEEN {a} AND {b} THEN '{label}'"
        for a, b, label in recodes.INDUSTRY_RANGES
    )
    + " ELSE 'No Clasificado' END"
)

# Clean clients and movements of the three-population flow.
SILVER_SQL = f"""WITH {CLIENTS_SQL}, {MOVES_SQL},
places(original, standardized, internacional) AS (VALUES {_PLACE_VALUES}),
latest AS (
  SELECT *, upper(trim(documento)) AS normalized_id,
    row_number() OVER (PARTITION BY upper(trim(documento)) ORDER BY year DESC) AS rn FROM raw_clients),
all_clients AS (
  SELECT normalized_id, tipo_documento, estado, year, ciiu AS ciiu_o, {INDUSTRY_CASE.format(c="ciiu")} AS ciiu,
    coalesce(ingresos_mens, 0) + coalesce(otros_ingresos, 0) AS ingresos, coalesce(egresos_mens, 0) AS egresos,
    coalesce(total_activos, 0) AS activos, coalesce(total_pasivos, 0) AS pasivos
  FROM latest WHERE rn = 1),
all_moves AS (
  SELECT upper(trim(num_ident)) AS normalized_id, num_ident, fecha_transac, tipo_transac, tipo_prod, tipo_canal,
    standardized AS jurisdiccion_o, internacional, abs(monto) AS monto, especie, nombre_prod, source_file,
    raw_moves.year AS year, transaction_type,
    CASE WHEN year(fecha_transac) BETWEEN 2022 AND 2024 THEN CAST(year(fecha_transac) AS VARCHAR) END AS calculated_year,
    CASE WHEN internacional = 'I' THEN 'jurisdiccion_6' {_TIER_CASES} ELSE 'jurisdiccion_0' END AS jurisdiccion
  FROM raw_moves LEFT JOIN places ON upper(trim(raw_moves.jurisdiccion)) = upper(trim(places.original))
  WHERE monto IS NOT NULL AND monto <> 0),
silver_clients AS (SELECT DISTINCT c.* FROM all_clients c SEMI JOIN all_moves m USING (normalized_id)),
silver_moves AS (SELECT DISTINCT m.* FROM all_moves m SEMI JOIN all_clients c USING (normalized_id))
"""

# Clean clients and movements of the associate flow.
ASSOCIATE_SQL = f"""WITH {ASSOCIATE_CLIENTS_SQL}, {ASSOCIATE_MOVES_SQL},
latest AS (
  SELECT *, upper(trim(num_identificacion)) AS normalized_id,
    row_number() OVER (PARTITION BY upper(trim(num_identificacion)) ORDER BY semestre DESC) AS rn FROM raw_clients),
all_moves AS (
  SELECT *, upper(trim(num_identificacion)) AS normalized_id,
    CASE WHEN year(fecha_transaccion) BETWEEN 2023 AND 2024 THEN CAST(year(fecha_transaccion) AS VARCHAR) || '-' ||
      CASE WHEN month(fecha_transaccion) <= 6 THEN 'I' ELSE 'II' END END AS semestre_fecha FROM raw_moves),
silver_clients AS (SELECT DISTINCT c.* FROM latest c SEMI JOIN all_moves m USING (normalized_id) WHERE c.rn = 1),
silver_moves AS (SELECT DISTINCT m.* FROM all_moves m SEMI JOIN silver_clients c USING (normalized_id))
"""


def silver(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return populations.clean_tables(clients(spark, sf_dir), moves(spark, sf_dir))


def associate_silver(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return associates.clean_tables(associate_clients(spark, sf_dir), associate_moves(spark, sf_dir))


@query(
    "latest_row_per_key",
    """SELECT user_key, event_id, event_type, value FROM (
      SELECT upper(trim(' user' || CAST(user_id AS VARCHAR) || ' ')) AS user_key, event_id, event_type, value,
        row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""",
)
def latest_row_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest event of each user, the user key normalised."""
    events = table(spark, sf_dir, "events").withColumn(
        "user_key", text.norm_key(F.concat(F.lit(" user"), F.col("user_id").cast("string"), F.lit(" ")))
    )
    latest = con.latest_per_key(events, F.col("user_key"), [F.col("ts").desc(), F.col("event_id").desc()])
    return latest.select("user_key", "event_id", "event_type", "value")


@query(
    "referential_filter_clients",
    f"""{SILVER_SQL} SELECT normalized_id, tipo_documento, estado, year, ciiu_o, ciiu, round(ingresos, 4) AS ingresos,
    round(egresos, 4) AS egresos, round(activos, 4) AS activos, round(pasivos, 4) AS pasivos FROM silver_clients""",
)
def referential_filter_clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, _ = silver(spark, sf_dir)
    money = [F.round(F.col(c), 4).alias(c) for c in populations.BALANCE]
    return kept.select("normalized_id", "tipo_documento", "estado", "year", "ciiu_o", "ciiu", *money)


@query(
    "referential_filter_movements",
    f"""{SILVER_SQL} SELECT normalized_id, fecha_transac, tipo_transac, tipo_prod, tipo_canal, jurisdiccion_o,
    internacional, jurisdiccion, monto, nombre_prod, calculated_year FROM silver_moves""",
)
def referential_filter_movements(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, kept = silver(spark, sf_dir)
    return kept.select(
        "normalized_id", "fecha_transac", "tipo_transac", "tipo_prod", "tipo_canal", "jurisdiccion_o",
        "internacional", "jurisdiccion", "monto", "nombre_prod", "calculated_year",
    )


@query(
    "associate_clients",
    f"""{ASSOCIATE_SQL} SELECT normalized_id, semestre, rol, tipo_contrato, actividad_economica FROM silver_clients""",
)
def associate_clients_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, _ = associate_silver(spark, sf_dir)
    return kept.select("normalized_id", "semestre", "rol", "tipo_contrato", "actividad_economica")


@query(
    "associate_movements",
    f"""{ASSOCIATE_SQL} SELECT normalized_id, fecha_transaccion, monto_transaccion, semestre AS semestre_archivo,
    semestre_fecha AS semestre, 'base_2024-I.xlsx' AS file_name FROM silver_moves""",
)
def associate_movements(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, kept = associate_silver(spark, sf_dir)
    return kept.select(
        "normalized_id", "fecha_transaccion", "monto_transaccion", "semestre_archivo", "semestre", "file_name"
    )


@query(
    "semi_then_semi",
    """WITH big AS (SELECT * FROM orders WHERE o_totalprice > 300000),
    m AS (SELECT big.* FROM big SEMI JOIN (SELECT * FROM customer WHERE c_mktsegment = 'BUILDING') c
          ON big.o_custkey = c.c_custkey)
    SELECT c_custkey, c_name FROM customer SEMI JOIN m ON customer.c_custkey = m.o_custkey
    WHERE c_mktsegment = 'BUILDING'""",
)
def semi_then_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = table(spark, sf_dir, "customer").where(F.col("c_mktsegment") == "BUILDING")
    big = table(spark, sf_dir, "orders").where(F.col("o_totalprice") > 300000).withColumnRenamed("o_custkey", "c_custkey")
    theirs = con.semi_join(big, members, "c_custkey")
    return con.semi_join(members, theirs, "c_custkey").select("c_custkey", "c_name")


@query(
    "anti_join_clients",
    """SELECT c_custkey, c_mktsegment FROM customer ANTI JOIN
    (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'P') o
    ON customer.c_custkey = o.o_custkey""",
)
def anti_join_clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    urgent = table(spark, sf_dir, "orders").where(
        (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "P")
    )
    people = table(spark, sf_dir, "customer")
    return con.anti_join(people, urgent.withColumnRenamed("o_custkey", "c_custkey"), "c_custkey").select(
        "c_custkey", "c_mktsegment"
    )


@query(
    "lookup_standardise",
    f"""{SILVER_SQL} SELECT jurisdiccion_o, internacional, count(*) AS n FROM all_moves GROUP BY 1, 2""",
)
def lookup_standardise(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = populations.clean_moves(moves(spark, sf_dir))
    return cleaned.groupBy("jurisdiccion_o", "internacional").agg(F.count(F.lit(1)).alias("n"))


@query(
    "risk_tier",
    f"""{SILVER_SQL} SELECT jurisdiccion, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM all_moves), 6)
    AS percentage FROM all_moves GROUP BY 1""",
)
def risk_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return category_share(populations.clean_moves(moves(spark, sf_dir)), "jurisdiccion", 6).orderBy("jurisdiccion")


@query(
    "count_unmapped",
    f"""{SILVER_SQL} SELECT count(*) AS total, CAST(count(*) FILTER (WHERE jurisdiccion_o IS NULL) AS BIGINT) AS missing
    FROM all_moves""",
)
def count_unmapped_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_unmapped(populations.clean_moves(moves(spark, sf_dir)), "jurisdiccion_o")


@query(
    "code_range_bucket",
    f"""WITH coded AS (SELECT p_partkey, CASE WHEN p_type = 'PROMO' AND p_size > 40 THEN ' '
        WHEN p_type = 'SMALL' THEN 'A1' WHEN p_type = 'LARGE' AND p_size = 1 THEN NULL
        ELSE lpad(CAST(p_size * 2 AS VARCHAR), 2, '0') || p_brand END AS code FROM part)
    SELECT p_partkey, code, {INDUSTRY_CASE.format(c="code")} AS industry FROM coded""",
)
def code_range_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, kind = F.col("p_size"), F.col("p_type")
    code = (
        F.when((kind == "PROMO") & (size > 40), " ")
        .when(kind == "SMALL", "A1")
        .when((kind == "LARGE") & (size == 1), F.lit(None))
        .otherwise(F.concat(F.lpad((size * 2).cast("string"), 2, "0"), F.col("p_brand")))
    )
    coded = table(spark, sf_dir, "part").select("p_partkey", code.alias("code"))
    return coded.withColumn("industry", recodes.industry_group(F.col("code")))


@query(
    "semester_bucket",
    """SELECT CASE WHEN CAST(o_orderdate AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1997-12-31'
      THEN CAST(year(o_orderdate) AS VARCHAR) || '-' || CASE WHEN month(o_orderdate) <= 6 THEN 'I' ELSE 'II' END END
      AS semester, count(*) AS n FROM orders GROUP BY 1""",
)
def semester_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    half = dates.semester_bucket(F.col("o_orderdate").cast("date"), 1996, 1997)
    return table(spark, sf_dir, "orders").groupBy(half.alias("semester")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "year_bucket",
    """SELECT CASE WHEN year(o_orderdate) BETWEEN 1996 AND 1998 THEN CAST(year(o_orderdate) AS VARCHAR) END AS year,
    count(*) AS n FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1995-06-01' AND DATE '2000-05-31' GROUP BY 1""",
)
def year_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    kept = table(spark, sf_dir, "orders").where(dates.in_period(day, "1995-06-01", "2000-05-31"))
    return kept.groupBy(dates.year_bucket(day, 1996, 1998).alias("year")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "nested_recode",
    f"""WITH {ASSOCIATE_CLIENTS_SQL}, {ASSOCIATE_MOVES_SQL}
    SELECT num_identificacion, semestre,
      CASE WHEN actividad_economica IS NULL THEN NULL WHEN actividad_economica = 'Independiente' THEN 'Otro'
           WHEN tipo_contrato IS NULL THEN NULL WHEN tipo_contrato = 'Término Indefinido' THEN 'Indefinido'
           ELSE 'Otro' END AS contract,
      CASE WHEN actividad_economica IS NULL THEN NULL WHEN actividad_economica = 'Asalariado' THEN 'Asalariado'
           ELSE 'Otro' END AS activity,
      CASE WHEN nivel_escolaridad IN ('Primaria', 'Bachillerato') THEN '01_Basico'
           WHEN nivel_escolaridad IN ('Tecnico', 'Tecnologia') THEN '02_Tecnologico'
           WHEN nivel_escolaridad = 'Universitario' THEN '03_Universitario'
           WHEN nivel_escolaridad IS NOT NULL THEN '04_Posgrado' END AS education,
      CASE WHEN sector_economico IN ('Sector Privado Esal', 'Sector Privado Financiero Solidario')
           THEN 'Sector Privado' ELSE sector_economico END AS sector,
      CASE WHEN estrato IN ('1', '2', '3') THEN estrato WHEN estrato IS NOT NULL THEN '4-5-6' END AS stratum
    FROM raw_clients""",
)
def nested_recode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return associate_clients(spark, sf_dir).select(
        "num_identificacion",
        "semestre",
        recodes.contract_group(F.col("tipo_contrato"), F.col("actividad_economica")).alias("contract"),
        recodes.activity_group(F.col("actividad_economica")).alias("activity"),
        recodes.education_level(F.col("nivel_escolaridad")).alias("education"),
        recodes.sector_group(F.col("sector_economico")).alias("sector"),
        recodes.stratum_group(F.col("estrato")).alias("stratum"),
    )


@query(
    "movement_recode",
    f"""WITH {ASSOCIATE_MOVES_SQL} SELECT CASE WHEN tipo_canal_transaccion = 'Físico' THEN 'Fisico'
    WHEN tipo_canal_transaccion IS NOT NULL THEN 'Electronico' END AS channel, CASE WHEN tipo_producto = 'CDT' THEN 'Ahorro' ELSE tipo_producto END AS product, count(*) AS n
    FROM raw_moves GROUP BY 1, 2""",
)
def movement_recode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        associate_moves(spark, sf_dir)
        .groupBy(
            recodes.channel_group(F.col("tipo_canal_transaccion")).alias("channel"),
            recodes.savings_product(F.col("tipo_producto")).alias("product"),
        )
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "income_compose",
    """SELECT c_custkey, coalesce(CASE WHEN c_acctbal >= 0 THEN c_acctbal END, 0) +
      coalesce(CASE WHEN c_nationkey > 4 THEN 100.5 END, 0) AS ingresos,
      CAST(NULL AS DOUBLE) AS egresos, coalesce(CASE WHEN c_acctbal < 0 THEN c_acctbal END, 0) AS activos,
      CAST(NULL AS DOUBLE) AS pasivos FROM customer""",
)
def income_compose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balance columns when only some sources exist: an absent source column gives null."""
    base = table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("ingresos_mens"),
        F.when(F.col("c_nationkey") > 4, F.lit(100.5)).alias("otros_ingresos"),
        F.when(F.col("c_acctbal") < 0, F.col("c_acctbal")).alias("total_activos"),
    )
    return con.replace_columns(base, populations.REPLACED, con.income_columns(base.columns))


@query(
    "age_tenure",
    """SELECT o_orderkey, CAST(floor(date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-12-31') / 365.0) AS INTEGER)
    AS years FROM orders""",
)
def age_tenure(spark: SparkSession, sf_dir: str) -> DataFrame:
    years = dates.years_between(F.col("o_orderdate").cast("date"), date(1998, 12, 31))
    return table(spark, sf_dir, "orders").select("o_orderkey", years.alias("years"))


@query(
    "in_place_update",
    """SELECT o_orderkey, o_orderstatus AS status_o, CASE WHEN lower(o_orderpriority) = '1-urgent' THEN 'U'
    ELSE o_orderstatus END AS o_orderstatus FROM orders""",
)
def in_place_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").withColumn("status_o", F.col("o_orderstatus"))
    urgent = F.lower("o_orderpriority") == "1-urgent"
    return con.update_where(rows, "o_orderstatus", urgent, F.lit("U")).select("o_orderkey", "status_o", "o_orderstatus")


@query(
    "align_missing_columns",
    """SELECT c_custkey AS key, c_name AS name, c_mktsegment AS segment, CAST(NULL AS VARCHAR) AS estado FROM customer
    UNION ALL SELECT s_suppkey, s_name, NULL, NULL FROM supplier""",
)
def align_missing_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")
    )
    firms = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"))
    return con.align_columns(con.stack_by_name(people, firms), {"key": "bigint", "estado": "string"})


@query(
    "key_difference",
    """SELECT key, 'left' AS side FROM (SELECT c_custkey AS key FROM customer EXCEPT SELECT o_custkey FROM orders
      WHERE o_totalprice > 100000)
    UNION ALL SELECT key, 'right' FROM (SELECT o_custkey AS key FROM orders WHERE o_totalprice > 100000
      EXCEPT SELECT c_custkey FROM customer)""",
)
def key_difference_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"))
    right = table(spark, sf_dir, "orders").where(F.col("o_totalprice") > 100000).select(F.col("o_custkey").alias("key"))
    return key_difference(left, right, "key")


@query(
    "predicate_filters",
    """SELECT l_orderkey, l_linenumber, abs(-l_extendedprice) AS amount FROM lineitem
    WHERE l_returnflag <> 'A' AND l_linestatus IN ('F') AND l_extendedprice > 0
      AND l_discount IS NOT NULL AND l_discount <> 0""",
)
def predicate_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = table(spark, sf_dir, "lineitem").where(
        (F.col("l_returnflag") != "A")
        & F.col("l_linestatus").isin("F")
        & (F.col("l_extendedprice") > 0)
        & F.col("l_discount").isNotNull()
        & (F.col("l_discount") != 0)
    )
    return kept.select("l_orderkey", "l_linenumber", F.abs(-F.col("l_extendedprice")).alias("amount"))


@query(
    "project_rename_range",
    """SELECT l_linenumber AS linea, l_orderkey AS pedido, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem""",
)
def project_rename_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key first, some columns renamed, a run of money columns by name."""
    money = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    rows = table(spark, sf_dir, "lineitem").select("l_linenumber", "l_orderkey", *money)
    return rows.withColumnsRenamed({"l_linenumber": "linea", "l_orderkey": "pedido"})


@query(
    "date_parts",
    """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, CAST(year(o_orderdate) AS INTEGER) AS year,
      strftime(o_orderdate, '%Y-%m') AS month,
      CASE WHEN o_orderpriority <> '5-LOW' THEN CAST(o_orderdate AS DATE) END AS dotted,
      CASE WHEN o_orderpriority <> '5-LOW' THEN CAST(o_orderdate AS DATE) END AS slashed FROM orders""",
)
def date_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates cast, split and parsed back from text; low-priority orders carry an impossible date text."""
    rows = table(spark, sf_dir, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("date"))
    low = F.col("o_orderpriority") == "5-LOW"
    day = dates.as_date(rows.schema, "o_orderdate")
    dotted = F.when(low, "31.02.2023").otherwise(F.date_format("o_orderdate", "dd.MM.yyyy"))
    slashed = F.when(low, "32/1/2023").otherwise(F.date_format("o_orderdate", "d/M/yyyy"))
    return rows.select(
        "o_orderkey",
        day.alias("day"),
        F.year(day).alias("year"),
        dates.month_key(day).alias("month"),
        dates.parse_dotted(dotted).alias("dotted"),
        dates.parse_day_month_year(slashed).alias("slashed"),
    )


@query(
    "label_text",
    """WITH c AS (SELECT n_name, c_mktsegment, count(*) AS n FROM nation JOIN customer ON n_nationkey = c_nationkey
      GROUP BY 1, 2)
    SELECT regexp_replace('/a/b/' || n_name || '.xlsx', '.*/', '') AS file_name,
      upper(substring(lower(n_name), 1, 1)) || substring(lower(n_name), 2) AS label,
      string_agg(CAST(n AS VARCHAR), ', ' ORDER BY c_mktsegment) AS customers FROM c GROUP BY n_name""",
)
def label_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names, labels, and the counts of each nation's few segments as one text."""
    people = table(spark, sf_dir, "customer")
    nations = table(spark, sf_dir, "nation")
    counts = people.groupBy("c_nationkey", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"))
    joined = counts.join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    grouped = joined.groupBy("n_name").agg(text.joined_counts(F.col("n"), F.col("c_mktsegment")).alias("customers"))
    path = F.concat(F.lit("/a/b/"), F.col("n_name"), F.lit(".xlsx"))
    return grouped.select(
        text.file_base_name(path).alias("file_name"),
        text.capitalise_label(F.lower("n_name")).alias("label"),
        "customers",
    )


@query(
    "log_and_power",
    """SELECT o_orderkey, round(ln(o_totalprice), 6) AS log_price,
      round((power(o_totalprice, 0.33) - 1) / 0.33, 4) AS power_price,
      o_totalprice / nullif(CAST(o_custkey AS DOUBLE), 0) AS ratio FROM orders""",
)
def log_and_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tamiz.operators.transform import boxcox

    price = F.col("o_totalprice")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.round(numbers.finite_log(price), 6).alias("log_price"),
        F.round(boxcox(price, 0.33), 4).alias("power_price"),
        numbers.safe_ratio(price, F.col("o_custkey")).alias("ratio"),
    )
