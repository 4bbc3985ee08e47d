"""The shared test tables seen as incidents, inhabitants, clients and movements.

Customers are clients, line items with their order are movements and incidents, nations
are places. Every row of the tables is used; the SQL fragments say the same in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tamiz.catalog.base import table

YEAR_SHIFT = 27  # order years 1995.. become 2022..

# Place spellings by nation key: 25 nations.
PLACE_OF_NATION = (
    "Bogotá D.C.", "MEDELLIN", " cali ", "Ibagu?", "Cúcuta", "España", "ESTADOS UNIDOS", "#N/D", "Leticia",
    "Girón", "Barranquilla", "san gil", "PERÚ", "panamá", "Neiva", "Cartagena", "Pereira", "Alemania",
    "Villavicencio", "BARRANCABERMEJA", "México", "Tunja", "bucaramanga", "Armenia", "Curaçao",
)
DEPARTMENT_OF_NATION = (
    "Bogota, D.C.", "Antioquia", "Valle del Cauca", "Tolima", "NORTE DE SANTANDER", "La Guajira", "ATLÁNTICO",
    "Archipiélago de San Andrés, Providencia", "Amazonas", "Santander", "BOLÍVAR", "Boyacá", "Caldas", "Caquetá",
    "Huila", "Cauca", "Risaralda", "César", "META", "Chocó", "CÓRDOBA", "Nariño", "Sucre", "QUINDÍO", "Arauca",
)
SECTORS = {
    "AUTOMOBILE": "Sector Privado Esal",
    "BUILDING": "Sector Publico Educacion",
    "FURNITURE": "Sector Publico Salud",
    "HOUSEHOLD": "Sector Privado",
    "MACHINERY": "Sector Publico Pensionado",
}


def _pick(names, key):
    return F.element_at(F.array(*[F.lit(n) for n in names]), key + 1)


def _sql_list(names) -> str:
    return "[" + ", ".join("'" + n.replace("'", "''") + "'" for n in names) + "]"


def _customer_name(key):
    """``customer#`` and the key in nine digits; what has no more than nine needs no formatter, which is slow."""
    plain = F.concat(F.lit("customer#"), F.lpad(key.cast("string"), 9, "0"))
    return F.when(key.between(0, 999_999_999), plain).otherwise(F.format_string("customer#%09d", key))


def shifted(c):
    return F.add_months(c.cast("date"), 12 * YEAR_SHIFT)


def incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One incident per line item, in the department of the customer's nation."""
    items = table(spark, sf_dir, "lineitem", spread=True).select("l_orderkey", "l_shipdate", "l_quantity")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    joined = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(
        customers, F.col("o_custkey") == F.col("c_custkey")
    )
    return joined.select(
        _pick(DEPARTMENT_OF_NATION, F.col("c_nationkey")).alias("departamento"),
        F.when(F.col("c_nationkey") == 8, "Bogotá D.C. (CT)").otherwise("Otro").alias("municipio"),
        shifted(F.col("l_shipdate")).alias("fecha"),
        F.col("l_quantity").cast("int").alias("cantidad"),
    )


def population(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inhabitants: customers of the nation, in every year; nation 21 has no whole-area row."""
    customers = table(spark, sf_dir, "customer").select("c_nationkey")
    return customers.select(
        _pick(DEPARTMENT_OF_NATION, F.col("c_nationkey")).alias("departamento"),
        F.explode(F.array(*[F.lit(y) for y in (2022, 2023, 2024)])).alias("anio"),
        F.when(F.col("c_nationkey") == 21, "Cabecera").otherwise("Total").alias("area_geografica"),
        F.lit(1000).alias("total"),
    )


INCIDENTS_SQL = f"""
incidents AS (
  SELECT {_sql_list(DEPARTMENT_OF_NATION)}[c_nationkey + 1] AS departamento,
         CASE WHEN c_nationkey = 8 THEN 'Bogotá D.C. (CT)' ELSE 'Otro' END AS municipio,
         CAST(CAST(l_shipdate AS DATE) + INTERVAL {YEAR_SHIFT} YEAR AS DATE) AS fecha,
         CAST(l_quantity AS INTEGER) AS cantidad
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
),
population AS (
  SELECT {_sql_list(DEPARTMENT_OF_NATION)}[c_nationkey + 1] AS departamento, anio,
         CASE WHEN c_nationkey = 21 THEN 'Cabecera' ELSE 'Total' END AS area_geografica, 1000 AS total
  FROM customer, (VALUES (2022), (2023), (2024)) AS y(anio)
)"""


def clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two yearly rows per customer, the second with updated income."""
    base = table(spark, sf_dir, "customer")
    nation = F.col("c_nationkey")
    version = F.explode(F.array(F.lit("2023"), F.lit("2024"))).alias("year")
    rows = base.select("*", version)
    newest = F.col("year") == "2024"
    return rows.select(
        F.concat(F.lit("N"), nation.cast("string")).alias("oficina"),
        F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), "Nit").otherwise("Cedula").alias("tipo_documento"),
        F.concat(F.lit(" "), F.upper("c_name")).alias("documento"),
        F.when(nation == 24, F.lit(None))
        .when(nation == 23, F.lit("A1"))
        .otherwise(F.concat(F.lpad((nation * 4).cast("string"), 2, "0"), F.lit("10")))
        .alias("ciiu"),
        F.col("c_mktsegment").alias("ocupacion"),
        F.when(newest, F.col("c_acctbal")).otherwise(F.lit(1.0)).alias("ingresos_mens"),
        (F.col("c_acctbal") * 0.5).alias("egresos_mens"),
        F.when(F.col("c_acctbal") >= 0, F.lit(10.5)).alias("otros_ingresos"),
        (F.col("c_acctbal") + F.col("c_custkey")).alias("total_activos"),
        F.when(nation != 3, F.col("c_acctbal") * 0.25).alias("total_pasivos"),
        F.lit(0.0).alias("valor_patrimoni"),
        F.when(F.col("c_acctbal") < 0, "I").otherwise("A").alias("estado"),
        F.concat_ws("_", F.lit("Base Clientes"), F.concat(F.col("year"), F.lit(".txt"))).alias("source_file"),
        "year",
    )


CLIENTS_SQL = """
raw_clients AS (
  SELECT 'N' || c_nationkey AS oficina,
         CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'Nit' ELSE 'Cedula' END AS tipo_documento,
         ' ' || upper(c_name) AS documento,
         CASE WHEN c_nationkey = 24 THEN NULL WHEN c_nationkey = 23 THEN 'A1'
              ELSE lpad(CAST(c_nationkey * 4 AS VARCHAR), 2, '0') || '10' END AS ciiu,
         c_mktsegment AS ocupacion,
         CASE WHEN y.year = '2024' THEN c_acctbal ELSE 1.0 END AS ingresos_mens,
         c_acctbal * 0.5 AS egresos_mens,
         CASE WHEN c_acctbal >= 0 THEN 10.5 END AS otros_ingresos,
         c_acctbal + c_custkey AS total_activos,
         CASE WHEN c_nationkey <> 3 THEN c_acctbal * 0.25 END AS total_pasivos,
         0.0 AS valor_patrimoni,
         CASE WHEN c_acctbal < 0 THEN 'I' ELSE 'A' END AS estado,
         'Base Clientes_' || y.year || '.txt' AS source_file, y.year AS year
  FROM customer, (VALUES ('2023'), ('2024')) AS y(year)
)"""


def moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One movement per line item; no discount stands for a zero amount, no tax for a missing one."""
    items = table(spark, sf_dir, "lineitem", spread=True).select(
        "l_orderkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
        "l_returnflag", "l_linestatus", "l_shipdate",
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    joined = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(
        suppliers, F.col("l_suppkey") == F.col("s_suppkey")
    )
    flow = F.when(F.col("l_linestatus") == "F", "Ingreso").otherwise("Egreso")
    sign = F.when(F.col("l_linestatus") == "F", F.lit(1.0)).otherwise(F.lit(-1.0))
    amount = (
        F.when(F.col("l_discount") == 0, F.lit(0.0))
        .when(F.col("l_tax") == 0, F.lit(None))
        .otherwise(F.col("l_extendedprice") * sign)
    )
    return joined.select(
        _customer_name(F.col("o_custkey")).alias("num_ident"),
        shifted(F.col("l_shipdate")).alias("fecha_transac"),
        flow.alias("tipo_transac"),
        F.when(F.col("l_returnflag") == "A", "Ahorro")
        .when(F.col("l_returnflag") == "N", "Credito")
        .otherwise("CDT")
        .alias("tipo_prod"),
        F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "Virtual").otherwise("Fisico").alias("tipo_canal"),
        _pick(PLACE_OF_NATION, F.col("s_nationkey")).alias("jurisdiccion"),
        amount.alias("monto"),
        F.col("o_orderpriority").alias("especie"),
        F.when(F.col("l_quantity") < 50, F.col("l_quantity").cast("int").cast("string")).alias("nombre_prod"),
        F.lit("Movimientos_2024.txt").alias("source_file"),
        F.lit("2024").alias("year"),
        F.lit("Movimientos").alias("transaction_type"),
    )


MOVES_SQL = f"""
raw_moves AS (
  SELECT 'customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') AS num_ident,
         CAST(CAST(l_shipdate AS DATE) + INTERVAL {YEAR_SHIFT} YEAR AS DATE) AS fecha_transac,
         CASE WHEN l_linestatus = 'F' THEN 'Ingreso' ELSE 'Egreso' END AS tipo_transac,
         CASE l_returnflag WHEN 'A' THEN 'Ahorro' WHEN 'N' THEN 'Credito' ELSE 'CDT' END AS tipo_prod,
         CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'Virtual' ELSE 'Fisico' END AS tipo_canal,
         {_sql_list(PLACE_OF_NATION)}[s_nationkey + 1] AS jurisdiccion,
         CASE WHEN l_discount = 0 THEN 0.0 WHEN l_tax = 0 THEN NULL
              ELSE l_extendedprice * CASE WHEN l_linestatus = 'F' THEN 1.0 ELSE -1.0 END END AS monto,
         o_orderpriority AS especie,
         CASE WHEN l_quantity < 50 THEN CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) END AS nombre_prod,
         'Movimientos_2024.txt' AS source_file, '2024' AS year, 'Movimientos' AS transaction_type
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey
)"""


def associate_clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two semester rows per customer."""
    rows = table(spark, sf_dir, "customer").select(
        "*", F.explode(F.array(F.lit("2023-II"), F.lit("2024-I"))).alias("semestre")
    )
    seg, nation, balance = F.col("c_mktsegment"), F.col("c_nationkey"), F.col("c_acctbal")
    sector = F.create_map(*[F.lit(x) for kv in SECTORS.items() for x in kv])
    return rows.select(
        F.concat(F.upper("c_name"), F.lit(" ")).alias("num_identificacion"),
        F.when(nation == 7, "Empleado").otherwise("Asociado").alias("rol"),
        F.when(nation < 10, "Término Indefinido").when(nation < 20, "Temporal").alias("tipo_contrato"),
        F.when(nation == 2, F.lit(None)).when(nation < 6, "Independiente").otherwise("Asalariado").alias(
            "actividad_economica"
        ),
        F.element_at(sector, seg).alias("sector_economico"),
        F.when(nation < 5, "Primaria").when(nation < 12, "Tecnologia").when(nation == 13, F.lit(None)).when(
            nation < 20, "Universitario"
        ).otherwise("Maestria").alias("nivel_escolaridad"),
        F.when(nation != 17, (nation / 4).cast("int").cast("string")).alias("estrato"),
        balance.alias("salario_actual"),
        F.when(nation != 11, F.lit(7.25)).alias("otros_ingresos"),
        (balance * 0.5).alias("egresos"),
        (balance + 1000).alias("activos"),
        (balance * 0.25).alias("pasivos"),
        F.lit("1980-02-29").cast("date").alias("fecha_nacimiento"),
        F.lit("2010-01-01").cast("date").alias("fecha_ingreso"),
        "semestre",
        F.concat_ws("_", F.lit("base"), F.concat(F.col("semestre"), F.lit(".xlsx"))).alias("source_file"),
    )


ASSOCIATE_CLIENTS_SQL = f"""
raw_clients AS (
  SELECT upper(c_name) || ' ' AS num_identificacion,
         CASE WHEN c_nationkey = 7 THEN 'Empleado' ELSE 'Asociado' END AS rol,
         CASE WHEN c_nationkey < 10 THEN 'Término Indefinido' WHEN c_nationkey < 20 THEN 'Temporal' END AS tipo_contrato,
         CASE WHEN c_nationkey = 2 THEN NULL WHEN c_nationkey < 6 THEN 'Independiente' ELSE 'Asalariado' END
           AS actividad_economica,
         CASE c_mktsegment {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SECTORS.items())} END AS sector_economico,
         CASE WHEN c_nationkey < 5 THEN 'Primaria' WHEN c_nationkey < 12 THEN 'Tecnologia' WHEN c_nationkey = 13 THEN NULL
              WHEN c_nationkey < 20 THEN 'Universitario' ELSE 'Maestria' END AS nivel_escolaridad,
         CASE WHEN c_nationkey <> 17 THEN CAST(c_nationkey // 4 AS VARCHAR) END AS estrato,
         c_acctbal AS salario_actual, CASE WHEN c_nationkey <> 11 THEN 7.25 END AS otros_ingresos,
         c_acctbal * 0.5 AS egresos, c_acctbal + 1000 AS activos, c_acctbal * 0.25 AS pasivos,
         s.semestre AS semestre, 'base_' || s.semestre || '.xlsx' AS source_file
  FROM customer, (VALUES ('2023-II'), ('2024-I')) AS s(semestre)
)"""


def associate_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One movement per order; pending orders carry a non-positive amount."""
    orders = table(spark, sf_dir, "orders")
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    return orders.select(
        _customer_name(F.col("o_custkey")).alias("num_identificacion"),
        shifted(F.col("o_orderdate")).alias("fecha_transaccion"),
        F.when(priority.isin("1-URGENT", "5-LOW"), "Credito").otherwise("Ahorro").alias("tipo_producto"),
        F.when(status == "F", "Ingreso").otherwise("Egreso").alias("tipo_transaccion"),
        F.when(priority.isin("2-HIGH", "5-LOW"), "Físico").when((status != "P") | (priority != "4-NOT SPECIFIED"), "Web").alias(
            "tipo_canal_transaccion"
        ),
        F.when((status == "P") & (priority == "3-MEDIUM"), -F.col("o_totalprice"))
        .otherwise(F.col("o_totalprice"))
        .alias("monto_transaccion"),
        F.lit("2024-I").alias("semestre"),
        F.lit("/in/base_2024-I.xlsx").alias("source_file"),
    )


ASSOCIATE_MOVES_SQL = f"""
raw_moves AS (
  SELECT 'customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') AS num_identificacion,
         CAST(CAST(o_orderdate AS DATE) + INTERVAL {YEAR_SHIFT} YEAR AS DATE) AS fecha_transaccion,
         CASE WHEN o_orderpriority IN ('1-URGENT', '5-LOW') THEN 'Credito' ELSE 'Ahorro' END AS tipo_producto,
         CASE WHEN o_orderstatus = 'F' THEN 'Ingreso' ELSE 'Egreso' END AS tipo_transaccion,
         CASE WHEN o_orderpriority IN ('2-HIGH', '5-LOW') THEN 'Físico'
              WHEN o_orderstatus <> 'P' OR o_orderpriority <> '4-NOT SPECIFIED' THEN 'Web' END AS tipo_canal_transaccion,
         CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '3-MEDIUM' THEN -o_totalprice ELSE o_totalprice END
           AS monto_transaccion,
         '2024-I' AS semestre, '/in/base_2024-I.xlsx' AS source_file
  FROM orders
)"""
