"""Queries that write raw files from the shared tables and read them back through the sources."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from tamiz.catalog.base import query, table
from tamiz.catalog.fixtures import encode_workbook, write_files, write_lines
from tamiz.catalog.standin import YEAR_SHIFT, shifted
from tamiz.operators.quality import row_counts
from tamiz.sources import delimited, sinks, workbook
from tamiz.session import scratch_path

# Orders as movement lines. Files of 2023 and 2025 hold lines that are too long (5-LOW) or too short (1-URGENT).
_MOVES_SQL = f"""WITH m AS (
  SELECT *, CAST(CAST(o_orderdate AS DATE) + INTERVAL {YEAR_SHIFT} YEAR AS DATE) AS day FROM orders),
f AS (SELECT *, 'Abonos_' || year(day) || '.txt' AS source_file, year(day) IN (2023, 2025) AS untidy FROM m),
rows AS (SELECT CAST(o_orderkey AS VARCHAR) AS num_ident,
    CASE WHEN o_orderpriority <> '2-HIGH' THEN day END AS fecha_transac, o_orderstatus AS tipo_transac,
    CASE WHEN o_orderstatus = 'F' THEN 'Ahorro' END AS tipo_prod, 'Fisico' AS tipo_canal, 'CALI' AS jurisdiccion,
    CASE WHEN o_orderpriority <> '3-MEDIUM' THEN o_totalprice END AS monto,
    CASE WHEN untidy AND o_orderpriority = '1-URGENT' THEN NULL ELSE 'E' END AS especie,
    CASE WHEN untidy AND o_orderpriority = '1-URGENT' THEN NULL ELSE '8' END AS nombre_prod,
    untidy AND o_orderpriority IN ('1-URGENT', '5-LOW') AS damaged, untidy, source_file,
    CASE WHEN year(day) <= 2024 THEN CAST(year(day) AS VARCHAR) ELSE '' END AS year, 'Abonos' AS transaction_type FROM f)
"""


def _move_files(spark: SparkSession, sf_dir: str) -> str:
    orders = table(spark, sf_dir, "orders").withColumn("day", shifted(F.col("o_orderdate")))
    untidy = F.year("day").isin(2023, 2025)
    priority, status = F.col("o_orderpriority"), F.col("o_orderstatus")
    head = [
        F.col("o_orderkey").cast("string"),
        F.when(priority == "2-HIGH", "31/02/2023").otherwise(F.date_format("day", "d/M/yyyy")),
        status,
        F.when(status == "F", "Ahorro").otherwise(""),
        F.lit("Fisico"),
        F.lit("CALI"),
        F.when(priority == "3-MEDIUM", "abc").otherwise(F.col("o_totalprice").cast("string")),
    ]
    tail = (
        F.when(untidy & (priority == "1-URGENT"), "")
        .when(untidy & (priority == "5-LOW"), "|E|8|more")
        .otherwise("|E|8")
    )
    lines = orders.select(
        F.concat(F.concat_ws("|", *head), tail).alias("line"),
        F.concat(F.lit("Abonos_"), F.year("day").cast("string"), F.lit(".txt")).alias("src"),
    )
    return write_lines(lines, "|".join(delimited.MOVE_COLUMNS), "moves")


@query("delimited_ingest", f"{_MOVES_SQL} SELECT * EXCLUDE (untidy) FROM rows")
def delimited_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delimited.read_moves(spark, _move_files(spark, sf_dir))


@query(
    "delimited_ingest_fallback",
    f"{_MOVES_SQL} SELECT * EXCLUDE (untidy) REPLACE (CASE WHEN NOT untidy THEN fecha_transac END AS fecha_transac) FROM rows",
)
def delimited_ingest_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delimited.read_moves_or_fallback(spark, _move_files(spark, sf_dir))


_CLIENTS_SQL = """WITH c AS (
  SELECT *, CASE WHEN c_nationkey < 12 THEN '2023' ELSE '2024' END AS year, c_mktsegment = 'FURNITURE' AS wrong FROM customer),
rows AS (SELECT 'N' || c_nationkey AS oficina, 'Nit' AS tipo_documento, c_name AS documento, '0111' AS ciiu,
  c_mktsegment AS ocupacion, c_acctbal AS ingresos_mens, CAST(NULL AS DOUBLE) AS egresos_mens, 1.5 AS otros_ingresos,
  CAST(c_custkey AS DOUBLE) AS total_activos, 2.0 AS total_pasivos, 3.0 AS valor_patrimoni, 'A' AS estado,
  'Base Clientes_' || year || '.txt' AS source_file, year, wrong FROM c)
"""


def _client_files(spark: SparkSession, sf_dir: str, narrow: bool) -> str:
    """Client lines of 13 columns; one segment's lines are cut short, and ``narrow`` adds a file of few columns."""
    people = table(spark, sf_dir, "customer")
    year = F.when(F.col("c_nationkey") < 12, "2023").otherwise("2024")
    head = [
        F.concat(F.lit("N"), F.col("c_nationkey").cast("string")), F.lit("Nit"), F.col("c_name"), F.lit("0111"),
        F.col("c_mktsegment"), F.col("c_acctbal").cast("string"), F.lit("n/a"), F.lit("1.5"),
        F.col("c_custkey").cast("string"), F.lit("2"), F.lit("3"),
    ]
    tail = F.when(F.col("c_mktsegment") == "FURNITURE", "").otherwise("|A|x")
    lines = people.select(
        F.concat(F.concat_ws("|", *head), tail).alias("line"),
        F.concat(F.lit("Base Clientes_"), year, F.lit(".txt")).alias("src"),
    )
    if narrow:
        few = people.select(F.concat_ws("|", "c_name", "c_mktsegment").alias("line"), F.lit("Base Clientes_2022.txt").alias("src"))
        lines = lines.unionByName(few)
    header = "|".join(f"Campo {i}" for i in range(1, 14))
    return write_lines(lines, header, "clients")


@query("delimited_clients", f"{_CLIENTS_SQL} SELECT * EXCLUDE (wrong) FROM rows WHERE NOT wrong")
def delimited_clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thirteen columns bound by position; short lines left out."""
    return delimited.read_clients(spark, _client_files(spark, sf_dir, narrow=False))


@query(
    "delimited_clients_padded",
    f"{_CLIENTS_SQL} SELECT * EXCLUDE (wrong) REPLACE (CASE WHEN NOT wrong THEN estado END AS estado) FROM rows",
)
def delimited_clients_padded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short lines padded; a file of too few columns left out."""
    people = table(spark, sf_dir, "customer")
    path = _client_files(spark, sf_dir, narrow=False)
    few = people.select(F.concat_ws("|", "c_name", "c_mktsegment").alias("line"))
    few.write.text(f"{path}/src=Base Clientes_2022.txt")
    return delimited.read_clients_padded(spark, path)


# One folder: client files of 11 to 14 columns, in which one segment's lines lack a column, and two files of movements.
_FOLDER_SQL = """WITH c AS (
  SELECT *, 11 + c_nationkey % 4 AS columns, CAST(2022 + c_nationkey % 4 AS VARCHAR) AS y, c_mktsegment = 'FURNITURE' AS wrong FROM customer),
rows AS (SELECT *, 'Base Clientes_' || y || '.txt' AS source_file, CASE WHEN y = '2025' THEN '' ELSE y END AS year FROM c)
"""


def _folder(spark: SparkSession, sf_dir: str) -> str:
    people = table(spark, sf_dir, "customer")
    extra = F.col("c_nationkey") % 4
    head = [
        F.concat(F.lit("N"), F.col("c_nationkey").cast("string")), F.lit("Nit"), F.col("c_name"), F.lit("0111"),
        F.col("c_mktsegment"), F.col("c_acctbal").cast("string"), F.lit("n/a"), F.lit("1.5"),
        F.col("c_custkey").cast("string"), F.lit("2"),
    ]
    tail = F.array(F.lit("3"), F.lit("A"), F.lit("x"), F.lit("y"))
    n_tail = extra + F.when(F.col("c_mktsegment") == "FURNITURE", 0).otherwise(1)
    clients = people.select(
        F.concat(F.lit("Base Clientes_"), (2022 + extra).cast("string"), F.lit(".txt")).alias("file"),
        F.col("c_custkey").cast("long").alias("nth"), F.array_join(F.concat(F.array(*head), F.slice(tail, F.lit(1), n_tail)), "|").alias("line"),
    )
    kind = F.when(F.col("o_orderkey") % 2 == 0, "Abonos_2023.txt").otherwise("Retiros_2024.txt").alias("file")
    fields = [
        F.col("o_orderkey").cast("string"), F.lit("7/3/2023"), F.col("o_orderstatus"), F.lit("Ahorro"), F.lit("Fisico"), F.lit("CALI"),
        F.col("o_totalprice").cast("string"), F.lit("E"), F.lit("8"),
    ]
    moves = table(spark, sf_dir, "orders").select(kind, F.col("o_orderkey").cast("long").alias("nth"), F.concat_ws("|", *fields).alias("line"))
    headers = [(f"Base Clientes_{2022 + e}.txt", -1, "|".join(f"Campo {i}" for i in range(1, 12 + e))) for e in range(4)]
    headers += [(f, -1, "|".join(delimited.MOVE_COLUMNS)) for f in ("Abonos_2023.txt", "Retiros_2024.txt")]
    first = spark.createDataFrame(headers, "file string, nth long, line string")
    return write_files(clients.unionByName(moves).unionByName(first), "folder")


@query(
    "folder_clients",
    f"""{_FOLDER_SQL} SELECT 'N' || c_nationkey AS oficina, 'Nit' AS tipo_documento, c_name AS documento, '0111' AS ciiu,
      c_mktsegment AS ocupacion, c_acctbal AS ingresos_mens, CAST(NULL AS DOUBLE) AS egresos_mens, 1.5 AS otros_ingresos,
      CAST(c_custkey AS DOUBLE) AS total_activos, 2.0 AS total_pasivos, 3.0 AS valor_patrimoni, 'A' AS estado, source_file, year
    FROM rows WHERE columns >= 12 AND NOT wrong""",
)
def folder_clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delimited.read_folder(spark, _folder(spark, sf_dir))[0]


@query(
    "folder_moves",
    """SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'Abonos' ELSE 'Retiros' END AS transaction_type,
      CASE WHEN o_orderkey % 2 = 0 THEN 'Abonos_2023.txt' ELSE 'Retiros_2024.txt' END AS source_file, CAST(o_orderkey AS VARCHAR) AS num_ident,
      DATE '2023-03-07' AS fecha_transac, o_orderstatus AS tipo_transac, o_totalprice AS monto FROM orders""",
)
def folder_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of the same folder that are not client files."""
    moves = delimited.read_folder(spark, _folder(spark, sf_dir))[1]
    return moves.select("transaction_type", "source_file", "num_ident", "fecha_transac", "tipo_transac", "monto")


@query(
    "folder_rejects",
    f"""{_FOLDER_SQL} SELECT source_file, columns, CASE WHEN wrong THEN columns - 1 ELSE columns END AS width,
      CASE WHEN columns < 12 THEN 'file below twelve columns' ELSE 'line of another width' END AS reason, count(*) AS lines
    FROM rows WHERE columns < 12 OR wrong GROUP BY ALL""",
)
def folder_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the folder load leaves out, by file and reason."""
    path = _folder(spark, sf_dir)
    return delimited.rejected_clients(spark, path, f"*{delimited.CLIENT_FILE_MARK}*.txt")


_BOOK_ROWS = 2000  # customers per workbook: keys are unique, so a workbook never grows beyond this


def _workbooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Semester workbooks of customers and a movement sheet, built by Spark, one per block of customer keys."""
    people = table(spark, sf_dir, "customer").withColumn("book", F.floor(F.col("c_custkey") / _BOOK_ROWS))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        book = int(pdf["book"].iloc[0])
        day = pd.Timestamp("2023-02-28").date()
        clients = [["NUM_IDENTIFICACION", "FECHA_INGRESO", "SALARIO_ACTUAL", "ROL"]]
        moves = [["MONTO_TRANSACCION", "FECHA_TRANSACCION", "NUM_IDENTIFICACION"]]
        for name, balance, segment in zip(pdf["c_name"], pdf["c_acctbal"], pdf["c_mktsegment"]):
            clients.append([name, day, balance if balance >= 0 else "n/a", segment])
            moves.append([balance, "28.02.2023" if segment == "BUILDING" else day, name])
        content = encode_workbook({"InformaciónCliente": clients, "Movimientos": moves})
        return pd.DataFrame({"path": [f"/in/base{book}_2023-II.xlsx"], "content": [content]})

    return people.groupBy("book").applyInPandas(build, "path string, content binary")


@query(
    "sheet_ingest",
    f"""SELECT c_name AS num_identificacion, DATE '2023-02-28' AS fecha_ingreso,
      CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS salario_actual, c_mktsegment AS rol, CAST(NULL AS VARCHAR) AS estrato,
      'base' || CAST(c_custkey // {_BOOK_ROWS} AS VARCHAR) || '_2023-II.xlsx' AS source_file, '2023-II' AS semestre
    FROM customer""",
)
def sheet_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Client sheets bound by header; a header that no workbook has gives nulls."""
    headers = ["NUM_IDENTIFICACION", "FECHA_INGRESO", "SALARIO_ACTUAL", "ROL", "ESTRATO"]
    return workbook.read_typed_sheet(_workbooks(spark, sf_dir), workbook.CLIENT_SHEET, workbook.CLIENT_TYPES, headers)


@query(
    "sheet_ingest_movements",
    """SELECT c_name AS num_identificacion, DATE '2023-02-28' AS fecha_transaccion, c_acctbal AS monto_transaccion,
    '2023-II' AS semestre FROM customer""",
)
def sheet_ingest_movements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Movement sheets whose dates are date cells in some rows and dotted text in others."""
    headers = ["NUM_IDENTIFICACION", "FECHA_TRANSACCION", "MONTO_TRANSACCION"]
    rows = workbook.read_typed_sheet(_workbooks(spark, sf_dir), workbook.MOVE_SHEET, workbook.MOVE_TYPES, headers)
    return rows.drop("source_file")


@query(
    "multi_dataset_export",
    """SELECT 'clients' AS table_name, count(*) AS row_count FROM customer
    UNION ALL SELECT 'moves', count(*) FROM orders""",
)
def multi_dataset_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two datasets written below one root and counted from what was written."""
    tables = {"clients": table(spark, sf_dir, "customer"), "moves": table(spark, sf_dir, "orders")}
    paths = sinks.export(tables, scratch_path(spark, "export"))
    return row_counts({name: spark.read.parquet(path) for name, path in paths.items()})
