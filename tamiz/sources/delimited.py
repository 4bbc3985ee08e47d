"""Pipe-delimited client and movement files, many at a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tamiz.functions.dates import parse_day_month_year
from tamiz.functions.numbers import to_double
from tamiz.functions.text import prefix_of_name, year_in_name
from tamiz.session import keep_small

# File columns in order.
CLIENT_COLUMNS = (
    "oficina", "tipo_documento", "documento", "ciiu", "ocupacion", "ingresos_mens", "egresos_mens",
    "otros_ingresos", "total_activos", "total_pasivos", "valor_patrimoni", "estado",
)
CLIENT_NUMBERS = CLIENT_COLUMNS[5:11]
MOVE_COLUMNS = (
    "num_ident", "fecha_transac", "tipo_transac", "tipo_prod", "tipo_canal", "jurisdiccion", "monto", "especie",
    "nombre_prod",
)
CLIENT_FILE_MARK = "Base Clientes"
DAMAGED = "_damaged"


def source_name(path: Column) -> Column:
    """The input a row came from: the file, or the folder when Spark wrote it as part files."""
    whole = F.url_decode(F.regexp_replace(path, r"\+", "%2B"))
    named = F.regexp_replace(whole, r"/part-[^/]*$", "")
    return F.regexp_replace(F.regexp_extract(named, r"([^/]+)$", 1), "^[^=]*=", "")


def with_provenance(df: DataFrame, kind: bool = False) -> DataFrame:
    """Add ``source_file`` and ``year``, for movements also ``transaction_type``, from the file path."""
    named = df.withColumn("source_file", source_name(F.col("_path"))).drop("_path")
    out = named.withColumn("year", year_in_name(F.col("source_file")))
    return out.withColumn("transaction_type", prefix_of_name(F.col("source_file"))) if kind else out


def _scan(spark: SparkSession, path: str, columns: tuple[str, ...], mode: str, pattern: str | None) -> DataFrame:
    schema = ", ".join(f"`{c}` string" for c in columns)
    reader = spark.read.option("sep", "|").option("header", True).option("mode", mode).option("columnPruning", False)
    reader = reader.option("recursiveFileLookup", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if mode == "PERMISSIVE":
        schema += f", `{DAMAGED}` string"
        reader = reader.option("columnNameOfCorruptRecord", DAMAGED)
    return reader.schema(schema).csv(path)


def header_names(spark: SparkSession, path: str, pattern: str | None = None) -> list[str]:
    """Column names of a file, read from its first line."""
    reader = spark.read.option("sep", "|").option("header", True).option("recursiveFileLookup", True)
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).csv(path).columns


def narrow_files(spark: SparkSession, path: str, least: int, pattern: str | None = None) -> DataFrame:
    """``source_file, columns`` of the files whose widest line has fewer than ``least`` columns."""
    reader = spark.read.option("recursiveFileLookup", True)
    lines = (reader.option("pathGlobFilter", pattern) if pattern else reader).text(path)
    widths = lines.select(source_name(F.col("_metadata.file_path")).alias("source_file"), F.size(F.split("value", r"\|")).alias("w"))
    return widths.groupBy("source_file").agg(F.max("w").alias("columns")).where(F.col("columns") < least)


def _lines(spark: SparkSession, path: str, pattern: str | None) -> DataFrame:
    """``value, _path, _start, _width`` of every line that is not blank; a separator inside quotes does not count."""
    reader = spark.read.option("recursiveFileLookup", True)
    lines = (reader.option("pathGlobFilter", pattern) if pattern else reader).text(path)
    width = F.size(F.split(F.regexp_replace("value", '"[^"]*"', ""), r"\|"))
    return lines.where(F.trim("value") != "").select(
        "value", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_start"), width.alias("_width")
    )


def file_headers(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """``_path, header, columns``: the first line of each file and its number of columns."""
    first = _lines(spark, path, pattern).where("_start = 0").withColumn("_row", F.monotonically_increasing_id())
    head = first.groupBy("_path").agg(F.min_by(F.struct("value", "_width"), "_row").alias("h"))
    return head.select("_path", F.col("h.value").alias("header"), F.col("h._width").alias("columns"))


def _judged_clients(spark: SparkSession, path: str, pattern: str | None) -> DataFrame:
    """Data lines with ``reason``: why a line is left out, judged by its own file's header; null if it stays.

    Headers are one row per file and go to the lines, which stay where they are read, up to the checked size. Each line that
    equals its file's header is taken for a header, as in files put together from several.
    """
    headers = keep_small(file_headers(spark, path, pattern))
    rows = _lines(spark, path, pattern).join(headers, "_path").where("value <> header")
    narrow = F.when(F.col("columns") < len(CLIENT_COLUMNS), "file below twelve columns")
    return rows.withColumn("reason", F.coalesce(narrow, F.when(F.col("_width") != F.col("columns"), "line of another width")))


def read_clients(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """Clients with the first twelve columns bound by position, each file by its own header.

    Lines of another width than their header and files below twelve columns are left out; ``rejected_clients`` counts them.
    """
    schema = ", ".join(f"{c} string" for c in CLIENT_COLUMNS)
    kept = _judged_clients(spark, path, pattern).where("reason IS NULL")
    rows = kept.select(F.from_csv("value", schema, {"sep": "|"}).alias("r"), "_path").select("r.*", "_path")
    return with_provenance(rows.withColumns({c: to_double(F.col(c)) for c in CLIENT_NUMBERS}))


def rejected_clients(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """``source_file, columns, width, reason, lines``: what ``read_clients`` left out, with the header's and the lines' width."""
    out = _judged_clients(spark, path, pattern).where("reason IS NOT NULL")
    names = [source_name(F.col("_path")).alias("source_file"), "columns", F.col("_width").alias("width"), "reason"]
    return out.groupBy(*names).agg(F.count(F.lit(1)).alias("lines"))


def read_clients_padded(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """As ``read_clients`` for untidy files: short lines are padded, files below twelve columns left out."""
    rows = _scan(spark, path, CLIENT_COLUMNS, "PERMISSIVE", pattern)
    rows = rows.select(*CLIENT_COLUMNS, F.col("_metadata.file_path").alias("_path"))
    typed = with_provenance(rows.withColumns({c: to_double(F.col(c)) for c in CLIENT_NUMBERS}))
    narrow = keep_small(narrow_files(spark, path, len(CLIENT_COLUMNS), pattern))
    return typed.join(narrow, "source_file", "left_anti").select(*CLIENT_COLUMNS, "source_file", "year")


def _typed_moves(rows: DataFrame, day: Column) -> DataFrame:
    blank = {c: F.nullif(F.col(c), F.lit("")) for c in MOVE_COLUMNS}
    return rows.withColumns(blank).withColumns({"fecha_transac": day, "monto": to_double(F.col("monto"))})


def read_moves(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """Movements: empty text is missing, ``day/month/year`` dates, failed numbers and dates missing.

    Rows of a damaged line keep what could be read and say so in ``damaged``.
    """
    rows = _scan(spark, path, MOVE_COLUMNS, "PERMISSIVE", pattern)
    # Spark refuses a scan of the damage mark alone, so the test also reads the first column.
    damaged = F.col(DAMAGED).isNotNull() & (F.length(F.coalesce("num_ident", F.lit(""))) >= 0)
    rows = rows.select(*MOVE_COLUMNS, damaged.alias("damaged"), F.col("_metadata.file_path").alias("_path"))
    return with_provenance(_typed_moves(rows, parse_day_month_year(F.col("fecha_transac"))), kind=True)


def read_moves_or_fallback(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """As ``read_moves``, but a file with any damaged line is loaded the lenient way: all its dates are missing."""
    rows = read_moves(spark, path, pattern)
    bad = rows.groupBy("source_file").agg(F.max("damaged").alias("bad")).where("bad").select("source_file", "bad")
    joined = rows.join(keep_small(bad), "source_file", "left")
    lenient = F.when(F.col("bad").isNull(), F.col("fecha_transac"))
    return joined.withColumn("fecha_transac", lenient).drop("bad").select(*rows.columns)


def read_folder(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Clients and movements of one folder of text files, told apart by file name."""
    clients = read_clients(spark, path, f"*{CLIENT_FILE_MARK}*.txt")
    moves = read_moves_or_fallback(spark, path, "*.txt")
    return clients, moves.where(~F.col("source_file").contains(CLIENT_FILE_MARK))
