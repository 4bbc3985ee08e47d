"""Workbook sheets, many files in one job. A sheet holds at most 1,048,576 rows, so one task per file is bounded."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator, Mapping
from datetime import datetime, timedelta
from xml.etree.ElementTree import iterparse

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tamiz.functions.dates import parse_dotted
from tamiz.functions.numbers import to_double, to_int
from tamiz.functions.text import file_base_name, semester_in_name, snake_names, year_in_name
from tamiz.operators.features import levels

DATE_FORMATS = frozenset(range(14, 23)) | frozenset(range(27, 37)) | frozenset(range(45, 48)) | frozenset(range(50, 59))
EPOCH = datetime(1899, 12, 30)


def _children(stream, tag: str):
    for _, node in iterparse(stream):
        if node.tag.rsplit("}", 1)[-1] == tag:
            yield node
            node.clear()


def _text(node) -> str:
    return "".join(t.text or "" for t in node.iter() if t.tag.rsplit("}", 1)[-1] == "t")


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    """Cell style numbers that show a date."""
    if "xl/styles.xml" not in book.namelist():
        return set()
    body = book.read("xl/styles.xml").decode()
    custom = {
        int(i) for i, code in re.findall(r'numFmtId="(\d+)"[^>]*formatCode="([^"]*)"', body) if re.search("[dy]", code)
    }
    formats = re.search(r"<cellXfs.*?</cellXfs>", body, re.S)
    ids = re.findall(r'<xf [^>]*?numFmtId="(\d+)"', formats.group(0)) if formats else []
    return {i for i, f in enumerate(ids) if int(f) in DATE_FORMATS or int(f) in custom}


def _sheet_part(book: zipfile.ZipFile, sheet: str | int) -> str:
    names = re.findall(r'<sheet [^>]*?name="([^"]*)"[^>]*?r:id="([^"]*)"', book.read("xl/workbook.xml").decode())
    key = names[sheet][1] if isinstance(sheet, int) else dict(names)[sheet]
    links = book.read("xl/_rels/workbook.xml.rels").decode()
    for link in re.findall(r"<Relationship [^>]*>", links):
        if re.search(f'Id="{re.escape(key)}"', link):
            target = re.search(r'Target="([^"]*)"', link).group(1)
            return target.lstrip("/") if target.startswith("/") else "xl/" + target
    raise KeyError(sheet)


def _column_number(ref: str) -> int:
    n = 0
    for ch in re.match("[A-Z]+", ref).group(0):
        n = n * 26 + ord(ch) - 64
    return n - 1


def sheet_rows(content: bytes, sheet: str | int = 0) -> Iterator[tuple[int, list[str | None]]]:
    """``(row number, cell texts)`` of a sheet; dates read ``YYYY-MM-DD``."""
    book = zipfile.ZipFile(io.BytesIO(content))
    shared: list[str] = []
    if "xl/sharedStrings.xml" in book.namelist():
        shared = [_text(n) for n in _children(book.open("xl/sharedStrings.xml"), "si")]
    dates = _date_styles(book)
    for row in _children(book.open(_sheet_part(book, sheet)), "row"):
        cells: list[str | None] = []
        for cell in row:
            at = _column_number(cell.get("r")) if cell.get("r") else len(cells)
            cells += [None] * (at + 1 - len(cells))
            kind = cell.get("t")
            value = next((c.text for c in cell if c.tag.rsplit("}", 1)[-1] == "v"), None)
            if kind == "inlineStr":
                value = _text(cell)
            elif kind == "s" and value is not None:
                value = shared[int(value)]
            elif value is not None and kind is None and int(cell.get("s", 0)) in dates:
                value = (EPOCH + timedelta(days=float(value))).strftime("%Y-%m-%d")
            cells[at] = value if value != "" else None
        yield int(row.get("r")), cells


def _by_header(rows: list[tuple[int, list]], headers: list[str]) -> list[tuple[int, list]]:
    """Data rows with their cells put in the order of ``headers``; a header the sheet lacks gives None."""
    at = {name: i for i, name in enumerate(rows[0][1])} if rows else {}
    places = [at.get(h, -1) for h in headers]
    return [(n, [c[i] if 0 <= i < len(c) else None for i in places]) for n, c in rows[1:]]


def _parse(sheet: str | int, skip: int, width: int, headers: list[str] | None):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    rows = [(n, c) for n, c in sheet_rows(content, sheet) if n > skip]
                except (KeyError, zipfile.BadZipFile, IndexError):
                    yield pd.DataFrame({"path": [path], "row_no": [0], "cells": [None], "unreadable": [True]})
                    continue
                if headers is not None:
                    rows = _by_header(rows, headers)
                for i in range(0, len(rows), 10_000):
                    part = rows[i : i + 10_000]
                    yield pd.DataFrame(
                        {
                            "path": path,
                            "row_no": [n - skip for n, _ in part],
                            "cells": [(c + [None] * width)[: max(width, len(c))] for _, c in part],
                            "unreadable": False,
                        }
                    )

    return run


def workbooks(spark: SparkSession, path: str, pattern: str = "*.xlsx") -> DataFrame:
    """``path, content`` of every workbook below ``path``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True)
    return files.load(path).select("path", "content")


def read_cells(
    files: DataFrame, sheet: str | int = 0, skip: int = 0, width: int = 1, headers: list[str] | None = None
) -> DataFrame:
    """``path, row_no, cells, unreadable``: rows after the first ``skip``, numbered from 1, cells as text.

    With ``headers`` the first row names the columns and the cells follow the order of ``headers``.
    """
    schema = "path string, row_no bigint, cells array<string>, unreadable boolean"
    return files.select("path", "content").mapInPandas(_parse(sheet, skip, width, headers), schema)


def sheet_headers(files: DataFrame, sheet: str | int = 0, skip: int = 0) -> list[str]:
    """Header names found in any of the workbooks."""
    heads = read_cells(files, sheet, skip).where("row_no = 1").select(F.explode("cells").alias("h"))
    return levels(heads, F.col("h"), "sheet header")


def unreadable_files(cells: DataFrame) -> DataFrame:
    return cells.where("unreadable").select(file_base_name(F.col("path")).alias("source_file")).distinct()


def _named(cells: DataFrame, names: list[str]) -> DataFrame:
    picks = [F.get("cells", F.lit(i)).alias(n) for i, n in enumerate(names)]
    return cells.where("not unreadable").select(file_base_name(F.col("path")).alias("source_file"), "row_no", *picks)


def _any_day(c: Column) -> Column:
    """A date cell, or ``d.M.yyyy`` text."""
    return F.coalesce(F.try_to_timestamp(c, F.lit("yyyy-MM-dd")).cast("date"), parse_dotted(c))


def read_incidents(files: DataFrame, skip: int = 9) -> DataFrame:
    """Incident workbooks: a heading of ``skip`` rows, a header row, six columns."""
    names = ["armas_medios", "departamento", "municipio", "fecha", "codigo_dane", "cantidad"]
    rows = _named(read_cells(files, 0, skip, len(names)), names).where(F.col("row_no") > 1)
    return rows.select(
        *names[:3],
        _any_day(F.col("fecha")).alias("fecha"),
        "codigo_dane",
        to_int(F.col("cantidad")).alias("cantidad"),
        "source_file",
        year_in_name(F.col("source_file")).alias("year"),
    ).where(F.col("departamento").isNotNull())


def read_population(files: DataFrame, skip: int = 11, last_row: int | None = None) -> DataFrame:
    """Population workbooks: the first seven columns, and rows up to ``last_row`` where notes follow the data."""
    names = ["cod_dpto", "departamento", "cod_dpto_mpio", "municipio", "anio", "area_geografica", "total"]
    rows = _named(read_cells(files, 0, skip, len(names)), names).where(F.col("row_no") > 1)
    if last_row is not None:
        rows = rows.where(F.col("row_no") <= last_row)
    return rows.select(
        *names[:4],
        to_int(F.col("anio")).alias("anio"),
        "area_geografica",
        to_int(F.col("total")).alias("total"),
        "source_file",
        year_in_name(F.col("source_file")).alias("year"),
    )


# Typed headers of the client and movement sheets; headers not listed stay text.
CLIENT_TYPES = {
    "FECHA_INGRESO": "date", "FECHA_NACIMIENTO": "date", "NUMERO_HIJOS": "double", "SALARIO_ACTUAL": "double",
    "OTROS_INGRESOS": "double", "ACTIVOS": "double", "PASIVOS": "double", "PATRIMONIO": "double", "EGRESOS": "double",
}
MOVE_TYPES = {"FECHA_TRANSACCION": "date", "MONTO_TRANSACCION": "double"}
CLIENT_SHEET, MOVE_SHEET = "InformaciónCliente", "Movimientos"


def read_typed_sheet(files: DataFrame, sheet: str | int, types: Mapping[str, str], headers: list[str]) -> DataFrame:
    """A sheet bound by header name, so files may order their columns differently.

    ``headers`` are the wanted columns; a file that lacks one gives nulls. Names come out in snake case.
    """
    cells = read_cells(files, sheet, 0, len(headers), headers).where("not unreadable")
    picks = []
    for i, (header, name) in enumerate(zip(headers, snake_names(headers))):
        cell, kind = F.get("cells", F.lit(i)), types.get(header)
        typed = _any_day(cell) if kind == "date" else to_double(cell) if kind == "double" else cell
        picks.append(typed.alias(name))
    source = file_base_name(F.col("path"))
    return cells.select(*picks, source.alias("source_file"), semester_in_name(source).alias("semestre"))


def read_semester_files(files: DataFrame, client_headers: list[str], move_headers: list[str]) -> tuple[DataFrame, DataFrame]:
    """Clients and movements of two-sheet semester workbooks."""
    return (
        read_typed_sheet(files, CLIENT_SHEET, CLIENT_TYPES, client_headers),
        read_typed_sheet(files, MOVE_SHEET, MOVE_TYPES, move_headers),
    )
