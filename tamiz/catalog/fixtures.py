"""Raw files written from the shared tables, for the queries that read files."""

from __future__ import annotations

import io
import zipfile
from datetime import date
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tamiz.session import scratch_path

_TYPES = (
    '<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">'
    '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
    '<Default Extension="xml" ContentType="application/xml"/></Types>'
)
_STYLES = '<styleSheet><cellXfs count="2"><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>'


def _cell(value) -> str:
    if value is None or (isinstance(value, float) and pd.isna(value)):
        return "<c/>"
    if isinstance(value, date):
        return f'<c s="1"><v>{(value - date(1899, 12, 30)).days}</v></c>'
    if isinstance(value, (int, float)):
        return f"<c><v>{value!r}</v></c>"
    return f'<c t="inlineStr"><is><t>{escape(str(value))}</t></is></c>'


def encode_workbook(sheets: dict[str, list[list]]) -> bytes:
    """A minimal workbook; one list of cells per row."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        book.writestr("[Content_Types].xml", _TYPES)
        book.writestr("xl/styles.xml", _STYLES)
        names = "".join(f'<sheet name="{escape(n)}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets, 1))
        book.writestr("xl/workbook.xml", f"<workbook><sheets>{names}</sheets></workbook>")
        links = "".join(f'<Relationship Id="r{i}" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1))
        book.writestr("xl/_rels/workbook.xml.rels", f"<Relationships>{links}</Relationships>")
        for i, rows in enumerate(sheets.values(), 1):
            body = "".join(f'<row r="{n}">{"".join(map(_cell, row))}</row>' for n, row in enumerate(rows, 1))
            book.writestr(f"xl/worksheets/sheet{i}.xml", f"<worksheet><sheetData>{body}</sheetData></worksheet>")
    return out.getvalue()


def write_lines(df: DataFrame, header: str, name: str) -> str:
    """Write ``line`` text under a header line, one folder per ``src``; returns the root folder."""
    path = scratch_path(df.sparkSession, name)
    plain = {"header": True, "sep": "\u0001", "quote": "\u0000", "escape": "\u0000", "escapeQuotes": False}
    df.select(F.col("line").alias(header), "src").write.partitionBy("src").options(**plain).csv(path)
    return path


def write_files(lines: DataFrame, name: str) -> str:
    """Write ``lines(file, nth, line)`` as plain text files of these names in one folder, lines in order of ``nth``."""
    spark, path = lines.sparkSession, scratch_path(lines.sparkSession, name)
    rows = lines.repartition("file").sortWithinPartitions("file", "nth")
    rows.select("line", "file").write.partitionBy("file").text(f"{path}-parts")
    hadoop = spark._jvm.org.apache.hadoop.fs
    files = hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(hadoop.Path(path))
    for found in files.globStatus(hadoop.Path(f"{path}-parts/file=*/part-*")):
        folder = found.getPath().getParent().getName()
        files.rename(found.getPath(), hadoop.Path(f"{path}/{folder.partition('=')[2]}"))
    return path
