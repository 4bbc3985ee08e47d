"""Delimited files, workbooks, tables and exports in a temporary folder."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from tamiz.catalog.fixtures import encode_workbook
from tamiz.operators.quality import catalog_row_counts, require_tables
from tamiz.sources import delimited, sinks, workbook
from tests.conftest import rows

HEAD = "|".join(delimited.MOVE_COLUMNS)


def test_folder_of_text_files(spark, tmp_path):
    wide = "|".join(f"C{i}" for i in range(13))
    (tmp_path / "Base Clientes_2023.txt").write_text(f"{wide}\nN1|Nit|1|0111|x|10|abc||1|2|3|A|extra\nshort|line\n")
    (tmp_path / "Abonos_2024.txt").write_text(f"{HEAD}\n1|1/2/2024|Ingreso||Fisico|CALI|-5.5|E|8\n2|31/02/2024|Egreso|Ahorro|Fisico|CALI|x|E|1\n")
    (tmp_path / "Pagos_2022.txt").write_text(f"{HEAD}\n3|01/02/2022|Ingreso|CDT|Fisico|CALI|7|E|8|more\n4|02/02/2022|Ingreso|CDT\n")
    clients, moves = delimited.read_folder(spark, str(tmp_path))
    assert rows(clients.select("documento", "ingresos_mens", "egresos_mens", "estado", "source_file", "year")) == [
        ("1", 10.0, None, "A", "Base Clientes_2023.txt", "2023")]
    got = rows(moves.select("num_ident", "fecha_transac", "tipo_prod", "monto", "nombre_prod", "damaged", "transaction_type"), "num_ident")
    assert got == [
        ("1", date(2024, 2, 1), None, -5.5, "8", False, "Abonos"), ("2", None, "Ahorro", None, "1", False, "Abonos"),
        ("3", None, "CDT", 7.0, "8", True, "Pagos"), ("4", None, "CDT", None, None, True, "Pagos")]


def test_narrow_client_files_are_reported_and_left_out(spark, tmp_path):
    twelve = "|".join("abcdefghijkl")
    (tmp_path / "a_2023.txt").write_text(f"{twelve}\n{twelve}\n1|2\n")
    (tmp_path / "b_2024.txt").write_text("x|y\n1|2\n")
    assert rows(delimited.narrow_files(spark, str(tmp_path), 12)) == [("b_2024.txt", 2)]
    kept = delimited.read_clients_padded(spark, str(tmp_path))
    assert rows(kept.select("oficina", "documento", "source_file"), "oficina") == [("1", None, "a_2023.txt"), ("a", "c", "a_2023.txt")]
    assert delimited.header_names(spark, str(tmp_path / "b_2024.txt")) == ["x", "y"]


def save_book(path, sheets):
    path.write_bytes(encode_workbook(sheets))


def test_incident_and_population_books(spark, tmp_path):
    note = [["note"]]
    day = date(2023, 5, 6)
    save_book(tmp_path / "crimes_2023.xlsx", {"s": note * 9 + [list("abcdef")] + [
        ["arma", "Huila", "Neiva", day, "41001", 3], ["arma", None, "x", day, "1", 1], ["arma", "Meta", "y", "07.05.2023", "5", "z"]]})
    out = workbook.read_incidents(workbook.workbooks(spark, str(tmp_path), "crimes*.xlsx"))
    assert rows(out.select("departamento", "fecha", "cantidad", "year"), "departamento") == [
        ("Huila", day, 3, "2023"), ("Meta", date(2023, 5, 7), None, "2023")]
    save_book(tmp_path / "pop.xlsx", {"s": note * 11 + [list("abcdefghij")] + [
        ["41", "Huila", "41001", "Neiva", 2023, "Total", 100, 1, 2, 3], ["footer"]]})
    (tmp_path / "bad.xlsx").write_bytes(b"not a workbook")
    files = workbook.workbooks(spark, str(tmp_path), "*p*.xlsx")
    assert rows(workbook.read_population(files, last_row=2).select("departamento", "anio", "total", "year")) == [("Huila", 2023, 100, "")]
    bad = workbook.unreadable_files(workbook.read_cells(workbook.workbooks(spark, str(tmp_path))))
    assert rows(bad) == [("bad.xlsx",)]


def test_semester_book_binds_by_header(spark, tmp_path):
    save_book(tmp_path / "base_2023-II.xlsx", {
        "InformaciónCliente": [["ROL", "NUM_IDENTIFICACION", "ACTIVOS"], ["Asociado", "01", 5.5]],
        "Movimientos": [["NUM_IDENTIFICACION", "MONTO_TRANSACCION", "FECHA_TRANSACCION"], ["01", "x", date(2023, 8, 1)]]})
    files = workbook.workbooks(spark, str(tmp_path))
    heads = workbook.sheet_headers(files, workbook.MOVE_SHEET)
    assert heads == ["FECHA_TRANSACCION", "MONTO_TRANSACCION", "NUM_IDENTIFICACION"]
    clients, moves = workbook.read_semester_files(files, ["NUM_IDENTIFICACION", "ACTIVOS", "ESTRATO"], heads)
    assert rows(clients) == [("01", 5.5, None, "base_2023-II.xlsx", "2023-II")]
    assert rows(moves.select("fecha_transaccion", "monto_transaccion")) == [(date(2023, 8, 1), None)]


def test_tables(spark, tmp_path):
    spark.sql("CREATE DATABASE IF NOT EXISTS tz")
    try:
        spark.sql("USE tz")
        sinks.create_table(spark, "gold_a", "x int, y string", str(tmp_path / "a"))
        with pytest.raises(ValueError):
            require_tables(spark, ["gold_a", "gold_none"])
        df = spark.createDataFrame([("p", 1), ("q", 2)], "y string, x int")
        sinks.append(df, "gold_a")
        sinks.append(df, "gold_a")
        assert spark.table("gold_a").count() == 4
        sinks.swap(spark.table("gold_a").distinct(), "gold_a")
        assert rows(spark.table("gold_a"), "x") == [(1, "p"), (2, "q")]
        sinks.keep_existing(df.limit(1), "gold_a")
        assert rows(catalog_row_counts(spark, "gold_", "tz")) == [("gold_a", 2)]
        sinks.replace(df.limit(1), "gold_a", ["y"])
        assert spark.table("gold_a").count() == 1
    finally:
        spark.sql("USE default")
        spark.sql("DROP DATABASE tz CASCADE")


def test_export_round_trip(spark, tmp_path):
    paths = sinks.export({"c": spark.range(3).toDF("x"), "m": spark.range(2).toDF("x")}, str(tmp_path), "csv")
    assert {n: spark.read.csv(p, header=True).count() for n, p in paths.items()} == {"c": 3, "m": 2}


def test_raw_table_columns_parse(spark):
    from pyspark.sql.types import StructType

    assert len(StructType.fromDDL(sinks.RAW_TABLES["bronze_movimientos"])) == 12
    assert [f.name for f in StructType.fromDDL(sinks.RAW_TABLES["bronze_clientes"])][:12] == list(delimited.CLIENT_COLUMNS)


def test_header_only_columns_are_text(spark):
    assert set(workbook.CLIENT_TYPES.values()) == {"date", "double"}
    assert spark.range(1).select(F.lit(1)).count() == 1


def test_each_file_by_its_own_header(spark, tmp_path):
    wide = delimited.CLIENT_COLUMNS + ("extra",)
    line = lambda n, id_: "|".join(["1", "CC", id_, "10", '"a|b"', "5", "4", "3", "2", "1", "0", "A", "x"][:n])
    for name, n, columns in (("a_2023.txt", 12, delimited.CLIENT_COLUMNS), ("b_2024.txt", 13, wide), ("c_2024.txt", 5, wide[:5])):
        body = ["|".join(columns), line(n, name[0]), "", line(n - 1, "short")]
        (tmp_path / f"Base Clientes {name}").write_text("\n".join(body) + "\n")
    clients, moves = delimited.read_folder(spark, str(tmp_path))
    kept = rows(clients.select("source_file", "documento", "ocupacion", "ingresos_mens", "estado"), "source_file")
    assert kept == [("Base Clientes a_2023.txt", "a", "a|b", 5.0, "A"), ("Base Clientes b_2024.txt", "b", "a|b", 5.0, "A")]
    assert rows(delimited.rejected_clients(spark, str(tmp_path)), "source_file", "width") == [
        ("Base Clientes a_2023.txt", 12, 11, "line of another width", 1),
        ("Base Clientes b_2024.txt", 13, 12, "line of another width", 1),
        ("Base Clientes c_2024.txt", 5, 4, "file below twelve columns", 1),
        ("Base Clientes c_2024.txt", 5, 5, "file below twelve columns", 1),
    ]
