"""Whole flows on small hand-written tables."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from tamiz.plans import associates, departments, populations, segmentation
from tests.conftest import rows


def test_department_flow(spark):
    incidents = spark.createDataFrame(
        [("Bogota, D.C.", "x", date(2022, 1, 1), 5), ("Cundinamarca", "Bogotá D.C. (CT)", date(2022, 2, 1), 1),
         ("NARIÑO", "y", date(2024, 1, 1), 2), ("Meta", "z", date(2021, 1, 1), 9), (None, "z", date(2022, 1, 1), 9)],
        "departamento string, municipio string, fecha date, cantidad int",
    )
    people = spark.createDataFrame(
        [("Bogotá, D.C.", 2022, "Total", 60), ("Bogotá, D.C.", 2022, "Cabecera", 999), ("Nariño", 2024, "Total", 0)],
        "departamento string, anio int, area_geografica string, total int",
    )
    out = departments.yearly_rates(incidents, people)
    assert rows(out.select("departamento", "crimes22", "pop22", "rate22", "crimes24", "rate24"), "departamento") == [
        ("Bogota", 6, 60, 10000.0, None, None), ("Narino", None, None, None, 2, None)]


CLIENTS = [
    (" a1 ", "Nit", None, "A", 1.0, 2.0, "2023", "f1"), ("A1", "Nit", "4700", "A", 5.0, None, "2024", "f2"),
    ("b2", "CC", None, "I", None, None, "2024", "f2"), ("c3", "CC", "1200", None, 1.0, 1.0, "2024", "f2"),
    ("d4", "CC", "9", "A", 1.0, 1.0, "2024", "f2"), ("e5", "Nit", None, "A", 1.0, 1.0, "2024", "f2"),
]
CLIENT_SCHEMA = (
    "documento string, tipo_documento string, ciiu string, estado string, ingresos_mens double, otros_ingresos double, "
    "year string, source_file string"
)
DAY = date(2023, 3, 1)
MOVES = [
    ("a1", DAY, "Ingreso", "CDT", "Fisico", "CALI", 10.0, "1"), ("a1", DAY, "Ingreso", "CDT", "Fisico", "CALI", 10.0, "1"),
    ("A1 ", DAY, "Egreso", "Ahorro", "Virtual", "PERÚ", -4.0, "1"), ("b2", None, "Ingreso", "CDT", "Fisico", "x", 3.0, "8"),
    ("b2", DAY, "Ingreso", "Ahorro", "Fisico", "CALI", 8.0, "1"), ("c3", DAY, "Ingreso", "Ahorro", "Fisico", "CALI", 6.0, None),
    ("c3", DAY, "Ingreso", "Ahorro", "Fisico", "CALI", 0.0, "1"), ("z9", DAY, "Ingreso", "Ahorro", "Fisico", "CALI", 1.0, "8"),
    ("e5", DAY, "Ingreso", "Ahorro", "Fisico", "CALI", 2.0, "1"), ("e5", None, "Ingreso", "Ahorro", "Fisico", "CALI", 4.0, "1"),
]
MOVE_SCHEMA = (
    "num_ident string, fecha_transac date, tipo_transac string, tipo_prod string, tipo_canal string, jurisdiccion string, "
    "monto double, nombre_prod string"
)


def test_population_flow(spark):
    raw_clients, raw_moves = spark.createDataFrame(CLIENTS, CLIENT_SCHEMA), spark.createDataFrame(MOVES, MOVE_SCHEMA)
    clients, moves = populations.clean_tables(raw_clients, raw_moves)
    assert rows(clients.select("normalized_id", "ciiu_o", "ingresos", "egresos"), "normalized_id") == [
        ("A1", "4700", 5.0, None), ("B2", None, 0.0, None), ("C3", "1200", 2.0, None), ("E5", None, 2.0, None)]
    # the repeated movement counts once, zero amounts and unknown clients are gone
    assert moves.count() == 7
    features = populations.feature_tables(clients, moves)
    got = {r["num_ident"]: r for r in features.collect()}
    assert {k: v["population"] for k, v in got.items()} == {
        "A1": "persona_juridica", "B2": "bajo_monto", "C3": "persona_natural", "E5": "persona_juridica"}
    a, b, c, e = (got[k] for k in ("A1", "B2", "C3", "E5"))
    assert (a["comercio"], a["Ahorro_Ingreso"], a["CDT_Ingreso"], a["jurisdiccion_6_Egreso"]) == (1, 10.0, 0.0, 4.0)
    assert (b["CDT_Ingreso"], b["Ahorro_Ingreso"], b["num_transa"]) == (3.0, 0.0, 1.0)
    assert (c["ind_alimentaria"], c["num_transa"], c["Ahorro_Ingreso"], c["activo"]) == (1, None, None, None)
    assert (e["no_clasificado"], e["Ahorro_Ingreso"]) == (None, 3.0)  # two periods, one of them missing
    low = populations.population_table(features, "bajo_monto")
    assert "CDT_Ingreso" in low.columns and "comercio" not in low.columns
    with pytest.raises(ValueError):
        populations.population_table(features, "other")


def test_associate_flow(spark):
    base = ("Asociado", "Término Indefinido", "Asalariado", "Sector Privado Esal", "Primaria", "5")
    raw_clients = spark.createDataFrame(
        [("1", *base, 10.0, 1.0, "2023-II", "f"), ("1 ", *base, 20.0, None, "2024-I", "f"),
         ("2", "Empleado", *base[1:], 1.0, 1.0, "2024-I", "f"), ("3", *base, 1.0, 1.0, "2024-I", "f")],
        "num_identificacion string, rol string, tipo_contrato string, actividad_economica string, sector_economico string, "
        "nivel_escolaridad string, estrato string, salario_actual double, otros_ingresos double, semestre string, source_file string",
    ).withColumns({c: F.lit(1.0) for c in ("egresos", "activos", "pasivos")}).withColumns(
        {c: F.lit(None).cast("date") for c in ("fecha_nacimiento", "fecha_ingreso")}
    )
    raw_moves = spark.createDataFrame(
        [("1", date(2023, 1, 5), 4.0, "Ahorro", "Ingreso", "Físico"), ("1", date(2023, 2, 5), 2.0, "Ahorro", "Ingreso", "Web"),
         ("1", date(2023, 2, 5), -9.0, "Ahorro", "Ingreso", "Web"), ("2", date(2023, 2, 5), 2.0, "Ahorro", "Ingreso", "Web")],
        "num_identificacion string, fecha_transaccion date, monto_transaccion double, tipo_producto string, "
        "tipo_transaccion string, tipo_canal_transaccion string",
    ).withColumns({"semestre": F.lit("x"), "source_file": F.lit("/p/q.xlsx")})
    clients, moves = associates.clean_tables(raw_clients, raw_moves)
    assert rows(moves.select("semestre", "semestre_archivo", "file_name").distinct()) == [("2023-I", "x", "q.xlsx")]
    out = associates.feature_table(clients, moves).collect()
    assert len(out) == 1
    r = out[0]
    assert (r["num_identificacion"], r["T_Contr_Indef"], r["Sec_Econ_Priv"], r["ingresos"], r["num_transa"]) == ("1", 1, 1, None, 1.0)
    assert (r["Ahorro_Ingreso"], r["Fisico_Ingreso"], r["Electronico_Ingreso"]) == (3.0, 2.0, 1.0)


def test_model_columns():
    m = segmentation.MODELS
    assert [len(m[k].columns) for k in ("associates", "persona_natural", "persona_juridica", "bajo_monto")] == [22, 28, 28, 5]


def test_segment_labels_every_row(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    model = segmentation.MODELS["bajo_monto"]
    data = [(str(i), *[float(v) for v in rng.lognormal(3 + 3 * (i % 2), 1, 5)]) for i in range(200)]
    df = spark.createDataFrame(data, "num_ident string, " + ", ".join(f"{c} double" for c in model.columns))
    out = segmentation.segment(df, "num_ident", model, micro_k=50, starts=1)
    assert out.count() == 200 and out.select("num_ident").distinct().count() == 200
    assert {r[0] for r in out.select("cluster").distinct().collect()} == {1, 2, 3, 4}
    profile, alerts = segmentation.segment_reports(out, model)
    assert profile.count() == 5 == alerts.count()
