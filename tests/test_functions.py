"""Column expressions whose null, rounding and parsing rules matter."""

from datetime import date

from pyspark.sql import functions as F

from tamiz.functions import dates, numbers, recodes, text
from tests.conftest import rows


def one(spark, expr, schema, *values):
    df = spark.createDataFrame([(v,) for v in values], schema)
    return [r[0] for r in df.select(expr).collect()]


def test_keys_and_names(spark):
    assert one(spark, text.norm_key(F.col("a")), "a string", " ab1 ", None) == ["AB1", None]
    assert one(spark, text.strip_accents(F.col("a")), "a string", "ÁñÉ xyz") == ["ane xyz"]
    assert one(spark, text.capitalise_first(F.col("a")), "a string", "sAN pEDRO", "") == ["San pedro", ""]
    assert one(spark, text.capitalise_label(F.col("a")), "a string", "kMeans") == ["KMeans"]
    assert text.snake_names(["Núm. Ident", "ACTIVOS", "numHijos", "ACTIVOS", "2x"]) == [
        "num_ident", "activos", "num_hijos", "activos_2", "x2x"]
    assert text.spaced_names(["a_b"]) == ["a b"]


def test_composite_key_spells_missing_parts(spark):
    df = spark.createDataFrame([("Ahorro", None), (None, "Egreso")], "p string, f string")
    assert rows(df.select(text.composite_key(F.col("p"), F.col("f")))) == [("Ahorro_NA",), ("NA_Egreso",)]


def test_semester_and_year_of_file_names(spark):
    names = ["x_2023-II.xlsx", "x_2024-I.xlsx", "x.xlsx"]
    assert one(spark, text.semester_in_name(F.col("a")), "a string", *names) == ["2023-II", "2024-I", None]
    assert one(spark, text.year_in_name(F.col("a")), "a string", "m_2023.txt", "m_2019.txt") == ["2023", ""]
    assert one(spark, text.prefix_of_name(F.col("a")), "a string", "Abonos_2023.txt") == ["Abonos"]


def test_casts_never_fail(spark):
    assert one(spark, numbers.to_double(F.col("a")), "a string", "abc", "1.5", "") == [None, 1.5, None]
    assert one(spark, numbers.to_int(F.col("a")), "a string", "12.5", "x", "7") == [13, None, 7]
    assert one(spark, dates.parse_day_month_year(F.col("a")), "a string", "31/02/2023", "1/2/2023") == [None, date(2023, 2, 1)]
    assert one(spark, dates.parse_dotted(F.col("a")), "a string", "05.03.2024", "2024") == [date(2024, 3, 5), None]


def test_rounding_and_division(spark):
    assert one(spark, numbers.half_even(F.col("a")), "a double", 2.5, 3.5) == [2.0, 4.0]
    df = spark.createDataFrame([(5, 0), (5, 2), (5, None)], "n int, d int")
    assert rows(df.select(numbers.safe_ratio(F.col("n"), F.col("d")))) == [(None,), (2.5,), (None,)]
    assert rows(df.select(numbers.rate_per(F.col("n"), F.col("d")))) == [(None,), (250000.0,), (None,)]
    assert one(spark, numbers.finite_log(F.col("a")), "a double", 0.0, 1.0) == [None, 0.0]


def test_distinct_periods_counts_missing_once(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("a", None), ("a", None), ("b", 1)], "k string, p int")
    out = df.groupBy("k").agg(numbers.distinct_periods(F.col("p")).alias("n"))
    assert rows(out, "k") == [("a", 2), ("b", 1)]


def test_period_buckets(spark):
    days = [date(2023, 6, 30), date(2023, 7, 1), date(2025, 1, 1), None]
    assert one(spark, dates.semester_bucket(F.col("a")), "a date", *days) == ["2023-I", "2023-II", None, None]
    assert one(spark, dates.year_bucket(F.col("a")), "a date", *days) == ["2023", "2023", None, None]
    years = one(spark, dates.years_between(F.col("a"), date(2024, 12, 31)), "a date", date(2024, 1, 2), date(2025, 1, 1))
    assert years == [0, -1]


def test_industry_groups(spark):
    codes = ["0111", "1200", "3500", "4400", "A1", " ", None, "9900"]
    assert one(spark, recodes.industry_group(F.col("a")), "a string", *codes) == [
        "Agricultura y Minería", "Industria de Alimentos y Bebidas", "No Clasificado", "No Clasificado",
        "No Clasificado", None, None, "Otros Servicios"]


def test_departments(spark):
    given = ["Bogota, D.C.", "BOGOTÁ", "Archipiélago de San Andrés, X", "Valle del Cauca", "norte de santander", "NARIÑO"]
    assert one(spark, recodes.department_name(F.col("a")), "a string", *given) == [
        "Bogota", "Bogota", "San Andres", "Valle", "Norte de Santander", "Narino"]
    df = spark.createDataFrame([("Cundinamarca", "Bogotá D.C. (CT)")], "d string, m string")
    assert rows(df.select(recodes.department_name(F.col("d"), F.col("m")))) == [("Bogota",)]


def test_recodes_keep_missing(spark):
    df = spark.createDataFrame(
        [("Independiente", "Término Indefinido"), ("Asalariado", "Término Indefinido"), ("Asalariado", None), (None, "x")],
        "a string, c string",
    )
    out = df.select(recodes.contract_group(F.col("c"), F.col("a")), recodes.activity_group(F.col("a")))
    assert rows(out) == [("Otro", "Otro"), ("Indefinido", "Asalariado"), (None, "Asalariado"), (None, None)]
    levels = one(spark, recodes.education_level(F.col("a")), "a string", "Primaria", "Tecnologia", "Universitario", "PhD", None)
    assert levels == ["01_Basico", "02_Tecnologico", "03_Universitario", "04_Posgrado", None]
    assert one(spark, recodes.stratum_group(F.col("a")), "a string", "2", "5", None) == ["2", "4-5-6", None]
