"""Value recodes of the domain, as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

from tamiz.functions.text import capitalise_first, strip_accents

# First two digits of an industry code, ends included, and its group.
INDUSTRY_RANGES = (
    (1, 9, "Agricultura y Minería"),
    (10, 12, "Industria de Alimentos y Bebidas"),
    (13, 33, "Industria Manufacturera"),
    (41, 43, "Construcción e Infraestructura"),
    (45, 47, "Comercio al por Mayor y por Menor"),
    (50, 82, "Servicios Profesionales y Técnicos"),
    (90, 99, "Otros Servicios"),
)
INDUSTRY_OTHER = "No Clasificado"

# Department spellings with a name of their own.
DEPARTMENT_NAMES = {
    "Bogota, D.C.": "Bogota",
    "La Guajira": "Guajira",
    "Valle del Cauca": "Valle",
}
DEPARTMENT_PREFIXES = {"Archipiélago de San Andrés": "San Andres"}
MUNICIPALITY_NAMES = {"Bogotá D.C. (CT)": "Bogota"}
# Names kept as written here instead of first-letter capitals.
DEPARTMENT_CASE = {
    "bogota": "Bogota",
    "bogota, d.c.": "Bogota",
    "norte de santander": "Norte de Santander",
    "san andres": "San Andres",
}


def recode(c: Column, labels: Mapping[str, str], default: Column | str | None = None) -> Column:
    """Exact-value recode. Values outside ``labels``, nulls included, take ``default``."""
    out = None
    for value, label in labels.items():
        out = F.when(c == value, label) if out is None else out.when(c == value, label)
    if out is None:
        return default if isinstance(default, Column) else F.lit(default)
    return out if default is None else out.otherwise(default)


def keep_null(c: Column, expr: Column) -> Column:
    """``expr``, but null wherever ``c`` is null (a comparison with a missing value is missing)."""
    return F.when(c.isNotNull(), expr)


def code_range(c: Column, ranges: Sequence[tuple[int, int, str]], default: str, digits: int = 2) -> Column:
    """Group of a numeric code prefix. Blank or null gives null, anything else outside the ranges ``default``."""
    number = F.substring(c, 1, digits).try_cast("int")
    group = F.when(c.isNull() | (F.trim(c) == ""), F.lit(None).cast("string"))
    for low, high, label in ranges:
        group = group.when(number.between(low, high), label)
    return group.otherwise(default)


def industry_group(c: Column) -> Column:
    return code_range(c, INDUSTRY_RANGES, INDUSTRY_OTHER)


def department_name(department: Column, municipality: Column | None = None, with_prefixes: bool = True) -> Column:
    """One spelling per department; a capital-district municipality overrides its department."""
    name = recode(department, DEPARTMENT_NAMES, department)
    if with_prefixes:
        for prefix, label in DEPARTMENT_PREFIXES.items():
            name = F.when(department.startswith(prefix), label).otherwise(name)
    if municipality is not None:
        name = recode(municipality, MUNICIPALITY_NAMES, name)
    plain = strip_accents(name)
    return recode(F.lower(plain), DEPARTMENT_CASE, capitalise_first(plain))


def contract_group(contract: Column, activity: Column) -> Column:
    """Open-ended contract or other; the self-employed never have an open-ended one."""
    effective = F.when(activity == "Independiente", "Prestación Servicios").when(activity.isNotNull(), contract)
    return keep_null(effective, F.when(effective == "Término Indefinido", "Indefinido").otherwise("Otro"))


def activity_group(activity: Column) -> Column:
    return keep_null(activity, F.when(activity == "Asalariado", "Asalariado").otherwise("Otro"))


def education_level(education: Column) -> Column:
    """Four ordered levels; a missing value stays missing."""
    return (
        F.when(education.isin("Primaria", "Bachillerato"), "01_Basico")
        .when(education.isin("Tecnico", "Tecnologia"), "02_Tecnologico")
        .when(education == "Universitario", "03_Universitario")
        .when(education.isNotNull(), "04_Posgrado")
    )


def sector_group(sector: Column) -> Column:
    private = ("Sector Privado Esal", "Sector Privado Financiero Solidario")
    return F.when(sector.isin(*private), "Sector Privado").otherwise(sector)


def stratum_group(stratum: Column) -> Column:
    return keep_null(stratum, F.when(stratum.isin("1", "2", "3"), stratum).otherwise("4-5-6"))


def channel_group(channel: Column) -> Column:
    return keep_null(channel, F.when(channel == "Físico", "Fisico").otherwise("Electronico"))


def savings_product(product: Column) -> Column:
    """Term deposits count as savings."""
    return F.when(product == "CDT", "Ahorro").otherwise(product)


def indicator(c: Column, value: str, null_as_zero: bool = False) -> Column:
    """0/1 test for one value; a null is null, or 0 with ``null_as_zero``."""
    test = F.coalesce(c == value, F.lit(False)) if null_as_zero else (c == value)
    return test.cast("int")
