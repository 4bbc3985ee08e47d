"""Departments: incidents and population to yearly rates and ordinal risk levels."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tamiz.functions.numbers import finite_log
from tamiz.functions.recodes import department_name
from tamiz.operators.features import rate_table

YEARS = (2022, 2023, 2024)


def clean_population(raw: DataFrame, years=YEARS) -> DataFrame:
    """Inhabitants by department and year; only the rows that cover the whole area count."""
    kept = raw.where((F.col("area_geografica") == "Total") & F.col("anio").isin(list(years)))
    named = kept.select(
        department_name(F.col("departamento")).alias("departamento"), F.col("anio").alias("year"), "total"
    )
    return named.groupBy("departamento", "year").agg(F.sum("total").alias("total"))


def clean_incidents(raw: DataFrame, years=YEARS) -> DataFrame:
    """Incidents by department and year."""
    kept = raw.where(F.col("departamento").isNotNull() & F.year("fecha").isin(list(years)))
    named = kept.select(
        department_name(F.col("departamento"), F.col("municipio"), with_prefixes=False).alias("departamento"),
        F.year("fecha").alias("year"),
        "cantidad",
    )
    return named.groupBy("departamento", "year").agg(F.sum("cantidad").alias("n_cases"))


def yearly_rates(incidents: DataFrame, population: DataFrame, years=YEARS) -> DataFrame:
    """The department table: cases, inhabitants and rate per 100,000 for each year."""
    return rate_table(clean_incidents(incidents, years), clean_population(population, years), "departamento", "year", years)


def log_rates(rates: DataFrame, years=YEARS) -> DataFrame:
    """Logged rates, the model input."""
    names = [f"rate{y % 100:02d}" for y in years]
    return rates.select("departamento", *[finite_log(F.col(n)).alias(n) for n in names])
