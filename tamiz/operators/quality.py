"""Counts, shares and differences that check a load."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tamiz.functions.numbers import percent


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """``table_name, row_count``, each table counted by one small aggregate."""
    parts = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        for name, df in tables.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def catalog_row_counts(spark: SparkSession, prefix: str = "gold_", database: str | None = None) -> DataFrame:
    """Row counts of the catalog tables whose name starts with ``prefix``."""
    names = [t.name for t in spark.catalog.listTables(database) if t.name.startswith(prefix)]
    if not names:
        return spark.createDataFrame([], "table_name string, row_count bigint")
    qualify = (lambda n: f"{database}.{n}") if database else (lambda n: n)
    return row_counts({n: spark.table(qualify(n)) for n in sorted(names)})


def require_tables(spark: SparkSession, names: Sequence[str]) -> None:
    missing = [n for n in names if not spark.catalog.tableExists(n)]
    if missing:
        raise ValueError(f"required tables not found: {', '.join(missing)}")


def category_share(df: DataFrame, column: str, digits: int | None = None) -> DataFrame:
    """``column, n, percentage`` of all rows."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.withColumn("percentage", percent(F.col("n"), total, digits))


def count_unmapped(df: DataFrame, column: str) -> DataFrame:
    """Rows in all, and rows where ``column`` is missing."""
    return df.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col(column).isNull()).alias("missing"))


def key_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Distinct keys found on one side only; ``side`` says which."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    only_left = a.join(b, key, "left_anti").withColumn("side", F.lit("left"))
    only_right = b.join(a, key, "left_anti").withColumn("side", F.lit("right"))
    return only_left.unionByName(only_right)


def zero_share(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``variable, zeros, zero_percentage``; a column with a missing value has neither."""
    def zeros(c: str) -> Column:
        cell = F.col(f"`{c}`")
        hits = F.count_if(cell == 0)
        return F.when(F.count_if(cell.isNull()) == 0, hits).alias(c)

    counts = df.agg(*[zeros(c) for c in columns], F.count(F.lit(1)).alias("__rows"))
    tall = counts.unpivot(["__rows"], list(columns), "variable", "zeros")
    return tall.select("variable", "zeros", percent(F.col("zeros"), F.col("__rows"), 2).alias("zero_percentage"))


def column_minimums(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``variable, minimum`` of the non-missing values."""
    lows = df.agg(*[F.min(F.col(f"`{c}`").cast("double")).alias(c) for c in columns])
    return lows.unpivot([], list(columns), "variable", "minimum")


def top_groups(df: DataFrame, group: str, measure: Column, name: str, n: int = 10) -> DataFrame:
    """The ``n`` groups with the largest aggregate, ties by group."""
    return df.groupBy(group).agg(measure.alias(name)).orderBy(F.col(name).desc_nulls_last(), F.col(group)).limit(n)
