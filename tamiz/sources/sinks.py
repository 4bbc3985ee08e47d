"""Tables and datasets written out."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

# Declared columns of the raw tables.
RAW_TABLES = {
    "bronze_crimes": "armas_medios string, departamento string, municipio string, fecha date, codigo_dane string, "
    "cantidad int, source_file string, year string",
    "bronze_population": "cod_dpto string, departamento string, cod_dpto_mpio string, municipio string, anio int, "
    "area_geografica string, total int, source_file string, year string",
    "bronze_clientes": "oficina string, tipo_documento string, documento string, ciiu string, ocupacion string, "
    "ingresos_mens double, egresos_mens double, otros_ingresos double, total_activos double, total_pasivos double, "
    "valor_patrimoni double, estado string, source_file string, year string",
    "bronze_movimientos": "num_ident string, fecha_transac date, tipo_transac string, tipo_prod string, "
    "tipo_canal string, jurisdiccion string, monto double, especie string, nombre_prod string, source_file string, "
    "year string, transaction_type string",
}


def create_table(spark: SparkSession, name: str, columns: str, path: str | None = None) -> None:
    """An empty table with declared columns, unless it exists."""
    place = f" LOCATION '{path}'" if path else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet{place}")


def append(df: DataFrame, name: str) -> None:
    """Add rows to a table, columns matched by name."""
    df.select(*df.sparkSession.table(name).columns).write.insertInto(name)


def replace(df: DataFrame, name: str, partition_by: Sequence[str] = (), path: str | None = None) -> None:
    """Write the table anew; a second run gives the same table."""
    writer = df.write.mode("overwrite").format("parquet")
    writer = writer.option("path", path) if path else writer
    (writer.partitionBy(*partition_by) if partition_by else writer).saveAsTable(name)


def keep_existing(df: DataFrame, name: str) -> None:
    """Write the table only if it does not exist."""
    df.write.mode("ignore").format("parquet").saveAsTable(name)


def swap(df: DataFrame, name: str) -> None:
    """Replace a table by rows derived from it, without a moment in which there is none.

    The rows are written to a new folder beside the table's own, then the catalog entry is pointed at it in one step. Queries
    planned before still read the old folder, which stays; a failed write leaves the table as it was. The table must not be
    partitioned (``layers.Layers`` has no such limit).
    """
    spark = df.sparkSession
    parts = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE TABLE EXTENDED {name}").collect()}
    if "# Partition Information" in parts:
        raise ValueError(f"{name} is partitioned")
    target = f"{parts['Location'].rstrip('/')}-{uuid.uuid4().hex[:12]}"
    df.select(*spark.table(name).columns).write.parquet(target)
    spark.sql(f"ALTER TABLE {name} SET LOCATION '{target}'")
    spark.catalog.refreshTable(name)


def export(tables: Mapping[str, DataFrame], root: str, fmt: str = "parquet") -> dict[str, str]:
    """Write several datasets below one root, one folder each."""
    paths = {}
    for name, df in tables.items():
        paths[name] = f"{root.rstrip('/')}/{name}"
        writer = df.write.mode("overwrite").format(fmt)
        (writer.option("header", True) if fmt == "csv" else writer).save(paths[name])
    return paths
