import pytest
from pyspark.sql import functions as F

from tamiz.sources import sinks
from tamiz.sources.layers import Layers

TABLES = {"bronze.moves": "id bigint, amount double", "silver.moves": "id bigint, amount double", "gold.totals": "n bigint"}


def moves(spark, n):
    return spark.range(n).select("id", F.col("id").cast("double").alias("amount"))


def test_reader_sees_old_or_new_rows(spark, tmp_path):
    store = Layers(spark, str(tmp_path), TABLES)
    assert store.write("bronze.moves", moves(spark, 5)) == 1
    old = store.read("bronze.moves")
    assert store.swap("bronze.moves", lambda df: df.where("id > 1")) == 2
    assert (old.count(), store.read("bronze.moves").count(), store.read("bronze.moves", 1).count()) == (5, 3, 5)
    assert store.release("bronze.moves") == [1] and store.versions("bronze.moves") == [2]
    with pytest.raises(ValueError, match="version 1"):
        store.read("bronze.moves", 1)
    with pytest.raises(ValueError):
        store.release("bronze.moves", 0)


def test_failed_write_changes_nothing(spark, tmp_path):
    store = Layers(spark, str(tmp_path), TABLES)
    store.write("bronze.moves", moves(spark, 5))
    broken = moves(spark, 5).withColumn("amount", F.when(F.col("id") == 4, F.raise_error("broken").cast("double")).otherwise(0.0))
    with pytest.raises(Exception, match="broken"):
        store.write("bronze.moves", broken)
    assert store.versions("bronze.moves") == [1] and store.read("bronze.moves").count() == 5
    assert [p.name for p in (tmp_path / "bronze" / "moves").iterdir() if not p.name.startswith("v")] == []


def test_second_writer_of_a_version_fails(spark, tmp_path, monkeypatch):
    store = Layers(spark, str(tmp_path), TABLES)
    store.write("bronze.moves", moves(spark, 5))
    monkeypatch.setattr(store, "versions", lambda name: [])
    with pytest.raises(Exception, match="exist"):
        store.write("bronze.moves", moves(spark, 1))
    monkeypatch.undo()
    assert store.read("bronze.moves").count() == 5


def test_declared_columns_and_required_tables(spark, tmp_path):
    store = Layers(spark, str(tmp_path), TABLES)
    with pytest.raises(ValueError, match="amount missing; x not declared; id is int, declared bigint"):
        store.write("bronze.moves", spark.sql("SELECT 1 AS id, 2 AS x"))
    with pytest.raises(ValueError, match="not found: bronze.moves, gold.totals"):
        store.require(["bronze.moves", "gold.totals"])
    store.create("bronze.moves")
    store.create("bronze.moves")
    store.require(["bronze.moves"])
    assert store.versions("bronze.moves") == [1] and store.read("bronze.moves").count() == 0
    assert not store.write_if_absent("bronze.moves", moves(spark, 2)) and store.write_if_absent("gold.totals", spark.sql("SELECT 3L AS n"))
    store.append("bronze.moves", moves(spark, 2))
    store.append("bronze.moves", moves(spark, 2))
    assert {tuple(r) for r in store.row_counts("bronze").collect()} == {("bronze.moves", 4)}
    assert store.row_counts("silver").collect() == []
    other = Layers(spark, str(tmp_path), {"bronze.moves": "id string, amount double"})
    with pytest.raises(ValueError, match="id is bigint"):
        other.require(["bronze.moves"])
    for bad in ("copper.moves", "bronze", "bronze.a/b"):
        with pytest.raises(ValueError):
            Layers(spark, str(tmp_path), {bad: "x int"})


def test_catalog_swap_leaves_no_gap(spark, tmp_path):
    try:
        sinks.create_table(spark, "swap_a", "id bigint, amount double", str(tmp_path / "a"))
        sinks.append(moves(spark, 5), "swap_a")
        old = spark.table("swap_a")
        sinks.swap(spark.table("swap_a").where("id > 1"), "swap_a")
        assert (old.count(), spark.table("swap_a").count()) == (5, 3)
        with pytest.raises(Exception):
            sinks.swap(spark.table("swap_a").withColumn("amount", F.raise_error("broken").cast("double")), "swap_a")
        assert spark.table("swap_a").count() == 3
    finally:
        spark.sql("DROP TABLE IF EXISTS swap_a")
