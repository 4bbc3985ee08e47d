"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tamiz.llm.base import Stages


def _fingerprint(links: DataFrame):
    return tuple(links.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first())


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``links(a, b)`` to ``(node, root)``, where root is the smallest node of the component.

    Each round hangs every node below the smallest neighbour it knows; the number of links never grows, a round moves
    them through joins that AQE can split, and minima are taken map-side first. Nodes without links are not returned.
    """
    stages = Stages(links.sparkSession)
    links = stages.keep(
        links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    )
    before = _fingerprint(links)
    for _ in range(max_rounds):
        both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = stages.keep(both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = stages.keep(moved.unionAll(low.select("a", F.col("m").alias("b"))).distinct())
        stages.drop(links, large)
        links, after = small, _fingerprint(small)
        if after == before:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(
                links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        before = after
    raise RuntimeError("components did not settle; raise max_rounds")
