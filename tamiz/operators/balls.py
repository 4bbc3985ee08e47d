"""Exact neighbours and extreme distances of any number of rows, by balls and the triangle inequality.

Rows are dealt to their nearest pivot, a row of the table itself; the rows of one pivot are a ball with a radius. A row
can have a neighbour within distance t in a ball only if its distance to that ball's pivot is at most t plus the radius,
and for every closer ball the pivots' distance bounds it once more. A pair of balls holds distances between
``centre distance - radii`` and ``centre distance + radii``. What these bounds leave open is looked at row by row, inside
tasks of bounded size: a ball of many rows, equal ones too, is cut into cells.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tamiz.operators import kernels, pairs
from tamiz.session import cut_lineage

PIVOTS = 2048  # bound of the pivots that reach the driver and every task
CELL_ROWS = 1024
ASKED_ROWS = 512
SLACK = 1e-9  # relative; rounding must not close a ball that holds an equal distance
FAN_OUT = 16
FIRST_PAIRS = 256


def labelled_rows(points: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """``id, vec, label`` with vectors as doubles; rows without a vector are left out."""
    rows = points.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"), F.col(label_col).alias("label"))
    return rows.where(F.col("vec").isNotNull())


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=float).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def pivots_of(rows: DataFrame, most: int = PIVOTS) -> np.ndarray:
    """About the square root of the table's rows, at most ``most``, chosen by a hash of the id; distinct."""
    n = rows.count()
    wanted = min(most, max(1, round(n**0.5)))
    chosen = rows.select("vec", F.xxhash64("id", F.lit(7)).alias("h"), "id").orderBy("h", "id").limit(wanted).collect()
    return np.unique(_matrix(pd.Series([r["vec"] for r in chosen], dtype=object)), axis=0)


def dealt(rows: DataFrame, pivots: np.ndarray, cell_rows: int = CELL_ROWS) -> tuple[DataFrame, DataFrame]:
    """``id, vec, label, ball, away, cell`` of every row, and ``ball, n, cells, radius`` of every ball.

    Cells are hash parts of a ball, so that a ball of any size comes in pieces of about ``cell_rows``.
    """

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            d = kernels.distances(_matrix(batch["vec"]), pivots) if len(batch) else np.zeros((0, len(pivots)))
            near = d.argmin(axis=1) if len(batch) else np.zeros(0, dtype=int)
            yield batch.assign(ball=near.astype("int32"), away=d[np.arange(len(batch)), near])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    placed = cut_lineage(rows.mapInPandas(deal, f"{fields}, ball int, away double"))
    balls = placed.groupBy("ball").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("radius"))
    balls = cut_lineage(balls.select("ball", "n", F.ceil(F.col("n") / cell_rows).cast("int").alias("cells"), "radius"))
    part = F.pmod(F.xxhash64("id", F.lit(11)), F.col("cells")).cast("int")
    return placed.join(balls.select("ball", "cells"), "ball").withColumn("part", part).drop("cells"), balls


def _closest(mine: np.ndarray, ids: np.ndarray, x: np.ndarray, others: np.ndarray, k: int):
    """Per row of ``x`` its k nearest of another id: places and distances, ties to the smaller id."""
    d = kernels.distances(x, others)
    d[mine[:, None] == ids[None, :]] = np.inf
    take = min(k, len(ids))
    by_id = np.argsort(ids, kind="stable")
    order = by_id[np.argsort(d[:, by_id], axis=1, kind="stable")[:, :take]]
    return order, np.take_along_axis(d, order, axis=1)


_FOUND = "id bigint, label {label}, d double, other bigint, other_label {label}"


def _search_cells(members: DataFrame, visitors: DataFrame, k: int, label: str) -> DataFrame:
    """Each visitor against the members of the cell it visits, at most k results within its reach.

    A cell's members come first in its task and stay (``CELL_ROWS`` of them); visitors pass in batches.
    """
    both = members.select("ball", "part", F.lit(0).alias("turn"), "id", "vec", "label", F.lit(None).cast("double").alias("reach")).unionByName(
        visitors.select("ball", "part", F.lit(1).alias("turn"), "id", "vec", "label", "reach")
    )
    spread = both.repartition("ball", "part").sortWithinPartitions("ball", "part", "turn")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held = None, []
        for batch in batches:
            for cell, rows in batch.groupby(["ball", "part"], sort=False):
                if cell != key:
                    key, held = cell, []
                held.append(rows[rows["turn"] == 0])
                asking = rows[rows["turn"] == 1]
                if not len(asking):
                    continue
                held = [pd.concat(held)]
                known = held[0]
                if not len(known):
                    continue
                ids, labels = known["id"].to_numpy(), known["label"].to_numpy()
                others = _matrix(known["vec"])
                for start in range(0, len(asking), ASKED_ROWS):
                    some = asking.iloc[start : start + ASKED_ROWS]
                    place, d = _closest(some["id"].to_numpy(), ids, _matrix(some["vec"]), others, k)
                    row, at = np.nonzero(np.isfinite(d) & (d <= some["reach"].to_numpy()[:, None]))
                    yield pd.DataFrame(
                        {
                            "id": some["id"].to_numpy()[row], "label": some["label"].to_numpy()[row], "d": d[row, at],
                            "other": ids[place[row, at]], "other_label": labels[place[row, at]],
                        }
                    )

    return spread.mapInPandas(search, _FOUND.format(label=label))


def _blocks_of(known: list, reach: dict[int, float], between: np.ndarray, blocks: int) -> tuple[list, list]:
    """Block of the asking rows of each cell, and the blocks that the rows of each ball have to pass.

    Blocks are runs of cells with about as many rows each. A block is passed unless the triangle inequality puts the ball
    out of reach of every ball in it.
    """
    total, before, cells, held = sum(r["n"] for r in known), 0, [], {}
    for r in known:
        for part in range(r["cells"]):
            block = min(blocks - 1, before * blocks // total)
            cells.append((r["ball"], part, block))
            held.setdefault(r["ball"], set()).add(block)
            before += -(-r["n"] // r["cells"])
    balls = [r["ball"] for r in known]
    radius = np.array([r["radius"] for r in known])
    far = between[np.ix_(balls, balls)]
    slack = SLACK * (far + radius[:, None] + radius[None, :])
    near = far - radius[:, None] - radius[None, :] <= np.array([reach[b] for b in balls])[:, None] + slack
    passed = []
    for j, ball in enumerate(balls):
        blocks_of_ball = sorted(set().union(*[held[balls[i]] for i in np.flatnonzero(near[:, j])]))
        passed.append((ball, blocks_of_ball))
    return cells, passed


def nearest_rows(points: DataFrame, id_col: str, vec_col: str, label_col: str, k: int = 10, pivots: int = PIVOTS,
                 cell_rows: int = CELL_ROWS) -> DataFrame:
    """``id, label, rank, other, other_label, d``: the k nearest rows of every row, ties to the smaller id.

    First every row is compared with its own cell. The k-th distance found there is its reach. Then tasks hold blocks of
    asking rows, and the balls that the triangle inequality leaves open to a block pass by; a row looks at a ball only if
    the ball can hold something nearer than its k nearest so far. Ids have to be unique; labels may be null.
    """
    rows = labelled_rows(points, id_col, vec_col, label_col)
    spark, label = rows.sparkSession, rows.schema["label"].dataType.simpleString()
    centres = pivots_of(rows, pivots)
    if not len(centres):
        return spark.createDataFrame([], _FOUND.format(label=label)).select("id", "label", F.lit(1).alias("rank"), "other", "other_label", "d")
    placed, balls = dealt(rows, centres, cell_rows)
    placed = cut_lineage(placed)

    own = placed.withColumn("reach", F.lit(float("inf")))
    first = _search_cells(placed, own, k, label)
    reach = first.groupBy("id").agg(F.count(F.lit(1)).alias("found"), F.max("d").alias("kth"))
    reach = reach.select("id", F.when(F.col("found") >= k, F.col("kth")).alias("kth"))
    asking = placed.join(reach, "id", "left").withColumn("reach", F.coalesce("kth", F.lit(float("inf")))).drop("kth")
    asking = cut_lineage(asking)

    # One row per pivot: bounded by ``pivots``.
    known = balls.orderBy("ball").collect()
    farthest = {r["ball"]: r["most"] for r in asking.groupBy("ball").agg(F.max("reach").alias("most")).collect()}
    radius = np.full(len(centres), -1.0)
    for r in known:
        radius[r["ball"]] = r["radius"]
    between = kernels.distances(centres, centres)
    blocks = pairs.blocks_for(sum(r["n"] for r in known), 2 * centres.shape[1] + 4 * k, spark.sparkContext.defaultParallelism)
    cells, passed = _blocks_of(known, farthest, between, blocks)
    block_of = spark.createDataFrame(cells, "ball int, part int, block int")
    blocks_of = spark.createDataFrame(passed, "ball int, blocks array<int>")
    kept = ["ball", "id", "vec", "label"]
    members = placed.select(*kept).join(F.broadcast(blocks_of), "ball")
    asking = asking.join(block_of, ["ball", "part"]).select(*kept, "away", "reach", "block")
    both = pairs.met(asking, members, blocks).select("turn", *kept, "away", "reach").sortWithinPartitions("turn", "ball")

    def found_by(rows: pa.RecordBatch, held: pairs.Nearest) -> Iterator[pa.RecordBatch]:
        row, at = np.nonzero(np.isfinite(held.d))
        ids, labels = rows.column("id"), rows.column("label")
        tags = pa.array(held.tag[row, at].tolist(), labels.type)
        columns = [ids.take(pa.array(row)), labels.take(pa.array(row)), pa.array(held.d[row, at]), pa.array(held.other[row, at]), tags]
        yield pa.RecordBatch.from_arrays(columns, names=["id", "label", "d", "other", "other_label"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, asked, held = [], None, None
        for batch in batches:
            cut = int(np.searchsorted(batch.column("turn").to_numpy(), 1))
            if cut:
                waiting.append(batch.slice(0, cut))
            if cut == len(batch) or not waiting:
                continue
            if held is None:
                asked = pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
                x = pairs.matrix(asked.column("vec"))
                origin = x.mean(axis=0)
                side = pairs.Side(x, origin, True)
                mine, home = asked.column("ball").to_numpy(), asked.column("away").to_numpy()
                ids = asked.column("id").to_numpy()
                order = np.argsort(ids, kind="stable")
                held = pairs.Nearest(len(x), k, asked.column("reach").to_numpy())
            of_ball = batch.column("ball").to_numpy()
            ends = np.append(np.flatnonzero(of_ball[cut + 1 :] != of_ball[cut:-1]) + cut + 1, len(batch))
            for start, end in zip(np.append(cut, ends[:-1]), ends):
                ball = of_ball[start]
                d, gap = pairs.exact(x, centres[ball]), between[mine, ball]
                t = np.minimum(held.reach, held.d[:, -1]) + SLACK * (d + radius[ball])
                with np.errstate(divide="ignore", invalid="ignore"):
                    plane = np.where(gap > 0, (d * d - home * home) / (2 * gap) - 1e-14 * d * d / gap, 0.0)
                look = np.flatnonzero((d - radius[ball] <= t) & (plane <= t))
                for at in range(start, end if len(look) else start, pairs.TILE_ROWS):
                    some = batch.slice(at, min(pairs.TILE_ROWS, end - at))
                    others, tags = some.column("id").to_numpy(), np.empty(len(some), dtype=object)
                    tags[:] = some.column("label").to_pylist()
                    there = pairs.Side(pairs.matrix(some.column("vec")), origin, False)
                    same, member = pairs.same_key(ids[order], order, others)
                    for low in range(0, len(look), pairs.TILE_ROWS):
                        rows = look[low : low + pairs.TILE_ROWS]
                        d2, off = pairs.squares(side, rows, there)
                        place = np.searchsorted(rows, same)
                        here = (place < len(rows)) & (rows[np.minimum(place, len(rows) - 1)] == same)
                        d2[place[here], member[here]] = np.inf
                        held.take(side, rows, there, others, tags, d2, off)
        if held is not None:
            yield from found_by(asked, held)

    found = both.mapInArrow(search, _FOUND.format(label=label))
    order = Window.partitionBy("id").orderBy("d", "other")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("id", "label", "rank", "other", "other_label", "d")


def connectivity(points: DataFrame, id_col: str, vec_col: str, label_col: str, neighbours: int = 10, **sizes: int) -> DataFrame:
    """One row ``connectivity``: over all rows, 1/j for every j-th nearest neighbour of another label."""
    near = nearest_rows(points, id_col, vec_col, label_col, neighbours, **sizes)
    penalty = F.when(~F.col("label").eqNullSafe(F.col("other_label")), 1.0 / F.col("rank")).otherwise(0.0)
    return near.agg(F.coalesce(F.sum(penalty), F.lit(0.0)).alias("connectivity"))


class _Extreme:
    """What is looked for: the least distance between labels, or the greatest within one."""

    def __init__(self, widest: bool):
        self.widest = widest
        self.best: float | None = None

    def take(self, value: float | None) -> None:
        if value is not None and (self.best is None or (value > self.best if self.widest else value < self.best)):
            self.best = float(value)

    def open_pairs(self, pairs: DataFrame) -> DataFrame:
        """Pairs whose bound could still beat the best distance known."""
        if self.best is None:
            return pairs
        edge = self.best * (1 - SLACK) if self.widest else self.best * (1 + SLACK)
        return pairs.where(F.col("bound") > edge) if self.widest else pairs.where(F.col("bound") < edge)


def _distance(a: Column | str, b: Column | str) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))


def _bounded(pairs: DataFrame, info: DataFrame, widest: bool) -> DataFrame:
    """``a, b, bound, known, tight``: what a pair could hold at best, a distance it does hold, whether they are equal."""
    sides = [
        info.select(F.col("ball").alias(s), F.col("centre").alias(f"c{s}"), F.col("radius").alias(f"r{s}"), F.col("n").alias(f"n{s}")) for s in "ab"
    ]
    met = pairs.join(sides[0], "a").join(sides[1], "b").withColumn("mid", _distance("ca", "cb"))
    reach = F.col("ra") + F.col("rb")
    bound = F.col("mid") + reach if widest else F.greatest(F.col("mid") - reach, F.lit(0.0))
    if widest:  # inside one ball the radius is a distance between two rows, and twice the radius the most there can be
        known = F.when(F.col("a") == F.col("b"), F.col("ra")).otherwise(F.greatest("mid", "ra", "rb"))
    else:
        known = F.col("mid")
    return met.select("a", "b", bound.alias("bound"), known.alias("known"), (reach == 0).alias("tight"), (F.greatest("na", "nb")).alias("n"))


def _split(rows: DataFrame, info: DataFrame, which: DataFrame, fan_out: int) -> DataFrame:
    """Rows of the balls in ``which`` dealt to sub-balls around ``fan_out`` of their own rows; ``parent`` is kept.

    The centre and a row at the full radius are among them, so every ball that has a radius comes apart.
    """
    active = rows.drop("parent", "centre").join(info.join(which, "ball").select("ball", "radius"), "ball")
    first = F.when(F.col("away") == 0, 0).when(F.col("away") == F.col("radius"), 1).otherwise(2)
    order = Window.partitionBy("ball").orderBy("turn", F.xxhash64("id", F.lit(13), "ball"), "id")
    turns = active.select("ball", "vec", "id", first.alias("turn"))
    # One row at the radius is enough: the others wait with the rest.
    edge = turns.where("turn = 1").groupBy("ball").agg(F.min("id").alias("edge"))
    turns = turns.join(edge, "ball", "left").withColumn("turn", F.when((F.col("turn") == 1) & (F.col("id") != F.col("edge")), 2).otherwise(F.col("turn")))
    seeds = turns.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= fan_out)
    seeds = seeds.groupBy("ball").agg(F.array_sort(F.collect_list(F.struct("nth", "vec"))).alias("seeds"))
    nearest = F.array_min(
        F.transform("seeds", lambda s: F.struct(_distance("vec", s["vec"]).alias("d"), s["nth"].alias("nth"), s["vec"].alias("vec")))
    )
    joined = active.join(seeds, "ball").withColumn("at", nearest)
    return joined.select(
        "id", "vec", "label", F.col("ball").alias("parent"), F.concat_ws(".", "ball", F.col("at.nth")).alias("ball"),
        F.col("at.vec").alias("centre"), F.col("at.d").alias("away"),
    )


def _info(rows: DataFrame) -> DataFrame:
    return rows.groupBy("ball").agg(
        F.first("label").alias("label"), F.first("parent").alias("parent"), F.first("centre").alias("centre"),
        F.max("away").alias("radius"), F.count(F.lit(1)).alias("n"),
    )


def _extreme_of(a: np.ndarray, b: np.ndarray, widest: bool) -> float:
    """Extreme distance between two sets: found by matrix products, taken from plain differences."""
    best, origin = None, b.mean(axis=0)
    left, right = pairs.Side(a, origin, True), pairs.Side(b, origin, False)
    for start in range(0, len(a), pairs.TILE_ROWS):
        d2, off = pairs.squares(left, slice(start, start + pairs.TILE_ROWS), right)
        edge = d2.max() - 2 * off if widest else d2.min() + 2 * off
        i, j = np.nonzero(d2 >= edge if widest else d2 <= edge)
        for at in range(0, len(i), pairs.AT_ONCE):
            d = pairs.exact(a[start + i[at : at + pairs.AT_ONCE]], b[j[at : at + pairs.AT_ONCE]])
            found = float(d.max() if widest else d.min())
            best = found if best is None else max(best, found) if widest else min(best, found)
    return best


def _looked_at(chosen: DataFrame, rows: DataFrame, widest: bool) -> float | None:
    """Extreme distance over the rows of a few pairs of small balls, one task per pair."""
    named = chosen.withColumn("pair", F.concat_ws("|", "a", "b"))
    sides = [
        rows.select(F.col("ball").alias(s), "vec").join(named.select("pair", s), s).select("pair", F.lit(s).alias("side"), "vec") for s in "ab"
    ]

    def extreme(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = (_matrix(pdf.loc[pdf["side"] == s, "vec"]) for s in "ab")
        return pd.DataFrame({"d": [_extreme_of(a, b, widest)]})

    found = sides[0].unionByName(sides[1]).groupBy("pair").applyInPandas(extreme, "d double")
    return found.agg((F.max if widest else F.min)("d").alias("d")).first()["d"]


def extreme_distance(points: DataFrame, id_col: str, vec_col: str, label_col: str, widest: bool, cell_rows: int = CELL_ROWS,
                     fan_out: int = FAN_OUT) -> float | None:
    """Greatest distance within a label (``widest``), or least distance between labels; None where there is no pair.

    Starts with one ball per label. In each round the pairs of balls whose bound cannot beat the best distance known are
    dropped, and the larger balls of the others are split. Pairs of balls of at most ``cell_rows`` rows are looked at row
    by row, the most promising first, four times as many in each round. Rows without a label are left out.
    """
    rows = labelled_rows(points, id_col, vec_col, label_col).where(F.col("label").isNotNull())
    rows = rows.groupBy("label", "vec").agg(F.min("id").alias("id"))  # equal rows of a label give no other distance
    order = F.min(F.struct(F.xxhash64("id", F.lit(5)), "id", "vec")).alias("s")
    centres = rows.groupBy("label").agg(order).select("label", F.col("s.vec").alias("centre"))
    whole = rows.join(centres, "label").select(
        "id", "vec", "label", F.lit("").alias("parent"), F.concat(F.lit("l"), F.col("label").cast("string")).alias("ball"), "centre",
        _distance("vec", "centre").alias("away"),
    )
    rows = cut_lineage(whole)
    info = cut_lineage(_info(rows))
    if widest:
        pairs = info.select(F.col("ball").alias("a"), F.col("ball").alias("b"))
    else:  # one ball per label: a short list
        listed = info.agg(F.array_sort(F.collect_list("ball")).alias("balls")).select("balls", F.posexplode("balls").alias("at", "a"))
        pairs = listed.select("a", F.explode(F.slice("balls", F.col("at") + 2, F.size("balls"))).alias("b"))
    goal = _Extreme(widest)
    while True:
        bounded = cut_lineage(_bounded(pairs, info, widest))
        ends = bounded.agg((F.max if widest else F.min)("known").alias("known")).first()
        goal.take(ends["known"])
        alive = goal.open_pairs(bounded).where(~F.col("tight"))
        small = alive.where(F.col("n") <= cell_rows)
        large = alive.where(F.col("n") > cell_rows)
        _finish(goal, small, rows, widest)
        large = cut_lineage(goal.open_pairs(large).select("a", "b"))
        if large.isEmpty():
            return goal.best
        which = large.select(F.col("a").alias("ball")).union(large.select(F.col("b").alias("ball"))).distinct()
        rows = cut_lineage(_split(rows, info, which, fan_out))
        info = cut_lineage(_info(rows))
        below = info.select("parent", "ball")
        firsts = below.select(F.col("parent").alias("a"), F.col("ball").alias("x"))
        seconds = below.select(F.col("parent").alias("b"), F.col("ball").alias("y"))
        pairs = large.join(firsts, "a").join(seconds, "b").where((F.col("a") != F.col("b")) | (F.col("x") <= F.col("y")))
        pairs = pairs.select(F.col("x").alias("a"), F.col("y").alias("b"))


def _finish(goal: _Extreme, small: DataFrame, rows: DataFrame, widest: bool) -> None:
    """Look at the pairs of small balls, the most promising first, until no bound can beat what was found."""
    take = FIRST_PAIRS
    order = F.desc("bound") if widest else F.asc("bound")
    left = goal.open_pairs(small)
    while True:
        chosen = cut_lineage(left.orderBy(order, "a", "b").limit(take))
        if chosen.isEmpty():
            return
        goal.take(_looked_at(chosen, rows, widest))
        left = goal.open_pairs(left.join(chosen.select("a", "b"), ["a", "b"], "left_anti"))
        take *= 4


def dunn(points: DataFrame, id_col: str, vec_col: str, label_col: str, **sizes: int) -> DataFrame:
    """One row ``gap, diameter, dunn``: least distance between labels over the greatest within one."""
    spark = points.sparkSession
    gap = extreme_distance(points, id_col, vec_col, label_col, False, **sizes)
    diameter = extreme_distance(points, id_col, vec_col, label_col, True, **sizes)
    ratio = gap / diameter if gap is not None and diameter else None
    return spark.createDataFrame([(gap, diameter, ratio)], "gap double, diameter double, dunn double")
