"""Points in the plane: range and distance queries by a grid, tours."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def in_rectangle(x: Column, y: Column, cx: float, cy: float, half_w: float, half_h: float) -> Column:
    """Both bounds inclusive."""
    return x.between(cx - half_w, cx + half_w) & y.between(cy - half_h, cy + half_h)


#: Pairs of one group of a join by place, and of one task, at most.
PAIRS = 1 << 25


def within(points: DataFrame, centres: DataFrame, radius: float, point_cols: list[str] | None = None, centre_cols: list[str] | None = None) -> DataFrame:
    """(centre, id, dist) of all points at most ``radius`` from a centre; both have (id, x, y).  With ``point_cols`` or
    ``centre_cols``, columns of either side that have names of their own, also these and the places x, y, cx, cy.

    Cells as wide as the radius: a centre looks in its own and the eight around it, so that the join
    is on the cell and a point meets only its surroundings.  The pairs of each cell are counted first: where they are more than
    PAIRS in all, the points of a full cell are dealt into blocks, each of which meets all the cell's centres, and the join gets as many tasks."""
    cell = lambda c: F.floor(F.col(c) / radius)
    near = F.array(*[F.lit(k) for k in (-1, 0, 1)])
    wide = centres.select(F.col("id").alias("centre"), F.col("x").alias("cx"), F.col("y").alias("cy"), *(centre_cols or []), F.explode(F.transform(near, lambda k: k + cell("x"))).alias("gx"), cell("y").alias("g"))
    wide = wide.select("centre", "cx", "cy", *(centre_cols or []), "gx", F.explode(F.transform(near, lambda k: k + F.col("g"))).alias("gy"))
    points = points.withColumns({"gx": cell("x"), "gy": cell("y")})
    keys = ["gx", "gy"]
    filled = points.groupBy(*keys).agg(F.count("*").alias("p")).join(wide.groupBy(*keys).agg(F.count("*").alias("c")), keys)
    pairs = filled.select(*keys, (F.col("p").cast("double") * F.col("c")).alias("n"))
    total = pairs.agg(F.sum("n")).first()[0] or 0.0
    if total > PAIRS:
        # A full cell has PAIRS pairs: they are few beside the points.
        full = F.broadcast(pairs.where(F.col("n") > PAIRS).select(*keys, F.ceil(F.col("n") / PAIRS).alias("__blocks")))
        blocks = F.coalesce("__blocks", F.lit(1).cast("long"))
        keys = [*keys, "__block"]
        # A few blocks a task, so that tasks are alike.
        tasks = max(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(math.ceil(2 * total / PAIRS), 20_000))
        points = points.join(full, ["gx", "gy"], "left").withColumn("__block", F.pmod(F.xxhash64("id", "x", "y"), blocks)).drop("__blocks").repartition(tasks, *keys)
        wide = wide.join(full, ["gx", "gy"], "left").withColumn("__block", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))).drop("__blocks").repartition(tasks, *keys)
    dist = distance(F.col("x"), F.col("y"), F.col("cx"), F.col("cy"))
    out = points.join(wide, keys).withColumn("dist", dist)
    more = [] if point_cols is None and centre_cols is None else ["x", "y", "cx", "cy", *(point_cols or []), *(centre_cols or [])]
    return out.where(F.col("dist") <= radius).select("centre", "id", "dist", *more)


def close_pairs(points: DataFrame, radius: float) -> DataFrame:
    """(a, b, dist) of all pairs a < b at most ``radius`` apart."""
    return within(points, points, radius).where("centre < id").select(F.col("centre").alias("a"), F.col("id").alias("b"), "dist")


def tour_length(points: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The length of each closed tour through the points of a group, in order."""
    w = Window.partitionBy(*by).orderBy(*order)
    nxt = F.coalesce(F.lead(F.struct("x", "y")).over(w), F.first(F.struct("x", "y")).over(w))
    leg = points.select(*by, "x", "y", nxt.alias("n")).select(*by, distance(F.col("x"), F.col("y"), F.col("n.x"), F.col("n.y")).alias("leg"))
    return leg.groupBy(*by).agg(F.sum("leg").alias("length"))
