"""Joins by place and by order: nearest segment, vision cone, next ahead, overlap, gather, paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions import scalars as S
from tidewater.operators import spatial as G

#: Places of a set whose pairs are all wanted, at most.
PLACES = 10_000


def visibility(points: DataFrame, alpha: float) -> DataFrame:
    """(i, j, w): 1 / distance^alpha for all pairs of a set of places (id, x, y), 0 on the diagonal.

    All pairs are the result, so the set is one of places, not of observations; more than PLACES are refused."""
    if points.limit(PLACES + 1).count() > PLACES:
        raise ValueError(f"visibility is for {PLACES} places at most")
    a = points.select(F.col("id").alias("i"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    b = points.select(F.col("id").alias("j"), F.col("x").alias("bx"), F.col("y").alias("by"))
    dist = G.distance(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))
    return a.crossJoin(b).select("i", "j", F.when(F.col("i") == F.col("j"), 0.0).otherwise(F.try_divide(F.lit(1.0), F.pow(dist, F.lit(alpha)))).alias("w"))


def first_in_sight(agents: DataFrame, targets: DataFrame, reach: float, half_angle: float) -> DataFrame:
    """(id, target): for each agent (id, x, y, direction) that sees a target (id, x, y), the one of the smallest id.

    Only targets of the cells around an agent are looked at."""
    near = G.within(targets, agents, reach, centre_cols=["direction"])
    seen = near.where(S.sees(F.col("x") - F.col("cx"), F.col("y") - F.col("cy"), F.col("direction"), reach, half_angle))
    return seen.groupBy(F.col("centre").alias("id")).agg(F.min("id").alias("target"))


def clear_of(points: DataFrame, others: DataFrame, radius: float) -> DataFrame:
    """The points (id, x, y, ...) farther than ``radius`` from all others (id, x, y)."""
    hit = G.within(points, others, radius).select("id").distinct()
    return points.join(hit, "id", "left_anti")


def next_ahead(points: DataFrame, obstacles: DataFrame, lane: str, width: float) -> DataFrame:
    """(id, obstacle, ahead): the obstacle (id, x) of the point's lane with the least x that is strictly greater, and
    how far it is; null without one.  Ties to the smaller id.

    Lanes are cut into buckets of ``width``: a window looks inside a bucket, and what comes after it is told by
    the first obstacle of each later bucket, so that a long lane is spread over tasks."""
    cut = lambda c: F.floor(c / width)
    rows = points.select(lane, "x", "id", F.lit(None).cast("struct<x:double,id:long>").alias("o"))
    mark = F.struct(F.col("x").cast("double").alias("x"), F.col("id").cast("long").alias("id"))
    rows = rows.unionByName(obstacles.select(lane, "x", F.lit(None).cast("long").alias("id"), mark.alias("o"))).withColumn("b", cut(F.col("x")))
    # From high to low, points before the obstacles of their own x.
    down = Window.partitionBy(lane, "b").orderBy(F.desc("x"), F.col("o").isNotNull(), F.desc("o.id")).rowsBetween(Window.unboundedPreceding, 0)
    inside = rows.withColumn("hit", F.last("o", ignorenulls=True).over(down)).where("o is null")
    later = rows.groupBy(lane, "b").agg(F.min("o").alias("first"))
    after = Window.partitionBy(lane).orderBy(F.desc("b")).rowsBetween(Window.unboundedPreceding, -1)
    later = later.select(lane, "b", F.last("first", ignorenulls=True).over(after).alias("next"))
    hit = F.coalesce("hit", "next")
    return inside.join(later, [lane, "b"]).select("id", hit["id"].alias("obstacle"), (hit["x"] - F.col("x")).alias("ahead"))


def overlapping(rects: DataFrame, others: DataFrame, cell: float) -> DataFrame:
    """(a, b) of overlapping rectangles (id, x, y, w, h: centre and half extents; touching counts), found by shared cells."""

    def cells(df: DataFrame, p: str) -> DataFrame:
        lo, hi = (lambda c, h: F.floor((F.col(c) - F.col(h)) / cell)), (lambda c, h: F.floor((F.col(c) + F.col(h)) / cell))
        out = df.select(*[F.col(c).alias(p + c) for c in ("id", "x", "y", "w", "h")], F.explode(F.sequence(lo("x", "w"), hi("x", "w"))).alias("gx"), F.sequence(lo("y", "h"), hi("y", "h")).alias("gys"))
        return out.withColumn("gy", F.explode("gys")).drop("gys")

    pairs = cells(rects, "a").join(cells(others, "b"), ["gx", "gy"])
    meet = (F.abs(F.col("ax") - F.col("bx")) <= F.col("aw") + F.col("bw")) & (F.abs(F.col("ay") - F.col("by")) <= F.col("ah") + F.col("bh"))
    # A pair is taken in the first cell that both cover.
    first = lambda c, h: F.greatest(F.floor((F.col("a" + c) - F.col("a" + h)) / cell), F.floor((F.col("b" + c) - F.col("b" + h)) / cell))
    return pairs.where(meet & (F.col("gx") == first("x", "w")) & (F.col("gy") == first("y", "h"))).select(F.col("aid").alias("a"), F.col("bid").alias("b"))


def path_sum(paths: DataFrame, weights: DataFrame, by: list[str], order: list[str], city: str) -> DataFrame:
    """(by, total, edges): the weights (i, j, w) along each path, from every place to the next; missing edges count 0."""
    step = paths.select(*by, F.col(city).alias("i"), F.lead(city).over(Window.partitionBy(*by).orderBy(*order)).alias("j")).where("j is not null")
    # Steps are counted before the join, so that a hot edge is one row a path.
    step = step.groupBy(*by, "i", "j").agg(F.count("*").alias("n"))
    out = step.join(weights, ["i", "j"], "left")
    return out.groupBy(*by).agg(F.sum(F.col("n") * F.coalesce("w", F.lit(0.0))).alias("total"), F.sum("n").alias("edges"))


def neighbour_counts(points: DataFrame, size: float) -> DataFrame:
    """(id, n): how many other points lie in a point's cell and the eight around it; cells are counted first."""
    here = points.select("id", F.floor(F.col("x") / size).alias("gx"), F.floor(F.col("y") / size).alias("gy"))
    cells = here.groupBy("gx", "gy").agg(F.count("*").alias("n"))
    near = F.array(*[F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    around = cells.select("gx", "gy", "n", F.inline(near)).select((F.col("gx") + F.col("dx")).alias("gx"), (F.col("gy") + F.col("dy")).alias("gy"), "n")
    around = around.groupBy("gx", "gy").agg(F.sum("n").alias("n"))
    return here.join(around, ["gx", "gy"]).select("id", (F.col("n") - 1).alias("n"))


def neighbour_means(points: DataFrame, radius: float, cols: list[str]) -> DataFrame:
    """(id, cols, n): the means over the other points within ``radius`` of each point that has any."""
    more = [c for c in cols if c not in ("id", "x", "y")]
    near = G.within(points, points, radius, point_cols=more).where("centre <> id")
    return near.groupBy(F.col("centre").alias("id")).agg(*[F.avg(c).alias(c) for c in cols], F.count("*").alias("n"))


def best_sensor(agents: DataFrame, raster: DataFrame, reach: float, angles: list[float], size: int) -> DataFrame:
    """(id, sensor, total): each agent (id, x, y, direction) sums the raster (x, y, v) in a square of ``size`` cells at
    ``reach`` in every direction of ``angles`` (degrees), and takes the first sensor of the greatest sum."""
    turn = F.array(*[F.struct(F.lit(i).alias("sensor"), F.lit(float(a)).alias("turn")) for i, a in enumerate(angles)])
    look = agents.select("id", "x", "y", "direction", F.inline(turn))
    a = F.radians(F.col("direction") + F.col("turn"))
    corner = lambda c, f: (F.col(c) + reach * f(a) - size / 2).cast("int")
    look = look.select("id", "sensor", corner("x", F.cos).alias("x0"), corner("y", F.sin).alias("y0"))
    look = look.select("id", "sensor", F.explode(F.sequence(F.col("x0"), F.col("x0") + (size - 1))).alias("x"), "y0")
    look = look.select("id", "sensor", "x", F.explode(F.sequence(F.col("y0"), F.col("y0") + (size - 1))).alias("y"))
    sums = look.join(raster, ["x", "y"], "left").groupBy("id", "sensor").agg(F.coalesce(F.sum("v"), F.lit(0)).alias("total"))
    best = sums.groupBy("id").agg(F.max(F.struct(F.col("total"), (-F.col("sensor")).alias("s"))).alias("b"))
    return best.select("id", (-F.col("b.s")).alias("sensor"), F.col("b.total").alias("total"))
