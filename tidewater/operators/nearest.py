"""Nearest neighbours of points among segments: branch and bound over a packed index of boxes.

The segments are sorted along a space-filling curve and packed ``FAN`` to a box, the boxes again, until one row of boxes is left
(a handful of levels for any number of segments).  The points go down level by level: a box is as near as its
nearest edge and, as it holds a segment, no farther than its farthest corner.  So the least of these farthest distances bounds
what a point can find, and boxes that are wholly farther than that are left out.  A level is a join on the box (AQE
splits a box that very many points look into) and a minimum by point.  Up to ``FAN`` segments need neither: they go along in the plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions import scalars as S
from tidewater.tables import scratch, table

#: Segments or boxes in a box.
FAN = 64
#: Tasks that pack a level at most.
MOST_TASKS = 10_000
#: What rounding may add to a bound.
_SLACK = 1 + 1e-9
_SEG, _BOX = ["sid", "ax", "ay", "bx", "by"], ["node", "x0", "y0", "x1", "y1"]


#: Bits of a coordinate on the curve.
_BITS = 16


def _hilbert(x: str, y: str) -> Column:
    """The place on a Hilbert curve, whose neighbours are neighbours in the plane, of the cell (x, y)."""
    rx, ry = "(shiftright(a.x, k) & 1)", "(shiftright(a.y, k) & 1)"
    turn = lambda c: f"if({rx} = 1, {(1 << _BITS) - 1}L - a.{c}, a.{c})"
    moved = lambda c, other: f"if({ry} = 0, {turn(other)}, a.{c})"
    d = f"a.d + shiftleft(cast(((3 * {rx}) ^ {ry}) AS bigint), 2 * k)"
    start = f"named_struct('x', {x}, 'y', {y}, 'd', 0L)"
    return F.expr(f"aggregate(sequence({_BITS - 1}, 0, -1), {start}, (a, k) -> named_struct('x', {moved('x', 'y')}, 'y', {moved('y', 'x')}, 'd', {d})).d")


def _curve(seg: DataFrame) -> DataFrame:
    """Segments with their box and the place of its middle on a curve through 2^16 by 2^16 cells."""
    lo, hi = (lambda a, b: F.least(a, b)), (lambda a, b: F.greatest(a, b))
    seg = seg.withColumns({"x0": lo("ax", "bx"), "y0": lo("ay", "by"), "x1": hi("ax", "bx"), "y1": hi("ay", "by")})
    r = seg.agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")).first()
    cell = lambda a, b, least, most: F.floor(((F.col(a) - least) / 2 + (F.col(b) - least) / 2) / ((most - least) or 1.0) * 65535).cast("long")
    seg = seg.withColumns({"cx": cell("x0", "x1", r.x0, r.x1), "cy": cell("y0", "y1", r.y0, r.y1)})
    return seg.withColumn("z", _hilbert("cx", "cy")).drop("cx", "cy")


def _pack(rows: DataFrame, order: list[str], item: Column, fan: int) -> DataFrame:
    """(node, box, items): neighbours in order, ``fan`` to a node."""
    # No task packs fewer than a few boxes, so that each level is smaller than the one below.
    tasks = max(1, min(rows.count() // (16 * fan), MOST_TASKS))
    rows = rows.repartitionByRange(tasks, *order).sortWithinPartitions(*order).withColumn("node", F.expr(f"monotonically_increasing_id() div {fan}"))
    return rows.groupBy("node").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.collect_list(item).alias("items"))


def packed_index(segments: DataFrame, fan: int = FAN) -> tuple[list[DataFrame], list]:
    """The levels of the index over segments (sid, ax, ay, bx, by), leaves first, each a written table (node, items), and the boxes of
    the last one, ``fan`` at most."""
    if fan < 2:
        raise ValueError("a box holds two or more")
    cur = table(_pack(_curve(segments), ["z", "sid"], F.struct(*_SEG), fan), "index")
    levels = [cur]
    while True:
        top = cur.select(*_BOX).limit(fan + 1).collect()
        if len(top) <= fan:
            return levels, top
        cur = table(_pack(cur.select(F.col("node").alias("child"), *_BOX[1:]), ["child"], F.struct(F.col("child").alias("node"), *_BOX[1:]), fan), "index")
        levels.append(cur)


def _least(x: Column, y: Column, b: Column) -> Column:
    dx, dy = F.greatest(b["x0"] - x, x - b["x1"], F.lit(0.0)), F.greatest(b["y0"] - y, y - b["y1"], F.lit(0.0))
    return dx * dx + dy * dy


def _most(x: Column, y: Column, b: Column) -> Column:
    dx, dy = F.greatest(F.abs(x - b["x0"]), F.abs(x - b["x1"])), F.greatest(F.abs(y - b["y0"]), F.abs(y - b["y1"]))
    return dx * dx + dy * dy


def _place(x: Column, y: Column, s: Column) -> Column:
    """(d2, segment, x, y): the foot of the point or, where that lies outside, the end b."""
    fx, fy, along = S.projected(x, y, s["ax"], s["ay"], s["bx"], s["by"])
    outside = along.isNull() | (along < 0) | (along > S.length(s["bx"] - s["ax"], s["by"] - s["ay"]))
    tx, ty = F.when(outside, s["bx"]).otherwise(fx), F.when(outside, s["by"]).otherwise(fy)
    d2 = (tx - x) * (tx - x) + (ty - y) * (ty - y)
    return F.struct(d2.alias("d2"), s["sid"].alias("segment"), tx.alias("x"), ty.alias("y"))


def _literal(rows: list, names: list[str]) -> Column:
    return F.array(*[F.struct(*[F.lit(r[n]).alias(n) for n in names]) for r in rows])


def nearest_segment(points: DataFrame, segments: DataFrame, fan: int = FAN, counts: bool = False) -> DataFrame:
    """(id, segment, x, y, d2): for each point (id, x, y) the segment (id, ax, ay, bx, by) whose nearest place,
    the foot of the point or, where that lies outside, the end b, is nearest; ties to the smaller id.  ``counts`` adds ``seen``,
    the segments measured.

    Ids are unique.  A point without a coordinate finds nothing (nulls), nor does any where there is no segment; segments without
    a coordinate are not found."""
    seg = segments.select(F.col("id").alias("sid"), *[F.col(c).cast("double").alias(c) for c in _SEG[1:]]).dropna(subset=_SEG[1:])
    pts = points.select("id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    placed, x, y = pts.dropna(subset=["x", "y"]), F.col("x"), F.col("y")
    few = seg.limit(fan + 1).collect()
    out = ["id", "p.segment", "p.x", "p.y", "p.d2", *(["seen"] if counts else [])]
    if not few:
        found = placed.select("id", F.lit(None).cast(f"struct<d2:double,segment:{seg.schema['sid'].dataType.simpleString()},x:double,y:double>").alias("p"), F.lit(0).alias("seen"))
    elif len(few) <= fan:
        found = placed.select("id", F.array_min(F.transform(_literal(few, _SEG), lambda s: _place(x, y, s))).alias("p"), F.lit(len(few)).alias("seen"))
    else:
        with scratch() as keep:
            levels, top = packed_index(seg, fan)
            for t in levels:
                keep(t)
        cur = placed.withColumn("boxes", _literal(top, _BOX))
        cur = cur.withColumn("bound", F.array_min(F.transform("boxes", lambda b: _most(x, y, b))))
        near = lambda bound: (lambda b: _least(x, y, b) <= bound * _SLACK)
        for level in levels[:0:-1]:
            row = _into(cur, level, near)
            row = row.withColumn("bound", F.least("bound", F.array_min(F.transform("items", lambda b: _most(x, y, b)))))
            row = row.withColumn("boxes", F.filter("items", near(F.col("bound"))))
            cur = row.groupBy("id").agg(F.first("x").alias("x"), F.first("y").alias("y"), F.min("bound").alias("bound"), F.flatten(F.collect_list("boxes")).alias("boxes"))
        # The nearest box first: what is found there leaves few of the others.
        near_first = F.array_min(F.transform("boxes", lambda b: F.struct(_least(x, y, b).alias("d"), b["node"].alias("node"))))["node"]
        leaves, best = levels[0].select("node", "items"), F.array_min(F.transform("items", lambda s: _place(x, y, s)))
        row = cur.withColumn("node", near_first).join(leaves, "node").select("id", "x", "y", "boxes", "node", best.alias("p"), F.size("items").alias("n"))
        row = row.select("*", F.col("p.d2").alias("reach"))
        rest = F.filter("boxes", lambda b: (_least(x, y, b) <= F.col("reach") * _SLACK) & (b["node"] != F.col("node")))
        row = row.select("id", "x", "y", "p", "n", F.transform(rest, lambda b: b["node"]).alias("rest"))
        row = row.select("id", "x", "y", "p", "n", F.explode_outer("rest").alias("node"))
        # A number of no box where there is no other, so that these rows don't meet.
        row = row.withColumn("node", F.coalesce("node", -1 - F.pmod(F.xxhash64("id"), F.lit(1 << 20)))).join(leaves, "node", "left")
        row = row.select("id", "n", F.when(F.col("items").isNull(), F.col("p")).otherwise(F.least("p", best)).alias("p"), F.coalesce(F.size("items"), F.lit(0)).alias("m"))
        found = row.groupBy("id").agg(F.min("p").alias("p"), (F.max("n") + F.sum(F.greatest("m", F.lit(0)))).alias("seen"))
    missing = pts.where("x IS NULL OR y IS NULL").select("id", F.lit(None).cast(found.schema["p"].dataType).alias("p"), F.lit(0).alias("seen"))
    return found.unionByName(missing).select(*out)


def _into(cur: DataFrame, level: DataFrame, near) -> DataFrame:
    """A row for each point and box that may hold its nearest, with what is in the box."""
    boxes = F.filter("boxes", near(F.col("bound")))
    rows = cur.select("id", "x", "y", "bound", F.explode(F.transform(boxes, lambda b: b["node"])).alias("node"))
    return rows.join(level.select("node", "items"), "node")
