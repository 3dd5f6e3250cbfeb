"""The packed index of segments against all pairs, its bounds, and what it looks at."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tests.compare import SF
from tidewater import plans
from tidewater.operators import nearest as N

PTS, SEGS = "id long, x double, y double", "id long, ax double, ay double, bx double, by double"


def brute(pts, segs):
    want = {}
    for i, x, y in pts:
        best = []
        for s, ax, ay, bx, by in segs:
            n = math.hypot(bx - ax, by - ay)
            along = ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / n if n else None
            inside = along is not None and 0 <= along <= n
            tx, ty = (ax + (bx - ax) / n * along, ay + (by - ay) / n * along) if inside else (bx, by)
            best.append(((tx - x) ** 2 + (ty - y) ** 2, s))
        want[i] = min(best)
    return want


def cases(seed):
    r = random.Random(seed)
    at = lambda k=1: [round(r.uniform(-3, 3), k) for _ in range(2)]
    segs = [(i, *at(), *at()) for i in range(60)] + [(100 + i, 1.0, 1.0, 1.0, 1.0) for i in range(30)] + [(200 + i, *(p := at(4)), p[0] + 0.01, p[1]) for i in range(200)]
    pts = [(i, *at()) for i in range(150)] + [(900, 1e6, -1e6), (901, 1.0, 1.0)]
    return pts, segs


@pytest.mark.parametrize("fan", [2, 8, 1000])
def test_same_as_all_pairs(spark, fan):
    pts, segs = cases(fan)
    got = N.nearest_segment(spark.createDataFrame(pts, PTS), spark.createDataFrame(segs, SEGS).repartition(5), fan)
    got, want = {r.id: r for r in got.collect()}, brute(pts, segs)
    assert got.keys() == want.keys()
    assert all(abs(got[i].d2 - d) <= 1e-9 * max(1, d) for i, (d, _) in want.items())
    assert got[901].segment == want[901][1]


def test_missing_coordinates_and_no_segments(spark):
    pts = spark.createDataFrame([(1, None, 0.0), (2, 0.0, 0.0)], PTS)
    segs = [(1, None, 0.0, 0.0, 0.0), (2, 5.0, 5.0, 5.0, 5.0)]
    for fan in (2, 64):
        got = {r.id: (r.segment, r.d2) for r in N.nearest_segment(pts, spark.createDataFrame(segs + [(i, 9.0, 9.0, 9.0, 9.0) for i in range(3, 6)], SEGS), fan).collect()}
        assert got == {1: (None, None), 2: (2, 50.0)}
    got = N.nearest_segment(pts, spark.createDataFrame(segs[:1], SEGS)).collect()
    assert sorted((r.id, r.segment) for r in got) == [(1, None), (2, None)]
    assert N.nearest_segment(pts.limit(0), spark.createDataFrame(segs, SEGS)).count() == 0


def test_few_of_a_hundred_thousand_segments_are_measured(spark):
    n = 100_000
    h = lambda salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(1_000_000)) / 1000.0
    segs = spark.range(n).select("id", h(1).alias("ax"), h(2).alias("ay")).select("id", "ax", "ay", (F.col("ax") + h(3) / 1000).alias("bx"), (F.col("ay") + h(4) / 1000).alias("by"))
    hot = spark.range(500).select("id", F.lit(500.0).alias("x"), F.lit(500.0).alias("y"))
    pts = spark.range(500, 1500).select("id", h(5).alias("x"), h(6).alias("y")).unionByName(hot)
    out = N.nearest_segment(pts, segs, counts=True)
    rows = out.collect()
    seen = [r.seen for r in rows]
    assert len(rows) == 1500 and sum(seen) / len(seen) < 300 and max(seen) < 2000
    some = [r for r in rows if r.id % 250 == 0]
    where = {r.id: (r.x, r.y) for r in pts.where("id % 250 = 0").collect()}
    want = brute([(i, *p) for i, p in where.items()], [tuple(r) for r in segs.collect()])
    assert len(some) == 6 and all(abs(r.d2 - want[r.id][0]) < 1e-9 for r in some)


def test_no_nested_loop(spark):
    pts, segs = cases(1)
    p, s = spark.createDataFrame(pts, PTS), spark.createDataFrame(segs, SEGS)
    for df in (N.nearest_segment(p, s), N.nearest_segment(p, s, 8), plans.QUERIES["nearest_segment"](spark, SF)):
        plan = df._jdf.queryExecution().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
