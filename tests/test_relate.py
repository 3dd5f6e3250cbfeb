"""Joins by place and order against all pairs, with ties, nulls and empty tables."""

import math
import re
import random

import pytest
from pyspark.sql import functions as F

from tidewater.operators import relate as R
from tidewater.operators import signal as W
from tidewater.operators import spatial as G

PTS = "id long, x double, y double"


def cloud(seed, n, start=0):
    r = random.Random(seed)
    return [(start + i, round(r.uniform(-3, 3), 1), round(r.uniform(-3, 3), 1)) for i in range(n)]


def test_within_and_clear_of(spark):
    a, b = cloud(1, 60), cloud(2, 40, 100)
    pa = spark.createDataFrame([*a, (900, None, 1.0)], PTS)
    pb = spark.createDataFrame([*b, (901, None, None)], PTS)
    near = {(c[0], p[0]) for c in b for p in a if math.sqrt((p[1] - c[1]) ** 2 + (p[2] - c[2]) ** 2) <= 0.5}
    assert {(r.centre, r.id) for r in G.within(pa, pb, 0.5).collect()} == near
    assert {r.id for r in R.clear_of(pa, pb, 0.5).collect()} == {p[0] for p in a} - {i for _, i in near} | {900}
    assert R.clear_of(pa, pb.limit(0), 0.5).count() == 61 and G.within(pa.limit(0), pb, 0.5).count() == 0


def test_next_ahead_with_ties_and_gaps(spark):
    r = random.Random(5)
    pts = [(i, float(r.randint(-20, 20)), i % 3) for i in range(80)]
    obs = [(500 + i, float(r.randint(-20, 20)), i % 2) for i in range(25)]
    schema = "id long, x double, lane int"
    for width in (0.7, 5.0, 1000.0):
        got = {x.id: (x.obstacle, x.ahead) for x in R.next_ahead(spark.createDataFrame(pts, schema), spark.createDataFrame(obs, schema), "lane", width).collect()}
        want = {}
        for i, x, lane in pts:
            ahead = sorted((ox, o) for o, ox, ol in obs if ol == lane and ox > x)
            want[i] = (ahead[0][1], ahead[0][0] - x) if ahead else (None, None)
        assert got == want


def test_overlaps_touch_and_count_once(spark):
    r = random.Random(6)
    rects = [(i, *[float(r.randint(-6, 6)) for _ in range(2)], float(r.randint(0, 3)), float(r.randint(0, 3))) for i in range(40)]
    df = spark.createDataFrame(rects, "id long, x double, y double, w double, h double")
    got = sorted((x.a, x.b) for x in R.overlapping(df, df, 2.0).collect())
    want = sorted((a[0], b[0]) for a in rects for b in rects if abs(a[1] - b[1]) <= a[3] + b[3] and abs(a[2] - b[2]) <= a[4] + b[4])
    assert got == want


def test_neighbours_sensors_and_paths(spark):
    pts = cloud(7, 70)
    df = spark.createDataFrame(pts, PTS)
    cell = {i: (math.floor(x / 0.7), math.floor(y / 0.7)) for i, x, y in pts}
    want = {i: sum(abs(c[0] - e[0]) <= 1 and abs(c[1] - e[1]) <= 1 for e in cell.values()) - 1 for i, c in cell.items()}
    assert {r.id: r.n for r in R.neighbour_counts(df, 0.7).collect()} == want
    agents = spark.createDataFrame([(1, 0.0, 0.0, 0), (2, 50.0, 50.0, 90)], "id long, x double, y double, direction int")
    raster = spark.createDataFrame([(x, y, 1 + (y > 0)) for x in range(-9, 10) for y in range(-9, 10)], "x int, y int, v int")
    got = {r.id: (r.sensor, r.total) for r in R.best_sensor(agents, raster, 6.0, [-40, 0, 40], 3).collect()}
    assert got == {1: (2, 18), 2: (0, 0)}
    paths = spark.createDataFrame([("p", i, c) for i, c in enumerate("abab")] + [("q", 0, "a")], "k string, i int, c string")
    edges = spark.createDataFrame([("a", "b", 2.0)], "i string, j string, w double")
    assert [tuple(r) for r in R.path_sum(paths, edges, ["k"], ["i"], "c").collect()] == [("p", 4.0, 3)]


def test_convolution_by_hand(spark):
    r = random.Random(8)
    image = [[r.randint(0, 9) for _ in range(6)] for _ in range(5)]
    cells = spark.createDataFrame([("k", x, y, float(v)) for x, row in enumerate(image) for y, v in enumerate(row)], "k string, x int, y int, v double")
    kernel = [[1.0, -1.0], [0.5, 2.0]]
    for stride in (1, 2):
        got = {(c.x, c.y): c.v for c in W.convolve(cells, kernel, 5, 6, ["k"], stride).collect()}
        want = {(x // stride, y // stride): sum(image[x + i][y + j] * kernel[i][j] for i in (0, 1) for j in (0, 1)) for x in range(0, 4, stride) for y in range(0, 5, stride)}
        assert got == want
    flat = W.rescaled(cells.withColumn("v", F.lit(3.0)), ["k"])
    assert {c.v for c in flat.collect()} == {0.0}


def test_spectrum_of_a_sine(spark):
    rows = [("s", i, math.sin(2 * math.pi * 5 * i / 64)) for i in range(64)] + [("z", i, 0.0) for i in range(4)]
    got = W.spectrum(spark.createDataFrame(rows, "tag string, i int, v double"), "tag", ["i"], "v", 64.0).collect()
    top = max((r for r in got if r.tag == "s"), key=lambda r: r.power)
    assert top.k == 5 and top.frequency == 5.0 and {r.power for r in got if r.tag == "z"} == {0.0}


def test_full_cells_are_dealt_into_blocks(spark, monkeypatch):
    """Hot cells, each point once; as many tasks as the pairs ask for, and no block of more pairs than allowed but by chance."""
    r = random.Random(11)
    rows = [(i, r.gauss(0, 0.1), r.gauss(0, 0.1)) for i in range(400)] + [(400 + i, r.uniform(-9, 9), r.uniform(-9, 9)) for i in range(200)]
    p = spark.createDataFrame(rows, "id long, x double, y double")
    want = sorted((a, b) for a, ax, ay in rows if a % 5 == 0 for b, bx, by in rows if math.sqrt((bx - ax) ** 2 + (by - ay) ** 2) <= 0.5)
    monkeypatch.setattr(G, "PAIRS", 500)
    out = G.within(p, p.where("id % 5 = 0"), 0.5)
    assert sorted((x.centre, x.id) for x in out.collect()) == want
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    tasks = [int(n) for n in re.findall(r"RepartitionByExpression .*?, (\d+)", plan)]
    assert "__block" in plan and len(tasks) == 2 and min(tasks) > 100
