"""Operators that must not pass a whole column through one task: results against plain Python, and their plans."""

import math
import random

from pyspark.sql import functions as F

from tidewater.operators import evaluate as E
from tidewater.operators import profile as P
from tidewater.operators import series as S


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_order_statistics(spark, monkeypatch):
    r = random.Random(1)
    values = {
        "even": [r.uniform(-5, 5) for _ in range(3000)],
        "ties": [float(r.choice([1, 1, 1, 2, 7])) for _ in range(3000)],
        "skew": [math.exp(r.uniform(-300, 300)) * r.choice([-1, 1]) for _ in range(3000)],
        "ends": [r.choice([math.inf, -math.inf, 0.0, 1.5]) for _ in range(3000)],
        "gaps": [r.choice([None, math.nan, r.random()]) for _ in range(3000)],
        "none": [None] * 3000,
    }
    df = spark.createDataFrame(list(zip(*values.values(), strict=True)), ", ".join(f"{c} double" for c in values))
    monkeypatch.setattr(P, "CUTS", 16)
    clean = {c: sorted(x for x in v if x is not None and not math.isnan(x)) for c, v in values.items()}
    ranks = {c: [0, 1, len(v) // 3, len(v) - 1] if v else [] for c, v in clean.items()}
    got = P.order_statistics(df, ranks)
    assert got == {c: {k: clean[c][k] for k in ks} for c, ks in ranks.items()}
    q = P.quantiles(df, ["even", "none"], [0.1, 0.5, 1.0])
    v = clean["even"]
    for p, x in zip([0.1, 0.5, 1.0], q["even"], strict=True):
        h = (len(v) - 1) * p
        assert abs(x - (v[int(h)] + (v[min(int(h) + 1, len(v) - 1)] - v[int(h)]) * (h - int(h)))) < 1e-12
    assert q["none"] == [None] * 3


def test_describe_of_empty_and_one_row(spark):
    empty = P.describe(spark.createDataFrame([], "x double, y int"), ["x", "y"]).collect()
    assert [(r.name, r.n, r.q50) for r in empty] == [("x", 0, None), ("y", 0, None)]
    one = P.describe(spark.createDataFrame([(4,)], "y int"), ["y"]).first()
    assert (one.n, one.mean, one.lo, one.q25, one.hi) == (1, 4, 4, 4, 4) and one.sd is None


def test_hash_split_compares_and_does_not_shuffle(spark, monkeypatch):
    df = spark.range(5000).withColumn("v", F.lit("x"))
    want = [r.id for r in df.select("id", F.md5(F.concat(F.lit("s"), F.col("id").cast("string"))).alias("h")).orderBy("h", "id").limit(math.ceil(5000 * 0.3)).collect()]
    for rows in (50_000, 7):
        monkeypatch.setattr(S, "SPLIT_ROWS", rows)
        out = S.hash_split(df, "id", 0.3, "s")
        assert {r.id for r in out.where("test").collect()} == set(want)
    assert "Window" not in plan(out) and "Join" not in plan(out) and "Aggregate" not in plan(out)
    assert S.hash_split(df, "id", 0.0).where("test").count() == 0 and S.hash_split(df, "id", 1.0).where("not test").count() == 0
    assert S.hash_split(spark.range(0), "id", 0.5).count() == 0


def test_curve_of_many_scores(spark):
    r = random.Random(2)
    rows = [(int(r.random() < 0.3), r.random() if i % 3 else round(r.random(), 1)) for i in range(4000)]
    df = spark.createDataFrame(rows, "y int, p double")
    got = {x.threshold: (x.precision, x.recall) for x in E.precision_recall_curve(df, "y", "p").collect()}
    positives = sum(y for y, _ in rows)
    rows.sort(key=lambda x: -x[1])
    hits, want = 0, {}
    for n, (y, p) in enumerate(rows, 1):
        hits += y
        want[p] = (hits / n, hits / positives)
    assert got.keys() == want.keys() and all(abs(a - b) < 1e-12 for p in want for a, b in zip(got[p], want[p], strict=True))
    assert "partitionBy" in plan(E.precision_recall_curve(df, "y", "p")) or "__range" in plan(E.precision_recall_curve(df, "y", "p"))
    assert E.precision_recall_curve(df.limit(0), "y", "p").count() == 0


def test_value_counts_shares(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "k string")
    assert [(r.k, r.n, r.share) for r in P.value_counts(df, "k").collect()] == [("a", 2, 0.5), (None, 1, 0.25), ("b", 1, 0.25)]
    assert P.value_counts(df.limit(0), "k").count() == 0


def test_shuffled_places_and_sample(spark):
    out = S.shuffled(spark.range(1000), "id", "q").orderBy("place").collect()
    assert [r.place for r in out] == list(range(1, 1001)) and [r.id for r in out] != list(range(1000))
    assert [r.id for r in S.sample(spark.range(1000), "id", 5, "q").collect()] == [r.id for r in out[:5]]
