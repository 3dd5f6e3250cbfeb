"""Hand-computed answers for null, tie and boundary rules; closed forms against plain loops."""

import random

from pyspark.sql import functions as F

from tidewater.operators import profile as P
from tidewater.operators import series as S


def column(spark, values, col):
    df = spark.createDataFrame(list(enumerate(values)), "i int, x double")
    return [r.y for r in df.select("i", col.alias("y")).orderBy("i").collect()]


def test_windows(spark):
    assert column(spark, [1.0, None, 2.0, 3.0, 4.0], S.rolling_mean("x", 2, ["i"])) == [None, None, None, 2.5, 3.5]
    assert column(spark, [1.0, None, 2.0], S.cumulative_sum("x", ["i"])) == [1, None, 3]
    assert column(spark, [100.0, 0.0, 5.0], S.percent_change("x", ["i"])) == [None, -100, None]
    assert column(spark, [None, 5.0, None, None, 7.0], S.forward_fill("x", ["i"])) == [0, 5, 5, 5, 7]
    shown = column(spark, [1.0] * 60, S.display_mean("x", 50, ["i"]))
    assert (shown[49], shown[50]) == (1, 1.02)


def test_discounted_reward_is_the_reverse_scan(spark):
    assert [round(v, 4) for v in column(spark, [0.0, 0.0, 1.0, 0.0, -1.0, 0.0], S.discounted("x", 0.99, ["i"]))] == [0.9801, 0.99, 1, -0.99, -1, 0]
    r = random.Random(3)
    rewards = [r.choice([0.0, 0.0, 0.0, 1.0, -1.0]) for _ in range(300)]
    want, run = [], 0.0
    for x in reversed(rewards):
        run = x if x else run * 0.9
        want.append(run)
    got = column(spark, rewards, S.discounted("x", 0.9, ["i"]))
    assert all(abs(a - b) < 1e-12 for a, b in zip(got, reversed(want), strict=True))


def test_histogram_zipf_and_inverse_cdf(spark):
    df = spark.createDataFrame([(v,) for v in (0.0, 0.5, 1.2, 1.4, 2.0, 2.5, 3.0, 3.5, None)], "x double")
    hist = P.histogram(df, "x", 1.0, 3)
    assert [r.n for r in hist.orderBy("bin").collect()] == [1, 3, 2]
    curve = P.zipf_rank(hist)
    assert [(r.n, r.cumul) for r in curve.orderBy("bin").collect()] == [(3, 3), (2, 5), (1, 6)]
    draws = spark.createDataFrame([(1.5,), (3.0,), (4.0,), (6.0,)], "r double")
    assert [r.x for r in P.inverse_cdf(draws, curve).orderBy("r").collect()] == [0.25, 0.5, 1.0, 2.5]


def test_correlation_uses_pairwise_complete_rows(spark):
    df = spark.createDataFrame([(1.0, 2.0, 1.0), (2.0, None, 5.0), (3.0, 7.0, 2.0), (None, 1.0, 8.0)], "a double, b double, c double")
    got = {(r.a, r.b): round(r.r, 6) for r in P.correlation_matrix(df, ["a", "b", "c"]).collect()}
    assert (got["a", "b"], got["a", "c"], got["b", "c"]) == (1, 0.240192, -0.520401)


def test_bands_and_splits(spark):
    grid = F.array(*[F.lit(float(i)) for i in range(10, 100, 10)])
    assert column(spark, [5.0, 10.0, 95.0, None], P.decile_band(F.col("x"), grid)) == [0, 1, 9, 9]
    df = spark.range(101)
    assert S.hash_split(df, "id", 0.2).where("test").count() == 21
    assert S.chronological_split(df, ["id"], 0.8).where("train").count() == 80
