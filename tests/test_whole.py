"""Results over the whole input, where a query or its SQL once stopped short."""

import random

from pyspark.sql import functions as F

from tests.compare import SF, connect
from tidewater import plans
from tidewater.operators import ordered as O
from tidewater.operators import series as S


def test_anova_top3_ranks_all_dimensions(spark):
    cells = connect().execute("SELECT i, label, x FROM (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings)").fetchall()
    by = {}
    for i, label, x in cells:
        by.setdefault(i, {}).setdefault(label, []).append(x)
    assert len(by) == 64

    def f(groups):
        n, mean = sum(map(len, groups)), sum(map(sum, groups)) / sum(map(len, groups))
        between = sum(len(g) * (sum(g) / len(g) - mean) ** 2 for g in groups) / (len(groups) - 1)
        return between / (sum((x - sum(g) / len(g)) ** 2 for g in groups for x in g) / (n - len(groups)))

    want = sorted(((f(list(g.values())), f"e{i}") for i, g in by.items()), reverse=True)[:3]
    got = plans.QUERIES["anova_top3"](spark, SF).collect()
    assert [r.name for r in got] == [name for _, name in want] == ["e61", "e32", "e6"]
    assert all(abs(r.f - v) < 1e-5 for r, (v, _) in zip(got, want, strict=True))


def test_recurrence_composes_chunks_of_a_hot_group(spark):
    r = random.Random(4)
    rows = [(0 if i % 3 else i % 50, i, r.choice([0.0, 0.5, 0.9, 1.1]), r.uniform(-5, 5)) for i in range(6000)]
    rows += [(99, 1, 0.9, None), (99, 2, 0.9, 1.0), *[(98, i, 2.0, 0.0) for i in range(3000)]]
    r.shuffle(rows)
    want = {}
    for g, _, k, e in sorted(rows, key=lambda x: x[:2]):
        x = want.get(g, 0.0)
        want[g] = None if x is None or e is None else x * k + e
    out = O.recurrence(spark.createDataFrame(rows, "g int, i int, k double, e double"), ["g"], "i", "k", "e", F.lit(0.0))
    got = {x.g: x.x for x in out.collect()}
    assert got.keys() == want.keys()
    assert all((v is None) == (got[g] is None) and (v is None or abs(v - got[g]) < 1e-9) for g, v in want.items())


def test_discounted_frames_grow_by_a_row(spark):
    df = spark.createDataFrame([(i, float(i % 7 == 0)) for i in range(20)], "i int, x double")
    plan = df.select(S.discounted("x", 0.9, ["i"]))._jdf.queryExecution().optimizedPlan().toString()
    assert "unboundedfollowing" not in plan


def test_stream_buckets_hold_every_event(spark):
    """The newest buckets too, which an hour of lateness used to hold back."""
    got = plans.QUERIES["stream_bucket_means"](spark, SF).collect()
    events = connect().execute("SELECT count(value), CAST(time_bucket(INTERVAL '20 minutes', max(ts)) AS VARCHAR) FROM events").fetchone()
    assert (sum(r.n for r in got), max(r.start for r in got)) == events
