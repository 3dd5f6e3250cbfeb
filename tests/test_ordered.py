"""Ordered operators on groups that are cut into many runs: against plain loops, and no window over a whole group."""

import random

import pytest

from pyspark.sql import functions as F

from tests.compare import SF
from tidewater import plans
from tidewater.operators import ordered as O
from tidewater.operators import series as S


@pytest.fixture(scope="module")
def rows():
    """One group holds nearly all rows; a null group; groups of a row."""
    r = random.Random(4)
    out = [(0, i, r.choice([0.0] * 9 + [1.0, -1.0]), r.uniform(-1, 1)) for i in range(2500)]
    out += [(g, i, r.choice([0.0, 1.0]), r.uniform(-1, 1)) for g in range(1, 9) for i in range(r.randint(1, 12))] + [(None, i, 0.0, 0.5) for i in range(70)]
    r.shuffle(out)
    return out


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, "g int, i int, x double, k double").repartition(4)


def groups(rows):
    out = {}
    for row in sorted(rows, key=lambda t: (t[0] is not None, t[0] or 0, t[1])):
        out.setdefault(row[0], []).append(row)
    return out


@pytest.mark.parametrize("run", [7, 64, O.RUN])
def test_numbers_and_next_and_discounts(frame, rows, run):
    got = {(r.g, r.i): r for r in O.next_marked(O.numbered(frame, ["g"], ["i"], run), ["g"], F.col("x") != 0, F.col("x")).collect()}
    disc = {(r.g, r.i): r.disc for r in O.discounted(frame, "x", 0.9, ["i"], ["g"], run).collect()}
    assert len(got) == len(disc) == len(rows)
    for g, own in groups(rows).items():
        nxt = None
        for n in range(len(own), 0, -1):
            _, i, x, _ = own[n - 1]
            nxt = (n, x) if x else nxt
            r = got[g, i]
            assert r.rn == n and (r.next and tuple(r.next)) == nxt
            assert disc[g, i] == pytest.approx(nxt[1] * 0.9 ** (nxt[0] - n) if nxt else 0.0)


@pytest.mark.parametrize("k,block", [(1, 2), (3, 5), (30, 64), (3, O.RUN)])
def test_frames_reach_over_blocks(frame, rows, k, block):
    blocks, w = O.haloed(O.numbered(frame, ["g"], ["i"], 50), ["g"], k, block)
    got = blocks.withColumn("s", F.collect_list("i").over(w.rowsBetween(-k, 0))).where("NOT halo")
    got = {(r.g, r.i): r.s for r in got.collect()}
    for g, own in groups(rows).items():
        for n, row in enumerate(own):
            assert got[g, row[1]] == [x[1] for x in own[max(0, n - k) : n + 1]]
    assert len(got) == len(rows)


@pytest.mark.parametrize("fan,run", [(2, 9), (16, 100), (O.FAN, O.RUN)])
def test_recurrence_at_every_step(frame, rows, fan, run):
    args = (frame, ["g"], "i", "k", "x", F.lit(3.0), fan, run)
    steps = {(r.g, r["at"]): r.x for r in O.recurrence_steps(*args).collect()}
    last = {r.g: r.x for r in O.recurrence(*args).collect()}
    assert len(steps) == len(rows)
    for g, own in groups(rows).items():
        x = 3.0
        for _, i, e, k in own:
            x = x * k + e
            assert steps[g, i] == pytest.approx(x, rel=1e-9, abs=1e-12)
        assert last[g] == pytest.approx(x, rel=1e-9, abs=1e-12)


def test_totals_of_groups(frame, rows):
    got = O.with_group_totals(O.numbered(frame, ["g"], ["i"], 20), ["g"], {"n": F.count("*"), "s": F.sum("x")}).collect()
    want = {g: (len(own), sum(r[2] for r in own)) for g, own in groups(rows).items()}
    assert len(got) == len(rows) and all((r.n, r.s) == want[r.g] for r in got)


def test_no_rows(spark):
    none = spark.createDataFrame([], "g int, i int, x double, k double")
    assert O.recurrence_steps(none, ["g"], "i", "k", "x", F.lit(1.0)).count() == 0
    assert O.recurrence(none, ["g"], "i", "k", "x", F.lit(1.0)).count() == 0
    assert O.discounted(none, "x", 0.9, ["i"], ["g"]).count() == 0


@pytest.mark.parametrize("name", ["frame_stack_newest_first", "eps_schedule", "discounted_reward", "discounted_reward_z", "decay_deposit_steps", "absorbing_layers_steps"])
def test_no_window_of_rows_by_the_key_alone(spark, name):
    """Windows over rows are by the key and its run or block; those by the key alone are over one row a run."""
    plan = plans.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan()
    lines = [line for line in plan.toString().split("\n") if " Window [" in line or line.lstrip("+-: ").startswith("Window [")]
    for line in lines:
        assert "run#" in line or "block#" in line, line


def test_spread_of_one_key(spark):
    """All rows of one key: every task of the sort and of the blocks gets its part."""
    df = spark.range(40_000).select(F.lit(1).alias("g"), F.col("id").alias("i"))
    n = O.numbered(df, ["g"], ["i"], 1000)
    blocks, _ = O.haloed(n, ["g"], 5, 1000)
    sizes = [r["count"] for r in blocks.groupBy("block").count().collect()]
    assert len(sizes) in (40, 41) and max(sizes) <= 1005
    assert max(r["count"] for r in n.groupBy("run").count().collect()) <= 1000
    w = S.over(["rn"], ["g", "block"])
    assert blocks.withColumn("s", F.sum("i").over(w.rowsBetween(-5, 0))).where("NOT halo").agg(F.count("*")).first()[0] == 40_000
