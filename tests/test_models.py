"""Models by held-out accuracy, exact neighbours by brute force, and streams over several micro-batches."""

import math
import random

from pyspark.ml import Pipeline
from pyspark.ml.classification import LinearSVC
from pyspark.sql import Observation
from pyspark.sql import functions as F

from tests.compare import SF
from tidewater import plans
from tidewater.operators import ensemble as EN
from tidewater.operators import learn as M
from tidewater.streaming import stateful as ST


def test_models_held_out(spark):
    got = {(r.model, r.metric): r.value for r in plans.QUERIES["model_comparison"](spark, SF).collect()}
    assert set(m for m, _ in got) == {*M.MODELS, "kernel"} and all(v > 0.85 for v in got.values()), got
    top = plans.QUERIES["feature_importances"](spark, SF).collect()
    assert len(top) == 26 and abs(sum(r.importance for r in top) - 1) < 1e-9
    curve = {r.share: r.mean for r in plans.QUERIES["learning_curve"](spark, SF).collect()}
    assert len(curve) == 5 and curve[1.0] > 0.85 and curve[1.0] >= curve[0.1] - 0.02
    r = plans.QUERIES["matrix_factors"](spark, SF).first()
    assert r.of_factors < r.of_means


def test_the_labels_cannot_be_read_off(spark):
    """Shuffled labels are not learnt."""
    from tidewater.plans import models

    data = models._task(spark, SF)
    other = data.withColumn("label", F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("double"))
    test = F.pmod(F.xxhash64(F.lit("t"), "doc_id"), F.lit(2)) == 0
    score = dict(((n, m), v) for n, m, v in M.compare({"tree": M.prepared(M.MODELS["tree"]())}, other.where(~test), other.where(test)))
    assert score["tree", "accuracy"] < 0.65


def test_letter_shares_by_hand_in_one_pass(spark):
    """Every letter of texts with signs of one to four bytes, capitals, nothing and null; the text is named once in the plan, not once a letter."""
    from tidewater.plans import models

    texts = ["Abba", "", None, "\u00c9t\u00e9 zz \U0001f600", "123 \u0130\u212a", "q" * 300 + "\u20ac"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(3)
    got = {r.i: r.s for r in df.select("i", models.letter_shares(F.lower("text")).alias("s")).collect()}
    for i, t in enumerate(texts):
        low = (t or "").lower()
        assert got[i] == [low.count(c) / len(low) if low else 0.0 for c in models.NAMES], i
    plan = models._task(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(text") == 1 and "translate" not in plan


def test_saved_model_scores_the_same(spark):
    r = plans.QUERIES["saved_model_scores"](spark, SF).first()
    assert r.differ == 0 and r.n > 20 and r.accuracy > 0.85 and r.saved >= 1


def test_models_in_a_session_that_has_observed(spark):
    """An observation stays with the session, which summaries of trained models hold."""
    seen = Observation("rows")
    spark.range(3).observe(seen, F.count(F.lit(1)).alias("n")).collect()
    assert seen.get == {"n": 3}
    r = plans.QUERIES["saved_model_scores"](spark, SF).first()
    assert r.differ == 0 and r.n > 20 and r.accuracy > 0.85 and r.saved >= 1
    df = M.features(spark.createDataFrame([(i, [float(i % 7), float(i % 5)], int(i % 7 > 3)) for i in range(140)], "id long, v array<double>, y int"), ["v"], "y", ["id"])
    models = {k: M.prepared(M.MODELS[k]()) for k in ("forest", "neuron")} | {"kernel": M.kernel_machine(2, size=16)}
    assert all(v > 0.85 for _, _, v in M.compare(models, df, df))
    assert all(v > 0.85 for _, _, v in M.learning_curve(M.MODELS["neuron"](), df, "id", [1.0], folds=2))


def test_draws_of_a_search(spark):
    r = random.Random(1)
    rows = [(i, [r.random(), r.random()], 0) for i in range(120)]
    df = M.features(spark.createDataFrame([(i, v, int(v[0] > 0.5)) for i, v, _ in rows], "id long, v array<double>, y int"), ["v"], "y", ["id"])
    found = M.search(M.MODELS["tree"](), {"maxDepth": [1, 2, 0]}, df, folds=3)
    assert len(found.avgMetrics) == 3 and found.avgMetrics[0] > 0.9 > found.avgMetrics[2]


def test_boosted_stumps_by_brute_force(spark):
    """Every stump over all thresholds, reweighted by hand."""
    r = random.Random(7)
    rows = [(float(r.randint(0, 9)), float(r.randint(0, 9))) for _ in range(120)]
    y = [int(a + b > 9) + (a > 7) for a, b in rows]
    df = spark.createDataFrame([([a, b], c) for (a, b), c in zip(rows, y, strict=True)], "v array<double>, y int")
    df = M.features(df, ["v"], "y", ["v"])

    def stump(w):
        """The split of least Gini impurity, and the heaviest class of each side."""
        best = None
        for f in (0, 1):
            for t in range(9):
                gini, sides = 0.0, []
                for side in (True, False):
                    n = [sum(x for x, row, c in zip(w, rows, y, strict=True) if (row[f] <= t) == side and c == k) for k in range(3)]
                    s = sum(n)
                    gini += s - sum(x * x for x in n) / s if s else 0
                    sides.append(n.index(max(n)))
                if best is None or gini < best[0] - 1e-9:
                    best = (gini, f, t, sides)
        return lambda row, b=best: b[3][0 if row[b[1]] <= b[2] else 1]

    w, votes = [1.0] * len(rows), []
    for _ in range(6):
        s = stump(w)
        err = sum(x for x, row, c in zip(w, rows, y, strict=True) if s(row) != c) / sum(w)
        alpha = math.log((1 - err) / err) + math.log(2)
        votes.append((s, alpha))
        w = [x * (math.exp(alpha) if s(row) != c else 1) for x, row, c in zip(w, rows, y, strict=True)]
        w = [x * len(w) / sum(w) for x in w]
    want = {}
    for row in rows:
        score = [sum(a for s, a in votes if s(row) == k) for k in range(3)]
        want[row] = score.index(max(score))
    model = EN.AdaBoost(rounds=6, depth=1).fit(df)
    assert all(abs(a - b) < 1e-6 for a, (_, b) in zip(model.alphas, votes, strict=True))
    assert {tuple(x.v): x.prediction for x in model.transform(df).collect()} == want
    assert len(EN.AdaBoost(rounds=5).fit(df.where("label < 2 AND label = 0 OR label = 1").where("label = 0")).alphas) <= 1


def test_kernel_estimate_and_circles(spark):
    r = random.Random(8)
    at = lambda rad: [rad * math.cos(t := r.uniform(0, 6.3)), rad * math.sin(t)]
    rows = [(i, [x + r.gauss(0, 0.1) for x in at(1 + 2 * (i % 2))], i % 2) for i in range(400)]
    df = M.features(spark.createDataFrame(rows, "id long, v array<double>, y int"), ["v"], "y", ["id"])
    test = F.col("id") % 4 < 2
    plain = Pipeline(stages=[LinearSVC(maxIter=50)])
    score = dict(((n, m), v) for n, m, v in M.compare({"plain": plain, "kernel": M.kernel_machine(2, gamma=1.0)}, df.where(~test), df.where(test)))
    assert score["kernel", "accuracy"] > 0.97 and score["plain", "accuracy"] < 0.75
    z = EN.RandomFourierFeatures(width=2, size=4096, gamma=0.7).transform(df.limit(40)).select("features", "fourier").collect()
    for a in z:
        for b in z:
            exact = math.exp(-0.7 * float(a.features.squared_distance(b.features)))
            assert abs(float(a.fourier.dot(b.fourier)) - exact) < 5 / math.sqrt(4096 / 2)


def test_pipeline_with_products_and_selection(spark):
    r = random.Random(3)
    rows = [(i, [a, b, r.random()], int(a * b > 0)) for i in range(400) for a, b in [(r.uniform(-1, 1), r.uniform(-1, 1))]]
    df = M.features(spark.createDataFrame([*rows, (999, [0.1, 0.2, 0.3], None)], "id long, v array<double>, y int"), ["v"], "y", ["id"])
    test = F.col("id") % 4 == 0
    score = dict(((n, m), v) for n, m, v in M.compare({"plain": M.prepared(M.MODELS["neuron"]()), "products": M.prepared(M.MODELS["neuron"](), degree=2, top=2)}, df.where(~test), df.where(test)))
    assert df.count() == 400 and score["products", "accuracy"] > 0.9 > score["plain", "accuracy"]


def test_neighbours_by_brute_force(spark, monkeypatch):
    r = random.Random(4)
    rows = [(i, r.randint(0, 3), [float(r.randint(0, 5)) for _ in range(3)]) for i in range(150)]
    df = spark.createDataFrame(rows, "id long, label int, v array<double>")
    want = {}
    for i, _, v in rows[::10]:
        near = sorted((sum((a - b) ** 2 for a, b in zip(v, w, strict=True)), j, label) for j, label, w in rows if j != i)[:7]
        votes = [x[2] for x in near]
        want[i] = max((votes.count(x), -x) for x in votes)
    for q, n in ((4096, 65536), (4, 20)):
        monkeypatch.setattr(M, "QUERIES", q)
        monkeypatch.setattr(M, "ROWS", n)
        got = {x.query: (x.votes, -x.label) for x in M.nearest_neighbours(df.where("id % 10 = 0"), df, 7).collect()}
        assert got == want
    assert M.nearest_neighbours(df.limit(0), df, 3).count() == 0


STEPS = "key string, t int, reward double, done boolean"


def batches(spark, tmp_path, rows, n):
    """The rows as a stream of n micro-batches, in order."""
    size = -(-len(rows) // n)
    for i in range(n):
        spark.createDataFrame(rows[i * size : (i + 1) * size], STEPS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(STEPS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def test_states_carry_over_batches(spark, tmp_path):
    r = random.Random(5)
    rows = [(r.choice("abc"), t, r.choice([0.0, 1.0, -1.0]), r.random() < 0.1) for t in range(300)]
    stream = batches(spark, tmp_path, rows, 4)
    run = lambda s, name, mode: ST.run_to_end(s, str(tmp_path / name), str(tmp_path / f"{name}-state"), mode)
    want, now, kept, x = [], {}, {}, {}
    for k, t, v, d in rows:
        e, total, n = now.get(k, (0, 0.0, 0))
        total, n = total + v, n + 1
        if d:
            want.append((k, e, total, n))
            e, total, n = e + 1, 0.0, 0
        now[k] = (e, total, n)
        kept[k] = [*kept.get(k, []), t][-6:]
        x[k] = x.get(k, 0.0) * 0.9 + v
    got = run(ST.episodes(stream, "key", ["t"], "reward", "done"), "episodes", "append")
    assert sorted(map(tuple, got.collect())) == sorted(want)
    got = ST.latest(run(ST.newest(stream, "key", ["t"], "t", 6), "newest", "update"), ["key"])
    assert {g.key: g["items"] for g in got.collect()} == kept
    got = ST.latest(run(ST.decay(stream, "key", ["t"], "reward", 0.9), "decay", "update"), ["key"])
    assert all(abs(g.x - x[g.key]) < 1e-9 for g in got.collect())


def test_buckets_drop_what_is_too_late(spark, tmp_path):
    """Late is what lies under the watermark of the batch before."""
    schema = "ts timestamp_ntz, value double"
    for part in ([("2022-01-01 00:05:00", 1.0), ("2022-01-01 00:10:00", 3.0)], [("2022-01-01 05:00:00", 5.0)], [("2022-01-01 09:00:00", 1.0)], [("2022-01-01 00:15:00", 100.0)], [("2022-01-01 09:01:00", 1.0)]):
        df = spark.createDataFrame(part, "ts string, value double").select(F.col("ts").cast("timestamp_ntz").alias("ts"), "value")
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = ST.run_to_end(ST.bucket_means(stream, "ts", "value", "20 minutes", [], late="1 hour"), str(tmp_path / "out"), str(tmp_path / "state"))
    got = {str(r.start): (r.mean, r.n) for r in out.collect()}
    assert got["2022-01-01 00:00:00"] == (2.0, 2) and "2022-01-01 09:00:00" not in got
    batch = ST.bucket_means(spark.read.schema(schema).parquet(str(tmp_path / "in")), "ts", "value", "20 minutes", [])
    assert {str(r.start): r.n for r in batch.collect()}["2022-01-01 00:00:00"] == 3


TICKED = "key string, ts timestamp, amount double"


def test_ticks_and_lists_over_batches(spark, tmp_path):
    """Values of every tick of every key, also of keys without new rows, and lists of the newest, as in one batch."""
    from datetime import datetime, timedelta

    from tidewater.streaming import processors as PR

    r, start = random.Random(9), datetime(2024, 1, 1)
    rows = sorted((start + timedelta(minutes=r.randint(0, 60 * 24)), r.choice("abc"), float(r.randint(1, 9))) for _ in range(120))
    rows = [("idle", start + timedelta(minutes=5), 100.0)] + [(k, t, v) for t, k, v in rows] + [("a", start + timedelta(hours=30), 1.0)]
    for i in range(0, len(rows), 25):
        spark.createDataFrame(rows[i : i + 25], TICKED).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(TICKED).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    hour, want = 3_600_000, {}
    last = int((max(t for _, t, _ in rows).timestamp() * 1000 - 2 * hour) // hour)
    at = lambda t: int(t.timestamp() * 1000 // hour)
    for key in {k for k, _, _ in rows}:
        own = [(at(t), v) for k, t, v in rows if k == key]
        for k in range(min(own)[0], last):
            want[key, k] = sum(v * 0.5 ** (k - j) for j, v in own if j <= k)
    want = {k: x for k, x in want.items() if x >= 1e-3}
    with PR.state_store(spark):
        out = ST.run_to_end(PR.decay_ticks(stream, "key", "ts", "amount", hour, 0.5, "2 hours", least=1e-3), str(tmp_path / "t"), str(tmp_path / "tc"))
        got = {(x.key, x.tick): x.x for x in out.collect()}
        held = ST.latest(ST.run_to_end(PR.newest(stream, "key", "ts", "amount", 4), str(tmp_path / "n"), str(tmp_path / "nc"), "update"), ["key"]).collect()
    assert got.keys() == want.keys() and all(abs(got[k] - x) < 1e-9 for k, x in want.items())
    assert sum(k == "idle" for k, _ in got) > 10
    assert {x.key: list(x["items"]) for x in held} == {key: [v for _, v in sorted((t, v) for k, t, v in rows if k == key)[-4:]] for key in "abc"} | {"idle": [100.0]}


def test_a_key_is_read_and_written_once_a_call():
    """Thirty days of deposits of a key: one read and one write of its state, then one of each for all its ticks."""
    from pyspark.sql import Row

    from tidewater.streaming import processors as PR

    class Handle:
        def __init__(self):
            self.calls, self.timers, self.held = 0, [], None

        def getValueState(self, name, schema):  # noqa: N802
            return self

        def getMapState(self, name, *schemas):  # noqa: N802
            return self

        def registerTimer(self, at):  # noqa: N802
            self.timers.append(at)

        def get(self):
            self.calls += 1
            return self.held

        def update(self, value):
            self.calls += 1
            self.held = value

        def getCurrentWatermarkInMs(self):  # noqa: N802
            return 40_000

    h = Handle()
    p = PR._Ticks("key", 1000, 0.5, 1e-6)
    p.init(h)
    assert not list(p.handleInputRows(("a",), iter([Row(tick=t, deposit=1.0) for t in [*range(5, 35), 5]]), h)) and h.calls == 2
    got = list(p.handleExpiredTimer(("a",), h, None))
    assert h.calls == 4 and [r.tick for r in got] == list(range(5, 40)) and h.timers == [6000, 41000]
    x, want = 0.0, []
    for t in range(5, 40):
        x += 2.0 if t == 5 else 1.0 if t < 35 else 0.0
        want.append(x)
        x *= 0.5
    assert [r.x for r in got] == want
