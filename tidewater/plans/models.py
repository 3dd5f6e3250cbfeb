"""Queries on Spark ML and on streams.  Those whose result SQL can't give have no SQL; the tests hold them."""

from __future__ import annotations

import random
import string

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.functions.letters import letter_shares
from tidewater.operators import ensemble as EN
from tidewater.operators import index as IX
from tidewater.operators import learn as M
from tidewater.plans.registry import load, query
from tidewater.streaming import processors as PR
from tidewater.streaming import stateful as ST
from tidewater.streaming.processors import state_store
from tidewater.tables import delete, forget, new_path, table


def _xy(spark, d):
    e = F.col("embedding")
    return load(spark, d, "embeddings").select("vec_id", "label", *[F.get(e, F.lit(i)).cast("double").alias(c) for i, c in enumerate("xy")])


@query("polynomial_features", "SELECT vec_id, 1e0 AS one, round(x, 6) AS x, round(x * x, 6) AS xx, round(y, 6) AS y, round(x * y, 6) AS xy, round(y * y, 6) AS yy FROM (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings)")
def polynomial_features(spark, d):
    p = M.polynomial(_xy(spark, d), ["x", "y"], 2)
    return p.select("vec_id", *[F.round(F.col("poly")[i], 6).alias(c) for i, c in enumerate(("one", "x", "xx", "y", "xy", "yy"))])


@query("scaled_features", "WITH v AS (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings) SELECT vec_id, round((x - avg(x) OVER ()) / stddev_samp(x) OVER (), 5) AS x, round((y - avg(y) OVER ()) / stddev_samp(y) OVER (), 5) AS y FROM v")
def scaled_features(spark, d):
    return M.standardised(_xy(spark, d), ["x", "y"]).select("vec_id", *[F.round(F.col("z")[i], 5).alias(c) for i, c in enumerate("xy")])


@query("scaled_population", "WITH v AS (SELECT vec_id, embedding[1]::DOUBLE AS x FROM embeddings) SELECT vec_id, round((x - avg(x) OVER ()) / stddev_pop(x) OVER (), 5) AS x FROM v")
def scaled_population(spark, d):
    return M.standardised(_xy(spark, d), ["x"], population=True).select("vec_id", F.round(F.col("z")[0], 5).alias("x"))


@query("features_and_label", "SELECT vec_id, len(embedding) AS width, CAST(label AS DOUBLE) AS label FROM embeddings")
def features_and_label(spark, d):
    f = M.features(load(spark, d, "embeddings"), ["embedding"], "label", ["vec_id"])
    return f.select("vec_id", F.size(vector_to_array("features")).cast("long").alias("width"), "label")


@query("neighbour_vote", """WITH q AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 100 = 0), r AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS v FROM embeddings),
d AS (SELECT q.id AS query, r.label, row_number() OVER (PARTITION BY q.id ORDER BY list_sum(list_transform(range(1, 65), lambda i: (q.v[i] - r.v[i]) ** 2)), r.id) AS rn FROM q JOIN r ON q.id <> r.id),
n AS (SELECT query, label, count(*) AS votes FROM d WHERE rn <= 5 GROUP BY ALL)
SELECT query, label, votes FROM n QUALIFY row_number() OVER (PARTITION BY query ORDER BY votes DESC, label) = 1""")
def neighbour_vote(spark, d):
    """The queries are the rows of ids divisible by 100."""
    e = load(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("int").alias("label"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return M.nearest_neighbours(e.where("id % 100 = 0"), e, 5)


_POLICY = "p AS (SELECT vec_id, label, 0.05e0 + 0.9e0 / (1 + exp(-embedding[1]::DOUBLE * 4)) AS new, 0.05e0 + 0.9e0 / (1 + exp(-embedding[2]::DOUBLE * 4)) AS old, embedding[3]::DOUBLE - embedding[4]::DOUBLE AS adv FROM embeddings)"


@query("policy_loss", f"""WITH {_POLICY} SELECT label, round(avg(-least(new / (old + 1e-10) * adv, greatest(0.8e0, least(1.2e0, new / (old + 1e-10))) * adv) + 0.01e0 * new * ln(new + 1e-10)), 6) AS loss, round(avg(adv), 6) AS advantage FROM p GROUP BY label""")
def policy_loss(spark, d):
    e = lambda i: F.get("embedding", F.lit(i)).cast("double")
    prob = lambda x: 0.05 + 0.9 / (1 + F.exp(-x * 4))
    p = load(spark, d, "embeddings").select("label", prob(e(0)).alias("new"), prob(e(1)).alias("old"), M.advantage(e(2), e(3)).alias("adv"))
    loss = M.clipped_policy_loss(F.col("new"), F.col("old"), F.col("adv"), 0.2, 0.01)
    return p.groupBy("label").agg(F.round(loss, 6).alias("loss"), F.round(F.avg("adv"), 6).alias("advantage"))


# ---- models: which documents are English, from the shares of their letters


#: The letters that ``letter_shares`` counts, in order.
NAMES = list(string.ascii_lowercase)


def _task(spark, d):
    """(doc_id, features, label): the share of each letter in the whole text of every document with a language, and whether it is English."""
    docs = load(spark, d, "documents").where("lang IS NOT NULL")
    docs = docs.select("doc_id", letter_shares(F.lower("text")).alias("shares"), (F.col("lang") == "en").cast("int").alias("english"))
    return M.features(docs, ["shares"], "english", ["doc_id"])


def _parts(spark, d):
    """The task, written once, and its held-out fifth by a hash of the key."""
    data = table(_task(spark, d), "task")
    test = F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0
    return data, data.where(~test), data.where(test)


@query("model_comparison")
def model_comparison(spark, d):
    """(model, metric, value) of every named pipeline on a held-out fifth."""
    data, train, test = _parts(spark, d)
    pipelines = {k: M.prepared(m()) for k, m in M.MODELS.items()} | {"kernel": M.kernel_machine(len(NAMES), gamma=0.02)}
    rows = M.compare(pipelines, train, test)
    forget(data)
    return spark.createDataFrame(rows, "model string, metric string, value double")


@query("feature_importances")
def feature_importances(spark, d):
    data = table(_task(spark, d), "task")
    model = M.MODELS["forest"]().fit(data)
    forget(data)
    return spark.createDataFrame(M.importances(model, NAMES), "name string, importance double")


@query("parameter_search")
def parameter_search(spark, d):
    """Recall of 40 drawn settings of a tree by cross-validation in four folds."""
    r = random.Random(1)
    draws = {"maxDepth": [r.randint(1, 6) for _ in range(40)], "minInstancesPerNode": [r.randint(1, 60) for _ in range(40)], "maxBins": [r.choice([8, 16, 32, 64]) for _ in range(40)]}
    data, _, _ = _parts(spark, d)
    found = M.search(M.MODELS["tree"](), draws, data, folds=4)
    forget(data)
    rows = [(i, *[v[i] for v in draws.values()], float(x)) for i, x in enumerate(found.avgMetrics)]
    return spark.createDataFrame(rows, "draw int, depth int, least int, bins int, recall double")


def _curve(spark, d):
    data, _, _ = _parts(spark, d)
    rows = M.learning_curve(M.MODELS["tree"](), data, "doc_id", [0.1, 0.325, 0.55, 0.775, 1.0], folds=4)
    forget(data)
    return spark.createDataFrame(rows, "share double, fold int, score double")


@query("learning_curve")
def learning_curve(spark, d):
    """Mean accuracy over four folds at five shares of the training rows."""
    return M.curve_means(_curve(spark, d))


@query("saved_model_scores")
def saved_model_scores(spark, d):
    """A neuron trained for more and more steps, saved whenever its validation loss is the best so far; the best one, loaded again,
    on the held-out fifth, as a stream: its version, rows, accuracy, scores that differ from those by the weights of the neuron before
    saving, and how many were saved."""
    data, train, test = _parts(spark, d)
    valid = F.pmod(F.xxhash64(F.lit("valid"), "doc_id"), F.lit(5)) == 0
    path = new_path(spark, "models")
    steps = [M.prepared(LogisticRegression(maxIter=n, tol=0.0)) for n in (1, 2, 4, 8, 16)]
    saved = EN.save_best(steps, train.where(~valid), train.where(valid), path)
    version, model = EN.load_best(spark, path)
    scaler, neuron = steps[version].fit(train.where(~valid)).stages
    again = scaler.transform(test).select("doc_id", EN.neuron_probability("scaled", neuron).alias("before"))
    held = table(test, "held")
    streamed = EN.score(spark.readStream.schema(held.schema).parquet(held._tidewater_path), model, version).select("doc_id", "label", "prediction", "model_version", vector_to_array("probability")[1].alias("p"))
    at = new_path(spark, "scored")
    out = ST.run_to_end(streamed, f"{at}/out", f"{at}/checkpoint")
    got = out.join(again, "doc_id").agg(
        F.max("model_version").alias("version"), F.count("*").alias("n"), F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("accuracy"), F.count_if(F.abs(F.col("p") - F.col("before")) > 1e-9).alias("differ")
    )
    row = got.first()
    delete(spark, at)
    delete(spark, path)
    forget(data, held)
    return spark.createDataFrame([(row.version, row.n, row.accuracy, row.differ, sum(s for _, _, s in saved))], "version int, n long, accuracy double, differ long, saved int")


@query("matrix_factors")
def matrix_factors(spark, d):
    """Root mean squared error of a biased factorisation of users by event types, and of the means alone."""
    kinds = load(spark, d, "events").select("event_type").distinct()
    e = load(spark, d, "events").join(F.broadcast(kinds.select("event_type", (F.crc32("event_type") % (1 << 31)).cast("int").alias("item"))), "event_type")
    r = e.groupBy(F.col("user_id").cast("int").alias("user"), "item").agg(F.avg("value").cast("float").alias("rating"))
    model, user, item = M.factorise(r)
    p = model.transform(r).join(user, "user").join(item, "item")
    rest = F.col("rating") - F.col("of_user") - F.col("of_item")
    return p.agg(F.sqrt(F.avg(rest * rest)).alias("of_means"), F.sqrt(F.avg((rest - F.col("prediction")) * (rest - F.col("prediction")))).alias("of_factors"))


# ---- streams, run to the end of their input


def _stream(spark, d):
    # A pattern, as a stream takes no single file.
    path = f"{d}/event[s].parquet"
    return spark.readStream.schema(load(spark, d, "events").schema).option("maxFilesPerTrigger", 1000).parquet(path)


def _run(spark, stream, name: str, mode: str):
    at = new_path(spark, name)
    with state_store(spark):
        out = ST.run_to_end(stream, f"{at}/out", f"{at}/checkpoint", mode)
    delete(spark, f"{at}/checkpoint")
    return out


@query("stream_bucket_means", "SELECT CAST(time_bucket(INTERVAL '20 minutes', ts) AS VARCHAR) AS start, event_type, round(avg(value), 6) AS mean, count(value) AS n FROM events GROUP BY ALL")
def stream_bucket_means(spark, d):
    """Twenty-minute means by tag of all events; each micro-batch tells the buckets that it changed, and the last word on each counts."""
    s = ST.bucket_means(_stream(spark, d), "ts", "value", "20 minutes", ["event_type"])
    out = ST.latest(_run(spark, s, "buckets", "update"), ["start", "event_type"])
    return out.select(F.col("start").cast("string").alias("start"), "event_type", F.round("mean", 6).alias("mean"), "n")


_EPISODES = """WITH r AS (SELECT user_id, ts, event_id, CASE event_type WHEN 'purchase' THEN 1e0 WHEN 'error' THEN -1e0 ELSE 0e0 END AS reward, event_type = 'purchase' AS done FROM events),
e AS (SELECT *, coalesce(sum(CAST(done AS INTEGER)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS episode FROM r)
SELECT user_id, CAST(episode AS BIGINT) AS episode, sum(reward) AS total, count(*) AS steps FROM e GROUP BY ALL HAVING bool_or(done)"""


def _steps(stream):
    r = F.when(F.col("event_type") == "purchase", 1.0).when(F.col("event_type") == "error", -1.0).otherwise(0.0)
    return stream.select("user_id", "ts", "event_id", r.alias("reward"), (F.col("event_type") == "purchase").alias("done"))


@query("stream_episodes", _EPISODES)
def stream_episodes(spark, d):
    """Totals of each episode of a user, which ends with a purchase."""
    return _run(spark, ST.episodes(_steps(_stream(spark, d)), "user_id", ["ts", "event_id"], "reward", "done"), "episodes", "append")


@query("stream_newest", "SELECT user_id, list(event_id ORDER BY rn DESC) AS items FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 5 GROUP BY 1")
def stream_newest(spark, d):
    """The five newest events of a user."""
    s = PR.newest(_stream(spark, d), "user_id", "ts", "event_id", 5)
    return ST.latest(_run(spark, s, "newest", "update"), ["user_id"])


@query("stream_decay", """WITH RECURSIVE e AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
t AS (SELECT user_id, 0e0 AS x, CAST(0 AS BIGINT) AS rn FROM (SELECT DISTINCT user_id FROM events) UNION ALL SELECT t.user_id, t.x * 0.9e0 + e.value, e.rn FROM t JOIN e ON e.user_id = t.user_id AND e.rn = t.rn + 1)
SELECT user_id, round(arg_max(x, rn), 4) AS x FROM t GROUP BY user_id""")
def stream_decay(spark, d):
    s = ST.decay(_stream(spark, d).select("user_id", "ts", "event_id", "value"), "user_id", ["ts", "event_id"], "value", 0.9)
    return ST.latest(_run(spark, s, "decay", "update"), ["user_id"]).select("user_id", F.round("x", 4).alias("x"))


@query("stream_decay_ticks", """WITH t AS (SELECT user_id, epoch_ms(ts) // 86400000 AS tick, sum(value) AS deposit FROM events GROUP BY ALL),
m AS (SELECT (epoch_ms(max(ts)) - 3600000) // 86400000 AS over_ FROM events), f AS (SELECT user_id, min(tick) AS first_ FROM t GROUP BY 1),
k AS (SELECT user_id, unnest(range(first_, (SELECT over_ FROM m))) AS tick FROM f)
SELECT k.user_id, k.tick, round(sum(t.deposit * pow(0.9e0, k.tick - t.tick)), 5) AS x FROM k JOIN t ON t.user_id = k.user_id AND t.tick <= k.tick GROUP BY ALL""")
def stream_decay_ticks(spark, d):
    """A tenth of what a user has is lost at the end of every day, with or without events."""
    s = PR.decay_ticks(_stream(spark, d), "user_id", "ts", "value", 86_400_000, 0.9, "1 hour")
    return _run(spark, s, "ticks", "append").select("user_id", "tick", F.round("x", 5).alias("x"))


@query("stream_actions", "SELECT event_id, CASE WHEN value > 50 THEN 'buy' ELSE 'wait' END AS action FROM events")
def stream_actions(spark, d):
    """The loop observe, act, record."""
    at = new_path(spark, "actions")
    policy = lambda df: df.select("event_id", F.when(F.col("value") > 50, "buy").otherwise("wait").alias("action"))
    run = ST.record_steps(_stream(spark, d), f"{at}/out", policy).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    key = load(spark, d, "events").schema["event_id"].dataType
    return spark.read.schema(T.StructType([T.StructField("event_id", key), T.StructField("action", T.StringType())])).parquet(f"{at}/out").select("event_id", "action")


@query("approximate_neighbours")
def approximate_neighbours(spark, d):
    """Of the ten nearest of each vector whose id is divisible by 100, how many an index finds."""
    e = load(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return IX.recall(e.where("id % 100 = 0"), e, 10, IX.fit(e, 10))
