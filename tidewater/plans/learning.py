"""Queries that evaluate predictions, place points and work on vectors."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewater.functions import vectors as V
from tidewater.operators import evaluate as E
from tidewater.operators import spatial as G
from tidewater.plans.registry import load, query
from tidewater.sources import files
from tidewater.tables import new_path

_PRED = """s AS (SELECT vec_id, label, list_transform(range(10), lambda k: list_sum(list_filter(embedding::DOUBLE[], lambda x, i: (i - 1) % 10 = k))) AS s FROM embeddings),
p AS (SELECT vec_id, label AS truth, CAST(list_position(s, list_max(s)) - 1 AS INTEGER) AS pred FROM s)"""
_CELLS = f"{_PRED}, k AS (SELECT CAST(i AS INTEGER) AS i FROM range(10) r(i)), m AS (SELECT a.i AS truth, b.i AS pred, count(p.vec_id) AS n FROM k a CROSS JOIN k b LEFT JOIN p ON p.truth = a.i AND p.pred = b.i GROUP BY 1, 2)"


def _vec(spark, d):
    e = load(spark, d, "embeddings")
    return e.select("vec_id", "label", F.transform("embedding", lambda v: v.cast("double")).alias("v"))


def predictions(spark, d):
    """The class of greatest score; a class's score is the sum of every tenth value of the vector from its own on."""
    scores = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda k: V.total(F.filter("v", lambda x, i: i % 10 == k)))
    return _vec(spark, d).select("vec_id", F.col("label").alias("truth"), V.argmax(scores).cast("int").alias("pred"))


def _matrix(spark, d):
    return E.confusion(predictions(spark, d), "truth", "pred", 10)


@query("confusion_matrix", f"WITH {_CELLS} SELECT truth, pred, n, round(n / nullif(sum(n) OVER (PARTITION BY truth), 0), 6) AS share FROM m")
def confusion_matrix(spark, d):
    return _matrix(spark, d).select("truth", "pred", "n", F.round("share", 6).alias("share"))


@query("class_report", f"""WITH {_CELLS}
SELECT i AS label, CAST(sum(CASE WHEN truth = i THEN n ELSE 0 END) AS BIGINT) AS support,
  round(sum(CASE WHEN truth = i AND pred = i THEN n END) / nullif(sum(CASE WHEN pred = i THEN n END), 0), 6) AS "precision",
  round(sum(CASE WHEN truth = i AND pred = i THEN n END) / nullif(sum(CASE WHEN truth = i THEN n END), 0), 6) AS recall,
  round(2e0 * sum(CASE WHEN truth = i AND pred = i THEN n END) / nullif(sum(CASE WHEN truth = i THEN n END) + sum(CASE WHEN pred = i THEN n END), 0), 6) AS f1
FROM k JOIN m ON m.truth = i OR m.pred = i GROUP BY i""")
def class_report(spark, d):
    out = E.class_report(_matrix(spark, d))
    return out.select("label", "support", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("accuracy", f"WITH {_PRED} SELECT round(avg(CAST(truth = pred AS INTEGER)), 6) AS accuracy, count_if(truth <> pred) AS wrong FROM p")
def accuracy(spark, d):
    same = F.col("truth") == F.col("pred")
    return predictions(spark, d).agg(F.round(F.avg(same.cast("int")), 6).alias("accuracy"), F.count_if(~same).alias("wrong"))


@query("misclassified_first", f"WITH {_PRED} SELECT * FROM p WHERE truth <> pred ORDER BY vec_id LIMIT 24")
def misclassified_first(spark, d):
    return predictions(spark, d).where("truth <> pred").orderBy("vec_id").limit(24)


_SCORED = "s AS (SELECT quality AS y, n_chars / (n_chars + 1000e0) AS p FROM labels JOIN documents USING (doc_id))"


def _scored(spark, d):
    n = F.col("n_chars")
    return load(spark, d, "labels").join(load(spark, d, "documents").select("doc_id", "n_chars"), "doc_id").select(F.col("quality").alias("y"), (n / (n + 1000.0)).alias("p"))


@query("losses", f"WITH {_SCORED} SELECT round(avg(-y * ln(p + 1e-15) - (1 - y) * ln(1 - p + 1e-15)), 6) AS bce, round(avg(pow(y - p, 2)), 6) AS mse, round(sum((1 + y) * (-y * ln(p + 1e-15) - (1 - y) * ln(1 - p + 1e-15))) / sum(1 + y), 6) AS weighted FROM s")
def losses(spark, d):
    y, p = F.col("y"), F.col("p")
    return _scored(spark, d).agg(F.round(E.log_loss(y, p), 6).alias("bce"), F.round(E.squared_error(y, p), 6).alias("mse"), F.round(E.log_loss(y, p, weight=1 + y), 6).alias("weighted"))


@query("pr_curve", f"""WITH {_SCORED}, g AS (SELECT p AS threshold, sum(y) AS y, count(*) AS n FROM s GROUP BY 1)
SELECT round(threshold, 9) AS threshold, round(sum(y) OVER w / sum(n) OVER w, 6) AS "precision", round(sum(y) OVER w / sum(y) OVER (), 6) AS recall FROM g WINDOW w AS (ORDER BY threshold DESC)""")
def pr_curve(spark, d):
    curve = E.precision_recall_curve(_scored(spark, d), "y", "p")
    return curve.select(F.round("threshold", 9).alias("threshold"), F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query("matrix_accuracy", f"WITH {_CELLS} SELECT round(sum(CASE WHEN truth = pred THEN n ELSE 0 END) / sum(n), 6) AS accuracy, round(1 - sum(CASE WHEN truth = pred THEN n ELSE 0 END) / sum(n), 6) AS error FROM m")
def matrix_accuracy(spark, d):
    return E.matrix_accuracy(_matrix(spark, d)).select(F.round("accuracy", 6).alias("accuracy"), F.round("error", 6).alias("error"))


@query("cross_entropy", """WITH e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS k FROM embeddings),
q AS (SELECT vec_id, label, k, exp(x) AS x, sum(exp(x)) OVER (PARTITION BY vec_id) AS total FROM e)
SELECT round(avg(-ln(x / total)), 6) AS cce, round(sum((1 + label) * -ln(x / total)) / sum(1 + label), 6) AS weighted FROM q WHERE k = label""")
def cross_entropy(spark, d):
    """The exponentials of a vector as unscaled scores of 64 classes."""
    v = _vec(spark, d).select("label", F.transform("v", F.exp).alias("p"))
    y = F.transform(F.sequence(F.lit(0), F.size("p") - 1), lambda k: (k == F.col("label")).cast("double"))
    return v.agg(F.round(E.cross_entropy(y, F.col("p")), 6).alias("cce"), F.round(E.cross_entropy(y, F.col("p"), weight=1 + F.col("label")), 6).alias("weighted"))


_PTS = "pts AS (SELECT vec_id AS id, label, embedding[1]::DOUBLE * 10 AS x, embedding[2]::DOUBLE * 10 AS y FROM embeddings)"


def points(spark, d):
    e = load(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("id"), "label", (F.col("embedding")[0].cast("double") * 10).alias("x"), (F.col("embedding")[1].cast("double") * 10).alias("y"))


@query("radius_query", f"WITH {_PTS} SELECT c.id AS centre, p.id, round(sqrt((p.x - c.x) ** 2 + (p.y - c.y) ** 2), 6) AS dist FROM pts c JOIN pts p ON sqrt((p.x - c.x) ** 2 + (p.y - c.y) ** 2) <= 0.7 WHERE c.label = 3")
def radius_query(spark, d):
    p = points(spark, d)
    return G.within(p, p.where("label = 3"), 0.7).select("centre", "id", F.round("dist", 6).alias("dist"))


@query("close_pairs", f"WITH {_PTS} SELECT a.id AS a, b.id AS b, round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), 6) AS dist FROM pts a JOIN pts b ON a.id < b.id AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 0.2")
def close_pairs(spark, d):
    return G.close_pairs(points(spark, d), 0.2).select("a", "b", F.round("dist", 6).alias("dist"))


@query("rect_query", f"WITH {_PTS} SELECT id FROM pts WHERE x BETWEEN -1.5 AND 1.5 AND y BETWEEN -0.5 AND 2.5")
def rect_query(spark, d):
    return points(spark, d).where(G.in_rectangle(F.col("x"), F.col("y"), 0.0, 1.0, 1.5, 1.5)).select("id")


@query("tour_length", f"""WITH {_PTS}, n AS (SELECT label, x, y, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS ny FROM pts WINDOW w AS (PARTITION BY label ORDER BY id))
SELECT label, round(sum(sqrt((x - nx) ** 2 + (y - ny) ** 2)), 5) AS length FROM n GROUP BY 1""")
def tour_length(spark, d):
    return G.tour_length(points(spark, d), ["label"], ["id"]).select("label", F.round("length", 5).alias("length"))


@query("barycentre", f"WITH {_PTS} SELECT label, round(avg(x), 6) AS x, round(avg(y), 6) AS y FROM pts GROUP BY 1")
def barycentre(spark, d):
    return points(spark, d).groupBy("label").agg(F.round(F.avg("x"), 6).alias("x"), F.round(F.avg("y"), 6).alias("y"))


_FIT = "f AS (SELECT c_nationkey AS k, sum(c_acctbal) AS s FROM customer GROUP BY 1)"


@query("fitness_share", f"WITH {_FIT} SELECT k, round(s * s / sum(s * s) OVER (), 6) AS share FROM f")
def fitness_share(spark, d):
    f = load(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.sum("c_acctbal").alias("s"))
    sq = F.col("s") * F.col("s")
    return f.select("k", F.round(sq / F.sum(sq).over(Window.partitionBy(F.lit(0))), 6).alias("share"))


@query("roulette", f"""WITH {_FIT}, c AS (SELECT k, sum(s * s) OVER (ORDER BY k) - s * s AS lo, sum(s * s) OVER (ORDER BY k) AS hi, sum(s * s) OVER () AS total FROM f)
SELECT i AS draw, k FROM range(200) g(i) JOIN c ON (i + 0.5e0) / 200 * total > lo AND (i + 0.5e0) / 200 * total <= hi""")
def roulette(spark, d):
    """Draws by cumulative fitness; one row a nation, so the wheel goes to all tasks."""
    f = load(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.sum("c_acctbal").alias("s"))
    sq = F.col("s") * F.col("s")
    hi = F.sum(sq).over(Window.orderBy("k").rowsBetween(Window.unboundedPreceding, 0))
    wheel = f.select("k", (hi - sq).alias("lo"), hi.alias("hi"), F.sum(sq).over(Window.partitionBy(F.lit(0))).alias("total"))
    r = (F.col("id") + 0.5) / 200 * F.col("total")
    return spark.range(200).join(F.broadcast(wheel), (r > F.col("lo")) & (r <= F.col("hi"))).select(F.col("id").alias("draw"), "k")


_TYPES = ("click", "error", "purchase", "signup", "view")
_TAGS = "tags AS (SELECT CAST(time_bucket(INTERVAL '20 minutes', ts) AS VARCHAR) AS ts, " + ", ".join(f"avg(CASE WHEN event_type = '{t}' THEN value END) AS {t}" for t in _TYPES) + " FROM events GROUP BY 1)"


def tags(spark, d):
    """Twenty-minute means of each tag side by side: the full outer merge of all tags in one shuffle."""
    start = F.window("ts", "20 minutes")["start"].cast("string").alias("ts")
    return load(spark, d, "events").groupBy(start).pivot("event_type", list(_TYPES)).agg(F.avg("value"))


@query("nway_outer_tags", f"WITH {_TAGS} SELECT ts, " + ", ".join(f"round({t}, 6) AS {t}" for t in _TYPES) + " FROM tags")
def nway_outer_tags(spark, d):
    return tags(spark, d).select("ts", *[F.round(t, 6).alias(t) for t in _TYPES])


@query("ffill_tags", f"WITH {_TAGS} SELECT ts, " + ", ".join(f"round(coalesce(last_value({t} IGNORE NULLS) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING), 0), 6) AS {t}" for t in _TYPES) + " FROM tags")
def ffill_tags(spark, d):
    w = Window.orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    return tags(spark, d).select("ts", *[F.round(F.coalesce(F.last(t, ignorenulls=True).over(w), F.lit(0.0)), 6).alias(t) for t in _TYPES])


@query("viewed_not_bought", "SELECT DISTINCT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS dt FROM events WHERE event_type = 'view' EXCEPT SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) FROM events WHERE event_type = 'purchase'")
def viewed_not_bought(spark, d):
    e = load(spark, d, "events").select("user_id", F.col("ts").cast("date").cast("string").alias("dt"), "event_type")
    seen, bought = (e.where(F.col("event_type") == k).drop("event_type") for k in ("view", "purchase"))
    return seen.subtract(bought)


@query("softmax", """WITH e AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS k, unnest(embedding)::DOUBLE AS x FROM embeddings)
SELECT vec_id, CAST(k AS BIGINT) AS k, round(exp(x - max(x) OVER u) / sum(exp(x)) OVER u * exp(max(x) OVER u), 6) AS p FROM e WINDOW u AS (PARTITION BY vec_id)""")
def softmax(spark, d):
    return _vec(spark, d).select("vec_id", F.posexplode(V.softmax(F.col("v"))).alias("k", "p")).select("vec_id", F.col("k").cast("long").alias("k"), F.round("p", 6).alias("p"))


@query("activations", """SELECT vec_id, round(1 / (1 + exp(-x)), 6) AS sigmoid, round(tanh(x), 6) AS tanh, greatest(x, 0) AS relu, round(CASE WHEN x > 0 THEN x ELSE exp(x) - 1 END, 6) AS elu
FROM (SELECT vec_id, embedding[3]::DOUBLE AS x FROM embeddings)""")
def activations(spark, d):
    x = _vec(spark, d).select("vec_id", F.col("v")[2].alias("x"))
    act = {k: V.ACTIVATIONS[k](F.col("x")) for k in ("sigmoid", "tanh", "relu", "elu")}
    return x.select("vec_id", *[(c if k == "relu" else F.round(c, 6)).alias(k) for k, c in act.items()])


_W = [[((i * 7 + j * 3) % 5 - 2) / 10 for j in range(65)] for i in range(3)]


@query("dense_forward", "SELECT vec_id, " + ", ".join(f"round(greatest(0, {' + '.join(f'({w}) * embedding[{j + 1}]::DOUBLE' for j, w in enumerate(row[:64]))} + ({row[64]})), 6) AS o{i}" for i, row in enumerate(_W)) + " FROM embeddings")
def dense_forward(spark, d):
    out = _vec(spark, d).select("vec_id", V.dense(F.col("v"), _W, "relu").alias("o"))
    return out.select("vec_id", *[F.round(F.col("o")[i], 6).alias(f"o{i}") for i in range(3)])


@query("td_target", "SELECT vec_id, round(embedding[6]::DOUBLE + CASE WHEN label = 0 THEN 0 ELSE 0.99 * list_max(embedding[1:5])::DOUBLE END, 6) AS target FROM embeddings")
def td_target(spark, d):
    return _vec(spark, d).select("vec_id", F.round(V.td_target(F.col("v")[5], F.col("label") == 0, F.slice("v", 1, 5), 0.99), 6).alias("target"))


@query("eps_greedy", "SELECT vec_id, CAST(k AS BIGINT) AS k, round(0.1e0 / 5 + CASE WHEN k = list_position(embedding[1:5], list_max(embedding[1:5])) - 1 THEN 0.9e0 ELSE 0 END, 6) AS p FROM embeddings, range(5) r(k)")
def eps_greedy(spark, d):
    p = V.epsilon_greedy(F.slice("v", 1, 5), 0.1)
    return _vec(spark, d).select("vec_id", F.posexplode(p).alias("k", "p")).select("vec_id", F.col("k").cast("long").alias("k"), F.round("p", 6).alias("p"))


@query("loss_surface", """WITH g AS (SELECT i * 21 + j AS g, -2 + i * 0.2e0 AS a, -2 + j * 0.2e0 AS b FROM range(21) r(i), range(21) q(j)),
p AS (SELECT embedding[1]::DOUBLE * 10 AS x, embedding[2]::DOUBLE * 10 AS y, CAST(label < 5 AS INTEGER) AS t FROM embeddings)
SELECT CAST(g AS INTEGER) AS g, round(avg(ln(1 + exp(-abs(a * x + b * y))) + greatest(a * x + b * y, 0) - t * (a * x + b * y)), 6) AS loss, count(*) AS n FROM g, p GROUP BY 1""")
def loss_surface(spark, d):
    """The loss of a neuron over a grid of 21 by 21 weights."""
    grid = [(-2 + i * 0.2, -2 + j * 0.2) for i in range(21) for j in range(21)]
    e = load(spark, d, "embeddings").select(F.transform(F.slice("embedding", 1, 2), lambda v: v.cast("double") * 10).alias("x"), (F.col("label") < 5).cast("int").alias("y"))
    return E.loss_surface(e, grid).select("g", F.round("loss", 6).alias("loss"), "n")


@query("score_thresholds", f"""WITH {_PRED}, c AS (SELECT list_max(s.s) - list_sum(s.s) / 10 AS score, CAST(p.truth = p.pred AS INTEGER) AS t FROM s JOIN p USING (vec_id)), h AS (SELECT unnest([0.2e0, 0.4e0, 0.6e0, 0.8e0, 1e0]) AS threshold)
SELECT threshold, count_if(score >= threshold) AS taken, CAST(sum(CASE WHEN score >= threshold THEN t ELSE 0 END) AS BIGINT) AS "right", round(sum(CASE WHEN score >= threshold THEN t ELSE 0 END) / nullif(count_if(score >= threshold), 0), 6) AS precision FROM c, h GROUP BY 1""")
def score_thresholds(spark, d):
    """How sure a prediction is (its class's score less the mean), against thresholds."""
    scores = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda k: V.total(F.filter("v", lambda x, i: i % 10 == k)))
    c = _vec(spark, d).select("label", scores.alias("s")).select((F.array_max("s") - V.total(F.col("s")) / 10).alias("score"), (V.argmax(F.col("s")) == F.col("label")).alias("t"))
    out = E.over_threshold(c, "score", F.col("t"), [0.2, 0.4, 0.6, 0.8, 1.0])
    return out.select("threshold", "taken", F.col("right").cast("long").alias("right"), F.round("precision", 6).alias("precision"))


@query("observed_metrics", "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(max(value), 6) AS top, (SELECT count(*) FROM events) AS written, round((SELECT sum(value * 2) FROM events), 3) AS reward FROM events GROUP BY 1")
def observed_metrics(spark, d):
    """What a job writes, with its number of rows and their sum observed on the way: no second pass."""
    e = load(spark, d, "events").select("event_type", "value", (F.col("value") * 2).alias("reward"))
    written, seen = files.write_observed(e, new_path(spark, "observed"), written=F.count(F.lit(1)), reward=F.sum("reward"))
    out = written.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.max("value"), 6).alias("top"))
    return out.withColumns({"written": F.lit(seen["written"]).cast("long"), "reward": F.round(F.lit(seen["reward"]), 3)})
