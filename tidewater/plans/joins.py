"""Queries that relate rows by place, by order and by set, and that need a sum over neighbours."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewater.functions import scalars as S
from tidewater.operators import nearest as N
from tidewater.operators import ordered as O
from tidewater.operators import relate as R
from tidewater.operators import series as W
from tidewater.plans.learning import _PTS, points
from tidewater.plans.registry import load, query

_BARY = f"{_PTS}, b AS (SELECT label AS id, avg(x) AS x, avg(y) AS y FROM pts GROUP BY 1)"


def barycentres(spark, d):
    return points(spark, d).groupBy(F.col("label").alias("id")).agg(F.avg("x").alias("x"), F.avg("y").alias("y"))


@query("distance_matrix", f"WITH {_BARY} SELECT p.id AS i, q.id AS j, round(CASE WHEN p.id = q.id THEN 0 ELSE 1 / pow(sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2), 2) END, 4) AS w FROM b p, b q")
def distance_matrix(spark, d):
    return R.visibility(barycentres(spark, d), 2.0).select("i", "j", F.round("w", 4).alias("w"))


@query("transition_shares", f"""WITH {_BARY}, w AS (SELECT p.id AS i, q.id AS j, CASE WHEN p.id = q.id THEN 0 ELSE pow(1 + (p.id * 3 + q.id) % 5, 0.5e0) / pow(sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2), 2) END AS w FROM b p, b q)
SELECT i, j, round(w / sum(w) OVER (PARTITION BY i), 6) AS p FROM w""")
def transition_shares(spark, d):
    """Pheromone to the power 0.5 times visibility, as shares of each row of the matrix."""
    from tidewater.functions import vectors as V

    eta = R.visibility(barycentres(spark, d), 2.0).withColumn("tau", (1 + (F.col("i") * 3 + F.col("j")) % 5).cast("double"))
    rows = eta.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("j", "tau", "w"))).alias("r"))
    p = V.transition_probability(F.transform("r", lambda x: x["tau"]), F.transform("r", lambda x: x["w"]), 0.5, 1.0)
    out = rows.select("i", F.inline(F.arrays_zip(F.transform("r", lambda x: x["j"]).alias("j"), p.alias("p"))))
    return out.select("i", "j", F.round("p", 6).alias("p"))


@query("nearest_segment", f"""WITH {_BARY}, s AS (SELECT a.id, a.x AS ax, a.y AS ay, c.x AS bx, c.y AS by_ FROM b a JOIN b c ON c.id = (a.id + 1) % 10),
p AS (SELECT pts.id, s.id AS segment, pts.x, pts.y, ax, ay, bx, by_, sqrt((bx - ax) ** 2 + (by_ - ay) ** 2) AS l, ((pts.x - ax) * (bx - ax) + (pts.y - ay) * (by_ - ay)) / sqrt((bx - ax) ** 2 + (by_ - ay) ** 2) AS s FROM pts, s),
t AS (SELECT id, segment, x, y, CASE WHEN s < 0 OR s > l THEN bx ELSE ax + (bx - ax) / l * s END AS tx, CASE WHEN s < 0 OR s > l THEN by_ ELSE ay + (by_ - ay) / l * s END AS ty FROM p)
SELECT id, segment, round((tx - x) ** 2 + (ty - y) ** 2, 5) AS d2 FROM t QUALIFY row_number() OVER (PARTITION BY id ORDER BY (tx - x) ** 2 + (ty - y) ** 2, segment) = 1""")
def nearest_segment(spark, d):
    """The closed path through the barycentres, for every point."""
    b = barycentres(spark, d)
    a = b.select("id", F.col("x").alias("ax"), F.col("y").alias("ay"))
    c = b.select(((F.col("id") + 9) % 10).cast(b.schema["id"].dataType).alias("id"), F.col("x").alias("bx"), F.col("y").alias("by"))
    return N.nearest_segment(points(spark, d), a.join(c, "id")).select("id", "segment", F.round("d2", 5).alias("d2"))


_AGENTS = "a AS (SELECT id, x, y, (id * 37) % 360 - 180 AS direction FROM pts WHERE label = 1), f AS (SELECT id, x, y FROM pts WHERE label IN (2, 4))"


def _agents(spark, d):
    return points(spark, d).where("label = 1").select("id", "x", "y", ((F.col("id") * 37) % 360 - 180).alias("direction"))


@query("vision_cone", f"""WITH {_PTS}, {_AGENTS} SELECT a.id, min(f.id) AS target FROM a JOIN f ON sqrt((f.x - a.x) ** 2 + (f.y - a.y) ** 2) < 0.6
AND abs(a.direction - degrees(atan2(f.y - a.y, f.x - a.x))) < 45 GROUP BY 1""")
def vision_cone(spark, d):
    return R.first_in_sight(_agents(spark, d), points(spark, d).where("label in (2, 4)"), 0.6, 45.0)


@query("clear_of_hits", f"WITH {_PTS} SELECT id FROM pts p WHERE label = 5 AND NOT EXISTS (SELECT 1 FROM pts b WHERE b.label = 6 AND sqrt((p.x - b.x) ** 2 + (p.y - b.y) ** 2) <= 0.4)")
def clear_of_hits(spark, d):
    p = points(spark, d)
    return R.clear_of(p.where("label = 5"), p.where("label = 6"), 0.4).select("id")


@query("next_ahead", f"""WITH {_PTS}, q AS (SELECT p.id, o.id AS obstacle, o.x - p.x AS ahead, row_number() OVER (PARTITION BY p.id ORDER BY o.x, o.id) AS rn
  FROM pts p LEFT JOIN pts o ON o.label = 3 AND p.id % 4 = o.id % 4 AND o.x > p.x WHERE p.label <> 3)
SELECT id, obstacle, round(ahead, 6) AS ahead FROM q WHERE rn = 1""")
def next_ahead(spark, d):
    """The nearest obstacle strictly ahead in the same of four lanes."""
    p = points(spark, d).withColumn("lane", F.col("id") % 4)
    p = p.withColumn("id", F.col("id").cast("long"))
    return R.next_ahead(p.where("label <> 3"), p.where("label = 3"), "lane", 0.5).select("id", "obstacle", F.round("ahead", 6).alias("ahead"))


_RECT = "r AS (SELECT id, label, x, y, 0.05e0 + (id % 7) * 0.03e0 AS w, 0.05e0 + (id % 5) * 0.04e0 AS h FROM pts)"


@query("overlapping_rectangles", f"WITH {_PTS}, {_RECT} SELECT a.id AS a, b.id AS b FROM r a JOIN r b ON a.label = 1 AND b.label = 2 AND abs(a.x - b.x) <= a.w + b.w AND abs(a.y - b.y) <= a.h + b.h")
def overlapping_rectangles(spark, d):
    i = F.col("id")
    r = points(spark, d).withColumns({"w": 0.05 + (i % 7) * 0.03, "h": 0.05 + (i % 5) * 0.04})
    return R.overlapping(r.where("label = 1"), r.where("label = 2"), 0.5)


_STEPS = "e AS (SELECT user_id, event_type AS i, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS j FROM events), t AS (SELECT i, j, count(*) AS n FROM e WHERE j IS NOT NULL GROUP BY ALL), w AS (SELECT i, j, round(n / sum(n) OVER (PARTITION BY i), 9) AS w FROM t)"


@query("path_lookup", f"WITH {_STEPS} SELECT user_id, round(sum(w), 4) AS total, count(*) AS edges FROM e JOIN w USING (i, j) GROUP BY 1")
def path_lookup(spark, d):
    """Each user's path through the event types, looked up in the matrix of all transitions."""
    e = load(spark, d, "events")
    step = e.select(F.col("event_type").alias("i"), F.lead("event_type").over(W.over(["ts", "event_id"], ["user_id"])).alias("j")).where("j is not null")
    t = step.groupBy("i", "j").agg(F.count("*").alias("n"))
    w = t.select("i", "j", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("i")), 9).alias("w"))
    return R.path_sum(e, w, ["user_id"], ["ts", "event_id"], "event_type").select("user_id", F.round("total", 4).alias("total"), "edges")


_GRID = "g AS (SELECT id, CAST(floor(x / 0.4e0) AS BIGINT) AS gx, CAST(floor(y / 0.4e0) AS BIGINT) AS gy FROM pts)"


@query("grid_neighbours", f"WITH {_PTS}, {_GRID} SELECT a.id, count(*) - 1 AS n FROM g a JOIN g b ON abs(a.gx - b.gx) <= 1 AND abs(a.gy - b.gy) <= 1 GROUP BY 1")
def grid_neighbours(spark, d):
    return R.neighbour_counts(points(spark, d), 0.4)


@query("nonempty_cells", f"WITH {_PTS}, {_GRID} SELECT gx, gy, count(*) AS n FROM g GROUP BY ALL")
def nonempty_cells(spark, d):
    p = points(spark, d)
    return p.groupBy(F.floor(F.col("x") / 0.4).alias("gx"), F.floor(F.col("y") / 0.4).alias("gy")).agg(F.count("*").alias("n"))


@query("single_cells", f"WITH {_PTS}, {_GRID} SELECT gx, gy, min(id) AS id FROM g GROUP BY gx, gy HAVING count(*) = 1")
def single_cells(spark, d):
    """Cells that only one point can fill."""
    p = points(spark, d).groupBy(F.floor(F.col("x") / 0.4).alias("gx"), F.floor(F.col("y") / 0.4).alias("gy"))
    return p.agg(F.count("*").alias("n"), F.min("id").alias("id")).where("n = 1").drop("n")


@query("neighbour_means", f"""WITH {_PTS}, n AS (SELECT a.id, avg(b.x) AS mx, avg(b.y) AS my, count(*) AS n FROM pts a JOIN pts b ON a.id <> b.id AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 0.5 GROUP BY 1)
SELECT id, round(mx / sqrt(mx * mx + my * my) * 4, 4) AS vx, round(my / sqrt(mx * mx + my * my) * 4, 4) AS vy, n FROM n""")
def neighbour_means(spark, d):
    """The mean of the neighbours' vectors, set to length 4."""
    m = R.neighbour_means(points(spark, d), 0.5, ["x", "y"])
    v = S.with_length(F.col("x"), F.col("y"), 4.0)
    return m.select("id", F.round(v[0], 4).alias("vx"), F.round(v[1], 4).alias("vy"), "n")


_SENSE = """s AS (SELECT a.id, sensor, CAST(trunc(a.x * 10 + 6 * cos(radians(direction + turn)) - 1.5e0) AS INTEGER) AS x0, CAST(trunc(a.y * 10 + 6 * sin(radians(direction + turn)) - 1.5e0) AS INTEGER) AS y0
  FROM a, (VALUES (0, -40), (1, 0), (2, 40)) t(sensor, turn)),
m AS (SELECT CAST(floor(x * 10) AS INTEGER) AS x, CAST(floor(y * 10) AS INTEGER) AS y, count(*) AS v FROM pts GROUP BY ALL),
t AS (SELECT s.id, s.sensor, coalesce(sum(m.v), 0) AS total FROM s LEFT JOIN m ON m.x BETWEEN x0 AND x0 + 2 AND m.y BETWEEN y0 AND y0 + 2 GROUP BY ALL)"""


@query("best_sensor", f"WITH {_PTS}, {_AGENTS}, {_SENSE} SELECT id, CAST(arg_max(sensor, total * 10 - sensor) AS INTEGER) AS sensor, CAST(max(total) AS BIGINT) AS total FROM t GROUP BY 1")
def best_sensor(spark, d):
    """Which of three squares ahead of an agent holds most points of the raster."""
    p = points(spark, d)
    raster = p.groupBy(F.floor(F.col("x") * 10).cast("int").alias("x"), F.floor(F.col("y") * 10).cast("int").alias("y")).agg(F.count("*").alias("v"))
    agents = _agents(spark, d).withColumns({"x": F.col("x") * 10, "y": F.col("y") * 10})
    return R.best_sensor(agents, raster, 6.0, [-40, 0, 40], 3)


# ---- sets, samples, order


@query("union_all", "SELECT c_nationkey AS nation, c_acctbal AS balance FROM customer UNION ALL SELECT s_nationkey, s_acctbal FROM supplier")
def union_all(spark, d):
    c = load(spark, d, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"))
    return c.unionByName(load(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance")))


@query("distinct_values", "SELECT DISTINCT event_type, user_id % 10 AS u FROM events")
def distinct_values(spark, d):
    return load(spark, d, "events").select("event_type", (F.col("user_id") % 10).alias("u")).distinct()


@query("append_columns", """WITH e AS (SELECT vec_id, round(embedding[1]::DOUBLE, 6) AS a, row_number() OVER (ORDER BY embedding[1], vec_id) AS rn FROM embeddings), d AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY n_chars, doc_id) AS rn FROM documents)
SELECT e.rn AS place, vec_id, a, doc_id, n_chars FROM e JOIN d USING (rn)""")
def append_columns(spark, d):
    """Two tables side by side by position, each in an order of its own; the rows that the longer one has more are left out."""
    e = load(spark, d, "embeddings").select("vec_id", F.col("embedding")[0].alias("x"))
    n = load(spark, d, "documents").select("doc_id", "n_chars")
    e = O.numbered(e, [], ["x", "vec_id"]).select("rn", "vec_id", F.round(F.col("x").cast("double"), 6).alias("a"))
    n = O.numbered(n, [], ["n_chars", "doc_id"]).select("rn", "doc_id", "n_chars")
    return e.join(n, "rn").select(F.col("rn").alias("place"), "vec_id", "a", "doc_id", "n_chars")


@query("sample_without_replacement", "SELECT o_orderkey FROM orders ORDER BY md5('s1' || CAST(o_orderkey AS VARCHAR)), o_orderkey LIMIT 100")
def sample_without_replacement(spark, d):
    return W.sample(load(spark, d, "orders").select("o_orderkey"), "o_orderkey", 100, "s1")


@query("seeded_shuffle", "SELECT p_partkey, row_number() OVER (ORDER BY md5('s2' || CAST(p_partkey AS VARCHAR)), p_partkey) AS place FROM part")
def seeded_shuffle(spark, d):
    return W.shuffled(load(spark, d, "part").select("p_partkey"), "p_partkey", "s2")


@query("order_by_name", "SELECT n_name, row_number() OVER (ORDER BY n_name) AS place FROM nation")
def order_by_name(spark, d):
    """One row a nation."""
    return load(spark, d, "nation").select("n_name", F.row_number().over(Window.orderBy("n_name")).cast("long").alias("place"))


@query("forward_fill_counts", """WITH s AS (SELECT user_id, event_id, ts, CASE WHEN value < 100 THEN value END AS v FROM events)
SELECT user_id, count_if(v IS NULL) AS missing, round(sum(coalesce(f, 0)), 3) AS filled FROM (SELECT user_id, v, last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS f FROM s) GROUP BY 1""")
def forward_fill_counts(spark, d):
    s = load(spark, d, "events").select("user_id", "event_id", "ts", F.when(F.col("value") < 100, F.col("value")).alias("v"))
    f = s.withColumn("f", W.forward_fill("v", ["ts", "event_id"], ["user_id"]))
    return f.groupBy("user_id").agg(F.count_if(F.col("v").isNull()).alias("missing"), F.round(F.sum("f"), 3).alias("filled"))


@query("absorbing_layers", """WITH RECURSIVE e AS (SELECT user_id, value, least(0.1e0 + (event_id % 13) * 0.1e0, 1) AS k, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
t AS (SELECT user_id, 100e0 AS x, CAST(0 AS BIGINT) AS rn FROM (SELECT DISTINCT user_id FROM events) UNION ALL SELECT t.user_id, t.x * (1 - e.k) + e.value, e.rn FROM t JOIN e ON e.user_id = t.user_id AND e.rn = t.rn + 1)
SELECT user_id, round(arg_max(x, rn), 4) AS x FROM t GROUP BY user_id""")
def absorbing_layers(spark, d):
    """What enters a layer loses at most all of itself and gains what the layer emits: f = f (1 - min(k, 1)) + e."""
    k = F.least(0.1 + (F.col("event_id") % 13) * 0.1, F.lit(1.0))
    e = load(spark, d, "events").select("user_id", F.struct("ts", "event_id").alias("at"), (1 - k).alias("k"), F.col("value").alias("e"))
    return O.recurrence(e, ["user_id"], "at", "k", "e", F.lit(100.0)).select("user_id", F.round("x", 4).alias("x"))


@query("absorbing_layers_steps", """WITH RECURSIVE e AS (SELECT user_id, event_id, value, least((event_id % 13 + 1) / 11e0, 1) AS k, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
t AS (SELECT user_id, CAST(NULL AS BIGINT) AS event_id, 100e0 AS x, CAST(0 AS BIGINT) AS rn FROM (SELECT DISTINCT user_id FROM events)
  UNION ALL SELECT t.user_id, e.event_id, t.x * (1 - e.k) + e.value, e.rn FROM t JOIN e ON e.user_id = t.user_id AND e.rn = t.rn + 1)
SELECT user_id, event_id, round(x, 4) AS x FROM t WHERE rn > 0""")
def absorbing_layers_steps(spark, d):
    """What leaves every layer."""
    k = F.least((F.col("event_id") % 13 + 1) / 11, F.lit(1.0))
    e = load(spark, d, "events").select("user_id", F.struct("ts", "event_id").alias("at"), (1 - k).alias("k"), F.col("value").alias("e"))
    return O.recurrence_steps(e, ["user_id"], "at", "k", "e", F.lit(100.0)).select("user_id", "at.event_id", F.round("x", 4).alias("x"))
