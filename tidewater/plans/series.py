"""Queries on ordered series: windows, splits, scaling, trajectories."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.operators import ordered as O
from tidewater.operators import series as S
from tidewater.plans.registry import load, query

DAILY = "daily AS (SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS dt, sum(o_totalprice) AS total FROM orders GROUP BY 1)"
REWARD = "r AS (SELECT event_id, user_id, ts, CASE event_type WHEN 'purchase' THEN 1e0 WHEN 'error' THEN -1e0 ELSE 0e0 END AS reward, value FROM events)"


def daily(spark, d) -> DataFrame:
    return load(spark, d, "orders").groupBy(F.col("o_orderdate").cast("date").cast("string").alias("dt")).agg(F.sum("o_totalprice").alias("total"))


def rewards(spark, d) -> DataFrame:
    r = F.when(F.col("event_type") == "purchase", 1.0).when(F.col("event_type") == "error", -1.0).otherwise(0.0)
    return load(spark, d, "events").select("event_id", "user_id", "ts", r.alias("reward"), "value")


@query("rolling_mean_daily", f"""
WITH {DAILY}
SELECT dt, round(total, 4) AS total,
  round(CASE WHEN count(total) OVER w20 = 20 THEN avg(total) OVER w20 END, 4) AS mean20,
  round((total - lag(total) OVER w) / nullif(lag(total) OVER w, 0) * 100, 4) AS pct,
  round(sum(total) OVER (ORDER BY dt ROWS UNBOUNDED PRECEDING), 2) AS cum
FROM daily WINDOW w AS (ORDER BY dt), w20 AS (ORDER BY dt ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""")
def rolling_mean_daily(spark, d):
    return daily(spark, d).select(
        "dt", F.round("total", 4).alias("total"), F.round(S.rolling_mean("total", 20, ["dt"]), 4).alias("mean20"),
        F.round(S.percent_change("total", ["dt"]), 4).alias("pct"), F.round(S.cumulative_sum("total", ["dt"]), 2).alias("cum"),
    )


@query("pct_change_abs", f"""
WITH {DAILY}
SELECT dt, round((total - p) / nullif(p, 0) * 100, 4) AS pct, round(abs(total - p) / nullif(p, 0) * 100, 4) AS pct_abs
FROM (SELECT dt, total, lag(total) OVER (ORDER BY dt) AS p FROM daily)""")
def pct_change_abs(spark, d):
    return daily(spark, d).select(
        "dt", F.round(S.percent_change("total", ["dt"]), 4).alias("pct"), F.round(S.percent_change("total", ["dt"], absolute=True), 4).alias("pct_abs")
    )


_SPLIT = f"""WITH {DAILY}, s AS (
  SELECT dt, total, row_number() OVER (ORDER BY dt) <= floor(count(*) OVER () * 0.8e0) AS train FROM daily),
st AS (SELECT avg(total) AS mu, stddev_samp(total) AS sd FROM s WHERE train)"""


@query("zscore_train_stats", f"""{_SPLIT}
SELECT dt, train, round((total - mu) / sd, 6) AS z, round((total - mu) / sd * sd + mu, 4) AS back FROM s, st""")
def zscore_train_stats(spark, d):
    s = S.chronological_split(daily(spark, d), ["dt"], 0.8)
    z = S.zscore(s, ["total"], F.col("train"))
    return z.select("dt", "train", F.round("z_total", 6).alias("z"), F.round(S.unscale(F.col("z_total"), F.col("mu_total"), F.col("sd_total")), 4).alias("back"))


@query("zscore_table", f"""WITH {DAILY} SELECT dt, round((total - avg(total) OVER ()) / stddev_samp(total) OVER (), 6) AS z FROM daily""")
def zscore_table(spark, d):
    return S.zscore(daily(spark, d), ["total"]).select("dt", F.round("z_total", 6).alias("z"))


@query("chronological_split", f"{_SPLIT} SELECT train, count(*) AS n, min(dt) AS first_dt, max(dt) AS last_dt FROM s GROUP BY train")
def chronological_split(spark, d):
    s = S.chronological_split(daily(spark, d), ["dt"], 0.8)
    return s.groupBy("train").agg(F.count("*").alias("n"), F.min("dt").alias("first_dt"), F.max("dt").alias("last_dt"))


@query("hash_split_exact", """
SELECT o_orderkey, row_number() OVER (ORDER BY md5('7' || CAST(o_orderkey AS VARCHAR)), o_orderkey) <= ceil(count(*) OVER () * 0.2e0) AS test FROM orders""")
def hash_split_exact(spark, d):
    return S.hash_split(load(spark, d, "orders").select("o_orderkey"), "o_orderkey", 0.2, "7")


@query("trailing_means", f"""WITH {REWARD}
SELECT event_id, round(avg(value) OVER (w ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), 6) AS mean50,
  round(sum(value) OVER (w ROWS BETWEEN 50 PRECEDING AND CURRENT ROW) / least(50, row_number() OVER w), 6) AS mean51_50,
  round(avg(value) OVER (w ROWS BETWEEN 100 PRECEDING AND 1 PRECEDING), 6) AS mean100_before
FROM r WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def trailing_means(spark, d):
    o, by = ["ts", "event_id"], ["user_id"]
    return rewards(spark, d).select(
        "event_id", F.round(S.trailing_mean("value", 50, o, by), 6).alias("mean50"), F.round(S.display_mean("value", 50, o, by), 6).alias("mean51_50"),
        F.round(S.trailing_mean("value", 100, o, by, before=True), 6).alias("mean100_before"),
    )


_DISC = f"""WITH {REWARD}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM r),
f AS (SELECT *, first_value(CASE WHEN reward <> 0 THEN rn END IGNORE NULLS) OVER a AS nr,
  first_value(CASE WHEN reward <> 0 THEN reward END IGNORE NULLS) OVER a AS nv FROM n
  WINDOW a AS (PARTITION BY user_id ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
g AS (SELECT event_id, user_id, coalesce(nv * pow(0.99e0, nr - rn), 0e0) AS disc FROM f)"""


@query("discounted_reward", f"{_DISC} SELECT event_id, round(disc, 6) AS disc FROM g")
def discounted_reward(spark, d):
    r = O.discounted(rewards(spark, d), "reward", 0.99, ["ts", "event_id"], ["user_id"])
    return r.select("event_id", F.round("disc", 6).alias("disc"))


@query("discounted_reward_z", f"""{_DISC}
SELECT event_id, round((disc - avg(disc) OVER u) / nullif(stddev_pop(disc) OVER u, 0), 6) AS z FROM g WINDOW u AS (PARTITION BY user_id)""")
def discounted_reward_z(spark, d):
    r = O.discounted(rewards(spark, d), "reward", 0.99, ["ts", "event_id"], ["user_id"]).select("event_id", "user_id", "run", "disc")
    r = O.with_group_totals(r, ["user_id"], {"mu": F.avg("disc"), "sd": F.stddev_pop("disc")})
    return r.select("event_id", F.round(F.try_divide(F.col("disc") - F.col("mu"), F.col("sd")), 6).alias("z"))


@query("seq_windows", """
WITH s AS (SELECT event_id, value, row_number() OVER w AS rn, lag(value, 1) OVER w AS v1, lag(value, 8) OVER w AS v8,
  avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) AS m FROM events
  WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, v8 AS oldest, v1 AS newest, round(m, 6) AS mean, value AS target, (rn - 9) // 32 AS batch FROM s WHERE rn > 8""")
def seq_windows(spark, d):
    s = S.sequences(load(spark, d, "events"), "value", 8, ["ts", "event_id"], ["user_id"], 32)
    mean = F.aggregate("seq", F.lit(0.0), lambda a, x: a + x) / 8
    return s.select("event_id", F.get("seq", F.lit(0)).alias("oldest"), F.get("seq", F.lit(7)).alias("newest"), F.round(mean, 6).alias("mean"), "target", "batch")


@query("frame_stack4", """
SELECT event_id, coalesce(lag(value, 3) OVER w, first_value(value) OVER w) AS f0, coalesce(lag(value, 2) OVER w, first_value(value) OVER w) AS f1,
  coalesce(lag(value, 1) OVER w, first_value(value) OVER w) AS f2, value AS f3
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def frame_stack4(spark, d):
    f = S.frame_stack("value", 4, ["ts", "event_id"], ["user_id"])
    return load(spark, d, "events").select("event_id", f.alias("f")).select("event_id", *[F.get("f", F.lit(i)).alias(f"f{i}") for i in range(4)])


@query("frame_stack_newest_first", """
SELECT event_id, value AS f0, coalesce(lag(value, 1) OVER w, first_value(value) OVER w) AS f1, coalesce(lag(value, 2) OVER w, first_value(value) OVER w) AS f2,
  coalesce(lag(value, 3) OVER w, first_value(value) OVER w) AS f3
FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)""")
def frame_stack_newest_first(spark, d):
    """Five types share all rows, so each is cut into blocks that bring the three rows before them along."""
    e = load(spark, d, "events").select("event_id", "ts", "event_type", "value")
    rows, _ = O.haloed(O.numbered(e, ["event_type"], ["ts", "event_id"]), ["event_type"], 3)
    f = S.frame_stack("value", 4, ["rn"], ["event_type", "block"], newest_first=True)
    rows = rows.select("event_id", "halo", f.alias("f")).where("NOT halo")
    return rows.select("event_id", *[F.get("f", F.lit(i)).alias(f"f{i}") for i in range(4)])


@query("replay_tail", """
SELECT event_id, user_id FROM (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 30""")
def replay_tail(spark, d):
    return S.newest(load(spark, d, "events"), 30, ["ts", "event_id"], ["user_id"]).select("event_id", "user_id")


@query("episode_totals", f"""WITH {REWARD}
SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS episode, sum(reward) AS total, count(*) AS steps, max(rn) AS last_step
FROM (SELECT *, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS rn FROM r) GROUP BY 1, 2""")
def episode_totals(spark, d):
    r = rewards(spark, d).withColumn("episode", F.col("ts").cast("date").cast("string"))
    r = r.withColumn("rn", F.row_number().over(S.over(["ts", "event_id"], ["user_id", "episode"])).cast("long"))
    return r.groupBy("user_id", "episode").agg(F.sum("reward").alias("total"), F.count("*").alias("steps"), F.max("rn").alias("last_step"))


@query("running_best", """
SELECT event_id, max(value) OVER w AS best, coalesce(value > max(value) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS is_record
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def running_best(spark, d):
    w = S.over(["ts", "event_id"], ["user_id"])
    before = F.max("value").over(w.rowsBetween(Window.unboundedPreceding, -1))
    best = F.max("value").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return load(spark, d, "events").select("event_id", best.alias("best"), F.coalesce(F.col("value") > before, F.lit(True)).alias("is_record"))


@query("lap_timer", """
SELECT event_id, CAST(date_diff('millisecond', lag(ts) OVER w, ts) AS BIGINT) AS lap_ms FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def lap_timer(spark, d):
    ms = lambda c: F.unix_millis(c.cast("timestamp"))
    w = S.over(["ts", "event_id"], ["user_id"])
    return load(spark, d, "events").select("event_id", (ms(F.col("ts")) - ms(F.lag("ts").over(w))).alias("lap_ms"))


@query("eps_schedule", """
SELECT event_id, round(1.0e0 - 0.9e0 * least(rn - 1, 499) / 499, 6) AS eps, CASE WHEN rn > 550 THEN 0.01e0 WHEN rn > 200 THEN 0.05e0 ELSE 0.1e0 END AS lr
FROM (SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rn FROM events)""")
def eps_schedule(spark, d):
    e = O.numbered(load(spark, d, "events").select("event_id", "ts", "event_type"), ["event_type"], ["ts", "event_id"])
    lr = F.when(F.col("rn") > 550, 0.01).when(F.col("rn") > 200, 0.05).otherwise(0.1)
    return e.select("event_id", F.round(S.linear_schedule(F.col("rn") - 1, 1.0, 0.1, 500), 6).alias("eps"), lr.alias("lr"))


@query("central_difference", f"""WITH {DAILY}
SELECT dt, round((lead(total) OVER w - lag(total) OVER w) / 2, 4) AS diff FROM daily WINDOW w AS (ORDER BY dt)""")
def central_difference(spark, d):
    w = S.over(["dt"])
    return daily(spark, d).select("dt", F.round((F.lead("total").over(w) - F.lag("total").over(w)) / 2, 4).alias("diff"))


@query("decay_deposit", """
WITH RECURSIVE e AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
t AS (SELECT user_id, 0e0 AS x, CAST(0 AS BIGINT) AS rn FROM (SELECT DISTINCT user_id FROM events)
  UNION ALL SELECT t.user_id, t.x * 0.9e0 + e.value, e.rn FROM t JOIN e ON e.user_id = t.user_id AND e.rn = t.rn + 1)
SELECT user_id, round(arg_max(x, rn), 4) AS x FROM t GROUP BY user_id""")
def decay_deposit(spark, d):
    e = load(spark, d, "events").select("user_id", F.struct("ts", "event_id").alias("at"), F.lit(0.9).alias("k"), F.col("value").alias("e"))
    return O.recurrence(e, ["user_id"], "at", "k", "e", F.lit(0.0)).select("user_id", F.round("x", 4).alias("x"))


@query("decay_deposit_steps", """
WITH RECURSIVE e AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
t AS (SELECT user_id, CAST(NULL AS BIGINT) AS event_id, 0e0 AS x, CAST(0 AS BIGINT) AS rn FROM (SELECT DISTINCT user_id FROM events)
  UNION ALL SELECT t.user_id, e.event_id, t.x * 0.9e0 + e.value, e.rn FROM t JOIN e ON e.user_id = t.user_id AND e.rn = t.rn + 1)
SELECT user_id, event_id, round(x, 4) AS x FROM t WHERE rn > 0""")
def decay_deposit_steps(spark, d):
    """What is left of all deposits after every one."""
    e = load(spark, d, "events").select("user_id", F.struct("ts", "event_id").alias("at"), F.lit(0.9).alias("k"), F.col("value").alias("e"))
    return O.recurrence_steps(e, ["user_id"], "at", "k", "e", F.lit(0.0)).select("user_id", "at.event_id", F.round("x", 4).alias("x"))


@query("autoregressive_forecast", f"""
WITH RECURSIVE {DAILY}, st AS (SELECT CAST(dt[1:4] AS INTEGER) AS y, total, row_number() OVER (PARTITION BY CAST(dt[1:4] AS INTEGER) ORDER BY dt DESC) AS rn FROM daily),
s0 AS (SELECT y, max(CASE WHEN rn = 1 THEN total END) AS a, max(CASE WHEN rn = 2 THEN total END) AS b, max(CASE WHEN rn = 3 THEN total END) AS c FROM st GROUP BY y),
f AS (SELECT y, 1 AS step, 0.5e0 * a + 0.3e0 * b + 0.2e0 * c AS p, a, b FROM s0 WHERE c IS NOT NULL
  UNION ALL SELECT y, step + 1, 0.5e0 * p + 0.3e0 * a + 0.2e0 * b, p, a FROM f WHERE step < 12)
SELECT y, step, round(p, 4) AS p FROM f""")
def autoregressive_forecast(spark, d):
    """Each forecast feeds the next window: sequential in a series, parallel over series (one per year here)."""
    days = daily(spark, d).withColumn("y", F.substring("dt", 1, 4).cast("int"))
    last = F.slice(F.reverse(F.array_sort(F.collect_list(F.struct("dt", "total")))), 1, 3)
    g = S.newest(days, 3, ["dt"], ["y"]).groupBy("y").agg(F.transform(last, lambda s: s["total"]).alias("w")).where(F.size("w") == 3)
    step = lambda w, _: F.concat(F.array(w[0] * 0.5 + w[1] * 0.3 + w[2] * 0.2), w)
    path = F.reverse(F.slice(F.aggregate(F.sequence(F.lit(1), F.lit(12)), F.col("w"), step), 1, 12))
    return g.select("y", F.posexplode(path).alias("s", "p")).select("y", (F.col("s") + 1).alias("step"), F.round("p", 4).alias("p"))
