"""Queries that profile tables and shape columns."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewater.operators import profile as P
from tidewater.operators import series as S
from tidewater.plans.registry import load, query
from tidewater.plans.series import DAILY, daily

_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
SHIPPED = "shipped AS (SELECT CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS dt, sum(l_extendedprice) AS value, sum(l_quantity) AS qty FROM lineitem GROUP BY 1)"


def shipped(spark, d):
    return load(spark, d, "lineitem").groupBy(F.col("l_shipdate").cast("date").cast("string").alias("dt")).agg(
        F.sum("l_extendedprice").alias("value"), F.sum("l_quantity").alias("qty")
    )


@query("describe_lineitem", " UNION ALL ".join(
    f"""SELECT '{c}' AS name, count({c}) AS n, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS sd, CAST(min({c}) AS DOUBLE) AS lo,
    round(quantile_cont({c}, 0.25), 6) AS q25, round(quantile_cont({c}, 0.5), 6) AS q50, round(quantile_cont({c}, 0.75), 6) AS q75, CAST(max({c}) AS DOUBLE) AS hi FROM lineitem""" for c in _COLS))
def describe_lineitem(spark, d):
    out = P.describe(load(spark, d, "lineitem"), _COLS)
    return out.select("name", "n", *[F.round(c, 6).alias(c) if c not in ("lo", "hi") else F.col(c) for c in out.columns[2:]])


@query("moments_by_group", """
SELECT event_type, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd_sample, round(stddev_pop(value), 6) AS sd_pop, min(value) AS lo, max(value) AS hi,
  round(sum(value), 4) AS total, round(sqrt(sum(value * value)), 4) AS l2, round(sum(abs(value)), 4) AS l1 FROM events GROUP BY 1""")
def moments_by_group(spark, d):
    v = F.col("value")
    return load(spark, d, "events").groupBy("event_type").agg(
        F.round(F.avg(v), 6).alias("mean"), F.round(F.stddev_samp(v), 6).alias("sd_sample"), F.round(F.stddev_pop(v), 6).alias("sd_pop"), F.min(v).alias("lo"),
        F.max(v).alias("hi"), F.round(F.sum(v), 4).alias("total"), F.round(F.sqrt(F.sum(v * v)), 4).alias("l2"), F.round(F.sum(F.abs(v)), 4).alias("l1"),
    )


_JOINED = f"WITH {DAILY}, {SHIPPED}, j AS (SELECT dt, total, value, qty FROM daily LEFT JOIN shipped USING (dt))"


@query("left_join_daily", f"{_JOINED} SELECT dt, round(total, 4) AS total, round(value, 4) AS value FROM j")
def left_join_daily(spark, d):
    return daily(spark, d).join(shipped(spark, d), "dt", "left").select("dt", F.round("total", 4).alias("total"), F.round("value", 4).alias("value"))


def _joined(spark, d):
    return daily(spark, d).join(shipped(spark, d), "dt", "left")


_PAIRS = [(a, b) for a in ("total", "value", "qty") for b in ("total", "value", "qty")]


@query("corr_matrix", _JOINED + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {'1e0' if a == b else f'round(corr({a}, {b}), 6)'} AS r FROM {'j' if a != b else '(SELECT 1)'}" for a, b in _PAIRS))
def corr_matrix(spark, d):
    return P.correlation_matrix(_joined(spark, d), ["total", "value", "qty"]).select("a", "b", F.round("r", 6).alias("r"))


@query("corr_by_year", f"{_JOINED} SELECT CAST(dt[1:4] AS INTEGER) AS y, round(corr(total, value), 6) AS r FROM j WHERE dt BETWEEN '1996-01-01' AND '2000-12-31' GROUP BY 1")
def corr_by_year(spark, d):
    j = _joined(spark, d).where(F.col("dt").between("1996-01-01", "2000-12-31"))
    return j.groupBy(F.substring("dt", 1, 4).cast("int").alias("y")).agg(F.round(F.corr("total", "value"), 6).alias("r"))


@query("year_filter", "SELECT o_orderkey, o_totalprice FROM orders WHERE year(o_orderdate) = 1997")
def year_filter(spark, d):
    """Written as a date range, so that it is pushed to the scan."""
    t = F.col("o_orderdate")
    lo, hi = (F.lit(x).cast("timestamp_ntz") for x in ("1997-01-01", "1998-01-01"))
    return load(spark, d, "orders").where((t >= lo) & (t < hi)).select("o_orderkey", "o_totalprice")


@query("value_counts_freq", "SELECT event_type, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM events GROUP BY 1")
def value_counts_freq(spark, d):
    return P.value_counts(load(spark, d, "events"), "event_type").select("event_type", "n", F.round("share", 6).alias("share"))


_DL = "WITH dl AS (SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id))"


def _dl(spark, d):
    return load(spark, d, "documents").drop("text").join(load(spark, d, "labels"), "doc_id", "left")


@query("missing_rate", _DL + " UNION ALL ".join(f" SELECT '{c}' AS name, round(avg(CAST({c} IS NULL AS INTEGER)), 6) AS rate FROM dl" for c in ("doc_id", "lang", "source", "n_chars", "quality", "toxic")))
def missing_rate(spark, d):
    return P.missing_rates(_dl(spark, d)).select("name", F.round("rate", 6).alias("rate"))


@query("columns_by_missing", _DL + " SELECT doc_id, quality, toxic FROM dl")
def columns_by_missing(spark, d):
    df = _dl(spark, d)
    return df.select("doc_id", *P.columns_by_missing(df, 0.3, 0.9))


@query("drop_any_null", _DL + " SELECT * FROM dl WHERE quality IS NOT NULL AND toxic IS NOT NULL AND lang IS NOT NULL AND source IS NOT NULL AND n_chars IS NOT NULL")
def drop_any_null(spark, d):
    return _dl(spark, d).na.drop("any")


@query("choose_by_type", "SELECT c_name, c_mktsegment FROM customer")
def choose_by_type(spark, d):
    df = load(spark, d, "customer")
    return df.select(*P.columns_of_type(df, "string"))


_ABS = f"WITH {DAILY}, p AS (SELECT dt, (total - lag(total) OVER (ORDER BY dt)) / lag(total) OVER (ORDER BY dt) * 100 AS pct FROM daily), a AS (SELECT abs(pct) AS x FROM p WHERE pct IS NOT NULL)"
_HIST = f"{_ABS}, h AS (SELECT CAST(b.b AS INTEGER) AS bin, b.b * 5e0 AS lo, b.b * 5e0 + 5 AS hi, count(a.x) AS n FROM range(60) b(b) LEFT JOIN a ON ceil(a.x / 5) - 1 = b.b AND a.x > 0 AND a.x <= 300 GROUP BY b.b)"
_ZIPF = f"""{_HIST}, z AS (SELECT m.bin, m.mid, r.n, CAST(sum(r.n) OVER (ORDER BY m.bin) AS BIGINT) AS cumul
  FROM (SELECT bin, (lo + hi) / 2 AS mid FROM h) m JOIN (SELECT n, row_number() OVER (ORDER BY n DESC) - 1 AS bin FROM h) r USING (bin))"""


def _moves(spark, d):
    x = F.abs(S.percent_change("total", ["dt"]))
    return daily(spark, d).select(x.alias("x")).where("x is not null")


@query("histogram_right_closed", f"{_HIST} SELECT * FROM h")
def histogram_right_closed(spark, d):
    return P.histogram(_moves(spark, d), "x", 5.0, 60)


@query("zipf_rank", f"{_ZIPF} SELECT * FROM z")
def zipf_rank(spark, d):
    return P.zipf_rank(P.histogram(_moves(spark, d), "x", 5.0, 60))


@query("cumulative_distribution", f"{_HIST} SELECT bin, hi, CAST(sum(n) OVER (ORDER BY bin) AS BIGINT) AS cumul, round(sum(n) OVER (ORDER BY bin) / sum(n) OVER (), 6) AS share FROM h")
def cumulative_distribution(spark, d):
    h = P.histogram(_moves(spark, d), "x", 5.0, 60)
    up = F.sum("n").over(Window.orderBy("bin"))
    return h.select("bin", "hi", up.alias("cumul"), F.round(up / F.sum("n").over(Window.partitionBy(F.lit(0))), 6).alias("share"))


@query("inverse_cdf_draws", f"""{_ZIPF}, t AS (SELECT sum(n) AS total FROM z), u AS (SELECT k, (k + 0.5e0) / 2000 * total AS r FROM range(2000) g(k), t),
s AS (SELECT cumul AS c1, min(mid) AS m1 FROM z GROUP BY cumul),
s2 AS (SELECT c1, m1, coalesce(lag(c1) OVER (ORDER BY c1), 0) AS c0, coalesce(lag(m1) OVER (ORDER BY c1), 0) AS m0 FROM s)
SELECT k, round(r, 6) AS r, round(m0 + (m1 - m0) * (r - c0) / (c1 - c0), 6) AS x FROM u JOIN s2 ON r > c0 AND r <= c1""")
def inverse_cdf_draws(spark, d):
    curve = P.zipf_rank(P.histogram(_moves(spark, d), "x", 5.0, 60))
    total = curve.agg(F.sum("n").alias("total"))
    draws = spark.range(2000).join(F.broadcast(total)).select(F.col("id").alias("k"), ((F.col("id") + 0.5) / 2000 * F.col("total")).alias("r"))
    return P.inverse_cdf(draws, curve).select("k", F.round("r", 6).alias("r"), F.round("x", 6).alias("x"))


@query("decile_grid", " UNION ALL ".join(f"SELECT {i} AS i, round(quantile_cont(value, {i / 10}), 6) AS q FROM events" for i in range(1, 10)))
def decile_grid(spark, d):
    return P.decile_grid(load(spark, d, "events"), "value").select(F.posexplode("grid").alias("i", "q")).select((F.col("i") + 1).alias("i"), F.round("q", 6).alias("q"))


@query("decile_band", """WITH g AS (SELECT quantile_cont(value, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS q FROM events)
SELECT event_id, CAST(CASE WHEN value IS NULL THEN 9 ELSE len(list_filter(q, lambda x: x <= value)) END AS INTEGER) AS band FROM events, g""")
def decile_band(spark, d):
    e = load(spark, d, "events")
    return e.crossJoin(F.broadcast(P.decile_grid(e, "value"))).select("event_id", P.decile_band(F.col("value"), F.col("grid")).alias("band"))


_EDGES = [10, 20, 35, 50, 75, 100, 150, 200, 300, 500]


@query("band_case", "SELECT event_id, CASE " + " ".join(f"WHEN value < {e} THEN {i}" for i, e in enumerate(_EDGES)) + f" ELSE {len(_EDGES)} END AS band FROM events")
def band_case(spark, d):
    return load(spark, d, "events").select("event_id", P.band(F.col("value"), _EDGES).alias("band"))


@query("encode_map", "SELECT event_id, CASE event_type WHEN 'purchase' THEN 1 WHEN 'view' THEN 0 WHEN 'error' THEN -1 END AS code FROM events")
def encode_map(spark, d):
    codes = F.create_map(*[F.lit(x) for kv in (("purchase", 1), ("view", 0), ("error", -1)) for x in kv])
    return load(spark, d, "events").select("event_id", F.try_element_at(codes, F.col("event_type")).alias("code"))


@query("any_positive", _DL + " SELECT doc_id, coalesce(quality, 0) + coalesce(toxic, 0) >= 1 AS flag FROM dl")
def any_positive(spark, d):
    return _dl(spark, d).select("doc_id", (F.coalesce("quality", F.lit(0)) + F.coalesce("toxic", F.lit(0)) >= 1).alias("flag"))


@query("one_hot", "SELECT vec_id, " + ", ".join(f"CAST(label = {i} AS INTEGER) AS k{i}" for i in range(10)) + " FROM embeddings")
def one_hot(spark, d):
    hot = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda k: (k == F.col("label")).cast("int"))
    return load(spark, d, "embeddings").select("vec_id", hot.alias("h")).select("vec_id", *[F.get("h", F.lit(i)).alias(f"k{i}") for i in range(10)])


@query("project_rename_drop", "SELECT o_orderkey AS id, o_orderstatus AS status, round(o_totalprice / 1000, 6) AS thousands, round(o_totalprice / (SELECT max(o_totalprice) FROM orders) * 100, 6) AS pct_of_max FROM orders")
def project_rename_drop(spark, d):
    o = load(spark, d, "orders").drop("o_custkey", "o_orderdate", "o_orderpriority").withColumnsRenamed({"o_orderkey": "id", "o_orderstatus": "status"})
    top = o.agg(F.max("o_totalprice").alias("top"))
    return o.crossJoin(F.broadcast(top)).select("id", "status", F.round(F.col("o_totalprice") / 1000, 6).alias("thousands"), F.round(F.col("o_totalprice") / F.col("top") * 100, 6).alias("pct_of_max"))


_STATUS = ("F", "O", "P")


@query("pivot_wide", "SELECT CAST(year(o_orderdate) AS INTEGER) AS y, " + ", ".join(f"round(sum(CASE WHEN o_orderstatus = '{s}' THEN o_totalprice END), 2) AS {s}_total, count(CASE WHEN o_orderstatus = '{s}' THEN 1 END) AS {s}_n" for s in _STATUS) + " FROM orders GROUP BY 1")
def pivot_wide(spark, d):
    """Long to wide with flattened two-level names."""
    g = load(spark, d, "orders").groupBy(F.year("o_orderdate").alias("y")).pivot("o_orderstatus", list(_STATUS))
    w = g.agg(F.sum("o_totalprice").alias("total"), F.count(F.lit(1)).alias("n"))
    return w.select("y", *[c for s in _STATUS for c in (F.round(f"{s}_total", 2).alias(f"{s}_total"), F.coalesce(f"{s}_n", F.lit(0)).alias(f"{s}_n"))])


@query("unpivot_long", "SELECT l_orderkey, l_linenumber, name, value FROM (SELECT l_orderkey, l_linenumber, l_discount, l_tax FROM lineitem) UNPIVOT (value FOR name IN (l_discount, l_tax))")
def unpivot_long(spark, d):
    return load(spark, d, "lineitem").unpivot(["l_orderkey", "l_linenumber"], ["l_discount", "l_tax"], "name", "value")


@query("max_scaling", "SELECT vec_id, round(embedding[1] / (SELECT max(embedding[1]) FROM embeddings), 5) AS x, round(embedding[2] / 255e0, 7) AS y, 1e0 AS bias, len(embedding) + 1 AS width FROM embeddings")
def max_scaling(spark, d):
    e = load(spark, d, "embeddings")
    x = F.col("embedding")[0].cast("double")
    top = e.agg(F.max(x).alias("top"))
    wide = F.concat(F.transform("embedding", lambda v: v.cast("double")), F.array(F.lit(1.0)))
    return e.crossJoin(F.broadcast(top)).select("vec_id", F.round(x / F.col("top"), 5).alias("x"), F.round(F.col("embedding")[1].cast("double") / 255, 7).alias("y"), F.element_at(wide, -1).alias("bias"), F.size(wide).cast("long").alias("width"))


@query("reshape_rows", "SELECT vec_id, (i - 1) // 8 AS r, (i - 1) % 8 AS c, round(v, 6) AS v FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings)")
def reshape_rows(spark, d):
    """An array as the cells of an 8 x 8 matrix."""
    e = load(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v"))
    return e.select("vec_id", F.floor(F.col("i") / 8).alias("r"), (F.col("i") % 8).cast("long").alias("c"), F.round(F.col("v").cast("double"), 6).alias("v"))


@query("anova_top3", """WITH x AS (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
g AS (SELECT i, label, count(*) AS n, avg(x) AS m, var_pop(x) AS v FROM x GROUP BY 1, 2),
t AS (SELECT i, sum(n) AS n, count(*) AS k, sum(n * v) AS wi, sum(n * m * m) AS nmm, sum(n * m) AS nm FROM g GROUP BY i)
SELECT 'e' || i AS name, round(((nmm - nm * nm / n) / (k - 1)) / (wi / (n - k)), 5) AS f FROM t ORDER BY f DESC LIMIT 3""")
def anova_top3(spark, d):
    f = P.anova_f_positions(load(spark, d, "embeddings"), "embedding", "label", "e")
    return f.orderBy(F.desc("f")).limit(3).select("name", F.round("f", 5).alias("f"))


@query("range_filter", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 10 AND l_quantity < 40 AND l_discount > 0.02 AND l_tax < 0.07 AND l_extendedprice > 5000")
def range_filter(spark, d):
    q, p = F.col("l_quantity"), F.col("l_extendedprice")
    return load(spark, d, "lineitem").where((q > 10) & (q < 40) & (F.col("l_discount") > 0.02) & (F.col("l_tax") < 0.07) & (p > 5000)).select("l_orderkey", "l_linenumber")


@query("positional_slice", f"WITH {DAILY} SELECT dt, round(total, 4) AS total FROM (SELECT *, row_number() OVER (ORDER BY dt) AS rn FROM daily) WHERE rn BETWEEN 101 AND 200")
def positional_slice(spark, d):
    return daily(spark, d).withColumn("rn", F.row_number().over(Window.orderBy("dt"))).where(F.col("rn").between(101, 200)).select("dt", F.round("total", 4).alias("total"))


@query("prefix_filter", "SELECT p_partkey, p_name FROM part WHERE starts_with(p_type, (SELECT min(p_type) FROM part)[1:4])")
def prefix_filter(spark, d):
    p = load(spark, d, "part")
    head = p.agg(F.substring(F.min("p_type"), 1, 4).alias("head"))
    return p.join(F.broadcast(head), F.col("p_type").startswith(F.col("head"))).select("p_partkey", "p_name")


@query("clip_and_select", "SELECT event_id, greatest(5, least(100, value)) AS clipped, CASE WHEN value > 50 THEN value ELSE value * 0.01e0 END AS leaky FROM events")
def clip_and_select(spark, d):
    v = F.col("value")
    return load(spark, d, "events").select("event_id", F.greatest(F.lit(5.0), F.least(F.lit(100.0), v)).alias("clipped"), F.when(v > 50, v).otherwise(v * 0.01).alias("leaky"))


@query("conditional_counts", "SELECT user_id, count_if(event_type = 'purchase') AS bought, count_if(value > 50) AS large, count(DISTINCT event_type) AS kinds FROM events GROUP BY 1")
def conditional_counts(spark, d):
    return load(spark, d, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "purchase").alias("bought"), F.count_if(F.col("value") > 50).alias("large"), F.countDistinct("event_type").alias("kinds"))


@query("action_counts_zero_filled", "SELECT u.user_id, t.event_type, count(e.event_id) AS n FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN (SELECT DISTINCT event_type FROM events) t LEFT JOIN events e ON e.user_id = u.user_id AND e.event_type = t.event_type GROUP BY 1, 2")
def action_counts_zero_filled(spark, d):
    """Counts for every action, used or not: a map of the counted ones, filled from the list of all."""
    e = load(spark, d, "events")
    kinds = e.agg(F.sort_array(F.collect_set("event_type")).alias("kinds"))
    per = e.groupBy("user_id", "event_type").count().groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "count"))).alias("m"))
    out = per.crossJoin(F.broadcast(kinds)).select("user_id", "m", F.explode("kinds").alias("event_type"))
    return out.select("user_id", "event_type", F.coalesce(F.try_element_at("m", F.col("event_type")), F.lit(0)).alias("n"))
