"""Queries on scalar and array functions, synthetic tables, rasters and spectra."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tidewater.functions import scalars as S
from tidewater.functions import tables
from tidewater.functions import vectors as V
from tidewater.operators import ordered as O
from tidewater.operators import signal as W
from tidewater.plans.registry import load, query
from tidewater.sources import files, rest, synthetic
from tidewater.tables import new_path


def _uni(key: str, salt: str = "") -> str:
    return f"(CAST('0x' || substr(md5('{salt}' || CAST({key} AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296e0)"


def _nor(key: str, salt: str = "") -> str:
    return f"(sqrt(-2 * ln(1 - {_uni(key, salt + 'a')})) * cos({2 * math.pi!r} * {_uni(key, salt + 'b')}))"


def _rounded(df, *keep, digits=6):
    return df.select(*keep, *[F.round(c, digits).alias(c) for c in df.columns if c not in keep])


# ---- text and dates


@query("text_functions", """SELECT c_custkey, concat_ws('-', c_mktsegment, c_name) AS joined, 'W' || c_nationkey AS cell, printf('%06d|%.2f', c_custkey, c_acctbal) AS shown,
  'https://host/q?tag=' || c_mktsegment || '&from=' || replace('2022-01-01T00:00:00.000Z', ':', '%3A') AS url FROM customer""")
def text_functions(spark, d):
    c = load(spark, d, "customer")
    url = S.url("https://host/q?", {"tag": F.col("c_mktsegment"), "from": F.lit("2022-01-01T00:00:00.000Z")})
    return c.select("c_custkey", F.concat_ws("-", "c_mktsegment", "c_name").alias("joined"), F.concat(F.lit("W"), F.col("c_nationkey").cast("string")).alias("cell"), F.format_string("%06d|%.2f", "c_custkey", F.col("c_acctbal").cast("double")).alias("shown"), url.alias("url"))


_SLASHED = "CASE WHEN o_orderkey % 7 = 0 THEN strftime(o_orderdate, '%d/%m/%Y') WHEN o_orderkey % 7 = 1 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END"


@query("parse_dates", f"""SELECT o_orderkey, CAST(CAST(try_strptime({_SLASHED}, '%Y-%m-%d') AS DATE) AS VARCHAR) AS d, CAST(year(try_strptime({_SLASHED}, '%Y-%m-%d')) AS INTEGER) AS y, CAST(month(try_strptime({_SLASHED}, '%Y-%m-%d')) AS INTEGER) AS m,
  strftime(o_orderdate, '%Y%m%d')[3:6] AS ymmdd, strftime(o_orderdate, '%Y-%m-%dT12:30:00') AS iso FROM orders""")
def parse_dates(spark, d):
    """A date of one form; another form and missing ones give null."""
    k, t = F.col("o_orderkey") % 7, F.col("o_orderdate")
    text = F.when(k == 0, F.date_format(t, "dd/MM/yyyy")).when(k != 1, F.date_format(t, "yyyy-MM-dd"))
    date = S.parse_date(text)
    any_ = S.parse_any(F.concat(F.date_format(t, "yyyy-MM-dd"), F.lit("T12:30:00")))
    return load(spark, d, "orders").select("o_orderkey", date.cast("string").alias("d"), F.year(date).alias("y"), F.month(date).alias("m"), F.substring(F.date_format(t, "yyyyMMdd"), 3, 4).alias("ymmdd"), F.date_format(any_, "yyyy-MM-dd'T'HH:mm:ss").alias("iso"))


# ---- geometry

_V = "v AS (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS ax, embedding[4]::DOUBLE AS ay, embedding[5]::DOUBLE AS bx, embedding[6]::DOUBLE AS by_ FROM embeddings)"


def _vectors(spark, d):
    e = F.col("embedding")
    names = ("x", "y", "ax", "ay", "bx", "by")
    return load(spark, d, "embeddings").select("vec_id", *[F.get(e, F.lit(i)).cast("double").alias(c) for i, c in enumerate(names)])


@query("vector_geometry", f"""WITH {_V}, n AS (SELECT *, sqrt(x * x + y * y) AS n FROM v)
SELECT vec_id, round(x / n * 3, 6) AS mx, round(y / n * 3, 6) AS my, round(CASE WHEN n > 0.5 THEN x * 0.5e0 / n ELSE x END, 6) AS lx, round(CASE WHEN n > 0.5 THEN y * 0.5e0 / n ELSE y END, 6) AS ly,
  round(atan2(-y, x), 6) AS heading, round(x * cos(radians(30)) - y * sin(radians(30)), 6) AS rx, round(x * sin(radians(30)) + y * cos(radians(30)), 6) AS ry,
  round(x - 2 * (x * ax + y * ay) / (ax * ax + ay * ay) * ax, 6) AS fx, round(y - 2 * (x * ax + y * ay) / (ax * ax + ay * ay) * ay, 6) AS fy, round(degrees(atan2(y, x)), 6) AS polar FROM n""")
def vector_geometry(spark, d):
    x, y, ax, ay = map(F.col, ("x", "y", "ax", "ay"))
    m, low, r, f = S.with_length(x, y, 3.0), S.limited(x, y, 0.5), S.rotated(x, y, 30.0), S.reflected(x, y, ax, ay)
    cols = {"mx": m[0], "my": m[1], "lx": low[0], "ly": low[1], "heading": S.heading(x, y), "rx": r[0], "ry": r[1], "fx": f[0], "fy": f[1], "polar": F.degrees(F.atan2(y, x))}
    return _vectors(spark, d).select("vec_id", *[F.round(c, 6).alias(k) for k, c in cols.items()])


@query("segment_projection", f"""WITH {_V}, p AS (SELECT *, ((x - ax) * (bx - ax) + (y - ay) * (by_ - ay)) / sqrt((bx - ax) ** 2 + (by_ - ay) ** 2) AS s, sqrt((bx - ax) ** 2 + (by_ - ay) ** 2) AS l FROM v)
SELECT vec_id, round(ax + (bx - ax) / l * s, 6) AS px, round(ay + (by_ - ay) / l * s, 6) AS py, round(s, 6) AS along FROM p""")
def segment_projection(spark, d):
    p = S.projected(*map(F.col, ("x", "y", "ax", "ay", "bx", "by")))
    return _vectors(spark, d).select("vec_id", *[F.round(c, 6).alias(k) for k, c in zip(("px", "py", "along"), p, strict=True)])


@query("sector_mask", f"""WITH {_V}, t AS (SELECT vec_id, x, y, atan2(x, y) - 0.3e0 AS t FROM v)
SELECT vec_id FROM t WHERE x * x + y * y <= 0.36e0 AND CASE WHEN t < 0 THEN {2 * math.pi!r} + t ELSE t END <= 2.2e0 - 0.3e0""")
def sector_mask(spark, d):
    return _vectors(spark, d).where(S.in_sector(F.col("x"), F.col("y"), 0.6, 0.3, 2.2)).select("vec_id")


@query("trigonometry", f"WITH {_V} SELECT vec_id, round(sin(x), 6) AS s, round(cos(x), 6) AS c, round(atan(y), 6) AS a, round(sqrt(x * x + y * y), 6) AS h, CAST(floor(x * 10) - 4 * floor(floor(x * 10) / 4) AS BIGINT) AS m, CAST(floor(floor(x * 10) / 4) AS BIGINT) AS q, CAST(round_even(x * 10, 0) AS BIGINT) AS r FROM v")
def trigonometry(spark, d):
    x, y = F.col("x"), F.col("y")
    ten = F.floor(x * 10)
    return _vectors(spark, d).select("vec_id", F.round(F.sin(x), 6).alias("s"), F.round(F.cos(x), 6).alias("c"), F.round(F.atan(y), 6).alias("a"), F.round(F.hypot(x, y), 6).alias("h"), F.pmod(ten, F.lit(4)).alias("m"), F.floor(ten / 4).alias("q"), F.bround(x * 10).cast("long").alias("r"))


# ---- atmosphere and quantisation


_Z = "z AS (SELECT event_id, least(value * 500, 80000) AS z FROM events)"
_STD = "CASE " + " ".join(f"WHEN z >= {b * 1000} THEN {t}e0 + (z / 1000 - {b}) * {r}e0" for b, t, r in reversed(S.LAYERS)) + " END"
_SIMPLE = "288.2e0 - 0.0065e0 * least(z, 11000)"


@query("atmosphere", f"""WITH {_Z} SELECT event_id, round({_SIMPLE}, 4) AS simple, floor({_SIMPLE}) AS whole, round({_STD}, 4) AS standard, round(101325 * exp(-z / 8500), 4) AS pressure,
  round(101325 * exp(-z / 8500) / (1.380649e-23 * ({_SIMPLE})) / 1e20, 4) AS density FROM z""")
def atmosphere(spark, d):
    """At the height that each event's value stands for, up to 80 km."""
    z = load(spark, d, "events").select("event_id", F.least(F.col("value") * 500, F.lit(80000.0)).alias("z"))
    c = F.col("z")
    return z.select("event_id", F.round(S.temperature(c), 4).alias("simple"), F.floor(S.temperature(c)).cast("double").alias("whole"), F.round(S.standard_temperature(c), 4).alias("standard"), F.round(S.pressure(c), 4).alias("pressure"), F.round(S.number_density(c) / 1e20, 4).alias("density"))


@query("black_body", f"""WITH w AS (SELECT event_id, (event_id % 120 + 1) * 0.5e-6 AS w, CASE WHEN user_id % 2 = 0 THEN 216.7e0 ELSE 288.2e0 END AS t FROM events)
SELECT event_id, round({2 * S.H * S.C ** 2!r} / pow(w, 5) / (exp({S.H * S.C / S.K_B!r} / (w * t)) - 1) / 1e3, 4) AS radiance, round(log10(pow(10, -22.5e0 - 24 * abs((w - 15e-6) / 15e-6))), 6) AS band FROM w""")
def black_body(spark, d):
    """Each event is a reading of one of 120 wavelengths at one of two temperatures."""
    w = (F.col("event_id") % 120 + 1) * 0.5e-6
    t = F.when(F.col("user_id") % 2 == 0, 216.7).otherwise(288.2)
    return load(spark, d, "events").select("event_id", F.round(S.planck(w, t) / 1e3, 4).alias("radiance"), F.round(F.log10(S.absorption_band(w)), 6).alias("band"))


@query("int16_quantised", "SELECT event_id, CAST(trunc(value / (SELECT max(value) FROM events) * 32767) AS SMALLINT) AS of_max, CAST(trunc(value - (SELECT avg(value) FROM events)) AS SMALLINT) AS of_mean FROM events")
def int16_quantised(spark, d):
    e = load(spark, d, "events").select("event_id", "value")
    s = e.agg(F.max("value").alias("top"), F.avg("value").alias("mean"))
    return e.crossJoin(F.broadcast(s)).select("event_id", S.to_int16(F.col("value"), F.col("top")).alias("of_max"), S.centred_int16(F.col("value"), F.col("mean")).alias("of_mean"))


@query("interpolated_knots", "SELECT event_id, round(1 + 4 * (greatest(10, least(60, value)) - 10) / 50e0, 6) AS y FROM events")
def interpolated_knots(spark, d):
    return load(spark, d, "events").select("event_id", F.round(S.between_knots(F.col("value"), 10.0, 1.0, 60.0, 5.0), 6).alias("y"))


# ---- arrays


@query("softmax_jacobian", """WITH e AS (SELECT vec_id, unnest(embedding[1:4])::DOUBLE AS x, generate_subscripts(embedding[1:4], 1) - 1 AS k FROM embeddings),
s AS (SELECT vec_id, k, exp(x) / sum(exp(x)) OVER (PARTITION BY vec_id) AS s FROM e)
SELECT a.vec_id, CAST(a.k AS INTEGER) AS i, CAST(b.k AS INTEGER) AS j, round(a.s * (CASE WHEN a.k = b.k THEN 1 ELSE 0 END - b.s), 6) AS v FROM s a JOIN s b USING (vec_id)""")
def softmax_jacobian(spark, d):
    v = F.transform(F.slice("embedding", 1, 4), lambda x: x.cast("double"))
    m = load(spark, d, "embeddings").select("vec_id", F.posexplode(V.softmax_jacobian(V.softmax(v))).alias("i", "row"))
    return m.select("vec_id", "i", F.posexplode("row").alias("j", "v")).select("vec_id", "i", "j", F.round("v", 6).alias("v"))


@query("activation_slopes", f"""WITH {_V} SELECT vec_id, round(1 / (1 + exp(-x)) * (1 - 1 / (1 + exp(-x))), 6) AS sigmoid, round(1 - tanh(x) * tanh(x), 6) AS tanh, CASE WHEN x > 0 THEN 1e0 ELSE 0e0 END AS relu,
  round(CASE WHEN x > 0 THEN 1 ELSE exp(x) END, 6) AS elu, CASE WHEN x < 0 THEN 0.02e0 ELSE 1e0 END AS prelu, round(CASE WHEN x < 0 THEN x * 0.02e0 ELSE x END, 6) AS prelu_x FROM v""")
def activation_slopes(spark, d):
    x = F.col("x")
    return _vectors(spark, d).select("vec_id", *[F.round(V.SLOPES[k](x), 6).alias(k) for k in ("sigmoid", "tanh", "relu", "elu", "prelu")], F.round(V.ACTIVATIONS["prelu"](x), 6).alias("prelu_x"))


@query("gather", "SELECT vec_id, round(embedding[label + 1]::DOUBLE, 6) AS chosen FROM embeddings")
def gather(spark, d):
    return load(spark, d, "embeddings").select("vec_id", F.round(V.gather(F.col("embedding"), F.col("label")).cast("double"), 6).alias("chosen"))


@query("masked_argmax", """WITH e AS (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS k, label FROM embeddings)
SELECT vec_id, CAST(arg_max(k, x) AS BIGINT) AS best FROM e WHERE k % 10 <> label GROUP BY vec_id""")
def masked_argmax(spark, d):
    mask = F.transform("embedding", lambda x, i: i % 10 != F.col("label"))
    return load(spark, d, "embeddings").select("vec_id", V.masked_argmax(F.col("embedding"), mask).alias("best"))


@query("last_true_index", """WITH e AS (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS k FROM embeddings)
SELECT vec_id, CAST(coalesce(max(CASE WHEN x > 0.25 THEN k END), -1) AS BIGINT) AS at FROM e GROUP BY vec_id""")
def last_true_index(spark, d):
    return load(spark, d, "embeddings").select("vec_id", V.last_true(F.transform("embedding", lambda x: x > F.lit(0.25).cast("float"))).cast("long").alias("at"))


@query("array_zip", "SELECT vec_id, CAST(k AS INTEGER) AS k, round(a, 6) AS a, round(b, 6) AS b FROM (SELECT vec_id, unnest(embedding[1:32])::DOUBLE AS a, unnest(embedding[33:64])::DOUBLE AS b, generate_subscripts(embedding[1:32], 1) - 1 AS k FROM embeddings)")
def array_zip(spark, d):
    """Two parallel lists as rows, position by position."""
    e = load(spark, d, "embeddings").select("vec_id", F.slice("embedding", 1, 32).alias("a"), F.slice("embedding", 33, 32).alias("b"))
    out = files.unzip(e, "vec_id", ["a", "b"], "k")
    return out.select("vec_id", "k", *[F.round(F.col(c).cast("double"), 6).alias(c) for c in "ab"])


@query("concat_columns", "SELECT vec_id, len(list_concat(list_concat(embedding, [label::FLOAT]), embedding)) AS n, round(list_sum(list_concat(embedding, [label::FLOAT]))::DOUBLE, 3) AS total FROM embeddings")
def concat_columns(spark, d):
    """Blocks of columns side by side."""
    e = F.col("embedding")
    wide = F.concat(e, F.array(F.col("label").cast("float")))
    return load(spark, d, "embeddings").select("vec_id", F.size(F.concat(wide, e)).cast("long").alias("n"), F.round(V.total(F.transform(wide, lambda x: x.cast("double"))), 3).alias("total"))


@query("transposed_cells", "SELECT vec_id, CAST((k - 1) % 8 AS INTEGER) AS r, CAST((k - 1) // 8 AS INTEGER) AS c, round(v, 6) AS v FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS k FROM embeddings)")
def transposed_cells(spark, d):
    """The 8 x 8 matrix of a vector, turned over its diagonal inside the row, and as cells."""
    row = lambda i: F.slice("embedding", i * 8 + 1, 8)
    columns = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda j: F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.get(row(i), j).cast("double")))
    m = load(spark, d, "embeddings").select("vec_id", F.posexplode(columns).alias("r", "line"))
    return _rounded(m.select("vec_id", "r", F.posexplode("line").alias("c", "v")), "vec_id", "r", "c")


@query("generated_episodes", """WITH t AS (SELECT n_nationkey, e, s, row_number() OVER (PARTITION BY n_nationkey ORDER BY e, s) - 1 AS t FROM nation, range(3) a(e), range(5) b(s) WHERE s < 5 - n_nationkey % 2)
SELECT n_nationkey, CAST(e AS INTEGER) AS episode, CAST(s AS INTEGER) AS step, round(1 - 0.9e0 * least(t, 9) / 9, 6) AS eps FROM t""")
def generated_episodes(spark, d):
    """A table function's rows for each row of a table."""
    load(spark, d, "nation").createOrReplaceTempView("tidewater_nation")
    return spark.sql(f"SELECT n_nationkey, episode, step, round(eps, 6) AS eps FROM tidewater_nation, LATERAL {tables.register(spark)}(CAST(n_nationkey AS INT), 3, 5, 1.0D, 0.1D, 10)")


# ---- synthetic tables


def _numbers(spark, d, name, key):
    return load(spark, d, name).select(F.col(key).alias("id"))


@query("random_points", f"SELECT i AS id, CAST(floor({_uni('i', 'px')} * 640) AS BIGINT) AS x, CAST(floor({_uni('i', 'py')} * 480) AS BIGINT) AS y FROM (SELECT o_orderkey AS i FROM orders)")
def random_points(spark, d):
    """A place for every order."""
    return synthetic.points(spark, _numbers(spark, d, "orders", "o_orderkey"), 640, 480)


@query("blobs", f"SELECT i AS id, CAST(i % 3 AS INTEGER) AS label, round([-4e0, 0e0, 5e0][i % 3 + 1] + {_nor('i', 'bx')} * 0.7e0, 6) AS x, round([1e0, -3e0, 2e0][i % 3 + 1] + {_nor('i', 'by')} * 0.7e0, 6) AS y FROM (SELECT c_custkey AS i FROM customer)")
def blobs(spark, d):
    """A point for every customer, in one of three clouds."""
    return _rounded(synthetic.blobs(spark, _numbers(spark, d, "customer", "c_custkey"), [(-4, 1), (0, -3), (5, 2)], 0.7), "id", "label")


@query("circles", f"""WITH n AS (SELECT count(*) AS n, (count(*) + 1) // 2 AS h FROM part)
SELECT i AS id, CAST(i >= h AS INTEGER) AS label, round(CASE WHEN i >= h THEN 0.5e0 * cos({2 * math.pi!r} * (i - h) / (n // 2)) ELSE cos({2 * math.pi!r} * i / h) END + {_nor('i', 'cx')} * 0.05e0, 6) AS x,
  round(CASE WHEN i >= h THEN 0.5e0 * sin({2 * math.pi!r} * (i - h) / (n // 2)) ELSE sin({2 * math.pi!r} * i / h) END + {_nor('i', 'cy')} * 0.05e0, 6) AS y FROM (SELECT p_partkey AS i FROM part), n""")
def circles(spark, d):
    """A point for every part, on one of two circles."""
    return _rounded(synthetic.circles(spark, _numbers(spark, d, "part", "p_partkey"), 0.5, 0.05), "id", "label")


@query("inline_constants", "SELECT cx, cy, round(sum(w * value), 4) AS total, count(*) AS n FROM events JOIN (VALUES (0, 0, 0, 4e0 / 9), (1, 1, 0, 1e0 / 9), (2, 0, 1, 1e0 / 9), (3, 1, 1, 1e0 / 36)) v(k, cx, cy, w) ON k = user_id % 4 GROUP BY 1, 2")
def inline_constants(spark, d):
    """A table written in the query (four directions and their weights), joined to all events."""
    v = synthetic.constants(spark, [(0, 0, 0, 4 / 9), (1, 1, 0, 1 / 9), (2, 0, 1, 1 / 9), (3, 1, 1, 1 / 36)], "k int, cx int, cy int, w double")
    e = load(spark, d, "events").join(v, (F.col("user_id") % 4) == F.col("k"))
    return e.groupBy("cx", "cy").agg(F.round(F.sum(F.col("w") * F.col("value")), 4).alias("total"), F.count("*").alias("n"))


_SCORE = "1.5e0 * x - 2e0 * y + 0.25e0"


@query("decision_surface", f"WITH p AS (SELECT CAST(floor(x * 4) AS BIGINT) AS i, CAST(floor(y * 4) AS BIGINT) AS j, {_SCORE} AS z FROM (SELECT embedding[1]::DOUBLE * 10 AS x, embedding[2]::DOUBLE * 10 AS y FROM embeddings)) SELECT i, j, round(avg(1 / (1 + exp(-z))), 6) AS p, count_if(z > -1.1e0) AS above, count(*) AS n FROM p GROUP BY 1, 2")
def decision_surface(spark, d):
    """A neuron's mean output over the cells that points fill, and how many of them its score takes over a threshold."""
    z = 1.5 * F.col("x") - 2.0 * F.col("y") + 0.25
    e = F.col("embedding")
    p = load(spark, d, "embeddings").select((e[0].cast("double") * 10).alias("x"), (e[1].cast("double") * 10).alias("y"))
    p = p.select(F.floor(F.col("x") * 4).alias("i"), F.floor(F.col("y") * 4).alias("j"), V.ACTIVATIONS["sigmoid"](z).alias("p"), (z > -1.1).alias("above"))
    return p.groupBy("i", "j").agg(F.round(F.avg("p"), 6).alias("p"), F.count_if("above").alias("above"), F.count("*").alias("n"))


@query("monte_carlo_pi", f"SELECT round(4e0 * count_if({_uni('i', 'u')} ** 2 + {_uni('i', 'v')} ** 2 < 1) / count(*), 6) AS pi FROM (SELECT event_id AS i FROM events)")
def monte_carlo_pi(spark, d):
    """A draw for every event."""
    i = F.col("id")
    u, v = S.uniform(i, "u"), S.uniform(i, "v")
    return _numbers(spark, d, "events", "event_id").agg(F.round(4.0 * F.count_if(u * u + v * v < 1) / F.count("*"), 6).alias("pi"))


# ---- rasters and spectra: a vector of 64 as an 8 x 8 raster

_CELLS = "c AS (SELECT vec_id, (k - 1) // 8 AS x, (k - 1) % 8 AS y, v FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS k FROM embeddings))"
_KERNEL = [[1.0, 0.0, -1.0], [2.0, 0.0, -2.0], [1.0, 0.0, -1.0]]


def _cells(spark, d):
    c = load(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("k", "v"))
    return c.select("vec_id", F.floor(F.col("k") / 8).cast("int").alias("x"), (F.col("k") % 8).cast("int").alias("y"), F.col("v").cast("double").alias("v"))


@query("convolution", f"""WITH {_CELLS}, k(i, j, w) AS (VALUES {', '.join(f'({i}, {j}, {w}e0)' for i, r in enumerate(_KERNEL) for j, w in enumerate(r))}),
o AS (SELECT vec_id, (x - i) // 2 AS x, (y - j) // 2 AS y, sum(v * w) AS v FROM c, k WHERE x >= i AND y >= j AND x - i <= 5 AND y - j <= 5 AND (x - i) % 2 = 0 AND (y - j) % 2 = 0 GROUP BY ALL)
SELECT vec_id, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, round(v, 5) AS v, round((v - min(v) OVER w) * 255 / (max(v) OVER w - min(v) OVER w), 3) AS stretched FROM o WINDOW w AS (PARTITION BY vec_id)""")
def convolution(spark, d):
    out = W.convolve(_cells(spark, d), _KERNEL, 8, 8, ["vec_id"], 2).withColumn("raw", F.round("v", 5))
    return W.rescaled(out, ["vec_id"]).select("vec_id", "x", "y", F.col("raw").alias("v"), F.round("v", 3).alias("stretched"))


@query("binarised_frame", f"WITH {_CELLS} SELECT vec_id, CAST((x - 1) // 2 AS INTEGER) AS x, CAST(y // 2 AS INTEGER) AS y, CAST(0.299e0 * v + 0.587e0 * v * v + 0.114e0 * abs(v) >= 0.05e0 AS INTEGER)::DOUBLE AS v FROM c WHERE x >= 1 AND x < 7 AND (x - 1) % 2 = 0 AND y % 2 = 0")
def binarised_frame(spark, d):
    v = F.col("v")
    return W.binarised(_cells(spark, d).withColumn("v", S.luma(v, v * v, F.abs(v))), 1, 7, 2, 0.05)


@query("nearest_resize", f"WITH {_CELLS} SELECT vec_id, CAST(a AS INTEGER) AS x, CAST(b AS INTEGER) AS y, round(v, 6) AS v FROM range(5) p(a), range(5) q(b) JOIN c ON c.x = a * 8 // 5 AND c.y = b * 8 // 5")
def nearest_resize(spark, d):
    return _rounded(W.resized(_cells(spark, d), 8, 8, 5, ["vec_id"]), "vec_id", "x", "y")


@query("corner_codes", f"""WITH {_CELLS}, t AS (SELECT vec_id, x, y, greatest(0, v) AS v FROM c)
SELECT a.vec_id, CAST(a.x AS INTEGER) AS x, CAST(a.y AS INTEGER) AS y, CAST(8 * ceil(least(1, a.v)) + 4 * ceil(least(1, b.v)) + 2 * ceil(least(1, c.v)) + ceil(least(1, e.v)) AS INTEGER) AS code
FROM t a JOIN t b ON b.vec_id = a.vec_id AND b.x = a.x + 1 AND b.y = a.y JOIN t c ON c.vec_id = a.vec_id AND c.x = a.x + 1 AND c.y = a.y + 1 JOIN t e ON e.vec_id = a.vec_id AND e.x = a.x AND e.y = a.y + 1""")
def corner_codes(spark, d):
    """Each cell with its neighbours to the right and below, from the array itself: no join."""
    v = F.transform("embedding", lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), x.cast("double"))))
    at = [F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), S.corner_code(*[F.get("v", F.lit((x + dx) * 8 + y + dy)) for dx, dy in ((0, 0), (1, 0), (1, 1), (0, 1))]).alias("code")) for x in range(7) for y in range(7)]
    return load(spark, d, "embeddings").select("vec_id", v.alias("v")).select("vec_id", F.inline(F.array(*at)))


@query("packed_rgb", "SELECT event_id, CAST(((user_id % 256) << 16) + ((event_id % 256) << 8) + (user_id + event_id) % 256 AS INTEGER) AS rgb FROM events")
def packed_rgb(spark, d):
    u, e = F.col("user_id"), F.col("event_id")
    return load(spark, d, "events").select("event_id", S.packed_rgb(u % 256, e % 256, (u + e) % 256).alias("rgb"))


@query("vector_spectrum", """WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS n FROM embeddings)
SELECT vec_id, CAST(k AS INTEGER) AS k, round(pow(sum(x * cos(2 * pi() * k * n / 64)), 2) + pow(sum(x * sin(2 * pi() * k * n / 64)), 2), 4) AS power FROM e, range(33) r(k) GROUP BY ALL""")
def vector_spectrum(spark, d):
    out = load(spark, d, "embeddings").select("vec_id", F.posexplode(V.power_spectrum(F.col("embedding"), 64)).alias("k", "power"))
    return out.select("vec_id", "k", F.round("power", 4).alias("power"))


@query("series_spectrum", """WITH d AS (SELECT event_type, date_diff('day', DATE '2020-01-01', CAST(ts AS DATE)) AS day, avg(value) AS v FROM events GROUP BY ALL),
s AS (SELECT event_type, v / sqrt(sum(v * v) OVER (PARTITION BY event_type)) AS x, row_number() OVER (PARTITION BY event_type ORDER BY day) - 1 AS n, count(*) OVER (PARTITION BY event_type) AS c FROM d)
SELECT event_type, k, round(k / c::DOUBLE, 6) AS frequency, round(pow(sum(x * cos(2 * pi() * k * n / c)), 2) + pow(sum(x * sin(2 * pi() * k * n / c)), 2), 6) AS power FROM s, range(400) r(k) WHERE k <= c // 2 GROUP BY event_type, k, c""")
def series_spectrum(spark, d):
    e = load(spark, d, "events").groupBy("event_type", F.datediff(F.col("ts").cast("date"), F.lit("2020-01-01").cast("date")).alias("day")).agg(F.avg("value").alias("v"))
    return _rounded(W.spectrum(e, "event_type", ["day"], "v", 1.0), "event_type", "k")


# ---- nested answers


@query("inline_series", "SELECT event_type AS tag, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS at, round(value, 4) AS value FROM events")
def inline_series(spark, d):
    """Events packed as a historian answers, and unpacked again."""
    at = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    e = load(spark, d, "events").select("event_type", "user_id", F.struct(at.alias("timestamp"), "value").alias("v"))
    # A body holds a tag's readings of an hour, as answers do, so that none grows with a tag's rows.
    bodies = e.groupBy("event_type", "user_id", F.substring("v.timestamp", 1, 13)).agg(F.to_json(F.struct(F.array(F.collect_list("v")).alias("values"))).alias("body"))
    out = rest.inline_series(bodies, "event_type", "body")
    return out.select(F.col("event_type").alias("tag"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("at"), F.round("value", 4).alias("value"))


@query("flatten_records", "SELECT c_custkey AS id, c_mktsegment AS info_segment, c_nationkey AS info_nation FROM customer")
def flatten_records(spark, d):
    rec = F.struct(F.col("c_custkey").alias("id"), F.struct(F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation")).alias("info"))
    bodies = load(spark, d, "customer").groupBy(F.floor(F.col("c_custkey") / 50)).agg(F.to_json(F.struct(F.collect_list(rec).alias("data"))).alias("body"))
    nation = load(spark, d, "customer").schema["c_nationkey"].dataType.simpleString()
    key = load(spark, d, "customer").schema["c_custkey"].dataType.simpleString()
    return rest.flatten_data(bodies, "body", f"id:{key},info:struct<segment:string,nation:{nation}>")


@query("pick_level", "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS date, round(max(CASE WHEN event_type = 'view' THEN value END), 4) AS view, round(max(CASE WHEN event_type = 'click' THEN value END), 4) AS click FROM events GROUP BY 1")
def pick_level(spark, d):
    """One field of a long table with two levels of names, a column a ticker."""
    q = load(spark, d, "events").groupBy(F.col("ts").cast("date").cast("string").alias("date"), F.col("event_type").alias("ticker")).agg(F.max("value").alias("High"), F.min("value").alias("Low"))
    q = q.unpivot(["date", "ticker"], ["High", "Low"], "field", "value")
    return _rounded(rest.pick_level(q, "High", ["view", "click"]), "date", digits=4)


@query("nested_weights", "SELECT vec_id, CAST(0 AS INTEGER) AS layer, CAST((k - 1) // 8 AS INTEGER) AS i, CAST((k - 1) % 8 AS INTEGER) AS j, round(w, 6) AS w FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS w, generate_subscripts(embedding, 1) AS k FROM embeddings)")
def nested_weights(spark, d):
    """Weights as nested lists in JSON, and as rows again."""
    rows = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.transform(F.slice("embedding", i * 8 + 1, 8), lambda x: x.cast("double")))
    text = load(spark, d, "embeddings").select("vec_id", F.to_json(F.array(rows)).alias("value"))
    return _rounded(files.explode_layers(text, "vec_id", F.from_json("value", "array<array<array<double>>>")), "vec_id", "layer", "i", "j")


@query("json_rows", "SELECT o_orderkey, to_json({'o_orderkey': o_orderkey, 'o_orderstatus': o_orderstatus, 'prio': [o_orderpriority]}) AS line FROM orders")
def json_rows(spark, d):
    o = load(spark, d, "orders").withColumn("prio", F.array("o_orderpriority"))
    return o.select("o_orderkey", files.as_json("o_orderkey", "o_orderstatus", "prio").alias("line"))


@query("metric_rows", "SELECT step, metric, round(value, 4) AS value FROM (SELECT event_id AS step, value AS loss, value * 2 AS reward FROM events) UNPIVOT (value FOR metric IN (loss, reward))")
def metric_rows(spark, d):
    e = load(spark, d, "events").select(F.col("event_id").alias("step"), F.col("value").alias("loss"), (F.col("value") * 2).alias("reward"))
    return files.melt_metrics(e, "step", ["loss", "reward"]).select("step", "metric", F.round("value", 4).alias("value"))


@query("save_best", """SELECT user_id, event_id, value FROM (SELECT *, min(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM events)
WHERE value IS NOT NULL AND (b IS NULL OR value < b)""")
def save_best(spark, d):
    return files.best_so_far(load(spark, d, "events").select("user_id", "event_id", "value"), ["user_id"], "event_id", "value")


@query("long_spectrum", """WITH s AS (SELECT p_retailprice::DOUBLE - (SELECT avg(p_retailprice) FROM part) AS v, row_number() OVER (ORDER BY p_partkey) - 1 AS i FROM part), n AS (SELECT count(*) // 50 * 50 AS n FROM part),
k AS (SELECT unnest(range(1, 25)) AS k)
SELECT k, round(sum(v * cos(2 * pi() * k * i / n)), 3) AS re, round(-sum(v * sin(2 * pi() * k * i / n)), 3) AS im FROM s, n, k WHERE i < n GROUP BY k""")
def long_spectrum(spark, d):
    """The low end of the spectrum of all parts' prices in order, a series in parts (its length a multiple of 50)."""
    p = load(spark, d, "part").select("p_partkey", F.col("p_retailprice").cast("double").alias("v"))
    n = p.count() // 50 * 50
    mean = p.agg(F.avg("v")).first()[0]
    s = O.numbered(p, [], ["p_partkey"]).where(F.col("rn") <= n).select((F.col("rn") - 1).alias("i"), (F.col("v") - mean).alias("v"))
    out = W.long_spectrum(s, "i", "v", n)
    return out.where("k BETWEEN 1 AND 24").select("k", F.round("re", 3).alias("re"), F.round("im", 3).alias("im"))


# ---- tables written in a file's form and read again


@query("csv_round_trip", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def csv_round_trip(spark, d):
    c = load(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    path = new_path(spark, "csv")
    c.write.csv(path, header=True)
    return files.csv(spark, path, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in c.schema))


@query("game_log_round_trip", """SELECT row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id) - 1 AS game, round(value, 4) AS score, user_id AS cycles, event_id AS play_ms, event_id * 2 AS train_ms FROM events""")
def game_log_round_trip(spark, d):
    """A log a day, each a document of one list a measure, read again as a row a game."""
    e = load(spark, d, "events").select(F.to_date("ts").alias("day"), F.struct("ts", "event_id", "value", "user_id").alias("r"))
    logs = e.groupBy("day").agg(F.array_sort(F.collect_list("r")).alias("r"))
    of = lambda name, kind: F.transform("r", lambda x: x[name].cast(kind))
    elapse = F.transform("r", lambda x: F.array(x["event_id"].cast("long"), (x["event_id"] * 2).cast("long")))
    path = new_path(spark, "logs")
    logs.select("day", of("value", "double").alias("score"), of("user_id", "int").alias("cycles"), elapse.alias("elapse")).write.partitionBy("day").json(path)
    g = files.game_log(spark, path)
    return g.select(F.col("game").cast("long").alias("game"), F.round("score", 4).alias("score"), F.col("cycles").cast("long").alias("cycles"), "play_ms", "train_ms")
