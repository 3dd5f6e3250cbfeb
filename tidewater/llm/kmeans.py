"""Exact k-means on whole numbers with block-norm screening.

A vector's components become integers, floor(scale * x).  Its compressed form, worked out once and
written beside it, is the squared norm of each segment of ``BLOCK`` components.  For a segment b of a vector
v and a centroid c the Cauchy-Schwarz inequality gives v_b . c_b <= |v_b| |c_b|, so that

    |v - c|^2 >= sum over b of (|v_b| - |c_b|)^2

and a whole batch gets the bounds of all centroids from one small matrix product of norms.  The centroid
of the least bound is measured first, exactly; the others only where their bound is not above the best
distance found.  The bound is lowered by more than rounding can raise it, so no nearest centroid is ever
missed, and every distance and every mean is worked out in whole numbers.

Spread over a cluster: a round is one pass of the written table without a shuffle of vectors; each task
gives one sum a cluster and component, Spark adds them up, and k * dim sums reach the driver.  Centroids go
to the tasks as k * dim numbers.  A cluster or a repeated vector of any size only makes its sum larger.

Defined results: only rows whose vector has exactly ``dim`` components, none null, NaN or infinite, are
kept.  Seeds are the k kept rows with the least sha256 of ``1:<id>`` (ties: least vector); rows with a
null id are clustered but never seeds; of fewer rows with an id than k all are seeds.  With no seed
nothing is returned.  Repeated rows each count.  Components so large that squared distances outgrow a long
(beyond 2^27.5 after scaling, for 64) take a slower path of unbounded integers; a distance or inertia beyond a long is null.  Other columns
pass through, but those named like the new ones, which are replaced.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.llm.shared import col, columns, map_arrow, scratch, table

BLOCK = 4
_MOST = (1 << 63) - 1
NEW = ["cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def _wide(dim: int) -> int:
    """Up to here the squared distance of two vectors fits into a long."""
    return math.isqrt((1 << 61) // dim)


@dataclass
class Clustering:
    """Centroids of whole numbers; the distance sums of the clusters, once the rows are assigned."""

    centroids: list[list[int]]
    inertia: list[int] = field(default_factory=list)

    def sha256(self) -> list[str]:
        return [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in self.centroids]


def _usable(vector: Column, dim: int) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return vector.isNotNull() & (F.size(vector) == dim) & finite


def _whole(flat: np.ndarray, scale: int, most: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = np.floor(flat * scale)
    if not len(x) or np.abs(x).max() <= most:
        return x.astype(np.int64)
    # Doubles from 2^53 on are whole, whatever they are multiplied with.
    return np.array([math.floor(v * scale) if abs(v) < 2.0**53 else int(v) * scale for v in flat.tolist()], object)


def compress(vectors: DataFrame, dim: int = 64, scale: int = 64, vector_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """The usable rows, with their whole-number components ``q`` and segment norms ``norms``; both null if the
    distances could outgrow a long, ``wide`` then has the components as text."""
    src = vectors.where(_usable(col(vector_col), dim)).withColumn(vector_col, col(vector_col).cast("array<double>"))
    # The vector stays as it came where it is wanted; here it is only read.
    names = src.columns
    at = names.index(vector_col)
    schema = T.StructType([f for f in src.schema if f.name != vector_col] + [T.StructField("__q", T.ArrayType(T.IntegerType())), T.StructField("__norms", T.ArrayType(T.LongType())), T.StructField("__wide", T.ArrayType(T.StringType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            flat = b.column(at).flatten().to_numpy(zero_copy_only=False)
            q = _whole(flat, scale, _wide(dim)).reshape(b.num_rows, dim)
            fits = (np.abs(q).max(axis=1) <= _wide(dim)).astype(bool)
            wide = [None if f else list(map(str, r)) for f, r in zip(fits, q, strict=True)] if not fits.all() else pa.nulls(b.num_rows, pa.list_(pa.string()))
            small = np.where(fits[:, None], q, 0).astype(np.int64)
            norms = np.add.reduceat(small * small, np.arange(0, dim, block), axis=1)
            arrays = [b.column(i) for i in range(len(names)) if i != at]
            arrays += [_lists(small.astype(np.int32), ~fits), _lists(norms, ~fits), wide if isinstance(wide, pa.Array) else pa.array(wide, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return map_arrow(src, run, schema)


def _lists(m: np.ndarray, null: np.ndarray) -> pa.Array:
    n, w = m.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * w, pa.int32()), pa.array(m.ravel()), mask=pa.array(null) if null.any() else None)


class Screen:
    """The centroids with their segment norms, ready to give each vector of a batch its nearest one."""

    def __init__(self, centroids: list[list[int]], block: int = BLOCK):
        self.exact = centroids
        big = max(abs(x) for c in centroids for x in c)
        self.whole = np.array(centroids, np.int64 if big <= _wide(len(centroids[0])) else object)
        #: Numbers beyond these have no bounds in doubles.
        self.bounded = big < 1 << 400
        floats = self.whole.astype(float) if self.bounded else np.zeros(self.whole.shape)
        self.norms = np.sqrt(np.add.reduceat(floats * floats, np.arange(0, floats.shape[1], block), axis=1))
        self.square = (self.norms**2).sum(axis=1)
        #: Vectors seen, and exact distances worked out for them.
        self.seen = self.measured = 0

    def nearest(self, q: np.ndarray, norms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cluster, squared distance) for vectors q (n x dim) with squared segment norms (n x segments)."""
        n = len(q)
        if not self.bounded:
            got = [self.nearest_wide(v) for v in q.tolist()]
            return np.array([j for j, _ in got]), np.array([d for _, d in got], object)
        square = norms.sum(axis=1).astype(float)
        scale = square[:, None] + self.square[None, :]
        # sum of (|v_b| - |c_b|)^2, less than rounding may have added
        bound = scale - 2 * (np.sqrt(norms) @ self.norms.T) - 1e-9 * scale - 1e-6
        best = np.zeros(n, self.whole.dtype)
        cluster = np.zeros(n, np.int32)
        first = bound.argmin(axis=1)
        self.seen += n

        def measure(rows: np.ndarray, j: int) -> np.ndarray:
            away = q[rows] - self.whole[j]
            self.measured += len(rows)
            return (away * away).sum(axis=1)

        for j in range(len(self.exact)):
            rows = np.flatnonzero(first == j)
            cluster[rows], best[rows] = j, measure(rows, j)
        for j in range(len(self.exact)):
            rows = np.flatnonzero((bound[:, j] <= best) & (first != j))
            d = measure(rows, j)
            better = ((d < best[rows]) | ((d == best[rows]) & (j < cluster[rows]))).astype(bool)
            cluster[rows[better]], best[rows[better]] = j, d[better]
        return cluster, best

    def nearest_wide(self, v: list[int]) -> tuple[int, int]:
        d = [sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in self.exact]
        return (j := d.index(min(d))), d[j]


def _assigned(b: pa.RecordBatch, screen: Screen, q: int) -> tuple[np.ndarray, list, np.ndarray, list]:
    """(cluster, distance, the rows' components, rows of wide components) of a batch; columns q, norms, wide at q, q + 1, q + 2."""
    dim = len(screen.exact[0])
    n = b.num_rows
    null = b.column(q).is_null().to_numpy(zero_copy_only=False)
    at = np.flatnonzero(~null)
    v = b.column(q).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.int64)
    norms = b.column(q + 1).flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1)
    cluster, distance = np.zeros(n, np.int32), np.zeros(n, object)
    cluster[at], distance[at] = screen.nearest(v, norms) if len(v) else (0, 0)
    wide = []
    if null.any():
        for i in np.flatnonzero(null):
            row = list(map(int, b.column(q + 2)[int(i)].as_py()))
            wide.append((i, row))
            cluster[i], distance[i] = screen.nearest_wide(row)
    return cluster, distance, v, wide


def _round(rows: DataFrame, model: Clustering, block: int) -> Clustering:
    """Assign, then move every centroid that has vectors to the floor of their mean."""
    k, dim = len(model.centroids), len(model.centroids[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        screen = Screen(model.centroids, block)
        sums, count = [[0] * dim for _ in range(k)], [0] * k
        for b in batches:
            if not b.num_rows:
                continue
            cluster, _, v, wide = _assigned(b, screen, 0)
            narrow = np.delete(cluster, [i for i, _ in wide])
            for j in np.unique(cluster):
                count[j] += int((cluster == j).sum())
                # A batch's sum fits into a long; the task's is a Python integer.
                sums[j] = [a + int(s) for a, s in zip(sums[j], v[narrow == j].sum(axis=0), strict=True)]
            for i, row in wide:
                sums[cluster[i]] = [a + s for a, s in zip(sums[cluster[i]], row, strict=True)]
        got = [(j, d, count[j], sums[j][d]) for j in range(k) if count[j] for d in range(dim)]
        # High and low part: sums of any number of tasks stay exact.
        parts = [[g[0] for g in got], [g[1] for g in got], [g[2] for g in got], [str(g[3] >> 40) for g in got], [g[3] & ((1 << 40) - 1) for g in got]]
        yield pa.RecordBatch.from_arrays([pa.array(p, t) for p, t in zip(parts, (pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.int64()), strict=True)], names=["j", "d", "n", "hi", "lo"])

    parts = map_arrow(rows.select("__q", "__norms", "__wide"), run, "j int, d int, n long, hi string, lo long")
    total = parts.groupBy("j", "d").agg(F.sum("n").alias("n"), F.sum(F.expr("try_cast(hi AS decimal(38,0))")).alias("hi"), F.sum(F.col("lo").cast("decimal(38,0)")).alias("lo"), F.collect_list(F.when(F.expr("try_cast(hi AS decimal(38,0))").isNull(), F.col("hi"))).alias("far"))
    new = [list(c) for c in model.centroids]
    for r in total.collect():
        new[r.j][r.d] = (((int(r.hi or 0) + sum(map(int, r.far))) << 40) + int(r.lo)) // r.n
    return Clustering(new)


def _seeds(rows: DataFrame, k: int, id_col: str) -> list[list[int]]:
    h = F.sha2(F.concat(F.lit("1:"), col(id_col).cast("string")), 256)
    cands = rows.where(col(id_col).isNotNull()).select(h.alias("h"), "__q", "__wide").orderBy("h", "__q", "__wide").limit(k)
    return [list(r["__q"]) if r["__q"] is not None else list(map(int, r["__wide"])) for r in cands.collect()]


def cluster(
    vectors: DataFrame, k: int = 16, rounds: int = 3, dim: int = 64, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK,
) -> tuple[DataFrame, Clustering]:
    """The usable rows without their vector, with cluster and squared distance, and the clustering."""
    src = vectors.select(*columns(vectors, *NEW))
    with scratch() as keep:
        rows = table(compress(src, dim, scale, vector_col, block), "vectors")
        model = Clustering(_seeds(rows, k, id_col))
        names = [c for c in rows.columns if c not in ("__q", "__norms", "__wide")]
        schema = T.StructType([rows.schema[c] for c in names] + [T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType()), T.StructField("__far", T.StringType())])
        if not model.centroids:
            return vectors.sparkSession.createDataFrame([], T.StructType(schema[:-1])), model
        for _ in range(rounds):
            model = _round(rows, model, block)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            screen = Screen(model.centroids, block)
            for b in batches:
                if not b.num_rows:
                    continue
                j, d, _, _ = _assigned(b, screen, len(names))
                fit = [int(x) if x <= _MOST else None for x in d]
                far = [None if x <= _MOST else str(x) for x in d]
                yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(j, pa.int32()), pa.array(fit, pa.int64()), pa.array(far, pa.string())], names=schema.names)

        out = keep(table(map_arrow(rows.select(*[col(c) for c in names], "__q", "__norms", "__wide"), run, schema), "clusters"))
    # Whole sums of numbers up to 2^63: a decimal holds those of 10^19 rows.
    sums = out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"), F.count("__far").alias("far")).collect()
    model.inertia = [0] * len(model.centroids)
    for r in sums:
        model.inertia[r.cluster] = int(r.s or 0) if not r.far else _MOST + 1
    return out.drop("__far"), model


def _per_cluster(values: list, kind: str) -> Column:
    return F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("cluster") + 1)


def with_clusters(vectors: DataFrame, **how) -> DataFrame:
    """``cluster`` with the sums of the distances and the digest of the centroid in each row."""
    rows, model = cluster(vectors, **how)
    fit = [x if x <= _MOST else None for x in model.inertia] or [None]
    total = None if None in fit or sum(fit) > _MOST else sum(fit)
    return rows.withColumns({
        "cluster_inertia": _per_cluster(fit, "long"), "inertia": F.lit(total).cast("long"),
        "centroid_sha256": _per_cluster(model.sha256() or [None], "string"),
    })


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return with_clusters(vectors).select("vec_id", *NEW)


def _sql() -> str:
    step = """
d{r} AS (
  SELECT v.id, v.q, c.j, list_sum(list_transform(list_zip(v.q, c.c), lambda x: (x[1] - x[2]) * (x[1] - x[2]))) AS d FROM v, c{r} c),
a{r} AS (SELECT id, q, arg_min(j, {{'d': d, 'j': j}}) AS j, min(d) AS d FROM d{r} GROUP BY id, q),"""
    move = """
s{r} AS (SELECT j, i, sum(q[i]) AS s, count(*) AS n FROM (SELECT j, q, unnest(range(1, 65)) AS i FROM a{p}) GROUP BY j, i),
m{r} AS (SELECT j, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c FROM s{r} GROUP BY j),
c{r} AS (SELECT c.j, coalesce(m.c, c.c) AS c FROM c{p} c LEFT JOIN m{r} m ON m.j = c.j),"""
    body = step.format(r=0) + "".join(move.format(r=r, p=r - 1) + step.format(r=r) for r in (1, 2, 3))
    return f"""
WITH v AS (
  SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS (SELECT row_number() OVER (ORDER BY h) - 1 AS j, q AS c FROM (SELECT sha256('1:' || id) AS h, q FROM v WHERE id IS NOT NULL ORDER BY h LIMIT 16)),{body}
t AS (SELECT j, sum(d) AS ci FROM a3 GROUP BY j)
SELECT a.id AS vec_id, CAST(a.j AS INTEGER) AS cluster, CAST(a.d AS BIGINT) AS distance, CAST(t.ci AS BIGINT) AS cluster_inertia,
  CAST((SELECT sum(ci) FROM t) AS BIGINT) AS inertia, sha256(array_to_string(c.c, ',')) AS centroid_sha256
FROM a3 a JOIN t ON t.j = a.j JOIN c3 c ON c.j = a.j
"""


OP11_SQL = _sql()
