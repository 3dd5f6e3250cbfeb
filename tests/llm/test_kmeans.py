"""Exact k-means with block-norm screening: against brute force, bounds, edge cases."""

import hashlib
import random

import numpy as np

from tests.compare import SF
from tidewater.llm import kmeans

INF, NAN = float("inf"), float("nan")


def brute(rows, k=16, rounds=3, dim=64, scale=64):
    """{id: (cluster, distance)}, centroids; in plain integers."""
    q = [(i, [int(np.floor(scale * float(x))) if abs(x) < 2**40 else int(x) * scale for x in v]) for i, v in rows]
    seeds = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in q if i is not None)[:k]
    c = [v for _, v in seeds]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, m, strict=True)), j) for j, m in enumerate(c)) for _, v in q]

    for _ in range(rounds):
        got = assign()
        for j in range(len(c)):
            own = [v for (_, v), (_, a) in zip(q, got, strict=True) if a == j]
            if own:
                c[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    return [(i, a, d) for (i, _), (d, a) in zip(q, assign(), strict=True)], c


def frame(spark, rows, kind="float"):
    return spark.createDataFrame([(i, v, "x", 1) for i, v in rows], f"vec_id long, embedding array<{kind}>, cluster string, __h int")


def test_whole_table_by_brute_force(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    want, centroids = brute(rows)
    got, model = kmeans.cluster(frame(spark, rows))
    assert sorted((r.vec_id, r.cluster, r.distance) for r in got.collect()) == sorted(want)
    assert model.centroids == centroids and sum(model.inertia) == sum(d for _, _, d in want)


def test_rows_that_are_left_out_or_repeated(spark):
    r = random.Random(1)
    v = lambda: [r.uniform(-1, 1) for _ in range(64)]
    hot = v()
    good = [(i, v()) for i in range(30)] + [(40, hot)] * 50 + [(None, v()), (None, hot)]
    bad = [(90, None), (91, []), (92, v()[:63]), (93, [*v(), 0.0]), (94, [None, *v()[1:]]), (95, [NAN, *v()[1:]]), (96, [-INF, *v()[1:]]), (None, None)]
    got = kmeans.with_clusters(frame(spark, good + bad, "double"))
    assert got.columns == ["vec_id", "__h", *kmeans.NEW]
    rows = got.collect()
    want, centroids = brute(good)
    key = lambda t: tuple(-1 if x is None else x for x in t)
    assert sorted(((x.vec_id, x.cluster, x.distance) for x in rows), key=key) == sorted(want, key=key)
    assert {x.inertia for x in rows} == {sum(d for _, _, d in want)}
    for x in rows:
        assert x.cluster_inertia == sum(d for _, a, d in want if a == x.cluster)
        assert x.centroid_sha256 == hashlib.sha256(",".join(map(str, centroids[x.cluster])).encode()).hexdigest()


def test_few_rows_and_none(spark):
    none = kmeans.with_clusters(frame(spark, []))
    assert none.columns == ["vec_id", "__h", *kmeans.NEW] and none.count() == 0
    assert kmeans.with_clusters(frame(spark, [(None, [0.5] * 64)])).count() == 0
    assert [(r.cluster, r.distance, r.inertia) for r in kmeans.with_clusters(frame(spark, [(7, [0.5] * 64)])).collect()] == [(0, 0, 0)]


def test_tied_centroids_go_to_the_smaller_number(spark):
    rows = [(i, [1.0] * 64) for i in range(20)]
    assert {r.cluster for r in kmeans.with_clusters(frame(spark, rows)).collect()} == {0}


def test_numbers_beyond_a_long(spark):
    rows = [(i, [float(i)] * 64) for i in range(17)] + [(50, [1e300] + [0.0] * 63), (51, [3e8] * 64), (52, [-2e6] * 64)]
    want, centroids = brute(rows)
    got, model = kmeans.cluster(frame(spark, rows, "double"))
    assert model.centroids == centroids
    assert {r.vec_id: (r.cluster, r.distance) for r in got.collect()} == {i: (a, d if d < 1 << 63 else None) for i, a, d in want}


def test_bounds_screen_and_lose_nothing():
    r = np.random.default_rng(5)
    for spread in (1, 40, 10**6):
        centres = r.integers(-spread, spread + 1, (16, 64))
        v = np.concatenate([centres[r.integers(0, 16, 500)] + r.integers(-2, 3, (500, 64)), r.integers(-spread, spread + 1, (500, 64)) * r.integers(0, 2, (500, 64))])
        screen = kmeans.Screen(centres.tolist())
        cluster, best = screen.nearest(v, np.add.reduceat(v * v, np.arange(0, 64, kmeans.BLOCK), axis=1))
        full = ((v[:, None, :] - centres[None]) ** 2).sum(axis=2)
        assert (cluster == full.argmin(axis=1)).all() and (best == full.min(axis=1)).all()
    # Vectors near their centroid leave few others to measure.
    assert screen.measured < 0.8 * 16 * screen.seen
