"""A transform in parts against one of the whole series."""

import cmath
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.operators import signal as W


@pytest.mark.parametrize("n,most", [(6000, 100), (4096, 64), (1, 1), (97, 97), (1000, 1000)])
def test_long_spectrum(spark, n, most):
    x = np.random.default_rng(n).normal(size=n)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i long, v double").repartition(5)
    got = {r.k: complex(r.re, r.im) for r in W.long_spectrum(df, "i", "v", n, most).collect()}
    want = np.fft.fft(x)
    assert len(got) == n and max(abs(got[k] - want[k]) for k in range(n)) < 1e-9


def test_what_cannot_be_cut(spark):
    df = spark.range(97).select("id", F.lit(1.0).alias("v"))
    with pytest.raises(ValueError):
        W.long_spectrum(df, "id", "v", 97, 20)
    with pytest.raises(Exception, match="gaps"):
        W.long_spectrum(df.where("id <> 5").unionByName(df.where("id = 9")), "id", "v", 96).collect()


def test_power_spectrum_of_short_arrays(spark):
    """Against the sums; nulls in an array, arrays of other lengths, none; and no loop over elements in the plan."""
    from tidewater.functions import vectors as V

    arrays = [[1.0, 2.0, -1.0, 0.5], [1.0, None, 3.0], [None, None], [], None, [2.0], [0.0, 1.0, 2.0, 3.0, 4.0, 5.0]]
    df = spark.createDataFrame(list(enumerate(arrays)), "i int, v array<float>").repartition(2)
    for n in (None, 4):
        out = df.select("i", F.posexplode(V.power_spectrum(F.col("v"), n)).alias("k", "p"))
        want = {}
        for i, v in enumerate(arrays):
            m = n or len(v or [])
            for k in range(m // 2 + 1 if v else 0):
                z = [x * cmath.exp(-2j * math.pi * k * j / m) for j, x in enumerate(v) if x is not None]
                want[i, k] = abs(sum(z)) ** 2 if z else None
        got = {(r.i, r.k): r.p for r in out.collect()}
        assert got.keys() == want.keys()
        assert all(got[x] == y if y is None else abs(got[x] - y) < 1e-9 for x, y in want.items())
    assert "lambda" not in out._jdf.queryExecution().optimizedPlan().toString()
