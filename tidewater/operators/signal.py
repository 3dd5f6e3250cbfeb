"""Spectra of series and convolutions of rasters."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def spectrum(df: DataFrame, by: str, order: list[str], x: str, rate: float) -> DataFrame:
    """(by, k, frequency, power): the real Fourier transform of each series, scaled to length 1 first.

    A series is one group and must fit a task (8 bytes a value while it is transformed); the series are spread."""

    def one(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        v = part.sort_values(order)[x].to_numpy(float)
        v = v / (np.linalg.norm(v) or 1.0)
        y = np.fft.rfft(v)
        return pd.DataFrame({by: key[0], "k": np.arange(len(y)), "frequency": np.fft.rfftfreq(len(v), 1 / rate), "power": np.abs(y) ** 2})

    kind = df.schema[by].dataType.simpleString()
    return df.select(by, *order, x).groupBy(by).applyInPandas(one, f"{by} {kind}, k long, frequency double, power double")


def convolve(cells: DataFrame, kernel: list[list[float]], height: int, width: int, by: list[str], stride: int = 1) -> DataFrame:
    """(by, x, y, v): the valid cross-correlation of rasters (by, x, y, v) with a kernel, every ``stride`` cells.

    Every cell is sent to the outputs that it is part of, and these are sums: one shuffle, with partial sums before it."""
    parts = [F.struct(F.lit(i).alias("__i"), F.lit(j).alias("__j"), F.lit(float(k)).alias("__k")) for i, row in enumerate(kernel) for j, k in enumerate(row) if k]
    long = cells.select(*by, "x", "y", "v", F.inline(F.array(*parts)))
    ox, oy = F.col("x") - F.col("__i"), F.col("y") - F.col("__j")
    inside = (ox >= 0) & (oy >= 0) & (ox <= height - len(kernel)) & (oy <= width - len(kernel[0])) & (ox % stride == 0) & (oy % stride == 0)
    out = long.where(inside).select(*by, (ox / stride).cast("int").alias("x"), (oy / stride).cast("int").alias("y"), (F.col("v") * F.col("__k")).alias("v"))
    return out.groupBy(*by, "x", "y").agg(F.sum("v").alias("v"))


def rescaled(cells: DataFrame, by: list[str], top: float = 255.0) -> DataFrame:
    """The values of each raster stretched to 0..top; a flat raster becomes 0."""
    w = Window.partitionBy(*by)
    lo, hi = F.min("v").over(w), F.max("v").over(w)
    return cells.withColumn("v", F.coalesce(F.try_divide((F.col("v") - lo) * top, hi - lo), F.lit(0.0)))


def binarised(pixels: DataFrame, top: int, bottom: int, step: int, least: float) -> DataFrame:
    """Rows (..., x, y, v) of a raster from row ``top`` to ``bottom``, every ``step`` cells, as 0 or 1 by a threshold."""
    keep = (F.col("x") >= top) & (F.col("x") < bottom) & ((F.col("x") - top) % step == 0) & (F.col("y") % step == 0)
    out = pixels.where(keep).withColumns({"x": ((F.col("x") - top) / step).cast("int"), "y": (F.col("y") / step).cast("int")})
    return out.withColumn("v", (F.col("v") >= least).cast("double"))


def resized(pixels: DataFrame, height: int, width: int, to: int, by: list[str]) -> DataFrame:
    """Nearest-neighbour resize to ``to`` x ``to``: each target cell takes the source cell that its corner falls on."""
    grid = pixels.sparkSession.range(to * to).select(F.floor(F.col("id") / to).cast("int").alias("tx"), (F.col("id") % to).cast("int").alias("ty"))
    grid = grid.withColumns({"x": F.floor(F.col("tx") * height / to).cast("int"), "y": F.floor(F.col("ty") * width / to).cast("int")})
    # The grid has to^2 rows, whatever the data.
    return pixels.join(F.broadcast(grid), ["x", "y"]).select(*by, F.col("tx").alias("x"), F.col("ty").alias("y"), "v")


#: Values of one part of a series that is transformed in parts, at most.
PART = 1 << 20


def _factors(n: int, most: int) -> tuple[int, int]:
    """The two factors of n that are nearest to its root."""
    for r in range(math.isqrt(n), 0, -1):
        if n % r == 0:
            if n // r > most:
                break
            return r, n // r
    raise ValueError(f"a series of {n} values can't be cut into parts of {most} at most: leave some off, or pad it with zeros")


def long_spectrum(df: DataFrame, at: str, x: str, n: int, most: int = PART) -> DataFrame:
    """(k, re, im): the Fourier transform of one series of n values (``at`` 0 to n - 1, each once), spread over tasks.

    With n = r * c it is taken in four steps: transforms of the c columns (every c-th value), each value turned by
    its twiddle factor, transforms of the r rows.  A task holds a part of about the root of n; the values are shuffled twice."""
    r, c = _factors(n, most)

    def transform(part: pd.DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
        part = part.sort_values("i")
        if len(part) != size:
            raise ValueError("the series has gaps or repeated places")
        return part["i"].to_numpy(), np.fft.fft(part["re"].to_numpy() + 1j * part["im"].to_numpy())

    def columns(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        _, y = transform(part, r)
        k = np.arange(r)
        y = y * np.exp(-2j * np.pi * (key[0] * k % n) / n)
        return pd.DataFrame({"row": k, "i": np.full(r, key[0]), "re": y.real, "im": y.imag})

    def rows(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        _, y = transform(part, c)
        return pd.DataFrame({"k": key[0] + r * np.arange(c), "re": y.real, "im": y.imag})

    src = df.select((F.col(at) % c).cast("long").alias("col"), F.expr(f"`{at}` div {c}").cast("long").alias("i"), F.col(x).cast("double").alias("re"), F.lit(0.0).alias("im"))
    turned = src.groupBy("col").applyInPandas(columns, "row long, i long, re double, im double")
    return turned.groupBy("row").applyInPandas(rows, "k long, re double, im double")
