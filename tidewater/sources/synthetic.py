"""Repeatable synthetic tables: every value follows from the row's number, whatever the partitions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions import scalars as S


def _ids(spark: SparkSession, n: int | DataFrame) -> DataFrame:
    """Row numbers: 0 to n - 1, or those of a table (its column id)."""
    return spark.range(n) if isinstance(n, int) else n.select("id")


def points(spark: SparkSession, n: int | DataFrame, width: float, height: float, salt: str = "p") -> DataFrame:
    """(id, x, y): whole coordinates, evenly over a rectangle."""
    i = F.col("id")
    return _ids(spark, n).select("id", F.floor(S.uniform(i, salt + "x") * width).alias("x"), F.floor(S.uniform(i, salt + "y") * height).alias("y"))


def blobs(spark: SparkSession, n: int | DataFrame, centres: Sequence[tuple[float, float]], sd: float = 1.0, salt: str = "b") -> DataFrame:
    """(id, label, x, y): normal clouds around the centres, in turn."""
    i = F.col("id")
    label = (i % len(centres)).cast("int")
    at = [F.get(F.array(*[F.lit(float(c[k])) for c in centres]), label) for k in (0, 1)]
    return _ids(spark, n).select("id", label.alias("label"), *[(c + S.normal(i, salt + k) * sd).alias(k) for c, k in zip(at, "xy", strict=True)])


def circles(spark: SparkSession, n: int | DataFrame, factor: float = 0.8, noise: float = 0.0, salt: str = "c") -> DataFrame:
    """(id, label, x, y): an outer circle (0) of radius 1 and an inner one (1), points evenly along them."""
    i, ids = F.col("id"), _ids(spark, n)
    n = n if isinstance(n, int) else n.count()
    label = (i >= (n + 1) // 2).cast("int")
    half = F.when(label == 0, (n + 1) // 2).otherwise(n // 2)
    angle = 2 * math.pi * (i - F.when(label == 1, (n + 1) // 2).otherwise(0)) / half
    r = F.when(label == 1, factor).otherwise(1.0)
    return ids.select("id", label.alias("label"), *[(r * f(angle) + S.normal(i, salt + k) * noise).alias(k) for f, k in ((F.cos, "x"), (F.sin, "y"))])


def constants(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


def grid(spark: SparkSession, nx: int, ny: int, x: tuple[float, float], y: tuple[float, float]) -> DataFrame:
    """(i, j, x, y): a regular grid, both ends of each axis included."""
    cell = spark.range(nx * ny).select(F.floor(F.col("id") / ny).cast("int").alias("i"), (F.col("id") % ny).cast("int").alias("j"))
    at = lambda k, n, ends: F.lit(ends[0]) + F.col(k) * F.lit((ends[1] - ends[0]) / max(n - 1, 1))
    return cell.select("i", "j", at("i", nx, x).alias("x"), at("j", ny, y).alias("y"))
