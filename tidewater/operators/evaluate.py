"""Evaluation of predictions: confusion matrix, per-class report, curves, losses.

Every one reduces the rows to counts first (classes squared, or distinct scores)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def confusion(df: DataFrame, truth: str, pred: str, classes: int) -> DataFrame:
    """(truth, pred, n, share of the true class): rows are the truth, unused cells are 0."""
    n = df.groupBy(F.col(truth).cast("int").alias("truth"), F.col(pred).cast("int").alias("pred")).agg(F.count("*").alias("n"))
    labels = F.sequence(F.lit(0), F.lit(classes - 1))
    grid = df.sparkSession.range(1).select(F.explode(labels).alias("truth")).select("truth", F.explode(labels).alias("pred"))
    out = grid.join(n, ["truth", "pred"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.withColumn("share", F.try_divide("n", F.sum("n").over(Window.partitionBy("truth"))))


def class_report(matrix: DataFrame) -> DataFrame:
    """(label, support, precision, recall, f1) from a confusion matrix; null where nothing was predicted or true."""
    same = F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0)
    rows = F.array(
        F.struct(F.col("truth").alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("said"), same.cast("long").alias("hits")),
        F.struct(F.col("pred").alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("said"), F.lit(0).cast("long").alias("hits")),
    )
    g = matrix.select(F.inline(rows)).groupBy("label").agg(*[F.sum(c).alias(c) for c in ("support", "said", "hits")])
    f1 = F.try_divide(2.0 * F.col("hits"), F.col("support") + F.col("said"))
    return g.select("label", "support", F.try_divide("hits", "said").alias("precision"), F.try_divide("hits", "support").alias("recall"), f1.alias("f1"))


def running_sums(df: DataFrame, order: str, sums: list[str], ranges: int = 256) -> DataFrame:
    """``df`` with the running sums of ``sums`` down the falling numbers ``order`` (all different): the rows
    are dealt into ranges, summed range by range, and then run through inside each range."""
    bounds = df.agg(F.percentile_approx(order, [i / ranges for i in range(1, ranges)], 20 * ranges).alias("b"))
    rows = df.crossJoin(F.broadcast(bounds)).withColumn("__range", F.size(F.filter("b", lambda x: x <= F.col(order)))).drop("b")
    above = Window.orderBy(F.desc("__range")).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("__range").agg(*[F.sum(c).alias(f"__t_{c}") for c in sums])
    totals = totals.select("__range", *[F.coalesce(F.sum(f"__t_{c}").over(above), F.lit(0)).alias(f"__a_{c}") for c in sums])
    inside = Window.partitionBy("__range").orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumns({f"__i_{c}": F.sum(c).over(inside) for c in sums}).join(F.broadcast(totals), "__range")
    return out.select(*df.columns, *[(F.col(f"__i_{c}") + F.col(f"__a_{c}")).alias(f"run_{c}") for c in sums])


def precision_recall_curve(df: DataFrame, label: str, score: str) -> DataFrame:
    """(threshold, precision, recall) of score >= threshold, one row for each distinct score."""
    g = df.groupBy(F.col(score).alias("threshold")).agg(F.sum(label).alias("p"), F.count("*").alias("n"))
    all_p = g.agg(F.sum("p").alias("all_p"))
    out = running_sums(g, "threshold", ["p", "n"]).crossJoin(F.broadcast(all_p))
    return out.select("threshold", F.try_divide("run_p", "run_n").alias("precision"), F.try_divide("run_p", "all_p").alias("recall"))


def log_loss(y: Column, p: Column, eps: float = 1e-15, weight: Column | None = None) -> Column:
    loss = -y * F.ln(p + eps) - (1 - y) * F.ln(1 - p + eps)
    return F.avg(loss) if weight is None else F.try_divide(F.sum(weight * loss), F.sum(weight))


def cross_entropy(y: Column, p: Column, eps: float = 1e-15, weight: Column | None = None) -> Column:
    """Mean categorical cross-entropy of arrays (one-hot y, scores p, which are scaled to sum to one)."""
    total = F.aggregate(p, F.lit(0.0), lambda s, x: s + x)
    loss = -F.aggregate(F.zip_with(y, p, lambda t, x: t * F.ln(F.greatest(F.least(x / total, F.lit(1 - eps)), F.lit(eps)))), F.lit(0.0), lambda s, x: s + x)
    return F.avg(loss) if weight is None else F.try_divide(F.sum(weight * loss), F.sum(weight))


def matrix_accuracy(matrix: DataFrame) -> DataFrame:
    """(accuracy, error) from a confusion matrix."""
    hits = F.sum(F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0))
    return matrix.agg(F.try_divide(hits, F.sum("n")).alias("accuracy"), (1 - F.try_divide(hits, F.sum("n"))).alias("error"))


def squared_error(y: Column, p: Column) -> Column:
    return F.avg(F.pow(y - p, F.lit(2)))


def loss_surface(rows: DataFrame, grid: Sequence[Sequence[float]], bias: float = 0.0) -> DataFrame:
    """(g, loss, n): the mean logistic loss of a neuron with each of the weights in ``grid`` over rows (x array, y 0 or 1).

    One scan: a task multiplies its rows with all weights, block by block, and gives one sum a weight; the grid goes
    along with the tasks, so it is a set of settings, not a table."""
    w = np.array(grid, float)
    if w.size > 1_000_000:
        raise ValueError("a grid of a million numbers at most")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros(len(w)), 0
        for part in parts:
            for at in range(0, len(part), 1024):
                some = part.iloc[at : at + 1024]
                z = np.stack(some["x"].to_numpy()) @ w.T + bias
                # y softplus(-z) + (1 - y) softplus(z)
                total += (np.logaddexp(0, z) - some["y"].to_numpy(float)[:, None] * z).sum(axis=0)
                n += len(some)
        if n:
            yield pd.DataFrame({"g": np.arange(len(w)), "total": total, "n": n})

    sums = rows.select("x", "y").mapInPandas(run, "g int, total double, n long")
    return sums.groupBy("g").agg((F.sum("total") / F.sum("n")).alias("loss"), F.sum("n").alias("n"))


def over_threshold(df: DataFrame, score: str, truth: Column, thresholds: Sequence[float]) -> DataFrame:
    """(threshold, taken, right, precision, recall): the rows whose score is at or over each threshold, in one scan."""
    at = F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold")
    n = df.select(F.col(score).alias("s"), truth.cast("int").alias("t")).select("s", "t", at).groupBy("threshold")
    taken, right, true = F.count_if(F.col("s") >= F.col("threshold")), F.sum(F.when(F.col("s") >= F.col("threshold"), F.col("t")).otherwise(0)), F.sum("t")
    return n.agg(taken.alias("taken"), right.alias("right"), F.try_divide(right, taken).alias("precision"), F.try_divide(right, true).alias("recall"))
