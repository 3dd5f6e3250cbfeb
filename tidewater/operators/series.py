"""Order-dependent operators on series.  Every one takes its ordering keys; ``by`` splits series.

A window without ``by`` runs in one task, so use it on series that an aggregation has made short
(days, intervals), not on raw rows; with ``by`` the series are spread over the cluster.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

Names = Sequence[str]


def over(order: Names, by: Names = ()) -> WindowSpec:
    return Window.partitionBy(*by).orderBy(*order)


def rolling_mean(x: str, k: int, order: Names, by: Names = ()) -> Column:
    """Mean of the last k rows, null until all k are non-null."""
    w = over(order, by).rowsBetween(1 - k, 0)
    return F.when(F.count(x).over(w) == k, F.avg(x).over(w))


def percent_change(x: str, order: Names, by: Names = (), absolute: bool = False) -> Column:
    """(x1 - x0) / x0 * 100, null at a zero base; ``absolute`` covers the numerator only."""
    before = F.lag(x).over(over(order, by))
    d = F.col(x) - before
    return F.try_divide(F.abs(d) if absolute else d, before) * 100


def cumulative_sum(x: str, order: Names, by: Names = ()) -> Column:
    """Running sum that skips nulls and stays null on them."""
    return F.when(F.col(x).isNotNull(), F.sum(x).over(over(order, by).rowsBetween(Window.unboundedPreceding, 0)))


def trailing_mean(x: str, k: int, order: Names, by: Names = (), before: bool = False) -> Column:
    """Mean of the last k rows (of those before this one), however many there are."""
    w = over(order, by)
    return F.avg(x).over(w.rowsBetween(-k, -1) if before else w.rowsBetween(1 - k, 0))


def display_mean(x: str, k: int, order: Names, by: Names = ()) -> Column:
    """The sum of k + 1 rows over min(k, rows so far): kept for comparison with old displays."""
    w = over(order, by)
    return F.sum(x).over(w.rowsBetween(-k, 0)) / F.least(F.lit(k), F.row_number().over(w))


def forward_fill(x: str, order: Names, by: Names = (), start: float = 0.0) -> Column:
    """The last non-null value so far; ``start`` before the first."""
    w = over(order, by).rowsBetween(Window.unboundedPreceding, 0)
    return F.coalesce(F.last(x, ignorenulls=True).over(w), F.lit(start))


def sequences(df: DataFrame, x: str, length: int, order: Names, by: Names = (), batch: int | None = None) -> DataFrame:
    """Sliding windows of ``length`` rows (seq) with the next row's value (target), and the batch number."""
    w = over(order, by)
    out = df.withColumn("seq", F.collect_list(x).over(w.rowsBetween(-length, -1))).withColumn("rn", F.row_number().over(w))
    out = out.where(F.size("seq") == length).withColumnRenamed(x, "target")
    return out.withColumn("batch", F.floor((F.col("rn") - length - 1) / batch)) if batch else out


def frame_stack(x: str, k: int, order: Names, by: Names = (), newest_first: bool = False) -> Column:
    """The last k rows as an array, the first row repeated where there are fewer."""
    w = over(order, by)
    rows = F.collect_list(x).over(w.rowsBetween(1 - k, 0))
    first = F.first(x).over(w.rowsBetween(Window.unboundedPreceding, 0))
    out = F.concat(F.array_repeat(first, F.lit(k) - F.size(rows)), rows)
    return F.reverse(out) if newest_first else out


def discounted(reward: str, gamma: float, order: Names, by: Names = ()) -> Column:
    """Discounted reward, reset at every non-zero reward: the next non-zero reward from here on times
    gamma to the power of its distance; 0 after the last one.  For groups that a task can hold; ordered.discounted
    takes any."""
    w = Window.partitionBy(*by).orderBy(*[F.col(c).desc() for c in order])  # backwards, so that the frame grows by a row at a time
    left = F.row_number().over(w)
    hit = F.when(F.col(reward) != 0, F.struct(left.alias("left"), F.col(reward).alias("r")))
    nxt = F.last(hit, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return F.coalesce(nxt["r"] * F.pow(F.lit(gamma), left - nxt["left"]), F.lit(0.0))


def newest(df: DataFrame, n: int, order: Names, by: Names = ()) -> DataFrame:
    """A bounded first-in-first-out memory: the n newest rows (of each series)."""
    if not by:
        return df.orderBy(*[F.col(c).desc() for c in order]).limit(n)
    w = Window.partitionBy(*by).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n).drop("__rn")


def zscore(df: DataFrame, cols: Names, train: Column | None = None, sample: bool = True) -> DataFrame:
    """(x - mean) / sd of each column, with the statistics of the ``train`` rows; adds z_, mu_ and sd_ columns.

    The one-row statistics go to all tasks."""
    base = df.where(train) if train is not None else df
    sd = F.stddev_samp if sample else F.stddev_pop
    stats = base.agg(*[F.avg(c).alias(f"mu_{c}") for c in cols], *[sd(c).alias(f"sd_{c}") for c in cols])
    out = df.crossJoin(F.broadcast(stats))
    return out.withColumns({f"z_{c}": F.try_divide(F.col(c) - F.col(f"mu_{c}"), F.col(f"sd_{c}")) for c in cols})


def unscale(z: Column, mu: Column, sd: Column) -> Column:
    return z * sd + mu


def chronological_split(df: DataFrame, order: Names, share: float) -> DataFrame:
    """Adds ``train``: the first floor(share * n) rows in order.  For short (aggregated) series."""
    rn, n = F.row_number().over(Window.orderBy(*order)), F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))
    return df.withColumn("train", rn <= F.floor(n * share))


#: Rows that the last range of a hash split may hold.
SPLIT_ROWS = 50_000


def hash_split(df: DataFrame, key: str, share: float, salt: str = "") -> DataFrame:
    """Adds ``test`` for an exact ceil(share * n) rows, in the order of a hash of the key (a repeatable shuffle).

    The hashes are counted by their first three digits, then those of the range that holds the cut by the next
    three, until SPLIT_ROWS are left, which give the hash at the cut.  So a row is marked by a comparison
    and the table isn't shuffled.  The key is unique; rows of one key are marked alike."""
    h = F.md5(F.concat(F.lit(salt), F.col(key).cast("string")))
    hashes = df.select(h.alias("h"), F.col(key).alias("k"))
    want = math.ceil(df.count() * share)
    head, left = "", None
    while want and (left is None or left > SPLIT_ROWS) and len(head) < 30:
        at = F.substring("h", len(head) + 1, 3).alias("at")
        for r in hashes.where(F.col("h").startswith(head)).groupBy(at).agg(F.count("*").alias("n")).orderBy("at").collect():
            if want <= r.n:
                head, left = head + r["at"], r.n
                break
            want -= r.n
    if not want:
        return df.withColumn("test", F.lit(False))
    cut = hashes.where(F.col("h").startswith(head)).orderBy("h", "k").limit(want).agg(F.max(F.struct("h", "k")).alias("cut")).first().cut
    return df.withColumn("test", (h < cut.h) | ((h == cut.h) & (F.col(key) <= cut.k)))


def sample(df: DataFrame, key: str, n: int, salt: str = "") -> DataFrame:
    """n rows without replacement, those of least hash of the key: each task keeps n, and only these meet."""
    return df.orderBy(F.md5(F.concat(F.lit(salt), F.col(key).cast("string"))), key).limit(n)


def shuffled(df: DataFrame, key: str, salt: str = "") -> DataFrame:
    """Adds ``place``: the row's number from 1 in the order of a hash of the key; counted range by range of the hash."""
    rows = df.withColumn("__h", F.md5(F.concat(F.lit(salt), F.col(key).cast("string")))).withColumn("__r", F.substring("__h", 1, 3))
    counts = rows.groupBy("__r").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(Window.partitionBy("__r").orderBy("__h", key))
    out = rows.withColumn("__i", inside).join(F.broadcast(counts.select("__r", before.alias("__b"))), "__r")
    return out.select(*df.columns, (F.col("__i") + F.col("__b")).alias("place"))


def linear_schedule(t: Column, start: float, end: float, steps: int) -> Column:
    return F.lit(start) + F.lit(end - start) * F.least(t, F.lit(steps - 1)) / (steps - 1)
