"""Profiles of columns: moments, quantiles, missing values, histograms, correlation."""

from __future__ import annotations

import math
import sys
from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUARTILES = (0.25, 0.5, 0.75)


#: Buckets that one pass cuts the interval of an order statistic into.
CUTS = 4096


_GREATEST = sys.float_info.max


def _number(c: str) -> Column:
    """The column without NaN, infinities as the greatest doubles (so that intervals can be cut)."""
    x = F.col(c).cast("double")
    return F.when(x.isNotNull() & ~F.isnan(x), F.greatest(F.lit(-_GREATEST), F.least(F.lit(_GREATEST), x)))


def order_statistics(df: DataFrame, ranks: dict[str, Sequence[int]], edges: dict[str, tuple] | None = None) -> dict[str, dict[int, float]]:
    """{column: {rank: value}}: the values of the given ranks (from 0) among a column's numbers, exactly; NaN counts as missing.

    Each pass counts the rows in CUTS buckets of every interval that still holds a wanted rank and goes on
    with the buckets that do, so no pass shuffles more than the counts; values that lie evenly need about
    log(rows) / log(CUTS) passes, any doubles eight at most.  Only the buckets of wanted ranks reach the driver.
    ``edges``: (count, least, greatest) of each column, if known."""
    edges = edges or _edges(df, list(ranks))
    done: dict[str, dict[int, float]] = {c: {} for c in ranks}
    # (column, least value, greatest value, rows before, ranks wanted)
    left = [(c, *edges[c][1:], 0, sorted(set(k))) for c, k in ranks.items() if edges[c][0] and k]
    while left:
        for c, lo, hi, _, wanted in left:
            if lo == hi:
                done[c].update(dict.fromkeys(wanted, lo if abs(lo) < _GREATEST else math.copysign(math.inf, lo)))
        left = [x for x in left if x[1] < x[2]]
        if not left:
            break
        cells = []
        for i, (c, lo, hi, _, _) in enumerate(left):
            x = _number(c)
            # In halves, so that the width doesn't overflow.
            at = F.least(F.floor((x / 2 - lo / 2) / (hi / 2 - lo / 2) * CUTS), F.lit(CUTS - 1)).cast("int")
            cells.append(F.when(x.between(lo, hi), F.struct(F.lit(i).alias("i"), at.alias("at"), x.alias("x"))))
        long = df.select(F.inline(F.filter(F.array(*cells), lambda s: s.isNotNull())))
        counts = long.groupBy("i", "at").agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
        up = Window.partitionBy("i").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
        start = F.get(F.array(*[F.lit(x[3]).cast("long") for x in left]), F.col("i"))
        wanted = F.get(F.array(*[F.array(*[F.lit(k).cast("long") for k in x[4]]) for x in left]), F.col("i"))
        counts = counts.withColumn("before", start + F.coalesce(F.sum("n").over(up), F.lit(0)))
        inside = F.filter(wanted, lambda k: (k >= F.col("before")) & (k < F.col("before") + F.col("n")))
        left = [(left[r.i][0], r.lo, r.hi, r.before, r.ks) for r in counts.withColumn("ks", inside).where(F.size("ks") > 0).collect()]
    return done


def _edges(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple]:
    """(count, least, greatest) of each column's numbers."""
    x = [_number(c) for c in cols]
    row = df.agg(*[f(v).alias(f"{f.__name__}{i}") for i, v in enumerate(x) for f in (F.count, F.min, F.max)]).first()
    return {c: tuple(row[3 * i : 3 * i + 3]) for i, c in enumerate(cols)}


def quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float]) -> dict[str, list[float | None]]:
    """Exact quantiles of each column, linear between the two nearest values; None without values."""
    edges = _edges(df, cols)
    n = {c: e[0] for c, e in edges.items()}
    at = {c: [(n[c] - 1) * p for p in probs] for c in cols}
    got = order_statistics(df, {c: sorted({k for h in hs for k in (int(h), min(int(h) + 1, n[c] - 1))}) if n[c] else [] for c, hs in at.items()}, edges)

    def value(v: dict[int, float], h: float, top: int) -> float:
        a, b = v[int(h)], v[min(int(h) + 1, top)]
        return a if a == b or h == int(h) else a + (b - a) * (h - int(h))

    return {c: [value(got[c], h, n[c] - 1) if n[c] else None for h in hs] for c, hs in at.items()}


def describe(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row a column: count, mean, sd (sample), min, exact quartiles, max."""
    q = quantiles(df, cols, QUARTILES)
    aggs = [
        F.struct(
            F.lit(c).alias("name"), F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("sd"), F.min(c).cast("double").alias("lo"),
            *[F.lit(v).cast("double").alias(f"q{int(p * 100)}") for p, v in zip(QUARTILES, q[c], strict=True)], F.max(c).cast("double").alias("hi"),
        ).alias(f"c{i}")
        for i, c in enumerate(cols)
    ]
    return df.agg(*aggs).select(F.inline(F.array(*[F.col(f"c{i}") for i in range(len(cols))])))


def missing_rates(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(name, rate) of nulls, one pass."""
    cols = list(cols or df.columns)
    rates = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in cols])
    return rates.select(F.inline(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("rate")) for c in cols])))


def columns_by_missing(df: DataFrame, low: float, high: float) -> list[str]:
    """The columns whose missing rate lies strictly between the bounds (a few numbers come to the driver)."""
    return sorted(r.name for r in missing_rates(df).collect() if low < r.rate < high)


def columns_of_type(df: DataFrame, *types: str) -> list[str]:
    return [c for c, t in df.dtypes if t in types]


def correlation_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(a, b, r) for all pairs of columns over the rows where both are known; one pass."""
    pairs = list(combinations(cols, 2))
    row = df.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    cells = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("r")) for a, b in pairs]
    cells += [F.struct(F.lit(b).alias("a"), F.lit(a).alias("b"), F.col(f"`{a}|{b}`").alias("r")) for a, b in pairs]
    cells += [F.struct(F.lit(c).alias("a"), F.lit(c).alias("b"), F.lit(1.0).alias("r")) for c in cols]
    return row.select(F.inline(F.array(*cells)))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """(col, n, share), most frequent first; the total is taken over the counted values."""
    n = df.groupBy(col).agg(F.count("*").alias("n"))
    # The one-row total goes to all tasks.
    total = n.agg(F.sum("n").alias("__total"))
    return n.crossJoin(F.broadcast(total)).select(col, "n", (F.col("n") / F.col("__total")).alias("share")).orderBy(F.desc("n"), col)


def histogram(df: DataFrame, col: str, width: float, bins: int) -> DataFrame:
    """(bin, lo, hi, n): right-closed bins (lo, hi] of equal width from 0, empty ones kept, values outside
    dropped (so are 0 and less)."""
    x = F.col(col)
    inside = df.where((x > 0) & (x <= bins * width))
    counts = inside.groupBy((F.ceil(x / width) - 1).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    all_bins = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    lo = F.col("bin") * F.lit(width)
    return all_bins.join(counts, "bin", "left").select("bin", lo.alias("lo"), (lo + width).alias("hi"), F.coalesce("n", F.lit(0)).alias("n"))


def zipf_rank(hist: DataFrame) -> DataFrame:
    """(bin, mid, n, cumul): the counts in falling order set against the bins' midpoints in rising order,
    with the running sum: a rank-frequency curve.  As many rows as bins."""
    ranked = hist.select("n", (F.row_number().over(Window.orderBy(F.desc("n"))) - 1).alias("bin"))
    mid = hist.select("bin", ((F.col("lo") + F.col("hi")) / 2).alias("mid"))
    w = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    return mid.join(ranked, "bin").withColumn("cumul", F.sum("n").over(w))


def inverse_cdf(draws: DataFrame, curve: DataFrame, r: str = "r") -> DataFrame:
    """Each draw's value: the first point with cumul >= r, interpolated from the point before
    (the first one from 0).  ``curve`` (mid, cumul) is small (bins); zero-width steps are left out."""
    w = Window.orderBy("cumul", "mid")
    steps = curve.groupBy("cumul").agg(F.min("mid").alias("mid")).withColumns(
        {"c0": F.lag("cumul", 1, 0).over(w), "m0": F.lag("mid", 1, 0.0).over(w)}
    )
    steps = steps.where("cumul > c0").withColumnRenamed("cumul", "c1").withColumnRenamed("mid", "m1")
    hit = (F.col(r) > F.col("c0")) & (F.col(r) <= F.col("c1"))
    value = F.col("m0") + (F.col("m1") - F.col("m0")) * (F.col(r) - F.col("c0")) / (F.col("c1") - F.col("c0"))
    return draws.join(F.broadcast(steps), hit).select(*draws.columns, value.alias("x"))


def band(x: Column, edges: Sequence[float]) -> Column:
    """The number of edges that x has reached; null falls through to the last band."""
    out = F.lit(len(edges))
    for i in reversed(range(len(edges))):
        out = F.when(x < edges[i], i).otherwise(out)
    return out


def decile_grid(df: DataFrame, col: str) -> DataFrame:
    """(grid): the nine exact deciles in one row."""
    grid = quantiles(df, [col], [i / 10 for i in range(1, 10)])[col]
    return df.sparkSession.range(1).select(F.array(*[F.lit(v).cast("double") for v in grid]).alias("grid"))


def decile_band(x: Column, grid: Column) -> Column:
    """The first i with x < grid[i], else 9; null gives 9."""
    return F.when(x.isNull(), 9).otherwise(F.size(F.filter(grid, lambda g: g <= x)))


def anova_f(df: DataFrame, cols: Sequence[str], label: str) -> DataFrame:
    """(name, f): the one-way F statistic of each column over the label's groups; one pass by group."""
    long = df.select(label, F.inline(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("x")) for c in cols])))
    return _f_statistic(long, label)


def anova_f_positions(df: DataFrame, array: str, label: str, prefix: str) -> DataFrame:
    """anova_f of every position of an array column, however long: ``prefix`` and the position from 1 is the name."""
    long = df.select(label, F.posexplode(array).alias("i", "x"))
    return _f_statistic(long.select(label, F.concat(F.lit(prefix), F.col("i") + 1).alias("name"), F.col("x").cast("double").alias("x")), label)


def _f_statistic(long: DataFrame, label: str) -> DataFrame:
    g = long.where("x is not null").groupBy("name", label).agg(F.count("*").alias("n"), F.avg("x").alias("m"), F.var_pop("x").alias("v"))
    t = g.groupBy("name").agg(
        F.sum("n").alias("n"), F.count("*").alias("k"), F.sum(F.col("n") * F.col("v")).alias("within"),
        F.sum(F.col("n") * F.col("m") * F.col("m")).alias("nmm"), F.sum(F.col("n") * F.col("m")).alias("nm"),
    )
    between = F.col("nmm") - F.col("nm") * F.col("nm") / F.col("n")
    return t.select("name", F.try_divide(between / (F.col("k") - 1), F.col("within") / (F.col("n") - F.col("k"))).alias("f"))
