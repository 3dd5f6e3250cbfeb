"""Ordered operators for groups of any size: no window holds a whole group.

The rows are sorted by range over the whole cluster and written once, in runs of ``RUN`` rows.  What
a row needs from further off comes in one of three ways
  * a total of the runs before (``numbered``, ``next_marked``): the runs' totals, one row a run, are summed up in order and
    handed to the rows of each run;
  * the last k rows (``haloed``): rows are cut into blocks by their number, and a block gets the k last rows of the one before;
  * the result of the row before (``recurrence``, ``recurrence_steps``): a parallel prefix scan.  Steps x -> k x + e are
    composed ``FAN`` at a time, level by level, until a group is one step (up-sweep); then each level's starts follow from those
    of the level above (down-sweep).
A group may hold all rows; the order is total (ties would make the results of neighbours swap).  Null keys are a
group; from a null factor or addend on x is null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidewater.tables import scratch, table

Names = Sequence[str]
#: Rows of a run or block, and steps that are composed into one.
RUN, FAN = 65_536, 256


def numbered(df: DataFrame, by: Names, order: Names, run: int = RUN) -> DataFrame:
    """``df`` with ``rn``, the row's number from 1 in its group, and ``run``, rising with it; a group's rows of a run are ``run`` at most."""
    rows = df.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order).withColumn("__id", F.monotonically_increasing_id())
    rows = table(rows.withColumn("run", F.expr(f"__id div {run}")), "ordered")
    inside = F.row_number().over(Window.partitionBy(*by, "run").orderBy("__id"))
    counts = rows.groupBy(*by, "run").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(*by).orderBy("run").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(*by, "run", F.coalesce(before, F.lit(0)).alias("__before"))
    return _by_run(rows, counts, by).withColumn("rn", inside + F.col("__before")).drop("__before", "__id")


def _by_run(rows: DataFrame, per_run: DataFrame, by: Names) -> DataFrame:
    """Rows with what their run has; null keys are keys too."""
    keys = [*by, "run"]
    other = per_run.select(*[F.col(c).alias(f"__k_{c}") for c in keys], *[c for c in per_run.columns if c not in keys])
    on = [F.col(c).eqNullSafe(F.col(f"__k_{c}")) for c in keys]
    return rows.join(other, on).drop(*[f"__k_{c}" for c in keys])


def haloed(rows: DataFrame, by: Names, k: int, block: int = RUN) -> tuple[DataFrame, WindowSpec]:
    """Numbered rows with their ``block`` and, in front of each block, the ``k`` rows before it (``halo`` true), and the
    window over a block in order: frames of up to k rows before a row are whole in it."""
    if k >= block:
        raise ValueError("a frame has fewer rows than a block")
    at = F.col("rn") - 1
    own = F.struct(F.floor(at / block).alias("block"), F.lit(False).alias("halo"))
    more = F.struct((F.floor(at / block) + 1).alias("block"), F.lit(True).alias("halo"))
    out = rows.withColumn("__b", F.explode(F.when(at % block >= block - k, F.array(own, more)).otherwise(F.array(own))))
    out = out.withColumns({"block": F.col("__b.block"), "halo": F.col("__b.halo")}).drop("__b")
    return out, Window.partitionBy(*by, "block").orderBy("rn")


def next_marked(rows: DataFrame, by: Names, mark: Column, value: Column) -> DataFrame:
    """Numbered rows with ``next``: (rn, value) of the first row from here on, itself included, where ``mark`` holds; null after the last."""
    rows = rows.withColumn("__hit", F.when(mark, F.struct(F.col("rn").alias("rn"), value.alias("value"))))
    down = Window.partitionBy(*by, "run").orderBy(F.desc("rn")).rowsBetween(Window.unboundedPreceding, 0)
    first = rows.groupBy(*by, "run").agg(F.min("__hit").alias("__first"))
    later = Window.partitionBy(*by).orderBy(F.desc("run")).rowsBetween(Window.unboundedPreceding, -1)
    first = first.select(*by, "run", F.last("__first", ignorenulls=True).over(later).alias("__later"))
    inside = F.last("__hit", ignorenulls=True).over(down)
    return _by_run(rows, first, by).withColumn("next", F.coalesce(inside, F.col("__later"))).drop("__hit", "__later")


def with_group_totals(rows: DataFrame, by: Names, totals: dict[str, Column]) -> DataFrame:
    """Rows (with ``run``) with aggregates of their whole group; these reach the rows by group and run, so that
    no task gets a group's rows."""
    sums = rows.groupBy(*by).agg(*[c.alias(n) for n, c in totals.items()])
    runs = rows.select(*by, "run").distinct()
    other = sums.select(*[F.col(c).alias(f"__g_{c}") for c in by], *totals)
    runs = runs.join(other, [F.col(c).eqNullSafe(F.col(f"__g_{c}")) for c in by]).drop(*[f"__g_{c}" for c in by])
    return _by_run(rows, runs, by)


def discounted(df: DataFrame, reward: str, gamma: float, order: Names, by: Names, run: int = RUN) -> DataFrame:
    """``df`` with ``run`` and ``disc``: the next non-zero reward from here on times gamma to the power of its distance; 0 after the last."""
    rows = next_marked(numbered(df, by, order, run), by, F.col(reward) != 0, F.col(reward))
    disc = F.coalesce(F.col("next.value") * F.pow(F.lit(gamma), F.col("next.rn") - F.col("rn")), F.lit(0.0))
    return rows.select(*df.columns, "run", disc.alias("disc"))


# ---- prefix scan


def _levels(df: DataFrame, by: Names, order: str, factor: str, add: str, start: Column, fan: int, run: int) -> tuple[list[DataFrame], DataFrame]:
    """Groups of ``fan`` steps level by level (by, c: number of the group, steps: [(rn, k, e, at)]), and one step a group of rows (by, k, e, x0)."""
    src = df.select(*by, F.col(order).alias("at"), F.col(factor).cast("double").alias("k"), F.col(add).cast("double").alias("e"), start.cast("double").alias("x0"))
    rows = numbered(src, by, ["at"], run)
    starts = rows.where("rn = 1").select(*by, "x0")
    most = rows.agg(F.max("rn")).first()[0] or 0
    levels, cur = [], rows.select(*by, F.col("rn"), "k", "e", "at")
    while True:
        steps = F.array_sort(F.collect_list(F.struct("rn", "k", "e", *(["at"] if not levels else []))))
        packed = table(cur.groupBy(*by, F.expr(f"(rn - 1) div {fan}").alias("c")).agg(steps.alias("steps")), "scan")
        levels.append(packed)
        one = "named_struct('k', get(steps, 0).k, 'e', get(steps, 0).e)"
        # k1 k2 may overflow where e1 is 0; then it doesn't count.
        step = f"aggregate(slice(steps, 2, {fan}), {one}, (s, r) -> named_struct('k', s.k * r.k, 'e', if(s.e = 0, r.e, s.e * r.k + r.e)))"
        cur = packed.select(*by, (F.col("c") + 1).alias("rn"), F.expr(step).alias("s")).select(*by, "rn", "s.k", "s.e")
        most = -(-most // fan)
        if most <= 1:
            return levels, _of_group(cur.drop("rn"), starts, by)


def _of_group(rows: DataFrame, other: DataFrame, by: Names) -> DataFrame:
    o = other.select(*[F.col(c).alias(f"__g_{c}") for c in by], *[c for c in other.columns if c not in by])
    return rows.join(o, [F.col(c).eqNullSafe(F.col(f"__g_{c}")) for c in by]).drop(*[f"__g_{c}" for c in by])


def recurrence(df: DataFrame, by: Names, order: str, factor: str, add: str, start: Column, fan: int = FAN, run: int = RUN) -> DataFrame:
    """(by, x): the last x of each group, where x_i = x_(i-1) * factor_i + add_i along ``order`` from ``start``."""
    with scratch() as keep:
        _, last = _levels(df, by, order, factor, add, start, fan, run)
        out = keep(table(last.select(*by, F.expr("if(x0 = 0, e, x0 * k + e)").alias("x")), "scan"))
    return out


def recurrence_steps(df: DataFrame, by: Names, order: str, factor: str, add: str, start: Column, fan: int = FAN, run: int = RUN) -> DataFrame:
    """(by, at, x): x after every row, where x_i = x_(i-1) * factor_i + add_i along ``order`` from ``start``."""
    with scratch() as keep:
        levels, last = _levels(df, by, order, factor, add, start, fan, run)
        above = last.select(*by, F.lit(0).cast("long").alias("c"), F.col("x0").alias("x"))
        for level, packed in reversed(list(enumerate(levels))):
            # In an array: the x before each step, and after it.
            x = "element_at(xs, -1)"
            xs = f"aggregate(steps, cast(array(x) AS array<double>), (xs, r) -> concat(xs, array(if({x} = 0, r.e, {x} * r.k + r.e))))"
            rows = _keyed(packed, above, by).select(*by, F.expr(xs).alias("xs"), "steps")
            if level:
                rows = rows.select(*by, F.expr("inline(transform(steps, (r, i) -> struct(r.rn - 1 AS c, xs[i] AS x)))"))
                above = table(rows, "scan")
            else:
                rows = rows.select(*by, F.expr("inline(transform(steps, (r, i) -> struct(r.at AS at, xs[i + 1] AS x)))"))
        out = keep(table(rows, "scan"))
    return out


def _keyed(packed: DataFrame, above: DataFrame, by: Names) -> DataFrame:
    keys = [*by, "c"]
    o = above.select(*[F.col(c).alias(f"__g_{c}") for c in keys], "x")
    return packed.join(o, [F.col(c).eqNullSafe(F.col(f"__g_{c}")) for c in keys]).drop(*[f"__g_{c}" for c in keys])
