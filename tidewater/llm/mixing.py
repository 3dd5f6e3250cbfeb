"""Mixing sources to target weights by Pfair scheduling.

A source's documents are cut into blocks of ``block_chars`` characters.  With weight
w = a/Q, block j (from 0) is released at slot floor(j/w) and due by slot ceil((j+1)/w);
in every slot the released block with the earliest deadline goes.  All weights sum to
one, so every block meets its window and no source is ever a whole block ahead of or
behind its share.  The order repeats after Q slots, so one period (or as many slots of it as the
sources have blocks for, if that is less) is worked out, and every document finds its slot by arithmetic.

The slots are worked out in ranges, side by side, each a SQL fold over one row.  Where a range begins, each
source has had floor or ceil of its share, which is known but for who had the last one.  So a range starts one
longest window early, from the state in which the open blocks that are due last are still to come.  That state has,
for every deadline, no more blocks to do than the true one, and as many in all.  With blocks of deadlines up to the range's
first slot the true schedule is done there, so is this one; of later deadlines both have had the same number since the
start.  So both are in the same state there, and the ranges make one schedule (the queues with deadlines up
to d follow n -> max(n + new - 1, 0) in both).

Weights are any numbers of 0 or more, taken exactly as written: their ratio in whole numbers gives Q.

Defined results
  * every input row comes back once, with ``mix_block`` and ``mix_slot`` added; reading in
    the order (mix_slot, mix_rank) is the mixture; input columns of the names ``mix_block``, ``mix_slot``,
    ``mix_rank`` and ``mixed`` are replaced, all others pass through, whatever their names;
  * ``mixed`` is true for slots before the first one whose source has run out: up to there
    the deviation bound holds for every source; later slots of spent sources are empty;
  * a source without a target weight, or null, has null slot and ``mixed`` false (last);
    weights are shared out among the sources that occur;
  * within a source the order is by md5 of the id, ties by id and length; null text counts
    as 0 characters; a document longer than a block begins in one and fills the next ones.

Positions come from two-level running sums: a source is cut into chunks by the first ``CHUNK_DIGITS``
digits of the md5, summed within chunks and then over chunks, so that a source with a
third of all rows is spread over all tasks.  The texts are read twice at most: for the sums, and for the rows.
"""

from __future__ import annotations

from fractions import Fraction
from math import ceil, gcd, lcm

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.llm.shared import col, columns, table

#: Slots of a range at least, slots that one array grows to, and tasks that work ranges out at most.
SLOTS, RUN, MOST_TASKS = 20_000, 500, 10_000
CHUNK_DIGITS = 3
#: The query's target weights, in hundredths.
TARGET = {f"src{i}": 8 if i < 5 else 6 if i < 10 else 3 for i in range(20)}
BLOCK_CHARS = 32_768


def schedule(weights: DataFrame, slots: int | None = None, run: int = SLOTS) -> DataFrame:
    """(source, share, k, offset, period): slot ``offset`` of each period belongs to block k
    (mod share) of source, for weights (source, share); only the first ``slots`` of a period if given.

    The slots are cut into ranges of at least ``run``, a row and so a task each."""
    spark = weights.sparkSession
    listed = sorted((r.source, r.share) for r in weights.where("share > 0").select("source", "share").collect())
    q = sum(a for _, a in listed)
    n = min(q, slots or q)
    warm = max((-(-q // a) for _, a in listed), default=0) + 1
    size = max(run, 4 * warm)
    ranges = max(1, -(-n // size)) if n else 0
    w = "array(" + ", ".join(f"named_struct('a', {a}L, 'whole', {q // a}L, 'rest', {q % a}L)" for _, a in listed) + ")"
    first, start = f"(id * {size}L)", f"greatest(id * {size}L - {warm}L, 0L)"
    rows = spark.range(0, ranges, 1, max(1, min(ranges, MOST_TASKS))).select(
        F.expr(start).alias("start"), F.expr(first).alias("first"), F.expr(f"least({first} + {size}L, {n}L)").alias("end"), F.expr(w if listed else "cast(array() AS array<struct<a: bigint, whole: bigint, rest: bigint>>)").alias("w")
    )
    rows = rows.select("first", "end", "w", "start", F.expr(_blocks(q)).alias("s")).select("first", "end", "w", "start", F.expr(_begun(q)).alias("s"))
    rows = rows.select("first", "end", "w", F.expr(f"if(start < first, aggregate(sequence(start, first - 1), s, (s, t) -> {_step('s')}.s), s)").alias("s"))
    # In arrays of ``RUN``, as an array is written anew for every slot that it grows by.
    inner = f"""aggregate(sequence(t, least(t + {RUN - 1}, end - 1)), named_struct('s', got.s, 'out', cast(array() AS array<struct<i: int, k: bigint>>)),
      (x, t) -> transform(array({_step('x.s')}), y -> named_struct('s', y.s, 'out', concat(x.out, array(y.hit))))[0])"""
    out = f"""aggregate(sequence(first, end - 1, {RUN}L), named_struct('s', s, 'out', cast(array() AS array<array<struct<i: int, k: bigint>>>)),
      (got, t) -> transform(array({inner}), z -> named_struct('s', z.s, 'out', concat(got.out, array(z.out))))[0]).out"""
    found = rows.where("first < end").select("first", F.posexplode(F.flatten(F.expr(out))).alias("p", "hit"))
    names = F.array(*[F.struct(F.lit(s).alias("source"), F.lit(a).cast("long").alias("share")) for s, a in listed]) if listed else F.expr("cast(array() AS array<struct<source: string, share: bigint>>)")
    of = names[F.col("hit.i")]
    return found.select(of["source"].alias("source"), of["share"].alias("share"), F.col("hit.k").alias("k"), (F.col("first") + F.col("p")).alias("offset"), F.lit(q).cast("long").alias("period"))


def _big(x: str) -> str:
    """Products of two longs need more digits than a long has."""
    return f"cast({x} AS decimal(19, 0))"


def _blocks(q: int) -> str:
    """For each source the block j whose window holds the place before slot ``start`` or begins there: its number, where it is released
    (f), where it ends in whole slots (nf) and what is over (nm, in parts of a slot), and whether it is released already."""
    j = f"cast({_big('start')} * {_big('x.a')} div {_big(f'{q}L')} AS bigint)"
    ends = f"{_big('y.j + 1')} * {_big(f'{q}L')}"
    return f"""transform(transform(w, x -> named_struct('j', {j}, 'a', x.a)), (y, i) -> named_struct(
      'j', y.j, 'f', cast({_big('y.j')} * {_big(f'{q}L')} div {_big('y.a')} AS bigint), 'nf', cast({ends} div {_big('y.a')} AS bigint), 'nm', cast({ends} % {_big('y.a')} AS bigint),
      'open', {_big('start')} * {_big('y.a')} % {_big(f'{q}L')} <> 0, 'i', i))"""


def _due(x: str) -> str:
    return f"({x}.nf + if({x}.nm > 0, 1L, 0L))"


def _next(x: str, w: str) -> str:
    more = f"({x}.nm + {w}.rest >= {w}.a)"
    return f"named_struct('j', {x}.j + 1, 'f', {x}.nf, 'nf', {x}.nf + {w}.whole + if({more}, 1L, 0L), 'nm', {x}.nm + {w}.rest - if({more}, {w}.a, 0L))"


def _begun(q: int) -> str:
    """The state to start from: of the open blocks as many are still to come as slots lack, those due last."""
    waiting = "cast(aggregate(s, 0L, (n, x) -> n + x.j + if(x.open, 1L, 0L)) - start AS int)"
    last = f"slice(sort_array(transform(filter(s, x -> x.open), x -> struct({_due('x')} AS due, x.i AS i)), false), 1, {waiting})"
    plain = "named_struct('j', x.j, 'f', x.f, 'nf', x.nf, 'nm', x.nm)"
    return f"transform(array({last}), late -> transform(s, (x, i) -> if(x.open AND NOT exists(late, y -> y.i = i), {_next('x', 'w[i]')}, {plain})))[0]"


def _step(s: str) -> str:
    """Struct (s, hit) after slot t: of the released blocks the one that is due first goes (ties: the first source)."""
    pick = f"array_min(transform({s}, (x, i) -> if(x.f <= t, struct({_due('x')} AS due, i AS i), NULL))).i"
    return f"transform(array({pick}), p -> named_struct('s', transform({s}, (x, i) -> if(i = p, {_next('x', 'w[i]')}, x)), 'hit', named_struct('i', p, 'k', {s}[p].j)))[0]"


def shares(weights: dict[str, float]) -> dict[str, int]:
    """The weights as whole numbers of the same ratio, as small as can be."""
    exact = {s: Fraction(str(w)) for s, w in weights.items()}
    if any(w < 0 for w in exact.values()):
        raise ValueError("weights are numbers of 0 or more")
    unit = lcm(*[w.denominator for w in exact.values()])
    whole = {s: int(w * unit) for s, w in exact.items()}
    by = gcd(*whole.values()) or 1
    return {s: w // by for s, w in whole.items()}


def mix(
    docs: DataFrame, weights: dict[str, float], block_chars: int = BLOCK_CHARS, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
    chars: Column | None = None,
) -> DataFrame:
    """``docs`` with the place of each in the mixture; ``chars``: its size, if that isn't the length of the text."""
    spark = docs.sparkSession
    chars = F.coalesce(F.length(col(text_col)) if chars is None else chars, F.lit(0)).cast("long")
    h = F.md5(F.coalesce(col(id_col).cast("string"), F.lit("")))
    # A key that is never null, so that windows and the join below share one shuffle of the rows.
    named = F.coalesce(F.concat(F.lit("s"), col(source_col)), F.lit("n"))
    rows = docs.withColumns({"__m_h": h, "__m_c": F.substring(h, 1, CHUNK_DIGITS), "__m_n": chars, "__m_s": named})
    # As many rows as sources times chunks; it serves all that follows.
    totals = table(rows.groupBy("__m_s", "__m_c").agg(F.sum("__m_n").alias("n"), F.count("*").alias("rows")), "totals")
    by_source = Window.partitionBy("__m_s").orderBy("__m_c").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "__m_s", "__m_c",
        F.coalesce(F.sum("n").over(by_source), F.lit(0)).alias("__m_off"), F.coalesce(F.sum("rows").over(by_source), F.lit(0)).alias("__m_roff"),
    )
    # One row for each listed source that occurs.  The last document's block is the largest; where it begins
    # is known only per row, so the total rounds up.
    blocks = {r.s: ceil(r.n / block_chars) for r in totals.where(F.col("__m_s").isin(*["s" + s for s in weights])).groupBy(F.expr("substring(__m_s, 2)").alias("s")).agg(F.sum("n").alias("n")).collect()}
    share = shares({s: w for s, w in weights.items() if s in blocks and w > 0})
    period = sum(share.values())
    listed = spark.createDataFrame([(s, a, blocks[s]) for s, a in sorted(share.items())], "source string, share long, blocks long")
    need = max((-(-(blocks[s] + 1) * period // a) + 1 for s, a in share.items()), default=0)
    plan = schedule(listed, need).join(F.broadcast(listed.select("source", "blocks")), "source")
    plan = table(plan, "plan")
    # The slot of the first block that a source does not have ends the exact part of the mixture.
    ends = plan.where(F.expr("blocks % share = k")).agg(F.min(F.expr("(blocks div share) * period + offset"))).first()[0]
    plan = plan.select(*[F.col(c).alias(f"__m_p_{c}") for c in ("source", "share", "k", "offset", "period")])
    inside = Window.partitionBy("__m_s", "__m_c").orderBy("__m_h", col(id_col), "__m_n").rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumns({"__m_in": F.coalesce(F.sum("__m_n").over(inside), F.lit(0)), "__m_rin": F.count(F.lit(1)).over(inside)})
    out = out.join(offsets, ["__m_s", "__m_c"])
    known = F.create_map(*[F.lit(x) for s, a in sorted(share.items()) for x in ("s" + s, a)]).cast("map<string,long>")
    out = out.withColumns({
        "__m_block": F.floor((F.col("__m_in") + F.col("__m_off")) / block_chars),
        "__m_rank": F.col("__m_rin") + F.col("__m_roff"),
        "__m_share": F.try_element_at(known, F.col("__m_s")),
    })
    key = F.when(F.col("__m_share") > 0, F.col("__m_block") % F.col("__m_share"))
    out = out.join(plan, (F.col("__m_s") == F.concat(F.lit("s"), F.col("__m_p_source"))) & (key == F.col("__m_p_k")), "left")
    slot = F.expr("(__m_block div __m_p_share) * __m_p_period + __m_p_offset")
    return out.select(
        *columns(docs, "mix_block", "mix_slot", "mix_rank", "mixed"),
        F.col("__m_block").alias("mix_block"), slot.alias("mix_slot"), F.col("__m_rank").alias("mix_rank"),
        F.coalesce(slot < F.lit(ends).cast("long"), F.lit(False)).alias("mixed"),
    )


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    # The length is all that is needed of a text, so the texts are read once.
    sizes = table(docs.select("doc_id", "source", F.length("text").alias("n")), "sizes")
    return mix(sizes, TARGET, chars=F.col("n")).select("doc_id", "source", "mix_block", "mix_slot", "mix_rank", "mixed")


_SHARES = ", ".join(f"('{s}', {a})" for s, a in sorted(TARGET.items()))
OP8_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, source, md5(CAST(doc_id AS VARCHAR)) AS h, coalesce(length(text), 0) AS n FROM documents),
placed AS (
  SELECT doc_id, source, n,
    CAST(coalesce(sum(n) OVER w, 0) AS BIGINT) // {BLOCK_CHARS} AS mix_block, count(*) OVER w AS mix_rank
  FROM d WINDOW w AS (PARTITION BY source ORDER BY h, doc_id, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
target(source, share) AS (VALUES {_SHARES}),
have AS (SELECT source, share, row_number() OVER (ORDER BY source) AS i FROM target WHERE source IN (SELECT source FROM d)),
q AS (SELECT CAST(sum(share) AS BIGINT) AS q FROM have),
arr AS (SELECT list(share ORDER BY i) AS a, (SELECT q FROM q) AS q FROM have),
sim AS (
  SELECT CAST(-1 AS BIGINT) AS t, list_transform(a, lambda x: CAST(0 AS BIGINT)) AS done, CAST(0 AS BIGINT) AS pick FROM arr
  UNION ALL
  SELECT t + 1, list_transform(done, lambda d, k: d + CASE WHEN k = p THEN 1 ELSE 0 END), p
  FROM (SELECT t, done, (SELECT b.i FROM (SELECT h.i, done[h.i] AS n, h.share AS share FROM have h) b, q
          WHERE (b.n * q.q) // b.share <= t + 1
          ORDER BY ((b.n + 1) * q.q + b.share - 1) // b.share, b.i LIMIT 1) AS p
        FROM sim WHERE t + 1 < (SELECT q FROM q))),
plan AS (
  SELECT h.source, h.share, s.t AS offs, row_number() OVER (PARTITION BY h.source ORDER BY s.t) - 1 AS k
  FROM sim s JOIN have h ON h.i = s.pick WHERE s.t >= 0),
ends AS (
  SELECT min((b.blocks // p.share) * (SELECT q FROM q) + p.offs) AS horizon
  FROM (SELECT source, CAST(ceil(sum(n) / {BLOCK_CHARS}e0) AS BIGINT) AS blocks FROM d GROUP BY source) b
  JOIN plan p ON p.source = b.source AND b.blocks % p.share = p.k)
SELECT x.doc_id, x.source, x.mix_block,
  (x.mix_block // p.share) * (SELECT q FROM q) + p.offs AS mix_slot, x.mix_rank,
  coalesce((x.mix_block // p.share) * (SELECT q FROM q) + p.offs < (SELECT horizon FROM ends), false) AS mixed
FROM placed x LEFT JOIN plan p ON p.source = x.source AND x.mix_block % p.share = p.k
"""
