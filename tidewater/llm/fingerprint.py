"""Document fingerprints: improbable features in chained Bloom filters.

Every window of 32 bytes of the UTF-8 text is a feature.  Its entropy level (0 to 1000) has a
rarity: the less often the level occurs over all windows of the corpus, the rarer.  In each run
of 32 consecutive windows the leftmost rarest one is picked; windows picked 8 times or more (in a text of
under 32 runs, by a quarter of them) are the document's features.  They go, in order, into a chain of 2048-bit Bloom filters, five bits a
feature, 160 features a filter.  Two fingerprints are compared filter by filter: common bits above
what chance gives, as a share of the possible; each filter of the shorter chain takes its best
partner, weighted by its bits.

Defined results: null is the empty text; an empty text has the fingerprint ``0:``; texts under 32
bytes, or with no usable feature, are one feature; equal texts have equal fingerprints for the same
rarity table; two empty texts are alike (1), an empty and another one aren't (0).
The next document is the next in descending id (nulls last, ties by a hash of the text), after the last the
first.  Input columns of other names don't matter; ``with_fingerprints`` replaces one of the output's name.

One pass gathers the rarity table (1001 counts), one the id, hash and length of each text (written once; bounds and
first rows come from it), one the texts.  Finding each document's
successor costs one shuffle by ranges of the id of about ``RANGE_BYTES``, hot ids and nulls being cut by the
hash of the text too (rows equal in id and text stay in one range, which is sorted on disk and read as a stream); the only
things that pass through the driver are range bounds and the first row of each range,
``MAX_RANGES`` at most (ranges grow beyond).
"""

from __future__ import annotations

import base64
import hashlib
import json
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.llm.shared import col, columns, map_arrow, mix64, scratch, table

WINDOW, POPULAR, LEVELS = 32, 8, 1000
#: Levels below are repetitive bytes, which fit too many texts.
LEAST_LEVEL = 100
BITS, HASHES, PER_FILTER = 2048, 5, 160
BLOCK = 1 << 16
RANGE_BYTES, MAX_RANGES = 32 << 20, 65_536
_SCALE = 1 << 20
_CLOG = np.array([round(c * math.log2(c) * _SCALE) if c else 0 for c in range(WINDOW + 1)], np.int64)
_GAIN = np.concatenate([[0], np.diff(_CLOG)])


def entropy_levels(buf: np.ndarray) -> np.ndarray:
    """The entropy level (of at most log2(32) = 5 bits) of the window that begins at each byte (len(buf) - 31 of them)."""
    total = len(buf) - WINDOW + 1
    out = np.empty(max(total, 0), np.int16)
    for s in range(0, total, BLOCK):
        w = min(BLOCK, total - s)
        x = buf[s : s + w + WINDOW - 1]
        gone, come = np.ones(w - 1, np.uint8), np.ones(w - 1, np.uint8)
        for k in range(1, WINDOW):
            same = (x[:-k] == x[k:]).view(np.uint8)
            gone += same[: w - 1]
            come += same[WINDOW - k : WINDOW - k + w - 1]
        first = _CLOG[np.bincount(x[:WINDOW], minlength=256)].sum()
        sums = np.concatenate([[first], first + np.cumsum(_GAIN[come] - _GAIN[gone])])
        out[s : s + w] = LEVELS - sums * LEVELS // (5 * WINDOW * _SCALE)
    return out


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts in one buffer, and where each begins (and the last ends)."""
    ends = np.cumsum([0, *map(len, texts)])
    return np.frombuffer(b"".join(texts), np.uint8), ends


def _inside(ends: np.ndarray, n: int, reach: int) -> np.ndarray:
    """True where ``reach`` bytes from this one on belong to the same text."""
    ok = np.ones(n, bool)
    for e in ends[1:]:
        ok[max(0, e - reach + 1) : e] = False
    return ok


def level_counts(texts: list[bytes]) -> np.ndarray:
    buf, ends = _joined(texts)
    if len(buf) < WINDOW:
        return np.zeros(LEVELS + 1, np.int64)
    levels = entropy_levels(buf)
    return np.bincount(levels[_inside(ends, len(buf), WINDOW)[: len(levels)]], minlength=LEVELS + 1)


def rarity_ranks(counts: np.ndarray) -> np.ndarray:
    """The rank of each level, 0 the rarest; levels that aren't used get the last rank of all."""
    order = np.lexsort((np.arange(LEVELS + 1), counts))
    ranks = np.empty(LEVELS + 1, np.int64)
    ranks[order] = np.arange(LEVELS + 1)
    ranks[:LEAST_LEVEL] = LEVELS + 1
    return ranks


def fingerprints(texts: list[str], ranks: np.ndarray) -> list[str]:
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    buf, ends = _joined(raw)
    chosen: list[np.ndarray] = [np.empty(0, np.uint64)] * len(raw)
    if len(buf) >= WINDOW:
        levels = entropy_levels(buf)
        inside = _inside(ends, len(buf), WINDOW)[: len(levels)]
        rank = np.where(inside, ranks[levels], LEVELS + 2)
        key = (rank << 40) | np.arange(len(rank))
        pop = np.zeros(len(rank), np.int32)
        if len(key) >= WINDOW:
            low = key
            for step in (1, 2, 4, 8, 16):
                low = np.minimum(low[:-step], low[step:])
            runs = _inside(ends, len(buf), 2 * WINDOW - 1)[: len(low)]
            pop += np.bincount(low[runs] & ((1 << 40) - 1), minlength=len(rank)).astype(np.int32)
        for i, b in enumerate(raw):
            n = len(b) - WINDOW + 1
            if 0 < n < WINDOW:
                pop[key[ends[i] : ends[i] + n].min() & ((1 << 40) - 1)] = POPULAR
        # Texts with few runs can't pick a window that often.
        need = np.full(len(rank), POPULAR)
        for i, b in enumerate(raw):
            few = len(b) - 2 * WINDOW + 2
            if 0 < few < 4 * POPULAR:
                need[ends[i] : ends[i] + len(b)] = -(-few // 4)
        at = np.flatnonzero((pop >= need) & (rank <= LEVELS))
        rows = np.lib.stride_tricks.sliding_window_view(buf, WINDOW)[at].view("<u8") if len(at) else np.empty((0, WINDOW // 8), np.uint64)
        with np.errstate(over="ignore"):
            h = np.zeros(len(at), np.uint64)
            for j in range(rows.shape[1]):
                h = mix64(h * np.uint64(0x9FB21C651E98DF25) + rows[:, j].astype(np.uint64) + np.uint64(j + 1))
        chosen = np.split(h, np.searchsorted(at, ends[1:-1]))
    return [_chain(h, b) for h, b in zip(chosen, raw, strict=True)]


def _chain(h: np.ndarray, raw: bytes) -> str:
    if not raw:
        return "0:"
    if not len(h):
        h = np.frombuffer(hashlib.blake2b(raw, digest_size=8).digest(), np.uint64)
    h = h[np.sort(np.unique(h, return_index=True)[1])]
    n = -(-len(h) // PER_FILTER)
    bits = np.zeros((n, BITS), bool)
    which = np.arange(len(h)) // PER_FILTER
    for j in range(HASHES):
        bits[which, ((h >> np.uint64(11 * j)) & np.uint64(BITS - 1)).astype(np.int64)] = True
    return f"{len(h)}:{base64.b64encode(np.packbits(bits, axis=1).tobytes()).decode()}"


def likeness(a: str, b: str) -> float:
    """The normalised bit overlap of two fingerprints, 0 to 1."""
    if a == b:
        return 1.0
    x, y = (np.frombuffer(base64.b64decode(s.partition(":")[2]), np.uint8).reshape(-1, BITS // 8) for s in (a, b))
    if not len(x) or not len(y):
        return 0.0
    if len(x) > len(y) or (len(x) == len(y) and int(a.partition(":")[0]) > int(b.partition(":")[0])):
        x, y = y, x
    ny = np.bitwise_count(y).sum(axis=1, dtype=np.int64)
    got = weight = 0.0
    for f in x:
        nf = int(np.bitwise_count(f).sum(dtype=np.int64))
        common = np.bitwise_count(y & f).sum(axis=1, dtype=np.int64)
        chance = nf * ny / BITS
        noise = 3 * np.sqrt(chance * (BITS - nf) * (BITS - ny) / (BITS * (BITS - 1)))
        most = np.minimum(nf, ny)
        score = np.where(common > chance + noise, (common - chance) / np.maximum(most - chance, 1e-9), 0.0)
        got += nf * float(np.clip(score.max(), 0, 1))
        weight += nf
    return got / weight


def _pieces(col: pa.Array, chars: int = 1 << 20) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) in parts of about ``chars`` characters."""
    part, size, first = [], 0, 0
    for i, t in enumerate(col.to_pylist()):
        part.append(t or "")
        size += len(part[-1])
        if size >= chars:
            yield first, part
            part, size, first = [], 0, i + 1
    if part:
        yield first, part


def fit_rarity(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Ranks of the entropy levels over all windows of all texts; 1001 counts come to the driver."""

    def count(batches):
        total = np.zeros(LEVELS + 1, np.int64)
        for b in batches:
            for _, texts in _pieces(b.column(0)):
                total += level_counts([t.encode("utf-8", "surrogatepass") for t in texts])
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["level", "n"])

    counts = np.zeros(LEVELS + 1, np.int64)
    for r in docs.select(col(text_col)).mapInArrow(count, "level long, n long").groupBy("level").agg(F.sum("n").alias("n")).collect():
        counts[r.level] = r.n
    return rarity_ranks(counts)


def with_fingerprints(docs: DataFrame, ranks: np.ndarray, text_col: str = "text", out_col: str = "fingerprint") -> DataFrame:
    """``docs`` with a fingerprint of each text; no shuffle."""
    cols = [c for c in docs.columns if c != out_col]
    src = docs.select(*columns(docs, out_col))
    at = cols.index(text_col)

    def run(batches):
        for b in batches:
            for first, texts in _pieces(b.column(at)):
                part = b.slice(first, len(texts))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(fingerprints(texts, ranks), pa.string())], names=[*cols, out_col])

    return map_arrow(src, run, T.StructType([*src.schema.fields, T.StructField(out_col, T.StringType())]))


def with_next(docs: DataFrame, parts: int | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(bucket, look, id, text) of (id, text), dealt out by ranges of id, descending, with a lookahead row:
    partitioned and sorted so that the row after each row with ``look`` false is its successor."""
    with scratch():
        # Sizes, bounds and first rows come from three numbers a row, so that texts are read for them once.
        ids = table(docs.select("id", F.xxhash64("text").alias("h"), F.length("text").alias("n")), "ids")
        size = ids.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("chars"), F.count("*").alias("rows"), F.count_if(F.col("id").isNull()).alias("nulls")).first()
        if not size.rows:
            return docs.select(F.lit(0).alias("bucket"), F.lit(False).alias("look"), "id", "text")
        parts = max(parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size.chars // (4 * range_bytes)))
        n = max(2, min(MAX_RANGES, max(4 * parts, -(-size.chars // range_bytes))))
        bucket, slices = _buckets(ids, n, size.nulls, size.rows)
        key = F.struct(F.col("id").isNull().alias("last"), F.bitwise_not("id").alias("down"), "h")
        firsts = {r.bucket: r.m for r in ids.select(bucket.alias("bucket"), key.alias("k")).groupBy("bucket").agg(F.min("k").alias("m")).collect()}
    order = sorted(firsts)
    # The first row of a bucket is also the lookahead of the bucket before it; the very first one closes the ring.
    before = dict(zip(order, [order[-1], *order[:-1]], strict=True))
    rows_of = [firsts.get(b) for b in range(slices)]
    first_id = _longs([None if r is None or r.down is None else ~r.down for r in rows_of])
    first_h = _longs([r and r.h for r in rows_of])
    at = docs.withColumn("h", F.xxhash64("text")).withColumn("bucket", bucket)
    own = F.struct("bucket", F.lit(False).alias("look"))
    leads = F.get(first_id, F.col("bucket")).eqNullSafe(F.col("id")) & (F.get(first_h, F.col("bucket")) == F.col("h"))
    ahead = F.when(leads, F.struct(F.get(_longs([before.get(b) for b in range(slices)]), F.col("bucket")).cast("int").alias("bucket"), F.lit(True).alias("look")))
    rows = at.select("id", "text", "h", F.inline(F.filter(F.array(own, ahead), lambda s: s.isNotNull())))
    rows = rows.repartition(parts, "bucket")
    return rows.sortWithinPartitions("bucket", "look", F.col("id").desc_nulls_last(), "h", "text").select("bucket", "look", "id", "text")


def _buckets(ids: DataFrame, n: int, nulls: int, rows: int) -> tuple[Column, int]:
    """The bucket of a row (id, h), by about ``n`` ranges of id, highest ids first and nulls last, and how many there are."""
    shares = _constant([i / n for i in range(1, n)], "double")
    found = ids.agg(F.percentile_approx("id", shares, 20 * n).alias("b")).first().b or []
    # An id that several bounds fall on is hot: a range of its own, cut by the hash into as many slices.
    often = Counter(found)
    hot = {b: k for b, k in often.items() if k > 1 and b < (1 << 63) - 1}
    bounds = sorted({*often, *(b + 1 for b in hot)})
    slices = [min(n, -(-nulls * n // rows)) or 1, 1, *[hot.get(b, 1) for b in bounds]]  # nulls, below the first bound, from each bound on
    base = np.concatenate([[0], np.cumsum(slices[::-1])[:-1]])[::-1].tolist()  # the first slice of each range
    # Position among the bounds in two steps, so that a row costs about 2 * sqrt(bounds).
    wide = max(1, math.isqrt(len(bounds)))
    arr, heads = _longs(bounds), _longs(bounds[::wide])
    head = F.size(F.filter(heads, lambda b: b <= F.col("id")))
    inner = F.when(head > 0, (head - 1) * wide + F.size(F.filter(F.slice(arr, F.greatest((head - 1) * wide + 1, F.lit(1)), wide), lambda b: b <= F.col("id"))))
    at = F.when(F.col("id").isNull(), 0).otherwise(F.coalesce(inner, F.lit(0)) + 1).cast("int")
    share = F.floor((F.shiftright("h", 32) + (1 << 31)) * F.get(_longs(slices), at) / float(1 << 32))
    return (F.get(_longs(base), at) + share).cast("int"), sum(slices)


def _longs(values) -> Column:
    return _constant(values, "bigint")


def _constant(values, kind: str) -> Column:
    """A constant array, from one string that the optimizer reads once: it stays cheap for 65 536 numbers."""
    return F.from_json(F.lit(json.dumps(list(values))), f"array<{kind}>")


def edited(text: str, following: str) -> str:
    n = len(text) // 2
    return text[: len(text) - n] + following[:n]


def compare_with_next(docs: DataFrame, ranks: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text's fingerprint beside those of its edited text and of the next document."""
    rows = with_next(docs.select(col(id_col).cast("long").alias("id"), F.coalesce(col(text_col), F.lit("")).alias("text")))
    names = [id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches):
        held = None  # (id, text, fingerprint) of the row whose successor comes next
        for b in batches:
            for at, texts in _pieces(b.column(3)):
                look, ids = (b.column(c).slice(at, len(texts)).to_pylist() for c in (1, 2))
                prints = fingerprints(texts, ranks)
                pairs = []
                for k, (i, t, f) in enumerate(zip(ids, texts, prints, strict=True)):
                    if held:
                        pairs.append((held, (i, t, f)))
                    held = None if look[k] else (i, t, f)
                edits = [edited(p[1], q[1]) for p, q in pairs]
                new = fingerprints(edits, ranks) if edits else []
                cols = list(zip(*[
                    (p[0], len(p[1]), hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest(), p[2], f, likeness(p[2], f), likeness(p[2], q[2]))
                    for (p, q), e, f in zip(pairs, edits, new, strict=True)
                ], strict=True)) or [[]] * 7
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    kinds = [T.LongType(), T.LongType(), *[T.StringType()] * 3, *[T.DoubleType()] * 2]
    return rows.mapInArrow(run, T.StructType([T.StructField(c, k) for c, k in zip(names, kinds, strict=True)]))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return compare_with_next(docs, fit_rarity(docs))
