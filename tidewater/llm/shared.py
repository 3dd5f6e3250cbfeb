"""Whole-text hashing, per-text functions and connected components; the tables of the shared folder by their names here."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.tables import forget, scratch, shared_dir, table

__all__ = ["forget", "scratch", "shared_dir", "table"]
_U = np.uint64


def col(name: str) -> Column:
    """The column of exactly this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def columns(df: DataFrame, *without: str) -> list[Column]:
    """All columns of ``df`` but the named ones."""
    return [col(c) for c in df.columns if c not in without]


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow for columns of any names, which itself takes none with dots or backticks."""
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(pa.RecordBatch.from_arrays(b.columns, names=names) for b in batches)
        finally:
            give_back()

    return df.toDF(*[f"c{i}" for i in range(len(names))]).mapInArrow(run, schema)


def give_back() -> None:
    """What a task has freed goes back to the system: workers are kept for later tasks, and with them what
    their allocators hold."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def per_text(fn: Callable[[str | None], tuple], schema: pa.Schema, keep: list[str], text_col: str = "text", rows: int = 256):
    """A mapInArrow function: ``keep`` columns of the input, then ``fn(text)``'s values, in small batches."""
    new = [f for f in schema if f.name not in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                b = whole.slice(at, rows)
                got = [fn(t) for t in b.column(text_col).to_pylist()]
                cols = [b.column(c) for c in keep]
                cols += [pa.array([g[i] for g in got], type=f.type) for i, f in enumerate(new)]
                yield pa.RecordBatch.from_arrays(cols, names=keep + [f.name for f in new])
        _tables.clear()
        give_back()

    return run


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, element by element."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(14, int(n).bit_length())
    if size not in _tables:
        _tables.clear()
        with np.errstate(over="ignore"):
            _tables[size] = tuple(np.cumprod(np.concatenate([[_U(1)], np.full(size - 1, _U(b), dtype=_U)]), dtype=_U) for b in (_BASE, _INV))
    return _tables[size]


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash of each word [^ \\t-\\r]+ of the text, its A-Z lower-cased."""
    if not text:
        return np.empty(0, _U)
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), np.uint8)
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).view(np.int8)))
    start, end = edge[0::2], edge[1::2]
    if not len(start):
        return np.empty(0, _U)
    with np.errstate(over="ignore"):
        pw, inv = _powers(len(raw) + 1)
        run = np.concatenate([[_U(0)], np.cumsum((raw.astype(_U) + _U(1)) * pw[: len(raw)], dtype=_U)])
        return mix64((run[end] - run[start]) * inv[start] + (end - start).astype(_U) * _U(0xD6E8FEB86659FD93))


def shingle_hashes(text: str | None, k: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of k-word shingles; of the whole sequence if it is shorter."""
    w = word_hashes(text)
    if not len(w):
        return w
    with np.errstate(over="ignore"):
        n = max(1, len(w) - k + 1)
        h = np.full(n, _U(min(k, len(w))) * _U(0xA24BAED4963EE407), _U)
        for j in range(min(k, len(w))):
            h = mix64(h + w[j : j + n] * _U(0x9FB21C651E98DF25))
    return np.unique(h)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node reachable, for every node of ``edges`` (a, b).

    Alternating large-star and small-star steps: the edges of each node move to its least
    neighbour, so that even long chains shrink in about log(length) rounds.  Every step is a
    pre-aggregated minimum and a join with one row a node; both are written tables, so AQE can
    split a node with very many edges.  It ends when all edges are stars around a least node.
    """
    cur = table(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while not _all_stars(cur):
        both = cur.unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = table(both.groupBy("a").agg(F.min("b").alias("m")), "least")
        near = least.select("a", F.least("a", "m").alias("m"))
        large = table(both.join(near, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), "large")
        least2 = table(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        moved = large.join(least2, "a").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b"))
        nxt = table(moved.unionByName(least2.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), "edges")
        forget(cur, least, large, least2)
        cur = nxt
    pairs = cur.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return pairs.unionByName(cur.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _all_stars(edges: DataFrame) -> bool:
    """Whether no node hangs from two others, or from one that hangs itself."""
    seen = edges.select("a", F.lit(1).alias("down")).unionByName(edges.select(F.col("b").alias("a"), F.lit(0).alias("down")).distinct())
    per = seen.groupBy("a").agg(F.sum("down").alias("down"), F.count("*").alias("n"))
    return not per.where("down > 1 or (down = 1 and n > 1)").head(1)
