"""Benchmark decontamination by pigeonhole edit matching.

Text is normalised to lower-case words with single spaces.  An item of m characters may be
found with up to k = floor(rate * m) edits.  Cut into k + 1 pieces, at least one piece of an
occurrence with k edits is untouched, so one pass of an Aho-Corasick automaton over the pieces
of all items finds every candidate place; places of one item on neighbouring diagonals become one
window, and Myers' bit-parallel algorithm gives the least edit distance of the item to any
part of the window.

Bounded memory: the benchmark is cut into parts of about ``PART_CHARS`` characters by a hash of the item
(about 70 bytes a character of a part in each Python worker); one part at a time goes to the tasks as
an automaton.  A benchmark of one part, which is the rule, costs one pass over the corpus without a shuffle;
a larger one costs a pass a part, with the same results.  No limit on hits; a document is handled on
its own.

A piece that many items share (templates: "Which of the following ...") is screened for all of them at once: where it
occurs, the items are run through the text as a trie, whose rows are bit vectors over the text (the same algorithm
turned round), so that what items have in common is worked out once and a branch ends where no place can come near any more.
Only items that pass, and only where they pass, are verified one by one.

Defined results: null or empty texts hold nothing; an item with no word is never found; an item too
short for an edit is only found as whole words; an item that occurs several times in a document gives
one row, its best place (least distance, then leftmost end, then shortest span); equal items are found under
each of their ids; documents with no item give no row in ``find_leaks``.  A null item_id is reported as null.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.llm.shared import col, map_arrow, scratch, table

RATE = 0.08
PART_CHARS = 4_000_000
#: Items that share a piece from which on they are screened together, and rows between looks at how near the best place is.
WIDE, LOOK = 6, 12
#: Characters between the first and last place of a stretch of text that is screened at once.
STRETCH = 1 << 16
_WORD = re.compile(r"\w+")


def normalise(text: str | None) -> str:
    return " ".join(_WORD.findall((text or "").lower()))


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """(offset, piece): the item cut into k + 1 parts of nearly equal length."""
    cuts = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def myers(pattern: str, text: str, peq: dict[str, int] | None = None, anchored: bool = False) -> tuple[int, int]:
    """(least distance of pattern to a part of text, end of the first such part); ``anchored``: to a beginning of text."""
    m = len(pattern)
    if peq is None:
        peq = bit_masks(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    vp, vn, score = full, 0, m
    best, end = m, 0
    for i, c in enumerate(text):
        eq = peq.get(c, 0)
        d0 = ((((eq & vp) + vp) ^ vp) | eq | vn) & full
        hp = vn | (full & ~(d0 | vp))
        hn = d0 & vp
        if hp & top:
            score += 1
        elif hn & top:
            score -= 1
        hp = (hp << 1 | anchored) & full
        vp = ((hn << 1) | (full & ~(d0 | hp))) & full
        vn = hp & d0
        if score < best:
            best, end = score, i + 1
    return best, end


def bit_masks(pattern: str) -> dict[str, int]:
    peq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    return peq


def _heights(vp: int, vn: int, size: int) -> np.ndarray:
    """What bit vectors of steps up and down add up to, place by place."""
    n = -(-size // 8)
    up, down = (np.unpackbits(np.frombuffer(v.to_bytes(n, "little"), np.uint8), bitorder="little", count=size).astype(np.int32) for v in (vp, vn))
    return np.cumsum(up - down)


class Trie:
    """Items (text, edits allowed) in order, ready to be run through texts together."""

    def __init__(self, items: list[tuple[str, int]]):
        self.order = sorted(range(len(items)), key=lambda i: items[i][0])
        self.items = items
        self.shared, before = [], ""
        for i in self.order:
            t = items[i][0]
            n = 0
            while n < min(len(t), len(before)) and t[n] == before[n]:
                n += 1
            self.shared.append(n)
            before = t

    def ends(self, text: str) -> dict[int, list[int]]:
        """For each item that is within its edits of some part of the text: where such parts end."""
        full, peq = (1 << len(text)) - 1, bit_masks(text)
        # states[d]: after d characters of the item; mins: (d, least distance then) at some d.
        states, mins, out = [(0, 0)], [], {}
        for i, shared in zip(self.order, self.shared, strict=True):
            item, k = self.items[i]
            del states[shared + 1 :]
            while mins and mins[-1][0] > shared:
                mins.pop()
            if mins and mins[-1][1] > k:
                continue
            vp, vn = states[-1]
            for d in range(len(states), len(item) + 1):
                eq = peq.get(item[d - 1], 0)
                d0 = ((((eq & vp) + vp) ^ vp) | eq | vn) & full
                hp = vn | (full & ~(d0 | vp))
                hn = d0 & vp
                hp = (hp << 1 | 1) & full
                vp = ((hn << 1) | (full & ~(d0 | hp))) & full
                vn = hp & d0
                states.append((vp, vn))
                if d % LOOK == 0:
                    mins.append((d, d + min(0, int(_heights(vp, vn, len(text)).min()))))
                    if mins[-1][1] > k:
                        break
            else:
                far = len(item) + _heights(vp, vn, len(text))
                at = np.flatnonzero(far <= k)
                if len(at):
                    out[i] = (at + 1).tolist()
        return out


class Benchmark:
    """The items (id, normalised text) of a part of a benchmark, ready to search texts for."""

    def __init__(self, items: list[tuple[int | None, str]], rate: float = RATE):
        # Equal items are searched for once.
        ids: dict[str, list[int | None]] = {}
        for i, t in items:
            if t:
                ids.setdefault(t, []).append(i)
        # An item without an edit to spare must stand between blanks.
        spare = [(i, t, int(rate * len(t))) for t, i in ids.items()]
        self.items = [(i, t if k else f" {t} ", k, bit_masks(t) if k else {}) for i, t, k in spare]
        self.machine = ahocorasick.Automaton()
        at: dict[str, list[tuple[int, int]]] = {}
        for n, (_, t, k, _) in enumerate(self.items):
            for off, p in pieces(t, k):
                at.setdefault(p, []).append((n, off))
        #: The pieces that many items share: where each of these has the piece.
        self.wide: list[dict[int, list[int]]] = []
        self.tries: dict[tuple[int, ...], tuple[list[int], Trie]] = {}
        for p, places in at.items():
            group = None
            if len(places) >= WIDE and all(self.items[n][2] for n, _ in places):
                group = len(self.wide)
                self.wide.append({})
                for n, off in places:
                    self.wide[-1].setdefault(n, []).append(off)
            self.machine.add_word(p, (len(p), places, group))
        spans = [(off + self.items[n][2], len(self.items[n][1]) - off + self.items[n][2]) for of in self.wide for n, offs in of.items() for off in offs]
        self.back, self.ahead = (max((s[i] for s in spans), default=0) for i in (0, 1))
        if at:
            self.machine.make_automaton()

    def search(self, text: str | None) -> list[tuple[int | None, int, int, int]]:
        """(item_id, edits, start, end) in the normalised text, one for each item found."""
        t = normalise(text)
        if not t or not self.items:
            return []
        t = f" {t} "
        starts: dict[int, list[int]] = {}
        wide: list[tuple[int, int]] = []
        for end, (length, places, group) in self.machine.iter(t):
            if group is not None:
                wide.append((end + 1 - length, group))
                continue
            for n, off in places:
                starts.setdefault(n, []).append(end + 1 - length - off)
        for n, start in self._screened(t, sorted(wide)):
            starts.setdefault(n, []).append(start)
        out = []
        for n, found in starts.items():
            ids, p, k, peq = self.items[n]
            if not k:  # the piece is the item, and its blanks don't count
                out += [(i, 0, min(found), min(found) + len(p) - 2) for i in ids]
                continue
            best = None
            found.sort()
            i = 0
            while i < len(found):
                j = bisect_right(found, found[i] + 2 * k + 1, i)
                a, b = max(1, found[i] - k), min(len(t) - 1, found[j - 1] + len(p) + k)
                # An untouched occurrence needs no distance.
                hit = t.find(p, a, b)
                d, e = (0, hit - a + len(p)) if hit >= 0 else myers(p, t[a:b], peq)
                if d <= k and (best is None or d < best[0]):
                    best = (d, a + e)
                i = j
            if best:
                d, e = best
                size = len(p) if d == 0 else myers(p[::-1], t[max(1, e - len(p) - k) : e][::-1], anchored=True)[1]
                out += [(i, d, e - size - 1, e - 1) for i in ids]
        return out

    def _screened(self, t: str, at: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
        """(item, start) for the places ``at`` in t of pieces that many items share, of the items that the text there comes near to."""
        i = 0
        while i < len(at):
            j = i + 1
            while j < len(at) and at[j][0] - self.back <= at[j - 1][0] + self.ahead and at[j][0] - at[i][0] < STRETCH:
                j += 1
            a, b = max(1, at[i][0] - self.back), min(len(t) - 1, at[j - 1][0] + self.ahead)
            numbers, trie = self._trie(tuple(sorted({g for _, g in at[i:j]})))
            near = {numbers[x]: ends for x, ends in trie.ends(t[a:b]).items()}
            for place, g in at[i:j]:
                for n in near.keys() & self.wide[g].keys():
                    p, k = self.items[n][1], self.items[n][2]
                    for off in self.wide[g][n]:
                        # An end of the item's part lies within the window that this place opens.
                        e = bisect_left(near[n], place - off - k - a)
                        if e < len(near[n]) and near[n][e] <= place - off + len(p) + k - a:
                            yield n, place - off
            i = j

    def _trie(self, groups: tuple[int, ...]) -> tuple[list[int], Trie]:
        if groups not in self.tries:
            if len(self.tries) >= 32:
                self.tries.clear()
            numbers = sorted({n for g in groups for n in self.wide[g]})
            self.tries[groups] = numbers, Trie([(self.items[n][1], self.items[n][2]) for n in numbers])
        return self.tries[groups]


def _parts(benchmark: DataFrame, part_chars: int) -> Iterator[list[tuple[int | None, str]]]:
    """The normalised items, part by part; every part is read from the benchmark on its own."""
    items = benchmark.select(col("item_id").cast("long").alias("item_id"), col("text").alias("text"))
    size = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    n = max(1, -(-size // part_chars))
    for part in range(n):
        rows = items.where(F.pmod(F.xxhash64("text"), F.lit(n)) == part).collect()
        yield sorted(((r.item_id, normalise(r.text)) for r in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def _searcher(docs: DataFrame, items: list, rate: float):
    """A function that gives each task its Benchmark, built once a worker."""
    shared = docs.sparkSession.sparkContext.broadcast(items)
    state: dict = {}

    def get() -> Benchmark:
        if "b" not in state:
            state["b"] = Benchmark(shared.value, rate)
        return state["b"]

    return get


def find_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, id_col: str = "doc_id", text_col: str = "text", part_chars: int = PART_CHARS) -> DataFrame:
    """(id_col, item_id, edits, start, end): each benchmark item found in each document, with its place in
    the document's normalised text."""
    names = ["item_id", "edits", "start", "end"]
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *[T.StructField(c, T.LongType()) for c in names]])
    src = docs.select(col(id_col), col(text_col))
    out = None
    for items in _parts(benchmark, part_chars):
        get = _searcher(docs, items, rate)

        def run(batches, get=get):
            for b in batches:
                got = [(i, *hit) for i, t in enumerate(b.column(1).to_pylist()) for hit in get().search(t)]
                cols = list(zip(*got, strict=True)) if got else [[]] * 5
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(cols[0], pa.int64())), *[pa.array(c, pa.int64()) for c in cols[1:]]], names=[id_col, *names])

        found = map_arrow(src, run, schema)
        out = found if out is None else out.unionByName(found)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, id_col: str = "doc_id", text_col: str = "text", part_chars: int = PART_CHARS) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item.

    The flag is worked out in the same pass as the rows, so no join and no shuffle; between the parts of a
    large benchmark what is left is written, so that a task holds one automaton."""
    at = docs.columns.index(text_col)
    out, left = docs, None
    with scratch() as keep:
        for n, items in enumerate(_parts(benchmark, part_chars)):
            if n:
                out = left = table(out, "clean")
            get = _searcher(docs, items, rate)

            def run(batches, get=get):
                for b in batches:
                    yield b.filter(pa.array([not get().search(t) for t in b.column(at).to_pylist()], pa.bool_()))

            out = map_arrow(out, run, docs.schema)
        if left is not None:
            keep(left)
    return out


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
