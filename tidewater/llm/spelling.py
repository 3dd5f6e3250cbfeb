"""Spelling variants by Aho-Corasick automata over the halves of words.

Two words one edit apart share the first half of either (the edit is in the rest) or its second half, at the
same edge.  So every word of the vocabulary puts its two halves into an automaton, and every word is
run through the automata: a hit of a first half counts at the word's start, of a second half at its end, for
words whose length differs by one at most; what is left is verified.

Automaton shards.  A half and the words that it can be found in have the same three characters at the outer
edge (first or last), so a word's halves and its scans go to the shards of its two edges: each word
is scanned twice, however many shards there are.  A shard has about ``SHARD_WORDS`` / 2 words; one with more
than ``SHARD_WORDS`` words, because of a common beginning or ending, is cut into m parts of halves times m
parts of scanned words, which is exact and keeps every task at two parts at most.

Words are counted in the JVM: runs of letters are taken from whole texts and added up per task before
the shuffle.  Forms point to ever more frequent words, so roots come from pointer doubling, in about
log2(log5(largest count)) joins.

Defined results: null texts have no words; a null id reads as an empty one; rows of one id and text count each;
words of fewer than ``LEAST_CHARS`` code points or ``LEAST_N`` occurrences are left out; ties of forms go
to the word that comes first in code-point order; an empty table gives an empty result; other columns don't matter.
"""

from __future__ import annotations

import string
from collections import defaultdict
from collections.abc import Callable

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.shared import col, forget, scratch, table

LEAST_CHARS, LEAST_N, RATIO = 6, 5, 5
SHARD_WORDS = 40_000
EDGE = 3
#: Characters that one block of comparisons holds.
_BLOCK = 1 << 22


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, run): the maximal runs of letters of every text, A-Z in lower case; ids as text."""
    lower = F.translate(col(text_col), string.ascii_uppercase, string.ascii_lowercase)
    found = F.regexp_extract_all(lower, F.lit("[a-zÀ-ÿ]+"), F.lit(0))
    return docs.select(F.coalesce(col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(found).alias("run"))


def count_words(docs: DataFrame, edit: Callable[[Column, Column], Column] | None = None, least_chars: int = LEAST_CHARS, least_n: int = LEAST_N, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n); ``edit``, of id and run, may change a run first."""
    word = F.col("run") if edit is None else edit(F.col("id"), F.col("run"))
    found = runs(docs, id_col, text_col).select(word.alias("word")).where(F.length("word") >= least_chars)
    return found.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_n)


def halves(word: str) -> tuple[str, str]:
    return word[: len(word) // 2], word[len(word) // 2 :]


class Shard:
    """An automaton over the halves of some words, ready to scan others."""

    def __init__(self, words: list[str], counts: list[int], edges: list[tuple[bool, bool]] | None = None):
        """``edges``: for each word, whether its first and its second half are held here."""
        held: dict[tuple[bool, str], dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for i, w in enumerate(words):
            for last, half in enumerate(halves(w)):
                if edges is None or edges[i][last]:
                    held[bool(last), half][len(w)].append(i)
        self.words, self.counts = words, counts
        # Words of Latin letters are one byte a character.
        self.groups = [{n: np.array(at) for n, at in by.items()} for by in held.values()]
        self.letters = {n: np.frombuffer("".join(words[i] for i in at).encode("latin-1"), np.uint8).reshape(-1, n) for n, at in self._by_length().items()}
        self.row = {i: r for at in self._by_length().values() for r, i in enumerate(at)}
        at: dict[str, list[tuple[bool, int]]] = {}
        for g, (last, half) in enumerate(held):
            at.setdefault(half, []).append((last, g))
        self.heads = [None if last else half for last, half in held]
        self.machine = ahocorasick.Automaton()
        for half, groups in at.items():
            self.machine.add_word(half, (len(half), groups))
        if at:
            self.machine.make_automaton()

    def _by_length(self) -> dict[int, list[int]]:
        out: dict[int, list[int]] = defaultdict(list)
        for i, w in enumerate(self.words):
            out[len(w)].append(i)
        return out

    def scan(self, words: list[str], edges: list[tuple[bool, bool]] | None = None) -> list[tuple[str, int, int, str]]:
        """(word, number of near words found, largest count among them, that word) for those with any.

        A pair that shares both halves is only counted by the first.  ``edges``: for each word, whether its
        beginning and its end are to be looked at here."""
        if not self.heads:
            return []
        hits: dict[tuple[int, int], list[int]] = defaultdict(list)
        for i, w in enumerate(words):
            first, second = (True, True) if edges is None else edges[i]
            for end, (size, groups) in self.machine.iter(w):
                for last, g in groups:
                    if (second and end == len(w) - 1) if last else (first and end == size - 1):
                        hits[g, len(w)].append(i)
        number, best = [0] * len(words), [(0, "")] * len(words)
        for (g, n), at in hits.items():
            scanned = np.frombuffer("".join(words[i] for i in at).encode("latin-1"), np.uint8).reshape(-1, n)
            for m in (n - 1, n, n + 1):
                held = self.groups[g].get(m)
                if held is None:
                    continue
                letters = self.letters[m][[self.row[i] for i in held]]
                step = max(1, _BLOCK // letters.size)
                for a in range(0, len(at), step):
                    for q, h in zip(*np.nonzero(one_edit(scanned[a : a + step], letters)), strict=True):
                        i, j = at[a + q], held[h]
                        if self.heads[g] is None and words[i].startswith(halves(self.words[j])[0]):
                            continue
                        number[i] += 1
                        if (-self.counts[j], self.words[j]) < (-best[i][0], best[i][1]):
                            best[i] = (self.counts[j], self.words[j])
        return [(w, k, *b) for w, k, b in zip(words, number, best, strict=True) if k]


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each row of ``a`` (words of n letters) and of ``b`` (of n - 1, n or n + 1), whether exactly one edit parts them."""
    n, m = a.shape[1], b.shape[1]
    if n == m:
        return (a[:, None, :] != b[None, :, :]).sum(axis=2, dtype=np.int32) == 1
    if n > m:
        return one_edit(b, a).T
    # The longer one's extra letter stands behind as many equal ones as there are, or before.
    front = a[:, None, :] == b[None, :, :n]
    back = a[:, None, :] == b[None, :, 1:]
    lead = np.where(front.all(axis=2), n, front.argmin(axis=2))
    trail = np.where(back.all(axis=2), n, back[:, :, ::-1].argmin(axis=2))
    return lead + trail >= n


def near_words(words: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(word, n_near, form_n, form) for words (word, n) that have near words: how many, and the one of largest n."""
    total = words.count()
    shards = max(1, -(-4 * total // shard_words))
    edge = lambda last: F.struct(F.lit(last).alias("last"), F.pmod(F.xxhash64(F.lit(last), F.substring("word", -EDGE if last else 1, EDGE)), F.lit(shards)).cast("int").alias("shard"))
    dealt = words.select("word", "n", F.explode(F.array(edge(0), edge(1))).alias("e")).select("word", "n", "e.last", "e.shard")
    sizes = dealt.groupBy("shard").agg(F.count("*").alias("size")).select("shard", F.ceil(F.col("size") / shard_words).cast("int").alias("m"))
    part = lambda salt: F.pmod(F.xxhash64("word", F.lit(salt)), F.col("m")).cast("int")
    # In an uncut shard a row is both held and scanned.
    every = F.sequence(F.lit(0), F.col("m") - 1)
    cell = lambda i, j, held, scanned: F.struct(i.alias("i"), j.alias("j"), F.lit(held).alias("held"), F.lit(scanned).alias("scanned"))
    cells = F.when(F.col("m") == 1, F.array(cell(F.lit(0), F.lit(0), True, True))).otherwise(
        F.concat(F.transform(every, lambda j: cell(part("held"), j, True, False)), F.transform(every, lambda i: cell(i, part("scanned"), False, True)))
    )
    rows = dealt.join(sizes, "shard").select("word", "n", "last", "shard", F.explode(cells).alias("c")).select("word", "n", "last", "shard", "c.*")

    def run(t: pa.Table) -> pa.Table:
        held, counts, scanned = {}, {}, {}
        for w, n, last, h, s in zip(*(t.column(c).to_pylist() for c in ("word", "n", "last", "held", "scanned")), strict=True):
            counts[w] = n
            for to, wanted in ((held, h), (scanned, s)):
                if wanted:
                    a, b = to.get(w, (False, False))
                    to[w] = (a or not last, b or bool(last))
        shard = Shard(list(held), [counts[w] for w in held], list(held.values()))
        got = shard.scan(list(scanned), list(scanned.values()))
        return pa.table({k: pa.array([g[i] for g in got], kind) for i, (k, kind) in enumerate((("word", pa.string()), ("k", pa.int64()), ("form_n", pa.int64()), ("form", pa.string())))})

    found = rows.groupBy("shard", "i", "j").applyInArrow(run, "word string, k long, form_n long, form string")
    best = F.min(F.struct((-F.col("form_n")).alias("less"), F.col("form").alias("form")))
    return found.groupBy("word").agg(F.sum("k").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.less")).alias("form_n"), F.col("b.form").alias("form"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root, moved) for words (word, form): the end of each one's chain of forms."""
    cur = table(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots")
    while cur.where("moved").head(1):
        on = cur.select(F.col("word").alias("root"), F.col("root").alias("next"))
        nxt = cur.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        nxt = table(nxt, "roots")
        forget(cur)
        cur = nxt
    return cur


def group_spellings(words: DataFrame, ratio: int = RATIO, shard_words: int = SHARD_WORDS) -> DataFrame:
    """Words (word, n) with their form and root: (word, form, root, n, n_near, form_n)."""
    with scratch() as keep:
        words = keep(table(words.select("word", "n"), "words"))
        near = near_words(words, shard_words)
        enough = F.col("form_n") >= ratio * F.col("n")
        near = keep(table(words.join(near, "word").select("word", "n_near", F.when(enough, F.col("form")).alias("form"), F.when(enough, F.col("form_n")).alias("form_n")), "near"))
        ends = keep(roots(near.where("form IS NOT NULL"))).drop("moved")
    out = words.join(near, "word", "left").join(ends, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")


def planted(id_: Column, run: Column, every: int = 199) -> Column:
    """A run loses one code point where ``every`` divides the checksum of id and run."""
    h = F.crc32(F.concat(id_, F.lit(":"), run).cast("binary"))
    k = (h % F.length(run)).cast("int")
    return F.when(h % every == 0, F.concat(run.substr(F.lit(1), k), run.substr(k + 2, F.length(run)))).otherwise(run)


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return group_spellings(count_words(docs, planted))
