"""Spelling variants against brute force, the edit test, shards that are cut, edge cases."""

import random
import re
import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.compare import SF
from tidewater.llm import spelling as S
from tidewater.llm.shared import table

COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]
_LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def edits(word):
    """All words at one edit, over the letters that occur."""
    abc = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xC0, 0x100)))
    for i in range(len(word) + 1):
        yield from (word[:i] + c + word[i:] for c in abc)
        if i < len(word):
            yield word[:i] + word[i + 1 :]
            yield from (word[:i] + c + word[i + 1 :] for c in abc if c != word[i])


def brute_count(rows, every=199):
    n = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(_LOW)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if every and h % every == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            n[run] += len(run) >= 6
    return {w: k for w, k in n.items() if k >= 5}


def brute(n):
    near = {w: {u for u in edits(w) if u in n} for w in n}
    best = {w: min(us, key=lambda u: (-n[u], u)) for w, us in near.items() if us}
    form = {w: u for w, u in best.items() if n[u] >= 5 * n[w]}
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return sorted(out)


def collected(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


def test_whole_table_by_brute_force(spark):
    for sf in (SF, "/root/testdata/sf0.01"):
        rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
        want = brute(brute_count(rows))
        got = S.op13(spark, sf)
        assert got.columns == COLUMNS and collected(got) == want
        assert any(r[1] for r in want)


def test_cut_shards_and_chains(spark):
    r = random.Random(7)
    # Half of all words begin alike, and half of these end alike: the shards of these edges are cut.
    n = {}
    for i in range(1500):
        w = "".join(r.choice("ab") for _ in range(r.randint(3, 6)))
        n[("xyz" if i % 2 else r.choice("pqr") * 3) + w + ("uvw" if i % 4 < 2 else "")] = int(10 ** r.uniform(0.7, 5))
    n |= {"chainnn": 5, "chainna": 25, "chainba": 125, "chaicba": 625, "chdicba": 3125, "ehdicba": 15625}
    words = table(spark.createDataFrame(list(n.items()), "word string, n long"), "t")
    want = brute(n)
    assert max(len(r) and r[4] for r in want) > 3
    for size in (S.SHARD_WORDS, 100, 17):
        assert collected(S.group_spellings(words, shard_words=size)) == want
    assert {r[0]: r[2] for r in want}["chainnn"] == "ehdicba"


def test_edges(spark):
    words = "Ärger schön"  # not in the vocabulary: lower-cased in A-Z only
    rows = [(1, None), (2, ""), (3, "1 2 ,"), (None, "Straße " * 7), (None, "Straße " * 7), (4, "STRASSES " * 9), (5, "abcdef " * 4), (6, "x" * 200_000), (7, words), (8, ("abcdefg " * 50_000))]
    docs = spark.createDataFrame([(i, t, "a", 1, "b") for i, t in rows], "doc_id long, text string, word string, n int, `a.b` string")
    got = S.group_spellings(S.count_words(docs, S.planted))
    assert collected(got) == brute(brute_count(rows))
    none = S.group_spellings(S.count_words(docs.limit(0), S.planted))
    assert none.columns == COLUMNS and none.count() == 0
    assert collected(S.group_spellings(S.count_words(docs))) == brute(brute_count(rows, None))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("abÿ", min_size=3, max_size=7), min_size=2, max_size=12, unique=True))
def test_one_edit(words):
    for n in {len(w) for w in words}:
        for m in (n - 1, n, n + 1):
            a, b = ([w for w in words if len(w) == k] for k in (n, m))
            if a and b:
                grid = S.one_edit(*(np.frombuffer("".join(x).encode("latin-1"), np.uint8).reshape(len(x), -1) for x in (a, b)))
                assert [[y in set(edits(x)) for y in b] for x in a] == grid.tolist()


def test_pair_that_shares_both_halves_counts_once():
    shard = S.Shard(["aaaaaa", "aaaaaaa", "abcabc"], [5, 50, 7])
    assert sorted(shard.scan(["aaaaaa", "aaaaaaa", "abcabc", "abcxabc"])) == [("aaaaaa", 1, 50, "aaaaaaa"), ("aaaaaaa", 1, 5, "aaaaaa"), ("abcxabc", 1, 7, "abcabc")]
