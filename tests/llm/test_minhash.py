"""Near-duplicates against brute force: small cases, edge cases, and groups larger than the number of centres."""

import random
import re

import pytest

from tidewater.llm import minhash


def brute(rows, k, percent=80):
    """{id: (size, component)} by comparing all pairs of full sets."""
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                ra, rb = root(a), root(b)
                up[max(ra, rb)] = min(ra, rb)
    return {i: (len(sets[i]), root(i)) for i in ids}


def found(spark, rows, **kw):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(df, **kw).collect()}


def family(seed, size, words=60, edits=12, cut=False):
    """Edited copies of one text: words replaced (from few), or the end cut off."""
    r = random.Random(seed)
    base = [f"w{seed}x{i}" for i in range(words)]
    out = []
    for _ in range(size):
        t = base[: r.randint(words // 4, words)] if cut else list(base)
        if not cut:
            for _ in range(r.randint(0, edits)):
                t[r.randrange(words)] = f"e{r.randrange(4)}"
        out.append(" ".join(t))
    return out


def test_small_cases(spark):
    a = " ".join(f"a{i}" for i in range(40))
    rows = [
        (5, a), (3, a.upper()), (9, a + " tail"), (1, "one two three four five six"), (2, "One  two\tthree four\nfive six"),
        (10, None), (11, ""), (12, " \n\t "), (13, "short one"), (14, "short ONE"), (15, "short other"),
        (16, "x " * 3000), (17, "x x x x x"), (18, "één twee drie vier vijf"), (19, "Één twee drie vier vijf"),
    ]
    got = found(spark, rows, k=4)
    assert got == brute(rows, 4)
    assert got[9][1] == 3 and got[10] == (0, 10) and got[13][1] == 13 and got[14][1] == 13 and got[17][1] == 16 and got[19][1] == 19


@pytest.mark.parametrize("centres", [3, 128])
@pytest.mark.parametrize("cut", [False, True])
def test_groups_with_few_and_many_centres(spark, monkeypatch, centres, cut):
    monkeypatch.setattr(minhash, "CENTRES", centres)
    texts = family(1, 70, cut=cut) + family(2, 30, cut=cut) + family(3, 8, words=9, edits=2)
    rows = [(i * 7 % 1000, t) for i, t in enumerate(texts)]
    assert found(spark, rows, k=4) == brute(rows, 4)


def test_empty_nulls_repeats_and_clashing_names(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert minhash.near_duplicates(empty).collect() == []
    t = " ".join(f"q{i}" for i in range(20))
    df = spark.createDataFrame([(None, t, 1, "x"), (4, t, 2, "y"), (4, t, 3, "z"), (6, t, None, None)], "doc_id long, text string, n int, hub string")
    rows = minhash.near_duplicates(df).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in rows if r.doc_id) == [(4, 4, True), (4, 4, True), (6, 4, False)]
    assert [(r.component_id, r.kept) for r in rows if r.doc_id is None] == [(None, True)]
    kept = minhash.near_dedup(df)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["4", "None"]


def test_chain_is_one_component(spark):
    from tidewater.llm.shared import connected_components

    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert all(got[i] == 0 for i in range(61)) and got[101] == 100
