"""All ten operators and all five stages, with trained models and a real benchmark, on null, empty, long, tied and
repeated rows, empty tables, and columns whose names clash with the operators' own or hold a dot."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidewater.llm import decontam, fingerprint, langid, line_dedup, minhash, mixing, pii, pu_quality, toxicity, url_filter

EXTRA = ["offset", "share", "period", "horizon", "a.b", "a`c", "id", "h", "n", "x", "th", "hub", "g", "text2"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c.replace('`', '``')}` string" for c in EXTRA)
_r = random.Random(3)
LONG = " ".join("".join(_r.choice("abcdefghij") for _ in range(5)) for _ in range(170_000))
TIED = "one line here\nanother line\na third line\nand a fourth one with more words in it"
ROWS = [
    (1, None, "en"), (2, "", "en"), (3, " \n\t\n ", None), (None, "text without an id", "en"), (None, "text without an id", "en"), (None, None, None),
    (4, TIED, "en"), (5, TIED, "en"), (6, TIED, "de"), (7, TIED, None), (7, TIED, None), (7, "the same id, another text", "de"),
    (8, LONG, "en"), (9, "ж\u0000\n\n\n" * 3, "ru"), (10, "item of the benchmark with enough words to be found", "en"), (11, "x " * 100_000, "en"),
]


def docs(spark, rows=ROWS):
    return spark.createDataFrame([(i, t, lang, "ab"[k % 2] if k % 5 else None, None, *EXTRA) for k, (i, t, lang) in enumerate(rows)], SCHEMA)


def many(spark):
    """Rows to train on: good and bad, clean and toxic."""
    r = random.Random(1)
    word = lambda: "".join(r.choice("aeioulnrst") for _ in range(r.randint(2, 8)))
    rows = []
    for i in range(100, 220):
        t = [word() for _ in range(30)]
        t = [w + r.choice(["%%%", "$$$"]) for w in t] if i % 4 == 1 else t
        t[5:5] = ["you", "idiot"] if i % 3 == 0 else []
        rows.append((i, " ".join(t) + ".", "en"))
    return docs(spark, rows)


@pytest.fixture(scope="module")
def models(spark):
    train = many(spark)
    labels = spark.createDataFrame([(i, int(i % 4 != 1), int(i % 3 == 0)) for i in range(100, 220)] + [(None, 1, 1), (500, None, None)], "doc_id long, quality int, toxic int")
    quality, toxic = pu_quality.fit(train, labels), toxicity.fit(train, labels)
    assert quality.weights is not None and toxic.trees is not None
    bench = spark.createDataFrame([(1, "Item of the benchmark, with enough words to be found"), (2, None), (3, ""), (None, "zzz qqq")], "item_id long, text string")
    return {"quality": quality, "toxic": toxic, "bench": bench, "labels": labels, "langs": langid.fit(docs(spark)), "ranks": fingerprint.fit_rarity(docs(spark))}


def outcomes(spark):
    return spark.createDataFrame([("a.com", 1), ("a.com", 0), (None, 1)], "host string, good int")


# Each: what it makes of a table, which of the input's columns it keeps, and whether it keeps every row.
OPERATORS = {
    "1": (lambda d, m: line_dedup.line_dedup(d, counts=True), True),
    "2": (lambda d, m: fingerprint.with_fingerprints(d, m["ranks"]), True),
    "2 next": (lambda d, m: fingerprint.compare_with_next(d, m["ranks"]), False),
    "3": (lambda d, m: langid.identify(d, m["langs"]), True),
    "4": (lambda d, m: url_filter.url_filter(d, outcomes(d.sparkSession), url_col="text"), True),
    "5": (lambda d, m: pii.replace(d, b"key"), True),
    "6": (lambda d, m: decontam.decontaminate(d, m["bench"]), None),
    "6 parts": (lambda d, m: decontam.decontaminate(d, m["bench"], part_chars=10), None),
    "7": (lambda d, m: minhash.near_duplicates(d), False),
    "7 dedup": (lambda d, m: minhash.near_dedup(d), None),
    "8": (lambda d, m: mixing.mix(d, {"a": 0.3, "b": 0.7}, block_chars=1000), True),
    "9": (lambda d, m: pu_quality.with_quality(d, m["quality"]), True),
    "10": (lambda d, m: toxicity.with_toxicity(d, m["toxic"]), True),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_operator(spark, models, name):
    run, keeps = OPERATORS[name]
    src = docs(spark)
    out = run(src, models)
    rows = out.collect()
    if keeps or keeps is None:
        assert out.columns[: len(src.columns)] == src.columns
        assert all(r["a.b"] == "a.b" and r["a`c"] == "a`c" and r.offset == "offset" for r in rows)
    if keeps is not None:
        assert len(rows) == len(ROWS)
        assert sorted(str(r.doc_id) for r in rows) == sorted(str(i) for i, _, _ in ROWS)
    elif name.startswith("6"):
        assert {r.doc_id for r in rows} == {i for i, _, _ in ROWS} - {10} and len(rows) == len(ROWS) - 1
    else:
        assert sorted(str(r.doc_id) for r in rows) == sorted(map(str, [None, None, None, 1, 2, 3, 4, 7, 8, 9, 10, 11]))
        assert [r.text for r in rows if r.doc_id == 7] == [TIED] or [r.text for r in rows if r.doc_id == 7] == ["the same id, another text"]
    # Equal rows have equal results, and the same at every run.
    assert sorted(map(str, rows)) == sorted(map(str, run(src, models).collect()))
    empty = run(docs(spark, []), models)
    assert empty.columns == out.columns and empty.count() == 0


@pytest.mark.parametrize("k", range(5))
def test_stage(spark, models, k, tmp_path):
    models["labels"].write.parquet(f"{tmp_path}/labels.parquet")
    models["bench"].write.parquet(f"{tmp_path}/benchmark.parquet")
    stage = corpus_pipeline.STAGES[k][1]
    src = docs(spark).unionByName(many(spark))
    out = stage(spark, src, str(tmp_path))
    assert out.columns[: len(src.columns)] == src.columns and (k == 4 or out.columns == src.columns)
    assert 0 < out.count() <= src.count()
    assert stage(spark, docs(spark, []), str(tmp_path)).count() == 0


def test_results_of_edges(spark, models):
    got = {}
    for name, run in ((9, pu_quality.with_quality), (10, toxicity.with_toxicity)):
        model = models["quality" if name == 9 else "toxic"]
        got[name] = {(r.doc_id, r.text): r.score for r in run(docs(spark), model).collect()}
        scores = got[name]
        assert all(0 <= s <= 1 for s in scores.values()) and scores[1, None] == scores[2, ""] and scores[4, TIED] == scores[5, TIED] == scores[6, TIED]
    found = {r.item_id: r for r in decontam.find_leaks(docs(spark), models["bench"]).collect()}
    assert set(found) == {1} and found[1].doc_id == 10 and (found[1].edits, found[1].start, found[1].end) == (0, 0, 51)
    langs = {(r.doc_id, r.text): r.lang_pred for r in langid.identify(docs(spark), models["langs"]).collect()}
    assert langs[1, None] == langs[2, ""] == langs[3, " \n\t\n "] == "und" and langs[9, "ж\u0000\n\n\n" * 3] == "ru"
    # A hot id in the tables to learn from counts once.
    rows = docs(spark, [(1, TIED, None)] * 30 + [(2, "%%% $$$", None)])
    labels = spark.createDataFrame([(1, 1)] * 20 + [(1, 0)] * 5 + [(2, 0)] * 3, "doc_id long, quality int")
    seen = []
    keep = pu_quality.expand
    pu_quality.expand = lambda x, *a: seen.append(len(x)) or keep(x, *a)
    try:
        pu_quality.fit(rows, labels)
    finally:
        pu_quality.expand = keep
    assert seen[0] == 1 and max(seen) <= 31


def test_line_dedup_drops_only_what_it_emptied(spark):
    rows = [(1, TIED, None), (2, TIED, None), (3, "", None), (4, None, None), (5, " \n \n ", None)]
    got = {r.doc_id for r in line_dedup.line_dedup(docs(spark, rows), emptied=False).collect()}
    assert got == {1, 3, 4, 5}
    assert line_dedup.line_dedup(docs(spark, rows)).where(F.col("doc_id") == 2).first().text == ""
