"""The training-data operators on small tables: edge cases, brute force, round trips, held-out accuracy."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tests.compare import SF, check, connect
from tidewater.llm import decontam, fingerprint, langid, line_dedup, mixing, pii, pu_quality, queries, toxicity, url_filter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, host string, h long, id int"


def docs(spark, rows):
    """Rows (doc_id, text[, source]) with further columns whose names clash with the operators' own."""
    full = [(r[0], r[1], None, r[2] if len(r) > 2 else None, None, "s", "h", 1, 2) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


EDGE = [(1, None), (2, ""), (None, "no id\nat all"), (3, "a\nb\nc\nd"), (3, "a\nb\nc\nd"), (4, "x " * 20000), (5, "ж\u0000\n\n\n" * 3)]


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_against_sql(spark, name):
    check(spark, connect(), queries.QUERIES[name], queries.ORACLE[name])


# ---- line dedup


def brute_lines(rows, window=3):
    first, out = {}, {}
    for i, t in sorted(rows):
        lines = t.split("\n")
        gone = set()
        for p in range(len(lines) - window + 1):
            w = tuple(lines[p : p + window])
            if all(not x.strip(" ") for x in w):
                continue
            if first.setdefault(w, (i, p)) != (i, p):
                gone.update(range(p, p + window))
        out[i] = "\n".join(x for p, x in enumerate(lines) if p not in gone)
    return out


def test_line_dedup(spark):
    r = random.Random(5)
    rows = [(i, "\n".join(r.choice(["p", "q", "", "longer line", "z"]) for _ in range(r.randint(1, 30)))) for i in range(60)]
    got = {x.doc_id: x.text for x in line_dedup.line_dedup(docs(spark, rows)).collect()}
    assert got == brute_lines(rows)


def test_line_dedup_edges(spark):
    out = line_dedup.line_dedup(docs(spark, EDGE), counts=True)
    assert out.columns[:9] == docs(spark, []).columns
    got = sorted((str(r.doc_id), r.text, r.n_removed) for r in out.collect())
    assert len(got) == len(EDGE)
    assert ("1", None, 0) in got and ("2", "", 0) in got and got.count(("3", "a\nb\nc\nd", 0)) == 2
    assert line_dedup.line_dedup(docs(spark, [])).count() == 0


# ---- fingerprints


def test_fingerprints(spark):
    r = random.Random(1)
    text = " ".join("".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(400))
    other = " ".join("".join(r.choice("klmnopqrst") for _ in range(6)) for _ in range(400))
    rows = [(9, text), (7, text), (5, other), (3, None), (1, "tiny")]
    df = docs(spark, rows)
    got = {x.doc_id: x for x in fingerprint.compare_with_next(df, fingerprint.fit_rarity(df)).collect()}
    order = sorted(rows, reverse=True)
    for k, (i, t) in enumerate(order):
        t, following = t or "", order[(k + 1) % len(order)][1] or ""
        n = len(t) // 2
        edited = t[: len(t) - n] + following[:n]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
    assert got[9].fingerprint == got[7].fingerprint and got[9].near_next == 1 and got[3].fingerprint == "0:"
    assert got[7].near_next < 0.1 and 0.2 < got[7].near_edited < 0.8 and got[3].near_edited == 1
    edge = docs(spark, EDGE)
    assert fingerprint.compare_with_next(edge, fingerprint.fit_rarity(edge)).count() == len(EDGE)
    none = docs(spark, [])
    assert fingerprint.compare_with_next(none, fingerprint.fit_rarity(none)).count() == 0


# ---- language ID


def test_langid_held_out_and_edges(spark):
    out = langid.op3(spark, SF)
    known = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "text").where("length(text) > 40")
    hits = out.where("held_out").join(known, "doc_id").where("lang is not null").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert hits > 0.9
    model = langid.fit(spark.createDataFrame([("the cat and the dog " * 9, "en"), ("der hund und die katze " * 9, "de")], "text string, lang string"))
    rows = langid.identify(docs(spark, [*EDGE, (8, "1234 !?"), (9, "the dog and the cat " * 30 + "die katze und der hund " * 10)]), model).collect()
    got = {r.doc_id: r for r in rows}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (1, 2, 8))
    assert {x.lang for x in got[9].langs} == {"en", "de"} and got[9].lang_pred == "en" and 0.5 < got[9].score < 1
    empty = langid.fit(spark.createDataFrame([], "text string, lang string"))
    assert {r.lang_pred for r in langid.identify(docs(spark, EDGE), empty).collect()} == {"und"}


# ---- URL filter


def test_url_filter(spark):
    urls = [None, "", "no scheme", "HTTP://Sub.Example.ORG/es/1?x", "https://example.org/en/12", "http://a.com/fr/x", "http://b.com/de/", "http://spam.net/1", "http://new.spam.net", "http://good.net/#f"]
    pages = spark.createDataFrame([(i, u, "v") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    seen = spark.createDataFrame([("spam.net", 0)] * 60 + [("good.net", 1)] * 60 + [("x.net", None)], "host string, good int")
    got = {r.page_id: r for r in url_filter.url_filter(pages, seen).collect()}
    assert [got[i].host for i in (0, 1, 2)] == ["", "", ""] and got[3].host == "sub.example.org" and got[3].path == "/es/1"
    assert (got[3].rule, got[3].verdict) == ("example.org/es/", "block") and got[4].rule == "example.org/en/1" and got[5].rule == "com/fr/" and got[6].verdict == "block"
    assert got[7].verdict == "block" and got[8].verdict == "block" and got[9].verdict == "allow" and got[9].rule is None
    none = spark.createDataFrame([], "host string, good int")
    assert {r.verdict for r in url_filter.url_filter(pages, none).where("rule is null").collect()} == {"allow"}


# ---- PII


def test_pii_surrogates(spark):
    text = "Ask Ms. Anna Stone (anna.stone@mail.example.com, +49 151 2345678) at 10.1.2.3, card 4111 1111 1111 1111. Anna Stone agreed."
    rows = [(6, text), (7, "Again anna.stone@mail.example.com"), (8, "Mr. Peter Stone wrote other@mail.example.com"), *EDGE]
    got = {r.doc_id: r for r in pii.replace(docs(spark, rows), b"key").collect()}
    out = got[6].text
    assert not any(x in out for x in ("Anna Stone", "anna.stone@", "2345678", "10.1.2.3", "4111 1111"))
    name = [m for m in out.split(" (")[0].split()][2:4]
    assert name[0] in pii.GIVEN["f", "latin"] and out.count(" ".join(name)) == 2
    mail = got[7].text.removeprefix("Again ")
    assert mail in out and mail.count("@") == 1 and mail.endswith(".com") and mail not in got[8].text
    card = next(out[s:e] for s, e, k in pii.find(out) if k == "card")
    assert pii._luhn(card.replace(" ", "")) and len(card) == 19
    assert got[6].n_entities == 6 and got[1].text is None and got[2].text == "" and got[4].text == "x " * 20000
    assert pii.replace(docs(spark, []), b"key").count() == 0


def test_pii_is_one_to_one():
    seen = {pii._spell(f"{i:03d}", b"k", "t") for i in range(1000)}
    assert len(seen) == 1000


# ---- decontamination


def edit_distance_within(item, text):
    """Least distance of the item to any part of the text, by the full table."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def test_decontamination_against_the_full_table(spark):
    r = random.Random(2)
    word = lambda: "".join(r.choice("abc") for _ in range(r.randint(1, 4)))
    items = [(i, " ".join(word() for _ in range(8))) for i in range(12)] + [(90, None), (91, " ?! "), (92, "zz yy zz yy")]
    rows = []
    for i in range(80):
        t = [word() for _ in range(20)]
        t[4:12] = list(r.choice(items[:12])[1])
        t = "".join(t[:4]) + " " + "".join(t[4:])
        t = list(t)
        for _ in range(r.randint(0, 4)):
            t[r.randrange(len(t))] = r.choice("abc ")
        rows.append((i, "".join(t)))
    want = set()
    for i, t in rows:
        for n, item in items:
            item = decontam.normalise(item)
            d = edit_distance_within(item, decontam.normalise(t)) if item else 99
            if item and d <= int(0.08 * len(item)):
                want.add((i, n, d))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(x.doc_id, x.item_id, x.edits) for x in decontam.find_leaks(docs(spark, rows), bench).collect()}
    assert got == want and want
    kept = {x.doc_id for x in decontam.decontaminate(docs(spark, rows), bench).collect()}
    assert kept == {i for i, _ in rows} - {i for i, _, _ in want}
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.decontaminate(docs(spark, EDGE), none).count() == len(EDGE) and decontam.find_leaks(docs(spark, []), bench).count() == 0


# ---- mixing


def test_pfair_deviation_stays_under_one_block(spark):
    weights = {"a": 5, "b": 3, "c": 1}
    plan = spark.createDataFrame(sorted(weights.items()), "source string, share long")
    order = [r.source for r in mixing.schedule(plan).orderBy("offset").collect()]
    assert len(order) == 9 and {s: order.count(s) for s in weights} == weights
    for t in range(1, 10):
        for s, w in weights.items():
            assert abs(order[:t].count(s) - t * w / 9) < 1


def test_mixing_edges(spark):
    rows = [(i, "y" * 50, "ab"[i % 2]) for i in range(40)] + [(100, None, None), (101, "q", "unlisted"), (None, "r", "a"), (5, "y" * 50, "b")]
    got = mixing.mix(docs(spark, rows), {"a": 2, "b": 1, "gone": 4}, block_chars=100).collect()
    assert len(got) == len(rows)
    assert all(r.mix_slot is None and not r.mixed for r in got if r.source in (None, "unlisted"))
    slots = {(r.source, r.mix_block): r.mix_slot for r in got if r.mix_slot is not None}
    assert len(set(slots.values())) == len(slots)
    assert mixing.mix(docs(spark, []), {"a": 1}).count() == 0


# ---- classifiers


def auc(rows):
    rows = sorted(rows)
    pos = sum(y for _, y in rows)
    ranks = sum(k + 1 for k, (_, y) in enumerate(rows) if y)
    return (ranks - pos * (pos + 1) / 2) / (pos * (len(rows) - pos))


@pytest.mark.parametrize(("op", "label", "module"), [("op9_quality", "quality", pu_quality), ("op10_toxicity", "toxic", toxicity)])
def test_classifiers(spark, op, label, module):
    sf = SF.replace("0.001", "0.01")
    out = queries.QUERIES[op](spark, sf)
    assert out.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    known = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", label)
    rows = [(r.score, r[1]) for r in out.where("held_out").join(known, "doc_id").select("score", label).collect()]
    assert auc(rows) > 0.85
    fit, apply = (pu_quality.fit, pu_quality.with_quality) if op == "op9_quality" else (toxicity.fit, toxicity.with_toxicity)
    none = spark.createDataFrame([], f"doc_id long, {label} int")
    scored = apply(docs(spark, EDGE), fit(docs(spark, EDGE), none)).collect()
    assert len(scored) == len(EDGE) and {r.score for r in scored} == {0.5}
