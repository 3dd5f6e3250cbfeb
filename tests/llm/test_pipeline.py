"""The five stages against plain Python on a small corpus."""

import random
from math import ceil

from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_minhash import brute
from tests.llm.test_operators import edit_distance_within
from tidewater.llm import decontam, mixing, pu_quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    r = random.Random(8)
    words = ["".join(r.choice("aeioulnrst") for _ in range(r.randint(2, 8))) for _ in range(300)]
    line = lambda: " ".join(r.choice(words) for _ in range(r.randint(6, 12))).capitalize() + "."
    shared = [line() for _ in range(5)]
    items = [" ".join(r.choice(words) for _ in range(14)) for _ in range(3)]
    texts = []
    for i in range(70):
        lines = [line() for _ in range(r.randint(4, 9))]
        if i % 7 == 3:
            lines[2:2] = shared
        if i % 11 == 5:
            at = list(items[i % 3])
            at[10] = "q"
            lines[1] += " " + "".join(at)
        text = "\n".join(lines)
        if i % 10 == 9:  # a copy, joined to one line so that the shared lines don't show it, with a word more
            text = texts[-2].replace("\n", " ") + " " + r.choice(words)
        if i % 23 == 22:  # nothing is left of this one
            text = texts[-4]
        if i % 6 == 4:
            text = " ".join(w + r.choice(["%%%", "$$$", "***"]) for w in text.split())
        texts.append(text)
    texts += [None, "", "Short one."]
    return [(i, t, "en", f"src{i % 3}" if i % 13 else "unlisted", None) for i, t in enumerate(texts)], items


def line_stage(rows):
    first, out = {}, []
    for i, t in sorted(rows, key=lambda x: x[0]):
        lines, gone = (t or "").split("\n"), set()
        for p in range(len(lines) - 2):
            w = tuple(lines[p : p + 3])
            if any(x.strip(" ") for x in w) and first.setdefault(w, (i, p)) != (i, p):
                gone.update(range(p, p + 3))
        left = [x for p, x in enumerate(lines) if p not in gone]
        if not gone:
            out.append((i, t))
        elif any(x.strip() for x in left):
            out.append((i, "\n".join(left)))
    return out


def mixture_stage(rows, sources, weights, block):
    import hashlib

    shares = {s: w for s, w in weights.items() if s in {sources[i] for i, _ in rows}}
    q, names = sum(shares.values()), sorted(shares)
    done, slots = dict.fromkeys(names, 0), {s: [] for s in names}
    for t in range(4000):
        ready = [(ceil((done[s] + 1) * q / shares[s]), s) for s in names if done[s] * q // shares[s] <= t]
        s = min(ready)[1]
        slots[s].append(t)
        done[s] += 1
    total, place = {}, {}
    for i, t in sorted(rows, key=lambda x: hashlib.md5(str(x[0]).encode()).hexdigest()):
        place[i] = total.get(sources[i], 0) // block
        total[sources[i]] = total.get(sources[i], 0) + len(t or "")
    horizon = min(slots[s][ceil(total[s] / block)] for s in names)
    return {i: (b, slots[sources[i]][b] if sources[i] in slots else None, sources[i] in slots and slots[sources[i]][b] < horizon) for i, b in place.items()}


def test_pipeline_against_brute_force(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(mixing, "TARGET", {"src0": 3, "src1": 2, "src2": 1, "gone": 4})
    monkeypatch.setattr(mixing.mix, "__defaults__", (500, *mixing.mix.__defaults__[1:]))
    rows, items = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 0 if t and any(x in t for x in ("%%%", "$$$", "***")) else 1, 0) for i, t, *_ in rows if i % 3]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    model = pu_quality.fit(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))

    left = [(i, t) for i, t, *_ in rows if model.score(pu_quality.features(t)[None])[0] >= 0.7]
    sizes = [len(rows), len(left)]
    left = line_stage(left)
    sizes.append(len(left))
    near = brute(left, 5)
    left = [(i, t) for i, t in left if near[i][1] == i]
    sizes.append(len(left))
    norm = [decontam.normalise(x) for x in items]
    left = [(i, t) for i, t in left if all(edit_distance_within(n, decontam.normalise(t)) > int(0.08 * len(n)) for n in norm)]
    sizes.append(len(left))
    # Every stage has work to do.
    assert sizes == sorted(sizes, reverse=True) and len(set(sizes)) == 5
    place = mixture_stage(left, {i: s for i, _, _, s, _ in rows}, mixing.TARGET, 500)
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id: r.text for r in out} == dict(left) and len(out) == len(left)
    assert {r.doc_id: (r.mix_block, r.mix_slot, r.mixed) for r in out} == place


def test_stages_return_the_columns_of_documents(spark, tmp_path):
    docs = spark.createDataFrame([], SCHEMA)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).where(F.lit(True)).count() == 0
