"""What the operators choose and learn, worked out again in plain Python: the windows of a fingerprint, the language set
of least penalised likelihood, the features, stems, cross-fitted scores and calibration of toxicity."""

import base64
import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import IsotonicRegression

from tidewater.llm import fingerprint, langid, toxicity

MASK = (1 << 64) - 1

# ---- fingerprints


def mixed(x):
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = ((x ^ (x >> shift)) * factor) & MASK
    return x ^ (x >> 31)


def window_hash(w):
    h = 0
    for j in range(4):
        h = mixed((h * 0x9FB21C651E98DF25 + int.from_bytes(w[8 * j : 8 * j + 8], "little") + j + 1) & MASK)
    return h


def print_of(text, ranks):
    raw = text.encode()
    levels = [int(x) for x in fingerprint.entropy_levels(np.frombuffer(raw, np.uint8))]
    rank = [int(ranks[x]) for x in levels]
    runs = len(rank) - 31
    picked = Counter(min(range(s, s + 32), key=lambda i: (rank[i], i)) for s in range(runs))
    need = 8 if runs >= 32 else -(-runs // 4)
    if runs < 1:  # less than one run of windows: the rarest of them
        picked, need = Counter([min(range(len(rank)), key=lambda i: (rank[i], i))]), 1
    chosen = list(dict.fromkeys(window_hash(raw[i : i + 32]) for i in sorted(picked) if picked[i] >= need and rank[i] <= fingerprint.LEVELS))
    filters = [set() for _ in range(-(-len(chosen) // 160))]
    for k, h in enumerate(chosen):
        filters[k // 160] |= {(h >> (11 * j)) & 2047 for j in range(5)}
    return len(chosen), filters


def bits_of(fingerprint_):
    n, _, body = fingerprint_.partition(":")
    raw = base64.b64decode(body)
    return int(n), [{8 * i + 7 - b for i, x in enumerate(raw[at : at + 256]) for b in range(8) if x >> b & 1} for at in range(0, len(raw), 256)]


@pytest.mark.parametrize("seed", range(4))
def test_windows_of_a_fingerprint(seed):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefghijklmnoprstuwäé") for _ in range(r.randint(1, 9))) for _ in range(400)]
    texts = [" ".join(r.choice(words) for _ in range(n)) for n in (8, 10, 12, 14, 40, 300, 3000)]
    texts.append("aaaa " * 50 + texts[4] + "=" * 200)
    texts = [t for t in texts if len(t.encode()) >= 32]
    ranks = fingerprint.rarity_ranks(fingerprint.level_counts([t.encode() for t in texts]))
    got = fingerprint.fingerprints(texts, ranks)
    assert max(len(bits_of(g)[1]) for g in got) > 1  # a chain of filters
    for t, g in zip(texts, got, strict=True):
        want = print_of(t, ranks)
        assert not want[0] or bits_of(g) == want


# ---- languages


def test_language_set_by_enumeration():
    r = np.random.default_rng(5)
    langs = ["a", "b", "c", "d"]
    alphabets = {"a": "abcdefgh", "b": "efghijkl", "c": "ijklmnop", "d": "mnopqrst"}
    word = lambda lang: "".join(r.choice(list(alphabets[lang]), r.integers(2, 7)))
    counts = np.full((langid.BUCKETS, 4), langid.SMOOTH)
    for i, lang in enumerate(langs):
        np.add.at(counts[:, i], langid.trigram_buckets(" ".join(word(lang) for _ in range(4000))), 1)
    model = langid.Mixture(langs, np.log(counts / counts.sum(axis=0)))
    sizes = Counter()
    for _ in range(25):
        some = r.choice(langs, r.integers(1, 4), replace=False)
        text = " ".join(" ".join(word(lang) for _ in range(r.integers(30, 90))) for lang in some)
        at, n = np.unique(langid.trigram_buckets(text), return_counts=True)
        p = np.exp(model.log_p[at].astype(float))
        scores = {}
        for k in range(1, 5):
            for subset in itertools.combinations(range(4), k):
                q, w = p[:, subset], np.full(k, 1 / k)
                for _ in range(2000):
                    w = (n / (q @ w)) @ (q * w) / n.sum()
                scores[subset] = n @ np.log(q @ w) - 0.5 * k * np.log(n.sum())
        best = max(scores, key=scores.get)
        got = model.infer(text)
        assert sorted(langs.index(x) for x, _ in got[2]) == list(best) and got[0] == max(got[2], key=lambda x: x[1])[0]
        sizes[len(best)] += 1
    assert len(sizes) >= 3


# ---- toxicity


def test_features_by_counting():
    """Tokens of known kinds, counted as they are dealt out."""
    kinds = {
        "base": ["idiot", "Moron,", "stupid"], "undone": ["1d1ot", "m0ron"], "second": ["you", "Your,"], "capital": ["HELLO", "NASA,"],
        "stretched": ["sooo", "yesss"], "plain": ["house", "water,", "green", "4711", "don't"], "run": ["what?!", "(well)"],
    }
    r = random.Random(3)
    words = toxicity._Words({})
    for _ in range(200):
        dealt = [r.choice([*kinds, "plain", "plain"]) for _ in range(r.randint(1, 60))]
        tokens = [r.choice(kinds[k]) for k in dealt]
        text = " ".join(tokens)
        f = dict(zip(toxicity.NAMES, toxicity.features(text, words), strict=True))
        n, of = len(tokens), Counter(dealt)
        hits, second = [i for i, k in enumerate(dealt) if k in ("base", "undone")], [i for i, k in enumerate(dealt) if k == "second"]
        gaps = [min(abs(i - j) for j in second) for i in hits] if second else []
        assert f["base"] == of["base"] / n and f["base_log"] == pytest.approx(math.log1p(of["base"])) and f["stems"] == 0
        assert f["second_person"] == of["second"] / n and f["capital_words"] == of["capital"] / n and f["stretched"] == of["stretched"] / n
        assert f["plain_from_obfuscated"] == pytest.approx(math.log1p(of["undone"])) and f["obfuscated"] == of["undone"] / n and f["runs"] == of["run"] / n
        assert f["near_second_person"] == pytest.approx(max(0, 1 - min(gaps) / toxicity.NEAR) if gaps else 0)
        assert f["near_share"] == pytest.approx(sum(g <= toxicity.NEAR for g in gaps) / len(gaps) if gaps else 0)
        assert f["capitals"] * len(text) == pytest.approx(len(re.findall("[A-Z]", text))) and f["digits"] * len(text) == pytest.approx(len(re.findall("[0-9]", text)))
        assert f["exclamations"] * len(text) == pytest.approx(len(re.findall("[!?]", text))) and f["punctuation"] * len(text) == pytest.approx(len(re.findall(r"[^\w\s]", text)))
        assert f["length"] == pytest.approx(math.log1p(n)) and f["distinct_hits"] == pytest.approx(math.log1p(len({tokens[i] for i in hits})))


def labelled(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("aeioulnrst") for _ in range(r.randint(2, 8)))
    rows = []
    for i in range(160):
        toxic = int(r.random() < 0.35)
        t = [word() for _ in range(r.randint(5, 30))]
        if r.random() < (0.8 if toxic else 0.03):
            t[2:2] = [r.choice(["grumbler", "grumblers!", "Zwackelkopf"])]
        if r.random() < (0.5 if toxic else 0.15):
            t += ["you", "idiot"]
        rows.append((i, " ".join(t), toxic, r.randrange(2)))
    return rows


def test_stems_by_counting(spark):
    rows = labelled(1)
    got = toxicity.induce_stems(spark.createDataFrame([x[1:] for x in rows], "text string, y int, half int"))
    seen = Counter()
    for _, text, y, half in rows:
        words = {re.sub(r"^\W+|\W+$", "", t) for t in text.lower().split()}
        for s in {w[:k] for w in words if len(w) > 2 for k in range(3, min(8, len(w)) + 1)} | {w + "$" for w in words if len(w) > 2}:
            seen[s, half, y] += 1
    every = {s for s, _, _ in seen}
    tried = sum(seen[s, 0, 1] + seen[s, 1, 1] >= 4 for s in every)
    for halves, found in zip([(0,), (1,), (0, 1)], got, strict=True):
        total = [sum(y == k and half in halves for _, _, y, half in rows) for k in (0, 1)]
        good = {}
        for s in every:
            n0, n1 = (sum(seen[s, h, k] for h in halves) for k in (0, 1))
            if n1 < 4:
                continue
            odds = math.log((n1 + 0.1) / total[1] / ((n0 + 1) / total[0]))
            share = total[1] / sum(total)
            ratio = n1 * math.log(n1 / ((n0 + n1) * share)) + (n0 * math.log(n0 / ((n0 + n1) * (1 - share))) if n0 else 0)
            if odds >= math.log(12) and ratio >= math.log(tried):
                good[s] = (n1, odds)
        shorter = lambda s: s[:-1][:8] if s.endswith("$") else s[:-1]
        want = {s: odds for s, (n1, odds) in good.items() if good.get(shorter(s), (None,))[0] != n1}
        assert found == pytest.approx(want)
    assert got[2]


def pooled(rows):
    """Isotonic regression of (score, label, weight) by pooling neighbours: {score: value}."""
    sums = {}
    for p, y, w in rows:
        s, t = sums.get(p, (0.0, 0.0))
        sums[p] = (s + y * w, t + w)
    blocks = []
    for p in sorted(sums):
        blocks.append([*sums[p], [p]])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            s, t, ps = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + t, blocks[-1][2] + ps]
    return {p: s / t for s, t, ps in blocks for p in ps}


def test_scores_from_the_trees_by_hand(spark, monkeypatch):
    fits, scored = [], []

    class Trees(GBTClassifier):
        def fit(self, df):
            fits.append((df.groupBy("half").count().collect(), super().fit(df)))
            return fits[-1][1]

    class Isotonic(IsotonicRegression):
        def fit(self, df):
            scored.extend(df.collect())
            return super().fit(df)

    monkeypatch.setattr(toxicity, "GBTClassifier", Trees)
    monkeypatch.setattr(toxicity, "IsotonicRegression", Isotonic)
    rows = labelled(2)
    docs = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(x[0], x[2]) for x in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)

    # Each half is scored by trees of the other; the last ones are of both.
    assert [sorted(r["half"] for r in f[0]) for f in fits] == [[1], [0], [0, 1]]
    assert sum(r["count"] for r in fits[2][0]) == len(rows) == len(scored)
    # The calibration is the isotonic regression of these scores.
    want = pooled([(r.p, r.label, r.w) for r in scored])
    edges, values = model.calibration.boundaries.toArray(), model.calibration.predictions.toArray()
    assert all(abs(np.interp(p, edges, values) - v) < 1e-9 for p, v in want.items())

    def score(trees, stems, text):
        x = Vectors.dense(toxicity.features(text, toxicity._Words(stems)))
        margin = sum(w * t.predict(x) for w, t in zip(trees.treeWeights, trees.trees, strict=True))
        return 1 / (1 + math.exp(-2 * margin))

    got = {r.text: r.score for r in toxicity.with_toxicity(docs, model).collect()}
    assert len(set(got.values())) > 3
    for text in [x[1] for x in rows[:60]]:
        assert got[text] == pytest.approx(np.interp(score(fits[2][1], model.stems, text), edges, values), abs=1e-9)
