"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

Two lexicons give the densities.  The base one is a short fixed list of insults.  The other is
induced from the labelled training rows: word beginnings (3 to 8 letters, and whole words) that are
far commoner in toxic texts than in others, beyond what chance gives among so many, so that stems of any
language are found (half by half for the rows that train the trees, so that chance stems don't mislead
them).  A longer beginning that as many toxic texts have as a shorter one adds nothing and is left out.  Further
features: how near a hit is to a second-person pronoun, capitals, punctuation, and obfuscation
(digits or signs inside words, stretched letters, letters set apart), with hits counted again after
the obfuscation is undone.  Trees and calibration come from Spark ML.  Each half of the training rows
is scored by trees of the other one, and the isotonic regression is fitted to these scores; the trees that score new
texts are trained on both halves.  The score is the regression's value as it is, with its ties.

Bounds: at most ``MAX_ROWS`` toxic and ``MAX_ROWS`` other labelled rows are used to fit, taken by a
hash of the id.  Every text is scored whole, in one pass without shuffle.

Defined results: null counts as the empty text, which is scored like any other; without labelled rows of both
kinds in each half (by a hash of the id) the score is the smoothed share of toxic labels (0.5 with none); an id with several labels has that
of most of its rows (ties: 0), and counts once however often the table or the documents repeat it (with the
text of least hash).  An input column of the score's name is replaced; all others pass through, whatever
their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.llm.langid import fold
from tidewater.llm.shared import col, columns, map_arrow, scratch, table

MAX_ROWS = 10_000
MIN_ODDS = 12.0
THRESHOLD = 0.3
#: Insults, lower case.
BASE_LEXICON = frozenset(
    """idiot idiots moron morons stupid dumb dumbass fool scum trash garbage loser losers pathetic worthless
    disgusting clown clowns imbecile cretin jerk bastard bitch asshole shit fuck fucking crap filthy vermin
    degenerate freak ugly hate kill shut retard whore slut pig swine parasite dummkopf arschloch scheisse
    wichser schlampe idiotin trottel connard salope merde putain imbécile débile ordure raclure idiota imbécil
    estúpido estúpida mierda puta cabrón gilipollas basura asqueroso""".split()
)
#: Pronouns of the second person.
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine euch ihr tu te toi ton ta tes vous votre vos tú ti tuyo usted ustedes vosotros os su".split())
#: What stands for a letter in obfuscated words.
LEET = str.maketrans("013457@$!|€", "oieastasiie")
NEAR = 10
NAMES = [
    "base", "base_log", "stems", "stems_log", "stem_weight", "plain_from_obfuscated", "near_second_person", "second_person", "near_share",
    "capitals", "capital_words", "exclamations", "punctuation", "runs", "obfuscated", "stretched", "digits", "apart", "length", "distinct_hits",
]
_EDGE = re.compile(r"^\W+|\W+$")
_PLAIN_EDGE = ".,;:!?\"'()[]{}*-"
_INNER = re.compile(r"\w[^\w\s'’-]+\w|[^\W\d_]\d+[^\W\d_]|[@$]\w|\w[@$]")
_STRETCH = re.compile(r"(.)\1\1")
_SQUEEZE = re.compile(r"(.)\1+")
_NONWORD = re.compile(r"[\W_]+")


def stems_of(word: str) -> list[str]:
    """The beginnings of a lower-case word that can be lexicon entries; ``$`` marks a whole word."""
    return [word[:k] for k in range(3, min(8, len(word)) + 1)] + [word + "$"]


class _Words(dict):
    """What each token is, worked out once: flags, and above them the weight of its heaviest stem in millionths."""

    BASE, STEM, SECOND, CAPITAL, OBFUSCATED, STRETCHED, RUN, UNDONE, SINGLE = (1 << i for i in range(9))

    def __init__(self, stems: dict[str, float]):
        super().__init__()
        self.stems = stems
        self.heads = {s[:3] for s in stems}

    ALL = (1 << 9) - 1

    def __missing__(self, token: str) -> int:
        if len(self) > 200_000:
            self.clear()
        core = token.strip(_PLAIN_EDGE)
        letters = core.isalpha()
        if not letters:
            core = _EDGE.sub("", token)
        low = core.lower()
        weight = self.weigh(low)
        f = self.BASE * (low in BASE_LEXICON) | self.STEM * (weight > 0) | self.SECOND * (low in SECOND_PERSON)
        f |= self.CAPITAL * (len(core) > 1 and core.isupper()) | self.SINGLE * (len(core) == 1 and core.isalpha())
        f |= self.RUN * (len(token) - len(core) > 1)
        # Letters alone can't hide anything; the edges are signs that @ and $ aren't among.
        odd, long = not letters and bool(_INNER.search(token)), bool(_STRETCH.search(low))
        if "@" in token and "." in token:
            odd = False
        f |= self.OBFUSCATED * odd | self.STRETCHED * long
        if (odd or long) and not f & (self.BASE | self.STEM):
            plain = _NONWORD.sub("", token.lower().translate(LEET))
            found = [w for w in (plain, _SQUEEZE.sub(r"\1", plain), _SQUEEZE.sub(r"\1\1", plain)) if w in BASE_LEXICON or self.weigh(w) > 0]
            f |= self.UNDONE * bool(found)
        f |= round(weight * 1e6) << 9
        self[token] = f
        return f

    def weigh(self, word: str) -> float:
        if word[:3] not in self.heads:
            return 0.0
        return max((self.stems[s] for s in stems_of(word) if s in self.stems), default=0.0)


def _kinds(c: str) -> tuple[bool, bool, bool, bool]:
    return c.isupper(), not (c.isalnum() or c == "_" or c.isspace()), c.isdigit(), c in "!?"


_ASCII = np.array([_kinds(chr(i)) for i in range(128)]).T


def char_counts(text: str) -> tuple[int, ...]:
    """Capitals, signs (neither word nor space), digits, and exclamation and question marks."""
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    plain = cp < 128
    out = _ASCII @ np.bincount(cp[plain], minlength=128)
    for c, n in zip(*np.unique(cp[~plain], return_counts=True), strict=True):
        out = out + np.array(_kinds(chr(c))) * n
    return tuple(map(int, out))


def features(text: str | None, words: _Words) -> list[float]:
    tokens = (text or "").split()
    n = len(tokens)
    if not n:
        return [0.0] * len(NAMES)
    f = np.fromiter(map(words.__getitem__, tokens), np.int64, n)
    weight = int((f >> 9).max()) / 1e6
    f &= words.ALL
    capitals, signs, digits, marks = char_counts(text)
    has = lambda bit: (f & bit) != 0
    hit = has(words.BASE | words.STEM | words.UNDONE)
    at, you = np.flatnonzero(hit), np.flatnonzero(has(words.SECOND))
    # Letters set apart ("i d i o t") are put together and looked up.
    apart = 0
    single = np.concatenate([[False], has(words.SINGLE), [False]])
    edge = np.flatnonzero(single[1:] != single[:-1])
    for a, b in zip(edge[::2], edge[1::2], strict=True):
        if b - a >= 4:
            joined = "".join(_EDGE.sub("", t) for t in tokens[a:b]).lower()
            apart += joined in BASE_LEXICON or words.weigh(joined) > 0
    near = closest = 0.0
    if len(at) and len(you):
        k = np.searchsorted(you, at)
        d = np.minimum(np.abs(at - you[np.maximum(k - 1, 0)]), np.abs(you[np.minimum(k, len(you) - 1)] - at))
        closest, near = max(0.0, 1 - float(d.min()) / NEAR), float((d <= NEAR).mean())
    base, stem = int(has(words.BASE).sum()), int(has(words.STEM).sum())
    chars = len(text)
    return [
        base / n, math.log1p(base), stem / n, math.log1p(stem), weight, math.log1p(int(has(words.UNDONE).sum())), closest, len(you) / n, near,
        capitals / chars, float(has(words.CAPITAL).mean()), marks / chars, signs / chars,
        float(has(words.RUN).mean()), float(has(words.OBFUSCATED).mean()), float(has(words.STRETCHED).mean()), digits / chars,
        math.log1p(apart), math.log1p(n), math.log1p(len({tokens[i] for i in at})),
    ]


def induce_stems(rows: DataFrame) -> list[dict[str, float]]:
    """{stem: log odds} of beginnings far commoner in toxic rows (y = 1): of the rows of half 0, of
    half 1, and of all.  rows has (text, y, half)."""

    def count(batches):
        seen = [Counter() for _ in range(4)]
        for b in batches:
            for text, y, half in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                words = {_EDGE.sub("", t) for t in (text or "").lower().split()}
                seen[2 * half + y].update({s for w in words if len(w) > 2 for s in stems_of(w)})
        # A stem that only other rows have is no candidate, but its count is needed where another task has it.
        keys = list(set().union(*seen))
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *[pa.array([c[k] for k in keys], pa.int64()) for c in seen]], names=["stem", "a0", "a1", "b0", "b1"])

    sizes = {(r.half, r.y): r.n for r in rows.groupBy("half", "y").agg(F.count("*").alias("n")).collect()}
    counts = rows.select("text", "y", "half").mapInArrow(count, "stem string, a0 long, a1 long, b0 long, b1 long")
    counts = counts.groupBy("stem").agg(*[F.sum(c).alias(c) for c in ("a0", "a1", "b0", "b1")]).where("a1 + b1 >= 4")
    counts = table(counts, "stems")
    tried = math.log(max(counts.count(), 2))

    def best(n0, n1, halves) -> dict[str, float]:
        t0, t1 = (sum(sizes.get((h, y), 0) for h in halves) for y in (0, 1))
        if not t0 or not t1:
            return {}
        odds = F.log(((n1 + 0.1) / t1) / ((n0 + 1) / t0))
        # Half the likelihood ratio of rows of both kinds against chance; among so many, chance reaches the log of their number.
        r, n = t1 / (t0 + t1), F.col("n0") + F.col("n1")
        beyond = F.col("n1") * F.log(F.col("n1") / (n * r)) + F.when(F.col("n0") > 0, F.col("n0") * F.log(F.col("n0") / (n * (1 - r)))).otherwise(0)
        good = counts.select("stem", n0.alias("n0"), n1.alias("n1"), odds.alias("odds")).where("n1 >= 4").where((F.col("odds") >= math.log(MIN_ODDS)) & (beyond >= tried))
        whole = F.col("stem").endswith("$")
        shorter = F.when(whole, F.expr("substring(stem, 1, least(8, length(stem) - 1))")).otherwise(F.expr("substring(stem, 1, length(stem) - 1)"))
        same = good.select(F.col("stem").alias("shorter"), "n1")
        good = good.withColumn("shorter", shorter).join(same, ["shorter", "n1"], "left_anti")
        return {r.stem: float(r.odds) for r in good.select("stem", "odds").collect()}

    a0, a1, b0, b1 = map(F.col, ("a0", "a1", "b0", "b1"))
    return [best(a0, a1, (0,)), best(b0, b1, (1,)), best(a0 + b0, a1 + b1, (0, 1))]


def _sample(known: DataFrame, n: int) -> DataFrame:
    return known.orderBy(F.xxhash64("id"), "id").limit(n)


def _with_features(df: DataFrame, stems: dict[str, float], at: int, keep: list[str]) -> DataFrame:
    state: dict[str, _Words] = {}

    def run(batches):
        words = state.setdefault("w", _Words(stems))
        for b in batches:
            x = [features(t, words) for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(x, pa.list_(pa.float64()))], names=[*keep, "__tx_x"])

    schema = T.StructType([*[df.schema[c] for c in keep], T.StructField("__tx_x", T.ArrayType(T.DoubleType()))])
    return map_arrow(df, run, schema)


class Toxicity:
    """A fitted scorer: stems, trees and calibration; no trees means a constant score."""

    def __init__(self, prior: float, stems=None, trees=None, calibration=None):
        self.prior, self.stems, self.trees, self.calibration = prior, stems or {}, trees, calibration


def fit(docs: DataFrame, labels: DataFrame, train: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = MAX_ROWS) -> Toxicity:
    """``train``: which rows' labels may be used (a condition on id_col of labels)."""
    with scratch():
        known = (labels if train is None else labels.where(train)).where(col(id_col).isNotNull())
        known = known.groupBy(col(id_col).alias("id")).agg(F.avg(col(label_col).cast("double")).alias("y")).where("y is not null")
        known = table(known.select("id", (F.col("y") > 0.5).cast("int").alias("y")), "labels")
        return _fit(docs.select(col(id_col).alias("id"), col(text_col).alias("text")), known, max_rows)


def _fit(docs: DataFrame, known: DataFrame, max_rows: int) -> Toxicity:
    base = known.agg(F.sum("y").alias("s"), F.count("*").alias("n")).first()
    s, n = base.s or 0, base.n
    prior = (s + 1) / (n + 2)
    if not s or s == n:
        return Toxicity(prior)
    chosen = _sample(known.where("y = 1"), max_rows).unionByName(_sample(known.where("y = 0"), max_rows))
    # Both lists are bounded by max_rows; one text an id.
    rows = docs.join(F.broadcast(chosen), "id").groupBy("id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    half = F.pmod(F.xxhash64(F.lit(5), "id"), F.lit(2)).cast("int")
    rows = table(rows.withColumn("half", half), "toxicity")
    taken = {(r.y, r.half): r.n for r in rows.groupBy("y", "half").agg(F.count("*").alias("n")).collect()}
    if len(taken) < 4:
        return Toxicity(prior)
    first, second, stems = induce_stems(rows)
    # Rows left out of the sample are made up for by weight, so that scores stay probabilities.
    w = F.when(F.col("y") == 1, s / (taken[1, 0] + taken[1, 1])).otherwise((n - s) / (taken[0, 0] + taken[0, 1]))
    # The trees see each row with stems found in the other half, as they will see new texts.
    halves = [_with_features(rows.where(F.col("half") == h).select("y", "half", "text"), x, 2, ["y", "half"]) for h, x in ((0, second), (1, first))]
    data = halves[0].unionByName(halves[1])
    data = table(data.select(F.col("y").cast("double").alias("label"), "half", w.alias("w"), "__tx_x"), "toxicity")
    data = data.select("label", "half", "w", array_to_vector("__tx_x").alias("features"))
    trees = GBTClassifier(maxIter=12, maxDepth=3, stepSize=0.3, seed=7, weightCol="w", maxBins=64)
    scored = [
        trees.fit(data.where(F.col("half") != h)).transform(data.where(F.col("half") == h)).select("label", "w", vector_to_array("probability")[1].alias("p")) for h in (0, 1)
    ]
    calibration = IsotonicRegression(featuresCol="p", labelCol="label", weightCol="w").fit(scored[0].unionByName(scored[1]))
    return Toxicity(prior, stems, trees.fit(data), calibration)


def with_toxicity(docs: DataFrame, model: Toxicity, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """``docs`` with the score of each text (0 to 1)."""
    cols = [c for c in docs.columns if c != out_col]
    src = docs.select(*columns(docs, out_col))
    if model.trees is None:
        return src.withColumn(out_col, F.lit(model.prior))
    # The models name their own columns, so the input's go through them as one struct.
    out = _with_features(src, model.stems, cols.index(text_col), cols)
    out = out.select(F.struct(*columns(src)).alias("__tx_row"), array_to_vector("__tx_x").alias("features"))
    out = model.trees.transform(out).select("__tx_row", vector_to_array("probability")[1].alias("p"))
    out = model.calibration.transform(out)
    return out.select("__tx_row.*", F.col("prediction").alias(out_col))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = fit(docs, labels, fold("doc_id", 4) != 2)
    out = with_toxicity(docs, model).select("doc_id", "score")
    return out.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
