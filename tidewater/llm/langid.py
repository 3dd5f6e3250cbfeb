"""Language ID by multilingual mixture inference.

Each language is a smoothed distribution over character trigrams (hashed to ``BUCKETS``), counted
over all training texts.  A document is a mixture: expectation-maximisation estimates the share of
each language from its trigrams.  The languages, largest share first, are then added while the
penalised likelihood rises (half the log of the number of trigrams for each language: BIC), which
gives the document's set; the prediction is the language with the largest share in the set.

Defined results: null text, or one without a letter, is ``und`` with score 0 and an empty set;
with no training text at all every document is ``und``; training rows without language are left
out; ties go to the language first in the alphabet.  Texts are read whole.

Input columns named ``lang_pred``, ``score`` or ``langs`` are replaced; all others pass through, whatever
their names.

The counts are summed per task before the only shuffle (languages x BUCKETS rows at most).  The driver
fetches them as arrays, ``AT_ONCE`` languages at a time; the model goes to the tasks with 4 bytes a bucket, 128 KB a
language, however many there are.
"""

from __future__ import annotations

import re
import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.llm.shared import col, columns, map_arrow, table

BUCKETS = 1 << 15
AT_ONCE = 64
SMOOTH = 0.5
#: Expectation-maximisation ends when no share moves by more than CLOSE, and after EM_STEPS at the latest.
CLOSE, EM_STEPS = 1e-3, 200
_LETTER = re.compile(r"[^\W\d_]")
_alpha = None


def _letters() -> np.ndarray:
    global _alpha
    if _alpha is None:
        _alpha = np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
    return _alpha


def trigram_buckets(text: str) -> np.ndarray:
    """The bucket of every trigram of the lower-cased text, runs of other characters as one blank."""
    cp = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    cp = np.where(_letters()[cp], cp, np.uint32(32))
    blank = cp == 32
    cp = cp[~(blank & np.concatenate([[False], blank[:-1]]))]
    if len(cp) < 3:
        return np.empty(0, np.int64)
    with np.errstate(over="ignore"):
        h = cp[:-2] * np.uint32(0x9E3779B1) + cp[1:-1] * np.uint32(0x85EBCA77) + cp[2:] * np.uint32(0xC2B2AE3D)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
    return (h >> np.uint32(17)).astype(np.int64)


class Mixture:
    def __init__(self, langs: list[str], log_p: np.ndarray):
        self.langs, self.log_p = langs, log_p.astype(np.float32)

    def infer(self, text: str | None) -> tuple[str, float, list[tuple[str, float]]]:
        """(language, its share, [(language, share)] of the set, largest first)."""
        if not text or not self.langs or not _LETTER.search(text):
            return "und", 0.0, []
        at, n = np.unique(trigram_buckets(text), return_counts=True)
        if not len(at):
            return "und", 0.0, []
        n = n.astype(float)
        log_p = self.log_p[at].astype(float)
        p = np.exp(log_p)
        single = n @ log_p
        share = _em(p, n, np.full(len(self.langs), 1 / len(self.langs)))
        total = n.sum()
        order = np.lexsort((np.arange(len(share)), -share))
        top = int(np.argmax(single))
        best, best_score = ([top], np.ones(1)), single[top] - 0.5 * np.log(total)
        for k in range(2, len(order) + 1):
            some = np.sort(order[:k])
            if share[order[k - 1]] * total < 1:
                break
            w = _em(p[:, some], n, share[some] / share[some].sum())
            score = n @ np.log(p[:, some] @ w) - 0.5 * k * np.log(total)
            if score <= best_score:
                break
            best, best_score = (list(some), w), score
        found = sorted(zip(best[0], best[1], strict=True), key=lambda x: (-x[1], x[0]))
        return self.langs[found[0][0]], float(found[0][1]), [(self.langs[i], float(x)) for i, x in found]


def _em(p: np.ndarray, n: np.ndarray, w: np.ndarray) -> np.ndarray:
    for _ in range(EM_STEPS):
        r = p * w
        new = (n / r.sum(axis=1)) @ r
        new /= new.sum()
        moved = np.abs(new - w).max()
        w = new
        if moved < CLOSE:
            break
    return w


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Mixture:
    """The model of all rows of ``docs`` that have text and language."""

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                got = np.bincount(trigram_buckets(text), minlength=BUCKETS)
                sums[lang] = sums[lang] + got if lang in sums else got
        for lang, s in sums.items():
            at = np.flatnonzero(s)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(s[at], pa.int64())], names=["lang", "at", "n"])

    rows = docs.where(col(text_col).isNotNull() & col(lang_col).isNotNull()).select(col(text_col), col(lang_col).alias("lang"))
    counts = rows.mapInArrow(count, "lang string, at long, n long").groupBy("lang", "at").agg(F.sum("n").alias("n"))
    counts = table(counts, "trigrams")
    langs = sorted(r.lang for r in counts.select("lang").distinct().collect())
    log_p = np.empty((BUCKETS, len(langs)), np.float32)
    for first in range(0, len(langs), AT_ONCE):
        some = langs[first : first + AT_ONCE]
        got = counts.where(F.col("lang").isin(some)).toArrow()
        of = {x: i for i, x in enumerate(some)}
        n = np.full((BUCKETS, len(some)), SMOOTH)
        n[got["at"].to_numpy(), [of[x] for x in got["lang"].to_pylist()]] += got["n"].to_numpy()
        log_p[:, first : first + len(some)] = np.log(n / n.sum(axis=0))
    return Mixture(langs, log_p)


def identify(docs: DataFrame, model: Mixture, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score and langs (language and share of the set); no shuffle."""
    new = ("lang_pred", "score", "langs")
    cols = [c for c in docs.columns if c not in new]
    src = docs.select(*columns(docs, *new))
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.log_p))
    at = cols.index(text_col)
    state: dict[str, Mixture] = {}

    def run(batches):
        m = state.setdefault("m", Mixture(*shared.value))
        for b in batches:
            got = [m.infer(t) for t in b.column(at).to_pylist()]
            pairs = pa.array([[{"lang": x, "share": y} for x, y in g[2]] for g in got], pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())])))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pairs], names=[*cols, *new])

    pair = T.StructType([T.StructField("lang", T.StringType()), T.StructField("share", T.DoubleType())])
    types = (T.StringType(), T.DoubleType(), T.ArrayType(pair))
    return map_arrow(src, run, T.StructType([*src.schema.fields, *map(T.StructField, new, types)]))


def fold(id_col: str, n: int):
    """crc32 of the id as text, mod n."""
    return F.crc32(F.coalesce(col(id_col).cast("string"), F.lit(""))) % n


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.where(fold("doc_id", 3) != 1))
    out = identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", F.to_json("langs").alias("langs"))
