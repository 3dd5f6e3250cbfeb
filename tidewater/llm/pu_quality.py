"""Quality classifier by non-negative positive-unlabelled learning.

Trusted positives (label 1) and unlabelled web text train a logistic scorer over dense features of
form; the risk is  pi * R_p(+1) + max(0, R_u(-1) - pi * R_p(-1)),  whose second part, the risk on the
hidden negatives, is kept from going below zero, so the scorer can't overfit by calling positives
negative.  Rows of label 0 play no part.

The class prior pi is estimated from positives and unlabelled text: a scorer of positives against unlabelled
text ranks both, and pi is the least ratio of the share of unlabelled text above a threshold to
that of the positives (where negatives are rare the ratio is pi).  The probability is a monotone (Platt) map
of the margin, fitted on positives against unlabelled text too: at a margin the odds of being one of the n_p positives
and not one of the n_u unlabelled are n_p / (n_u pi) times the probability of label 1.

Bounds: at most ``MAX_ROWS`` positives are used to fit, taken by a hash of the id (so the same at every run); their
features reach the driver (``MAX_ROWS`` x 8 x features bytes, 1.4 MB).  The unlabelled side covers every text:
mean and deviation, the risk with its gradient, and the distribution of the margins are sums over all of them, from a
table of their features.  Only the weights that the descent starts from are fitted to ``MAX_ROWS`` of them.

Defined results: null counts as the empty text, which is scored like any other; with no positives
or no unlabelled rows the score is 0.5; an id with several labels has that of most of its rows (ties: 0), and counts
once however often the table or the documents repeat it (as positive with the text of least hash; every row is an
unlabelled one).  An input column of the score's name is replaced; all others pass through, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.llm.langid import fold
from tidewater.llm.shared import col, columns, map_arrow, scratch, table, word_hashes

MAX_ROWS = 8_000
THRESHOLD = 0.7
#: Steps of the descent over all rows, and bins of the margin (within +-SPAN).
STEPS, BINS, SPAN = 8, 2048, 20.0
#: Byte classes: each gets one feature, its share of the bytes.
CLASSES = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r", ".", ",", "!", "?", "|", "#$%&*@^~_=+<>\\/", ":;-()[]{}'\"`"]
_CLASS = np.full(256, len(CLASSES), np.int64)
for _i, _c in enumerate(CLASSES):
    _CLASS[list(_c.encode())] = _i
N_FEATURES = len(CLASSES) + 1 + 9


def features(text: str | None) -> np.ndarray:
    """Dense features of form: byte classes, word and line repetition, lengths."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    out = np.zeros(N_FEATURES)
    if not len(raw):
        return out
    k = len(CLASSES) + 1
    out[:k] = np.bincount(_CLASS[raw], minlength=k) / len(raw)
    w = word_hashes(text)
    n = len(w)
    lines = [x for x in text.split("\n") if x.strip()]
    with np.errstate(over="ignore"):
        pairs = np.unique(w[:-1] * np.uint64(0x9E3779B97F4A7C15) + w[1:]) if n > 1 else w
    unique = np.unique(w, return_counts=True)[1] if n else np.zeros(1)
    out[k:] = (
        np.log1p(n) / 10,
        len(raw) / max(n, 1) / 20,
        len(unique) / max(n, 1),
        (w[1:] == w[:-1]).mean() if n > 1 else 0,
        len(pairs) / max(n - 1, 1),
        unique.max() / max(n, 1),
        len(set(lines)) / max(len(lines), 1),
        np.log1p(n / max(len(lines), 1)) / 10,
        # How evenly the words are spread: the entropy of the word distribution by its maximum.
        -(unique / max(n, 1) * np.log(np.maximum(unique, 1) / max(n, 1))).sum() / max(np.log(max(n, 2)), 1e-9),
    )
    return out


def expand(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Standardised features within +-4, their squares, and a constant."""
    z = np.clip((x - mean) / scale, -4, 4)
    return np.hstack([z, z * z - 1, np.ones((len(z), 1))])


def risk(w: np.ndarray, p: np.ndarray, unlabelled: tuple[float, np.ndarray], prior: float, decay: float = 1e-4) -> tuple[float, np.ndarray]:
    """The non-negative risk of the sigmoid loss, and the gradient that lowers it.

    ``unlabelled``: (R_u(-1), its gradient).  Where the risk of the hidden negatives falls under zero,
    the gradient is that of raising it again."""
    sp = _sigmoid(p @ w)
    gp = (sp * (1 - sp)) @ p / len(p)
    ru, gu = unlabelled
    negative = ru - prior * sp.mean()
    value = prior * (1 - sp.mean()) + max(0.0, negative) + decay / 2 * (w @ w)
    return value, (gu - 2 * prior * gp if negative >= 0 else prior * gp - gu) + decay * w


def unlabelled_risk(w: np.ndarray, u: np.ndarray) -> tuple[float, np.ndarray]:
    """R_u(-1) and its gradient.  The sigmoid loss is bounded, so that far outliers don't dominate."""
    su = _sigmoid(u @ w)
    return su.mean(), (su * (1 - su)) @ u / len(u)


def fit_start(p: np.ndarray, u: np.ndarray, prior: float, w: np.ndarray | None = None, steps: int = 600, rate: float = 0.05) -> np.ndarray:
    """Weights of least non-negative risk for the rows given (Adam, whole sample a step)."""
    w = np.zeros(p.shape[1]) if w is None else w
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        grad = risk(w, p, unlabelled_risk(w, u), prior)[1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def fit_contrast(p: np.ndarray, u: np.ndarray, decay: float = 1e-3) -> np.ndarray:
    """Weights of logistic regression, positives against unlabelled text, both sides of equal weight (Newton)."""
    x = np.vstack([p, u])
    y = np.concatenate([np.ones(len(p)), np.zeros(len(u))])
    c = np.concatenate([np.full(len(p), 0.5 / len(p)), np.full(len(u), 0.5 / len(u))])
    w = np.zeros(x.shape[1])
    for _ in range(25):
        s = _sigmoid(x @ w)
        h = (x * (c * s * (1 - s))[:, None]).T @ x + decay * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (c * (s - y)) + decay * w)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w


def bin_of(margin: np.ndarray) -> np.ndarray:
    return np.clip(((margin + SPAN) * (BINS / (2 * SPAN))).astype(np.int64), 0, BINS - 1)


MIDDLES = (np.arange(BINS) + 0.5) * (2 * SPAN / BINS) - SPAN


def estimate_prior(p: np.ndarray, u: np.ndarray) -> float:
    """The class prior from how many positives and how many unlabelled rows fall in each bin of the margin.

    Thresholds keep a fifth of the positives at least, and both shares are taken at the cautious end of two
    standard deviations, so that a chance gap of few rows isn't taken for a pure region."""
    n_p, n_u = p.sum(), u.sum()
    share_p, share_u = (np.cumsum(x[::-1])[::-1] / n for x, n in ((p, n_p), (u, n_u)))
    few_p, many_u = share_p - 2 * np.sqrt(share_p * (1 - share_p) / n_p), share_u + 2 * np.sqrt(share_u * (1 - share_u) / n_u)
    ok = (share_p >= 0.2) & (few_p > 0)
    best = np.flatnonzero(ok)[np.argmin(many_u[ok] / few_p[ok])]
    return float(np.clip(share_u[best] / share_p[best], 0.01, 0.99))


def fit_map(p: np.ndarray, u: np.ndarray, prior: float) -> tuple[float, float]:
    """(a, b) of P(label 1) = sigmoid(a * margin + b), a >= 0, of greatest likelihood for the binned margins of
    positives and unlabelled rows (Newton on the two parameters, damped)."""
    k = p.sum() / (u.sum() * prior)
    use = np.flatnonzero(p + u)
    x, n1, n0 = np.stack([MIDDLES[use], np.ones(len(use))], axis=1), p[use], u[use]

    def loss(ab):
        s = k * _sigmoid(x @ ab)
        return n1 @ (np.log1p(s) - np.log(s)) + n0 @ np.log1p(s) + 1e-3 * ab @ ab

    ab = np.array([1.0, 0.0])
    for _ in range(100):
        q = _sigmoid(x @ ab)
        s = k * q
        # d/dz log s = 1 - q and d/dz log(1 + s) = s (1 - q) / (1 + s), z the map's argument.
        d = (n1 + n0) * s * (1 - q) / (1 + s) - n1 * (1 - q)
        dd = np.maximum((n1 + n0) * s * (1 - q) / (1 + s) * ((1 - q) / (1 + s) - q) + n1 * q * (1 - q), 1e-9)
        step = np.linalg.solve((x * dd[:, None]).T @ x + 2e-3 * np.eye(2), x.T @ d + 2e-3 * ab)
        at, size = loss(ab), 1.0
        while size > 1e-4 and loss(ab - size * step) > at:
            size /= 2
        ab = ab - size * step
        if np.abs(size * step).max() < 1e-7:
            break
    return float(max(ab[0], 0.0)), float(ab[1])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Quality:
    """A fitted scorer; ``weights`` None means a constant score."""

    def __init__(self, prior: float, mean=None, scale=None, weights=None, platt=(1.0, 0.0)):
        self.prior, self.mean, self.scale, self.weights, self.platt = prior, mean, scale, weights, platt

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), 0.5)
        a, b = self.platt
        return _sigmoid(a * (expand(x, self.mean, self.scale) @ self.weights) + b)


def feature_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, th, x): a hash of each text and its features."""
    src = docs.select(col(id_col).alias("id"), F.xxhash64(col(text_col)).alias("th"), col(text_col).alias("text"))

    def run(batches):
        for b in batches:
            x = [features(t) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(x, pa.list_(pa.float64()))], names=["id", "th", "x"])

    x = T.StructField("x", T.ArrayType(T.DoubleType()))
    return table(src.mapInArrow(run, T.StructType([*src.schema.fields[:2], x])), "features")


def _rows(b: pa.RecordBatch) -> np.ndarray:
    return b.column("x").flatten().to_numpy().reshape(-1, N_FEATURES)


def _sums(feats: DataFrame, fn, n: int) -> np.ndarray:
    """The n sums over all rows that ``fn`` (rows of features to n numbers) gives in parts."""

    def run(batches):
        total = sum((fn(_rows(b)) for b in batches if b.num_rows), np.zeros(n))
        yield pa.RecordBatch.from_arrays([pa.array(range(n), pa.int32()), pa.array(total, pa.float64())], names=["i", "v"])

    out = np.zeros(n)
    for r in feats.select("x").mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
        out[r.i] = r.v
    return out


def fit(docs: DataFrame, labels: DataFrame, train: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = MAX_ROWS, feats: DataFrame | None = None) -> Quality:
    """``train``: which rows' labels may be used (a condition on id_col of docs and labels); ``feats``: the
    feature_table of docs, if there is one already."""
    with scratch():
        unlabelled = feats if feats is not None else feature_table(docs if train is None else docs.where(train), id_col, text_col)
        if feats is not None and train is not None:
            unlabelled = feats.withColumnRenamed("id", id_col).where(train).withColumnRenamed(id_col, "id")
        return _fit(unlabelled, labels if train is None else labels.where(train), id_col, label_col, max_rows)


def _fit(feats: DataFrame, labels: DataFrame, id_col: str, label_col: str, max_rows: int) -> Quality:
    y = labels.groupBy(col(id_col).alias("id")).agg(F.avg(col(label_col).cast("double")).alias("y")).where("y > 0.5 and id is not null")
    # Bounded by max_rows, so the join that fetches their features may be a broadcast.
    chosen = y.select("id").orderBy(F.xxhash64("id"), "id").limit(max_rows)
    p = feats.join(F.broadcast(chosen), "id").groupBy("id").agg(F.min_by("x", "th").alias("x")).select("x").toArrow()
    # Any max_rows rows would do to start from; those of least hash are the same at every run.
    u = feats.select("x", "th", "id").orderBy("th", "id").limit(max_rows).select("x").toArrow()
    p, u = (np.array(t["x"].to_pylist(), float).reshape(-1, N_FEATURES) for t in (p, u))
    if not len(p) or not len(u):
        return Quality(0.5)
    d = N_FEATURES
    sums = _sums(feats, lambda x: np.concatenate([[len(x)], x.sum(axis=0), (x * x).sum(axis=0)]), 2 * d + 1)
    mean = sums[1 : d + 1] / sums[0]
    scale = np.maximum(np.sqrt(np.maximum(sums[d + 1 :] / sums[0] - mean * mean, 0)), 1e-3)
    p, u = expand(p, mean, scale), expand(u, mean, scale)

    def margins(w):
        of_u = _sums(feats, lambda x: np.bincount(bin_of(expand(x, mean, scale) @ w), minlength=BINS).astype(float), BINS)
        return np.bincount(bin_of(p @ w), minlength=BINS).astype(float), of_u

    prior = estimate_prior(*margins(fit_contrast(p, u)))
    w = fit_start(p, u, prior)

    def all_rows(w):
        def part(x):
            z = expand(x, mean, scale)
            s = _sigmoid(z @ w)
            return np.concatenate([[len(z), s.sum()], (s * (1 - s)) @ z])

        got = _sums(feats, part, len(w) + 2)
        return got[1] / got[0], got[2:] / got[0]

    # From the start on, the risk of all rows; a step along the gradient that doesn't lower it is halved.
    value, grad = risk(w, p, all_rows(w), prior)
    size = 4.0
    for _ in range(STEPS):
        new = w - size * grad
        v, g = risk(new, p, all_rows(new), prior)
        if v <= value:
            w, value, grad, size = new, v, g, size * 1.5
        else:
            size /= 4
    # Bins cover +-SPAN whatever the weights' length.
    w = w * (SPAN / 2 / max(np.abs(p @ w).max(), np.abs(u @ w).max(), 1e-9))
    return Quality(prior, mean, scale, w, fit_map(*margins(w), prior))


def with_quality(docs: DataFrame, model: Quality, text_col: str = "text", out_col: str = "score", least: float | None = None) -> DataFrame:
    """``docs`` with the score of each text; with ``least``, only rows of that score, without the score."""
    cols = [c for c in docs.columns if c != out_col or least is not None]
    src = docs.select(*[col(c) for c in cols])
    at = cols.index(text_col)

    def run(batches):
        for b in batches:
            x = np.array([features(t) for t in b.column(at).to_pylist()]).reshape(-1, N_FEATURES)
            s = model.score(x)
            if least is not None:
                yield b.filter(pa.array(s >= least))
            else:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64())], names=[*cols, out_col])

    return map_arrow(src, run, src.schema if least is not None else T.StructType([*src.schema.fields, T.StructField(out_col, T.DoubleType())]))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    # The features serve the fit and the scores, so the texts are read once.
    feats = feature_table(docs)
    model = fit(docs, labels, fold("doc_id", 4) != 2, feats=feats)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(model.score(_rows(b)), pa.float64())], names=["doc_id", "score"])

    out = feats.select("id", "x").mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
