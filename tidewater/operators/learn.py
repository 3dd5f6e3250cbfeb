"""Classical machine learning with Spark ML: features, trees, search, importances, learning curves, neighbours."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import PolynomialExpansion, StandardScaler, UnivariateFeatureSelector, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.recommendation import ALS
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.operators.ensemble import AdaBoost, RandomFourierFeatures, without_summaries


def features(df: DataFrame, cols: Sequence[str], label: str, keep: Sequence[str] = ()) -> DataFrame:
    """(keep, features, label): columns, or one array column, as a vector; rows with a null are left out."""
    if len(cols) == 1 and df.schema[cols[0]].dataType.typeName() == "array":
        out = df.withColumn("features", array_to_vector(F.transform(cols[0], lambda x: x.cast("double"))))
    else:
        out = VectorAssembler(inputCols=list(cols), outputCol="features", handleInvalid="skip").transform(df)
    return out.where(F.col(label).isNotNull()).select(*keep, "features", F.col(label).cast("double").alias("label"))


def polynomial(df: DataFrame, cols: Sequence[str], degree: int) -> DataFrame:
    """``df`` with ``poly``: all products of the columns up to the degree, after the constant 1."""
    wide = VectorAssembler(inputCols=list(cols), outputCol="__v", handleInvalid="keep").transform(df)
    out = PolynomialExpansion(degree=degree, inputCol="__v", outputCol="__p").transform(wide)
    return out.withColumn("poly", F.concat(F.array(F.lit(1.0)), vector_to_array("__p"))).drop("__v", "__p")


def standardised(df: DataFrame, cols: Sequence[str], population: bool = False) -> DataFrame:
    """``df`` with ``z``: each column less its mean, by its sample deviation (``population``: by that of the whole)."""
    wide = VectorAssembler(inputCols=list(cols), outputCol="__v").transform(df)
    z = StandardScaler(inputCol="__v", outputCol="__z", withMean=True).fit(wide).transform(wide)
    out = vector_to_array("__z")
    if population:
        n = df.count()
        out = F.transform(out, lambda x: x * F.sqrt(F.lit(n / max(n - 1, 1))))
    return z.withColumn("z", out).drop("__v", "__z")


#: Models by name: trees, a forest, boosted trees, reweighted stumps and the logistic neuron.
MODELS = {
    "tree": lambda: DecisionTreeClassifier(maxDepth=5, seed=1),
    "forest": lambda: RandomForestClassifier(numTrees=20, maxDepth=5, seed=1),
    "boosted": lambda: GBTClassifier(maxIter=10, maxDepth=3, seed=1),
    "adaboost": lambda: AdaBoost(rounds=10, depth=1),
    "neuron": lambda: LogisticRegression(maxIter=50),
}


def kernel_machine(width: int, size: int = 256, gamma: float = 0.5) -> Pipeline:
    """Scaling, random Fourier features of ``width`` numbers, and a linear machine."""
    scaler = StandardScaler(inputCol="features", outputCol="scaled", withMean=True)
    return Pipeline(stages=[scaler, RandomFourierFeatures(width=width, inputCol="scaled", outputCol="fourier", size=size, gamma=gamma), LinearSVC(featuresCol="fourier", maxIter=50, regParam=1e-4)])


def prepared(model, degree: int = 1, top: int | None = None) -> Pipeline:
    """A pipeline over ``features``: products up to a degree, the ``top`` of them by ANOVA F, scaled, and the model."""
    stages, at = [], "features"
    if degree > 1:
        stages.append(PolynomialExpansion(degree=degree, inputCol=at, outputCol="poly"))
        at = "poly"
    if top:
        stages.append(UnivariateFeatureSelector(featuresCol=at, outputCol="best", labelCol="label", selectionMode="numTopFeatures").setFeatureType("continuous").setLabelType("categorical").setSelectionThreshold(top))
        at = "best"
    stages.append(StandardScaler(inputCol=at, outputCol="scaled", withMean=True))
    return Pipeline(stages=[*stages, model.copy({model.featuresCol: "scaled"})])


def compare(models: dict[str, Pipeline], train: DataFrame, test: DataFrame, metrics: Sequence[str] = ("accuracy", "f1")) -> list[tuple[str, str, float]]:
    """(model, metric, value) of each pipeline, fitted on one part and measured on the other."""
    out = []
    for name, p in models.items():
        scored = without_summaries(p.fit(train), train.sparkSession).transform(test)
        out += [(name, m, MulticlassClassificationEvaluator(metricName=m).evaluate(scored)) for m in metrics]
    return out


def search(model, draws: dict[str, Sequence], train: DataFrame, folds: int = 4, metric: str = "recallByLabel", seed: int = 1):
    """The best model of a drawn list of settings ({parameter: values, drawn side by side}) by cross-validation."""
    n = len(next(iter(draws.values())))
    grid = [{model.getParam(k): v[i] for k, v in draws.items()} for i in range(n)]
    judge = MulticlassClassificationEvaluator(metricName=metric, metricLabel=1.0)
    return CrossValidator(estimator=model, estimatorParamMaps=grid or ParamGridBuilder().build(), evaluator=judge, numFolds=folds, seed=seed, parallelism=8).fit(train)


def importances(model, names: Sequence[str]) -> list[tuple[str, float]]:
    """The features by importance, greatest first."""
    return sorted(zip(names, map(float, model.featureImportances.toArray()), strict=True), key=lambda x: (-x[1], x[0]))


def learning_curve(model, data: DataFrame, key: str, shares: Sequence[float], folds: int = 4, metric: str = "accuracy") -> list[tuple[float, int, float]]:
    """(share, fold, score): each fold (by a hash of the key) scored by models fitted to shares of the others."""
    h = F.pmod(F.xxhash64(F.lit("fold"), key), F.lit(folds))
    u = F.pmod(F.xxhash64(F.lit("share"), key), F.lit(1 << 20)) / float(1 << 20)
    judge, out = MulticlassClassificationEvaluator(metricName=metric), []
    for k in range(folds):
        test = data.where(h == k)
        out += [(s, k, judge.evaluate(without_summaries(model.fit(data.where((h != k) & (u < s))), data.sparkSession).transform(test))) for s in shares]
    return out


def curve_means(rows: DataFrame) -> DataFrame:
    """(share, mean, folds) of a learning curve's scores."""
    return rows.groupBy("share").agg(F.avg("score").alias("mean"), F.count("*").alias("folds"))


#: Queries and rows of one block of an exact search.
QUERIES, ROWS = 4_096, 65_536


def nearest_neighbours(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """(query, label, votes): the most frequent label (ties: least) of each query's k nearest rows (ties: least id), exactly.

    Both have (id, v array); rows also label.  A query isn't its own neighbour.  Queries and rows are dealt into blocks by a
    hash, and each pair of blocks is one task's matrix product, which gives k rows a query; only these meet."""
    nq, nr = (max(1, -(-df.count() // size)) for df, size in ((queries, QUERIES), (rows, ROWS)))
    block = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    v = F.transform("v", lambda x: x.cast("double")).alias("v")
    q = queries.select(F.col("id").cast("long").alias("id"), v, block(nq).alias("qb"), every(nr).alias("rb"))
    r = rows.select(F.col("id").cast("long").alias("id"), F.col("label").cast("int").alias("label"), v, block(nr).alias("rb"), every(nq).alias("qb"))

    def near(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        if q.empty or r.empty:
            return pd.DataFrame({"query": [], "d2": [], "id": [], "label": []})
        r = r.sort_values("id", ignore_index=True)
        a, b, ids = np.stack(q["v"]), np.stack(r["v"]), r["id"].to_numpy()
        out = []
        for at in range(0, len(a), 64):
            x = a[at : at + 64]
            d2 = ((x[:, None, :] - b[None]) ** 2).sum(axis=2) if b.size < 1 << 18 else (x * x).sum(1)[:, None] + (b * b).sum(1) - 2 * x @ b.T
            d2[q["id"].to_numpy()[at : at + 64, None] == ids] = np.inf
            best = np.argsort(d2, axis=1, kind="stable")[:, :k]
            for i, row in enumerate(best):
                row = row[np.isfinite(d2[i, row])]
                out.append(pd.DataFrame({"query": q["id"].iloc[at + i], "d2": ((x[i] - b[row]) ** 2).sum(axis=1), "id": ids[row], "label": r["label"].to_numpy()[row]}))
        return pd.concat(out)

    found = q.groupBy("qb", "rb").cogroup(r.groupBy("qb", "rb")).applyInPandas(near, "query long, d2 double, id long, label int")
    best = found.groupBy("query").agg(F.slice(F.array_sort(F.collect_list(F.struct("d2", "id", "label"))), 1, k).alias("n"))
    votes = best.select("query", F.explode("n.label").alias("label")).groupBy("query", "label").agg(F.count("*").alias("votes"))
    return votes.groupBy("query").agg(F.max(F.struct("votes", (-F.col("label")).alias("l"))).alias("b")).select("query", (-F.col("b.l")).alias("label"), F.col("b.votes").alias("votes"))


def factorise(ratings: DataFrame, rank: int = 8, steps: int = 8, seed: int = 1):
    """A matrix (user, item, rating) as products of factors, by alternating least squares after the means of users and
    items are taken off: (model, means of users, means of items)."""
    user = ratings.groupBy("user").agg(F.avg("rating").alias("of_user"))
    rest = ratings.join(user, "user").withColumn("rest", F.col("rating") - F.col("of_user"))
    item = rest.groupBy("item").agg(F.avg("rest").alias("of_item"))
    rest = rest.join(item, "item").select("user", "item", (F.col("rest") - F.col("of_item")).cast("float").alias("rating"))
    return ALS(rank=rank, maxIter=steps, seed=seed, coldStartStrategy="drop").fit(rest), user, item


# ---- policy losses


def advantage(reward: Column, value: Column) -> Column:
    return reward - value


def clipped_policy_loss(new: Column, old: Column, adv: Column, clip: float = 0.2, entropy: float = 0.0) -> Column:
    """-mean(min(r a, clip(r) a)) - entropy * mean(-p ln p), for r = new / old probabilities of the actions taken."""
    r = F.try_divide(new, old + 1e-10)
    kept = F.greatest(F.lit(1 - clip), F.least(F.lit(1 + clip), r))
    return F.avg(-F.least(r * adv, kept * adv) - F.lit(entropy) * -(new * F.ln(new + 1e-10)))
