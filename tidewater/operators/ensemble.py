"""Estimators that Spark ML lacks, and models that are saved while they get better.

AdaBoost (SAMME): weighted trees one after the other.  After each, rows that it got wrong weigh exp(alpha) times as much,
alpha = ln((1 - err) / err) + ln(K - 1); the class of the greatest sum of alphas wins.  A round is a fit, a sum and a written table of
weights; it ends early at a tree that is right everywhere or no better than chance.

Kernel machine: random Fourier features z(x) = sqrt(2 / D) cos(W x + b), with W from a normal distribution of variance 2 gamma, make
z(x) z(y) an unbiased estimate of exp(-gamma |x - y|^2) of standard deviation 1 / sqrt(D / 2) at most; a linear machine
on them separates what one on x can't.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param.shared import HasFeaturesCol, HasInputCol, HasLabelCol, HasOutputCol, HasPredictionCol, Param, Params, TypeConverters
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.tables import delete, forget, new_path, table


class AdaBoost(Estimator, HasFeaturesCol, HasLabelCol, HasPredictionCol):
    """SAMME over trees of ``depth`` (1: stumps), ``rounds`` of them at most."""

    rounds = Param(Params._dummy(), "rounds", "trees at most", TypeConverters.toInt)
    depth = Param(Params._dummy(), "depth", "depth of a tree", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, featuresCol: str = "features", labelCol: str = "label", predictionCol: str = "prediction", rounds: int = 20, depth: int = 1):
        super().__init__()
        self._set(**self._input_kwargs)
        self._setDefault(rounds=20, depth=1)

    def _fit(self, dataset: DataFrame) -> AdaBoostModel:
        f, y, p = self.getFeaturesCol(), self.getLabelCol(), self.getPredictionCol()
        classes = int(dataset.agg(F.max(y)).first()[0] or 0) + 1
        rows = table(dataset.select(F.col(f).alias("features"), F.col(y).cast("double").alias("label"), F.lit(1.0).alias("weight")), "boost")
        tree = DecisionTreeClassifier(maxDepth=self.getOrDefault(self.depth), weightCol="weight", seed=1)
        trees, alphas = [], []
        for _ in range(self.getOrDefault(self.rounds)):
            model = tree.fit(rows)
            missed = (F.col("prediction") != F.col("label")).cast("double")
            scored = model.transform(rows)
            s = scored.agg(F.sum(F.col("weight") * missed).alias("wrong"), F.sum("weight").alias("all"), F.count("*").alias("n")).first()
            err = s.wrong / s.all
            if err >= 1 - 1 / classes:
                break
            alpha = math.log((1 - err) / max(err, 1e-12)) + math.log(max(classes - 1, 1))
            trees.append(model)
            alphas.append(alpha)
            if err == 0:
                break
            # Weights that sum to the number of rows.
            norm = s.n / (s.all - s.wrong + s.wrong * math.exp(alpha))
            nxt = table(scored.select("features", "label", (F.col("weight") * F.exp(alpha * missed) * norm).alias("weight")), "boost")
            forget(rows)
            rows = nxt
        forget(rows)
        return AdaBoostModel(trees, alphas, classes)._set(featuresCol=f, predictionCol=p)


class AdaBoostModel(Model, HasFeaturesCol, HasPredictionCol):
    def __init__(self, trees: Sequence, alphas: Sequence[float], classes: int):
        super().__init__()
        self.trees, self.alphas, self.classes = list(trees), list(alphas), classes

    def _transform(self, dataset: DataFrame) -> DataFrame:
        out, votes = dataset, []
        for i, t in enumerate(self.trees):
            t = t.copy({t.featuresCol: self.getFeaturesCol(), t.predictionCol: f"__p{i}", t.rawPredictionCol: f"__r{i}", t.probabilityCol: f"__q{i}"})
            out = t.transform(out).drop(f"__r{i}", f"__q{i}")
            votes.append((f"__p{i}", self.alphas[i]))
        score = lambda k: sum((F.when(F.col(c) == k, a).otherwise(0.0) for c, a in votes), F.lit(0.0))
        scores = F.array(*[score(k) for k in range(self.classes)])
        best = (F.array_position(scores, F.array_max(scores)) - 1).cast("double")
        return out.withColumn(self.getPredictionCol(), best).drop(*[c for c, _ in votes])


class RandomFourierFeatures(Transformer, HasInputCol, HasOutputCol):
    """``size`` random cosines of a vector of ``width`` numbers, which stand for the kernel exp(-gamma |x - y|^2)."""

    @keyword_only
    def __init__(self, *, width: int, inputCol: str = "features", outputCol: str = "fourier", size: int = 256, gamma: float = 1.0, seed: int = 1):
        super().__init__()
        self._set(inputCol=inputCol, outputCol=outputCol)
        r = np.random.default_rng(seed)
        self.w, self.b = r.normal(0, math.sqrt(2 * gamma), (width, size)), r.uniform(0, 2 * math.pi, size)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        w, b = self.w, self.b

        @F.pandas_udf("array<double>")
        def cosines(v: pd.Series) -> pd.Series:
            if not len(v):
                return pd.Series([], dtype=object)
            return pd.Series(list(np.sqrt(2 / len(b)) * np.cos(np.stack(v.to_numpy()) @ w + b)))

        return dataset.withColumn(self.getOutputCol(), array_to_vector(cosines(vector_to_array(self.getInputCol()))))


# ---- models that are saved while they get better


def log_loss(scored: DataFrame, label: str = "label", probability: str = "probability") -> float:
    """Mean of -ln of the probability given to the true class."""
    p = F.get(vector_to_array(probability), F.col(label).cast("int"))
    return scored.agg(F.avg(-F.ln(F.greatest(p, F.lit(1e-15))))).first()[0]


def without_summaries(model: Model, spark: SparkSession) -> Model:
    """The model, or a pipeline's stages, saved and loaded where they have a summary of their training.

    Summaries of two classes hold the session, and one in which any frame was observed (``Observation``) can't be sent to
    tasks, so a model that has one fails there at its first use (Task not serializable).  Loaded models have none."""
    if isinstance(model, PipelineModel):
        return PipelineModel([without_summaries(s, spark) for s in model.stages])
    if not getattr(model, "hasSummary", False):
        return model
    path = new_path(spark, "model")
    model.write().save(path)
    out = type(model).load(path)
    delete(spark, path)
    return out


def neuron_probability(x: str, model: LogisticRegressionModel) -> Column:
    """The probability of class 1 by a logistic model's own weights, of a vector column."""
    terms = F.zip_with(vector_to_array(x), F.lit(model.coefficients.toArray()), lambda a, w: a * w)
    return 1 / (1 + F.exp(-F.aggregate(terms, F.lit(model.intercept), lambda s, t: s + t)))


def save_best(candidates: Sequence[Pipeline], train: DataFrame, valid: DataFrame, path: str) -> list[tuple[int, float, bool]]:
    """Fits the candidates in turn and saves those that are better on ``valid`` than all before, each under its number, as
    ``path``/version=i with its loss; (version, loss, saved) of all of them.  A candidate is judged as saved; worse ones are deleted."""
    spark, best, out = train.sparkSession, math.inf, []
    for i, c in enumerate(candidates):
        at = f"{path}/version={i}"
        c.fit(train).write().overwrite().save(f"{at}/model")
        loss = log_loss(PipelineModel.load(f"{at}/model").transform(valid))
        if loss < best:
            note = spark.createDataFrame([(i, json.dumps({"loss": loss}))], "version int, note string")
            note.coalesce(1).write.mode("overwrite").json(f"{at}/note")
        else:
            delete(spark, at)
        out.append((i, loss, loss < best))
        best = min(best, loss)
    return out


def load_best(spark: SparkSession, path: str) -> tuple[int, PipelineModel]:
    """The saved model of least loss, and its version."""
    notes = spark.read.schema("version int, note string").json(f"{path}/version=*/note")
    loss = F.get_json_object("note", "$.loss").cast("double")
    version = notes.orderBy(loss, "version").first().version
    return version, PipelineModel.load(f"{path}/version={version}/model")


def score(df: DataFrame, model: PipelineModel, version: int) -> DataFrame:
    """Batch or stream with the model's columns and ``model_version``."""
    return model.transform(df).withColumn("model_version", F.lit(version))
