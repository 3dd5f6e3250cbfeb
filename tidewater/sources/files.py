"""Readers of files, each with a declared schema, and writers."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def csv(spark: SparkSession, path: str, schema: str, header: bool = True) -> DataFrame:
    """Rows of CSV files; cells that don't fit their type are null."""
    return spark.read.schema(schema).csv(path, header=header, mode="PERMISSIVE")


GAME_LOG = "game int, score array<double>, cycles array<int>, elapse array<array<long>>, lossActor array<double>, lossCritic array<double>"


def game_log(spark: SparkSession, path: str) -> DataFrame:
    """(log, game, score, cycles, play_ms, train_ms, loss_actor, loss_critic): one row a game of logs that hold
    one list a measure, position by position; a shorter or missing list gives nulls."""
    doc = spark.read.schema(GAME_LOG).json(path, multiLine=True).withColumn("log", F.col("_metadata.file_name"))
    lists = ["score", "cycles", "elapse", "lossActor", "lossCritic"]
    doc = doc.withColumns({c: F.coalesce(c, F.array().cast(doc.schema[c].dataType)) for c in lists})
    return unzip(doc, "log", ["score", "cycles", "elapse", "lossActor", "lossCritic"], "game").select(
        "log", "game", "score", "cycles", F.get("elapse", F.lit(0)).alias("play_ms"), F.get("elapse", F.lit(1)).alias("train_ms"),
        F.col("lossActor").alias("loss_actor"), F.col("lossCritic").alias("loss_critic"),
    )


def unzip(df: DataFrame, keep: str, lists: list[str], position: str) -> DataFrame:
    """Parallel lists as rows: (keep, position from 0, one value of each list)."""
    return df.select(keep, F.posexplode(F.arrays_zip(*lists)).alias(position, "__row")).select(keep, position, "__row.*")


def layers(spark: SparkSession, path: str) -> DataFrame:
    """(file, layer, i, j, w): the weights of networks saved as nested JSON lists, layer by row by column."""
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    return explode_layers(text, "file", F.from_json("value", "array<array<array<double>>>"))


def explode_layers(df: DataFrame, keep: str, nested: Column) -> DataFrame:
    out = df.select(keep, F.posexplode(nested).alias("layer", "rows"))
    out = out.select(keep, "layer", F.posexplode("rows").alias("i", "row"))
    return out.select(keep, "layer", "i", F.posexplode("row").alias("j", "w"))


def npy(spark: SparkSession, path: str) -> DataFrame:
    """(file, i, v): the rows of numeric .npy arrays (flattened to one list a row); objects are refused.

    A file is one task's work and must fit it; for large arrays keep Parquet."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                a = np.load(io.BytesIO(raw), allow_pickle=False)
                a = a.reshape(a.shape[0] if a.ndim else 1, -1).astype(float)
                for at in range(0, len(a), 1024):
                    part = a[at : at + 1024]
                    rows = pa.ListArray.from_arrays(pa.array(range(0, part.size + 1, part.shape[1] or 1), pa.int32()), pa.array(part.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array(range(at, at + len(part)), pa.int64()), rows], names=["file", "i", "v"])

    files = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_name").alias("file"), "content")
    return files.mapInArrow(read, "file string, i long, v array<double>")


# ---- writers


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object a line, arrays as lists."""
    df.write.mode("overwrite").json(path)


def as_json(*cols: str) -> Column:
    return F.to_json(F.struct(*cols))


def append_metrics(df: DataFrame, path: str, step: str, metrics: list[str]) -> None:
    """Adds rows (step, metric, value) to a table of metrics."""
    melt_metrics(df, step, metrics).write.mode("append").parquet(path)


def melt_metrics(df: DataFrame, step: str, metrics: list[str]) -> DataFrame:
    wide = df.select(step, *[F.col(m).cast("double").alias(m) for m in metrics])
    return wide.unpivot([step], metrics, "metric", "value").where("value is not null").withColumnRenamed(step, "step")


def best_so_far(runs: DataFrame, by: list[str], step: str, loss: str) -> DataFrame:
    """The rows at which a checkpoint is written that keeps only the best: the loss is less than at every step before."""
    from pyspark.sql import Window

    before = F.min(loss).over(Window.partitionBy(*by).orderBy(step).rowsBetween(Window.unboundedPreceding, -1))
    return runs.withColumn("__before", before).where(F.col(loss).isNotNull() & (F.col("__before").isNull() | (F.col(loss) < F.col("__before")))).drop("__before")


def write_observed(df: DataFrame, path: str, **metrics: Column) -> tuple[DataFrame, dict]:
    """``df`` written as Parquet and read back, and aggregates of it that were gathered while it was written."""
    seen = Observation("written")
    df.observe(seen, *[c.alias(n) for n, c in metrics.items()]).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), seen.get
