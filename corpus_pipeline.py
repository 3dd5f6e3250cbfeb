"""The corpus pipeline: quality, line dedup, near-duplicates, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
back as the next stage's docs.  All but the last return the columns of documents; the last adds
mix_block, mix_slot, mix_rank and mixed (see tidewater.llm.mixing) to all rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewater.llm import decontam, line_dedup, minhash, mixing, pu_quality
from tidewater.llm.shared import forget, scratch, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (score under 0.7) go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return pu_quality.with_quality(docs, pu_quality.fit(docs, labels), least=pu_quality.THRESHOLD)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of passages of three lines or more go, and documents of which nothing is left after that."""
    return line_dedup.line_dedup(docs, emptied=False)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents alike to 0.8 on five-word shingles the one with the smallest id stays."""
    return minhash.near_dedup(docs, k=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, up to the error budget, go."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document gets its place in the mixture of the target weights."""
    return mixing.mix(docs, mixing.TARGET)


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing", mixture),
]
#: SQL can't express a trained classifier or an edit distance search; tests/llm/test_pipeline.py holds it against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with scratch() as keep:
            out = keep(table(stage(spark, docs, sf_dir), name.replace(" ", "-")))
        forget(docs)
        docs = out
    return STAGES[-1][1](spark, docs, sf_dir)
