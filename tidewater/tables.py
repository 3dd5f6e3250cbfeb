"""Intermediate tables in the folder that all executors and the driver share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors and the driver share: spark.checkpoint.dir; unset, a local
    folder in local mode only (tests)."""
    set_ = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if set_:
        return set_
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = getattr(shared_dir, "made", None)
    if made is None:
        made = shared_dir.made = "file://" + tempfile.mkdtemp(prefix="tidewater-")
    return made


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else has."""
    return f"{shared_dir(spark)}/tidewater/{name}-{uuid.uuid4().hex}"


def table(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: cuts the lineage, survives lost
    executors, and lets AQE split skewed joins with it."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tidewater_path = path
    if _scratch:
        _scratch[-1].append(out)
    return out


_scratch: list[list[DataFrame]] = []


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes, at its end, the tables that were written within it, but those given to the function it
    yields; these belong to the scratch around it, if there is one."""
    made: list[DataFrame] = []
    kept: list[DataFrame] = []
    _scratch.append(made)

    def keep(t: DataFrame) -> DataFrame:
        kept.append(t)
        return t

    try:
        yield keep
    finally:
        _scratch.pop()
        forget(*[t for t in made if all(t is not k for k in kept)])
        if _scratch:
            _scratch[-1].extend(kept)


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def forget(*tables: DataFrame) -> None:
    """Delete tables that nothing reads any more."""
    for t in tables:
        if hasattr(t, "_tidewater_path"):
            delete(t.sparkSession, t._tidewater_path)
