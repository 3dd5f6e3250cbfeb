"""Sessions, and the package on the executors."""

from __future__ import annotations

import atexit
import io
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: Defaults for a session of our own; a given session is used as it is.
CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def session(master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session for analytics: UTC, AQE on, Arrow on; partitions by scale (twice the cores, locally)."""
    builder = SparkSession.builder.appName("tidewater").config(map=CONF | {k.replace("__", "."): v for k, v in conf.items()})
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", shuffle_partitions)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> SparkSession:
    """Make this package importable in Python workers wherever they run (what --py-files does)."""
    sc = spark.sparkContext
    if getattr(sc, "_tidewater_shipped", False):
        return spark
    here = Path(__file__).resolve().parent
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, p.relative_to(here.parent))
    fd, path = tempfile.mkstemp(prefix="tidewater-", suffix=".zip")
    with os.fdopen(fd, "wb") as f:
        f.write(buf.getvalue())
    # Executors fetch it when they start, so it stays until the driver ends.
    atexit.register(lambda: os.path.exists(path) and os.unlink(path))
    sc.addPyFile(path)
    sc._tidewater_shipped = True
    return spark
