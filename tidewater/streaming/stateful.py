"""Structured Streaming forms of the ordered operators, and a driver-free way to run them to the end of their input."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def event_time(df: DataFrame, ts: str) -> DataFrame:
    """The column as a timestamp with zone, which watermarks need."""
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


def bucket_means(df: DataFrame, ts: str, value: str, width: str, by: list[str], late: str | None = None) -> DataFrame:
    """(start, by, mean, n): means over tumbling windows; on a stream, rows later than ``late`` are left out and a
    window's state goes when it is over."""
    rows = event_time(df, ts)
    if late:
        rows = rows.withWatermark(ts, late)
    out = rows.groupBy(F.window(ts, width), *by).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))
    return out.select(F.col("window.start").alias("start"), *by, "mean", "n")


def episodes(stream: DataFrame, key: str, order: list[str], reward: str, done: str) -> DataFrame:
    """(key, episode, total, steps): per key, a row for each episode when its last step (``done``) comes.

    The state of a key is three numbers.  Steps of a key must come in order over the micro-batches; inside one they are sorted."""

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        number, total, steps = state.get if state.exists else (0, 0.0, 0)
        out = []
        for part in [pd.concat(list(parts))]:
            for r, d in part.sort_values(order)[[reward, done]].itertuples(index=False):
                total, steps = total + r, steps + 1
                if d:
                    out.append((k[0], number, total, steps))
                    number, total, steps = number + 1, 0.0, 0
        state.update((number, total, steps))
        yield pd.DataFrame(out, columns=[key, "episode", "total", "steps"])

    kind = stream.schema[key].dataType.simpleString()
    return stream.groupBy(key).applyInPandasWithState(
        step, f"{key} {kind}, episode long, total double, steps long", "number long, total double, steps long", "append", GroupStateTimeout.NoTimeout
    )


def newest(stream: DataFrame, key: str, order: list[str], item: str, n: int) -> DataFrame:
    """(key, items): after each micro-batch with rows of a key, its n newest items, oldest first: a bounded memory."""
    kinds = {c: stream.schema[c].dataType.simpleString() for c in (key, item)}

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        held = (held + pd.concat(list(parts)).sort_values(order)[item].tolist())[-n:]
        state.update((held,))
        yield pd.DataFrame({key: [k[0]], "items": [held]})

    return stream.groupBy(key).applyInPandasWithState(
        step, f"{key} {kinds[key]}, items array<{kinds[item]}>", f"items array<{kinds[item]}>", "update", GroupStateTimeout.NoTimeout
    )


def decay(stream: DataFrame, key: str, order: list[str], deposit: str, keep: float) -> DataFrame:
    """(key, x): after each micro-batch with rows of a key, x = x * keep + deposit over all its rows so far."""

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        x = state.get[0] if state.exists else 0.0
        for v in pd.concat(list(parts)).sort_values(order)[deposit]:
            x = x * keep + v
        state.update((x,))
        yield pd.DataFrame({key: [k[0]], "x": [x]})

    kind = stream.schema[key].dataType.simpleString()
    return stream.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, x double", "x double", "update", GroupStateTimeout.NoTimeout)


def record_steps(stream: DataFrame, path: str, policy: Callable[[DataFrame], DataFrame]):
    """A writer of the loop observe, act, record: each micro-batch of observations gets its actions and is written
    under its number, so that a repeated batch overwrites itself."""

    def act(batch: DataFrame, number: int) -> None:
        policy(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(act)


def run_to_end(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """What a stream writes for the input that is there now.  In append mode the rows, read back; in update and
    complete mode every micro-batch's rows with its number (``batch``)."""
    if mode == "append":
        out = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    else:
        writer = stream.writeStream.foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(f"{path}/batch={i}"))
        out = writer.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    out.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema.add("batch", "long") if mode != "append" else stream.schema).parquet(path)


def latest(df: DataFrame, keys: list[str]) -> DataFrame:
    """Of update-mode output the last row of each key."""
    cols = [c for c in df.columns if c not in (*keys, "batch")]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*cols), "batch").alias("r")).select(*keys, "r.*")
