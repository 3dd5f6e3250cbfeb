"""Table functions: rows from arguments, as a training loop yields a record an episode."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf


class Episodes:
    """(episode, step, eps): the steps of an agent's episodes with their exploration rate, falling to ``last`` in ``steps`` steps."""

    def eval(self, agent: int, episodes: int, length: int, first: float, last: float, steps: int) -> Iterator[tuple[int, int, float]]:
        t = 0
        for e in range(episodes):
            # Agents of odd numbers stop a step earlier.
            for s in range(length - agent % 2):
                yield e, s, first + (last - first) * min(t, steps - 1) / (steps - 1)
                t += 1


def register(spark: SparkSession) -> str:
    """Makes the function known to SQL and lateral joins; its name."""
    spark.udtf.register("tidewater_episodes", udtf(Episodes, returnType="episode int, step int, eps double"))
    return "tidewater_episodes"
