"""Approximate nearest neighbours by a fitted index of cells.

``fit`` learns cell centres from a bounded sample of rows and, on a part of it, how many cells a query must look into to find the
wanted share of its neighbours.  ``search`` deals every row into the cell of its nearest centre, and queries to the cells of
their nearest ``probes`` centres; cells are cut into blocks of rows, so that a cell of any size is spread over tasks.
``recall`` measures what is found against the exact search.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that the index is fitted on at most, queries of the calibration, rows and queries of a block.
SAMPLE, TRIES, ROWS, QUERIES = 20_000, 200, 16_384, 4_096


@dataclass
class Cells:
    centres: np.ndarray
    probes: int


def _d2(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T, 0)


def fit(rows: DataFrame, k: int, cells: int = 64, share: float = 0.95, rounds: int = 10) -> Cells:
    """Centres and probes from the SAMPLE rows (id, v) of least hash; ``share`` of the k nearest is to be found."""
    got = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").collect()
    if not got:
        return Cells(np.zeros((1, 1)), 1)
    x = np.array([r.v for r in got], float)
    c = x[: max(1, min(cells, len(x) // 4))].copy()
    for _ in range(rounds):
        own = _d2(x, c).argmin(axis=1)
        for j in range(len(c)):
            if (own == j).any():
                c[j] = x[own == j].mean(axis=0)
    own, q = _d2(x, c).argmin(axis=1), x[:TRIES]
    d = _d2(q, x)
    d[np.arange(len(q)), np.arange(len(q))] = np.inf
    near = np.argsort(d, axis=1)[:, : min(k, len(x) - 1)]
    # The place, in the order of a query's cells, of the cell that holds each of its neighbours.
    place = np.argsort(np.argsort(_d2(q, c), axis=1), axis=1)
    at = np.sort(np.concatenate([place[i, own[n]] for i, n in enumerate(near)] or [np.zeros(1, int)]))
    return Cells(c, int(at[min(len(at) - 1, int(np.ceil(share * len(at))))]) + 1 if len(at) else 1)


def _dealt(df: DataFrame, cells: Cells, probes: int) -> DataFrame:
    """Rows (id, v) with each of their ``probes`` nearest cells."""
    c = cells.centres

    def run(parts):
        for p in parts:
            for at in range(0, len(p), 4096):
                some = p.iloc[at : at + 4096]
                near = np.argsort(_d2(np.stack(some["v"].to_numpy()), c), axis=1, kind="stable")[:, :probes]
                yield pd.DataFrame({"id": some["id"].repeat(near.shape[1]), "v": some["v"].repeat(near.shape[1]), "cell": near.ravel().astype("int32")})

    return df.select(F.col("id").cast("long").alias("id"), F.transform("v", lambda x: x.cast("double")).alias("v")).mapInPandas(run, "id long, v array<double>, cell int")


def search(queries: DataFrame, rows: DataFrame, k: int, cells: Cells) -> DataFrame:
    """(query, id, d2): up to k rows (id, v) near each query (id, v), not itself."""
    held = _dealt(rows, cells, 1)
    sizes = held.groupBy("cell").agg(F.ceil(F.count("*") / ROWS).cast("int").alias("blocks"))
    held = held.join(sizes, "cell").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    asked = _dealt(queries, cells, cells.probes).join(sizes, "cell").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))

    def near(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        if q.empty or r.empty:
            return pd.DataFrame({"query": [], "id": [], "d2": []})
        a, b, ids, out = np.stack(q["v"].to_numpy()), np.stack(r["v"].to_numpy()), r["id"].to_numpy(), []
        for at in range(0, len(a), QUERIES):
            d = _d2(a[at : at + QUERIES], b)
            own = q["id"].to_numpy()[at : at + QUERIES]
            d[own[:, None] == ids] = np.inf
            best = np.argsort(d, axis=1, kind="stable")[:, :k]
            found = pd.DataFrame({"query": own.repeat(best.shape[1]), "id": ids[best].ravel(), "d2": np.take_along_axis(d, best, axis=1).ravel()})
            out.append(found[np.isfinite(found["d2"])])
        return pd.concat(out)

    got = asked.drop("blocks").groupBy("cell", "block").cogroup(held.drop("blocks").groupBy("cell", "block")).applyInPandas(near, "query long, id long, d2 double")
    best = got.groupBy("query").agg(F.slice(F.array_sort(F.collect_list(F.struct("d2", "id"))), 1, k).alias("n"))
    return best.select("query", F.inline("n")).select("query", "id", "d2")


def recall(queries: DataFrame, rows: DataFrame, k: int, cells: Cells) -> DataFrame:
    """(query, found, k): of each query's exact k nearest, how many the index finds."""
    everything = Cells(cells.centres, len(cells.centres))
    exact, got = search(queries, rows, k, everything), search(queries, rows, k, cells)
    hit = exact.join(got.select("query", "id", F.lit(1).alias("hit")), ["query", "id"], "left")
    return hit.groupBy("query").agg(F.count("hit").alias("found"), F.count("*").alias("k"))
