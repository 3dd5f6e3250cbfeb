"""The index of cells: exact with all cells, recall with the calibrated number, hot cells in blocks."""

import numpy as np
from pyspark.sql import functions as F

from tests.compare import SF
from tidewater import plans
from tidewater.operators import index as I


def frame(spark, x):
    return spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "id long, v array<double>")


def test_all_cells_give_the_exact_neighbours(spark, monkeypatch):
    r = np.random.default_rng(1)
    # Two thirds of all rows are one point's surroundings.
    x = np.concatenate([r.normal(size=(200, 4)) * 5, r.normal(size=(400, 4)) * 0.1])
    df = frame(spark, x)
    monkeypatch.setattr(I, "ROWS", 50)
    cells = I.fit(df, 5, cells=8)
    got = {}
    for row in I.search(df.where("id % 10 = 0"), df, 5, I.Cells(cells.centres, len(cells.centres))).collect():
        got.setdefault(row.query, set()).add(row.id)
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    assert all(got[i] == set(np.argsort(d[i])[:5]) for i in range(0, 600, 10))
    found = I.recall(df.where("id % 10 = 0"), df, 5, cells).agg(F.sum("found") / F.sum("k")).first()[0]
    assert found >= 0.9 and cells.probes < len(cells.centres)


def test_recall_of_the_query(spark):
    rows = plans.QUERIES["approximate_neighbours"](spark, SF).collect()
    assert len(rows) == 5 and sum(r.found for r in rows) / sum(r.k for r in rows) >= 0.9


def test_no_rows(spark):
    none = frame(spark, [])
    assert I.search(none, none, 3, I.fit(none, 3)).count() == 0
