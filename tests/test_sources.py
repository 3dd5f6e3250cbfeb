"""Readers and writers on files of the test's own, and REST sources on a local server."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlparse

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.functions import scalars as S
from tidewater.sources import files, rest, synthetic


def test_csv_keeps_bad_cells_as_null(spark, tmp_path):
    (tmp_path / "a.csv").write_text("day,price\n2020-01-02,3.5\nnever,x\n2020-01-04,\n")
    rows = files.csv(spark, str(tmp_path), "day date, price double").collect()
    assert sorted((str(r.day), r.price) for r in rows) == [("2020-01-02", 3.5), ("2020-01-04", None), ("None", None)]


def test_game_log(spark, tmp_path):
    doc = {"score": [1.0, 2.0, 3.0], "game": 3, "lossActor": [0.1, 0.2, 0.3], "lossCritic": [0.5], "elapse": [[10, 1], [20, 2], [30, 3]], "cycles": [5, 6, 7]}
    (tmp_path / "g.json").write_text(json.dumps(doc))
    rows = files.game_log(spark, str(tmp_path)).orderBy("game").collect()
    assert [(r.game, r.score, r.cycles, r.play_ms, r.train_ms, r.loss_critic) for r in rows] == [(0, 1.0, 5, 10, 1, 0.5), (1, 2.0, 6, 20, 2, None), (2, 3.0, 7, 30, 3, None)]
    assert {r.log for r in rows} == {"g.json"}


def test_weights_and_arrays(spark, tmp_path):
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "bird.json").write_text(json.dumps([[[1.0, 2.0], [3.0, 4.0]], [[5.0]]]))
    got = {(r.layer, r.i, r.j): r.w for r in files.layers(spark, str(tmp_path / "w")).collect()}
    assert got == {(0, 0, 0): 1, (0, 0, 1): 2, (0, 1, 0): 3, (0, 1, 1): 4, (1, 0, 0): 5}
    (tmp_path / "n").mkdir()
    a = np.arange(5000 * 6).reshape(5000, 2, 3)
    np.save(tmp_path / "n" / "a.npy", a)
    np.save(tmp_path / "n" / "b.npy", np.float32(7))
    rows = {(r.file, r.i): r.v for r in files.npy(spark, str(tmp_path / "n")).collect()}
    assert len(rows) == 5001 and rows["b.npy", 0] == [7.0] and all(rows["a.npy", i] == a[i].ravel().tolist() for i in (0, 1023, 1024, 4999))
    (tmp_path / "o").mkdir()
    np.save(tmp_path / "o" / "c.npy", np.array([{}], dtype=object), allow_pickle=True)
    with pytest.raises(Exception, match="allow_pickle"):
        files.npy(spark, str(tmp_path / "o")).collect()


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, [1.0, 2.0], None), (2, [], "x")], "id int, v array<double>, t string")
    files.write_json(df, str(tmp_path / "j"))
    assert sorted(map(tuple, spark.read.schema(df.schema).json(str(tmp_path / "j")).collect())) == sorted(map(tuple, df.collect()))
    m = spark.createDataFrame([(1, 0.5, None), (2, 0.25, 3)], "epoch int, loss double, score int")
    for _ in range(2):
        files.append_metrics(m, str(tmp_path / "m"), "epoch", ["loss", "score"])
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "m")).collect())) == sorted([(1, "loss", 0.5), (2, "loss", 0.25), (2, "score", 3.0)] * 2)
    runs = spark.createDataFrame([("a", 1, 3.0), ("a", 2, 3.0), ("a", 3, None), ("a", 4, 1.0), ("b", 1, None)], "run string, epoch int, loss double")
    assert sorted((r.run, r.epoch) for r in files.best_so_far(runs, ["run"], "epoch", "loss").collect()) == [("a", 1), ("a", 4)]


class Stub(BaseHTTPRequestHandler):
    seen: list = []

    def do_GET(self):
        q = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
        Stub.seen.append((q, self.headers.get("x-key")))
        status = 200
        if self.path.startswith("/missing"):
            status, body = 404, {}
        elif self.path.startswith("/flaky") and sum(q == s for s, _ in Stub.seen) < 3:
            status, body = 503, {}
        elif "data-reference" in q:
            day = q["from"][:10]
            body = {"values": [[{"timestamp": f"{day}T00:00:00Z", "value": 1.5}, {"timestamp": "bad", "value": None}]]}
        elif "ticker" in q:
            body = {"data": [{"date": d, "Open": 1.0, "High": 3.0, "Low": 0.5, "Close": len(q["ticker"]) + i, "Volume": 9} for i, d in enumerate(["2019-12-31", "2020-01-01", "2020-01-02"])]}
        else:
            body = {"data": [{"day": "2020-01-01", "gas": "5.5", "info": {"name": "n", "url": "u"}}, {"day": None, "gas": "-"}]}
        self.send_response(status)
        self.end_headers()
        self.wfile.write(json.dumps(body).encode())

    def log_message(self, *args):
        pass


@pytest.fixture(scope="module")
def server():
    http = HTTPServer(("127.0.0.1", 0), Stub)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{http.server_port}"
    http.shutdown()


def test_historian_asks_by_tag_and_month(spark, server):
    Stub.seen.clear()
    out = rest.historian(spark, f"{server}/q?", ["T1", "T2"], "2022-01-01", "2022-02-10", "PT20M", {"x-key": "k"}, days=31)
    rows = out.collect()
    assert sorted((r.tag, str(r.ts), r.value) for r in rows) == sorted([(t, ts, v) for t in ("T1", "T2") for ts, v in (("2022-01-01 00:00:00", 1.5), ("2022-02-01 00:00:00", 1.5), ("None", None), ("None", None))])
    asked = {(q["data-reference"], q["from"][:10], q["to"][:10], q["aggregation-period"]) for q, _ in Stub.seen}
    assert asked == {(t, a, b, "PT20M") for t in ("T1", "T2") for a, b in (("2022-01-01", "2022-01-31"), ("2022-02-01", "2022-02-10"))} and {k for _, k in Stub.seen} == {"k"}


def test_flatten_and_retry_and_refusal(spark, server):
    body = rest.fetch(spark, [f"{server}/flaky?a=1"])
    flat = rest.flatten_data(body, "body", "day:string,gas:string,info:struct<name:string,url:string>")
    assert flat.columns == ["day", "gas", "info_name", "info_url"]
    gas = F.expr("try_cast(gas as double)")
    assert sorted(str((r.d, r.gas)) for r in flat.select(S.parse_date(F.col("day")).cast("string").alias("d"), gas.alias("gas")).collect()) == ["('2020-01-01', 5.5)", "(None, None)"]
    with pytest.raises(Exception, match="404"):
        rest.fetch(spark, [f"{server}/missing"]).collect()


def test_market_and_one_level(spark, server):
    q = rest.market(spark, f"{server}/m?", ["AB", "CDE"], "2020-01-01")
    assert q.count() == 2 * 2 * 5
    wide = rest.pick_level(q, "Close", ["AB", "CDE"]).orderBy("date").collect()
    assert [(str(r.date), r.AB, r.CDE) for r in wide] == [("2020-01-01", 3.0, 4.0), ("2020-01-02", 4.0, 5.0)]


def test_synthetic_tables_do_not_depend_on_partitions(spark):
    for make in (lambda: synthetic.points(spark, 200, 50, 20), lambda: synthetic.blobs(spark, 200, [(0, 0), (9, 9)]), lambda: synthetic.circles(spark, 201, noise=0.1)):
        a, b = make(), make().repartition(7)
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert {(r.x >= 0, r.x < 50, r.y < 20) for r in synthetic.points(spark, 500, 50, 20).collect()} == {(True, True, True)}
    assert synthetic.grid(spark, 3, 1, (0, 1), (5, 6)).orderBy("i").collect()[1][2:] == (0.5, 5.0)
