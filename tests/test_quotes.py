"""Pushdown of filters into requests, counted by the server."""

import json
import threading
from datetime import date, timedelta
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from tidewater.sources.quotes import quotes


@pytest.fixture()
def server():
    asked = []

    class Answer(BaseHTTPRequestHandler):
        def do_GET(self):
            q = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
            asked.append((q["ticker"], q["start"], q["end"]))
            at, rows = date.fromisoformat(q["start"]), []
            while at <= date.fromisoformat(q["end"]):
                rows.append({"date": str(at), "Open": at.day, "Close": len(q["ticker"]), "Volume": None})
                at += timedelta(days=1)
            body = json.dumps({"data": rows}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    s = ThreadingHTTPServer(("127.0.0.1", 0), Answer)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}/q?", asked
    s.shutdown()


def test_filters_become_requests(spark, server):
    base, asked = server
    df = quotes(spark, base, ["A", "BB", "CCC"], "2022-01-01", "2022-03-31", days=31)

    def rows(where):
        asked.clear()
        return sorted((r.ticker, str(r.date)) for r in (df if where is None else df.where(where)).collect())

    assert len(rows(None)) == 270 and len(asked) == 9
    assert len(rows("ticker = 'BB'")) == 90 and {a[0] for a in asked} == {"BB"} and len(asked) == 3
    assert len(rows("ticker IN ('A', 'CCC') AND date >= DATE'2022-03-30'")) == 4 and sorted(asked) == [("A", "2022-03-30", "2022-03-31"), ("CCC", "2022-03-30", "2022-03-31")]
    assert rows("date = DATE'2022-02-02' AND ticker = 'A'") == [("A", "2022-02-02")] and asked == [("A", "2022-02-02", "2022-02-02")]
    assert len(rows("date > DATE'2022-01-30' AND date < DATE'2022-02-02'")) == 6 and {a[1:] for a in asked} == {("2022-01-31", "2022-02-01")}
    assert rows("ticker = 'none'") == [] and asked == []
    assert rows("date > DATE'2023-01-01'") == [] and asked == []
    # What can't be pushed is still applied.
    assert len(rows("Open > 30")) == 6 and len(asked) == 9
    asked.clear()
    assert df.where("ticker = 'A'").agg(F.sum("Close"), F.count("Volume")).first()[:] == (90.0, 0)
    assert len(asked) == 3
