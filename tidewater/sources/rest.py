"""REST services as a Spark source: one partition a request, fetched on the executors."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Iterator, Sequence
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidewater.functions import scalars as S


class RestSource(DataSource):
    """``spark.read.format("tidewater_rest")``: option ``urls`` (a JSON list) and ``headers`` (a JSON object); rows (url, body)."""

    @classmethod
    def name(cls) -> str:
        return "tidewater_rest"

    def schema(self) -> str:
        return "url string, body string"

    def reader(self, schema) -> DataSourceReader:
        return RestReader(json.loads(self.options["urls"]), json.loads(self.options.get("headers", "{}")), int(self.options.get("tries", "3")))


class RestReader(DataSourceReader):
    def __init__(self, urls: list[str], headers: dict[str, str], tries: int):
        self.urls, self.headers, self.tries = urls, headers, tries

    def partitions(self) -> Sequence[InputPartition]:
        return [InputPartition(u) for u in self.urls]

    def read(self, partition: InputPartition) -> Iterator[tuple[str, str]]:
        url = partition.value
        for k in range(self.tries):
            try:
                with urllib.request.urlopen(urllib.request.Request(url, headers=self.headers), timeout=60) as answer:
                    yield url, answer.read().decode("utf-8")
                return
            except urllib.error.HTTPError as e:
                # What the service refuses it refuses again; only its own failures pass.
                if e.code < 500 or k + 1 == self.tries:
                    raise
            except urllib.error.URLError:
                if k + 1 == self.tries:
                    raise
            time.sleep(0.2 * 2**k)


def fetch(spark: SparkSession, urls: Sequence[str], headers: dict[str, str] | None = None) -> DataFrame:
    """(url, body) of every address; headers come from the caller's configuration, never from here."""
    spark.dataSource.register(RestSource)
    return spark.read.format(RestSource.name()).option("urls", json.dumps(list(urls))).option("headers", json.dumps(headers or {})).load()


SERIES = "array<struct<timestamp:string,value:double>>"


def historian(spark: SparkSession, base: str, tags: Sequence[str], start: str, end: str, period: str, headers: dict[str, str] | None = None, days: int = 31) -> DataFrame:
    """(tag, ts, value) of a historian's tags from ``start`` to ``end`` (dates, both included), as its means over ``period``.

    A request asks for one tag and ``days`` days at most, so that a long time of many tags is many partitions."""
    urls, at, last = [], datetime.fromisoformat(start), datetime.fromisoformat(end)
    while at <= last:
        to = min(at + timedelta(days=days - 1), last)
        span = f"from={at:%Y-%m-%d}T00%3A00%3A00.000Z&to={to:%Y-%m-%d}T23%3A59%3A59.000Z"
        urls += [f"{base}data-reference={t}&aggregation=TIME&aggregation-function=MEAN&{span}&aggregation-period={period}" for t in tags]
        at = to + timedelta(days=1)
    bodies = fetch(spark, urls, headers).withColumn("tag", F.regexp_extract("url", r"data-reference=([^&]*)", 1))
    return inline_series(bodies, "tag", "body")


def inline_series(df: DataFrame, tag: str, body: str) -> DataFrame:
    """(tag, ts, value) of answers {"values": [[{"timestamp", "value"}, ...]]}; a bad timestamp is null."""
    values = F.from_json(body, f"values array<{SERIES}>")["values"]
    rows = df.select(tag, F.inline(F.flatten(values)))
    return rows.select(tag, S.parse_any(F.col("timestamp")).alias("ts"), "value")


def flatten_data(df: DataFrame, body: str, schema: str) -> DataFrame:
    """The records of answers {"data": [...]} as rows; nested fields come out as parent_child."""
    rows = df.select(F.inline(F.from_json(body, f"data array<struct<{schema}>>")["data"]))
    flat = []
    for f in rows.schema.fields:
        inner = getattr(f.dataType, "names", None)
        flat += [F.col(f"`{f.name}`.`{n}`").alias(f"{f.name}_{n}") for n in inner] if inner else [F.col(f"`{f.name}`")]
    return rows.select(*flat)


def market(spark: SparkSession, base: str, tickers: Sequence[str], start: str, headers: dict[str, str] | None = None) -> DataFrame:
    """(date, ticker, field, value) of daily quotes from ``start`` on, a request a ticker; answers are
    {"data": [{"date", "Open", "High", "Low", "Close", "Volume"}, ...]}."""
    fields = ["Open", "High", "Low", "Close", "Volume"]
    body = fetch(spark, [f"{base}ticker={t}&start={start}" for t in tickers], headers)
    body = body.withColumn("ticker", F.regexp_extract("url", r"ticker=([^&]*)", 1))
    schema = "data array<struct<date:string," + ",".join(f"{f}:double" for f in fields) + ">>"
    rows = body.select("ticker", F.inline(F.from_json("body", schema)["data"]))
    rows = rows.unpivot(["ticker", "date"], fields, "field", "value")
    return rows.select(S.parse_date(F.col("date")).alias("date"), "ticker", "field", "value").where(F.col("date") >= F.lit(start).cast("date"))


def pick_level(quotes: DataFrame, field: str, tickers: Sequence[str]) -> DataFrame:
    """(date, a column a ticker): one field of long quotes, side by side."""
    return quotes.where(F.col("field") == field).groupBy("date").pivot("ticker", list(tickers)).agg(F.first("value"))
