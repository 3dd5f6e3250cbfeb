"""Daily quotes of tickers as a Spark source with pushdown: filters on ticker and date become requests.

``spark.read.format("tidewater_quotes")`` with options ``base``, ``tickers`` (a JSON list), ``start``, ``end`` (dates, both included), ``days``
of a request and ``headers``.  A request asks ``base`` for one ticker from one day to another; the answer is
{"data": [{"date", "Open", "High", "Low", "Close", "Volume"}, ...]}.  A filter takes away tickers and days that it excludes before
anything is asked for; Spark applies it to the rows all the same."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator, Sequence
from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from tidewater.sources.rest import RestReader

FIELDS = ["Open", "High", "Low", "Close", "Volume"]


class QuoteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tidewater_quotes"

    def schema(self) -> str:
        return "ticker string, date date, " + ", ".join(f"{f} double" for f in FIELDS)

    def reader(self, schema) -> DataSourceReader:
        return QuoteReader(dict(self.options))


class QuoteReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.base, self.tickers = options["base"], json.loads(options["tickers"])
        self.first, self.last = (date.fromisoformat(options[k]) for k in ("start", "end"))
        self.days, self.headers = int(options.get("days", "365")), json.loads(options.get("headers", "{}"))

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            self._narrow(f)
            yield f

    def _narrow(self, f: Filter) -> None:
        column = getattr(f, "attribute", None)
        if column == ("ticker",) and isinstance(f, EqualTo | In):
            wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
            self.tickers = [t for t in self.tickers if t in wanted]
        elif column == ("date",) and isinstance(getattr(f, "value", None), date):
            day = timedelta(days=1)
            if isinstance(f, EqualTo | GreaterThanOrEqual):
                self.first = max(self.first, f.value)
            if isinstance(f, EqualTo | LessThanOrEqual):
                self.last = min(self.last, f.value)
            if isinstance(f, GreaterThan):
                self.first = max(self.first, f.value + day)
            if isinstance(f, LessThan):
                self.last = min(self.last, f.value - day)

    def partitions(self) -> Sequence[InputPartition]:
        out = []
        for t in self.tickers:
            at = self.first
            while at <= self.last:
                to = min(at + timedelta(days=self.days - 1), self.last)
                out.append(InputPartition((t, f"{self.base}ticker={t}&start={at}&end={to}")))
                at = to + timedelta(days=1)
        return out or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition.value is None:
            return
        ticker, url = partition.value
        for _, body in RestReader([url], self.headers, 3).read(InputPartition(url)):
            for r in json.loads(body)["data"]:
                yield (ticker, datetime.fromisoformat(r["date"]).date(), *[None if r.get(f) is None else float(r[f]) for f in FIELDS])


def quotes(spark: SparkSession, base: str, tickers: Sequence[str], start: str, end: str, headers: dict[str, str] | None = None, days: int = 365) -> DataFrame:
    """(ticker, date, Open, High, Low, Close, Volume) of each ticker and day; filters on either become fewer requests."""
    spark.dataSource.register(QuoteSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    options = {"base": base, "tickers": json.dumps(list(tickers)), "start": start, "end": end, "days": str(days), "headers": json.dumps(headers or {})}
    return spark.read.format(QuoteSource.name()).options(**options).load()
