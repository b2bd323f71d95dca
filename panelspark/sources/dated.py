"""A data source of dated rows by ticker over HTTP: filtered batches, and a stream that fetches what is new."""

from __future__ import annotations

import datetime as dt
import json
import urllib.error
from collections.abc import Iterator
from urllib.parse import urlencode

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import BooleanType, DataType, DateType, DoubleType, FloatType, IntegerType, LongType, ShortType, StructType, TimestampType

from panelspark.sources.http import fetch

DAY = dt.timedelta(days=1)


class Window(InputPartition):
    """A ticker's dates from start to end, both included."""

    def __init__(self, ticker: str, start: dt.date, end: dt.date):
        self.ticker, self.start, self.end = ticker, start, end


def windows(ticker: str, start: dt.date, end: dt.date, years: int) -> Iterator[Window]:
    """Windows of at most so many years that together are start to end."""
    while start <= end:
        month = dt.date(start.year + years, start.month, 1)
        last = min(end, month + DAY * (start.day - 1) - DAY)
        yield Window(ticker, start, last)
        start = last + DAY


def cast(value, kind: DataType):
    """A JSON value as a column's type; None where it can't be read as that."""
    try:
        if value is None:
            return None
        if isinstance(kind, DateType):
            return dt.date.fromisoformat(str(value)[:10])
        if isinstance(kind, TimestampType):
            return dt.datetime.fromisoformat(str(value))
        if isinstance(kind, (DoubleType, FloatType)):
            return float(value)
        if isinstance(kind, (LongType, IntegerType, ShortType)):
            return int(value)
        return bool(value) if isinstance(kind, BooleanType) else value if isinstance(value, str) else json.dumps(value)
    except (ValueError, TypeError):
        return None


class _Api:
    """What the options say: where to ask, for whom, and how rows become columns."""

    def __init__(self, schema: StructType, options):
        self.schema, self.url, self.base = schema, options["url"], float(options.get("base", 1.0))
        self.years, self.rows = int(options.get("years", 1)), options.get("rows")
        self.ticker, self.date = options.get("ticker_column", "ticker"), options.get("date_column", "trade_date")
        self.first = dt.date.fromisoformat(options["start"])
        self.options = {k: options.get(k) for k in ("tickers", "tickers_url", "end", "latest_url")}
        self.source = {v: k for k, v in json.loads(options.get("rename", "{}")).items()}

    def tickers(self) -> list[str]:
        if self.options["tickers"]:
            return sorted({t.strip() for t in self.options["tickers"].split(",")} - {""})
        return sorted(set(fetch(self.options["tickers_url"], base=self.base)))

    def last(self) -> dt.date:
        if self.options["latest_url"]:
            return dt.date.fromisoformat(fetch(self.options["latest_url"], base=self.base)["date"])
        return dt.date.fromisoformat(self.options["end"]) if self.options["end"] else dt.date.today()

    def get(self, window: Window) -> Iterator[tuple]:
        mark = "&" if "?" in self.url else "?"
        try:
            found = fetch(f"{self.url}{mark}{urlencode({'ticker': window.ticker, 'start': window.start, 'end': window.end})}", base=self.base)
        except urllib.error.HTTPError as e:
            if e.code != 404:
                raise
            return
        for row in found[self.rows] if self.rows else found:
            at = cast(row.get(self.source.get(self.date, self.date)), DateType())
            if at is not None and window.start <= at <= window.end:
                yield tuple(window.ticker if f.name == self.ticker else cast(row.get(self.source.get(f.name, f.name)), f.dataType) for f in self.schema.fields)


class DatedReader(DataSourceReader):
    """Asks for the tickers and dates that filters leave. Spark applies the filters again to what comes."""

    def __init__(self, api: _Api):
        self.api, self.only, self.start, self.end = api, None, api.first, None

    def pushFilters(self, filters):
        for f in filters:
            name = ".".join(getattr(f, "attribute", ()))
            value = getattr(f, "value", None)
            if name == self.api.ticker and isinstance(f, (EqualTo, In)):
                asked = set(value) if isinstance(f, In) else {value}
                self.only = asked if self.only is None else self.only & asked
            elif name == self.api.date and isinstance(value, dt.date) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.start = max(self.start, value + DAY * isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    last = value - DAY * isinstance(f, LessThan)
                    self.end = last if self.end is None else min(self.end, last)
            yield f

    def partitions(self) -> list[Window]:
        tickers = self.api.tickers() if self.api.options["tickers"] or self.api.options["tickers_url"] else sorted(self.only or ())
        end = self.api.last() if self.end is None else min(self.end, self.api.last())
        return [w for t in tickers if self.only is None or t in self.only for w in windows(t, self.start, end, self.api.years)]

    def read(self, partition: Window) -> Iterator[tuple]:
        return self.api.get(partition)


class DatedStream(DataSourceStreamReader):
    """The offset is the last date fetched and the tickers it holds for; Spark's checkpoint keeps it. A ticker that is new gets
    its whole history, the others the days after the mark."""

    def __init__(self, api: _Api):
        self.api = api

    def initialOffset(self) -> dict:
        return {"date": str(self.api.first - DAY), "tickers": []}

    def latestOffset(self) -> dict:
        return {"date": str(self.api.last()), "tickers": self.api.tickers()}

    def partitions(self, start: dict, end: dict) -> list[Window]:
        known, last = set(start["tickers"]), dt.date.fromisoformat(end["date"])
        begin = lambda t: dt.date.fromisoformat(start["date"]) + DAY if t in known else self.api.first
        return [w for t in end["tickers"] for w in windows(t, begin(t), last, self.api.years)]

    def read(self, partition: Window) -> Iterator[tuple]:
        return self.api.get(partition)

    def commit(self, end: dict) -> None:
        """Nothing to do: the checkpoint holds the offset."""


class DatedJson(DataSource):
    """format("dated_json"), for read and readStream: `url` is asked with ticker, start and end, and answers a list of objects,
    or an object that holds it under the option `rows`. Options: url, start (first date), end or latest_url (an object with
    `date`; today without either), tickers (comma-separated) or tickers_url (a list), years (1: longest window of a request),
    rename (JSON, a field's name to the column's), ticker_column, date_column, base (1.0: first wait in seconds).

    A partition is a ticker's window. Fields go to columns by name and are read as the column's type, null where that fails or
    the field is missing; rows outside the window, or without a date, are left out. An unknown ticker (404) has no rows. Batches
    need spark.sql.python.filterPushdown.enabled: filters on ticker and date go into the requests.
    """

    @classmethod
    def name(cls) -> str:
        return "dated_json"

    def schema(self) -> str:
        raise ValueError("dated_json needs a schema")

    def reader(self, schema) -> DatedReader:
        return DatedReader(_Api(schema, self.options))

    def streamReader(self, schema) -> DatedStream:
        return DatedStream(_Api(schema, self.options))
