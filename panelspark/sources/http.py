"""A data source of paged JSON over HTTP, with retries."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Iterator
from urllib.parse import urlencode

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Answers after which a request is made again.
RETRIED = (429, 500, 502, 503, 504)


def fetch(url: str, tries: int = 5, base: float = 1.0, longest: float = 60.0, timeout: float = 30.0):
    """The JSON at a URL. Busy or failing servers, broken connections and empty answers are asked again after base * 2^k
    seconds, at most `longest`; other answers of 400 and above fail at once."""
    for k in range(tries):
        try:
            with urllib.request.urlopen(url, timeout=timeout) as answer:
                if body := answer.read():
                    return json.loads(body)
                problem: Exception = ValueError(f"empty answer from {url}")
        except urllib.error.HTTPError as e:
            if e.code not in RETRIED:
                raise
            problem = e
        except (urllib.error.URLError, TimeoutError, ConnectionError) as e:
            problem = e
        if k < tries - 1:
            time.sleep(min(base * 2**k, longest))
    raise problem


class Pages(InputPartition):
    def __init__(self, first: int, step: int):
        self.first, self.step = first, step


class PagedReader(DataSourceReader):
    def __init__(self, schema, options):
        self.names = schema.fieldNames()
        self.url, self.limit = options["url"], int(options.get("limit", 100))
        self.parallel, self.base = int(options.get("parallel", 4)), float(options.get("base", 1.0))

    def partitions(self) -> list[Pages]:
        return [Pages(k, self.parallel) for k in range(self.parallel)]

    def read(self, partition: Pages) -> Iterator[tuple]:
        page = partition.first
        while True:
            mark = "&" if "?" in self.url else "?"
            try:
                rows = fetch(f"{self.url}{mark}{urlencode({'limit': self.limit, 'offset': page * self.limit})}", base=self.base)
            except urllib.error.HTTPError as e:
                if e.code != 404 or not page:
                    raise
                return  # a page past the end
            yield from (tuple(r.get(k) for k in self.names) for r in rows)
            if len(rows) < self.limit:
                return
            page += partition.step


class PagedJson(DataSource):
    """format("paged_json"): a list of objects a page, asked by limit and offset until a page is short. Options: url, limit
    (100), parallel (4: so many tasks, of which task k reads pages k, k + parallel, ...), base (1.0: first wait in seconds).
    The schema names the objects' fields; those that are missing are null. A page
    after the first that isn't found (404) is past the end. A task that runs again reads its pages again."""

    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def schema(self) -> str:
        raise ValueError("paged_json needs a schema")

    def reader(self, schema) -> PagedReader:
        return PagedReader(schema, self.options)
