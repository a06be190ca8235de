"""A live ordered listing as a Spark data source; partitions are disjoint key ranges.

``register(spark)`` makes ``spark.read.format("keyloom")`` available. Options: ``store`` names an
importable callable ``module:function`` that takes the options and returns a page fetcher, ``prefix``,
``ranges`` (hex keys, comma-separated, that cut the keyspace), ``max_keys``, ``start_after`` (hex),
``retries`` and ``rate`` (pages a second over all partitions).
"""

from __future__ import annotations

import importlib
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "key binary, size bigint, last_modified timestamp, etag string, storage_class string, row_type string"


class TransientError(Exception):
    """A page that may work when it is asked for again."""


class ProtocolError(Exception):
    """A store that doesn't go forward."""


@dataclass(frozen=True)
class PageOf:
    rows: list[tuple]
    truncated: bool


#: (prefix, start_after, max_keys) -> page
Fetcher = Callable[[bytes, bytes | None, int], PageOf]


def scan(fetch: Fetcher, prefix: bytes, after: bytes | None, upto: bytes | None, max_keys: int = 1000, retries: int = 3, pause: float = 0.0) -> Iterator[tuple]:
    """Rows with keys in (after, upto], page by page."""
    while True:
        for attempt in range(retries + 1):
            try:
                page = fetch(prefix, after, max_keys)
                break
            except TransientError:
                if attempt == retries:
                    raise
                time.sleep(min(0.05 * 2**attempt, 2.0))
        if page.truncated and not page.rows:
            raise ProtocolError("an empty page says there is more")
        for row in page.rows:
            if after is not None and row[0] <= after:
                raise ProtocolError("keys don't rise")
            after = row[0]
            if upto is not None and after > upto:
                return
            yield row
        if not page.truncated:
            return
        if pause:
            time.sleep(pause)


class Range(InputPartition):
    def __init__(self, after: bytes | None, upto: bytes | None):
        super().__init__(None)
        self.after, self.upto = after, upto


class ListingReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = dict(options)
        self.after: bytes | None = bytes.fromhex(options["start_after"]) if options.get("start_after") else None

    def partitions(self) -> list[Range]:
        cuts = sorted({bytes.fromhex(x) for x in self.options.get("ranges", "").split(",") if x})
        cuts = [c for c in cuts if self.after is None or c > self.after]
        return [Range(a, b) for a, b in zip([self.after, *cuts], [*cuts, None], strict=True)]

    def read(self, partition: Range) -> Iterator[tuple]:
        module, _, name = self.options["store"].partition(":")
        fetch = getattr(importlib.import_module(module), name)(self.options)
        rate = float(self.options.get("rate", 0))
        pause = len(self.partitions()) / rate if rate else 0.0
        yield from scan(fetch, self.options.get("prefix", "").encode(), partition.after, partition.upto, int(self.options.get("max_keys", 1000)), int(self.options.get("retries", 3)), pause)


class ListingSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "keyloom"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ListingReader:
        return ListingReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ListingSource)


def made_up_store(options: dict[str, str]) -> Fetcher:
    """A store of n numbered keys, for tests and examples."""
    keys = [f"data/{i:06d}".encode() for i in range(int(options.get("n", 1000)))]

    def fetch(prefix: bytes, after: bytes | None, max_keys: int) -> PageOf:
        found = [k for k in keys if k.startswith(prefix) and (after is None or k > after)]
        return PageOf([(k, len(k), None, None, "STANDARD", "OBJECT") for k in found[:max_keys]], len(found) > max_keys)

    return fetch
