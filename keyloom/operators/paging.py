"""Prefix and range pages with tokens, and the roll-up of keys by a delimiter."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.functions.keys import common_prefix
from keyloom.functions.parse import decode_token, encode_token, parse_query, prefix_end
from keyloom.operators.filters import key_range
from keyloom.operators.sorting import numbered
from keyloom.schema import COMMON_PREFIX, OBJECT, as_listing

MOST_KEYS = 1000


@dataclass(frozen=True)
class Request:
    """A page that is asked for; token and start_after exclude each other."""

    prefix: bytes = b""
    delimiter: bytes = b""
    start_after: bytes | None = None
    token: str | None = None
    max_keys: int = MOST_KEYS

    def __post_init__(self):
        if self.max_keys < 0:
            raise ValueError("max-keys is negative")
        if self.token is not None and self.start_after is not None:
            raise ValueError("a token excludes start-after")

    @classmethod
    def parse(cls, raw: str) -> Request:
        q = parse_query(raw)
        if q.get("list-type") != b"2":
            raise ValueError("list-type must be 2")
        count = q.get("max-keys", b"%d" % MOST_KEYS).decode()
        if not count.lstrip("-").isdigit():
            raise ValueError("max-keys is not a number")
        return cls(q.get("prefix", b""), q.get("delimiter", b""), q.get("start-after"), q["continuation-token"].decode() if "continuation-token" in q else None, int(count))

    @property
    def limit(self) -> int:
        return min(self.max_keys, MOST_KEYS)

    @property
    def bound(self) -> tuple[bytes | None, bool]:
        """Where to begin and whether that key itself counts."""
        return decode_token(self.token) if self.token is not None else (self.start_after, False)


@dataclass(frozen=True)
class Page:
    rows: DataFrame
    truncated: bool
    next_token: str | None


def in_range(df: DataFrame, request: Request) -> DataFrame:
    """Objects that a page can hold."""
    at, inclusive = request.bound
    after = at if at is not None and not inclusive else None
    return key_range(df.where(F.col("row_type") == OBJECT), after=after, from_=at if inclusive else None, prefix=request.prefix)


def entries(df: DataFrame, request: Request) -> DataFrame:
    """Objects and, with a delimiter, one row for each common prefix with what it stands for; not yet cut to a page.

    A prefix at or before the start was given out before and is left out.
    """
    rows = in_range(df, request)
    if not request.delimiter:
        return rows.withColumn("n_keys", F.lit(1).cast("bigint"))
    cp = common_prefix(F.col("key"), request.prefix, request.delimiter)
    if (at := request.bound[0]) is not None:
        rows = rows.where(cp.isNull() | (cp > F.lit(at)) if not request.bound[1] else F.lit(True))
    rolled = rows.withColumn("cp", cp)
    # objects are groups of their own, so one aggregation does both
    grouped = rolled.groupBy(F.coalesce("cp", "key").alias("key"), F.when(F.col("cp").isNull(), OBJECT).otherwise(COMMON_PREFIX).alias("row_type"))
    return grouped.agg(F.sum("size").alias("size"), F.max("last_modified").alias("last_modified"), F.count("*").alias("n_keys"))


def list_objects(df: DataFrame, request: Request) -> Page:
    """One page in key order; a row more than it holds tells whether there are more."""
    found = entries(df, request)
    if request.limit == 0:
        return Page(found.limit(0), False, None)
    keys = found.orderBy("key", "row_type").limit(request.limit + 1).collect()  # a page and one more; the page is made of these rows
    got = df.sparkSession.createDataFrame(keys[: request.limit], found.schema)
    if len(keys) <= request.limit:
        return Page(got, False, None)
    last = keys[request.limit - 1]
    key = bytes(last.key)
    if last.row_type == COMMON_PREFIX:  # go on behind everything under the prefix
        end = prefix_end(key)
        token = encode_token(end, True) if end is not None else None
    else:
        token = encode_token(key)
    return Page(got, token is not None, token)


def common_prefix_of(key: bytes, prefix: bytes, delimiter: bytes) -> bytes | None:
    """The key up to and with the first delimiter behind the prefix; None if there is none."""
    at = key.find(delimiter, len(prefix)) if delimiter else -1
    return key[: at + len(delimiter)] if at >= 0 else None


def skip_scan(spark: SparkSession, path: str, request: Request) -> tuple[Page, int]:
    """A page of a sorted dataset that opens only the files it needs; also how many it opened.

    Files are in key order with their first and last key in the manifest. A file that lies whole
    under one common prefix gives that prefix and isn't opened; the others are read one after the
    other until the page is full. Entries have a key and a row type.
    """
    from keyloom.sources.listing import file_spans

    at, inclusive = request.bound
    bound = encode_token(at, inclusive) if at is not None else None
    made: dict[tuple[bytes, str], None] = {}
    opened = 0
    for file, low, high, objects in file_spans(spark, path):
        if len(made) > request.limit:
            break
        end = prefix_end(request.prefix) if request.prefix else None
        if high < request.prefix or (end is not None and low >= end) or (at is not None and (high < at if inclusive else high <= at)):
            continue
        a, b = (common_prefix_of(k, request.prefix, request.delimiter) if k.startswith(request.prefix) else None for k in (low, high))
        whole = a is not None and a == b and objects
        if whole and (at is None or low >= at) or whole and (a, COMMON_PREFIX) in made:
            if at is None or inclusive or a > at:
                made[a, COMMON_PREFIX] = None
            continue
        opened += 1
        part = Request(request.prefix, request.delimiter, None, bound, request.max_keys)
        rows = entries(as_listing(spark.read.parquet(file)), part).select("key", "row_type").orderBy("key", "row_type").limit(request.limit + 2).collect()
        made.update({(bytes(r.key), r.row_type): None for r in rows})
    keys = sorted(made)
    page = keys[: request.limit]
    rows = spark.createDataFrame([(bytearray(k), t) for k, t in page], "key binary, row_type string")
    if len(keys) <= request.limit or not page:
        return Page(rows, False, None), opened
    key, kind = page[-1]
    go_on = prefix_end(key) if kind == COMMON_PREFIX else key
    token = None if go_on is None else encode_token(go_on, kind == COMMON_PREFIX)
    return Page(rows, token is not None, token), opened


def page_walk(df: DataFrame, request: Request, page: int = MOST_KEYS) -> DataFrame:
    """All pages of a walk at once: each entry with its page (from 0) and place."""
    rows = numbered(entries(df, request), ["key", "row_type"])
    return rows.withColumn("page", F.floor((F.col("n") - 1) / page)).withColumn("place", (F.col("n") - 1) % page)


def rollup_depth(df: DataFrame, depth: int, delimiter: bytes = b"/") -> DataFrame:
    """Keys, bytes and latest time by the first so many parts."""
    text = F.col("key").cast("string")
    part = F.substring_index(text, delimiter.decode(), depth)
    whole = F.concat(part, F.lit(delimiter.decode()))
    rows = df.where(F.col("row_type") == OBJECT).withColumn("prefix", F.when(F.length(part) < F.length(text), whole).otherwise(text))
    return rows.groupBy("prefix").agg(F.count("*").alias("n_keys"), F.sum("size").alias("size"))


def probe(df: DataFrame, prefix: bytes) -> bytes | None:
    """The first key under a prefix."""
    first = key_range(df, prefix=prefix).agg(F.min("key").alias("key")).first()
    return None if first.key is None else bytes(first.key)
