"""Row filters with explicit rules for rows that lack the field."""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.functions.parse import parse_micros, parse_size, prefix_end
from keyloom.schema import COMMON_PREFIX, OBJECT, key_text, micros


@dataclass(frozen=True)
class Filters:
    """All given conditions hold. Sizes and classes only judge objects, times all but prefixes."""

    include: str | None = None
    exclude: str | None = None
    min_size: str | int | None = None
    max_size: str | int | None = None
    modified_since: str | None = None
    modified_until: str | None = None
    storage_classes: tuple[str, ...] = field(default=())
    expression: str | None = None

    def __post_init__(self):
        a, b = self.sizes()
        if a is not None and b is not None and a > b:
            raise ValueError("min_size is above max_size")
        a, b = self.times()
        if a is not None and b is not None and a > b:
            raise ValueError("modified_since is after modified_until")
        for pattern in (self.include, self.exclude):
            try:
                re.compile(pattern or "")
            except re.error as e:
                raise ValueError(f"not a pattern: {pattern!r}") from e

    def sizes(self) -> tuple[int | None, int | None]:
        return tuple(None if x is None else parse_size(str(x)) for x in (self.min_size, self.max_size))

    def times(self) -> tuple[int | None, int | None]:
        return tuple(None if x is None else parse_micros(x) for x in (self.modified_since, self.modified_until))

    def predicates(self) -> list[Column]:
        """Cheap ones first; patterns last."""
        out = []
        low, high = self.sizes()
        if low is not None or high is not None:
            out.append((F.col("row_type") != OBJECT) | _within(F.col("size"), low, high))
        if self.storage_classes:
            upper = [c.upper() for c in self.storage_classes]
            out.append((F.col("row_type") != OBJECT) | F.coalesce(F.upper("storage_class").isin(upper), F.lit(False)))
        low, high = self.times()
        if low is not None or high is not None:
            out.append((F.col("row_type") == COMMON_PREFIX) | _within(micros(F.col("last_modified")), low, high))
        if self.expression:
            out.append(F.expr(self.expression))
        if self.include is not None:
            out.append(key_text(F.col("key")).rlike(self.include))
        if self.exclude is not None:
            out.append(~key_text(F.col("key")).rlike(self.exclude))
        return out

    def apply(self, df: DataFrame) -> DataFrame:
        found = self.predicates()
        return df.where(reduce(lambda a, b: a & b, found)) if found else df

    def encode(self) -> str:
        """A text that is the same for the same filters."""
        return json.dumps({k: v for k, v in asdict(self).items() if v not in (None, ())}, sort_keys=True)

    @classmethod
    def decode(cls, text: str) -> Filters:
        got = json.loads(text)
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in got.items()})


def _within(value: Column, low: int | None, high: int | None) -> Column:
    ok = F.lit(True)
    if low is not None:
        ok = ok & (value >= low)
    if high is not None:
        ok = ok & (value <= high)
    return ok


def key_range(df: DataFrame, after: bytes | None = None, upto: bytes | None = None, prefix: bytes = b"", from_: bytes | None = None, before: bytes | None = None) -> DataFrame:
    """Keys in (after, upto], [from_, before) and with a prefix, as bounds that reach the Parquet scan."""
    key = F.col("key")
    bounds = [key > F.lit(after)] if after is not None else []
    bounds += [key <= F.lit(upto)] if upto is not None else []
    bounds += [key >= F.lit(from_)] if from_ is not None else []
    bounds += [key < F.lit(before)] if before is not None else []
    if prefix:
        bounds.append(key >= F.lit(prefix))
        if (end := prefix_end(prefix)) is not None:
            bounds.append(key < F.lit(end))
    return df.where(reduce(lambda a, b: a & b, bounds)) if bounds else df
