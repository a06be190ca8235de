"""Three readings of how much of a range is still to come, as columns, and what they miss.

All take the range (low, high], the cursor in it and the keys given out so far. The window reads
positions in the range's own frame, behind what low and high share; the anchored one in the
cursor's, behind what low and the cursor share, so a cursor deep in one subtree still moves; the
rate-anchored one scales the keys given out (a page at least) by the anchored ratio, within a band.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from keyloom.functions.keys import fraction, fraction_in, hex_prefix

#: Bytes of a position; the band that the rate-anchored ratio is kept in.
BYTES, BAND = 8, 16.0


def _bottom(key: Column) -> Column:
    return F.coalesce(key, F.lit(b""))


def _anchored(low: Column, cursor: Column, high: Column) -> tuple[Column, Column]:
    """Consumed and left, in the cursor's frame; in a deeper frame than the range's the top is the end of the shared prefix."""
    a, c = _bottom(low), _bottom(cursor)
    d, whole = hex_prefix(a, c), hex_prefix(a, high)
    top = F.when(d <= whole, fraction(high, d, BYTES)).otherwise(1.0)
    at = fraction(c, d, BYTES)
    return at - fraction(a, d, BYTES), F.greatest(top - at, F.lit(0.0))


def window_remaining(low: Column, cursor: Column, high: Column, keys: Column) -> Column:
    consumed = F.greatest(fraction_in(_bottom(cursor), _bottom(low), high), F.lit(0.0))
    left = 1.0 - consumed
    return F.when(high.isNull(), float("inf")).when(consumed <= 0, left).otherwise(keys / consumed * left)


def anchored_remaining(low: Column, cursor: Column, high: Column, keys: Column) -> Column:
    consumed, left = _anchored(low, cursor, high)
    c = _bottom(cursor)
    within = F.when(c >= high, 0.0).when(consumed <= 0, left).otherwise(keys / consumed * left)
    return F.when(high.isNull(), float("inf")).when(c <= _bottom(low), 1.0).otherwise(within)


def rate_remaining(low: Column, cursor: Column, high: Column, keys: Column, page: int = 1000, least: float = 0.0) -> Column:
    consumed, left = _anchored(low, cursor, high)
    c = _bottom(cursor)
    ratio = F.when((c <= _bottom(low)) | (consumed <= 0), 1.0).otherwise(left / consumed)
    banded = F.least(F.greatest(ratio, F.lit(least)), F.lit(BAND))
    return F.when(high.isNull(), float("inf")).when(c >= high, 0.0).otherwise(F.greatest(keys, F.lit(page)) * banded)


def ignores_keys(low: Column, cursor: Column, high: Column, anchored: bool = False) -> Column:
    """Whether a reading leaves out the keys given out so far, because it sees nothing consumed."""
    consumed = _anchored(low, cursor, high)[0] if anchored else fraction_in(_bottom(cursor), _bottom(low), high)
    return high.isNull() | (_bottom(cursor) <= _bottom(low)) | (consumed <= 0)


def advance_seen(low: Column, before: Column, after: Column, high: Column, anchored: bool = False) -> Column:
    """Whether a reading sees the cursor move: by position, or, anchored, by a change of frame too."""
    a, b, c = _bottom(low), _bottom(before), _bottom(after)
    if not anchored:
        return F.when(high.isNull(), F.lit(False)).otherwise(fraction_in(c, a, high) > fraction_in(b, a, high))
    d, e = hex_prefix(a, b), hex_prefix(a, c)
    return (d != e) | (fraction(c, e, BYTES) > fraction(b, e, BYTES))
