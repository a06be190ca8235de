"""What characters keys have behind a shared prefix, and choosing one that occurs.

A made-up key that begins with a character no key has would cut an empty range off; one of those
seen at that place cuts where there are keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.schema import key_text

#: Places behind the prefix that are looked at; characters of a clean place: printable ASCII.
PLACES, LEAST, MOST = 8, " ", "~"


def alphabet(df: DataFrame, prefix: str = "", places: int = PLACES) -> DataFrame:
    """place (from 0, behind the prefix), clean, seen (sorted characters; none of a place that isn't clean).

    Characters outside printable ASCII count as one, so that a place has at most 96 and groups stay small.
    """
    text = key_text(F.col("key"))
    behind = F.substring(text, len(prefix) + 1, places)
    rows = df.where(F.startswith(text, F.lit(prefix)) & (behind != "")).select(F.posexplode(F.split(behind, "")).alias("place", "c"))
    plain = F.when(F.col("c").between(LEAST, MOST) & (F.octet_length("c") == 1), F.col("c"))
    each = rows.select("place", plain.alias("c")).distinct()
    found = each.groupBy("place").agg(F.max(F.col("c").isNull()).alias("odd"), F.sort_array(F.collect_list("c")).alias("seen"))
    return found.select("place", (~F.col("odd")).alias("clean"), F.when(F.col("odd"), F.array().cast("array<string>")).otherwise(F.col("seen")).alias("seen"))


def choose(seen: Column, low: Column, high: Column, share: Column | float) -> Column:
    """Of the characters seen strictly between two (null: open) the one at a share of their number; null for none."""
    room = F.filter(seen, lambda c: (low.isNull() | (c > low)) & (high.isNull() | (c < high)))
    n = F.size(room)
    at = F.least(F.greatest(F.floor((F.lit(share) if isinstance(share, float) else share) * n), F.lit(0)), n - 1)
    return F.get(room, at.cast("int"))
