"""Two listings against each other, and keys against ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.functions.keys import hex_prefix
from keyloom.operators.sorting import nearest


def diff(left: DataFrame, right: DataFrame, same: tuple[str, ...] = ("size", "etag")) -> DataFrame:
    """key, state: LEFT_ONLY, RIGHT_ONLY, CHANGED or SAME (by the given columns, nulls alike)."""
    a = left.select(F.col("key").alias("_l"), *[F.col(c).alias(f"_l_{c}") for c in same])
    b = right.select(F.col("key").alias("_r"), *[F.col(c).alias(f"_r_{c}") for c in same])
    joined = a.join(b, F.col("_l") == F.col("_r"), "full_outer")
    alike = F.lit(True)
    for c in same:
        alike &= F.col(f"_l_{c}").eqNullSafe(F.col(f"_r_{c}"))
    state = F.when(F.col("_r").isNull(), "LEFT_ONLY").when(F.col("_l").isNull(), "RIGHT_ONLY").when(alike, "SAME").otherwise("CHANGED")
    return joined.select(F.coalesce("_l", "_r").alias("key"), state.alias("state"))


def except_both(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that one side has more often, with the side; empty if both are alike as multisets."""
    return left.exceptAll(right).withColumn("side", F.lit("LEFT")).unionByName(right.exceptAll(left).withColumn("side", F.lit("RIGHT")))


def either_key(left: DataFrame, right: DataFrame) -> DataFrame:
    """Keys of either side, each once."""
    return left.select("key").unionByName(right.select("key")).distinct()


def not_finalized(files: DataFrame, finalized: DataFrame) -> DataFrame:
    """Files that no finished part claims."""
    return files.join(finalized, "file", "left_anti")


def owning_range(keys: DataFrame, ranges: DataFrame) -> DataFrame:
    """Each key with the range (low, high] that it is in; ranges don't overlap, null is open.

    Ranges and keys are put in one order and each key takes the last range begun before it, so there
    is no pairing of keys with ranges. They are dealt by ranges of that order, whatever prefix keys
    share; what a partition's first keys need from before it is one row.
    """
    begin = ranges.select(F.coalesce("low", F.lit(b"")).alias("at"), F.lit(1).alias("kind"), F.struct("range_id", "low", "high").alias("r"))
    rows = keys.select(F.col("key").alias("at"), F.lit(0).alias("kind"), F.lit(None).cast(begin.schema["r"].dataType).alias("r")).unionByName(begin)
    # at equal bytes a key comes before a range that it isn't in
    rows = nearest(rows, ["at", "kind"], "r", "own").where("kind = 0")
    inside = F.col("own.high").isNull() | (F.col("at") <= F.col("own.high"))
    return rows.select(F.col("at").alias("key"), F.when(inside, F.col("own.range_id")).alias("range_id"))


def overlapping(blocks: DataFrame, ranges: DataFrame) -> DataFrame:
    """Blocks [first, last] and ranges [low, high) that share keys; both are metadata."""
    return blocks.join(ranges, (F.col("last") >= F.col("low")) & (F.col("high").isNull() | (F.col("first") < F.col("high"))))


def meter_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """Counters after minus before, by name and tags; what is only on one side counts as 0 on the other."""
    on = ["name", "tags"]
    joined = before.select(*on, F.col("value").alias("a")).join(after.select(*on, F.col("value").alias("b")), on, "full_outer")
    return joined.select(*on, (F.coalesce("b", F.lit(0)) - F.coalesce("a", F.lit(0))).alias("delta"))


def conformance(expected: DataFrame, actual: DataFrame, on: str = "request", body: str = "body") -> DataFrame:
    """Recorded answers beside replayed ones: request, verdict (SAME, DIFFERENT, MISSING, EXTRA) and where they first differ.

    Times of answers and their white space between elements don't count.
    """
    plain = lambda c: F.regexp_replace(F.regexp_replace(c, r">\s+<", "><"), r"<RequestId>[^<]*</RequestId>", "")
    a = expected.select(F.col(on).alias("_a"), plain(F.col(body)).alias("want"))
    b = actual.select(F.col(on).alias("_b"), plain(F.col(body)).alias("got"))
    verdict = F.when(F.col("_b").isNull(), "MISSING").when(F.col("_a").isNull(), "EXTRA").when(F.col("want").eqNullSafe(F.col("got")), "SAME").otherwise("DIFFERENT")
    rows = a.join(b, F.col("_a") == F.col("_b"), "full_outer").withColumn("verdict", verdict)
    at = F.when(F.col("verdict") == "DIFFERENT", hex_prefix(F.coalesce("want", F.lit("")).cast("binary"), F.coalesce("got", F.lit("")).cast("binary")))
    return rows.select(F.coalesce("_a", "_b").alias("request"), "verdict", at.alias("differs_at"))


def ratios(reports: DataFrame, base: str, measures: list[str], name: str = "mode") -> DataFrame:
    """Each other report's measures over the base report's; 0 where the base's is 0. Reports are a row a mode."""
    first = reports.where(F.col(name) == base).select(*[F.col(m).alias(f"_{m}") for m in measures])
    over = [F.when(F.col(f"_{m}") == 0, 0.0).otherwise(F.col(m) / F.col(f"_{m}")).alias(f"{m}_ratio") for m in measures]
    return reports.where(F.col(name) != base).join(F.broadcast(first.limit(1)), F.lit(True)).select(F.lit(base).alias("base"), name, *over)
