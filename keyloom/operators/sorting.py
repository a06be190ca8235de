"""Global order: sorting into range-disjoint parts, numbering, checks and samples.

A row's number in a global order would take one task if asked of a window. ``numbered`` range-
partitions, numbers rows within each partition and adds the partitions' offsets (a row each).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyloom.plans.storage import kept
from keyloom.schema import order_columns


def sort_listing(df: DataFrame, parts: int) -> DataFrame:
    """Parts whose key ranges don't overlap, each in order; nothing is dropped."""
    return df.repartitionByRange(parts, F.col("key")).sortWithinPartitions(*order_columns())


def ranged(df: DataFrame, by: list[Column | str], parts: int | None = None) -> DataFrame:
    """df dealt to range partitions of an order and written, with the partition's number as _part: partitions don't overlap."""
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return kept(df.repartitionByRange(parts, *by).withColumn("_part", F.spark_partition_id()), "ranged")


def nearest(df: DataFrame, by: list[Column | str], value: str, before: str, behind: str | None = None, parts: int | None = None) -> DataFrame:
    """df with the last non-null value up to each row in the order and, if asked, the first from it on.

    Rows look within their range partition; what is carried over an edge is one row a partition.
    """
    rows = ranged(df, by, parts)
    key = F.struct(*by)
    inside = Window.partitionBy("_part").orderBy(*by)
    known = F.col(value).isNotNull()
    ends = rows.groupBy("_part").agg(F.max_by(F.when(known, F.col(value)), F.when(known, key)).alias("_last"), F.min_by(F.when(known, F.col(value)), F.when(known, key)).alias("_first"))
    along = Window.orderBy("_part")  # as many rows as partitions
    ends = ends.select("_part", F.last("_last", True).over(along.rowsBetween(Window.unboundedPreceding, -1)).alias("_carried"), F.first("_first", True).over(along.rowsBetween(1, Window.unboundedFollowing)).alias("_ahead"))
    rows = rows.withColumn(before, F.last(value, True).over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    if behind:
        rows = rows.withColumn(behind, F.first(value, True).over(inside.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    rows = rows.join(F.broadcast(ends), "_part").withColumn(before, F.coalesce(before, "_carried"))
    return (rows.withColumn(behind, F.coalesce(behind, "_ahead")) if behind else rows).drop("_part", "_carried", "_ahead")


def numbered(df: DataFrame, by: list[Column | str], name: str = "n", parts: int | None = None) -> DataFrame:
    """df with each row's number (from 1) in the order."""
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartitionByRange(parts, *by).sortWithinPartitions(*by)
    # the id counts rows of a partition in its low 33 bits
    rows = kept(rows.withColumn("_at", F.monotonically_increasing_id()), "numbered").withColumn("_part", F.shiftright("_at", 33))
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_size"))
    bases = sizes.select("_part", F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    rows = rows.join(F.broadcast(bases), "_part")  # as many rows as partitions
    return rows.withColumn(name, F.col("_base") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_part", "_at", "_base")


def duplicates(df: DataFrame) -> DataFrame:
    """Keys that occur more than once, and how often."""
    return df.groupBy("key").agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def fail_on_duplicates(df: DataFrame) -> DataFrame:
    first = duplicates(df).select("key").head()
    if first is not None:
        raise ValueError(f"duplicate key {bytes(first.key)!r}")
    return df


def order_check(df: DataFrame, parts: Column | str = "part", place: str = "place") -> DataFrame:
    """By part: rows, and how many keys are not above the one before; df has a part and a place in it."""
    before = F.lag("key").over(Window.partitionBy(parts).orderBy(place))
    return df.withColumn("_before", before).groupBy(parts).agg(F.count("*").alias("n_rows"), F.count_if(F.col("key") <= F.col("_before")).alias("n_not_above"))


def boundaries(df: DataFrame, ranges: int) -> DataFrame:
    """j, key: distinct keys at places floor(j * n / ranges), strictly ascending; none for fewer than two ranges or keys."""
    keys = numbered(df.select("key").distinct(), ["key"])
    n = keys.count()
    if n < 2 or ranges < 2:
        return keys.where("false").select(F.lit(0).cast("bigint").alias("j"), "key")
    at = df.sparkSession.range(1, ranges).select(F.col("id").alias("j"), F.floor(F.col("id") * n / ranges).alias("at"))
    at = at.groupBy("at").agg(F.min("j").alias("j")).where("at > 0")
    return keys.join(at, keys["n"] - 1 == at["at"]).select("j", "key")


def even_subsample(df: DataFrame, most: int) -> DataFrame:
    """At most so many distinct keys, evenly spaced from first to last; the middle one for one."""
    keys = numbered(df.select("key").distinct(), ["key"])
    n = keys.count()
    if n <= most:
        return keys
    if most <= 1:
        return keys.where(F.col("n") - 1 == n // 2)
    at = df.sparkSession.range(most).select(F.floor(F.col("id") * (n - 1) / (most - 1)).alias("at")).distinct()
    return keys.join(at, keys["n"] - 1 == at["at"]).drop("at")


def page_sample(df: DataFrame, page: int, most: int = 4096) -> DataFrame:
    """First keys of every so many-th page, so that about ``most`` are left."""
    keys = numbered(df.select("key"), ["key"]).where(F.col("n") % page == 1 if page > 1 else F.lit(True))
    firsts = keys.withColumn("page", F.floor((F.col("n") - 1) / page))
    total = firsts.count()
    stride = max(1, -(-total // most))
    return firsts.where(F.col("page") % stride == 0).select("page", "key")


def mass_subsample(df: DataFrame, most: int) -> DataFrame:
    """Greedy sample by mass: a key is taken when the mass so far reaches the next mark, which then moves a step beyond it.

    At most ``most`` of them; all if there are no more than that, the middle one if none reaches a mark. Marks reset
    at each taken key, so this isn't a prefix sum; it folds over candidates, which are seeds (a few
    thousand), never all keys.
    """
    step = F.col("total") / most
    one = df.groupBy().agg(F.sort_array(F.collect_list(F.struct("key", "mass"))).alias("rows"), F.sum("mass").cast("double").alias("total"))
    zero = F.struct(F.lit(0.0).alias("sum"), step.alias("next"), F.array().cast("array<binary>").alias("keys"))

    def fold(acc, row):
        total = acc["sum"] + row["mass"]
        hit = (total + 1e-9 >= acc["next"]) & (F.size(acc["keys"]) < most)
        return F.struct(total.alias("sum"), F.when(hit, total + step).otherwise(acc["next"]).alias("next"), F.when(hit, F.concat(acc["keys"], F.array(row["key"]))).otherwise(acc["keys"]).alias("keys"))

    taken = F.aggregate("rows", zero, fold)["keys"]
    all_ = F.col("rows.key")
    middle = F.array(F.get(all_, F.floor(F.size("rows") / 2).cast("int")))
    return one.select(F.explode(F.when(F.size("rows") <= most, all_).when(F.size(taken) == 0, middle).otherwise(taken)).alias("key"))


def spread_sample(df: DataFrame, by: list[Column | str], most: int) -> DataFrame:
    """At most so many rows, evenly spaced by rounded place, each at least one behind the last; the first one for one."""
    rows = numbered(df, by)
    n = rows.count()
    if n <= most:
        return rows
    if most <= 1:
        return rows.where(F.col("n") <= most)
    # fewer slots than rows: places rise by at least one on average, so only halves rounded up can meet
    slots = df.sparkSession.range(most).select(F.col("id"), F.floor(F.col("id") * (n - 1.0) / (most - 1) + 0.5).alias("at"))
    forced = F.max(F.col("at") - F.col("id")).over(Window.orderBy("id").rowsBetween(Window.unboundedPreceding, Window.currentRow)) + F.col("id")
    slots = slots.select((forced + 1).cast("bigint").alias("slot"))  # a page of exchanges
    return rows.join(F.broadcast(slots), rows["n"] == slots["slot"]).drop("slot")
