"""Tallies and shapes of a keyspace."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyloom.functions.keys import byte_at, hex_prefix
from keyloom.schema import COMMON_PREFIX, DELETE_MARKER, OBJECT

DEPTHS, LAST_DEPTH = 8, 15
#: What a class of child mass stands for.
MASS = {"empty": 0, "tiny": 10, "small": 1005, "large": 100_000}


def tally(df: DataFrame, *by: str) -> DataFrame:
    """Rows by type and bytes of objects."""
    t = F.col("row_type")
    size = F.coalesce(F.sum(F.when(t == OBJECT, F.col("size"))), F.lit(0)).alias("total_size")
    return df.groupBy(*by).agg(F.count("*").alias("n_rows"), *[F.count_if(t == k).alias(n) for k, n in ((OBJECT, "n_objects"), (COMMON_PREFIX, "n_prefixes"), (DELETE_MARKER, "n_markers"))], size)


def file_stats(df: DataFrame, file: str | Column = "_metadata.file_path") -> DataFrame:
    """Rows, first and last key of each file."""
    return df.groupBy((F.col(file) if isinstance(file, str) else file).alias("file")).agg(F.count("*").alias("n_rows"), F.min("key").alias("first_key"), F.max("key").alias("last_key"))


def gini(groups: DataFrame, value: str = "value", count: str = "n") -> DataFrame:
    """Gini coefficient of grouped data; 0 for nothing.

    With values ascending, the sum over pairs of n_i n_j |v_i - v_j| is twice the sum of
    n_i (v_i N_i - S_i) over what is below; groups are few (a row each distinct value).
    """
    below = Window.orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    rows = groups.groupBy(value).agg(F.sum(count).cast("double").alias("n")).withColumn("v", F.col(value).cast("double"))
    rows = rows.withColumn("n_below", F.coalesce(F.sum("n").over(below), F.lit(0.0))).withColumn("s_below", F.coalesce(F.sum(F.col("n") * F.col("v")).over(below), F.lit(0.0)))
    spread = F.sum(F.col("n") * (F.col("v") * F.col("n_below") - F.col("s_below")))
    total = F.sum("n") * F.sum(F.col("n") * F.col("v"))
    return rows.agg(F.when(total > 0, spread / total).otherwise(0.0).alias("gini"))


def mass_class(n: Column) -> Column:
    """How much is below a prefix: nothing, at most ten pages' tenth, at most a page and some, or more."""
    return F.when(n == 0, "empty").when(n <= 10, "tiny").when(n <= 1000, "small").otherwise("large")


def child_mass(children: DataFrame, n: str = "n_keys") -> DataFrame:
    """Children by class, with the mass that a class stands for."""
    name = mass_class(F.col(n)).alias("mass_class")
    of = F.create_map(*[F.lit(x) for p in MASS.items() for x in p])
    return children.groupBy(name).agg(F.count("*").alias("n_children")).withColumn("stands_for", of[F.col("mass_class")].cast("bigint"))


def alphabet(df: DataFrame, depths: int = DEPTHS) -> DataFrame:
    """Distinct printable ASCII bytes at each of the first places of keys.

    One pass: per place two 64-bit masks, or-ed together; bytes 20 to 5F and 60 to 7E.
    """
    aggs = []
    for i in range(depths):
        b = byte_at(F.col("key"), F.lit(i))
        there = F.octet_length("key") > i
        for name, low in (("low", 0x20), ("high", 0x60)):
            ok = there & (b >= low) & (b < min(low + 64, 0x7F))
            aggs.append(F.bit_or(F.when(ok, F.call_function("shiftleft", F.lit(1).cast("bigint"), (b - low).cast("int"))).otherwise(0)).alias(f"{name}{i}"))
    count = lambda i: F.bit_count(F.coalesce(f"low{i}", F.lit(0))) + F.bit_count(F.coalesce(f"high{i}", F.lit(0)))
    one = df.agg(*aggs)
    return one.select(F.posexplode(F.array(*[count(i).cast("bigint") for i in range(depths)])).alias("position", "n_bytes")).where("n_bytes > 0")


def divergence(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Pairs of keys by the number of bytes they begin with alike; from 15 on together."""
    depth = F.least(hex_prefix(F.col(a), F.col(b)), F.lit(LAST_DEPTH))
    return pairs.groupBy(depth.alias("depth")).agg(F.count("*").alias("n_pairs"))


def pivot_region(low: Column, pivot: Column) -> Column:
    """Kind of the byte at which a pivot leaves its range's low key."""
    b = byte_at(pivot, hex_prefix(low, pivot))
    return F.when(b.between(0x30, 0x39), "hex_digit").when(b.between(0x3A, 0x60), "dead_zone").when(b.between(0x61, 0x66), "hex_alpha").otherwise("other")


def fanout(children: DataFrame, parent: str = "parent") -> DataFrame:
    """Largest, total and number of probes of children by parent."""
    return children.groupBy(parent).agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("most"), F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count("*").alias("n_probes"))


def partitioned(children: DataFrame, prefix: str = "prefix") -> DataFrame:
    """Whether more than half of the child prefixes are of the form name=value/."""
    part = F.element_at(F.split(F.rtrim(F.col(prefix), F.lit("/")), "/"), -1)
    return children.agg((F.coalesce(F.avg(part.contains("=").cast("double")), F.lit(0.0)) > 0.5).alias("partitioned"), F.count("*").alias("n_children"))


def seed_shape(n_prefixes: int, n_objects: int, partitioned_: bool, tiny_share: float = 0.0, wide: int = 64) -> str:
    """What the first level of a keyspace looks like."""
    if not n_prefixes:
        return "flat_wide" if n_objects else "empty"
    if partitioned_:
        return "fanout_tiled"
    if n_prefixes >= wide and tiny_share > 0.5:
        return "tiny_leaf_explosion"
    return "wide" if n_prefixes >= wide else "narrow"


def percentiles(df: DataFrame, value: str, *by: str, at: tuple[float, ...] = (0.5, 0.9, 0.99)) -> DataFrame:
    """Interpolated percentiles and the largest, by group; exact (values are counted, so cost follows distinct values)."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), *[F.percentile(value, p).alias(f"p{round(p * 100)}") for p in at], F.max(value).alias("most"))


def nearest_rank(df: DataFrame, value: str, *by: str, at: tuple[float, ...] = (0.5, 0.9, 0.99)) -> DataFrame:
    """The smallest value that a share of values doesn't exceed, by group."""
    return df.groupBy(*by).agg(*[F.expr(f"percentile_disc({p}) within group (order by {value})").alias(f"p{round(p * 100)}") for p in at])


def page_fill(pages: DataFrame) -> DataFrame:
    """Pages, their keys, and those that are short although more followed."""
    return pages.agg(F.count("*").alias("n_pages"), F.coalesce(F.sum("n_keys"), F.lit(0)).alias("n_keys"), F.count_if((F.col("n_keys") < F.col("page_size")) & F.col("truncated")).alias("n_short"))


def remaining(keys: Column, consumed: Column, left: Column) -> Column:
    """Keys still to come: as dense as what was consumed; the rest itself before anything was; endless for an open range."""
    return F.when(left.isNull(), float("inf")).when(F.coalesce(consumed, F.lit(0.0)) <= 0, left).otherwise(keys / consumed * left)


def slowest(ranges: DataFrame, k: int = 10) -> DataFrame:
    """Ranges with most to come; open ones first."""
    est = remaining(F.col("keys"), F.col("consumed"), F.col("left"))
    return ranges.withColumn("remaining", est).orderBy(F.col("remaining").desc(), "range_id").limit(k)


def reasons(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"))


def meters(df: DataFrame) -> DataFrame:
    """Timers by name and tags."""
    return df.groupBy("name", "tags").agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.avg("value").alias("mean"), F.max("value").alias("most"), *[F.percentile("value", p).alias(n) for p, n in ((0.5, "p50"), (0.99, "p99"))])


def output_bytes(lines: DataFrame, line: str = "line") -> DataFrame:
    """UTF-8 bytes of lines with their ends."""
    return lines.agg(F.count("*").alias("n_lines"), F.coalesce(F.sum(F.octet_length(line).cast("bigint") + 1), F.lit(0)).alias("n_bytes"))


def all_hold(df: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """Whether every row meets each condition."""
    return df.agg(*[F.coalesce(F.every(c), F.lit(True)).alias(n) for n, c in conditions.items()], reduce(lambda a, b: a & b, [F.coalesce(F.every(c), F.lit(True)) for c in conditions.values()]).alias("ok"))

