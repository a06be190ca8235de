"""Reading a listing run from its trace: lineage, mass along the keyspace, findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyloom.functions.keys import family, fraction, hex_prefix
from keyloom.operators.compare import owning_range  # noqa: F401  (ranges of a trace are looked up the same way)
from keyloom.operators.sorting import nearest, ranged
from keyloom.plans.storage import kept

#: Names of events and reasons in a trace.
SPLITS = ("split", "owner_split")
UNSPLIT_REASONS = ("self_published", "pivot_reflect_lifted", "pivot_reflect_clamped", "confetti_probe")


def lineage(events: DataFrame, most_rounds: int = 64) -> DataFrame:
    """node, root: each node's first ancestor; by doubling the step to ancestors, so rounds are the logarithm of the depth."""
    split = events.where(F.col("event").isin(*SPLITS) & F.col("child_node_id").isNotNull())
    # of several splits that name a child the last one counts
    parent = split.groupBy(F.col("child_node_id").alias("node")).agg(F.max_by("node_id", "ts_ns").alias("up"))
    roots = events.select(F.col("node_id").alias("node")).where("node is not null and node >= 0").distinct()
    rows = kept(parent.join(roots, "node", "full_outer").select("node", F.coalesce("up", "node").alias("up")), "lineage")
    for _ in range(most_rounds):
        above = rows.select(F.col("node").alias("up"), F.col("up").alias("next"))
        stepped = kept(rows.join(above, "up", "left").select("node", F.col("up").alias("was"), F.coalesce("next", "up").alias("up")), "lineage")
        if stepped.where("was <> up").isEmpty():
            break
        rows = stepped.select("node", "up")
    return rows.select("node", F.col("up").alias("root"))


def mass_axis(pages: DataFrame, key: str = "cursor", mass: str = "keys") -> DataFrame:
    """key, upto: the share of all mass at or below each distinct key.

    Running sums by range partition and the partitions' own sums (a row each) make the whole.
    """
    rows = ranged(pages.groupBy(F.col(key).alias("key")).agg(F.sum(mass).alias("mass")), ["key"])
    sums = rows.groupBy("_part").agg(F.sum("mass").alias("all"))
    sums = sums.select("_part", F.coalesce(F.sum("all").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"), F.sum("all").over(Window.partitionBy()).alias("total"))
    run = F.sum("mass").over(Window.partitionBy("_part").orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("run", run).join(F.broadcast(sums), "_part")
    return rows.select("key", "mass", ((F.col("run") + F.col("base")) / F.when(F.col("total") == 0, 1).otherwise(F.col("total"))).alias("upto"))


def position(keys: DataFrame, axis: DataFrame, key: str = "key") -> DataFrame:
    """Keys with their place on the axis: between two measured keys by bytes, 1 behind the last.

    Both sides go into one order and each key takes its neighbours there, over range partitions.
    """
    marks = axis.select(F.col("key").alias("k"), F.lit(0).alias("kind"), F.struct("key", "upto").alias("m"))
    rows = keys.select(F.col(key).alias("k")).distinct().withColumn("kind", F.lit(1)).withColumn("m", F.lit(None).cast(marks.schema["m"].dataType)).unionByName(marks)
    rows = nearest(rows, ["k", "kind"], "m", "l", "r").where("kind = 1")
    skip = F.when(F.col("l").isNotNull(), hex_prefix(F.col("l.key"), F.col("r.key"))).otherwise(0)
    a, b, k = (fraction(c, skip, 8) for c in (F.coalesce("l.key", F.lit(b"")), F.col("r.key"), F.col("k")))
    share = F.when(b <= a, 0.0).otherwise(F.least(F.greatest((k - a) / (b - a), F.lit(0.0)), F.lit(1.0)))
    below = F.coalesce("l.upto", F.lit(0.0))
    at = F.when(F.col("l.key") == F.col("k"), F.col("l.upto")).when(F.col("r").isNull(), 1.0).otherwise(below + (F.col("r.upto") - below) * share)
    return rows.select(F.col("k").alias("key"), at.alias("position"))


def family_positions(found: DataFrame, axis: DataFrame) -> DataFrame:
    """families() with the places of their first and last key on a mass axis."""
    ends = found.select(F.explode(F.array("first_key", "last_key")).alias("key"))
    at = position(ends, axis)  # two rows a family
    first, last = (at.select(F.col("key").alias(f"{side}_key"), F.col("position").alias(f"{side}_position")) for side in ("first", "last"))
    return found.join(first, "first_key").join(last, "last_key")


def families(pages: DataFrame, most: int = 10, key: str = "cursor", mass: str = "keys") -> DataFrame:
    """Families of keys by mass, the heaviest."""
    first = F.split_part(F.col(key).cast("string"), F.lit("/"), F.lit(1))
    rows = pages.groupBy(family(F.col(key)).alias("family")).agg(F.sum(mass).alias("mass"), F.count_distinct(first).alias("n_dirs"), F.min(key).alias("first_key"), F.max(key).alias("last_key"))
    return rows.orderBy(F.col("mass").desc(), "family").limit(most)


def seeds(events: DataFrame, roots: DataFrame) -> DataFrame:
    """By root: keys listed under it, splits, workers."""
    rows = events.join(roots, events["node_id"] == roots["node"])
    kind = F.col("event")
    return rows.groupBy("root").agg(F.coalesce(F.sum(F.when(kind == "page_committed", F.col("keys"))), F.lit(0)).alias("keys"), F.count_if(kind.isin(*SPLITS)).alias("n_splits"), F.count_distinct(F.when(kind == "claimed", F.col("worker_id"))).alias("n_workers"))


def seed_findings(by_root: DataFrame) -> DataFrame:
    """The heaviest seed, its share, the upper median of the others that have keys, and the ratio of both."""
    heaviest = F.max(F.struct("keys", (-F.col("root")).alias("minus")))
    one = by_root.agg(heaviest.alias("top"), F.sum("keys").alias("total"), F.count("*").alias("n_seeds"), F.count_if(F.col("keys") == 0).alias("n_empty"), F.sort_array(F.collect_list(F.when(F.col("keys") > 0, F.col("keys")))).alias("ks"))
    # the heaviest is the last of the sorted list; seeds are plan metadata
    others = F.slice("ks", 1, F.greatest(F.size("ks") - 1, F.lit(0)))
    one = one.withColumn("median", F.coalesce(F.get(others, F.floor(F.size(others) / 2).cast("int")), F.lit(0)))
    return one.select("n_seeds", "n_empty", (-F.col("top.minus")).alias("top_seed"), F.col("top.keys").alias("top_keys"), (100.0 * F.col("top.keys") / F.greatest(F.col("total"), F.lit(1))).alias("top_share"), F.col("median").alias("median_keys"), F.when(F.col("median") > 0, F.floor(F.col("top.keys") / F.col("median"))).otherwise(0).alias("ratio"))


def ledger(events: DataFrame) -> DataFrame:
    """Whether all that was seeded or split was claimed and completed, and nothing failed."""
    n = lambda c: F.count_if(c)
    k = F.col("event")
    one = events.agg(n(k == "seeded").alias("n_seeds"), n(k.isin(*SPLITS)).alias("n_splits"), n(k == "claimed").alias("n_claimed"), n(k == "completed").alias("n_completed"), n(k == "failed").alias("n_failed"))
    return one.withColumn("ok", (F.col("n_seeds") + F.col("n_splits") == F.col("n_claimed")) & (F.col("n_claimed") == F.col("n_completed")) & (F.col("n_failed") == 0))


def page_costs(events: DataFrame) -> DataFrame:
    """Pages, keys, requests for 1,000 keys, and the fewest pages there could be."""
    one = events.where("event = 'page_committed'").agg(F.count("*").alias("n_pages"), F.coalesce(F.sum("keys"), F.lit(0)).alias("n_keys"))
    return one.select("*", F.when(F.col("n_keys") > 0, 1000.0 * F.col("n_pages") / F.col("n_keys")).alias("per_1000"), F.ceil(F.col("n_keys") / 1000).alias("least_pages"))


def mechanisms(events: DataFrame) -> DataFrame:
    """Splits by kind and mechanism, with the first three pivots."""
    rows = events.where(F.col("event").isin(*SPLITS)).withColumn("mechanism", F.coalesce("mechanism", F.lit("?")))
    nth = Window.partitionBy("mechanism").orderBy("ts_ns")
    rows = rows.withColumn("_n", F.count("pivot").over(nth.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    first = F.transform(F.sort_array(F.collect_list(F.when(F.col("pivot").isNotNull() & (F.col("_n") <= 3), F.struct("ts_ns", "pivot")))), lambda x: x["pivot"])
    return rows.groupBy(F.col("event").alias("kind"), "mechanism").agg(F.count("*").alias("n"), first.alias("pivots"))


def outcomes(events: DataFrame) -> DataFrame:
    """Steal attempts by outcome and reason."""
    name = F.concat_ws(" / ", F.coalesce("outcome", F.lit("?")), F.coalesce("reason", F.lit("?")))
    return events.where("event = 'steal_attempt'").groupBy(name.alias("name")).agg(F.count("*").alias("n"))


def gates(events: DataFrame, most: int = 6) -> DataFrame:
    """Reasons of split decisions, the most frequent, and whether they stopped a split."""
    rows = events.where("event = 'owner_split_decision'").groupBy(F.coalesce("reason", F.lit("?")).alias("reason")).agg(F.count("*").alias("n"))
    return rows.withColumn("blocked", ~F.col("reason").isin(*UNSPLIT_REASONS)).orderBy(F.col("n").desc(), "reason").limit(most)


def busy_time(segments: DataFrame, n_workers: Column | int) -> DataFrame:
    """Busy time, the time if it were spread evenly, and idle time, of segments (begin, end)."""
    n = F.lit(n_workers) if isinstance(n_workers, int) else n_workers
    one = segments.agg(F.sum(F.col("end") - F.col("begin")).cast("double").alias("busy"), (F.max("end") - F.min("begin")).cast("double").alias("elapsed"))
    return one.select("busy", (F.col("busy") / n).alias("ideal"), F.greatest(F.col("elapsed") * n - F.col("busy"), F.lit(0.0)).alias("idle"), (100.0 * F.col("busy") / n / F.col("elapsed")).alias("speedup_percent"))
