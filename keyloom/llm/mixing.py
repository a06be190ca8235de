"""Mixing sources to target weights, by Efraimidis-Spirakis sampling (native).

Every document gets an exponential key ``-ln(u) / weight`` with ``u`` hashed from its id, so that
taking documents by ascending key is weighted sampling without replacement and reruns agree. A
source whose target is ``e`` whole sizes and a remainder first gives ``e`` complete epochs; the
remainder is filled by ascending key. Whole documents are taken: the one at the budget's edge is in
if at least half of it fits.

Plan: no task holds a source. Each octave of keys is cut into ``CELLS`` slices, so any positive
weight is taken as it is; (source, slice) sums are prefix-summed to find where each source's budget
ends, and only rows of one slice are ordered together. Targets need one row per source on one task;
sources are metadata.

Nulls and ties: a null text has size 0, a null source is a source of its own (last), a null id has a
key by its text, a null weight is 1, one that isn't above 0 comes after all others; rows that agree in id and size share a key, so which of them is
in doesn't change the result. An empty table gives no rows. Extra columns, whatever their names, stay in ``mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keyloom.llm.common import WORD, table

CELLS = 4096
#: Keys of documents without weight begin here; doubles end a little above.
LAST = 1e300
SEED = "mix-1"


def uniform(doc_id: Column, seed: str = SEED) -> Column:
    """A number in (0, 1) from the first 48 bits of a digest."""
    head = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), doc_id.cast("string"))), 1, 12), 16, 10)
    return (head.cast("bigint") + F.lit(0.5)) / F.lit(float(1 << 48))


def water_fill(sizes: DataFrame, ratios: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """(source, source_size) -> also target: shares of the whole by weight, never above cap sizes.

    Resharing the excess by weight until none is above its cap ends at min(cap, level * weight) for
    one level; sources sorted by cap / weight are capped up to a point, so the level comes from
    prefix sums instead of rounds.
    """
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ratio = F.element_at(F.array(*map(F.lit, ratios)), ((F.row_number().over(by_name) - 1) % len(ratios) + 1).cast("int"))
    rows = sizes.withColumn("w", ratio.cast("bigint")).withColumn("top", F.col("source_size") * cap)
    before = Window.orderBy((F.col("top") / F.col("w")).asc(), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("total", F.sum("source_size").over(everything)).withColumn("w_all", F.sum("w").over(everything))
    rows = rows.withColumn("full", F.coalesce(F.sum("top").over(before), F.lit(0))).withColumn("w_full", F.coalesce(F.sum("w").over(before), F.lit(0)))
    rows = rows.withColumn("level", (F.col("total") - F.col("full")) / (F.col("w_all") - F.col("w_full")))
    #: The first source whose cap isn't reached sets the level; before it, all are full.
    open_level = F.min(F.when(F.col("level") * F.col("w") <= F.col("top"), F.struct((F.col("top") / F.col("w")).alias("at"), "level"))).over(everything)["level"]
    level = F.coalesce(open_level, F.lit(float("inf")))
    return rows.select("source", "source_size", F.least(F.col("top").cast("double"), level * F.col("w")).alias("target"))


def plan(docs: DataFrame, ratios: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """docs: doc_id, source, size, text_hash, weight -> doc_id, source, size, source_size, target, epochs, taken."""
    weight = F.coalesce("weight", F.lit(1.0))
    one = -F.log(uniform(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.col("text_hash").cast("string")))))
    key = F.when(weight > 0, F.least(one / weight, F.lit(LAST))).otherwise(one * LAST)
    keyed = docs.select("doc_id", "source", "size", "text_hash", key.alias("key"))
    # slices of an octave: of any weight's keys an octave holds at most a quarter, and a slice about that over CELLS
    octave = F.floor(F.log2("key"))
    keyed = keyed.withColumn("cell", octave * CELLS + F.floor((F.col("key") / F.pow(F.lit(2.0), octave) - 1) * CELLS))
    cells = keyed.groupBy("source", "cell").agg(F.sum("size").alias("cell_size"))
    targets = water_fill(cells.groupBy("source").agg(F.sum("cell_size").alias("source_size")), ratios, cap)
    upto = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("cell_start", F.coalesce(F.sum("cell_size").over(upto), F.lit(0)))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    targets = targets.withColumn("epochs", epochs.cast("bigint")).withColumn("left", F.col("target") - F.col("epochs") * F.col("source_size"))
    cells = cells.alias("c").join(targets.alias("t"), F.col("c.source").eqNullSafe(F.col("t.source"))).select("c.source", "cell", "cell_start", "source_size", "target", "epochs", "left")
    rows = keyed.alias("k").join(cells.alias("c"), F.col("k.source").eqNullSafe(F.col("c.source")) & (F.col("k.cell") == F.col("c.cell")))
    rows = rows.select("k.doc_id", "k.source", "k.cell", "size", "text_hash", "key", "cell_start", "source_size", "target", "epochs", "left")
    inside = Window.partitionBy("source", "cell").orderBy("key", "doc_id", "size", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.col("cell_start") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    again = (F.col("size") > 0) & (F.col("start") * 2 + F.col("size") <= F.col("left") * 2)
    return rows.select("doc_id", "source", "size", "text_hash", "source_size", "target", "epochs", (F.col("size") * (F.col("epochs") + again.cast("bigint"))).cast("bigint").alias("taken"))


def quality_weights(labels: DataFrame) -> DataFrame:
    """doc_id -> weight: 0.5 to 1.5 by mean quality label."""
    return labels.where("doc_id is not null").groupBy("doc_id").agg((F.avg("quality") + 0.5).alias("weight"))


def sized(docs: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """doc_id, source, size in words, text_hash, weight."""
    rows = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"), F.xxhash64("text").alias("text_hash"))
    return rows.withColumn("weight", F.lit(None).cast("double")) if weights is None else rows.join(weights.select("doc_id", "weight"), "doc_id", "left")


def mix(docs: DataFrame, weights: DataFrame | None = None, ratios: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """The mixture itself: each document as many times as it is taken, with its columns.

    Rows that agree in id, source and text are alike to the mix and share what they take as evenly as whole copies allow.
    """
    same = ["doc_id", "source", "text_hash"]
    planned = plan(sized(docs, weights), ratios, cap).where("taken > 0")
    taken = planned.groupBy(*[F.col(c).alias(f"_{c}") for c in same]).agg(F.sum((F.col("taken") / F.col("size")).cast("int")).alias("_times"))
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("d"), F.col("source").alias("s"), F.xxhash64("text").alias("h"))
    on = F.col("d").eqNullSafe(F.col("_doc_id")) & F.col("s").eqNullSafe(F.col("_source")) & (F.col("h") == F.col("_text_hash"))
    alike = Window.partitionBy("_doc_id", "_source", "_text_hash")
    rows = rows.join(taken, on).withColumn("rows", F.count("*").over(alike)).withColumn("k", F.row_number().over(alike.orderBy(F.lit(0))))
    each = F.floor(F.col("_times") / F.col("rows")) + (F.col("k") <= F.col("_times") % F.col("rows")).cast("int")
    return rows.select("row", F.explode(F.array_repeat(F.lit(0), each.cast("int")))).select("row.*")


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = quality_weights(table(spark, sf_dir, "labels"))
    return plan(sized(table(spark, sf_dir, "documents"), weights)).select("doc_id", "size", "source_size", "target", "taken")


#: For tables whose ids and weights aren't null or below 0, like the given ones.
OP1_SQL = rf"""
WITH q AS (SELECT doc_id, avg(quality) + 0.5 AS weight FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
d AS (
  SELECT documents.doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    coalesce(weight, 1.0) AS weight
  FROM documents LEFT JOIN q ON documents.doc_id = q.doc_id),
k AS (
  SELECT *, -ln((('0x' || md5('{SEED}:' || doc_id::VARCHAR)[1:12])::BIGINT + 0.5::DOUBLE) / {float(1 << 48)!r}::DOUBLE) / weight AS key FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM k GROUP BY source),
w AS (SELECT *, ((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::BIGINT AS w, source_size * 3 AS top FROM s),
l AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(top) OVER before, 0))::DOUBLE / (sum(w) OVER () - coalesce(sum(w) OVER before, 0))::DOUBLE AS level FROM w
  WINDOW before AS (ORDER BY top::DOUBLE / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
o AS (SELECT coalesce(min_by(level, top::DOUBLE / w) FILTER (level * w <= top), 'inf'::DOUBLE) AS level FROM l),
t AS (SELECT source, source_size, least(top::DOUBLE, o.level * w) AS target FROM l CROSS JOIN o),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS epochs FROM t),
r AS (
  SELECT k.doc_id, size, source_size, target, epochs, target - epochs * source_size AS rest,
    coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, (size * (epochs + CASE WHEN size > 0 AND start * 2 + size <= rest * 2 THEN 1 ELSE 0 END))::BIGINT AS taken FROM r
"""
