"""The test tables as listings and traces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.schema import as_listing


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def pages(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "pages")
    return as_listing(rows.select(F.regexp_replace("url", "^https?://", "").cast("binary").alias("key"), F.length("html").cast("bigint").alias("size"), F.md5("url").alias("etag"), F.timestamp_micros(F.lit(1_700_000_000_000_000) + F.col("page_id") * 1_000_250).alias("last_modified")))


def documents(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents")
    return as_listing(rows.select(F.concat_ws("/", "source", "lang", F.lpad(F.col("doc_id").cast("string"), 8, "0")).cast("binary").alias("key"), F.col("n_chars").alias("size")))


def orders(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders")
    key = F.concat(F.date_format("o_orderdate", "yyyy/MM/dd"), F.lit("/"), F.col("o_orderkey").cast("string"))
    return as_listing(rows.select(key.cast("binary").alias("key"), F.round(F.col("o_totalprice") * 100).cast("bigint").alias("size"), F.col("o_orderdate").cast("timestamp").alias("last_modified"), F.col("o_orderpriority").alias("storage_class"), F.when(F.col("o_orderstatus") == "P", "DELETE_MARKER").otherwise("OBJECT").alias("row_type")))


def lines(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem")
    key = F.concat(F.date_format("l_shipdate", "yyyy/MM/dd"), F.lit("/"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string"))
    return as_listing(rows.select(key.cast("binary").alias("key"), F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("size"), F.col("l_shipdate").cast("timestamp").alias("last_modified"), F.col("l_returnflag").alias("storage_class")))


def events(spark: SparkSession, d: str) -> DataFrame:
    """run (by user), at (microseconds from the first event), kind, value in hundredths, live +1 or -1."""
    rows = table(spark, d, "events").select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("user_id").alias("worker"), F.col("event_type").alias("kind"), F.round(F.col("value") * 100).cast("bigint").alias("cents"))
    return rows.select("event_id", (F.col("us") - F.lit(1_704_067_200_000_000)).alias("at"), (F.col("worker") % 8).alias("run"), "worker", "kind", "cents", (F.col("cents") % 7).alias("depth"))


def trace(spark: SparkSession, d: str) -> DataFrame:
    """Orders and lines as a run's trace: customers' orders are nodes, each split off the order of the same customer before it."""
    from pyspark.sql import Window

    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    before = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    o = o.withColumn("before", before)
    none = lambda t: F.lit(None).cast(t)
    seeded = o.where("before is null").select((F.col("o_orderkey") * 10).alias("ts_ns"), F.lit("seeded").alias("event"), F.lit(-1).cast("bigint").alias("worker_id"), F.col("o_orderkey").alias("node_id"), none("bigint").alias("child_node_id"), none("string").alias("mechanism"), none("string").alias("pivot"), none("bigint").alias("keys"))
    split = o.where("before is not null").select((F.col("o_orderkey") * 10 + 1), F.when(F.col("o_orderkey") % 3 == 0, "owner_split").otherwise("split"), F.col("o_custkey") % 16, F.col("before"), F.col("o_orderkey"), F.col("o_orderpriority"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0"), none("bigint"))
    claimed = o.select(F.col("o_orderkey") * 10 + 2, F.lit("claimed"), F.col("o_orderkey") % 16, "o_orderkey", none("bigint"), none("string"), none("string"), none("bigint"))
    li = table(spark, d, "lineitem")
    page = li.join(o.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey").select(F.col("l_orderkey") * 10 + 3, F.lit("page_committed"), F.col("l_orderkey") % 16, "l_orderkey", none("bigint"), none("string"), none("string"), F.col("l_quantity").cast("bigint"))
    done = o.select(F.col("o_orderkey") * 10 + 9, F.lit("completed"), F.col("o_orderkey") % 16, "o_orderkey", none("bigint"), none("string"), none("string"), none("bigint"))
    return seeded.union(split).union(claimed).union(page).union(done)


#: The same for DuckDB; keys are text there, which sorts alike.
SQL = """
P AS (SELECT regexp_replace(url, '^https?://', '') AS key, length(html)::BIGINT AS size, md5(url) AS etag, 1700000000000000 + page_id * 1000250 AS us FROM pages),
D AS (SELECT concat_ws('/', source, lang, lpad(doc_id::VARCHAR, 8, '0')) AS key, n_chars AS size FROM documents),
O AS (SELECT strftime(o_orderdate, '%Y/%m/%d') || '/' || o_orderkey AS key, round(o_totalprice * 100)::BIGINT AS size, epoch_us(o_orderdate) AS us, o_orderpriority AS storage_class, CASE WHEN o_orderstatus = 'P' THEN 'DELETE_MARKER' ELSE 'OBJECT' END AS row_type FROM orders),
L AS (SELECT strftime(l_shipdate, '%Y/%m/%d') || '/' || l_orderkey || '-' || l_linenumber AS key, round(l_extendedprice * 100)::BIGINT AS size, epoch_us(l_shipdate) AS us, l_returnflag AS storage_class FROM lineitem),
E AS (SELECT event_id, epoch_us(ts) - 1704067200000000 AS at, user_id % 8 AS run, user_id AS worker, event_type AS kind, round(value * 100)::BIGINT AS cents, round(value * 100)::BIGINT % 7 AS depth FROM events),
TB AS (SELECT o_orderkey, o_custkey, o_orderpriority, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before FROM orders),
T AS (
  SELECT o_orderkey * 10 AS ts_ns, 'seeded' AS event, -1::BIGINT AS worker_id, o_orderkey AS node_id, NULL::BIGINT AS child_node_id, NULL::VARCHAR AS mechanism, NULL::VARCHAR AS pivot, NULL::BIGINT AS keys FROM TB WHERE before IS NULL
  UNION ALL SELECT o_orderkey * 10 + 1, CASE WHEN o_orderkey % 3 = 0 THEN 'owner_split' ELSE 'split' END, o_custkey % 16, before, o_orderkey, o_orderpriority, lpad(o_orderkey::VARCHAR, 9, '0'), NULL FROM TB WHERE before IS NOT NULL
  UNION ALL SELECT o_orderkey * 10 + 2, 'claimed', o_orderkey % 16, o_orderkey, NULL, NULL, NULL, NULL FROM TB
  UNION ALL SELECT l_orderkey * 10 + 3, 'page_committed', l_orderkey % 16, l_orderkey, NULL, NULL, NULL, l_quantity::BIGINT FROM lineitem JOIN TB ON l_orderkey = o_orderkey
  UNION ALL SELECT o_orderkey * 10 + 9, 'completed', o_orderkey % 16, o_orderkey, NULL, NULL, NULL, NULL FROM TB)
"""
