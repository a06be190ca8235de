"""Samples of one instant."""

import math

import duckdb
from pyspark.sql import functions as F

from keyloom.operators import timeline
from keyloom.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_live_rate_of_ties(spark):
    rows = [("ends with ties", 0, 1), ("ends with ties", 2_000_000, 3), ("ends with ties", 2_000_000, 2), ("ends with ties", 2_000_000, 4), ("one", 5, 1), ("one instant", 5, 1), ("one instant", 5, 2), ("none", None, 1)]
    got = {r.run: r.rate for r in timeline.live_rate(spark.createDataFrame(rows, "run string, at bigint, k bigint").repartition(3), "run", "at", "k").collect()}
    assert got == {"ends with ties": 0.5, "one": None, "one instant": math.inf, "none": None}


def test_live_rate_like_sql_on_repeated_events(spark, tmp_path):
    events = spark.read.parquet(f"{DATA}/events.parquet")
    events.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(4)))).withColumn("event_id", F.col("event_id") + F.col("copy") * 1_000_000).drop("copy").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'" if t == "events" else f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = dict(con.execute(catalog.ORACLES["live_rate"]).fetchall())
    assert {r.run: r.rate for r in catalog.QUERIES["live_rate"](spark, str(tmp_path)).collect()} == want
