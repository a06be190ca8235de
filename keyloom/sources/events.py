"""Traces of runs as JSON lines, and recorded exchanges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fields of a trace, version 1.
TRACE = (
    "v int, ts_ns bigint, ts_ms bigint, event string, worker_id bigint, node_id bigint, lo string, hi string, cursor string, pivot string, keys bigint, completed boolean, child_node_id bigint, mechanism string, outcome string, reason string, "
    "est double, best_est double, far_ahead_fraction double, density_ratio double, keys_emitted double, pages_since_last_self_split bigint, outstanding bigint, worker_count bigint, seen bigint, skipped_unsplittable bigint, skipped_paced bigint, skipped_no_span bigint, chosen_node_id bigint"
)
KINDS = ("seeded", "claimed", "page_committed", "split", "owner_split", "completed", "failed", "steal_attempt", "owner_split_decision", "victim_selection")


def read_trace(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Events of known kinds, and (one row) how many lines were left out: torn, blank or unknown."""
    raw = spark.read.schema(TRACE + ", _corrupt string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    lines = spark.read.text(path).select(F.from_json("value", TRACE + ", _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("e"), "value")
    good = F.col("e._corrupt").isNull() & F.col("e.event").isin(*KINDS)
    skipped = lines.agg(F.count_if(~F.coalesce(good, F.lit(False)) & (F.trim("value") != "")).alias("n_skipped"), F.count_if(F.trim("value") == "").alias("n_blank"))
    return raw.where(F.col("event").isin(*KINDS)).drop("_corrupt"), skipped


def write_trace(events: DataFrame, path: str) -> None:
    """Append events as JSON lines in the order of their fields; fields without a value are left out."""
    fields = [c.split()[0] for c in TRACE.split(", ")]
    events.select(F.to_json(F.struct(*[c for c in fields if c in events.columns])).alias("value")).write.mode("append").text(path)


def unescape(text):
    """Keys of a trace as bytes: \\xHH is the character HH."""
    parts = F.split(text, r"(?=\\x[0-9A-Fa-f]{2})")
    one = lambda p: F.when(p.rlike(r"^\\x[0-9A-Fa-f]{2}"), F.concat(F.chr(F.conv(F.substring(p, 3, 2), 16, 10).cast("bigint")), F.substring(p, 5, 1 << 20))).otherwise(p)
    return F.array_join(F.transform(parts, one), "").cast("binary")


def read_recording(spark: SparkSession, path: str) -> DataFrame:
    """Exchanges of an HTTP archive: method, url, status, body."""
    kind = "log struct<entries: array<struct<request: struct<method: string, url: string>, response: struct<status: int, content: struct<text: string>>>>>"
    rows = spark.read.schema(kind).option("multiLine", True).json(path)
    return rows.select(F.posexplode("log.entries").alias("n", "e")).select("n", "e.request.method", "e.request.url", "e.response.status", F.col("e.response.content.text").alias("body"))
