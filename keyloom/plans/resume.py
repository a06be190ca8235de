"""State of a cut-off run as a table: which ranges are done, and from where the others go on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NODES = "node_id bigint, low binary, high binary, cursor binary, durable_cursor binary, status string, part string"


def open_ranges(nodes: DataFrame) -> DataFrame:
    """Ranges (after, upto] to list again: from what is durably written, else from the range's start."""
    return nodes.where("status <> 'COMPLETED'").select("node_id", F.coalesce("durable_cursor", "low").alias("after"), F.col("high").alias("upto"))


def counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("status").agg(F.count("*").alias("n_nodes"))


def durable_cursors(written: DataFrame) -> DataFrame:
    """The last key that each finished part has of each range."""
    return written.groupBy("part", "node_id").agg(F.max("key").alias("cursor"))


def resumed(done: DataFrame, again: DataFrame, nodes: DataFrame) -> DataFrame:
    """What finished parts hold, up to each range's durable cursor, with what was listed again behind it: each row once."""
    bounds = F.broadcast(nodes.select("node_id", "durable_cursor", "status"))  # plan metadata
    kept = done.join(bounds, "node_id").where("status = 'COMPLETED' or key <= durable_cursor").select(*done.columns)
    new = again.join(bounds, "node_id").where("status <> 'COMPLETED' and (durable_cursor is null or key > durable_cursor)").select(*done.columns)
    return kept.unionByName(new)


def check_identity(stored: str, now: str) -> None:
    if stored != now:
        raise ValueError("the run was begun with other options")
