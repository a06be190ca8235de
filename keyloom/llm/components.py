"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import discard, hot_join, stash


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """links (a, b), bigint, not null -> node, root: the least node reachable; only nodes with a link.

    Each round every link (u, v), u > v, is redirected to the least neighbour; the number of rounds
    is about the logarithm of the longest path. Least neighbours are pre-aggregated and joined by
    hot_join, so a node with very many links is no single task's group. Rounds are written to the
    shared folder, where each replaces the one before.
    """
    edges = stash(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    last, n = None, edges.count()
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("c"))
        large = hot_join(both, least, ["u"], 2 * n).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        more = stash(large.join(small, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "edges")
        discard(edges)
        edges = more
        state = edges.agg(F.count("*"), F.sum(F.hash("u", "v").cast("bigint"))).first()
        if state == last:
            break
        last, n = state, state[0]
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
