"""Incremental listings: snapshots that arrive as files become one table, each batch exactly once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.schema import LISTING


def read_stream(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """Listing files as a stream; a batch takes so many files at most."""
    return spark.readStream.schema(LISTING).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def write_batches(df: DataFrame, out: str, checkpoint: str, every: str | None = None):
    """Append a stream to a table by batch id: a batch that is done again replaces what it left before.

    every: an interval after which a part is rolled and the stream goes on; else what is there now is taken.
    """

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return df.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**({"processingTime": every} if every else {"availableNow": True})).start()


def progress(events: DataFrame, at: str = "ts", late: str = "10 minutes", width: str = "1 minute") -> DataFrame:
    """Pages and keys by window of a trace that streams in; rows later than allowed are left out."""
    stamped = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return stamped.groupBy(F.window(at, width).alias("w")).agg(F.count("*").alias("n_pages"), F.sum("keys").alias("n_keys")).select("w.start", "w.end", "n_pages", "n_keys")


def latest(rows: DataFrame) -> DataFrame:
    """The newest row of each key over all batches."""
    return rows.groupBy("key").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "key"]), F.struct("last_modified", "batch")).alias("r")).select("key", "r.*")
