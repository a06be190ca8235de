"""What the ten operators share: reading tables, words, shared storage, shipping code to executors."""

from __future__ import annotations

import os
import string
import tempfile
import uuid
import zipfile
from pathlib import Path

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rule: space and the controls 09 to 0D.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: The same rule for numpy: True for the six bytes that separate words.
SPACE_BYTES = bytes([0x20, *range(0x09, 0x0E)])

_SHIPPED: set[str] = set()
#: Bytes of an Arrow batch that goes to a Python worker (Spark's own limit is 64 MB).
BATCH_BYTES = 4 << 20
_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Texts of a partition, about 100 MB.
PART_ROWS = 25_000
#: A key is hot if it has at least one in so many rows, so there are at most so many hot keys.
HOT = 1000
#: Bits of a Bloom filter; it is a fixed 8 MB whatever it is made of.
BLOOM_BITS = 1 << 26


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(col, string.ascii_uppercase, string.ascii_lowercase)


def words(text: Column) -> Column:
    """Array of the words of a text; null counts as empty."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or where that is unset and all runs on one machine (tests) one of our own."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        at = f"file://{tempfile.gettempdir()}/keyloom-{os.getpid()}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def stash_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it goes when the JVM ends."""
    path = f"{shared_dir(spark)}/keyloom/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def stash(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Cut the lineage: write to the shared folder as Parquet and read it back."""
    spark, schema = df.sparkSession, df.schema
    path = stash_path(spark, name)
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._stash = path
    return out


def discard(*stashes: DataFrame) -> None:
    """Delete stashes that nothing will read again."""
    for df in stashes:
        at = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df._stash)
        at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def ship(spark: SparkSession) -> None:
    """Give executors this package, for clusters where it isn't installed; batches of texts for Python are cut by bytes."""
    context = spark.sparkContext
    if spark.conf.get(_BYTES, None) is None or int(spark.conf.get(_BYTES)) > BATCH_BYTES:
        spark.conf.set(_BYTES, str(BATCH_BYTES))
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    out = Path(tempfile.mkdtemp(prefix="keyloom-")) / "keyloom_ship.zip"
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent).as_posix())
    context.addPyFile(str(out))
    _SHIPPED.add(context.applicationId)


def partitions(spark: SparkSession, rows: DataFrame) -> int:
    """Partitions for an explicit repartition of texts: what the session is set to, or more if one would have over PART_ROWS rows."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // PART_ROWS))


def hot_join(rows: DataFrame, keyed: DataFrame, keys: list[str], total: int) -> DataFrame:
    """rows left-joined with keyed (one row a key; column c: how many rows have it): hot keys by a broadcast of at most HOT rows, the rest by a shuffle."""
    hot = keyed.where(F.col("c") * HOT >= total).drop("c").withColumn("_hot", F.lit(True))
    met = rows.join(F.broadcast(hot), keys, "left")
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(keyed.where(F.col("c") * HOT < total).drop("c"), keys, "left")
    return met.where("_hot").drop("_hot").unionByName(rest)


def bloom(ids: DataFrame, col: str) -> np.ndarray:
    """A Bloom filter of a bigint column as 64-bit words; at most BLOOM_BITS / 64 of them come to the driver."""
    h = F.xxhash64(col)
    at = F.explode(F.array(h.bitwiseAND(F.lit(BLOOM_BITS - 1)), F.shiftrightunsigned(h, 32).bitwiseAND(F.lit(BLOOM_BITS - 1))))
    rows = ids.select(at.alias("at")).select(F.shiftright("at", 6).alias("w"), F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("at").bitwiseAND(F.lit(63)).cast("int")).alias("m"))
    got = rows.groupBy("w").agg(F.bit_or("m").alias("m")).toArrow()
    out = np.zeros(BLOOM_BITS >> 6, np.uint64)
    out[got["w"].to_numpy()] = got["m"].to_numpy().view(np.uint64)
    return out


def in_bloom(words_: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which xxhash64 values may be of the filter's ids; never False for one that is."""
    h, most = h.view(np.uint64), np.uint64(BLOOM_BITS - 1)
    has = [(words_[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) for at in (h & most, (h >> np.uint64(32)) & most)]
    return (has[0] & has[1]).astype(bool)


def packed(docs: DataFrame) -> DataFrame:
    """doc_id, z: each text zstd-compressed on its own, for shuffles of whole texts; null stays null."""
    ship(docs.sparkSession)

    def run(batches):
        pack = zstandard.ZstdCompressor(level=3).compress
        for b in batches:
            z = [None if x is None else pack(x.encode("utf-8", "surrogatepass")) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "z": pa.array(z, pa.binary())})

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, z binary")


def small(batches, most: int = 4 << 20):
    """Arrow batches cut to about so many bytes, where work on one takes many times its size."""
    for b in batches:
        step = max(1, b.num_rows * most // max(b.nbytes, 1))
        for at in range(0, b.num_rows, step):
            yield b.slice(at, step)


def unpacker():
    """The inverse, to UTF-8 bytes; null is empty."""
    unpack = zstandard.ZstdDecompressor().decompress
    return lambda z: b"" if z is None else unpack(z)
