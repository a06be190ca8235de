"""Publishing a listing as a dataset, and resuming one that was cut off.

``data/`` is written by Spark's committer; then the driver writes the manifest, the symlink list and,
last, ``_SUCCESS``, each through a temporary name. A folder without ``_SUCCESS`` isn't a dataset; one
with another run's identity isn't overwritten unless asked.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.functions.parse import identity
from keyloom.operators.sorting import sort_listing
from keyloom.plans.formats import TSV_HEADER, lines
from keyloom.plans.resume import check_identity
from keyloom.schema import OBJECT, as_listing

DATA, MANIFEST, STATE, SYMLINK, SUCCESS = "data", "manifest.json", ".state", "symlink.txt", "_SUCCESS"
SORT_KEY = "key"
#: What a stamp of this version says; a reader that knows another version only must not trust it.
STAMP_ORDER, STAMP_VERSION, STAMP_MODES = "key_unsigned", 1, ("objects", "versions")
#: Bytes after which a part is rolled; a file's checksum takes it in one row, so it stays far below 2 GB.
PART_BYTES = 512 << 20
#: Rows by which a row's stored size is estimated.
SIZED = 20_000
#: What a suffix says about compression.
SUFFIXES = {".gz": "gzip", ".gzip": "gzip", ".zst": "zstd", ".zstd": "zstd"}


class Folder:
    """Files of a dataset, on any file system that Spark can reach."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self.fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def exists(self, name: str = "") -> bool:
        return self.fs.exists(self._at(name))

    def is_link(self) -> bool:
        """Whether the folder itself is a symbolic link, on a file system that has them."""
        path = self._at("").toUri()
        return path.getScheme() in (None, "file") and os.path.islink(path.getPath())

    def names(self, name: str = "") -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self._at(name))) if self.exists(name) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self._at(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        out = self.fs.create(self._at(f"{name}.tmp"), True)
        out.write(bytearray(text.encode()))
        out.hsync()
        out.close()
        self.fs.delete(self._at(name), False)
        if not self.fs.rename(self._at(f"{name}.tmp"), self._at(name)):
            raise OSError(f"can't publish {name}")

    def remove(self, name: str = "") -> None:
        self.fs.delete(self._at(name), True)


def manifest_state(folder: Folder) -> str:
    """ABSENT, VALID or DAMAGED."""
    if not folder.exists(MANIFEST):
        return "ABSENT"
    try:
        m = json.loads(folder.read(MANIFEST))
        whole = all(isinstance(m[k], t) for k, t in (("sourceBucket", str), ("version", str), ("creationTimestamp", int), ("fileFormat", str), ("fileSchema", str), ("sorted", bool), ("files", list)))
        key = isinstance(m["sortKey"], str) if m["sorted"] else m["sortKey"] is None
        files = all(isinstance(f["key"], str) and isinstance(f["size"], int) and isinstance(f["MD5checksum"], str) and isinstance(f["rowCount"], int) for f in m["files"])
        return "VALID" if whole and key and files and m["version"] == "1" else "DAMAGED"
    except (ValueError, KeyError, TypeError):
        return "DAMAGED"


def compression_of(path: str, form: str, wanted: str | None = None) -> str:
    """The compression asked for, else what the path's suffix says, else the form's own."""
    if wanted:
        return wanted
    known = next((c for s, c in SUFFIXES.items() if path.rstrip("/").endswith(s)), None)
    return known or ("zstd" if form == "parquet" else "none")


def stamp(manifest: dict, file: dict) -> dict | None:
    """A file's sort stamp: order, mode, version, index, final; None where it has none that can be read."""
    got = file.get("sortStamp")
    if not manifest.get("sorted") or not isinstance(got, dict) or got.get("order") != STAMP_ORDER or got.get("mode") not in STAMP_MODES or not isinstance(got.get("version"), int):
        return None
    return {"order": got["order"], "mode": got["mode"], "version": got["version"], "index": got.get("index", 1), "final": got.get("final") is True}


def rows_of(df: DataFrame, part_bytes: int) -> int:
    """How many rows of a listing are about so many stored bytes: by the average of its first ones before compression."""
    some = df.limit(SIZED).select([F.coalesce(F.octet_length(F.col(f.name).cast("string")), F.lit(1)).alias(f.name) for f in df.schema.fields])
    one = some.agg(F.sum(sum((F.col(c) for c in some.columns), F.lit(0))).alias("b"), F.count("*").alias("n")).first()
    return max(1, int(part_bytes / max(1.0, (one.b or 1) / max(1, one.n))))


def guard(folder: Folder, run: str, mode: str = "error") -> None:
    """Refuse a folder that holds something else, a link, another run, or (by default) a finished dataset."""
    if folder.is_link():
        raise FileExistsError(f"{folder.path} is a link")
    names = folder.names()
    if not names:
        return
    if mode == "overwrite":
        if SUCCESS not in names and STATE not in names:
            raise FileExistsError(f"{folder.path} holds other files")
        folder.remove()
        return
    if STATE not in names:
        raise FileExistsError(f"{folder.path} holds other files")
    check_identity(json.loads(folder.read(STATE)).get("run"), run)
    if SUCCESS in names and mode != "resume":
        raise FileExistsError(f"{folder.path} is finished")


def manifest_rows(spark: SparkSession, path: str, form: str = "parquet", suffix: str = "") -> DataFrame:
    """Of each data file: name, size, MD5, rows and, for Parquet, objects, first and last key."""
    binary = spark.read.format("binaryFile").load(f"{path}/{DATA}").where(~F.col("path").rlike(r"/[._][^/]*$"))
    name = F.substring_index("path", "/", -1)
    files = binary.select(name.alias("file"), F.col("length").alias("size"), F.md5("content").alias("md5"))
    if form == "parquet":
        rows = spark.read.parquet(f"{path}/{DATA}").groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count("*").alias("n_rows"), F.min("key").alias("min_key"), F.max("key").alias("max_key"), F.count_if(F.col("row_type") == OBJECT).alias("n_objects"))
    else:
        rows = spark.read.text(f"{path}/{DATA}").groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count("*").alias("n_rows"), F.lit(None).cast("binary").alias("min_key"), F.lit(None).cast("binary").alias("max_key"), F.lit(None).cast("bigint").alias("n_objects"))
    return files.join(rows, "file", "left").withColumn("n_rows", F.coalesce("n_rows", F.lit(0)))


def write_listing(df: DataFrame, path: str, form: str = "parquet", bucket: str = "", compression: str | None = None, sort: bool = False, parts: int | None = None, max_rows: int | None = None, options: tuple[str, ...] = (), mode: str = "error", part_bytes: int = PART_BYTES) -> dict:
    """Write a dataset and return its manifest.

    form: parquet, tsv or jsonl; compression by the path's suffix where it isn't given. Sorted parts
    don't overlap and are numbered in order. A part is rolled after max_rows rows or about part_bytes.
    """
    spark = df.sparkSession
    folder, run = Folder(spark, path), identity(bucket, form, str(sort), *options)
    guard(folder, run, mode)
    if mode == "resume" and folder.exists(SUCCESS):
        return json.loads(folder.read(MANIFEST))
    folder.write(STATE, json.dumps({"run": run, "phase": "MERGING" if sort else "WRITING"}))
    rows = as_listing(df)
    max_rows = min(max_rows or 1 << 62, rows_of(rows, part_bytes))
    if sort:
        rows = sort_listing(rows, parts or int(spark.conf.get("spark.sql.shuffle.partitions")))
    elif parts:
        rows = rows.repartition(parts)  # a coalesce would narrow all that comes before
    writer = (rows if form == "parquet" else lines(rows, form)).write.mode("overwrite")  # what an earlier attempt left goes
    writer = writer.option("maxRecordsPerFile", max_rows).option("compression", compression_of(path, form, compression))
    if form == "parquet":
        writer.parquet(f"{path}/{DATA}")
    else:
        writer.text(f"{path}/{DATA}")
    versions = sort and form == "parquet" and not spark.read.parquet(f"{path}/{DATA}").where("version_id is not null").isEmpty()
    return publish(folder, run, bucket, form, sort, "versions" if versions else "objects")


def publish(folder: Folder, run: str, bucket: str, form: str, sort: bool, mode: str = "objects") -> dict:
    """Manifest, symlink list and, last, the success marker; a row each file comes to the driver. Sorted files are stamped, the last as final."""
    files = []
    for r in sorted(manifest_rows(folder.spark, folder.path, form).collect(), key=lambda r: (bytes(r.min_key) if sort and r.min_key is not None else b"", r.file)):
        entry = {"key": f"{DATA}/{r.file}", "size": r.size, "MD5checksum": r.md5, "rowCount": r.n_rows}
        if r.min_key is not None:
            entry |= {"minKey": bytes(r.min_key).hex(), "maxKey": bytes(r.max_key).hex(), "objectCount": r.n_objects}
        files.append(entry)
    if sort:
        for i, entry in enumerate(files, 1):
            entry["sortStamp"] = {"order": STAMP_ORDER, "mode": mode, "version": STAMP_VERSION, "index": i} | ({"final": True} if i == len(files) else {})
    schema = TSV_HEADER.replace("\t", ", ") if form == "tsv" else form
    manifest = {"sourceBucket": bucket, "version": "1", "creationTimestamp": int(time.time() * 1000), "fileFormat": form.capitalize(), "fileSchema": schema, "sorted": sort, "sortKey": SORT_KEY if sort else None, "files": files}
    folder.write(MANIFEST, json.dumps(manifest, indent=2))
    folder.write(SYMLINK, "".join(f"{folder.path}/{f['key']}\n" for f in files))
    folder.write(STATE, json.dumps({"run": run, "phase": "COMPLETE"}))
    folder.write(SUCCESS, "")
    return manifest


def sort_capture(spark: SparkSession, source: str, path: str, **kwargs) -> dict:
    """Sort an older capture into a dataset; a key that occurs twice, or versions, are refused."""
    from keyloom.operators.sorting import fail_on_duplicates

    df = as_listing(spark.read.parquet(source))
    if not df.where("version_id is not null").isEmpty():
        raise ValueError("a capture with versions can't be sorted by key alone")
    return write_listing(fail_on_duplicates(df), path, sort=True, **kwargs)
