"""Stored listings: Parquet folders and datasets, with files pruned by the manifest."""

from __future__ import annotations

import json
from bisect import bisect_right

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.functions.parse import prefix_end
from keyloom.operators.filters import key_range
from keyloom.plans.dataset import DATA, MANIFEST, STAMP_VERSION, SUCCESS, Folder, manifest_state, stamp
from keyloom.schema import OBJECT, as_listing


def read_listing(spark: SparkSession, path: str, objects_only: bool = True) -> DataFrame:
    """A file, a folder of Parquet files or a dataset; missing optional columns are filled in."""
    folder = Folder(spark, path)
    rows = as_listing(spark.read.parquet(f"{path}/{DATA}" if folder.exists(DATA) else path))
    return rows.where(F.col("row_type") == OBJECT) if objects_only else rows


def read_range(spark: SparkSession, path: str, prefix: bytes = b"", after: bytes | None = None, upto: bytes | None = None) -> DataFrame:
    """Keys of a sorted dataset in a range: only files whose keys can be in it are opened."""
    folder = Folder(spark, path)
    if manifest_state(folder) != "VALID" or not folder.exists(SUCCESS):
        raise ValueError(f"{path} isn't a finished dataset")
    end = prefix_end(prefix) if prefix else None

    def may_hold(f: dict) -> bool:
        low, high = bytes.fromhex(f["minKey"]), bytes.fromhex(f["maxKey"])
        return high >= prefix and (end is None or low < end) and (after is None or high > after) and (upto is None or low <= upto)

    files = [f"{path}/{f['key']}" for f in json.loads(folder.read(MANIFEST))["files"] if f["rowCount"] and may_hold(f)]
    rows = as_listing(spark.read.parquet(*files)) if files else read_listing(spark, path).limit(0)
    return key_range(rows, after=after, upto=upto, prefix=prefix)


def file_spans(spark: SparkSession, path: str) -> list[tuple[str, bytes, bytes, bool]]:
    """Files of a sorted dataset in key order: path, first key, last key, whether they hold objects only."""
    folder = Folder(spark, path)
    if manifest_state(folder) != "VALID" or not folder.exists(SUCCESS):
        raise ValueError(f"{path} isn't a finished dataset")
    manifest = json.loads(folder.read(MANIFEST))
    ok, why = eligible(manifest)
    if not ok:
        raise ValueError(f"{path} can't be served by key order: {why}")
    return [(f"{path}/{f['key']}", bytes.fromhex(f["minKey"]), bytes.fromhex(f["maxKey"]), f.get("objectCount") == f["rowCount"]) for f in manifest["files"] if f["rowCount"]]


def row_groups(spark: SparkSession, path: str) -> list[tuple[str, int, int, bytes | None, bytes | None, bool]]:
    """Row groups of a sorted dataset, from the files' footers: file, number, rows, first and last key, whether they hold objects only.

    Keys are bounds: a writer may cut long statistics, downwards for the first and upwards for the last.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for file, *_ in file_spans(spark, path):
        at = jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(file), conf)
        reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(at)
        try:
            for i, block in enumerate(reader.getFooter().getBlocks()):
                by = {c.getPath().toDotString(): c.getStatistics() for c in block.getColumns()}
                known = {k: (bytes(s.getMinBytes()), bytes(s.getMaxBytes())) for k, s in by.items() if k in ("key", "row_type") and s is not None and s.hasNonNullValue()}
                low, high = known.get("key", (None, None))
                out.append((file, i, block.getRowCount(), low, high, known.get("row_type") == (OBJECT.encode(), OBJECT.encode())))
        finally:
            reader.close()
    return out


def first_group(groups: list[tuple], at: bytes) -> int:
    """Where a scan from a key on begins: the last row group whose first key isn't above it."""
    return max(0, bisect_right([g[3] or b"" for g in groups], at) - 1)


def eligible(manifest: dict) -> tuple[bool, str]:
    """Whether a dataset can be served by key order, and why not.

    It must say sorted, its files must be stamped in a version and mode that are known, numbered from
    1 on with the last as final, and not overlap.
    """
    if not manifest.get("sorted") or manifest.get("sortKey") != "key":
        return False, "not sorted by key"
    stamps = [stamp(manifest, f) for f in manifest["files"]]
    if any(s is None for s in stamps):
        return False, "a file without a stamp"
    if any(s["version"] != STAMP_VERSION for s in stamps):
        return False, "a stamp of an unknown version"
    if any(s["mode"] != "objects" for s in stamps):
        return False, "not a listing of objects"
    if [s["index"] for s in stamps] != list(range(1, len(stamps) + 1)):
        return False, "files are missing"
    if stamps and [s["final"] for s in stamps] != [False] * (len(stamps) - 1) + [True]:
        return False, "the last file is missing"
    files = [f for f in manifest["files"] if f["rowCount"]]
    for a, b in zip(files, files[1:], strict=False):
        if bytes.fromhex(a["maxKey"]) >= bytes.fromhex(b["minKey"]):
            return False, "files overlap"
    return True, ""
