"""The listing relation: its columns, their defaults in older captures, and its order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

OBJECT, COMMON_PREFIX, DELETE_MARKER = "OBJECT", "COMMON_PREFIX", "DELETE_MARKER"

LISTING = T.StructType([
    T.StructField("key", T.BinaryType(), False),
    T.StructField("size", T.LongType()),
    T.StructField("last_modified", T.TimestampType()),
    T.StructField("etag", T.StringType()),
    T.StructField("storage_class", T.StringType()),
    T.StructField("version_id", T.StringType()),
    T.StructField("is_latest", T.BooleanType()),
    T.StructField("is_delete_marker", T.BooleanType(), False),
    T.StructField("owner_id", T.StringType()),
    T.StructField("owner_display_name", T.StringType()),
    T.StructField("checksum_algorithm", T.StringType()),
    T.StructField("checksum_type", T.StringType()),
    T.StructField("row_type", T.StringType(), False),
])


def as_listing(df: DataFrame) -> DataFrame:
    """Any frame with a key -> all listing columns, in order; what an older capture lacks is filled in."""
    have = set(df.columns)
    row_type = F.col("row_type") if "row_type" in have else F.lit(OBJECT)
    known = {
        "checksum_type": F.when(F.col("checksum_algorithm").isNotNull(), "FULL_OBJECT") if "checksum_algorithm" in have else F.lit(None),
        "is_delete_marker": row_type == DELETE_MARKER,
        "row_type": row_type,
    }
    return df.select(*[(F.col(f.name) if f.name in have else known.get(f.name, F.lit(None))).cast(f.dataType).alias(f.name) for f in LISTING])


def project(df: DataFrame, *wanted: str) -> DataFrame:
    """Listing columns by name, always with the key and the row type; a name no listing has raises."""
    known = [f.name for f in LISTING.fields]
    if unknown := sorted(set(wanted) - set(known)):
        raise ValueError(f"no such column: {', '.join(unknown)}")
    return df.select(*[c for c in known if c in {"key", "row_type", *wanted}])


def keys_only(df: DataFrame) -> DataFrame:
    """Keys and nothing else; a scan reads no other column."""
    return df.select("key")


def type_rank(row_type: Column) -> Column:
    return F.when(row_type == OBJECT, 0).when(row_type == COMMON_PREFIX, 1).otherwise(2)


def order_columns(with_versions: bool = True) -> list[Column]:
    """Keys as unsigned bytes, then versions (none first), then row types."""
    rest = [F.col("version_id").asc_nulls_first(), type_rank(F.col("row_type")).asc()]
    return [F.col("key").asc(), *(rest if with_versions else [])]


def micros(at: Column) -> Column:
    """Microseconds since 1970; a missing time is 0."""
    return F.coalesce(F.unix_micros(at.cast("timestamp")), F.lit(0))


def key_text(key: Column) -> Column:
    """Keys as text; bytes that aren't UTF-8 become U+FFFD."""
    return F.make_valid_utf8(key.cast("string"))


def object_row(key: Column, size: Column, etag: Column | None = None, at: Column | None = None, storage_class: Column | None = None) -> list[Column]:
    """Source fields as listing columns: quotes around etags go, a missing size is 0."""
    none = F.lit(None)
    return [
        key.cast("binary").alias("key"), F.coalesce(size, F.lit(0)).cast("bigint").alias("size"), (none if at is None else at).cast("timestamp").alias("last_modified"),
        F.regexp_replace(none.cast("string") if etag is None else etag, '^"(.*)"$', "$1").alias("etag"), (none if storage_class is None else storage_class).cast("string").alias("storage_class"),
    ]
