"""Listing rows as lines of text, and pages as XML."""

from __future__ import annotations

from urllib.parse import quote
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.functions.keys import escape_controls, iso_time, percent_encode, xml_text
from keyloom.operators.paging import Page, Request
from keyloom.schema import COMMON_PREFIX, DELETE_MARKER, OBJECT, as_listing, key_text

#: Fixed value: the header of the tab-separated form.
TSV_HEADER = "key\tsize\tlast_modified\tetag\tstorage_class\trow_type"


def _only(kinds: tuple[str, ...], value: Column) -> Column:
    return F.coalesce(F.when(F.col("row_type").isin(*kinds), value), F.lit(""))


def tsv_line(escape: bool = False) -> Column:
    """Fields that a row's type lacks are blank."""
    form = escape_controls if escape else lambda c: c
    both, one = (OBJECT, DELETE_MARKER), (OBJECT,)
    fields = [form(key_text(F.col("key"))), _only(one, F.col("size").cast("string")), _only(both, iso_time(F.col("last_modified"))), _only(one, form(F.coalesce("etag", F.lit("")))), _only(one, form(F.coalesce("storage_class", F.lit("")))), F.col("row_type")]
    return F.concat_ws("\t", *fields)


def jsonl_line() -> Column:
    """Fields in fixed order; those that a row lacks are left out."""
    obj, marker = F.col("row_type") == OBJECT, F.col("row_type") == DELETE_MARKER
    either = obj | marker
    fields = [
        key_text(F.col("key")).alias("key"),
        F.when(obj, F.col("size")).alias("size"),
        F.when(obj, F.nullif(iso_time(F.col("last_modified")), F.lit(""))).alias("last_modified"),
        *[F.when(obj, F.col(c)).alias(c) for c in ("etag", "storage_class", "version_id")],
        F.when(obj & F.col("version_id").isNotNull(), F.col("is_latest")).alias("is_latest"),
        *[F.when(obj, F.col(c)).alias(c) for c in ("owner_id", "owner_display_name", "checksum_algorithm", "checksum_type")],
        F.col("row_type"),
    ]
    # a marker's fields come in another order
    marker_fields = [key_text(F.col("key")).alias("key"), "version_id", "is_latest", F.nullif(iso_time(F.col("last_modified")), F.lit("")).alias("last_modified"), "owner_id", "row_type"]
    prefix_fields = [key_text(F.col("key")).alias("key"), "row_type"]
    made = F.when(either & obj, F.to_json(F.struct(*fields))).when(marker, F.to_json(F.struct(*marker_fields))).otherwise(F.to_json(F.struct(*prefix_fields)))
    return F.when(made.rlike(r"\\u00[01][A-F]"), lower_hex(made)).otherwise(made)


def lower_hex(json_text: Column) -> Column:
    """Escaped control characters with lower-case digits; a backslash that is itself escaped begins none."""
    for digit in "ABCDEF":
        json_text = F.regexp_replace(json_text, rf"(?<!\\)((?:\\\\)*)\\u00([01]){digit}", rf"$1\\u00$2{digit.lower()}")
    return json_text


def table_line(escape: bool = True) -> Column:
    """Size to the right of 14 places, time to the left of 24, key; longer values aren't cut."""
    size = F.when(F.col("row_type") == OBJECT, F.col("size").cast("string")).when(F.col("row_type") == DELETE_MARKER, "-").otherwise("PRE")
    time = F.when(F.col("row_type") == COMMON_PREFIX, "").otherwise(iso_time(F.col("last_modified")))
    wide = lambda c, n: F.greatest(F.lit(n), F.char_length(c))
    key = key_text(F.col("key"))
    return F.concat(F.lpad(size, wide(size, 14), F.lit(" ")), F.lit("  "), F.rpad(time, wide(time, 24), F.lit(" ")), F.lit("  "), escape_controls(key) if escape else key)


def lines(df: DataFrame, form: str, escape: bool | None = None, terminal: bool = False) -> DataFrame:
    """One column, line; form is tsv, jsonl or table (auto: table on a terminal, else tsv)."""
    form = ("table" if terminal else "tsv") if form == "auto" else form
    made = {"tsv": lambda: tsv_line(bool(escape)), "jsonl": jsonl_line, "table": lambda: table_line(escape is not False)}
    if form not in made:
        raise ValueError(f"no such format: {form}")
    return df.select(made[form]().alias("line"))


#: The order of elements in a page, and their names.
LIST_OPEN = '<?xml version="1.0" encoding="UTF-8"?><ListBucketResult xmlns="http://s3.amazonaws.com/doc/2006-03-01/">'
ERROR_OPEN = '<?xml version="1.0" encoding="UTF-8"?><Error>'


def _element(name: str, value: str) -> str:
    return f"<{name}>{escape(value, {'"': '&quot;', chr(39): '&apos;'})}</{name}>"


def list_xml(page: Page, request: Request, bucket: str, url_encoded: bool = False, owner: bool = False) -> str:
    """A whole page as the answer's document; a page is bounded, so it is made on the driver."""
    text = lambda raw: quote(raw, safe="-._~") if url_encoded else raw.decode("utf-8", "replace")
    rows = as_listing(page.rows).select("row_type", "key", xml_entry(url_encoded, owner).alias("x")).orderBy("key").collect()
    head = [_element("Name", bucket), _element("Prefix", text(request.prefix))]
    head += [_element("ContinuationToken", request.token)] if request.token is not None else []
    head += [_element("StartAfter", text(request.start_after))] if request.start_after is not None else []
    head += [_element("NextContinuationToken", page.next_token)] if page.next_token is not None else []
    head += [_element("KeyCount", str(len(rows))), _element("MaxKeys", str(request.max_keys))]
    head += [_element("Delimiter", text(request.delimiter))] if request.delimiter else []
    head += [_element("EncodingType", "url")] if url_encoded else []
    head += [_element("IsTruncated", str(page.truncated).lower())]
    return LIST_OPEN + "".join(head) + "".join(r.x for k in (OBJECT, COMMON_PREFIX) for r in rows if r.row_type == k) + "</ListBucketResult>"


def error_xml(code: str, message: str, resource: str | None = None, request_id: str = "KEYLOOM") -> str:
    where = [_element("Resource", resource)] if resource is not None else []
    return ERROR_OPEN + "".join([_element("Code", code), _element("Message", message), *where, _element("RequestId", request_id)]) + "</Error>"


def xml_entry(url_encoded: bool = False, owner: bool = False) -> Column:
    """A page's entry as an XML element."""
    el = lambda name, c: F.concat(F.lit(f"<{name}>"), xml_text(c), F.lit(f"</{name}>"))
    optional = lambda name, c: F.when(c.isNotNull(), el(name, c)).otherwise("")
    key = percent_encode(F.col("key")) if url_encoded else key_text(F.col("key"))
    time = F.date_format(F.coalesce("last_modified", F.timestamp_micros(F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    who = F.concat(F.lit("<Owner>"), optional("ID", F.col("owner_id")), optional("DisplayName", F.col("owner_display_name")), F.lit("</Owner>"))
    body = F.concat(
        el("Key", key), el("LastModified", time), optional("ETag", F.concat(F.lit('"'), F.col("etag"), F.lit('"'))), optional("ChecksumAlgorithm", F.col("checksum_algorithm")), optional("ChecksumType", F.col("checksum_type")),
        el("Size", F.coalesce("size", F.lit(0)).cast("string")), optional("StorageClass", F.col("storage_class")), F.when(F.lit(owner) & F.coalesce("owner_id", "owner_display_name").isNotNull(), who).otherwise(""),
    )
    return F.when(F.col("row_type") == COMMON_PREFIX, F.concat(F.lit("<CommonPrefixes>"), el("Prefix", key), F.lit("</CommonPrefixes>"))).otherwise(F.concat(F.lit("<Contents>"), body, F.lit("</Contents>")))


def summary_json(row: DataFrame) -> DataFrame:
    """A summary row as one JSON document."""
    return row.select(F.to_json(F.struct("*")).alias("json"))


#: Phases of a run and their codes.
PHASES = {"LISTING": 0, "MERGING": 1, "WRITING": 2, "COMPLETE": 3, "SEEDING": 4, "STARTING": 5}


def summary_text(summary: dict) -> str:
    """A finished run for people: objects, bytes, time and rate, a line each."""
    n, size, seconds = int(summary.get("objects", 0)), float(summary.get("bytes", 0)), float(summary.get("seconds", 0))
    unit = 0
    while size >= 1024 and unit < 5:
        size, unit = size / 1024, unit + 1
    rows = [("objects", f"{n:,}"), ("bytes", f"{size:.1f} {('B', 'KiB', 'MiB', 'GiB', 'TiB', 'PiB')[unit]}"), ("elapsed", f"{seconds:.1f} s"), ("rate", f"{n / seconds:,.0f} objects/s" if seconds > 0 else "-")]
    return "\n".join(f"{name:<8} {value}" for name, value in rows)
