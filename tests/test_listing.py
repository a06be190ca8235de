"""Rules of the listing: filters, parsers, keys, pages, datasets, sources."""

import json

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from keyloom.functions import keys as K
from keyloom.functions import parse
from keyloom.operators import paging, sorting
from keyloom.operators.filters import Filters
from keyloom.operators.paging import Request
from keyloom.plans import dataset, formats
from keyloom.schema import as_listing, order_columns
from keyloom.sources import events, listing, live
from keyloom.streaming import ingest


def rows(spark, *keys, **more):
    return as_listing(spark.createDataFrame([(bytearray(k), i, *more.values()) for i, k in enumerate(keys)], "key binary, size bigint" + "".join(f", {n} string" for n in more)))


def keys(df):
    return [bytes(r.key) for r in df.orderBy("key").collect()]


@pytest.mark.parametrize(("text", "size"), [("0", 0), ("10", 10), ("4K", 4096), ("1.5MiB", 1572864), ("2gb", 2 << 30), (".5k", 512)])
def test_sizes(text, size):
    assert parse.parse_size(text) == size


@pytest.mark.parametrize("text", ["", "x", "1.0001K", "9999999P", "-1", "1 2"])
def test_bad_sizes(text):
    with pytest.raises(ValueError):
        parse.parse_size(text)


def test_times_and_durations():
    assert parse.parse_micros("1970-01-02") == 86_400_000_000
    assert parse.parse_micros("1970-01-01T01:00:00+01:00") == 0
    assert parse.parse_duration("1m30s") == 90_000_000
    assert parse.parse_duration("PT0.25S") == 250_000
    for bad in ("", "5", "1x", "P"):
        with pytest.raises(ValueError):
            parse.parse_duration(bad)


def test_address_query_redaction():
    assert parse.parse_address("s3://b/a%20b/c") == ("b", b"a%20b/c")
    assert parse.parse_query("prefix=a%2Fb&x=&max-keys=5") == {"prefix": b"a/b", "max-keys": b"5"}
    assert "abc" not in parse.redact("--token=abc https://u:abc@h/")


@given(st.binary(max_size=40), st.booleans())
def test_tokens(key, inclusive):
    assert parse.decode_token(parse.encode_token(key, inclusive)) == (key, inclusive)


@given(st.binary(max_size=6), st.binary(max_size=4))
def test_prefix_end(prefix, rest):
    end = parse.prefix_end(prefix)
    assert end is None or prefix + rest < end


@given(st.text(max_size=6), st.text(max_size=6))
def test_between(a, b):
    low, high = sorted((a.encode(errors="ignore"), b.encode(errors="ignore")))
    made = K.between(low, high)
    assert made is None or (low < made < high and made.decode())


def test_bytes_sort_unsigned(spark):
    df = rows(spark, b"\xff", b"", b"a", b"\x7f", b"\xef\xbf\xbd", b"\xf0\x90\x80\x80")
    assert [bytes(r.key) for r in df.orderBy(*order_columns()).collect()] == [b"", b"a", b"\x7f", b"\xef\xbf\xbd", b"\xf0\x90\x80\x80", b"\xff"]


def test_filters_on_rows_without_the_field(spark):
    df = as_listing(spark.sql("select cast('o' as binary) key, 5L size, 'STANDARD' storage_class, 'OBJECT' row_type union all select cast('n' as binary), 7L, null, 'OBJECT' union all select cast('p/' as binary), null, null, 'COMMON_PREFIX' union all select cast('m' as binary), null, null, 'DELETE_MARKER'"))
    assert keys(Filters(min_size=6).apply(df)) == [b"m", b"n", b"p/"]
    assert keys(Filters(storage_classes=("standard",)).apply(df)) == [b"m", b"o", b"p/"]
    assert keys(Filters(modified_since="2000-01-01").apply(df)) == [b"p/"]
    assert keys(Filters(modified_until="2000-01-01").apply(df)) == [b"m", b"n", b"o", b"p/"]
    with pytest.raises(ValueError):
        Filters(min_size=2, max_size=1)
    with pytest.raises(ValueError):
        Filters(include="(")


def test_invalid_utf8_keys(spark):
    df = rows(spark, b"a\xff", b"ok")
    assert keys(Filters(include="�").apply(df)) == [b"a\xff"]
    assert [r.line.split("\t")[0] for r in formats.lines(df, "tsv").collect()] == ["a�", "ok"]


def test_pages(spark):
    df = rows(spark, *(b"d/%02d" % i for i in range(7)), b"e")
    seen, token = [], None
    while True:
        page = paging.list_objects(df, Request(prefix=b"d/", token=token, max_keys=3))
        seen += keys(page.rows)
        token = page.next_token
        if not page.truncated:
            break
    assert seen == [b"d/%02d" % i for i in range(7)]
    empty = paging.list_objects(df, Request(max_keys=0))
    assert (empty.rows.count(), empty.truncated) == (0, False)
    with pytest.raises(ValueError):
        Request(start_after=b"a", token="v2:AA")
    with pytest.raises(ValueError):
        Request.parse("prefix=a")


def test_rollup(spark):
    df = rows(spark, b"a", b"b/", b"b/1", b"b/2", b"c/x/1", b"d")
    walk, token = [], None
    while True:
        page = paging.list_objects(df, Request(delimiter=b"/", token=token, max_keys=2))
        walk += [(bytes(r.key), r.row_type, r.n_keys) for r in page.rows.collect()]
        token = page.next_token
        if not page.truncated:
            break
    assert walk == [(b"a", "OBJECT", 1), (b"b/", "COMMON_PREFIX", 3), (b"c/", "COMMON_PREFIX", 1), (b"d", "OBJECT", 1)]
    inside = paging.entries(df, Request(delimiter=b"/", start_after=b"b/1"))
    assert keys(inside) == [b"c/", b"d"]  # b/ is not after b/1


def test_datasets(spark, tmp_path):
    df = rows(spark, *(b"k%03d" % i for i in range(100)))
    path = f"file://{tmp_path}/d"
    m = dataset.write_listing(df, path, bucket="b", sort=True, parts=4)
    assert m["sorted"] and sum(f["rowCount"] for f in m["files"]) == 100 and listing.eligible(m)[0]
    assert dataset.manifest_state(dataset.Folder(spark, path)) == "VALID"
    assert keys(listing.read_range(spark, path, after=b"k010", upto=b"k012")) == [b"k011", b"k012"]
    assert keys(listing.read_range(spark, path, prefix=b"k09")) == [b"k09%d" % i for i in range(10)]
    with pytest.raises(FileExistsError):
        dataset.write_listing(df, path, bucket="b", sort=True, parts=4)
    with pytest.raises(ValueError):
        dataset.write_listing(df, path, bucket="other", sort=True, mode="resume")
    assert dataset.write_listing(df, path, bucket="b", sort=True, mode="resume")["files"] == m["files"]
    dataset.Folder(spark, path).write("manifest.json", json.dumps({"version": "1"}))
    assert dataset.manifest_state(dataset.Folder(spark, path)) == "DAMAGED"
    (tmp_path / "x").mkdir()
    (tmp_path / "x/mine.txt").write_text("x")
    with pytest.raises(FileExistsError):
        dataset.write_listing(df, f"file://{tmp_path}/x", mode="overwrite")


@pytest.mark.parametrize("form", ["tsv", "jsonl"])
def test_text_datasets(spark, tmp_path, form):
    m = dataset.write_listing(rows(spark, b"a", b"b"), f"file://{tmp_path}/t", form=form, compression="gzip", parts=1)
    assert sum(f["rowCount"] for f in m["files"]) == 2


def test_older_captures(spark, tmp_path):
    spark.sql("select cast('k' as binary) key, 1L size, 'CRC32' checksum_algorithm").write.parquet(f"file://{tmp_path}/old")
    row = listing.read_listing(spark, f"file://{tmp_path}/old").first()
    assert (row.checksum_type, row.owner_display_name, row.row_type) == ("FULL_OBJECT", None, "OBJECT")


def test_duplicates_are_reported(spark, tmp_path):
    df = rows(spark, b"a", b"a", b"b")
    assert sorting.sort_listing(df, 2).count() == 3
    df.write.parquet(f"file://{tmp_path}/c")
    with pytest.raises(ValueError):
        dataset.sort_capture(spark, f"file://{tmp_path}/c", f"file://{tmp_path}/s")


def test_trace_lines(spark, tmp_path):
    (tmp_path / "t.jsonl").write_text('{"v":1,"event":"seeded","node_id":1,"lo":"a\\\\x09b"}\n\n{"event":"new_kind"}\n{"event":"claimed","node_id":1}\n{"event":"comp')
    good, skipped = events.read_trace(spark, f"file://{tmp_path}/t.jsonl")
    assert sorted(r.event for r in good.collect()) == ["claimed", "seeded"]
    assert skipped.first().n_skipped == 2
    assert bytes(good.where("lo is not null").select(events.unescape(F.col("lo")).alias("b")).first().b) == b"a\tb"


def test_live_scan_rules():
    def stuck(prefix, after, n):
        return live.PageOf([(b"a",)], True)

    with pytest.raises(live.ProtocolError):
        list(live.scan(stuck, b"", None, None))
    with pytest.raises(live.ProtocolError):
        list(live.scan(lambda *a: live.PageOf([], True), b"", None, None))
    fails = iter([1, 1, 0])

    def flaky(prefix, after, n):
        if next(fails):
            raise live.TransientError
        return live.PageOf([(b"a",), (b"c",)], False)

    assert list(live.scan(flaky, b"", None, b"b")) == [(b"a",)]


def test_stream(spark, tmp_path):
    rows(spark, b"a", b"b").write.parquet(f"file://{tmp_path}/in")
    for _ in range(2):  # a second run finds nothing new
        ingest.write_batches(ingest.read_stream(spark, f"file://{tmp_path}/in"), f"file://{tmp_path}/out", f"file://{tmp_path}/cp").awaitTermination()
    got = spark.read.parquet(f"file://{tmp_path}/out")
    assert keys(got) == [b"a", b"b"] and ingest.latest(got).count() == 2
