"""Sorted datasets, hashes, alphabets, estimators, latencies, the simulator, and what the queries don't reach."""

import hashlib
import json
import math
import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from keyloom.functions import keys as K
from keyloom.functions import parse
from keyloom.operators import alphabet, compare, estimate, paging, sorting, stats
from keyloom.operators.paging import Request
from keyloom.plans import dataset, formats, latency, simulate
from keyloom.schema import COMMON_PREFIX, OBJECT, as_listing, object_row
from keyloom.sources import events, listing
from keyloom.streaming import ingest


def rows(spark, *keys, **more):
    return as_listing(spark.createDataFrame([(bytearray(k), i, *more.values()) for i, k in enumerate(keys)], "key binary, size bigint" + "".join(f", {n} string" for n in more)))


# ---- order ---------------------------------------------------------------------


def subsample(masses, most):
    if len(masses) <= most:
        return list(range(len(masses)))
    step = sum(masses) / most
    mark, total, out = step, 0, []
    for i, m in enumerate(masses):
        total += m
        if len(out) < most and total + 1e-9 >= mark:
            out.append(i)
            mark = total + step
    return out or [len(masses) // 2]


def test_mass_subsample(spark):
    random.seed(2)
    cases = [([1, 1, 1000], 5), ([1, 1, 1000], 2), ([0, 0, 0, 0], 3), ([5], 1), ([1] * 9, 3)] + [([random.choice([0, 1, 7, 90]) for _ in range(30)], random.randint(1, 12)) for _ in range(4)]
    for masses, most in cases:
        df = spark.createDataFrame([(bytearray([i]), m) for i, m in enumerate(masses)], "key binary, mass bigint")
        assert sorted(r.key[0] for r in sorting.mass_subsample(df, most).collect()) == subsample(masses, most), (masses, most)


def test_spread_sample(spark):
    df = spark.range(23).select(F.col("id").alias("key"))
    for most in (0, 1, 2, 7, 22, 23, 40):
        got = sorted(r.key for r in sorting.spread_sample(df, ["key"], most).collect())
        want, last = [], -1
        for slot in range(min(most, 23)) if most < 23 else []:
            last = max(last + 1, math.floor(slot * 22 / (most - 1) + 0.5) if most > 1 else 0)
            want.append(last)
        assert got == (want if most < 23 else list(range(23)))


def test_neighbours_over_partitions(spark):
    """Keys that share a prefix are in several partitions and still find what lies before and behind."""
    random.seed(3)
    marks = sorted(random.sample(range(2000), 12))
    keys = sorted(set(random.sample(range(2000), 700)) - set(marks))
    df = spark.createDataFrame([(f"same/prefix/{i:05d}", None) for i in keys] + [(f"same/prefix/{i:05d}", i) for i in marks], "k string, v bigint").repartition(5)
    got = sorting.nearest(df, ["k"], "v", "before", "behind", parts=8)
    for r in got.collect():
        i = int(r.k[-5:])
        assert r.before == max((m for m in marks if m <= i), default=None)
        assert r.behind == min((m for m in marks if m >= i), default=None)
    assert sorting.ranged(df, ["k"], 8).select("_part").distinct().count() > 4


def test_ranges_of_keys_with_one_prefix(spark):
    keys = spark.range(500).select(F.format_string("data/%04d", "id").cast("binary").alias("key"))
    ranges = spark.createDataFrame([(i, f"data/{i * 100:04d}".encode() if i else None, f"data/{i * 100 + 100:04d}".encode() if i < 4 else None) for i in range(5)], "range_id int, low binary, high binary")
    got = {bytes(r.key): r.range_id for r in compare.owning_range(keys, ranges).collect()}
    assert got == {f"data/{i:04d}".encode(): (i - 1) // 100 if i else 0 for i in range(500)}


# ---- datasets ------------------------------------------------------------------


def test_sorted_dataset_is_rolled_and_stamped(spark, tmp_path):
    df = as_listing(spark.range(5000).select(F.format_string("d/%06d", F.col("id") * 7 % 5000).cast("binary").alias("key"), F.col("id").alias("size")))
    path = f"file://{tmp_path}/s"
    manifest = dataset.write_listing(df, path, sort=True, parts=2, part_bytes=30_000)
    stamps = [f["sortStamp"] for f in manifest["files"]]
    assert len(stamps) > 3 and [s["index"] for s in stamps] == list(range(1, len(stamps) + 1)) and [s.get("final", False) for s in stamps] == [False] * (len(stamps) - 1) + [True]
    assert listing.eligible(manifest) == (True, "")
    for f in manifest["files"]:
        data = (tmp_path / "s" / f["key"]).read_bytes()
        assert (hashlib.md5(data).hexdigest(), len(data)) == (f["MD5checksum"], f["size"])

    def broken(change):
        m = json.loads(json.dumps(manifest))
        change(m)
        return listing.eligible(m)[1]

    assert broken(lambda m: m["files"].pop()) == "the last file is missing"
    assert broken(lambda m: m["files"].pop(1)) == "files are missing"
    assert broken(lambda m: m["files"][0].pop("sortStamp")) == "a file without a stamp"
    assert broken(lambda m: m["files"][0]["sortStamp"].update(version=2)) == "a stamp of an unknown version"
    assert broken(lambda m: [f["sortStamp"].update(mode="versions") for f in m["files"]]) == "not a listing of objects"
    assert broken(lambda m: m["files"][1].update(minKey=m["files"][0]["minKey"])) == "files overlap"
    assert broken(lambda m: m.update(sorted=False)) == "not sorted by key"
    groups = listing.row_groups(spark, path)
    assert sum(g[2] for g in groups) == 5000 and all(g[5] for g in groups)
    for i in (0, 1234, 4999):
        key = f"d/{i:06d}".encode()
        at = listing.first_group(groups, key)
        assert groups[at][3] <= key and (at + 1 == len(groups) or groups[at + 1][3] > key)


def test_read_range_pushes_bounds_down(spark, tmp_path):
    df = as_listing(spark.range(4000).select(F.format_string("%02d/%04d", F.col("id") % 20, "id").cast("binary").alias("key")))
    path = f"file://{tmp_path}/s"
    dataset.write_listing(df, path, sort=True, parts=10)
    got = listing.read_range(spark, path, prefix=b"07/")
    plan = got._jdf.queryExecution().toString()
    assert "PushedFilters: [" in plan and "GreaterThanOrEqual(key" in plan and got.count() == 200
    assert len(got.inputFiles()) <= 2


def test_versions_are_stamped_as_such(spark, tmp_path):
    df = rows(spark, b"a", b"b", version_id="v1")
    manifest = dataset.write_listing(df, f"file://{tmp_path}/s", sort=True, parts=1)
    assert listing.eligible(manifest) == (False, "not a listing of objects")


@pytest.mark.parametrize(("path", "form", "asked", "want"), [("x.gz", "tsv", None, "gzip"), ("x.zst", "jsonl", None, "zstd"), ("x", "tsv", None, "none"), ("x", "parquet", None, "zstd"), ("x.gz", "tsv", "none", "none")])
def test_compression_by_suffix(path, form, asked, want):
    assert dataset.compression_of(path, form, asked) == want


def test_links_are_refused(spark, tmp_path):
    (tmp_path / "real").mkdir()
    os.symlink(tmp_path / "real", tmp_path / "link")
    with pytest.raises(FileExistsError):
        dataset.write_listing(rows(spark, b"a"), f"file://{tmp_path}/link")


def test_skip_scan_opens_few_files(spark, tmp_path):
    df = as_listing(spark.range(6000).select(F.format_string("%02d/%05d", F.floor(F.col("id") / 300), "id").cast("binary").alias("key")).unionByName(spark.createDataFrame([(bytearray(b"10"),), (bytearray(b"zz"),)], "key binary")))
    path = f"file://{tmp_path}/s"
    dataset.write_listing(df, path, sort=True, parts=60)
    token, seen, opened, pages = None, [], 0, 0
    while True:
        request = Request(delimiter=b"/", token=token, max_keys=4)
        page, n = paging.skip_scan(spark, path, request)
        whole = paging.list_objects(listing.read_listing(spark, path), request)
        got = [(bytes(r.key), r.row_type) for r in page.rows.orderBy("key").collect()]
        assert got == [(bytes(r.key), r.row_type) for r in whole.rows.orderBy("key").collect()]
        assert (page.truncated, page.next_token) == (whole.truncated, whole.next_token)
        seen, opened, pages, token = seen + got, opened + n, pages + 1, page.next_token
        if not page.truncated:
            break
    assert seen == sorted([(b"%02d/" % i, COMMON_PREFIX) for i in range(20)] + [(b"10", OBJECT), (b"zz", OBJECT)]) and pages == 6
    assert opened < 45  # of 60 files, six times


# ---- forms ---------------------------------------------------------------------


def test_listing_document(spark):
    df = rows(spark, b"a/1", b"b&", b"c<", etag="e")
    request = Request(delimiter=b"/", max_keys=2)
    page = paging.list_objects(df, request)
    got = formats.list_xml(page, request, "bu")
    assert got.startswith(formats.LIST_OPEN + "<Name>bu</Name><Prefix></Prefix><NextContinuationToken>") and "<KeyCount>2</KeyCount><MaxKeys>2</MaxKeys><Delimiter>/</Delimiter><IsTruncated>true</IsTruncated><Contents><Key>b&amp;</Key>" in got
    assert got.endswith("</Contents><CommonPrefixes><Prefix>a/</Prefix></CommonPrefixes></ListBucketResult>")
    coded = formats.list_xml(page, Request(prefix=b"", delimiter=b"/", start_after=b"A b", max_keys=2), "bu", url_encoded=True)
    assert "<StartAfter>A%20b</StartAfter>" in coded and "<EncodingType>url</EncodingType>" in coded and "<Key>b%26</Key>" in coded
    assert formats.error_xml("NoSuchBucket", "a < b", "/x") == '<?xml version="1.0" encoding="UTF-8"?><Error><Code>NoSuchBucket</Code><Message>a &lt; b</Message><Resource>/x</Resource><RequestId>KEYLOOM</RequestId></Error>'


def test_json_text_with_lower_hex(spark):
    texts = ["".join(map(chr, range(0x20))), "\\u000B", "\x0b\x0b\\\x0b", '"\\', "plain", "é "]
    df = as_listing(spark.createDataFrame([(bytearray(t.encode()), 1) for t in texts], "key binary, size bigint"))
    made = [r.line for r in formats.lines(df, "jsonl").collect()]
    assert sorted(json.loads(x)["key"] for x in made) == sorted(texts)
    short = {"\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f", '"': '\\"', "\\": "\\\\"}
    for t in texts:
        want = "".join(short.get(c, f"\\u{ord(c):04x}" if c < " " else c) for c in t)
        assert any(f'"key":"{want}"' in x for x in made), t


def test_summary(spark):
    assert formats.summary_text({"objects": 1500, "bytes": 3 << 20, "seconds": 2}).split("\n")[1:] == ["bytes    3.0 MiB", "elapsed  2.0 s", "rate     750 objects/s"]
    assert json.loads(formats.summary_json(spark.range(1).selectExpr("id", "'x' AS name")).first().json) == {"id": 0, "name": "x"}


def test_source_fields(spark):
    df = spark.createDataFrame([("k", None, '"abc"')], "k string, size bigint, etag string")
    r = df.select(*object_row(F.col("k"), F.col("size"), F.col("etag"))).first()
    assert (bytes(r.key), r["size"], r.etag) == (b"k", 0, "abc")


def test_identity_is_what_the_query_builds():
    assert parse.identity("a", None) == hashlib.sha256(b"a\0\0").hexdigest()


def test_trace_is_appended(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    some = spark.createDataFrame([(1, "claimed", 5), (2, "completed", None)], "v int, event string, worker_id bigint")
    events.write_trace(some, path)
    events.write_trace(some, path)
    got, skipped = events.read_trace(spark, path)
    assert got.count() == 4 and skipped.first().n_skipped == 0
    assert got.where("event = 'claimed' and worker_id = 5").count() == 2


def test_recordings(spark, tmp_path):
    doc = {"log": {"entries": [{"request": {"method": "GET", "url": f"/b?prefix={i}"}, "response": {"status": 200, "content": {"text": f"<a>{i}</a>"}}} for i in range(3)]}}
    (tmp_path / "r.har").write_text(json.dumps(doc))
    want = events.read_recording(spark, f"file://{tmp_path}/r.har").select(F.col("url").alias("request"), "body")
    replayed = spark.createDataFrame([("/b?prefix=0", "\n<a>0</a>"), ("/b?prefix=1", "<a>9</a>"), ("/b?prefix=7", "<a/>")], "request string, body string")
    got = {r.request: (r.verdict, r.differs_at) for r in compare.conformance(want, replayed).collect()}
    assert got["/b?prefix=1"] == ("DIFFERENT", 3) and got["/b?prefix=2"] == ("MISSING", None) and got["/b?prefix=7"] == ("EXTRA", None)


# ---- keys ----------------------------------------------------------------------


def test_mix64(spark):
    def plain(z):
        z = (z ^ (z >> 30)) * 0xBF58476D1CE4E5B9 & (1 << 64) - 1
        z = (z ^ (z >> 27)) * 0x94D049BB133111EB & (1 << 64) - 1
        return z ^ (z >> 31)

    random.seed(4)
    values = [0, 1, -1, (1 << 63) - 1, -(1 << 63)] + [random.randrange(-(1 << 63), 1 << 63) for _ in range(50)]
    for r in spark.createDataFrame([(v,) for v in values], "v bigint").select("v", K.mix64(F.col("v")).alias("m")).collect():
        assert r.m % (1 << 64) == plain(r.v % (1 << 64))


def test_crc32c(spark):
    assert K.crc32c_of([b"123456789", b"", b"\0" * 32, b"\xff" * 32]).tolist() == [0xE3069283, 0, 0x8A9136AA, 0x62A8AB43]
    df = spark.createDataFrame([(bytearray(b"123456789"),), (None,)], "v binary")
    assert {r.c for r in df.select(K.crc32c("v").alias("c")).collect()} == {0xE3069283, None}


@settings(max_examples=200)
@given(st.text(max_size=6), st.text(max_size=6), st.floats(0, 1))
def test_between_at_any_share(a, b, share):
    low, high = sorted((a.encode(), b.encode()))
    got = K.between(low, high, share)
    assert got is None or low < got < high


def test_between_at_the_length_limit(spark):
    low, high = b"A" + b"\0" * 1023, b"B"
    made = K.between(low, high)
    assert low < made < high and len(made) <= K.MOST_BYTES
    full = b"a" * 1023 + b"b"
    assert full < K.between(full, b"a" * 1023 + b"c") < b"a" * 1023 + b"c" if K.between(full, b"a" * 1023 + b"c") else True
    shorter = K.between(b"a" * 1024, b"b")
    assert b"a" * 1024 < shorter < b"b" and len(shorter) <= 1024
    df = spark.createDataFrame([(bytearray(b"a"), bytearray(b"z"), s) for s in (-1.0, 0.0, 0.25, 0.75, 2.0)] + [(bytearray(b"z"), bytearray(b"a"), 0.5), (None, bytearray(b"a"), 0.5)], "a binary, b binary, s double")
    got = [r.m and bytes(r.m) for r in df.select(K.interpolate("a", "b", "s").alias("m")).collect()]
    assert got[5:] == [None, None] and got[:5] == sorted(got[:5]) and all(b"a" < m < b"z" for m in got[:5])


def test_alphabet(spark):
    df = rows(spark, b"p/a1", b"p/c2", b"p/e3", "p/é4".encode(), b"p/", b"q/zz")
    found = {r.place: (r.clean, r.seen) for r in alphabet.alphabet(df, "p/", 3).collect()}
    assert found[0] == (False, []) and found[1] == (True, ["1", "2", "3", "4"]) and set(found) == {0, 1}
    pick = spark.range(1).select(*[alphabet.choose(F.array(*map(F.lit, "adgz")), low, high, s).alias(f"c{i}") for i, (low, high, s) in enumerate([(F.lit("a"), F.lit("z"), 0.5), (F.lit(None), F.lit(None), 1.0), (F.lit("a"), F.lit("d"), 0.5), (F.lit("b"), F.lit(None), 0.0)])]).first()
    assert tuple(pick) == ("g", "z", None, "d")


def frac(key, skip, n=8):
    return sum((key[skip + i] if skip + i < len(key) else 0) / 256 ** (i + 1) for i in range(n))


def shared(a, b):
    return next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def test_estimators(spark):
    random.seed(6)
    cases = [(b"", b"", b"z", 0), (b"a/", b"a/x/m", b"b", 1000), (b"a", b"a", b"c", 7), (b"a", b"c", b"c", 50), (b"a", b"b", None, 9)]
    cases += [(b"k/" + bytes(random.choices(b"abc", k=3)), b"k/" + bytes(random.choices(b"bcd", k=4)), b"k/" + bytes(random.choices(b"xyz", k=2)), random.randrange(5000)) for _ in range(20)]
    df = spark.createDataFrame([(i, bytearray(a), bytearray(c), None if h is None else bytearray(h), k) for i, (a, c, h, k) in enumerate(cases)], "i int, low binary, cursor binary, high binary, n bigint")
    at = ("low", "cursor", "high", "n")
    got = df.select("i", estimate.window_remaining(*map(F.col, at)).alias("w"), estimate.anchored_remaining(*map(F.col, at)).alias("a"), estimate.rate_remaining(*map(F.col, at)).alias("r"), estimate.ignores_keys(*map(F.col, at[:3]), anchored=True).alias("g"), estimate.advance_seen(F.col("low"), F.col("low"), F.col("cursor"), F.col("high"), anchored=True).alias("s"))
    for r in got.collect():
        low, cur, high, n = cases[r.i]
        if high is None:
            assert r.w == r.a == r.r == math.inf
            continue
        d, d0 = shared(low, cur), shared(low, high)
        used = frac(cur, d) - frac(low, d)
        left = max(0.0, (frac(high, d) if d <= d0 else 1.0) - frac(cur, d))
        if cur <= low:
            assert r.a == 1.0 and r.r == max(n, 1000) and r.g
        elif cur >= high:
            assert r.a == 0.0 and r.r == 0.0
        else:
            assert math.isclose(r.a, n / used * left if used > 0 else left, rel_tol=1e-9, abs_tol=1e-12)
            assert math.isclose(r.r, max(n, 1000) * min(16.0, max(0.0, left / used if used > 0 else 1.0)), rel_tol=1e-9)
            assert r.g == (used <= 0) and r.s
        whole = frac(high, d0, 12) - frac(low, d0, 12)
        share = min(1.0, max(0.0, (frac(cur, d0, 12) - frac(low, d0, 12)) / whole)) if whole > 0 else 0.0
        assert math.isclose(r.w, n / share * (1 - share) if share > 0 else 1 - share, rel_tol=1e-9, abs_tol=1e-12)


def test_seed_shapes(spark):
    assert [stats.seed_shape(*a) for a in ((0, 0, False), (0, 9, False), (70, 0, True), (70, 0, False, 0.6), (70, 0, False), (3, 0, False))] == ["empty", "flat_wide", "fanout_tiled", "tiny_leaf_explosion", "wide", "narrow"]
    found = stats.all_hold(spark.range(3), {"low": F.col("id") >= 0, "high": F.col("id") < 2}).first()
    assert (found.low, found.high, found.ok) == (True, False, False)
    assert stats.all_hold(spark.range(0), {"x": F.lit(False)}).first().ok


def test_other_options_are_refused(spark, tmp_path):
    dataset.write_listing(rows(spark, b"a"), f"file://{tmp_path}/s", bucket="one")
    with pytest.raises(ValueError, match="other options"):
        dataset.write_listing(rows(spark, b"a"), f"file://{tmp_path}/s", bucket="two", mode="resume")


def test_progress_of_a_stream(spark, tmp_path):
    import datetime as dt

    at = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    spark.createDataFrame([(at + dt.timedelta(seconds=20 * i), 10) for i in range(9)] + [(at + dt.timedelta(hours=2), 1)], "ts timestamp, keys bigint").coalesce(1).write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema("ts timestamp, keys bigint").parquet(f"file://{tmp_path}/in")
    q = ingest.progress(stream).writeStream.format("memory").queryName("progress").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.n_pages, r.n_keys) for r in spark.table("progress").collect()) == [(1, 1), (3, 30), (3, 30), (3, 30)]


# ---- latency and simulation ----------------------------------------------------


def test_latency_texts():
    assert [parse.parse_latency(t) for t in ("6865ms", "6.9s", "250", "0")] == [6_865_000, 6_900_000, 250_000, 0]
    for bad in ("", "-1", "5m", "1.5", "x"):
        with pytest.raises(ValueError):
            parse.parse_latency(bad)
    assert latency.parse_profile("measured")["structure_probe"] == (223_000, 55_000)
    for bad in ("page=5", "pivot_probe=5+1ms/cp", "structure_probe=5+1ms"):
        with pytest.raises(ValueError):
            latency.parse_profile(bad)


def test_latencies(spark):
    df = spark.range(2000).select(F.xxhash64("id").alias("h"), (F.col("id") % 5).alias("n"))
    profile = latency.parse_profile("worker_page=100ms,structure_probe=200ms+10ms/cp")
    got = df.select(latency.shape_latency(profile, F.lit(None), F.lit(1000), F.lit(None), F.col("h"), 0.25).alias("w"), latency.shape_latency(profile, F.lit("/"), F.lit(1000), F.col("n"), F.col("h")).alias("s"), latency.fitted(F.col("h"), 50, 150).alias("f"), latency.occupancy_scaled(F.lit(100), F.col("n"), 2).alias("o"), "n").collect()
    w = [r.w for r in got]
    assert min(w) >= 75_000 and max(w) < 125_000 and max(w) - min(w) > 45_000 and abs(sum(w) / len(w) - 100_000) < 1500
    assert all(r.s == 200_000 + 10_000 * r.n and r.o == 100 * max(1, r.n / 2) for r in got)
    assert min(r.f for r in got) >= 50 and abs(sum(r.f for r in got) / len(got) - 150) < 10


def plain_run(sizes, workers, page_time, page, split):
    """The simulator again, without heaps: the earliest page ends first, of equal ones the first begun."""
    waiting = sorted(n for n in sizes if n > 0)
    running, now, pages, splits, began, busy = [], 0.0, 0, 0, 0, 0.0
    while waiting or running:
        while len(running) < workers:
            if not waiting:
                big = max(running, key=lambda r: (r["left"], -r["no"]), default=None)
                if not split or big is None or big["left"] <= 2 * page:
                    break
                half = big["left"] // 2
                big["left"] -= half
                waiting, splits = [half], splits + 1
            n = waiting.pop()
            running.append({"end": now + page_time, "no": began, "left": n - min(page, n)})
            began, pages = began + 1, pages + 1
        done = min(running, key=lambda r: (r["end"], r["no"]))
        running.remove(done)
        now, busy = done["end"], busy + page_time
        if done["left"] > 0:
            running.append({"end": now + page_time, "no": done["no"], "left": done["left"] - min(page, done["left"])})
            pages += 1
    return pages, now, busy / (now * workers) if now else 0.0, splits


def test_simulator(spark):
    random.seed(7)
    sizes = [random.choice([0, 3, 900, 5000, 20_000]) for _ in range(15)]
    ranges = spark.createDataFrame([(n,) for n in sizes], "keys bigint")
    cases = [(f"{w}{x}", w, 0.2, 1000, x) for w in (1, 3, 8, 40) for x in (False, True)]
    scenarios = spark.createDataFrame(cases, "scenario string, workers int, latency double, page int, split boolean")
    got = {r.scenario: (r.pages, r.seconds, r.busy_share, r.splits) for r in simulate.sweep(ranges, scenarios).collect()}
    for name, workers, took, page, split in cases:
        assert got[name] == pytest.approx(plain_run(sizes, workers, took, page, split)), name
    more = scenarios.withColumns({"floor": F.lit(0.05), "seed": F.lit(9), "knee": F.lit(0)})
    a, b = ({r.scenario: r.seconds for r in simulate.sweep(ranges, more).collect()} for _ in range(2))
    assert a == b and all(a[k] != got[k][1] for k in a)
    slow = {r.scenario: r.seconds for r in simulate.sweep(ranges, scenarios.withColumns({"knee": F.lit(2)})).collect()}
    assert slow["8False"] > got["8False"][1] and slow["1False"] == pytest.approx(got["1False"][1])
