"""Each operator on odd rows and empty tables, and against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from keyloom.llm import bwt, chat, components, decontaminate, imatch, jaccard, language, lm, mixing, repeats, shingles, tokens, toxicity

DATA = "/root/testdata/sf0.001"


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]


# ---- 1 -------------------------------------------------------------------------


def test_mixing_odd_rows(odd, none, labels):
    rows = mixing.plan(mixing.sized(odd, mixing.quality_weights(labels))).collect()
    assert len(rows) == odd.count()
    assert all(0 <= r.taken <= 3 * r.size for r in rows)
    by = defaultdict(list)
    for r in rows:
        by[r.source].append(r)
    for rs in by.values():
        assert abs(sum(r.taken for r in rs) - rs[0].target) <= max(r.size for r in rs)
    total = sum(r.size for r in rows)
    assert math.isclose(sum(rs[0].target for rs in by.values()), total)
    assert sum(r.taken for r in rows) == sum(len(words(r.text)) for r in mixing.mix(odd, mixing.quality_weights(labels)).collect())
    assert mixing.mix(odd).columns == odd.columns
    assert mixing.plan(mixing.sized(none)).count() == 0 and mixing.mix(none).count() == 0


def test_water_fill(spark):
    sizes = spark.createDataFrame([("a", 1), ("b", 10), ("c", 1000), (None, 5), ("zero", 0)], "source string, source_size bigint")
    got = {r.source: r.target for r in mixing.water_fill(sizes).collect()}
    want, weight, cap = {}, {"a": 1, "b": 2, "c": 3, "zero": 1, None: 2}, {"a": 3, "b": 30, "c": 3000, "zero": 0, None: 15}
    left, open_ = 1016.0, set(weight)
    while open_:  # shares, cut at the cap, the excess shared again
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > cap[s]}
        if not full:
            want |= {s: level * weight[s] for s in open_}
            break
        want |= {s: cap[s] for s in full}
        left -= sum(cap[s] for s in full)
        open_ -= full
    assert got == pytest.approx(want)


def test_mixing_prefers_quality(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 4 == 0, "a").otherwise("b").alias("source"), F.lit(10).cast("bigint").alias("size"), F.lit(0).cast("bigint").alias("text_hash"), F.when(F.col("id") % 8 < 4, 1.5).otherwise(0.5).alias("weight"))
    # b has three quarters of the words but 2/3 of the target: a fraction of it is taken
    got = {r.weight: r.n for r in mixing.plan(docs).where("source = 'b' and taken > 0").withColumn("weight", F.when(F.col("doc_id") % 8 < 4, 1.5).otherwise(0.5)).groupBy("weight").agg(F.count("*").alias("n")).collect()}
    assert got[1.5] > got[0.5]


def test_mixing_takes_weights_as_they_are(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("b").alias("source"), F.lit(10).cast("bigint").alias("size"), F.lit(0).cast("bigint").alias("text_hash"), F.when(F.col("id") % 2 == 0, 64.0).otherwise(1 / 64).alias("weight"))
    docs = docs.unionByName(spark.range(300).select((-F.col("id") - 1).alias("doc_id"), F.lit("a").alias("source"), F.lit(100).cast("bigint").alias("size"), F.lit(0).cast("bigint").alias("text_hash"), F.lit(0.0).alias("weight")))
    rows = mixing.plan(docs).collect()
    b = [r for r in rows if r.source == "b"]
    part = [r for r in b if r.taken > r.size * r.epochs]
    assert b[0].target % b[0].source_size > 0 and len(part) == 1000
    assert all(r.doc_id % 2 == 0 for r in part)  # the light half comes after all heavy ones


def test_mixing_keeps_columns_of_any_name(spark, odd):
    docs = odd.withColumns({c: F.lit(c) for c in ("_copy", "_hash", "_rows", "_row", "_times", "_doc_id", "_source", "_text_hash", "row", "d", "s", "h", "k", "rows")})
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() > 0
    assert all(r[c] == c for r in mixed.collect() for c in ("_copy", "_hash", "_doc_id", "h", "rows"))


# ---- 2 -------------------------------------------------------------------------


def test_fingerprints(odd, none):
    docs = odd.select("doc_id", "text")
    lexicon = imatch.lexicon(docs, (0, 1))
    made = imatch.Fingerprints(lexicon)
    rows = imatch.edited_likeness(odd, lexicon).collect()
    assert len(rows) == odd.count()
    by = {r.doc_id: r for r in rows}
    assert by[1].fingerprint == by[2].fingerprint and by[3].fingerprint == by[4].fingerprint == by[5].fingerprint
    order = sorted({r.doc_id for r in rows if r.doc_id is not None}, reverse=True)
    texts = {r.doc_id: r.text or "" for r in odd.collect()}
    for i, name in enumerate(order[:-1]):
        if name == 7 or order[i + 1] == 7:
            continue
        t, z = texts[name], texts[order[i + 1]]
        edited = t[: len(t) - len(t) // 2] + z[: len(t) // 2]
        assert by[name].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert by[name].near_edited == (1.0 if t == edited else made.alike(made.of(t), made.of(edited)))
    one = imatch.edited_likeness(odd.where("doc_id = 9"), lexicon).first()
    assert one.near_next == 1.0  # the next one is itself
    assert imatch.edited_likeness(none, lexicon).count() == 0 and imatch.lexicon(none.select("doc_id", "text")) == []


def test_fingerprints_like_plain_sets(spark):
    """Likeness against sorted term lists by subset, compared as they are."""
    random.seed(12)
    rows = [(i, " ".join(f"w{random.randrange(60) ** 2 // 60}" for _ in range(random.choice([0, 1, 3, 40, 400])))) for i in range(40)]
    lexicon = [f"w{i}".encode() for i in range(5, 40)]

    def plain(text):
        out = defaultdict(list)
        for w in sorted(set(text.encode().split()) & set(lexicon), key=imatch.Fingerprints.hash):
            out[(imatch.Fingerprints.hash(w) >> 40) % imatch.SUBSETS].append(w)
        return out

    def alike(a, b):
        x, y = plain(a), plain(b)
        return 1.0 if a == b else sum(x[k] == y[k] for k in set(x) & set(y)) / len(set(x) | set(y)) if set(x) | set(y) else 0.0

    got = {r.doc_id: r for r in imatch.edited_likeness(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), lexicon).collect()}
    for i, t in rows:
        z = rows[(i - 1) % len(rows)][1]
        edited = t[: len(t) - len(t) // 2] + z[: len(t) // 2]
        assert math.isclose(got[i].near_next, alike(t, z)) and math.isclose(got[i].near_edited, alike(t, edited))
        assert all((a.fingerprint == got[i].fingerprint) == (plain(rows[a.doc_id][1]) == plain(t)) for a in got.values())


def test_lexicon_band(spark):
    docs = spark.createDataFrame([(i, "all " + ("half " if i % 2 else "") + f"own{i}") for i in range(100)], "doc_id bigint, text string")
    assert imatch.lexicon(docs, (0.1, 0.9)) == [b"half"]


# ---- 3 -------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=700), st.integers(1, 2**32))
def test_blocks_round_trip(ids, below):
    v = np.array([i % below for i in ids], np.uint32)
    got, names, counts = tokens.decode_shard(tokens.encode_shard(v, [None, 5], [len(v), 0]))
    assert (got == v).all() and names == [None, 5] and counts.tolist() == [len(v), 0]


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet="aB' .,<|>éİΣß\t\n\x1c\x85日1", max_size=40))
def test_encoder_is_the_library(text):
    e = tokens.encoder(tokens.tokenizer_path())
    assert np.frombuffer(e.encode(text), "<u4").tolist() == e.whole.encode(text, add_special_tokens=False).ids


def test_other_tokenizer_files_go_through_the_library(tmp_path):
    import json

    file = json.load(open(tokens.tokenizer_path(), encoding="utf-8"))
    assert tokens._stands_for(file)
    file["normalizer"]["normalizers"] = file["normalizer"]["normalizers"][:2]  # keeps upper case
    assert not tokens._stands_for(file)
    (tmp_path / "other.json").write_text(json.dumps(file), encoding="utf-8")
    e = tokens.Encoder(str(tmp_path / "other.json"))
    for text in ("Upper and lower", "", "A\u00a0B 12"):
        assert np.frombuffer(e.encode(text), "<u4").tolist() == e.whole.encode(text, add_special_tokens=False).ids


def test_token_files(spark, odd, none, tmp_path):
    e = tokens.encoder(tokens.tokenizer_path())
    at = 0
    for r, want in zip(tokens.tokens_of(odd).orderBy("start").collect(), sorted(odd.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0)), strict=True):
        ids = e.whole.encode(want.text or "", add_special_tokens=False).ids + [1]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (want.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert tokens.tokens_of(none).count() == 0
    path = f"file://{tmp_path}/s"
    tokens.write_shards(odd, path, tokens.tokenizer_path(), shard_ids=50)
    (tmp_path / "out").mkdir()
    tokens.export_shards(spark, path, str(tmp_path / "out"))
    whole = b"".join(tokens.decode_shard(p.read_bytes())[0].tobytes() for p in sorted((tmp_path / "out").iterdir()))
    assert len(whole) == 4 * at


# ---- 4 -------------------------------------------------------------------------


def test_language(spark, odd, none):
    trees = language.learn({"x": [b"abababab" * 20], "y": [b"xyzxyz" * 20]})
    rows = {r.doc_id: r for r in language.predict(odd, trees).collect()}
    assert all(rows[i].lang_pred == "und" and rows[i].score == 0 for i in (3, 4, 5))
    assert rows[1].lang_pred in ("x", "y") and 0 <= rows[1].score <= 1
    assert {r.lang_pred for r in language.predict(odd, None).collect()} == {"und"}
    assert language.predict(none, trees).count() == 0 and language.fit(none, language.held_out(F.col("doc_id"))) is None


def test_rows_without_id_teach_nothing(spark):
    docs = spark.createDataFrame([(None, "bonjour le monde " * 30, "fr"), (3, "hello old world " * 30, "en"), (3, "hello new world " * 30, "en")], "doc_id bigint, text string, lang string")
    assert language.fit(docs, F.lit(False)).languages == ["en"]
    assert language.fit(docs.where("doc_id is null"), F.lit(False)) is None


def test_code_lengths_like_dictionaries():
    """Costs against a plain PPM: contexts in dictionaries, escapes one by one."""
    random.seed(9)
    texts = {k: [bytes(random.choice(a) for _ in range(random.randint(0, 300))) for _ in range(6)] for k, a in (("x", b"abca"), ("y", b"acbd "))}
    trees = language.learn(texts)
    seen = defaultdict(Counter)  # (language, context) -> next bytes
    total = Counter()
    for lang, ts in texts.items():
        for t in ts:
            for i in range(len(t)):
                for k in range(language.DEPTH + 1):
                    context = (b"\0" * language.DEPTH + t)[i + language.DEPTH - k : i + language.DEPTH]
                    seen[lang, context][t[i]] += 1
                    total[lang, context] += 1
    # the shared set: contexts seen often enough over all languages
    often = Counter()
    for (_, context), n in total.items():
        often[context] += n

    def known(context):
        return all(often[context[j:]] >= language.LEAST_COUNT for j in range(len(context)))

    def cost(lang, context, byte):
        c = seen.get((lang, context), Counter())
        n, q = sum(c.values()), len(c)
        if c[byte]:
            return -math.log2(c[byte] / (n + q))
        shorter = cost(lang, context[1:], byte) if context else 8.0
        return shorter - math.log2(q / (n + q)) if n else shorter

    for t in (b"abcadbca", b"zz a", texts["y"][0]):
        for j, lang in enumerate(trees.languages):
            want = 0.0
            for i in range(len(t)):
                context = (b"\0" * language.DEPTH + t)[i : i + language.DEPTH]
                while not known(context):
                    context = context[1:]
                want += cost(lang, context, t[i])
            assert math.isclose(trees.lengths([t])[0, j], want, rel_tol=1e-5), (t, lang)


def test_code_lengths_are_exact():
    trees = language.learn({"x": [b"abcabcabdabc" * 5]})
    by_steps = trees.lengths([b"abcabd"])[0, 0]
    some = 0.0
    for i, _ in enumerate(b"abcabd"):  # a text's length is the sum over its bytes, whatever is scored together
        some += trees._some([b"abcabd"[i : i + 1]], b"abcabd"[max(0, i - language.DEPTH) : i])[0, 0]
    assert math.isclose(by_steps, some, rel_tol=1e-6)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(DATA + "/documents.parquet")
    found = language.op4_language(spark, DATA).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in found) >= 0.9 * len(found)


# ---- 5 -------------------------------------------------------------------------


def removed(rows):
    seen, out = set(), {}
    for name, t in sorted(rows):
        gone = bytearray(len(t))
        for p in range(len(t) - repeats.LENGTH + 1):
            w = t[p : p + repeats.LENGTH]
            if w in seen:
                gone[p : p + repeats.LENGTH] = b"\1" * repeats.LENGTH
            seen.add(w)
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        out[name] = (len(t), sum(gone), sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1])), hashlib.sha256(kept).hexdigest())
    return out


def passages(n=40):
    random.seed(4)
    shared = [" ".join(random.choice("qwertyuiop") * random.randint(1, 7) for _ in range(60)) for _ in range(3)]
    rows = []
    for i in range(n):
        own = " ".join(str(random.random()) for _ in range(random.randint(0, 30)))
        rows.append((i, own + (random.choice(shared)[random.randint(0, 30) :] if i % 2 else "") + own[: 20 * (i % 7)] + ("ab" * 150 if i % 11 == 0 else "")))
    return rows + [(n, rows[1][1]), (n + 1, rows[1][1]), (n + 2, ""), (n + 3, "x" * 99), (n + 4, "x" * 400)]


@pytest.mark.parametrize("most", [repeats.MOST, 300])
def test_repeats(spark, monkeypatch, most):
    rows = passages()
    monkeypatch.setattr(repeats, "MOST", most)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.without_repeats(df).collect()}
    assert got == removed([(i, t.encode()) for i, t in rows])


def test_repeats_copies_in_descending_order(spark):
    random.seed(6)
    text = " ".join(str(random.random()) for _ in range(40))
    rows = [(5, text), (3, text), (4, "own " + text[200:500] + " end"), (7, text[100:400])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)  # one task reads 5 before 3
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.without_repeats(df).collect()}
    assert got == removed([(i, t.encode()) for i, t in rows])


@pytest.mark.parametrize("tasks", [1, 7])
def test_repeats_rows_of_one_id(spark, tasks):
    random.seed(7)
    a, b, c = (" ".join(str(random.random()) for _ in range(30)) for _ in range(3))
    rows = [(1, a), (1, a), (2, b), (2, b), (3, "own " + b[50:300]), (4, a), (4, c), (4, c), (5, c), (5, b), (6, "short"), (6, "short"), (7, c[:90] + a[:200]), (7, c[:90] + a[:200])]
    names = sorted(set(rows), key=lambda r: (r[0], hashlib.md5(r[1].encode()).digest()))
    plain = removed([(i, t.encode()) for i, (_, t) in enumerate(names)])
    want = sorted((r[0], *plain[names.index(r)]) for r in rows)
    df = spark.createDataFrame(spark.sparkContext.parallelize(rows, len(rows)), "doc_id bigint, text string").coalesce(tasks)
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.without_repeats(df).collect()) == want


def test_repeats_copy_and_own_text_under_one_id(spark):
    random.seed(9)
    a, b = (" ".join(str(random.random()) for _ in range(12)) for _ in range(2))
    df = spark.createDataFrame([(3, a), (5, a), (5, b)], "doc_id bigint, text string")
    assert sorted((r.doc_id, r.n_bytes, r.n_removed) for r in repeats.without_repeats(df).collect()) == sorted([(3, len(a), 0), (5, len(a), len(a)), (5, len(b), 0)])


@pytest.mark.parametrize("piece", [150, 333])
def test_repeats_in_pieces_of_long_texts(spark, monkeypatch, piece):
    rows = passages(20)
    rows.append((99, " ".join(t for _, t in rows)))
    found = repeats.anchors([t.encode() for _, t in rows])
    monkeypatch.setattr(repeats, "PIECE", piece)
    cut = repeats.anchors([t.encode() for _, t in rows])
    windows = lambda got: sorted((d, s, h) for d, low, high, h in zip(got["doc"].tolist(), got["low"].tolist(), got["high"].tolist(), got["hash"].tolist(), strict=True) for s in range(low, high + 1))
    assert windows(cut) == windows(found)


def test_repeats_odd_rows(odd, none):
    rows = repeats.without_repeats(odd).collect()
    assert len(rows) == odd.count()
    assert {r.doc_id: r.n_removed == r.n_bytes for r in rows}[2]
    assert repeats.without_repeats(none).count() == 0


def test_merged_transforms():
    random.seed(3)
    for _ in range(60):
        base = [bytes(random.choice(b"abc") for _ in range(random.randint(0, 40))) for _ in range(random.randint(1, 9))]
        depth = random.choice([1, 3, 10])
        at, number = bwt.intervals(base, depth, random.choice([10, 1000]))
        got, want, p = defaultdict(set), defaultdict(set), 0
        for a, k in zip(at.tolist(), number.tolist(), strict=True):
            got[k].add(a)
        for s in base:
            for k in range(len(s) - depth + 1):
                want[s[k : k + depth]].add(p + k)
            p += len(s) + 1
        assert {frozenset(v) for v in got.values() if len(v) > 1} == {frozenset(v) for v in want.values() if len(v) > 1}


# ---- 6 -------------------------------------------------------------------------


def test_decontamination(spark, odd, none):
    item = "seven bright lanterns drift over quiet hills before the morning while slow barges carry grain along old canals toward harbour"
    near = item.replace("harbour", "port")
    long_item = " ".join(f"w{i}" for i in range(450))
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "tiny item"), (5, long_item), (None, "some words that nobody else would ever write down here")], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, "before " + item.upper() + " after"), (2, "x " + near + " y"), (3, " ".join(reversed(item.split()))), (4, None), (5, "a Tiny\titem here"), (6, "a " + " ".join(long_item.split()[190:430])), (7, item[:40]), (1, "before " + item.upper() + " after")], "doc_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()}
    assert got == {(1, 1), (2, 1), (5, 4), (6, 5)}
    assert sorted(r.doc_id for r in decontaminate.clean(docs, bench).collect()) == [3, 4, 7]
    assert decontaminate.clean(odd, bench).columns == odd.columns and decontaminate.clean(odd, bench).count() == odd.count()
    assert decontaminate.contaminated(none, bench).count() == 0 and decontaminate.clean(odd, bench.where("false")).count() == odd.count()
    # pieces are of equal size: the last words of an item of 205 aren't an item
    tail = " ".join(f"v{i}" for i in range(205))
    some = spark.createDataFrame([(1, " ".join(f"x{i}" for i in range(50)) + " " + " ".join(tail.split()[-5:])), (2, " ".join(tail.split()[3:140]))], "doc_id bigint, text string")
    assert {r.doc_id for r in decontaminate.contaminated(some, spark.createDataFrame([(1, tail)], "item_id bigint, text string")).collect()} == {2}
    # beyond the bound on what is sent, the same by a shuffle
    most, decontaminate.MOST_SENT = decontaminate.MOST_SENT, 0
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()} == got
    decontaminate.MOST_SENT = most


def test_radius_keeps_windows_of_the_least_similarity(spark):
    """Windows with words replaced until just above 0.75: the share that the Hamming radius lets through."""
    random.seed(5)
    rows = []
    for n in (15, 30, 59, 120, 200):
        for _ in range(60):
            w = [f"w{random.randrange(10**6)}" for _ in range(n)]
            e = list(w)
            k = 1
            while True:  # a run at the end, the edit that costs fewest shingles
                other = [*w[:-k], *[f"e{random.randrange(10**6)}" for _ in range(k)]]
                a, b = ({tuple(x[i : i + 5]) for i in range(n - 4)} for x in (w, other))
                if len(a & b) < 0.75 * len(a | b):
                    break
                e, k = other, k + 1
            rows.append((n, w, e))
    df = spark.createDataFrame(rows, "n int, w array<string>, e array<string>")
    near = F.bit_count(decontaminate.simhash(F.col("w")).bitwiseXOR(decontaminate.simhash(F.col("e")))) <= decontaminate.RADIUS
    got = {r.n: r.share for r in df.groupBy("n").agg(F.avg(near.cast("int")).alias("share")).collect()}
    assert min(got.values()) >= 0.85 and sum(got.values()) / len(got) >= 0.9, got


# ---- 7 -------------------------------------------------------------------------


def classes(rows):
    sets = {}
    for name, t in rows:
        w = words(t)
        sets[name] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


def near_copies():
    random.seed(8)
    rows = []
    for g in range(12):
        base = [f"w{random.randrange(400)}" for _ in range(random.choice([4, 6, 30, 120]))]
        for _ in range(random.randint(1, 9)):
            w = list(base)
            for _ in range(random.randint(0, 3)):
                w[random.randrange(len(w))] = f"e{random.randrange(10**6)}"
            rows.append((len(rows), " ".join(w)))
    return rows + [(len(rows) + i, t) for i, t in enumerate([None, "", "w1", "W1", "a b c d e", "a  b\tc d E", "a b c d e f"])]


@pytest.mark.parametrize("region", [jaccard.REGION, 3])
def test_jaccard_join(spark, monkeypatch, region):
    rows = near_copies()
    monkeypatch.setattr(jaccard, "REGION", region)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.components_of(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()}
    assert got == classes(rows)


def test_jaccard_long_texts_and_hot_shingles(spark, monkeypatch):
    random.seed(10)
    long = [f"w{random.randrange(5000)}" for _ in range(20_000)]
    common = " ".join(f"c{i}" for i in range(8))
    rows = [(i, " ".join([*long[: 20_000 - 7 * i], f"own{i}"])) for i in range(3)] + [(3, " ".join(reversed(long)))]
    rows += [(100 + i, common + " " + " ".join(f"u{i}x{j}" for j in range(random.choice([0, 1, 2, 3])))) for i in range(60)]  # short texts that are mostly one passage
    base = [f"b{i}" for i in range(80)]
    rows += [(200 + i, " ".join([*base[: 70 + i % 11], f"z{i}"])) for i in range(50)]  # one large group of near copies
    monkeypatch.setattr(jaccard, "REGION", 12)
    monkeypatch.setattr(jaccard, "LEAF", 2)
    monkeypatch.setattr(jaccard, "SAMPLED", 1)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.components_of(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)).collect()}
    assert got == classes(rows)


def test_jaccard_texts_of_one_id(spark):
    a, b, c = ("  ".join(f"{k}{i}" for i in range(20)) for k in "abc")
    rows = [(5, a), (5, b), (3, a), (4, b + " more"), (9, b), (7, c), (7, ""), (8, c + " x"), (2, "")]
    got = {r.doc_id: r.component_id for r in jaccard.components_of(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {5: 3, 3: 3, 4: 3, 9: 3, 7: 7, 8: 7, 2: 2}


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(0, 12), max_size=9), max_size=40), st.integers(1, 4), st.integers(0, 3))
def test_cells_lose_no_link(sets_, pivots, leaf):
    was = jaccard.PIVOTS, jaccard.LEAF
    jaccard.PIVOTS, jaccard.LEAF = pivots, leaf
    try:
        kept = [sorted(set(x)) for x in sets_ if x]
        group = jaccard.Group(np.array([v for x in kept for v in x], np.uint64), np.array([len(x) for x in kept], np.int64))
        root = group.join()
    finally:
        jaccard.PIVOTS, jaccard.LEAF = was
    want = list(range(len(kept)))
    for _ in want:
        for i, a in enumerate(kept):
            for j, b in enumerate(kept):
                both = len(set(a) & set(b))
                if 100 * both >= 75 * (len(a) + len(b) - both):
                    want[i] = want[j] = min(want[i], want[j])
    assert [[i for i in range(len(kept)) if root[i] == root[j]] for j in range(len(kept))] == [[i for i in range(len(kept)) if want[i] == want[j]] for j in range(len(kept))]


def test_jaccard_odd_rows(odd, none):
    rows = {r.doc_id: r.component_id for r in jaccard.components_of(odd).collect()}
    assert rows[2] == 1 and rows[8] == 1 and rows[3] == 3 and rows[None] is None and rows[7] == 7
    kept = [r.doc_id for r in jaccard.distinct_documents(odd).collect()]
    assert kept.count(7) == 2 and 2 not in kept and None in kept and 3 in kept
    assert jaccard.components_of(none).count() == 0 and jaccard.distinct_documents(none).columns == odd.columns


def test_components(spark):
    random.seed(1)
    for links in ([], [(i, i + 1) for i in range(40)], [(random.randrange(60), random.randrange(60)) for _ in range(40)], [(0, i) for i in range(1, 50)]):
        got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
        root = {x: x for e in links for x in e}
        for _ in root:
            for a, b in links:
                root[a] = root[b] = min(root[a], root[b])
        assert got == {k: v for k, v in root.items() if any(k in e and e[0] != e[1] for e in links)}


def test_shingles_are_sets():
    texts = [b"a b c d e f", b"A b\tc d e f ", b"", b"a b", b"a b a b a b a b a b", b"x" * 10]
    flat, n = shingles.sets(texts)
    assert n.tolist() == [2, 2, 0, 1, 2, 1]
    assert (flat[:2] == flat[2:4]).all()


# ---- 8 -------------------------------------------------------------------------


def test_toxicity(spark, odd, none, labels):
    rows = [(i, f"plain words about day {i % 9} and river {i % 7}" + (" awful nasty" if i % 3 == 0 else "")) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    marks = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(200)], "doc_id bigint, toxic bigint")
    model = toxicity.fit(docs, marks)
    found = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert all(found[i]._toxic == (i % 3 == 0) for i in range(300)) and all(0 <= r._severity <= 3 for r in found.values())
    assert list(model.theta) == sorted(model.theta)
    got = toxicity.score(odd, model)
    assert got.count() == odd.count() and not any(r._toxic for r in got.where("text is null or trim(text) = ''").collect())
    assert toxicity.score(none, model).count() == 0
    for d, m in ((none, marks), (docs, marks.where("toxic = 0")), (docs, marks.where("false"))):
        assert not any(r._toxic for r in toxicity.score(docs, toxicity.fit(d, m)).collect())


def test_toxicity_words_are_the_same_for_fit_and_score(spark):
    rows = [(i, f"plain\u00a0words\u00a0about day {i % 9}" + (" awful\u00a0nasty" if i % 3 == 0 else "")) for i in range(300)]
    docs = spark.createDataFrame([*rows, *rows[:30], (3, "another text of an id"), (400, "very long " * 40_000 + "awful\u00a0nasty")], "doc_id bigint, text string")
    marks = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(200)], "doc_id bigint, toxic bigint")
    model = toxicity.fit(docs, marks)
    again = toxicity.fit(docs.repartition(5), marks)
    assert model.weights == again.weights and (model.theta == again.theta).all()
    found = defaultdict(set)
    for r in toxicity.score(docs, model).collect():
        found[r.doc_id].add(r._toxic)
    assert all(found[i] == {i % 3 == 0} for i in range(300) if i != 3) and found[400] == {True}


def test_severity_of_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    model = toxicity.fit(docs, labels.where(half))
    rows = toxicity.score(docs, model).join(labels.where(~half & F.col("toxic").isNotNull()), "doc_id").select("toxic", "_severity", "_toxic").collect()
    bad, good = ([r for r in rows if r.toxic == k] for k in (1, 0))
    # some two hundred toxic rows to learn from, and invented words that differ from row to row
    assert bad and sum(r._toxic for r in bad) >= 0.6 * len(bad) and sum(r._toxic for r in good) <= 0.01 * len(good)
    assert sum(r._severity for r in bad) / len(bad) > 1 > 0.2 > sum(r._severity for r in good) / len(good)


# ---- 9 -------------------------------------------------------------------------


@pytest.mark.parametrize("share", [lm.HEAD, 40])
def test_lm(spark, odd, none, monkeypatch, share):
    monkeypatch.setattr(lm, "HEAD", share)
    training = odd.where("doc_id is null or doc_id not in (1, 9)")
    rows = lm.score(odd, training).collect()
    assert len(rows) == odd.count()
    c = Counter(t for r in training.collect() for t in lm.tokens(r.text))
    n, v = sum(c.values()), len(c)
    texts = {r.doc_id: r.text for r in odd.collect()}
    for r in rows:
        t = lm.tokens(texts[r.doc_id])
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(c[w] > 0 for w in t), n)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), rel_tol=1e-9)
        assert r.score < 0
    assert lm.score(none, training).count() == 0
    assert {r.n_known for r in lm.score(odd, none).collect()} == {0}


def test_lm_learns_from_all_positions(spark):
    text = " ".join("abcde"[i * i % 5] for i in range(300))
    docs = spark.createDataFrame([(i, text + f" {i}") for i in range(20)] + [(3, None), (None, "x y")], "doc_id bigint, text string")
    c = Counter(t for r in docs.collect() for t in lm.tokens(r.text))
    head = lm.Head(c.most_common(), sum(c.values()), len(c), {})
    rows = lm.positions(docs, head).collect()
    assert len({(r.split, r.round) for r in rows}) == len(rows) <= lm.ROUNDS
    kinds = np.concatenate([np.frombuffer(r.kinds, "<i2") for r in rows])
    want = Counter(int(k) for r in docs.collect() for k in head.classes(*head.indexes(r.text)))
    assert Counter(kinds[kinds != lm.BEFORE].tolist()) == want


def test_lm_beats_counts_whatever_the_partitions(spark, monkeypatch):
    monkeypatch.setattr(lm, "SPLIT", 200_000)  # two splits
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    out = language.held_out(F.col("doc_id"), 1)
    scores = []
    for n in (1, 64):
        rows = lm.score(docs.repartition(n), docs.where(~out).repartition(n)).where(out).select("doc_id", "n_tokens", "base_score", "score").collect()
        size = sum(r.n_tokens for r in rows)
        assert sum(r.score for r in rows) / size > sum(r.base_score for r in rows) / size + 0.05
        scores.append({r.doc_id: r.score for r in rows})
    assert all(math.isclose(scores[0][k], scores[1][k], rel_tol=1e-9) for k in scores[0])


def test_lm_scores_like_plain_sums(spark, monkeypatch):
    """Scores against probabilities that are normalised class by class, without the tables."""
    kept = {}
    made = lm.fit
    monkeypatch.setattr(lm, "fit", lambda t, h: kept.setdefault("state", made(t, kept.setdefault("head", h))))
    training = spark.createDataFrame([(i, " ".join(f"w{(i * j) % 17}" for j in range(30))) for i in range(50)], "doc_id bigint, text string")
    docs = spark.createDataFrame([(1, "w1 w2 w3 w3"), (2, "w0 unseen w4"), (3, None)], "doc_id bigint, text string")
    got = {r.doc_id: r.score for r in lm.score(docs, training).collect()}
    head, (r, a, b, bias) = kept["head"], [x.astype(np.float64) for x in kept["state"]]
    for row in docs.collect():
        index, words_ = head.indexes(row.text)
        kinds = head.classes(index, words_)
        want = 0.0
        for (u, v, w), i in zip(lm.contexts(kinds).tolist(), index.tolist(), strict=True):
            s = ((r[u] @ a + r[v] @ b) @ r.T + bias)[: lm.BEFORE]
            share = head.share[i] if i >= 0 else math.log10(0.5) - head.rare_mass[w - lm.RARE]
            want += (s[w] - np.log(np.exp(s).sum())) / math.log(10) + share
        assert math.isclose(got[row.doc_id], want, rel_tol=1e-4)


def test_lm_is_normalised():
    head = lm.Head([(b"a", 5), (b"b", 3), (b"\n", 2)], 12, 5, {lm.ending(b"c", lm.RARES): (2, 2)})
    t = lm.Tables(*lm.start(head)[:4])
    w = np.arange(lm.CLASSES - 1)
    p = 10 ** t.log10(np.full(len(w), 2), np.full(len(w), lm.BEFORE), w)
    assert math.isclose(p.sum(), 1, rel_tol=1e-4)


# ---- 10 ------------------------------------------------------------------------


@settings(max_examples=5, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["<", "|", "&", "[", "INST]", "/", "s>", "<SYS>>", "end|>", "turn", "a", "\n"]), max_size=12).map("".join), min_size=40, max_size=40))
def test_escape_is_reversible(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(F.col("t")).alias("e"))
    for r in df.select("t", "e", chat.unescape(F.col("e")).alias("u")).collect():
        assert r.t == r.u and not re.search(rf"[<\[]({chat.CONTROL})", r.e)


def test_chat_odd_rows(spark):
    rows = [(1, 2, "assistant", "b"), (1, 0, "user", "a<|end|>"), (1, None, None, None), (1, 300, "assistant", "</s>"), (None, 0, "user", ""), (2, 0, "user", "x"), (2, 0, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("segment", F.lit(9))
    turns = chat.canonical_turns(df)
    back = chat.read_back(chat.format_turns(turns)).orderBy("conv_id", "segment", "part").collect()
    said = defaultdict(list)
    for r in back:
        said[r.conv_id] += [(t.role, t.text) for t in r.turns]
    assert said[1] == [("", ""), ("user", "a<|end|>"), ("assistant", "b"), ("assistant", "</s>")]
    assert said[2] == [("user", "x")] * 2 and said[None] == [("user", "")]
    assert "".join(r.loss_text for r in back if r.conv_id == 1) == "b</s>"
    assert chat.format_turns(chat.canonical_turns(df.where("false"))).count() == 0
    with pytest.raises(ValueError):
        chat.canonical_turns(spark.range(1))


def test_chat_parts_of_one_turn_number(spark, monkeypatch):
    monkeypatch.setattr(chat, "PART", 10)
    rows = [(1, 0 if i % 2 else None, "user" if i % 3 else "assistant", f"t{i:03d}") for i in range(95)] + [(2, i, "user", "x" * 50_000) for i in range(3)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(3)
    back = chat.read_back(chat.format_turns(chat.canonical_turns(df))).orderBy("conv_id", "segment", "part").collect()
    assert max(r.n_turns for r in back) == 10 and len(back) == 11
    want = sorted((r for r in rows if r[0] == 1), key=lambda r: (-1 if r[1] is None else r[1], r[2], r[3]))
    assert [(t.role, t.text) for r in back if r.conv_id == 1 for t in r.turns] == [r[2:] for r in want]
    assert "".join(r.loss_text for r in back if r.conv_id == 1) == "".join(r[3] for r in want if r[2] == "assistant")


def test_layouts(spark):
    want = [(5, 0, "user", "q"), (5, 1, "assistant", "r")]
    for record in ("{'conv_id':5,'messages':[{'role':'user','content':'q'},{'role':'assistant','content':'r'}]}", "{'conv_id':5,'conversations':[{'from':'human','value':'q'},{'from':'gpt','value':'r'}]}", "{'conv_id':5,'instruction':'q','input':'','output':'r'}", "{'conv_id':5,'prompt':'q','completion':'r'}", "{'conv_id':5,'question':'q','answer':'r'}", "{'conv_id':5,'prompt':'q','completion':'r','meta':{'question':'x','answer':'y'}}", "{'conv_id':5,'prompt':'q','completion':'r','question':5}"):
        df = spark.createDataFrame([(record.replace("'", '"'),)], "record string")
        assert sorted(tuple(r) for r in chat.canonical_records(df).collect()) == want, record
    rows = spark.createDataFrame([('{"conv_id":2,"turn":7,"role":"user","text":null}',)], "record string")
    assert [tuple(r) for r in chat.canonical_records(rows).collect()] == [(2, 7, "user", None)]


def test_unknown_records_raise_or_stay_apart(spark):
    known = '{"conv_id":5,"question":"q","answer":"r"}'
    bad = ["torn {", '{"conv_id":1}', "[1]", None, '{"conv_id":1,"messages":[{"role":"user"}]}']
    df = spark.createDataFrame([(known,), *[(x,) for x in bad]], "record string")
    assert len(chat.canonical_records(df, unknown="apart").collect()) == 2
    assert sorted(r.record or "" for r in chat.unknown_records(df).collect()) == sorted(x or "" for x in bad)
    for x in bad:
        with pytest.raises(Exception, match="no mapping for the layout"):
            chat.canonical_records(spark.createDataFrame([(known,), (x,)], "record string")).collect()
    assert chat.canonical_records(df.where("false")).count() == 0
