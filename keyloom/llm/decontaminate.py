"""Benchmark decontamination by SimHash windows and multi-index Hamming search (native).

Each benchmark item is cut into passages of equal size, at most ``PASSAGE`` words. A document is searched with
windows of a passage's size: all starts that align a five-word shingle of the window with the same
shingle of a passage. (A window that shares no shingle has similarity 0, so none of those is built.)
Windows and passages get 64-bit SimHashes of their words; fingerprints are cut into ``BLOCKS`` blocks
of eight bits. Two fingerprints within ``RADIUS`` differ by at most one bit in some block, so
passages are indexed under each block's value and its eight neighbours and every pair within the
radius meets. Pairs within it are verified: the weighted Jaccard similarity of their shingles (each
counted as often as it occurs) must reach ``LEAST``.

Shingles of passages, and the index (72 narrow rows a passage), go to every task if what is sent is
at most ``MOST_SENT`` bytes, else by a shuffle; results are the same. Shingle lists join only pairs
within the radius. The rest moves only what aligned: starts, and the texts of documents that have any.
A window of similarity 0.75 may lie beyond the radius: README has the share.

Nulls and the like: null or empty texts and items match nothing; an item of fewer than five words is
one shingle; a null item id is an id; rows that agree in id and text count once each, as one match
per (doc_id, item_id). Empty tables give no rows. Extra columns are left out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm.common import ascii_lower, table, words

SHINGLE, LEAST = 5, 0.75
PASSAGE, BLOCKS, RADIUS = 200, 8, 15
#: Bytes, by ROW_BYTES a row of what is sent.
MOST_SENT, ROW_BYTES = 48 << 20, 48
_LANES = 0x0001000100010001


def shingles(w: Column, k: int = SHINGLE) -> Column:
    """Hashes of all runs of k words, in order."""
    run = lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)])
    return F.when(F.size(w) >= k, F.transform(F.sequence(F.lit(0), F.size(w) - k), run)).otherwise(F.array().cast("array<bigint>"))


def simhash(w: Column) -> Column:
    """64 bits: one for each that more than half of the words' hashes have; at most 254 words.

    Sixteen sums hold four counts each, 16 bits apart; adding 127 - n / 2 carries a majority into bit 7.
    """
    digest = F.transform(w, lambda x: F.conv(F.substring(F.md5(x), 1, 16), 16, -10).cast("bigint"))
    zero = F.array_repeat(F.lit(0).cast("bigint"), 16)
    sums = F.aggregate(digest, zero, lambda acc, h: F.transform(acc, lambda a, k: a + F.call_function("shiftrightunsigned", h, k).bitwiseAND(F.lit(_LANES))))
    push = (F.lit(127) - F.floor(F.size(w) / 2)).cast("bigint") * F.lit(_LANES)
    bit = lambda k: F.shiftleft(F.shiftright((F.get(sums, F.lit(k)) + push).bitwiseAND(F.lit(0x0080008000800080)), 7), k)
    return reduce(lambda x, y: x.bitwiseOR(y), [bit(k) for k in range(16)])


def similarity(a: Column, b: Column) -> Column:
    """Weighted Jaccard of two lists: each element counts as often as it occurs."""
    times = lambda x, h: F.size(F.filter(x, lambda y: y == h))
    both = F.aggregate(F.array_intersect(a, b), F.lit(0), lambda acc, h: acc + F.least(times(a, h), times(b, h)))
    return both / (F.size(a) + F.size(b) - both)


def passages(benchmark: DataFrame) -> DataFrame:
    """item_id, pid, w (words), n, k (shingle length), sh (shingles), print."""
    w = benchmark.select("item_id", words(ascii_lower(F.col("text"))).alias("all")).where(F.size("all") > 0)
    w = w.withColumn("pieces", F.ceil(F.size("all") / PASSAGE).cast("int"))
    pieces = w.select("item_id", "all", "pieces", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"))
    edge = lambda i: F.floor(i * F.size("all") / F.col("pieces")).cast("int")
    pieces = pieces.select("item_id", "piece", F.slice("all", edge(F.col("piece")) + 1, edge(F.col("piece") + 1) - edge(F.col("piece"))).alias("w"))
    pieces = pieces.withColumn("n", F.size("w")).withColumn("k", F.least("n", F.lit(SHINGLE)))
    sh = reduce(lambda x, k: F.when(F.col("k") == k, shingles(F.col("w"), k)).otherwise(x), range(1, SHINGLE), shingles(F.col("w")))
    return pieces.select("item_id", F.xxhash64("item_id", "piece", "w").alias("pid"), "w", "n", "k", sh.alias("sh"), simhash(F.col("w")).alias("print"))


def _block(print_: Column, i: Column) -> Column:
    return F.call_function("shiftrightunsigned", print_, (i * 8).cast("int")).bitwiseAND(F.lit(255))


def matches(docs: DataFrame, benchmark: DataFrame, least: float = LEAST, radius: int = RADIUS) -> DataFrame:
    """doc_id, key (of the text), item_id, start (word), n_words, similarity, distance: verified windows."""
    if radius // BLOCKS > 1:
        raise ValueError(f"the index covers radii below {2 * BLOCKS}")
    items = passages(benchmark).dropDuplicates(["item_id", "pid", "w"])
    index = items.select("n", "k", F.posexplode("sh").alias("j", "h")).distinct()
    lengths = {r.k: r["count"] for r in index.groupBy("k").count().collect()}  # shingle lengths, at most five
    send = lambda x, rows: F.broadcast(x) if rows * ROW_BYTES <= MOST_SENT else x
    read = docs.select("doc_id", "text", words(ascii_lower(F.col("text"))).alias("w"))
    key = F.xxhash64("text").alias("key")
    hits = None
    for k in sorted(lengths):
        runs = read.select("doc_id", key, F.posexplode(shingles(F.col("w"), k)).alias("at", "h"))
        got = runs.join(send(index.where(F.col("k") == k).select("n", "j", "h"), lengths[k]), "h").select("doc_id", "key", (F.col("at") - F.col("j")).alias("start"), "n", F.lit(k).alias("k"))
        hits = got if hits is None else hits.unionByName(got)
    if hits is None:
        return docs.sparkSession.createDataFrame([], "doc_id bigint, key bigint, item_id bigint, start int, n_words int, similarity double, distance int")
    # a window that begins before the text or ends behind it is cut there
    per_doc = hits.groupBy("doc_id", "key").agg(F.collect_set(F.struct("start", "n", "k")).alias("at"))
    found = read.withColumn("key", F.xxhash64("text")).alias("d").join(per_doc.alias("p"), F.col("d.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("d.key") == F.col("p.key")))
    windows = found.select("d.doc_id", "d.key", "w", F.explode("at").alias("a")).select("doc_id", "key", "a.start", "a.n", "a.k", "w")
    begin = F.greatest("start", F.lit(0))
    windows = windows.withColumn("w", F.slice("w", begin + 1, F.col("n") + F.least("start", F.lit(0)))).where("size(w) >= k")
    sh = reduce(lambda x, k: F.when(F.col("k") == k, shingles(F.col("w"), k)).otherwise(x), [k for k in sorted(lengths) if k < SHINGLE], shingles(F.col("w")))
    windows = windows.select("doc_id", "key", begin.alias("start"), "n", F.size("w").alias("n_words"), sh.alias("sh"), simhash(F.col("w")).alias("print"))
    near = F.transform(F.sequence(F.lit(-1), F.lit(7)), lambda b: F.when(b < 0, F.lit(0)).otherwise(F.call_function("shiftleft", F.lit(1), F.greatest(b, F.lit(0)))))
    entries = items.select("pid", "n", F.col("print").alias("item_print"), F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1))).alias("block"), near.alias("near"))
    entries = entries.select("*", F.explode("near").alias("flip")).withColumn("v", _block(F.col("item_print"), F.col("block")).bitwiseXOR(F.col("flip").cast("bigint"))).drop("near", "flip")
    asked = windows.select("*", F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1))).alias("block")).withColumn("v", _block(F.col("print"), F.col("block")))
    n_items = items.count()
    pairs = asked.join(send(entries, n_items * BLOCKS * 9), ["n", "block", "v"]).withColumn("distance", F.bit_count(F.col("print").bitwiseXOR(F.col("item_print")))).where(F.col("distance") <= radius)
    # a pair meets in several blocks; it is verified in the first
    differs = lambda b: F.bit_count(_block(F.col("print"), b).bitwiseXOR(_block(F.col("item_print"), b))) <= 1
    pairs = pairs.where(F.col("block") == F.filter(F.sequence(F.lit(0), F.lit(BLOCKS - 1)), differs)[0])
    verify = items.select("pid", "item_id", F.col("sh").alias("item_sh"))
    pairs = pairs.join(send(verify, n_items + sum(lengths.values())), "pid")  # its lists hold one number a shingle
    pairs = pairs.withColumn("similarity", similarity(F.col("sh"), F.col("item_sh"))).where(F.col("similarity") >= least)
    return pairs.select("doc_id", "key", "item_id", "start", "n_words", "similarity", "distance")


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document and benchmark item of which it holds a passage."""
    best = matches(docs, benchmark).groupBy("doc_id", "item_id")
    first = F.min(F.struct((-F.col("similarity")).alias("s"), F.col("start"), F.col("n_words"), F.col("distance"))).alias("m")
    return best.agg(first).select("doc_id", "item_id", (-F.col("m.s")).alias("similarity"), F.col("m.start").cast("bigint").alias("start_word"), F.col("m.n_words").cast("bigint").alias("n_words"), F.col("m.distance").cast("bigint").alias("distance"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows that hold a benchmark passage."""
    bad = matches(docs, benchmark).select(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["_id"]) & (F.xxhash64(docs["text"]) == bad["_key"]), "left_anti")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _bits(words_: str) -> str:
    hashes = f"list_transform({words_}, lambda x: ('0x' || md5(x)[1:16])::UBIGINT)"
    return f"list_transform(range(64), lambda b: list_sum(list_transform({hashes}, lambda h: ((h >> b) & 1)::BIGINT)) * 2 > len({words_}))"


_FOLD = "string_split_regex(trim(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '[\\x20\\x09-\\x0D]+')"
#: Windows aligned with a shared shingle, within the radius, verified.
OP6_SQL = f"""
WITH dw AS (SELECT doc_id, list_filter({_FOLD}, lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
ia AS (SELECT item_id, list_filter({_FOLD}, lambda x: x <> '') AS w FROM benchmark WHERE text IS NOT NULL),
ip AS (SELECT item_id, w, ceil(len(w) / {PASSAGE})::BIGINT AS pieces FROM ia WHERE len(w) > 0),
iq AS (SELECT item_id, w, pieces, unnest(range(pieces)) AS piece FROM ip),
iw AS (SELECT item_id, w[(piece * len(w)) // pieces + 1 : ((piece + 1) * len(w)) // pieces] AS w FROM iq),
i AS (SELECT item_id, w, len(w) AS n, least(len(w), {SHINGLE}) AS k FROM iw WHERE len(w) > 0),
s AS (SELECT item_id, n, k, unnest(range(n - k + 1)) AS j, w FROM i),
si AS (SELECT item_id, n, k, j, array_to_string(w[j + 1 : j + k], ' ') AS h FROM s),
d AS (SELECT DISTINCT doc_id, w FROM dw),
ks AS (SELECT DISTINCT k FROM i),
dp AS (SELECT doc_id, w, k, unnest(range(len(w) - k + 1)) AS p FROM d, ks WHERE len(w) >= k),
ds AS (SELECT doc_id, w, k, p, array_to_string(w[p + 1 : p + k], ' ') AS h FROM dp),
a AS (SELECT DISTINCT doc_id, w, p - j AS start, n, si.k AS k FROM ds JOIN si ON ds.h = si.h AND ds.k = si.k),
v AS (SELECT doc_id, n, k, greatest(start, 0) AS start, w[greatest(start, 0) + 1 : start + n] AS w FROM a),
vb AS (SELECT *, {_bits('w')} AS bits FROM v WHERE len(w) >= k),
ib AS (SELECT *, {_bits('w')} AS bits FROM i),
c AS (
  SELECT vb.doc_id, ib.item_id, vb.start, len(vb.w) AS n_words, vb.k, vb.w AS vw, ib.w AS iw,
    list_sum(list_transform(range(64), lambda b: (vb.bits[b + 1] <> ib.bits[b + 1])::BIGINT)) AS distance
  FROM vb JOIN ib ON vb.n = ib.n),
e AS (
  SELECT *, list_transform(range(len(vw) - k + 1), lambda x: array_to_string(vw[x + 1 : x + k], ' ')) AS vs,
    list_transform(range(len(iw) - k + 1), lambda x: array_to_string(iw[x + 1 : x + k], ' ')) AS ws FROM c WHERE distance <= {RADIUS}),
f AS (
  SELECT *, coalesce(list_sum(list_transform(list_intersect(vs, ws), lambda x: least(len(list_filter(vs, lambda y: y = x)), len(list_filter(ws, lambda y: y = x))))), 0) AS n_both FROM e),
g AS (SELECT doc_id, item_id, n_both::DOUBLE / (len(vs) + len(ws) - n_both) AS similarity, start, n_words, distance FROM f),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start, n_words, distance) AS rn FROM g WHERE similarity >= {LEAST})
SELECT doc_id, item_id, similarity, start::BIGINT AS start_word, n_words::BIGINT AS n_words, distance::BIGINT AS distance FROM r WHERE rn = 1
"""
