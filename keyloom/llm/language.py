"""Language ID by prediction by partial matching over bytes.

For each language a tree of byte contexts up to ``DEPTH`` long, with frozen counts. In a context
seen n times with q distinct next bytes, a byte seen c times costs -log2(c / (n + q)), any other an
escape of -log2(q / (n + q)) plus its cost in the context one byte shorter; below the empty context
it costs 8 bits. The language with the least code length of the whole text wins; its score is its
share when code lengths are read as probabilities. ASCII letters are lower-cased first.

Learning: from at most about ``DOCS_PER_LANGUAGE`` documents of each language (picked by hashed id,
with the expected number so bounded) and ``BYTES_PER_LANGUAGE`` bytes of them, on the driver. The
trees of all languages share one set of at most ``MOST_NODES / languages`` contexts, so all costs
are a table by (context, byte, language) and a text is scored with numpy by table look-ups for all
bytes at once. Prediction is one pass without a shuffle over whole texts.

Nulls and the like: a null text or one without a letter is ``und`` with score 0; rows without
language or id teach nothing (a null id counts as not held out); with nothing to learn from all is
``und``. Of equal code lengths the first language by code point wins. Extra columns are left out.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm.common import ship, table

DEPTH = 4
DOCS_PER_LANGUAGE, BYTES_PER_LANGUAGE = 400, 2_000_000
MOST_NODES, LEAST_COUNT = 24_000, 6
#: Bytes scored at a time.
CHUNK = 1 << 21
UND = "und"
_LETTER = re.compile(r"[^\W\d_]")


class Trees:
    """Contexts of all languages: children by (node, byte), costs in bits by (node, byte, language)."""

    def __init__(self, languages: list[str], step: np.ndarray, cost: np.ndarray):
        self.languages, self.step, self.cost = languages, step, cost
        self.nodes = len(step) // 512

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """(texts, languages) code lengths in bits."""
        out = np.zeros((len(texts), len(self.languages)))
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) <= CHUNK):
                size += len(texts[end])
                end += 1
            if size > CHUNK:
                t = texts[at]
                for i in range(0, len(t), CHUNK):  # a context is the last DEPTH bytes, so a long text can be cut
                    out[at] += self._some([t[i : i + CHUNK]], t[max(0, i - DEPTH) : i])[0]
            elif size:
                out[at:end] = self._some(texts[at:end])
            at = end
        return out

    def _some(self, texts: list[bytes], before: bytes = b"") -> np.ndarray:
        pad = before.rjust(DEPTH, b"\0")
        a = np.frombuffer(pad + pad.join(texts), np.uint8)
        n = np.array([len(t) for t in texts])
        here = np.repeat(np.arange(1, len(n) + 1) * DEPTH, n) + np.arange(int(n.sum()))
        node = walk(self.step, a, here, DEPTH)
        node -= (node >= self.nodes) * np.int32(self.nodes)
        bits = self.cost[(node << 8) | a[here]]
        full = np.flatnonzero(n)
        out = np.zeros((len(n), len(self.languages)))
        out[full] = np.add.reduceat(bits, (np.cumsum(n) - n)[full], axis=0, dtype=np.float64)
        return out


def walk(step: np.ndarray, a: np.ndarray, here: np.ndarray, depth: int) -> np.ndarray:
    """The longest context at each place; from ``len(step) // 512`` on, the twin of a node that no longer context continues."""
    node = np.zeros(len(here), np.int32)
    for j in range(1, depth + 1):
        node = step[(node << 8) | a[here - j]]
    return node


def learn(texts: dict[str, list[bytes]]) -> Trees:
    languages = sorted(texts)
    pad = b"\0" * DEPTH
    data, here = [], []
    for lang in languages:
        n = np.array([len(t) for t in texts[lang]])
        data.append(np.frombuffer(pad + pad.join(texts[lang]), np.uint8))
        here.append(np.repeat(np.arange(1, len(n) + 1) * DEPTH, n) + np.arange(int(n.sum())))
    most = max(1, MOST_NODES // len(languages))
    # contexts, shortest first: a context's code has its last byte lowest
    code, parent, last = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], [np.zeros(1, np.int64)]
    seen = [np.full(1, 1 << 60)]
    for k in range(1, DEPTH + 1):
        codes = np.concatenate([sum(a[h - 1 - j].astype(np.int64) << (8 * j) for j in range(k)) for a, h in zip(data, here, strict=True)])
        c, n = np.unique(codes, return_counts=True)
        c, n = c[n >= LEAST_COUNT], n[n >= LEAST_COUNT]
        code.append(c)
        seen.append(n)
    # a shorter context is seen as often at least, so taking the most frequent, shorter first among equals, keeps every parent
    order = np.lexsort((np.repeat(np.arange(DEPTH + 1), [len(c) for c in code]), -np.concatenate(seen)))[:most]
    depth = np.repeat(np.arange(DEPTH + 1), [len(c) for c in code])
    keep = np.sort(order)
    code_, depth = np.concatenate(code)[keep], depth[keep]
    nodes = len(keep)
    step = np.concatenate([np.repeat(np.arange(nodes), 256) + nodes, np.repeat(np.arange(nodes), 256) + nodes]).astype(np.int32)
    parent = np.zeros(nodes, np.int64)
    start = np.searchsorted(depth, np.arange(DEPTH + 2))
    for k in range(1, DEPTH + 1):
        mine, above = slice(start[k], start[k + 1]), slice(start[k - 1], start[k])
        parent[mine] = start[k - 1] + np.searchsorted(code_[above], code_[mine] & ((1 << (8 * (k - 1))) - 1))
        step[(parent[mine] << 8) | (code_[mine] >> (8 * (k - 1)))] = np.arange(start[k], start[k + 1])
    cost = np.empty((nodes, 256, len(languages)), np.float32)
    for i, (a, h) in enumerate(zip(data, here, strict=True)):
        counts = np.zeros(nodes * 256, np.int64)
        for k in range(DEPTH + 1):
            node = walk(step, a, h, k)
            ok = node < nodes
            ok &= depth[np.where(ok, node, 0)] == k
            counts += np.bincount((node[ok].astype(np.int64) << 8) | a[h][ok], minlength=nodes * 256)
        counts = counts.reshape(nodes, 256)
        n, q = counts.sum(1), (counts > 0).sum(1)
        with np.errstate(divide="ignore", invalid="ignore"):
            own = -np.log2(counts / (n + q)[:, None])
            escape = -np.log2(q / (n + q))
        for k in range(DEPTH + 1):
            mine = slice(start[k], start[k + 1])
            shorter = cost[parent[mine], :, i] if k else np.full((1, 256), 8.0)
            missing = np.where((n[mine] > 0)[:, None], escape[mine][:, None] + shorter, shorter)
            cost[mine, :, i] = np.where(counts[mine] > 0, own[mine], missing)
    return Trees(languages, step, cost.reshape(nodes * 256, len(languages)))


def fit(docs: DataFrame, held_out: Column) -> Trees | None:
    """Trees of the languages of rows that aren't held out."""
    rows = docs.where(~held_out & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}  # a row for each language
    if not sizes:
        return None
    name = F.xxhash64("doc_id", "text")  # rows of one id are drawn one by one
    draw = F.pmod(name, F.lit(1 << 30)) / float(1 << 30)
    chance = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, DOCS_PER_LANGUAGE / n))])
    texts: dict[str, list[bytes]] = {}
    used: dict[str, int] = {}
    for r in rows.where(draw < chance[F.col("lang")]).select("lang", "text", "doc_id").orderBy(name, "doc_id", "text").toLocalIterator():
        t = r.text.encode("utf-8", "surrogatepass").lower()
        if used.get(r.lang, 0) < BYTES_PER_LANGUAGE:
            texts.setdefault(r.lang, []).append(t)
            used[r.lang] = used.get(r.lang, 0) + len(t)
    texts = {k: v for k, v in texts.items() if used[k]}
    return learn(texts) if texts else None


def predict(docs: DataFrame, trees: Trees | None, text: str = "text") -> DataFrame:
    """docs' doc_id with lang_pred and score; text is all that is read."""
    rows = docs.select(F.col("doc_id").cast("bigint"), F.col(text))
    if trees is None:
        return rows.select("doc_id", F.lit(UND).alias("lang_pred"), F.lit(0.0).alias("score"))
    spark = docs.sparkSession
    ship(spark)
    at = spark.sparkContext.broadcast(trees)  # bounded by MOST_NODES

    def run(batches):
        trees = at.value
        for b in batches:
            texts = [x if x and _LETTER.search(x) else None for x in b.column(1).to_pylist()]
            bits = trees.lengths([(x or "").encode("utf-8", "surrogatepass").lower() for x in texts])
            best = bits.argmin(1) if len(texts) else np.zeros(0, int)
            share = 1 / np.exp2(np.maximum(bits.min(1, keepdims=True) - bits, -1000)).sum(1) if len(texts) else np.zeros(0)
            names = [trees.languages[k] if x else UND for k, x in zip(best.tolist(), texts, strict=True)]
            score = [s if x else 0.0 for s, x in zip(share.tolist(), texts, strict=True)]
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "lang_pred": pa.array(names, pa.string()), "score": pa.array(score, pa.float64())})

    return rows.mapInArrow(run, "doc_id bigint, lang_pred string, score double")


def held_out(doc_id: Column, remainder: int = 0) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == remainder, F.lit(False))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, fit(docs, held_out(F.col("doc_id")))).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
