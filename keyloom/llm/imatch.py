"""Document fingerprints by I-Match with randomised lexicon subsets.

The lexicon holds the words (A-Z lower-cased) whose document frequency lies in a band: at least
``BAND[0]`` and at most ``BAND[1]`` of all documents, counted over all of them. Every word falls
into one of ``SUBSETS`` lexicon subsets by its hash; for each subset the fingerprint has a hash of
the text's distinct terms in it, in sorted order, or ``ffff`` where it has none. Two fingerprints
are as alike as the share of equal hashes among the subsets in which either has one. Texts without a
lexicon term give no evidence: they are alike 0 to all but equal texts.

The band bounds the lexicon: a word in it is in at least ``BAND[0] * N`` documents, so there are at
most (mean distinct words of a document) / ``BAND[0]``; that is what goes to every task. Counting
pre-aggregates in each task. Fingerprints take one pass; the edited text needs the neighbour in id
order, for which documents are range-partitioned once and only a partition's two edge rows travel.

Nulls and ties: a null text is empty, a text without lexicon terms has a fingerprint of ``f`` only, a
null id comes last; rows of one id follow in the order of a hash of their packed bytes.
Repeated rows are rows of their own. An empty table gives no rows. Extra columns are left out.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keyloom.llm.common import packed, partitions, ship, stash, table, unpacker

BAND = (1 / 1000, 1 / 10)
SUBSETS = 64
NONE = 0xFFFF
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def terms(text: str) -> set[bytes]:
    """Distinct words; bytes split at exactly the six separators."""
    return set(text.encode("utf-8", "surrogatepass").translate(_LOWER).split())


def document_frequencies(docs: DataFrame) -> DataFrame:
    """word (binary), df: counted in each task first."""
    ship(docs.sparkSession)

    def run(batches):
        seen: Counter = Counter()

        def out():
            return pa.RecordBatch.from_pydict({"word": pa.array(list(seen.keys()), pa.binary()), "n": pa.array(list(seen.values()), pa.int64())})

        for b in batches:
            for x in b.column(0).to_pylist():
                seen.update(terms(x))
            if len(seen) >= 400_000:
                yield out()
                seen.clear()
        yield out()

    return docs.where("text is not null").select("text").mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("df"))


def lexicon(docs: DataFrame, band: tuple[float, float] = BAND) -> list[bytes]:
    """The words in the band, sorted; bounded as the module says."""
    n = docs.count()
    low, high = max(2, int(np.ceil(n * band[0]))), int(n * band[1])
    return sorted(bytes(r.word) for r in document_frequencies(docs).where(F.col("df").between(low, high)).collect())


class Fingerprints:
    def __init__(self, lexicon: list[bytes], subsets: int = SUBSETS):
        self.subsets = subsets
        self.known = {w: self.hash(w) for w in lexicon}

    @staticmethod
    def hash(word: bytes) -> int:
        return xxhash.xxh64_intdigest(word, 7)

    def of(self, text: str) -> np.ndarray:
        """Per subset a 16-bit hash, or NONE."""
        words = terms(text)
        get = self.known.get
        got = [h for w in words if (h := get(w)) is not None]
        out = np.full(self.subsets, NONE, ">u2")
        if got:
            h = np.array(got, np.uint64)
            subset = (h >> np.uint64(40)) % np.uint64(self.subsets)
            order = np.lexsort((h, subset))
            h, subset = h[order], subset[order]
            first = np.flatnonzero(np.concatenate([[True], subset[1:] != subset[:-1]]))
            place = (np.arange(len(h)) - np.repeat(first, np.diff(np.append(first, len(h))))).astype(np.uint64)
            # a term's hash is mixed with its place in the sorted list of its subset
            x = (h ^ (place * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
            x = np.add.reduceat(x ^ (x >> np.uint64(29)), first) * np.uint64(0x94D049BB133111EB)
            out[subset[first].astype(np.int64)] = np.minimum(x >> np.uint64(48), np.uint64(NONE - 1))
        return out

    @staticmethod
    def alike(a: np.ndarray, b: np.ndarray) -> float:
        either = (a != NONE) | (b != NONE)
        n = int(either.sum())
        return float((a == b)[either].sum()) / n if n else 0.0


def fingerprints(docs: DataFrame, lexicon_: list[bytes]) -> DataFrame:
    """doc_id, fingerprint of every text; one pass, no shuffle."""
    ship(docs.sparkSession)
    at = docs.sparkSession.sparkContext.broadcast(lexicon_)

    def run(batches):
        made = Fingerprints(at.value)
        for b in batches:
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "fingerprint": pa.array([made.of(x or "").tobytes().hex() for x in b.column(1).to_pylist()], pa.string())})

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, fingerprint string")


#: Digests are binary until the end: they are most of what is stored.
_ROW = "doc_id bigint, n_chars bigint, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"


def _row(made: Fingerprints, name, text: str, print_: np.ndarray, next_text: str, next_print: np.ndarray) -> tuple:
    half = len(text) // 2
    edited = text[: len(text) - half] + next_text[:half]
    other = print_ if edited == text else made.of(edited)
    digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).digest()
    return name, len(text), digest, print_.tobytes(), other.tobytes(), 1.0 if edited == text else made.alike(print_, other), 1.0 if next_text == text else made.alike(print_, next_print)


def _batch(rows: list[tuple], more: dict | None = None) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.float64()]
    names = [x.split()[0] for x in _ROW.split(", ")]
    out = {n: pa.array([r[i] for r in rows], k) for i, (n, k) in enumerate(zip(names, kinds, strict=True))}
    return pa.RecordBatch.from_pydict(out | (more or {}))


def edited_likeness(docs: DataFrame, lexicon_: list[bytes]) -> DataFrame:
    """Every document beside its edited text and the next document (descending id, around the end)."""
    spark = docs.sparkSession
    ship(spark)
    at = spark.sparkContext.broadcast(lexicon_)

    def run(batches):
        made, part = Fingerprints(at.value), TaskContext.get().partitionId()
        first = last = None
        unpack = unpacker()

        def edge(kind: str, row) -> pa.RecordBatch:
            return _batch([(row[0], None, None, None, None, None, None)], {"part": pa.array([part], pa.int32()), "edge": pa.array([kind]), "text": pa.array([row[1]], pa.string())})

        for b in batches:
            out = []
            for name, z in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                text = unpack(z.as_py()).decode("utf-8", "surrogatepass")
                now = (name, text, made.of(text))
                if last is None:
                    first = now
                else:
                    out.append(_row(made, *last, now[1], now[2]))
                last = now
            if out:
                yield _batch(out, {"part": pa.array([part] * len(out), pa.int32()), "edge": pa.nulls(len(out), pa.string()), "text": pa.nulls(len(out), pa.string())})
        if last is not None:
            yield edge("first", first)
            yield edge("last", last)

    by_id, tie = F.col("doc_id").desc_nulls_last(), F.xxhash64("z")
    rows = packed(docs).repartitionByRange(partitions(spark, docs), by_id, tie).sortWithinPartitions(by_id, tie, "z")
    rows = stash(rows.mapInArrow(run, _ROW + ", part int, edge string, text string"), "imatch")
    # two rows for each partition; a partition's last document is followed by the first of the next, the last one's by the very first
    edges = rows.where("edge is not null").select("part", "edge", "doc_id", "text")
    order = edges.where("edge = 'first'").select("part", F.lead("part").over(Window.orderBy("part")).alias("next_part"), F.min("part").over(Window.partitionBy()).alias("least"))
    order = order.select("part", F.coalesce("next_part", "least").alias("next_part"))
    pairs = edges.where("edge = 'last'").select("part", "doc_id", "text").join(order, "part")
    pairs = pairs.join(edges.where("edge = 'first'").select(F.col("part").alias("next_part"), F.col("text").alias("next_text")), "next_part")

    def finish(batches):
        made = Fingerprints(at.value)
        for b in batches:
            yield _batch([_row(made, n, a, made.of(a), z, made.of(z)) for n, a, z in zip(*[c.to_pylist() for c in b.columns], strict=True)])

    ends = pairs.select("doc_id", "text", "next_text").mapInArrow(finish, _ROW)
    rows = rows.where("edge is null").drop("part", "edge", "text").unionByName(ends)
    return rows.withColumns({c: F.lower(F.hex(c)) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")})


def op2_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return edited_likeness(docs, lexicon(docs))
