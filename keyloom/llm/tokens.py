"""Token-ID output in patched frame-of-reference blocks.

A shard is the image of one file: a header, a block index, a document table and blocks of 128 ids.
A block stores its minimum, the ids minus it packed at a width, and exceptions: position and full
difference of each id that doesn't fit. The width is that of a percentile of the differences, the
cheapest of ``PERCENTILES``. Any block can be read alone through the index.

``write_shards`` range-partitions documents by id, encodes each partition in order and writes shards
as rows of a Parquet table (Spark's committer makes lost executors harmless; ``export_shards`` puts
the same images into plain files). A row tells its partition and the ids before it there; adding the
ids of earlier partitions (a row each) gives global starts. ``read_shards`` decodes.

Nulls and ties: a null or empty text is only its end id, null ids come first, rows of one id follow
in order of a hash of their text. Empty tables write no shards. Extra columns are left out.
"""

from __future__ import annotations

import json
import struct
import unicodedata
import zlib
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keyloom.llm.common import partitions, ship, stash_path, table

BLOCK, MAGIC = 128, b"KLPF"
PERCENTILES = (100, 98, 95, 90, 75)
#: A shard ends with the document that brings it to so many ids.
SHARD_IDS = 1 << 20
MOST_CACHED = 500_000
#: What often follows a word; one pre-token.
ENDS = ".,;:!?*$&%#|"
#: header: magic, version, block size, ids, blocks, documents
_HEAD = struct.Struct("<4sHHQII")
#: The vocabulary's pre-tokens.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

_encoders: dict[str, Encoder] = {}


def _stands_for(file: dict) -> bool:
    """Whether a tokenizer file has the normalizer, pre-tokenizer and kind of model that Encoder rebuilds."""
    normal = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
    split = {"type": "Split", "pattern": {"Regex": PIECES}, "behavior": "Removed", "invert": True}
    level = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
    model = {k: v for k, v in file["model"].items() if k not in ("vocab", "merges")}
    plain = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": "</w>", "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}
    added = all(t["content"].startswith("<|") and t["special"] and not t["normalized"] for t in file["added_tokens"])
    return added and file["normalizer"] == {"type": "Sequence", "normalizers": normal} and file["pre_tokenizer"] == {"type": "Sequence", "pretokenizers": [split, level]} and model == plain and not file["truncation"] and not file["post_processor"]


class Encoder(dict):
    """The tokenizers library's ids of a text, remembered by word.

    The vocabulary drops white space and splits at it, so the ids of a text are those of its words
    one after the other. Words are made lower-case and cut into pre-tokens here and given to the
    library's model; those with characters outside Latin, inner white space or the special tokens'
    opening go through the whole library. A file with another normalizer, pre-tokenizer or model than
    the ones this stands for goes through the whole library altogether.
    """

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.known = _stands_for(json.load(f))
        self.model = self.whole.model
        self.find = regex.compile(PIECES).findall
        self.pieces: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        # bytes as the model's alphabet: printable Latin-1 stands for itself, the rest follows from 256 on
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = iter(range(256, 512))
        self.letters = [chr(b) if b in plain else chr(next(rest)) for b in range(256)]

    def __missing__(self, word: str) -> bytes:
        if len(self) >= MOST_CACHED:  # what is still in use comes back from the older half
            self.older = dict(self)
            self.clear()
        out = self.older.get(word)
        if out is None:
            out = self.ids(word)
        if len(word) <= 200:
            self[word] = out
        return out

    def ids(self, word: str) -> bytes:
        if word.isalpha() and (word.isascii() or max(word) < "ɐ"):
            cut = [word]
        elif len(word) > 200 or (not word.isascii() and (max(word) >= "ɐ" or "İ" in word)) or any(c <= " " or c in "<|\x7f\x85\xa0" for c in word):
            return np.array(self.whole.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        else:
            core = word.rstrip(ENDS)
            cut = [core, word[len(core) :]] if core.isalpha() else None
        if cut is None or "İ" in word:
            cut = self.find((word if word.isascii() else unicodedata.normalize("NFC", word)).lower())
        elif not word.isascii():
            cut[0] = unicodedata.normalize("NFC", cut[0])
        return b"".join([self.piece(p.lower()) for p in cut])

    def piece(self, p: str) -> bytes:
        out = self.pieces.get(p)
        if out is None:
            if len(self.pieces) >= MOST_CACHED:
                self.pieces.clear()
            known = p if p.isascii() else "".join(map(self.letters.__getitem__, p.encode()))
            out = self.pieces[p] = array("I", [t.id for t in self.model.tokenize(known)]).tobytes()
        return out

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if not self.known:
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


def encoder(path: str) -> Encoder:
    """One for each Python worker, so that its memory lasts over tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _pack(v: np.ndarray, width: int) -> np.ndarray:
    """(rows, 128) differences below 2^width -> (rows, 2 * width) words of 64 bits."""
    out = np.zeros((2, width, len(v)), np.uint64)
    v = np.ascontiguousarray(v.T).astype(np.uint64)
    for j in range(BLOCK):
        half, at = j >> 6, (j & 63) * width
        k, s = at >> 6, at & 63
        out[half, k] |= v[j] << np.uint64(s)
        if s + width > 64:
            out[half, k + 1] |= v[j] >> np.uint64(64 - s)
    return out.reshape(2 * width, len(v[0])).T


def _unpack(words: np.ndarray, width: int) -> np.ndarray:
    out = np.empty((BLOCK, len(words)), np.uint32)
    w = np.ascontiguousarray(words.T).reshape(2, width, len(words)) if width else None
    mask = np.uint64((1 << width) - 1)
    for j in range(BLOCK):
        if not width:
            out[j] = 0
            continue
        half, at = j >> 6, (j & 63) * width
        k, s = at >> 6, at & 63
        x = w[half, k] >> np.uint64(s)
        if s + width > 64:
            x = x | (w[half, k + 1] << np.uint64(64 - s))
        out[j] = x & mask
    return out.T


def _bits(x: np.ndarray) -> np.ndarray:
    return np.ceil(np.log2(x.astype(np.float64) + 1)).astype(np.int64)


def encode_shard(ids: np.ndarray, docs: list[int | None], counts: list[int]) -> bytes:
    """ids: unsigned 32-bit, all documents' one after the other; counts: ids of each document."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    grid = np.full(blocks * BLOCK, ids[-1] if n else 0, np.uint32)
    grid[:n] = ids
    grid = grid.reshape(blocks, BLOCK)
    least = grid.min(1) if n else np.zeros(0, np.uint32)
    diff = grid - least[:, None]
    order = np.sort(diff, 1)
    best = np.full(blocks, 1 << 30)
    width = np.zeros(blocks, np.int64)
    for p in PERCENTILES:
        w = _bits(order[:, min(BLOCK - 1, -(-BLOCK * p // 100) - 1)])
        over = (diff >= (np.uint64(1) << w.astype(np.uint64))[:, None]).sum(1)
        cost = 16 * w + 5 * over
        width = np.where(cost < best, w, width)
        best = np.minimum(best, cost)
    out_at = np.flatnonzero((diff >= (np.uint64(1) << width.astype(np.uint64))[:, None]).ravel())
    n_out = np.bincount(out_at // BLOCK, minlength=blocks)
    size = 6 + 16 * width + 5 * n_out  # minimum 4, width 1, exceptions 1
    index = np.concatenate([[0], np.cumsum(size)]).astype("<u8")
    body = np.empty(int(index[-1]), np.uint8)
    start = index[:-1].astype(np.int64)
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        low = diff[rows] & np.uint32((1 << int(w)) - 1)
        packed = np.ascontiguousarray(_pack(low, int(w))).astype("<u8").view(np.uint8).reshape(len(rows), -1) if w else np.empty((len(rows), 0), np.uint8)
        head = np.empty((len(rows), 6), np.uint8)
        head[:, :4] = np.ascontiguousarray(least[rows].astype("<u4")).view(np.uint8).reshape(-1, 4)
        head[:, 4], head[:, 5] = w, n_out[rows]
        whole = np.concatenate([head, packed], 1)
        body[start[rows][:, None] + np.arange(whole.shape[1])] = whole
    if len(out_at):
        block, position = out_at // BLOCK, (out_at % BLOCK).astype(np.uint8)
        rank = np.arange(len(out_at)) - np.concatenate([[0], np.cumsum(n_out)])[block]
        at = start[block] + 6 + 16 * width[block]
        body[at + rank] = position
        value = np.ascontiguousarray(diff.ravel()[out_at].astype("<u4")).view(np.uint8).reshape(-1, 4)
        body[(at + n_out[block] + 4 * rank)[:, None] + np.arange(4)] = value
    known = np.array([d is not None for d in docs], np.uint8)
    names = np.array([d or 0 for d in docs], "<i8")
    return b"".join([_HEAD.pack(MAGIC, 1, BLOCK, n, blocks, len(docs)), index.tobytes(), known.tobytes(), names.tobytes(), np.array(counts, "<u4").tobytes(), body.tobytes()])


def decode_shard(image: bytes) -> tuple[np.ndarray, list[int | None], np.ndarray]:
    """-> ids, document ids, ids of each document."""
    magic, version, block, n, blocks, docs = _HEAD.unpack_from(image)
    if (magic, version, block) != (MAGIC, 1, BLOCK):
        raise ValueError("not a shard of this format")
    at = _HEAD.size
    start = np.frombuffer(image, "<u8", blocks + 1, at)[:-1].astype(np.int64)
    at += 8 * (blocks + 1)
    known = np.frombuffer(image, np.uint8, docs, at)
    names = np.frombuffer(image, "<i8", docs, at := at + docs)
    counts = np.frombuffer(image, "<u4", docs, at := at + 8 * docs)
    body = np.frombuffer(image, np.uint8, offset=at + 4 * docs)
    out = np.empty((blocks, BLOCK), np.uint32)
    if blocks:
        head = body[start[:, None] + np.arange(6)]
        least = np.ascontiguousarray(head[:, :4]).view("<u4").ravel()
        width, n_out = head[:, 4].astype(np.int64), head[:, 5].astype(np.int64)
        for w in np.unique(width):
            rows = np.flatnonzero(width == w)
            raw = np.ascontiguousarray(body[(start[rows] + 6)[:, None] + np.arange(16 * w)])
            out[rows] = _unpack(raw.view("<u8").reshape(len(rows), -1) if w else raw, int(w))
        if total := int(n_out.sum()):
            row = np.repeat(np.arange(blocks), n_out)
            rank = np.arange(total) - np.repeat(np.cumsum(n_out) - n_out, n_out)
            first = start[row] + 6 + 16 * width[row]
            value = np.ascontiguousarray(body[(first + n_out[row] + 4 * rank)[:, None] + np.arange(4)]).view("<u4").ravel()
            out[row, body[first + rank]] = value
        out += least[:, None]
    return out.ravel()[:n], [int(d) if k else None for d, k in zip(names, known, strict=True)], counts


def write_shards(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, shard_ids: int = SHARD_IDS) -> None:
    """Write shards of (part, shard, ids_before, n_ids, image) rows in ascending order of document ids."""
    spark = docs.sparkSession
    ship(spark)

    def run(batches):
        encode, part = encoder(tokenizer).encode, TaskContext.get().partitionId()
        end = np.array([end_id], "<u4").tobytes()
        ids, names, counts, size, before, shard = [], [], [], 0, 0, 0

        def row():
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "shard": pa.array([shard], pa.int32()), "ids_before": pa.array([before], pa.int64()), "n_ids": pa.array([size], pa.int64()), "image": pa.array([encode_shard(np.frombuffer(b"".join(ids), "<u4"), names, counts)], pa.binary())})

        for b in batches:
            for name, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                got = encode(text.as_py() or "") + end
                ids.append(got)
                names.append(name)
                counts.append(len(got) // 4)
                size += len(got) // 4
                if size >= shard_ids:
                    yield row()
                    before, shard = before + size, shard + 1
                    ids, names, counts, size = [], [], [], 0
        if names:
            yield row()

    tie = F.xxhash64("text")
    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text")).repartitionByRange(partitions(spark, docs), "doc_id", tie).sortWithinPartitions("doc_id", tie, "text")
    rows.mapInArrow(run, "part int, shard int, ids_before bigint, n_ids bigint, image binary").write.option("compression", "uncompressed").parquet(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the images alone: doc_id, start, n_tokens, ids_crc32, ids (binary, little-endian unsigned 32-bit)."""
    ship(spark)
    shards = spark.read.parquet(path)
    # one row for each partition that wrote
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    bases = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))

    def run(batches):
        for b in batches:
            for part, before, image in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                ids, names, counts = decode_shard(image.as_py())
                ends = np.cumsum(counts, dtype=np.int64)
                raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
                cuts = [raw[4 * (e - c) : 4 * e] for e, c in zip(ends.tolist(), counts.tolist(), strict=True)]
                yield pa.RecordBatch.from_pydict({"part": pa.array([part] * len(names), pa.int32()), "doc_id": pa.array(names, pa.int64()), "before": pa.array(before + ends - counts), "n_tokens": pa.array(counts.astype(np.int64)), "ids_crc32": pa.array([zlib.crc32(c) for c in cuts], pa.int64()), "ids": pa.array([bytes(c) for c in cuts], pa.binary())})

    rows = shards.select("part", "ids_before", "image").mapInArrow(run, "part int, doc_id bigint, before bigint, n_tokens bigint, ids_crc32 bigint, ids binary")
    # bases are as many as range partitions, a few bytes each
    return rows.join(F.broadcast(bases), "part").select("doc_id", (F.col("before") + F.col("base")).alias("start"), "n_tokens", "ids_crc32", "ids")


def export_shards(spark: SparkSession, path: str, folder: str) -> None:
    """The same images as plain files, named by partition and number; the folder must be one that all executors share."""
    ship(spark)

    def run(batches):
        for b in batches:
            for part, shard, image in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                with open(f"{folder}/{part:06d}-{shard:06d}.klpf", "wb") as f:
                    f.write(image.as_py())
            yield pa.RecordBatch.from_pydict({"n": pa.array([b.num_rows], pa.int64())})

    spark.read.parquet(path).select("part", "shard", "image").mapInArrow(run, "n bigint").agg(F.sum("n")).collect()


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def tokens_of(docs: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    path = stash_path(spark, "tokens")
    write_shards(docs, path, tokenizer_path())
    return read_shards(spark, path).drop("ids")


def op3_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens_of(table(spark, sf_dir, "documents"))
