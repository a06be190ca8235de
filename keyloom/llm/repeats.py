"""Removal of repeated byte strings by merged Burrows-Wheeler transforms; exact.

A byte goes if it lies in a ``LENGTH``-byte window that also starts earlier (smaller doc_id, or in
the same document before). Transforms of a whole corpus would be merged over all its bytes, so first
everything that can't repeat is left out, without loss:

* Of equal texts only the first is looked at; the others go whole (if a window fits in).
* A window's anchor is the run of ``GRAM`` bytes with the least hash in it. Equal windows have equal
  anchors, so only stretches whose anchor occurs twice are looked at.
* Equal stretches (anchor, place of the anchor, bytes) are windows that repeat one for one: all but
  the first go, in each task before the shuffle and then by anchor.
* What is left are different stretches around the same anchor. They meet by anchor; those that share
  neither the bytes before it nor those behind it with another stretch share no window; about ``SHARD``
  bytes at a time become transforms, which are merged by interleave refinement; its intervals of a
  common prefix of LENGTH are the repeated windows, of which all but the earliest go.

Stretches of one anchor that are more than ``MOST`` bytes are not collected: their windows' digests
are dealt out, and a window goes if its digest was met before.

Nulls and the like: a null text is empty; rows of one id and text are one document and have the same
result; a null id comes first; different texts of one id follow in order of their digests. An empty
table gives no rows. Extra columns are left out.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm.bwt import intervals
from keyloom.llm.common import ship, stash, table, unpacker
from keyloom.llm.shingles import mix, powers

LENGTH, GRAM = 100, 32
PIECE, SHARD, BATCH, MOST = 1 << 20, 1 << 20, 2 << 20, 24 << 20
_REACH = LENGTH - GRAM + 1
_SIDE = (LENGTH - GRAM + 1) // 2
_PLACE_BITS = 22
#: Local stretches remembered before they are sent on.
_HELD = 40_000
NULL_ID = -(1 << 63)
_EMPTY = hashlib.sha256(b"").digest()


def anchors(texts: list[bytes]) -> dict[str, np.ndarray]:
    """Runs of window starts with one anchor: doc (index), low, high (starts, both in), at (anchor's place), hash."""
    out = {k: [np.zeros(0, np.int64)] for k in ("doc", "low", "high", "at")} | {"hash": [np.zeros(0, np.uint64)]}
    pieces, size = [], 0

    def flush():
        nonlocal size
        if pieces:
            for k, v in _anchors(pieces).items():
                out[k].append(v)
        pieces.clear()
        size = 0

    for i, t in enumerate(texts):
        for at in range(0, max(len(t) - LENGTH + 1, 0), PIECE):  # windows of a long text are dealt with in pieces
            pieces.append((i, at, t[at : at + PIECE + LENGTH - 1]))
            size += len(pieces[-1][2])
            if size >= PIECE:
                flush()
    flush()
    return {k: np.concatenate(v) for k, v in out.items()}


def _anchors(pieces: list[tuple[int, int, bytes]]) -> dict[str, np.ndarray]:
    a = np.frombuffer(b"".join(p for _, _, p in pieces), np.uint8)
    up, down = powers(len(a) + 1)
    upto = np.concatenate([[np.uint64(0)], np.cumsum((a.astype(np.uint64) + np.uint64(1)) * up[: len(a)], dtype=np.uint64)])
    n = len(a) - GRAM + 1
    h = mix((upto[GRAM:] - upto[:-GRAM]) * down[:n])
    low_bits = np.uint64((1 << _PLACE_BITS) - 1)
    key = (h & ~low_bits) | np.arange(n, dtype=np.uint64)
    # least of every _REACH keys: of a block's end and the next block's begin
    blocks = -(-n // _REACH) + 1
    full = np.full(blocks * _REACH, np.iinfo(np.uint64).max)
    full[:n] = key
    grid = full.reshape(blocks, _REACH)
    begin = np.minimum.accumulate(grid, 1).ravel()
    end = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
    windows = len(a) - LENGTH + 1
    anchor = (np.minimum(end[:windows], begin[_REACH - 1 : _REACH - 1 + windows]) & low_bits).astype(np.int64)
    size = np.array([len(p) for _, _, p in pieces])
    start = np.cumsum(size) - size
    piece = np.repeat(np.arange(len(pieces)), size)[:windows]
    inside = np.arange(windows) + LENGTH <= (start + size)[piece]
    s = np.flatnonzero(inside)
    anchor, piece = anchor[s], piece[s]
    new = np.ones(len(s), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (piece[1:] != piece[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(s)) - 1
    p = piece[first]
    shift = np.array([at for _, at, _ in pieces])[p] - start[p]
    return {"doc": np.array([i for i, _, _ in pieces])[p], "low": s[first] + shift, "high": s[last] + shift, "at": anchor[first] + shift, "hash": h[anchor[first]]}


def _rows(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(columns)


def _key(digest: bytes) -> int:
    """A text's key where its anchors are counted: the first 64 bits of its digest."""
    return int.from_bytes(digest[:8], "big", signed=True)


def anchor_table(docs: DataFrame) -> DataFrame:
    """hash, key (of the text), twice (in this text): once for each anchor of each text; of equal texts once a task."""

    def run(batches):
        seen: set[bytes] = set()
        for b in batches:
            keys, texts = [], []
            for x in b.column(0).to_pylist():
                t = (x or "").encode("utf-8", "surrogatepass")
                if len(t) < LENGTH or (d := hashlib.md5(t).digest()) in seen:
                    continue
                seen.add(d)
                keys.append(_key(d))
                texts.append(t)
            if len(seen) > 500_000:
                seen.clear()
            got = anchors(texts)
            order = np.lexsort((got["hash"], got["doc"]))
            h, doc = got["hash"][order], got["doc"][order]
            first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])) if len(h) else np.zeros(0, np.int64)
            times = np.diff(np.append(first, len(h)))
            yield _rows(hash=pa.array(h[first].view(np.int64)), key=pa.array(np.array(keys, np.int64)[doc[first]] if keys else np.zeros(0, np.int64)), twice=pa.array(times > 1))

    return docs.select("text").mapInArrow(run, "hash bigint, key bigint, twice boolean")


def repeated_anchors(found: DataFrame) -> DataFrame:
    """key, hash of anchors that occur twice in all, in one text or in two that differ."""

    def run(batches):
        held = None  # the first row of the last hash, not yet known to repeat
        last = of = None
        for b in batches:
            h, d, t = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            if not len(h):
                continue
            other = np.ones(len(h), bool)  # not the text before, read by another task
            other[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
            other[0] = h[0] != last or d[0] != of
            h, d, t = h[other], d[other], t[other]
            if not len(h):
                continue
            new = np.ones(len(h), bool)
            new[1:] = h[1:] != h[:-1]
            new[0] = h[0] != last
            more = np.ones(len(h), bool)  # the next row has the same hash
            more[:-1] = ~new[1:]
            more[-1] = False
            out = (~new) | t | more
            keys, hashes = [d[out]], [h[out]]
            if held is not None and not new[0]:
                keys.append(np.array([held], np.int64))
                hashes.append(np.array([last], np.int64))
            if new[-1] and not out[-1]:
                held = d[-1]
            elif new.any() or not new[0]:
                held = None
            last, of = h[-1], d[-1]
            yield _rows(key=pa.array(np.concatenate(keys)), hash=pa.array(np.concatenate(hashes)))

    return found.repartition("hash").sortWithinPartitions("hash", "key").mapInArrow(run, "key bigint, hash bigint")


#: kind 0: a finished document; 1: a stretch; 2: windows low to high go; 3: a document's packed text; 4: another row of that document
_PARTS = "kind int, doc_id bigint, digest binary, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary, hash bigint, low bigint, high bigint, place bigint, bytes binary"
_TYPES = [pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
_NAMES = [x.split()[0] for x in _PARTS.split(", ")]


def _parts(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(_NAMES)
    return pa.RecordBatch.from_pydict({n: pa.array(list(c), k) for n, c, k in zip(_NAMES, columns, _TYPES, strict=True)})


def _packed(docs: DataFrame) -> DataFrame:
    """doc_id, key, digest (of the text), n_bytes, z: the packed text, of equal ones only the first in a task."""

    def run(batches):
        seen: set[bytes] = set()
        pack = zstandard.ZstdCompressor(level=3).compress
        for b in batches:
            texts = [(x or "").encode("utf-8", "surrogatepass") for x in b.column(1).to_pylist()]
            digests = [hashlib.md5(t).digest() for t in texts]
            # short texts are nobody's copies, so they need not meet
            keys = [_key(d) if len(t) >= LENGTH else name for name, t, d in zip(b.column(0).to_pylist(), texts, digests, strict=True)]
            z = []
            for t, d in zip(texts, digests, strict=True):
                z.append(None if d in seen else pack(t))
                if len(t) >= LENGTH:
                    seen.add(d)
            if len(seen) > 500_000:
                seen.clear()
            yield _rows(doc_id=b.column(0), key=pa.array(keys, pa.int64()), digest=pa.array(digests, pa.binary()), n_bytes=pa.array(map(len, texts), pa.int64()), z=pa.array(z, pa.binary()))

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, key bigint, digest binary, n_bytes bigint, z binary")


def stretches(docs: DataFrame) -> DataFrame:
    """docs: doc_id, z, digest, n_bytes, hashes, by digest and doc_id -> parts of the kinds above.

    Of a digest's rows the first is the document; rows of the same id repeat it and others are copies.
    One of them at least has z, not always the first.
    """

    def run(batches):
        unpack = unpacker()
        held: dict[tuple, tuple] = {}

        def stretch(key, v) -> tuple:
            return (1, v[0], v[1], None, None, None, None, key[0], v[2], v[2] + v[3], key[1], v[4])

        digest = owner = again = None  # again: what another row of the document gives, once its text was there
        waiting = 0  # rows of the document before that
        for b in batches:
            names, zs, digests, sizes, hashes = (b.column(i) for i in range(5))
            out, texts, owners = [], [], []
            for i, (name, d, size) in enumerate(zip(names.to_pylist(), digests.to_pylist(), sizes.to_pylist(), strict=True)):
                if size < LENGTH:
                    out.append((0, name, d, size, 0, 0, hashlib.sha256(unpack(zs[i].as_py())).digest(), *[None] * 5))
                    continue
                if d != digest:
                    digest, owner, again, waiting = d, name, None, 0
                if name != owner:
                    out.append((0, name, d, size, size, 1, _EMPTY, *[None] * 5))
                elif again is None:
                    waiting += 1
                else:
                    out.append(again)
                if again is None and zs[i].is_valid:
                    z = zs[i].as_py()
                    t = unpack(z)
                    if hashes[i].is_valid:
                        again = (4, owner, d, *[None] * 9)
                        out.append((3, owner, d, size, *[None] * 7, z))
                        texts.append(t)
                        owners.append((owner, d, hashes[i].values.to_numpy()))
                    else:
                        again = (0, owner, d, size, 0, 0, hashlib.sha256(t).digest(), *[None] * 5)
                        out.append(again)
                    out += [again] * (waiting - 1)
            got = anchors(texts)
            cut = np.searchsorted(got["doc"], np.arange(len(texts) + 1))
            for j, (name, digest, wanted) in enumerate(owners):
                mine = slice(cut[j], cut[j + 1])
                h = got["hash"][mine].view(np.int64)
                t = texts[j]
                for k in np.flatnonzero(np.isin(h, wanted)).tolist():
                    low, high, at = (int(got[c][mine][k]) for c in ("low", "high", "at"))
                    s = t[low : high + LENGTH]
                    key = (int(h[k]), at - low, xxhash.xxh3_128_digest(s))
                    now = (name, digest, low, high - low, s)
                    old = held.get(key)
                    if old is None:
                        held[key] = now
                    else:
                        if now[:3] < old[:3]:
                            held[key], now = now, old
                        out.append((2, now[0], now[1], None, None, None, None, None, now[2], now[2] + now[3], None, None))
            if len(held) > _HELD:
                out += [stretch(k, v) for k, v in held.items()]
                held.clear()
            yield _parts(out)
        yield _parts([stretch(k, v) for k, v in held.items()])

    return docs.mapInArrow(run, _PARTS)


def _merged(batch: list[tuple]) -> list[tuple]:
    """Stretches (doc_id, digest, low, bytes) -> runs (doc_id, digest, first start, last start) of windows that also start earlier."""
    batch.sort(key=lambda r: r[:3])
    at, number = intervals([r[3] for r in batch], LENGTH, SHARD)
    size = np.array([len(r[3]) + 1 for r in batch])
    start = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(batch)), size)
    # places in the joined text rise with document and start, but for overlaps within a document, where starts say it
    low = np.array([r[2] for r in batch])
    same = {}
    rank = np.array([same.setdefault(r[:2], len(same)) for r in batch])
    o = owner[at]
    order = np.lexsort((low[o] + at - start[o], rank[o], number))
    at, number, o = at[order], number[order], o[order]
    again = np.zeros(len(at), bool)
    again[1:] = number[1:] == number[:-1]
    gone = np.zeros(int(size.sum()), bool)
    gone[at[again]] = True
    # no window starts at a string's end, so runs don't go from one to the next
    edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))).reshape(-1, 2)
    of = owner[edge[:, 0]]
    first, last = (edge[:, 0] - start[of] + low[of]).tolist(), (edge[:, 1] - 1 - start[of] + low[of]).tolist()
    return [(*batch[i][:2], x, y) for i, x, y in zip(of.tolist(), first, last, strict=True)]


def _sharing(group: dict[tuple, tuple]) -> tuple[list[tuple], list[tuple]]:
    """The stretches of one anchor that may share a window, cut to the windows that may, and runs that go already.

    Of a window's bytes outside the anchor at least half are on one side; so it holds the _SIDE bytes
    before the anchor or those behind it. Windows that hold a side nobody else has are cut off. Of
    stretches that are then equal the first stays: the windows of the others start earlier there.
    """
    sides = []
    for place, s in group:
        end = place + GRAM
        sides.append((s[place - _SIDE : place] if place >= _SIDE else None, s[end : end + _SIDE] if len(s) >= end + _SIDE else None))
    left, right = Counter(a for a, _ in sides), Counter(b for _, b in sides)
    rows: dict[tuple, tuple] = {}
    again = []
    for (place, s), (name, digest, low, _), (a, b) in zip(group, group.values(), sides, strict=True):
        begin = max(0, place - _SIDE + 1) if a is not None and left[a] == 1 else 0
        end = place + GRAM + _SIDE - 1 if b is not None and right[b] == 1 else len(s)
        cut = s[begin:end]
        if len(cut) < LENGTH:
            continue
        if (place - begin, cut) in rows:
            again.append((name, digest, low + begin, low + begin + len(cut) - LENGTH))
        else:
            rows[place - begin, cut] = (name, digest, low + begin, cut)
    return (list(rows.values()) if len(rows) > 1 else []), again


def compared(parts: DataFrame) -> DataFrame:
    """Stretches by anchor -> doc_id, digest, low, high: windows that go."""

    def run(batches):
        batch: list[tuple] = []
        size = 0
        group: dict[tuple, tuple] = {}
        now = None
        group_size = 0
        large = False  # an anchor with more than MOST bytes
        out: list[tuple] = []

        def windows(row: tuple) -> None:
            name, digest, low, s = row
            out.extend((name, digest, low + i, low + i, xxhash.xxh3_128_digest(s[i : i + LENGTH])) for i in range(len(s) - LENGTH + 1))

        def close() -> None:
            nonlocal batch, size, group_size, large
            if not large and len(group) > 1:
                rows, again = _sharing(group)
                out.extend((*r, None) for r in again)
                batch += rows
                size += sum(len(r[3]) + 1 for r in rows)
                if size >= BATCH:
                    out.extend((*r, None) for r in _merged(batch))
                    batch, size = [], 0
            group.clear()
            group_size, large = 0, False

        def table() -> pa.RecordBatch:
            c = list(zip(*out, strict=True)) if out else [()] * 5
            got = _rows(doc_id=pa.array(list(c[0]), pa.int64()), digest=pa.array(list(c[1]), pa.binary()), low=pa.array(list(c[2]), pa.int64()), high=pa.array(list(c[3]), pa.int64()), window=pa.array(list(c[4]), pa.binary()))
            out.clear()
            return got

        for b in batches:
            for h, name, digest, low, place, s in zip(*[b.column(i).to_pylist() for i in range(6)], strict=True):
                if h != now:
                    close()
                    now = h
                key = (place, s)
                if large:
                    windows((name, digest, low, s))
                    if len(out) > _HELD:
                        yield table()
                elif key in group:
                    out.append((name, digest, low, low + len(s) - LENGTH, None))
                else:
                    group[key] = (name, digest, low, s)
                    group_size += len(s) + 1
                    if group_size > MOST:
                        large = True
                        for row in group.values():
                            windows(row)
                            if len(out) > _HELD:
                                yield table()
                        group.clear()
            yield table()
        close()
        if batch:
            out.extend((*r, None) for r in _merged(batch))
        yield table()

    def again(batches):
        """Windows of large anchors by digest and place: all but the first of each."""
        last = None
        for b in batches:
            w = b.column(4).to_pylist()
            yield b.select(["doc_id", "digest", "low", "high"]).filter(pa.array([x == y for x, y in zip([last, *w], w, strict=False)], pa.bool_()))
            last = w[-1] if w else last

    rows = parts.where("kind = 1").select("hash", "doc_id", "digest", "low", "place", "bytes")
    kind = "doc_id bigint, digest binary, low bigint, high bigint"
    found = stash(rows.repartition("hash").sortWithinPartitions("hash", "doc_id", "digest", "low").mapInArrow(run, f"{kind}, window binary"), "compared")
    dealt = found.where("window is not null").repartition("window").sortWithinPartitions("window", "doc_id", "digest", "low")
    return found.where("window is null").drop("window").unionByName(dealt.mapInArrow(again, kind))


def _finish(batches):
    """doc_id, z, runs (array of low, high), more -> the document's row, and as many more of the same."""
    unpack = unpacker()
    for b in batches:
        out = []
        for name, z, runs, more in zip(b.column(0).to_pylist(), b.column(1), b.column(2), b.column(3).to_pylist(), strict=True):
            t = unpack(z.as_py())
            go = np.zeros(len(t) + 1, np.int64)
            if runs.is_valid:
                low, high = runs.values.field(0).to_numpy(), runs.values.field(1).to_numpy()
                np.add.at(go, low, 1)
                np.add.at(go, high + LENGTH, -1)
            gone = np.cumsum(go)[: len(t)] > 0
            a = np.frombuffer(t, np.uint8)
            spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0]) if len(t) else 0
            out += [(name, len(t), int(gone.sum()), spans, hashlib.sha256(a[~gone].tobytes()).digest())] * (1 + more)
        c = list(zip(*out, strict=True)) if out else [()] * 5
        yield _rows(doc_id=pa.array(list(c[0]), pa.int64()), n_bytes=pa.array(list(c[1]), pa.int64()), n_removed=pa.array(list(c[2]), pa.int64()), n_spans=pa.array(list(c[3]), pa.int64()), kept=pa.array(list(c[4]), pa.binary()))


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    ship(docs.sparkSession)
    docs = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NULL_ID)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    wanted = repeated_anchors(anchor_table(docs)).groupBy("key").agg(F.collect_set("hash").alias("hashes"))
    # anchors are of texts, whichever row of equal ones a task read; all rows of a text meet in one task
    joined = _packed(docs).repartition("key").join(wanted, "key", "left")
    rows = joined.sortWithinPartitions("digest", "doc_id").select("doc_id", "z", "digest", "n_bytes", "hashes")
    parts = stash(stretches(rows), "stretches")
    gone = parts.where("kind in (2, 4)").select("doc_id", "digest", "low", "high").unionByName(compared(parts))
    runs = gone.groupBy("doc_id", "digest").agg(F.collect_list(F.when(F.col("low").isNotNull(), F.struct("low", "high"))).alias("runs"), F.count_if(F.col("low").isNull()).alias("more"))
    texts = parts.where("kind = 3").select("doc_id", "digest", F.col("bytes").alias("z"))
    rest = texts.join(runs, ["doc_id", "digest"], "left").select("doc_id", "z", "runs", F.coalesce("more", F.lit(0)).alias("more")).mapInArrow(_finish, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")
    done = parts.where("kind = 0").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept").unionByName(rest)
    return done.select(F.when(F.col("doc_id") != NULL_ID, F.col("doc_id")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.lower(F.hex("kept")).alias("kept_sha256"))


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents"))
