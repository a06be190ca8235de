"""Burrows-Wheeler transforms of collections of byte strings, and their merge by interleave refinement."""

from __future__ import annotations

import numpy as np

#: Bytes of a suffix in its first sort key.
_FIRST = 7


class Transform:
    """A shard's suffixes in order, to a depth of ``depth`` at least: symbols (what stands before each, 0 for a string's begin, else its byte + 1; UTF-8 has no byte 255), back (the rank of the suffix that begins there), key (the first _FIRST bytes), at (places in the shard), rank (of each place)."""

    def __init__(self, symbols: np.ndarray, back: np.ndarray, key: np.ndarray, at: np.ndarray, rank: np.ndarray):
        self.symbols, self.back, self.key, self.at, self.rank = symbols, back, key, at, rank


def build(strings: list[bytes], depth: int) -> Transform:
    """One shard, by prefix doubling. Ends are smaller than bytes, each differs from all others."""
    n = sum(map(len, strings)) + len(strings)
    size = np.array([len(s) for s in strings])
    ends = np.cumsum(size + 1) - 1
    t = np.zeros(n + _FIRST, np.uint8)
    mask = np.ones(n, bool)
    mask[ends] = False
    t[:n][mask] = np.frombuffer(b"".join(strings), np.uint8).astype(np.uint8) + np.uint8(1)
    # a suffix of fewer than _FIRST bytes is padded with zeros; what follows its end must not count
    left = np.repeat(ends, size + 1) - np.arange(n)
    key = np.zeros(n, np.uint64)
    for j in range(_FIRST):
        key = key * np.uint64(257) + np.where(left > j, t[j : n + j], 0).astype(np.uint64)
    rank = _ranks(key)
    # ends in their order, before all else; a shorter suffix is told from another by its own end
    rank[ends] = np.arange(len(ends)) - len(ends)
    k = _FIRST
    while k < depth:
        nxt = rank[np.minimum(np.arange(n) + np.minimum(left, k), n - 1)] + len(ends)
        rank_all = (rank + len(ends)).astype(np.int64) * (n + len(ends) + 1) + nxt
        rank_all[ends] = np.arange(len(ends))
        rank = _ranks(rank_all)
        rank -= len(ends)
        k *= 2
    order = np.argsort(rank, kind="stable")
    place = np.empty(n, np.int32)
    place[order] = np.arange(n, dtype=np.int32)
    before = np.concatenate([[0], t[: n - 1]]).astype(np.uint8)
    back = np.concatenate([[0], place[: n - 1]]).astype(np.int32)
    return Transform(before[order], back[order], key[order], order, place)


def _ranks(key: np.ndarray) -> np.ndarray:
    order = np.argsort(key, kind="stable")
    s = key[order]
    rank = np.empty(len(key), np.int64)
    rank[order] = np.cumsum(np.concatenate([[0], (s[1:] != s[:-1]).astype(np.int64)])) if len(s) else 0
    return rank


def merge(shards: list[Transform], windows: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of ``depth`` bytes (places in each shard) that occur more than once: shard, place and number of the interval of equal ones.

    The interleave says which shard's suffix, at which rank, comes next. It begins with the order of the
    first bytes, which each shard's transform has, for the suffixes that end the windows. Reading the
    transforms in the order of the first k bytes and sorting stably by symbol gives the order of the
    first k + 1; an interval splits where symbols differ, or where what follows did: that is where the
    common prefix is k long. An interval of one suffix is a window that doesn't repeat and leaves, so
    nothing is sorted again that the shards or an earlier step have told apart.
    """
    first = min(_FIRST, depth)
    begin = np.cumsum([0] + [len(s.at) for s in shards])
    symbols = np.concatenate([s.symbols for s in shards])
    back = np.concatenate([s.back + np.int32(b) for s, b in zip(shards, begin, strict=False)]).astype(np.int32)
    at = np.concatenate([s.rank[w + depth - first] + b for s, w, b in zip(shards, windows, begin, strict=False)]).astype(np.int32)
    key = np.concatenate([s.key for s in shards])[at] // np.uint64(257 ** (_FIRST - first))
    order = np.argsort(key, kind="stable")
    at, number = _repeated(at[order], key[order])
    for _ in range(depth - first):
        s = symbols[at]
        order = np.argsort(s, kind="stable")
        at, s, was = back[at[order]], s[order], number[order]
        new = np.ones(len(at), bool)
        new[1:] = (s[1:] != s[:-1]) | (was[1:] != was[:-1])
        at, number = _repeated(at, np.cumsum(new, dtype=np.int32))
    shard = np.searchsorted(begin, at, side="right") - 1
    places = np.concatenate([s.at for s in shards]) if shards else np.zeros(0, np.int64)
    return shard, places[at], number


def _repeated(at: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes whose interval has more than one."""
    if not len(at):
        return at, np.zeros(0, np.int32)
    first = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]]))
    size = np.diff(np.append(first, len(at)))
    many = np.repeat(size > 1, size)
    return at[many], np.repeat(np.arange(len(size), dtype=np.int32), size)[many]


def intervals(strings: list[bytes], depth: int, shard: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in the joined text (each string followed by its end) of windows that occur more than once, and their intervals; shards are of about ``shard`` bytes."""
    made, windows, base, some, size = [], [], [0], [], 0
    for i, s in enumerate(strings):
        some.append(s)
        size += len(s) + 1
        if size >= shard or i == len(strings) - 1:
            made.append(build(some, depth))
            n = np.array([len(x) for x in some])
            start = np.cumsum(n + 1) - n - 1
            count = np.maximum(n - depth + 1, 0)
            windows.append(np.repeat(start - (np.cumsum(count) - count), count) + np.arange(int(count.sum())))
            base.append(base[-1] + size)
            some, size = [], 0
    if not made:
        return np.zeros(0, np.int64), np.zeros(0, np.int32)
    which, at, number = merge(made, windows, depth)
    return at + np.array(base)[which], number
