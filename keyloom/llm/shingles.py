"""Sets of hashed five-word shingles for many texts at once, in numpy."""

from __future__ import annotations

import numpy as np

from keyloom.llm.common import SPACE_BYTES

K = 5
#: Bytes handled at a time; a longer text is handled alone.
CHUNK = 1 << 21
_BASE = 0x9E3779B97F4A7C15 | 1
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_PLACE = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[list(SPACE_BYTES)] = True
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK + 4096)
        inverse = pow(_BASE, -1, 1 << 64)
        _powers[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, b, np.uint64)]), dtype=np.uint64) for b in (_BASE, inverse)]
    return _powers[0], _powers[1]


def chunks(texts: list[bytes]):
    """Runs (first, end) of texts of about CHUNK bytes."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) < CHUNK):
            size += len(texts[end]) + 1
            end += 1
        yield at, end
        at = end


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every lower-cased word, and the text it is of."""
    a = _LOWER[np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)]
    space = _SPACE[a]
    first = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    last = np.flatnonzero(~space[:-1] & space[1:]) + 1
    up, down = powers(len(a))
    upto = np.concatenate([[np.uint64(0)], np.cumsum((a.astype(np.uint64) + np.uint64(1)) * up[: len(a)], dtype=np.uint64)])
    h = mix((upto[last] - upto[first]) * down[first] ^ ((last - first).astype(np.uint64) << np.uint64(48)))
    starts = 1 + np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
    return h, np.searchsorted(starts, first, side="right") - 1


def sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after the other, and how many each has."""
    flat, count = [np.zeros(0, np.uint64)], []
    for at, end in chunks(texts):
        h, doc = word_hashes(texts[at:end])
        n = np.bincount(doc, minlength=end - at)
        runs = [h[j : len(h) - K + 1 + j] * _PLACE[j] for j in range(K)] if len(h) >= K else []
        sh = mix(sum(runs)) if runs else np.zeros(0, np.uint64)
        own = doc[: len(sh)]
        inside = own == doc[K - 1 :] if len(sh) else np.zeros(0, bool)
        sh, own = sh[inside], own[inside]
        short = np.flatnonzero((n > 0) & (n < K))
        if len(short):  # the whole sequence is one
            begin = np.cumsum(n) - n
            whole = np.array([mix(np.array([np.add.reduce(h[begin[i] : begin[i] + n[i]] * _PLACE[: n[i]]) ^ np.uint64(n[i])], np.uint64))[0] for i in short], np.uint64)
            sh, own = np.concatenate([sh, whole]), np.concatenate([own, short])
        order = np.lexsort((sh, own))
        sh, own = sh[order], own[order]
        new = np.ones(len(sh), bool)
        new[1:] = (sh[1:] != sh[:-1]) | (own[1:] != own[:-1])
        flat.append(sh[new])
        count.append(np.bincount(own[new], minlength=end - at))
    return np.concatenate(flat), np.concatenate(count) if count else np.zeros(0, np.int64)
