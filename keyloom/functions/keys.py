"""Keys as columns: text forms, prefixes, and arithmetic on bytes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyloom.schema import key_text

MOST_BYTES = 1024
#: Bytes of a fraction; more don't change a double.
FRACTION_BYTES = 12


def iso_time(at: Column) -> Column:
    """An instant with 0, 3 or 6 digits of fraction; empty for none or 1970-01-01T00:00:00Z."""
    at = at.cast("timestamp")
    us = F.unix_micros(at)
    form = F.when(us % 1_000_000 == 0, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    form = form.when(us % 1_000 == 0, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")).otherwise(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    return F.when(us.isNull() | (us == 0), "").otherwise(form)


def escape_controls(text: Column) -> Column:
    """Control characters as \\xHH. Texts without any, the usual case, aren't rewritten."""
    controls = [*range(0x20), 0x7F]
    escaped = reduce(lambda c, b: F.replace(c, F.lit(chr(b)), F.lit(f"\\x{b:02X}")), controls, text)
    return F.when(text.rlike(r"[\x00-\x1F\x7F]"), escaped).otherwise(text)


def percent_encode(key: Column) -> Column:
    """Each byte that isn't a letter, a digit or one of / - _ . as %HH."""
    pairs = F.regexp_replace(F.hex(key), "(..)", "%$1")
    plain = [*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *b"/-_."]
    decoded = reduce(lambda c, b: F.replace(c, F.lit(f"%{b:02X}"), F.lit(chr(b))), plain, pairs)
    return F.when(key.cast("string").rlike(r"^[A-Za-z0-9/_.\-]*$"), key.cast("string")).otherwise(decoded)


def token(key: Column, inclusive: bool = False) -> Column:
    """The continuation token of a page that starts after (or at) a key."""
    raw = F.concat(F.lit(bytes([inclusive])), key.cast("binary"))
    return F.concat(F.lit("v2:"), F.translate(F.rtrim(F.base64(raw), F.lit("=")), "+/", "-_"))


def token_key(token_: Column) -> Column:
    """The key of a token."""
    body = F.translate(F.substring(token_, 4, 1 << 20), "-_", "+/")
    full = F.rpad(body, (F.ceil(F.length(body) / 4) * 4).cast("int"), F.lit("="))
    return F.substring(F.unbase64(full), 2, MOST_BYTES + 1)


def xml_text(text: Column) -> Column:
    pairs = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")]
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), pairs, text)


def hex_prefix(a: Column, b: Column) -> Column:
    """Bytes that two keys begin with alike.

    By bisection on the hex forms: is the first half of what is left equal? Eleven steps reach 2047 bytes.
    """
    a, b = F.hex(a), F.hex(b)

    def longer(found: Column, step: Column) -> Column:
        n = (found + step) * 2
        same = (F.length(a) >= n) & (F.length(b) >= n) & (F.substr(a, F.lit(1), n) == F.substr(b, F.lit(1), n))
        return F.when(same, found + step).otherwise(found)

    return F.aggregate(F.array(*[F.lit(2**i) for i in range(10, -1, -1)]), F.lit(0), longer)


def byte_at(key: Column, i: Column) -> Column:
    """The byte at a place (from 0); 0 behind the end."""
    return F.coalesce(F.conv(F.nullif(F.substr(F.hex(key), (i * 2 + 1).cast("int"), F.lit(2)), F.lit("")), 16, 10).cast("int"), F.lit(0))


def fraction(key: Column, skip: Column | int = 0, count: int = FRACTION_BYTES) -> Column:
    """Bytes from a place on as a base-256 fraction."""
    skip = F.lit(skip) if isinstance(skip, int) else skip
    return reduce(lambda x, y: x + y, [byte_at(key, skip + i).cast("double") / F.lit(256.0 ** (i + 1)) for i in range(count)])


def fraction_in(key: Column, low: Column, high: Column) -> Column:
    """How far a key lies in (low, high]: 0 at low, 1 at high."""
    skip = hex_prefix(low, high)
    a, b, k = (fraction(c, skip) for c in (low, high, key))
    return F.when(b <= a, 0.0).otherwise(F.least(F.greatest((k - a) / (b - a), F.lit(0.0)), F.lit(1.0)))


def common_prefix(key: Column, prefix: bytes, delimiter: bytes) -> Column:
    """The key up to and with the first delimiter behind the prefix; null if there is none."""
    n = len(prefix)
    rest = F.substring(key, n + 1, 1 << 20)
    at = F.position(F.lit(delimiter), rest)
    return F.when(at > 0, F.substr(key, F.lit(1), (at + n + len(delimiter) - 1).cast("int")))


def family(key: Column) -> Column:
    """The first part of a key with long numbers as N."""
    return F.regexp_replace(F.split_part(key_text(key), F.lit("/"), F.lit(1)), r"\d{6,}", "N")


def successor(key: Column) -> Column:
    """The least key above all that begin with the given one; null for none."""
    body = F.regexp_replace(F.regexp_replace(F.hex(key), "(..)", "$1,"), "(?:FF,)*$", "")
    n = F.length(body)
    last = F.lpad(F.hex(F.conv(F.substr(body, (n - 2).cast("int"), F.lit(2)), 16, 10).cast("bigint") + 1), 2, "0")
    return F.when(n > 0, F.unhex(F.concat(F.replace(F.substr(body, F.lit(1), (n - 3).cast("int")), F.lit(","), F.lit("")), last)))


def _safe(c: int) -> bool:
    """Characters that may be put into a made-up key: no controls, no %, no surrogates or noncharacters."""
    return 0x20 <= c < 0x110000 and not 0x7F <= c <= 0x9F and c != 0x25 and not 0xD800 <= c < 0xE000 and not 0xFDD0 <= c < 0xFDF0 and c & 0xFFFE != 0xFFFE


def between(low: bytes, high: bytes, share: float = 0.5) -> bytes | None:
    """A key strictly between two keys, of safe characters behind what they share; None if there is none.

    At the first character that differs one in the gap is taken, at the given share of the way; where
    the gap is empty, low is kept and a character goes behind it.
    """
    try:
        a, b = low.decode(), high.decode()
    except UnicodeDecodeError:
        return None
    n = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    left, right = (ord(a[n]) if n < len(a) else -1), (ord(b[n]) if n < len(b) else 0x110000)
    target = left + max(1, round((right - left) * share))
    for c in sorted({target, *range(max(0, target - 80), min(0x110000, target + 80)), left + 1, 0x20, 0x21}, key=lambda c: abs(c - target)):
        if left < c < right and _safe(c):
            made = (a[:n] + chr(c)).encode()
            if low < made < high and len(made) <= MOST_BYTES:
                return made
    for c in ("O", "!", " "):
        made = low + c.encode()
        if low < made < high and len(made) <= MOST_BYTES:
            return made
    # nothing fits behind low: raise its last character that can be raised to a safe one, and end there
    for i in range(len(a) - 1, -1, -1):
        c = next((x for x in range(ord(a[i]) + 1, min(ord(a[i]) + 3000, 0x110000)) if _safe(x)), None)
        made = None if c is None else (a[:i] + chr(c)).encode()
        if made and low < made < high and len(made) <= MOST_BYTES:
            return made
    return None


@F.pandas_udf(T.BinaryType())
def interpolate(rows: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """between() of two columns at a share of the way, kept inside (0, 1); null where a bound is null or they leave no room."""
    for low, high, share in rows:
        yield pd.Series([between(bytes(a), bytes(b), min(1 - 1e-9, max(1e-9, float(s)))) if a is not None and b is not None and a < b else None for a, b, s in zip(low, high, share, strict=True)], dtype=object)


def _times(a: Column, b: int) -> Column:
    """a * b modulo 2^64, from products of 32 by 16 bits, none of which overflows."""
    low32, zero = F.lit(0xFFFFFFFF), F.lit(0).cast("bigint")
    low, high = zero, zero
    for x in (0, 1):
        half = F.shiftrightunsigned(a, 32 * x).bitwiseAND(low32)
        for i in range(4):
            p, at = half * F.lit(b >> (16 * i) & 0xFFFF), 32 * x + 16 * i
            if at < 32:
                low = low + F.shiftleft(p, at).bitwiseAND(low32)
                high = high + F.shiftrightunsigned(p, 32 - at)
            elif at < 64:
                high = high + F.shiftleft(p, at - 32).bitwiseAND(low32)
    high = (high + F.shiftrightunsigned(low, 32)).bitwiseAND(low32)
    return F.shiftleft(high, 32).bitwiseOR(low.bitwiseAND(low32))


def mix64(z: Column) -> Column:
    """The finishing step of the published SplitMix64 generator, on 64 bits."""
    for shift, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):  # fixed values of that generator
        z = _times(z.bitwiseXOR(F.shiftrightunsigned(z, shift)), times)
    return z.bitwiseXOR(F.shiftrightunsigned(z, 31))


def _crc_table() -> np.ndarray:
    """Remainders of all bytes by Castagnoli's polynomial, bits reversed."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0x82F63B78), t >> 1).astype(np.uint32)
    return t


def crc32c_of(values: list[bytes]) -> np.ndarray:
    """CRC-32C of byte strings, one byte of all of them at a time."""
    table, size = _crc_table(), np.array([len(v) for v in values], np.int64)
    order = np.argsort(-size, kind="stable")
    data, start = np.frombuffer(b"".join(values), np.uint8), np.cumsum(size) - size
    crc = np.full(len(values), 0xFFFFFFFF, np.uint32)
    for i in range(int(size.max()) if len(size) else 0):
        rows = order[: np.searchsorted(-size[order], -i, side="left")]  # those longer than i
        crc[rows] = table[(crc[rows] ^ data[start[rows] + i]) & 0xFF] ^ (crc[rows] >> np.uint32(8))
    return crc ^ np.uint32(0xFFFFFFFF)


@F.pandas_udf(T.LongType())
def crc32c(column: pd.Series) -> pd.Series:
    """CRC-32C as an unsigned number; null for null."""
    have = column.notna().to_numpy()
    out = pd.Series([None] * len(column), dtype="Int64")
    out[have] = crc32c_of([bytes(v) for v in column[have]]).astype(np.int64)
    return out


@F.pandas_udf(T.BinaryType())
def midpoint(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """between() of two columns."""
    for low, high in pairs:
        yield pd.Series([between(bytes(a), bytes(b)) if a is not None and b is not None and a < b else None for a, b in zip(low, high, strict=True)], dtype=object)


@F.pandas_udf(T.BinaryType())
def ahead(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """A key as far ahead of the second as the second is of the first, below the end of their range; null if none."""

    def one(start: bytes, at: bytes) -> bytes | None:
        skip = next((i for i, (x, y) in enumerate(zip(start, at, strict=False)) if x != y), min(len(start), len(at)))
        width = 4
        value = lambda k: int.from_bytes(k[skip : skip + width].ljust(width, b"\0"), "big")
        to = 2 * value(at) - value(start)
        if to <= value(at) or to >= 256**width:
            return None
        text = to.to_bytes(width, "big")
        made = at[:skip] + bytes(c if _safe(c) and c < 0x7F else 0x7E if c > 0x7E else 0x20 for c in text)
        return made if made > at else None

    for start, at in pairs:
        yield pd.Series([one(bytes(a), bytes(b)) if a is not None and b is not None and a < b else None for a, b in zip(start, at, strict=True)], dtype=object)
