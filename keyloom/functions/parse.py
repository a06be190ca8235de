"""Option texts: sizes, times, durations, addresses, queries, tokens."""

from __future__ import annotations

import base64
import hashlib
import re
from datetime import date, datetime, timezone
from decimal import Decimal, InvalidOperation
from urllib.parse import unquote_to_bytes

_SIZE = re.compile(r"\s*([0-9]*\.?[0-9]+)\s*([KMGTP]?)(?:I?B)?\s*", re.I)
_STEP = re.compile(r"([0-9]+)(ms|s|m|h|d)")
_STEP_MICROS = {"ms": 1_000, "s": 1_000_000, "m": 60_000_000, "h": 3_600_000_000, "d": 86_400_000_000}
_ISO = re.compile(r"P(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+(?:\.\d{1,6})?)S)?)?", re.I)


def parse_size(text: str) -> int:
    """Bytes of '10', '4K', '1.5GiB'; multipliers are binary and the result must be whole."""
    m = _SIZE.fullmatch(text or "")
    if not m:
        raise ValueError(f"not a size: {text!r}")
    try:
        n = Decimal(m[1]) * (1024 ** " KMGTP".index(m[2].upper() or " "))
    except InvalidOperation as e:
        raise ValueError(f"not a size: {text!r}") from e
    if n != n.to_integral_value() or n >= 1 << 63:
        raise ValueError(f"not a whole number of bytes within 63 bits: {text!r}")
    return int(n)


def parse_micros(text: str) -> int:
    """Microseconds of an ISO instant, a local date and time (UTC) or a date (its midnight)."""
    try:
        if re.fullmatch(r"\d{4}-\d{2}-\d{2}", text):
            at = datetime.combine(date.fromisoformat(text), datetime.min.time(), timezone.utc)
        else:
            at = datetime.fromisoformat(text)
            at = at.replace(tzinfo=timezone.utc) if at.tzinfo is None else at
    except (TypeError, ValueError) as e:
        raise ValueError(f"not a time: {text!r}") from e
    d = at - datetime(1970, 1, 1, tzinfo=timezone.utc)
    return (d.days * 86_400 + d.seconds) * 1_000_000 + d.microseconds


def parse_duration(text: str) -> int:
    """Microseconds of '500ms', '30s', '1h30m', 'PT1.5S'."""
    if text and (m := _ISO.fullmatch(text)) and any(m.groups()):
        d, h, mi, s = m.groups()
        return int((Decimal(d or 0) * 86_400 + Decimal(h or 0) * 3_600 + Decimal(mi or 0) * 60 + Decimal(s or 0)) * 1_000_000)
    parts = _STEP.findall(text or "")
    if not parts or "".join(a + b for a, b in parts) != text:
        raise ValueError(f"not a duration: {text!r}")
    return sum(int(a) * _STEP_MICROS[b] for a, b in parts)


def parse_latency(text: str) -> int:
    """Microseconds of '6865ms', '6.9s' or, without a unit, milliseconds."""
    m = re.fullmatch(r"(\d+(?:\.\d+)?)(ms|s)|(\d+)", (text or "").strip().lower())
    if not m:
        raise ValueError(f"not a latency: {text!r}")
    return int(Decimal(m[1]) * (1_000 if m[2] == "ms" else 1_000_000)) if m[1] else int(m[3]) * 1_000


def parse_address(text: str) -> tuple[str, bytes]:
    """Bucket and literal prefix of s3://bucket/prefix."""
    m = re.fullmatch(r"s3://([^/]+)(?:/(.*))?", text or "", re.S)
    if not m:
        raise ValueError(f"not an address: {text!r}")
    return m[1], (m[2] or "").encode()


def parse_query(raw: str) -> dict[str, bytes]:
    """A raw query string; empty values count as absent, + is a space."""
    out: dict[str, bytes] = {}
    for part in filter(None, (raw or "").split("&")):
        name, _, value = part.partition("=")
        if value:
            out[unquote_to_bytes(name).decode()] = unquote_to_bytes(value.replace("+", " "))
    return out


def encode_token(key: bytes, inclusive: bool = False) -> str:
    """Where the next page starts: a flag byte and the key, URL-safe."""
    return "v2:" + base64.urlsafe_b64encode(bytes([inclusive]) + key).rstrip(b"=").decode()


def decode_token(token: str) -> tuple[bytes, bool]:
    """key, inclusive; a token without version is a bare key after which to start."""
    body = token.removeprefix("v2:")
    if not re.fullmatch(r"[A-Za-z0-9_-]*", body):
        raise ValueError("not a continuation token")
    raw = base64.urlsafe_b64decode(body + "=" * (-len(body) % 4))
    if not token.startswith("v2:"):
        return raw, False
    if not raw or raw[0] > 1:
        raise ValueError("not a continuation token")
    return raw[1:], bool(raw[0])


def prefix_end(prefix: bytes) -> bytes | None:
    """The least key above all keys with the prefix; None if there is none."""
    body = prefix.rstrip(b"\xff")
    return body[:-1] + bytes([body[-1] + 1]) if body else None


def identity(*fields: str | None) -> str:
    """Hash that tells one run's options from another's; each field ends in NUL."""
    return hashlib.sha256(b"".join((f or "").encode() + b"\0" for f in fields)).hexdigest()


def redact(argument: str) -> str:
    """An option without secrets: tokens, keys and user info in addresses go."""
    text = re.sub(r"(?i)((?:token|secret|password|signature|credential|access-?key)[\w-]*[=:]\s*)\S+", r"\1***", argument)
    return re.sub(r"(\w+://)[^/@\s]+@", r"\1***@", text)
