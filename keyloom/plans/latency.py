"""How long a request would take: by its shape with jitter, by a fitted tail, by how busy the store is.

All are column expressions, drawn from hashes, so the same request always takes the same time.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from keyloom.functions.keys import mix64
from keyloom.functions.parse import parse_latency

SHAPES = ("worker_page", "pivot_probe", "structure_probe")
#: A measured profile in milliseconds, and what each common prefix adds.
MEASURED = {"worker_page": "223", "pivot_probe": "121", "structure_probe": "223+55/cp"}


def parse_profile(spec: str) -> dict[str, tuple[int, int]]:
    """shape=delay, comma-separated, or ``measured``: microseconds by shape, and for each common prefix of a structure probe."""
    parts = MEASURED if spec == "measured" else dict(p.strip().split("=", 1) for p in spec.split(","))
    out = {}
    for shape, delay in parts.items():
        if shape not in SHAPES:
            raise ValueError(f"no such shape: {shape}")
        base, _, more = delay.partition("+")
        if more and (shape != "structure_probe" or not more.lower().endswith("/cp")):
            raise ValueError(f"only a structure probe takes a time for each prefix: {delay}")
        out[shape] = (parse_latency(base.strip()), parse_latency(more[:-3].strip()) if more else 0)
    return out


def shape(delimiter: Column, max_keys: Column) -> Column:
    return F.when(F.length(F.coalesce(delimiter, F.lit(""))) > 0, "structure_probe").when(max_keys <= 1, "pivot_probe").otherwise("worker_page")


def signed_unit(key: Column) -> Column:
    """A number in [-1, 1) from a hash: its top 53 bits."""
    return F.shiftrightunsigned(mix64(key), 11) * F.lit(2.0**-52) - 1.0


def shape_latency(profile: dict[str, tuple[int, int]], delimiter: Column, max_keys: Column, n_prefixes: Column, request: Column, jitter: float = 0.0) -> Column:
    """Microseconds of a request; request: a 64-bit hash of all its fields, the token too, or all pages of a walk would jitter alike."""
    if not 0 <= jitter < 1:
        raise ValueError("jitter must be in [0, 1)")
    kind = shape(delimiter, max_keys)
    base = F.lit(0)
    for name, (one, more) in profile.items():
        base = F.when(kind == name, F.lit(one) + F.coalesce(n_prefixes, F.lit(0)) * more).otherwise(base)
    base = base.cast("bigint")
    return base if not jitter else F.greatest((base * (1.0 + jitter * signed_unit(request))).cast("bigint"), F.lit(0))


def fitted(draw: Column, floor: int, mean: int) -> Column:
    """A floor and an exponential tail with the given mean; draw is a 64-bit hash."""
    if not 0 <= floor <= mean:
        raise ValueError("the mean is below the floor")
    u = (signed_unit(draw) + 1.0) / 2.0
    return F.lit(floor).cast("bigint") if floor == mean else (floor - F.log(1.0 - u) * (mean - floor)).cast("bigint")


def occupancy_scaled(base: Column, busy: Column, knee: int, exponent: float = 1.0) -> Column:
    """A base time, longer by a power of how far more requests are under way than the store takes at once."""
    return (base * F.pow(F.greatest(busy / F.lit(float(knee)), F.lit(1.0)), F.lit(exponent))).cast("bigint")
