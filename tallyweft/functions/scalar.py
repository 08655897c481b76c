"""Scalar expressions that Spark has no single function for."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column, otherwise: float | None = 0.0) -> Column:
    """a / b in doubles; ``otherwise`` where b is zero or null."""
    out = F.try_divide(a.cast("double"), b.cast("double"))
    return out if otherwise is None else F.coalesce(out, F.lit(float(otherwise)))


def seconds_between(start: Column, end: Column) -> Column:
    """Seconds from start to end as a double, to the microsecond; works on timestamps without a zone."""
    return F.timestamp_diff("MICROSECOND", start, end).cast("double") / F.lit(1e6)


def md5_mod(text: Column, n: int | Column) -> Column:
    """The MD5 of a text, read as a 128-bit number, modulo n: folded in four chunks of 32 bits."""
    digest, n = F.md5(text), F.lit(n).cast("long") if isinstance(n, int) else n.cast("long")
    chunk = lambda i: F.conv(F.substring(digest, i * 8 + 1, F.lit(8)), 16, 10).cast("long")
    return F.aggregate(F.sequence(F.lit(0), F.lit(3)), F.lit(0).cast("long"), lambda a, i: F.pmod(a * F.lit(4294967296) + chunk(i), n))


def hmac_sha256(text: Column, key: str | bytes) -> Column:
    """HMAC-SHA256 in hex; the padded keys are made on the driver (a key above 64 bytes is hashed first)."""
    raw = key.encode() if isinstance(key, str) else key
    raw = (hashlib.sha256(raw).digest() if len(raw) > 64 else raw).ljust(64, b"\0")
    inner, outer = (F.unhex(F.lit(bytes(b ^ pad for b in raw).hex())) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(text, "UTF-8")), 256))), 256)


def sorted_json(*columns: tuple[str, Column] | str) -> Column:
    """A JSON object with its keys in order; null values leave their key out."""
    named = [(c, F.col(c)) if isinstance(c, str) else c for c in columns]
    return F.to_json(F.struct(*[c.alias(n) for n, c in sorted(named, key=lambda x: x[0])]))


def half_even(x: Column) -> Column:
    """Round half to even, to a whole number."""
    return F.bround(x, 0)


def clipped(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))
