"""Deterministic randomness from content hashes: the same in any engine and any partition."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The multipliers and the increment of SplitMix64; fixed values.
GAMMA = 0x9E3779B97F4A7C15
MIX_1 = 0xBF58476D1CE4E5B9
MIX_2 = 0x94D049BB133111EB


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def text_key(*columns: Column | str) -> Column:
    return F.concat_ws("|", *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in columns])


def hash32(key: Column) -> Column:
    """First 32 bits of the SHA-256 of a text, as a long."""
    return F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long")


def uniform(key: Column) -> Column:
    """A number in [0, 1)."""
    return hash32(key) / F.lit(float(1 << 32))


def bucket(key: Column, buckets: int) -> Column:
    return hash32(key) % buckets


def seed64(key: Column) -> Column:
    """First eight bytes of the SHA-256, big-endian, as an unsigned number."""
    return F.conv(F.substring(F.sha2(key, 256), 1, 16), 16, 10).cast("decimal(20,0)")


def content_id(*columns: Column | str, length: int = 16) -> Column:
    return F.substring(F.sha2(text_key(*columns), 256), 1, length)


def split_of(key: Column, train: int = 80, validation: int = 10, buckets: int = 100) -> Column:
    """Split of a group key: all its rows go to one split."""
    b = bucket(key, buckets)
    return F.when(b < train, "train").when(b < train + validation, "validation").otherwise("test")


def product(x: Column, by: int) -> Column:
    """Low 64 bits of a product of a long, from 32-bit halves so that nothing overflows. ``x`` stands
    in it ten times: a long expression should be a column of an earlier ``select``."""
    low, high = by & 0xFFFFFFFF, by >> 32
    mask = F.lit(0xFFFFFFFF)
    a, b = x.bitwiseAND(mask), F.shiftrightunsigned(x, 32)

    def mul32(u: Column, v: int) -> tuple[Column, Column]:
        """High and low 32 bits of the product of two 32-bit numbers."""
        v0, v1 = v & 0xFFFF, v >> 16
        p0, p1 = u * F.lit(v0), u * F.lit(v1)
        lower = p0.bitwiseAND(mask) + F.shiftleft(p1.bitwiseAND(F.lit(0xFFFF)), 16)
        upper = F.shiftrightunsigned(p0, 32) + F.shiftrightunsigned(p1, 16) + F.shiftrightunsigned(lower, 32)
        return upper.bitwiseAND(mask), lower.bitwiseAND(mask)

    carry, bottom = mul32(a, low)
    top = (carry + mul32(a, high)[1] + mul32(b, low)[1]).bitwiseAND(mask)
    return F.shiftleft(top, 32).bitwiseOR(bottom)


def _plus(x: Column, by: int) -> Column:
    """Sum modulo 2^64 without overflow."""
    mask = F.lit(0xFFFFFFFF)
    low = x.bitwiseAND(mask) + F.lit(by & 0xFFFFFFFF)
    high = (F.shiftrightunsigned(x, 32) + F.lit(by >> 32) + F.shiftrightunsigned(low, 32)).bitwiseAND(mask)
    return F.shiftleft(high, 32).bitwiseOR(low.bitwiseAND(mask))


def splitmix64(x: Column) -> Column:
    """The SplitMix64 output for state ``x`` (a long taken as unsigned), as a long."""
    v = _plus(x, GAMMA)
    v = product(v.bitwiseXOR(F.shiftrightunsigned(v, 30)), MIX_1)
    v = product(v.bitwiseXOR(F.shiftrightunsigned(v, 27)), MIX_2)
    return v.bitwiseXOR(F.shiftrightunsigned(v, 31))
