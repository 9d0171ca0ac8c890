"""32-bit integer hashing in Catalyst expressions, safe under ANSI arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MASK32 = 0xFFFFFFFF


def mul32(h: Column, k: int) -> Column:
    """(h * k) mod 2^32 for h < 2^32 without leaving 63 bits."""
    low = h * F.lit(k & 0xFFFF)
    high = (h * F.lit(k >> 16)).bitwiseAND(F.lit(0xFFFF)) * F.lit(65536)
    return (low + high).bitwiseAND(F.lit(MASK32))


def mix32(h: Column) -> Column:
    """The finaliser of a 32-bit murmur hash."""
    h = h.bitwiseXOR(F.shiftright(h, 16))
    h = mul32(h, 0x85EBCA6B)
    h = h.bitwiseXOR(F.shiftright(h, 13))
    h = mul32(h, 0xC2B2AE35)
    return h.bitwiseXOR(F.shiftright(h, 16))


def digits(*parts: Column | int) -> Column:
    """The 32 hexadecimal digits of the MD5 of the parts, joined by colons; any SQL engine can repeat it."""
    return F.md5(F.concat_ws(":", *(p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts)).cast("binary"))


def share(hex_digits: Column, start: int, count: int) -> Column:
    """`count` hexadecimal digits from `start` (counted from 1) as a double in [0, 1); 13 digits at most are exact."""
    return F.conv(F.substring(hex_digits, start, count), 16, 10).cast("bigint").cast("double") / F.lit(float(16**count))


def uniform01(*parts: Column | int) -> Column:
    """A double in [0, 1) from the parts alone, whatever the partitioning."""
    return share(digits(*parts), 1, 13)
