"""Stable keys: the same in every engine, run and partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def crc(c: Column) -> Column:
    return F.crc32(F.encode(c, "UTF-8"))


def dedup_key(text: Column, prefix: int = 600) -> Column:
    """CRC-32 of the beginning, with the length above it."""
    return crc(F.substring(text, 1, prefix)).bitwiseXOR(F.shiftleft(F.length(text).cast("long"), 32))


def in_validation(text: Column, permille: int, prefix: int | None = 400) -> Column:
    return crc(F.substring(text, 1, prefix) if prefix else text) % 1000 < permille


def order_key(*parts) -> Column:
    """A pseudo-random order, a pure function of its parts."""
    return F.md5(F.concat_ws(":", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]))


def uniform(*parts) -> Column:
    """A number in [0, 1) from the same key."""
    return F.conv(F.substring(order_key(*parts), 1, 8), 16, 10).cast("double") / float(1 << 32)
