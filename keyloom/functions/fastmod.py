"""Modulo and division by a constant; Catalyst's own arithmetic needs no reciprocal, which tests use alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .u64 import udiv, umod


def reciprocal32(d: int) -> int:
    return ((1 << 64) - 1) // d + 1 & (1 << 64) - 1


def reciprocal64(d: int) -> int:
    return ((1 << 128) - 1) // d + 1 & (1 << 128) - 1


def mod32(a: Column, d: int) -> Column:
    """a mod d of 32-bit values in BIGINT; 0 for d = 1."""
    return a % F.lit(d)


def div32(a: Column, d: int) -> Column:
    """a div d of 32-bit values; for d = 1 the reciprocal is 0 and so is this."""
    return F.lit(0).cast("long") if d == 1 else ((a - a % F.lit(d)) / F.lit(d)).cast("long")


def mod64(a: Column, d: int) -> Column:
    return umod(a, d)


def div64(a: Column, d: int) -> Column:
    return udiv(a, d)


def is_divisible(a: Column, d: int) -> Column:
    return a % F.lit(d) == 0
