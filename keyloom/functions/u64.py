"""Unsigned 64-bit integers as BIGINT of the same bits."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

ALL = (1 << 64) - 1


def signed(x: int) -> int:
    x &= ALL
    return x - (1 << 64) if x >> 63 else x


def lit(x: int) -> Column:
    return F.lit(signed(x)).cast("long")


@contextmanager
def wrapping(spark: SparkSession) -> Iterator[None]:
    """Arithmetic of DataFrames that are made inside wraps around; the setting is restored in any case."""
    name = "spark.sql.ansi.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def ult(a: Column, b: Column) -> Column:
    """a < b as unsigned."""
    flip = lit(1 << 63)
    return a.bitwiseXOR(flip) < b.bitwiseXOR(flip)


def order(x: Column) -> Column:
    """A BIGINT that sorts as x does unsigned."""
    return x.bitwiseXOR(lit(1 << 63))


def umod(x: Column, m: int | Column, two64_mod_m: Column | None = None) -> Column:
    """x mod m of unsigned x, m below 2^62; for a column m, 2^64 mod m comes beside it. 0 for m = 0."""
    if isinstance(m, int):
        if m == 0:
            return F.lit(0).cast("long")
        return F.pmod(F.pmod(x, F.lit(m).cast("long")) + F.when(x < 0, F.lit((1 << 64) % m).cast("long")).otherwise(F.lit(0)), F.lit(m).cast("long"))
    return F.pmod(F.pmod(x, m) + F.when(x < 0, two64_mod_m).otherwise(F.lit(0)), m)


def two64_mod(m: Column) -> Column:
    """2^64 mod m of a BIGINT column: twice (2^63 mod m), and 2^63 mod m is 1 more than (2^63 - 1) mod m."""
    half = (F.lit((1 << 63) - 1).cast("long") % m + 1) % m
    return (half * 2) % m


def udiv(x: Column, d: int) -> Column:
    """x div d of unsigned x for 1 < d < 2^62."""
    wide = F.when(x < 0, x.cast("decimal(20,0)") + F.lit(str(1 << 64)).cast("decimal(20,0)")).otherwise(x.cast("decimal(20,0)"))
    q = (wide - umod(x, d).cast("decimal(20,0)")) / F.lit(d).cast("decimal(20,0)")
    return q.cast("decimal(20,0)").cast("long")


def to_double(x: Column) -> Column:
    """The unsigned value, rounded once."""
    wide = x.cast("decimal(20,0)")
    return F.when(x < 0, wide + F.lit(str(1 << 64)).cast("decimal(20,0)")).otherwise(wide).cast("double")


def shr(x: Column, n: int) -> Column:
    return F.shiftrightunsigned(x, n)
