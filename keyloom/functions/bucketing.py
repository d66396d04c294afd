"""Bucketers: from a hash to one of B buckets, as Spark columns."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .u64 import lit, shr, to_double, ult, umod

#: Shares of dense buckets and of keys in them (as a bound on hashes), and points of a table.
DENSE_SHARE, DENSE_BOUND, FULCRUMS = 0.3, 11068046444225730560, 2048


def skew(h: Column, buckets: int) -> Column:
    """Three fifths of the hashes to the first three tenths of the buckets."""
    dense = int(DENSE_SHARE * buckets)
    first = umod(h, dense)
    if dense == buckets:
        return first
    rest = F.lit(dense) + umod(h, buckets - dense)
    return F.when(ult(h, lit(DENSE_BOUND)), first).otherwise(rest).cast("long")


def uniform(h: Column, buckets: int) -> Column:
    return umod(h, buckets)


def ranged(h: Column, buckets: int) -> Column:
    """By the upper 32 bits, monotone."""
    return shr(shr(h, 32) * F.lit(buckets).cast("long"), 32)


class Opt:
    """Buckets of sizes that suit the search, from a table size and load factor."""

    def __init__(self, buckets: int, lam: float, table: int, alpha: float):
        if table <= 0 or not 0 < alpha <= 1:
            raise ValueError("needs a table size and alpha in (0, 1]")
        self.buckets, self.alpha = buckets, alpha
        self.c = 0.2 * lam / math.sqrt(table)
        base = self._base(alpha)
        self.factor = 1.0 if alpha > 0.999999 or base <= 0 else 1.0 / base

    def _base(self, x: float) -> float:
        rest = 1.0 - x
        return (x + (rest * math.log(rest) if rest > 0 else 0.0)) * (1.0 - self.c) + self.c * x

    def relative(self, x: float) -> float:
        return self.factor * self._base(self.alpha * x)

    def __call__(self, h: Column) -> Column:
        if not self.buckets:
            return F.lit(0).cast("long")
        x = F.lit(self.alpha) * (to_double(h) / F.lit(float((1 << 64) - 1)))
        rest = F.lit(1.0) - x
        part = F.when(rest > 0, rest * F.log(rest)).otherwise(F.lit(0.0))
        y = F.lit(self.factor) * ((x + part) * F.lit(1.0 - self.c) + F.lit(self.c) * x)
        return F.least(F.floor(y * F.lit(float(self.buckets))), F.lit(self.buckets - 1).cast("long"))


def fulcrums(buckets: int, relative: Callable[[float], float] | None = None) -> list[int]:
    """Points of a table in 1/2^16 buckets; without ``relative`` on a line."""
    last, whole = FULCRUMS - 1, buckets << 16
    if relative is None:
        return [int(i / last * whole) for i in range(FULCRUMS)]
    return [0, *(int(relative(i / last) * whole) for i in range(last - 1)), whole]


def table(h: Column, buckets: int, points: list[int]) -> Column:
    """Between two points by the lower 32 bits of the hash.

    The weight of a point is the part of the step that lies behind it. Products are made of halves of 24 bits, so
    any number of buckets up to 2^30 does.
    """
    if not buckets:
        return F.lit(0).cast("long")
    z = h.bitwiseAND(lit(0xFFFFFFFF)) * F.lit(FULCRUMS - 1).cast("long")
    at, part = shr(z, 32).cast("int"), z.bitwiseAND(lit(0xFFFFFFFF))
    array = F.expr(f"array({','.join(f'{p}L' for p in points)})")

    def weighed(point: Column, weight: Column) -> Column:
        low, high = point.bitwiseAND(lit((1 << 24) - 1)), shr(point, 24)
        low_high = low * weight
        return shr(high * weight + shr(low_high, 24), 8)

    v = weighed(F.get(array, at), part) + weighed(F.get(array, at + 1), F.lit(0xFFFFFFFF).cast("long") - part)
    return F.least(shr(v, 16), F.lit(buckets - 1).cast("long"))


#: Bucketers by name: (hash, buckets, lambda, alpha) to a column. Others can be added.
BUCKETERS: dict[str, Callable[[Column, int, float, float], Column]] = {}


def _opt(buckets: int, lam: float, alpha: float) -> Opt:
    return Opt(buckets, lam, int(buckets * lam / alpha), alpha)


BUCKETERS |= {
    "skew": lambda h, b, lam, alpha: skew(h, b),
    "uniform": lambda h, b, lam, alpha: uniform(h, b),
    "range": lambda h, b, lam, alpha: ranged(h, b),
    "opt": lambda h, b, lam, alpha: _opt(b, lam, alpha)(h),
    "table": lambda h, b, lam, alpha: table(h, b, fulcrums(b, _opt(b, lam, alpha).relative)),
    "table_linear": lambda h, b, lam, alpha: table(h, b, fulcrums(b)),
}
