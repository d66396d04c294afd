"""Build configuration and sizing of perfect hash functions."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Limits and defaults.
MIN_PARTITION, MAX_DENSE_PARTITION = 1_000, 5_000
MAX_BUCKET = 255  # of tables up to 4,096 slots; of larger ones see largest_bucket
PILOT_LIMIT = 50_000_000  # tried for a bucket; those that additive search leaves out do not count
SEED_ATTEMPTS = 10
LAMBDA, ALPHA = 4.5, 0.98


class SeedError(RuntimeError):
    """No function exists for this seed: equal payloads, a bucket that is too large, or no pilot up to the limit."""


@dataclass(frozen=True)
class BuildConfig:
    """How to build. seed None: random seeds are tried, SEED_ATTEMPTS of them. avg_partition 0: one partition."""

    lam: float = LAMBDA
    alpha: float = ALPHA
    search: str = "xor"
    minimal: bool = True
    hasher: str = "murmur"
    bucketer: str = "skew"
    seed: int | None = None
    num_buckets: int = 0
    avg_partition: int = 0
    dense: bool = False
    secondary_sort: bool = False
    encoder: str = "rice"

    def checked(self, n: int) -> BuildConfig:
        if n <= 0:
            raise ValueError("there are no keys")
        if not 0 < self.alpha <= 1:
            raise ValueError("alpha must be in (0, 1]")
        if self.search not in ("xor", "add"):
            raise ValueError(f"unknown search: {self.search}")
        if self.search == "add" and table_size(n, self.alpha, "add") >= 1 << 32:
            raise ValueError("additive search needs a table below 2^32")
        return self


@dataclass
class BuildTimings:
    """Seconds by stage of a build."""

    hashing: float = 0.0
    searching: float = 0.0
    remapping: float = 0.0
    encoding: float = 0.0
    more: dict[str, float] = field(default_factory=dict)


def bucket_count(n: int, lam: float) -> int:
    if lam == 0:
        raise ValueError("lambda must not be 0")
    return math.ceil(n / lam)


def table_size(n: int, alpha: float, search: str) -> int:
    """floor(n / alpha), not below n; one more for xor if that is a power of two."""
    m = max(n, int(n / alpha))
    return m + 1 if search == "xor" and m & (m - 1) == 0 else m


def largest_bucket(table: int) -> int:
    """Keys a bucket may have. Buckets of "opt" grow with the root of the table (the first holds about twice the root);
    four times the root still has a pilot, while all slots are free, within some thousands."""
    return max(MAX_BUCKET, 4 * math.isqrt(table))


def table_size_column(n: Column, alpha: float, search: str) -> Column:
    m = F.greatest(n, F.floor(n / F.lit(alpha)))
    return m + F.when(m.bitwiseAND(m - 1) == 0, 1).otherwise(0) if search == "xor" else m


def partition_size(n: int, avg: int, dense: bool) -> int:
    """The average partition size in use; 0: not partitioned."""
    if not avg:
        return 0
    avg = max(avg, MIN_PARTITION)
    return min(min(avg, MAX_DENSE_PARTITION) if dense else avg, n)


def partition_count(n: int, avg: int) -> int:
    return math.ceil(n / avg) if avg else 0
