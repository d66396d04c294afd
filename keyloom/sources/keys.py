"""Key sources: scans of a table's column, and generated distinct keys."""

from __future__ import annotations

import secrets

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scan(spark: SparkSession, path: str, column: str, distinct: bool = False) -> DataFrame:
    """One column of a parquet table as ``key``, without nulls; only it is read."""
    keys = spark.read.parquet(path).select(F.col(column).alias("key")).where(F.col("key").isNotNull())
    return keys.distinct() if distinct else keys


def distinct_keys(spark: SparkSession, n: int, seed: int) -> DataFrame:
    """n distinct BIGINT keys, the same for a seed.

    A bijection of 64 bits makes them distinct from the start: xxhash64 of one long is one, so no shuffle is needed.
    """
    return spark.range(n).select(F.xxhash64(F.lit(seed).cast("long").bitwiseXOR(F.col("id"))).alias("key"))


def random_seed() -> int:
    return secrets.randbits(64)
