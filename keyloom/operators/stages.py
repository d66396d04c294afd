"""From keys to buckets: hashing, partitioning, duplicate payloads, sizes, the order of the search."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import MAX_BUCKET
from ..functions import bucketing, hashing
from ..functions.u64 import order


def hashed_keys(keys: DataFrame, column: str, hasher: str, seed: int) -> DataFrame:
    """h1, h2 of the keys that are not null."""
    return hashing.hashed(keys.where(F.col(column).isNotNull()), column, hasher, seed)


def partitioned(hashed: DataFrame, partitions: int) -> DataFrame:
    """``hashed`` with partition_id: the range bucket of h1 xor h2."""
    return hashed.withColumn("partition_id", bucketing.ranged(F.col("h1").bitwiseXOR(F.col("h2")), partitions))


def bucketed(hashed: DataFrame, bucketer: str, buckets: int, lam: float, alpha: float) -> DataFrame:
    """``hashed`` with bucket and payload."""
    return hashed.withColumns({"bucket": bucketing.BUCKETERS[bucketer](F.col("h1"), buckets, lam, alpha), "payload": F.col("h2")})


def duplicate_payloads(pairs: DataFrame) -> DataFrame:
    """partition_id, bucket, payload, n where a payload occurs more than once in a bucket; equal keys always do."""
    return pairs.groupBy("partition_id", "bucket", "payload").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def bucket_sizes(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("partition_id", "bucket").agg(F.count(F.lit(1)).alias("size"))


def oversize_buckets(pairs: DataFrame, most: int = MAX_BUCKET) -> DataFrame:
    return bucket_sizes(pairs).where(F.col("size") > most)


def size_histogram(pairs: DataFrame) -> DataFrame:
    return bucket_sizes(pairs).groupBy("size").agg(F.count(F.lit(1)).alias("buckets"))


def buckets(pairs: DataFrame) -> DataFrame:
    """partition_id, bucket, payloads by unsigned value. A bucket holds MAX_BUCKET payloads at most in any build."""
    by_value = F.sort_array(F.collect_list(F.struct(order(F.col("payload")).alias("o"), "payload")))
    return pairs.groupBy("partition_id", "bucket").agg(F.transform(by_value, lambda x: x["payload"]).alias("payloads"))


def merged_blocks(*blocks: DataFrame) -> DataFrame:
    """Blocks of pairs as one, in order of bucket and payload within each of Spark's partitions."""
    out = blocks[0]
    for other in blocks[1:]:
        out = out.unionByName(other)
    return out.repartition("partition_id", "bucket").sortWithinPartitions("partition_id", "bucket", order(F.col("payload")))


def search_order(sizes: DataFrame, descending: bool = False) -> DataFrame:
    """Position of each bucket in the search of its partition: large ones first, then by number (falling if asked)."""
    tie = F.desc("bucket") if descending else F.asc("bucket")
    return sizes.withColumn("position", F.row_number().over(Window.partitionBy("partition_id").orderBy(F.desc("size"), tie)))
