"""Building, evaluating, checking and keeping perfect hash functions."""

from __future__ import annotations

import json
import secrets
import time
from dataclasses import asdict, dataclass, field, replace

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import SEED_ATTEMPTS, BuildConfig, BuildTimings, SeedError, bucket_count, partition_count, partition_size, table_size
from ..functions import bucketing, hashing
from ..functions.u64 import ALL, lit, shr, umod, wrapping
from ..operators import search as S
from ..operators import slots, stages

VERSION = 1
#: Buckets up to which pilots are broadcast to look keys up; with more, the join shuffles.
BROADCAST_BUCKETS, BROADCAST_PARTITIONS = 2_000_000, 1_000_000
REASONS = {S.EQUAL_PAYLOADS: "equal payloads in a bucket (equal keys?)", S.LARGE_BUCKET: "a bucket is too large", S.NO_PILOT: "no pilot below the limit"}


@dataclass
class Index:
    """A function: kind is single, partitioned or dense. Its tables are DataFrames that can be saved and joined.

    pilots(partition_id, bucket, pilot, hashed_pilot), partitions(partition_id, num_keys, table_size, offset,
    two64_mod_m), free_slots(partition_id, rank, slot), taken(partition_id, pos).
    """

    spark: SparkSession
    kind: str
    config: BuildConfig
    seed: int
    num_keys: int
    table_size: int
    num_buckets: int
    num_partitions: int
    pilots: DataFrame
    partitions: DataFrame
    free_slots: DataFrame | None
    taken: DataFrame | None = None
    timings: BuildTimings = field(default_factory=BuildTimings)

    @property
    def is_minimal(self) -> bool:
        return self.config.minimal

    @property
    def search_type(self) -> str:
        return self.config.search

    def _placed(self, rows: DataFrame, key: str) -> DataFrame:
        """rows with the columns __p, __b, __h, __m, __t, __o, __n of each key's partition and bucket."""
        hashed = hashing.hashed(rows, key, self.config.hasher, self.seed).withColumnsRenamed({"h1": "__h1", "h2": "__h"})
        with wrapping(self.spark):
            part = bucketing.ranged(F.col("__h1").bitwiseXOR(F.col("__h")), self.num_partitions) if self.kind != "single" else F.lit(0).cast("long")
            bucket = bucketing.BUCKETERS[self.config.bucketer](F.col("__h1"), self.num_buckets, self.config.lam, self.config.alpha)
            hashed = hashed.withColumns({"__p": part, "__b": bucket}).drop("__h1")
        if self.kind == "single":
            m = self.table_size
            return hashed.withColumns({"__m": F.lit(m).cast("long"), "__t": F.lit((1 << 64) % m).cast("long"), "__o": F.lit(0).cast("long"), "__n": F.lit(self.num_keys).cast("long")})
        side = self.partitions.select(F.col("partition_id").alias("__p"), F.col("table_size").alias("__m"), F.col("two64_mod_m").alias("__t"), F.col("offset").alias("__o"), F.col("num_keys").alias("__n"))
        return hashed.join(F.broadcast(side) if self.num_partitions <= BROADCAST_PARTITIONS else side, "__p", "left")

    def lookup(self, rows: DataFrame, key: str, to: str = "position") -> DataFrame:
        """``rows`` with the position of each key; null for a null key and for keys of an empty partition.

        There is no test of membership: a key that was not built in gets a position too.
        """
        placed = self._placed(rows, key)
        side = self.pilots.select(F.col("partition_id").alias("__p"), F.col("bucket").alias("__b"), F.col("pilot").alias("__pilot"), F.col("hashed_pilot").alias("__hp"))
        few = self.num_buckets * self.num_partitions <= BROADCAST_BUCKETS
        joined = placed.join(F.broadcast(side) if few else side, ["__p", "__b"], "left")
        with wrapping(self.spark):
            joined = joined.withColumn("__slot", self._slot())
        known = F.col(key).isNotNull() & (F.col("__m") > 0)
        base = F.when(known, F.col("__slot"))
        dense = self.kind == "dense"
        if dense:
            joined = joined.withColumn("__slot", F.when(known, F.col("__o") + F.col("__slot")))
            base = F.col("__slot")
        if self.config.minimal:
            beyond = F.col("__slot") - (F.lit(self.num_keys) if dense else F.col("__n"))
            joined = joined.withColumn("__rank", F.when(beyond >= 0, beyond))
            free = self.free_slots.select(F.col("partition_id").alias("__p"), F.col("rank").alias("__rank"), F.col("slot").alias("__free"))
            free = free.drop("__p") if dense else free
            spare = max(1, self.table_size - self.num_keys)
            joined = joined.join(F.broadcast(free) if spare <= BROADCAST_BUCKETS else free, ["__rank"] if dense else ["__p", "__rank"], "left")
            base = F.when(known, F.when(F.col("__rank").isNull(), F.col("__slot")).otherwise(F.col("__free")))
        position = base if dense else F.col("__o") + base
        return joined.select(*[c for c in rows.columns if c != to], position.alias(to))

    def _slot(self) -> Column:
        pilot, m, t = F.coalesce("__pilot", F.lit(0).cast("long")), F.col("__m"), F.col("__t")
        safe = F.when(m > 0, m)
        if self.config.search == "xor":
            hashed = F.coalesce("__hp", F.lit(hashing.hash_pilot(0, self.seed)).cast("long"))
            return umod(F.col("__h").bitwiseXOR(hashed), safe, t)
        step = ((pilot - pilot % safe) / safe).cast("long")  # below 2^53, so exact
        moved = shr(hashing.mix64(F.col("__h") + step), 33) + pilot
        return moved.bitwiseAND(lit(0xFFFFFFFF)) % safe

    def check(self, rows: DataFrame, key: str) -> DataFrame:
        """One row: n, n_distinct, lo, hi, total of the positions of ``rows`` (its built-in keys, each once)."""
        at = self.lookup(rows.select(key), key, "position")
        return at.agg(F.count("position").alias("n"), F.countDistinct("position").alias("n_distinct"), F.min("position").alias("lo"), F.max("position").alias("hi"), F.sum("position").alias("total"))

    def is_perfect(self, rows: DataFrame, key: str) -> bool:
        x = self.check(rows, key).first()
        n, bound = self.num_keys, self.num_keys if self.config.minimal else self.table_size
        return x.n == n == x.n_distinct and x.lo >= 0 and x.hi < bound and (not self.config.minimal or x.total == n * (n - 1) // 2)

    def verified(self, members: DataFrame, key: str) -> DataFrame:
        """position and key of the built-in keys, to decode positions and to test membership with."""
        return self.lookup(members.select(key), key, "position")

    def bits(self) -> DataFrame:
        """component, bits, bits_per_key: what the parts take when packed by the configured encoders."""
        from ..operators import codecs

        pilots = self.dense_pilots() if self.kind == "dense" else self.all_pilots()
        sized = codecs.sizes(pilots.select("partition_id", "i", F.col("pilot").alias("v")), "partition_id", "i", "v", self.config.encoder)
        out = sized.select(F.lit("pilots").alias("component"), "num_bits")
        if self.config.minimal and self.free_slots is not None:
            free = self.free_slots.select("partition_id", F.col("rank").alias("i"), F.col("slot").alias("v"))
            out = out.unionByName(codecs.sizes(free, "partition_id", "i", "v", "elias_fano").select(F.lit("free_slots").alias("component"), "num_bits"))
        if self.kind != "single":
            offsets = self.partitions.select(F.lit(0).cast("long").alias("partition_id"), F.col("partition_id").alias("i"), F.col("offset").alias("v"))
            out = out.unionByName(codecs.sizes(offsets, "partition_id", "i", "v", "diff_compact").select(F.lit("offsets").alias("component"), "num_bits"))
        return out.groupBy("component").agg(F.sum("num_bits").cast("long").alias("bits")).withColumn("bits_per_key", F.col("bits") / F.lit(float(self.num_keys)))

    def all_pilots(self) -> DataFrame:
        """partition_id, i (bucket), pilot of all buckets; empty buckets have pilot 0."""
        every = self.partitions.select("partition_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(self.num_buckets - 1).cast("long"))).alias("bucket"))
        return every.join(self.pilots, ["partition_id", "bucket"], "left").select("partition_id", F.col("bucket").alias("i"), F.coalesce("pilot", F.lit(0)).alias("pilot"))

    def dense_pilots(self) -> DataFrame:
        """Pilots in the interleaved order of dense encoders: all partitions' bucket 0, then 1, and so on."""
        at = F.col("i") * self.num_partitions + F.col("partition_id")
        return self.all_pilots().select(F.lit(0).cast("long").alias("partition_id"), at.alias("i"), "pilot")

    def save(self, path: str) -> None:
        """Parquet tables and metadata under ``path``."""
        for name in ("pilots", "partitions", "free_slots", "taken"):
            df = getattr(self, name)
            if df is not None:
                df.write.mode("overwrite").parquet(f"{path}/{name}")
        meta = {"version": VERSION, "kind": self.kind, "config": asdict(self.config), "seed": self.seed, "num_keys": self.num_keys, "table_size": self.table_size, "num_buckets": self.num_buckets, "num_partitions": self.num_partitions, "parts": [x for x in ("pilots", "partitions", "free_slots", "taken") if getattr(self, x) is not None]}
        self.spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Index:
        meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
        if meta.get("version") != VERSION:
            raise ValueError(f"an index of version {meta.get('version')}, not {VERSION}")
        tables = {x: spark.read.parquet(f"{path}/{x}") if x in meta["parts"] else None for x in ("pilots", "partitions", "free_slots", "taken")}
        want = {"pilots": {"partition_id", "bucket", "pilot", "hashed_pilot"}, "partitions": {"partition_id", "num_keys", "table_size", "offset", "two64_mod_m"}}
        for name, columns in want.items():
            if tables[name] is None or not columns <= set(tables[name].columns):
                raise ValueError(f"{name} has not the columns of an index")
        return Index(spark, meta["kind"], BuildConfig(**meta["config"]), meta["seed"], meta["num_keys"], meta["table_size"], meta["num_buckets"], meta["num_partitions"], **tables)


def build_from_hashes(hashed: DataFrame, config: BuildConfig, kind: str, seed: int, n: int) -> Index:
    """An index of rows with h1, h2 (made with this seed). Raises SeedError if there is none for the seed."""
    spark = hashed.sparkSession
    config = config.checked(n)
    avg = partition_size(n, config.avg_partition, config.dense) if kind != "single" else n
    if kind != "single" and (not avg or avg == n):
        raise ValueError("the average partition size must lie between 0 and the number of keys")
    parts = partition_count(n, avg)
    buckets = config.num_buckets or bucket_count(avg, config.lam)
    timings, began = BuildTimings(), time.time()
    with wrapping(spark):
        placed = stages.partitioned(hashed, parts) if kind != "single" else hashed.withColumn("partition_id", F.lit(0).cast("long"))
        pairs = stages.bucketed(placed, config.bucketer, buckets, config.lam, config.alpha)
    found = (S.search_single(pairs, config, seed, n) if kind == "single" else S.search(pairs, config, seed)).persist(StorageLevel.MEMORY_AND_DISK)
    failed = found.where(F.col("kind") == S.FAILED).select("bucket").limit(1).collect()
    if failed:
        found.unpersist()
        raise SeedError(REASONS[failed[0][0]])
    timings.searching, began = time.time() - began, time.time()
    pilots = found.where(F.col("kind") == S.PILOT).select("partition_id", "bucket", "pilot", "hashed_pilot")
    words = found.where(F.col("kind") == S.TAKEN).select("partition_id", F.col("pos").alias("i"), "word")
    taken = slots.taken_slots(words)
    counts = found.groupBy("partition_id").agg(F.max("num_keys").alias("num_keys"))
    partitions = slots.partition_table(spark, counts, parts, config).persist()
    free = None
    if config.minimal:
        if kind == "dense":
            free = slots.dense_free_slots(taken, partitions, n).withColumn("partition_id", F.lit(0).cast("long"))
        else:
            free = slots.free_slots_of(words, partitions)
        free = free.persist()
    total = partitions.agg(F.sum("table_size")).first()[0]
    timings.remapping = time.time() - began
    return Index(spark, kind, config, seed, n, total if kind != "single" else table_size(n, config.alpha, config.search), buckets, parts, pilots, partitions, free, taken, timings)


def _build(keys: DataFrame, column: str, config: BuildConfig, kind: str) -> Index:
    keys = keys.select(column).where(F.col(column).isNotNull())
    n = keys.count()
    config.checked(n)
    attempts = 1 if config.seed is not None else SEED_ATTEMPTS
    for i in range(attempts):
        seed = config.seed if config.seed is not None else secrets.randbits(64)
        try:
            return build_from_hashes(stages.hashed_keys(keys, column, config.hasher, seed), config, kind, seed & ALL, n)
        except SeedError:
            if i == attempts - 1:
                raise
    raise AssertionError


def build_single(keys: DataFrame, column: str, config: BuildConfig | None = None) -> Index:
    """One function for all keys, searched in one task that holds five bytes for a slot and a part of the keys."""
    return _build(keys, column, replace(config or BuildConfig(), avg_partition=0, dense=False), "single")


def build_partitioned(keys: DataFrame, column: str, config: BuildConfig) -> Index:
    """A function for each partition of the keys, side by side; positions are shifted by the partitions before."""
    if config.dense:
        raise ValueError("dense partitioning needs build_dense")
    return _build(keys, column, config, "partitioned")


def build_dense(keys: DataFrame, column: str, config: BuildConfig) -> Index:
    """Many small partitions that share one table, and one remap if minimal."""
    return _build(keys, column, replace(config, dense=True), "dense")
