"""Functions from build to lookup, over every key."""

import itertools

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from keyloom.config import BuildConfig, SeedError
from keyloom.operators import search, slots, stages
from keyloom.plans import index as ix
from keyloom.sources.keys import distinct_keys, random_seed
from keyloom.streaming.lookup import lookup_stream


@pytest.fixture(scope="module")
def keys(spark):
    return distinct_keys(spark, 5000, 42).cache()


@pytest.mark.parametrize("find, minimal", list(itertools.product(("xor", "add"), (True, False))))
def test_variants_are_perfect(spark, keys, find, minimal):
    ansi = spark.conf.get("spark.sql.ansi.enabled")
    for build, more in ((ix.build_single, {}), (ix.build_partitioned, {"avg_partition": 1700}), (ix.build_dense, {"avg_partition": 1000})):
        for hasher, bucketer in (("xx", "opt"), ("murmur", "skew")) if build is ix.build_single else (("murmur", "skew"),):
            made = build(keys, "key", BuildConfig(seed=654321, search=find, minimal=minimal, hasher=hasher, bucketer=bucketer, alpha=0.94, lam=4, **more))
            assert made.is_perfect(keys, "key"), (build, hasher)
            assert (made.num_keys, made.seed, made.is_minimal, made.search_type) == (5000, 654321, minimal, find)
    assert spark.conf.get("spark.sql.ansi.enabled") == ansi


@pytest.mark.parametrize("n, alpha", [(1, 0.98), (2, 1.0), (3, 1.0), (64, 1.0), (128, 0.98), (500, 1.0)])
def test_small_sizes(spark, n, alpha):
    keys = spark.range(n).withColumnRenamed("id", "key")
    for find, bucketer in (("xor", "skew"), ("add", "uniform")):
        assert ix.build_single(keys, "key", BuildConfig(seed=5, alpha=alpha, search=find, bucketer=bucketer)).is_perfect(keys, "key")


def test_other_bucketers_and_order(spark, keys):
    few = keys.limit(1500)
    for bucketer in ("uniform", "range", "table", "table_linear"):
        assert ix.build_single(few, "key", BuildConfig(seed=1, bucketer=bucketer)).is_perfect(few, "key")
    one, two = (ix.build_single(few, "key", BuildConfig(seed=1, secondary_sort=s)) for s in (False, True))
    assert two.is_perfect(few, "key") and one.pilots.exceptAll(two.pilots).count() > 0
    again = ix.build_single(few.orderBy(F.desc("key")), "key", BuildConfig(seed=1))
    assert one.pilots.exceptAll(again.pilots).count() == 0


def test_string_and_null_keys(spark):
    rows = spark.createDataFrame([(f"key {i}",) for i in range(700)] + [(None,)], "key string")
    for hasher in ("xx", "murmur"):
        made = ix.build_single(rows, "key", BuildConfig(seed=3, hasher=hasher))
        assert made.is_perfect(rows.dropna(), "key") and made.lookup(rows, "key").where("key IS NULL").first().position is None


def test_failures(spark, keys, monkeypatch):
    twice = keys.unionByName(keys.limit(1))
    with pytest.raises(SeedError):
        ix.build_single(twice, "key", BuildConfig(seed=1))
    with pytest.raises(SeedError):
        ix.build_single(keys, "key", BuildConfig(seed=1, num_buckets=3))
    with pytest.raises(ValueError):
        ix.build_single(keys.limit(0), "key", BuildConfig(seed=1))
    with pytest.raises(ValueError):
        ix.build_single(keys, "key", BuildConfig(seed=1, alpha=1.1))
    with pytest.raises(ValueError):
        ix.build_partitioned(keys, "key", BuildConfig(seed=1, avg_partition=0))
    with pytest.raises(ValueError):
        ix.build_partitioned(keys, "key", BuildConfig(seed=1, avg_partition=1000, dense=True))
    tried = []
    once = ix.build_from_hashes

    def failing(hashed, config, kind, seed, n):
        tried.append(seed)
        if len(tried) < 3:
            raise SeedError("no")
        return once(hashed, config, kind, seed, n)

    monkeypatch.setattr(ix, "build_from_hashes", failing)
    assert ix.build_single(keys.limit(50), "key", BuildConfig()).num_keys == 50 and len(set(tried)) == 3
    assert 0 <= random_seed() < 1 << 64


def test_empty_partition_and_foreign_keys(spark):
    """Hashes that leave the middle partitions empty."""
    rows = spark.range(2500).select(F.xxhash64("id").alias("h"), "id")
    half = rows.select("id", F.shiftrightunsigned("h", 3).alias("h1"), F.lit(0).cast("long").alias("zero"), F.xxhash64("h").alias("raw"))
    half = half.select("id", "h1", F.shiftrightunsigned("raw", 3).alias("h2"))
    for kind, dense in (("partitioned", False), ("dense", True)):
        made = ix.build_from_hashes(half, BuildConfig(avg_partition=1000, dense=dense, bucketer="uniform", num_buckets=700), kind, 7, 2500)
        sizes = [r.num_keys for r in made.partitions.orderBy("partition_id").collect()]
        assert sizes[-1] == 0 and sum(sizes) == 2500
        joined = stages.bucketed(stages.partitioned(half, made.num_partitions), "uniform", made.num_buckets, made.config.lam, made.config.alpha)
        assert joined.select("partition_id", "bucket").distinct().join(made.pilots, ["partition_id", "bucket"], "left_anti").count() == 0


def test_free_slots_by_a_plain_loop(spark):
    import random

    r = random.Random(6)
    for n, m in ((1, 1), (5, 9), (40, 55), (10, 10)):
        taken = sorted(r.sample(range(m), n))
        holes = [x for x in range(n) if x not in taken]
        want, at = [], 0
        for s in range(n, m):
            want.append(holes[at] if at < len(holes) else (holes[at - 1] if holes else 0))
            at += s in taken
        table = spark.createDataFrame([(0, n, m, 0)], "partition_id long, num_keys long, table_size long, offset long")
        rows = spark.createDataFrame([(0, p) for p in taken], "partition_id long, pos long")
        for got in (slots.free_slots(rows, table), slots.dense_free_slots(rows, table, n)):
            assert [x.slot for x in got.orderBy("rank").collect()] == want
    halves = spark.createDataFrame([(0, 3, 6, 0), (1, 4, 6, 6)], "partition_id long, num_keys long, table_size long, offset long")
    rows = spark.createDataFrame([(0, 0), (0, 4), (0, 5), (1, 0), (1, 2), (1, 3), (1, 5)], "partition_id long, pos long")
    assert [(x.rank, x.slot) for x in slots.dense_free_slots(rows, halves, 7).orderBy("rank").collect()] == [(0, 1), (1, 1), (2, 2), (3, 3), (4, 3)]


def test_grouping(spark):
    pairs = [[(1, 101), (3, 301), (5, 501), (5, 503)], [(1, 102), (2, 201), (5, 502), (6, 601)], [(3, 302), (5, 500)], []]
    blocks = [spark.createDataFrame([(0, *x) for x in b], "partition_id long, bucket long, payload long") for b in pairs]
    merged = stages.merged_blocks(*blocks)
    assert {r.bucket: r["size"] for r in stages.bucket_sizes(merged).collect()} == {1: 2, 2: 1, 3: 2, 5: 4, 6: 1}
    assert stages.duplicate_payloads(merged).count() == 0 and stages.oversize_buckets(merged, 3).count() == 1
    sizes = spark.createDataFrame([(0, 15, 3), (0, 10, 2), (0, 30, 2), (0, 20, 1), (0, 5, 1)], "partition_id long, bucket long, size long")
    assert [r.bucket for r in stages.search_order(sizes).orderBy("position").collect()] == [15, 10, 30, 5, 20]
    assert [r.bucket for r in stages.search_order(sizes, True).orderBy("position").collect()] == [15, 30, 10, 20, 5]
    signed = spark.createDataFrame([(0, 1, -1), (0, 1, 1), (0, 1, 0)], "partition_id long, bucket long, payload long")
    assert stages.buckets(signed).first().payloads == [0, 1, -1]


def test_save_load_and_stream(spark, keys, tmp_path):
    made = ix.build_dense(keys, "key", BuildConfig(seed=918273, avg_partition=1000, search="add"))
    made.save(str(tmp_path / "index"))
    again = ix.Index.load(spark, str(tmp_path / "index"))
    assert again.config == made.config and again.is_perfect(keys, "key")
    assert made.lookup(keys, "key").exceptAll(again.lookup(keys, "key")).count() == 0
    keys.write.parquet(str(tmp_path / "keys"))
    stream = spark.readStream.schema("key long").parquet(str(tmp_path / "keys"))
    query = lookup_stream(stream, "key", again).writeStream.format("memory").queryName("looked_up").start()
    query.processAllAvailable()
    query.stop()
    found = spark.table("looked_up")
    assert found.count() == 5000 == found.select("position").distinct().count()
    spark.createDataFrame([('{"version": 9}',)], "v string").write.mode("overwrite").text(str(tmp_path / "index/meta"))
    with pytest.raises(ValueError):
        ix.Index.load(spark, str(tmp_path / "index"))


def test_lookup_plan_reads_keys_only_and_stays_in_the_engine(spark, keys, tmp_path):
    made = ix.build_single(keys, "key", BuildConfig(seed=1))
    keys.withColumn("more", F.lit("x")).write.parquet(str(tmp_path / "keys"))
    plan = made.lookup(spark.read.parquet(str(tmp_path / "keys")).select("key"), "key")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<key:bigint>" in plan and "BroadcastHashJoin" in plan
    assert not any(x in plan.split("InMemoryRelation")[0] for x in ("ArrowEvalPython", "BatchEvalPython"))


def test_bits(spark, keys):
    made = ix.build_partitioned(keys, "key", BuildConfig(seed=1, avg_partition=1000))
    sizes = {r.component: r.bits_per_key for r in made.bits().collect()}
    assert set(sizes) == {"pilots", "free_slots", "offsets"} and 1 < sizes["pilots"] < 5
    assert search.SCHEMA.startswith("partition_id")


def test_first_bucket_of_opt_grows_with_the_table(spark):
    """Over 255 keys in the first bucket, which the limit of small tables refused."""
    rows = spark.range(40_000).select(F.format_string("Customer#%09d", "id").alias("key"))
    made = ix.build_single(rows, "key", BuildConfig(seed=1234, hasher="xx", bucketer="opt"))
    sizes = stages.bucket_sizes(stages.bucketed(stages.hashed_keys(rows, "key", "xx", 1234).withColumn("partition_id", F.lit(0)), "opt", made.num_buckets, made.config.lam, made.config.alpha))
    assert sizes.agg(F.max("size")).first()[0] > 255 and made.is_perfect(rows, "key")


def test_repeated_names_are_one_key(spark, tmp_path):
    from keyloom.queries import lookup_string_keys

    spark.range(900).select(F.concat(F.lit("name "), F.col("id") % 300).alias("c_name")).write.parquet(str(tmp_path / "customer.parquet"))
    assert tuple(lookup_string_keys(spark, str(tmp_path)).first()) == (900, 300, 0, 299, 3 * 300 * 299 // 2)


@pytest.mark.parametrize("find", ["xor", "add"])
def test_windows_of_buckets_give_the_same_pilots(monkeypatch, find):
    """Many buckets at a time against one after another, both orders of equal sizes."""
    r = np.random.default_rng(3)
    bucket, payload = (r.random(40_000) ** 1.5 * 9_000).astype(np.int64), r.integers(0, 1 << 63, 40_000).astype(np.uint64) * np.uint64(2)
    for second in (False, True):
        config = BuildConfig(search=find, secondary_sort=second)
        many = search.searched(bucket, payload, config, 17)
        with monkeypatch.context() as patch:
            patch.setattr(search, "MANY_KEYS", 1 << 40)
            patch.setattr(search, "Window", None)
            one = search.searched(bucket, payload, config, 17)
        assert many[0] == one[0] == 0 and all((a == b).all() for a, b in zip(many[1:], one[1:], strict=True))
        assert many[3].sum() == 40_000


def test_pilots_left_out_do_not_count():
    """Keys that coincide for all pilots below the table's size, which is beyond the limit of pilots tried."""
    own = np.array([[1259904246501411638, 16227464369011521700]], np.uint64)
    assert search.Window(40, "add", 1, limit=20)(own).tolist() == [40]
    full = search.Window(40, "xor", 1, limit=20)
    full.taken[:] = True
    assert full(own) is None


def test_single_search_reads_parts_and_fails_at_once(spark, keys):
    batches = [pa.RecordBatch.from_arrays([pa.array(range(i, i + 10_000)), pa.array([[1, 2]] * 10_000)], ["bucket", "payloads"]) for i in range(0, 400_000, 10_000)]
    read = [(len(ids), len(payloads)) for ids, _, payloads in search._read(iter(batches))]
    assert sum(n for n, _ in read) == 400_000 and max(n for n, _ in read) < search.BUCKETS_READ + 10_000 and all(2 * n == m for n, m in read)
    with pytest.raises(SeedError, match="equal payloads"):
        ix.build_single(keys.unionByName(keys.limit(1)), "key", BuildConfig(seed=1))
    plan = ix.build_single(keys, "key", BuildConfig(seed=1, secondary_sort=True)).pilots._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "FlatMapGroupsInPandas" not in plan


def test_free_slots_of_a_large_table(spark):
    """Against numpy; no frame from a row to the end, which takes time by the square, and no row for every slot."""
    r = np.random.default_rng(8)
    n, m = 50_000, 70_001
    taken = np.sort(r.permutation(m)[:n])
    used = np.isin(np.arange(m), taken)
    holes, last = np.flatnonzero(~used[:n]), used[n:].sum()
    want = holes[np.minimum(np.cumsum(used[n:]) - used[n:], last - 1)]
    table = spark.createDataFrame([(0, n, m, 0)], "partition_id long, num_keys long, table_size long, offset long")
    words = spark.createDataFrame([(0, i, w) for i, w in enumerate(search.words_of(used).tolist())], "partition_id long, i long, word long")
    assert slots.taken_slots(words).count() == n
    for got in (slots.free_slots_of(words, table), slots.free_slots(slots.taken_slots(words), table)):
        assert "currentrow$(), unboundedfollowing" not in got._jdf.queryExecution().toString()
        assert [x.slot for x in got.orderBy("rank").collect()] == want.tolist()
