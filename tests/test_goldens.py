"""Fixed values that hashes, sizes, searches and encoders have to give."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from keyloom import config
from keyloom.functions import bits, bucketing, fastmod, hashing
from keyloom.functions.u64 import ALL, lit, signed, two64_mod, umod, wrapping
from keyloom.operators import codecs, search

MURMUR = [
    (b"", 0, 0x0), (b"hello", 0, 0x1E68D17C457BF117), (b"hello", 123, 0x240CB1D62529FB86), (b"hello world", 0, 0xD3BA2368A832AFCE),
    (b"hello world", 987, 0x7E71FB78C477A259), (b"1234567", 0, 0xAE9EBD2095279402), (b"12345678", 0, 0x758F67D162B2D202), (b"123456789", 0, 0x4977490251674330),
]


def test_murmur_of_bytes():
    for key, seed, want in MURMUR:
        assert int(hashing.murmur64_bytes([key, b"x", key], seed)[2]) == want


def test_murmur_of_longs_agrees(spark):
    values = [0, 1, -1, 12345, signed(1 << 63), 987654321987]
    with wrapping(spark):
        got = [r.h for r in spark.createDataFrame([(v,) for v in values], "v long").select(hashing.murmur64(F.col("v"), 77).alias("h")).collect()]
    want = hashing.murmur64_bytes([(v & ALL).to_bytes(8, "little") for v in values], 77)
    assert [g & ALL for g in got] == want.tolist() == hashing.murmur64_np(np.array(values, np.int64).view(np.uint64), 77).tolist()


def test_xx_against_a_library(spark):
    xxhash = pytest.importorskip("xxhash")
    for seed in (0, 1, 42, 1 << 63, ALL):
        strings = ["", "a", "hello world", "é" * 40]
        got = spark.createDataFrame([(s,) for s in strings], "s string").select(hashing.xx64(F.col("s"), seed).alias("h")).collect()
        assert [r.h & ALL for r in got] == [xxhash.xxh64_intdigest(s.encode(), seed) for s in strings]
        longs = [0, 5, -1]
        got = spark.createDataFrame([(v,) for v in longs], "v long").select(hashing.xx64(F.col("v"), seed).alias("h")).collect()
        assert [r.h & ALL for r in got] == [xxhash.xxh64_intdigest((v & ALL).to_bytes(8, "little"), seed) for v in longs]


def test_key_types(spark):
    keys = spark.createDataFrame([("hello", bytearray(b"hello"), 7)], "s string, b binary, i int")
    for hasher in hashing.HASHERS:
        rows = [hashing.hashed(keys, c, hasher, 123).first() for c in ("s", "b", "i")]
        assert (rows[0].h1, rows[0].h2) == (rows[1].h1, rows[1].h2) != (rows[2].h1, rows[2].h2)
    assert hashing.hashed(keys, "s", "murmur", 123).first().h1 & ALL == 0x240CB1D62529FB86
    with pytest.raises(TypeError):
        hashing.hashed(keys.select(F.lit(1.5).alias("d")), "d", "xx", 1)


def test_ansi_setting_is_restored(spark):
    before = spark.conf.get("spark.sql.ansi.enabled")
    with pytest.raises(ZeroDivisionError), wrapping(spark):
        raise ZeroDivisionError
    assert spark.conf.get("spark.sql.ansi.enabled") == before


def test_sizes():
    size = config.table_size
    assert [size(100, 0.98, "xor"), size(125, 0.98, "xor"), size(128, 1, "xor"), size(128, 1, "add"), size(100, 1, "xor"), size(99, 1.01, "xor")] == [102, 127, 129, 128, 100, 99]
    assert [config.bucket_count(*x) for x in ((100, 5), (101, 5), (99, 5), (10000, 4.3), (0, 5))] == [20, 21, 20, 2326, 0]
    with pytest.raises(ValueError):
        config.bucket_count(10, 0)
    assert [config.partition_count(*x) for x in ((100000, 20000), (100001, 20000), (99999, 20000), (10000, 1000), (10000, 0), (0, 1000))] == [5, 6, 5, 10, 0, 0]
    cases = [(10000, 0, False, 0), (100000, 20000, False, 20000), (100000, 500, False, 1000), (10000, 20000, False, 10000), (100000, 6000, True, 5000), (100000, 500, True, 1000), (100000, 3000, True, 3000), (1000, 6000, True, 1000)]
    assert all(config.partition_size(n, avg, dense) == want for n, avg, dense, want in cases)


def test_modulo(spark):
    values = [0, 1, 2, 9, 10, 11, 1019, 1020, (1 << 63) - 1, 1 << 63, ALL - 1, ALL, 0xDEADBEEFCAFEBABE]
    df = spark.createDataFrame([(signed(v),) for v in values], "v long")
    for d in (2, 3, 10, 1020, (1 << 62) - 1):
        got = df.select(fastmod.mod64(F.col("v"), d).alias("m"), fastmod.div64(F.col("v"), d).alias("q"), umod(F.col("v"), F.lit(d).cast("long"), two64_mod(F.lit(d).cast("long"))).alias("c")).collect()
        assert [(r.m, r.q & ALL, r.c) for r in got] == [(v % d, v // d, v % d) for v in values]
        for v in values:
            assert v * fastmod.reciprocal64(d) % (1 << 128) * d >> 128 == v % d


def test_range_and_skew_buckets(spark):
    points = {0x00000000FFFFFFFF: 0, 0x1999999900000000: 0, 0x1999999A00000000: 1, 0x8000000012345678: 5, 0xFFFFFFFFABCDEF01: 9}
    df = spark.createDataFrame([(signed(h),) for h in points], "h long")
    assert [r.b for r in df.select(bucketing.ranged(F.col("h"), 10).alias("b")).collect()] == list(points.values())
    t = bucketing.DENSE_BOUND
    hashes = [0, t - 1, t, t + 1, ALL, 1 << 60, 1 << 30]
    got = spark.createDataFrame([(signed(h),) for h in hashes], "h long").select(bucketing.skew(F.col("h"), 1000).alias("b")).collect()
    assert [r.b for r in got] == [h % 300 if h < t else 300 + h % 700 for h in hashes]
    one = spark.createDataFrame([(signed(h),) for h in hashes], "h long").select(bucketing.skew(F.col("h"), 2).alias("b")).collect()
    assert all(0 <= r.b < 2 for r in one)


def test_opt_and_table_buckets(spark):
    opt = bucketing.Opt(1000, 4, 4000, 0.95)
    quarters = [0, 1 << 62, 1 << 63, 3 << 62, ALL]
    got = [r.b for r in spark.createDataFrame([(signed(h),) for h in quarters], "h long").select(opt(F.col("h")).alias("b")).collect()]
    assert got[0] == 0 and got[-1] == 999 and got == sorted(got)
    points = bucketing.fulcrums(1000, lambda x: x * x)
    low = [0, 1 << 30, 1 << 31, 3 << 30, 0xFFFFFFFF]
    got = [r.b for r in spark.createDataFrame([(h,) for h in low], "h long").select(bucketing.table(F.col("h"), 1000, points).alias("b")).collect()]
    assert all(abs(a - b) <= 52 for a, b in zip(got, (0, 62, 250, 562, 999), strict=True))
    large = 1 << 26  # products beyond 2^63
    points = bucketing.fulcrums(large)
    got = [r.b for r in spark.createDataFrame([(h,) for h in low], "h long").select(bucketing.table(F.col("h"), large, points).alias("b")).collect()]
    for h, b in zip(low, got, strict=True):
        z = h * 2047
        i, part = z >> 32, z & 0xFFFFFFFF
        assert b == min(((points[i] * part >> 32) + (points[i + 1] * (0xFFFFFFFF - part) >> 32)) >> 16, large - 1)


def u(*x):
    return np.array(x, np.uint64)


def test_search_cases():
    free = lambda m: np.zeros(m, bool)
    assert search.find_add(u(1000, 2005, 3010), free(20)) == 0
    taken = free(20)
    taken[search.slots_of(u(1000), 0, 20, "add", 102)] = True
    assert search.find_add(u(1000, 2005, 3010), taken) == 1
    assert search.find_add(u(1259904246501411638, 16227464369011521700), free(40)) == 40
    assert search.find_xor(u(1000, 2005, 3010), free(20), search.Pilots(201)) == 0
    taken = free(20)
    taken[search.slots_of(u(1000), 0, 20, "xor", 202)] = True
    assert search.find_xor(u(1000, 2005, 3010), taken, search.Pilots(202)) == 2
    assert search.find_xor(u(1234567), free(10), search.Pilots(301)) == 0 == search.find_add(u(987654), free(15))
    assert search.find_xor(u(1000, 1000), free(10), search.Pilots(303), limit=1) == -1


def test_search_is_first_fit():
    """The smallest pilot, against trying one after another."""
    r = np.random.default_rng(5)
    for kind in ("xor", "add"):
        for _ in range(40):
            m, own = 60, r.integers(0, 1 << 63, 4).astype(np.uint64)
            taken = r.random(m) < 0.6
            got = search.find_xor(own, taken, search.Pilots(9)) if kind == "xor" else search.find_add(own, taken)
            tried = next(p for p in range(10**6) if not taken[s := search.slots_of(own, p, m, kind, 9)].any() and len(set(s.tolist())) == 4)
            assert got == tried


def test_rice_and_elias_fano_parameters():
    rice = [([], 0), ([0, 0, 0], 0), ([0, 1, 0, 3, 0, 0, 1, 2], 0), ([10, 5, 15, 8, 12], 3), ([100, 150, 120], 6), ([0], 0), ([10], 3)]
    assert all(codecs.rice_parameter(sum(v), len(v)) == want for v, want in rice)
    cases = [([0], 0, [], "1"), ([42], 5, [10], "01"), ([1, 7, 11, 13, 23, 26], 2, [1, 3, 3, 1, 3, 2], "101010100101"), ([0, 1, 2, 5, 7], 0, [], "101010001001"), ([0, 1, 3], 0, [], "101001")]
    for v, width, low, ones in cases:
        got = codecs.EliasFano.encode(u(*v))
        assert got[0] == width
        assert low == [] or codecs.unpack(got[2], width, len(v)).tolist() == low
        unpacked = "".join(map(str, np.unpackbits(np.frombuffer(got[1], np.uint8), bitorder="little")))
        assert unpacked.rstrip("0") == ones.rstrip("0")
    assert [codecs.low_bits(6, 1001), codecs.low_bits(4, 6)] == [7, 0]
    with pytest.raises(ValueError):
        codecs.EliasFano.encode(u(3, 2))


def test_round_trips():
    r = np.random.default_rng(11)
    lists = [u(), u(0), u(0, 5, 10, 15, 63, 64, 65, 130, 200), np.zeros(50, np.uint64), r.integers(0, 1 << 20, 500).astype(np.uint64)]
    for v in lists:
        for codec in (codecs.Rice, codecs.Compact):
            width, high, low = codec.encode(v)
            assert codec.decode(width, len(v), high, low).tolist() == v.tolist()
            assert codec.bits(v) > 0
        rising = np.sort(v)
        width, high, low = codecs.EliasFano.encode(rising)
        assert codecs.EliasFano.decode(width, len(v), high, low).tolist() == rising.tolist()
    for width in range(1, 65):
        v = r.integers(0, 1 << 63, 150).astype(np.uint64) >> np.uint64(max(0, 63 - width))
        v &= u(ALL >> (64 - width))[0]
        assert codecs.unpack(codecs.pack(v, width), width, 150).tolist() == v.tolist()
    for v, step in (([5, 5, 5, 5], 0), ([0, 10, 20, 30, 40], 10), ([40, 30, 20, 10, 0], 10), ([0, 5, 15, 20, 35], 10), ([1 << 40, (1 << 40) + 50, (1 << 40) + 55], 20)):
        assert codecs.from_diff(codecs.to_diff(u(*v), step), step).tolist() == v


def test_interleaving(spark):
    rows = spark.createDataFrame([(p, b, 100 * p + b) for p in range(3) for b in range(4)], "partition_id long, bucket long, pilot long")
    got = [r.pilot for r in codecs.interleaved(rows, 3).orderBy("at").collect()]
    assert got == [0, 100, 200, 1, 101, 201, 2, 102, 202, 3, 103, 203]
    for name in codecs.DENSE:
        again = codecs.decode_dense(codecs.encode_dense(rows, 3, name), 3, name)
        assert sorted(map(tuple, again.collect())) == sorted(map(tuple, rows.collect()))


def test_rank_and_select(spark):
    size = 262144 + 2 * 4096 + 100
    ones = [0, 5, 63, 64, 127, 4095, 4096, 4097, 262143, 262144, 262209, size - 1]
    df = spark.createDataFrame([(p,) for p in ones], "pos long")
    asked = sorted({max(0, p + d) for p in ones for d in (-1, 0, 1)} | {size + 5, 200000})
    got = {r.pos: r.rank for r in bits.rank1(df, spark.createDataFrame([(p,) for p in asked], "pos long")).collect()}
    assert got == {p: sum(x < p for x in ones) for p in asked}
    got = {r.k: r.pos for r in bits.select1(df, spark.range(20).withColumnRenamed("id", "k"), size).collect()}
    assert got == {k: ones[k] if k < len(ones) else size for k in range(20)}
    word = sum(1 << i for i in (0, 3, 5, 6, 10, 12, 63))
    got = spark.range(9).select(bits.select_in_word(lit(word), F.col("id")).alias("p")).collect()
    assert [r.p for r in got] == [0, 3, 5, 6, 10, 12, 63, 64, 64]
