"""Queries over the driver's tables for every operator, and the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable
from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import BuildConfig, bucket_count, partition_count, partition_size, table_size_column
from .functions import bits, bucketing, fastmod, hashing
from .functions.u64 import wrapping
from .operators import codecs, slots, stages
from .plans.index import build_dense, build_partitioned, build_single
from .sources.folders import shared_folder
from .sources.keys import distinct_keys, scan

SEED, KEYS, AVG = 1234, "o_orderkey", 2000
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

# --- SQL of unsigned arithmetic ---------------------------------------------------------------------------------
_T = "18446744073709551616"


def _u(x: str) -> str:
    return f"((({x})::HUGEINT + {_T}) % {_T})::UBIGINT"


def _s(x: str) -> str:
    return f"(CASE WHEN {x} >= 9223372036854775808 THEN ({x})::HUGEINT - {_T} ELSE ({x})::HUGEINT END)::BIGINT"


def _mul(a: str, b: int | str) -> str:
    return f"((({a})::UHUGEINT * ({b})::UHUGEINT) % {_T}::UHUGEINT)::UBIGINT"


def _shifted(x: str, n: int) -> str:
    return f"xor({x}, {x} >> {n})"


def _murmur_sql(table: str, key: str, seed: int, out: str, more: str = "") -> str:
    """CTEs ending in ``out`` with key, h (unsigned) and more."""
    all_, m = (1 << 64) - 1, hashing.MURMUR_M
    start = (seed & all_) ^ (8 * m & all_)
    more = f", {more}" if more else ""
    return f"""{out}_0 AS (SELECT {key} AS key{more}, {_mul(_u(key), m)} AS k FROM {table}),
{out}_1 AS (SELECT * EXCLUDE (k), {_mul(_shifted("k", 47), m)} AS k FROM {out}_0),
{out}_2 AS (SELECT * EXCLUDE (k), {_mul(f"xor({start}::UBIGINT, k)", m)} AS h FROM {out}_1),
{out}_3 AS (SELECT * EXCLUDE (h), {_mul(_shifted("h", 47), m)} AS h FROM {out}_2),
{out} AS (SELECT * EXCLUDE (h), {_shifted("h", 47)} AS h FROM {out}_3)"""


def _xx_sql(table: str, key: str, seed: int, out: str) -> str:
    all_ = (1 << 64) - 1
    p1, p2, p3, p4, p5 = hashing.P1, hashing.P2, hashing.P3, hashing.P4, hashing.P5

    def rot(x: str, n: int) -> str:
        return f"({_mul(x, 1 << n)} + ({x} >> {64 - n}))"

    return f"""{out}_0 AS (SELECT {key} AS key, {_mul(_u(key), p2)} AS k FROM {table}),
{out}_1 AS (SELECT key, xor({(seed + p5 + 8) & all_}::UBIGINT, {_mul(rot("k", 31), p1)}) AS h FROM {out}_0),
{out}_2 AS (SELECT key, (({_mul(rot("h", 27), p1)}::UHUGEINT + {p4}::UHUGEINT) % {_T}::UHUGEINT)::UBIGINT AS h FROM {out}_1),
{out}_3 AS (SELECT key, {_mul(_shifted("h", 33), p2)} AS h FROM {out}_2),
{out}_4 AS (SELECT key, {_mul(_shifted("h", 29), p3)} AS h FROM {out}_3),
{out} AS (SELECT key, {_shifted("h", 32)} AS h FROM {out}_4)"""


_INVERTED = ~SEED & ((1 << 64) - 1)
#: key, h1, h2 of order keys by Murmur.
_BOTH = f"""WITH {_murmur_sql("orders", KEYS, SEED, "a")}, {_murmur_sql("orders", KEYS, _INVERTED, "b")},
hh AS (SELECT a.key, a.h AS h1, b.h AS h2 FROM a JOIN b USING (key))"""


def _query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _orders(spark: SparkSession, sf: str) -> DataFrame:
    return scan(spark, f"{sf}/orders.parquet", KEYS)


def _hashed(spark: SparkSession, sf: str, hasher: str = "murmur") -> DataFrame:
    return stages.hashed_keys(_orders(spark, sf), "key", hasher, SEED)


# --- hashes and integer kernels ---------------------------------------------------------------------------------
@_query(f"{_BOTH} SELECT key, {_s('h1')} AS h1, {_s('h2')} AS h2, {_s('xor(h1, h2)')} AS mixed FROM hh")
def hash_murmur_u64(spark: SparkSession, sf: str) -> DataFrame:
    return _hashed(spark, sf).withColumn("mixed", F.col("h1").bitwiseXOR(F.col("h2")))


@_query(f"""WITH {_xx_sql("orders", KEYS, SEED, "a")}, {_xx_sql("orders", KEYS, _INVERTED, "b")}
SELECT key, {_s('a.h')} AS h1, {_s('b.h')} AS h2 FROM a JOIN b USING (key)""")
def hash_xx_u64(spark: SparkSession, sf: str) -> DataFrame:
    return _hashed(spark, sf, "xx")


@_query(f"""WITH a AS (SELECT {KEYS} AS key, {_mul(_shifted(_u(KEYS), 30), 0xBF58476D1CE4E5B9)} AS x FROM orders),
b AS (SELECT key, {_mul(_shifted("x", 27), 0x94D049BB133111EB)} AS x FROM a)
SELECT key, {_s(_shifted("x", 31))} AS mixed FROM b""")
def mix64(spark: SparkSession, sf: str) -> DataFrame:
    with wrapping(spark):
        return _orders(spark, sf).select("key", hashing.mix64(F.col("key")).alias("mixed"))


@_query()
def hash_murmur_strings(spark: SparkSession, sf: str) -> DataFrame:
    return stages.hashed_keys(scan(spark, f"{sf}/customer.parquet", "c_name"), "key", "murmur", SEED)


@_query(f"""{_BOTH} SELECT key, {_s('h1 % 1020')} AS mod64, {_s('h1 // 1020')} AS div64, {_s('h1 % 4611686018427387903')} AS mod_large,
  ((h1 >> 32) % 1020)::BIGINT AS mod32, ((h1 >> 32) // 1020)::BIGINT AS div32, 0::BIGINT AS div32_one, (h1 >> 33) % 7 = 0 AS divisible FROM hh""")
def fastmod_all(spark: SparkSession, sf: str) -> DataFrame:
    h, high = F.col("h1"), F.shiftrightunsigned("h1", 32)
    return _hashed(spark, sf).select(
        "key", fastmod.mod64(h, 1020).alias("mod64"), fastmod.div64(h, 1020).alias("div64"), fastmod.mod64(h, (1 << 62) - 1).alias("mod_large"),
        fastmod.mod32(high, 1020).alias("mod32"), fastmod.div32(high, 1020).alias("div32"), fastmod.div32(high, 1).alias("div32_one"),
        fastmod.is_divisible(F.shiftrightunsigned("h1", 33), 7).alias("divisible"),
    )


@_query(f"""{_BOTH} SELECT key, bit_count({_s('h1')})::INTEGER AS ones,
  coalesce((SELECT i FROM (SELECT i, row_number() OVER (ORDER BY i) - 1 AS nth FROM range(64) t(i) WHERE (h1 >> i) % 2 = 1) WHERE nth = key % 40), 64)::INTEGER AS place FROM hh""")
def bits_of_words(spark: SparkSession, sf: str) -> DataFrame:
    h = _hashed(spark, sf)
    return h.select("key", bits.popcount(F.col("h1")).alias("ones"), bits.select_in_word(F.col("h1"), F.col("key") % 40).alias("place"))


# --- bucketers --------------------------------------------------------------------------------------------------
_B, _LAM, _ALPHA = 3000, 4.5, 0.98
_OPT = bucketing.Opt(_B, _LAM, int(_B * _LAM / _ALPHA), _ALPHA)
_SKEW = f"(CASE WHEN h1 < {bucketing.DENSE_BOUND}::UBIGINT THEN h1 % {int(0.3 * _B)} ELSE {int(0.3 * _B)} + h1 % {_B - int(0.3 * _B)} END)::BIGINT"
_X = f"({_ALPHA}::DOUBLE * (h1::DOUBLE / 18446744073709551615::DOUBLE))"
_OPT_SQL = f"least(floor({_OPT.factor!r}::DOUBLE * ((x + CASE WHEN 1 - x > 0 THEN (1 - x) * ln(1 - x) ELSE 0 END) * {1.0 - _OPT.c!r}::DOUBLE + {_OPT.c!r}::DOUBLE * x) * {float(_B)}::DOUBLE)::BIGINT, {_B - 1})"


def _table_sql(points: list[int]) -> str:
    return f"""{_BOTH}, z AS (SELECT key, (h1 % 4294967296)::BIGINT * 2047 AS z FROM hh),
p AS (SELECT key, (z // 4294967296) AS i, (z % 4294967296)::HUGEINT AS part, {points}::HUGEINT[] AS f FROM z)
SELECT key, least(((f[i + 1] * part) // 4294967296 + (f[i + 2] * (4294967295 - part)) // 4294967296) // 65536, {_B - 1})::BIGINT AS bucket FROM p"""


def _bucket_query(name: str, sql: str) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return _hashed(spark, sf).select("key", bucketing.BUCKETERS[name](F.col("h1"), _B, _LAM, _ALPHA).cast("long").alias("bucket"))

    run.__name__ = f"bucket_{name}"
    _query(sql)(run)


_bucket_query("skew", f"{_BOTH} SELECT key, {_SKEW} AS bucket FROM hh")
_bucket_query("uniform", f"{_BOTH} SELECT key, (h1 % {_B})::BIGINT AS bucket FROM hh")
_bucket_query("range", f"{_BOTH} SELECT key, (((h1 >> 32)::UHUGEINT * {_B}) >> 32)::BIGINT AS bucket FROM hh")
_bucket_query("opt", f"{_BOTH}, o AS (SELECT key, {_X} AS x FROM hh) SELECT key, {_OPT_SQL} AS bucket FROM o")
_bucket_query("table", _table_sql(bucketing.fulcrums(_B, _OPT.relative)))
_bucket_query("table_linear", _table_sql(bucketing.fulcrums(_B)))

# --- grouping ---------------------------------------------------------------------------------------------------
_PAIRS = f"{_BOTH}, p AS (SELECT key, 0::BIGINT AS partition_id, {_SKEW} AS bucket, h2 AS u, {_s('h2')} AS payload FROM hh)"


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    hashed = _hashed(spark, sf).withColumn("partition_id", F.lit(0).cast("long"))
    return stages.bucketed(hashed, "skew", _B, _LAM, _ALPHA).select("key", "partition_id", "bucket", "payload")


@_query(f"{_PAIRS}, s AS (SELECT bucket, count(*) AS size FROM p GROUP BY 1) SELECT size, count(*) AS buckets FROM s GROUP BY 1")
def bucket_size_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return stages.size_histogram(_pairs(spark, sf))


@_query(f"""{_PAIRS}, s AS (SELECT partition_id, bucket, count(*) AS size FROM p GROUP BY ALL)
SELECT *, row_number() OVER (ORDER BY size DESC, bucket)::INTEGER AS position FROM s""")
def bucket_search_order(spark: SparkSession, sf: str) -> DataFrame:
    return stages.search_order(stages.bucket_sizes(_pairs(spark, sf)))


@_query(f"""{_PAIRS}, s AS (SELECT partition_id, bucket, count(*) AS size FROM p GROUP BY ALL)
SELECT *, row_number() OVER (ORDER BY size DESC, bucket DESC)::INTEGER AS position FROM s""")
def bucket_search_order_descending(spark: SparkSession, sf: str) -> DataFrame:
    return stages.search_order(stages.bucket_sizes(_pairs(spark, sf)), descending=True)


@_query(f"{_PAIRS} SELECT partition_id, bucket, string_agg(payload, ',' ORDER BY u) AS payloads FROM p GROUP BY ALL")
def buckets_grouped(spark: SparkSession, sf: str) -> DataFrame:
    grouped = stages.buckets(_pairs(spark, sf))
    return grouped.select("partition_id", "bucket", F.array_join(F.transform("payloads", lambda x: x.cast("string")), ",").alias("payloads"))


@_query(f"{_PAIRS}, q AS (SELECT * FROM p UNION ALL SELECT * FROM p WHERE key % 3 = 0) SELECT bucket, count(*) AS size FROM q GROUP BY 1")
def merged_block_sizes(spark: SparkSession, sf: str) -> DataFrame:
    pairs = _pairs(spark, sf)
    merged = stages.merged_blocks(pairs.where("key % 2 = 0"), pairs.where("key % 2 = 1"), pairs.where("key % 3 = 0"))
    return stages.bucket_sizes(merged).select("bucket", "size")


@_query(f"""WITH {_murmur_sql("lineitem", "l_orderkey", SEED, "a", "l_linenumber AS line")}, {_murmur_sql("lineitem", "l_orderkey", _INVERTED, "b", "l_linenumber AS line")},
p AS (SELECT a.key, a.h AS h1, b.h AS h2 FROM (SELECT DISTINCT key, h FROM a) a JOIN (SELECT key, h FROM b) b USING (key))
SELECT 0::BIGINT AS partition_id, {_SKEW} AS bucket, {_s('h2')} AS payload, count(*) AS n FROM p GROUP BY ALL HAVING count(*) > 1""")
def duplicate_payloads(spark: SparkSession, sf: str) -> DataFrame:
    hashed = stages.hashed_keys(scan(spark, f"{sf}/lineitem.parquet", "l_orderkey"), "key", "murmur", SEED)
    return stages.duplicate_payloads(stages.bucketed(hashed.withColumn("partition_id", F.lit(0).cast("long")), "skew", _B, _LAM, _ALPHA))


@_query(f"{_BOTH} SELECT 0::BIGINT AS partition_id, (h1 % 40)::BIGINT AS bucket, count(*) AS size FROM hh GROUP BY ALL HAVING count(*) > 255")
def oversize_buckets(spark: SparkSession, sf: str) -> DataFrame:
    hashed = _hashed(spark, sf).withColumn("partition_id", F.lit(0).cast("long"))
    return stages.oversize_buckets(stages.bucketed(hashed, "uniform", 40, _LAM, _ALPHA))


# --- sizes and partitions ---------------------------------------------------------------------------------------
_POW = "(m::BIGINT & (m::BIGINT - 1)) = 0"


@_query(f"""WITH s AS (SELECT {KEYS} + 1 AS n FROM orders), t AS (SELECT n, greatest(n, floor(n / 0.94)::BIGINT) AS m FROM s)
SELECT n, m + CASE WHEN {_POW} THEN 1 ELSE 0 END AS xor_size, m AS add_size, ceil(n / 4.5)::BIGINT AS buckets FROM t""")
def table_sizes(spark: SparkSession, sf: str) -> DataFrame:
    n = (F.col("key") + 1).alias("n")
    sized = _orders(spark, sf).select(n)
    return sized.select("n", table_size_column(F.col("n"), 0.94, "xor").alias("xor_size"), table_size_column(F.col("n"), 0.94, "add").alias("add_size"), F.ceil(F.col("n") / 4.5).alias("buckets"))


_PARTS = f"""{_BOTH}, c AS (SELECT CASE WHEN count(*) < {AVG} THEN count(*) ELSE {AVG} END AS avg, count(*) AS n FROM hh),
k AS (SELECT ceil(n / avg)::BIGINT AS parts FROM c),
i AS (SELECT unnest(range((SELECT parts FROM k)))::BIGINT AS partition_id),
q AS (SELECT (((xor(h1, h2) >> 32)::UHUGEINT * (SELECT parts FROM k)::UHUGEINT) >> 32)::BIGINT AS partition_id, count(*) AS num_keys FROM hh GROUP BY 1),
r AS (SELECT partition_id, coalesce(num_keys, 0)::BIGINT AS num_keys FROM i LEFT JOIN q USING (partition_id)),
m AS (SELECT *, CASE WHEN num_keys = 0 THEN 0 ELSE greatest(num_keys, floor(num_keys / 0.98)::BIGINT) END AS m FROM r),
t AS (SELECT partition_id, num_keys, CASE WHEN m > 0 AND {_POW} THEN m + 1 ELSE m END AS table_size FROM m)"""


def _offsets_sql(width: str) -> str:
    return f"""{_PARTS} SELECT *, coalesce(sum({width}) OVER (ORDER BY partition_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset",
  CASE WHEN table_size > 0 THEN ({_T}::UHUGEINT % table_size::UHUGEINT)::BIGINT ELSE 0 END AS two64_mod_m FROM t"""


def _counts(spark: SparkSession, sf: str) -> tuple[DataFrame, int]:
    hashed = _hashed(spark, sf)
    n = hashed.count()
    parts = partition_count(n, partition_size(n, AVG, False))
    return stages.partitioned(hashed, parts).groupBy("partition_id").agg(F.count(F.lit(1)).alias("num_keys")), parts


@_query(f"{_PARTS} SELECT partition_id, num_keys FROM q JOIN (SELECT 1) ON true")
def partition_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return _counts(spark, sf)[0]


def _offset_query(name: str, config: BuildConfig, width: str) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        counts, parts = _counts(spark, sf)
        return slots.partition_table(spark, counts, parts, config)

    run.__name__ = f"partition_offsets_{name}"
    _query(_offsets_sql(width))(run)


_offset_query("minimal", BuildConfig(), "num_keys")
_offset_query("nonminimal", BuildConfig(minimal=False), "table_size")
_offset_query("dense", BuildConfig(dense=True), "table_size")

# --- encoders ---------------------------------------------------------------------------------------------------
_SEQ = "SELECT (o_custkey % 50)::BIGINT AS g, row_number() OVER (PARTITION BY o_custkey % 50 ORDER BY o_orderkey) - 1 AS i, floor(o_totalprice)::BIGINT AS v FROM orders"
_RISING = f"SELECT g, i, (sum(v) OVER (PARTITION BY g ORDER BY i))::BIGINT AS v FROM ({_SEQ})"


def _sequence(spark: SparkSession, sf: str, rising: bool = False) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("g").orderBy("o_orderkey")
    out = spark.read.parquet(f"{sf}/orders.parquet").select((F.col("o_custkey") % 50).alias("g"), "o_orderkey", F.floor("o_totalprice").alias("v"))
    out = out.select("g", (F.row_number().over(w) - 1).cast("long").alias("i"), (F.sum("v").over(w) if rising else F.col("v")).cast("long").alias("v"))
    return out


@_query(f"""WITH s AS ({_SEQ}), t AS (SELECT g, sum(v)::DOUBLE AS t, count(*)::DOUBLE AS n FROM s GROUP BY g)
SELECT g, CASE WHEN t > 0 THEN greatest(0, least(63, floor(log2(ln((sqrt(5) + 1) / 2 - 1) / ln(1 - n / (t + n)))) + 1)) ELSE 0 END::INTEGER AS parameter FROM t""")
def rice_parameter(spark: SparkSession, sf: str) -> DataFrame:
    grouped = _sequence(spark, sf).groupBy("g").agg(F.sum("v").cast("double").alias("t"), F.count(F.lit(1)).cast("double").alias("n"))
    return grouped.select("g", codecs.rice_parameter_column(F.col("t"), F.col("n")).alias("parameter"))


@_query(f"WITH s AS ({_SEQ}) SELECT g, CASE WHEN max(v) > 0 THEN length(bin(max(v))) ELSE 0 END::INTEGER AS width FROM s GROUP BY g")
def compact_width(spark: SparkSession, sf: str) -> DataFrame:
    return _sequence(spark, sf).groupBy("g").agg(codecs.bit_length_column(F.max("v")).alias("width"))


@_query(f"""WITH s AS ({_RISING}), t AS (SELECT g, count(*) AS n, max(v) + 1 AS universe FROM s GROUP BY g)
SELECT g, n, universe, CASE WHEN universe > n THEN floor(log2(universe::DOUBLE / n)) ELSE 0 END::INTEGER AS low FROM t""")
def ef_params(spark: SparkSession, sf: str) -> DataFrame:
    grouped = _sequence(spark, sf, True).groupBy("g").agg(F.count(F.lit(1)).alias("n"), (F.max("v") + 1).alias("universe"))
    return grouped.withColumn("low", codecs.low_bits_column(F.col("n"), F.col("universe")))


@_query(f"""WITH s AS ({_RISING}) SELECT g, i, v, ((v >> 10) - coalesce(lag(v) OVER (PARTITION BY g ORDER BY i) >> 10, 0))::BIGINT AS gap,
  coalesce(lag(v) OVER (PARTITION BY g ORDER BY i) > v, false) AS falls FROM s""")
def ef_gaps(spark: SparkSession, sf: str) -> DataFrame:
    return codecs.unary_gaps(_sequence(spark, sf, True), "i", "v", 10)


@_query(f"WITH s AS ({_RISING}) SELECT g, i, (abs(v - i * 150000) * 2 + CASE WHEN v - i * 150000 >= 0 THEN 1 ELSE 0 END)::BIGINT AS x FROM s")
def diff_encode(spark: SparkSession, sf: str) -> DataFrame:
    return _sequence(spark, sf, True).select("g", "i", codecs.diff_column(F.col("v"), F.col("i"), F.lit(150_000)).alias("x"))


def _round_trip(codec: str, rising: bool) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return codecs.decode(codecs.encode(_sequence(spark, sf, rising), "g", "i", "v", codec))

    run.__name__ = f"{codec}_roundtrip"
    _query(f"SELECT g, i, v FROM ({_RISING if rising else _SEQ})")(run)


for _codec, _rises in (("rice", False), ("compact", False), ("elias_fano", True), ("diff_compact", True), ("diff_rice", True)):
    _round_trip(_codec, _rises)


def _access(codec: str, rising: bool) -> None:
    """Values at places, of which some lie beyond the end (-1 here)."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        asked = spark.read.parquet(f"{sf}/orders.parquet").select((F.col("o_custkey") % 50).alias("g"), (F.col(KEYS) % 100).alias("i"))
        found = codecs.access(codecs.encode(_sequence(spark, sf, rising), "g", "i", "v", codec), asked)
        return found.withColumn("v", F.coalesce("v", F.lit(-1).cast("long")))

    run.__name__ = f"{codec}_access"
    asked = f"SELECT DISTINCT (o_custkey % 50)::BIGINT AS g, ({KEYS} % 100)::BIGINT AS i FROM orders"
    _query(f"SELECT g, i, coalesce(v, -1)::BIGINT AS v FROM ({asked}) LEFT JOIN ({_RISING if rising else _SEQ}) USING (g, i)")(run)


for _codec, _rises in (("rice", False), ("compact", False), ("elias_fano", True), ("diff_compact", True), ("diff_rice", True)):
    _access(_codec, _rises)

#: Order keys run from 0, so the indexes have no holes.
_PILOTS = "SELECT (o_orderkey % 7)::BIGINT AS partition_id, (o_orderkey // 7)::BIGINT AS bucket, (o_custkey % 900)::BIGINT AS pilot FROM orders"


def _pilots(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf}/orders.parquet")
    return rows.select((F.col(KEYS) % 7).alias("partition_id"), F.floor(F.col(KEYS) / 7).alias("bucket"), (F.col("o_custkey") % 900).alias("pilot"))


@_query(f"SELECT partition_id, bucket, pilot, bucket * 7 + partition_id AS at FROM ({_PILOTS})")
def dense_interleave_order(spark: SparkSession, sf: str) -> DataFrame:
    return codecs.interleaved(_pilots(spark, sf), 7)


def _dense_trip(name: str) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return codecs.decode_dense(codecs.encode_dense(_pilots(spark, sf), 7, name), 7, name)

    run.__name__ = f"dense_{name}_roundtrip"
    _query(_PILOTS)(run)


def _dense_access(name: str) -> None:
    """Pilots of buckets by half of their numbers."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        asked = spark.read.parquet(f"{sf}/orders.parquet").select((F.col("o_custkey") % 7).alias("partition_id"), F.floor(F.col(KEYS) / 14).alias("bucket"))
        return codecs.access_dense(codecs.encode_dense(_pilots(spark, sf), 7, name), asked, 7, name)

    run.__name__ = f"dense_{name}_access"
    asked = f"SELECT DISTINCT (o_custkey % 7)::BIGINT AS partition_id, ({KEYS} // 14)::BIGINT AS bucket FROM orders"
    _query(f"SELECT partition_id, bucket, pilot FROM ({asked}) LEFT JOIN ({_PILOTS}) USING (partition_id, bucket)")(run)


for _codec in codecs.DENSE:
    _dense_trip(_codec)
    _dense_access(_codec)

# --- bit vectors ------------------------------------------------------------------------------------------------
_SET = "SELECT DISTINCT o_custkey * 37 AS pos FROM orders"


def _bits(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/orders.parquet").select((F.col("o_custkey") * 37).alias("pos")).distinct()


@_query(f"""WITH b AS ({_SET}), q AS (SELECT o_orderkey * 5 AS pos FROM orders),
u AS (SELECT pos, 1 AS one FROM b), r AS (SELECT pos, sum(one) OVER (ORDER BY pos) AS upto FROM u)
SELECT q.pos, coalesce(r.upto, 0)::BIGINT AS rank FROM q ASOF LEFT JOIN r ON q.pos > r.pos""")
def rank1(spark: SparkSession, sf: str) -> DataFrame:
    return bits.rank1(_bits(spark, sf), _orders(spark, sf).select((F.col("key") * 5).alias("pos")))


@_query(f"""WITH b AS (SELECT pos, row_number() OVER (ORDER BY pos) - 1 AS k FROM ({_SET}))
SELECT o_orderkey AS k, coalesce(pos, 10000000)::BIGINT AS pos FROM orders LEFT JOIN b ON k = o_orderkey""")
def select1(spark: SparkSession, sf: str) -> DataFrame:
    return bits.select1(_bits(spark, sf), _orders(spark, sf).select(F.col("key").alias("k")), 10_000_000)


@_query(f"""WITH b AS ({_SET}), q AS (SELECT DISTINCT (pos // 64) * 64 + o AS pos FROM b, (SELECT unnest([0, 7, 40, 63]) AS o))
SELECT q.pos, (SELECT coalesce(sum(1::BIGINT << (b.pos - q.pos)::INTEGER), 0) FROM b WHERE b.pos >= q.pos AND b.pos < q.pos + 40)::BIGINT AS value FROM q""")
def get_bits(spark: SparkSession, sf: str) -> DataFrame:
    words = bits.words(_bits(spark, sf))
    asked = words.select(F.explode(F.transform(F.array(*[F.lit(x).cast("long") for x in (0, 7, 40, 63)]), lambda o: F.col("i") * 64 + o)).alias("pos"))
    return bits.get_bits(words, asked, 40)


@_query(f"SELECT pos FROM ({_SET}) WHERE pos % 2 = 0 UNION SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0")
def bits_set_unset(spark: SparkSession, sf: str) -> DataFrame:
    own = _bits(spark, sf)
    kept = bits.without(own, own.where("pos % 2 = 1"))
    return bits.with_set(kept, _orders(spark, sf).select(F.col("key").alias("pos")).where("pos % 3 = 0"))


# --- functions --------------------------------------------------------------------------------------------------
_BUILDERS = {"single": build_single, "partitioned": build_partitioned, "dense": build_dense}


def _config(kind: str, search: str = "xor", minimal: bool = True, **more) -> BuildConfig:
    return BuildConfig(seed=SEED, search=search, minimal=minimal, avg_partition=0 if kind == "single" else 1000, **more)


def _lookup_query(kind: str, search: str, minimal: bool) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        keys = _orders(spark, sf)
        index = _BUILDERS[kind](keys, "key", _config(kind, search, minimal))
        found = index.check(keys, "key")
        if minimal:
            return found
        return found.select("n", "n_distinct", (F.col("lo") >= 0).alias("low"), (F.col("hi") < index.table_size).alias("high"))

    run.__name__ = f"lookup_{kind}_{search}_{'min' if minimal else 'nonmin'}"
    n = "count(*) AS n, count(DISTINCT o_orderkey) AS n_distinct"
    _query(f"SELECT {n}, 0::BIGINT AS lo, count(*) - 1 AS hi, (count(*) * (count(*) - 1) // 2)::BIGINT AS total FROM orders" if minimal else f"SELECT {n}, true AS low, true AS high FROM orders")(run)


for _kind, _search, _minimal in product(_BUILDERS, ("xor", "add"), (True, False)):
    _lookup_query(_kind, _search, _minimal)


@_query(f"SELECT count(*) AS n, count(DISTINCT c_name) AS n_distinct, 0::BIGINT AS lo, count(*) - 1 AS hi, (count(*) * (count(*) - 1) // 2)::BIGINT AS total FROM customer")
def lookup_string_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Names, each built in once; all customers look theirs up."""
    names, rows = (scan(spark, f"{sf}/customer.parquet", "c_name", distinct) for distinct in (True, False))
    return build_single(names, "key", _config("single", hasher="xx", bucketer="opt")).check(rows, "key")


@_query("SELECT count(*) AS n, count(DISTINCT o_orderkey) AS n_distinct, 0::BIGINT AS lo, count(*) - 1 AS hi, (count(*) * (count(*) - 1) // 2)::BIGINT AS total FROM orders")
def save_load_lookup_equal(spark: SparkSession, sf: str) -> DataFrame:
    from .plans.index import Index

    keys, where = _orders(spark, sf), shared_folder(spark, "index")
    build_dense(keys, "key", _config("dense", bucketer="opt")).save(where)
    return Index.load(spark, where).check(keys, "key")


@_query("SELECT floor(count(*) / 0.98)::BIGINT - count(*) AS n, true AS below, true AS rising, true AS onto FROM orders")
def free_slots_summary(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    keys = _orders(spark, sf)
    index = build_single(keys, "key", _config("single"))
    stepped = index.free_slots.withColumn("before", F.lag("slot").over(Window.orderBy("rank")))
    used = index.taken.where(F.col("pos") < index.num_keys).count()
    summed = stepped.agg(F.count(F.lit(1)).alias("n"), (F.max("slot") < index.num_keys).alias("below"), F.min(F.coalesce(F.col("slot") >= F.col("before"), F.lit(True))).alias("rising"), (F.countDistinct("slot") == index.num_keys - used).alias("onto"))
    return summed


@_query(f"""{_BOTH}, sized AS (SELECT ceil(count(*) / {_LAM}::DOUBLE)::UBIGINT AS b, floor(0.3::DOUBLE * ceil(count(*) / {_LAM}::DOUBLE))::UBIGINT AS d FROM hh)
SELECT count(DISTINCT CASE WHEN h1 < {bucketing.DENSE_BOUND}::UBIGINT THEN h1 % d ELSE d + h1 % (b - d) END) AS buckets, true AS all_there FROM hh, sized""")
def pilots_complete(spark: SparkSession, sf: str) -> DataFrame:
    keys = _orders(spark, sf)
    index = build_single(keys, "key", _config("single"))
    pairs = stages.bucketed(_hashed(spark, sf).withColumn("partition_id", F.lit(0).cast("long")), "skew", bucket_count(keys.count(), _LAM), _LAM, _ALPHA)
    there = stages.bucket_sizes(pairs).join(index.pilots, ["partition_id", "bucket"], "left")
    return there.agg(F.count("pilot").alias("buckets"), (F.count("pilot") == F.count(F.lit(1))).alias("all_there"))


@_query()
def bits_per_key(spark: SparkSession, sf: str) -> DataFrame:
    return build_dense(_orders(spark, sf), "key", _config("dense")).bits()


@_query("SELECT count(*) AS n, count(*) AS n_distinct, true AS same_again FROM orders")
def distinct_keys_generator(spark: SparkSession, sf: str) -> DataFrame:
    n = _orders(spark, sf).count()
    one, two = distinct_keys(spark, n, 42), distinct_keys(spark, n, 42).withColumnRenamed("key", "other")
    return one.join(two, F.col("key") == F.col("other"), "left").agg(F.count("key").alias("n"), F.countDistinct("key").alias("n_distinct"), (F.count("other") == F.count("key")).alias("same_again"))


@_query("SELECT l_orderkey AS key, count(*) AS lines, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT) * (100 - CAST(round(l_discount * 100) AS BIGINT))) AS DOUBLE) / 10000 AS revenue FROM lineitem GROUP BY 1")
def dict_revenue(spark: SparkSession, sf: str) -> DataFrame:
    """Dictionary-encodes order keys, sums revenue by code, and decodes the codes."""
    keys = _orders(spark, sf)
    index = build_partitioned(keys, "key", _config("partitioned"))
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_extendedprice", "l_discount")
    exact = F.round(F.col("l_extendedprice") * 100).cast("long") * (100 - F.round(F.col("l_discount") * 100).cast("long"))  # no rounding by order
    coded = index.lookup(lines, "l_orderkey", "code").groupBy("code").agg(F.count(F.lit(1)).alias("lines"), (F.sum(exact).cast("double") / 10000).alias("revenue"))
    return coded.join(index.verified(keys, "key"), F.col("code") == F.col("position")).select("key", "lines", "revenue")


@_query("SELECT o_orderkey * 3 AS probe, o_orderkey * 3 < (SELECT count(*) FROM orders) AS member FROM orders")
def semi_join_verified(spark: SparkSession, sf: str) -> DataFrame:
    """Membership of keys, a third of them built in: the position's own key decides."""
    keys = _orders(spark, sf)
    index = build_single(keys, "key", _config("single"))
    probes = index.lookup(keys.select((F.col("key") * 3).alias("probe")), "probe", "at")
    own = index.verified(keys, "key")
    return probes.join(own, F.col("at") == F.col("position"), "left").select("probe", F.coalesce(F.col("probe") == F.col("key"), F.lit(False)).alias("member"))
