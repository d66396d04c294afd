"""Elements of encoded sequences, read one by one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from keyloom.operators import codecs

WHERE = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", codecs.CODECS)
@pytest.mark.parametrize("high", [1, 2, 300, 1 << 40])
def test_any_place(name, high):
    rng = np.random.default_rng(high)
    v = rng.integers(0, high, 1500).astype(np.uint64)
    v = np.sort(v) if name == "elias_fano" else v
    codec = codecs.CODECS[name]
    width, upper, lower = codec.encode(v)
    at = rng.permutation(np.repeat(np.arange(1500), 2))
    assert (codec.access(width, upper, lower, at) == v[at]).all()
    assert len(codec.access(width, upper, lower, at[:0])) == 0


@pytest.mark.parametrize("codec", ["rice", "diff_rice"])
def test_places_that_are_not_there(spark, codec):
    rows = spark.createDataFrame([(g, i, i * 9 + g) for g in (1, 2) for i in range(20)], "g int, i int, v int")
    coded = codecs.encode(rows, "g", "i", "v", codec)
    asked = spark.createDataFrame([(1, 0), (1, 0), (1, 19), (1, 20), (1, -1), (3, 0), (2, 7), (None, 1), (2, None)], "g int, i int")
    got = sorted(tuple(r) for r in codecs.access(coded, asked).select("g", "i", F.coalesce("v", F.lit(-1))).collect())
    assert got == [(1, -1, -1), (1, 0, 1), (1, 19, 172), (1, 20, -1), (2, 7, 65), (3, 0, -1)]
    assert codecs.access(coded, asked.limit(0)).count() == 0
    assert [r.v for r in codecs.access(coded.limit(0), asked).collect()] == [None] * 6


@pytest.mark.parametrize("name", codecs.DENSE)
def test_dense_places(spark, name):
    pilots = spark.range(1001).select((F.col("id") % 7).alias("partition_id"), F.floor(F.col("id") / 7).alias("bucket"), (F.col("id") * 31 % 97).alias("pilot"))
    coded = codecs.encode_dense(pilots, 7, name, 100)
    asked = spark.createDataFrame([(0, 0), (6, 142), (3, 77), (3, 77), (7, 1), (-1, 1), (0, 143), (6, -1), (None, 1), (2, None)], "partition_id int, bucket int")
    got = {(r.partition_id, r.bucket): r.pilot for r in codecs.access_dense(coded, asked, 7, name, 100).collect()}
    there = {(p, b): (b * 7 + p) * 31 % 97 for p, b in ((0, 0), (6, 142), (3, 77))}
    assert got == there | dict.fromkeys([(7, 1), (-1, 1), (0, 143), (6, -1)])


@pytest.mark.parametrize("name", ["rice_access", "diff_compact_access", "dense_mono_r_access"])
def test_larger_tables(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{WHERE}/orders.parquet'")
    want = con.execute(entry.oracle_sql()[name]).df()
    got = entry.queries()[name](spark, WHERE).toPandas()[list(want.columns)]
    plain = lambda df: sorted(map(tuple, df.astype("float").fillna(-1).to_numpy().tolist()))
    assert plain(got) == plain(want)
