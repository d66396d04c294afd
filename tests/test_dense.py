"""Dense encoders over all orders, and mono sequences in several ranges."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from keyloom.operators import codecs

WHERE = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["interleave_order", *(f"{c}_roundtrip" for c in codecs.DENSE)])
def test_every_order(spark, name):
    n = spark.read.parquet(f"{WHERE}/orders.parquet").count()
    got = entry.queries()[f"dense_{name}"](spark, WHERE).selectExpr("bucket * 7 + partition_id AS key", "pilot")
    want = spark.read.parquet(f"{WHERE}/orders.parquet").selectExpr("o_orderkey AS key", "o_custkey % 900 AS pilot")
    assert got.count() == n == got.join(want, ["key", "pilot"]).distinct().count()


@pytest.mark.parametrize("name", ["mono_r", "mono_c"])
def test_mono_in_ranges(spark, name):
    pilots = spark.range(1001).select((F.col("id") % 7).alias("partition_id"), F.floor(F.col("id") / 7).alias("bucket"), (F.col("id") * 31 % 97).alias("pilot"))
    coded = codecs.encode_dense(pilots, 7, name, 100)
    assert sorted(r.n for r in coded.collect()) == [1, *[100] * 10]
    got = codecs.decode_dense(coded, 7, name, 100).orderBy("bucket", "partition_id").collect()
    assert [(r.partition_id, r.bucket, r.pilot) for r in got] == [(i % 7, i // 7, i * 31 % 97) for i in range(1001)]
