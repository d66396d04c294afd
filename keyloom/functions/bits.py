"""Bit vectors as DataFrames of set positions (pos): rank, select, runs of bits; and words as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .u64 import lit, shr

#: Positions of a block; ranks add up counts of blocks and places within them, so no task sees all positions.
BLOCK_BITS = 12


def _ranked(bits: DataFrame) -> DataFrame:
    """bits with rank: set positions before pos."""
    blocked = bits.select("pos").distinct().withColumn("block", shr(F.col("pos"), BLOCK_BITS))
    counts = blocked.groupBy("block").agg(F.count(F.lit(1)).alias("c"))
    # Blocks of blocks: one prefix sum over few rows, one within each.
    counts = counts.withColumn("super", shr(F.col("block"), BLOCK_BITS))
    supers = counts.groupBy("super").agg(F.sum("c").alias("c"))
    supers = supers.select("super", F.coalesce(F.sum("c").over(Window.orderBy("super").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("s"))
    inner = F.coalesce(F.sum("c").over(Window.partitionBy("super").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.withColumn("b", inner).join(supers, "super").select("block", (F.col("s") + F.col("b")).alias("before"))
    within = F.row_number().over(Window.partitionBy("block").orderBy("pos")) - 1
    return blocked.withColumn("within", within).join(counts, "block").select("pos", (F.col("before") + F.col("within")).cast("long").alias("rank"))


def rank1(bits: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (pos) with rank: set positions below pos; beyond the last, all of them."""
    blocked = bits.select("pos").distinct().withColumn("block", shr(F.col("pos"), BLOCK_BITS)).select("pos", "block", F.lit(None).cast("boolean").alias("asks"))
    each = asked.select("pos").distinct().withColumn("block", shr(F.col("pos"), BLOCK_BITS)).select("pos", "block", F.lit(True).alias("asks"))
    both = blocked.unionByName(each)
    set_ = F.when(F.col("asks").isNull(), 1)
    counts = both.groupBy("block").agg(F.count(set_).alias("c")).withColumn("super", shr(F.col("block"), BLOCK_BITS))
    supers = counts.groupBy("super").agg(F.sum("c").alias("c"))
    supers = supers.select("super", F.coalesce(F.sum("c").over(Window.orderBy("super").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("s"))
    inner = F.coalesce(F.sum("c").over(Window.partitionBy("super").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.withColumn("b", inner).join(supers, "super").select("block", (F.col("s") + F.col("b")).alias("before"))
    below = Window.partitionBy("block").orderBy("pos").rangeBetween(Window.unboundedPreceding, -1)
    out = both.withColumn("within", F.count(set_).over(below)).where("asks").join(counts, "block")
    return out.select("pos", (F.col("before") + F.col("within")).cast("long").alias("rank"))


def select1(bits: DataFrame, asked: DataFrame, size: int) -> DataFrame:
    """asked (k) with pos: the position of the set bit with k before it; ``size`` if there is none."""
    return asked.join(_ranked(bits), F.col("k") == F.col("rank"), "left").select("k", F.coalesce("pos", F.lit(size)).cast("long").alias("pos"))


def get_bits(words: DataFrame, asked: DataFrame, width: int) -> DataFrame:
    """asked (pos) with value: ``width`` bits (to 63) from pos of words (i, word), across the border of two."""
    at = asked.select("pos", F.floor(F.col("pos") / 64).alias("i"), (F.col("pos") % 64).cast("int").alias("off"))
    low = at.join(words, "i").withColumnRenamed("word", "low")
    both = low.join(words.select((F.col("i") - 1).alias("i"), F.col("word").alias("high")), "i", "left")
    value = F.call_function("shiftrightunsigned", F.col("low"), F.col("off"))
    more = F.when(F.col("off") > 64 - width, F.call_function("shiftleft", F.coalesce("high", F.lit(0).cast("long")), 64 - F.col("off"))).otherwise(F.lit(0).cast("long"))
    return both.select("pos", value.bitwiseOR(more).bitwiseAND(lit((1 << width) - 1)).alias("value"))


def popcount(x: Column) -> Column:
    return F.bit_count(x)


def select_in_word(word: Column, k: Column) -> Column:
    """Position of the set bit of a BIGINT with k set bits below it; 64 if there is none."""
    places = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("getbit", word, i) == 1)
    return F.coalesce(F.get(places, k.cast("int")), F.lit(64)).cast("int")


def with_set(bits: DataFrame, more: DataFrame) -> DataFrame:
    return bits.select("pos").unionByName(more.select("pos")).distinct()


def without(bits: DataFrame, gone: DataFrame) -> DataFrame:
    return bits.join(gone.select("pos"), "pos", "left_anti")


def words(bits: DataFrame) -> DataFrame:
    """i, word: the vector in words of 64 bits; words without set bits are left out."""
    one = F.expr("shiftleft(1L, CAST(pos % 64 AS INT))")
    return bits.groupBy(F.floor(F.col("pos") / 64).alias("i")).agg(F.bit_or(one).alias("word"))
