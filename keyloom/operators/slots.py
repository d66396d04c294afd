"""Partition offsets, and the remap of slots beyond the number of keys onto holes below it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import BuildConfig, table_size_column
from ..functions.u64 import two64_mod


def partition_table(spark: SparkSession, counts: DataFrame, partitions: int, config: BuildConfig) -> DataFrame:
    """partition_id, num_keys, table_size, offset, two64_mod_m of all partitions, empty ones too.

    counts: partition_id, num_keys. Offsets add up table sizes, but keys if the partitions are minimal themselves.
    """
    every = spark.range(partitions).withColumnRenamed("id", "partition_id")
    sized = every.join(counts, "partition_id", "left").select("partition_id", F.coalesce("num_keys", F.lit(0)).cast("long").alias("num_keys"))
    m = F.when(F.col("num_keys") == 0, F.lit(0)).otherwise(table_size_column(F.col("num_keys"), config.alpha, config.search)).cast("long")
    sized = sized.withColumn("table_size", m)
    width = F.col("num_keys") if config.minimal and not config.dense else F.col("table_size")
    # One row per partition of the function meets in one task here, never the keys.
    before = Window.orderBy("partition_id").rowsBetween(Window.unboundedPreceding, -1)
    sized = sized.withColumn("offset", F.coalesce(F.sum(width).over(before), F.lit(0)).cast("long"))
    modulus = F.when(F.col("table_size") > 0, two64_mod(F.greatest("table_size", F.lit(1).cast("long")))).otherwise(F.lit(0).cast("long"))
    return sized.withColumn("two64_mod_m", modulus)


def words(taken: DataFrame) -> DataFrame:
    """partition_id, i, word: 64 slots each, taken ones (partition_id, pos) as bits; words without any are left out."""
    bit = F.expr("shiftleft(1L, cast(pos % 64 as int))")
    return taken.groupBy("partition_id", F.expr("pos div 64").alias("i")).agg(F.bit_or(bit).alias("word"))


def taken_slots(words: DataFrame) -> DataFrame:
    """partition_id, pos of the bits of words."""
    return words.select("partition_id", F.explode(F.expr("filter(sequence(i * 64, i * 64 + 63), p -> getbit(word, cast(p % 64 as int)) = 1)")).alias("pos"))


def free_slots(taken: DataFrame, partitions: DataFrame) -> DataFrame:
    """free_slots_of of taken slots (partition_id, pos)."""
    return free_slots_of(words(taken), partitions)


def free_slots_of(words: DataFrame, partitions: DataFrame) -> DataFrame:
    """partition_id, rank, slot for each partition's slots from num_keys on, rank counting from there.

    A used slot gets the next hole below num_keys; an unused one what the next used slot gets, or the last did (0 if
    none did), so that the slots do not fall. Only holes and the slots from num_keys on become rows; the windows sort
    those of a partition and add up from the first, once.
    """
    sized = partitions.where("num_keys > 0").select("partition_id", "num_keys", "table_size")
    every = sized.select("*", F.explode(F.expr("sequence(0L, (table_size - 1) div 64)")).alias("i"))
    every = every.join(words.select("partition_id", "i", "word"), ["partition_id", "i"], "left").withColumn("word", F.coalesce("word", F.lit(0).cast("long")))
    wanted = F.expr("filter(sequence(i * 64, least(i * 64 + 63, table_size - 1)), p -> p >= num_keys OR getbit(word, cast(p % 64 as int)) = 0)")
    marked = every.select("partition_id", "num_keys", "word", F.explode(wanted).alias("pos"))
    marked = marked.select("partition_id", "num_keys", "pos", F.expr("cast(getbit(word, cast(pos % 64 as int)) as long)").alias("used"))
    by_pos = Window.partitionBy("partition_id").orderBy("pos")
    holes = marked.where("pos < num_keys").select("partition_id", F.row_number().over(by_pos).cast("long").alias("nth"), F.col("pos").alias("slot"))
    # The nth used slot takes the nth hole; an unused one that of the next used, the last ones that of the last used.
    upto, all_ = by_pos.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("partition_id")
    above = marked.where("pos >= num_keys").withColumns({"upto": F.sum("used").over(upto), "all": F.sum("used").over(all_)})
    above = above.select("partition_id", (F.col("pos") - F.col("num_keys")).alias("rank"), F.least(F.col("upto") + 1 - F.col("used"), "all").alias("nth"))
    return above.join(holes, ["partition_id", "nth"], "left").select("partition_id", "rank", F.coalesce("slot", F.lit(0).cast("long")).alias("slot"))


def dense_free_slots(taken: DataFrame, partitions: DataFrame, n: int) -> DataFrame:
    """rank, slot for the slots from n on over all partitions, as one table of the sum of their sizes.

    Positions are numbered within partitions and shifted by what the partitions before hold, so no task sees more
    than a partition.
    """
    sized = partitions.where("num_keys > 0").select("partition_id", "offset", "table_size")
    every = sized.select("partition_id", "offset", F.explode(F.sequence(F.lit(0).cast("long"), F.col("table_size") - 1)).alias("pos"))
    marked = every.join(taken.select("partition_id", "pos", F.lit(True).alias("used")), ["partition_id", "pos"], "left")
    marked = marked.select("partition_id", (F.col("offset") + F.col("pos")).alias("at"), F.coalesce("used", F.lit(False)).alias("used"))
    hole, over = ~F.col("used") & (F.col("at") < n), F.col("used") & (F.col("at") >= n)
    marked = marked.select("partition_id", "at", hole.alias("hole"), over.alias("over")).where(F.col("hole") | (F.col("at") >= n))
    ahead = Window.orderBy("partition_id").rowsBetween(Window.unboundedPreceding, -1)
    totals = marked.groupBy("partition_id").agg(F.sum(F.col("hole").cast("long")).alias("h"), F.sum(F.col("over").cast("long")).alias("o"))
    totals = totals.select("partition_id", F.coalesce(F.sum("h").over(ahead), F.lit(0)).alias("h"), F.coalesce(F.sum("o").over(ahead), F.lit(0)).alias("o"), F.sum("o").over(Window.partitionBy(F.lit(0))).alias("all"))
    inside = Window.partitionBy("partition_id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    joined = marked.join(totals, "partition_id")
    before_holes = F.col("h") + F.coalesce(F.sum(F.col("hole").cast("long")).over(inside), F.lit(0))
    before_over = F.col("o") + F.coalesce(F.sum(F.col("over").cast("long")).over(inside), F.lit(0))
    holes = joined.withColumn("nth", before_holes).where("hole").select("nth", F.col("at").alias("slot"))
    # The nth used slot takes the nth hole; an unused one that of the next used, the last ones that of the last used.
    above = joined.withColumn("nth", before_over).where(F.col("at") >= n)
    above = above.select(F.least("nth", F.col("all") - 1).alias("nth"), (F.col("at") - n).alias("rank"))
    return above.join(holes, "nth", "left").select("rank", F.coalesce("slot", F.lit(0).cast("long")).alias("slot"))
