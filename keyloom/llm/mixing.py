"""Mixing sources to target weights by weighted sampling without replacement (Efraimidis and Spirakis).

Every document draws an exponential key of rate ``weight``: ``-ln(u) / weight`` with ``u`` from a hash, so
reruns agree. A source whose target is e + f times its size gives e complete epochs and, of one more, the
documents with the smallest keys up to f of its size. Only built-in DataFrame functions run.

The order within a source is found without gathering the source anywhere: keys fall into bins, sums by bin
are prefix-summed, and only inside the bins are keys sorted. What comes out is one cut per source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import Scratch

WORD = r"[^\x20\x09-\x0D]+"
#: Weights by labelled quality: 1, 0, and none. None may be below LEAST_WEIGHT.
GOOD_WEIGHT, POOR_WEIGHT, PLAIN_WEIGHT = 2.0, 1.0, 1.5
LEAST_WEIGHT = 1.0
MOST_EPOCHS = 3
#: Rows that a bin of keys has on the average, and sources up to which the cuts are broadcast.
ROWS_A_BIN, BROADCAST_SOURCES = 2_000, 100_000


def n_words(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def digest(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def sampling_key(doc_id: Column, text_digest: Column, weight: Column, seed: str) -> Column:
    """Exponential of rate ``weight`` from 52 bits of a hash of id and text."""
    own = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")), text_digest))
    u = (F.conv(F.substring(own, 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(2**52))
    return -F.log(u) / weight


def quality_weights(labels: DataFrame) -> DataFrame:
    """One row per labelled doc_id with its weight; the best of several labels counts."""
    best = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("q"))
    weight = F.when(F.col("q") == 1, GOOD_WEIGHT).when(F.col("q") == 0, POOR_WEIGHT).otherwise(PLAIN_WEIGHT)
    return best.select(F.col("doc_id").alias("__wid"), weight.alias("__weight"))


def source_targets(sizes: DataFrame, share: float = 1.0) -> DataFrame:
    """Targets of (source, source_size): weights 1, 2, 3 repeating by source, null last, filled up to 3 times.

    With sources in order of cap / weight, the level is that of the first source which it leaves below its cap.
    One row per source meets in one task here, never the documents.
    """
    every = Window.partitionBy(F.lit(0))
    by_name = every.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    ranked = sizes.withColumn("__w", ((F.row_number().over(by_name) - 1) % 3 + 1).cast("double"))
    ranked = ranked.withColumn("__cap", MOST_EPOCHS * F.col("source_size").cast("double"))
    up = every.orderBy(F.col("__cap") / F.col("__w"), F.col("source").isNull(), F.col("source").cast("binary"))
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum(F.col("source_size").cast("double")).over(every) * share - F.coalesce(F.sum("__cap").over(before), F.lit(0.0))) / (
        F.sum("__w").over(every) - F.coalesce(F.sum("__w").over(before), F.lit(0.0))
    )
    levelled = ranked.withColumn("__level", level)
    free = F.when(F.col("__level") * F.col("__w") <= F.col("__cap"), F.struct(F.col("__cap") / F.col("__w"), "__level"))
    levelled = levelled.withColumn("__at", F.min(free).over(every)["__level"])
    target = F.coalesce(F.least(F.col("__cap"), F.col("__at") * F.col("__w")), F.col("__cap"))
    return levelled.select("source", "source_size", target.alias("target"))


def _cuts(keyed: DataFrame, share: float) -> DataFrame:
    """One row per source: source_size, target, epochs, and the key and doc_id up to which one more copy is taken.

    A document is in the fraction if its middle lies within it, which comes nearest to the target.
    """
    sizes = keyed.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("__rows"))
    bins = F.greatest(F.lit(1), F.ceil(F.sum("__rows").over(Window.partitionBy(F.lit(0))) / ROWS_A_BIN))
    sizes = sizes.withColumn("__bins", bins)
    sources = source_targets(sizes.select("source", "source_size"), share)
    sources = sources.join(sizes.select(F.col("source").alias("__s"), "__bins"), F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    sources = sources.withColumn("epochs", whole).withColumn("__rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    side = F.broadcast(sources) if sizes.count() <= BROADCAST_SOURCES else sources
    side = side.withColumnRenamed("source", "__s")
    binned = keyed.join(side, F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    binned = binned.withColumn("__bin", F.floor((1 - F.exp(-F.col("key") * LEAST_WEIGHT)) * F.col("__bins")))
    by_bin = binned.groupBy("source", "__bin").agg(F.sum("size").alias("__in"))
    ahead = Window.partitionBy("source").orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    by_bin = by_bin.withColumn("__ahead", F.coalesce(F.sum("__in").over(ahead), F.lit(0)))
    by_bin = by_bin.select(F.col("source").alias("__s"), F.col("__bin").alias("__b"), "__ahead")
    placed = binned.join(by_bin, F.col("source").eqNullSafe(F.col("__s")) & (F.col("__bin") == F.col("__b")))
    inside = Window.partitionBy("source", "__bin").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("__before", F.col("__ahead") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    within = (F.col("size") > 0) & (F.col("__before") + F.col("size") / 2 <= F.col("__rest"))
    last = placed.where(within).groupBy("source").agg(F.max(F.struct("key", "doc_id")).alias("cut"))
    last = last.withColumnRenamed("source", "__s")
    return sources.join(last, F.col("source").eqNullSafe(F.col("__s")), "left").select("source", "source_size", "target", "epochs", "cut")


def decisions(docs: DataFrame, labels: DataFrame | None = None, share: float = 1.0, seed: str = "mix") -> DataFrame:
    """One row per document: doc_id, source, digest (of its text), size, source_size, target, copies, taken.

    copies: complete epochs, and one more for documents of the fractional selection; taken: size times copies.
    docs: doc_id, text, source; other columns are not read. labels: doc_id, quality; without them all weigh the
    same. Null texts have size 0 and take nothing; a null source is a source of its own, the last. Rows alike in
    doc_id and text share a key, so both are taken or left. Empty tables give empty results.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    keyed = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), digest(F.col("text")).alias("digest"))
    weight = F.lit(PLAIN_WEIGHT)
    if labels is not None:
        keyed = keyed.join(quality_weights(labels), F.col("doc_id") == F.col("__wid"), "left")
        weight = F.coalesce(F.col("__weight"), weight)
    key = sampling_key(F.col("doc_id"), F.col("digest"), weight, seed)
    keyed = scratch.save(keyed.select("doc_id", "source", "size", "digest", key.alias("key")), "keyed")
    cuts = scratch.save(_cuts(keyed, share), "cuts").withColumnRenamed("source", "__s")
    side = F.broadcast(cuts) if cuts.count() <= BROADCAST_SOURCES else cuts
    more = (F.col("size") > 0) & (F.struct("key", "doc_id") <= F.col("cut"))
    copies = F.col("epochs") + F.when(more, 1).otherwise(0)
    out = keyed.join(side, F.col("source").eqNullSafe(F.col("__s"))).withColumn("copies", copies)
    taken = (F.col("size") * F.col("copies")).alias("taken")
    return out.select("doc_id", "source", "digest", "size", "source_size", "target", "copies", taken)


def mix(docs: DataFrame, labels: DataFrame | None = None, share: float = 1.0, seed: str = "mix") -> DataFrame:
    """``docs``, all columns, with size, source_size, target, copies and taken as in ``decisions``.

    A column of docs that has the name of an added one is replaced. Documents that the mix takes no copy of stay,
    with copies 0.
    """
    added = ["size", "source_size", "target", "copies", "taken"]
    made = decisions(docs, labels, share, seed).distinct()
    made = made.select(F.col("doc_id").alias("__id"), F.col("source").alias("__s"), F.col("digest").alias("__d"), *added)
    kept = docs.select(*[c for c in docs.columns if c not in added]).withColumn("__digest", digest(F.col("text")))
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & F.col("source").eqNullSafe(F.col("__s")) & (F.col("__digest") == F.col("__d"))
    return kept.join(made, same).drop("__id", "__s", "__d", "__digest")
