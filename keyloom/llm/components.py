"""Connected components by alternating large-star and small-star (Kiveris and others, 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Scratch


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """edges: a > b. One star operation; what a node gathers is its least neighbour, never a list of them."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("at"), F.least("a", "m").alias("m"))
    moved = both.join(least, F.col("a") == F.col("at"))
    if large:
        out = moved.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = moved.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*")
    return out.where("a > b").distinct()


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """node and root (the least node of its component) for all nodes of edges (a long, b long) but the roots.

    Loops and repeated edges do no harm; rows with a null end are no edges. No edges give no rows.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = scratch.save(edges, f"{name}-0")
    step, before = 0, None
    while True:
        seen = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.pmod(F.xxhash64("b", "a"), F.lit(1 << 30)))).first()
        if seen == before or not seen[0]:
            break
        before, step = seen, step + 1
        now = scratch.save(_stars(_stars(now, True), False), f"{name}-{step}")
        scratch.drop(f"{name}-{step - 1}")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
