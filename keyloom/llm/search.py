"""Exact top-k inner-product search by MaxScore over sharded posting lists.

A shard keeps, for each dimension and sign, the rows with such a component and the largest of them. A query's terms are
its dimensions with the sign that raises the score; |q| times the largest component bounds what a term can add. With
terms by falling bound, those whose bounds together cannot lift a row to the k-th best score so far are non-essential:
only the postings of the others are traversed, and the rows met are probed in the rest while they are competitive.
Each shard gives its k best of each query, and these are merged. Many queries are dealt to blocks; each pair of a shard
and a block is a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import Scratch

#: Rows of a shard on the average, shards at least where there are rows enough, rows that give the first threshold of
#: a query by each of its strongest terms, and dimensions probed between two looks at the threshold.
SHARD_ROWS, LEAST_SHARDS, SHARD_LEAST = 65_536, 12, 2_048
SEED_TERMS, SEED_ROWS, PROBES = 12, 24, 8
#: Queries that one task asks of a shard on the average.
BLOCK = 8_192


class Shard:
    """Posting lists of one shard, by dimension and sign, with the places of the largest components of each."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        self.ids, self.by_dim = ids, np.ascontiguousarray(rows.T)
        self.postings = []
        for values in self.by_dim:
            both = []
            for sign in (1, -1):
                at = np.flatnonzero(values * sign > 0)
                own = np.abs(values[at])
                top = at[np.argpartition(-own, SEED_ROWS)[:SEED_ROWS]] if len(at) > SEED_ROWS else at
                both.append((at, own, int(own.max()) if len(own) else 0, top))
            self.postings.append(both)

    def best(self, own_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best rows but those of ``own_id``."""
        query = np.pad(query, (0, max(0, len(self.by_dim) - len(query))))[: len(self.by_dim)]
        terms = [(abs(q) * self.postings[d][int(q < 0)][2], d) for d, q in enumerate(query.tolist()) if q]
        terms = sorted(((b, d) for b, d in terms if b), reverse=True)
        rest = np.concatenate([np.cumsum([b for b, _ in terms][::-1])[::-1], [0]]).astype(np.int64)
        seeds = [self.postings[d][int(query[d] < 0)][3] for _, d in terms[:SEED_TERMS]]
        seeds = np.unique(np.concatenate(seeds)) if seeds else np.zeros(0, np.int64)
        seeds = seeds[self.ids[seeds] != own_id]
        floor = None
        if len(seeds) >= k:
            floor = int(np.partition(query @ self.by_dim[:, seeds], len(seeds) - k)[len(seeds) - k])
        if floor is None or floor <= 0:  # rows without any raising term can be among the best
            at = np.flatnonzero(self.ids != own_id)
            return self._first(at, query @ self.by_dim[:, at], k)
        essential = int(np.searchsorted(-rest, -floor, "right"))  # the first place from which all bounds stay below
        essential = min(essential, len(terms))
        found = np.zeros(len(self.ids), np.int64)
        for _, d in terms[:essential]:
            at, own, _, _ = self.postings[d][int(query[d] < 0)]
            found[at] += abs(int(query[d])) * own
        at = np.flatnonzero((found > 0) & (found + rest[essential] >= floor))
        at = at[self.ids[at] != own_id]
        score = found[at]
        met = {d for _, d in terms[:essential]}
        bounds = {d: b for b, d in terms}
        lower = sorted(met, key=lambda d: -abs(int(query[d])))  # of these the lowering side is still to come
        others = [d for _, d in terms[essential:]]
        others += [d for d in np.flatnonzero(query).tolist() if d not in bounds]
        left = int(rest[essential])
        for i, d in enumerate(lower + others):
            q = int(query[d])
            values = q * self.by_dim[d, at]
            if d in met:
                score += np.minimum(values, 0)
            else:
                score += values
                left -= bounds.get(d, 0)
            if i % PROBES == PROBES - 1:
                stays = score + left >= floor
                at, score = at[stays], score[stays]
        return self._first(at, score, k)

    def _first(self, at: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        if len(at) > k:
            stays = score >= np.partition(score, len(at) - k)[len(at) - k]
            at, score = at[stays], score[stays]
        order = np.lexsort((self.ids[at], -score))[:k]
        return self.ids[at[order]], score[order]


def _matrix(column: pa.Array, wide: int | None = None) -> np.ndarray:
    """Rows of integers, short ones filled with zeros."""
    sizes = np.diff(column.offsets.to_numpy(zero_copy_only=False))
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if len(sizes) and (sizes == sizes[0]).all():
        return values.reshape(len(sizes), int(sizes[0]))
    out = np.zeros((len(sizes), int(sizes.max()) if len(sizes) else 0), np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = values
    return out


def _stacked(parts: list[np.ndarray]) -> np.ndarray:
    wide = max((p.shape[1] for p in parts), default=0)
    return np.concatenate([np.pad(p, ((0, 0), (0, wide - p.shape[1]))) for p in parts]) if parts else np.zeros((0, 0), np.int64)


def _searched(k: int):
    """Rows come by shard and block, first those of the shard, then the queries of the block, one after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, rows, shard = None, [], [], None
        for batch in batches:
            which, asked = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            cuts = np.flatnonzero((which[1:] != which[:-1]) | (asked[1:] != asked[:-1])) + 1
            out: list[tuple] = []
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                if lo == hi:
                    continue
                if which[lo] != now:
                    now, ids, rows, shard = which[lo], [], [], None
                part = batch.slice(lo, hi - lo)
                own, vectors = part.column(3).to_numpy(), _matrix(part.column(4))
                if not asked[lo]:
                    ids.append(own)
                    rows.append(vectors)
                    continue
                if shard is None and ids:
                    shard, ids, rows = Shard(np.concatenate(ids), _stacked(rows)), [], []
                if shard is not None:
                    for row, own_id, vector in zip(part.column(2).to_pylist(), own.tolist(), vectors, strict=True):
                        out += [(row, own_id, i, s) for i, s in zip(*(x.tolist() for x in shard.best(own_id, vector, k)), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], pa.int64()) for j in range(4)], ["row", "query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, is_query, k: int = 5) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row of ``vectors`` where ``is_query``, its k best other rows.

    vectors: id long, vector array<long>; other columns are only read by ``is_query``. The score is the integer inner
    product (components and scores must fit in 64 bits); ties go to the smaller id, and a row is no candidate of
    a query with its id. Missing components are 0. Rows without id or vector, or with a null component, take no part;
    a query with fewer candidates than k gets all. Repeated query rows get their results each. No rows give none.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "search")
    whole = F.col("id").isNotNull() & F.col("vector").isNotNull() & ~F.exists("vector", lambda x: x.isNull())
    rows = vectors.where(whole).select(F.monotonically_increasing_id().alias("row"), "id", "vector", is_query.alias("asks"))
    rows = scratch.save(rows, "rows")
    n, queries = rows.agg(F.count(F.lit(1)), F.count_if("asks")).first()
    shards = max(1, -(-n // SHARD_ROWS), min(LEAST_SHARDS, n // SHARD_LEAST))
    blocks = max(1, -(-queries // BLOCK))
    each = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    dealt = lambda k: F.pmod(F.xxhash64("row"), F.lit(k)).cast("int")
    stored = rows.select(dealt(shards).alias("shard"), each(blocks).alias("block"), F.lit(False).alias("asks"), "row", "id", "vector")
    asked = rows.where("asks").select(each(shards).alias("shard"), dealt(blocks).alias("block"), F.lit(True).alias("asks"), "row", "id", "vector")
    placed = stored.unionByName(asked).select((F.col("shard") * blocks + F.col("block")).alias("place"), "asks", "row", "id", "vector")
    by_shard = placed.repartitionById(shards * blocks, "place").sortWithinPartitions("place", "asks")
    found = by_shard.mapInArrow(_searched(k), "row long, query_id long, vec_id long, score long")
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")


def scaled(embeddings: DataFrame, by: int = 256) -> DataFrame:
    """id and vector of integers floor(by * x); vectors with a null or non-finite component are null."""
    fits = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    vector = F.when(fits, F.transform("embedding", lambda x: F.floor(x.cast("double") * by).cast("long")))
    return embeddings.select(F.col("vec_id").alias("id"), vector.alias("vector"))
