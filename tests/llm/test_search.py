import random

import numpy as np
from pyspark.sql import functions as F

from keyloom.llm import search


def brute(rows, asks, k):
    out = {}
    for q, v in rows:
        if asks(q):
            best = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i) for i, w in rows if i != q)[:k]
            out[q] = [(r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return out


def check(spark, rows, k=5):
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "id long, vector array<long>, score string")
    got = {}
    for r in search.top_k(df, search.F.col("id") % 7 == 0, k).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert {q: sorted(x) for q, x in got.items()} == {q: x for q, x in brute(rows, lambda i: i % 7 == 0, k).items() if x}


def test_as_brute_force(spark, monkeypatch):
    monkeypatch.setattr(search, "SHARD_LEAST", 60)
    r = random.Random(3)
    check(spark, [(i, [r.randint(-90, 90) for _ in range(16)]) for i in range(400)])
    check(spark, [(i, [r.choice([0, 0, 0, 0, r.randint(0, 50)]) for _ in range(40)]) for i in range(300)])
    check(spark, [(i, [5, -3, 2] if i % 3 else [r.randint(-2, 2) for _ in range(3)]) for i in range(300)])  # ties
    check(spark, [(i, [r.randint(-9, -1) for _ in range(4)]) for i in range(200)])
    check(spark, [(i, [r.randint(-9, 9) for _ in range(i % 5)]) for i in range(200)])  # lengths differ
    check(spark, [(i, [1]) for i in range(4)])


def test_nulls_and_empty(spark):
    df = spark.createDataFrame([(0, [1.0, float("nan")]), (7, [0.5, 0.5]), (None, [1.0, 1.0]), (8, None), (9, [None, 1.0]), (10, [-0.001, 1.0])], "vec_id long, embedding array<float>")
    got = search.top_k(search.scaled(df), search.F.lit(True)).collect()
    assert sorted((r.query_id, r.vec_id, r.score) for r in got) == [(7, 10, 128 * -1 + 128 * 256), (10, 7, 128 * -1 + 128 * 256)]
    assert search.top_k(search.scaled(df.limit(0)), search.F.lit(True)).count() == 0


def test_prunes(monkeypatch):
    """On sparse rows far from all are met."""
    r = np.random.default_rng(1)
    rows = np.where(r.random((5000, 200)) < 0.02, r.integers(1, 100, (5000, 200)), 0)
    shard = search.Shard(np.arange(5000), rows)
    met = []
    first = search.Shard._first
    monkeypatch.setattr(search.Shard, "_first", lambda self, at, s, k: met.append(len(at)) or first(self, at, s, k))
    query = np.zeros(200, np.int64)
    query[:4] = [100, 80, 3, 2]
    ids, scores = shard.best(-1, query, 5)
    assert scores.tolist() == sorted((rows @ query).tolist(), reverse=True)[:5] and met[0] < 500


def test_blocks_of_queries(spark, monkeypatch):
    rows = spark.range(300).select("id", F.transform(F.sequence(F.lit(1), F.lit(6)), lambda d: F.pmod(F.xxhash64("id", d), F.lit(41)) - 20).alias("vector"))
    asks = F.col("id") % 3 == 0
    whole = search.top_k(rows, asks).collect()
    monkeypatch.setattr(search, "BLOCK", 17)
    monkeypatch.setattr(search, "SHARD_ROWS", 90)
    assert len(whole) == 500 and sorted(search.top_k(rows, asks).collect()) == sorted(whole)
