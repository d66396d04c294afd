import math
import random
from collections import defaultdict

from keyloom.llm import mixing


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in capped]
        rest = total - sum(capped.values())
        want = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if want[s] > 3 * sizes[s]]
        if not over:
            return capped | want
        capped |= {s: 3 * sizes[s] for s in over}


def rows(seed, n=400):
    r = random.Random(seed)
    sources = ["b", "a", None, "é", "\U0001f600", "￿", "tiny"]
    out = [(i, " ".join(["w"] * r.choice([0, 1, 5, 40, 300])), r.choices(sources, [60, 5, 5, 3, 3, 3, 1])[0]) for i in range(n)]
    return [*out, (n, None, "a"), (n, None, "a"), (None, "a b", None), (7, "x y", "none of this")]


def test_targets_and_selection(spark, monkeypatch):
    monkeypatch.setattr(mixing, "ROWS_A_BIN", 10)
    data = rows(1)
    docs = spark.createDataFrame([(*d, 1.0) for d in data], "doc_id long, text string, source string, target double")
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 400, 3)] + [(3, 1), (None, 1), (4, None)], "doc_id long, quality int")
    got = mixing.decisions(docs, labels).collect()
    assert len(got) == len(data)
    sizes = defaultdict(int)
    for _, t, s in data:
        sizes[s] += len((t or "").split())
    want = brute_targets(sizes)
    taken, largest = defaultdict(int), defaultdict(int)
    for r in got:
        assert math.isclose(r.target, want[r.source], rel_tol=1e-9, abs_tol=1e-9), (r, want)
        assert r.source_size == sizes[r.source] and 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s]
    again = mixing.decisions(docs.repartition(7), labels.repartition(3)).collect()
    key = lambda r: (str(r.doc_id), str(r.source), r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_order_is_by_key(spark):
    data = [(i, "a b c", "big") for i in range(300)] + [(i, "a", "small") for i in range(300, 310)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string")
    got = mixing.decisions(docs).where("source = 'big'")
    keyed = got.withColumn("k", mixing.sampling_key(got.doc_id, got.digest, mixing.F.lit(mixing.PLAIN_WEIGHT), "mix"))
    order = [r.copies for r in keyed.orderBy("k").collect()]
    assert order == sorted(order, reverse=True) and len(set(order)) == 2


def test_mix_keeps_columns_and_empty(spark):
    docs = spark.createDataFrame(rows(2), "doc_id long, text string, source string").withColumn("size", mixing.F.lit("clash"))
    out = mixing.mix(docs)
    assert out.columns == ["doc_id", "text", "source", "size", "source_size", "target", "copies", "taken"]
    assert out.count() == docs.count()
    assert mixing.mix(docs.limit(0)).count() == 0
