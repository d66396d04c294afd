import random
import re

import pytest

from keyloom.llm import near_dedup
from keyloom.llm.components import components
from keyloom.llm.store import Scratch


def shingles(text):
    words = [w.decode() for w in (text or "").encode().lower().split()]
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} - {()}


def brute(docs):
    sets = [shingles(t) for _, t in docs]
    up = list(range(len(docs)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted(((d, len(s), least.get(root(i))) for i, ((d, _), s) in enumerate(zip(docs, sets, strict=True))), key=str)


def texts(seed, groups, most):
    r = random.Random(seed)
    out = []
    for _ in range(groups):
        base = [f"w{r.randint(0, 900)}" for _ in range(r.choice([3, 5, 30, 120]))]
        for _ in range(r.randint(1, most)):
            own = list(base)
            for _ in range(r.randint(0, 4)):
                own[r.randrange(len(own))] = f"w{r.randint(0, 900)}"
            out.append(r.choice([" ", "\n"]).join(own))
    r.shuffle(out)
    return list(enumerate(out, 10))


def check(spark, docs):
    df = spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, text string, component_id int").repartition(3)
    got = near_dedup.classes(df).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(docs)
    return df


@pytest.mark.parametrize("block, bucket", [(1000, 2000), (20, 2000), (7, 5)])
def test_as_brute_force(spark, monkeypatch, block, bucket):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    monkeypatch.setattr(near_dedup, "BUCKET", bucket)
    docs = texts(block, 25, 6) + [(i + 5000, t) for i, t in texts(block + 1, 2, 80)]
    check(spark, docs)


def test_odd_rows(spark):
    long = " ".join(f"x{i}" for i in range(30000))
    docs = [(3, None), (1, ""), (2, " \n"), (9, "One  two"), (8, "one TWO"), (7, "a b c d e"), (7, "a b c d e"), (7, "other words"), (None, "a b c d e"), (6, long), (5, long + " y"), (4, "É b c d e"), (11, "é b c d e")]
    df = check(spark, docs)
    kept = near_dedup.dedup(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [1, 11, 2, 3, 4, 5, 7, 7, 7, 8]
    assert near_dedup.classes(df.limit(0)).count() == 0


def test_components(spark):
    r = random.Random(4)
    edges = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)] + [(900, i) for i in range(500, 700)] + [(5, 5), (None, 1)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = sorted((root(a), root(b)))
            up[b] = a
    got = components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "test"), "t").collect()
    assert sorted((x.node, x.root) for x in got) == sorted((x, root(x)) for x in up if root(x) != x)
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "test"), "t").count() == 0
    assert re.match("file:|/", Scratch(spark, "test").root)
