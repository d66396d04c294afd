import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from keyloom.llm import language, textkit

WORDS = {"xx": "tha inge orn est ofa".split(), "yy": "kul vaz mek zug rok".split(), "zz": "été çoi lèau ñue êpa".split()}


def corpus(n, seed=1):
    r = random.Random(seed)
    return [(i, " ".join(r.choices(WORDS[lang], k=r.randint(3, 60))), lang) for i in range(n) for lang in [r.choice(list(WORDS))]]


@pytest.mark.parametrize("piece", [1, 2, 3, 7, 1 << 20])
def test_counts_as_brute_force(monkeypatch, piece):
    monkeypatch.setattr(textkit, "PIECE", piece)
    texts = ["Abc  d1é x", "", None, "z", "  ", "Ab" * 9]
    found, total = language.counts(pa.array(texts))
    for i, t in enumerate(texts):
        b = bytes([32, *language._CLASS[np.frombuffer((t or "").encode(), np.uint8)].tolist(), 32]) if t else b""
        each = Counter(b[j : j + n] for n in (1, 2, 3) for j in range(len(b) - n + 1) if b"  " not in b[j : j + n] and b[j : j + n] != b" ")
        assert total[i] == sum(each.values()) == found[i].sum()
        assert np.sort(found[i])[::-1][: len(each)].tolist() == sorted(each.values(), reverse=True)


def test_held_out_accuracy_and_rejection(spark):
    docs = spark.createDataFrame([(*d, "own") for d in corpus(600)], "doc_id long, text string, lang string, score string")
    model = language.fit(docs.where(~language.held_out()))
    got = language.identify(docs.where(language.held_out()), model).collect()
    assert len(got) > 100 and sum(r.lang == r.lang_pred for r in got) / len(got) > 0.98
    assert all(0 <= r.score <= 1 and not r.rejected for r in got)
    odd = [(1, None), (2, ""), (3, "123 !?"), (4, "éé"), (5, "qxjwq bxjwp " * 60), (6, "tha inge"), (6, "tha inge")]
    got = language.identify(spark.createDataFrame(odd, "doc_id long, text string"), model).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 7 and [by[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and all(by[i].rejected for i in (1, 2, 3, 5))
    assert by[4].lang_pred == "zz" and by[6].lang_pred == "xx" and not by[6].rejected


def test_no_training_rows(spark):
    docs = spark.createDataFrame([(1, "a", None)], "doc_id long, text string, lang string")
    model = language.fit(docs)
    assert [r.lang_pred for r in language.identify(docs, model).collect()] == ["und"]
    assert language.identify(docs.limit(0), model).count() == 0


def test_sample_keeps_its_bound(spark):
    some = spark.range(2 * language.PER_LANGUAGE).select(
        F.lit(None).cast("long").alias("doc_id"), F.format_string("words of text %06d", "id").alias("text"), F.lit("en").alias("lang")
    )
    assert language._sample(some).count() == language.PER_LANGUAGE
    assert language._sample(some.withColumn("text", F.lit("one text"))).count() == 1
    assert language._sample(some.limit(0)) is None
