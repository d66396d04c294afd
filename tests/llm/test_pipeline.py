"""The pipeline on planted cases, and each stage on its own input."""

import random

import corpus_pipeline
from keyloom.llm import line_dedup

SYLLABLES = {"xx": "tha inge orn est ofa ble ren".split(), "yy": "kul vaz mek zug rok bim dop".split()}


def text(r, lang, n):
    words = ["".join(r.choices(SYLLABLES[lang], k=r.randint(1, 4))) for _ in range(n)]
    return "\n".join(" ".join(words[i : i + 12]) for i in range(0, n, 12))


def planted(tmp_path, spark):
    r = random.Random(17)
    docs = [(i, text(r, lang, r.randint(30, 90)), lang, f"src{i % 3}") for i in range(240) for lang in [r.choice(["xx", "yy"])]]
    bench = [(i, text(r, "xx", 40)) for i in range(5)]
    rows = list(docs)
    rows += [(1000 + i, docs[i][1], docs[i][2], "src0") for i in range(5)]  # exact copies
    words = docs[20][1].split(" ")
    rows.append((1010, " ".join([*words[:-1], "changed"]), docs[20][2], "src1"))  # a near copy
    rows.append((1020, docs[30][1] + "\n" + bench[2][1] + "\n" + text(r, "xx", 12), "xx", "src2"))  # a leak
    rows += [(1030, "12345 67 !!", "xx", "src0"), (1031, None, None, None), (1032, "", "xx", "src1")]  # rejected
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(*x, len(x[1] or "")) for x in rows], schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(i, i % 2, 0) for i in range(0, 240, 2)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path), docs


def test_stages_on_planted_cases(spark, tmp_path):
    where, clean = planted(tmp_path, spark)
    docs = spark.read.parquet(f"{where}/documents.parquet")
    columns, kept = docs.columns, {}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontamination", "mixing"]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, where)
        assert name == "mixing" or out.columns == columns
        out.write.parquet(str(tmp_path / f"out-{name}"))
        docs = spark.read.parquet(str(tmp_path / f"out-{name}"))
        kept[name] = {r.doc_id: r for r in docs.collect()}
        if i < 4:
            assert {x[0] for x in clean} <= kept[name].keys(), name  # clean documents stay
    assert not {1030, 1031, 1032} & kept["language_id"].keys() and {1000, 1010, 1020} <= kept["language_id"].keys()
    assert not {1000, 1001, 1002, 1003, 1004} & kept["line_dedup"].keys()  # all their lines stand before
    assert all(kept["line_dedup"][x[0]].text == x[1] for x in clean if x[0] < 30)
    assert all(r.n_chars == len(r.text) for r in kept["line_dedup"].values())
    assert kept["near_dedup"].keys() <= kept["line_dedup"].keys() and 1020 in kept["near_dedup"] and 1020 not in kept["decontamination"]
    mixed = kept["mixing"]
    assert mixed.keys() <= kept["decontamination"].keys() and all(1 <= r.copies <= 3 and r.taken == r.copies * r["size"] for r in mixed.values())
    total, by = sum(len(r.text.split()) for r in kept["decontamination"].values()), {}
    for r in mixed.values():
        by[r.source] = by.get(r.source, 0) + r.taken
        assert abs(r.target - total * (1, 2, 3)[int(r.source[3])] / 6) < 1e-6 * total
    assert all(abs(by[s] - total * (1, 2, 3)[int(s[3])] / 6) <= 90 for s in by)


def test_run_and_empty(spark, tmp_path):
    where, _ = planted(tmp_path, spark)
    assert corpus_pipeline.run(spark, where).count() > 100
    for t in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{where}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"none/{t}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
    assert line_dedup.THRESHOLD > 0.75
