import random
import re

from keyloom.llm import line_dedup


def words(line):
    return frozenset(re.findall(r"[^\x20\x09-\x0D]+", line.lower()))


def brute(docs):
    """Numbers of removed lines by document, docs in order."""
    seen, out = [], {}
    for d, text in docs:
        for no, line in enumerate((text or "").split("\n"), 1):
            own = words(line)
            if own:
                if any(len(own & x) >= 0.85 * len(own | x) - 1e-9 for x in seen):
                    out.setdefault(d, []).append(no)
                seen.append(own)
    return out


def texts(seed):
    r = random.Random(seed)
    bases = [[f"w{int(r.expovariate(0.01))}" for _ in range(r.choice([1, 2, 7, 20, 60]))] for _ in range(30)]
    out = []
    for _ in range(60):
        lines = []
        for _ in range(r.randint(0, 8)):
            own = list(r.choice(bases[: r.choice([3, 30])]))
            for _ in range(r.randint(0, 3)):
                own[r.randrange(len(own))] = f"w{int(r.expovariate(0.01))}"
            lines.append(r.choice(["", " ", "\t"]) + r.choice([" ", "  ", "\x0b"]).join(own).replace("w1", r.choice(["w1", "W1", "Wé1"])))
        out.append("\n".join(lines))
    return [*out, None, "", "\n\n", " ", "x", "X \n x", "\r"]


def test_as_brute_force(spark, monkeypatch):
    for seed, family in ((1, 16), (2, 2)):
        monkeypatch.setattr(line_dedup, "FAMILY", family)
        docs = list(enumerate(texts(seed), 3))
        df = spark.createDataFrame([(*d, "a") for d in docs], "doc_id long, text string, no string")
        want = brute(docs)
        got = line_dedup.report(df).collect()
        assert len(got) == len(docs)
        for x in got:
            text = dict(docs)[x.doc_id]
            assert x.removed == ",".join(map(str, want.get(x.doc_id, []))), (x, text)
            assert (x.n_removed, x.n_lines) == (len(want.get(x.doc_id, [])), len((text or "").split("\n")) * (text is not None))


def test_dedup_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "BROADCAST_ROWS", 0)
    data = [(1, "a b c\n\nd e", 9), (2, "A b c\nnew", 9), (3, "d e", 9), (None, "new", 9), (4, None, 9), (5, "", 9), (6, " \n", 9), (7, "own\nown", 9), (7, "own\nown", 9)]
    df = spark.createDataFrame(data, "doc_id long, text string, n_chars long")
    out = line_dedup.dedup(df)
    assert out.columns == df.columns
    want = [(1, "a b c\n\nd e", 10), (2, "new", 3), (4, None, 0), (5, "", 0), (6, " \n", 2), (7, "own", 3), (7, "own", 3)]
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)
    assert line_dedup.report(df.limit(0)).count() == 0


def test_numbers_shared_exchange_and_plain_aggregates(spark, monkeypatch):
    """Documents are numbered without gaps over several partitions; the first lines of sets are found without sorting
    (before, SortAggregate of a struct), and both sides of the candidate join read one exchange."""
    plans, save = {}, line_dedup.Scratch.save

    def kept(self, df, name, **options):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return save(self, df, name, **options)

    monkeypatch.setattr(line_dedup.Scratch, "save", kept)
    data = [(i % 40 if i % 7 else None, f"line {i % 9} of the text\nand {i} again") for i in range(120)]
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(5)
    before = spark.conf.get("spark.sql.adaptive.enabled"), spark.conf.get(line_dedup.MAP_BITS[0])
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        scratch = line_dedup.Scratch(spark, "numbers")
        names = line_dedup._names(line_dedup._tokens(docs, scratch), scratch).orderBy("d").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before[0])
    assert [x.d for x in names] == list(range(len(set(data))))
    in_order = [(x.doc_id is None, x.doc_id or 0, x.text_hash) for x in names]
    assert in_order == sorted(in_order)
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        line_dedup.removed_lines(docs).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    assert spark.conf.get(line_dedup.MAP_BITS[0]) == before[1]
    assert "SortAggregate" not in plans["firsts"]
    plain = re.sub(r"#\d+L?|plan_id=\d+|[:|+\s-]", "", plans["met-0"])
    sides = [x.split("Sort[")[0] for x in plain.split("Exchangehashpartitioning(word")[1:]]
    assert len(sides) == 2
    assert sides[0] == sides[1]


def test_lengths_and_order(spark, monkeypatch):
    """Similar lines of unlike length, the shorter one before or after the other, with and without a match before."""
    monkeypatch.setattr(line_dedup, "FAMILY", 3)
    r = random.Random(5)
    docs = []
    for i in range(150):
        own = [f"g{i % 12}x{j}" for j in range(r.choice([6, 7, 13, 20, 40]))]
        n = len(own)
        keep = r.sample(own, n - r.randint(0, max(1, n // 6)))
        docs.append((i, " ".join(keep + [f"own{i}x{j}" for j in range(r.randint(0, 2))])))
    want = brute(docs)
    got = line_dedup.report(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert 20 < len(want) < 140
    assert {x.doc_id: x.removed for x in got if x.n_removed} == {d: ",".join(map(str, v)) for d, v in want.items()}
