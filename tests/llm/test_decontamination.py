import hashlib
import random
import re

from keyloom.llm import decontamination

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").encode().lower())


def brute(text, items):
    own, hit, found = words(text), set(), set()
    for item, t in items:
        w = words(t)
        n = min(13, len(w))
        windows = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
        for i in range(len(own) - n + 1 if n else 0):
            if tuple(own[i : i + n]) in windows:
                hit.update(range(i, i + n))
                if item is not None:
                    found.add(str(item))
    sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    return len(own), len(hit), len(found), sha, bool(hit) and 20 * len(hit) >= len(own)


def test_as_brute_force(spark):
    r = random.Random(8)
    item = lambda n: " ".join(r.choices("abcdefgh", k=n))
    items = [(i, item(r.choice([1, 2, 4, 5, 9, 12, 13, 14, 30, 60]))) for i in range(14)] + [(None, item(20)), (50, ""), (51, None), (3, item(40)), (60, "Éa x")]
    texts = [None, "", "...", "éa X!", "Éa, x"]
    for _ in range(120):
        own = [item(r.randint(0, 40)).upper()]
        for _ in range(r.randint(0, 3)):
            w = (r.choice(items)[1] or "").split()
            a = r.randint(0, len(w))
            own += [" - ".join(w[a : a + r.randint(1, 40)]), item(r.randint(0, 30))]
        texts.append("\n".join(own))
    texts += [texts[10], " ".join(items[9][1] for _ in range(300))]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, items string")
    bench = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, doc_id int")
    got = decontamination.digest(decontamination.hits(docs, bench)).collect()
    assert len(got) == len(texts)
    for x in got:
        assert (x.n_words, x.n_hit, x.n_items, x.items_sha256, x.contaminated) == brute(texts[x.doc_id], items), texts[x.doc_id]
    kept = decontamination.clean(docs, bench)
    assert sorted(x.doc_id for x in kept.collect()) == [i for i, t in enumerate(texts) if not brute(t, items)[4]]
    assert decontamination.hits(docs.limit(0), bench).count() == 0
    none = decontamination.hits(docs, bench.limit(0))
    assert none.where("n_hit > 0").count() == 0 and none.count() == len(texts)


def test_guarantee():
    """Any two sequences with 13 words in common keep a fingerprint of them in common."""
    r = random.Random(9)
    for _ in range(200):
        shared = r.choices(range(50), k=13)
        keys = []
        for _ in range(2):
            own = decontamination.np.array(r.choices(range(50), k=r.randint(0, 20)) + shared + r.choices(range(50), k=r.randint(0, 20)), decontamination.np.uint64)
            keys.append({x["fp"] for x in decontamination._fingerprints(own, 13)})
        assert keys[0] & keys[1]


def test_passages_of_long_documents_are_cut(spark):
    """Below a twentieth of the words, the document stays without the passages, and repeated and null ids as well."""
    passage = [f"p{i}" for i in range(13)]
    before, after = " ".join(f"é{i}" for i in range(300)) + ". (", ") " + " ".join(f"B{i}" for i in range(300)) + "!"
    text = before + " -\n".join(passage).upper() + after
    docs = spark.createDataFrame([(1, "x", text), (1, "y", text), (None, "z", text), (2, "x", "\t" + before + after)], "doc_id long, source string, text string")
    bench = spark.createDataFrame([(0, " ".join(passage))], "item_id long, text string")
    got = decontamination.clean(docs, bench)
    assert got.columns == docs.columns
    assert sorted((str(r.doc_id), r.source, r.text) for r in got.collect()) == sorted([("1", "x", before + after), ("1", "y", before + after), ("None", "z", before + after), ("2", "x", "\t" + before + after)])
    assert decontamination.hits(got, bench).where("n_hit > 0").count() == 0


def test_passages_drop_long_documents(spark):
    r = random.Random(3)
    passage = [f"p{i}" for i in range(13)]
    rest = [f"w{r.randrange(10**6)}" for _ in range(5000)]
    texts = {1: [*rest[:2500], *passage, *rest[2500:]], 2: rest, 3: [*rest[:2500], *passage[:12], *rest[2500:]], 4: [*rest, "short", "item"]}
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()] + [(5, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(0, " ".join(passage)), (1, "short item")], "item_id long, text string")
    got = {x.doc_id: x.text for x in decontamination.clean(docs, bench, passages=True).collect()}
    assert got.keys() == {2, 3, 4, 5}
    assert got[2].split() == got[4].split() == rest and got[3].split() == texts[3] and got[5] is None
