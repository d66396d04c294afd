"""Benchmark decontamination by winnowing.

A fingerprint is the least hash of k consecutive words in a window of w such hashes (the leftmost of equal ones),
so of any w + k - 1 words that document and item share, both keep the same fingerprint. Items of 13 words or more
are searched for 13 shared words; a shorter item of m words is a length class of its own and searched for all m.
Fingerprints of documents that no item has are dropped where they are made, by a bit map of fixed size. The rest are
joined, and each hit is extended word by word within what one window can reach.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkit
from .store import Scratch

WINDOW, GRAM = 13, 5
#: Bits of the map of benchmark fingerprints, as a power of two; it is what tasks get, whatever the benchmark's size.
MAP_BITS = 24
#: Rows and spans up to which what was hit is broadcast to the texts; beyond, both are shuffled.
BROADCAST_SPANS = 500_000
_FP = "struct<cls:int,fp:long,pos:int,lead:int,near:binary>"
_PLACE = textkit.U(64 - MAP_BITS)


def _gram(cls: int) -> int:
    return min(GRAM, cls)


def winnow(hashes: np.ndarray, w: int) -> np.ndarray:
    """Places of the leftmost least hash of each window of w."""
    n = len(hashes) - w + 1
    if n < 1:
        return np.zeros(0, np.int64)
    least = hashes[:n].copy()
    for d in range(1, w):
        np.minimum(least, hashes[d : d + n], out=least)
    place = np.full(n, -1, np.int64)
    for d in range(w):
        np.copyto(place, np.arange(d, d + n), where=(place < 0) & (hashes[d : d + n] == least))
    return np.unique(place)


def _fingerprints(own: np.ndarray, cls: int) -> list[dict]:
    """Of one text's words, those of a length class, with the words that a span of the class can hold around each."""
    k = _gram(cls)
    found = textkit.grams(own, k, cls)
    out = []
    for i in winnow(found, cls - k + 1).tolist():
        lo = max(0, i - (cls - k))
        out.append({"cls": cls, "fp": int(found[i : i + 1].view(np.int64)[0]), "pos": i, "lead": i - lo, "near": own[lo : i + cls].tobytes()})
    return out


def _of_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in textkit.tables(batches):
        hashes, at = textkit.words(batch.column(1), textkit.ALNUM)
        fps = []
        for lo, hi in zip(at[:-1], at[1:], strict=True):
            fps.append(_fingerprints(hashes[lo:hi], min(WINDOW, int(hi - lo))) if hi > lo else [])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, _arrow_fps())], ["item", "fps"])


def _arrow_fps() -> pa.DataType:
    return pa.list_(pa.struct([("cls", pa.int32()), ("fp", pa.int64()), ("pos", pa.int32()), ("lead", pa.int32()), ("near", pa.binary())]))


def _of_documents(classes: list[int], bits: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textkit.tables(batches):
            hashes, at = textkit.words(batch.column(2), textkit.ALNUM)
            fps: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for cls in classes:
                found = textkit.grams(hashes, _gram(cls), cls) >> _PLACE
                hit = np.flatnonzero(bits[(found >> textkit.U(6)).astype(np.int64)] >> (found & textkit.U(63)) & textkit.U(1))
                for d in np.unique(np.searchsorted(at, hit, "right") - 1).tolist():  # only these can have a fingerprint in the map
                    own = hashes[at[d] : at[d + 1]]
                    for x in _fingerprints(own, cls):
                        place = (x["fp"] % (1 << 64)) >> int(_PLACE)
                        if int(bits[place >> 6]) >> (place & 63) & 1:
                            fps[d].append(x)
            counts = pa.array(np.diff(at), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), counts, pa.array(fps, _arrow_fps())], ["row", "doc_id", "n_words", "fps"])

    return run


def _extended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shared words around each hit: the range of the document's words, if it is long enough."""
    for batch in batches:
        x = batch.to_pydict()
        row, item, los, his = [], [], [], []
        for r, i, cls, pos, lead, near, item_lead, item_near in zip(*(x[c] for c in ("row", "item", "cls", "pos", "lead", "near", "item_lead", "item_near")), strict=True):
            k = _gram(cls)
            if near == item_near and lead == item_lead:
                a, b = lead, len(near) // 8 - lead
            else:
                own, other = np.frombuffer(near, np.int64), np.frombuffer(item_near, np.int64)
                n = min(lead, item_lead)
                apart = np.flatnonzero((own[lead - n : lead] != other[item_lead - n : item_lead])[::-1])
                a = int(apart[0]) if len(apart) else n
                n = min(len(own) - lead, len(other) - item_lead)
                apart = np.flatnonzero(own[lead : lead + n] != other[item_lead : item_lead + n])
                b = int(apart[0]) if len(apart) else n
            if b >= k and a + b >= cls:
                row.append(r)
                item.append(i)
                los.append(pos - a)
                his.append(pos + b)
        yield pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(item, pa.string()), pa.array(los, pa.int64()), pa.array(his, pa.int64())], ["row", "item", "lo", "hi"])


def hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: doc_id, text_hash, n_words, n_hit, spans (array<struct<lo, hi>> of hit words), items.

    docs: doc_id, text. benchmark: item_id, text. Other columns are not read. A document's word is hit if it lies in an
    occurrence of 13 consecutive words of an item, or of the whole of a shorter item. Null and empty texts have no
    words and no hits. An item without id hits words but is not listed; items of one id count once. Repeated rows get
    a result each. Empty tables give empty results, an empty benchmark no hits.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "decontaminate")
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), "text")
    items = scratch.save(items.mapInArrow(_of_items, f"item string, fps array<{_FP}>").select("item", F.explode("fps").alias("f")).select("item", "f.*").distinct(), "items")
    place = F.shiftrightunsigned("fp", 64 - MAP_BITS)
    lit = items.groupBy(F.shiftright(place, 6).alias("i")).agg(F.expr(f"bit_or(shiftleft(1L, CAST(shiftrightunsigned(fp, {64 - MAP_BITS}) & 63 AS INT)))").alias("b"))
    bits = np.zeros(1 << (MAP_BITS - 6), np.int64)
    for i, b in lit.collect():
        bits[i] = b
    classes = sorted(r.cls for r in items.select("cls").distinct().collect())
    texts = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))
    keys = texts.select("row", F.struct("doc_id", "text_hash").alias("key"), "text")
    kind = keys.schema["key"].dataType.simpleString()
    found = keys.mapInArrow(_of_documents(classes, bits.view(np.uint64)), f"row long, doc_id {kind}, n_words long, fps array<{_FP}>")
    found = scratch.save(found, "documents")
    each = found.select("row", F.explode("fps").alias("f")).select("row", "f.*")
    side = items.select("item", "cls", "fp", F.col("lead").alias("item_lead"), F.col("near").alias("item_near"))
    pairs = each.join(side, ["cls", "fp"]).select("row", "item", "cls", "pos", "lead", "near", "item_lead", "item_near")
    shared = pairs.mapInArrow(_extended, "row long, item string, lo long, hi long")
    by_doc = shared.groupBy("row").agg(F.sort_array(F.collect_set(F.struct("lo", "hi"))).alias("spans"), F.sort_array(F.collect_set("item")).alias("items"))
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("to"), F.lit(0).cast("long").alias("n")),
        lambda acc, s: F.struct(F.greatest(acc["to"], s["hi"]).alias("to"), (acc["n"] + F.greatest(F.lit(0).cast("long"), s["hi"] - F.greatest(acc["to"], s["lo"]))).alias("n")),
    )["n"]
    by_doc = by_doc.withColumn("n_hit", covered)
    out = found.select("row", "doc_id.*", "n_words").join(by_doc, "row", "left")
    empty = F.array().cast("array<string>")
    return out.select("doc_id", "text_hash", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), "spans", F.coalesce("items", empty).alias("items"))


def contaminated():
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


#: Words of a text, as ``hits`` counts them.
_WORDS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _without(text: Column, spans: Column) -> Column:
    """The text without the words of spans and what stands between them."""
    gaps = F.split(text, _WORDS, -1)
    within = lambda i, first: F.exists(spans, lambda s: (s["lo"] + first <= i) & (i < s["hi"]))
    kept = F.transform(F.regexp_extract_all(text, F.lit(_WORDS), F.lit(0)), lambda w, i: F.concat(F.when(within(i, 1), "").otherwise(F.get(gaps, i)), F.when(within(i, 0), "").otherwise(w)))
    return F.concat(F.array_join(kept, ""), F.element_at(gaps, -1))


def clean(docs: DataFrame, benchmark: DataFrame, passages: bool = False) -> DataFrame:
    """``docs`` without contaminated rows: those of whose words a twentieth or more is hit, and with ``passages`` all
    that hold a whole window of WINDOW words, however long the rest is. The hit words of others are cut out of their
    text; other columns stay as they are. Rows without hits stay untouched, whatever is null in them."""
    bad = contaminated()
    if passages:
        bad = bad | F.exists("spans", lambda s: s["hi"] - s["lo"] >= WINDOW)
    hit = hits(docs, benchmark).where("n_hit > 0")
    hit = hit.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__h"), F.col("spans").alias("__spans"), bad.alias("__bad")).dropDuplicates(["__id", "__h"])
    hit = Scratch(docs.sparkSession, "hit").save(hit, "hit")
    size = hit.agg(F.count(F.lit(1)) + F.coalesce(F.sum(F.size("__spans")), F.lit(0))).first()[0]
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("__h"))
    rest = docs.join(F.broadcast(hit) if size <= BROADCAST_SPANS else hit, same, "left").where(~F.coalesce("__bad", F.lit(False)))
    text = F.when(F.col("__spans").isNull(), F.col("text")).otherwise(_without(F.col("text"), F.col("__spans")))
    return rest.select(*[text.alias(c) if c == "text" else F.col(c) for c in docs.columns])


def digest(found: DataFrame) -> DataFrame:
    """From ``hits``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    sha = F.sha2(F.array_join("items", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), sha.alias("items_sha256"), contaminated().alias("contaminated"))
