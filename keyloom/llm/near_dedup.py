"""Near-duplicate documents by MinHash, exact on the candidates.

1. Each document's set of word shingles gives HASHES universal hash minima and, from them, bands. Documents with equal
   sets are one node from here on.
2. Nodes that share a band are candidates; what their signatures (8 bits of each minimum) say of the similarity thins
   them out, in each bucket, to the links of signature components.
3. Large-star and small-star join the candidates to groups. Within a group full sets confirm links, in blocks of
   bounded size: a document outside the block's largest component is compared with all others, and only such.
   For groups of more than one block, representatives of the blocks' components are compared, and then all documents
   outside the group's largest component with all of it. So no link between components stays unseen, and no pairs
   are listed.

A pair of similarity 0.75 shares no band with probability (1 - 0.75 ** ROWS) ** BANDS, 2e-5; higher ones far less.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkit
from .components import components
from .store import Scratch

SHINGLE, PERCENT = 5, 75
ROWS, BANDS = 5, 40
HASHES = ROWS * BANDS
#: Least share of equal minima: of pairs at 0.75 it loses one in ten million.
SIGNATURE = PERCENT / 100 - 5.2 * (0.75 * 0.25 / HASHES) ** 0.5
#: Nodes of a bucket whose signatures are compared (a larger one stays a group), and of a block; shingles of a block.
BUCKET, BLOCK, BLOCK_SHINGLES = 2000, 1000, 4_000_000
REPRESENTATIVES = 8
MAP_BITS = 24
_SEEDS = textkit.mixed(np.arange(1, 2 * HASHES + 1, dtype=np.uint64))
_TIMES, _PLUS = (_SEEDS[:HASHES] >> textkit.U(32)).astype(np.uint32) | np.uint32(1), (_SEEDS[HASHES:] >> textkit.U(32)).astype(np.uint32)


def shingle_sets(column: pa.Array, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """Sorted hashes of each text's distinct shingles; a text of fewer words is one shingle, one without has none."""
    hashes, at = textkit.words(column)
    found = textkit.grams(hashes, size)
    for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if hi - lo >= size:
            yield np.unique(found[lo : hi - size + 1])
        else:
            yield textkit.grams(hashes[lo:hi], hi - lo, hi - lo) if hi > lo else found[:0]


def minima(own: np.ndarray) -> np.ndarray:
    x = (own >> textkit.U(32)).astype(np.uint32)
    out = np.full(HASHES, np.uint32(0xFFFFFFFF))
    for lo in range(0, len(x), 1024):
        np.minimum(out, (x[lo : lo + 1024] * _TIMES[:, None] + _PLUS[:, None]).min(1), out=out)
    return out


def bands(least: np.ndarray) -> np.ndarray:
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for x in least.reshape(BANDS, ROWS).T:
        out = textkit.mixed(out * textkit.U(3) + x)
    return out.view(np.int64)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in textkit.tables(batches, 2048):
        n, one, two, signature, banded = [], [], [], [], []
        for own in shingle_sets(batch.column(2)):
            n.append(len(own))
            spread = textkit.mixed(own)
            one.append(int(spread.sum().view(np.int64)) if len(own) else None)
            two.append(int(np.bitwise_xor.reduce(textkit.mixed(spread + textkit.U(7))).view(np.int64)) if len(own) else None)
            least = minima(own)
            signature.append((least & np.uint32(255)).astype(np.uint8).tobytes() if len(own) else None)
            banded.append(bands(least) if len(own) else np.zeros(0, np.int64))
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in banded])]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(banded)))
        arrays = [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(signature, pa.binary()), lists]
        yield pa.RecordBatch.from_arrays(arrays, ["row", "doc_id", "n_shingles", "one", "two", "signature", "bands"])


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Runs of rows alike in the first ``keys`` columns, from rows sorted by these."""
    kept: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        cuts = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns])) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
            now = tuple(c[lo] for c in columns)
            if now != last and kept:
                yield pa.Table.from_batches(kept)
                kept = []
            last = now
            kept.append(batch.slice(lo, hi - lo))
    if kept:
        yield pa.Table.from_batches(kept)


class Forest:
    """Union-find over 0..n-1; roots are least."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = int(self.up[i])
        return i

    def join(self, i: int, others: np.ndarray) -> None:
        roots = {self.root(i), *(self.root(int(j)) for j in others)}
        for r in roots:
            self.up[r] = min(roots)

    def roots(self) -> np.ndarray:
        while True:
            above = self.up[self.up]
            if (above == self.up).all():
                return above
            self.up = above


def join_all(n: int, alike: Callable[[int], np.ndarray], forest: Forest, only: np.ndarray | None = None) -> None:
    """Joins what ``alike`` finds, asking only where a component outside the largest could still grow.

    A document in the largest component is asked for nothing, since all outside it are asked for all.
    """
    todo = np.arange(n) if only is None else only
    asked = np.zeros(n, bool)
    while True:
        roots = forest.roots()
        largest = np.bincount(roots, minlength=n).argmax() if only is None else -1
        left = todo[~asked[todo] & (roots[todo] != largest)]
        if not len(left):
            if only is None and not asked.any() and n:
                left = todo[:1]
            else:
                return
        for i in left[: max(1, len(left) // 8)].tolist():
            asked[i] = True
            forest.join(i, alike(i))


def _by_signature(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Buckets to links (a, b) of their signature components, each node with the least of its component."""
    a: list[np.ndarray] = []
    b: list[np.ndarray] = []
    for group in _groups(batches, 1):
        rows = group.column("row").to_numpy()
        x = np.frombuffer(b"".join(group.column("signature").to_pylist()), np.uint8).reshape(len(rows), HASHES)
        if len(rows) == 2:
            if (x[0] == x[1]).mean() >= SIGNATURE:
                a.append(rows[:1])
                b.append(rows[1:])
        else:
            order = np.argsort(rows)
            rows, x, forest = rows[order], x[order], Forest(len(rows))
            join_all(len(rows), lambda i, x=x: np.flatnonzero((x == x[i]).mean(1) >= SIGNATURE), forest)
            roots = forest.roots()
            far = np.flatnonzero(roots != np.arange(len(rows)))
            a.append(rows[far])
            b.append(rows[roots[far]])
        if len(a) > 2000:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])
            a, b = [], []
    if a:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])


class Block:
    """Full sets of some documents, by shingle."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets])
        self.ends = np.cumsum(self.sizes)
        _, self.names = np.unique(np.concatenate(sets), return_inverse=True)
        order = np.argsort(self.names, kind="stable")
        self.owners = np.repeat(np.arange(len(sets)), self.sizes)[order]
        self.counts = np.bincount(self.names)
        self.starts = np.cumsum(self.counts) - self.counts

    def alike(self, i: int) -> np.ndarray:
        """Documents whose sets have PERCENT of the union in common with that of i."""
        own = self.names[self.ends[i] - self.sizes[i] : self.ends[i]]
        own = own[self.counts[own] > 1]
        if not len(own):
            return own
        n = self.counts[own]
        at = np.repeat(self.starts[own] - np.cumsum(n) + n, n) + np.arange(n.sum())
        common = np.bincount(self.owners[at], minlength=len(self.sizes))
        return np.flatnonzero(100 * common >= PERCENT * (self.sizes[i] + self.sizes - common))


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks to (group, row, root, size, pick): a row's component in its block, and whether it represents it."""
    for table in _groups(batches, 2):
        rows = table.column("row").to_numpy()
        order = np.argsort(rows)
        rows = rows[order]
        sets = [np.frombuffer(x, np.uint64) for x in table.column("shingles").take(pa.array(order)).to_pylist()]
        forest = Forest(len(rows))
        join_all(len(rows), Block(sets).alike, forest)
        roots = forest.roots()
        nth: dict[int, int] = {}
        pick = []
        for r in roots.tolist():
            nth[r] = nth.get(r, 0) + 1
            pick.append(nth[r] <= REPRESENTATIVES)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), table.column(0)[0].as_py())), pa.array(rows), pa.array(rows[roots]), pa.array(pick)], ["group", "row", "root", "pick"])


def _crossed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of documents (stray false) and of strays, to links between different components."""
    for table in _groups(batches, 3):
        stray = table.column("stray").to_numpy()
        if not stray.any():
            continue
        rows, roots = table.column("row").to_numpy(), table.column("root").to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
        forest = Forest(len(rows))
        for r in np.unique(roots):
            own = np.flatnonzero(roots == r)
            forest.join(int(own[0]), own)
        join_all(len(rows), Block(sets).alike, forest, np.flatnonzero(stray))
        found = forest.roots()
        yield pa.RecordBatch.from_arrays([pa.array(roots), pa.array(roots[found])], ["a", "b"])


def _sets_of(bits: np.ndarray):
    """Shingle sets of the rows that may be in a group, by a bit map of these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textkit.tables(batches, 1024):
            place = batch.column(1).to_numpy()  # of column 0, the document
            batch = batch.filter(pa.array((bits[place >> 6] >> (place & 63).astype(np.uint64) & np.uint64(1)).astype(bool)))
            sets = [s.tobytes() for s in shingle_sets(batch.column(2))] if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["key", "shingles"])

    return run


def _place() -> Column:
    return F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(1 << MAP_BITS))


def _bit_map(rows: DataFrame) -> np.ndarray:
    """A map of fixed size of the rows' places: at most 2^18 words come to the driver, whatever the rows."""
    place = _place()
    words = rows.select(F.shiftright(place, 6).alias("i"), place.alias("p")).groupBy("i").agg(F.expr("bit_or(shiftleft(1L, CAST(p & 63 AS INT)))").alias("b"))
    bits = np.zeros(1 << (MAP_BITS - 6), np.int64)
    found = words.toPandas()
    bits[found["i"].to_numpy(np.int64)] = found["b"].to_numpy(np.int64)
    return bits.view(np.uint64)


def classes(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, text_hash, n_shingles, component_id (the smallest doc_id of its component).

    docs: doc_id long, text; other columns are not read. Null texts and texts without words have no shingles, and
    are a component of their own. Repeated rows are documents alike. A document without doc_id can link others; its
    component_id is null if no document of its component has one. No rows give none.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near")
    texts = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), "text")
    key = F.struct("doc_id", "text_hash").alias("key")
    kind = texts.select(key).schema["key"].dataType.simpleString()
    numbered = texts.select(F.monotonically_increasing_id().alias("row"), key, "text")  # once: what is saved keeps the numbers
    signed = scratch.save(numbered.mapInArrow(_signed, f"row long, doc_id {kind}, n_shingles long, one long, two long, signature binary, bands array<long>"), "signed")
    signed = signed.select("row", "doc_id.*", "n_shingles", "one", "two", "signature", "bands")

    same = signed.where("n_shingles > 0").groupBy("one", "two", "n_shingles").agg(F.min("row").alias("node"), F.min("doc_id").alias("label"))
    same = scratch.save(same, "same")
    nodes = signed.join(same.select("node"), F.col("row") == F.col("node"), "left_semi")
    banded = scratch.save(nodes.select("row", F.explode("bands").alias("band")), "banded")
    buckets = banded.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("row")).alias("x"), F.bit_xor(F.xxhash64("row", F.lit(1))).alias("y"), F.min("row").alias("least"))
    buckets = buckets.where("n > 1").groupBy("n", "x", "y").agg(F.min("band").alias("b"), F.min("least").alias("least"))  # one for each set of members
    members = banded.join(buckets.select("b", "n", "least"), F.col("band") == F.col("b")).select("band", "row", "n", "least")
    members = scratch.save(members, "members")
    scratch.drop("banded")
    small = members.where(F.col("n") <= BUCKET).select("band", "row")
    small = small.join(nodes.select("row", "signature"), "row").select("band", "row", "signature")
    small = small.repartition("band").sortWithinPartitions("band").mapInArrow(_by_signature, "a long, b long")
    large = members.where((F.col("n") > BUCKET) & (F.col("row") != F.col("least"))).select(F.col("row").alias("a"), F.col("least").alias("b"))
    grouped = components(small.unionByName(large), scratch, "group")
    heads = grouped.select(F.col("root").alias("row"), F.col("root").alias("group")).distinct()
    grouped = scratch.save(grouped.select(F.col("node").alias("row"), F.col("root").alias("group")).unionByName(heads), "grouped")
    scratch.drop("members")
    scratch.tidy()

    sized = grouped.join(nodes.select("row", "n_shingles"), "row")
    blocks = sized.groupBy("group").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).alias("blocks"))
    placed = grouped.join(blocks, "group").select("row", "group", "blocks", F.pmod(F.xxhash64("row"), F.col("blocks")).alias("block"))
    placed = placed.join(nodes.select("row", F.col("doc_id").alias("d"), F.col("text_hash").alias("h")), "row")
    bits = _bit_map(placed.select(F.col("d").alias("doc_id"), F.col("h").alias("text_hash")))
    sets = texts.select(key, _place().alias("place"), "text").mapInArrow(_sets_of(bits), f"key {kind}, shingles binary").select("key.*", "shingles")
    sets = placed.join(sets, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("h") == F.col("text_hash")))
    sets = scratch.save(sets.select("row", "group", "blocks", "block", "shingles"), "sets")
    confirmed = sets.select("group", "block", "row", "shingles").repartition("group", "block").sortWithinPartitions("group", "block")
    confirmed = scratch.save(confirmed.mapInArrow(_confirmed, "group long, row long, root long, pick boolean"), "confirmed")
    found = confirmed.select("row", "root").distinct()  # a repeated row has its set twice
    several = sets.where("blocks > 1")
    if several.limit(1).count():
        found = _across(several, confirmed, found, scratch)
    scratch.drop("sets")

    named = same.join(found, F.col("node") == F.col("row"), "left").select("one", "two", "n_shingles", "label", F.coalesce("root", "node").alias("root"))
    least = named.groupBy("root").agg(F.min("label").alias("component_id"))
    named = named.join(least, "root").select(F.col("one").alias("p"), F.col("two").alias("q"), F.col("n_shingles").alias("m"), "component_id")
    out = signed.join(named, (F.col("one") == F.col("p")) & (F.col("two") == F.col("q")) & (F.col("n_shingles") == F.col("m")), "left")
    own = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "text_hash", "n_shingles", own.alias("component_id"))


def _across(several: DataFrame, confirmed: DataFrame, found: DataFrame, scratch: Scratch) -> DataFrame:
    """row, root with the components of blocks joined where documents of a group's different blocks are alike."""
    known = several.join(confirmed.select("row", "root", "pick").distinct(), "row")
    # Representatives, dealt to blocks at random, join the large components; nothing depends on what this misses.
    count = known.where("pick").groupBy("group").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("of"))
    chosen = known.where("pick").join(count, "group").select("group", F.pmod(F.xxhash64("row", F.lit(5)), F.col("of")).alias("block"), F.lit(0).cast("long").alias("other"), "row", "root", "shingles", F.lit(True).alias("stray"))
    schema = "a long, b long"
    links = chosen.repartition("group", "block", "other").sortWithinPartitions("group", "block", "other").mapInArrow(_crossed, schema)
    links = scratch.save(links.where("a <> b").distinct(), "links-1")
    joined = components(links, scratch, "first")
    first = joined.withColumnRenamed("root", "top")
    known = several.join(confirmed.select("row", "root").distinct(), "row").join(first, F.col("root") == F.col("node"), "left")
    known = known.select("group", "block", "row", "shingles", F.coalesce("top", "root").alias("root"))
    sizes = known.groupBy("group", "root").agg(F.count(F.lit(1)).alias("n"))
    largest = sizes.groupBy("group").agg(F.max(F.struct("n", "root")).alias("m"), F.sum("n").alias("all"))
    largest = largest.select("group", F.col("m.root").alias("main"), F.ceil((F.col("all") - F.col("m.n")) / BLOCK).alias("parts"))
    known = known.join(largest.where("parts > 0"), "group").withColumn("part", F.pmod(F.xxhash64("row", F.lit(9)), F.col("parts")))
    all_rows = known.select("group", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("other"), "row", "root", "shingles", F.lit(False).alias("stray"))
    blocks = known.select("group", "block").distinct().withColumnRenamed("block", "b").withColumnRenamed("group", "g")
    strays = known.where("root <> main").join(blocks, F.col("group") == F.col("g")).select("group", F.col("b").alias("block"), F.col("part").alias("other"), "row", "root", "shingles", F.lit(True).alias("stray"))
    crossed = all_rows.unionByName(strays).repartition("group", "block", "other").sortWithinPartitions("group", "block", "other")
    more = scratch.save(crossed.mapInArrow(_crossed, schema).where("a <> b").distinct(), "links-2")
    joined = components(links.unionByName(more), scratch, "last").select("node", F.col("root").alias("top"))
    return found.join(joined, F.col("root") == F.col("node"), "left").select("row", F.coalesce("top", "root").alias("root"))


def dedup(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each component: the one with the smallest doc_id. All columns stay.

    Rows alike in doc_id and text stay together. Documents without doc_id go if another of their component has one.
    """
    own = F.coalesce(F.col("doc_id") != F.col("component_id"), F.col("component_id").isNotNull())
    gone = classes(docs).where(own).select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__h")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("__h"))
    return docs.join(gone, same, "left_anti")


def digest(found: DataFrame) -> DataFrame:
    """From ``classes``: doc_id, n_shingles, component_id, kept."""
    return found.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))
