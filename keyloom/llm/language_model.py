"""Scores of texts by a class-based bigram model in the manner of Brown and others.

P(w | v) mixes P(class of w | class of v) * P(w | class of w) with a smoothed unigram. Classes of all words of training
texts come from exchange clustering: in each round every word moves to the class under which the contexts it was seen in
(the classes of the words before and after, as of the round before) are most likely, which is what the likelihood of class
bigrams asks for; contexts are counted again in each round, until a round gains less than GAIN. A round is a pass over
chunks and one over slices of the vocabulary, and only the counts of class bigrams go to the driver and the tasks. The
rounds start from classes found likewise with neighbours in CLASSES hash classes. Unseen words are one word with a class
of its own, whose transitions are those of words seen once, by the share of these that were new.

Texts are cut into chunks of tokens, encoded once against the chunk's own word list. Counts and classes of words are
joined to the word lists, never to the tokens, and nothing of the size of the vocabulary is broadcast.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from contextlib import contextmanager, suppress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit
from .store import Scratch

MIN_COUNT, CLASSES, ROUNDS = 1, 64, 2
#: Nats a token that a round of exchange must gain for another one to follow.
GAIN = 0.002
#: Tokens of a chunk, which is what a pass holds at a time; in smaller ones word lists repeat more.
CHUNK = 1 << 20
#: Documents, and chunks or slices of them, that are passed to Python at a time: rows have texts, or blobs of megabytes.
DOCUMENTS, BLOBS = 512, 1
#: Tokens that passes over chunks look at in one go.
SLICE = 1 << 20
#: Weight of the class model, and smoothing of its transitions and of the unigrams.
WEIGHT, TRANSITION, UNIGRAM = 0.85, 0.5, 0.1
#: Classes beyond those of exchange: unseen words.
RARE = 1
END_CLASS = CLASSES + RARE
ALL_CLASSES = END_CLASS + 1
#: Of a word: the classes before it, and as many after it.
CONTEXTS = ALL_CLASSES
#: The end of a text, as a word no text holds.
END = np.uint64(0x5EED0FE4D0000001)
_ZSTD, _ZSTD_KEPT = pa.Codec("zstd", 1), pa.Codec("zstd", 3)
#: Bytes up to which what belongs to chunks is broadcast to them; beyond, both are shuffled by chunk.
BROADCAST_BYTES = 32 << 20
#: Words whose vectors are written out and multiplied in one go.
BLOCK = 8192
#: Chunks for which there is a slice of the vocabulary, and slices at least: passes handle slices x chunks blobs, and a task
#: adds up one slice.
CHUNKS, LEAST = 4, 12
#: Tables of packed columns are written as they are.
PACKED = {"compression": "none"}


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10 == 0


def _packed(x: np.ndarray, kept: bool = False) -> bytes:
    return len(x).to_bytes(8, "little") + (_ZSTD_KEPT if kept else _ZSTD).compress(np.ascontiguousarray(x).tobytes(), asbytes=True)


def _unpacked(x: bytes, kind: type) -> np.ndarray:
    n = int.from_bytes(x[:8], "little")
    return np.frombuffer(_ZSTD.decompress(x[8:], n * np.dtype(kind).itemsize, asbytes=True) if n else b"", kind)


def _release() -> None:
    """Gives freed memory back, which allocators keep: a task's peaks then are those of one chunk, not of all passes."""
    pa.default_memory_pool().release_unused()
    with suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


@contextmanager
def _passed(spark: SparkSession, rows: int) -> Iterator[None]:
    """What is run inside passes so many rows to Python at a time, so that both sides hold these and not all of a task."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _released(run):
    """A pass over batches that gives its memory back at its end, since workers outlive it."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        _release()

    return whole


def _narrow(x: np.ndarray) -> bytes:
    """Small numbers in as few bytes each as all of them allow."""
    top = int(x.max()) if len(x) else 0
    kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if top <= np.iinfo(k).max)
    return bytes([np.dtype(kind).itemsize]) + _packed(x.astype(kind))


def _wide(x: bytes) -> np.ndarray:
    return _unpacked(x[1:], f"u{x[0]}")


def _packed_sorted(x: np.ndarray) -> bytes:
    """Ascending numbers, by their steps."""
    return _narrow(np.diff(x, prepend=x.dtype.type(0)))


def _unpacked_sorted(x: bytes) -> np.ndarray:
    return np.cumsum(_wide(x), dtype=np.int64)


def _with_ends(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    out = np.empty(len(hashes) + len(at) - 1, np.uint64)
    ends = at[1:] + np.arange(len(at) - 1)
    out[ends] = END
    inside = np.ones(len(out), bool)
    inside[ends] = False
    out[inside] = hashes
    return out


def _coded(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words in order, and for each token which it is; in less time and memory than np.unique takes."""
    found = pa.array(tokens).dictionary_encode()
    words = found.dictionary.to_numpy()
    order = np.argsort(words)
    place = np.empty(len(order), np.uint32)
    place[order] = np.arange(len(order), dtype=np.uint32)
    return words[order], place[found.indices.to_numpy()]


def _chunked():
    """Chunks of documents: keys, held, sizes, codes into words (sorted), and how often each is in training texts."""

    def chunk(number: int, parts: list[tuple]) -> pa.RecordBatch:
        keys, held, tokens, sizes = (x for x in zip(*parts, strict=True))
        parts.clear()
        _release()
        keys, held, sizes = pa.concat_arrays(keys), np.concatenate(held), np.concatenate(sizes)
        tokens = np.concatenate(tokens)
        words, codes = _coded(tokens)
        train = np.bincount(codes[np.repeat(~held, sizes)], minlength=len(words))
        arrays = [
            pa.array([number], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys),
            *(pa.array([_packed(x, True)], pa.binary()) for x in (held, sizes.astype(np.uint32), codes, words, train.astype(np.uint32))),
        ]
        return pa.RecordBatch.from_arrays(arrays, ["chunk", "keys", "held", "sizes", "codes", "words", "train"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, parts, n = TaskContext.get().partitionId() << 20, [], 0
        for batch in textkit.tables(batches, DOCUMENTS):
            hashes, at = textkit.words(batch.column(2))
            # A copy of the keys, since a slice would keep the texts of its batch.
            parts.append((batch.column(0).take(np.arange(batch.num_rows)), batch.column(1).to_numpy(zero_copy_only=False).astype(bool), _with_ends(hashes, at), np.diff(at) + 1))
            n += len(parts[-1][2])
            if n >= CHUNK:
                yield chunk(number, parts)
                number, parts, n = number + 1, [], 0
                _release()
        if parts:
            yield chunk(number, parts)
        textkit.forget()
        _release()

    return run


def _rows(batch: pa.RecordBatch, columns: list[int | str]) -> Iterator[tuple]:
    """Rows of some columns, one at a time, since a batch may hold many chunks."""
    columns = [batch.column(c) for c in columns]
    for i in range(batch.num_rows):
        yield tuple(c[i].as_py() for c in columns)


def _edges(words: np.ndarray, slices: int) -> np.ndarray:
    """Where the slices of the vocabulary begin among sorted words, and the end: words are hashes, slices equal ranges."""
    first = [-(-(i << 32) // slices) << 32 for i in range(slices)]
    return np.append(np.searchsorted(words, np.array(first, np.uint64)), len(words))


def _counts_by_slice(slices: int):
    """Of each chunk and slice: the words (sorted), and how often each is in the chunk's training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, words, train in _rows(batch, [0, 1, 2]):
                words, train = _unpacked(words, np.uint64), _unpacked(train, np.uint32)
                begins = _edges(words, slices)
                some = np.flatnonzero(np.diff(begins))
                ranges = [slice(begins[i], begins[i + 1]) for i in some.tolist()]
                own, n = pa.array([words[x].tobytes() for x in ranges], pa.binary()), pa.array([_narrow(train[x]) for x in ranges], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(np.full(len(some), chunk)), own, n], ["slice", "chunk", "words", "n"])

    return run


_TOTALS = "c long, slice int, totals binary, ids binary, types long, once long, twice long"


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows of ``_counts_by_slice`` sorted by slice: for each chunk the totals of its words of the slice and their
    ranks among all words of the slice; for each slice (c -1) how many words training texts have, once, and twice."""
    for number, parts in _by_slice(batches, 4):
        words = [np.frombuffer(p[1], np.uint64) for p in parts]
        own, back = _coded(np.concatenate(words))
        totals = np.bincount(back, weights=np.concatenate([_wide(p[2]) for p in parts]), minlength=len(own)).astype(np.uint64)
        out = [(-1, number, b"", b"", int((totals > 0).sum()), int((totals == 1).sum()), int((totals == 2).sum()))]
        for p, ids in zip(parts, np.split(back, np.cumsum([len(w) for w in words])[:-1]), strict=True):
            out.append((p[0], number, _narrow(totals[ids]), _packed_sorted(ids), 0, 0, 0))
        kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], ["c", "slice", "totals", "ids", "types", "once", "twice"])


def _totals_of_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Totals and ranks of each chunk's words, in their order, from rows (chunk, totals, ids) sorted by chunk and slice."""
    for chunk, parts in _by_slice(batches, 3):
        totals = np.concatenate([_wide(p[0]) for p in parts]).astype(np.uint64)
        ids = np.concatenate([_unpacked_sorted(p[1]) for p in parts])
        yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([_packed(totals)], pa.binary()), pa.array([_packed(np.diff(ids, prepend=0).astype(np.int32))], pa.binary())], ["c", "totals", "ids"])


def rare_class(totals: np.ndarray) -> np.ndarray:
    """The class of words seen less than MIN_COUNT times, which are those of no training text."""
    return np.full(np.shape(totals), CLASSES, np.int64)


def contexts(words: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """Classes before any exchange, by hash."""
    own = (textkit.mixed(words) % textkit.U(CLASSES)).astype(np.int64)
    own = np.where(totals >= MIN_COUNT, own, rare_class(totals))
    return np.where(words == END, END_CLASS, own)


def _often(words: np.ndarray, totals: np.ndarray, slices: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the training words of a chunk, and where the slices of the vocabulary begin among them."""
    at = np.flatnonzero((totals >= MIN_COUNT) & (words != END))
    return at, _edges(words[at], slices)


def _vectors(slices: int):
    """Of each chunk and slice of the vocabulary, in training texts: words, keys (rank in the slice * 2 * CONTEXTS +
    context; those after a word come second) and their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for held, sizes, codes, *packed in _rows(batch, [0, 1, 2, 3, 4]):
                words, totals = _unpacked(packed[0], np.uint64), _unpacked(packed[1], np.uint64)
                at, begins = _often(words, totals, slices)
                each = contexts(words, totals.astype(np.int64)).astype(np.uint8)
                numbers, keys, counts = _chunk_vectors(at, begins, each, _training(held, sizes, codes))
                own = pa.array([words[at[begins[i] : begins[i + 1]]].tobytes() for i in numbers], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), own, keys, counts], ["slice", "words", "keys", "counts"])

    return run


def _training(held: bytes, sizes: bytes, codes: bytes) -> np.ndarray:
    """Codes of a chunk's training tokens."""
    return _unpacked(codes, np.uint32)[np.repeat(~_unpacked(held, bool), _unpacked(sizes, np.uint32))]


def _run_lengths(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of sorted ones and how often each is there."""
    starts = np.flatnonzero(np.concatenate([np.ones(min(1, len(key)), bool), key[1:] != key[:-1]]))
    return key[starts], np.diff(starts, append=len(key)).astype(np.uint32)


def _chunk_vectors(at: np.ndarray, begins: np.ndarray, classes: np.ndarray, codes: np.ndarray) -> tuple[list[int], pa.Array, pa.Array]:
    """Slices that the training words of a chunk are in, and keys and counts of each, packed."""
    kind = np.uint32 if (len(at) + 1) * 2 * CONTEXTS < 1 << 32 else np.uint64
    first = np.zeros(len(classes), kind)
    first[at] = np.arange(len(at), dtype=kind) * kind(2 * CONTEXTS)
    each = classes[codes]
    ends = np.array([END_CLASS], np.uint8)  # a text follows the end of the one before
    mine = each != END_CLASS
    first = first[codes[mine]]
    m = len(first)
    del codes
    key = np.empty(2 * m, kind)
    np.add(first, np.concatenate([ends, each[:-1]])[: len(each)][mine], out=key[:m])
    np.add(first, np.concatenate([each[1:], ends])[: len(each)][mine], out=key[m:])
    key[m:] += kind(CONTEXTS)
    del first, each, mine
    key.sort()
    cuts = np.searchsorted(key, (begins * (2 * CONTEXTS)).astype(kind))
    numbers, keys, counts = np.flatnonzero(np.diff(begins)).tolist(), [], []
    for i in numbers:
        own, n = _run_lengths(key[cuts[i] : cuts[i + 1]])
        keys.append(_packed_sorted(own - kind(begins[i] * 2 * CONTEXTS) if len(own) else own))
        counts.append(_narrow(n))
    del key
    _release()
    return numbers, pa.array(keys, pa.binary()), pa.array(counts, pa.binary())


def _vector_rows(words: np.ndarray, key: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows (word, places, counts) of sorted keys (rank * 2 * CONTEXTS + place)."""
    rank, starts = np.unique(key // (2 * CONTEXTS), return_index=True)
    offsets = np.concatenate([starts, [len(key)]]).astype(np.int32)
    places = pa.ListArray.from_arrays(pa.array(offsets), pa.array((key % (2 * CONTEXTS)).astype(np.int16)))
    counts = pa.ListArray.from_arrays(pa.array(offsets), pa.array(n.astype(np.int64)))
    whole = pa.RecordBatch.from_arrays([pa.array(words[rank]), places, counts], ["word", "places", "counts"])
    for lo in range(0, whole.num_rows, 10_000):
        yield whole.slice(lo, 10_000)


def _flat(table: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """word of each row, row of each entry, its place and its count."""
    if isinstance(table, pa.RecordBatch):
        table = pa.Table.from_batches([table])
    table = table.combine_chunks()
    places = table.column("places").chunk(0) if table.num_rows else pa.array([], pa.list_(pa.int16()))
    counts = table.column("counts").chunk(0) if table.num_rows else pa.array([], pa.list_(pa.int64()))
    sizes = np.diff(places.offsets.to_numpy())
    return table.column("word").to_numpy(), np.repeat(np.arange(len(sizes)), sizes), places.flatten().to_numpy().astype(np.int64), counts.flatten().to_numpy()


def _by_slice(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[tuple[int, list[tuple]]]:
    """Slices and the other columns of their rows, from rows sorted by slice."""
    now, parts = None, []
    for batch in batches:
        for number, *packed in _rows(batch, list(range(columns))):
            if number != now and parts:
                yield now, parts
                parts = []
            now = number
            parts.append(tuple(packed))
    if parts:
        yield now, parts


def _added(parts: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a slice's rows (words, keys, counts): its words, keys in order, counts."""
    words = [np.frombuffer(p[0], np.uint64) for p in parts]
    own, back = _coded(np.concatenate(words))
    found = []
    for to, p in zip(np.split(back.astype(np.int64), np.cumsum([len(w) for w in words])[:-1]), parts, strict=True):
        rank, place = np.divmod(_unpacked_sorted(p[1]), 2 * CONTEXTS)
        # Keys with their counts in the lower bits, which are sorted as one.
        found.append((to[rank] * (2 * CONTEXTS) + place) << 32 | _wide(p[2]).astype(np.int64))
    both = np.concatenate(found)
    del found
    both.sort()
    key = both >> 32
    starts = np.flatnonzero(np.concatenate([np.ones(min(1, len(key)), bool), key[1:] != key[:-1]]))
    return own, key[starts], np.add.reduceat(both & 0xFFFFFFFF, starts) if len(key) else np.zeros(0, np.int64)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each word, from rows sorted by slice; a slice is added up at a time."""
    for _, parts in _by_slice(batches, 4):
        own, key, n = _added(parts)
        if len(key):
            yield from _vector_rows(own.view(np.int64), key, n)


def _moves(slices: int):
    """Of chunks: the counts of steps (slice -1), and vectors of words by the classes around them, by slice; words are
    told by their ranks in the slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["slice", "chunk", "ids", "keys", "counts"]
        for batch in batches:
            for chunk, numbers, classes, ids, words, totals, *packed in _rows(batch, ["chunk", "numbers", "classes", "ids", "words", "totals", "held", "sizes", "codes"]):
                words, totals = _unpacked(words, np.uint64), _unpacked(totals, np.uint64)
                at, begins = _often(words, totals, slices)
                own = _own_classes(words, at, begins, numbers, classes)
                ids = np.cumsum(_unpacked(ids, np.int32), dtype=np.int64)[at]
                codes = _training(*packed)
                steps = np.zeros(ALL_CLASSES**2, np.int64)
                for lo in range(0, len(codes), SLICE):
                    # With the token before it, or the end before the first one.
                    each = own[codes[max(lo - 1, 0) : lo + SLICE]]
                    steps += np.bincount(_steps(each)[min(lo, 1) :], minlength=len(steps))
                numbers, keys, counts = _chunk_vectors(at, begins, own, codes)
                del codes
                none = [b""]
                ranks = [_packed_sorted(ids[begins[i] : begins[i + 1]]) for i in numbers]
                columns = none + ranks, none + keys.to_pylist(), [_packed(steps), *counts.to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([-1, *numbers], pa.int32()), pa.array(np.full(len(numbers) + 1, chunk)), *(pa.array(x, pa.binary()) for x in columns)], names)

    return run


def _best(logs: np.ndarray, n_words: int, parts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The likeliest class of each word, from parts of sorted, distinct keys (word * 2 * CONTEXTS + place) and their counts.

    The vectors of BLOCK words at a time are written out and multiplied whole.
    """
    out, columns = np.zeros(n_words, np.uint8), np.ascontiguousarray(logs.T)
    lows = np.arange(0, n_words + BLOCK, BLOCK)
    cuts = [np.searchsorted(key, lows * (2 * CONTEXTS)) for key, _ in parts]
    vectors = np.zeros(min(BLOCK, n_words) * 2 * CONTEXTS)
    for i, lo in enumerate(lows[:-1].tolist()):
        hi = min(lo + BLOCK, n_words)
        vectors[:] = 0
        for (key, n), c in zip(parts, cuts, strict=True):
            if c[i] < c[i + 1]:
                vectors[key[c[i] : c[i + 1]] - lo * 2 * CONTEXTS] += n[c[i] : c[i + 1]]
        out[lo:hi] = (vectors.reshape(-1, 2 * CONTEXTS)[: hi - lo] @ columns).argmax(1)
    return out


def _reassigned(logs: np.ndarray):
    """Of rows of ``_moves`` sorted by slice: chunk, slice and the new classes of the words asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, parts in _by_slice(batches, 5):
            ids, vectors = [_unpacked_sorted(p[1]) for p in parts], []
            for to, p in zip(ids, parts, strict=True):
                rank, place = np.divmod(_unpacked_sorted(p[2]), 2 * CONTEXTS)
                vectors.append((to[rank] * (2 * CONTEXTS) + place, _wide(p[3])))
            classes = _best(logs, max(int(to[-1]) for to in ids) + 1, vectors)
            chunks = pa.array([p[0] for p in parts], pa.int64())
            yield pa.RecordBatch.from_arrays([chunks, pa.array(np.full(len(parts), number, np.int32)), pa.array([_packed(classes[to]) for to in ids], pa.binary())], ["c", "slice", "classes"])

    return run


def _likelihood(steps: np.ndarray) -> float:
    """Nats a token of what classes tell of the next: the part of the class bigrams' log likelihood that exchange can change."""
    log = lambda x: float((x[x > 0] * np.log(x[x > 0])).sum())
    return (log(steps.astype(float)) - log(steps.sum(0).astype(float)) - log(steps.sum(1).astype(float))) / steps.sum() + np.log(steps.sum())


def _exchange(scratch: Scratch, counted: DataFrame, placed: DataFrame, slices: int) -> DataFrame:
    """placed (c, numbers, classes) after rounds of exchange, of which the last kept is the likeliest."""
    best, kept, rounds = -np.inf, placed, 0
    counted = counted.drop("keys")
    while True:
        moves = _with(counted, placed, _class_bytes()).mapInArrow(_released(_moves(slices)), "slice int, chunk long, ids binary, keys binary, counts binary")
        with _passed(scratch.spark, BLOBS):
            moves = scratch.save(moves, f"moves{rounds}", **PACKED)
        steps = moves.where("slice = -1").select("counts").mapInArrow(_all_steps, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
        table = np.zeros(ALL_CLASSES**2, np.int64)
        table[steps["at"].to_numpy(np.int64)] = steps["n"].to_numpy(np.int64)
        table = table.reshape(ALL_CLASSES, ALL_CLASSES)
        gain = _likelihood(table) - best if table.any() else 0.0
        if gain > 0:
            best, kept = best + gain if np.isfinite(gain) else _likelihood(table), placed
        if gain < GAIN:
            scratch.drop(f"moves{rounds}")
            return kept
        logs = _logs(np.concatenate([table[:, :CLASSES].T, table[:CLASSES]], 1))
        moved = moves.where("slice >= 0").repartition("slice").sortWithinPartitions("slice").mapInArrow(_released(_reassigned(logs)), _ANSWERS)
        with _passed(scratch.spark, BLOBS):
            placed = scratch.save(_gathered(moved), f"placed{rounds}", **PACKED)
        scratch.drop(f"moves{rounds}")
        scratch.tidy()
        rounds += 1


def _with(chunks: DataFrame, side: DataFrame, blobs: Column) -> DataFrame:
    """Chunks with what ``side`` has for them, by its column c; blobs: the bytes of a row of it."""
    size = side.agg(F.sum(blobs)).first()[0] or 0
    return chunks.join(F.broadcast(side) if size <= BROADCAST_BYTES else side.hint("shuffle_hash"), F.col("chunk") == F.col("c"), "left")


def _class_bytes() -> Column:
    return F.aggregate("classes", F.lit(0).cast("long"), lambda n, x: n + F.octet_length(x))


def _all_steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = np.zeros(ALL_CLASSES**2, np.int64)
    for batch in batches:
        for x in batch.column(0).to_pylist():
            table += _unpacked(x, np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(table))), pa.array(table)], ["at", "n"])


_ANSWERS = "c long, slice int, classes binary"


def _gathered(answers: DataFrame) -> DataFrame:
    return answers.groupBy("c").agg(F.collect_list(F.struct("slice", "classes")).alias("x")).select("c", F.col("x.slice").alias("numbers"), "x.classes")


def _own_classes(words: np.ndarray, at: np.ndarray, begins: np.ndarray, numbers: list | None, classes: list | None) -> np.ndarray:
    """Classes of a chunk's words from those of its slices, which are in the order of ``_often``."""
    own = np.where(words == END, END_CLASS, CLASSES).astype(np.uint8)
    for i, what in zip(numbers or [], classes or [], strict=True):
        own[at[begins[i] : begins[i + 1]]] = _unpacked(what, np.uint8)
    return own


def _often_of_chunks(slices: int):
    """Of each chunk and slice: slice, chunk and the training words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, words, totals in _rows(batch, [0, 1, 2]):
                words = _unpacked(words, np.uint64)
                at, begins = _often(words, _unpacked(totals, np.uint64), slices)
                some = np.flatnonzero(np.diff(begins))
                own = pa.array([words[at[begins[i] : begins[i + 1]]].tobytes() for i in some.tolist()], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(np.full(len(some), number)), own, pa.array([b""] * len(some), pa.binary())], ["slice", "chunk", "words", "classes"])

    return run


def _classes_of_words(slices: int, logs: np.ndarray):
    """Of vectors: slices of the vocabulary with the classes of their words; chunk -1 sorts them before the chunks that
    ask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textkit.tables(batches, 65536):
            words, classes, *_ = _likeliest(logs, batch)
            order = np.argsort(words.view(np.uint64))
            words, classes = words.view(np.uint64)[order], classes[order]
            begins = _edges(words, slices)
            some = np.flatnonzero(np.diff(begins))
            columns = ([x[begins[i] : begins[i + 1]].tobytes() for i in some.tolist()] for x in (words, classes))
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(np.full(len(some), -1)), *(pa.array(x, pa.binary()) for x in columns)], ["slice", "chunk", "words", "classes"])

    return run


def _looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """chunk, slice and classes, from rows sorted by slice and chunk."""
    now, known, table = None, [], None
    for batch in batches:
        out: list[tuple] = []
        for number, chunk, words, classes in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if number != now:
                now, known, table = number, [], None
            if chunk < 0:
                known.append((np.frombuffer(words, np.uint64), np.frombuffer(classes, np.uint8)))
                continue
            if table is None:
                w, c = (np.concatenate(x) for x in zip(*known, strict=True))  # every training word has a vector
                order = np.argsort(w)
                table = w[order], c[order]
            out.append((chunk, number, _packed(table[1][np.searchsorted(table[0], np.frombuffer(words, np.uint64))])))
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate((pa.int64(), pa.int32(), pa.binary()))], ["c", "slice", "classes"])


def _logs(table: np.ndarray) -> np.ndarray:
    """Smoothed log probabilities of contexts by class, before and after apart."""
    halves = [table[:, :CONTEXTS] + 0.1, table[:, CONTEXTS:] + 0.1]
    return np.concatenate([np.log(h / h.sum(1, keepdims=True)) for h in halves], 1)


def _likeliest(logs: np.ndarray, batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """Words with their classes, and of each entry of their vectors the row, place and count."""
    words, row, place, count = _flat(batch)
    return words, _best(logs, len(words), [(row * (2 * CONTEXTS) + place, count)]), row, place, count


def _exchanged(logs: np.ndarray):
    """Counts of contexts by the classes that words move to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(len(logs) * 2 * CONTEXTS)
        for batch in textkit.tables(batches, 65536):
            _, classes, row, place, count = _likeliest(logs, batch)
            table += np.bincount(classes[row].astype(np.int64) * (2 * CONTEXTS) + place, weights=count, minlength=len(table))
        at = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(table[at].astype(np.int64))], ["at", "n"])

    return run


def _assigned(logs: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textkit.tables(batches, 65536):
            words, classes, *_ = _likeliest(logs, batch)
            yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(classes.astype(np.int64))], ["word", "class"])

    return run


def cluster(vectors: DataFrame) -> DataFrame:
    """word, class of vectors (word, places, counts)."""
    return vectors.mapInArrow(_assigned(_fitted(vectors)), "word long, class long")


def _fitted(vectors: DataFrame) -> np.ndarray:
    """Log probabilities of contexts by class. Seeds are the most frequent words; ties go to the first class."""
    total = F.aggregate("counts", F.lit(0).cast("long"), lambda acc, n: acc + n)
    seeds = vectors.withColumn("n", total).orderBy(F.desc("n"), "word").limit(CLASSES).collect()
    if not seeds:
        return np.zeros((1, 2 * CONTEXTS))
    table = np.zeros((len(seeds), 2 * CONTEXTS))
    for i, r in enumerate(seeds):
        table[i, r.places] = r.counts
    for _ in range(ROUNDS):
        moved = vectors.mapInArrow(_exchanged(_logs(table)), "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
        table = np.zeros(len(seeds) * 2 * CONTEXTS)
        table[moved["at"].to_numpy()] = moved["n"].to_numpy()
        table = table.reshape(len(seeds), 2 * CONTEXTS)
    return _logs(table)


def _classed(slices: int):
    """Chunks with the class of each of their words in place of the word lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for words, totals, *placed in _rows(batch, ["words", "totals", "numbers", "classes"]):
                words = _unpacked(words, np.uint64)
                out.append(_packed(_own_classes(words, *_often(words, _unpacked(totals, np.uint64), slices), *placed)))
            columns = ["keys", "held", "sizes", "codes", "totals"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(out, pa.binary())], [*columns, "classes"])

    return run


def _slices(sizes: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """Ranges of texts and of their tokens, of about SLICE tokens; longer texts are slices of their own."""
    ends = np.cumsum(sizes, dtype=np.int64)
    first, begin = 0, 0
    while first < len(sizes):
        last = max(first + 1, int(np.searchsorted(ends, begin + SLICE, "right")))
        yield first, last, begin, int(ends[last - 1])
        first, begin = last, int(ends[last - 1])


def _steps(classes: np.ndarray) -> np.ndarray:
    """Transitions before * ALL_CLASSES + own of each token; texts begin after an end."""
    before = np.concatenate([[END_CLASS], classes[:-1]])
    return before.astype(np.int32) * ALL_CLASSES + classes


def _as_unseen(classes: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Steps with words seen once as unseen words."""
    return _steps(np.where(new, CLASSES, classes))


def _transitions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of steps in training texts; after them, those to and from words seen once, with these as unseen words."""
    n = ALL_CLASSES**2
    table = np.zeros(2 * n, np.int64)
    for batch in batches:
        for held, sizes, codes, totals, classes in _rows(batch, [0, 1, 2, 3, 4]):
            held, sizes = _unpacked(held, bool), _unpacked(sizes, np.uint32)
            new = _unpacked(totals, np.uint64) == 1
            classes, codes = _unpacked(classes, np.uint8), _unpacked(codes, np.uint32)
            for first, last, lo, hi in _slices(sizes):
                mine, train = codes[lo:hi], np.repeat(~held[first:last], sizes[first:last])
                table[:n] += np.bincount(_steps(classes[mine])[train], minlength=n)
                to = new[mine]
                touched = train & (to | np.concatenate([[False], to[:-1]]))
                table[n:] += np.bincount(_as_unseen(classes[mine], to)[touched], minlength=n)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(table))), pa.array(table)], ["at", "n"])


def _scored(steps: np.ndarray, tokens: int, types: int, once: int, twice: int, new: np.ndarray | None = None):
    """Scores by the counts of steps (a square), tokens and types, and of the types seen once and twice.

    The unseen word is alone in its class; its steps are ``new`` (those of words seen once) by the share that was new.
    """
    unseen = once / (once + 2 * twice) if once else 0.5
    smoothed = steps + (0 if new is None else unseen * new) + TRANSITION
    chance = smoothed / smoothed.sum(1, keepdims=True)
    of_class = steps.sum(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, *packed in zip(batch.column(0), *(batch.column(i).to_pylist() for i in range(1, 6)), strict=True):
                held, sizes, codes, totals, classes = (_unpacked(x, k) for x, k in zip(packed, (bool, np.uint32, np.uint32, np.uint64, np.uint8), strict=True))
                totals = totals.astype(np.float64)
                base = (totals + UNIGRAM) / (tokens + UNIGRAM * (types + 1))
                emitted = totals / np.maximum(of_class[classes], 1)
                emitted = np.where(classes == CLASSES, 1.0, emitted)
                logs = np.log10(base)
                for first, last, lo, hi in _slices(sizes):
                    own, n = codes[lo:hi], sizes[first:last].astype(np.int64)
                    p = WEIGHT * chance.ravel()[_steps(classes[own])] * emitted[own] + (1 - WEIGHT) * base[own] if tokens else base[own]
                    starts = np.cumsum(n) - n
                    known, low, high = (np.add.reduceat(x, starts) for x in ((totals > 0)[own].astype(np.int64), logs[own], np.log10(p)))
                    yield pa.RecordBatch.from_arrays(
                        [keys.values.slice(first, last - first), pa.array(held[first:last]), pa.array(n), pa.array(known), pa.array(np.full(len(n), tokens)), pa.array(low), pa.array(high)],
                        ["key", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                    )

    return run


def scores(docs: DataFrame, held: Column | None = None) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    docs: doc_id, text; other columns are not read. ``held`` says which documents do not train (default: a tenth by
    doc_id; a null id is the empty text). Tokens are lower-cased (A-Z) words and an end; null texts are empty, so have
    the end alone. base_score: smoothed unigrams; score: the model's log10 probability; perplexity: 10 to the power of
    its negative mean. Without training documents the score is the base score. Repeated rows count and get a result
    each. No rows give none.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lm")
    packed = docs.select(F.struct("doc_id").alias("key"), (held_out() if held is None else held).alias("held"), "text")
    kind = packed.schema["key"].dataType.simpleString()
    parts = "held binary, sizes binary, codes binary"
    encoded = packed.mapInArrow(_chunked(), f"chunk long, keys array<{kind}>, {parts}, words binary, train binary")
    with _passed(spark, DOCUMENTS):
        encoded = scratch.save(encoded, "encoded", **PACKED)

    slices = max(LEAST, encoded.count() // CHUNKS)
    rows = encoded.select("chunk", "words", "train").mapInArrow(_released(_counts_by_slice(slices)), "slice int, chunk long, words binary, n binary")
    with _passed(spark, BLOBS):
        sums = scratch.save(rows.repartition("slice").sortWithinPartitions("slice").mapInArrow(_released(_totals), _TOTALS), "sums", **PACKED)
    scratch.tidy()
    types, once, twice = (x or 0 for x in sums.agg(F.sum("types"), F.sum("once"), F.sum("twice")).first())
    totals = sums.where("c >= 0").repartition("c").sortWithinPartitions("c", "slice").select("c", "totals", "ids")
    with _passed(spark, BLOBS):
        totals = scratch.save(totals.mapInArrow(_released(_totals_of_chunks), "c long, totals binary, ids binary"), "totals", **PACKED)
    scratch.drop("sums")
    counted = _with(encoded, totals, F.octet_length("totals") + F.octet_length("ids"))
    counted = scratch.save(counted.select("chunk", "keys", "held", "sizes", "codes", "words", "totals", "ids"), "counted", **PACKED)
    scratch.drop("encoded")
    scratch.tidy()

    vectors = counted.select("held", "sizes", "codes", "words", "totals").mapInArrow(_released(_vectors(slices)), "slice int, words binary, keys binary, counts binary")
    vectors = vectors.repartition("slice").sortWithinPartitions("slice").mapInArrow(_released(_summed), "word long, places array<short>, counts array<long>")
    with _passed(spark, BLOBS):
        vectors = scratch.save(vectors, "vectors")
    scratch.tidy()
    row = "slice int, chunk long, words binary, classes binary"
    known = vectors.mapInArrow(_released(_classes_of_words(slices, _fitted(vectors))), row)
    asked = counted.select("chunk", "words", "totals").mapInArrow(_released(_often_of_chunks(slices)), row)
    placed = known.unionByName(asked).repartition("slice").sortWithinPartitions("slice", "chunk").mapInArrow(_released(_looked_up), _ANSWERS)
    placed = scratch.save(_gathered(placed), "placed", **PACKED)
    scratch.drop("vectors")
    scratch.tidy()
    placed = _exchange(scratch, counted, placed, slices)
    classed = _with(counted, placed, _class_bytes())
    with _passed(spark, BLOBS):
        classed = scratch.save(classed.mapInArrow(_released(_classed(slices)), f"keys array<{kind}>, {parts}, totals binary, classes binary"), "classed", **PACKED)
    scratch.drop("counted")
    scratch.tidy()

    found = classed.select("held", "sizes", "codes", "totals", "classes").mapInArrow(_released(_transitions), "at long, n long").groupBy("at").agg(F.sum("n").alias("n"))
    with _passed(spark, BLOBS):
        found = found.toPandas()
    counts = np.zeros(2 * ALL_CLASSES**2, np.int64)
    counts[found["at"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    steps, new = counts.reshape(2, ALL_CLASSES, ALL_CLASSES)
    schema = f"key {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    out = classed.mapInArrow(_released(_scored(steps, int(steps.sum()), int(types), int(once), int(twice), new)), schema)
    perplexity = F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens"))
    return out.select("key.doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", perplexity.alias("perplexity"))
