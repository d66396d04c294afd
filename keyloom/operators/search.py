"""The search for pilots: per partition, bucket by bucket, the smallest pilot that puts all keys on free slots.

This is the one sequential step. It runs as vectorised numpy inside a task per partition. Small partitions go bucket
by bucket: slots of a bucket's keys for a run of pilots at once, and the first run of pilots that holds a valid one
gives the smallest. Large ones go by windows of buckets, with the same pilots.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import PILOT_LIMIT, BuildConfig, largest_bucket, table_size
from ..functions.hashing import mix64_np, murmur64_np

#: Rows of a search's result, by kind: a bucket's pilot, 64 slots (pos: their number / 64; word: taken ones as bits), a
#: failure.
PILOT, TAKEN, FAILED = 0, 1, 2
#: Failures.
EQUAL_PAYLOADS, LARGE_BUCKET, NO_PILOT = 1, 2, 3
SCHEMA = "partition_id long, kind int, bucket long, pilot long, hashed_pilot long, pos long, word long, num_keys long"
FIRST_RUN, LONGEST_CELLS = 16, 1 << 18
#: Keys from which windows are used, most buckets of single keys in one, cells and pilots of a run, buckets read at once.
MANY_KEYS, WINDOW, CELLS, LONGEST_RUN, BUCKETS_READ = 1 << 15, 1 << 15, 1 << 15, 1 << 12, 1 << 17


class Pilots:
    """Hashes of pilots, grown as needed."""

    def __init__(self, seed: int):
        self.seed, self.hashes = seed, murmur64_np(np.arange(1024, dtype=np.uint64), seed)

    def __call__(self, lo: int, hi: int) -> np.ndarray:
        while len(self.hashes) < min(hi, 1 << 22):
            n = len(self.hashes)
            self.hashes = np.concatenate([self.hashes, murmur64_np(np.arange(n, 2 * n, dtype=np.uint64), self.seed)])
        return self.hashes[lo:hi] if hi <= len(self.hashes) else murmur64_np(np.arange(lo, hi, dtype=np.uint64), self.seed)


def _distinct(slots: np.ndarray) -> np.ndarray:
    """Columns without equal slots."""
    if len(slots) == 1:
        return np.ones(slots.shape[1], bool)
    by_value = np.sort(slots, 0)
    return (by_value[1:] != by_value[:-1]).all(0)


def find_xor(payloads: np.ndarray, taken: np.ndarray, pilots: Pilots, limit: int = PILOT_LIMIT) -> int:
    """The smallest pilot below limit, or -1. slot = (payload xor hash(pilot)) mod m."""
    m, lo, run = np.uint64(len(taken)), 0, FIRST_RUN
    while lo < limit:
        hi = min(lo + run, limit)
        slots = ((payloads[:, None] ^ pilots(lo, hi)) % m).astype(np.int64)
        good = np.flatnonzero(~taken[slots].any(0))
        if len(good):
            good = good[_distinct(slots[:, good])]
            if len(good):
                return lo + int(good[0])
        lo, run = hi, min(run * 2, max(FIRST_RUN, LONGEST_CELLS // len(payloads)))
    return -1


def find_add(payloads: np.ndarray, taken: np.ndarray, limit: int = PILOT_LIMIT) -> int:
    """The smallest pilot below limit, or -1. slot = ((mix(payload + pilot div m) >> 33) + pilot) mod 2^32 mod m.

    While pilot div m stays, all slots of a bucket move together, so equal ones stay equal: such a run is left out.
    """
    m, lo, run = len(taken), 0, FIRST_RUN
    base, at = None, -1
    while lo < limit:
        if lo // m != at:
            at = lo // m
            base = mix64_np(payloads + np.uint64(at)) >> np.uint64(33)
            if len(np.unique(((base + np.uint64(lo)) & np.uint64(0xFFFFFFFF)) % np.uint64(m))) < len(base):
                lo = (at + 1) * m
                continue
        hi = min(lo + run, limit, (at + 1) * m)
        slots = (((base[:, None] + np.arange(lo, hi, dtype=np.uint64)) & np.uint64(0xFFFFFFFF)) % np.uint64(m)).astype(np.int64)
        good = np.flatnonzero(~taken[slots].any(0))
        good = good[_distinct(slots[:, good])] if len(good) else good
        if len(good):
            return lo + int(good[0])
        lo, run = hi, min(run * 2, max(FIRST_RUN, LONGEST_CELLS // len(payloads)))
    return -1


def slots_of(payloads: np.ndarray, pilot: int, m: int, search: str, seed: int) -> np.ndarray:
    if search == "xor":
        return ((payloads ^ murmur64_np(np.array([pilot], np.uint64), seed)[0]) % np.uint64(m)).astype(np.int64)
    moved = (mix64_np(payloads + np.uint64(pilot // m)) >> np.uint64(33)) + np.uint64(pilot)
    return ((moved & np.uint64(0xFFFFFFFF)) % np.uint64(m)).astype(np.int64)


class Window:
    """Pilots of buckets in the order of the search, many at a time, the same as one after another.

    A window of buckets of one size looks for its pilots over the slots taken so far. A candidate is the smallest
    pilot that was valid then, and slots only fill up, so it is the final one if its slots are still free when the
    bucket's turn comes: all buckets before the first that wants a slot of an earlier one are final at once. The
    others keep their candidates and search on from those that have been taken. Single keys need not wait: a slot
    refused for an earlier bucket's sake is never free again for this one, so they search until no two agree.
    """

    def __init__(self, size: int, search: str, seed: int, limit: int = PILOT_LIMIT):
        self.m, self.search, self.limit, self.pilots = size, search, limit, Pilots(seed)
        self.taken, self.used = np.zeros(size, bool), 0
        self.owner = np.zeros(size, np.int32)
        self.span = 256.0

    def __call__(self, payloads: np.ndarray) -> np.ndarray | None:
        """Pilots of buckets of one size (rows), whose slots are taken then; None if one has no pilot."""
        n, size = payloads.shape
        pilots, tried = np.zeros(n, np.int64), np.zeros(n, np.int64)
        slots = np.zeros((n, size), np.int64)
        done = ahead = 0
        again = np.zeros(0, np.int64)
        while done < n:
            end = min(n, max(ahead, done + (WINDOW if size == 1 else max(16, int(self.span * 1.5)))))
            wanted = np.concatenate([again, np.arange(ahead, end)])
            ahead = end
            if len(wanted) and not self._find(payloads, pilots, tried, slots, wanted):
                return None
            own = slots[done:end]
            ids = np.arange(done, end, dtype=np.int32)
            self.owner[own[::-1].ravel()] = np.repeat(ids[::-1], size)
            late = np.flatnonzero((self.owner[own] != ids[:, None]).any(1))
            if size == 1 and len(late):
                again = late + done
                pilots[again] += 1
                continue
            stop = done + int(late[0]) if len(late) else end
            self.span += 0.1 * ((stop - done) * (1 if len(late) else 2) - self.span)
            self.taken[slots[done:stop]] = True
            self.used += (stop - done) * size
            done = stop
            again = np.flatnonzero(self.taken[slots[done:end]].any(1)) + done
            pilots[again] += 1
        return pilots

    def _find(self, payloads: np.ndarray, pilots: np.ndarray, tried: np.ndarray, slots: np.ndarray, rows: np.ndarray) -> bool:
        """Moves rows on to their smallest valid pilots from where they stand, and sets their slots."""
        size = payloads.shape[1]
        free = max(1e-9, 1 - self.used / self.m)
        run = min(LONGEST_RUN, max(8.0, free**-size))
        while len(rows):
            step = int(max(1, min(run, CELLS // min(len(rows), CELLS), LONGEST_CELLS // size)))
            left = [self._run(payloads, pilots, tried, slots, rows[at : at + CELLS], step) for at in range(0, len(rows), CELLS)]
            rows = np.concatenate(left)
            if len(rows) and tried[rows].max() >= self.limit:
                return False
            run = min(LONGEST_RUN, run * 2)
        return True

    def _run(self, payloads: np.ndarray, pilots: np.ndarray, tried: np.ndarray, slots: np.ndarray, rows: np.ndarray, step: int) -> np.ndarray:
        """Tries the next ``step`` pilots of rows; the rows that go on."""
        m, own, start = np.uint64(self.m), payloads[rows], pilots[rows]
        if self.search == "add":
            turn = start // self.m
            own = mix64_np(own + turn.astype(np.uint64)[:, None]) >> np.uint64(33)
            begin = start.astype(np.uint64)
        elif start.max() + step <= len(self.pilots.hashes):
            hashes = None
        else:
            hashes = murmur64_np((start[:, None] + np.arange(step)).view(np.uint64), self.pilots.seed)

        def slot(key: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
            if self.search == "add":
                return (((key + (begin[i] + j.view(np.uint64))) & np.uint64(0xFFFFFFFF)) % m).view(np.int64)
            return ((key ^ (self.pilots.hashes[start[i] + j] if hashes is None else hashes[i, j])) % m).view(np.int64)

        i, j = np.arange(len(rows))[:, None], np.arange(step)[None, :]
        good = ~self.taken[slot(own[:, :1], i, j)]
        if self.search == "add":
            good &= start[:, None] + j < (turn[:, None] + 1) * self.m
        i, j = np.nonzero(good)
        for k in range(1, own.shape[1]):
            ok = np.flatnonzero(~self.taken[slot(own[i, k], i, j)])
            i, j = i[ok], j[ok]
            if not len(i):
                break
        if len(i):
            at = slot(own[i], i[:, None], j[:, None])
            if own.shape[1] > 1:
                apart = np.sort(at, 1)
                ok = np.flatnonzero((apart[:, 1:] != apart[:, :-1]).all(1))
                i, j, at = i[ok], j[ok], at[ok]
            first = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]])) if len(i) else i
            found = rows[i[first]]
            pilots[found] += j[first]
            slots[found] = at[first]
        over = np.ones(len(rows), bool)
        over[i] = False
        rows, start = rows[over], start[over]
        after = start + step
        if self.search == "add":
            turn = (turn[over] + 1) * self.m
            apart = np.sort(own[over] % m, 1)
            stuck = (apart[:, 1:] == apart[:, :-1]).any(1) & (turn < (1 << 32) - (1 << 31))
            after = np.where(stuck, turn, np.minimum(after, turn))
            tried[rows] += np.where(stuck, 1, step)
        else:
            tried[rows] += step
        pilots[rows] = after
        return rows


def words_of(taken: np.ndarray) -> np.ndarray:
    """Taken slots as bits of words of 64."""
    return np.packbits(np.concatenate([taken, np.zeros(-len(taken) % 64, bool)]), bitorder="little").view("<i8")


def searched(bucket: np.ndarray, payload: np.ndarray, config: BuildConfig, seed: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """Failure (0: none), buckets with their pilots, and taken, of one partition."""
    order = np.lexsort((payload, bucket))
    bucket, payload = bucket[order], payload[order]
    starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    sizes = np.diff(np.concatenate([starts, [len(bucket)]]))
    taken = np.zeros(table_size(len(bucket), config.alpha, config.search), bool)
    none = np.zeros(0, np.int64)
    if ((payload[1:] == payload[:-1]) & (bucket[1:] == bucket[:-1])).any():
        return EQUAL_PAYLOADS, none, none, taken
    if sizes.max() > largest_bucket(len(taken)):
        return LARGE_BUCKET, none, none, taken
    ids = bucket[starts]
    pilots, cache = np.zeros(len(ids), np.int64), Pilots(seed)
    if len(bucket) >= MANY_KEYS:
        window, turns = Window(len(taken), config.search, seed), np.lexsort((-ids if config.secondary_sort else ids, -sizes))
        for own in np.split(turns, np.flatnonzero(np.diff(sizes[turns])) + 1):
            got = window(payload[starts[own][:, None] + np.arange(sizes[own[0]])])
            if got is None:
                return NO_PILOT, none, none, taken
            pilots[own] = got
        return 0, ids, pilots, window.taken
    for i in np.lexsort((-ids if config.secondary_sort else ids, -sizes)).tolist():
        own = payload[starts[i] : starts[i] + sizes[i]]
        pilot = find_xor(own, taken, cache) if config.search == "xor" else find_add(own, taken)
        if pilot < 0:
            return NO_PILOT, none, none, taken
        pilots[i] = pilot
        taken[slots_of(own, pilot, len(taken), config.search, seed)] = True
    return 0, ids, pilots, taken


def search(pairs: DataFrame, config: BuildConfig, seed: int) -> DataFrame:
    """SCHEMA rows of all partitions of pairs (partition_id, bucket, payload). A group is a partition of the function,
    of bounded size by its configuration."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        part, n = int(rows["partition_id"].iloc[0]), len(rows)
        failed, ids, pilots, taken = searched(rows["bucket"].to_numpy(np.int64), rows["payload"].to_numpy(np.int64).view(np.uint64), config, seed)
        batches = [_rows(part, n, FAILED, bucket=np.array([failed]))] if failed else [_pilot_rows(part, n, ids, pilots, seed), _word_rows(part, n, words_of(taken))]
        return pa.Table.from_batches(batches).to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get)

    return pairs.select("partition_id", "bucket", "payload").groupBy("partition_id").applyInPandas(run, SCHEMA)


def search_single(pairs: DataFrame, config: BuildConfig, seed: int, n: int) -> DataFrame:
    """The same of the n keys of one partition, which is one task by definition: its buckets come sorted in the order
    of the search and are read a part at a time, so that the task holds the table's slots and never all keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        window = Window(table_size(n, config.alpha, config.search), config.search, seed)
        for ids, sizes, payloads in _read(batches):
            starts, pilots = np.cumsum(sizes) - sizes, np.zeros(len(ids), np.int64)
            for own in np.split(np.arange(len(ids)), np.flatnonzero(np.diff(sizes)) + 1):
                rows = payloads[starts[own][:, None] + np.arange(sizes[own[0]])]
                apart = np.sort(rows, 1)
                failed = EQUAL_PAYLOADS if (apart[:, 1:] == apart[:, :-1]).any() else LARGE_BUCKET if sizes[own[0]] > largest_bucket(window.m) else 0
                got = None if failed else window(rows)
                if got is None:
                    yield _rows(0, n, FAILED, bucket=np.array([failed or NO_PILOT]))
                    return
                pilots[own] = got
            yield _pilot_rows(0, n, ids, pilots, seed)
        yield _word_rows(0, n, words_of(window.taken))

    groups = pairs.groupBy("bucket").agg(F.collect_list("payload").alias("payloads"))
    # Equal payloads come first of all, so that they fail at once; then large buckets, then by number.
    size, most = F.size("payloads"), F.lit(1 << 22)
    first = F.when(F.size(F.array_distinct("payloads")) < size, 0).otherwise(F.greatest(most - size, F.lit(1))).cast("long")
    tie = (F.lit((1 << 40) - 1) - F.col("bucket")) if config.secondary_sort else F.col("bucket")
    ordered = groups.withColumn("turn", F.shiftleft(first, 40) + tie).repartition(1).sortWithinPartitions("turn")
    return ordered.select("bucket", "payloads").mapInArrow(run, SCHEMA).repartition("bucket", "pos")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Buckets, their sizes and payloads, BUCKETS_READ or a few more at a time."""
    held, rows = [], 0

    def joined() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lists = [b.column(1) for b in held]
        parts = [b.column(0) for b in held], [x.value_lengths() for x in lists], [x.flatten() for x in lists]
        ids, sizes, payloads = (np.concatenate([x.to_numpy(zero_copy_only=False) for x in part]) for part in parts)
        return ids, sizes.astype(np.int64), payloads.view(np.uint64)

    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= BUCKETS_READ:
            yield joined()
            held, rows = [], 0
    if rows:
        yield joined()


def _rows(part: int, n: int, kind: int, **columns: np.ndarray) -> pa.RecordBatch:
    size = len(next(iter(columns.values())))
    fixed = {"partition_id": pa.array(np.full(size, part)), "kind": pa.array(np.full(size, kind, np.int32)), "num_keys": pa.array(np.full(size, n))}
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([fixed[c] if c in fixed else pa.array(columns[c]) if c in columns else pa.nulls(size, pa.int64()) for c in names], names)


def _pilot_rows(part: int, n: int, ids: np.ndarray, pilots: np.ndarray, seed: int) -> pa.RecordBatch:
    return _rows(part, n, PILOT, bucket=ids, pilot=pilots, hashed_pilot=murmur64_np(pilots.view(np.uint64), seed).view(np.int64))


def _word_rows(part: int, n: int, words: np.ndarray) -> pa.RecordBatch:
    return _rows(part, n, TAKEN, pos=np.arange(len(words)), word=words)
