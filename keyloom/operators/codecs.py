"""Compact encodings of integer sequences: parameters as columns, packing as vectorised numpy inside tasks.

A sequence is what shares a group, in order of an index; its values are non-negative and below 2^63 (diff: any).
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: ln(phi - 1) of the golden ratio phi, from which Rice parameters come.
LN_PHI = math.log((math.sqrt(5) + 1) / 2 - 1)
#: Blocks of the rank index, for sizes.
SUPERBLOCK, BLOCK = 262_144, 4_096


def pack(values: np.ndarray, width: int) -> bytes:
    """Values of ``width`` bits, the lowest first."""
    if not width or not len(values):
        return b""
    bits = (values.astype(np.uint64)[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(blob: bytes, width: int, n: int) -> np.ndarray:
    if not width or not n:
        return np.zeros(n, np.uint64)
    bits = np.unpackbits(np.frombuffer(blob, np.uint8), bitorder="little")[: n * width].reshape(n, width).astype(np.uint64)
    return (bits << np.arange(width, dtype=np.uint64)).sum(1, dtype=np.uint64)


def unary(gaps: np.ndarray) -> bytes:
    """For each gap so many zeros, then a one."""
    ones = np.cumsum(gaps.astype(np.int64) + 1) - 1
    bits = np.zeros(int(ones[-1]) + 1 if len(ones) else 0, np.uint8)
    bits[ones] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def ones_at(blob: bytes, n: int) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(np.frombuffer(blob, np.uint8), bitorder="little"))[:n]


def read_at(blob: bytes, width: int, at: np.ndarray) -> np.ndarray:
    """The values at some places of what ``pack`` made; other places are not read."""
    if not width or not len(at):
        return np.zeros(len(at), np.uint64)
    place = at[:, None] * width + np.arange(width)
    bits = (np.frombuffer(blob, np.uint8)[place >> 3] >> (place & 7).astype(np.uint8)) & np.uint8(1)
    return (bits.astype(np.uint64) << np.arange(width, dtype=np.uint64)).sum(1, dtype=np.uint64)


class Ones:
    """Places of ones in a blob by their number, from counts of the bytes before."""

    def __init__(self, blob: bytes):
        self.bytes = np.frombuffer(blob, np.uint8)
        self.counts = np.bitwise_count(self.bytes)
        self.upto = np.cumsum(self.counts, dtype=np.int64)

    def select(self, k: np.ndarray) -> np.ndarray:
        """The place of each one, numbered from 0; -1 for -1."""
        of = np.searchsorted(self.upto, np.maximum(k, 0), side="right")
        left = np.maximum(k, 0) - (self.upto[of] - self.counts[of])
        seen = np.unpackbits(self.bytes[of][:, None], axis=1, bitorder="little").cumsum(1)
        return np.where(k < 0, -1, of * 8 + (seen == left[:, None] + 1).argmax(1))


def rice_parameter(total: float, n: int) -> int:
    if not n or not total:
        return 0
    p = n / (total + n)
    if not 0 < p < 1:
        return 0
    log = math.log(1 - p)
    if log == 0:
        return 63
    return min(63, max(0, math.floor(math.log2(LN_PHI / log)) + 1))


def rice_parameter_column(total: Column, n: Column) -> Column:
    ratio = F.lit(LN_PHI) / F.log(1 - n / (total + n))
    found = F.floor(F.log2(F.when(total > 0, ratio))) + 1
    return F.coalesce(F.greatest(F.lit(0), F.least(F.lit(63), found)), F.lit(0)).cast("int")


def bit_length_column(x: Column) -> Column:
    return F.when(x > 0, F.length(F.bin(x))).otherwise(F.lit(0)).cast("int")


def low_bits(n: int, universe: int) -> int:
    return math.floor(math.log2(universe / n)) if n and universe > n else 0


def low_bits_column(n: Column, universe: Column) -> Column:
    return F.coalesce(F.when(universe > n, F.floor(F.log2(universe / n))), F.lit(0)).cast("int")


def _index_bits(n_bits: int) -> int:
    """A rank index over so many bits: 64 for each superblock, 16 for each block."""
    return 64 * -(-n_bits // SUPERBLOCK) + 16 * -(-n_bits // BLOCK)


class Rice:
    """Unary quotients and low bits, split by the mean."""

    @staticmethod
    def encode(v: np.ndarray) -> tuple[int, bytes, bytes]:
        width = rice_parameter(float(v.sum(dtype=np.float64)), len(v))
        return width, unary(v >> np.uint64(width)), pack(v & np.uint64((1 << width) - 1), width)

    @staticmethod
    def decode(width: int, n: int, high: bytes, low: bytes) -> np.ndarray:
        ends = ones_at(high, n)
        gaps = np.diff(np.concatenate([[-1], ends])) - 1
        return (gaps.astype(np.uint64) << np.uint64(width)) | unpack(low, width, n)

    @staticmethod
    def access(width: int, high: bytes, low: bytes, at: np.ndarray) -> np.ndarray:
        ones = Ones(high)
        return ((ones.select(at) - ones.select(at - 1) - 1).astype(np.uint64) << np.uint64(width)) | read_at(low, width, at)

    @staticmethod
    def bits(v: np.ndarray) -> int:
        width = rice_parameter(float(v.sum(dtype=np.float64)), len(v))
        high = int((v >> np.uint64(width)).sum()) + len(v)
        return high + _index_bits(high) + width * len(v) + 8


class Compact:
    """All values in the width of the largest."""

    @staticmethod
    def encode(v: np.ndarray) -> tuple[int, bytes, bytes]:
        width = int(v.max()).bit_length() if len(v) else 0
        return width, b"", pack(v, width)

    @staticmethod
    def decode(width: int, n: int, high: bytes, low: bytes) -> np.ndarray:
        return unpack(low, width, n)

    @staticmethod
    def access(width: int, high: bytes, low: bytes, at: np.ndarray) -> np.ndarray:
        return read_at(low, width, at)

    @staticmethod
    def bits(v: np.ndarray) -> int:
        return (int(v.max()).bit_length() if len(v) else 0) * len(v) + 64 + 8


class EliasFano:
    """Values that do not fall: low bits, and unary steps of the rest."""

    @staticmethod
    def encode(v: np.ndarray) -> tuple[int, bytes, bytes]:
        if (v[1:] < v[:-1]).any():
            raise ValueError("the values fall")
        width = low_bits(len(v), int(v[-1]) + 1) if len(v) else 0
        return width, unary(np.diff(np.concatenate([np.zeros(1, np.uint64), v >> np.uint64(width)]))), pack(v & np.uint64((1 << width) - 1), width)

    @staticmethod
    def decode(width: int, n: int, high: bytes, low: bytes) -> np.ndarray:
        return ((ones_at(high, n) - np.arange(n)).astype(np.uint64) << np.uint64(width)) | unpack(low, width, n)

    @staticmethod
    def access(width: int, high: bytes, low: bytes, at: np.ndarray) -> np.ndarray:
        return ((Ones(high).select(at) - at).astype(np.uint64) << np.uint64(width)) | read_at(low, width, at)

    @staticmethod
    def bits(v: np.ndarray) -> int:
        width = low_bits(len(v), int(v[-1]) + 1) if len(v) else 0
        high = (int(v[-1]) >> width) + len(v) if len(v) else 0
        return high + _index_bits(high) + width * len(v) + 64 + 8


def to_diff(v: np.ndarray, step: int) -> np.ndarray:
    """Distances from i * step, the sign (1: not negative) in the lowest bit."""
    d = v.astype(np.int64) - np.arange(len(v), dtype=np.int64) * step
    return (np.abs(d).astype(np.uint64) << np.uint64(1)) | (d >= 0).astype(np.uint64)


def from_diff(x: np.ndarray, step: int, at: np.ndarray | None = None) -> np.ndarray:
    """The values again, of all places or of those in ``at``."""
    d = (x >> np.uint64(1)).astype(np.int64)
    at = np.arange(len(x), dtype=np.int64) if at is None else at
    return (np.where(x & np.uint64(1), d, -d) + at * step).astype(np.int64)


def diff_column(v: Column, i: Column, step: Column) -> Column:
    d = v - i * step
    return F.shiftleft(F.abs(d), 1).bitwiseOR(F.when(d >= 0, 1).otherwise(0).cast("long"))


#: Encoders by name; others with encode, decode, access and bits can be added.
CODECS = {"rice": Rice, "compact": Compact, "elias_fano": EliasFano}
#: Values of a mono sequence that are encoded in one go; longer sequences are cut into ranges of so many.
MONO_BLOCK = 1 << 20
#: Places of a sequence that are read in one go.
ACCESS_BLOCK = 1 << 16
#: Names of dense encoders: one sequence over interleaved pilots (mono), or one for each bucket (inter).
DENSE = {"mono_r": ("mono", "rice"), "inter_r": ("inter", "rice"), "mono_c": ("mono", "compact"), "inter_c": ("inter", "compact")}


def _step(v: np.ndarray) -> int:
    return int(v[-1]) // max(1, len(v) - 1) if len(v) else 0


def _inner(name: str) -> tuple[bool, str]:
    return (True, name[5:]) if name.startswith("diff_") else (False, name)


def _grouped(df: DataFrame, group: str, order: str, value: str, make: Callable[[int, np.ndarray], dict], schema: str) -> DataFrame:
    def run(batches):
        open_g, pieces = 0, []  # of the sequence that may go on in the next batch
        for rows in batches:
            g, v, out = rows["g"].to_numpy(), rows["v"].to_numpy(np.int64), []
            starts = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else []
            for a, b in zip(starts, [*starts[1:], len(g)]):
                if pieces and g[a] != open_g:
                    out.append(make(open_g, np.concatenate(pieces)))
                    pieces = []
                open_g = int(g[a])
                pieces.append(v[a:b])
            if out:
                yield pd.DataFrame(out)
        if pieces:
            yield pd.DataFrame([make(open_g, np.concatenate(pieces))])

    narrow = df.select(F.col(group).cast("long").alias("g"), F.col(order).cast("long").alias("i"), F.col(value).cast("long").alias("v"))
    return narrow.repartition("g").sortWithinPartitions("g", "i").mapInPandas(run, schema)


def _flat(found):
    """Frames of g, i, v from tuples (g, places, values, whether there), many short sequences in one."""
    held, n = [], 0
    for g, i, v, there in found:
        held.append((np.full(len(i), g, np.int64), i, v, ~there))
        n += len(i)
        if n >= ACCESS_BLOCK:
            yield _frame(held)
            held, n = [], 0
    if held:
        yield _frame(held)


def _frame(held) -> pd.DataFrame:
    g, i, v, gone = (np.concatenate(x) for x in zip(*held))
    return pd.DataFrame({"g": g, "i": i, "v": pd.arrays.IntegerArray(v, gone)})


def encode(df: DataFrame, group: str, order: str, value: str, codec: str) -> DataFrame:
    """g, codec, n, step, width, high, low, num_bits: one encoded sequence per group."""
    diff, name = _inner(codec)

    def make(g: int, v: np.ndarray) -> dict:
        step = _step(v) if diff else 0
        x = to_diff(v, step) if diff else v.astype(np.uint64)
        width, high, low = CODECS[name].encode(x)
        return {"g": g, "codec": codec, "n": len(v), "step": step, "width": width, "high": high, "low": low, "num_bits": CODECS[name].bits(x) + 64 * diff}

    return _grouped(df, group, order, value, make, "g long, codec string, n long, step long, width int, high binary, low binary, num_bits long")


def sizes(df: DataFrame, group: str, order: str, value: str, codec: str) -> DataFrame:
    """g, num_bits of each group's sequence when encoded."""
    diff, name = _inner(codec)

    def make(g: int, v: np.ndarray) -> dict:
        x = to_diff(v, _step(v)) if diff else v.astype(np.uint64)
        return {"g": g, "num_bits": CODECS[name].bits(x) + 64 * diff}

    return _grouped(df, group, order, value, make, "g long, num_bits long")


def decode(encoded: DataFrame) -> DataFrame:
    """g, i (from 0), v of all sequences."""

    def found(batches):
        for rows in batches:
            for r in rows.itertuples():
                diff, name = _inner(r.codec)
                x = CODECS[name].decode(int(r.width), int(r.n), r.high or b"", r.low or b"")
                v = from_diff(x, int(r.step)) if diff else x.view(np.int64)
                yield r.g, np.arange(len(v)), v, np.ones(len(v), bool)

    return encoded.mapInPandas(lambda batches: _flat(found(batches)), "g long, i long, v long")


def access(encoded: DataFrame, asked: DataFrame) -> DataFrame:
    """g, i, v: the values at the places (g, i) of ``asked``, each once, read without decoding the sequences.

    v is null where there is no such sequence or place; places with a null are left out.
    """

    def found(batches):
        for rows in batches:
            for r in rows.itertuples():
                at = np.asarray(r.at, np.int64)
                v, there = np.zeros(len(at), np.int64), np.zeros(len(at), bool)
                if r.codec is not None:
                    diff, name = _inner(r.codec)
                    there = (at >= 0) & (at < int(r.n))
                    if there.any():
                        x = CODECS[name].access(int(r.width), r.high or b"", r.low or b"", at[there])
                        v[there] = from_diff(x, int(r.step), at[there]) if diff else x.view(np.int64)
                yield r.g, at, v, there

    places = asked.select(F.col("g").cast("long").alias("g"), F.col("i").cast("long").alias("i")).dropna().distinct()
    lists = places.groupBy("g", F.floor(F.col("i") / ACCESS_BLOCK).alias("block")).agg(F.collect_list("i").alias("at"))
    return lists.join(encoded, "g", "left").select("g", "at", "codec", "n", "step", "width", "high", "low").mapInPandas(lambda batches: _flat(found(batches)), "g long, i long, v long")


def interleaved(pilots: DataFrame, partitions: int) -> DataFrame:
    """pilots (partition_id, bucket, pilot) with the index partitions * bucket + partition_id of dense encoders."""
    return pilots.withColumn("at", F.col("bucket") * partitions + F.col("partition_id"))


def encode_dense(pilots: DataFrame, partitions: int, name: str, block: int = MONO_BLOCK) -> DataFrame:
    """Pilots by a dense encoder: one sequence, in ranges of ``block`` values (g numbers them), or one per bucket over
    the partitions."""
    kind, codec = DENSE[name]
    if kind == "mono":
        return encode(interleaved(pilots, partitions).withColumn("range", F.floor(F.col("at") / block)), "range", "at", "pilot", codec)
    return encode(pilots, "bucket", "partition_id", "pilot", codec)


def decode_dense(encoded: DataFrame, partitions: int, name: str, block: int = MONO_BLOCK) -> DataFrame:
    """partition_id, bucket, pilot again; ``block`` as encoded."""
    out = decode(encoded)
    if DENSE[name][0] == "mono":
        at = F.col("g") * block + F.col("i")
        return out.select((at % partitions).alias("partition_id"), F.floor(at / partitions).alias("bucket"), F.col("v").alias("pilot"))
    return out.select(F.col("i").alias("partition_id"), F.col("g").alias("bucket"), F.col("v").alias("pilot"))


def access_dense(encoded: DataFrame, asked: DataFrame, partitions: int, name: str, block: int = MONO_BLOCK) -> DataFrame:
    """partition_id, bucket, pilot of the places (partition_id, bucket) of ``asked``, each once; ``block`` as encoded.

    The pilot is null where there is none.
    """
    if DENSE[name][0] == "mono":
        inside = F.col("partition_id").between(0, partitions - 1)
        at = F.when(inside, F.col("bucket") * partitions + F.col("partition_id"))
        found = access(encoded, asked.select(F.floor(at / block).alias("g"), F.pmod(at, F.lit(block)).alias("i")))
        at = F.col("g") * block + F.col("i")
        found = found.select(F.pmod(at, F.lit(partitions)).alias("partition_id"), F.floor(at / partitions).alias("bucket"), F.col("v").alias("pilot"))
        outside = asked.where(~inside).select("partition_id", "bucket", F.lit(None).cast("long").alias("pilot"))
        return found.unionByName(outside.dropna(subset=["partition_id", "bucket"]).distinct())
    found = access(encoded, asked.select(F.col("bucket").alias("g"), F.col("partition_id").alias("i")))
    return found.select(F.col("i").alias("partition_id"), F.col("g").alias("bucket"), F.col("v").alias("pilot"))


def unary_gaps(df: DataFrame, order: str, value: str, width: int, group: str = "g") -> DataFrame:
    """Steps of the high parts of an Elias-Fano sequence, with ``falls`` where the values fall."""
    w = Window.partitionBy(group).orderBy(order)
    before = F.lag(value).over(w)
    high = F.shiftright(F.col(value), width)
    gap = high - F.coalesce(F.shiftright(before, width), F.lit(0))
    return df.select(group, order, value, gap.alias("gap"), F.coalesce(before > F.col(value), F.lit(False)).alias("falls"))
