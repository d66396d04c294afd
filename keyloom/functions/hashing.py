"""128-bit key hashes (h1, h2) as Spark columns: XXH64 and MurmurHash64A with a seed and with its complement."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .u64 import ALL, lit, shr, signed, wrapping

#: Fixed values of XXH64 and MurmurHash64A.
P1, P2, P3, P4, P5 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5
MURMUR_M, MURMUR_R = 0xC6A4A7935BD1E995, 47
#: The seed with which Spark's xxhash64 begins.
SPARK_SEED = 42


def _unshift(x: int, n: int) -> int:
    """Inverse of x ^ (x >> n)."""
    out = x
    for _ in range(64 // n + 1):
        out = x ^ (out >> n)
    return out


def xx_preimage(seed: int) -> int:
    """The long whose xxhash64 in Spark is ``seed``: hashing it first seeds the hash of the next column."""
    inverse = lambda p: pow(p, -1, 1 << 64)
    h = _unshift(seed & ALL, 32) * inverse(P3) & ALL
    h = _unshift(h, 29) * inverse(P2) & ALL
    h = (_unshift(h, 33) - P4) * inverse(P1) & ALL
    h = (h >> 27 | h << 37) & ALL
    k = (h ^ (SPARK_SEED + P5 + 8)) * inverse(P1) & ALL
    k = (k >> 31 | k << 33) & ALL
    return k * inverse(P2) & ALL


def xx64(key: Column, seed: int) -> Column:
    """XXH64 of a BIGINT (8 bytes, little-endian), STRING (UTF-8) or BINARY key. Null keys have to be filtered before."""
    return F.xxhash64(lit(xx_preimage(seed)), key)


def murmur64(key: Column, seed: int) -> Column:
    """MurmurHash64A of a BIGINT as 8 little-endian bytes; to be used under ``wrapping``."""
    m = lit(MURMUR_M)
    k = key * m
    k = k.bitwiseXOR(shr(k, MURMUR_R)) * m
    h = lit((seed & ALL) ^ (8 * MURMUR_M & ALL)).bitwiseXOR(k) * m
    h = h.bitwiseXOR(shr(h, MURMUR_R)) * m
    return h.bitwiseXOR(shr(h, MURMUR_R))


def murmur64_np(values: np.ndarray, seed: int) -> np.ndarray:
    """The same of uint64 values."""
    m, r = np.uint64(MURMUR_M), np.uint64(MURMUR_R)
    k = values * m
    k = (k ^ (k >> r)) * m
    h = (np.uint64((seed & ALL) ^ (8 * MURMUR_M & ALL)) ^ k) * m
    h = (h ^ (h >> r)) * m
    return h ^ (h >> r)


def murmur64_bytes(keys: list[bytes], seed: int) -> np.ndarray:
    """MurmurHash64A of byte strings; all of one length go together."""
    m, r = np.uint64(MURMUR_M), np.uint64(MURMUR_R)
    sizes = np.fromiter(map(len, keys), np.int64, len(keys))
    out = np.empty(len(keys), np.uint64)
    for n in np.unique(sizes).tolist():
        own = np.flatnonzero(sizes == n)
        data = np.frombuffer(b"".join(keys[i] for i in own), np.uint8).reshape(len(own), n)
        h = np.full(len(own), np.uint64((seed & ALL) ^ (n * MURMUR_M & ALL)))
        for at in range(0, n - 7, 8):
            k = np.ascontiguousarray(data[:, at : at + 8]).view("<u8").ravel() * m
            h = (h ^ ((k ^ (k >> r)) * m)) * m
        if n % 8:
            tail = np.zeros((len(own), 8), np.uint8)
            tail[:, : n % 8] = data[:, n - n % 8 :]
            h = (h ^ tail.view("<u8").ravel()) * m
        h = (h ^ (h >> r)) * m
        out[own] = h ^ (h >> r)
    return out


def _murmur_udf(seed: int) -> Callable[[Column], Column]:
    @F.pandas_udf(T.LongType())
    def hashed(keys: pd.Series) -> pd.Series:
        return pd.Series(murmur64_bytes([b"" if x is None else bytes(x) for x in keys], seed).view(np.int64)).where(keys.notna())

    return hashed


def mix64(x: Column) -> Column:
    """Finaliser of splitmix; to be used under ``wrapping``."""
    x = x.bitwiseXOR(shr(x, 30)) * lit(0xBF58476D1CE4E5B9)
    x = x.bitwiseXOR(shr(x, 27)) * lit(0x94D049BB133111EB)
    return x.bitwiseXOR(shr(x, 31))


def mix64_np(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Hashers by name: (key, its type, seed) to a column. Others can be added.
HASHERS: dict[str, Callable[[Column, T.DataType, int], Column]] = {}


def _xx(key: Column, kind: T.DataType, seed: int) -> Column:
    return xx64(key, seed)


def _murmur(key: Column, kind: T.DataType, seed: int) -> Column:
    return murmur64(key, seed) if isinstance(kind, T.LongType) else _murmur_udf(seed)(key.cast("binary"))


HASHERS |= {"xx": _xx, "murmur": _murmur}


def hashed(keys: DataFrame, column: str, hasher: str, seed: int) -> DataFrame:
    """``keys`` with h1, h2 of the key column. BIGINT, STRING and BINARY keys are taken, INT as BIGINT."""
    kind = keys.schema[column].dataType
    key = F.col(column)
    if isinstance(kind, (T.IntegerType, T.ShortType, T.ByteType)):
        kind, key = T.LongType(), key.cast("long")
    if not isinstance(kind, (T.LongType, T.StringType, T.BinaryType)):
        raise TypeError(f"keys must be BIGINT, STRING or BINARY, not {kind.simpleString()}")
    make = HASHERS[hasher]
    with wrapping(keys.sparkSession):
        return keys.withColumns({"h1": make(key, kind, seed), "h2": make(key, kind, ~seed & ALL)})


def hash_pilot(pilot: int, seed: int) -> int:
    return signed(int(murmur64_np(np.array([pilot], np.uint64), seed)[0]))
