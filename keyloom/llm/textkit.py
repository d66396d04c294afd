"""Vectorised words of Arrow string columns: spans, 64-bit hashes and n-gram hashes, in pieces of bounded size."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
PIECE = 1 << 20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_STEP = U(0x9E3779B97F4A7C15 | 1)


def _kept(*dropped: tuple[int, int]) -> np.ndarray:
    out = np.ones(256, bool)
    for a, b in dropped:
        out[a : b + 1] = False
    return out


#: Bytes of words: all but white space, and ASCII letters (lower-cased before) and digits with all beyond ASCII.
SPACED = _kept((0x20, 0x20), (0x09, 0x0D))
ALNUM = _kept((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads all of them."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@cache
def _letters() -> np.ndarray:
    return mixed(np.arange(1, 257, dtype=U) * _STEP)


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2^64."""
    if not _POWERS or len(_POWERS[0]) < n:
        up = np.full(max(n, 2 * PIECE), _STEP, U)
        down = np.full(len(up), U(pow(int(_STEP), -1, 1 << 64)), U)
        up[0] = down[0] = 1
        _POWERS[:] = [np.cumprod(up), np.cumprod(down)]
    return _POWERS[0], _POWERS[1]


def forget() -> None:
    """Lets go of the powers, for passes after which a worker reads no more texts."""
    _POWERS.clear()


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is empty."""
    column = pc.fill_null(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column, "")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), at


def _pieces(data: np.ndarray, at: np.ndarray, kept: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of bytes of about PIECE, cut between documents or else between words."""
    lo, end = int(at[0]), int(at[-1])
    while lo < end:
        hi = min(lo + PIECE, end)
        if hi < end:
            cut = int(at[np.searchsorted(at, hi, "right") - 1])
            if cut <= lo:
                cut = hi
                while cut < end and kept[data[cut]]:
                    step = np.flatnonzero(~kept[data[cut : cut + PIECE]])
                    cut = cut + int(step[0]) if len(step) else min(end, cut + PIECE)
                stop = int(at[np.searchsorted(at, lo, "right")])
                cut = min(cut, stop)
            hi = cut
        yield lo, hi
        lo = hi


def spans(data: np.ndarray, at: np.ndarray, kept: np.ndarray, lower: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Starts, ends and hashes of words, piece by piece; offsets are of ``data``. Words do not cross documents."""
    letters, kept = (_letters()[_LOWER], kept[_LOWER]) if lower else (_letters(), kept)
    for lo, hi in _pieces(data, at, kept):
        own = data[lo:hi]
        inside = kept[own]
        edge = np.zeros(hi - lo + 1, bool)
        between = at[np.searchsorted(at, lo, "right") : np.searchsorted(at, hi)] - lo
        edge[between] = True
        first = inside.copy()
        first[1:] &= ~inside[:-1] | edge[1:-1]
        last = inside.copy()
        last[:-1] &= ~inside[1:] | edge[1:-1]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        up, down = _powers(hi - lo)
        total = np.zeros(hi - lo + 1, U)
        np.cumsum(letters[own] * up[: hi - lo], out=total[1:])
        yield starts + lo, ends + lo, mixed((total[ends] - total[starts]) * down[starts] + U(1))


def words(column: pa.Array, kept: np.ndarray = SPACED, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and the offsets of each document's words among them."""
    data, at = buffers(column)
    starts, hashes = [np.zeros(0, np.int64)], [np.zeros(0, U)]
    for s, _, h in spans(data, at, kept, lower):
        starts.append(s)
        hashes.append(h)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), at)


def grams(hashes: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hashes of k consecutive words at each place of the whole sequence."""
    n = max(0, len(hashes) - k + 1)
    out = np.full(n, U(seed * 2 + 1), U)
    for j in range(k):
        out = out * _STEP + hashes[j : j + n]
    return mixed(out)


def tables(batches: Iterator[pa.RecordBatch], rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """Smaller slices of batches, so that what is derived from one stays small."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)
