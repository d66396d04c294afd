"""Token counts by a linear longest-match automaton.

The trie of the vocabulary gets, for each node, a failure link and the number of tokens that following it pops: what
greedy longest-match-first has settled when no piece goes on as the text does. A word is then read once, byte by
byte, adding those counts; no piece is built. All distinct words of a batch are read in step.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: A vocabulary goes to every task, so its pieces are bounded, in bytes; bytes read in step before words go one by one.
MOST_BYTES, IN_STEP = 64 << 20, 256


@dataclass
class Automaton:
    """edges: sorted node * 256 + byte, to: their ends; fail: -1 for none; pops: tokens that following fail settles;
    rest: tokens that the end of a word settles, -1 if it is no piece of the vocabulary; start, settled: after lead."""

    edges: np.ndarray
    to: np.ndarray
    fail: np.ndarray
    pops: np.ndarray
    rest: np.ndarray
    start: int = 0
    settled: int = 0

    @staticmethod
    def of(pieces: list[bytes], lead: bytes = b" ") -> Automaton:
        """lead: what comes before every word and is tokenised with it."""
        if sum(map(len, pieces)) > MOST_BYTES:
            raise ValueError("the vocabulary is too large to go to every task")
        nodes: list[dict[int, int]] = [{}]
        whole = {0: False}
        for piece in pieces:
            at = 0
            for b in piece:
                after = nodes[at].get(b)
                if after is None:
                    after = nodes[at][b] = len(nodes)
                    nodes.append({})
                at = after
            if at:
                whole[at] = True
        fail, pops = [-1] * len(nodes), [0] * len(nodes)
        level = [(0, b, to) for b, to in nodes[0].items()]
        while level:
            deeper = []
            for up, b, at in level:
                if whole.get(at):
                    fail[at], pops[at] = 0, 1
                else:
                    back, n = fail[up], pops[up]
                    while back >= 0 and b not in nodes[back]:
                        n += pops[back]
                        back = fail[back]
                    if back >= 0:
                        fail[at], pops[at] = nodes[back][b], n
                deeper += [(at, c, to) for c, to in nodes[at].items()]
            level = deeper
        rest = [0] * len(nodes)
        for at in range(1, len(nodes)):
            back, n = at, 0
            while back > 0:
                n += pops[back]
                back = fail[back]
            rest[at] = n if back == 0 else -1
        keys = np.array([at * 256 + b for at, x in enumerate(nodes) for b in x], np.int64)
        to = np.array([t for x in nodes for t in x.values()], np.int32)
        order = np.argsort(keys)
        out = Automaton(keys[order], to[order], np.array(fail, np.int32), np.array(pops, np.int32), np.array(rest, np.int32))
        out.start, out.settled = out._read(0, 0, lead)
        return out

    def _read(self, at: int, n: int, text: bytes) -> tuple[int, int]:
        """Byte by byte; the node is -1 once no piece fits."""
        for b in text:
            while at >= 0:
                i = int(np.searchsorted(self.edges, at * 256 + b))
                if i < len(self.edges) and self.edges[i] == at * 256 + b:
                    at = int(self.to[i])
                    break
                n += int(self.pops[at])
                at = int(self.fail[at])
            if at < 0:
                break
        return at, n

    def count(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Tokens of each word; -1 for words that no pieces make up."""
        order = np.argsort(starts - ends, kind="stable")
        first, long = starts[order], (ends - starts)[order]
        at, n = np.full(len(order), self.start, np.int64), np.full(len(order), self.settled, np.int64)
        for i in range(min(int(long[0]) if len(long) else 0, IN_STEP)):
            todo = np.arange(np.searchsorted(-long, -i, "left"))
            todo = todo[at[todo] >= 0]
            byte = data[first[todo] + i].astype(np.int64)
            while len(todo):
                key = at[todo] * 256 + byte
                j = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
                fits = self.edges[j] == key
                at[todo[fits]] = self.to[j[fits]]
                todo, byte = todo[~fits], byte[~fits]
                n[todo] += self.pops[at[todo]]
                at[todo] = self.fail[at[todo]]
                goes_on = at[todo] >= 0
                todo, byte = todo[goes_on], byte[goes_on]
        for i in np.flatnonzero(long > IN_STEP).tolist():
            at[i], n[i] = self._read(int(at[i]), int(n[i]), data[first[i] + IN_STEP : first[i] + long[i]].tobytes())
        rest = np.where(at >= 0, self.rest[np.maximum(at, 0)], -1)
        out = np.empty(len(order), np.int64)
        out[order] = np.where((at >= 0) & (rest >= 0), n + rest, -1)
        return out


def tiktoken_pieces(path: str) -> list[bytes]:
    """Pieces of a file of lines 'base64 rank'."""
    with open(path, "rb") as lines:
        return [base64.b64decode(line.split()[0]) for line in lines if line.strip()]


def _counted(automaton: Automaton):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textkit.tables(batches):
            data, at = textkit.buffers(batch.column(1))
            first, last, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
            for s, e, h in textkit.spans(data, at, textkit.SPACED, lower=False):
                first.append(s)
                last.append(e)
                keys.append(h)
            s, e = np.concatenate(first), np.concatenate(last)
            _, own, back = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
            each = automaton.count(data, s[own], e[own])[back]
            bounds = np.searchsorted(s, at)
            total, unknown = (np.concatenate([[0], np.cumsum(x)])[bounds] for x in (np.where(each < 0, 1, each), each < 0))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.diff(x).astype(np.int64)) for x in (bounds, total, unknown))], ["key", "n_words", "n_tokens", "n_unknown"])

    return run


def count_tokens(docs: DataFrame, pieces: list[bytes], lead: bytes = b" ") -> DataFrame:
    """All columns of ``docs`` but text, and n_words, n_tokens, n_unknown (columns of those names are replaced).

    Words are runs without ASCII white space; each, after ``lead``, is cut greedily into the longest pieces. A word
    that cannot be cut is one unknown token. Null and empty texts have none. Repeated rows get a result each.
    """
    others = [c for c in docs.columns if c not in ("text", "n_words", "n_tokens", "n_unknown")]
    packed = docs.select(F.struct(*others).alias("key") if others else F.lit(0).alias("key"), "text")
    kind = packed.schema["key"].dataType.simpleString()
    out = packed.mapInArrow(_counted(Automaton.of(pieces, lead)), f"key {kind}, n_words long, n_tokens long, n_unknown long")
    return out.select(*[F.col("key")[c].alias(c) for c in others], "n_words", "n_tokens", "n_unknown")
