"""Language identification by nearest centroid.

A text becomes the normalised TF-IDF vector of its letter n-grams, hashed into DIMS places; document frequencies count
all training documents. Of each language a bounded sample (PER_LANGUAGE documents, those with the least hashes) is
clustered by cosine into CENTROIDS. A text gets the language of its most similar centroid, and is rejected if the
distance is too large for its length, or if it has no letter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import textkit

DIMS, LONGEST = 1 << 13, 3
#: The bound of the sample that centroids are fitted on, for each language, and centroids of each.
PER_LANGUAGE, CENTROIDS, ROUNDS = 400, 4, 12
#: Parts of a language in which the least hashes are sought at first.
PARTS = 16
#: A text of FULL n-grams or more is rejected below this cosine; the cosine asked for falls with the root of fewer.
LEAST_COSINE, FULL = 0.2, 400
UNKNOWN = "und"
_CLASS = np.full(256, 32, np.uint8)
_CLASS[97:123] = np.arange(97, 123)
_CLASS[65:91] = np.arange(97, 123)
_CLASS[128:] = np.arange(128, 256)
_BLANK = np.full(1, 32, np.uint8)
_ASCII = re.compile(rb"[A-Za-z]")


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1


def has_letter(text: str | None) -> bool:
    return text is not None and (bool(_ASCII.search(text.encode())) or any(map(str.isalpha, text)))


def counts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """n-gram counts, a row per text, and the number of n-grams of each. Blanks stand for all that is no letter."""
    data, at = textkit.buffers(column)
    out = np.zeros((len(column), DIMS), np.float32)
    total = np.zeros(len(column), np.int64)
    for d, (lo, hi) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
        for start in range(lo, hi, textkit.PIECE):  # a blank stands before and after the text
            stop, last = start + textkit.PIECE + LONGEST - 1, start + textkit.PIECE >= hi
            own = np.concatenate([_BLANK[: int(start == lo)], _CLASS[data[start : min(stop, hi)]], _BLANK[: int(stop > hi)]])
            wide = own.astype(np.uint32)
            blank = own == 32
            for n in range(1, LONGEST + 1):
                size = len(own) - n + 1 if last else min(len(own) - n + 1, textkit.PIECE + (start == lo))
                code, good = wide[:size] + np.uint32(n << 26), ~blank[:size] if n == 1 else None
                for j in range(1, n):
                    code = code * np.uint32(257) + wide[j : j + size]
                    apart = ~(blank[j - 1 : j - 1 + size] & blank[j : j + size])
                    good = apart if good is None else good & apart
                place = (code * np.uint32(2654435761)) >> np.uint32(33 - DIMS.bit_length())
                place = place[good]
                out[d] += np.bincount(place, minlength=DIMS)
                total[d] += len(place)
    return out, total


def vectors(column: pa.Array, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Normalised vectors of texts, and their numbers of n-grams."""
    found, total = counts(column)
    np.log1p(found, out=found)
    found *= idf
    norm = np.sqrt(np.einsum("ij,ij->i", found, found))
    found /= np.maximum(norm, 1e-30)[:, None]
    return found, total


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df, n = np.zeros(DIMS, np.int64), 0
    for batch in textkit.tables(batches, 256):
        df += (counts(batch.column(0))[0] > 0).sum(0)
        n += batch.num_rows
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, DIMS), pa.int32()), pa.array([n, *df.tolist()], pa.int64())], ["place", "n"])


def _vectorised(idf: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textkit.tables(batches, 128):
            found, total = vectors(batch.column(1), idf)
            rows = [x.tobytes() if n else None for x, n in zip(found, total, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(rows, pa.binary())], ["lang", "h", "vector"])

    return run


def _clustered(rows: pd.DataFrame) -> pd.DataFrame:
    """Spherical k-means from far-apart seeds; rows of one language, at most PER_LANGUAGE."""
    rows = rows.dropna(subset=["vector"]).sort_values("h")
    if rows.empty:
        return pd.DataFrame({"lang": [], "vector": []})
    x = np.stack([np.frombuffer(v, np.float32) for v in rows["vector"]])
    mean = x.mean(0)
    chosen = [mean / np.linalg.norm(mean)]
    while len(chosen) < min(CENTROIDS, len(x)):
        near = (x @ np.stack(chosen).T).max(1)
        chosen.append(x[np.argsort(near, kind="stable")[len(near) // 4]])  # far, but no outlier
    centres = np.stack(chosen)
    for _ in range(ROUNDS):
        own = (x @ centres.T).argmax(1)
        for j in range(len(centres)):
            if (own == j).any():
                mean = x[own == j].mean(0)
                centres[j] = mean / np.linalg.norm(mean)
    return pd.DataFrame({"lang": rows["lang"].iloc[0], "vector": [c.astype(np.float32).tobytes() for c in centres]})


class Model:
    """idf by place; centroids as rows, with the language of each, in order of languages."""

    def __init__(self, idf: np.ndarray, langs: list[str], centres: np.ndarray):
        self.idf, self.langs, self.centres = idf, langs, centres

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, cosine to its nearest centroid, and whether the text is rejected."""
        found, total = vectors(column, self.idf)
        if not self.langs:
            return [UNKNOWN] * len(column), np.zeros(len(column)), np.ones(len(column), bool)
        near = found @ self.centres.T
        best = near.argmax(1)
        cosine = np.clip(near[np.arange(len(best)), best].astype(np.float64), 0, 1)
        letters = np.array([has_letter(x) for x in column.to_pylist()], bool)
        far = cosine < LEAST_COSINE * np.sqrt(np.minimum(total, FULL) / FULL)
        names = [self.langs[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), letters.tolist(), strict=True)]
        return names, np.where(letters, cosine, 0.0), ~letters | far


def _sample(known: DataFrame) -> DataFrame | None:
    """lang, text, h of at most PER_LANGUAGE documents a language, those of the least hashes of doc_id and text; rows
    alike in both are one. The least are taken in PARTS parts of each language first, and then of what is left."""
    hashed = known.select("lang", "text", F.xxhash64("doc_id", "text").alias("h"))
    least = hashed.select("lang", "h", F.pmod("h", F.lit(PARTS)).alias("part"))
    for by in (["lang", "part"], ["lang"]):
        place = F.row_number().over(Window.partitionBy(*by).orderBy("h"))
        least = least.withColumn("r", place).where(F.col("r") <= PER_LANGUAGE).drop("r")
    cuts = least.groupBy("lang").agg(F.max("h").alias("cut")).collect()
    if not cuts:
        return None
    cut = F.create_map(*[F.lit(x) for r in cuts for x in (r.lang, r.cut)])
    return hashed.where(F.col("h") <= F.element_at(cut, F.col("lang"))).dropDuplicates(["lang", "h"])


def fit(docs: DataFrame) -> Model:
    """Learns from text and lang of ``docs``; rows without either are left out. No rows give a model without languages."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    df = np.zeros(DIMS + 1, np.int64)
    for place, n in known.select("text").mapInArrow(_frequencies, "place int, n long").groupBy("place").agg(F.sum("n")).collect():
        df[place + 1] = n
    idf = (np.log((1 + df[0]) / (1 + df[1:])) + 1).astype(np.float32)
    sample = _sample(known)
    if sample is None:
        return Model(idf, [], np.zeros((0, DIMS), np.float32))
    sample = sample.mapInArrow(_vectorised(idf), "lang string, h long, vector binary")
    fitted = sample.groupBy("lang").applyInPandas(_clustered, "lang string, vector binary").collect()
    fitted = sorted(fitted, key=lambda r: r.lang)
    return Model(idf, [r.lang for r in fitted], np.stack([np.frombuffer(r.vector, np.float32) for r in fitted]) if fitted else np.zeros((0, DIMS), np.float32))


def _predicted(model: Model, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textkit.tables(batches, 256):
            text = batch.column(1)
            langs, cosine, rejected = model.predict(text)
            more, names = ([text], ["text"]) if with_text else ([], [])
            yield pa.RecordBatch.from_arrays([batch.column(0), *more, pa.array(langs), pa.array(cosine), pa.array(rejected)], ["key", *names, "lang_pred", "score", "rejected"])

    return run


def identify(docs: DataFrame, model: Model, with_text: bool = True) -> DataFrame:
    """All columns of ``docs`` and lang_pred, score (cosine, 0 to 1), rejected (columns of those names are replaced).

    Null texts and texts without letters are ``und`` with score 0, and rejected. Between equal centroids the first
    language counts. Repeated rows get a result each, no rows none; whole texts count, however long.
    """
    others = [c for c in docs.columns if c not in ("text", "lang_pred", "score", "rejected")]
    packed = docs.select(F.struct(*others).alias("key") if others else F.lit(0).alias("key"), "text")
    kind = packed.schema["key"].dataType.simpleString()
    text = "text string, " if with_text else ""
    out = packed.mapInArrow(_predicted(model, with_text), f"key {kind}, {text}lang_pred string, score double, rejected boolean")
    where = {c: F.col("key")[c].alias(c) for c in others} | ({"text": F.col("text")} if with_text else {})
    return out.select(*[where[c] for c in docs.columns if c in where], "lang_pred", "score", "rejected")
