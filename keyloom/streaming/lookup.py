"""An extension: positions for keys of a stream, by stream-static joins with the tables of an index."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..plans.index import Index


def lookup_stream(stream: DataFrame, key: str, index: Index, to: str = "position") -> DataFrame:
    """The stream with each key's position. The index should have been loaded from a folder, so that each micro-batch
    reads its tables from there; no state is kept."""
    return index.lookup(stream, key, to)
