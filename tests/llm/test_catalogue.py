"""Queries of the subpackage with SQL, against DuckDB on the smallest tables."""

import pytest

import __spark_entry__ as entry
from keyloom.llm.catalogue import ORACLE_SQL, QUERIES

WHERE = "/root/testdata/sf0.001"


def rows(df):
    columns = sorted(df.columns)
    plain = lambda x: f"{x:.6g}" if isinstance(x, float) else str(x)
    return columns, sorted(tuple(map(plain, r)) for r in df[columns].itertuples(index=False))


def test_names():
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 11)}
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries()) and set(ORACLE_SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{WHERE}/{t}.parquet'")
    assert rows(QUERIES[name](spark, WHERE).toPandas()) == rows(con.execute(ORACLE_SQL[name]).df())
