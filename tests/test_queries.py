"""The driver's contract: names, and every query with SQL against DuckDB on the smallest tables."""

import math

import pytest

import __spark_entry__ as entry

WHERE = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df):
    columns = sorted(df.columns)
    plain = lambda x: None if x is None or isinstance(x, float) and math.isnan(x) else f"{x:.9g}" if isinstance(x, float) else str(x)
    return columns, sorted((tuple(map(plain, r)) for r in df[columns].itertuples(index=False)), key=str)


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 50


@pytest.mark.parametrize("name", sorted(n for n in entry.core.ORACLE_SQL if not n.startswith("lookup_") or n == "lookup_string_keys"))
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{WHERE}/{t}.parquet'")
    if name == "dict_revenue" or "partition" in name or name in ("save_load_lookup_equal",):
        assert con.execute("SELECT count(*) FROM orders").fetchone()[0] > 1000
    assert rows(entry.core.QUERIES[name](spark, WHERE).toPandas()) == rows(con.execute(entry.core.ORACLE_SQL[name]).df())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
