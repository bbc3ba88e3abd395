"""Every query of the engine's own operators against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from tidemark.plans import catalogue

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    return round(float(v), 6) if isinstance(v, (int, float)) or type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", list(catalogue.queries()))
def test_query(spark, sql, name):
    df = catalogue.queries()[name](spark, SF)
    got = sorted(repr(tuple(plain(r[c]) for c in sorted(df.columns))) for r in df.collect())
    if name not in catalogue.oracle_sql():
        assert got
        return
    rel = sql.sql(catalogue.oracle_sql()[name])
    assert sorted(rel.columns) == sorted(df.columns)
    at = [rel.columns.index(c) for c in sorted(rel.columns)]
    assert got == sorted(repr(tuple(plain(r[i]) for i in at)) for r in rel.fetchall())


def test_entry_module(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
