"""Each registered query of the library against its SQL, and without it for running at all."""

import os

import duckdb
import pytest

from tidemark.plans import registry

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, list | tuple):
        return [plain(v) for v in value]
    return value


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, con, name):
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((repr([plain(r[c]) for c in columns]) for r in df.collect()))
    assert got, "a query must not pass on nothing"
    sql = registry.oracles().get(name)
    if sql is None:
        return
    want = con.sql(sql)
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert got == sorted(repr([plain(r[i]) for i in at]) for r in want.fetchall())
