"""Operator 9: the properties of a Pfair schedule, and the SQL that says the same."""

import random

import duckdb
import pytest

from tidemark.llm.mixing import ORACLE, mix_sources, quotas, schedule

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("shares", [{"a": 70, "b": 20, "c": 10}, {"x": 1, "y": 1, "z": 1}, {"a": 997, "b": 2, "c": 1, "d": 0}])
def test_deviation_stays_below_one_block(spark, shares):
    period = 100
    quota = quotas(spark.createDataFrame(list(shares.items()), "source string, share long"), period)
    of = {r.source: r.quota for r in quota.collect()}
    assert sum(of.values()) == period and min(of.values()) >= 1
    rows = sorted(schedule(quota, period).collect(), key=lambda r: r.slot)
    assert [r.slot for r in rows] == list(range(period))
    assert all(r.release <= r.slot < r.due for r in rows)
    for t in range(period + 1):
        for s, a in of.items():
            assert abs(sum(r.source == s for r in rows[:t]) - a * t / period) < 1


def test_every_document_once_and_weights_hold(spark):
    rng = random.Random(0)
    rows = [(i, rng.choice("aab"), "x" * rng.randint(0, 30)) for i in range(400)] + [(None, None, None), (401, None, "y"), (402, "c", "z" * 500), (3, "a", "dup"), (3, "a", "dup"), (404, "c", None)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(3)
    got = mix_sources(df, {"a": 5, "b": 3, "c": 1}, block=50, period=20).collect()
    assert sorted((repr(r.doc_id), repr(r.source)) for r in got) == sorted((repr(a), repr(b)) for a, b, _ in rows)
    assert all(r.release <= r.slot < r.due for r in got)
    slots = {(r.source, r.block): r.slot for r in got}
    assert len(set(slots.values())) == len(slots)
    assert len({(r.source, r.slot) for r in got}) == len(slots)
    assert mix_sources(df.limit(0)).count() == 0


def test_more_sources_than_slots(spark):
    rows = [(i, f"s{i % 45}", "x" * 60) for i in range(180)]
    got = mix_sources(spark.createDataFrame(rows, "doc_id long, source string, text string"), block=50, period=20).collect()
    assert sorted(r.doc_id for r in got) == list(range(180))
    assert all(r.release <= r.slot < r.due for r in got)
    first = {r.source for r in got if r.slot < 60}
    assert len(first) == 45


def test_sql_agrees(spark):
    from tidemark.llm.queries import op9_pfair_mixing

    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    want = con.sql(ORACLE)
    names = want.columns
    got = sorted(tuple(r[c] for c in names) for r in op9_pfair_mixing(spark, SF).collect())
    assert got == sorted(want.fetchall()) and len(got) > 100
    assert "Python" not in op9_pfair_mixing(spark, SF)._jdf.queryExecution().toString()
