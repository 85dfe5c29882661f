"""Globs over paths whose numbers have any length."""

import duckdb

import __spark_entry__


def test_keys_of_any_length(spark, tmp_path):
    keys = [1, 10, 19999, 20000, 100000, 123456, 199999, 1000000, 1200000, 210000, 10**18, 9 * 10**18]
    rows = [(k, name, f"{kind} X") for k in keys for name, kind in (("hot bolt", "SMALL"), ("a_1b c", "SMALL"), ("a_12.py/b c", "LARGE"))]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_type string").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    got = {(r.path, r.hit) for r in __spark_entry__.queries()["glob_predicate"](spark, str(tmp_path)).collect()}
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW part AS FROM '{tmp_path}/part.parquet/*.parquet'")
        want = set(db.execute(__spark_entry__.oracle_sql()["glob_predicate"]).fetchall())
    assert got == want and len({p for p, hit in want if hit}) > 8
