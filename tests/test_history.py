"""Reads of a history against loops."""

import random

from tidemark.operators import history


def test_gone_by_against_a_loop(spark):
    rng = random.Random(5)
    events = [(rng.choice("abc"), rng.randrange(40), c, rng.choice("ADM")) for c in range(300)]
    asked = [("d", i, rng.choice("abcx"), None if i % 50 == 0 else rng.randrange(-1, 42)) for i in range(400)]
    df = history.gone_by(spark.createDataFrame(asked, "doc string, line long, path string, written long"), spark.createDataFrame(events, "path string, epoch long, commit long, kind string"))
    got = sorted((r.line, r.gone, r.gone_commit) for r in df.collect())
    want = []
    for _, line, path, written in asked:
        later = [(e, c) for p, e, c, k in events if p == path and k == "D" and (written is None or e > written)]
        want += [(line, *min(later))] if later else []
    assert got == sorted(want)


def test_no_window_reads_its_rows_again_and_again(spark):
    """A frame up to the last row is read anew for each row by Spark; a path of n events took n * n / 2 steps."""
    asked = spark.range(1).selectExpr("'a' AS path", "id AS written")
    events = spark.range(1).selectExpr("'a' AS path", "id AS epoch", "id AS commit", "'D' AS kind")
    for df in (history.gone_by(asked, events), history.state_as_of(asked, events)):
        assert "unboundedfollowing" not in df._jdf.queryExecution().optimizedPlan().toString().lower()
