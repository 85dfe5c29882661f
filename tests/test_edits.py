"""Names at a few edits against a loop."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import resolve


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("most", [0, 1, 2, 3])
def test_edit_near_against_a_loop(spark, most):
    rng = random.Random(7)
    name = lambda: "".join(rng.choices("abü_1", k=rng.randrange(1, 7)))
    files, claims = [(f"{rng.choice('xy')}/{name()}",) for _ in range(80)], [(f"{rng.choice('xyz')}/{name()}",) for _ in range(150)]
    got = {(r.target, r.name, r.distance) for r in resolve.edit_near(spark.createDataFrame(claims, "target string"), spark.createDataFrame(files, "path string"), most).collect()}
    want = set()
    for (t,) in set(claims):
        near = min(((d, p[2:]) for (p,) in files if p[0] == t[0] and (d := edits(t[2:], p[2:])) <= most), default=None)
        want |= {(t, near[1], near[0])} if near else set()
    assert got == want and want


def test_a_common_piece_makes_no_pairs(spark, monkeypatch):
    """Before, all names that begin alike met."""
    met, real = [], F.levenshtein
    monkeypatch.setattr(resolve.F, "levenshtein", lambda *a: met.append(a) or real(*a))
    n = 2000
    files = spark.range(n).selectExpr("concat('src/blue_anvil_', 10000 + id * 37, '.py') AS path")
    claims = files.selectExpr("concat('src/', substring(path, 6)) AS target")
    out = resolve.edit_near(claims, files)
    assert out.count() == n and out.agg(F.max("distance")).first()[0] == 1
    assert len(met) == 1  # all were settled at the distance of one, and no pieces were compared
