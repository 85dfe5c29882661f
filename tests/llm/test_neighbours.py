"""Operator 3 against brute force."""

import itertools

import numpy as np
import pytest

from tidemark.llm import neighbours, probing
from tidemark.llm.neighbours import nearest
from tidemark.llm.queries import op3_multiprobe_neighbours


def brute(rows, k, every):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    out = {}
    for q, x in good:
        if q % every == 0:
            near = sorted((-(x * y).sum() / (np.sqrt((x * x).sum()) * np.sqrt((y * y).sum())), i) for i, y in good if i != q)
            out[q] = [(i, -s) for s, i in near[:k]]
    return out


def test_probes_come_in_order_of_their_cost():
    rng = np.random.default_rng(1)
    for _ in range(5):
        at = rng.uniform(-3, 3, 4)
        own = np.floor(at)
        cost = {}
        for steps in itertools.product((-1, 0, 1), repeat=4):
            cost[steps] = sum(0 if s == 0 else ((a - o) if s < 0 else (o + 1 - a)) ** 2 for s, a, o in zip(steps, at, own))
        got = [tuple((c - own).astype(int)) for c in probing.probes(at, 81)]
        assert len(set(got)) == 81 and got[0] == (0, 0, 0, 0)
        assert np.allclose([cost[g] for g in got], sorted(cost.values()))


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_recall(spark, sf):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").collect()]
    want = brute(rows, 5, 50)
    got = {}
    for r in op3_multiprobe_neighbours(spark, f"/root/testdata/{sf}").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == set(want) and all(sorted(x)[-1][0] == 5 == len(x) for x in got.values())
    hits = [len({i for _, i, _ in got[q]} & {i for i, _ in want[q]}) for q in want]
    assert sum(hits) / (5 * len(hits)) >= 0.9
    exact = dict(itertools.chain.from_iterable((((q, i), s) for i, s in v) for q, v in want.items()))
    assert all(abs(s - exact[q, i]) < 1e-12 for q, x in got.items() for _, i, s in x if (q, i) in exact)


@pytest.mark.parametrize("cell_rows", [4096, 3])
def test_copies_ties_and_odd_vectors(spark, monkeypatch, cell_rows):
    monkeypatch.setattr(neighbours, "CELL_ROWS", cell_rows)
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(1, 30)] + [(i, [1.0, 2.0, 3.0, 4.0]) for i in range(100, 140)]
    rows += [(50, [2.0, 4.0, 6.0, 8.0]), (200, None), (201, []), (210, [0.0] * 4), (220, [1.0, None, 2.0, 3.0]), (230, [1.0, float("nan"), 2.0, 3.0]), (240, [1.0, float("inf"), 2.0, 3.0]), (None, [1.0] * 4), (100, [1.0, 2.0, 3.0, 4.0])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, kind int").repartition(3)
    got = {}
    for r in nearest(df, every=10).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = brute(list(dict((i, (i, v)) for i, v in rows).values()), 5, 10)
    assert set(got) == set(want)
    for q, x in got.items():
        assert [i for _, i, _ in sorted(x)] == [i for i, _ in want[q]], q


def test_few_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [-1.0, 0.1]), (2, [0.0, -1.0])], "vec_id long, embedding array<double>")
    assert [r.vec_id for r in nearest(df).collect()] == [2, 1]
    assert nearest(df.filter("vec_id = 0")).count() == 0
    assert nearest(df.limit(0)).count() == 0


@pytest.mark.parametrize("pairs", [1 << 15, 7])
def test_many_ties_go_to_the_smaller_ids(spark, monkeypatch, pairs):
    """One direction at many lengths: every cosine is the same, the vectors are not. A short vector with the smallest id changes nothing."""
    monkeypatch.setattr(neighbours, "PAIRS", pairs)
    v = [0.3, -1.7, 0.9, 2.2]
    rows = [(i, [x * 2.0 ** (i % 40 - 20) * (1 + i // 40) for x in v]) for i in range(60)] + [(-1, [1.0])]
    got = {}
    for r in nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    same = brute([r for r in rows if r[0] >= 0], 5, 50)
    assert {q: [i for _, i in sorted(x)] for q, x in got.items()} == {q: [i for i, _ in x] for q, x in same.items()}
    power = [(i, [x * 2.0 ** (i - 30) for x in v]) for i in range(60)]
    got = {}
    for r in nearest(spark.createDataFrame(power, "vec_id long, embedding array<double>")).collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert {q: sorted(x) for q, x in got.items()} == {0: [1, 2, 3, 4, 5], 50: [0, 1, 2, 3, 4]}
