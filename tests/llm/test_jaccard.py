"""Operator 7 against all pairs."""

import random

import numpy as np
import pytest

from tidemark.llm import base, jaccard
from tidemark.llm.components import components
from tidemark.llm.jaccard import near_duplicates


def family(rng, words, n, edits):
    base = [rng.choice(words) for _ in range(rng.randint(20, 60))]
    for _ in range(n):
        own = list(base)
        for _ in range(rng.randint(0, edits)):
            own[rng.randrange(len(own))] = rng.choice(words)
        yield " ".join(own)


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    texts = [t for _ in range(12) for t in family(rng, words, rng.randint(1, 12), 4)] + [" ".join(rng.choices(words, k=rng.randint(0, 40))) for _ in range(30)]
    passage = " ".join(rng.choices(words, k=25))
    texts += [f"{' '.join(rng.choices(words, k=5))} {passage}" for _ in range(15)]
    rows = [(i, t) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows + [(900, None), (901, ""), (902, " \n"), (903, "a b"), (904, "A  B"), (905, "a"), (None, texts[0]), (None, "only null here twice over"), (None, "only null here twice over"), (3, rows[0][1]), (3, rows[0][1]), (906, texts[1].upper())]


def brute(rows, k, num, den):
    def grams(t):
        w = (t or "").encode().lower().split()
        return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])

    sets = [grams(t) for _, t in rows]
    link = [[i != j and bool(sets[i]) and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]) for j in range(len(rows))] for i in range(len(rows))]
    label = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            label[i] = min([label[i]] + [label[j] for j in range(len(rows)) if link[i][j]])
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if label[j] == label[i] and rows[j][0] is not None]
        out.append((d, len(sets[i]), min(ids) if ids else None, sum(link[i])))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed,k,num,tile", [(1, 3, 90, 1024), (2, 5, 80, 4), (3, 3, 60, 1024)])
def test_all_links_are_found(spark, seed, k, num, tile):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((tuple(r)[:4] for r in near_duplicates(df, k, num, 100, tile=tile).collect()), key=repr)
    want = brute(rows, k, num, 100)
    assert got == want
    assert sum(n > 0 for *_, n in want) > 20


def test_frequent_ngrams_leave_the_zone(spark, monkeypatch):
    rows = corpus(5)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    flat = np.full(1 << jaccard.SKETCH_BITS, 10**9)
    flat[: len(flat) // 2] = 0  # the upper half of all hashes counts as frequent
    monkeypatch.setattr(jaccard, "sketch", lambda rows, k: np.where(flat > 0, 65 * 10**9, 0) if k else flat)
    got = sorted((tuple(r)[:4] for r in near_duplicates(df, 3, 85, 100).collect()), key=repr)
    assert got == brute(rows, 3, 85, 100)


def test_overlaps_and_labels():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 300, 60)).astype(np.uint64) for _ in range(40)]
    got = jaccard.overlaps(sets, width=16)
    assert all(got[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(40) for j in range(40) if i != j)
    assert jaccard.local_labels(6, np.array([4, 1]), np.array([5, 4])).tolist() == [0, 1, 2, 3, 1, 1]


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 200), (200, 150), (300, 300)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 200: 100, 150: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_small_stage_tables_have_few_files(spark, monkeypatch, tmp_path):
    """Where Spark does not join small partitions, tables of a narrow row for each class would get a file for each of them."""
    monkeypatch.setattr(base, "shared_dir", lambda spark: str(tmp_path))
    rows = [(i, f"{i // 2} a{i // 2} b{i // 2} c{i // 2} d{i // 2} e{i // 2}") for i in range(400)]
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        for k, v in zip(before, ("16", "false"), strict=True):
            spark.conf.set(k, v)
        rows += [(i, t + " new") for i, t in rows[:100]]
        got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=3, num=50, den=100)
        assert got.count() == 500 and {r.component_id for r in got.collect()} == set(range(0, 400, 2))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    files = [(t.name.partition("-")[0], len(list(t.glob("part-*")))) for t in (tmp_path / "stages").iterdir()]
    assert {n for name, n in files if name in ("classes", "groups", "sizes", "verdicts")} == {1}
    assert sum(n for name, n in files if name == "edges") <= 16 + sum(name == "edges" for name, _ in files)  # one round's count is not known before


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    odd = spark.createDataFrame([(1, "a b c d e f", 1, 2), (2, "a b c d e f", 1, 2)], "doc_id long, text string, node long, n int")
    assert {r.component_id for r in near_duplicates(odd).collect()} == {1}


def test_links_at_the_threshold_of_equally_frequent_ngrams(spark, monkeypatch):
    rng = random.Random(11)
    rows = []
    for i in range(150):  # six of eight words in common: 6 / 10, exactly the threshold
        words = [f"p{i}x{rng.randrange(10**9)}x{j}" for j in range(10)]
        rows += [(2 * i, " ".join(words[:8])), (2 * i + 1, " ".join(words[:6] + words[8:]))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    exact = jaccard.sketch
    monkeypatch.setattr(jaccard, "sketch", lambda rows, k: np.where(exact(rows, k) > 0, 10**9, 0))  # all n-grams are frequent, with the same count
    got = {r.doc_id: r.n_links for r in near_duplicates(df, 1, 60, 100).collect()}
    assert sum(n == 0 for n in got.values()) == 0


@pytest.mark.parametrize("num,den", [(90, 100), (80, 100), (60, 100)])
def test_linked_sets_have_a_part_in_common(num, den):
    rng = np.random.default_rng(num)
    sets = []
    for size in [*range(1, 40), *rng.integers(40, 900, 60)]:
        whole = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64))
        gone = rng.integers(0, len(whole) * (den - num) // den + 1)
        other = rng.permutation(whole)[gone:]
        more = rng.integers(0, max(0, den * len(other) // num - len(whole)) + 1)
        sets += [whole, np.unique(np.concatenate([other, rng.integers(0, 1 << 63, more).astype(np.uint64)]))]
    row, key = jaccard.part_keys(np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.concatenate(sets), len(sets), num, den)
    linked = 0
    for x in range(0, len(sets), 2):
        a, b = set(sets[x].tolist()), set(sets[x + 1].tolist())
        if a != b and b and den * len(a & b) >= num * len(a | b):
            linked += 1
            assert set(key[row == x].tolist()) & set(key[row == x + 1].tolist())
    assert linked > 30
    assert len(set(key.tolist())) > len(key) / 3  # unlike sets share hardly any


@pytest.mark.parametrize("seed,k,num,tile", [(1, 3, 90, 1024), (2, 5, 80, 4), (3, 3, 60, 1024), (4, 1, 80, 1024)])
def test_all_links_are_found_where_ngrams_are_crowded(spark, seed, k, num, tile):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((tuple(r)[:4] for r in near_duplicates(df, k, num, 100, tile=tile, meeting=1).collect()), key=repr)
    assert got == brute(rows, k, num, 100)


def test_a_common_passage_makes_no_large_group(spark, monkeypatch):
    rng = random.Random(3)
    passage = " ".join(f"common{i}" for i in range(14))
    texts = [f"{passage} {' '.join(f'w{rng.randrange(10**9)}' for _ in range(rng.randint(3, 8)))}" for _ in range(900)]
    texts += [f"{passage} {' '.join(f'pair{x // 2}y{i}' for i in range(30))}" + " end" * (x % 2) for x in range(20)]
    counts, real = {}, jaccard.stage

    def stage(df, name):
        counts[name] = out = real(df, name)
        return out

    monkeypatch.setattr(jaccard, "stage", stage)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    got = {r.doc_id: (r.component_id, r.n_links) for r in near_duplicates(df, 3, 90, 100).collect()}
    assert all(got[900 + x] == (900 + x // 2 * 2, 1) for x in range(20))
    assert all(got[x] == (x, 0) for x in range(900))
    assert counts["groups"].groupBy("root").count().agg({"count": "max"}).first()[0] < 20  # each group's texts are dealt to tiles
