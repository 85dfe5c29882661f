"""Operator 12 against a loop over all documents, and the lists that it does not read."""

import math
import random
import re
from collections import Counter

import numpy as np

from tidemark.llm.search import Shard, lexical_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k):
    counted = [(i, Counter(terms(t))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    n, length = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in counted:
            m = 75 + 25 * sum(c.values()) * n // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if t in c)
            scores.append((-score, i is None, i or 0, i))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(x for x in scores if x[0] < 0)[:k])]
    return sorted(map(repr, out))


def made(seed, docs, words=60):
    rng = random.Random(seed)
    pool = [f"w{int(rng.paretovariate(0.7))}" for _ in range(400)] + ["Über", "über", "ß", "日本", "A-B", "x_y"]
    return [(i, " ".join(rng.choice(pool) for _ in range(rng.randint(1, words)))) for i in range(docs)]


def found(spark, docs, items, **more):
    d, q = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    return sorted(repr(tuple(r)) for r in lexical_search(d, q, **more).collect())


def test_like_a_loop(spark):
    docs, items = made(1, 300), made(2, 25, 20)
    assert found(spark, docs, items) == brute(docs, items, 20)
    # many shards and blocks change nothing
    assert found(spark, docs, items, k=3, block=60, shard=400) == brute(docs, items, 3)


def test_nulls_ties_repeats_and_odd_texts(spark):
    docs = [(9, "red fox"), (3, "red fox"), (3, "red fox"), (None, "red fox"), (None, "Red FOX"), (1, None), (2, ""), (4, "... !"), (5, "fox " * 30_000), (6, "été-fox"), (None, None)] + [(20 + i, "blue hen") for i in range(40)]
    items = [(1, "fox red red"), (1, "été"), (None, "fox"), (2, None), (3, ""), (4, "?!"), (5, "nowhere"), (6, "hen"), (6, "hen")]
    assert found(spark, docs, items, k=4) == brute(docs, items, 4)


def test_empty_tables_and_other_columns(spark):
    docs, items = spark.createDataFrame(made(4, 5), "doc_id long, text string"), spark.createDataFrame([(1, "w1 w2")], "item_id long, text string")
    assert lexical_search(docs.limit(0), items).collect() == [] == lexical_search(docs, items.limit(0)).collect()
    odd = docs.selectExpr("doc_id", "text", "1 AS score", "2 AS rank", "3 AS query", "array(1) AS terms", "4 AS item_id")
    assert sorted(map(tuple, lexical_search(odd, items).collect())) == sorted(map(tuple, lexical_search(docs, items).collect()))


def test_long_lists_are_probed_only(monkeypatch):
    """A frequent term adds no candidates once the rare ones have set the score to beat."""
    n = 2000
    rng = np.random.default_rng(5)
    rows = np.concatenate([np.arange(n), np.sort(rng.choice(n, 30, replace=False))])
    which = np.repeat([0, 1], [n, 30]).astype(np.int32)
    tfs = np.concatenate([rng.integers(1, 9, n), np.ones(30)]).astype(np.int32)
    shard = Shard(which, rows, tfs, np.full(n, 50), 2, n, 50 * n)
    weights = np.array([1, 9000])
    plain = np.zeros(n, np.int64)
    np.add.at(plain, rows, weights[which] * shard_parts(tfs))
    want = sorted((-s, d) for d, s in enumerate(plain))[:20]
    at, scores = shard.best(np.array([0, 1]), weights, 20, 1)
    assert sorted((-s, d) for d, s in zip(at.tolist(), scores.tolist()))[:20] == want
    assert len(at) <= 30 and not shard.total.any() and not shard.met.any()


def shard_parts(tfs):
    return 1_000_000_000 * tfs.astype(np.int64) // (1000 * tfs.astype(np.int64) + 12 * 100)
