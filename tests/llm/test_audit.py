"""Operator 13 against a loop over orders and documents."""

import random
import re
from itertools import permutations

from pyspark.sql import functions as F

from tidemark.llm.audit import PermutationTrie, filter_audit

COLUMNS = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def brute(docs, labels):
    good, toxic = {d for d, q, _ in labels if q == 1} - {None}, {d for d, _, t in labels if t == 1} - {None}
    judged = []
    for i, lang, text in docs:
        text = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        bad = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), "D": bool(re.search(r"[#$%&*|]", text))}
        bad["E"] = i is not None and any(j is not None and j < i and (t or "") == text for j, _, t in docs)
        judged.append((lang or "", i in good, i in toxic, {f for f in bad if bad[f]}))
    out, shapley = [], {}
    for part in {j[0] for j in judged}:
        for order in permutations("ABCDE"):
            left = [j for j in judged if j[0] == part]
            gone = []
            for step, f in enumerate(order):
                lost = [j for j in left if f in j[3]]
                left = [j for j in left if f not in j[3]]
                alone = sum(j[3] == {f} for j in judged if j[0] == part)
                out.append([part, "".join(order), step + 1, len(left), len(lost), sum(f in j[3] for j in gone), alone, sum(j[1] for j in lost), sum(j[2] for j in lost), f])
                shapley[part, f] = shapley.get((part, f), 0) + len(lost)
                gone += lost
    return sorted(map(repr, ([*r[:-1], shapley[r[0], r[-1]]] for r in out)))


def audited(docs, labels):
    return sorted(repr([r[c] for c in COLUMNS]) for r in filter_audit(docs, labels).collect())


def test_like_a_loop(spark):
    rng = random.Random(11)
    text = lambda: " ".join(rng.choice(["a", "Bc", "é", "#x", "long", *(f"v{k}" for k in range(rng.choice([5, 500])))]) for _ in range(rng.choice([0, 30, 99, 100, 150])))
    docs = [(i, rng.choice(["en", "de", None, ""]), text()) for i in range(60)]
    docs += [(100 + i, rng.choice(["en", None]), docs[rng.randrange(60)][2]) for i in range(30)]
    docs += [(None, "en", docs[0][2]), (None, "en", docs[0][2]), (200, "en", None), (201, "fr", ""), (5, "en", docs[5][2]), (300, "en", "X" * 200_000), (301, "de", "w\x85x\xa0y " * 40_000)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 130, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1)]
    d = spark.createDataFrame(docs, "doc_id long, lang string, text string").repartition(3)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    want = brute(docs, labels)
    assert audited(d, lab) == want
    odd = d.selectExpr("*", "1 AS good", "'x' AS part", "2 AS A", "3 AS digest", "4 AS id")
    assert audited(odd, lab.selectExpr("*", "5 AS text", "6 AS id")) == want


def test_states_are_shared_and_let_go(spark):
    rows = spark.range(64).selectExpr("'p' AS part", "false AS good", "false AS toxic", "id % 2 = 0 AS A", "id % 3 = 0 AS B", "id % 5 = 0 AS C")
    trie = PermutationTrie(rows, {f: F.col(f) for f in "ABC"})
    edges = trie.edges().collect()
    assert len(trie.seen) == 8 and len(edges) == 12  # 2^3 states, an edge for each state and filter that it lacks
    assert {(r.before, r.filter): (r.there, r.removed) for r in edges}["AB", "C"] == (sum(i % 2 and i % 3 and 1 for i in range(64)), sum(bool(i % 2 and i % 3 and i % 5 == 0) for i in range(64)))
    assert not spark.sparkContext._jsc.getPersistentRDDs()


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, lang string, text string")
    assert filter_audit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect() == []
