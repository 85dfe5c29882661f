"""Operators 1 and 5 and what they share, against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from pyspark.sql import functions as F

from tidemark.llm import base, queries, repeats, substring, suffix_array
from tidemark.llm.substring import substring_dedup
from tidemark.llm.suffix_array import suffix_array_dedup


def corpus(seed, n=60, alphabet="ab c\n", most=200):
    rng = random.Random(seed)
    shared = ["".join(rng.choices(alphabet, k=rng.randint(20, 90))) for _ in range(6)]
    out = []
    for i in range(n):
        text = "".join(rng.choice(shared) if rng.random() < 0.5 else "".join(rng.choices(alphabet + "xyzéß", k=rng.randint(0, most // 4))) for _ in range(rng.randint(0, 6)))
        out.append((i, text))
    out += [(n, None), (n + 1, ""), (None, shared[0] * 2), (3, out[3][1]), (3, out[3][1]), (n + 2, "a" * 500), (n + 3, " \t\n "), (n + 4, shared[1] * 40)]
    return out


def brute_bytes(rows, size):
    seen = Counter()
    for _, t in rows:
        b = (t or "").encode()
        seen.update(b[i : i + size] for i in range(len(b) - size + 1))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for i in range(len(b) - size + 1):
            if seen[b[i : i + size]] > 1:
                gone[i : i + size] = [True] * size
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def brute_words(rows, size):
    seen, split = Counter(), [(t or "").encode().split() for _, t in rows]
    for w in split:
        seen.update(tuple(w[i : i + size]) for i in range(len(w) - size + 1))
    out = []
    for (d, _), w in zip(rows, split):
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            if seen[tuple(w[i : i + size])] > 1:
                gone[i : i + size] = [True] * size
        out.append((d, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    return out


def key(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize("seed,size,crowd", [(1, 24, 256), (2, 40, 2), (3, 9, 256)])
def test_bytes_match_brute_force(spark, seed, size, crowd):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = suffix_array_dedup(df, size=size, width=6, crowd=crowd).collect()
    assert key([tuple(r)[:5] for r in got]) == key(brute_bytes(rows, size))
    assert any(r.n_removed for r in got)
    for r in got:
        assert hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256
        assert sum(s.end - s.start for s in r.spans) == r.n_removed


@pytest.mark.parametrize("seed,size,crowd", [(4, 5, 256), (5, 8, 1), (6, 4, 256)])
def test_words_match_brute_force(spark, seed, size, crowd):
    rows = corpus(seed, alphabet="ab \n")
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = substring_dedup(df, size=size, width=3, crowd=crowd).collect()
    assert key([tuple(r)[:4] for r in got]) == key(brute_words(rows, size))
    assert any(r.n_removed for r in got)
    for r in got:
        assert hashlib.sha256(b" ".join(r.kept.encode().split())).hexdigest() == r.kept_sha256


def test_long_text_is_cut_to_blocks(monkeypatch, spark):
    rng = np.random.default_rng(3)
    units = rng.integers(0, 3, 5000).astype(np.uint64)
    first = np.array([0, 4000, 4003, 5000])
    whole = repeats.chunks_of(units, first, 20, 4)
    monkeypatch.setattr(repeats, "BLOCK", 300)
    cut = repeats.chunks_of(units, first, 20, 4)
    flat = lambda c: sorted((int(r), int(s) + k, int(a)) for r, s, n, a in zip(c["row"], c["start"], c["n"], c["anchor"]) for k in range(int(n)))
    assert flat(whole) == flat(cut)
    assert len(flat(whole)) == 4000 - 19 + 997 - 19


@pytest.mark.parametrize("seed", range(5))
def test_suffix_array_and_prefixes(seed):
    rng = np.random.default_rng(seed)
    symbols = np.append(rng.integers(1, 4 if seed else 3, 400), 0).astype(np.uint16)
    text = symbols.tolist()
    order = suffix_array.suffix_array(symbols, 400)
    assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
    common = suffix_array.neighbour_prefixes(suffix_array.packed(symbols), order, 50, symbols)
    for k in range(1, len(order)):
        a, b = text[order[k - 1] :], text[order[k] :]
        n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert common[k] == min(n, 50)


def test_subtree_nodes():
    assert sorted(substring.subtree(np.array([0, 3, 5, 3, 0, 2]))) == [(2, 4, 5), (3, 0, 3), (5, 1, 2)]


def test_empty_table_and_other_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_array_dedup(empty).count() == 0 and substring_dedup(empty).count() == 0
    odd = spark.createDataFrame([(1, "a b c d e f", 1, 2, 3), (2, "a b c d e f", 1, 2, 3)], "doc_id long, text string, k1 long, spans long, anchor long")
    assert {r.n_removed for r in substring_dedup(odd, size=4, width=2).collect()} == {6}
    assert {r.n_removed for r in suffix_array_dedup(odd, size=4, width=2).collect()} == {11}


def test_rows_that_are_alike_cost_in_proportion(spark):
    """Contexts of rows that share id and text are sent once, whatever their number."""
    rng = random.Random(9)
    one, two = ("".join(rng.choices("abcd ", k=60)) for _ in range(2))
    made = {}
    for n in (50, 400):
        rows = [(None, one + two)] * n + [(1, one + "x" + two[5:]), (2, "y" + one[3:] + two)]
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        keyed = base.keyed(df)
        units = repeats.Units("bytes", 24, 6)
        entries = repeats.anchors(keyed, units).cache()
        kinds = entries.groupBy("anchor", "digest").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("k1", "k2", "start", "n")).alias("one"))
        made[n] = repeats.contexts(keyed, kinds, units).count() - kinds.count()
        got = suffix_array_dedup(df, size=24, width=6).collect()
        assert key([tuple(r)[:5] for r in got]) == key(brute_bytes(rows, 24))
    assert made[50] == made[400] == 0


def test_crowded_anchors_are_widened(spark):
    """One passage in many surroundings: the contexts at its edges come to more than `crowd` units."""
    rng = random.Random(10)
    passage = "".join(rng.choices("abcdef ", k=50))
    rows = [(i, "".join(rng.choices("ghijkl ", k=30)) + passage[rng.randint(0, 9) :] + "".join(rng.choices("mnopq ", k=30))) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for crowd in (30, 500, repeats.CROWD):
        got = suffix_array_dedup(df, size=24, width=6, crowd=crowd).collect()
        assert key([tuple(r)[:5] for r in got]) == key(brute_bytes(rows, 24))


@pytest.mark.parametrize("operator,brute,size,width", [(suffix_array_dedup, brute_bytes, 24, 6), (substring_dedup, brute_words, 12, 3)])
def test_texts_are_not_moved_for_crowded_anchors(spark, monkeypatch, operator, brute, size, width):
    """Texts are joined with what is wanted of them once, however often anchors are widened; after that contexts are."""
    rng = random.Random(12)
    rows = [(i, " ".join(rng.choices("ghi", k=15)) + " j k l m n o p q r s t u v w"[rng.randint(0, 5) * 2 :] + " " + " ".join(rng.choices("xyz", k=15))) for i in range(60)]
    rows += [rows[3], (70, rows[4][1]), (None, rows[5][1]), (None, rows[5][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    read, cut = [], repeats.contexts
    monkeypatch.setattr(repeats, "contexts", lambda rows, kinds, units: read.append((units.width, rows.schema["text"].dataType.simpleString())) or cut(rows, kinds, units))
    got = operator(df, size=size, width=width, crowd=30, texts=False).collect()
    assert key([tuple(r) for r in got]) == key(brute(rows, size))
    assert [kind for _, kind in read] == ["string"] + ["binary"] * (len(read) - 1) and len(read) > 1


@pytest.mark.parametrize("n_bytes,n_words", [(394, 59), (399, 60), (400, 60), (401, 60)])
def test_passages_of_over_50_words_go_from_400_bytes_on(spark, tmp_path, n_bytes, n_words):
    """The registered query, with its own parameters: what repeats goes by its bytes, not by its words, and what surrounds it stays."""
    rng = random.Random(13)
    passage = " ".join("".join(rng.choices("abcdef", k=5)) for _ in range(n_words))
    passage += "f" * (n_bytes - len(passage))
    own = lambda: "".join(rng.choices("ghijkl", k=300))
    rows = [(i, own() + " \t\n"[i] + passage + "\t\n "[i] + own()) for i in range(3)]
    rows += [(3, "".join(rng.choices("mnopqr ", k=900))), (4, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in queries.op1_suffix_array_dedup(spark, str(tmp_path)).collect()]
    assert key(got) == key(brute_bytes(rows, 400))
    assert {r[0]: r[2] for r in got} == {i: n_bytes if i < 3 and n_bytes >= 400 else 0 for i in range(5)}


@pytest.mark.parametrize("name,operator", [("suffix_array", suffix_array_dedup), ("substring", substring_dedup)])
def test_the_resolver_decides(spark, monkeypatch, name, operator):
    """Where an anchor has different contexts, nothing but the suffix array or the tree says which windows repeat."""
    df = spark.createDataFrame(corpus(1, alphabet="ab \n"), "doc_id long, text string").repartition(3)
    removed = lambda: sorted(map(repr, ((r.doc_id, r.n_removed) for r in operator(df, size=6, width=3, texts=False).collect())))
    true = removed()
    for answer in (True, False):
        monkeypatch.setattr({"suffix_array": suffix_array, "substring": substring}[name], "resolve", lambda parts, n, copies, size, answer=answer: [np.full(k, answer) for k in n])
        assert removed() != true
