"""Operators 2 and 8: arithmetic against plain formulas, held-out accuracy, odd rows."""

import math
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from tidemark.llm import langid, quality
from tidemark.llm.queries import op2_quality_discriminant, op8_rank_order_language

SF = "/root/testdata/sf0.01"


def test_discriminant_is_the_difference_of_log_densities():
    rng = np.random.default_rng(0)
    x = [rng.normal(size=(200, 3)) @ rng.normal(size=(3, 3)) + 1, rng.normal(size=(300, 3)) * [1, 2, 0.5]]
    n, means, within = np.array([200.0, 300.0]), np.stack([a.mean(0) for a in x]), np.stack([(a - a.mean(0)).T @ (a - a.mean(0)) for a in x])
    model = quality.Discriminant.fit(n, means, within, 0.2, 0.01)
    pooled = sum((a - a.mean(0)).T @ (a - a.mean(0)) for a in x) / 498
    density = []
    for k, a in enumerate(x):
        c = 0.99 * (0.8 * np.cov(a.T) + 0.2 * pooled) + 0.01 * np.eye(3) * (np.trace(pooled) / 3 + 1e-9)
        d = x[1] - a.mean(0)
        density.append(math.log(n[k] / 500) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(c), d))
    assert np.allclose(model.score(x[1]), 1 / (1 + np.exp(density[0] - density[1])))
    assert quality.Discriminant.fit(np.array([1.0, 3.0]), means, np.zeros((2, 3, 3)), 0.1, 0.1).score(x[0])[0] == 0.75


def test_classes_of_identical_documents(spark):
    """Nothing varies but rounding: the ridge keeps the covariances positive definite."""
    rng = np.random.default_rng(1)
    rows, labels = [], []
    for k in range(6):
        text = " ".join(rng.choice(["alpha", "be", "Gamma", "delta,", "e|f", "12"], rng.integers(3, 300)))
        rows += [(k * 1000 + i, text) for i in range(400)]
        labels += [(k * 1000 + i, k % 2) for i in range(400)]
    docs, told = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    for some in ("doc_id < 2000", "doc_id < 4000", "doc_id >= 4000"):
        got = quality.quality_scores(docs.filter(some), told.filter(some)).collect()
        y = dict(labels)
        assert all(r.predicted == y[r.doc_id] for r in got), some
    statistics = [quality.statistics(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)])) for t in {t for _, t in rows}]
    for copies in (200, 3000):
        for x in statistics:
            same = np.repeat(x, copies, 0)
            means = same.sum(0)[None] / copies
            part = ((same - means).T @ (same - means))[None]
            quality.Discriminant.fit(np.array([copies, copies]), np.repeat(means, 2, 0), np.repeat(part, 2, 0), 0.1, 1e-4)


def plain_statistics(text):
    """The 14 statistics of one text, by loops over words and characters."""
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text) if w]
    chars, lines, size = sum(map(len, words)), text.split("\n"), len(text.encode())
    grams = Counter(zip(words, words[1:], words[2:]))
    again = sum(any(0 <= k <= len(words) - 3 and grams[tuple(words[k : k + 3])] > 1 for k in (i - 2, i - 1, i)) for i in range(len(words)))
    seen, dup = set(), 0
    for line in lines:
        dup += line in seen
        if line.strip(" \t\r\x0b\x0c"):
            seen.add(line)
    upper = sum("A" <= c <= "Z" or "\u00c0" <= c <= "\u00de" for c in text)
    letters = sum(c.isascii() and c.isalpha() or 0xC3 <= b < 0xF5 for c in text for b in c.encode()[:1]) or 1
    root, n, some = math.sqrt, max(len(words), 1), max(chars, 1)
    count = lambda kinds: sum(text.count(c) for c in kinds)
    return [
        math.log1p(len(words)), math.log1p(chars / n), root(count("#*$%&|<>") / some), root(upper / letters), root(text.count("!") / some), root(text.count("|") / some),
        root(sum(a == b for a, b in zip(words, words[1:])) / n), math.log1p(len(set(words))) / math.log(n + 2), root(again / n), root(dup / len(lines)),
        math.log1p(max(size, 1) / len(lines)), root(count(".,;:?'\"()[]-") / some), root(count("0123456789") / some), root(sum(len(w.encode()) <= 3 for w in words) / n),
    ]


def test_statistics_like_loops(spark):
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    texts = sorted(texts, key=len)[:150] + ["", " \n ", "a a a\na a a\n\n", "ÀÉ ß", "日本 x!|"]
    raw = [t.encode() for t in texts]
    got = quality.statistics(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    assert np.allclose(got, [plain_statistics(t) for t in texts])


def test_quality_held_out_accuracy(spark):
    got = {r.doc_id: r for r in op2_quality_discriminant(spark, SF).collect()}
    told = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    held = [d for d in told if got[d].held_out]
    assert all(got[d].held_out == (crc32(str(d).encode()) % 5 == 0) for d in got)
    assert len(held) > 50 and np.mean([got[d].predicted == told[d] for d in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())


def test_quality_odd_rows(spark):
    docs = spark.createDataFrame([(1, "a b", 5), (None, "c", 5), (2, None, 5), (3, "", 5), (4, "x " * 20_000, 5), (1, "a b", 5)], "doc_id long, text string, x int")
    labels = spark.createDataFrame([(1, 1), (None, 0), (2, None), (3, 7)], "doc_id long, quality int")
    rows = quality.quality_scores(docs, labels).collect()
    assert len(rows) == 6 and all(r.score is not None for r in rows)
    none = quality.quality_scores(docs, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    assert quality.quality_scores(docs.limit(0), labels).count() == 0


def plain_grams(text):
    out, word = Counter(), ""
    text = text.lower()
    letters = "".join(c if c.isalpha() else " " for c in text)
    for word in letters.split():
        padded = f" {word} "
        out.update(padded[i : i + n] for n in (1, 2, 3) for i in range(len(padded) - n + 1) if padded[i : i + n] != " ")
    return out


def spelled(key):
    return "".join(chr(key >> s & (1 << 21) - 1) for s in (42, 21, 0) if key >> s & (1 << 21) - 1)


@pytest.mark.parametrize("texts", [["Hello, World!", "", "12 -- 3", "Ünï  ß a\n\nb", "日本 x"], ["...", "İstanbul'da ne var", "a"]])
def test_grams_match_plain_counts(texts):
    row, key, count, has = langid.grams(texts)
    for i, t in enumerate(texts):
        assert {spelled(int(k)): int(c) for r, k, c in zip(row, key, count) if r == i} == plain_grams(t)
        assert has[i] == any(c.isalpha() for c in t)


def test_out_of_place_distance():
    known = {"aa": langid.top(*langid.grams(["the cat and the dog"])[:3], 20)[1], "bb": langid.top(*langid.grams(["le chat et la chienne"])[:3], 20)[1]}
    text = "the chat and then"
    own = langid.top(*langid.grams([text])[:3], 20)[1].tolist()
    want = {lang: sum(abs(i - p.tolist().index(k)) if k in p.tolist() else 20 for i, k in enumerate(own)) for lang, p in known.items()}
    lang, score = langid.Distances(known, 20).predict([text, "", "!!"])
    assert lang[0] == min(want, key=want.get) and math.isclose(score[0], 1 - min(want.values()) / (20 * len(own)))
    assert lang[1:] == ["und", "und"]


def test_language_held_out_accuracy(spark):
    told = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = op8_rank_order_language(spark, SF).collect()
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out]
    assert len(held) > 100 and np.mean([r.lang_pred == told[r.doc_id] for r in held]) > 0.98


def test_language_odd_rows(spark):
    rows = [(1, "the cat and the dog", "en", 1), (4, "le chat et la chienne", "fr", 1), (None, "the dog", "en", 1), (5, None, "en", 1), (6, "", None, 1), (7, "123 ...", "fr", 1), (8, "the the " * 30_000, None, 1), (8, "the the " * 30_000, None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    got = sorted(((r.doc_id, r.lang_pred) for r in langid.languages(df).collect()), key=repr)
    assert got == sorted([(1, "en"), (4, "fr"), (None, "en"), (5, "und"), (6, "und"), (7, "und"), (8, "en"), (8, "en")], key=repr)
    assert {r.lang_pred for r in langid.languages(df.withColumn("lang", df.lang.substr(9, 0))).collect()} <= {"", "und"}
    assert langid.languages(df.limit(0)).count() == 0


def test_many_kinds_of_letters_in_one_run_of_rows():
    from tidemark.llm.langid import grams

    letters = [chr(c) for c in range(0x110000) if chr(c).isalpha() and chr(c).lower() == chr(c)]
    assert len(letters) > 66_000
    texts = ["ab a"] * 3000 + ["".join(letters)] + ["b a"] * 5
    row, key, count, has = grams(texts)
    assert has.all() and (np.diff(row) >= 0).all() and row.max() == len(texts) - 1
    one = grams(["ab a"])
    for i in (0, 1499, 2999):
        assert key[row == i].tolist() == one[1].tolist() and count[row == i].tolist() == one[2].tolist()
    assert len(key[row == 3000]) >= 3 * len(letters) - 2


def test_whole_result_like_plain_profiles(spark):
    """Profiles, distances and the query's rows against counters over all documents."""
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").collect()
    key = lambda g: sum(ord(c) << 21 * (len(g) - 1 - i) for i, c in enumerate(g))
    first = lambda c: [g for g, _ in sorted(c.items(), key=lambda x: (-x[1], key(x[0])))[:300]]
    grams, learned = [plain_grams(r.text or "") for r in rows], {}
    for r, g in zip(rows, grams):
        if r.lang is not None and r.text is not None and crc32(str(r.doc_id).encode()) % 4 != 2:
            learned.setdefault(r.lang, Counter()).update(g)
    ranks = {lang: {g: i for i, g in enumerate(first(c))} for lang, c in sorted(learned.items())}
    want = {}
    for r, g in zip(rows, grams):
        own = first(g)
        far = {lang: sum(abs(i - known[x]) if x in known else 300 for i, x in enumerate(own)) for lang, known in ranks.items()}
        best = min(far, key=far.get)
        want[r.doc_id] = (best, 1 - far[best] / (300 * len(own))) if own else ("und", 0.0)
    got = {r.doc_id: (r.lang_pred, r.score) for r in op8_rank_order_language(spark, SF).collect()}
    assert len(ranks) > 1 and got.keys() == want.keys()
    assert [(d, got[d][0]) for d in got] == [(d, want[d][0]) for d in got]
    assert all(math.isclose(got[d][1], want[d][1], abs_tol=1e-12) for d in got)
