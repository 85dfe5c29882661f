"""Operator 10: base counts against brute force, measures against the tokenizer, bands on a small corpus."""

import math
import random
import zlib
from collections import Counter

from tidemark.llm.fertility import fertility, fertility_rules, script_of
from tidemark.llm.tokens import public_path

WORD_BREAKS = " \t\n\r\x0b\x0c"


def words_of(text):
    out, word = [], ""
    for c in (text or "") + " ":
        if c in WORD_BREAKS:
            if word:
                out.append(word)
            word = ""
        else:
            word += c
    return out


def brute(text):
    w = words_of(text)
    grams = Counter(zip(w, w[1:], w[2:]))
    hit = [any(0 <= k <= len(w) - 3 and grams[tuple(w[k : k + 3])] > 1 for k in (i - 2, i - 1, i)) for i in range(len(w))]
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for line in lines:
        dup += line in seen
        if words_of(line):
            seen.add(line)
    n, r = len(w), sum(hit)
    return n, sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, r, n < 50 or 100 * r > 50 * n


def test_base_counts(spark):
    rng = random.Random(7)
    rows = [(i, "".join(rng.choice(["ab", "é", "x", "#", "|", " ", " ", "\n", "\t", "\x85", "\xa0", "日本"]) for _ in range(rng.randint(0, 400)))) for i in range(80)]
    rows += [(100, None), (101, ""), (102, "a b c\na b c\n \n \na b c"), (None, "x y " * 200), (103, "w " * 30_000), (1, rows[1][1]), (1, rows[1][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = fertility_rules(df, lang_col=None).collect()
    want = sorted((repr(d), *brute(t)) for d, t in rows)
    assert sorted((repr(r.doc_id), *tuple(r)[1:7]) for r in got) == want
    assert not any(r.kept for r in got if r.base_failed)
    assert fertility_rules(df.limit(0), lang_col=None).count() == 0


def test_measures(spark):
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=public_path("piece_bpe_32k.model"))
    texts = ["The river and the lake", "漢字ꙮ x", "", "Éé ümläut ß"]
    for r in fertility(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), lang_col=None).collect():
        ids = [i for w in words_of(texts[r.doc_id]) for i in model.encode(w)]
        n = len(ids)
        assert r.n_tokens == n
        assert math.isclose(r.byte_share, sum(map(model.is_byte, ids)) / max(n, 1))
        assert math.isclose(r.token_entropy, -sum(c / n * math.log2(c / n) for c in Counter(ids).values()), abs_tol=1e-9)
        assert math.isclose(r.chars_per_token, sum(map(len, words_of(texts[r.doc_id]))) / max(n, 1))


def test_whole_texts_tokenise_as_their_words(spark):
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=public_path("piece_bpe_32k.model"))
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(30).collect():
        text = " ".join(words_of(r.text))
        assert model.encode(text) == [i for w in words_of(text) for i in model.encode(w)]


def test_bands_reject_the_odd_text(spark):
    rng = random.Random(1)
    syllables = "the and ing er re on at en tion nd".split()
    prose = lambda: " ".join("".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(120))
    rows = [(i, prose(), "en") for i in range(60)] + [(99, " ".join(f"{w}&&&$$" for w in prose().split()), "en"), (98, prose(), None)]
    got = {r.doc_id: r for r in fertility_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert not got[99].kept and not got[99].base_failed and all(got[i].kept for i in range(60))
    assert got[98].band == "script:latin"
    assert [script_of(x) for x in ("Привет мир", "123", "日本 a", "한국")] == ["cyrillic", "none", "han", "hangul"]


def test_bands_reject_junk_and_keep_prose_of_labelled_documents(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(16)
    held = [(labels[r.doc_id], r.kept) for r in fertility_rules(docs).collect() if labels.get(r.doc_id) in (0, 1) and not r.base_failed and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    junk, good = ([kept for q, kept in held if q == y] for y in (0, 1))
    assert len(junk) > 50 and len(good) > 500
    assert junk.count(False) > len(junk) / 2 and good.count(False) < len(good) / 100


def test_verdicts_like_plain_quartiles(spark):
    """The query's `kept` for all documents of a small table against sorted lists, with a band of its own for documents without language."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=public_path("piece_bpe_32k.model"))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("doc_id", "text", "CASE WHEN doc_id % 7 > 0 THEN lang END AS lang")
    plain, lists = {}, {}
    for r in docs.collect():
        text = r.text or ""
        ids = [i for w in words_of(text) for i in model.encode(w)]
        n = len(ids)
        measures = (sum(map(len, words_of(text))) / max(n, 1), sum(map(model.is_byte, ids)) / max(n, 1), -sum(c / n * math.log2(c / n) for c in Counter(ids).values()))
        band = f"lang:{r.lang}" if r.lang is not None else f"script:{script_of(text)}"
        failed = brute(text)[-1]
        plain[r.doc_id] = (band, n, measures, failed)
        if not failed:
            for k, m in enumerate(measures):
                lists.setdefault((band, k), []).append(math.floor(m * 1024))
    kept = {}
    for d, (band, n, measures, failed) in plain.items():
        kept[d] = not failed
        for k, m in enumerate(measures):
            bins = sorted(lists.get((band, k), [0]))
            low, high = (bins[-(-q * len(bins) // 4) - 1] / 1024 for q in (1, 3))
            reach = 2.5 * (1 + 2 / math.sqrt(max(n, 1))) * max(high - low, abs(high) * 0.02 + 0.002)
            kept[d] &= low - reach <= m <= high + reach
    got = {r.doc_id: (r.base_failed, r.kept) for r in fertility_rules(docs).collect()}
    assert got == {d: (plain[d][3], kept[d]) for d in plain}
    assert len({x[0] for x in plain.values()}) > 2 and {False, True} == {x[1] for x in got.values()}
