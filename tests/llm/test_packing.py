"""Operator 6 against the tokenizer itself and the rules of a packing."""

import itertools
import math
import zlib

import numpy as np
import pytest

from tidemark.llm.packing import Complements, best_fit, best_fit_packing, plan_sequences, slots
from tidemark.llm.tokens import public_path, word_bpe

ODD = ["Don't STOP!!", "naïve café — Ünïcode", "Σίσυφος ΟΔΟΣ", "한국어 日本語", "a b\x85c\x1cd", "éclair ﬁ İstanbul", "<|endoftext|> x<|startoftext|>", "hello <|endoftext|> world", "a<|endoftext|>b <|EndOfText|> <| endoftext |>", "x&&& 123 4a5 $$$ we'll", "\x00 \x7f", "ÿþ"]


def test_word_ids_equal_the_tokenizer(spark):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_path("word_bpe_49k.json"))
    texts = ODD + [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    words = word_bpe(public_path("word_bpe_49k.json"))
    for t in texts:
        assert np.frombuffer(words.text(t.encode()), "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids, t[:60]


@pytest.mark.parametrize("seed", range(4))
def test_plan_uses_each_piece_once_and_few_sequences(seed):
    rng = np.random.default_rng(seed)
    capacity = 128
    lengths = np.minimum(rng.lognormal(3, 1, 20_000).astype(int) + 1, capacity)
    counts = np.bincount(lengths, minlength=capacity + 1)
    plan = plan_sequences(counts, capacity)
    used = np.zeros(capacity + 1, int)
    for pieces, times in plan:
        assert sum(pieces) <= capacity and times > 0
        for x in pieces:
            used[x] += times
    assert used.tolist() == counts.tolist()
    assert sum(t for _, t in plan) <= 1.001 * lengths.sum() / capacity + 1


def brute_complement(counts, gap, held):
    """Whether one, two or three available lengths sum to `gap`."""
    free = counts.copy()
    for x in held:
        free[x] -= 1
    have = [x for x in range(1, len(free)) for _ in range(min(free[x], 3))]
    sums = {0: {0}}
    for n in (1, 2, 3):
        sums[n] = {sum(c) for c in itertools.combinations(have, n)}
    return [gap in sums[n] for n in (1, 2, 3)]


@pytest.mark.parametrize("seed", range(3))
def test_complements_are_found_whenever_there_are_any(seed):
    rng = np.random.default_rng(seed)
    counts = np.zeros(31, np.int64)
    for x in rng.integers(1, 31, 12):
        counts[x] += rng.integers(1, 3)
    left = Complements(counts)
    for _ in range(60):
        gap, held = int(rng.integers(1, 31)), ()
        there = np.flatnonzero(left.counts)
        if len(there) and rng.random() < 0.7:
            held = (int(rng.choice(there)),)
        got = [left.single(gap, held), left.pair(gap, held), left.triple(gap, held)]
        assert [x is not None for x in got] == brute_complement(left.counts, gap, held)
        for x in got:
            if x:
                assert sum(x) == gap and left.most((*held, *x)) >= 1
        taken = next((x for x in got if x), None)
        if taken and rng.random() < 0.5:
            left.take(taken, 1)


def test_best_fit_alone_and_slots():
    counts = np.bincount([3, 3, 3, 5, 7, 7], minlength=11)
    plan = best_fit(counts, 10)
    assert sum(t for _, t in plan) == 3
    table = slots(plan)
    assert table["times"].sum() == 6 and (np.diff(table["length"]) >= 0).all()


def test_packing_query(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(99, None), (98, ""), (None, "word " * 50), (5, ODD[5]), (5, ODD[5]), (77, "alpha beta gamma " * 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = best_fit_packing(df, capacity=16, ids=True).collect()
    words = word_bpe(public_path("word_bpe_49k.json"))
    want = sorted(tuple(np.frombuffer(words.text((t or "").encode()), "<u4").tolist() + [1]) for _, t in rows)
    by_doc, by_sequence = {}, {}
    for r in got:
        assert r.length == len(r.ids) <= 16 and r.start == 16 * r.piece and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by_sequence.values():
        places.sort()
        assert [o for o, _ in places] == np.cumsum([0, *(n for _, n in places)])[:-1].tolist() and sum(n for _, n in places) <= 16
    assert sum(map(len, want)) == sum(r.length for r in got)
    assert tuple(x for r in sorted(by_doc[77], key=lambda r: r.piece) for x in r.ids) in want
    assert len(by_sequence) <= math.ceil(sum(map(len, want)) / 16) + 2
    assert best_fit_packing(df.limit(0)).count() == 0
