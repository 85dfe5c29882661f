"""Operator 11 against a loop over documents."""

import hashlib
import random

from tidemark.llm.lines import line_dedup


def bare(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))


def brute(rows, at_least, min_chars):
    """(doc_id, lines, dropped, kept text) of each row; a document is an id, or a text without one."""
    name = lambda i, t: (1, i, "") if i is not None else (0, 0, t or "")
    holders = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            holders.setdefault(bare(line), set()).add(name(i, t))
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        gone = [len(bare(x)) >= min_chars and len(h := holders[bare(x)]) >= at_least and (i is None or name(i, t) != max(h)) for x in lines]
        out.append((i, len(lines), sum(gone), "\n".join(x for x, g in zip(lines, gone) if not g)))
    return out


def compared(spark, rows, at_least=3, min_chars=4, extra=False):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    if extra:
        df = df.selectExpr("doc_id", "text", "'x' AS line", "1 AS key", "2 AS pos", "3 AS k1", "array(1) AS lost", "array('q') AS lines")
    got = sorted(repr(tuple(r)[:3] + (r.kept_text, r.kept_sha256)) for r in line_dedup(df, at_least, min_chars).collect())
    want = sorted(repr((*w, hashlib.sha256(w[3].encode()).hexdigest())) for w in brute(rows, at_least, min_chars))
    assert got == want


def test_like_a_loop(spark):
    rng = random.Random(3)
    pool = ["Licence A", "  licence a\t", "ÄRGER über", "ärger über", "Ärger über", "abc", "", "   ", "x\r", "line \x85 one", "日本語の行です", "LINE two"] + [f"own {k}" for k in range(60)]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 12)))) for i in range(120)]
    compared(spark, rows)
    compared(spark, rows, at_least=5, min_chars=9, extra=True)


def test_nulls_repeats_and_long_texts(spark):
    # without an id all rows are below every id; two of them with one text are one document
    text = "first line\nsecond line\n\nfirst line"
    rows = [(None, "second line"), (2, text), (2, text), (2, "second line\nother"), (5, "second LINE "), (7, None), (8, ""), (9, "\n\n"), (10, "long line\n" * 50_000), (11, "long line"), (12, "long line\n"), (13, "first line\r")]
    compared(spark, rows)
    compared(spark, [(i, "the same line\n" * 3) for i in range(400)] + [(1, "the same line\n" * 3)] * 300)


def test_empty(spark):
    assert line_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_no_line_is_kept_when_the_largest_holder_is_elsewhere(spark):
    rows = spark.createDataFrame([(i, "passage that three hold") for i in (3, 1, 2)], "doc_id long, text string")
    assert {r.doc_id: r.kept_text for r in line_dedup(rows).collect()} == {1: "", 2: "", 3: "passage that three hold"}
