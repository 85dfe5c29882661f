"""The pipeline's stages against brute force on a small table, and the whole of it."""

import random
import re

from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_jaccard import brute
from tidemark.llm.mixing import scheduled
from tidemark.llm.packing import best_fit_by_slot

ARGS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, words, n):
    return " ".join(rng.choices(words, k=n))


def documents(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choices(["the", "and", "ing", "er", "on", "at", "en"], k=rng.randint(1, 3))) for _ in range(600)]
    passage = prose(rng, words, 60)
    rows = [(i, prose(rng, words, rng.randint(5, 120)), "en", rng.choice("abc")) for i in range(60)]
    for i in range(60, 80):  # near copies of documents
        w = rows[i - 60][1].split()
        if len(w) > 60:
            w[-1] = "changed"
        rows.append((i, " ".join(w), "en", "a"))
    rows += [(i, f"{prose(rng, words, 30)}\n{passage}\n{prose(rng, words, 30)}", "en", "b") for i in range(80, 90)]
    rows += [(90, "123 ... 456", None, "a"), (91, None, "en", None), (92, "", "en", "a"), (93, rows[2][1], None, None), (2, rows[2][1], "en", rows[2][3]), (None, rows[4][1], "en", "a"), (94, passage, "en", "c")]
    return [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows], passage


def test_stages_against_brute_force(spark):
    rows, passage = documents(1)
    docs = spark.createDataFrame(rows, ARGS).repartition(3)
    steps = dict(corpus_pipeline.STAGES)
    one = steps["language_id"](spark, docs, "").collect()
    want = [r for r in rows if r[1] and re.search("[a-z]", r[1])]
    assert sorted(map(repr, map(tuple, one))) == sorted(map(repr, want))

    two = steps["ngram_jaccard_join"](spark, spark.createDataFrame(one, ARGS), "").collect()
    keys = [(r[0], r[1]) for r in want]
    group = {}
    for (d, _, component, _), _ in zip(brute(keys, 5, 80, 100), keys):
        group.setdefault(component, set()).add(d)
    assert sorted(r.doc_id for r in two) == sorted(group)
    assert len(two) < len(one) - 15

    three = steps["substring_dedup"](spark, spark.createDataFrame(two, ARGS), "").collect()
    assert all(passage[:200] not in r.text for r in three)
    texts = {r.doc_id: r.text for r in two}
    seen = {}
    for d, t in texts.items():
        w = t.split()
        for i in range(len(w) - 34):
            seen.setdefault(tuple(w[i : i + 35]), []).append((d, i))
    for r in three:
        w = texts[r.doc_id].split()
        gone = {x for i in range(len(w) - 34) if len(seen[tuple(w[i : i + 35])]) > 1 for x in range(i, i + 35)}
        assert r.text.split() == [x for i, x in enumerate(w) if i not in gone]
    assert {r.doc_id for r in two} - {r.doc_id for r in three} == {94}

    four = steps["source_mixing"](spark, spark.createDataFrame(three, ARGS), "").collect()
    assert sorted(map(repr, map(tuple, four))) == sorted(map(repr, map(tuple, three)))
    five = steps["best_fit_packing"](spark, spark.createDataFrame(four, ARGS), "").collect()
    assert {r.doc_id for r in five} == {r.doc_id for r in four}


def test_unlinked_rows_without_an_id_of_their_own_stay(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(500)]
    one, two, three, four = (prose(rng, words, 40) for _ in range(4))
    rows = [(None, one), (None, two), (5, three), (5, four), (None, one), (6, four), (7, None), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t or "")) for i, t in rows], ARGS).repartition(3)
    got = dict(corpus_pipeline.STAGES)["ngram_jaccard_join"](spark, docs, "").collect()
    assert sorted((r.doc_id, r.text) for r in got if r.doc_id == 5) == sorted([(5, three), (5, four)])
    assert sorted(repr((r.doc_id, r.text)) for r in got) == sorted(map(repr, [(None, one), (None, two), (5, three), (5, four), (7, None), (None, None)]))


def test_sequences_follow_the_mixture(spark):
    rng = random.Random(5)
    words = ["the", "river", "and", "a", "lake", "of", "hill", "is"]
    rows = [(i, prose(rng, words, rng.randint(50, 900)), "en", "aaab"[i % 4], None) for i in range(1600)]
    rows += [(None, "no id", "en", "a", None), (None, "no id", "en", "a", None), (3, "again", "en", None, None), (1700, prose(rng, words, 9000), "en", "b", None)]
    docs = spark.createDataFrame(rows, ARGS).repartition(3)
    slot = {}
    for r in scheduled(docs).collect():
        slot.setdefault((r.doc_id, r.text), r._slot)
    pieces, text_of = corpus_pipeline.pack(spark, docs, "").collect(), {d: t for d, t, *_ in rows if d is not None and d != 3}
    total = sum(r.length for r in pieces)
    assert sorted(repr(r.doc_id) for r in pieces if r.piece == 0) == sorted(repr(r[0]) for r in rows)
    sequences = {}
    for r in pieces:
        sequences.setdefault(r.sequence_id, []).append(r)
    assert sorted(sequences) == list(range(len(sequences)))
    for own in sequences.values():
        ends = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == ends
            ends += r.length
        assert ends <= 4096
    assert len(sequences) <= 1.1 * total / 4096 + 2
    # the earliest slot of a sequence never falls with its number
    least = [min((slot[r.doc_id, text_of[r.doc_id]] for r in sequences[s] if r.doc_id in text_of), default=None) for s in range(len(sequences))]
    least = [x for x in least if x is not None]
    assert least == sorted(least) and len(set(least)) > 3
    narrow = best_fit_by_slot(scheduled(docs), fill=10).collect()  # several ranges
    mean = {}
    for r in narrow:
        if r.doc_id in text_of:
            mean.setdefault(r.sequence_id // 20, []).append(slot[r.doc_id, text_of[r.doc_id]])
    means = [sum(v) / len(v) for _, v in sorted(mean.items())]
    assert len(narrow) == len(pieces) and len(means) > 4 and means == sorted(means)


def test_run_and_empty(spark):
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert got.columns[:3] == ["doc_id", "piece", "start"] and got.count() > 100
    docs = spark.createDataFrame([], ARGS)
    for _, apply in corpus_pipeline.STAGES:
        docs = apply(spark, docs, "")
        assert docs.count() == 0


def test_columns_of_any_name_pass_through(spark):
    """Names that the stages use themselves, or that need quotes, keep the user's values."""
    rows, _ = documents(2)
    names = ["score", "_text", "blank", "_spans", "_s", "_slot", "_source", "_start", "_k1", "_nth", "others", "k1", "r1", "lang_pred", "a.b", "x y", "_order", "_size", "n", "root"]
    docs = spark.createDataFrame(rows, ARGS).repartition(2)
    for k, c in enumerate(names):
        docs = docs.withColumn(c, F.concat_ws("-", F.lit(k), F.col("doc_id")))
    docs = docs.withColumn("m", F.create_map(F.lit("a"), F.col("doc_id"))).withColumn("_a", F.array(F.struct("doc_id")))
    for name, apply in corpus_pipeline.STAGES[:-1]:
        out = apply(spark, docs, "")
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        got = out.collect()
        assert got
        for r in got:
            for k, c in enumerate(names):
                assert r[c] == (f"{k}-{r.doc_id}" if r.doc_id is not None else f"{k}"), (name, c)
            assert r["m"] == {"a": r.doc_id} and r["_a"][0].doc_id == r.doc_id
    assert corpus_pipeline.pack(spark, docs, "").count() > 0
