"""Decision logs of tables and folders, and mentions of decisions."""

import pytest
from pyspark.sql import functions as F

from tidemark.corpus import Corpus
from tidemark.operators import decisions

LOG = """# Decisions

| ID | What | Status |
|---|---|---|
| D-1 | one | superseded by D-3 |
| D-2 | two | active |
| **D-3** | supersedes D-1, D-02 | accepted |
| D-4 | four | agreed with all of them; superseded by D-5 |
| D-5 | five | partially superseded (D-6) |

A paragraph cuts the table.

| D-6 | six | đã bỏ |
| D-7 | seven, **bị thay: D-6** and so on |
| D-8 | thay cho D-5 và D-7 | |
| D-1 | again | active |
"""
ADR = ["# One\n\nStatus: Superseded by ADR-2\n", "# Two\n\n## Status\n\nAccepted\n\n## Context\nobsolete things\n", "# Three\n\n* Status: deprecated\n", "no status at all\n"]


def lines_of(spark, pages):
    df = spark.createDataFrame([(p, p, t) for p, t in pages], "doc string, path string, text string")
    return df.select("doc", "path", F.posexplode(F.split("text", "\n")).alias("p", "text")).select("doc", "path", (F.col("p") + 1).alias("line"), "text")


def test_logs(spark):
    pages = [("docs/DECISIONS.md", LOG), ("docs/other.md", LOG), ("x/decision-log.md", "| D-1 | a |\n")] + [(f"docs/adr/000{k}-x.md", t) for k, t in enumerate(ADR, 1)]
    got = {(r.log, r.id): (r.line, r.status, list(r.by)) for r in decisions.decisions(lines_of(spark, pages)).collect()}
    log = "docs/DECISIONS.md"
    assert got == {
        (log, "D1"): (5, "superseded", ["D3"]), (log, "D2"): (6, "amended", ["D3"]), (log, "D3"): (7, "active", []), (log, "D4"): (8, "amended", ["D5"]), (log, "D5"): (9, "amended", ["D6", "D8"]),
        (log, "D6"): (13, "superseded", []), (log, "D7"): (14, "amended", ["D6", "D8"]), (log, "D8"): (15, "active", []),
        ("docs/adr", "ADR1"): (1, "superseded", ["ADR2"]), ("docs/adr", "ADR2"): (1, "active", []), ("docs/adr", "ADR3"): (1, "superseded", []), ("docs/adr", "ADR4"): (1, "active", []),
    }


@pytest.mark.parametrize("text,want", [("superseded", "superseded"), ("**Superseded** by D-2", "superseded"), ("", "active"), ("accepted", "active"), ("superseded in part by D-2", "amended"), ("superseded by D-2, partly", "active"), ("bị thay (D-2)", "superseded"), ("bị thay một phần", "amended"), ("x" * 13 + " obsolete", "amended"), ("supersededness", "active"), ("amended by D-9", "amended")])
def test_status(spark, text, want):
    assert spark.range(1).select(decisions.told_status(F.lit(text))).first()[0] == want


def test_standing(spark):
    chain = [("l", f"D{i}", "superseded", [f"D{i + 1}"]) for i in range(1, 12)] + [("l", "D12", "active", []), ("l", "A1", "superseded", ["A2"]), ("l", "A2", "superseded", ["A1"]), ("m", "D1", "superseded", ["D9"]), ("l", "B1", "superseded", []), ("l", "B2", "superseded", ["B2"])]
    got = {(r.log, r.id): r.now for r in decisions.standing(spark.createDataFrame(chain, "log string, id string, status string, by array<string>")).collect()}
    assert got == {("l", f"D{i}"): "D12" for i in range(1, 12)} | {("m", "D1"): "D9"}


def test_mentions_in_a_corpus(spark):
    rows = [("r", "docs/DECISIONS.md", "doc", LOG), ("r", "tool/DECISIONS.md", "doc", "| D-1 | own |\n| D-2 | **superseded by D-1** |\n"), ("r", "use.md", "doc", "As D-1, D-2, D-3 and D-99 say; X-1 is no id.\n"), ("r", "tool/use.md", "doc", "D-1 holds, D-2 not, D-4 is of the other log, D-98 of none\n")]
    rows += [("s", "use.md", "doc", "D-1 is nothing here\n")] + [("s", f"docs/adr/000{k}-x.md", "doc", t) for k, t in enumerate(ADR, 1)] + [("s", "a.md", "doc", "see ADR-1, ADR 2, ADR-0009\n")]
    found = Corpus(spark.createDataFrame(rows, "repo string, path string, kind string, text string")).check(groups=["decisions"]).collect()
    assert {(r.repo, r.path, r.rule.removeprefix("decision-"), r.claim) for r in found if r.path.endswith(("use.md", "a.md"))} == {
        ("r", "use.md", "superseded", "D-1"), ("r", "use.md", "amended", "D-2"), ("r", "use.md", "unknown", "D-99"), ("r", "tool/use.md", "amended", "D-2"), ("r", "tool/use.md", "amended", "D-4"), ("r", "tool/use.md", "unknown", "D-98"),
        ("s", "a.md", "superseded", "ADR-1"), ("s", "a.md", "unknown", "ADR-0009"),
    }
