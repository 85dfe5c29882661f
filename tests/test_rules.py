"""The open registry of rules: a rule of three lines, what it may not do, and what the check stages for it."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidemark import rules
from tidemark.corpus import Corpus
from tidemark.functions import messages


def corpus(spark):
    rows = [("r", "README.md", "doc", "# T\n\nshort\n\n" + "long " * 50 + "\n"), ("r", "src/x.py", "code", "x = 1\nimport gone\n")]
    return Corpus(spark.createDataFrame(rows, "repo string, path string, kind string, text string"))


@pytest.fixture
def long_lines():
    @rules.rule("long-lines", "lines", says={"long-line": ("the line is long: {}", "dòng dài: {}")})
    def find(corpus, lines):
        return lines.filter("length(text) > 200").selectExpr("repo", "path", "line", "left(text, 9) AS text", "'long-line' AS rule", "'warning' AS severity")

    yield find
    rules.forget("long-lines", "long-line")


def test_a_rule_of_the_user(spark, long_lines):
    got = corpus(spark).check(groups=["long-lines"]).collect()
    assert [(r.path, r.line, r.col, r.rule, r.severity, r.claim, r.message) for r in got] == [("README.md", 5, 1, "long-line", "warning", "long long", "the line is long: long long")]
    assert [r.message for r in corpus(spark).check(groups=["long-lines", "long-lines"], lang="vi").collect()] == ["dòng dài: long long"]
    assert corpus(spark).check(groups=["long-lines"], names=["other"]).count() == 0
    everything = corpus(spark)
    assert "long-lines" in [r.name for r in rules.chosen(everything)] and not {"stale", "copies"} & {r.name for r in rules.chosen(everything)}


def test_a_rule_about_code_has_its_own_line(spark):
    try:
        rules.rule("imports")(lambda c: c.files.filter("path LIKE '%.py'").selectExpr("repo", "path", "2L AS line", "'gone' AS text", "'import-gone' AS rule", "'error' AS severity", "7 AS col", "'import gone' AS own"))
        got = corpus(spark).check(groups=["imports"]).collect()
        assert [(r.path, r.line, r.col, r.rule, r.severity, r.message) for r in got] == [("src/x.py", 2, 7, "import-gone", "error", "import-gone: gone")]
    finally:
        rules.forget("imports")


def test_what_a_rule_may_not_do(spark, long_lines):
    with pytest.raises(ValueError, match="already registered: long-lines"):
        rules.rule("long-lines")(lambda c: c.files)
    with pytest.raises(ValueError, match="already registered: link-broken"):
        rules.rule("new", says={"link-broken": ("x", "x")})(lambda c: c.files)
    with pytest.raises(ValueError, match="no shared table tokens"):
        rules.rule("new", "tokens")
    with pytest.raises(ValueError, match="no rule nothing; there are paths"):
        corpus(spark).check(groups=["nothing"])
    bare = rules.Rule("bare", lambda c: c.files, (), bool)
    with pytest.raises(ValueError, match="rule bare returns no line, rule, severity"):
        rules.findings(bare, corpus(spark), {})
    empty = rules.Rule("nulls", lambda c: c.files.select("repo", "path", F.lit(None).cast("int").alias("line"), "text", F.lit("r").alias("rule"), F.lit("info").alias("severity")), (), bool)
    with pytest.raises(PySparkException, match="rule nulls: line is null"):
        rules.findings(empty, corpus(spark), {}).collect()
    assert "new" not in [r.name for r in rules.chosen(corpus(spark))] and messages.MESSAGES["link-broken"][0] != "x"


def test_only_needed_tables_are_staged(spark, monkeypatch):
    monkeypatch.setattr(Corpus, "claims", lambda *a: pytest.fail("claims are not needed"))
    assert corpus(spark).check(groups=["tables"]).count() == 0
