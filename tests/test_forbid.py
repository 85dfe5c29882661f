"""Forbid directives, and closures of imports."""

import pytest

from tidemark.corpus import Corpus
from tidemark.operators import forbid, resolve


@pytest.mark.parametrize(
    "body,want",
    [
        (r"forbid /os\.kill\(\w+, 0\)/ in **/*.py", (r"os\.kill\(\w+, 0\)", "", ["**/*.py"], "")), ("forbid /a/b/im", ("a/b", "im", [], "")), ('FORBID "a.b" in x.py, y/', (r"a\.b", "", ["x.py", "y/"], "")), ("forbid 'it' IN *.js *.ts", ("it", "", ["*.js", "*.ts"], "")),
        ("forbid /x/ on *.py", None), ("forbid src/*.py /x/", None), ("forbid /x", None), ("forbid //", None), ("forbid", None), ("forbid /x/q", None), ("forbid /x/ in", None),
    ],
)
def test_parse(body, want):
    got = forbid.parse(body)
    assert got == want if want else got[3].startswith("expected")
    assert forbid.parse("forbid /([/ in *.py")[3] and not forbid.parse("forbid /([/ in *.py")[3].startswith("expected")


def test_violations_in_a_corpus(spark):
    code = "import os\n\ndef alive(pid):\n    os.kill(pid, 0)\n"
    rows = [("r", "AGENTS.md", "doc", "# Rules\n\nNever `call` os.kill.\n<!-- tidemark: forbid /os\\.kill\\(\\w+, 0\\)/ in **/*.py -->\n<!-- tidemark: forbid /([/ in *.py -->\n<!-- tidemark: forbid \"DEBUG = 1\" -->\n"), ("r", "src/proc.py", "code", code), ("r", "src/proc.js", "code", code)]
    rows += [("r", "many.py", "code", "".join(f"debug = 1; x{k}\nDEBUG = 1 # {k}\n" for k in range(70))), ("r", "a.toml", "conf", "DEBUG = 1"), ("s", "src/proc.py", "code", code), ("s", "x.md", "doc", "none")]
    schema = "repo string, path string, kind string, text string"
    found = Corpus(spark.createDataFrame(rows, schema)).check(groups=["forbidden"]).collect()
    assert {(r.repo, r.path, r.line, r.claim) for r in found if r.rule == "rule-violation" and r.path != "many.py"} == {("r", "src/proc.py", 4, "os.kill(pid, 0)")}
    assert [r.line for r in sorted(found, key=lambda r: r.line) if r.path == "many.py"] == list(range(2, 141, 2))  # all of them
    assert [(r.path, r.line, r.severity) for r in found if r.rule == "rule-invalid"] == [("AGENTS.md", 5, "error")]
    # the fingerprint of a violation is that of its own line, whatever the page says at that line
    rows[0] = ("r", "AGENTS.md", "doc", rows[0][3].replace("Never `call` os.kill.\n", "Never `call` os.kill.\n`other`\n"))
    again = Corpus(spark.createDataFrame(rows, schema)).check(groups=["forbidden"]).collect()
    prints = lambda rows: {r.fingerprint for r in rows if r.rule == "rule-violation"}
    assert prints(found) == prints(again)


def test_import_closure(spark):
    chain = [(f"p{i:02d}", f"p{i + 1:02d}") for i in range(60)] + [("a", "b"), ("b", "c"), ("c", "a"), ("a", "a")]
    got = {tuple(r) for r in resolve.import_closure(spark.createDataFrame(chain, "page string, part string")).collect()}
    want = {(f"p{i:02d}", f"p{j:02d}") for i in range(61) for j in range(i + 1, 61)} | {(x, y) for x in "abc" for y in "abc" if x != y}
    assert got == want
    assert resolve.import_closure(spark.createDataFrame([], "page string, part string")).collect() == []
