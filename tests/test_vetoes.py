"""Each reason not to call a path missing, alone; sentences over lines; projects that a page has its reader clone; and all of it in a corpus."""

import pytest
from pyspark.sql import functions as F

from tidemark.corpus import Corpus
from tidemark.functions import text
from tidemark.operators import findings, shell, vetoes

WORDS = [
    ("src/new.py", "See `", "` for more.", "live", None), ("src/new.py", "See `", "`.", "plan", "not-live"), ("new.py", "See `", "`.", "live", "bare-name"), ("/etc/new.py", "See `", "`.", "live", "outside"),
    ("C:/x/new.py", "See `", "`.", "live", "address"), ("src/<name>.py", "See `", "`.", "live", "placeholder"), ("app/[id]/page.tsx", "See `", "`.", "live", "placeholder"), ("src/.env", "See `", "`.", "live", "private"),
    ("my-app/new.py", "See `", "`.", "live", "readers-own"), ("src/build/new.py", "See `", "`.", "live", "built"), ("src/new.py", "It was renamed: `", "`", "live", "gone"), ("src/new.py", "`", "` đã bỏ", "live", "gone"),
    ("src/new.py", "In v1.2 – v1.6 it was `", "`", "live", "past"), ("src/new.py", "Hồi đó dùng `", "`", "live", "past"), ("src/new.py", "For example `", "`", "live", "example"), ("src/new.py", "You can also configure `", "`", "live", "reader-may"),
    ("src/new.py", "There is no such file as `", "`", "live", "denied"), ("src/new.py", "`", "` doesn't exist here", "live", "denied"), ("src/new.py", "Dự án không có `", "`", "live", "denied"), ("src/new.py", "denyWrite: `", "`", "live", "access-list"),
    ("src/new.py", "If the project uses it, `", "` counts", "live", "other-trees"), ("src/new.py", "Create `", "` first", "live", "made-later"), ("src/new.py", "Tạo `", "`", "live", "made-later"),
    ("src/new.py", "Create it. Then read `", "`", "live", None), ("src/new.py", "add " + "x " * 40 + "`", "`", "live", None), ("src/new.py", "The compiled page " + "x " * 30 + "copies all to `", "`", "live", "build-output"),
]


def test_words(spark):
    rows = spark.createDataFrame([(i, *w) for i, w in enumerate(WORDS)], "id int, target string, before string, after string, kind string, want string")
    got = vetoes.with_veto(rows, vetoes.word_vetoes(F.col("target"), F.col("before"), F.col("after"), F.col("kind"))).orderBy("id").collect()
    assert [(r.target, r.before, r.veto) for r in got] == [(r.target, r.before, r.want) for r in got]
    assert {r.status for r in got if r.veto is None} == {"missing"} and {r.status for r in got if r.veto == "built"} == {"unverified"}
    empty = vetoes.with_veto(rows.limit(0), vetoes.word_vetoes(F.col("target"), F.col("before"), F.col("after"), F.col("kind")))
    assert empty.count() == 0


def test_sentences_of_claims(spark):
    page = ["# Head", "One. Two goes", "  on to `a/b` and", "ends; next", "", "| x `a/b` | y |", "`a/b`"]
    lines = spark.createDataFrame([("d", i, t) for i, t in enumerate(page, 1)], "doc string, line int, text string")
    claims = spark.createDataFrame([("d", 3, 9, "a/b"), ("d", 6, 5, "a/b"), ("d", 7, 1, "a/b"), ("d", 3, 1, "nowhere"), ("d", 99, 1, "a/b"), ("e", 1, 1, None)], "doc string, line int, col int, text string")
    got = {(r.doc, r.line, r.text): (r.before, r.after) for r in vetoes.claim_sentences(claims, lines).collect()}
    assert got == {
        ("d", 3, "a/b"): ("Two goes on to `", "` and ends;"), ("d", 6, "a/b"): ("| x `", "`"), ("d", 7, "a/b"): ("`", "`"), ("d", 3, "nowhere"): ("Two goes on to `a/b` and", " ends;"), ("d", 99, "a/b"): (None, None), ("e", 1, None): (None, None),
    }


@pytest.mark.parametrize("line,past,done", [
    ("v1.2–v1.6 had it", True, False), ("from 1.2 - 1.6.", True, False), ("1.2 and 1.6", False, False), ("2-3 items", False, False), ("measured on 3 May", True, False), ("measured 2024-05-03", True, False), ("measured well", False, False),
    ("đo ngày 3/5", True, False), ("tính đến 12/10", True, False), ("từng lọt qua", True, False), ("từng câu một", False, False), ("Previously here", True, False), ("", False, False), ("- [x] ready", False, True), ("* [X] ready", False, True),
    ("- [ ] open", False, False), ("all DONE here", False, True), ("abandONED", False, False), ("✅ ok", False, True), ("-[x]", False, False),
])
def test_past_and_done(spark, line, past, done):
    assert tuple(spark.range(1).select(text.is_past(F.lit(line)), text.is_done(F.lit(line))).first()) == (past, done)


def test_secrets():
    cases = {
        "api_key = abcdef1": "api_key = ***", 'token: "abcdefg" x': 'token: "***" x', "key=abc": "key=abc", "mytokens=abcdef password:=qwerty9": "mytokens=*** password:***", "'auth' : 'abcdefgh'": "'auth' : '***'",
        "plain = abcdefgh": "plain = abcdefgh", "": "", "key: token_abc = foobar1": "key: *** = foobar1", "a key = ": "a key = ", "KEY==abcdef": "KEY=***",
    }
    assert {k: text.without_secrets(k) for k in cases} == cases


def test_other_projects(spark):
    assert shell.entered_clones(["git clone --depth 1 -b main https://h/o/tool.git", "cd tool", "cd other", "git clone git@h:o/x.git ./y && cd y"]) == ["tool", "y"]
    docs = spark.createDataFrame([(f"r/{p}", "r", p) for p in ("a/SKILL.md", "a/x/one.md", "a/x/SKILL.md", "a/two.md", "b.md", "c.md")], "doc string, repo string, path string")
    entered = spark.createDataFrame([("r/a/SKILL.md", "tool"), ("r/b.md", "R"), ("r/c.md", "elsewhere/")], "doc string, folder string")
    own = spark.createDataFrame([("r", "r")], "repo string, name string")
    # the inner skill is a unit of its own; a clone of the tree itself is no other project
    assert {r.doc for r in vetoes.other_projects(docs, entered, own).collect()} == {"r/a/SKILL.md", "r/a/two.md", "r/c.md"}
    assert vetoes.other_projects(docs, entered.limit(0), own).count() == 0


PAGES = {
    "README.md": "# App\n\nRead `src/gone_never.py` now.\nCreate `src/later.py` first.\nIt reads `src/made.json` and `src/cache/data.bin` too.\nAlso `nowhere/at_all.py` here.\nSee https://h/o/t/blob/main/src/theirs.py first.\n\nThere, `src/theirs.py` holds.\n",
    "old.md": "# Old\n\nThis has been removed in 3.\n\n## More\n\nRead `src/old_thing.py` now.\n",
    "skill/SKILL.md": "# S\n\n```sh\ngit clone https://h/o/tool\ncd tool\npython src/go.py\n```\n",
    "skill/more.md": "# M\n\nRead `src/of_tool.py` now.\n",
    "AGENTS.md": "# A\n\nRead `src/agents_never.py` now.\n",
}


def test_corpus(spark):
    rows = [("r", p, "doc", t) for p, t in PAGES.items()] + [("r", "src/main.py", "code", "open('made.json')\n"), ("r", ".gitignore", "ignore", "cache/\n")]
    corpus = Corpus(spark.createDataFrame(rows, "repo string, path string, kind string, text string"))
    got = {r.claim: (r.status, r.veto) for r in corpus.unproved().collect()}
    assert got == {
        "src/gone_never.py": ("missing", None), "src/later.py": ("skipped", "made-later"), "src/made.json": ("unverified", "in-code"), "src/cache/data.bin": ("unverified", "ignored"), "nowhere/at_all.py": ("unverified", "no-folder"),
        "src/theirs.py": ("unverified", "elsewhere"), "src/old_thing.py": ("skipped", "retired-page"), "src/of_tool.py": ("unverified", "other-project"), "src/agents_never.py": ("missing", None),
    }
    found = corpus.check(groups=["paths", "commands"]).collect()
    assert {(r.rule, r.severity, r.claim) for r in found} == {("path-missing", "info", "src/gone_never.py"), ("path-missing", "warning", "src/agents_never.py")}


def test_done_lines_still_downgrade(spark):
    f = spark.createDataFrame([("path-gone", "error", "live", t) for t in ("previously x", "- [x] y", "z")], "rule string, severity string, kind string, text string")
    assert [r.severity for r in findings.downgraded(f).collect()] == ["info", "info", "error"]
