"""Reading and rendering pages, shell lines, sources, the corpus: against literal expectations."""

import difflib
import json
import os
import subprocess

import pytest
from pyspark.sql import functions as F

from tidemark.corpus import Corpus
from tidemark.functions import paths
from tidemark.operators import documents, findings, markdown, render, resolve, shell
from tidemark.sources import git, manifests

PAGE = """---
title: x
---
# A `code` title {#own}
Text with `one` and ``two ` ticks`` and \\`not`.

## Part
## Part
Setext
------
| a | b |
|---|---|
| 1 | 2 |
no bar | row
| 1 | 2 | 3 |

| stray | row |
| more | rows |

```sh
$ cd app
$ python run.py --fast
output line
```
[link](a.md#x "t") ![img](b.png) `[no](c.md)`
[ref]: d.md
<!-- tidemark: ignore-start -->
hidden
<!-- tidemark: ignore-end -->
last <!-- tidemark: ignore -->
<!-- tidemark: plan --> <a id="here"></a>
"""


def test_reader():
    page = markdown.Reader(PAGE).read()
    assert [(h["line"], h["level"], h["title"], h["anchor"]) for h in page.headings] == [(4, 1, "A code title", "own"), (7, 2, "Part", "part"), (8, 2, "Part", "part-1"), (9, 2, "Setext", "setext")]
    assert [s["text"] for s in page.spans] == ["code", "one", "two ` ticks", "[no](c.md)"]
    assert [(t["start"], t["width"], [(r["line"], r["cells"]) for r in t["rows"]]) for t in page.tables] == [(11, 2, [(13, 2), (14, 2), (15, 3)])]
    assert page.stray == [17, 18] and page.mark == "plan" and {"here", "own", "part-1"} <= page.anchors
    assert [x["text"] for x in page.fences[0]["lines"]] == ["cd app", "python run.py --fast"]
    assert [(x["dest"], x["image"]) for x in page.links] == [("a.md#x", False), ("b.png", True)]
    assert {27, 28} & page.ignored and 30 in page.ignored


@pytest.mark.parametrize("raw,want", [("**Bold** and _it_", "Bold and it"), ("[t](u) <b>x</b>", "t x"), ("a `*b*` c", "a *b* c"), ("A &amp; B", "A & B"), (r"\*x\*", "*x*"), ("snake_case_name", "snake_case_name")])
def test_heading_text(raw, want):
    assert markdown.heading_text(raw) == want


@pytest.mark.parametrize(
    "line,want",
    [
        ("[a](b) ![c](d 'e') [f [g] h](<i j> \"k\")", [("a", "b", False), ("c", "d", True), ("f [g] h", "i j", False)]),
        ("[![x](y.png)](z(1).md) [n]() [m](a b)", [("![x](y.png)", "z(1).md", False), ("x", "y.png", True)]),
        (r"\[a](b) [c\]](d", [("a", "b", False)]),
    ],
)
def test_inline_links(line, want):
    assert [(label, dest, image) for _, image, label, dest in markdown.inline_links(line)] == want


def test_kinds_of_lines():
    assert markdown.atx_heading("## a # ##") == (2, "a #") and markdown.atx_heading("####### a") is None and markdown.atx_heading("#a") is None and markdown.atx_heading("# C#") == (1, "C#")
    assert markdown.fence_open("~~~ py x") == ("~~~", "py") and markdown.fence_open("``` a`b") is None and markdown.fence_open("    ```") is None
    assert [markdown.underline(x) for x in ("===", " -", "-=", "", "    =")] == [1, 2, 0, 0, 0]
    assert markdown.is_delimiter("|:-|--:|") and not markdown.is_delimiter("| a |") and markdown.row_cells(r"| a \| b | c |") == [r" a \| b ", " c "]
    assert [markdown.begins_block(x) for x in ("> q", "- i", "12) i", "<div>", "    code", "text", "1234567890. x", "-x")] == [True] * 5 + [False] * 3
    assert [markdown.after_prompt(x) for x in ("$ ls", "PS C:\\x> dir", ">>> f()", "PSX> a", "$x", "%")] == ["ls", "dir", "f()", None, None, ""]
    assert markdown.definition("[a]: <b>") == ("a", "b") and markdown.definition("[^1]: b") is None
    assert markdown.tag_names('<a name="x"><b id=y>') == ["x", "y"] and markdown.attribute_ids("{: .c #d} {#e} {f}") == ["d", "e"]


def test_anchors():
    assert markdown.page_slug("Build & *Target* 2.0") == "build--target-20"
    assert markdown.skeleton("Éàbuild.target") == "eabuildtarget"


@pytest.mark.parametrize("line,want", [("a 'b c' d", ["a", "b c", "d"]), ('x="1 2"y', ["x=1 2y"]), ("''", [""]), ("  ", []), ("a\"b'c\"d", ["ab'cd"])])
def test_argv(line, want):
    assert shell.argv(line) == want


def test_commands():
    assert shell.simple_commands("a && b 'x;y' | c; d") == ["a", "b 'x;y'", "c", "d"]
    got = shell.commands(["cd app", "FOO=1 sudo python -m pkg.mod --dry \\", "  --v=2", "npm run build", "make -j 2 CC=x all", "./run.sh # note", "pytest tests/a.py::t"])
    assert [(c["kind"], c["target"], c["folder"]) for c in got] == [("module", "pkg.mod", "app"), ("npm", "build", "app"), ("make", "2", "app"), ("path", "run.sh", "app"), ("path", "tests/a.py", "app")]
    assert got[0]["flags"] == ["--dry", "--v"]


@pytest.mark.parametrize(
    "text,want",
    [
        ("a **b** *c* ~~d~~ `<e>`", "<p>a <strong>b</strong> <em>c</em> <del>d</del> <code>&lt;e&gt;</code></p>"),
        ("[x](javascript:y) [z](https://q?a&b)", '<p>x <a href="https://q?a&amp;b">z</a></p>'),
        ("- a\n  - b\n- [x] c", '<ul><li>a<ul><li>b</li></ul></li><li><input type="checkbox" disabled checked> c</li></ul>'),
        ("> [!NOTE]\n> hi", '<aside class="callout note"><p class="title">Note</p>\n<p>hi</p></aside>'),
        ("|a|b|\n|:-|-:|\n|1|2|", "<table><thead><tr><th style=text-align:left>a</th><th style=text-align:right>b</th></tr></thead><tbody><tr><td style=text-align:left>1</td><td style=text-align:right>2</td></tr></tbody></table>"),
        ("```py\na<b\n```", '<figure class="code"><figcaption>py</figcaption><pre><code>a&lt;b</code></pre></figure>'),
        ("# T\n## T", '<h1 id="t">T</h1>\n<h2 id="t-1">T</h2>'),
        ("---", "<hr>"),
        ('![a" onerror="alert(1)](x.png "t\'<")', '<figure><img src="x.png" alt="a&quot; onerror=&quot;alert(1)" title="t&#x27;&lt;"></figure>'),
        ('[x](u" onclick="y)', '<p><a href="u&quot; onclick=&quot;y">x</a></p>'),
        ("**a *b* c** 2*3*4 [**l** `k`](u(1)) ![no t](a b)", "<p>**a <em>b</em> c** 2*3*4 <a href=\"u(1)\"><strong>l</strong> <code>k</code></a> !<a href=\"a b\">no t</a></p>"),
        ("![a](b.png)", '<figure><img src="b.png" alt="a"></figure>'),
    ],
)
def test_blocks(text, want):
    assert render.Blocks().render(text.split("\n")) == want


def test_whole_page_and_contents():
    out = render.page("# Top\n\n## One\n\n### In\n\n## Two\n", lang="en-GB")
    assert '<a href="#in"><span>1.1</span> In</a>' in out and "<title>Top</title>" in out and "Contents" in out
    assert "Mục lục" in render.page("# A\n## B", lang="xx") and "<nav>" not in render.page("# A\n## B", with_toc=False)


def test_paths(spark):
    df = spark.createDataFrame([("a/./b/../c.md", "a/x", "a/b/c.md")], "p string, d string, t string")
    r = df.select(paths.normalise(F.col("p")).alias("n"), paths.relative(F.col("t"), F.col("d")).alias("r"), paths.ancestors(F.col("t")).alias("a"), paths.suffixes(F.col("t")).alias("s"), paths.extension(F.lit("x/.env")).alias("e")).first()
    assert (r.n, r.r, r.a, r.s, r.e) == ("a/c.md", "../b/c.md", ["a/b", "a", ""], ["a/b/c.md", "b/c.md", "c.md"], "")
    globs = {"*.md": ["a/b.md", "b.MD"], "/docs/*.py": ["docs/x.py"], "src/**/t": ["src/t", "src/a/b/t/x"], "build/": ["build/x"]}
    for pattern, hits in globs.items():
        for path in ["a/b.md", "b.MD", "docs/x.py", "src/t", "src/a/b/t/x", "build/x", "other"]:
            assert spark.range(1).select(F.lit(path).rlike(paths.glob_regex(pattern))).first()[0] == (path in hits), (pattern, path)


def test_near_names_match_difflib(spark):
    files = spark.createDataFrame([(f"src/{n}.py",) for n in ("engine", "engines", "report", "reporter", "x")], "path string")
    got = {r.target: r.name for r in resolve.near_names(spark.createDataFrame([("src/engin.py",), ("src/reprt.py",)], "target string"), files, most=1).collect()}
    assert got == {t: difflib.get_close_matches(t[4:], ["engine.py", "engines.py", "report.py", "reporter.py", "x.py"], 1, 0.84)[0] for t in got} and len(got) == 2


def test_context_pack_is_greedy(spark):
    rows = [("a", 9.0, 700, "x"), ("b", 8.0, 900, "y"), ("c", 7.0, 700, "x"), ("d", 6.0, 1500, "z"), ("e", 5.0, 300, "w"), ("f", 4.0, 10, "v")]
    got = documents.context_pack(spark.createDataFrame(rows, "section string, score double, tokens long, body string"), 2000).collect()
    assert [r.section for r in sorted(got, key=lambda r: r.place)] == ["a", "b", "e"]


def test_context_pack_goes_on_behind_the_first_page(spark):
    args = "section string, score double, tokens long, body string"
    best = [("a", 2000.0, 1000, "best")]
    rows = best + [(f"l{i}", 1000.0 - i, 1500, f"long {i}") for i in range(600)] + [("z", 1.0, 900, "fits")]
    assert [tuple(r) for r in documents.context_pack(spark.createDataFrame(rows, args), 2000).collect()] == [(1, "a", 1000), (2, "z", 900)]
    rows = [(f"s{i:04d}", 1000.0 - i, 1, f"short {i}") for i in range(1300)]
    assert documents.context_pack(spark.createDataFrame(rows, args), 1200).count() == 1140


def test_a_best_section_larger_than_the_budget_is_cut(spark):
    body = "\n".join("abcd" * 10 for _ in range(50))
    ranked = spark.createDataFrame([("a", 2.0, 512, body), ("b", 1.0, 5, "small")], "section string, score double, tokens long, body string")
    packed = documents.context_pack(ranked, 110)
    assert [tuple(r) for r in packed.collect()] == [(1, "a", 110)]
    assert [r.text for r in documents.context_texts(packed, ranked).collect()] == ["\n".join(body.split("\n")[:10])]


def test_baseline_empties_and_downgrades(spark):
    rows = [("path-gone", "error", "a.md", 1, 1, "c", "it was previously here", "live"), ("table-shape", "warning", "p.md", 2, 1, "c", "x", "plan"), ("link-broken", "error", "p.md", 3, 1, "c", "x", "plan")]
    f = findings.with_fingerprints(findings.downgraded(spark.createDataFrame(rows, "rule string, severity string, path string, line int, col int, claim string, text string, kind string")))
    assert {r.rule: r.severity for r in f.collect()} == {"path-gone": "info", "table-shape": "warning", "link-broken": "info"}
    assert findings.without_baseline(f, f).count() == 0


def test_manifests(spark):
    files = spark.createDataFrame(
        [("web/package.json", "conf", json.dumps({"version": "1.2.3", "scripts": {"build": "x", "test": "y"}})), ("Makefile", "code", "all: a\n\techo\nX := 1\nb c: d\n"), ("requirements.txt", "conf", "Flask>=2.0\n# no\nx[y] == 1\n"),
         ("pyproject.toml", "conf", '[project]\nversion = "0.1.0"\n'), ("m.py", "code", "def f(x):\n    pass\nclass C:\n    async def g(self): ...\nVALUE = 1\n"), ("m.go", "code", "func (s *S) Serve() {\ntype T struct {\n")],
        "path string, kind string, text string",
    )
    assert {r.script for r in manifests.npm_scripts(files).collect()} == {"build", "test"}
    assert {"all"} <= {r.target for r in manifests.make_targets(files).collect()} and "X" not in {r.target for r in manifests.make_targets(files).collect()}
    assert {(r.package, r.spec) for r in manifests.requirement_pins(files).collect()} == {("flask", ">=2.0"), ("x", "==1")}
    assert {r.version for r in manifests.versions(files).collect()} == {"1.2.3", "0.1.0"}
    assert {(r.name, r.kind) for r in manifests.definitions(files).collect()} == {("f", "function"), ("C", "type"), ("g", "function"), ("VALUE", "value"), ("Serve", "function"), ("T", "type")}


@pytest.fixture
def repository(tmp_path):
    day = 0

    def run(*args):
        nonlocal day
        day += args[0] == "commit"
        date = f"2026-01-{day + 1:02d}T12:00:00Z"
        subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=a", "-c", "user.email=a@b", *args], check=True, capture_output=True, env=os.environ | {"GIT_COMMITTER_DATE": date, "GIT_AUTHOR_DATE": date})

    run("init", "-q")
    (tmp_path / "src").mkdir()
    (tmp_path / "src/engine.py").write_text("def start_engine():\n    return '--fast'\n")
    (tmp_path / "README.md").write_text("# Use\n\nRun `src/engine.py` or `src/motor.py` with `--fast` or `--slow`, see [x](src/engine.py) and [y](gone.md). Calls `start_engine()` and `stop_engine()`.\n")
    (tmp_path / ".env").write_text("token=abc")
    run("add", "."), run("commit", "-qm", "first")
    run("mv", "src/engine.py", "src/core.py"), run("commit", "-qm", "moved")
    run("mv", "src/core.py", "src/engine.py"), run("commit", "-qm", "back")
    return str(tmp_path)


def test_git_source(spark, repository):
    git.register(spark)
    read = lambda table: spark.read.format("git_history").option("repos", repository).option("table", table).load().collect()
    commits = sorted(read("commits"), key=lambda r: r.pos)
    assert [c.subject for c in commits] == ["back", "moved", "first"]
    assert {(e.pos, e.kind, e.path, e.other) for e in read("events") if e.pos == 1} == {(1, "D", "src/engine.py", "src/core.py"), (1, "A", "src/core.py", "src/engine.py")}
    assert {t.path for t in read("tree")} == {"README.md", "src/engine.py", ".env"}
    assert [(b.line, b.path) for b in read("blame")] == [(1, "README.md"), (2, "README.md"), (3, "README.md")]
    assert read("unanswered")[0].calls == 0


def test_corpus_check(spark, repository):
    corpus = Corpus.from_folders(spark, {"r": repository})
    assert {r.path for r in corpus.files.collect()} == {"README.md", "src/engine.py"}
    rows = corpus.check().collect()
    got = {(r.rule, r.severity, r.claim) for r in rows}
    assert got == {("path-missing", "info", "src/motor.py"), ("link-broken", "error", "gone.md"), ("flag-missing", "warning", "--slow"), ("symbol-gone", "info", "stop_engine()")}
    assert {r.message for r in rows if r.rule == "link-broken"} == {"the link gone.md leads nowhere"}
    assert {r.kind for r in corpus.claims().collect()} == {"path", "flag", "link", "symbol"}
    assert corpus.context("engine", 500).count() == 1 and corpus.cost().count() == 0


def test_links_of_a_site(spark):
    rows = [("s", "docs/guide/start.md", "doc", "[a](../setup/) [b](/guide/deep) [c](/api/made) [d](/blog/made/) [e](no.md) [f](more)"), ("s", "docs/setup.md", "doc", "x"), ("s", "docs/guide/deep/index.md", "doc", "x")]
    rows += [("t", "docs/a.md", "doc", "[a](/setup/) [b](/api/made)"), ("s", "docs/guide/start/more.png", "code", "")]
    files = spark.createDataFrame(rows, "repo string, path string, kind string, text string")
    got = {(r.repo, r.path, r.rule, r.severity, r.claim) for r in Corpus(files).check(groups=["paths"]).collect()}
    site = {("s", "docs/guide/start.md", "link-unverified", "info", "/api/made, /blog/made/"), ("s", "docs/guide/start.md", "link-broken", "error", "no.md"), ("s", "docs/guide/start.md", "link-broken", "error", "more")}
    assert got == site | {("t", "docs/a.md", "link-broken", "error", "/setup/"), ("t", "docs/a.md", "link-broken", "error", "/api/made")}


def test_corpus_check_with_history(spark, repository, tmp_path):
    """Two trees: what one has proves nothing for the other."""

    day = 10

    def run(*args):
        nonlocal day
        day += args[0] == "commit"
        date = f"2026-01-{day + 1:02d}T12:00:00Z"
        subprocess.run(["git", "-C", repository, "-c", "user.name=a", "-c", "user.email=a@b", *args], check=True, capture_output=True, env=os.environ | {"GIT_COMMITTER_DATE": date, "GIT_AUTHOR_DATE": date})

    (tmp_path / "src/old.py").write_text("x = 1\n")
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs/decisions.md").write_text("# Log\n\n| id | status |\n|---|---|\n| D-1 | superseded by D-2 |\n| D-2 | active |\n")
    (tmp_path / "docs/use.md").write_text("# v1.2.3\n\nAs D-1 and D-9 say, see [a](../README.md#nowhere) and `src/old.py`.\n\n```sh\npython src/gone.py\nmake all\nnpm run build\n```\n\n| a | b |\n|---|---|\n| 1 |\n")
    (tmp_path / "docs/package.json").write_text('{"version": "1.2.4", "scripts": {"test": "x"}}')
    (tmp_path / "docs/Makefile").write_text("one:\n\techo\n")
    run("add", "."), run("commit", "-qm", "docs"), run("rm", "-q", "src/old.py"), run("commit", "-qm", "gone")
    (tmp_path / "src/engine.py").write_text("def begin():\n    return '--fast'\n")
    run("add", "."), run("commit", "-qm", "renamed")
    corpus = Corpus.from_folders(spark, {"r": repository}, history=True)
    other = spark.createDataFrame([("s", "src/old.py", "code", "def stop_engine(): '--slow'"), ("s", "x.md", "doc", "fine `src/old.py`")], "repo string, path string, kind string, text string")
    corpus.files = corpus.files.select("repo", "path", "kind", "text").unionByName(other)
    got = {(r.repo, r.path, r.rule, r.severity, r.claim) for r in corpus.check().collect()}
    assert got == {
        ("r", "README.md", "path-missing", "info", "src/motor.py"), ("r", "README.md", "link-broken", "error", "gone.md"), ("r", "README.md", "flag-missing", "warning", "--slow"), ("r", "README.md", "symbol-gone", "warning", "start_engine()"),
        ("r", "docs/use.md", "path-moved", "error", "src/old.py"), ("r", "docs/use.md", "anchor-missing", "warning", "../README.md#nowhere"), ("r", "docs/use.md", "decision-superseded", "warning", "D-1"), ("r", "docs/use.md", "decision-unknown", "error", "D-9"),
        ("r", "docs/use.md", "command-missing", "warning", "python src/gone.py"), ("r", "docs/use.md", "npm-script-missing", "error", "npm build"), ("r", "docs/use.md", "make-target-missing", "error", "make all"), ("r", "docs/use.md", "table-shape", "info", "1 cells, not 2"),
        ("r", "docs/use.md", "version-mismatch", "warning", "1.2.3"), ("r", "README.md", "stale-risk", "info", "src/engine.py"),
    }


def test_git_files_and_blobs(spark, repository, tmp_path):
    git.register(spark)
    (tmp_path / ".gitignore").write_text("*.log\n")
    (tmp_path / "a.log").write_text("x")
    (tmp_path / "new.py").write_text("y = 1\n")
    read = lambda table: spark.read.format("git_history").option("repos", repository).option("table", table).load().collect()
    assert {(r.path, r.dirty) for r in read("files")} == {("README.md", False), ("src/engine.py", False), (".env", False), (".gitignore", True), ("new.py", True)}
    assert [r.path for r in read("ignored")] == ["a.log"]
    assert {(r.pos, r.path, r.text[:4]) for r in read("blobs") if r.text} == {(2, "src/engine.py", "def "), (1, "src/core.py", "def "), (0, "src/engine.py", "def ")}
    one = git.Repository(repository)
    assert one.is_ancestor("HEAD~1", "HEAD") and not one.is_ancestor("HEAD", "HEAD~1") and one.show("HEAD", "src/engine.py").startswith("def")


def test_clone_and_cd():
    got = shell.commands(["git clone https://x/y/app.git", "cd app", "python run.py", "cd sub && python a.py"])
    assert [(c["target"], c["folder"]) for c in got] == [("run.py", ""), ("a.py", "sub")]


def test_config(tmp_path):
    from tidemark import config

    assert config.load(str(tmp_path)) == config.Settings()
    (tmp_path / "pyproject.toml").write_text("[tool.tidemark]\nlive = ['a']\nlang = 3\n")
    assert config.load(str(tmp_path)) == config.Settings(live=["a"])
    (tmp_path / "tidemark.toml").write_text("lang = [")
    assert config.load(str(tmp_path)).live == ["a"]


def test_baseline_file_and_html(spark, tmp_path):
    from tidemark.operators import reports

    rows = [("docs/a.md", 1, 1, "r", "error", "</script><b>", "f1"), ("b.md", 2, 1, "r", "info", "m", "f2")]
    f = spark.createDataFrame(rows, "path string, line int, col int, rule string, severity string, message string, fingerprint string")
    assert reports.read_baseline(spark, str(tmp_path / "none")).count() == 0
    reports.write_baseline(f, str(tmp_path / "base"))
    assert {r.fingerprint for r in reports.read_baseline(spark, str(tmp_path / "base")).collect()} == {"f1", "f2"}
    pages = {r.area: r.html for r in reports.html_pages(f).collect()}
    assert set(pages) == {"docs", "."} and pages["docs"].count("</script>") == 2 and "\\u003c/script>\\u003cb>" in pages["docs"]
    data = pages["docs"].split('id="d">')[1].split("</script>")[0]
    assert json.loads(data)[0]["message"] == "</script><b>"
