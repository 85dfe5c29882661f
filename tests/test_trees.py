"""Drawn trees: which blocks draw this tree, their entries against a plain reading, from where they are drawn, and all of it in a corpus with history."""

import pytest
from pyspark.sql import functions as F

from tidemark.corpus import Corpus
from tidemark.operators import markdown, trees

TREE = "```text\n.\n├── index.md\n└── README.md\n```\n"
BLOCKS = [  # page, what makes its tree say nothing
    (f"# Repository\n\nRepository structure:\n\n{TREE}", None), (f"# G\n\nSuppose you have the following source code structure:\n\n{TREE}", "example"), (f"# G\n\nCreate your project with the following scaffold:\n\n{TREE}", "example"),
    (f"# G\n\nYour project directory structure:\n\n{TREE}", "example"), (f"# G\n\nGiven this file tree\n\n{TREE}", "example"), (f"# G\n\nYou can add pages by creating files.\n\n{TREE}", "example"), (f"# G\n\nYou can read it. Done by creating files.\n\n{TREE}", None),
    (f"# G\n\nEach of your own very big repositories\n\n{TREE}", None), (f"# G\n\nA file tree:\n\n{TREE}", "example"), (f"# G\n\nHere a page is a file in it\n\n{TREE}", "example"), (f"# G\n\n{TREE}\nThe example above shows it.\n", "example"),
    (f"# G\n\nWe should also create these:\n\n{TREE}", "example"), (f"# G\n\nFor example:\n\n```\nx\n```\n\nThe files:\n\n{TREE}", None), ("# G\n\n```mermaid\n├── a.py\n└── b.py\n```\n", "language"), ("# Flow\n\n```\nsrc/app\n├── User enters\n│\nv\n└── Yes\n```\n", "diagram"),
    ("# G\n\n```\n┌───┐\n├── a\n└── b\n```\n", "diagram"), ("# G\n\n```\n+---+\n|-- a\n|-- b\n```\n", "diagram"), ("# G\n\n```\nReady?\n├── a.py\n└── b.py\n```\n", "diagram"), ("# The build process\n\n```\n├── a.py -> b.py\n└── c.py\n```\n", "diagram"),
    ("# G\n\n```\n├── a.py -> b.py\n└── c.py\n```\n", None), ("# G\n\n```\n├── yes → go on\n└── c.py\n```\n", "diagram"), ("# G\n\n```\n├── src/x (old) → go\n└── c.py  # why?\n```\n", None), ("# G\n\n```\n├── is it new -> go\n└── c.py\n```\n", "diagram"),
    ("# Skill authoring patterns\n\n## Project structure\n\n```\n├── a.py\n└── c.py\n```\n", "example"), ("# Skill authoring patterns\n\n## Other\n\n```\n├── a.py\n└── c.py\n```\n", None),
]


def test_which_blocks_draw_this_tree(spark):
    docs = spark.createDataFrame([(f"d{i}", f"p{i}.md", t) for i, (t, _) in enumerate(BLOCKS)] + [("none", "n.md", None), ("one", "o.md", "```\n├── a\n```\n")], "doc string, path string, text string")
    fences = markdown.exploded(markdown.scan(docs), "fences")
    got = {r.doc: r.why for r in trees.drawn(fences, trees.teaching_pages(docs)).collect()}
    assert [(BLOCKS[i][0], got[f"d{i}"]) for i in range(len(BLOCKS))] == BLOCKS and len(got) == len(BLOCKS)
    assert trees.drawn(fences.limit(0), trees.teaching_pages(docs)).count() == 0
    odd = fences.limit(1).select("doc", "start", "lang", F.expr("array(named_struct('line', 1, 'text', '├── a'), named_struct('line', 2, 'text', '└── b'))").alias("lines"), *(F.lit(None).cast("string").alias(c) for c in ("heading", "lead", "after")))
    assert [r.why for r in trees.drawn(odd, trees.teaching_pages(docs)).collect()] == [None]


@pytest.mark.parametrize("text,folder,want", [
    ("app/\n├── src/\n│   ├── main.py  # runs\n│   └── lib/\n│       └── a.py\n└── docs", "", [("src/", "app/src/", "app", "src"), ("main.py", "app/src/main.py", "app", "src/main.py"), ("lib/", "app/src/lib/", "app", "src/lib"), ("a.py", "app/src/lib/a.py", "app", "src/lib/a.py"), ("docs", "app/docs", "app", "docs")]),
    ("cmd/\n└── a.go\nclient/\n└── b.go", "", [("cmd/", "cmd/", "cmd", ""), ("a.go", "cmd/a.go", "cmd", "a.go"), ("client/", "client/", "client", ""), ("b.go", "client/b.go", "client", "b.go")]),  # two at the left edge: no root
    ("Docs/\n├── a.md\n└── b.md", "web/docs", [("a.md", "a.md", "", "a.md"), ("b.md", "b.md", "", "b.md")]),  # the page's own folder
    (".\n├── a.md\n└── src\n    └── b.rs", "", [("a.md", "a.md", "", "a.md"), ("src", "src", "", "src"), ("b.rs", "src/b.rs", "", "src/b.rs")]),
    ("|-- a.py\n|   `-- b.py\n+-- c.py (old)\n`-- ...", "", [("a.py", "a.py", "a.py", ""), ("b.py", "a.py/b.py", "a.py", "b.py"), ("c.py", "c.py", "c.py", "")]),
    ("├── <name>/\n│   └── x.py\n├── two words\n├── → out\n├── a.py — tells\n└── b.py // why", "", [("x.py", "x.py", "x.py", ""), ("a.py", "a.py", "a.py", ""), ("b.py", "b.py", "b.py", "")]),
    ("\n \n", "", []),
])
def test_entries(spark, text, folder, want):
    got = trees.entries(list(enumerate(text.split("\n"), 1)), folder)
    for (_, _, name, path, top, sub), (w_name, w_path, w_top, w_sub) in zip(got, want, strict=True):
        assert (name, path, top, sub.rstrip("/")) == (w_name, w_path, w_top, w_sub)
    assert all(text.split("\n")[n - 1][col - 1 :].startswith(name) for n, col, name, *_ in got)


def loop(entries, files, past):
    """The plain reading of `rebased` for one page in `folder`."""
    there = {"/".join(f.split("/")[:i]) for f in files for i in range(1, f.count("/") + 2)}
    out = []
    for (folder, top), rows in entries.items():
        kids = sorted({sub for _, sub in rows if sub})
        join = lambda *p: "/".join(x for x in p if x)
        hits = lambda base: sum(join(base, k) in there for k in kids)
        own = max(hits(join(folder, top)), hits(top))
        cut = None
        if len(kids) >= 2 and own * 2 < len(kids) and not any(join(b, k) in past for b in (join(folder, top), top) for k in kids):
            parts = top.split("/")
            options = [(-hits(base), i, p, "/".join(parts[i:])) for i in range(1, len(parts) + 1) for p, base in enumerate((join(folder, *parts[i:]), join(*parts[i:])))]
            best = min(options)
            if -best[0] > own and -best[0] * 2 >= len(kids):
                cut = best[3]
        out += [path if cut is None else join(cut, sub) for path, sub in rows if cut is None or sub]
    return sorted(out)


@pytest.mark.parametrize("files,past", [
    (["mytool/cli.py", "mytool/utils/fmt.py", "src/main.py", "README.md"], []), (["cli.py", "utils/fmt.py"], []), (["cli.py", "utils/fmt.py"], ["mytool/mytool/cli.py"]), (["docs/cli.py", "docs/utils/fmt.py", "cli.py"], []),
    (["mytool/mytool/cli.py", "mytool/mytool/table.py", "cli.py"], []), (["table.py"], []), ([], []), (["mytool/cli.py", "mytool/table.py", "cli.py", "table.py"], []),
])
def test_rebased_against_a_loop(spark, files, past):
    subs = ["", "cli.py", "table.py", "utils", "utils/fmt.py"]
    drawn = {("docs", "mytool/mytool"): [("/".join(x for x in ("mytool/mytool", s) if x), s) for s in subs], ("", "one"): [("one", ""), ("one/only.py", "only.py")]}
    rows = [("r", "d" + folder, folder, i, path, top, sub) for (folder, top), entries in drawn.items() for i, (path, sub) in enumerate(entries)]
    df = spark.createDataFrame(rows * 2, "repo string, doc string, folder string, line int, path string, top string, sub string").distinct()
    there = spark.createDataFrame([("r", "/".join(f.split("/")[:i])) for f in files for i in range(1, f.count("/") + 2)] + [("s", "one/only.py")], "repo string, candidate string")
    ever = spark.createDataFrame([("r", p) for p in past], "repo string, candidate string")
    assert sorted(r.path for r in trees.rebased(df, there, ever).collect()) == loop(drawn, files, past)


HOME = {
    "AGENTS.md": "# Layout\n\n```\nmytool/\n├── src/\n│   └── main.py\n└── README.md\n```\n\n```\nmytool/mytool/      # package\n├── cli.py          # CLI\n├── table.py        # Tables\n└── utils/\n    └── fmt.py\n\nconfig.toml\n```\n",
    "docs/guide.md": "# Structure\n\n```text\nunrelated-root/\n├── src/\n│   └── missing.py\n└── config/\n```\n\n<!-- ignored -->\n\n# Repository\n\n```text\nsrc/\n└── notes/\n    ├── cli.py\n    └── missing_entry.py\n```\n",
    "docs/flow.md": "# Flow\n\n```text\nsrc/app\n├── User enters\n│   v\n│   updateSession\n└── Yes\n```\n",
    "README.md": "# x\n\nYour project directory structure:\n\n```\n├── src/nowhere_a.py\n└── src/nowhere_b.py\n```\n",
}


def test_corpus(spark):
    code = ["mytool/cli.py", "mytool/utils/fmt.py", "src/main.py", "src/notes/cli.py", "config.toml"]
    rows = [("r", p, "doc", t) for p, t in HOME.items()] + [("r", p, "code", "x = 1\n") for p in code]
    found = Corpus(spark.createDataFrame(rows, "repo string, path string, kind string, text string")).check(groups=["paths"]).collect()
    assert {(r.rule, r.path, r.claim) for r in found} == {("path-missing", "AGENTS.md", "table.py"), ("path-missing", "docs/guide.md", "missing_entry.py")}


def test_history_of_drawn_entries(spark):
    """A folder that was flattened keeps its findings, as its entries were under the top once."""
    page = "# Layout\n\n```\nlib/\n├── parser.py\n└── render.py\n```\n"
    rows = [("r", "AGENTS.md", "doc", page), ("r", "parser.py", "code", "x"), ("r", "render.py", "code", "y")]
    events = [("r", f"lib/{n}.py", 1, "A", 100, None) for n in ("parser", "render")] + [("r", f"lib/{n}.py", 0, "D", 300, f"{n}.py") for n in ("parser", "render")]
    blame = spark.createDataFrame([("r", "AGENTS.md", i, 200) for i in range(1, 8)], "repo string, path string, line long, epoch long")
    corpus = Corpus(spark.createDataFrame(rows, "repo string, path string, kind string, text string"), events=spark.createDataFrame(events, "repo string, path string, pos long, kind string, epoch long, other string"), blame=blame)
    assert {(r.rule, r.claim) for r in corpus.check(groups=["paths"]).collect() if r.severity != "info"} == {("path-moved", "parser.py"), ("path-moved", "render.py")}
