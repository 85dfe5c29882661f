"""Options and subcommands by the scope of their script, with history."""

from tidemark.corpus import Corpus
from tidemark.operators import scripts, shell

FILES = {
    "tool.py": "import argparse\np.add_argument('--near-miss')\nsub.add_parser('build')\nsub.add_parser('clean')\nX = {'list': 1}\n",
    "beside.py": "OPTION = '--shared'\n", "tool/deep/x.py": "'--packed'\n", "far/other.py": "'--elsewhere'\n", "far/plain.py": "print('no options')\n",
    "app/__main__.py": "import typer\n@app.command()\ndef do_it(dry_run: bool): ...\n@app.command()\ndef undo(): ...\n", "app/sub/y.py": "'--inner'\n",
}


def files(spark):
    return spark.createDataFrame([("r", p, t) for p, t in FILES.items()] + [("s", "tool.py", "import click\n'--elsewhere'\n")], "repo string, path string, text string")


def test_scopes_against_a_loop(spark):
    names = [("r", "tool.py"), ("r", "far/other.py"), ("r", "app/__main__.py"), ("r", "none.py"), ("s", "tool.py")]
    got = {}
    for r in scripts.scopes(spark.createDataFrame(names, "repo string, script string"), files(spark)).collect():
        got.setdefault((r.repo, r.script), set()).add(r.path)
    assert got == {
        ("r", "tool.py"): {"tool.py", "beside.py", "tool/deep/x.py"}, ("r", "far/other.py"): {"far/other.py", "far/plain.py"}, ("r", "app/__main__.py"): {"app/__main__.py", "app/sub/y.py"},
        ("r", "none.py"): {"none.py", "tool.py", "beside.py"}, ("s", "tool.py"): {"tool.py"},
    }


def test_unknown_options(spark):
    flags = ["--near-miss", "--near", "--shared", "--packed", "--elsewhere", "--help"]
    calls = [("r", "tool.py", f) for f in flags] + [("r", "far/plain.py", "--x"), ("r", "app/__main__.py", "--dry-run"), ("r", "app/__main__.py", "--inner"), ("r", "app/__main__.py", "--gone"), ("s", "tool.py", "--shared"), ("s", "tool.py", "--elsewhere")]
    df = spark.createDataFrame(calls * 2, "repo string, script string, flag string")
    scope = scripts.scopes(df, files(spark))
    assert sorted(tuple(r) for r in scripts.unknown_options(df, scope, files(spark)).select("repo", "script", "flag").collect()) == [("r", "app/__main__.py", "--gone"), ("r", "tool.py", "--elsewhere"), ("r", "tool.py", "--near"), ("s", "tool.py", "--shared")]
    assert scripts.unknown_options(df.limit(0), scope, files(spark)).count() == 0


def test_unknown_subcommands(spark):
    words = [("r", "tool.py", w) for w in ("build", "list", "biuld", "zebra", "")] + [("r", "app/__main__.py", w) for w in ("do_it", "do-it", "undoo")] + [("s", "tool.py", "any")]
    df = spark.createDataFrame(words, "repo string, script string, word string")
    got = scripts.with_hints(scripts.unknown_subcommands(df, scripts.scopes(df, files(spark)), files(spark))).collect()
    assert {(r.script, r.word, r.hint) for r in got} == {("tool.py", "biuld", "build"), ("tool.py", "zebra", None), ("app/__main__.py", "undoo", "undo")}


def test_first_words():
    assert [shell.describe(c.split())["first"] for c in ("python t.py build --x", "python -m a.b run", "./t.py go", "python t.py --x go", "python t.py a/b")] == ["build", "run", "go", "", ""]


def test_corpus_with_history(spark):
    page = "# T\n\n```sh\npython tool.py biuld --near-miss --was\npython tool.py lost --never --shared\n```\n"
    rows = [("r", p, "code", t) for p, t in FILES.items()] + [("r", "README.md", "doc", page)]
    df = spark.createDataFrame(rows, "repo string, path string, kind string, text string")
    found = {(r.rule, r.claim) for r in Corpus(df).check(groups=["arguments"]).collect()}
    assert found == {("flag-missing", "--was"), ("flag-missing", "--never"), ("subcommand-missing", "biuld")}
    blobs = spark.createDataFrame([("r", "tool.py", 1, 100, "'--was' 'lost'"), ("r", "tool.py", 0, 300, FILES["tool.py"])], "repo string, path string, pos long, epoch long, text string")
    blame = spark.createDataFrame([("r", "README.md", i, 200) for i in range(1, 8)], "repo string, path string, line long, epoch long")
    events = spark.createDataFrame([("r", "tool.py", 1, "A", 100, None), ("r", "tool.py", 0, "M", 300, None)], "repo string, path string, pos long, kind string, epoch long, other string")
    known = Corpus(df, events=events, blobs=blobs, blame=blame).check(groups=["arguments"]).collect()
    assert {(r.rule, r.claim) for r in known} == {("flag-removed", "--was"), ("flag-missing", "--never"), ("subcommand-missing", "biuld"), ("subcommand-missing", "lost")}


def test_places_say_what_scopes_say(spark):
    names = [(r, p) for r in "rs" for p in [*FILES, "none.py", "app/none.py", "tool", "far/__init__.py", "__main__.py"]]
    words = ["--near-miss", "--shared", "--packed", "--elsewhere", "--inner", "--dry-run", "--gone", "--help"]
    df = spark.createDataFrame([(*n, w) for n in names for w in words], "repo string, script string, flag string")
    calls = spark.createDataFrame([(*n, w) for n in names for w in ("build", "list", "undo", "biuld", "do_it")], "repo string, script string, word string")
    rows = lambda found: sorted(map(str, found.collect()))
    pairs, places = scripts.scopes(df, files(spark)), scripts.places(df)
    assert rows(scripts.unknown_options(df, places, files(spark))) == rows(scripts.unknown_options(df, pairs, files(spark))) != []
    assert rows(scripts.unknown_subcommands(calls, places, files(spark))) == rows(scripts.unknown_subcommands(calls, pairs, files(spark))) != []


def test_a_folder_of_many_scripts_makes_no_pairs(spark):
    """Before, each script of a folder met each module beside it."""
    n = 3000
    code = spark.range(n).selectExpr("'r' AS repo", "concat('s/t', id, '.py') AS path", "concat('import argparse\n\"--o', id % 5, '\" .add_parser(\"clean\") .add_parser(\"make', id % 3, '\")') AS text")
    calls = code.selectExpr("repo", "path AS script", "'--o7' AS flag", "'make3' AS word")
    lost, words = scripts.unknown_options(calls.drop("word"), scripts.places(calls), code), scripts.unknown_subcommands(calls.drop("flag"), scripts.places(calls), code)
    for found in (lost, words):
        found.write.format("noop").mode("overwrite").save()
        assert found.count() == n
        assert _most_rows(found) < 20 * n


def _most_rows(df):
    """The most rows that an operator of the plan as run put out."""
    df.collect()
    done, most = [df._jdf.queryExecution().executedPlan()], 0
    while done:
        plan = done.pop()
        kind = plan.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            done.append(plan.executedPlan())
            continue
        if kind.endswith("QueryStageExec"):
            done.append(plan.plan())
            continue
        found = plan.metrics().get("numOutputRows")
        most = max(most, found.get().value() if found.isDefined() else 0)
        done += [plan.children().apply(i) for i in range(plan.children().size())]
    return most
