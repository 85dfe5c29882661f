"""python -m tidemark check|claims|context|cost|impact FOLDER [...]: the corpus questions on folders of this machine."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import functions as F

from .config import load
from .corpus import Corpus
from .functions import messages
from .operators import findings, reports
from .session import local_session
from .sources import git


def named(folders: list[str]) -> dict[str, str]:
    """Folders by their last name, and by their whole path where two share it."""
    last = [f.rstrip("/").rpartition("/")[2] for f in folders]
    return {n if last.count(n) == 1 else f.rstrip("/"): f for n, f in zip(last, folders, strict=True)}


def main(argv: list[str] | None = None) -> int:
    """0: fine; 1: findings of at least the failing severity; 2: wrong use."""
    p = argparse.ArgumentParser(prog="tidemark")
    p.add_argument("command", choices=["check", "claims", "context", "cost", "impact"])
    p.add_argument("folders", nargs="+")
    p.add_argument("--query", default="")
    p.add_argument("--budget", type=int, default=2000)
    p.add_argument("--since", default="HEAD", help="revision that impact compares the working tree with")
    p.add_argument("--all", action="store_true", help="show guesses as they are")
    p.add_argument("--history", action="store_true", help="read git histories, as proof")
    p.add_argument("--lang", choices=["en", "vi"], help="language of the messages")
    p.add_argument("--baseline", help="folder of known findings, which are not told")
    p.add_argument("--update-baseline", action="store_true", help="write all findings to it instead")
    p.add_argument("--format", choices=["text", "json", "sarif", "github", "html"], default="text")
    p.add_argument("--fail-on", choices=[*findings.RANKS, "never"], default="error")
    a = p.parse_args(argv)
    spark = local_session("tidemark")
    settings = load(a.folders[0])
    corpus = Corpus.from_folders(spark, named(a.folders), history=a.history, live=settings.live, plans=settings.plans)
    corpus.history = settings.history
    if a.command == "impact":
        told = corpus.impact(git.read(spark, named(a.folders), "base", since=a.since)).persist()
        shown = told.orderBy("late", "repo", "path", "line", "term").withColumn("said", messages.lost(*(F.col(c) for c in ("kind", "term", "file", "note")), a.lang or settings.lang))
        for r in shown.toLocalIterator():
            print(json.dumps(r.asDict(), ensure_ascii=False) if a.format == "json" else f"{r.path}:{r.line}{' (plan)' if r.late else ''}  {r.said}")
        return int(bool(told.filter("NOT late").take(1)))
    if a.command != "check":
        table = {"claims": corpus.claims, "cost": corpus.cost, "context": lambda: corpus.context(a.query, a.budget)}[a.command]()
        for r in table.toLocalIterator():
            print(*r.asDict().values(), sep="\t")
        return 0
    found = corpus.check(sure_only=not (a.all or a.update_baseline), lang=a.lang or settings.lang).persist()
    if a.update_baseline and a.baseline:
        reports.write_baseline(found, a.baseline)
        return 0
    if a.baseline:
        found = findings.without_baseline(found, reports.read_baseline(spark, a.baseline))
    rows, column = {"text": (reports.text_blocks, "block"), "json": (reports.json_documents, "json"), "sarif": (reports.sarif_logs, "json"), "github": (reports.annotations, "annotation"), "html": (reports.html_pages, "html")}[a.format]
    for r in rows(found).toLocalIterator():
        print(r[column])
    if a.format == "text":
        print(reports.summary_line(found).first().summary)
    return int(a.fail_on != "never" and bool(findings.at_least(found, a.fail_on).take(1)))


if __name__ == "__main__":
    sys.exit(main())
