"""Rules that documents make executable: `forbid /PATTERN/flags in GLOB, GLOB`, or a literal in quotes instead of the pattern."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import glob_regex

FLAGS = {"i": re.IGNORECASE, "m": re.MULTILINE, "s": re.DOTALL, "x": re.VERBOSE}
RULES = "repo string, doc string, line int, body string, pattern string, flags string, globs array<string>, error string"


def parse(body: str) -> tuple[str, str, list[str], str]:
    """(pattern, flags, globs, error) of a directive; the error is empty for one that can be used.

    The pattern ends at the last slash that only flags follow, so it may hold slashes; a literal ends at its quote.
    """
    rest = body.strip()[len("forbid") :].strip()
    wrong = "", "", [], "expected: forbid /pattern/ in glob"
    if not rest or rest[0] not in "/\"'":
        return wrong
    mark, flags = rest[0], ""
    for end in sorted((i for i, c in enumerate(rest) if c == mark and i > 1), reverse=mark == "/"):
        inner, behind = rest[1:end], rest[end + 1 :]
        word, _, places = behind.partition(" ")
        if (mark == "/" and not set(word) <= set(FLAGS)) or (mark != "/" and word):
            continue
        lead, _, globs = places.strip().partition(" ")
        if places.strip() and (lead.lower() != "in" or not globs.strip()):
            continue
        pattern, flags = (inner, word) if mark == "/" else (re.escape(inner), "")
        try:
            compiled(pattern, flags)
        except (re.error, OverflowError) as error:
            return pattern, flags, [], str(error)
        return pattern, flags, [g for g in re.split(r"[,\s]+", globs) if g], ""
    return wrong


@lru_cache(maxsize=4096)
def compiled(pattern: str, flags: str) -> re.Pattern[str]:
    return re.compile(pattern, sum({FLAGS[f] for f in flags}))


def rules(directives: DataFrame) -> DataFrame:
    """The directives (repo, doc, line, body) that forbid something, read; `error` says what is wrong with those that cannot be used."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            read = [parse(b) for b in batch.column("body").to_pylist()]
            parts = [pa.array([r[0] for r in read], pa.string()), pa.array([r[1] for r in read], pa.string()), pa.array([[glob_regex(g) for g in r[2]] for r in read], pa.list_(pa.string())), pa.array([r[3] for r in read], pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *parts], [*batch.schema.names, "pattern", "flags", "globs", "error"])

    named = directives.filter(F.lower("body").startswith("forbid")).select("repo", "doc", F.col("line").cast("int").alias("line"), "body")
    return named.mapInArrow(of, RULES)


def violations(known: DataFrame, code: DataFrame) -> DataFrame:
    """(repo, doc, body, rule_line, path, line, text): all lines of code (repo, path, kind, text) that break a rule of their repository, the rule with the line of its page.

    Globs are tried on paths alone; a file is read once, with all the rules that hold for it. Without a glob a rule holds for code, not for configuration.
    """
    fine = known.filter("error = ''").select("repo", F.struct("doc", F.col("line").alias("rule_line"), "body", "pattern", "flags").alias("rule"), "globs")
    held = F.when(F.size("globs") > 0, F.exists("globs", lambda g: F.rlike("path", g))).otherwise(F.col("kind") == "code")
    per_file = code.select("repo", "path", "kind").join(fine, "repo").filter(held).groupBy("repo", "path").agg(F.collect_set("rule").alias("rules"))
    schema = "repo string, doc string, body string, rule_line int, path string, line int, text string"

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for repo, path, text, some in zip(*(batch.column(c).to_pylist() for c in ("repo", "path", "text", "rules")), strict=True):
                for rule in some:
                    pattern = compiled(rule["pattern"], rule["flags"])
                    out += [(repo, rule["doc"], rule["body"], rule["rule_line"], path, n, line) for n, line in enumerate(text.splitlines(), 1) if pattern.search(line)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int32() if k in (3, 5) else pa.string()) for k, x in enumerate(zip(*out, strict=True))], [c.strip().split(" ")[0] for c in schema.split(",")])

    return code.filter("text IS NOT NULL").select("repo", "path", "text").join(per_file, ["repo", "path"]).mapInArrow(of, schema)
