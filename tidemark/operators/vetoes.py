"""Why a path that never was is not told as missing: each reason is a veto with a name, and the first one in their order is kept.

A claim that nothing speaks against is told (`missing`). One whose sentence or place makes it no statement about this tree is `skipped`; one that the tree cannot
decide is `unverified`. Words are read in English and Vietnamese. Nulls: a null sentence, target or line has no veto by words; an empty table gives an empty table.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import ancestors, basename, dirname, suffixes
from ..functions.text import is_acknowledged, is_past, says
from .claims import has_placeholder
from .guards import ignore_rules, ignored_paths, paragraphs
from .inventory import GENERATED, is_private

# Words and phrases by which a sentence takes its path out of this tree, and folders that builds make.
EXAMPLES = ["for example", "example", "usually", "typically", "e.g."]
READER_MAY = [f"{who} {may}{also}" for who in ("you", "we") for may in ("can", "could", "should", "may", "might", "must", "need to", "have to", "will") for also in ("", " also")]
READER_DOES = ["customize", "configure", "define", "implement", "set up"]
MADE_LATER = ["create", "add", "new", "generate", "will", "should create", "tạo", "thêm", "sinh ra", "sẽ"]
DENIED_BEFORE = ["no file", "no folder", "no directory", "no path", "no such file", "no such folder", "no such directory", "no such path", "không có", "không tồn tại"]
DENIED_AFTER = ["does not exist", "doesn't exist", "do not exist", "don't exist", "is not exist", "isn't exist"]
ACCESS_LISTS = ["denyWrite", "denyRead", "allowWrite", "allowRead", "denylist", "allowlist", "denied individually", "deny list", "allow list"]
OTHER_TREES = [f"if {the}{what}" for the in ("the ", "") for what in ("repo", "repository", "project", "app", "you")]
HOLDING = ["has", "have", "use", "uses", "contain", "contains", "include", "includes"]
MAKERS = ["build", "compile", "compiles", "compiled", "compiling", "generate", "generates", "generated", "render", "renders", "rendered"]
PUTS = ["move", "moves", "copy", "copies", "write", "writes", "output", "outputs", "emit", "emits"]
RETIRED = (
    [f"{has} been {gone}" for has in ("has", "have") for gone in ("removed", "deprecated", "discontinued", "dropped")]
    + [f"was {gone}" for gone in ("removed", "discontinued", "dropped")]
    + [f"no longer {kept}" for kept in ("supported", "maintained", "available")]
    + [f"{gone} {kind}feature" for gone in ("removed", "deprecated", "discontinued") for kind in ("", "experimental ")]
    + ["đã bị gỡ", "đã bị xóa", "đã bị xoá", "đã bị bỏ", "không còn được hỗ trợ", "không còn được duy trì"]
)
BUILT_FOLDERS = [*GENERATED, "build", "out", "target", ".git"]
NEAR = 60  # characters between a word that makes or denies a thing and its path
OPENING = 25  # lines in which a page says what has become of its subject
ADDRESS_LINES = 12  # lines above a path in which the address of its file elsewhere may stand

#: Vetoes in their order, with what becomes of the claim.
STATUS = {
    "not-live": "skipped", "bare-name": "unverified", "outside": "unverified", "address": "unverified", "placeholder": "skipped", "private": "skipped", "readers-own": "skipped", "built": "unverified",
    "gone": "skipped", "past": "skipped", "retired-page": "skipped", "example": "skipped", "reader-may": "skipped", "denied": "skipped", "access-list": "skipped", "other-trees": "skipped",
    "elsewhere": "unverified", "made-later": "skipped", "build-output": "unverified", "ignored": "unverified", "other-project": "unverified", "no-folder": "unverified", "in-code": "unverified",
}
STOP = "\u0001"


def claim_sentences(claims: DataFrame, lines: DataFrame) -> DataFrame:
    """`claims` (doc, line, col, text, ...) with the parts of their sentence `before` and `after` the claim: paragraphs read on over lines, sentences end at . ! ? ; and between cells.

    lines (doc, line, text): only pages with claims are looked at. A claim that its line does not hold has the whole line before it; one without a line has nulls.
    """
    own = claims.columns
    pages = lines.join(claims.select("doc").distinct(), "doc", "left_semi").select("doc", F.col("line").cast("long").alias("line"), "text")
    runs = paragraphs(pages)
    whole = runs.groupBy("doc", "paragraph").agg(F.sort_array(F.collect_list(F.struct("line", "text"))).alias("_run"))
    placed = runs.select("doc", F.col("line").alias("_line"), "paragraph").join(whole, ["doc", "paragraph"]).withColumnRenamed("doc", "_doc")
    told = claims.join(placed, (F.col("doc") == F.col("_doc")) & (F.col("line") == F.col("_line")), "left")
    mine = F.filter("_run", lambda x: x["line"] == F.col("line"))[0]["text"]
    told = told.withColumn("_mine", mine).withColumn("_at", F.expr("locate(text, _mine, greatest(col, 1))"))
    left = F.when(F.col("_at") > 0, F.expr("left(_mine, _at - 1)")).otherwise(F.col("_mine"))
    right = F.when(F.col("_at") > 0, F.expr("substring(_mine, _at + length(text))")).otherwise(F.lit(""))
    above = F.transform(F.filter("_run", lambda x: x["line"] < F.col("line")), lambda x: F.trim(x["text"]))
    below = F.transform(F.filter("_run", lambda x: x["line"] > F.col("line")), lambda x: F.trim(x["text"]))
    cut = lambda text: F.split(F.replace(F.regexp_replace(text, r"([.!?;])\s+", f"$1{STOP}"), F.lit(" | "), F.lit(STOP)), STOP)
    before = F.element_at(cut(F.concat_ws(" ", above, F.ltrim(left))), -1)
    after = cut(F.concat_ws(" ", F.rtrim(right), below))[0]
    known = F.col("_mine").isNotNull()
    return told.select(*own, F.when(known, before).alias("before"), F.when(known, after).alias("after"))


def _clause_end(text: Column) -> Column:
    """The last characters of the last clause of a text."""
    clause = F.element_at(F.split(text, r"[.!?;]"), -1)
    return F.right(clause, F.lit(NEAR))


def word_vetoes(target: Column, before: Column, after: Column, doc_kind: Column) -> dict[str, Column]:
    """The vetoes that a claim and its sentence show by themselves, by name."""
    low = F.lower(target)
    parts = F.filter(F.split(F.regexp_replace(low, "^/+|/+$", ""), "/"), lambda p: p != "")
    sentence = F.concat_ws(" ", before, after)
    bare = F.ltrim(F.regexp_replace(after, "^[\\s`\"']+", ""))
    to_here = F.regexp_replace(before, "[\\s`]+$", "")
    return {
        "not-live": doc_kind != "live",
        "bare-name": F.size(parts) < 2,
        "outside": target.startswith("/") | target.startswith("~"),
        "address": target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"),
        "placeholder": has_placeholder(target) | F.contains(target, F.lit("[")),
        "private": is_private(target),
        "readers-own": F.exists(parts, lambda p: p.startswith("your-") | p.startswith("my-")),
        "built": F.arrays_overlap(parts, F.array(*(F.lit(x) for x in BUILT_FOLDERS))),
        "gone": is_acknowledged(sentence),
        "past": is_past(sentence),
        "example": says(before, EXAMPLES),
        "reader-may": says(before, [f"{may} {does}" for may in READER_MAY for does in READER_DOES]),
        "denied": says(_clause_end(before), DENIED_BEFORE) | F.exists(F.array(*(F.lit(w) for w in DENIED_AFTER)), lambda w: F.lower(bare).startswith(w)),
        "access-list": says(sentence, ACCESS_LISTS),
        "other-trees": says(before, OTHER_TREES) & says(before, HOLDING),
        "made-later": says(_clause_end(before), MADE_LATER),
        "build-output": says(before, MAKERS) & says(before, PUTS) & F.lower(to_here).endswith(" to"),
    }


def retired_pages(lines: DataFrame, headings: DataFrame) -> DataFrame:
    """Pages (doc) that say before their first section that their subject is gone: lines (doc, line, text), headings (doc, line, level)."""
    section = headings.filter("level >= 2 AND line > 1").groupBy("doc").agg(F.min("line").alias("_section"))
    lead = lines.filter(F.col("line") <= OPENING).join(section, "doc", "left").filter("_section IS NULL OR line < _section")
    whole = lead.groupBy("doc").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), " ").alias("_lead"))
    return whole.filter(says(F.col("_lead"), RETIRED)).select("doc")


def told_elsewhere(claims: DataFrame, lines: DataFrame) -> DataFrame:
    """Claims (doc, line, target) above which, within some lines, stands an address that ends with their path: the file is of another tree."""
    address = r"(?i)https?://[^/\s<>()\[\]\"'`]+(/[^\s<>()\[\]\"'`?#]*)"
    found = lines.select("doc", F.col("line").alias("_at"), F.explode(F.regexp_extract_all("text", F.lit(address), 1)).alias("_url"))
    ends = found.select("doc", "_at", F.explode(suffixes(F.url_decode(F.regexp_replace(F.regexp_replace("_url", r"[.,;]+$", ""), r"%(?![0-9A-Fa-f]{2})|\+", "_")))).alias("_end")).distinct()
    asked = claims.select("doc", "line", "target").distinct().withColumn("_end", F.regexp_replace("target", r"^[./]+", ""))
    return asked.join(ends, ["doc", "_end"]).filter(F.col("_at").between(F.col("line") - ADDRESS_LINES, F.col("line"))).select("doc", "line", "target").distinct()


def ignored_targets(claims: DataFrame, files: DataFrame) -> DataFrame:
    """Claims (doc, line, target, candidate: a path below its repository) that ignore files cover, by the path itself, a folder above it, or, for a folder, a rule for something right in it.

    files (path, text). Folders end with a slash in `target`.
    """
    rules = ignore_rules(files)
    each = claims.select("doc", "line", "target", "candidate").distinct()
    up = each.withColumn("_path", F.explode(F.array_union(F.array("candidate"), F.filter(ancestors(F.col("candidate")), lambda a: a != ""))))
    as_folder = F.when((F.col("_path") != F.col("candidate")) | F.col("target").endswith("/"), F.concat("_path", F.lit("/x"))).otherwise(F.col("_path"))
    asked = up.withColumn("path", F.explode(F.array_distinct(F.array("_path", as_folder))))
    hit = ignored_paths(asked.select("path").distinct(), rules).filter("ignored")
    return asked.join(hit.select("path"), "path", "left_semi").select("doc", "line", "target").distinct()


def literal_names(files: DataFrame) -> DataFrame:
    """(repo, name): what strings of the code say of paths: a string itself and, where it is a path without spaces, its endings of two names or more. Of any length."""
    quoted = F.flatten(F.array(*(F.regexp_extract_all("text", F.lit(rf"{q}([^{q}\r\n]+){q}"), 1) for q in ("'", '"', "`"))))
    each = files.filter("kind = 'code'").select("repo", F.explode(F.array_distinct(quoted)).alias("s")).withColumn("s", F.replace("s", F.lit("\\"), F.lit("/")))
    plain = F.regexp_replace(F.regexp_replace("s", "^(?:\\./)+", ""), "/+$", "")
    ends = F.when(F.contains("s", F.lit("/")) & ~F.col("s").rlike(r"\s"), F.filter(suffixes(F.regexp_replace("s", "^/+|/+$", "")), lambda e: F.contains(e, F.lit("/")))).otherwise(F.array().cast("array<string>"))
    return each.select("repo", F.explode(F.array_union(F.array(plain), ends)).alias("name")).distinct()


def in_literals(claims: DataFrame, names: DataFrame) -> DataFrame:
    """Claims (repo, doc, line, target) whose path or last name the code writes in quotes."""
    flat = F.regexp_replace("target", "^(?:\\./)+|/+$", "")
    asked = claims.select("repo", "doc", "line", "target").distinct().withColumn("name", F.explode(F.array_distinct(F.array(flat, basename(flat)))))
    return asked.join(names, ["repo", "name"], "left_semi").select("doc", "line", "target").distinct()


def other_projects(docs: DataFrame, entered: DataFrame, own: DataFrame) -> DataFrame:
    """Pages (doc) whose paths and commands are another project's: they, or a page of the same skill, have the reader enter a clone of it.

    docs (doc, repo, path), entered (doc, folder): clones that a page enters, own (repo, name): what the tree itself is called. A skill is the nearest folder above a page with a SKILL.md;
    the search stops there, so what lies below an inner skill says nothing about an outer one. Pages outside of skills speak for themselves.
    """
    skills = docs.filter(basename(F.col("path")) == "SKILL.md").select("repo", dirname(F.col("path")).alias("_folder"))
    up = docs.select("repo", "doc", F.posexplode(F.filter(ancestors(F.col("path")), lambda a: a != "")).alias("_up", "_folder"))
    nearest = up.join(skills.distinct(), ["repo", "_folder"]).groupBy("doc").agg(F.min_by("_folder", "_up").alias("_folder"))
    keyed = docs.select("repo", "doc").distinct().join(nearest, "doc", "left").withColumn("_unit", F.coalesce("_folder", F.col("doc")))
    foreign = entered.withColumn("name", F.lower(basename(F.regexp_replace("folder", "/+$", "")))).join(keyed, "doc").join(own.select("repo", F.lower("name").alias("name")).distinct(), ["repo", "name"], "left_anti")
    return keyed.join(foreign.select("repo", "_unit").distinct(), ["repo", "_unit"], "left_semi").select("doc")


def with_veto(claims: DataFrame, shown: dict[str, Column]) -> DataFrame:
    """`claims` with `veto`, the first reason in the order of STATUS that holds, and `status`: missing, skipped or unverified."""
    first = F.coalesce(*(F.when(shown[name], F.lit(name)) for name in STATUS if name in shown))
    status = F.create_map(*(F.lit(x) for kv in STATUS.items() for x in kv))
    return claims.withColumn("veto", first).withColumn("status", F.when(F.col("veto").isNull(), "missing").otherwise(status[F.col("veto")]))
