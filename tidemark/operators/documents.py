"""Kinds of documents, decisions, retrieval, near copies, impact and cost."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import basename, dirname, matches_any
from ..functions.text import NUMBER, number_shape, terms, token_estimate
from .guards import within_budget
from .inventory import is_agent_file

# Names, folders and status words that tell what a document is for.
HISTORY_NAMES = (
    "changelog changes history release releases release-notes releasenotes news decision decisions decision-log decisionlog lesson lessons lesson-learned lessons-learned postmortem post-mortem retro retrospective "
    "journal diary devlog handover result results report reports"
).split()
HISTORY_FOLDERS = (
    "archive archived _archive attic old legacy deprecated history adr adrs decisions decision-records research pinned vendor third-party third_party thirdparty jobs runs experiment experiments fixture fixtures "
    "testdata template templates scaffold boilerplate prompt prompts done completed complete implemented shipped superseded obsolete finished release-notes release_notes releasenotes"
).split()
POST_FOLDERS = "blog blogs news posts _posts articles announcement announcements".split()
PLAN_NAMES = "plan plans proposal rfc draft todo idea ideas spike brainstorm wip brief".split()
PLAN_FOLDERS = "task tasks ticket tickets plan plans proposal proposals rfc rfcs draft drafts idea ideas backlog todo todos wip in-progress in_progress inprogress planned upcoming".split()
PLAN_STATUS = ["draft", "proposed", "planned", "in progress", "wip", "approved"]
PAST_STATUS = ["done", "implemented", "completed", "shipped", "superseded", "obsolete", "deprecated", "archived", "rejected", "withdrawn", "accepted"]
WEIGHTS = {"live": 1.0, "plan": 0.7, "history": 0.4}


def has_word(name: Column, words: list[str]) -> Column:
    """Whether one of `words` stands in a name, apart from the rest by hyphens, underscores, dots, spaces or the name's ends."""
    return F.translate(F.lower(name), "_. ", "---").rlike("(?:^|-)(?:" + "|".join(words) + ")(?:-|$)")


def in_folder(path: Column, names: list[str], more: Callable[[Column], Column] = lambda x: F.lit(False)) -> Column:
    """Whether a folder above the path has one of these names, or is one that `more` says."""
    return F.exists(F.split(F.lower(dirname(path)), "/"), lambda x: x.isin(names) | more(x))


def is_dated(name: Column) -> Column:
    return F.try_to_date(F.substring(name, 1, 10), "yyyy-MM-dd").isNotNull() & name.rlike(r"^[\d-]{10}")


def document_kind(path: Column, mark: Column, status: Column, old: Column, live: list[str] = (), history: list[str] = (), plans: list[str] = ()) -> Column:
    """live, plan or history: by mark, by settings, by status line, by older version folder, by folder and name, in this order."""
    name = basename(path)
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    word = F.lower(F.regexp_replace(status, r"\s+", " "))
    return (
        F.when(mark.isin("live", "plan", "history"), mark)
        .when(matches_any(path, list(live)), "live")
        .when(matches_any(path, list(history)), "history")
        .when(matches_any(path, list(plans)), "plan")
        .when(word.isin(PLAN_STATUS), "plan")
        .when(word != "", "history")
        .when(old, "history")
        .when(in_folder(path, HISTORY_FOLDERS, lambda x: is_dated(x) | x.startswith("versioned_docs")), "history")
        .when(is_dated(name) & ~in_folder(path, POST_FOLDERS), "plan")
        .when(has_word(stem, HISTORY_NAMES), "history")
        .when(has_word(F.regexp_replace(stem, r"\d+", "-"), PLAN_NAMES) | in_folder(path, PLAN_FOLDERS), "plan")
        .otherwise("live")
    )


def status_of(text: Column) -> Column:
    """The word of a status line: "status", marks of emphasis aside, then a colon, dash or bar, then one of the words; else null."""
    flat = F.lower(F.translate(text, "*_\"'", ""))
    parts = F.filter(F.transform(F.split(flat, "[:|—–]|(?<=status)\\s*-"), lambda x: F.regexp_replace(F.trim(x), r"\s+", " ")), lambda x: x != "")
    word = F.get(F.filter(F.array(*(F.lit(w) for w in [*PLAN_STATUS, *PAST_STATUS])), lambda w: F.concat(F.get(parts, F.lit(1)), F.lit(" ")).startswith(F.concat(w, F.lit(" ")))), F.lit(0))
    return F.when((F.get(parts, F.lit(0)) == "status") & ~text.startswith("    "), word)


def status_words(lines: DataFrame, within: int = 20) -> DataFrame:
    """(doc, status): the first status line among the first lines of a document."""
    return lines.filter(F.col("line") <= within).withColumn("_w", status_of(F.col("text"))).filter("_w IS NOT NULL").groupBy("doc").agg(F.min_by("_w", "line").alias("status"))


def folder_version(name: Column) -> Column:
    """The numbers of a version folder: v1, 1.2, version-3.x; null for others."""
    core = F.regexp_replace(F.regexp_replace(F.lower(name), r"^v(?:ersion[-_]?)?", ""), r"\.x$", "")
    numbers = F.split(core, r"\.")
    return F.when(F.forall(numbers, lambda x: x.rlike(r"^\d{1,9}$")), F.transform(numbers, lambda x: x.cast("int")))


def old_versions(docs: DataFrame) -> DataFrame:
    """Paths below a version folder that has a sibling of a later version."""
    part = F.split(dirname(F.col("path")), "/")
    each = docs.select("path", F.posexplode(part).alias("i", "name")).withColumn("parent", F.array_join(F.slice(F.split("path", "/"), 1, F.col("i")), "/"))
    versioned = each.withColumn("version", folder_version(F.col("name"))).filter("version IS NOT NULL")
    newest = versioned.withColumn("top", F.max("version").over(Window.partitionBy("parent")))
    return newest.filter("version < top").select("path").distinct()


def decision_status(rows: DataFrame) -> DataFrame:
    """Decisions (log, id, status, by: ids that replace it): a decision that later ones say they replace is amended, unless its own row says more. Needs replaces (an id, or null)."""
    later = rows.filter("replaces IS NOT NULL").groupBy("log", F.col("replaces").alias("id")).agg(F.sort_array(F.collect_set("id")).alias("by"))
    joined = rows.drop("replaces").join(later, ["log", "id"], "left")
    status = F.when((F.col("status") == "active") & F.col("by").isNotNull(), "amended").otherwise(F.col("status"))
    return joined.select("log", "id", status.alias("status"), F.array_join(F.coalesce("by", F.array().cast("array<string>")), ",").alias("by"))


def decision_findings(mentions: DataFrame, decisions: DataFrame) -> DataFrame:
    """Mentions (doc, line, id) against decisions (id, status): unknown ids of known prefixes, superseded and amended ones."""
    prefix = lambda c: F.regexp_extract(c, r"^([A-Z]+)", 1)
    known = decisions.select(prefix(F.col("id")).alias("_p")).distinct()
    seen = mentions.withColumn("_p", prefix(F.col("id"))).join(known, "_p", "left_semi").join(decisions, "id", "left")
    rule = F.when(F.col("status").isNull(), "decision-unknown").when(F.col("status") == "superseded", "decision-superseded").when(F.col("status") == "amended", "decision-amended")
    severity = F.when(F.col("status").isNull(), "error").when(F.col("status") == "superseded", "warning").otherwise("info")
    return seen.withColumns({"rule": rule, "severity": severity}).filter("rule IS NOT NULL").select("doc", "line", "id", "rule", "severity")


def bm25(sections: DataFrame, query: str, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """`sections` (section, text, weight) that hold a word of the query, with their score. Only the query's postings are made."""
    counted = sections.withColumn("_t", terms(F.col("text"))).filter(F.size("_t") > 0).select("section", "weight", F.size("_t").alias("length"), "_t")
    words = list(dict.fromkeys(w for w in "".join(c if c.isalnum() else " " for c in query.lower()).split() if len(w) > 1))
    stats = counted.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean"))
    tf = counted.select("section", "weight", "length", F.explode(F.array(*(F.struct(F.lit(w).alias("term"), F.size(F.filter("_t", F.lit(w).eqNullSafe)).alias("tf")) for w in words))).alias("p")).select("section", "weight", "length", "p.*").filter("tf > 0")
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))  # a row for each word of the query
    scored = tf.join(F.broadcast(df), "term").join(F.broadcast(stats))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean")))
    return scored.groupBy("section").agg((F.sum(part) * F.first("weight")).alias("score"))


def context_pack(ranked: DataFrame, budget: int, page: int = 500) -> DataFrame:
    """(place, section, tokens) of sections (section, score, tokens, body) in order of score, as many as fit: one too large is skipped, equal bodies come
    once, near the budget it ends. A best section larger than the budget is cut to it and stands alone (see `context_texts`).

    Sections are read in pages of `page`, of those that still fit, until the budget is used or none is left. Each page fills at least one place.
    """
    best = ranked.groupBy("body").agg(F.min(F.struct((-F.col("score")).alias("s"), "section", "tokens")).alias("x")).select("x.*").persist()
    kept: list[tuple[int, str, int]] = []
    used, last = 0, None
    while used < budget * 0.95:
        left = best.filter(F.col("tokens") <= budget - used) if kept else best
        if last is not None:
            left = left.filter((F.col("s") > last["s"]) | ((F.col("s") == last["s"]) & (F.col("section") > last["section"])))
        rows = left.orderBy("s", "section").limit(page).collect()
        for r in rows:
            tokens = budget if not kept and r["tokens"] > budget else r["tokens"]
            if used < budget * 0.95 and used + tokens <= budget:
                used += tokens
                kept.append((len(kept) + 1, r["section"], tokens))
        if len(rows) < page:
            break
        last = rows[-1]
    best.unpersist()
    return ranked.sparkSession.createDataFrame(kept, "place long, section string, tokens long")  # at most `budget` rows


def context_texts(packed: DataFrame, ranked: DataFrame) -> DataFrame:
    """`packed` (see `context_pack`) with the text of each section; of one that was cut, the first lines that fit."""
    whole = packed.join(ranked.select("section", "body", F.col("tokens").alias("all")), "section")
    lines = whole.select("*", F.posexplode(F.split("body", "\n")).alias("line", "of"))
    cut = within_budget(lines.filter("tokens < all"), token_estimate(F.col("of")), F.col("tokens")).groupBy("section").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "of"))), lambda x: x["of"]), "\n").alias("cut"))
    text = F.when(F.col("tokens") < F.col("all"), F.coalesce("cut", F.lit(""))).otherwise(F.col("body"))
    return whole.join(cut, "section", "left").select("place", "section", "tokens", text.alias("text"))


def stale_marks(sections: DataFrame, findings: DataFrame) -> DataFrame:
    """Findings within sections: an equi-join on the document, then the range of lines."""
    f = findings.select("doc", "line", "rule")
    return sections.join(f, "doc").filter("line BETWEEN start AND end").groupBy("doc", "start").agg(F.count(F.lit(1)).alias("stale"))


def diverged_copies(lines: DataFrame) -> DataFrame:
    """Lines that are alike but for their numbers, in two documents or more and in exactly two variants: the older ones against the newest. lines (doc, line, text, epoch)."""
    shape = number_shape(F.col("text"))
    shaped = lines.withColumns({"shape": shape, "nums": F.regexp_extract_all("text", F.lit(f"({NUMBER})"), 1)}).filter(F.size("nums") > 0).filter((F.length("shape") >= 50) & (F.length(F.regexp_replace("shape", "[# ]", "")) >= 40))
    groups = shaped.groupBy("shape").agg(F.countDistinct("doc").alias("docs"), F.countDistinct("nums").alias("variants"), F.max(F.struct("epoch", "doc", "line", "nums")).alias("new")).filter("docs >= 2 AND variants = 2")
    old = shaped.join(groups, "shape").filter((F.col("nums") != F.col("new.nums")) & (F.col("epoch") < F.col("new.epoch")) & (F.col("doc") != F.col("new.doc")))
    return old.select("doc", "line", F.col("new.doc").alias("other"), F.col("new.line").alias("other_line"))


def lost_terms(before: DataFrame, after: DataFrame) -> DataFrame:
    """Terms that a change removes and nothing defines any more."""
    return before.select("term").distinct().join(after.select("term"), "term", "left_anti")


def impact(lost: DataFrame, alive: DataFrame, lines: DataFrame) -> DataFrame:
    """(doc, line, term): document lines that name what a change removed and nothing else defines."""
    gone = lost_terms(lost, alive)
    tokens = lines.select("doc", "line", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"([A-Za-z_][A-Za-z0-9_]*)"), 1))).alias("term"))
    return tokens.join(gone, "term").select("doc", "line", "term")


def agent_cost(files: DataFrame) -> DataFrame:
    """What the instruction files for agents cost (path, text): tokens, lines and when they are read."""
    folder = dirname(F.col("path"))
    loaded = F.when((folder == "") | folder.isin(".github", ".claude"), F.lit("every session")).otherwise(F.concat(F.lit("when working in "), folder, F.lit("/")))
    lines = (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("long")
    return files.filter(is_agent_file(F.col("path"))).select("path", token_estimate(F.col("text")).alias("tokens"), lines.alias("lines"), loaded.alias("loaded"))


def impact_order(hits: DataFrame) -> DataFrame:
    """Hits (doc, line, term, kind) with `place`: plans last, then by document, line and term."""
    by_kind = F.row_number().over(Window.partitionBy(F.col("kind") == "plan").orderBy("doc", "line", "term"))
    return hits.withColumns({"late": F.col("kind") == "plan", "place": by_kind.cast("long")})


def cost_order(costs: DataFrame) -> DataFrame:
    """Costs (path, tokens, loaded): what every session reads first, then the largest."""
    return costs.orderBy(F.col("loaded") != "every session", F.desc("tokens"), "path")
