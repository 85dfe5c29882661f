"""Decision logs: which decisions there are, what became of them, and who mentions them.

A log is a page with a table of decisions, or a folder with a page for each (ADR). A row or page says its own status; later rows may say that they replace
earlier ones. A log counts for the documents below the folder that it is about.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import ancestors, basename
from ..staging import staged

# Names of logs and of the folders that hold them, and the words of both languages by which a status is told.
LOG_NAMES = "decision decisions decision-log decision_log decisionlog decisions-log decisions_log decisionslog adr-log adr_log adrlog adr adrs quyet-dinh quyet_dinh quyetdinh".split()
ADR_FOLDERS = ["adr", "adrs", "decisions", "decision-records", "architecture/decisions"]
WRAPPERS = "docs doc adr adrs decisions decision-records architecture".split()
REPLACED = ["superseded", "replaced by", "obsolete", "withdrawn", "revoked", "bị thay", "đã bỏ", "đã hủy", "deprecated"]
IN_PART = ["bị thay một phần", "bị thay 1 phần", "partially superseded", "partly superseded", "superseded in part", "amended by", "sửa một phần"]
REPLACES = ["supersedes", "replaces", "overrides", "thay cho", "thay thế", "thay", "sửa", "đè"]
STATUS_HEADS = ["status", "trạng thái", "state", "tình trạng"]
LEAD = 12  # letters before a word of REPLACED, up to which it is the status and not a remark
SHORT_ROW = 300  # letters of a row whose whole text may tell its status

ID = r"([A-Z]{1,6})-?(\d{1,5})"
KEY = ["log", "id"]


def one_of(words: list[str]) -> str:
    """A pattern for one of these phrases by itself, letter case aside, in any script."""
    return r"(?iu)(?<![\p{L}\p{N}_])(?:" + "|".join(re.escape(w).replace(r"\ ", r"\s+") for w in words) + r")(?![\p{L}\p{N}_])"


def refs(text: Column, own: Column) -> Column:
    """Ids that a text names, in order and without `own`, numbers without leading zeros."""
    ids = F.regexp_extract_all(text, F.lit(rf"(?<!\w){ID}(?!\w)"), F.lit(0))
    return F.filter(F.array_distinct(F.transform(ids, normal)), lambda x: x != own)


def normal(ref: Column) -> Column:
    return F.concat(F.upper(F.regexp_extract(ref, "^([A-Za-z]+)", 1)), F.regexp_extract(ref, r"(\d+)", 1).cast("long").cast("string"))


def told_status(text: Column) -> Column:
    """superseded, amended or active, from the text of a status."""
    # "superseded", but in part: that is told by the phrases of IN_PART alone
    whole = one_of(REPLACED).replace("superseded", r"superseded(?![^.;]*(?:in part|partly|partially))").replace(r"bị\s+thay|", r"bị\s+thay(?!\s*(?:một phần|1 phần))|")
    at = F.regexp_instr(text, F.lit(whole))
    lead = F.regexp_replace(F.regexp_replace(F.substring(text, F.lit(1), at - 1), r"[*_`(\[]", ""), r"^[ :;,.-]+|[ :;,.-]+$", "")
    return F.when(text.rlike(one_of(IN_PART)), "amended").when(at > 0, F.when(F.length(lead) <= LEAD, "superseded").otherwise("amended")).otherwise("active")


def cells_of(row: Column) -> Column:
    """Cells of a table row; bars behind a backslash are none."""
    inner = F.regexp_replace(F.trim(row), r"^\||(?<!\\)\|$", "")
    return F.transform(F.split(inner, r"(?<!\\)\|"), F.trim)


def is_log(path: Column) -> Column:
    return F.regexp_replace(F.lower(basename(path)), r"\.(md|markdown)$", "").isin(LOG_NAMES) & F.lower(path).rlike(r"\.(md|markdown)$")


def table_decisions(lines: DataFrame) -> DataFrame:
    """(log, line, id, status, by, replaces) of the rows whose first cell is an id, of logs with two such rows or more: lines (doc, path, line, text).

    The status stands in a cell below a header that says so. Rows of another shape tell it by a bold mark, which never replaces more than a part, or if they are
    short by their text. Rows that a paragraph has cut off from their table count too.
    """
    bars = lines.filter(is_log(F.col("path"))).filter(F.ltrim("text").startswith("|")).withColumns({"cells": cells_of(F.col("text")), "line": F.col("line").cast("int")})
    by = Window.partitionBy("doc").orderBy("line")
    rule = F.forall("cells", lambda c: c.rlike("^:?-+:?$"))
    # a header is the row above a row of dashes that follows at once
    heads = bars.withColumn("head", F.when(F.lead(rule).over(by) & (F.lead("line").over(by) == F.col("line") + 1), F.col("cells")))
    known = heads.withColumn("head", F.last("head", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1)))
    first = F.regexp_replace(F.get("cells", F.lit(0)), r"^[\s*]+|[\s*]+$", "")
    rows = known.withColumn("ref", first).filter(F.col("ref").rlike(rf"^{ID}[a-z]?$")).withColumn("id", normal(F.col("ref")))
    rows = rows.withColumn("rows", F.count(F.lit(1)).over(Window.partitionBy("doc"))).filter("rows >= 2")
    head = F.coalesce("head", F.array().cast("array<string>"))
    marks = F.transform(head, lambda h: h.rlike("(?iu)" + "|".join(STATUS_HEADS)))
    place = F.size(marks) - F.array_position(F.reverse(marks), True).cast("int")  # of the last such header
    told = F.when(F.array_contains(marks, True) & (F.size("cells") == F.size(head)), F.get("cells", place))
    flat = F.array_join("cells", " ")
    bold = F.regexp_extract(flat, r"(\*\*[^*]*" + one_of(REPLACED + IN_PART) + r"[^*]*\*\*.{0,200})", 1)
    short = F.when(F.length(flat) < SHORT_ROW, flat).otherwise("")
    status = F.when(told.isNotNull(), told_status(told)).when(bold != "", "amended").otherwise(told_status(short))
    text = F.when(told.isNotNull(), told).when(bold != "", bold).otherwise(short)
    named = rows.withColumns({"status": status, "_t": text}).withColumn("by", F.when(F.col("status") == "active", F.array().cast("array<string>")).otherwise(refs(F.col("_t"), F.col("id"))))
    chain = F.regexp_extract_all(flat, F.lit(rf"{one_of(REPLACES)}\s+((?:[A-Z]{{1,6}}-?\d{{1,5}}(?:\s*(?:,|và|and|&)\s*)?)+)"), 1)
    return named.select(F.col("doc").alias("log"), "path", "line", "id", "status", "by", refs(F.array_join(chain, " "), F.col("id")).alias("replaces"))


def adr_decisions(lines: DataFrame) -> DataFrame:
    """(log, line, id, status, by, replaces) of the pages of ADR folders: lines (doc, path, line, text). The folder is the log; a page without a status is active."""
    pattern = rf"(?i)(?:^|/)(?:{'|'.join(ADR_FOLDERS)})/(\d{{1,5}})[-_][^/]+\.md$"
    pages = lines.withColumn("number", F.regexp_extract("path", pattern, 1)).filter("number <> ''")
    low = F.lower(F.trim("text"))
    own, head = low.rlike(r"^(?:[*-]\s+)?\**status\**:"), low.rlike(r"^#+\s*status\b")
    by = Window.partitionBy("doc").orderBy("line")
    under = F.last(F.when(head, F.col("line")), ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1))
    placed = pages.withColumns({"own": own, "under": F.when(~head & (F.trim("text") != ""), under)})
    told = F.when(F.col("own") | (F.col("line") - F.col("under") <= 5), F.struct("line", "text"))
    one = placed.groupBy("doc", "path", "number").agg(F.min(told).alias("t"))
    text = F.coalesce("t.text", F.lit(""))
    id_ = F.concat(F.lit("ADR"), F.col("number").cast("long").cast("string"))
    out = one.select(F.regexp_replace("doc", "/?[^/]*$", "").alias("log"), "path", F.lit(1).alias("line"), id_.alias("id"), told_status(text).alias("status"), text.alias("_t"))
    none = F.array().cast("array<string>")
    return out.withColumn("by", F.when(F.col("status") == "active", none).otherwise(refs(F.col("_t"), F.col("id")))).drop("_t").withColumn("replaces", none)


def decisions(lines: DataFrame) -> DataFrame:
    """(log, path, line, id, status, by) of all logs. The first row of an id in a log counts; an active decision that another row says it replaces is amended by that one."""
    both = staged(table_decisions(lines).unionByName(adr_decisions(lines)), "decisions")
    first = both.withColumn("_n", F.row_number().over(Window.partitionBy(*KEY).orderBy("line", "path"))).filter("_n = 1").drop("_n")
    later = both.select("log", F.explode("replaces").alias("id"), F.struct("line", F.col("id").alias("by")).alias("x")).groupBy(*KEY).agg(F.transform(F.sort_array(F.collect_set("x")), lambda x: x["by"]).alias("later"))
    told = first.join(later, KEY, "left")
    changed = (F.col("status") == "active") & F.col("later").isNotNull()
    names = F.when(F.col("status") == "superseded", F.col("by")).otherwise(F.array_distinct(F.concat("by", F.coalesce("later", F.array().cast("array<string>")))))
    return told.select("log", "path", "line", "id", F.when(changed, "amended").otherwise(F.col("status")).alias("status"), names.alias("by"))


def standing(known: DataFrame) -> DataFrame:
    """(log, id, now): the decision that stands in the place of a superseded one, by way of all that came between. Each round doubles the way, and rounds end when no way grows.

    Decisions that replace each other in a circle have none.
    """
    next_ = known.filter("status = 'superseded' AND size(by) > 0").select("log", "id", F.get("by", F.lit(0)).alias("now"), F.lit(1).alias("steps"))
    ways = staged(next_.filter("id <> now"), "ways")
    most = ways.count()
    reach = 1
    while reach <= most:
        further = ways.select("log", F.col("id").alias("now"), F.col("now").alias("_then"), F.col("steps").alias("_more"))
        grown = staged(ways.join(further, ["log", "now"], "left").select("log", "id", F.coalesce("_then", "now").alias("now"), (F.col("steps") + F.coalesce("_more", F.lit(0))).alias("steps")), "ways")
        if not grown.join(ways.select("log", "id", F.col("now").alias("_was")), KEY).filter("now <> _was").take(1):
            break
        ways, reach = grown, 2 * reach
    # what still leads on after as many steps as there are decisions goes round in a circle
    return ways.join(next_.select("log", F.col("id").alias("now")), ["log", "now"], "left_anti").select("log", "id", "now")


def scope(log: Column) -> Column:
    """The folder that a log is about: the nearest above it that is not one for documents or decisions."""
    up = F.filter(ancestors(log), lambda f: (f == "") | ~F.lower(F.element_at(F.split(f, "/"), -1)).isin(WRAPPERS))
    return F.get(up, F.lit(0))


def mentions(lines: DataFrame, known: DataFrame, id_style: str = r"(?<![A-Za-z0-9_/.-])(ADR[- ]?\d{1,5}|[A-Z]{1,6}-?\d{1,5})(?![A-Za-z0-9_])") -> DataFrame:
    """(doc, line, text, id, status, by, log): ids that lines (repo, doc, path, line, text) name, in the style of a log that counts for them: what the nearest such log says of them, null where none knows them.

    known (repo, log, folder: the log's, path, line, id, status, by). The row of a decision does not mention itself.
    """
    said = lines.select("repo", "doc", "path", "line", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(id_style), 1))).alias("text"))
    said = said.withColumns({"id": normal(F.col("text")), "prefix": F.upper(F.regexp_extract("text", "^([A-Za-z]+)", 1))})
    said = said.join(known.select("repo", "path", "line", "id"), ["repo", "path", "line", "id"], "left_anti")
    logs = known.select("repo", "log", "folder", F.regexp_extract("id", "^([A-Z]+)", 1).alias("prefix")).distinct()
    up = said.select("*", F.posexplode(F.array_distinct(ancestors(F.col("path")))).alias("far", "folder"))
    near = up.join(logs, ["repo", "folder", "prefix"])
    found = near.join(known.select("repo", "log", "id", "status", "by"), ["repo", "log", "id"], "left")
    best = F.min(F.struct(F.col("status").isNull().alias("none"), "far", "log", "status", "by")).alias("b")
    return found.groupBy("repo", "doc", "path", "line", "text", "id").agg(best).select("repo", "doc", "path", "line", "text", "id", "b.status", "b.by", "b.log")
