"""Structure of Markdown lines by windows: fences, headings, tables, runs of stray rows, ignored ranges, code spans, links.

Input is a table of lines (doc, line, text). What only a sequential reading gets exactly right is in markdown.py.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FENCE = r"^\s{0,3}(?:```|~~~)"


def by_doc() -> Window:
    return Window.partitionBy("doc").orderBy("line")


def so_far() -> Window:
    return by_doc().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def explode_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, line, text) with lines from 1."""
    return docs.select(F.col(id_col).alias("doc"), F.posexplode(F.split(text_col, "\n")).alias("pos", "text")).select("doc", (F.col("pos") + 1).cast("long").alias("line"), "text")


def with_fences(lines: DataFrame) -> DataFrame:
    """`fence`: the number of the fence block a line is in (its marks included), null outside."""
    mark = F.col("text").rlike(FENCE).cast("long")
    marked = lines.withColumns({"_mark": mark, "_seen": F.sum(mark).over(so_far())})
    return marked.withColumn("fence", F.when((F.col("_seen") % 2 == 1) | (F.col("_mark") == 1), F.floor((F.col("_seen") + 1) / 2).cast("long"))).drop("_mark", "_seen")


def headings(lines: DataFrame) -> DataFrame:
    """(doc, line, level, title) of ATX headings outside of fences."""
    title = F.regexp_replace(F.regexp_extract("text", r"^\s{0,3}#{1,6}\s+(.*)$", 1), r"\s*#*\s*$", "")
    return with_fences(lines).filter("fence IS NULL").filter(F.col("text").rlike(r"^\s{0,3}#{1,6}\s+")).select("doc", "line", F.length(F.regexp_extract("text", r"^\s{0,3}(#{1,6})", 1)).cast("long").alias("level"), title.alias("title"))


def numbered_slugs(heads: DataFrame, slug: Column) -> DataFrame:
    """`anchor`: the slug, from the second of a document on with -1, -2 and so on."""
    nth = F.row_number().over(Window.partitionBy("doc", "_slug").orderBy("line")) - 1
    return heads.withColumn("_slug", slug).withColumn("_n", nth).withColumn("anchor", F.when(F.col("_n") == 0, F.col("_slug")).otherwise(F.concat("_slug", F.lit("-"), "_n"))).drop("_n", "_slug")


def heading_numbers(heads: DataFrame) -> DataFrame:
    """`number`: 1. for second-level headings, 1.2 for third-level ones below."""
    at = Window.partitionBy("doc").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    h2 = F.sum((F.col("level") == 2).cast("long")).over(at)
    inner = Window.partitionBy("doc", "_h2").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    two = heads.filter("level IN (2, 3)").withColumn("_h2", h2)
    return two.withColumn("number", F.when(F.col("level") == 2, F.concat("_h2", F.lit("."))).otherwise(F.concat_ws(".", F.col("_h2"), F.sum((F.col("level") == 3).cast("long")).over(inner)))).drop("_h2")


def cells(text: Column) -> Column:
    """Cells of a table row: outer bars do not count."""
    inner = F.regexp_replace(F.regexp_replace(F.trim(text), r"^\|", ""), r"\|$", "")
    return F.split(inner, r"(?<!\\)\|")


def tables(lines: DataFrame) -> DataFrame:
    """Rows that begin with a bar: `block` numbers runs of them; `head` is the line of the run's header if its second row is a delimiter; `cells` counts."""
    rows = with_fences(lines).filter("fence IS NULL").filter(F.col("text").rlike(r"^\s*\|")).drop("fence").withColumn("_gap", (F.col("line") - F.lag("line", 1, -1).over(by_doc()) > 1).cast("long"))
    run = rows.withColumn("block", F.sum("_gap").over(so_far()))
    inside = Window.partitionBy("doc", "block").orderBy("line")
    delimiter = F.forall(cells(F.col("text")), lambda c: F.trim(c).rlike("^:?-+:?$"))
    numbered = run.withColumns({"cells": F.size(cells(F.col("text"))).cast("long"), "delimiter": delimiter, "nth": F.row_number().over(inside).cast("long"), "_two": F.row_number().over(inside) == 2})
    whole = Window.partitionBy("doc", "block")
    headed = F.max(F.col("_two") & F.col("delimiter")).over(whole)
    first = F.min("line").over(whole)
    width = F.max(F.when(F.col("nth") == 1, F.col("cells"))).over(whole)
    return numbered.withColumns({"head": F.when(headed, first), "width": F.when(headed, width)}).drop("_gap", "_two")


def odd_rows(lines: DataFrame) -> DataFrame:
    """Tables some of whose rows have another number of cells than the header: (doc, head, width, bad, rows, most: the most frequent other number)."""
    body = tables(lines).filter("head IS NOT NULL AND nth > 2")
    per = body.groupBy("doc", "head", "width", "cells").agg(F.count(F.lit(1)).alias("n"))
    bad = F.col("cells") != F.col("width")
    out = per.groupBy("doc", "head", "width").agg(F.sum(F.when(bad, F.col("n")).otherwise(0)).alias("bad"), F.sum("n").alias("rows"), F.min_by(F.when(bad, F.col("cells")), F.when(bad, F.struct(-F.col("n"), F.col("cells")))).alias("most"))
    return out.filter("bad > 0")


def stray_runs(lines: DataFrame) -> DataFrame:
    """Two or more bar rows outside of all tables, at most one line apart: (doc, first, last, rows)."""
    stray = tables(lines).filter("head IS NULL AND cells >= 2").select("doc", "line")
    gap = (F.col("line") - F.lag("line", 1, -10).over(by_doc()) > 2).cast("long")
    island = stray.withColumn("_gap", gap).withColumn("run", F.sum("_gap").over(so_far()))
    return island.groupBy("doc", "run").agg(F.min("line").alias("first"), F.max("line").alias("last"), F.count(F.lit(1)).alias("rows")).filter("rows >= 2").drop("run")


def last_table_above(runs: DataFrame, tables_: DataFrame) -> DataFrame:
    """For each stray run the header of the last table that begins above it, by one window over runs and headers together."""
    heads = tables_.filter("head IS NOT NULL").select("doc", F.col("head").alias("line")).distinct().withColumns({"head": F.col("line"), "first": F.lit(None).cast("long"), "rows": F.lit(None).cast("long")})
    both = runs.select("doc", F.col("first").alias("line"), F.lit(None).cast("long").alias("head"), "first", "rows").unionByName(heads)
    return both.withColumn("above", F.last("head", ignorenulls=True).over(so_far())).filter("first IS NOT NULL").select("doc", "first", "rows", "above")


def directives(lines: DataFrame, word: str = "tidemark") -> DataFrame:
    """(doc, line, body) of the comments that address this tool."""
    body = F.regexp_extract("text", rf"(?i)<!--\s*{word}\s*:\s*(.*?)\s*-->", 1)
    return lines.select("doc", "line", body.alias("body")).filter("body <> ''")


def ignored_lines(lines: DataFrame, word: str = "tidemark") -> DataFrame:
    """Lines in ignored ranges: the last start or end at or above a line is a start."""
    state = F.when(F.col("text").rlike(rf"(?i)<!--\s*{word}\s*:\s*ignore-start\s*-->"), 1).when(F.col("text").rlike(rf"(?i)<!--\s*{word}\s*:\s*ignore-end\s*-->"), 0)
    return lines.withColumn("_state", F.last(state, ignorenulls=True).over(so_far())).filter("_state = 1").drop("_state")


def code_spans(lines: DataFrame) -> DataFrame:
    """(doc, line, nth, code) of single-backtick spans outside of fences."""
    found = F.regexp_extract_all("text", F.lit(r"`([^`]+)`"), 1)
    return with_fences(lines).filter("fence IS NULL").select("doc", "line", F.posexplode(found).alias("nth", "code")).withColumn("nth", F.col("nth").cast("long"))


def links(lines: DataFrame) -> DataFrame:
    """(doc, line, label, dest) of inline links outside of fences and code."""
    masked = F.regexp_replace("text", r"`[^`]+`", "")
    pattern = r"\[[^\[\]]*\]\([^)\s]+\)"
    found = F.regexp_extract_all(masked, F.lit(f"({pattern})"), 1)
    out = with_fences(lines).filter("fence IS NULL").select("doc", "line", F.explode(found).alias("m"))
    return out.select("doc", "line", F.regexp_extract("m", r"^\[([^\]]*)\]", 1).alias("label"), F.regexp_extract("m", r"\(([^)]*)\)$", 1).alias("dest"))


def after_front_matter(lines: DataFrame) -> DataFrame:
    """Drops the lines of a front matter: from a first line --- to the next one, if there is one in the first 200 lines."""
    close = F.min(F.when((F.col("line") > 1) & (F.col("line") <= 200) & F.trim("text").isin("---", "..."), F.col("line"))).over(Window.partitionBy("doc"))
    opens = F.max((F.col("line") == 1) & (F.trim("text") == "---")).over(Window.partitionBy("doc"))
    return lines.withColumns({"_open": opens, "_close": close}).filter("NOT (_open AND _close IS NOT NULL AND line <= _close)").drop("_open", "_close")


def sections(lines: DataFrame) -> DataFrame:
    """(doc, start, end, title): stretches from a heading of level 1 to 3 to the line before the next; what stands before the first has the document's name as title."""
    heads = headings(lines).filter("level <= 3").select("doc", F.col("line").alias("start"), "title")
    ends = lines.groupBy("doc").agg(F.max("line").alias("lines"))
    top = ends.join(heads.filter("start = 1").select("doc"), "doc", "left_anti").select("doc", F.lit(1).cast("long").alias("start"), F.col("doc").cast("string").alias("title"))
    all_ = heads.unionByName(top).join(ends, "doc")
    end = F.coalesce(F.lead("start").over(Window.partitionBy("doc").orderBy("start")) - 1, F.col("lines"))
    return all_.select("doc", "start", end.alias("end"), "title").filter(F.col("end") >= F.col("start"))


def sticky_heading(lines: DataFrame) -> DataFrame:
    """Each line with the title of the last heading above it."""
    title = F.when(F.col("text").rlike(r"^\s{0,3}#{1,6}\s+"), F.regexp_extract("text", r"^\s{0,3}#{1,6}\s+(.*)$", 1))
    return lines.withColumn("under", F.last(title, ignorenulls=True).over(so_far()))
