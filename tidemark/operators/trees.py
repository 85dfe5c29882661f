"""Drawn file trees: which blocks of a page draw one, what their entries are, and from which folder they are drawn.

A block that draws a tree has two lines with branches or more. It says nothing about this tree where it is a diagram of something else, or where its page tells
that it shows an example or the reader's own project. Entries are read from the place of their names, with a stack of the folders above. Nulls: a null heading, lead
or text after a block has no words; blocks without lines draw nothing; empty tables give empty tables.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import basename, dirname, joined
from ..functions.text import says

# Characters that trees and boxes are drawn with, languages of diagrams, words about diagrams and about projects that are not this one.
GLYPHS = " \t│├└─┬┼┊┆|`+"
CORNERS = "┌┐┏┓┗┛╭╮╰╯▼▲◀▶"
DIAGRAM_LANGUAGES = ["mermaid", "plantuml", "graphviz", "dot", "goat", "ditaa"]
FLOW_WORDS = ["flow", "workflow", "sequence", "lifecycle", "pipeline", "diagram", "process"]
ANSWERS = ["yes", "no", "true", "false"]
SUPPOSED = ["for example", "as an example", "suppose", "assuming", "scaffold", "the example above", "this example above", "the sample above", "this sample above"]
GIVEN = [f"{w} {that} {what} {drawn}" for w in ("with", "given", "consider") for that in ("this", "the following", "a") for what in ("content", "source", "file", "directory", "project") for drawn in ("structure", "tree", "layout")]
ABOVE = [f"{that} {what} above" for that in ("the", "this") for what in ("example", "sample")]
TREE_OF = [f"{a} {what} tree:" for a in ("a", "an") for what in ("file", "logical", "content")]
YOURS = ["project", "site", "content", "repository", "repo", "app"]
MAY = ["can", "could", "should", "may", "might", "must", "will"]
MAKE = [f"{also}{make}" for also in ("", "also ") for make in ("create", "scaffold")]
BY_MAKING = ["by creating", "by adding", "by generating", "by scaffolding"]
IS_A = ["is a file", "is an file", "is a directory", "is an directory"]
SKILL_SUBJECTS = ["authoring", "best practices", "patterns"]
SKILL_HINTS = ["patterns", "standards", "best practices", "test-driven", "cross-project", "across projects"]
SHOWN_HEADS = ["structure", "organization", "layout"]
SHOWN_THINGS = ["project", "file", "test", "directory", "folder", "skill"]
OPENING = 20  # lines in which a page says that it teaches how skills are written
BRANCHES = 2  # lines with branches that make a tree

BRANCH = r"[├└]|^\s*[|`+]--"
ARROW = r"[→⇒]|(?:^|[^-])--?>"


# ---------------------------------------------------------------- what a block is


def _texts(lines: Column) -> Column:
    """The lines of a block without remarks."""
    return F.transform(lines, lambda x: F.regexp_replace(x["text"], r"\s+#\s.*$", ""))


def branches(lines: Column) -> Column:
    return F.size(F.filter(lines, lambda x: x["text"].rlike(BRANCH)))


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\w-]+"), lambda w: w != "")


def is_diagram(lines: Column, heading: Column) -> Column:
    """Boxes, a bar with an arrow head beside or below it, questions with branches, branches that lead on to something, or arrows under a heading about a flow."""
    texts = _texts(lines)
    bare = F.transform(texts, lambda t: F.trim(t))
    boxed = F.exists(bare, lambda t: t.rlike(f"[{CORNERS}]") | t.rlike(r"^\+([-=]+\+)+$"))
    led = F.exists(bare, lambda t: t.rlike(r"^[|│]\s+[vV^↓↑]$")) | F.exists(F.arrays_zip(F.slice(bare, 1, F.greatest(F.size(bare) - 1, F.lit(0))).alias("a"), F.slice(bare, 2, F.greatest(F.size(bare), F.lit(0))).alias("b")), lambda p: p["a"].isin("|", "│") & F.lower(p["b"]).isin("v", "^", "↓", "↑"))
    asks = F.exists(bare, lambda t: t.endswith("?")) & F.exists(texts, lambda t: t.rlike(r"[├└]|^\s*[|+]--"))
    flows = says(F.coalesce(heading, F.lit("")), FLOW_WORDS) & F.exists(texts, lambda t: t.rlike(rf"[←→]|{ARROW}"))

    def leads_on(text: Column) -> Column:
        """A branch whose label, before its arrow, is no file's name: a remark of several words or with brackets, a question, or an answer."""
        label = F.regexp_replace(text, r"^[│| ]*(?:[├└][─-]+|\+--)\s*", "")
        first = F.trim(F.get(F.split(F.regexp_replace(label, ARROW, "\u0001"), "\u0001"), F.lit(0)))
        file_like = F.split(first, r"\s")[0].rlike(r"^[\w.@+~-]+(?:[/\\].*|\.[A-Za-z0-9]+)$")
        remark = F.contains(first, F.lit(" ")) | first.rlike(r"[()?]") | F.lower(first).isin(ANSWERS)
        return (label != text) & label.rlike(ARROW) & ~file_like & remark

    return F.coalesce(boxed | led | asks | flows | F.exists(texts, leads_on), F.lit(False))


def is_illustrative(lead: Column, heading: Column, after: Column, teaches: Column) -> Column:
    """Whether the text before or after a block, or a page that teaches how skills are written, makes it an example or the reader's own project."""
    before, following = F.coalesce(lead, F.lit("")), F.coalesce(after, F.lit(""))
    words = _words(before)
    yours = F.exists(F.sequence(F.lit(0), F.size(words)), lambda i: (F.get(words, i) == "your") & F.arrays_overlap(F.slice(words, i + 2, F.lit(4)), F.array(*(F.lit(w) for w in YOURS))))
    parts = F.split(before, r"[.!?\n]")
    may = [f"{who} {may}" for who in ("you", "we") for may in MAY]
    by_making = F.exists(parts, lambda s: says(s, may) & says(s, BY_MAKING))
    is_a = F.exists(parts, lambda s: says(s, ["a", "an"]) & says(s, IS_A) & ~F.lower(F.trim(s)).startswith("is a"))
    told = says(before, SUPPOSED + GIVEN + [f"{m} {k}" for m in may for k in MAKE]) | F.exists(F.array(*(F.lit(t) for t in TREE_OF)), lambda t: F.contains(F.regexp_replace(F.lower(before), r"\s+:", ":"), t))
    heads = _words(F.coalesce(heading, F.lit("")))
    things = F.array(*(F.lit(w) for w in SHOWN_THINGS))
    shown = F.exists(F.sequence(F.lit(0), F.size(heads)), lambda i: F.get(heads, i).isin(SHOWN_HEADS) & F.arrays_overlap(F.slice(heads, F.greatest(i - 1, F.lit(1)), F.when(i > 1, 2).otherwise(i)), things))
    pattern = says(F.coalesce(heading, F.lit("")), ["visual overview"]) | F.coalesce(heading, F.lit("")).rlike(r"(?i)\bpattern\s+\d")
    return told | F.coalesce(yours, F.lit(False)) | by_making | is_a | says(following, ABOVE) | (F.coalesce(teaches, F.lit(False)) & (F.coalesce(shown, F.lit(False)) | pattern))


def teaching_pages(docs: DataFrame) -> DataFrame:
    """Pages (doc) that teach how skills are written: docs (doc, path, text)."""
    opening = F.slice(F.split("text", r"\r\n|\n|\r"), 1, OPENING)
    whole = F.array_join(opening, "\n")
    about = F.exists(opening, lambda t: says(t, ["skill", "skills"]) & says(t, SKILL_SUBJECTS))
    return docs.filter(((F.lower(basename(F.col("path"))) == "skill.md") | about) & says(whole, SKILL_HINTS)).select("doc").distinct()


def drawn(fences: DataFrame, teaching: DataFrame) -> DataFrame:
    """Blocks (doc, start, lang, lines, heading, lead, after) that draw a tree, with `why`: what makes one say nothing about this tree (language, diagram, example), else null."""
    known = fences.filter(branches(F.col("lines")) >= BRANCHES).join(teaching.select("doc", F.lit(True).alias("_teaches")), "doc", "left")
    why = (
        F.when(F.col("lang").isin(DIAGRAM_LANGUAGES), "language")
        .when(is_illustrative(F.col("lead"), F.col("heading"), F.col("after"), F.col("_teaches")), "example")
        .when(is_diagram(F.col("lines"), F.col("heading")), "diagram")
    )
    return known.withColumn("why", why).drop("_teaches")


# ---------------------------------------------------------------- what it draws


def place_of_name(line: str) -> int:
    """Where the branches of a line end; a hyphen is one where another, a rule or a space follows."""
    at = 0
    while at < len(line) and (line[at] in GLYPHS or (line[at] == "-" and line[at + 1 : at + 2] in tuple("- ─"))):
        at += 1
    return at


def entry_name(text: str) -> str:
    """The name before any remark; empty for what is no name of a file: placeholders, descriptions, drawings."""
    name = re.split(r"\s{2,}|\t|\s(?:#|//|←|<-|–)\s?|—", text, maxsplit=1)[0].strip()
    if name.endswith(")") and " (" in name:
        name = name[: name.index(" (")].strip()
    drawing = any(c > "\x7f" and unicodedata.category(c) in ("So", "Sm") for c in name)
    placeholder = any(c in name for c in "<>{}*?$%|…") or "..." in name
    begins = name[:1].isalnum() or name[:1] in tuple("_.@+~-")
    return "" if drawing or placeholder or not begins or (" " in name and not name.endswith("/")) else name


def entries(lines: list[tuple[int, str]], folder: str = "") -> list[tuple[int, int, str, str, str, str]]:
    """(line, col, name, path, top, sub) of the entries that the lines (line, text) of a block draw; paths are relative to the page's folder `folder`.

    A folder alone at the left edge, first of all, is what the tree is drawn from: it is no entry, and none of the path when it is the page's own folder. `sub` is the path below `top`, the
    first folder; empty for the top itself. Entries whose name is none (see `entry_name`) go, and what is drawn below them belongs to the folder above.
    """
    shown = [(n, place_of_name(t), t) for n, t in lines if t.strip()]
    edge = [t for _, _, t in shown if t[0] not in GLYPHS and t[0] != "-"]
    out, stack, base = [], [], None
    for k, (n, at, text) in enumerate(shown):
        name = entry_name(text[at:])
        plain = name.rstrip("/")
        if k == 0 and at == 0 and name.endswith("/") and len(edge) == 1:
            base = "" if plain.rsplit("/", 1)[-1].lower() == folder.rsplit("/", 1)[-1].lower() else plain
            continue
        while stack and stack[-1][0] >= at:
            stack.pop()
        if not plain:
            continue
        above = stack[-1][1] if stack else base or ""
        path = "/".join(p for p in (above, "" if plain == "." else plain) if p)
        stack.append((at, path))
        top = base if base is not None else stack[0][1]
        sub = path[len(top) + 1 :] if top and path.startswith(f"{top}/") else "" if path == top else path
        if path:
            out.append((n, at + 1, name, path + ("/" if name.endswith("/") else ""), top, sub))
    return out


ENTRIES = "doc string, line int, col int, text string, path string, top string, sub string"


def tree_entries(blocks: DataFrame) -> DataFrame:
    """(doc, line, col, text, path, top, sub): the entries of the blocks (doc, folder, lines); see `entries`. A path of a folder ends with a slash where its name does."""

    def of(batches):
        for batch in batches:
            rows = [(doc, *e) for doc, folder, lines in zip(batch["doc"], batch["folder"], batch["lines"], strict=True) for e in entries([(x["line"], x["text"]) for x in lines], folder or "")]
            yield pd.DataFrame(rows, columns=["doc", "line", "col", "text", "path", "top", "sub"])

    return blocks.select("doc", "folder", "lines").mapInPandas(of, ENTRIES)


# ---------------------------------------------------------------- from where it is drawn


def _ends(top: Column) -> Column:
    """What is left of a top folder when its first names are cut off, one more each time; the last is empty."""
    parts = F.split(top, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i + 1, F.size(parts)), "/"))


def rebased(drawn_: DataFrame, there: DataFrame, ever: DataFrame) -> DataFrame:
    """Entries (repo, doc, folder, line, path, top, sub, ...) as seen from this tree: a tree drawn from the folder that holds it has its top cut shorter.

    That is so where at least two entries lie below the top, fewer than half of them are there (repo, candidate), none ever was (ever: repo, candidate), and with the
    first names of the top cut off at least half of them are, and more than before. Of several cuts the one with most entries there counts, then the shorter cut, then the page's folder before
    the root. The entry of the top itself, which is the clone's folder, then goes.
    """
    key = ["repo", "doc", "top"]
    kids = drawn_.filter("sub <> ''").select(*key, "folder", F.regexp_replace("sub", "/$", "").alias("sub")).distinct()
    here, root = F.col("folder"), F.lit("")
    option = lambda k, place, base: F.struct(F.lit(k).alias("k") if isinstance(k, int) else k.alias("k"), F.lit(place).alias("place"), base.alias("base"))
    own = F.array(*(option(0, p, joined(f, F.col("top"))) for p, f in enumerate((here, root))))
    cuts = F.flatten(F.transform(_ends(F.col("top")), lambda e, i: F.array(*(option((i + 1).cast("int"), p, joined(f, e)) for p, f in enumerate((here, root))))))
    tried = kids.select(*key, "sub", F.explode(F.concat(own, cuts)).alias("o")).select(*key, "sub", "o.*").withColumn("candidate", joined(F.col("base"), F.col("sub")))
    known = tried.join(there.select("repo", "candidate", F.lit(1).alias("hit")).distinct(), ["repo", "candidate"], "left").join(ever.select("repo", "candidate", F.lit(1).alias("past")).distinct(), ["repo", "candidate"], "left")
    count = known.groupBy(*key, "k", "place").agg(F.count(F.lit(1)).alias("kids"), F.count("hit").alias("hits"), F.count("past").alias("past"))
    as_drawn = count.filter("k = 0").groupBy(*key).agg(F.max("kids").alias("kids"), F.max("hits").alias("own"), F.max("past").alias("past")).filter("kids >= 2 AND own * 2 < kids AND past = 0")
    best = count.filter("k > 0").groupBy(*key).agg(F.min(F.struct((-F.col("hits")).alias("m"), "k", "place")).alias("b"))
    cut = as_drawn.join(best, key).filter("-b.m > own AND -b.m * 2 >= kids").select(*key, F.col("b.k").alias("_k"))
    moved = drawn_.join(cut, key, "left")
    end = F.get(_ends(F.col("top")), F.col("_k") - 1)
    path = F.when(F.col("_k").isNull(), F.col("path")).otherwise(F.concat_ws("/", F.when(end != "", end), "sub"))
    slash = F.when(F.col("path").endswith("/") & ~path.endswith("/"), F.concat(path, F.lit("/"))).otherwise(path)
    return moved.filter("_k IS NULL OR sub <> ''").withColumn("path", slash).drop("_k")
