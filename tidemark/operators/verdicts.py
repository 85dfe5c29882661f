"""What a claim that does not hold was: there when its line was written, there at another time, never there; and what speaks against telling."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.paths import basename, dirname, normalise, suffixes
from ..functions.text import is_acknowledged, is_past, says
from .history import gone_by, state_as_of
from .inventory import is_generated, is_private
from .similar import close_matches

# Words that make a sentence speak of examples, of things to make, of things that may be there, and of things that are not.
EXAMPLE_WORDS = ["for example", "for instance", "e.g.", "such as", "i.e.", "like this"]
CREATION_WORDS = ["create", "creates", "creating", "add", "adds", "generate", "generates", "generated", "write", "writes", "written", "save", "saves", "saved", "output", "outputs", "produces", "build", "builds", "copy", "rename"]
CONDITION_WORDS = ["if", "when present", "if present", "optional", "optionally", "may", "might", "can", "could", "unless"]
ABSENCE_WORDS = ["does not exist", "doesn't exist", "do not exist", "don't exist", "no such", "not exist", "missing", "absent"]
WEB_ROUTES = "issues issue pulls pull releases wiki discussions actions commits commit compare tree blob security projects milestones labels".split()
TEMPLATE_FOLDERS = "template templates scaffold scaffolds boilerplate boilerplates".split()
LANGUAGES = "ar bn cs da de el en es et fa fi fr he hi hu id it ja ko nb nl no pl pt ru sv th tr uk ur vi zh".split()
MODULE_FORMS = ["{}.py", "{}/__init__.py", "{}/__main__.py", "src/{}.py", "src/{}/__main__.py"]


# ---------------------------------------------------------------- proof by history


def against_history(questions: DataFrame, events: DataFrame) -> DataFrame:
    """Questions (path, written, ...) with `then` (there when the line was written), `now`, `ever`, and the first deletion after it (gone, gone_commit).

    A question without `written` is of a line that no commit has yet: `then` is null.
    """
    own = questions.columns
    asked = state_as_of(questions, events).withColumn("then", F.when(F.col("written").isNotNull(), F.coalesce(F.col("state") != "D", F.lit(False)))).drop("state")
    per = events.groupBy("path").agg((F.max_by("kind", F.struct("epoch", "commit")) != "D").alias("now"), (F.count_if(F.col("kind") != "D") > 0).alias("ever"))
    gone = gone_by(questions.select("path", "written").filter("written IS NOT NULL").distinct(), events)
    known = asked.join(per, "path", "left").join(gone, ["path", "written"], "left")
    return known.select(*own, "then", F.coalesce("now", F.lit(False)).alias("now"), F.coalesce("ever", F.lit(False)).alias("ever"), "gone", "gone_commit")


def path_rules(judged: DataFrame) -> DataFrame:
    """Rule and severity of paths that are not in the tree (see `against_history`); no proof, no finding: what never was is left to `path-missing`.

    `names_target` says that the line names where the path went, `agent` that the document instructs agents.
    """
    rule = (
        F.when(F.col("then").isNull() & F.col("now"), "path-removed-now").when(F.coalesce("then", F.lit(False)), "path-moved").when(F.col("ever"), "path-gone").otherwise("path-missing")
    )
    severity = (
        F.when(F.col("rule") == "path-removed-now", "error")
        .when(F.col("rule") == "path-moved", F.when(F.col("names_target"), "info").otherwise("error"))
        .when(F.col("rule") == "path-gone", F.when(F.col("names_target"), "info").otherwise("warning"))
        .otherwise(F.when(F.col("agent"), "warning").otherwise("info"))
    )
    return judged.withColumn("rule", rule).withColumn("severity", severity)


def name_events(blobs: DataFrame) -> DataFrame:
    """(path, epoch, commit, kind) of names, `path` being the name: A when the first file has it, D when the last one loses it. blobs (path, epoch, commit, names: empty where the file goes)."""
    before = F.coalesce(F.lag("names").over(Window.partitionBy("path").orderBy("epoch", "commit")), F.array().cast("array<string>"))
    moved = F.concat(
        F.transform(F.array_except("names", "_b"), lambda n: F.struct(n.alias("name"), F.lit(1).alias("d"))),
        F.transform(F.array_except("_b", "names"), lambda n: F.struct(n.alias("name"), F.lit(-1).alias("d"))),
    )
    # one row for each name and commit: what several files gain and lose in it is summed
    each = blobs.withColumn("_b", before).select("epoch", "commit", F.explode(moved).alias("m")).groupBy(F.col("m.name").alias("path"), "epoch", "commit").agg(F.sum("m.d").alias("d"))
    n = F.sum("d").over(Window.partitionBy("path").orderBy("epoch", "commit").rowsBetween(Window.unboundedPreceding, 0))
    kind = F.when((F.col("n") > 0) & (F.col("n") - F.col("d") <= 0), "A").when((F.col("n") <= 0) & (F.col("n") - F.col("d") > 0), "D")
    return each.withColumn("n", n).withColumn("kind", kind).filter("kind IS NOT NULL").select("path", "epoch", "commit", "kind")


def gone_names(questions: DataFrame, events: DataFrame, rule: str, rule_now: str) -> DataFrame:
    """Names (path, written, ...) that the code had when the line was written and has no more, with rule and severity; for lines without commit, those that the last commit has."""
    judged = against_history(questions, events)
    hit = F.when(F.col("then").isNull() & F.col("now"), rule_now).when(F.col("then") & ~F.col("now"), rule)
    return judged.withColumn("rule", hit).filter("rule IS NOT NULL").withColumn("severity", F.lit("warning")).select(*questions.columns, "rule", "severity", "gone", "gone_commit")


def ever_existed(claims: DataFrame, events: DataFrame) -> DataFrame:
    """(doc, line, target, path): the one path of the history that ends with the target; several prove nothing."""
    ends = events.select("path").distinct().select("path", F.explode(suffixes(F.lower("path"))).alias("_end"))
    hit = claims.withColumn("_end", F.lower("target")).join(ends, "_end")
    return hit.groupBy("doc", "line", "target").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("path")).filter("n = 1").drop("n")


def rename_hints(gone: DataFrame, names: DataFrame, least: float = 0.75) -> DataFrame:
    """(path, name, hint): the most similar name of the same file for one that is gone."""
    best = close_matches(gone.select(F.col("path").alias("group"), F.col("name").alias("wanted")), names.select(F.col("path").alias("group"), "name").join(gone.select(F.col("path").alias("group"), "name"), ["group", "name"], "left_anti"), least, 1)
    return best.select(F.col("group").alias("path"), F.col("wanted").alias("name"), F.col("name").alias("hint"))


def package_left(names: DataFrame, manifests: DataFrame, pins: DataFrame) -> DataFrame:
    """Names (path, name, package) whose package's manifest is gone while another manifest still depends on it: manifests (package, alive), pins (package)."""
    gone = manifests.groupBy("package").agg(F.max("alive").alias("alive")).filter("NOT alive").select("package")
    return names.join(gone, "package", "left_semi").join(pins.select("package").distinct(), "package", "left_semi")


def words_at(blobs: DataFrame, names: DataFrame) -> DataFrame:
    """(rev, name, path, line, defined): where a name stands in the code at a commit: a line that defines it before one that uses it, then by path and line. blobs (rev, path, line, text), names (rev, name)."""
    tokens = blobs.select("rev", "path", "line", "text", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"([A-Za-z_][A-Za-z0-9_]*)"), 1))).alias("name"))
    defined = F.expr(r"text RLIKE concat('(?:def|class|function|func|fn|struct|enum|interface|trait|const|let|var|type)\\s+', name, '\\b')")
    hit = tokens.join(names.distinct(), ["rev", "name"]).withColumn("defined", defined)
    best = F.struct((~F.col("defined")).alias("u"), "path", "line")
    return hit.groupBy("rev", "name").agg(F.min(best).alias("b")).select("rev", "name", "b.path", "b.line", (~F.col("b.u")).alias("defined"))


def lost_headings(versions: DataFrame) -> DataFrame:
    """(path, heading, epoch): headings that a page had in the version before and not in this one, at the last time. versions (path, epoch, headings)."""
    before = F.lag("headings").over(Window.partitionBy("path").orderBy("epoch"))
    lost = versions.withColumn("_b", before).select("path", "epoch", F.explode(F.array_except("_b", "headings")).alias("heading"))
    return lost.groupBy("path", "heading").agg(F.max("epoch").alias("epoch"))


# ---------------------------------------------------------------- what speaks against telling


def may_be_told(text: Column, path: Column) -> Column:
    """Whether a path that never was may be called missing: its sentence neither gives an example, nor makes the thing, nor doubts it, nor says itself that it is gone; and the path is of the tree's own."""
    doubtful = says(text, EXAMPLE_WORDS + CREATION_WORDS + CONDITION_WORDS + ABSENCE_WORDS) | is_acknowledged(text) | is_past(text)
    return ~(doubtful | is_private(path) | is_generated(path))


def translated_pages(docs: DataFrame) -> DataFrame:
    """Paths of translations: a language behind the name (README-ja.md, guide.fr.md), or a language folder that has a sibling language folder."""
    behind = F.regexp_extract(F.lower(basename(F.col("path"))), r"[-_.]([a-z]{2})(?:[-_][a-z]{2})?\.[a-z]+$", 1)
    part = F.split("path", "/")
    each = docs.select("path", F.posexplode(F.slice(part, 1, F.size(part) - 1)).alias("i", "name")).withColumn("parent", F.array_join(F.slice(F.split("path", "/"), 1, F.col("i")), "/"))
    tongue = F.regexp_extract(F.lower("name"), r"^([a-z]{2})(?:[-_][a-z]{2})?$", 1)
    inside = each.withColumn("_l", tongue).filter(F.col("_l").isin(LANGUAGES))
    several = inside.groupBy("parent").agg(F.countDistinct("_l").alias("n")).filter("n >= 2").select("parent")
    return docs.filter(behind.isin(LANGUAGES)).select("path").union(inside.join(several, "parent").select("path")).distinct()


def is_web_route(doc: Column, dest: Column) -> Column:
    """A link that leaves the tree towards the pages of a code host: ../../issues/42."""
    seen = normalise(F.concat_ws("/", dirname(doc), F.substring_index(F.substring_index(dest, "#", 1), "?", 1)))
    outside = F.regexp_extract(seen, r"^(?:\.\./)+([^/]*)", 1)
    return outside.isin(WEB_ROUTES)


def in_template_folder(path: Column) -> Column:
    return F.arrays_overlap(F.split(F.lower(dirname(path)), "/"), F.array(*(F.lit(x) for x in TEMPLATE_FOLDERS)))


def names_target(text: Column, target: Column) -> Column:
    """Whether a line also names the place where something went: the whole path or its last name."""
    return F.contains(text, target) | F.exists(F.split(text, r"[\s`'\"(),;:\[\]]+"), lambda w: w == basename(target))


def identifier_like(text: Column) -> Column:
    """Looks like a name of the code rather than a word: underscores inside, capitals inside, or long and all capitals."""
    inner = F.substring(text, 2, F.length(text))
    plain = text.rlike(r"^[A-Za-z_][A-Za-z0-9_]*$")
    return plain & (F.contains(F.trim(F.translate(text, "_", " ")), F.lit(" ")) | ((F.lower(inner) != inner) & (F.upper(text) != text)) | ((F.upper(text) == text) & (F.length(text) >= 6)))


def code_strings(files: DataFrame, most: int = 400) -> DataFrame:
    """(literal): what stands in quotes in code, up to `most` characters."""
    return files.select(F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(rf"[\"']([^\"'\n]{{1,{most}}})[\"']"), 1))).alias("literal")).distinct()


def in_code_strings(claims: DataFrame, literals: DataFrame) -> DataFrame:
    """Claims (doc, line, target) whose path, or its last name, is a string of the code: it may be made at run time."""
    known = literals.select(F.col("literal").alias("_k"))
    asked = claims.select("*", F.explode(F.array_distinct(F.array("target", basename(F.col("target"))))).alias("_k"))
    return asked.join(known, "_k", "left_semi").drop("_k").distinct()


def module_files(claims: DataFrame, files: DataFrame) -> DataFrame:
    """(doc, line, module, path): the first file, of those that a module may be, that is there; null where none is."""
    base = F.replace("module", F.lit("."), F.lit("/"))
    forms = F.array(*(F.concat(F.lit(a), base, F.lit(b)) for a, b in (f.split("{}") for f in MODULE_FORMS)))
    found = claims.select("*", F.posexplode(forms).alias("rank", "path")).join(files.select("path").distinct(), "path").groupBy("doc", "line", "module").agg(F.min_by("path", "rank").alias("path"))
    return claims.join(found, ["doc", "line", "module"], "left")


def unknown_targets(claims: DataFrame, targets: DataFrame) -> DataFrame:
    """Claims (doc, line, folder, target) of make targets that the file of their folder lacks; files (folder, target). A pattern rule (%) makes all targets of its form; folders without a file prove nothing."""
    per = targets.groupBy("folder").agg(F.collect_set("target").alias("known"))
    fits = F.exists("known", lambda k: (k == F.col("target")) | (F.contains(k, F.lit("%")) & F.col("target").startswith(F.substring_index(k, "%", 1)) & F.col("target").endswith(F.substring_index(k, "%", -1))))
    return claims.join(per, "folder").filter(~fits).select("doc", "line", "folder", "target", F.lit("make-target-missing").alias("rule"), F.lit("error").alias("severity"))


def version_mismatches(heads: DataFrame, versions: DataFrame) -> DataFrame:
    """Headings (doc, line, version) that state another version than the manifest of their own folder (folder, version)."""
    own = versions.groupBy("folder").agg(F.min("version").alias("real"))
    return heads.withColumn("folder", dirname(F.col("doc"))).join(own, "folder").filter("version <> real").select("doc", "line", "version", "real", F.lit("version-mismatch").alias("rule"), F.lit("warning").alias("severity"))


def command_rules(missing: DataFrame) -> DataFrame:
    """Scripts and modules that are not there (then, folder_there): an error if they were there when the line was written, a warning if their folder is there, else nothing."""
    severity = F.when(F.coalesce("then", F.lit(False)), "error").when(F.col("folder_there"), "warning")
    return missing.withColumn("severity", severity).filter("severity IS NOT NULL").withColumn("rule", F.lit("command-missing"))


def removed_flags(questions: DataFrame, events: DataFrame, scripts: DataFrame) -> DataFrame:
    """Options (doc, line, script, flag, written) that their script had when the line was written and has no more: a warning, and only information where the whole script has left."""
    asked = questions.withColumn("path", F.concat_ws(" ", "script", "flag"))
    keyed = events.withColumn("path", F.concat_ws(" ", "script", "flag")).select("path", "epoch", "commit", "kind")
    out = against_history(asked, keyed).filter("then AND NOT now").join(scripts.select(F.col("path").alias("script"), F.lit(True).alias("_here")).distinct(), "script", "left")
    return out.select("doc", "line", "script", "flag", F.lit("flag-removed").alias("rule"), F.when(F.col("_here"), "warning").otherwise("info").alias("severity"))


@F.pandas_udf(T.BooleanType())
def is_pattern(pattern: pd.Series) -> pd.Series:
    """Whether a text is a regular expression."""

    def fine(p: str | None) -> bool:
        try:
            re.compile(p or "(")
        except re.error:
            return False
        return True

    return pattern.map(fine)


def valid_rules(rules: DataFrame) -> DataFrame:
    """Forbid rules (rule, glob, pattern) with `fine`: a rule that lacks a part or whose pattern is no regular expression is `rule-invalid`."""
    whole = F.coalesce((F.col("glob") != "") & (F.col("pattern") != ""), F.lit(False))
    return rules.withColumn("fine", whole & is_pattern(F.col("pattern")))
