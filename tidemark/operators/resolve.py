"""Where claims point: joins of named targets with what is there. All are equi-joins on exploded candidates, suffixes, folders or blocking keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import ancestors, basename, dirname, joined, suffixes
from ..staging import staged
from .similar import close_matches


def candidates(claims: DataFrame, bases: Column) -> DataFrame:
    """Each claim (doc, line, target) with its candidate paths in order: the target as seen from each base folder."""
    return claims.withColumn("_c", F.array_distinct(F.transform(bases, lambda b: joined(b, F.col("target"))))).select("*", F.posexplode("_c").alias("rank", "path")).drop("_c")


def resolve(claims: DataFrame, files: DataFrame, bases: Column) -> DataFrame:
    """Each claim with `hit`, the first of its candidates that is there, and its rank; null where none is."""
    keys = claims.columns
    found = candidates(claims, bases).join(files.select("path").distinct(), "path").groupBy(*keys).agg(F.min_by("path", "rank").alias("hit"), F.min("rank").cast("long").alias("rank"))
    return claims.join(found, keys, "left")


def suffix_hits(claims: DataFrame, files: DataFrame) -> DataFrame:
    """(doc, line, target, hits, first): files whose path ends with the target at a segment, letter case aside."""
    ends = files.select("path", F.explode(suffixes(F.lower("path"))).alias("_end"))
    hit = claims.withColumn("_end", F.lower("target")).join(ends, "_end")
    return hit.groupBy("doc", "line", "target").agg(F.countDistinct("path").alias("hits"), F.min("path").alias("first"))


def elsewhere(claims: DataFrame, files: DataFrame) -> DataFrame:
    """Suggestions: claims whose target ends exactly one path."""
    return suffix_hits(claims, files).filter("hits = 1").select("doc", "line", "target", F.col("first").alias("suggestion"))


def case_hits(claims: DataFrame, files: DataFrame) -> DataFrame:
    """Claims that differ from a path in letter case alone, with the real spelling."""
    real = files.select("path", F.lower("path").alias("_low"))
    return claims.withColumn("_low", F.lower("target")).join(real, "_low").filter("path <> target").select("doc", "line", "target", F.col("path").alias("spelled"))


def missing(claims: DataFrame, files: DataFrame) -> DataFrame:
    return claims.join(files.select(F.col("path").alias("target")), "target", "left_anti")


def near_names(claims: DataFrame, files: DataFrame, least: float = 0.84, most: int = 3) -> DataFrame:
    """Likely typos: for each target its most similar sibling names (score of at least `least`), best first."""
    asked = claims.select("target", dirname(F.col("target")).alias("group"), basename(F.col("target")).alias("wanted")).distinct()
    here = files.select(dirname(F.col("path")).alias("group"), basename(F.col("path")).alias("name"))
    return asked.join(close_matches(asked, here, least, most), ["group", "wanted"]).select("target", "name", "score", "rank")


def edit_near(claims: DataFrame, files: DataFrame, most: int = 2) -> DataFrame:
    """The nearest sibling by edit distance, at most `most`; ties go to the first name.

    Names at a distance of one meet at what is left when each drops a letter or none; who has such a sibling is settled. For the others a name is cut into
    `most` + 1 pieces. `most` edits leave one of them whole, moved by `most` places at most, so both sides meet at (folder, length, number of the piece,
    piece). Many names may share a piece, but seldom all letters except one.
    """
    count = most + 1
    here = files.select(dirname(F.col("path")).alias("_dir"), basename(F.col("path")).alias("name"))
    asked = claims.select("target").distinct().withColumns({"_dir": dirname(F.col("target")), "wanted": basename(F.col("target"))})

    def nearest(pairs: DataFrame, most: int) -> DataFrame:
        d = pairs.withColumn("distance", F.levenshtein("wanted", "name", most).cast("long")).filter("distance >= 0")
        return d.groupBy("target").agg(F.min(F.struct("distance", "name")).alias("b")).select("target", F.col("b.name").alias("name"), F.col("b.distance").alias("distance"))

    def dropped(name: str) -> Column:
        """Hashes of a name and of all that is left of it without one letter."""
        return F.explode(F.expr(f"array_distinct(transform(sequence(0, length({name})), i -> if(i = 0, xxhash64({name}), xxhash64(concat(left({name}, i - 1), substring({name}, i + 1))))))"))

    if most < 1:
        return nearest(asked.join(here, (asked._dir == here._dir) & (asked.wanted == here.name)).select("target", "wanted", "name"), most)
    met = asked.select("target", "_dir", dropped("wanted").alias("_rest")).join(here.select("_dir", "name", dropped("name").alias("_rest")), ["_dir", "_rest"])
    close = nearest(met.select("target", basename(F.col("target")).alias("wanted"), "name"), 1)
    if most == 1:
        return close
    close = staged(close, "close")
    asked = staged(asked.join(close, "target", "left_anti"), "asked")
    if not asked.take(1):
        return close

    def pieces(length: str) -> str:
        """SQL array of (nth, start, size) of the pieces of a name of `length` letters."""
        return f"transform(sequence(0, {most}), i -> struct(i AS nth, i * ({length} div {count}) AS start, if(i = {most}, {length} - i * ({length} div {count}), {length} div {count}) AS size))"

    here = here.join(asked.select("_dir").distinct(), "_dir", "left_semi").withColumn("_l", F.length("name"))
    there = here.select("_dir", "name", "_l", F.explode(F.expr(pieces("_l"))).alias("p")).select("_dir", "name", "_l", F.col("p.nth").alias("_nth"), F.expr("substring(name, p.start + 1, p.size)").alias("_piece"))
    each = asked.select("*", F.explode(F.expr(f"sequence(greatest(length(wanted) - {most}, 0), length(wanted) + {most})")).alias("_l"))
    each = each.select("*", F.explode(F.expr(pieces("_l"))).alias("p")).select("*", F.explode(F.expr(f"sequence(p.start - {most}, p.start + {most})")).alias("_at")).filter("_at >= 0 AND _at + p.size <= length(wanted)")
    probes = each.select("target", "wanted", "_dir", "_l", F.col("p.nth").alias("_nth"), F.expr("substring(wanted, _at + 1, p.size)").alias("_piece")).distinct()
    pairs = probes.join(there, ["_dir", "_l", "_nth", "_piece"]).select("target", "wanted", "name").distinct()
    return close.unionByName(nearest(pairs, most))


def deepest(rows: DataFrame, path_col: str, holders: DataFrame, folder_col: str) -> DataFrame:
    """`rows` with the holder whose folder is the deepest at or above the path's folder, nulls where there is none."""
    keys = rows.columns
    others = [c for c in holders.columns if c != folder_col]
    up = rows.select(*keys, F.posexplode(ancestors(F.col(path_col))).alias("_up", "_folder"))
    hit = up.join(holders.withColumnRenamed(folder_col, "_folder"), "_folder").groupBy(*keys).agg(F.min_by(F.struct(F.col("_folder").alias(folder_col), *others), "_up").alias("_best"))
    return rows.join(hit, keys, "left").select(*keys, "_best.*")


EDGE = 12  # letters of a pattern's ends that are joined on


def template_hits(names: DataFrame, templates: DataFrame, least: int = 3) -> DataFrame:
    """(name, pattern): names that a format string of the code builds. `templates` (pattern) are regular expressions of literal text and holes, without alternatives.

    What stands before the first hole and after the last one, `EDGE` letters of each at most, is compared by an equi-join; there are at most
    (EDGE + 1)**2 pairs of lengths of such ends, so that is the most rows that a name becomes. Only what meets there is matched. Patterns that begin
    with fewer than `least` literal letters vouch for nothing.
    """
    letter = "A-Za-z0-9_ /-"
    head = F.regexp_extract("pattern", rf"^((?:[{letter}](?![?*+{{]))*)", 1)
    tail = F.regexp_extract("pattern", rf"(?:^|[^\\{letter}])([{letter}]*)$", 1)
    ends = templates.select("pattern", F.substring(head, 1, EDGE).alias("_head"), F.right(tail, F.lit(EDGE)).alias("_tail")).filter(F.length("_head") >= least).distinct()
    shapes = ends.agg(F.collect_set(F.struct(F.length("_head").alias("h"), F.length("_tail").alias("t"))).alias("_shapes"))  # one row
    asked = names.crossJoin(F.broadcast(shapes)).select("name", F.explode("_shapes").alias("s")).filter(F.length("name") >= F.greatest("s.h", "s.t"))
    keyed = asked.select("name", F.expr("left(name, s.h)").alias("_head"), F.expr("right(name, s.t)").alias("_tail"))
    return keyed.join(ends, ["_head", "_tail"]).filter(F.expr("name RLIKE concat('^(?:', pattern, ')$')")).select("name", "pattern").distinct()


def unknown_symbols(claims: DataFrame, idents: DataFrame) -> DataFrame:
    """Claims of names that the code does not have."""
    return claims.join(idents.select("name").distinct(), "name", "left_anti")


def rule_hits(rules: DataFrame, code: DataFrame, most: int = 50) -> DataFrame:
    """Lines that a forbid rule (rule, glob, pattern) hits, the first `most` of each rule by path and line.

    Rules are written by hand, some dozens at most; past `LIMIT` they are refused rather than crossed with the code.
    """
    if rules.limit(LIMIT + 1).count() > LIMIT:
        raise ValueError(f"more than {LIMIT} forbid rules")
    hit = code.join(F.broadcast(rules), F.expr("path RLIKE glob AND text RLIKE pattern"))
    rank = F.row_number().over(Window.partitionBy("rule").orderBy("path", "line"))
    return hit.withColumn("_n", rank).filter(F.col("_n") <= most).select("rule", "path", "line", "text")


LIMIT = 1000


def mirror_votes(docs: DataFrame, languages: list[str]) -> DataFrame:
    """Which folder a language folder mirrors: each document of a language tree votes for the folder where the same tail stands outside of it. (root, source, votes) with two votes at least and no tie."""
    part = F.split("path", "/")
    lang = F.array_position(F.transform(part, lambda x: F.lower(x).isin(languages)), True)
    tree = docs.withColumn("_at", lang).filter("_at > 0").select("path", F.array_join(F.slice(part, 1, F.col("_at").cast("int")), "/").alias("root"), F.array_join(F.slice(part, (F.col("_at") + 1).cast("int"), F.size(part)), "/").alias("tail"))
    plain = docs.withColumn("_at", lang).filter("_at = 0").select(F.explode(suffixes(F.col("path"))).alias("tail"), F.col("path").alias("other"))
    votes = tree.join(plain, "tail").select("root", F.expr("substring(other, 1, length(other) - length(tail))").alias("source"), "path").groupBy("root", "source").agg(F.countDistinct("path").alias("votes"))
    ranked = votes.withColumns({"_r": F.rank().over(Window.partitionBy("root").orderBy(F.desc("votes"))), "_n": F.count(F.lit(1)).over(Window.partitionBy("root", "votes"))})
    return ranked.filter("_r = 1 AND _n = 1 AND votes >= 2").select("root", "source", "votes")


def anchor_findings(links: DataFrame, anchors: DataFrame) -> DataFrame:
    """Links (doc, line, target, anchor) into pages that have no such anchor, neither as written nor by its letters and digits alone."""
    bare = lambda c: F.lower(F.regexp_replace(c, r"(?U)[^\p{Alnum}]", ""))
    exact = links.join(anchors.select(F.col("path").alias("target"), "anchor"), ["target", "anchor"], "left_anti")
    return exact.withColumn("_s", bare(F.col("anchor"))).join(anchors.select(F.col("path").alias("target"), bare(F.col("anchor")).alias("_s")).distinct(), ["target", "_s"], "left_anti").drop("_s")


def import_closure(imports: DataFrame) -> DataFrame:
    """(page, part) for all pages that a page imports, directly or not, however far; a page that imports itself in a circle is not its own part.

    Each round joins what is known with itself, which doubles the length of the ways, and keeps each pair once; rounds end when no pair is new.
    """
    known = staged(imports.select("page", "part").filter("page <> part").distinct(), "imports")
    count = known.count()
    while True:
        further = known.select(F.col("page").alias("part"), F.col("part").alias("_next"))
        wider = staged(known.unionByName(known.join(further, "part").select("page", F.col("_next").alias("part"))).filter("page <> part").distinct(), "imports")
        if (more := wider.count()) == count:
            return wider
        known, count = wider, more
