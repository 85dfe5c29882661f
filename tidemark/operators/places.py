"""Where things lie: addresses of sites, roots of drawn trees, parts of pages, changes between two trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import dirname, joined, suffixes
from .resolve import deepest

PAGE_ENDINGS = [".md", ".mdx", "/index.md", "/index.mdx", "/README.md"]
# Headers of patches, and keys under which tools tell which file they edited.
PATCH_HEADERS = ["Update File", "Add File", "Delete File", "Move to"]
PATH_KEYS = ["file_path", "path", "notebook_path"]


def is_site_address(dest: Column) -> Column:
    """A link without ending that ends at a folder or a bare name, as sites have them."""
    target = F.substring_index(F.substring_index(dest, "#", 1), "?", 1)
    name = F.element_at(F.split(F.regexp_replace(target, "/+$", ""), "/"), -1)
    return (target != "") & ~F.contains(name, F.lit(".")) & (target.startswith("/") | target.endswith("/") | F.contains(target, F.lit("/")))


def site_pages(links: DataFrame, files: DataFrame) -> DataFrame:
    """(doc, line, dest, page, far): the page that a site address leads to, by the names that a site gives its pages; more than one page is far away and no proof."""
    bare = F.regexp_replace(F.substring_index(F.substring_index("dest", "#", 1), "?", 1), "^/+|/+$", "")
    names = links.select("doc", "line", "dest", F.explode(F.array(*(F.concat(bare, F.lit(e)) for e in PAGE_ENDINGS))).alias("_end"))
    ends = files.select("path", F.explode(suffixes(F.col("path"))).alias("_end"))
    hit = names.join(ends, "_end").groupBy("doc", "line", "dest").agg(F.countDistinct("path").alias("n"), F.min("path").alias("page"))
    return hit.select("doc", "line", "dest", "page", (F.col("n") > 1).alias("far"))


def collapsed_site_links(links: DataFrame, shown: int = 3) -> DataFrame:
    """One note for each document with links that only its site could prove: (doc, line, links, examples), the first `shown` by line."""
    rows = F.sort_array(F.collect_list(F.struct("line", "dest")))
    return links.groupBy("doc").agg(F.min("line").alias("line"), F.count(F.lit(1)).alias("links"), F.array_join(F.transform(F.slice(rows, 1, shown), lambda r: r["dest"]), ", ").alias("examples"))


def site_roots(claims: DataFrame, sites: DataFrame, below: str = "static") -> DataFrame:
    """Claims (doc, line, target) with the path that the target has below the nearest site folder (folder); targets that leave it have none."""
    near = deepest(claims, "doc", sites, "folder")
    path = joined(F.concat_ws("/", "folder", F.lit(below)), F.regexp_replace("target", "^/+", ""))
    return near.filter("folder IS NOT NULL").withColumn("path", path).filter(F.col("path").startswith(F.concat("folder", F.lit("/"))))


def page_imports(lines: DataFrame) -> DataFrame:
    """(page, part): pages that a page of MDX imports, by relative address; lines (doc, line, text)."""
    told = F.regexp_extract("text", r"^\s*import\s[^'\"]*['\"](\.{1,2}/[^'\"]+\.mdx?)['\"]", 1)
    return lines.withColumn("_t", told).filter("_t <> ''").select(F.col("doc").alias("page"), joined(dirname(F.col("doc")), F.col("_t")).alias("part")).distinct()


def rerooted(entries: DataFrame, files: DataFrame) -> DataFrame:
    """Drawn trees under the folder where most of their entries are: entries (doc, top, path) below a top folder of any place. (doc, top, base, hits), ties to the shorter, then first base."""
    ends = files.select("path", F.explode(suffixes(F.col("path"))).alias("_end"))
    hit = entries.select("doc", "top", F.col("path").alias("_end")).distinct().join(ends, "_end")
    base = F.regexp_replace(F.expr("left(path, length(path) - length(_end))"), "/$", "")
    votes = hit.withColumn("base", base).groupBy("doc", "top", "base").agg(F.count(F.lit(1)).alias("hits"))
    best = F.min(F.struct((-F.col("hits")).alias("m"), F.length("base").alias("l"), "base"))
    return votes.groupBy("doc", "top").agg(best.alias("b")).select("doc", "top", "b.base", (-F.col("b.m")).alias("hits"))


def tree_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Changes between two trees (path, digest): (path, kind, other). A, D, M; a content that left one path for another, and only there, is R at the new path."""
    both = before.withColumnRenamed("digest", "_b").join(after.withColumnRenamed("digest", "_a"), "path", "full")
    changed = both.filter("NOT (_b <=> _a)")
    left = changed.filter("_a IS NULL").select(F.col("path").alias("other"), F.col("_b").alias("digest"))
    came = changed.filter("_b IS NULL").select("path", F.col("_a").alias("digest"))
    single = lambda df, c: df.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min(c).alias(c)).filter("n = 1").drop("n")
    moved = single(came, "path").join(single(left, "other"), "digest").select("path", F.lit("R").alias("kind"), "other")
    rest = changed.join(moved.select("path"), "path", "left_anti").join(moved.select(F.col("other").alias("path")), "path", "left_anti")
    kind = F.when(F.col("_b").isNull(), "A").when(F.col("_a").isNull(), "D").otherwise("M")
    return rest.select("path", kind.alias("kind"), F.lit(None).cast("string").alias("other")).unionByName(moved)


def edited_paths(calls: DataFrame) -> DataFrame:
    """(id, path): files that a tool call edited: calls (id, payload: JSON of any shape). Known keys, wherever they stand, and the headers of patches."""
    keys = rf"\"(?:{'|'.join(PATH_KEYS)})\"\s*:\s*\"((?:[^\"\\]|\\.)*)\""
    headers = rf"\*\*\* (?:{'|'.join(PATCH_HEADERS)}): ([^\\\"\n]+)"
    found = F.array_union(F.regexp_extract_all("payload", F.lit(keys), 1), F.regexp_extract_all("payload", F.lit(headers), 1))
    return calls.select("id", F.explode(found).alias("path")).withColumn("path", F.trim("path")).filter("path <> ''").distinct()
