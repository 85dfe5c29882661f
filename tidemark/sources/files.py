"""A tree of files as a table, read by Spark: kinds and private names are decided on paths alone, before any content is read."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.inventory import MOST_CODE_BYTES, MOST_DOC_BYTES, classify_files

SKIPPED_FOLDERS = (
    ".git .hg .svn node_modules .venv venv env __pycache__ .mypy_cache .pytest_cache .ruff_cache .tox .nox .cache dist build site-packages target .next .nuxt .idea .vscode .gradle bower_components vendor .eggs"
).split()
KEPT_HIDDEN = ".github .claude .cursor .gemini .codex .agents .windsurf".split()


def walk(spark: SparkSession, root: str, repo: str = "") -> DataFrame:
    """(repo, path, kind, size, mtime, text) of the readable files under `root`. Too large and binary files have a null text; bytes that are no UTF-8 become U+FFFD.

    The tree is listed first, without content; only files that their names and sizes let through are opened. Their list passes through the driver, as
    every listing of Spark does.
    """
    base = root.rstrip("/").split("://")[-1].lstrip("/")
    path = F.regexp_replace(F.regexp_replace("path", r"^[a-z0-9]+:/*", ""), "^" + re.escape(base) + "/", "")
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(F.col("path").alias("file"), path.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))
    folder = F.split(F.regexp_extract("path", r"^(.*)/[^/]*$", 1), "/")
    hidden = F.exists(folder, lambda x: (x != "") & x.startswith(".") & ~x.isin(KEPT_HIDDEN))
    ignores = (F.substring_index("path", "/", -1) == ".gitignore") & ~F.col("generated")
    kept = classify_files(listed).withColumn("kind", F.when(ignores, "ignore").otherwise(F.col("kind"))).filter("readable OR kind = 'ignore'").filter(~F.arrays_overlap(folder, F.array(*(F.lit(x) for x in SKIPPED_FOLDERS))) & ~hidden)
    small = F.col("size") <= F.when(F.col("kind") == "doc", MOST_DOC_BYTES).otherwise(MOST_CODE_BYTES)
    named = kept.select(F.lit(repo).alias("repo"), "file", "path", "kind", "size", "mtime", small.alias("small"))
    names = [re.sub(r"([\[\]{}*?\\])", r"\\\1", r["file"]) for r in named.filter("small").select("file").toLocalIterator()]
    if not names:
        return named.select("repo", "path", "kind", "size", "mtime", F.lit(None).cast("string").alias("text"))
    binary = F.position(F.lit(b"\x00"), F.substring("content", 1, 8192)) > 0
    read = spark.read.format("binaryFile").load(names).filter(F.col("length") <= MOST_DOC_BYTES).select(F.col("path").alias("file"), F.when(~binary, F.decode("content", "UTF-8")).alias("text"))
    return named.join(read, "file", "left").select("repo", "path", "kind", "size", "mtime", "text")
