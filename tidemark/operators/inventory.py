"""Inventory of a tree as a table: kinds of files, what must not be read, folders, owning repositories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import ancestors, basename, dirname, extension, stem

# Endings and names of the kinds of files.
DOC = ".md .markdown .mdx".split()
CODE = (
    ".py .pyi .pyw .js .mjs .cjs .jsx .ts .tsx .mts .cts .go .rs .java .kt .kts .cs .fs .vb .c .h .cc .cpp .hpp .hh .m .mm .rb .php .swift .scala .lua .dart .ex "
    ".exs .erl .clj .r .jl .zig .nim .sh .bash .zsh .fish .ps1 .psm1 .psd1 .bat .cmd .sql .vue .svelte .astro .groovy .gradle .pl .pm"
).split()
CONF = ".json .jsonc .json5 .toml .yaml .yml .ini .cfg .conf .txt .html .htm .css .scss .less .xml .proto .graphql .gql .tf .hcl .mk .cmake .properties .in .spec".split()
CODE_NAMES = "makefile gnumakefile dockerfile justfile procfile rakefile gemfile vagrantfile jenkinsfile cmakelists.txt build workspace".split()
LOCK_NAMES = "package-lock.json yarn.lock pnpm-lock.yaml poetry.lock uv.lock cargo.lock composer.lock gemfile.lock go.sum pipfile.lock".split()
GENERATED = "node_modules __pycache__ .venv venv site-packages .mypy_cache .pytest_cache .ruff_cache .tox dist .next .nuxt coverage htmlcov .eggs".split()
PRIVATE_NAMES = ".env .npmrc .pypirc .netrc id_rsa id_ed25519 id_ecdsa credentials.json cookies.txt cookies.json cookies.sqlite".split()
PRIVATE_ENDINGS = ".pem .key .p12 .pfx .keystore .jks .kdbx .cookies".split()
COOKIE_ENDINGS = ".txt .json .sqlite .db .pkl".split()
MOST_DOC_BYTES, MOST_CODE_BYTES = 3_000_000, 1_500_000
AGENT_NAMES = "claude.md agents.md agents.override.md gemini.md claude.local.md".split()
AGENT_PATHS = ".github/copilot-instructions.md .cursorrules .windsurfrules".split()


def kind_of(path: Column) -> Column:
    """doc, code, conf, or empty for what is no text of the tree's own."""
    name, ending = F.lower(basename(path)), extension(path)
    skipped = name.isin(LOCK_NAMES) | name.rlike(r"(?:\.min\.js|\.min\.css|\.map)$")
    return F.when(skipped, "").when(ending.isin(DOC), "doc").when(ending.isin(CODE) | name.isin(CODE_NAMES), "code").when(ending.isin(CONF), "conf").otherwise("")


def is_private(path: Column) -> Column:
    """May hold secrets: such files are never read."""
    low = F.lower(path)
    name, ending = basename(low), extension(path)
    named = name.isin(PRIVATE_NAMES) | name.startswith(".env.")
    cookies = F.contains(name, F.lit("cookie")) & ending.isin(COOKIE_ENDINGS)
    in_cookies = F.arrays_overlap(F.split(dirname(low), "/"), F.array(F.lit("cookie"), F.lit("cookies")))
    return F.when(named, ~name.rlike(r"\.(?:example|sample|template)$")).otherwise(ending.isin(PRIVATE_ENDINGS) | cookies | F.contains(low, F.lit("secret")) | in_cookies)


def is_generated(path: Column) -> Column:
    return F.arrays_overlap(F.split(path, "/"), F.array(*(F.lit(x) for x in GENERATED)))


def is_agent_file(path: Column) -> Column:
    low = F.lower(path)
    return basename(low).isin(AGENT_NAMES) | low.isin(AGENT_PATHS) | low.rlike(r"^\.cursor/rules/.*\.mdc$")


def classify_files(files: DataFrame) -> DataFrame:
    """`files` (path, ...) with kind, private, generated, readable."""
    out = files.withColumns({"kind": kind_of(F.col("path")), "private": is_private(F.col("path")), "generated": is_generated(F.col("path"))})
    return out.withColumn("readable", ~F.col("private") & ~F.col("generated") & (F.col("kind") != ""))


def folders(files: DataFrame) -> DataFrame:
    """Every folder above a file, without the root."""
    return files.select(F.explode(ancestors(F.col("path"))).alias("folder")).filter("folder <> ''").distinct()


def without_rendered(files: DataFrame) -> DataFrame:
    """Drops pages (x.html) that are rendered from a document beside them (x.md)."""
    docs = files.filter(extension(F.col("path")).isin(DOC)).select(stem(F.col("path")).alias("_stem")).distinct()
    pages = files.filter(extension(F.col("path")).isin(".html", ".htm")).withColumn("_stem", stem(F.col("path")))
    return files.filter(~F.coalesce(extension(F.col("path")).isin(".html", ".htm"), F.lit(False))).unionByName(pages.join(docs, "_stem", "left_anti").drop("_stem"))


def nearest_ancestor(rows: DataFrame, path_col: str, holders: DataFrame, folder_col: str) -> DataFrame:
    """`rows` with the columns of the holder whose folder is the deepest above the path; rows without one go. An equi-join on exploded folders."""
    keys = rows.columns
    up = rows.select(*keys, F.posexplode(ancestors(F.col(path_col))).alias("_up", "_folder"))
    hit = up.join(holders.withColumnRenamed(folder_col, "_folder"), "_folder")
    best = hit.groupBy(*keys).agg(F.min_by(F.struct(F.col("_folder").alias(folder_col), *(F.col(c) for c in holders.columns if c != folder_col)), "_up").alias("_best"))
    return best.select(*keys, "_best.*")
