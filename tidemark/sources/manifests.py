"""Manifests of packages: scripts, targets, versions and pins, from the text of files."""

from __future__ import annotations

import tomllib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import basename, dirname

PIN_LINE = r"^([A-Za-z0-9][A-Za-z0-9._-]*)\s*(?:\[[^\]]*\])?\s*((?:===|==|>=|<=|~=|!=|<|>)\s*[^;#\s]+)"


def npm_scripts(files: DataFrame) -> DataFrame:
    """(manifest, folder, script) of package.json files."""
    scripts = F.map_keys(F.from_json(F.get_json_object("text", "$.scripts"), "map<string,string>"))
    return files.filter(basename(F.col("path")) == "package.json").select(F.col("path").alias("manifest"), dirname(F.col("path")).alias("folder"), F.explode(scripts).alias("script"))


def make_targets(files: DataFrame) -> DataFrame:
    """(file, folder, target) of make and just files."""
    named = F.lower(basename(F.col("path"))).isin("makefile", "gnumakefile", "justfile") | F.col("path").endswith(".mk")
    lines = files.filter(named).select("path", F.explode(F.split("text", "\n")).alias("line"))
    return lines.withColumn("target", F.regexp_extract("line", r"^([A-Za-z0-9_.%/-]+)(?:\s+[^:=]*)?:(?!=)", 1)).filter("target <> ''").select(F.col("path").alias("file"), dirname(F.col("path")).alias("folder"), "target")


def requirement_pins(files: DataFrame) -> DataFrame:
    """(file, folder, package, spec) of requirement files."""
    lines = files.filter(basename(F.col("path")).rlike(r"^requirements[^/]*\.(?:txt|in)$")).select("path", F.explode(F.split("text", "\n")).alias("line"))
    pins = lines.withColumns({"package": F.lower(F.regexp_extract("line", PIN_LINE, 1)), "spec": F.regexp_replace(F.regexp_extract("line", PIN_LINE, 2), r"\s+", "")})
    return pins.filter("package <> ''").select(F.col("path").alias("file"), dirname(F.col("path")).alias("folder"), "package", "spec")


def versions(files: DataFrame) -> DataFrame:
    """(file, folder, version) of package.json, pyproject.toml and Cargo.toml; files that do not parse give none."""
    json_ones = files.filter(basename(F.col("path")) == "package.json").select("path", F.get_json_object("text", "$.version").alias("version"))

    def of(batches):
        for batch in batches:
            out = []
            for path, text in zip(batch["path"], batch["text"], strict=True):
                try:
                    data = tomllib.loads(text or "")
                except tomllib.TOMLDecodeError:
                    continue
                part = data.get("project") or data.get("package") or {}
                if isinstance(part.get("version"), str):
                    out.append((path, part["version"]))
            yield pd.DataFrame(out, columns=["path", "version"])

    toml_ones = files.filter(basename(F.col("path")).isin("pyproject.toml", "Cargo.toml")).select("path", "text").mapInPandas(of, "path string, version string")
    return json_ones.unionByName(toml_ones).filter("version IS NOT NULL").select(F.col("path").alias("file"), dirname(F.col("path")).alias("folder"), "version")


def definitions(files: DataFrame) -> DataFrame:
    """(path, line, name, kind): names that code files define, by one pattern for each family of languages."""
    patterns = {
        "function": r"^\s*(?:export\s+)?(?:default\s+)?(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?(?:def|function\*?|fn|func(?:\s+\([^)]*\))?|fun|sub)\s+([A-Za-z_$][\w$]*)",
        "type": r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?(?:pub(?:\([^)]*\))?\s+|public\s+|private\s+|final\s+|data\s+|sealed\s+)*(?:class|struct|enum|interface|trait|type|record|object)\s+([A-Za-z_$][\w$]*)",
        "value": r"^\s*(?:export\s+)?(?:const|let|var|val|static)\s+(?:mut\s+)?([A-Za-z_$][\w$]*)\s*(?::[^=]+)?=|^([A-Za-z_]\w*)\s*(?::[^=]+)?=(?!=)",
    }
    lines = files.filter("kind = 'code'").select("path", F.posexplode(F.split("text", "\n")).alias("pos", "code")).filter(F.length("code") <= 600)
    found = F.lit(None).cast("struct<name:string,kind:string>")
    for kind, p in reversed(patterns.items()):
        groups = [F.regexp_extract("code", p, g) for g in ((1, 2) if kind == "value" else (1,))]
        name = groups[0] if len(groups) == 1 else F.when(groups[0] != "", groups[0]).otherwise(groups[1])
        found = F.when(name != "", F.struct(name.alias("name"), F.lit(kind).alias("kind"))).otherwise(found)
    return lines.withColumn("d", found).filter("d IS NOT NULL").select("path", (F.col("pos") + 1).cast("long").alias("line"), "d.name", "d.kind")


def _by_repo(files: DataFrame) -> list[str]:
    return ["repo"] if "repo" in files.columns else []


def identifiers(files: DataFrame) -> DataFrame:
    """(repo if there is one, name, first): all identifiers of the code, with the first file that has each."""
    own = _by_repo(files)
    names = F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"([A-Za-z_][A-Za-z0-9_]*)"), 1))).alias("name")
    return files.filter("kind IN ('code', 'conf')").select(*own, "path", names).groupBy(*own, "name").agg(F.min("path").alias("first"))


def flag_literals(files: DataFrame) -> DataFrame:
    """(repo if there is one, flag): options that stand in the code."""
    flags = F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"(--[A-Za-z][A-Za-z0-9_-]*)"), 1))).alias("flag")
    return files.filter("kind IN ('code', 'conf')").select(*_by_repo(files), flags).distinct()
