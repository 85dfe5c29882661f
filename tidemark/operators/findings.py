"""Findings: severities, downgrades, duplicates, baselines, counts and orders."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fingerprint, is_done, is_past

RANKS = {"error": 2, "warning": 1, "info": 0}
# Rules about form, rules that a sentence on the past softens, rules that guess.
STRUCTURAL = ["table-orphan", "table-shape", "rule-invalid", "rule-violation"]
PAST_RULES = ["symbol-gone", "symbol-removed-now", "path-gone", "path-moved", "path-removed-now", "flag-removed", "subcommand-missing"]
GUESS_RULES = ["path-typo", "path-missing", "path-gone", "anchor-missing", "symbol-gone", "flag-removed", "flag-missing", "subcommand-missing", "copies-diverged", "command-missing"]


def rank(severity: Column) -> Column:
    return F.when(severity == "error", 2).when(severity == "warning", 1).otherwise(0)


def downgraded(findings: DataFrame) -> DataFrame:
    """Severity in context: in plans and on done lines only form counts; what sentences on the past say of the gone is information. Needs kind (of the document) and text (the line)."""
    soft = ((F.col("kind") == "plan") | is_done(F.col("text"))) & ~F.col("rule").isin(STRUCTURAL)
    past = F.col("rule").isin(PAST_RULES) & is_past(F.col("text"))
    history = (F.col("kind") == "history") & ~F.col("rule").startswith("decision")
    return findings.filter(~history).withColumn("severity", F.when(soft | past, "info").otherwise(F.col("severity")))


def with_fingerprints(findings: DataFrame) -> DataFrame:
    return findings.withColumn("fingerprint", fingerprint(F.col("rule"), F.col("path"), F.col("claim"), F.col("text")))


def first_of_each(findings: DataFrame) -> DataFrame:
    """One finding for each fingerprint and line: the first by column."""
    nth = F.row_number().over(Window.partitionBy("fingerprint", "line").orderBy("col"))
    return findings.withColumn("_n", nth).filter("_n = 1").drop("_n")


def sure_only(findings: DataFrame) -> DataFrame:
    return findings.withColumn("severity", F.when(F.col("rule").isin(GUESS_RULES), "info").otherwise(F.col("severity")))


def without_baseline(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    return findings.join(baseline.select("fingerprint"), "fingerprint", "left_anti")


def at_least(findings: DataFrame, floor: str) -> DataFrame:
    return findings.filter(rank(F.col("severity")) >= RANKS[floor])


def in_focus(findings: DataFrame, focus: list[str]) -> DataFrame:
    """Findings whose path is, or lies below, a focus path; where they carry `evidence` (documents that prove them), also those with one there."""

    def inside(path: Column) -> Column:
        hit = F.lit(False)
        for f in focus:
            hit = hit | (path == f) | path.startswith(f.rstrip("/") + "/")
        return hit

    kept = inside(F.col("path"))
    return findings.filter(kept | F.exists("evidence", inside) if "evidence" in findings.columns else kept)


def document_stats(claims: DataFrame, findings: DataFrame) -> DataFrame:
    """For each document its claims by status and findings by severity, and a colour."""
    c = claims.groupBy(F.col("doc").alias("path")).agg(F.count(F.lit(1)).alias("claims"), F.count_if(F.col("status") == "ok").alias("ok"), F.count_if(F.col("status") == "broken").alias("broken"))
    f = findings.groupBy("path").agg(*(F.count_if(F.col("severity") == s).alias(f"{s}s") for s in RANKS))
    both = c.join(f, "path", "left").fillna(0, [f"{s}s" for s in RANKS])
    return both.withColumn("color", F.when(F.col("errors") > 0, "red").when(F.col("warnings") > 0, "yellow").otherwise("green"))


def totals(claims: DataFrame, findings: DataFrame) -> DataFrame:
    """One row of counts over everything."""
    c = claims.agg(F.countDistinct("doc").alias("docs"), F.count(F.lit(1)).alias("claims"), F.count_if(F.col("status").isin("ok", "broken")).alias("checked"), F.count_if(F.col("status") == "ok").alias("verified"))
    f = findings.agg(*(F.count_if(F.col("severity") == s).alias(f"{s}s") for s in RANKS))
    return c.join(F.broadcast(f))  # one row each


def ordered(findings: DataFrame) -> DataFrame:
    return findings.orderBy(F.desc(rank(F.col("severity"))), "path", "line", "col")


def report_order(findings: DataFrame) -> DataFrame:
    """`position`: documents with the worst findings first, then by path; in each by line and column."""
    worst = F.max(rank(F.col("severity"))).over(Window.partitionBy("path"))
    inside = F.row_number().over(Window.partitionBy("path").orderBy("line", "col", "rule"))
    return findings.withColumns({"worst": worst.cast("long"), "position": inside.cast("long")})


def collapsed_links(findings: DataFrame, totals_: DataFrame, least: int = 3) -> DataFrame:
    """Documents at least half of whose links (and three at least) never existed: one note for each, with the count. totals_ (path, links)."""
    never = findings.filter("rule = 'link-broken'").groupBy("path").agg(F.count(F.lit(1)).alias("never"), F.min("line").alias("line"))
    return never.join(totals_, "path").filter((F.col("never") >= least) & (2 * F.col("never") >= F.col("links"))).select("path", "line", "never", "links", F.lit("foreign-links").alias("rule"))


@dataclass
class Rules:
    """Rules by name; each takes the corpus (tables by name) and returns findings (rule, severity, path, line, col, claim, text)."""

    by_name: dict[str, Callable[[dict[str, DataFrame]], DataFrame]] = field(default_factory=dict)

    def register(self, name: str, rule: Callable[[dict[str, DataFrame]], DataFrame]) -> None:
        self.by_name[name] = rule

    def run(self, corpus: dict[str, DataFrame], names: list[str] | None = None) -> DataFrame:
        parts = [self.by_name[n](corpus) for n in names or self.by_name]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return first_of_each(with_fingerprints(downgraded(out)))
