"""The whole check over the Markdown and code of the views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..corpus import Corpus
from .page_queries import _pages
from .registry import query
from .views import v_code


def corpus_of(spark: SparkSession, sf: str) -> Corpus:
    """One repository: the pages of v_md and the files of v_code."""
    rows = F.sort_array(F.collect_list(F.struct("line", "text")))
    code = v_code(spark, sf).groupBy("path").agg(F.array_join(F.transform(rows, lambda r: r["text"]), "\n").alias("text"))
    docs = _pages(spark, sf).select(F.col("doc").alias("path"), "text", F.lit("doc").alias("kind"))
    return Corpus(docs.unionByName(code.withColumn("kind", F.lit("code"))).withColumn("repo", F.lit("r")))


@query()
def corpus_check(spark: SparkSession, sf: str) -> DataFrame:
    """All rules in one plan; tests compare it with literal trees."""
    return corpus_of(spark, sf).check().select("path", "line", "rule", "severity", "claim")
