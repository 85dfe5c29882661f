"""Registered queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .audit import ORACLE as AUDIT_SQL
from .audit import filter_audit
from .base import table
from .fertility import fertility_rules
from .jaccard import near_duplicates
from .langid import languages
from .lines import ORACLE as LINES_SQL
from .lines import line_dedup
from .mixing import ORACLE as MIXING_SQL
from .mixing import mix_sources
from .neighbours import nearest
from .packing import best_fit_packing
from .quality import quality_scores
from .search import ORACLE as SEARCH_SQL
from .search import lexical_search
from .substring import substring_dedup
from .suffix_array import suffix_array_dedup
from .warc import warc_round_trip

Query = Callable[[SparkSession, str], DataFrame]


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_array_dedup(table(spark, sf_dir, "documents"), texts=False)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"), texts=False)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(table(spark, sf_dir, "documents"))


def op10_tokeniser_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility_rules(table(spark, sf_dir, "documents"))


def op2_quality_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_rank_order_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(table(spark, sf_dir, "documents"))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=3, num=90, den=100).select("doc_id", "n_shingles", "component_id", "n_links")


def op9_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


def op3_multiprobe_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


def op4_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(table(spark, sf_dir, "pages")).drop("url")


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents"), texts=False)


def op12_maxscore_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_suffix_array_dedup, op5_substring_dedup, op6_best_fit_packing, op10_tokeniser_fertility, op2_quality_discriminant, op8_rank_order_language, op7_ngram_jaccard_join, op9_pfair_mixing, op3_multiprobe_neighbours, op4_warc_bundles, op11_line_dedup, op12_maxscore_search, op13_filter_audit)}

ORACLES: dict[str, str] = {"op9_pfair_mixing": MIXING_SQL, "op11_line_dedup": LINES_SQL, "op12_maxscore_search": SEARCH_SQL, "op13_filter_audit": AUDIT_SQL}
