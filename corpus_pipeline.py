"""The corpus pipeline: language identification, near-duplicate removal, substring removal, source mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a table, which is written as Parquet and read again as the next one's docs.
All but the last return the columns of `documents`, and any further ones that `docs` has, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import base
from tidemark.llm.jaccard import near_duplicates
from tidemark.llm.langid import UNKNOWN, languages
from tidemark.llm.mixing import scheduled
from tidemark.llm.packing import best_fit_by_slot
from tidemark.llm.substring import kept_texts

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Least similarity to a learned language; prose of a learned language scores 0.4 and more.
LEAST_SCORE = 0.05


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a learned language: those without a letter or unlike all profiles go.

    Null and empty texts go, having no letter. Null ids and null languages teach nothing and stay if their text does; equal distances go to the first
    language by name; rows that are alike stay or go together. An empty table stays empty, and where no row has a language none can be learned and all go.
    """
    plain, whole = base.set_aside(docs, COLUMNS)
    found = languages(plain, keep=plain.columns)
    return whole(found.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_SCORE)))


def join_ngrams(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group linked by five-word n-grams at a similarity of 0.8: that with the smallest id, null ids last.

    Null, empty and blank texts are linked with nothing and all stay. Rows with one id and different texts, and rows without id, are documents of their
    own; of rows alike in id and text the first by the other columns stays (columns of maps aside). An empty table stays empty.
    """
    plain, whole = base.set_aside(docs, COLUMNS)
    found = near_duplicates(plain, k=5, num=80, den=100)
    first = F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("i"), "k1", "k2")
    heads = found.filter("n_shingles > 0").groupBy("r1", "r2").agg(F.min(first).alias("head"))
    chosen = heads.select("head.k1", "head.k2")
    blank = found.filter("n_shingles = 0").select("k1", "k2").distinct().withColumn("blank", F.lit(True))
    wanted = chosen.distinct().withColumn("blank", F.lit(False)).unionByName(blank)
    named = plain.withColumns(base.key_columns())
    joined = named.join(wanted.withColumnsRenamed({"k1": "_k1", "k2": "_k2"}), ["_k1", "_k2"])
    # rows alike in id and text are one group too; blank texts are linked with nothing
    order = [F.col(f.name) for f in plain.schema.fields if f.name not in ("doc_id", "text") and "map<" not in f.dataType.simpleString()]
    one = F.row_number().over(Window.partitionBy("_k1", "_k2").orderBy(*order or [F.lit(0)]))
    return whole(joined.withColumn("_nth", one).filter("_nth = 1 or blank"))


def remove_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes passages of 35 words and more that stand anywhere else; texts of which nothing is left go. n_chars follows the text.

    Null, empty, blank and shorter texts stay as they are. Rows that are alike are each other's copies, so both lose what they share; null ids are
    rows like others. An empty table stays empty.
    """
    plain, whole = base.set_aside(docs, COLUMNS)
    kept = kept_texts(plain, size=35)
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))
    return whole(kept)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts the documents into the order of the mixture: files and rows follow the slots of their blocks.

    A null source is a source; null and empty texts take no room in their block; rows without an id are ordered by their texts, and
    rows that are alike, or begin at one place, follow each other in any order. An empty table stays empty.
    """
    plain, whole = base.set_aside(docs, COLUMNS)
    return whole(scheduled(plain).orderBy("_slot", "_start"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents by their slots in the mixture, which follow from the documents alone, whatever the order in which files are read: sequence ids follow the slots.

    A null or empty text is the end mark alone; rows that are alike are packed each for itself; null ids stay. An empty table gives an empty result.
    """
    return best_fit_by_slot(scheduled(docs.select("doc_id", "source", "text")))


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard_join", join_ngrams),
    ("substring_dedup", remove_substrings),
    ("source_mixing", mix),
    ("best_fit_packing", pack),
]

#: No SQL says rank-order profiles or this packing; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`."""
    docs = base.table(spark, sf_dir, "documents")
    for name, apply in STAGES[:-1]:
        docs = base.stage(apply(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
