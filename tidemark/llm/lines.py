"""Operator 11: line dedup. Lines are exploded, normalised and hashed; hashes of many documents lose their lines; the rest is put together by position.

1. Every line becomes (key, document, row, position): the key is the 128-bit digest of the line without white space at its ends and with A-Z in lower case.
   Lines shorter than the limit leave here, and no text of a line is shuffled.
2. Keys are counted with map-side combination. Only lines whose key stands in as many rows as the limit asks for are looked at again.
3. Of these, the documents of each key are counted exactly, and the largest one is its keeper. A key that half of the corpus holds is one row of that
   count; the join back to its lines is one that Spark splits.
4. The positions that a row loses meet its text once, in the last join, and the lines that stay are put together in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import key_columns, keyed, stage

#: White space that is cut off at a line's ends.
BLANKS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def line_key(line: Column) -> Column:
    """A line without white space at its ends, A-Z in lower case; other letters stay as they are."""
    bare = F.btrim(line, F.lit(BLANKS))
    # lower() is quick, and right where all characters are ASCII
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, UPPER.lower()))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def repeated_lines(docs: DataFrame, at_least: int, min_chars: int, id_col: str, text_col: str) -> DataFrame:
    """(k1, k2, pos): the lines of each row (see `base.key_columns`) that go."""
    rows = keyed(docs, id_col, text_col)
    # a document is an id; rows without one are documents by their texts, below all others
    doc = F.struct(F.col("id").isNotNull().alias("has"), "k1", F.when(F.col("id").isNull(), F.col("k2")).otherwise(0).alias("k2"))
    each = rows.select(doc.alias("doc"), "k1", "k2", F.posexplode(lines_of(F.col("text"))).alias("pos", "line")).withColumn("line", line_key(F.col("line")))
    lines = each.filter(F.char_length("line") >= min_chars).select(F.unhex(F.md5("line")).alias("key"), "doc", "k1", "k2", "pos")
    # both counts are written first: then either side of the joins is a plain exchange, and Spark can split a key that many lines have
    often = stage(lines.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= at_least).select("key"), "often")
    found = stage(lines.join(often, "key"), "lines")
    holders = found.select("key", "doc").distinct().groupBy("key").agg(F.count(F.lit(1)).alias("docs"), F.max("doc").alias("keeper"))
    lost = found.join(stage(holders.filter(F.col("docs") >= at_least), "holders"), "key").filter(F.col("doc") != F.col("keeper"))
    return lost.select("k1", "k2", "pos")


def line_dedup(docs: DataFrame, at_least: int = 3, min_chars: int = 20, texts: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 and, with `texts`, the kept text of each row.

    Lines end at newlines only. Those whose key has `min_chars` code points and stands in `at_least` documents go, except in the document with the
    largest id, which keeps all of them. A document is an id: rows with one id and different texts are one document, with several texts. Rows
    without an id are told apart by their texts and come below every id. Rows that are alike keep or lose the same. A null or empty text is one empty
    line and stays; an empty table gives an empty result; other columns are ignored.
    """
    lost = repeated_lines(docs, at_least, min_chars, id_col, text_col).groupBy("k1", "k2").agg(F.collect_set("pos").alias("lost"))
    key = key_columns(id_col, text_col)
    rows = docs.select(key["_k1"].alias("k1"), key["_k2"].alias("k2"), F.col(id_col).cast("long").alias("doc_id"), lines_of(F.col(text_col).cast("string")).alias("lines"))
    # the lines are made below the join, so that they are made once a row; texts are shuffled once, at any size
    joined = rows.join(lost.hint("merge"), ["k1", "k2"], "left")
    stays = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("lost"))
    kept = F.when(F.col("lost").isNull(), F.array_join("lines", "\n")).otherwise(F.array_join(F.transform(stays, lambda i: F.get("lines", i)), "\n"))
    out = joined.select("doc_id", F.size("lines").cast("long").alias("n_lines"), F.coalesce(F.size("lost"), F.lit(0)).cast("long").alias("n_dropped"), kept.alias("kept_text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"), *(["kept_text"] if texts else []))


#: The same for unique ids that are not null, in DuckDB.
ORACLE = f"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
each AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM split),
named AS (SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{UPPER.lower()}') AS k FROM each),
many AS (SELECT k, max(doc_id) AS keeper FROM named WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
judged AS (SELECT n.doc_id, n.pos, n.line, m.k IS NOT NULL AND n.doc_id <> m.keeper AS gone FROM named n LEFT JOIN many m ON n.k = m.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
