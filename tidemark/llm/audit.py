"""Operator 13: audit of how filters interact, over a trie of their orders.

A prefix of an order leaves the same survivors as any other order of the same filters, so the 5! orders share 2^5 states. They are visited depth first:
each state's survivors are a DataFrame of its own, made from the state before it by one filter and persisted while the states below it are visited.
A state that an earlier branch has reached is not made again: the memo has its counts. One job a state counts, for each part, what is there and
what every filter that is still to come removes: the edges of the trie. Orders, steps and Shapley sums are then read off the edges.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from itertools import permutations
from math import factorial

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import shared_dir, stage

#: Separators of words.
SPACES = r"[\x20\x09-\x0D]+"


def text_failures(text: Column) -> dict[str, Column]:
    """What a text fails by itself: A too short, B too repetitive, C too many capitals, D odd characters."""
    words = F.filter(F.split(text, SPACES), lambda w: w != "")
    return {
        "A": F.size(words) < 100,
        "B": 100 * F.size(F.array_distinct(words)) < 80 * F.size(words),
        "C": 100 * (F.char_length(text) - F.char_length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))) > 10 * F.char_length(text),
        "D": F.coalesce(text.rlike(r"[#$%&*|]"), F.lit(False)),
    }


def judged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, good, toxic, A, B, C, D, E) of each row: what it fails, of the five filters. No text leaves the scan.

    E is failed by a row whose text a smaller id has too. A null text is empty; a null id is neither smaller nor larger than another, so
    such a row does not fail E; a row is good or toxic if any label of its id says so, and a label without an id says nothing.
    """
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = source.select("id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), *(c.alias(name) for name, c in text_failures(F.col("text")).items()))
    # only texts that stand twice need the join; they are written first, so that Spark can split the rows of a text that many have
    firsts = stage(rows.groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest", "first"), "firsts")
    known = labels.filter((F.col("quality") == 1) | (F.col("toxic") == 1)).groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    told = rows.join(firsts, "digest", "left").join(known, "id", "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    return told.select("part", yes("good").alias("good"), yes("toxic").alias("toxic"), "A", "B", "C", "D", F.coalesce(F.col("id") > F.col("first"), F.lit(False)).alias("E"))


class PermutationTrie:
    """Survivors of every unordered prefix, visited depth first, and the counts of their edges."""

    def __init__(self, rows: DataFrame, filters: Mapping[str, Column]):
        self.filters, self.rows = dict(filters), rows
        self.path = f"{shared_dir(rows.sparkSession)}/stages/edges-{uuid.uuid4().hex}"
        self.seen: set[frozenset[str]] = set()

    def edges(self) -> DataFrame:
        """(part, before, filter, there, removed, good_lost, toxic_lost): `before` names the filters that ran, in alphabetical order."""
        self._visit(frozenset(), self.rows)
        written = self.rows.sparkSession.read.schema(self._counts(frozenset(), self.rows).schema).parquet(self.path)
        return written

    def _counts(self, state: frozenset[str], survivors: DataFrame) -> DataFrame:
        ahead = [f for f in self.filters if f not in state]
        count = lambda c: F.count(F.when(c, 1))
        sums = [F.struct(F.lit(f).alias("filter"), count(self.filters[f]).alias("removed"), count(self.filters[f] & F.col("good")).alias("good_lost"), count(self.filters[f] & F.col("toxic")).alias("toxic_lost")).alias(f"edge_{f}") for f in ahead]
        by_part = survivors.groupBy("part").agg(F.count(F.lit(1)).alias("there"), *sums)
        edges = by_part.select("part", F.lit("".join(sorted(state))).alias("before"), "there", F.explode(F.array(*(F.col(f"edge_{f}") for f in ahead))).alias("e"))
        return edges.select("part", "before", "e.filter", "there", "e.removed", "e.good_lost", "e.toxic_lost")

    def _visit(self, state: frozenset[str], survivors: DataFrame) -> None:
        self.seen.add(state)
        if len(state) == len(self.filters):
            return  # no filter is left, so no edge
        survivors = survivors.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            self._counts(state, survivors).write.mode("append").parquet(self.path)
            for f, fails in self.filters.items():
                if (after := state | {f}) not in self.seen:
                    self._visit(after, survivors.filter(~fails))
        finally:
            survivors.unpersist()


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: a row for each part, each of the 120 orders and each of its steps.

    A null part and an empty one are the same part. Null and empty texts fail A alone (and E, if a smaller id has one too); rows that are alike count each; see `judged` for null and
    repeated ids. An empty table has no part and gives an empty result; other columns are ignored.
    """
    rows = stage(judged(docs, labels, id_col, text_col, part_col), "judged")
    spark, names = rows.sparkSession, "ABCDE"
    filters = {f: F.col(f) for f in names}
    edges = PermutationTrie(rows, filters).edges()
    only = lambda f: F.col(f) & ~F.greatest(*(F.col(g) for g in names if g != f))
    alone = rows.groupBy("part").agg(*(F.struct(F.lit(f).alias("filter"), F.count(F.when(F.col(f), 1)).alias("fails"), F.count(F.when(only(f), 1)).alias("unique_fails")).alias(f"of_{f}") for f in names))
    fails = alone.select("part", F.explode(F.array(*(F.col(f"of_{f}") for f in names))).alias("e")).select("part", "e.filter", "e.fails", "e.unique_fails")
    # an unordered prefix of s filters stands before a filter in s! orders of itself, and 4 - s are left to be ordered behind it
    orders = F.element_at(F.array(*(F.lit(factorial(s) * factorial(len(names) - 1 - s)) for s in range(len(names)))), F.length("before") + 1)
    shapley = edges.groupBy("part", "filter").agg(F.sum(F.col("removed") * orders).alias("shapley"))
    steps = [("".join(p), k + 1, p[k], "".join(sorted(p[:k]))) for p in permutations(names) for k in range(len(names))]
    plan = F.broadcast(spark.createDataFrame(steps, "filter_order string, step int, filter string, before string"))  # 600 rows, whatever the data
    # a state in which nothing of a part is left has no edges of it: zeros
    told = fails.join(plan, "filter").join(edges, ["part", "before", "filter"], "left").join(shapley, ["part", "filter"], "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return told.select("part", "filter_order", "step", (n("there") - n("removed")).alias("kept"), n("removed").alias("removed"), (F.col("fails") - n("removed")).alias("redundant"), "unique_fails", n("good_lost").alias("good_lost"), n("toxic_lost").alias("toxic_lost"), n("shapley").alias("shapley"))


#: The same for unique ids that are not null, in DuckDB: each order is applied to each document.
ORACLE = r"""
WITH RECURSIVE texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
words AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS first FROM texts),
judged AS (SELECT w.doc_id, part, coalesce(l.quality = 1, false) AS good, coalesce(l.toxic = 1, false) AS toxic,
  {'A': len(w) < 100, 'B': 100 * len(list_distinct(w)) < 80 * len(w), 'C': 100 * len(regexp_extract_all(t, '[A-Z]')) > 10 * length(t),
   'D': regexp_matches(t, '[#$%&*|]'), 'E': w.doc_id > first} AS f FROM words w LEFT JOIN labels l ON l.doc_id = w.doc_id),
failed AS (SELECT doc_id, part, good, toxic, [x for x in ['A', 'B', 'C', 'D', 'E'] if CASE x WHEN 'A' THEN f.A WHEN 'B' THEN f.B WHEN 'C' THEN f.C WHEN 'D' THEN f.D ELSE f.E END] AS bad FROM judged),
orders AS (SELECT '' AS o UNION ALL SELECT o || x FROM orders, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) WHERE NOT contains(o, x)),
steps AS (SELECT o, s, substr(o, CAST(s AS INT), 1) AS x FROM orders, range(1, 6) r(s) WHERE length(o) = 5),
ended AS (SELECT o, failed.*, CASE WHEN len(bad) = 0 THEN 6 ELSE list_min([strpos(o, b) for b in bad]) END AS fell FROM failed, orders WHERE length(o) = 5),
counted AS (SELECT part, e.o AS filter_order, CAST(s AS INT) AS step, x, count(*) FILTER (WHERE fell > s) AS kept, count(*) FILTER (WHERE fell = s) AS removed,
  count(*) FILTER (WHERE fell < s AND list_contains(bad, x)) AS redundant, count(*) FILTER (WHERE bad = [x]) AS unique_fails,
  count(*) FILTER (WHERE fell = s AND good) AS good_lost, count(*) FILTER (WHERE fell = s AND toxic) AS toxic_lost
  FROM ended e JOIN steps p ON p.o = e.o GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley FROM counted
"""
