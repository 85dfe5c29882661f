"""Operator 3: approximate nearest neighbours by multiprobe p-stable hashing.

All distinct vectors go into some tables of cells (p-stable Gaussian projections of the unit vectors, cut to cells). A query visits in each
table its own cell and then perturbed ones in the order of their estimated success. In each cell that queries visit, all of its vectors
are ranked exactly and the best leave it; the candidates of all cells are merged. Queries that find too few are compared with all vectors.

On unit vectors the Euclidean distance orders as the cosine does.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import small_side, stage
from .probing import Tables, probes

CELL_ROWS = 4096  # vectors, and queries, of a cell compared in one group
PAIRS = 1 << 15  # compared exactly at once


def _vectors(column: pa.Array | pa.ChunkedArray, dimension: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimension)


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row by row, in double precision and always in the same order of additions, so that equal pairs get equal values."""
    dot = lambda a, b: (a * b).sum(1)
    return dot(x, y) / (np.sqrt(dot(x, x)) * np.sqrt(dot(y, y)))


def valid(vectors: DataFrame, id_col: str, vector_col: str, dimension: int) -> DataFrame:
    """(id, v): vectors that can take part. Null, zero and shorter or longer ones, and those with null or non-finite components, cannot."""
    v = F.col(vector_col).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists(v, lambda x: x != 0)
    return vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).filter(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") == dimension)).filter(~F.coalesce(bad, F.lit(True)) & some)


def index(kinds: DataFrame, tables: Tables, dimension: int) -> DataFrame:
    """(t, cell, kind, v): each kind once for each table."""

    def of(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                x = _vectors(part.column("v"), dimension)
                cells = tables.names(np.floor(tables.project(x / np.sqrt((x * x).sum(1, keepdims=True)))))
                n, count = cells.shape
                again = pa.array(np.repeat(np.arange(n), count))
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(count, dtype=np.int32), n)), pa.array(cells.ravel()), part.column("kind").take(again), part.column("v").take(again)], ["t", "cell", "kind", "v"])

    return kinds.select("kind", "v").mapInArrow(of, "t int, cell long, kind long, v array<double>")


def visits(queries: DataFrame, tables: Tables, dimension: int, most: int) -> DataFrame:
    """(t, cell, q, v): the cells that each query visits."""

    def of(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                x = _vectors(part.column("v"), dimension)
                at = tables.project(x / np.sqrt((x * x).sum(1, keepdims=True)))
                t, cell, who = [], [], []
                for k in range(at.shape[0]):
                    for j in range(at.shape[1]):
                        names = tables.names(probes(at[k, j], most))
                        t.append(np.full(len(names), j, np.int32))
                        cell.append(names)
                        who.append(np.full(len(names), k))
                again = pa.array(np.concatenate(who))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(t)), pa.array(np.concatenate(cell)), part.column("q").take(again), part.column("v").take(again)], ["t", "cell", "q", "v"])

    return queries.select("q", "v").mapInArrow(of, "t int, cell long, q long, v array<double>")


FOUND = "q long, kind long, score double"


def search(indexed: DataFrame, visited: DataFrame, dimension: int, keep: int) -> DataFrame:
    """The best `keep` kinds of each visited cell for each of its queries.

    A crowded cell is dealt out to groups of about CELL_ROWS of its vectors and CELL_ROWS of its queries, each part of the one meeting each part of
    the other, so that no group grows with the table.
    """
    at = ["t", "cell"]
    parts = lambda n: F.greatest(F.lit(1), F.ceil(n / CELL_ROWS)).cast("int")
    here = indexed.groupBy(*at).agg(parts(F.count(F.lit(1))).alias("parts"))
    crowd = small_side(here.join(visited.groupBy(*at).agg(parts(F.count(F.lit(1))).alias("asks")), at), "crowds", 200_000)
    spread = lambda df, own, other: df.join(crowd, at).withColumn(own[0], F.pmod(F.xxhash64(own[1]), F.col(own[2])).cast("int")).withColumn(other[0], F.explode(F.sequence(F.lit(0), F.col(other[1]) - 1)))
    there = spread(indexed, ("part", "kind", "parts"), ("ask", "asks")).select(*at, "part", "ask", "kind", "v")
    asked = spread(visited, ("ask", "q", "asks"), ("part", "parts")).select(*at, "part", "ask", "q", "v")
    return ranked(there, asked, [*at, "part", "ask"], dimension, keep)


def everywhere(kinds: DataFrame, queries: DataFrame, dimension: int, keep: int) -> DataFrame:
    """The best `keep` kinds of all for each query, exactly: both are dealt out to groups of bounded size, and each part of the one meets each part of the other."""
    parts, asks = (max(1, -(-df.count() // CELL_ROWS)) for df in (kinds, queries))
    deal = lambda col, n: F.pmod(F.xxhash64(col), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    there = kinds.select(deal("kind", parts).alias("part"), every(asks).alias("ask"), "kind", "v")
    asked = queries.select(deal("q", asks).alias("ask"), every(parts).alias("part"), "q", "v")
    return ranked(there, asked, ["part", "ask"], dimension, keep)


def ranked(there: DataFrame, asked: DataFrame, group: list[str], dimension: int, keep: int) -> DataFrame:
    """The best `keep` kinds (kind, v) of a group for each of its queries (q, v)."""

    def rank(key, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"q": pa.array([], pa.int64()), "kind": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        x, kinds = _vectors(left.column("v"), dimension), left.column("kind").to_numpy()
        unit = x / np.sqrt((x * x).sum(1, keepdims=True))
        out: list[tuple] = []
        n, slack = min(keep, len(x)), 8 * dimension * np.finfo(float).eps  # more than the product's rounding
        queries = right.column("q").to_numpy()
        for i in range(0, right.num_rows, 256):
            y = _vectors(right.column("v").slice(i, 256), dimension)
            about = (y / np.sqrt((y * y).sum(1, keepdims=True))) @ unit.T
            # all that the product cannot tell from the n-th best are compared exactly, ties of any number included
            inside = about >= np.partition(about, len(x) - n, axis=1)[:, len(x) - n, None] - slack
            cuts = np.flatnonzero(np.diff(np.cumsum(inside.sum(1)) // PAIRS, prepend=-1)).tolist()
            for a, b in zip(cuts, [*cuts[1:], len(y)], strict=True):
                who, near = np.nonzero(inside[a:b])
                score = cosines(y[a:b][who], x[near])
                order = np.lexsort((kinds[near], -score, who))
                who = who[order]
                order = order[np.arange(len(who)) - np.searchsorted(who, who) < n]
                out.append((queries[i + a : i + b][np.sort(who)[np.arange(len(who)) - np.searchsorted(who, who) < n]], kinds[near[order]], score[order]))
        return pa.table({name: pa.array(np.concatenate(v)) for name, v in zip(("q", "kind", "score"), zip(*out, strict=True), strict=True)})

    return there.groupBy(*group).cogroup(asked.groupBy(*group)).applyInArrow(rank, FOUND)


def best(found: DataFrame, keep: int) -> DataFrame:
    one = found.groupBy("q", "kind").agg(F.max("score").alias("score"))
    return one.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "kind"))).filter(F.col("r") <= keep).drop("r")


def nearest(vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding", count: int = 8, width: int = 8, side: float = 2.3, most: int = 50, seed: int = 7) -> DataFrame:
    """(query_id, rank, vec_id, score): the `k` vectors with the largest cosine found for each vector whose id is divisible by `every`, itself left out; ties go to the smaller id.

    Vectors that are null, zero, of another length than most (of equals the shorter), or hold null or non-finite components take no part, nor do null ids. Equal
    vectors are one *kind* in the index, with its k + 1 smallest ids, as no others can be among the best k; rows with the
    same id and vector count once. Each query gets min(k, others) rows; an empty table gives an empty result; other columns are ignored.
    """
    lengths = vectors.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & (F.size(vector_col) > 0)).groupBy(F.size(vector_col).alias("d")).count()
    commonest = lengths.orderBy(F.desc("count"), "d").first()
    dimension = int(commonest["d"]) if commonest else 1
    all_ = valid(vectors, id_col, vector_col, dimension)
    kinds = stage(all_.groupBy("v").agg(F.min("id").alias("kind")), "kinds")
    asked = all_.filter(F.col("id") % every == 0).distinct()
    tables = Tables.draw(dimension, count, width, side, seed)
    indexed = stage(index(kinds, tables, dimension), "cells")
    query_kinds = stage(asked.groupBy("v").agg(F.min("id").alias("q")), "queries")
    found = stage(best(search(indexed, visits(query_kinds, tables, dimension, most), dimension, k + 1), k + 1), "found")

    # queries that found less than there is: exactly, among all vectors
    enough = min(k + 1, kinds.count())
    got = found.groupBy("q").agg(F.count(F.lit(1)).alias("n"))
    few = query_kinds.join(got, "q", "left").filter(F.coalesce("n", F.lit(0)) < enough).select("q", "v")
    if few.take(1):
        few = stage(few, "few")
        found = found.join(few.select("q"), "q", "left_anti").unionByName(best(everywhere(kinds, few, dimension, k + 1), k + 1))

    # back from kinds to ids: a kind's smallest ids, and all ids that ask
    members = all_.distinct().withColumn("nth", F.row_number().over(Window.partitionBy("v").orderBy("id"))).filter(F.col("nth") <= k + 1)
    ids = members.join(kinds, "v").select("kind", F.col("id").alias("vec_id"))
    asking = asked.join(query_kinds, "v").select("q", F.col("id").alias("query_id"))
    near = found.join(ids, "kind").select("q", "vec_id", "score")
    near = near.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))).filter(F.col("r") <= k + 1).drop("r")
    pairs = asking.join(near, "q").filter("query_id <> vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return pairs.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
