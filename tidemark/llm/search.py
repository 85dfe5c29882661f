"""Operator 12: ranked lexical search by MaxScore, shard by shard.

The queries are taken in blocks of bounded size. For each block:

1. Every document is cut into terms where it lies; of each, its length and the counts of the block's terms are written as one row of a stage table.
2. The numbers of documents and terms, and each term's document frequency, are summed from that table over all documents.
3. Each task gathers its documents into shards of a bounded number of postings and inverts them. Every term has an upper bound in the shard: the largest
   part that it adds to any score there. A query's lists are read in descending order of these bounds. As soon as all that are left could not lift
   a document up to the score to beat, they are non-essential: no new document comes from them, and they are only probed for documents that still can
   qualify with all that is left. The score to beat is the k-th best so far, also of the shards before.
4. The best of all tasks are ranked, first within a share of the documents and then over these shares.

Terms are told apart by 64-bit hashes of their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import LOWER, row_runs, signed, stage, text_buffer, word_spans, word_units

#: ASCII bytes that are no letter or digit break terms.
BREAKS = np.ones(256, bool)
for _first, _last in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
    BREAKS[_first : _last + 1] = False
SHARD = 1 << 21  # postings of a shard
BLOCK = 1 << 18  # terms of the queries that are taken together
SHARES = 64  # of the documents, in the last ranking


# ---------------------------------------------------------------- terms


def terms_of(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all terms, and for each row the number of its first (n + 1 entries)."""
    low = LOWER[raw]
    starts, ends, first = word_spans(low, off, BREAKS)
    return signed(word_units(low, starts, ends)), first


def counts_in(keys: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys of each row in order, how often each stands there, and the n + 1 bounds of the rows. Keys are of 32 bits."""
    row = np.repeat(np.arange(len(first) - 1, dtype=np.int64), np.diff(first))
    ranked = np.sort(row << 32 | keys)
    head = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(ranked) else np.zeros(0, np.int64)
    times, ranked = np.diff(np.append(head, len(ranked))), ranked[head]
    return ranked & 0xFFFFFFFF, times, np.searchsorted(ranked >> 32, np.arange(len(first)))


def query_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item_id, terms, times): the distinct terms of each query."""

    def of(batches):
        for batch in batches:
            raw, off = text_buffer(batch.column("text"))
            hashes, first = terms_of(raw, off)
            kinds, at = np.unique(hashes, return_inverse=True)
            keys, times, bounds = counts_in(at.astype(np.int64), first)
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.ListArray.from_arrays(bounds.astype(np.int32), kinds[keys]), pa.ListArray.from_arrays(bounds.astype(np.int32), times.astype(np.int32))], ["item_id", "terms", "times"])

    return items.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(of, "item_id long, terms array<long>, times array<int>")


def postings(docs: DataFrame, known: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n, terms, tfs) of each document that has a term: its length, and the counts of the `known` terms (sorted hashes), which are given by their places."""

    def of(batches):
        for batch in batches:
            raw, off = text_buffer(batch.column("text"))
            for i, j in row_runs(off):
                hashes, first = terms_of(raw[off[i] : off[j]], off[i : j + 1] - off[i])
                at = np.searchsorted(known, hashes)
                at[at == len(known)] = 0
                hit = known[at] == hashes if len(known) else np.zeros(len(hashes), bool)
                kept = np.concatenate([[0], np.cumsum(hit)])[first]
                keys, times, bounds = counts_in(at[hit], kept)
                lists = [pa.ListArray.from_arrays(bounds.astype(np.int32), x.astype(np.int32)) for x in (keys, times)]
                out = pa.RecordBatch.from_arrays([batch.column("doc_id")[i:j], pa.array(np.diff(first).astype(np.int64)), *lists], ["doc_id", "n", "terms", "tfs"])
                yield out.filter(pa.array(np.diff(first) > 0))

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(of, "doc_id long, n long, terms array<int>, tfs array<int>")


def frequencies(written: DataFrame, known: int) -> np.ndarray:
    """In how many documents each known term stands. A task sends one row for each term that it has met."""

    def of(batches):
        total = np.zeros(known, np.int64)
        for batch in batches:
            total += np.bincount(batch.column("terms").flatten().to_numpy(zero_copy_only=False), minlength=known)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["term", "df"])

    summed = written.select("terms").mapInArrow(of, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    out = np.zeros(known, np.int64)
    out[summed.column("term").to_numpy()] = summed.column("df").to_numpy()
    return out


def term_weights(df: np.ndarray, docs: int) -> np.ndarray:
    return np.floor(1000 * np.log((2 * docs + 2) / (2 * df + 1))).astype(np.int64)


# ---------------------------------------------------------------- shards


class Shard:
    """Posting lists of some documents, with an upper bound for each."""

    def __init__(self, terms: np.ndarray, rows: np.ndarray, tfs: np.ndarray, lengths: np.ndarray, known: int, docs: int, length: int):
        scale = 75 + (25 * lengths * docs) // length
        order = np.argsort(terms, kind="stable")
        self.rows, tfs = rows[order], tfs[order].astype(np.int64)
        self.parts = (1_000_000_000 * tfs) // (1000 * tfs + 12 * scale[self.rows])
        self.begin = np.searchsorted(terms[order], np.arange(known + 1))
        self.most = np.zeros(known, np.int64)
        there = np.flatnonzero(np.diff(self.begin))
        if len(there):
            self.most[there] = np.maximum.reduceat(self.parts, self.begin[there])
        self.total, self.met = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), bool)

    def best(self, terms: np.ndarray, weights: np.ndarray, k: int, beat: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and scores of all documents that may be among the `k` best; none of those left out reaches `beat` and the k-th best here."""
        bounds = weights * self.most[terms]
        order = np.argsort(-bounds, kind="stable")
        order = order[bounds[order] > 0]
        terms, weights, bounds = terms[order], weights[order], bounds[order]
        rest = np.append(np.cumsum(bounds[::-1])[::-1], 0)  # what the lists from here on can add at most
        found: list[np.ndarray] = []
        size, i = 0, 0
        while i < len(terms) and rest[i] >= beat:  # essential: a document of these lists alone may still qualify
            a, b = self.begin[terms[i]], self.begin[terms[i] + 1]
            rows = self.rows[a:b]
            fresh = rows[~self.met[rows]]
            self.met[fresh] = True
            found.append(fresh)
            size += len(fresh)
            self.total[rows] += weights[i] * self.parts[a:b]
            i += 1
            if size >= k and i < len(terms) and rest[i] >= beat:
                beat = max(beat, self._kth(self.total[np.concatenate(found)], k))
        rows = np.concatenate(found) if found else np.zeros(0, np.int64)
        scores = self.total[rows]
        self.total[rows], self.met[rows] = 0, False
        for j in range(i, len(terms)):  # non-essential: probed while a document can qualify
            can = scores + rest[j] >= beat
            rows, scores = rows[can], scores[can]
            if not len(rows):
                break
            a, b = self.begin[terms[j]], self.begin[terms[j] + 1]
            at = np.minimum(a + np.searchsorted(self.rows[a:b], rows), b - 1)
            scores = scores + np.where(self.rows[at] == rows, weights[j] * self.parts[at], 0)
            if len(rows) >= k:
                beat = max(beat, self._kth(scores, k))
        can = (scores >= beat) & (scores > 0)
        return rows[can], scores[can]

    @staticmethod
    def _kth(scores: np.ndarray, k: int) -> int:
        return int(np.partition(scores, len(scores) - k)[len(scores) - k])


def shards(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.ChunkedArray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, lengths, and (row, term, tf) of the postings of as many documents as have about `size` postings."""

    def of(parts: list[pa.RecordBatch]):
        whole = pa.Table.from_batches(parts).combine_chunks()
        lists = whole.column("terms").combine_chunks()
        rows = np.repeat(np.arange(len(whole)), lists.value_lengths().to_numpy(zero_copy_only=False))
        return whole.column("doc_id"), whole.column("n").to_numpy(), rows, lists.flatten().to_numpy(zero_copy_only=False), whole.column("tfs").combine_chunks().flatten().to_numpy(zero_copy_only=False)

    held, there = [], 0
    for batch in batches:
        lengths = batch.column("terms").value_lengths().to_numpy(zero_copy_only=False)
        sums, a = np.concatenate([[0], np.cumsum(lengths + 1)]), 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(sums, sums[a] + size - there, "right")) - 1)
            held.append(batch.slice(a, b - a))
            there += int(sums[b] - sums[a])
            a = b
            if there >= size or a < batch.num_rows:
                yield of(held)
                held, there = [], 0
    if held:
        yield of(held)


def ranked(ids: np.ndarray, missing: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the `k` best: by score, then by id, rows without one last."""
    return np.lexsort((ids, missing, -scores))[:k]


def search_block(written: DataFrame, queries: list[tuple[np.ndarray, np.ndarray]], known: int, docs: int, length: int, k: int, size: int) -> DataFrame:
    """(query, doc_id, score): the `k` best documents of each task for each query, given by its places of terms and their weights."""

    def of(batches):
        tops = [(np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)) for _ in queries]
        for ids, lengths, rows, terms, tfs in shards(batches, size):
            shard = Shard(terms, rows, tfs, lengths, known, docs, length)
            missing, ids = ids.is_null().to_numpy(), ids.fill_null(0).to_numpy()
            for q, (own, weights) in enumerate(queries):
                old = tops[q]
                at, scores = shard.best(own, weights, k, int(old[2][-1]) if len(old[2]) == k else 1)
                if len(at):
                    new = [np.concatenate(x) for x in zip(old, (ids[at], missing[at], scores), strict=True)]
                    order = ranked(*new, k)
                    tops[q] = tuple(x[order] for x in new)
        each = [len(t[2]) for t in tops]
        if sum(each):
            ids, missing, scores = (np.concatenate(x) for x in zip(*tops, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(queries), dtype=np.int32), each)), pa.array(ids, mask=missing), pa.array(scores)], ["query", "doc_id", "score"])

    return written.mapInArrow(of, "query int, doc_id long, score long")


def lexical_search(docs: DataFrame, items: DataFrame, k: int = 20, block: int = BLOCK, shard: int = SHARD, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: the `k` best documents of each row of `items`, of those with a score above 0.

    Ties go to the smaller doc_id, rows without an id last. Documents are rows: rows that are alike have the same score and both count, in ranks and in
    the frequencies of terms. A null or empty text, or one without a term, is no document and no query. Items without a hit have no row; rows of `items` that share an
    id are ranked each by itself. Empty tables give an empty result; other columns are ignored.

    `block` bounds the distinct terms of the queries that are taken together (one query may have more); each block reads the documents once.
    """
    spark = docs.sparkSession
    asked = stage(query_terms(items, item_col, item_text_col), "queries").filter(F.size("terms") > 0)
    all_terms = asked.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks = max(1, -(-2 * all_terms // block))
    found = [_ranked_block(docs, asked.filter(F.pmod(F.xxhash64("item_id", "terms"), F.lit(blocks)) == b), k, shard, id_col, text_col) for b in range(blocks)] if all_terms else []
    out = [x for x in found if x is not None]
    if not out:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    whole = out[0]
    for more in out[1:]:
        whole = whole.unionByName(more)
    return whole


def _ranked_block(docs: DataFrame, asked: DataFrame, k: int, shard: int, id_col: str, text_col: str) -> DataFrame | None:
    got = asked.toArrow()  # about `block` terms
    if not got.num_rows:
        return None
    terms, times = (got.column(c).combine_chunks() for c in ("terms", "times"))
    known, at = np.unique(terms.flatten().to_numpy(zero_copy_only=False), return_inverse=True)
    written = stage(postings(docs, known, id_col, text_col), "postings")
    n, length = written.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not n:
        return None
    weights = term_weights(frequencies(written, len(known)), n)
    cuts = np.cumsum([0, *terms.value_lengths().to_pylist()])
    often = times.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    queries = [(at[a:b], weights[at[a:b]] * often[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    best = search_block(written, queries, len(known), n, int(length), k, shard)
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    for group in (["query", "share"], ["query"]):
        best = best.withColumn("share", F.pmod(F.xxhash64("doc_id"), F.lit(SHARES))) if "share" in group else best
        best = best.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("rank") <= k)
    ids = docs.sparkSession.createDataFrame(pa.table({"query": pa.array(np.arange(got.num_rows, dtype=np.int32)), "item_id": got.column("item_id")}))
    return best.join(F.broadcast(ids), "query").select("item_id", "rank", "doc_id", "score")


#: The same in DuckDB, for unique ids that are not null.
ORACLE = r"""
WITH terms AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
tfs AS (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY ALL),
lengths AS (SELECT doc_id, count(*) AS n FROM terms GROUP BY ALL),
corpus AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM lengths),
dfs AS (SELECT term, count(*) AS df FROM tfs GROUP BY term),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM dfs, corpus),
asked AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
scaled AS (SELECT doc_id, 75 + (25 * n * docs) // total AS m FROM lengths, corpus),
scores AS (SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
  FROM asked JOIN weights USING (term) JOIN tfs USING (term) JOIN scaled USING (doc_id) GROUP BY ALL),
placed AS (SELECT item_id, doc_id, score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM placed WHERE rank <= 20
"""
