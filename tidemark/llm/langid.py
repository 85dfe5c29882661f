"""Operator 8: language identification by rank-order profiles.

A profile is a language's most frequent n-grams (one to three letters, a space at word edges) in order. A document's own most
frequent n-grams are looked up in each profile: the distance is the sum of how far each is out of place, or a full
profile's length where it is missing.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .base import crc32_mod, row_runs, small_side, text_buffer

ROWS = 4096  # rows looked at together
CODE_BITS = 21  # of a code point
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, count) of the n-grams of each text, by row and key, and whether each row has a letter. A key holds the code points."""
    parts = [np.frombuffer(f" {t.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    code = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
    row = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    letter = _letters()[code]
    has = np.bincount(row[letter], minlength=len(parts)) > 0
    keep = letter.copy()
    keep[1:] |= letter[:-1] & ~letter[1:]
    keep[:-1] |= letter[1:] & ~letter[:-1]
    # of a run of other characters one space stays: the one after a word, or before the first word of a row
    first = np.ones(len(code), bool)
    first[1:] = row[1:] != row[:-1]
    spaces = keep & ~letter
    previous = np.concatenate([[False], letter[:-1]]) & ~first
    kept_before = np.zeros(len(code), bool)
    at = np.flatnonzero(keep)
    kept_before[at[1:]] = spaces[at[:-1]] & (row[at[1:]] == row[at[:-1]])
    keep &= letter | previous | ~kept_before
    code, row, letter = np.where(letter, code, 32)[keep], row[keep], letter[keep]
    alphabet, small = np.unique(code, return_inverse=True)
    bits = max(int(len(alphabet)).bit_length(), 1)
    if 3 * bits + len(texts).bit_length() > 62:  # many kinds of letters: half of the texts at a time; those of one text always fit
        half = len(texts) // 2
        one, two = grams(texts[:half]), grams(texts[half:])
        return (np.concatenate([one[0], two[0] + half]), *(np.concatenate([x, y]) for x, y in zip(one[1:], two[1:], strict=True)))  # type: ignore[return-value]
    small = small.astype(np.int64) + 1
    owner = row.astype(np.int64) << (3 * bits)
    n = len(small)
    keys = [(owner | small)[letter]]
    if n > 1:
        keys.append((owner[:-1] | small[:-1] << bits | small[1:])[row[:-1] == row[1:]])
    if n > 2:
        keys.append((owner[:-2] | small[:-2] << (2 * bits) | small[1:-1] << bits | small[2:])[(row[:-2] == row[2:]) & letter[1:-1]])
    ranked = np.sort(np.concatenate(keys))
    head = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(ranked) else np.zeros(0, np.int64)
    count, ranked = np.diff(np.append(head, len(ranked))), ranked[head]
    table = np.concatenate([[0], alphabet]).astype(np.int64)
    mask = (1 << bits) - 1
    key = table[ranked >> (2 * bits) & mask] << (2 * CODE_BITS) | table[ranked >> bits & mask] << CODE_BITS | table[ranked & mask]
    return ranked >> (3 * bits), key, count, has


def top(row: np.ndarray, key: np.ndarray, count: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, rank) of each row's `size` most frequent n-grams; ties go to the smaller key."""
    order = np.lexsort((key, -count, row))
    row, key = row[order], key[order]
    begin = np.searchsorted(row, row, "left")
    rank = np.arange(len(row)) - begin
    fine = rank < size
    return row[fine], key[fine], rank[fine]


def _runs(batch: pa.RecordBatch, column: str = "text") -> Iterator[tuple[int, int, list[str]]]:
    raw, off = text_buffer(batch.column(column))
    for i, j in row_runs(off, 1 << 19):
        for a in range(i, j, ROWS):
            b = min(a + ROWS, j)
            plain = raw[off[a] : off[b]].tobytes()
            yield a, b, [plain[x:y].decode("utf-8", "replace") for x, y in zip((off[a:b] - off[a]).tolist(), (off[a + 1 : b + 1] - off[a]).tolist(), strict=True)]


def profiles(told: DataFrame, size: int, most: int) -> dict[str, np.ndarray]:
    """Each language's most frequent n-grams, learned from about `most` documents of it at most (fewer if it has fewer), chosen by a hash of the text."""
    per = told.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    chosen = told.join(small_side(per, "languages"), "lang").filter(F.pmod(F.xxhash64("text"), F.lit(1_000_003)) * F.col("n") < F.lit(1_000_003) * F.lit(most)).select("lang", "text")

    def of(batches):
        for batch in batches:
            for i, j, texts in _runs(batch):
                langs = np.array(batch.column("lang")[i:j].to_pylist(), object)
                for lang in sorted(set(langs)):
                    _, key, count, _ = grams([t for t, own in zip(texts, langs, strict=True) if own == lang])
                    kinds, back = np.unique(key, return_inverse=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(kinds)), pa.array(kinds), pa.array(np.bincount(back.ravel(), weights=count, minlength=len(kinds)).astype(np.int64))], ["lang", "key", "n"])

    counts = chosen.mapInArrow(of, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "key"))).filter(F.col("rank") <= size)
    found: dict[str, list[tuple[int, int]]] = {}
    for r in ranked.collect():  # `size` n-grams of each language
        found.setdefault(r["lang"], []).append((r["rank"], r["key"]))
    return {lang: np.array([k for _, k in sorted(x)], np.int64) for lang, x in sorted(found.items())}


class Distances:
    """Out-of-place distances to all profiles at once."""

    def __init__(self, known: dict[str, np.ndarray], size: int):
        self.langs, self.size = list(known), size
        self.keys = np.unique(np.concatenate([*known.values(), np.zeros(0, np.int64)]))
        self.ranks = np.full((len(known), len(self.keys) + 1), -1)
        for k, own in enumerate(known.values()):
            self.ranks[k, np.searchsorted(self.keys, own)] = np.arange(len(own))

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Nearest language (the first by name of equals) and 1 - distance / largest possible distance."""
        row, key, count, has = grams(texts)
        row, key, rank = top(row, key, count, self.size)
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        at = np.searchsorted(self.keys, key)
        at[at < len(self.keys)] = np.where(self.keys[at[at < len(self.keys)]] == key[at < len(self.keys)], at[at < len(self.keys)], len(self.keys))
        there = self.ranks[:, at]
        out = np.where(there < 0, self.size, np.abs(there - rank))
        total = np.stack([np.bincount(row, weights=o, minlength=len(texts)) for o in out])
        n = np.maximum(np.bincount(row, minlength=len(texts)), 1)
        best = total.argmin(0)
        score = np.clip(1 - total[best, np.arange(len(texts))] / (n * self.size), 0, 1)
        return [self.langs[b] if h else UNKNOWN for b, h in zip(best, has, strict=True)], np.where(has, score, 0.0)


def languages(docs: DataFrame, folds: int = 4, held: int = 2, size: int = 300, most: int = 2000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", keep: list[str] | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each document; with `keep`, these columns of `docs` and lang_pred and score.

    Learned from the documents with a language whose crc32 of the id as text, modulo `folds`, is not `held`: about `most` of each
    language at most. `und` with score 0 where the text is null or has no letter, or nothing could be learned; a null id teaches nothing and
    is not held out; equal distances go to the first language by name; rows that are alike get the same; an empty table gives an
    empty result; other columns are ignored.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    fold = crc32_mod(F.col(id_col).cast("long"), folds)
    told = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (fold != held)).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    known = Distances(profiles(told, size, most), size)

    if keep is not None:
        source = docs.select(*(F.col(c) for c in keep), F.col(text_col).cast("string").alias("_text"))
    names, own = source.columns[:-1], source.columns[-1]

    def of(batches):
        for batch in batches:
            for i, j, texts in _runs(batch, own):
                lang, score = known.predict(texts)
                yield pa.RecordBatch.from_arrays([*(batch.column(c)[i:j] for c in names), pa.array(lang, pa.string()), pa.array(score)], [*names, "lang_pred", "score"])

    schema = StructType([*source.schema.fields[:-1], StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    found = source.mapInArrow(of, schema)
    if keep is not None:
        return found
    return found.select("doc_id", F.coalesce(crc32_mod(F.col("doc_id"), folds) == held, F.lit(False)).alias("held_out"), "lang_pred", "score")
