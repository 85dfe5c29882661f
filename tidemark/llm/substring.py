"""Operator 5: substring dedup by prefix-partitioned suffix trees, over words.

A window of `size` words goes to the group of its *variable-length prefix*: the words up to the end of its anchor, between the
anchor's width and the whole window. Windows of equal content have equal prefixes, so each group holds whole subtrees.
Groups that share an anchor are kept together while they fit into memory; a crowded anchor is widened step by step, which lengthens its
windows' prefixes up to the whole window, where a group is one node. In each group the sorted suffixes and their common prefixes give the internal
nodes of the subtree; nodes at least `size` words deep are the repeats.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from . import base, repeats
from .suffix_array import _span_arrays, neighbour_prefixes, packed, sort_directly


def subtree(common: np.ndarray) -> list[tuple[int, int, int]]:
    """Internal nodes (depth, first leaf, last leaf) of the suffix tree whose leaves, in order, share `common[i]` symbols with the one before."""
    nodes: list[tuple[int, int, int]] = []
    stack: list[tuple[int, int]] = []  # (depth, first leaf)
    depths = [*common.tolist()[1:], 0]
    for i, depth in enumerate(depths, 1):
        first = i - 1
        while stack and stack[-1][0] > depth:
            deep, first = stack.pop()
            nodes.append((deep, first, i - 1))
        if depth > 0 and (not stack or stack[-1][0] < depth):
            stack.append((depth, first))
    return nodes


def sorted_suffixes(parts: list[np.ndarray], n: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First n[i] suffixes of each part, in order: (places, common prefixes up to `depth`, start of each part)."""
    _, ranks = np.unique(np.concatenate(parts), return_inverse=True)
    lengths = np.array([len(p) for p in parts])
    start = np.cumsum(lengths + 1) - lengths - 1
    symbols = np.zeros(int((lengths + 1).sum()), np.uint64)
    symbols[np.arange(len(ranks)) + np.repeat(np.arange(len(parts)), lengths)] = ranks.ravel() + 1
    places = np.repeat(start, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    words = packed(symbols, 32, 2)
    order = sort_directly(words, places, depth, 2)
    return order, neighbour_prefixes(words, order, depth, symbols, 2), start


def resolve(parts: list[np.ndarray], n: np.ndarray, copies: np.ndarray, size: int) -> list[np.ndarray]:
    order, common, start = sorted_suffixes(parts, n, size)
    flags = np.zeros(int(start[-1] + len(parts[-1]) + 1), bool)
    for depth, first, last in subtree(common):
        if depth >= size:
            flags[order[first : last + 1]] = True
    return [flags[a : a + k] | (c >= 2) for a, k, c in zip(start, n, copies, strict=True)]


RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"


def substring_dedup(docs: DataFrame, size: int = 35, width: int = 6, id_col: str = "doc_id", text_col: str = "text", crowd: int = repeats.CROWD, texts: bool = True) -> DataFrame:
    """Removes from each text all words that a window of `size` consecutive words covers which also starts anywhere else in the corpus.

    Words are `[^\\x20\\x09-\\x0D]+`, unchanged; windows do not cross documents and are judged on the input. Returns one row
    for each input row: doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space), and with `texts`
    kept: the text without the removed words, its other white space as it was.
    A null text has no words and gives an empty kept; texts with fewer words keep all; rows that are alike are each other's
    copies; a null id stays null; an empty table gives an empty result; other columns are ignored.
    """
    rows = base.keyed(docs, id_col, text_col)
    found = repeats.with_spans(rows, repeats.spans(rows, repeats.Units("words", size, width), resolve, crowd))

    def of(batches):
        for batch in batches:
            raw, off = base.text_buffer(batch.column("text"))
            marks = _span_arrays(batch.column("spans"))
            out: list[list] = [[] for _ in range(4)]
            for i in range(batch.num_rows):
                for k, v in enumerate(cut_words(raw[off[i] : off[i + 1]], marks(i), size)):
                    out[k].append(v)
            arrays = [batch.column("id"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())]
            yield pa.RecordBatch.from_arrays(arrays + [pa.array(out[3], pa.string())] * texts, ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept"] * texts)

    return found.select("id", "text", "spans").mapInArrow(of, RESULT if texts else RESULT.split(", kept string")[0])


def cut_words(text: np.ndarray, marks, size: int) -> tuple[int, int, str, str]:
    """(words, removed words, digest of the kept words, the text without them)."""
    plain = text.tobytes()
    if marks is None:
        words = plain.split()
        return len(words), 0, hashlib.sha256(b" ".join(words)).hexdigest(), plain.decode()
    starts, ends, _ = base.word_spans(text, np.array([0, len(text)]))
    gone = repeats.covered(marks, len(starts), size)
    words = [plain[a:b] for a, b in zip(starts[~gone].tolist(), ends[~gone].tolist(), strict=True)]
    keep = np.ones(len(text), bool)
    for a, b in zip(*repeats.runs(gone, np.zeros(0, np.int64)), strict=True):
        keep[starts[a] : starts[b] if b < len(starts) else ends[b - 1]] = False
    return len(starts), int(gone.sum()), hashlib.sha256(b" ".join(words)).hexdigest(), text[keep].tobytes().decode()


def kept_texts(docs: DataFrame, size: int = 35, width: int = 6, id_col: str = "doc_id", text_col: str = "text", crowd: int = repeats.CROWD) -> DataFrame:
    """`docs` with the repeated windows removed from its texts. Rows that lose all their words go; null and blank texts stay as they are."""
    named = docs.withColumns(base.key_columns(id_col, text_col))
    found = repeats.spans(base.keyed(docs, id_col, text_col), repeats.Units("words", size, width), resolve, crowd)
    joined = named.join(found.withColumnsRenamed({"k1": "_k1", "k2": "_k2", "spans": "_spans"}), ["_k1", "_k2"], "left").drop("_k1", "_k2")
    names = docs.columns

    def of(batches):
        for batch in batches:
            raw, off = base.text_buffer(batch.column("_text"))
            marks = _span_arrays(batch.column("_spans"))
            text, fine = batch.column(text_col).to_pylist(), [True] * batch.num_rows
            for i in range(batch.num_rows):
                if (mark := marks(i)) is not None:
                    words, gone, _, text[i] = cut_words(raw[off[i] : off[i + 1]], mark, size)
                    fine[i] = gone < words
            arrays = [pa.array(text, pa.string()) if c == text_col else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(arrays, names).filter(pa.array(fine))

    schema = StructType([StructField(f.name, StringType()) if f.name == text_col else f for f in docs.schema.fields])
    return joined.withColumn("_text", F.col(text_col).cast("string")).mapInArrow(of, schema)
