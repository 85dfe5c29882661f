"""Operator 1: suffix-array dedup. Bytes that a repeated string of a given length covers are removed.

Suffix sorting in two stages: suffixes smaller than their successors (type B) are sorted directly, the others (type A)
follow from them by one scan over the buckets of first symbols; then the common prefixes of neighbours are computed.
The scan moves whole buckets and waves of equal symbols at a time instead of single suffixes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import base, repeats

PACK, BITS = 7, 9  # symbols in a 64-bit word


def packed(symbols: np.ndarray, bits: int = BITS, pack: int = PACK, stride: int = 1) -> np.ndarray:
    """At each place, the next `pack` symbols (each `stride` places on) in one word that compares as they do; zeros follow the end."""
    wide = np.zeros(len(symbols) + pack * stride, np.uint64)
    wide[: len(symbols)] = symbols
    out = np.zeros(len(symbols), np.uint64)
    for k in range(pack):
        out |= wide[k * stride : k * stride + len(symbols)] << np.uint64(bits * (pack - 1 - k))
    return out


def wider(words: np.ndarray, step: int) -> tuple[np.ndarray, int]:
    """Words of three times as many symbols (twice, if there are too many kinds) that compare as they do: each word gets its rank, and ranks are packed."""
    kinds, rank = np.unique(words, return_inverse=True)
    rank = rank.ravel().astype(np.uint64) + np.uint64(1)
    fold = 3 if len(kinds) < (1 << 21) - 1 else 2
    return packed(rank, 63 // fold, fold, step), step * fold


def sort_directly(words: np.ndarray, places: np.ndarray, depth: int, step: int = PACK) -> np.ndarray:
    """Places in the order of what follows them, compared to `depth` symbols at least; only ties are looked at again."""
    last = len(words)
    places = places[np.argsort(words[places], kind="stable")]
    new = np.ones(len(places), bool)
    new[1:] = words[places[1:]] != words[places[:-1]]
    group = np.cumsum(new) - 1
    idx = np.flatnonzero(np.bincount(group)[group] > 1) if len(group) else group
    g = group[idx]
    seen = step
    while seen < depth and len(idx):
        p = places[idx]
        at = p + seen
        key = np.where(at < last, words[np.minimum(at, last - 1)], np.uint64(0))
        order = np.lexsort((key, g))
        places[idx], key, g = p[order], key[order], g[order]
        split = np.ones(len(idx), bool)
        split[1:] = (key[1:] != key[:-1]) | (g[1:] != g[:-1])
        g = np.cumsum(split) - 1
        tied = np.bincount(g)[g] > 1
        idx, g = idx[tied], g[tied]
        seen += step
    return places


def types(symbols: np.ndarray) -> np.ndarray:
    """True where a suffix is larger than its successor (type A). The last suffix counts as type B."""
    n = len(symbols)
    falls = np.zeros(n, bool)
    falls[:-1] = symbols[:-1] > symbols[1:]
    decided = np.ones(n, bool)
    decided[:-1] = symbols[:-1] != symbols[1:]
    place = np.where(decided, np.arange(n), n)
    nearest = np.minimum.accumulate(place[::-1])[::-1]
    return falls[nearest]


def suffix_array(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of `symbols` (small integers, the last one 0 and smallest) in order of their first `depth` symbols."""
    is_a = types(symbols)
    words, step = packed(symbols), PACK
    while step * 4 < depth:  # long comparisons go by words of words
        words, step = wider(words, step)
    sorted_b = sort_directly(words, np.flatnonzero(~is_a), depth, step)
    top = int(symbols.max()) + 1
    bounds = np.searchsorted(symbols[sorted_b], np.arange(top + 1))
    waiting: list[list[np.ndarray]] = [[] for _ in range(top)]
    out: list[np.ndarray] = []

    def deal(places: np.ndarray, c: int) -> np.ndarray:
        """Puts predecessors of type A into their buckets; returns those of this same bucket."""
        before = places[places > 0] - 1
        before = before[is_a[before]]
        s = symbols[before]
        rest = before[s != c]
        if len(rest):
            s_rest = symbols[rest]
            order = np.argsort(s_rest, kind="stable")
            rest, s_rest = rest[order], s_rest[order]
            heads = np.flatnonzero(np.concatenate([[True], s_rest[1:] != s_rest[:-1]]))
            for x, y in zip(heads.tolist(), [*heads[1:].tolist(), len(rest)], strict=True):
                waiting[s_rest[x]].append(rest[x:y])
        return before[s == c]

    for c in range(top):
        wave = np.concatenate(waiting[c]) if waiting[c] else np.zeros(0, np.int64)
        while len(wave):
            out.append(wave)
            wave = deal(wave, c)
        direct = sorted_b[bounds[c] : bounds[c + 1]]
        if len(direct):
            out.append(direct)
            deal(direct, c)
        waiting[c] = []
    return np.concatenate(out)


def neighbour_prefixes(words: np.ndarray, order: np.ndarray, depth: int, symbols: np.ndarray, step: int = PACK) -> np.ndarray:
    """Common prefix of each suffix in `order` with the one before it, up to `depth`; 0 for the first."""
    got = np.zeros(len(order), np.int64)
    alive, last = np.arange(1, len(order)), len(words)
    for seen in range(0, depth, step):
        if not len(alive):
            break
        a, b = order[alive - 1] + seen, order[alive] + seen
        fine = (np.maximum(a, b) < last) & (words[np.minimum(a, last - 1)] == words[np.minimum(b, last - 1)])
        ended = alive[~fine]
        if len(ended):
            a, b = order[ended - 1] + seen, order[ended] + seen
            more, going = np.zeros(len(ended), np.int64), np.ones(len(ended), bool)
            for k in range(step):
                going &= (np.maximum(a, b) + k < last) & (symbols[np.minimum(a + k, last - 1)] == symbols[np.minimum(b + k, last - 1)])
                more += going
            got[ended] = seen + more
        alive = alive[fine]
        got[alive] = seen + step
    return np.minimum(got, depth)


def resolve(parts: list[np.ndarray], n: np.ndarray, copies: np.ndarray, size: int) -> list[np.ndarray]:
    """Which windows of `size` bytes occur twice: neighbours in the suffix array share `size` bytes, or the whole part has copies."""
    ends = np.cumsum([len(p) + 1 for p in parts])
    symbols = np.zeros(ends[-1], np.uint16)
    start = ends - [len(p) + 1 for p in parts]
    for p, a in zip(parts, start, strict=True):
        symbols[a : a + len(p)] = p
        symbols[a : a + len(p)] += 1
    is_window = np.zeros(len(symbols), bool)
    for a, k in zip(start, n, strict=True):
        is_window[a : a + k] = True
    order = suffix_array(symbols, size)
    order = order[is_window[order]]
    long = neighbour_prefixes(packed(symbols), order, size, symbols) >= size
    twice = long.copy()
    twice[:-1] |= long[1:]
    flags = np.zeros(len(symbols), bool)
    flags[order[twice]] = True
    return [flags[a : a + k] | (c >= 2) for a, k, c in zip(start, n, copies, strict=True)]


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, spans array<struct<start:int,end:int>>"


def suffix_array_dedup(docs: DataFrame, size: int = 400, width: int = 64, id_col: str = "doc_id", text_col: str = "text", crowd: int = repeats.CROWD, texts: bool = True) -> DataFrame:
    """Removes from each text all bytes that a string of `size` bytes covers which also starts anywhere else in the corpus.

    Strings do not cross documents and may overlap; they are judged on the input. Returns one row for each input row: doc_id,
    n_bytes, n_removed, n_spans, kept_sha256, and with `texts` also the kept bytes and the removed spans [start, end).
    A null text counts as empty; texts shorter than `size` keep all; rows that are alike, same id included, are each other's
    copies; a null id stays null; an empty table gives an empty result; other columns are ignored.
    """
    if not width <= size:
        raise ValueError("width must not exceed size")
    rows = base.keyed(docs, id_col, text_col)
    units = repeats.Units("bytes", size, width)
    found = repeats.with_spans(rows, repeats.spans(rows, units, resolve, crowd))

    def of(batches):
        for batch in batches:
            raw, off = base.text_buffer(batch.column("text"))
            marks = _span_arrays(batch.column("spans"))
            out: list[list] = [[] for _ in range(6)]
            for i in range(batch.num_rows):
                text = raw[off[i] : off[i + 1]]
                gone = repeats.covered(marks(i), len(text), size)
                a, b = repeats.runs(gone, np.zeros(0, np.int64))
                kept = text[~gone].tobytes()
                for k, v in enumerate((len(text), len(text) - len(kept), len(a), hashlib.sha256(kept).hexdigest(), kept, [{"start": int(x), "end": int(y)} for x, y in zip(a, b, strict=True)] if texts else None)):
                    out[k].append(v)
            arrays = [batch.column("id"), *(pa.array(v, pa.int64()) for v in out[:3]), pa.array(out[3], pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if texts:
                arrays += [pa.array(out[4], pa.binary()), pa.array(out[5], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))]
                names += ["kept", "spans"]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return found.select("id", "text", "spans").mapInArrow(of, RESULT if texts else RESULT.split(", kept binary")[0])


def _span_arrays(column: pa.Array):
    """Reader of a column of arrays of (first, n)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets, valid = column.offsets.to_numpy(), column.is_valid().to_numpy(zero_copy_only=False)
    first, n = (column.values.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("first", "n"))
    return lambda i: (first[offsets[i] : offsets[i + 1]], n[offsets[i] : offsets[i + 1]]) if valid[i] else None
