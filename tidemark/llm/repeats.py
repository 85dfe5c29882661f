"""Windows of L units that occur twice or more anywhere in a corpus, found exactly without sorting the whole corpus.

A unit is a byte or a word. A window's *anchor* is the stretch of `width` units in it with the smallest hash (the
leftmost of equals), which depends on the window's content alone: equal windows have equal anchors at equal places. Runs of
consecutive windows with the same anchor are *chunks*; a chunk's *context* is all that its windows cover.

1. `anchors`: each row's chunks as (anchor, digest of the context, row, place). About one chunk for each (L - width) / 2 units.
2. `occurrences`: chunks whose anchor occurs twice or more. An anchor all of whose contexts are alike needs no comparison: every
   window in it is repeated. That settles copies, however many, with map-side combination alone.
3. Where an anchor has different contexts, one context of each kind, with its number of copies, goes to a *resolver*
   (suffix array or suffix trees), which says which windows of it are repeated. All equal windows meet there.
4. The contexts of an anchor that come to more than `crowd` units (the edge of a passage that a large share of the corpus holds) are rows by themselves:
   they are dealt by wider anchors, from step 1 on, until each group fits into a task. The widest is the whole window: such groups are of one content.
   The texts are not moved again for that.
5. `spans`: by row, the stretches of windows that are repeated.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base
from .base import BASE_A, BASE_B, U64, Poly, signed, stage

PLACE_BITS = 24
BLOCK = 1 << 18  # windows looked at together
CROWD = 1 << 22  # units of a group; sorting takes some 50 bytes for each, so about 200 MB of a task
ANCHORS = "anchor long, digest long, k1 long, k2 long, start long, n int"
CONTEXTS = "anchor long, digest long, copies long, n int, units binary"
MARKS = "anchor long, digest long, first int, n int"


class Units:
    """How a text is cut to units. kind: "bytes", "words" or "hashes" (contexts of words); size: units in a window; width: units in an anchor."""

    def __init__(self, kind: str, size: int, width: int):
        self.kind, self.size, self.width = kind, size, width

    def of(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Units of a run of rows, and each row's first unit (n + 1 entries)."""
        if self.kind == "bytes":
            return base.BYTE_UNITS[raw], offsets
        if self.kind == "hashes":
            return np.frombuffer(raw.tobytes(), U64), offsets // 8
        starts, ends, first = base.word_spans(raw, offsets)
        return base.word_units(raw, starts, ends), first

    def wider(self) -> Units:
        """Units of the contexts, with anchors whose distance to the whole window is an eighth of what it was."""
        return Units("bytes" if self.kind == "bytes" else "hashes", self.size, self.size - (self.size - self.width) // 8)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    have, reach = x, 1
    while reach < width:
        step = min(reach, width - reach)
        have = np.minimum(have[: len(have) - step], have[step:])
        reach += step
    return have


def chunks_of(units: np.ndarray, first: np.ndarray, size: int, width: int) -> dict[str, np.ndarray]:
    """Chunks of the rows whose units lie at first[i]:first[i+1]: arrays row, start (unit within the row), n, anchor, digest."""
    out: dict[str, list[np.ndarray]] = {k: [] for k in ("row", "start", "n", "anchor", "digest")}
    lengths = np.diff(first)
    for lo, hi in _blocks(first, lengths, size):
        part = units[lo : hi + size - 1]
        total = len(part)
        if total < size:
            continue
        row_of = np.searchsorted(first, np.arange(lo, hi), "right") - 1
        valid = np.arange(lo, hi) + size <= first[row_of + 1]
        grams = Poly(part, BASE_A).windows(width)
        keep = (grams >> U64(PLACE_BITS)) << U64(PLACE_BITS)
        best = sliding_min(keep | np.arange(len(grams), dtype=U64), size - width + 1)[: hi - lo]
        place = (best & U64((1 << PLACE_BITS) - 1)).astype(np.int64)
        at = np.flatnonzero(valid[: len(place)])
        if not len(at):
            continue
        p, r = place[at], row_of[at]
        new = np.ones(len(at), bool)
        new[1:] = (p[1:] != p[:-1]) | (r[1:] != r[:-1])
        head = np.flatnonzero(new)
        n = np.diff(np.append(head, len(at)))
        start, anchor_at, row = at[head], p[head], r[head]
        whole = Poly(part, BASE_B).of(start, start + n + size - 1)
        with np.errstate(over="ignore"):
            digest = base.mix(whole + (anchor_at - start).astype(U64) * U64(BASE_A) + n.astype(U64))
        out["row"].append(row)
        out["start"].append(start + lo - first[row])
        out["n"].append(n)
        out["anchor"].append(grams[anchor_at])
        out["digest"].append(digest)
    return {k: np.concatenate(v) if v else np.zeros(0, U64 if k in ("anchor", "digest") else np.int64) for k, v in out.items()}


def _blocks(first: np.ndarray, lengths: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Stretches [lo, hi) of window starts, of about BLOCK each; rows are cut only where they are longer."""
    i, n = 0, len(lengths)
    while i < n:
        if lengths[i] > BLOCK:
            for lo in range(int(first[i]), int(first[i + 1]), BLOCK):
                yield lo, min(lo + BLOCK, int(first[i + 1]))
            i += 1
            continue
        j = i + 1
        while j < n and lengths[j] <= BLOCK and first[j + 1] - first[i] <= BLOCK:
            j += 1
        yield int(first[i]), int(first[j])
        i = j


# ---------------------------------------------------------------- Spark side

#: A resolver gets distinct runs of units (arrays), each with its number of windows and of copies, and says for each window of each whether it is repeated.
Resolver = Callable[[list[np.ndarray], np.ndarray, np.ndarray, int], list[np.ndarray]]


def anchors(rows: DataFrame, units: Units) -> DataFrame:
    """One row for each chunk of each row of `rows` (k1, k2, text)."""

    def of(batches):
        for batch in batches:
            raw, off = base.text_buffer(batch.column("text"))
            k1, k2 = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("k1", "k2"))
            for i, j in base.row_runs(off):
                got = chunks_of(*units.of(raw[off[i] : off[j]], off[i : j + 1] - off[i]), units.size, units.width)
                if len(got["row"]):
                    row = got["row"] + i
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(signed(got["anchor"])), pa.array(signed(got["digest"])), pa.array(k1[row]), pa.array(k2[row]), pa.array(got["start"]), pa.array(got["n"].astype(np.int32))],
                        ["anchor", "digest", "k1", "k2", "start", "n"],
                    )

    return rows.select("k1", "k2", "text").mapInArrow(of, ANCHORS)


def _stretches(batches, units: Units, emit):
    """For rows (text, wanted: array of structs with start and n): emit(wanted row number, units, first unit, wanted structs flattened)."""
    for batch in batches:
        raw, off = base.text_buffer(batch.column("text"))
        wanted = batch.column("wanted")
        ends = wanted.offsets.to_numpy()
        flat = wanted.values
        cols = {f.name: flat.field(f.name).to_numpy(zero_copy_only=False) for f in flat.type}
        for i, j in base.row_runs(off):
            u, first = units.of(raw[off[i] : off[j]], off[i : j + 1] - off[i])
            item = np.arange(ends[i], ends[j])
            row = np.searchsorted(ends, item, "right") - 1
            if len(item):
                yield from emit(batch, raw[off[i] : off[j]], u, row, first[row - i], {k: v[item] for k, v in cols.items()})


def _one_of_alike(batches):
    """Batches without the rows that have the k1 and k2 of the row before. A join on these brings rows that are alike together."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        k1, k2 = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("k1", "k2"))
        new = np.ones(len(k1), bool)
        new[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
        new[0] = last != (k1[0], k2[0])
        last = (k1[-1], k2[-1])
        yield batch if new.all() else batch.filter(pa.array(new))


def contexts(rows: DataFrame, kinds: DataFrame, units: Units) -> DataFrame:
    """The units of one context of each kind, read from the text it stands in. Bytes go as they are, words as 64-bit hashes."""
    wanted = kinds.select("one.k1", "one.k2", F.struct("anchor", "digest", "copies", "one.start", "one.n").alias("w")).groupBy("k1", "k2").agg(F.collect_list("w").alias("wanted"))

    def emit(batch, raw, u, row, at, w):
        a, b = at + w["start"], at + w["start"] + w["n"] + units.size - 1
        source = raw if units.kind == "bytes" else u
        cut = [source[x:y].tobytes() for x, y in zip(a.tolist(), b.tolist(), strict=True)]
        step = 2000
        for k in range(0, len(cut), step):
            s = slice(k, k + step)
            yield pa.RecordBatch.from_arrays([pa.array(w["anchor"][s]), pa.array(w["digest"][s]), pa.array(w["copies"][s]), pa.array(w["n"][s].astype(np.int32)), pa.array(cut[s], pa.binary())], ["anchor", "digest", "copies", "n", "units"])

    return rows.select("k1", "k2", "text").join(wanted.hint("merge"), ["k1", "k2"]).mapInArrow(lambda b: _stretches(_one_of_alike(b), units, emit), CONTEXTS)


def compared(found: DataFrame, units: Units, resolve: Resolver, limit: int = 1 << 20) -> DataFrame:
    """Marks: stretches of repeated windows, counted from a context's first window. All contexts of an anchor are compared together, and many anchors at a time."""
    kind = np.uint8 if units.kind == "bytes" else U64

    def of(batches):
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for item in zip(*(batch.column(k).to_pylist() for k in ("anchor", "digest", "copies", "n", "units")), strict=True):
                if size >= limit and item[0] != held[-1][0]:
                    yield from settle(held)
                    held, size = [], 0
                held.append(item)
                size += len(item[4])
        if held:
            yield from settle(held)

    def settle(held):
        held = list({item[:2]: item for item in held}.values())  # a context that rows which are alike have each sent counts once
        marks = repeated(units_of := [np.frombuffer(x[4], kind) for x in held], np.array([x[3] for x in held]), np.array([x[2] for x in held]), units.size, resolve)
        del units_of
        if len(marks[0]):
            which = marks[0]
            yield pa.RecordBatch.from_arrays(
                [pa.array([held[i][0] for i in which], pa.int64()), pa.array([held[i][1] for i in which], pa.int64()), pa.array(marks[1].astype(np.int32)), pa.array(marks[2].astype(np.int32))],
                ["anchor", "digest", "first", "n"],
            )

    return found.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(of, MARKS)


def runs(flags: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true flags; a run also ends before each index in `cuts`."""
    here = np.zeros(len(flags) + 1, bool)
    here[:-1] = flags
    cut = np.zeros(len(flags) + 1, bool)
    cut[cuts] = True
    before = np.zeros(len(flags) + 1, bool)
    before[1:] = flags
    return np.flatnonzero(here & (~before | cut)), np.flatnonzero(before & (~here | cut))


def repeated(parts: list[np.ndarray], n: np.ndarray, copies: np.ndarray, size: int, resolve: Resolver) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, first window, windows) of the stretches that the resolver finds repeated."""
    out: list[list[np.ndarray]] = [[], [], []]
    for i, flags in enumerate(resolve(parts, n, copies, size)):
        x, y = runs(flags, np.zeros(0, np.int64))
        out[0].append(np.full(len(x), i))
        out[1].append(x)
        out[2].append(y - x)
    return tuple(np.concatenate(v) for v in out)  # type: ignore[return-value]


def stretches(rows: DataFrame, units: Units, resolve: Resolver, crowd: int) -> DataFrame:
    """(k1, k2, first, n): stretches of repeated windows of `rows` (k1, k2, text)."""
    entries = stage(anchors(rows, units), "anchors")
    counts = entries.groupBy("anchor").agg(F.count(F.lit(1)).alias("c"), F.min("digest").alias("lo"), F.max("digest").alias("hi")).filter("c >= 2")
    # written first, so that both sides of the join are plain exchanges and Spark can split an anchor that many chunks have
    counts = stage(counts.select("anchor", (F.col("lo") != F.col("hi")).alias("mixed")), "repeated")
    occ = stage(entries.join(counts, "anchor"), "occurrences")
    alike = occ.filter("not mixed").select("k1", "k2", F.col("start").cast("int").alias("first"), "n")
    mixed = occ.filter("mixed")
    kinds = stage(mixed.groupBy("anchor", "digest").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("k1", "k2", "start", "n")).alias("one")), "kinds")
    crowded = kinds.groupBy("anchor").agg(F.sum(F.col("one.n") + units.size - 1).alias("c")).filter(F.col("c") > crowd).select("anchor")
    found = contexts(rows, kinds, units)
    if units.width == units.size or not crowded.take(1):
        marks = compared(found, units, resolve)
    else:
        crowded = base.small_side(crowded, "crowded")
        found = stage(found, "contexts")
        # a window of a context is repeated if another of these contexts has it, or if the context has copies
        apart = found.join(crowded, "anchor", "left_semi").select(F.col("anchor").alias("k1"), F.col("digest").alias("k2"), F.col("units").alias("text"))
        marks = compared(found.join(crowded, "anchor", "left_anti"), units, resolve)
        marks = marks.unionByName(stretches(apart, units.wider(), resolve, crowd).withColumnsRenamed({"k1": "anchor", "k2": "digest"}))
        marks = marks.unionByName(kinds.join(crowded, "anchor", "left_semi").filter("copies >= 2").select("anchor", "digest", F.lit(0).alias("first"), "one.n"))
    met = mixed.join(marks.withColumnRenamed("n", "m"), ["anchor", "digest"])
    return alike.unionByName(met.select("k1", "k2", (F.col("start") + F.col("first")).cast("int").alias("first"), F.col("m").alias("n")))


def spans(rows: DataFrame, units: Units, resolve: Resolver, crowd: int = CROWD) -> DataFrame:
    """(k1, k2, spans: array of (first, n)): stretches of repeated windows of each row of `rows` (k1, k2, text) that has any. Stretches may overlap or touch.

    Rows that are alike in k1 and k2 count as so many copies.
    """
    return stretches(rows, units, resolve, crowd).groupBy("k1", "k2").agg(F.collect_set(F.struct("first", "n")).alias("spans"))


def with_spans(rows: DataFrame, found: DataFrame) -> DataFrame:
    return rows.join(found.hint("merge"), ["k1", "k2"], "left")  # texts are shuffled at any size


def covered(spans_of: list[tuple[int, int]] | None, total: int, size: int) -> np.ndarray:
    """Flags of the units that lie in a repeated window."""
    edge = np.zeros(total + 1, np.int32)
    if spans_of is not None and len(spans_of):
        first, n = spans_of
        np.add.at(edge, first, 1)
        np.add.at(edge, np.minimum(first + n + size - 1, total), -1)
    return np.cumsum(edge[:-1]) > 0
