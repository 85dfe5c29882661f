"""Operator 6: best-fit packing with exact complements.

Packing sees only how many pieces there are of each length, at most `capacity` numbers whatever the corpus. Lengths are
taken from the longest down. What is missing to a full sequence is looked up in an index of single lengths, of sums of two and of sums of three
lengths, and combinations that fill it exactly are used as often as their counts allow. What is left goes, longest first,
into the open sequence with the smallest sufficient gap. The plan is a short list of (pieces of a sequence, times); each piece
then finds its place by its rank among the pieces of its length.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import small_side, stage, text_buffer
from .tokens import public_path, word_bpe

Plan = list[tuple[tuple[int, ...], int]]


class Complements:
    """Counts of lengths under an index of sums: for each sum asked for, the lengths that begin a pair or a triple with it, longest first.

    Counts only fall, so what has run out never comes back: an entry of the index keeps the place from which combinations may still be there.
    """

    def __init__(self, counts: np.ndarray):
        self.counts = counts.astype(np.int64).copy()
        self._pairs: dict[int, list] = {}  # sum: [first lengths, place]
        self._triples: dict[int, list] = {}

    def _there(self, lengths: tuple[int, ...], held: tuple[int, ...] = ()) -> bool:
        """Whether the lengths are available besides those held."""
        return all(self.counts[x] >= lengths.count(x) + held.count(x) for x in lengths)

    def single(self, gap: int, held: tuple[int, ...] = ()) -> tuple[int, ...] | None:
        return (gap,) if gap > 0 and self._there((gap,), held) else None

    def pair(self, gap: int, held: tuple[int, ...] = ()) -> tuple[int, ...] | None:
        """Two available lengths of this sum, the first as long as can be."""
        if gap < 2:
            return None
        entry = self._pairs.get(gap)
        if entry is None:
            have = self.counts[: gap + 1] > 0
            both = np.flatnonzero(have[1:gap] & have[1:gap][::-1]) + 1
            entry = self._pairs[gap] = [both[2 * both >= gap][::-1].tolist(), 0]
        first = entry[0]
        while entry[1] < len(first) and not self._there((first[entry[1]], gap - first[entry[1]])):
            entry[1] += 1
        for k in range(entry[1], len(first)):
            if self._there((first[k], gap - first[k]), held):
                return (first[k], gap - first[k])
        return None

    def triple(self, gap: int, held: tuple[int, ...] = ()) -> tuple[int, ...] | None:
        """Three available lengths of this sum. The longest of them is at least a third of it."""
        if gap < 3:
            return None
        entry = self._triples.get(gap)
        if entry is None:
            have = np.flatnonzero(self.counts[1 : gap - 1] > 0) + 1
            entry = self._triples[gap] = [have[3 * have >= gap][::-1].tolist(), 0]
        first = entry[0]
        for k in range(entry[1], len(first)):
            x = first[k]
            rest = self.pair(gap - x, (*held, x)) if self._there((x,), held) else None
            if rest:
                return (x, *rest)
            if k == entry[1] and (not self.counts[x] or not self.pair(gap - x, (x,))):
                entry[1] += 1
        return None

    def most(self, lengths: tuple[int, ...]) -> int:
        """How often the lengths are there together."""
        return min(int(self.counts[x]) // lengths.count(x) for x in set(lengths))

    def take(self, lengths: tuple[int, ...], times: int) -> None:
        for x in lengths:
            self.counts[x] -= times


def plan_sequences(counts: np.ndarray, capacity: int) -> Plan:
    """(lengths in a sequence, number of such sequences). counts[x]: pieces of length x, 0 < x <= capacity."""
    left, plan = Complements(counts), []
    for length in range(capacity, 0, -1):
        while left.counts[length] > 0:
            gap, own = capacity - length, (length,)
            fill = () if gap == 0 else left.single(gap, own) or left.pair(gap, own) or left.triple(gap, own)
            if fill is None:
                break
            lengths = (length, *fill)
            times = left.most(lengths)
            left.take(lengths, times)
            plan.append((lengths, times))
    return plan + best_fit(left.counts, capacity)


def best_fit(counts: np.ndarray, capacity: int) -> Plan:
    """Longest first, each piece into the open sequence with the smallest sufficient gap; alike sequences are handled together."""
    open_by_gap: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    is_open = np.zeros(capacity + 1, bool)

    def put(lengths: tuple[int, ...], times: int, gap: int) -> None:
        open_by_gap.setdefault(gap, []).append((lengths, times))
        is_open[gap] = True

    for length in np.flatnonzero(counts)[::-1].tolist():
        n = int(counts[length])
        while n:
            gaps = np.flatnonzero(is_open[length:])
            if len(gaps):
                gap = int(gaps[0]) + length
                lengths, times = open_by_gap[gap].pop()
                if not open_by_gap[gap]:
                    is_open[gap] = False
            else:
                gap, lengths, times = capacity, (), n
            each = min(gap // length, n)
            used = min(times, n // each)
            if used < times and lengths:
                put(lengths, times - used, gap)
            put(lengths + (length,) * each, used, gap - each * length)
            n -= each * used
    return [x for same in open_by_gap.values() for x in same]


def slots(plan: Plan) -> dict[str, np.ndarray]:
    """Where the pieces of each length go: pieces first..first + times - 1 of a length fill one place of `times` sequences from `sequence` on. Sorted by length and first."""
    rows, used, sequence = [], {}, 0
    for lengths, times in plan:
        offset = 0
        for x in lengths:
            rows.append((x, used.get(x, 0), times, sequence, offset))
            used[x] = used.get(x, 0) + times
            offset += x
        sequence += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("length", "first", "times", "sequence", "offset"), table.T.copy(), strict=True))


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, capacity: int, path: str, end_id: int, ids: bool, id_col: str, text_col: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Each document's ids, cut after every `capacity`, with its whole numbers in the columns `keep`."""

    def of(batches):
        words = word_bpe(path)
        tail = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            raw, off = text_buffer(batch.column("text"))
            out: list[list] = [[] for _ in range(6)]
            for i in range(batch.num_rows):
                got = words.text(raw[off[i] : off[i + 1]].tobytes()) + tail
                for k, at in enumerate(range(0, len(got), 4 * capacity)):
                    part = got[at : at + 4 * capacity]
                    for kept, v in zip(out, (i, k, at // 4, len(part) // 4, zlib.crc32(part), np.frombuffer(part, "<i4") if ids else None), strict=True):
                        kept.append(v)
            arrays = [batch.column("id").take(pa.array(out[0], pa.int64())), *(pa.array(v, t) for v, t in zip(out[1:5], (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True))]
            more = [batch.column(c).take(pa.array(out[0], pa.int64())) for c in keep]
            yield pa.RecordBatch.from_arrays(arrays + [pa.array(out[5], pa.list_(pa.int32()))] * ids + more, ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * ids + list(keep))

    needed = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), *(F.col(c).cast("long").alias(c) for c in keep))
    return needed.mapInArrow(of, PIECES + ", ids array<int>" * ids + "".join(f", {c} long" for c in keep))


def best_fit_packing(docs: DataFrame, capacity: int = 4096, path: str | None = None, end_id: int = 1, ids: bool = False, buckets: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packs all documents into few sequences of at most `capacity` tokens.

    One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and with `ids` the token ids.
    A document is its ids and `end_id`; a null or empty text is `end_id` alone; only documents longer than `capacity` are cut. Rows that
    are alike are packed each for itself; null ids stay; an empty table gives an empty result; other columns are ignored.

    `buckets` splits the pieces of one length, of which there may be any number, for counting ranks.
    """
    spark = docs.sparkSession
    cut = stage(pieces(docs, capacity, path or public_path("word_bpe_49k.json"), end_id, ids, id_col, text_col), "pieces")
    cut = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int"))
    sizes = cut.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).drop("n")
    counts = np.zeros(capacity + 1, np.int64)
    for row in cut.groupBy("length").count().collect():  # at most `capacity` rows
        counts[row["length"]] = row["count"]
    where = spark.sparkContext.broadcast(slots(plan_sequences(counts, capacity)))  # bounded by capacity
    ranked = cut.withColumn("own", F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece")) - 1).join(before, ["length", "bucket"])
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * ids

    def place(batches):
        table = where.value
        span = int(table["first"].max() + table["times"].max() + 1) if len(table["first"]) else 1
        heads = table["length"] * span + table["first"]
        for batch in batches:
            length, rank = (batch.column(k).to_numpy() for k in ("length", "rank"))
            k = np.searchsorted(heads, length * span + rank, "right") - 1
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + [pa.array(table["sequence"][k] + rank - table["first"][k]), pa.array(table["offset"][k])], [*names, "sequence_id", "offset"])

    return ranked.select(*names, (F.col("own") + F.col("before")).alias("rank")).mapInArrow(place, PIECES + ", ids array<int>" * ids + ", sequence_id long, offset long")


PLACED = PIECES + ", sequence long, offset long, range long"


def pack_range(table: pa.Table, capacity: int) -> pa.Table:
    """Packs the pieces of one range. Those of a length take their places in the order of slots, and sequences are numbered by their earliest piece."""
    slot, begin, doc, piece = (table[c].cast(pa.int64()).fill_null(-(2**63)).to_numpy() for c in ("_slot", "_start", "doc_id", "piece"))
    table = table.take(pa.array(np.lexsort((piece, doc, begin, slot))))
    length = table["length"].to_numpy()
    where = slots(plan_sequences(np.bincount(length, minlength=capacity + 1), capacity))
    by_length = np.argsort(length, kind="stable")
    rank = np.empty(len(length), np.int64)
    rank[by_length] = np.arange(len(length)) - np.searchsorted(length[by_length], length[by_length], "left")
    span = int(where["first"].max() + where["times"].max() + 1)
    k = np.searchsorted(where["length"] * span + where["first"], length * span + rank, "right") - 1
    _, first, which = np.unique(where["sequence"][k] + rank - where["first"][k], return_index=True, return_inverse=True)
    number = np.empty(len(first), np.int64)
    number[np.argsort(first)] = np.arange(len(first))
    names = [x.split()[0] for x in PIECES.split(", ")]
    return pa.table([*(table[c] for c in names), pa.array(number[which]), pa.array(where["offset"][k]), table["range"]], [*names, "sequence", "offset", "range"])


def best_fit_by_slot(docs: DataFrame, capacity: int = 4096, path: str | None = None, end_id: int = 1, unit: int = 10, fill: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packs documents that have a place in a mixture (_slot, _start; see `mixing.scheduled`), so that the sequences follow it. Columns as of `best_fit_packing`.

    Slots are cut into ranges of whole units of `unit` slots and about `fill` sequences. Each range is packed for itself, and ranges are
    numbered in their order, so sequences hold the mixture range by range. A range costs at most a few sequences that are not full.
    Null and repeated ids, null texts and empty tables are handled as there; texts without a byte share the slot of their neighbours and
    come to one range, whatever their number.
    """
    cut = stage(pieces(docs, capacity, path or public_path("word_bpe_49k.json"), end_id, False, id_col, text_col, ("_slot", "_start")), "pieces")
    cut = cut.withColumn("unit", F.expr(f"_slot div {unit}"))
    in_order = Window.orderBy("unit")  # a row for each `unit` slots
    sums = cut.groupBy("unit").agg(F.sum("length").alias("n"))
    ranges = small_side(sums.select("unit", F.floor((F.sum("n").over(in_order) - F.col("n")) / (fill * capacity)).cast("long").alias("range")), "ranges")

    def of(table: pa.Table) -> pa.Table:
        return pack_range(table, capacity)

    placed = stage(cut.join(ranges, "unit").drop("unit").groupBy("range").applyInArrow(of, PLACED), "placed")
    ends = placed.groupBy("range").agg((F.max("sequence") + 1).alias("n"))
    before = small_side(ends.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("before")), "before")
    names = [x.split()[0] for x in PIECES.split(", ")]
    return placed.join(before, "range").select(*names, (F.col("sequence") + F.col("before")).alias("sequence_id"), "offset")
