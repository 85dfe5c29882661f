"""Operator 7: n-gram Jaccard join by rare-first prefix filtering.

A document is its set of word n-grams, as 64-bit hashes. Documents with equal sets are one *class*. Two sets of sizes x and y reach
the threshold only if the first `size - ceil(threshold * size) + 1` n-grams of each, in any one order of all n-grams, have one in common.

The order is rare-first. Counting all n-grams exactly would move the corpus several times over, and only prefixes matter. So a fixed
share of all n-grams, the *zone*, chosen by their hash, comes first, rarest first by exact counts. It is a little larger than a
prefix, so nearly all prefixes lie inside. A document whose zone has too few n-grams adds, from the rest, ordered by counts of
hash buckets, exactly those that its prefix still needs. Frequent n-grams by the bucket counts are not part of the zone, so none of them gathers the corpus in a task.

N-grams that only one set has lead the order and can match nothing: a document with a prefix of such ones drops out here. The others meet
at their shared prefix n-grams, where length, position, the number of shared zone n-grams and 256 parities of their n-grams rule most pairs
out. Sets that hold an n-gram which too many prefixes share meet by parts instead: sets that reach the threshold differ in few n-grams, so that of
one more hash-chosen parts than that, one at least is equal in both (`pieces`). Groups that the rest
connect are compared, in tiles of bounded size: at the first n-gram that a
pair has in common, length and positional filters apply, then the suffix filter (overlap bounded by how many hashes
fall into each of some ranges), then the sets themselves are compared, once for each pair. Links leave a tile as one label for each class, so
large groups of near copies make no rows for pairs.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import base
from .base import BASE_A, BASE_B, LOWER, U64, Poly, mix, signed, stage
from .components import components

SKETCH_BITS, BLOCK_BITS = 20, 12
RANGES = 32  # of the suffix filter
SIGN = ("s0", "s1", "s2", "s3")  # parities of a set
TILE, TILE_GRAMS = 1024, 1 << 21  # classes and n-grams of a side of a tile, about


def shingles(raw: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct word k-grams of each row, sorted; a row with fewer words has all of them as one."""
    raw = LOWER[raw]
    starts, ends, first = base.word_spans(raw, off)
    n_words = np.diff(first)
    poly = Poly(base.word_units(raw, starts, ends), BASE_A)
    row = np.repeat(np.arange(len(n_words)), np.maximum(n_words - k + 1, 0))
    at = first[:-1][row] + np.arange(len(row)) - np.repeat(np.cumsum(np.maximum(n_words - k + 1, 0)) - np.maximum(n_words - k + 1, 0), np.maximum(n_words - k + 1, 0))
    few = np.flatnonzero((n_words > 0) & (n_words < k))
    with np.errstate(over="ignore"):
        h = np.concatenate([poly.of(at, at + k), mix(poly.of(first[few], first[few + 1]) + n_words[few].astype(U64))])
    row = np.concatenate([row, few])
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return row[new], h[new]


def digests(row: np.ndarray, h: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size and two digests of each row's set."""
    n = np.bincount(row, minlength=rows)
    ends = np.concatenate([[0], np.cumsum(n)])
    one, two = (np.concatenate([[U64(0)], np.cumsum(mix(h ^ U64(salt)), dtype=U64)]) for salt in (BASE_A, BASE_B))
    with np.errstate(over="ignore"):
        return n, mix((one[ends[1:]] - one[ends[:-1]]) + n.astype(U64)), mix((two[ends[1:]] - two[ends[:-1]]) ^ n.astype(U64))


def parities(row: np.ndarray, h: np.ndarray, rows: int) -> np.ndarray:
    """Of each row's set, whether an odd number of n-grams falls into each of 256 hash ranges, as bits of four numbers. Two sets differ in as many n-grams, at least, as these in bits."""
    out = np.zeros((rows, len(SIGN)), U64)
    np.bitwise_xor.at(out, (row, ((h >> U64(46)) & U64(3)).astype(np.int64)), U64(1) << ((h >> U64(40)) & U64(63)))
    return out


def _buckets(h: np.ndarray) -> np.ndarray:
    return (h >> U64(64 - SKETCH_BITS)).astype(np.int64)


def sketch(rows: DataFrame, k: int) -> np.ndarray:
    """In how many documents the n-grams of each of 2**SKETCH_BITS hash buckets stand. Its size is fixed, whatever the corpus."""

    def of(batches):
        total = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            raw, off = base.text_buffer(batch.column("text"))
            for i, j in base.row_runs(off):
                total += np.bincount(_buckets(shingles(raw[off[i] : off[j]], off[i : j + 1] - off[i], k)[1]), minlength=len(total))
        parts = total.reshape(-1, 1 << BLOCK_BITS)
        used = [(b, np.flatnonzero(p)) for b, p in enumerate(parts) if p.any()]
        used = [(b, at if 3 * len(at) < parts.shape[1] else None) for b, at in used]  # None: all counts of the block, in order
        if used:
            where = [None if at is None else at.astype(np.uint16).tobytes() for _, at in used]
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in used], pa.int32()), pa.array(where, pa.binary()), pa.array([(parts[b] if at is None else parts[b][at]).astype(np.uint32).tobytes() for b, at in used], pa.binary())], ["block", "at", "n"])

    def add(group: pa.Table) -> pa.Table:
        total = np.zeros(1 << BLOCK_BITS, np.int64)
        for at, n in zip(group["at"].to_pylist(), group["n"].to_pylist(), strict=True):
            total[slice(None) if at is None else np.frombuffer(at, np.uint16)] += np.frombuffer(n, np.uint32)
        return pa.table({"block": group["block"][:1], "n": pa.array([total.tobytes()], pa.binary())})

    found = np.zeros(1 << SKETCH_BITS, np.int64).reshape(-1, 1 << BLOCK_BITS)
    for r in rows.select("text").mapInArrow(of, "block int, at binary, n binary").groupBy("block").applyInArrow(add, "block int, n binary").collect():
        found[r["block"]] = np.frombuffer(r["n"], np.int64)
    return found.ravel()


ENTRIES = "token long, node long, aux long"
MEMBERS = "k1 long, k2 long, id long, d1 long, d2 long, n int, prefix int, zone int, s0 long, s1 long, s2 long, s3 long"
LIGHT = -1  # aux of an n-gram of the zone; else bucket count and place in the prefix, in one number


def entries(rows: DataFrame, k: int, num: int, den: int, counts, members: bool) -> DataFrame:
    """With `members`, each row of the table with its set's digests, size, prefix length and number of n-grams in the zone. Without, (token, node, aux):
    the n-grams of each set, its first digest as node, that are in the zone, and those that its prefix needs besides."""
    share = min(1.0, 1.15 * (den - num) / den + 0.01)
    limit = U64(int(share * ((1 << 32) - 1)))

    def of(batches):
        rough_of = counts.value
        heavy = 64 * rough_of.mean() + 1000
        seen: set[int] = set()
        for batch in batches:
            raw, off = base.text_buffer(batch.column("text"))
            for i, j in base.row_runs(off):
                row, h = shingles(raw[off[i] : off[j]], off[i : j + 1] - off[i], k)
                n, d1, d2 = digests(row, h, j - i)
                prefix = np.where(n > 0, n - -(-num * n // den) + 1, 0)
                rough = rough_of[_buckets(h)]
                light = ((h & U64(0xFFFFFFFF)) <= limit) & (rough <= heavy)
                zone = np.bincount(row[light], minlength=j - i)
                if members:
                    arrays = [batch.column(c)[i:j] for c in ("k1", "k2", "id")] + [pa.array(signed(d1)), pa.array(signed(d2))]
                    yield pa.RecordBatch.from_arrays(arrays + [pa.array(v.astype(np.int32)) for v in (n, prefix, zone)] + [pa.array(v) for v in signed(parities(row, h, j - i)).T], [x.split()[0] for x in MEMBERS.split(", ")])
                    continue
                order = np.lexsort((signed(h), rough, light, row))  # in each row the others, in the order in which compare() visits them, then the zone
                place = np.arange(len(row)) - np.searchsorted(row, row, "left")
                needed = (place < np.maximum(prefix - zone, 0)[row[order]]) & ~light[order]
                more, more_pos = order[needed], zone[row[order[needed]]] + place[needed]
                if len(seen) > 1_000_000:
                    seen.clear()
                fresh = np.zeros(j - i, bool)  # copies within a partition are entered once
                for x, d in enumerate(d1.tolist()):
                    if d not in seen:
                        seen.add(d)
                        fresh[x] = True
                a, keep = np.flatnonzero(light & fresh[row]), fresh[row[more]]
                at = np.concatenate([a, more[keep]])
                aux = np.concatenate([np.full(len(a), LIGHT), np.minimum(rough[more[keep]], 1 << 38) << 24 | more_pos[keep]])
                yield pa.RecordBatch.from_arrays([pa.array(signed(h[at])), pa.array(signed(d1[row[at]])), pa.array(aux.astype(np.int64))], ["token", "node", "aux"])

    return rows.select("k1", "k2", "id", "text").mapInArrow(of, MEMBERS if members else ENTRIES)


MEETING = 1024  # prefixes that an n-gram may have for their pairs to be looked at there; the sets of more meet by parts
JOINED = 1 << 13  # sets with an equal part whose pairs are looked at; more than that are joined, for the tiles to compare
MET = "token long, node long, n int, pos int, rest int, known int, s0 long, s1 long, s2 long, s3 long"


def _meet(batches, num: int, den: int):
    """Edges between sets that meet at an n-gram or part (rows of MET, sorted) and that filters leave possible, as one label for each.

    A pair overlaps by at most what is left of the shorter one from the n-gram on, and by at most the zone n-grams that either shares with
    any set plus its n-grams outside of the zone. It differs by at least the parities that differ.
    """
    names = [x.split()[0] for x in MET.split(", ")]
    held: list[np.ndarray] | None = None

    def settle(cols: list[np.ndarray]):
        token, node, n, pos, rest, known = cols[:6]
        sign = np.stack(cols[6:], 1).view(U64)
        head = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        size = np.diff(np.append(head, len(token)))
        out: list[tuple[np.ndarray, np.ndarray]] = []

        def fine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            need = -(-num * (n[x] + n[y]) // (den + num))
            similar = den * np.minimum(n[x], n[y]) >= num * np.maximum(n[x], n[y])
            left = np.minimum(n[x] - pos[x], n[y] - pos[y]) >= need
            zone = np.minimum(known[x], known[y]) + np.minimum(rest[x], rest[y]) >= need
            return (similar & left & zone) | (n[x] < 0) | (n[y] < 0)

        def close(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            differ = np.bitwise_count(sign[x] ^ sign[y]).sum(1, dtype=np.int64)
            return ((den + num) * differ <= (den - num) * (n[x] + n[y])) | (n[x] < 0) | (n[y] < 0)

        two = head[size == 2]
        two = two[fine(two, two + 1)]
        two = two[close(two, two + 1)]
        out.append((node[two], node[two + 1]))
        for h, k in zip(head[size > 2].tolist(), size[size > 2].tolist(), strict=True):
            if k > JOINED:
                out.append((node[h + 1 : h + k], np.full(k - 1, node[h])))
                continue
            i = h + np.argsort(n[h : h + k], kind="stable")
            label = np.arange(k)
            step = max(1, (1 << 20) // k)
            for lo in range(0, k, step):  # a set against those that are not smaller, nor too large, nor connected with it by then
                x = np.arange(lo, min(lo + step, k))
                end = k if n[i[0]] < 0 else int(np.searchsorted(n[i], den * n[i[x[-1]]] // num, "right"))
                y = np.arange(lo, end)
                a, b = np.nonzero((label[x][:, None] != label[y][None, :]) & (x[:, None] < y[None, :]) & fine(i[x][:, None], i[y][None, :]))
                a, b = x[a], y[b]
                linked = close(i[a], i[b])
                moved = np.flatnonzero(label != np.arange(k))
                label = local_labels(k, np.concatenate([a[linked], moved]), np.concatenate([b[linked], label[moved]]))
            moved = np.flatnonzero(label != np.arange(k))
            out.append((node[i[moved]], node[i[label[moved]]]))
        a, b = (np.concatenate(v) for v in zip(*out, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    for batch in batches:
        cols = [pc.fill_null(batch.column(c), -1).to_numpy(zero_copy_only=False).astype(np.int64) for c in names]
        if held is not None:
            cols = [np.concatenate([x, y]) for x, y in zip(held, cols, strict=True)]
        if not len(cols[0]):
            continue
        cut = int(np.searchsorted(cols[0], cols[0][-1], "left"))  # the last n-gram may go on in the next batch
        if cut:
            yield settle([c[:cut] for c in cols])
        held = [c[cut:] for c in cols]
    if held is not None and len(held[0]):
        yield settle(held)


def part_keys(row: np.ndarray, h: np.ndarray, rows: int, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) such that rows with different sets that reach the threshold have a key in common.

    Bounds of sizes grow so that such sets lie in the same span or in neighbouring ones; a set takes part in its own span and in the one below.
    In a span, linked sets differ in at most `most` n-grams, so of `most` + 1 + spare parts, chosen by hash, more than `spare` are
    equal. A set with at most `spare` empty parts shares one that is not empty; only of others do the empty parts count as well.
    """
    n = np.bincount(row, minlength=rows)
    bounds = [1]
    while bounds[-1] <= n.max(initial=0):
        bounds.append(bounds[-1] * den // num + 1)
    bounds.append(bounds[-1] * den // num + 1)
    bound = np.array(bounds)
    own = np.searchsorted(bound, n, "right") - 1
    mixed, salted = mix(h ^ U64(BASE_A)) >> U64(32), mix(h ^ U64(BASE_B))
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for span in (own, own - 1):
        at = np.clip(span, 0, len(bound) - 3)
        most = (den - num) * (bound[at + 1] + bound[at + 2] - 2) // (den + num)
        spare = most // 8
        parts = np.where((n > 0) & (span >= 0) & (most > 0), most + 1 + spare, 0)  # where no n-gram may differ, sets are equal
        first = np.cumsum(parts) - parts
        mine = parts[row] > 0
        r = row[mine]
        where = first[r] + ((mixed[mine] * parts[r].astype(U64)) >> U64(32)).astype(np.int64)
        order = np.argsort(where, kind="stable")
        with np.errstate(over="ignore"):
            sums = np.concatenate([[U64(0)], np.cumsum(salted[mine][order], dtype=U64)])
        full, start = np.unique(where[order], return_index=True)
        with np.errstate(over="ignore"):
            total = sums[np.append(start[1:], len(order)).astype(np.int64)] - sums[start]
        empty = np.ones(int(parts.sum()), bool)
        empty[full] = False
        of = np.repeat(np.arange(rows), parts)
        empty &= (np.bincount(of[empty], minlength=rows) > spare)[of]
        place = np.concatenate([full, np.flatnonzero(empty)])
        whose = of[place]
        with np.errstate(over="ignore"):
            key = mix(np.concatenate([total, np.zeros(len(place) - len(full), U64)]) + mix((at[whose].astype(U64) << U64(40)) + (place - first[whose]).astype(U64)))
        out.append((whose, key))
    return tuple(np.concatenate(v) for v in zip(*out, strict=True))  # type: ignore[return-value]


def pieces(texts: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Rows of MET for each part of the sets of `texts` (d1, text), the part as token."""

    def of(batches):
        for batch in batches:
            raw, off = base.text_buffer(batch.column("text"))
            node = batch.column("d1").to_numpy(zero_copy_only=False)
            for i, j in base.row_runs(off):
                row, h = shingles(raw[off[i] : off[j]], off[i : j + 1] - off[i], k)
                n, sign = np.bincount(row, minlength=j - i).astype(np.int32), signed(parities(row, h, j - i))
                who, key = part_keys(row, h, j - i, num, den)
                none = np.zeros(len(who), np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in (signed(key), node[i + who], n[who], none, n[who], none, *sign[who].T)], [x.split()[0] for x in MET.split(", ")])

    return texts.select("d1", "text").mapInArrow(of, MET)


VERIFIED = "d1 long, d2 long, to1 long, to2 long, links long"


def compare(sets: list[np.ndarray], prefixes: list[list[tuple[int, int, int, int]]], num: int, den: int, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs (a, b) of sets, a in `left` and b in `right` (flags), each pair once, a < b unless only one of (a, b), (b, a) is wanted."""
    size = np.array([len(s) for s in sets])
    count = len(sets)
    wanted = left[:, None] & right[None, :]
    wanted = np.triu(wanted | wanted.T, 1)
    lo, hi = np.minimum(size[:, None], size[None, :]), np.maximum(size[:, None], size[None, :])
    wanted &= den * lo >= num * hi  # length
    need = -(-num * (size[:, None] + size[None, :]) // (den + num))
    tokens: dict[tuple[int, int, int], list[tuple[int, int]]] = {}
    for x, own in enumerate(prefixes):
        for *token, pos in own:
            tokens.setdefault(tuple(token), []).append((x, pos))  # type: ignore[arg-type]
    maybe = np.zeros((count, count), bool)
    for token in sorted(t for t, own in tokens.items() if len(own) > 1):
        at = np.array(sorted(tokens[token]))
        x, rest = at[:, 0], size[at[:, 0]] - at[:, 1]
        box = np.ix_(x, x)
        new = wanted[box]
        # at the first common n-gram, the overlap is at most what is left from there on
        maybe[box] |= new & (np.minimum(rest[:, None], rest[None, :]) >= need[box])
        wanted[box] = False
    a, b = np.nonzero(maybe)
    if not len(a):
        return a, b
    by_range = np.stack([np.bincount((s >> U64(59)).astype(np.int64), minlength=RANGES) for s in sets])
    fine = np.concatenate([np.minimum(by_range[a[i : i + 100_000]], by_range[b[i : i + 100_000]]).sum(1) for i in range(0, len(a), 100_000)]) >= need[a, b]
    a, b = a[fine], b[fine]
    if len(a) <= 4 * count:
        common = np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(a, b, strict=True)], np.int64)
    else:
        common = overlaps(sets)[a, b]
    linked = common >= need[a, b]
    return a[linked], b[linked]


def overlaps(sets: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Sizes of all intersections, from products of 0/1 matrices over the n-grams that two sets or more have."""
    whole = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, back, times = np.unique(whole, return_inverse=True, return_counts=True)
    shared = times > 1
    column = np.cumsum(shared) - 1
    keep = shared[back]
    owner, column = owner[keep], column[back[keep]]
    out = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for start in range(0, int(shared.sum()), width):
        i, j = np.searchsorted(column, [start, start + width])
        part = np.zeros((len(sets), width), np.float32)
        part[owner[i:j], column[i:j] - start] = 1
        out += part @ part.T
    return np.rint(out).astype(np.int64)


def local_labels(count: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of each member's component."""
    label = np.arange(count)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            break
    return label


def _verify(batches, k: int, num: int, den: int):
    """Compares the members of each (root, i, j): all of them if i = j, else those of tile i with those of tile j."""
    held: list[dict] = []

    def settle():
        raw, off = base.text_buffer(pa.array([m["text"] for m in held], pa.string()))
        parts = []
        for i, j in base.row_runs(off):
            row, h = shingles(raw[off[i] : off[j]], off[i : j + 1] - off[i], k)
            parts += np.split(h, np.cumsum(np.bincount(row, minlength=j - i))[:-1])
        tile = np.array([m["tile"] for m in held])
        prefixes = [[(p["tier"], p["c"], p["token"], p["pos"]) for p in m["tokens"]] for m in held]
        a, b = compare(parts, prefixes, num, den, tile == held[0]["i"], tile == held[0]["j"])
        copies = np.array([m["copies"] for m in held], np.int64)
        links = np.bincount(a, weights=copies[b], minlength=len(held)) + np.bincount(b, weights=copies[a], minlength=len(held))
        label = local_labels(len(held), a, b)
        d1, d2 = (np.array([m[c] for m in held], np.int64) for c in ("d1", "d2"))
        mine = np.flatnonzero(links > 0)
        return pa.RecordBatch.from_arrays([pa.array(v) for v in (d1[mine], d2[mine], d1[label[mine]], d2[label[mine]], links[mine].astype(np.int64))], ["d1", "d2", "to1", "to2", "links"])

    for batch in batches:
        for m in batch.to_pylist():
            if held and (m["root"], m["i"], m["j"]) != (held[0]["root"], held[0]["i"], held[0]["j"]):
                yield settle()
                held = []
            held.append(m)
    if held:
        yield settle()


def near_duplicates(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text", tile: int = TILE, meeting: int = MEETING) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links, k1, k2, r1, r2) for each row of `docs`.

    Two documents are linked when den * |intersection| >= num * |union| of their word `k`-grams (A-Z in lower case). component_id is the
    smallest doc_id that links reach, n_links the number of documents directly linked. A null, empty or blank text has an empty set and no
    links; with fewer than `k` words all words are the one n-gram; rows that are alike are linked; null ids count as larger than all
    others, and a component of such alone has a null component_id; an empty table gives an empty result; other columns are ignored.
    k1, k2 name the row (see base.keyed). r1, r2 name its group, the rows that links reach, which component_id does not where ids are null or
    repeated: they are the digests of one of its sets, null for an empty set.
    """
    spark = docs.sparkSession
    rows = base.keyed(docs, id_col, text_col)
    counts = spark.sparkContext.broadcast(sketch(rows, k))  # of fixed size
    members = stage(entries(rows, k, num, den, counts, members=True), "members")
    most = members.count()  # of classes, and of what has a row for each; read off the files' ends
    last = F.lit(2**63 - 1).cast("long")
    classes = stage(members.filter("n > 0").groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("copies"), F.min(F.coalesce("id", last)).alias("least"), F.min(F.struct("k1", "k2")).alias("one"), F.first("prefix").alias("prefix"), F.first("zone").alias("zone"), F.first("n").alias("n"), *(F.first(c).alias(c) for c in SIGN)), "classes", most)

    # n-grams that two sets have, in the order (tier, c, token); of each set, those in its prefix
    at_token = Window.partitionBy("token")
    shared = entries(rows, k, num, den, counts, members=False).withColumns({"lo": F.min("node").over(at_token), "hi": F.max("node").over(at_token), "c": F.count(F.lit(1)).over(at_token)}).filter("lo <> hi")
    light = F.col("aux") == LIGHT
    item = F.struct(F.when(light, 0).otherwise(1).alias("tier"), F.when(light, F.col("c")).otherwise(F.shiftright("aux", 24)).alias("c"), "token", F.when(light, -1).otherwise(F.col("aux").bitwiseAND((1 << 24) - 1)).cast("int").alias("pos"))
    lists = shared.groupBy("node").agg(F.sort_array(F.collect_set(item)).alias("tokens"))
    # should two classes ever share the first digest, n is null and no filter applies to them
    of_node = classes.groupBy(F.col("d1").alias("node")).agg(F.max("prefix").alias("prefix"), F.max("zone").alias("zone"), F.when(F.count(F.lit(1)) == 1, F.max("n")).alias("n"), *(F.max(c).alias(c) for c in SIGN))
    known = F.size(F.filter("tokens", lambda t: t["tier"] == 0))
    placing = F.transform("tokens", lambda t, i: F.struct(t["tier"].alias("tier"), t["c"].alias("c"), t["token"].alias("token"), F.when(t["tier"] == 0, i + F.col("zone") - known).otherwise(t["pos"]).cast("int").alias("pos")))
    placed = lists.join(of_node, "node").select("node", "prefix", "zone", "n", known.alias("known"), placing.alias("tokens"), *SIGN).select("node", "zone", "n", "known", *SIGN, F.filter("tokens", lambda t: t["pos"] < F.col("prefix")).alias("tokens")).filter(F.size("tokens") > 0)
    placed = stage(placed, "prefixes")

    each = placed.select("node", "zone", "n", "known", *SIGN, F.explode("tokens").alias("t")).select("t.token", "node", "n", "t.pos", (F.col("n") - F.col("zone")).alias("rest"), "known", *SIGN)

    def met(rows_met: DataFrame) -> DataFrame:
        return rows_met.repartition("token").sortWithinPartitions("token", "node").mapInArrow(partial(_meet, num=num, den=den), "a long, b long")

    crowds = base.small_side(each.groupBy("token").count().filter(F.col("count") > meeting).select("token"), "crowds")
    pairs = stage(met(each.join(crowds, "token", "left_anti")), "pairs")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node"), F.lit(False).alias("crowd")).unionByName(each.join(crowds, "token", "left_semi").select("node", F.lit(True).alias("crowd")))
    ends = ends.groupBy("node").agg(F.max("crowd").alias("crowd")).join(classes.select(F.col("d1").alias("node"), "d1", "d2", "one.k1", "one.k2"), "node").drop("node")
    once = F.row_number().over(Window.partitionBy("k1", "k2").orderBy("d1", "d2"))  # rows that are alike stand here together
    texts = stage(rows.select("k1", "k2", "text").join(ends.hint("merge"), ["k1", "k2"]).withColumn("nth", once).filter("nth = 1").select("d1", "d2", "crowd", "text"), "texts")
    groups = stage(components(pairs.unionByName(met(pieces(texts.filter("crowd"), k, num, den)))), "groups", most)
    of_root = groups.join(classes.select(F.col("d1").alias("node"), "n"), "node").groupBy("root").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("grams"))
    tiles = F.greatest(F.lit(1), F.ceil(F.col("size") / F.lit(tile)), F.ceil(F.col("grams") / F.lit(TILE_GRAMS))).cast("int")
    # written first, so that Spark can split a root that many classes have
    sizes = stage(of_root.select("root", tiles.alias("tiles")), "sizes", most)
    work = groups.join(sizes, "root").join(classes, groups["node"] == classes["d1"]).join(placed.select("node", "tokens"), "node")
    work = work.select("root", "d1", "d2", "copies", "tokens", "tiles").withColumn("tile", F.pmod(F.xxhash64("d2"), F.col("tiles")).cast("int"))
    dealt = work.join(texts.select("d1", "d2", "text"), ["d1", "d2"])
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select("root", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "tile", "d1", "d2", "copies", "tokens", "text")
    verified = dealt.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j").mapInArrow(partial(_verify, k=k, num=num, den=den), VERIFIED)
    verified = stage(verified, "links")

    key, to = F.struct("d1", "d2"), F.struct(F.col("to1").alias("d1"), F.col("to2").alias("d2"))
    labels = components(verified.select(key.alias("a"), to.alias("b")), rows=verified.count())
    links = verified.groupBy("d1", "d2").agg(F.sum("links").alias("links"))
    joined = classes.join(labels.select("node.d1", "node.d2", "root"), ["d1", "d2"])
    least = joined.groupBy("root").agg(F.min("least").alias("reached"))
    linked = joined.join(least, "root").join(links, ["d1", "d2"]).select("d1", "d2", "reached", "links", F.col("root.d1").alias("r1"), F.col("root.d2").alias("r2"))
    verdicts = classes.join(linked, ["d1", "d2"], "left").select("d1", "d2", F.coalesce("r1", "d1").alias("r1"), F.coalesce("r2", "d2").alias("r2"), F.coalesce("reached", "least").alias("reached"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    # written first, so that Spark can split a class that many rows share; empty sets, however many, need no verdict
    verdicts = stage(verdicts, "verdicts", most)
    alone = members.filter("n = 0").select("*", *(F.lit(None).cast("long").alias(c) for c in ("r1", "r2", "reached", "links")))
    out = members.filter("n > 0").join(verdicts, ["d1", "d2"], "left").unionByName(alone)
    return out.select(
        F.col("id").alias("doc_id"),
        F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("n") > 0, F.nullif("reached", last)).otherwise(F.col("id")).alias("component_id"),
        F.when(F.col("n") > 0, F.col("links")).otherwise(F.lit(0)).cast("long").alias("n_links"),
        "k1",
        "k2",
        "r1",
        "r2",
    )
