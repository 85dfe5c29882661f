"""Operator 10: quality rules from tokeniser fertility.

A public vocabulary with byte fallback says how well it knows a text: characters per token, share of byte tokens, entropy of the
tokens. For each language (or script, where the language is not given) quartiles over the whole corpus give bands;
texts outside of a band are rejected, as are those that fail the base rules.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import base
from .base import BASE_A, U64, mix, small_side, stage, text_buffer
from .tokens import byte_pieces, piece_bpe, public_path

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
MEASURES = ("chars_per_token", "byte_share", "token_entropy")
BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def base_counts(raw: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    """For each row: words, code points in words, symbols, lines equal to an earlier one, words in 3-word windows that the text repeats."""

    def per_row(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags)])
        return total[off[1:]] - total[off[:-1]]

    starts, ends, first = base.word_spans(raw, off)
    units = base.word_units(raw, starts, ends)
    row = np.repeat(np.arange(len(off) - 1), np.diff(first))
    repeat = np.zeros(len(units), bool)
    if len(units) >= 3:
        with np.errstate(over="ignore"):
            grams = mix(units[:-2] * U64(3) + mix(units[1:-1] + mix(units[2:] + row[:-2].astype(U64) * U64(BASE_A))))
        at = np.flatnonzero(row[:-2] == row[2:])
        order = at[np.argsort(grams[at])]
        same = grams[order][1:] == grams[order][:-1]
        for k in range(3):
            repeat[order[1:][same] + k] = True
            repeat[order[:-1][same] + k] = True
    total = np.concatenate([[0], np.cumsum(repeat)])
    dup = np.zeros(len(off) - 1, np.int64)
    for i in np.flatnonzero(per_row(raw == 10)):
        seen = set()
        for line in raw[off[i] : off[i + 1]].tobytes().split(b"\n"):
            if line in seen:
                dup[i] += 1
            elif line.strip(b" \t\n\r\x0b\x0c"):
                seen.add(line)
    return [np.diff(first), per_row(~base.SPACE[raw] & ((raw & 0xC0) != 0x80)), per_row(SYMBOLS[raw]), dup, total[first[1:]] - total[first[:-1]]]


def token_measures(ids: np.ndarray, bounds: np.ndarray, chars: np.ndarray, byte_ids: tuple[int, int]) -> list[np.ndarray]:
    """For each row, whose ids lie at bounds[i]:bounds[i + 1]: tokens, characters per token, share of byte tokens, entropy in bits. 0 without tokens."""
    n = np.diff(bounds)
    some = np.maximum(n, 1)
    is_byte = np.concatenate([[0], np.cumsum((ids >= byte_ids[0]) & (ids <= byte_ids[1]))])
    row = np.repeat(np.arange(len(n), dtype=np.int64), n)
    ranked = np.sort((row << 32) | ids)
    head = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(ranked) else np.zeros(0, np.int64)
    times = np.diff(np.append(head, len(ranked)))
    of_row = ranked[head] >> 32
    part = times / some[of_row]
    return [n, chars / some, (is_byte[bounds[1:]] - is_byte[bounds[:-1]]) / some, np.bincount(of_row, weights=-part * np.log2(part), minlength=len(n))]


def fertility(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """doc_id, band (language or script), the base counts, n_tokens and the measures of each document."""
    path = path or public_path("piece_bpe_32k.model")
    lang = F.col(lang_col).cast("string") if lang_col else F.lit(None).cast("string")
    source = docs.select(F.col(id_col).cast("long").alias("id"), lang.alias("lang"), F.col(text_col).cast("string").alias("text"))

    def of(batches):
        words, byte_ids = piece_bpe(path), byte_pieces(path)
        for batch in batches:
            raw, off = text_buffer(batch.column("text"))
            for i, j in base.row_runs(off):
                part, o = raw[off[i] : off[j]], off[i : j + 1] - off[i]
                counts = base_counts(part, o)
                plain = part.tobytes()
                got = [words.text(plain[a:b]) for a, b in zip(o[:-1].tolist(), o[1:].tolist(), strict=True)]
                bounds = np.cumsum([0, *map(len, got)]) // 4
                measures = token_measures(np.frombuffer(b"".join(got), "<u4").astype(np.int64), bounds, counts[1], byte_ids)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id")[i:j], pa.array(_bands(batch.column("lang")[i:j], plain, o)), *(pa.array(c.astype(np.int64)) for c in counts), pa.array(measures[0].astype(np.int64)), *(pa.array(m.astype(np.float64)) for m in measures[1:])],
                    ["doc_id", "band", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_tokens", *MEASURES],
                )

    return source.mapInArrow(of, f"doc_id long, band string, {BASE}, n_tokens long, " + ", ".join(f"{m} double" for m in MEASURES))


#: First code points of blocks and the script that each belongs to, for texts without a language.
SCRIPTS = ((0x41, "latin"), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "other"), (0x590, "hebrew"), (0x600, "arabic"), (0x700, "other"), (0x900, "indic"), (0xE00, "other"), (0x1E00, "latin"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"), (0x4E00, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"))


def script_of(text: str) -> str:
    """The script that most letters of a text are in; `none` without letters."""
    letters = np.array([ord(c) for c in text if c.isalpha()])
    if not len(letters):
        return "none"
    which = np.searchsorted([a for a, _ in SCRIPTS], letters, "right") - 1
    return SCRIPTS[int(np.bincount(np.maximum(which, 0)).argmax())][1]


def _bands(langs: pa.Array, plain: bytes, off: np.ndarray) -> list[str]:
    return [f"lang:{x}" if x is not None else f"script:{script_of(plain[off[k] : off[k + 1]].decode('utf-8', 'replace'))}" for k, x in enumerate(langs.to_pylist())]


GRID = 1 / 1024  # of the measures' quartiles


def bands(measured: DataFrame) -> DataFrame:
    """Quartiles of each measure over a band's documents that pass the base rules, and the range that counts as one unit of distance from them.

    Values are counted on a grid, so quartiles are exact up to its step, the same in every run, and cost a row for each band and step at most.
    """
    step = F.explode(F.array(*(F.struct(F.lit(m).alias("m"), F.floor(F.col(m) / GRID).cast("long").alias("bin")) for m in MEASURES)))
    counts = measured.filter(~F.col("base_failed")).select("band", step.alias("s")).groupBy("band", "s.m", "s.bin").agg(F.count(F.lit(1)).alias("n"))
    of = Window.partitionBy("band", "m")
    ranked = counts.withColumns({"upto": F.sum("n").over(of.orderBy("bin")), "all": F.sum("n").over(of)})
    edge = lambda m, q: F.min(F.when((F.col("m") == m) & (4 * F.col("upto") >= q * F.col("all")), F.col("bin"))) * GRID
    quartiles = ranked.groupBy("band").agg(*(x for m in MEASURES for x in (edge(m, 1).alias(f"{m}_low"), edge(m, 3).alias(f"{m}_high"))))
    return quartiles.withColumns({f"{m}_unit": F.greatest(F.col(f"{m}_high") - F.col(f"{m}_low"), F.abs(F.col(f"{m}_high")) * 0.02 + 0.002) for m in MEASURES})


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def fertility_rules(docs: DataFrame, path: str | None = None, reach: float = 2.5, short: float = 2.0, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """doc_id, n_words, the base counts, base_failed, kept, then band and measures, for each document.

    A measure may lie `reach` interquartile ranges beyond its band's quartiles, and more in short texts, whose measures vary more: by a
    share of `short` over the root of their tokens. Both were chosen on the labelled documents of sf0.1 outside of the fold crc32 of the id modulo 5
    = 0: the README has what they reject there and in the held-out fold.
    A null or empty text has no words and fails the base rules; a document without language goes by its script; a band
    none of whose documents passes the base rules accepts none, as none is left to judge; rows that are alike count each; null ids stay; an
    empty table gives an empty result; other columns are ignored.
    """
    measured = stage(fertility(docs, path, id_col, text_col, lang_col), "fertility").withColumn("base_failed", base_failed())
    limits = small_side(bands(measured), "bands")
    inside, far = F.lit(True), reach * (1 + short / F.sqrt(F.greatest("n_tokens", F.lit(1))))
    for m in MEASURES:
        inside = inside & F.col(m).between(F.col(f"{m}_low") - far * F.col(f"{m}_unit"), F.col(f"{m}_high") + far * F.col(f"{m}_unit"))
    joined = measured.join(limits, "band", "left")
    names = [x.split()[0] for x in BASE.split(", ")]
    return joined.select("doc_id", *names, "base_failed", (~F.col("base_failed") & F.coalesce(inside, F.lit(False))).alias("kept"), "band", "n_tokens", *MEASURES)
