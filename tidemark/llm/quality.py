"""Operator 2: quality classifier by regularised quadratic discriminant.

Each text becomes a vector of transformed statistics. Each class has a mean and a covariance, the latter drawn towards the pooled
covariance and a multiple of the unit matrix. A score is the logistic of the difference of the two log densities, whose
Mahalanobis terms come from Cholesky factors that are computed once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base
from .base import crc32_mod, stage, text_buffer
from .fertility import base_counts

STATISTICS = ("words", "word_length", "symbols", "upper", "shouts", "bars", "stutter", "variety", "repeats", "lines_again", "line_length", "marks", "digits", "short_words")
UPPER = np.zeros(256, bool)
UPPER[65:91] = True
LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123), *range(0xC3, 0xF5)]] = True
MARKS = np.zeros(256, bool)
MARKS[list(b".,;:?'\"()[]-")] = True


def statistics(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One row of STATISTICS for each text; shares are taken to their square roots and counts to logarithms, which brings both closer to normal."""

    def per_row(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags)])
        return total[off[1:]] - total[off[:-1]]

    starts, ends, first = base.word_spans(raw, off)
    units = base.word_units(raw, starts, ends)
    row = np.repeat(np.arange(len(off) - 1), np.diff(first))

    def per_word_row(flags: np.ndarray) -> np.ndarray:
        return np.bincount(row[flags], minlength=len(off) - 1)

    n_words, chars, symbols, dup_lines, repeats = base_counts(raw, off)
    words, chars1, size = np.maximum(n_words, 1), np.maximum(chars, 1), np.maximum(np.diff(off), 1)
    same = np.zeros(len(units), bool)
    same[1:] = (units[1:] == units[:-1]) & (row[1:] == row[:-1])
    order = np.lexsort((units, row))
    fresh = np.ones(len(units), bool)
    fresh[1:] = (units[order][1:] != units[order][:-1]) | (row[order][1:] != row[order][:-1])
    distinct = np.bincount(row[order][fresh], minlength=len(off) - 1)
    lines = per_row(raw == 10) + 1
    upper = UPPER[raw]
    two = np.zeros(len(raw), bool)  # upper case of Latin-1: C3 80 to C3 9E
    two[1:] = (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E)
    letters = np.maximum(per_row(LETTER[raw]), 1)
    return np.stack(
        [
            np.log1p(n_words),
            np.log1p(chars / words),
            np.sqrt(symbols / chars1),
            np.sqrt((per_row(upper) + per_row(two)) / letters),
            np.sqrt(per_row(raw == 33) / chars1),
            np.sqrt(per_row(raw == 124) / chars1),
            np.sqrt(per_word_row(same) / words),
            np.log1p(distinct) / np.log(words + 2),
            np.sqrt(repeats / words),
            np.sqrt(dup_lines / lines),
            np.log1p(size / lines),
            np.sqrt(per_row(MARKS[raw]) / chars1),
            np.sqrt(per_row((raw >= 48) & (raw <= 57)) / chars1),
            np.sqrt(per_word_row(ends - starts <= 3) / words),
        ],
        axis=1,
    )


@dataclass(frozen=True)
class Discriminant:
    """Means, inverted Cholesky factors and log terms of the two classes; `plain` is the score where there was nothing to learn."""

    means: tuple[np.ndarray, np.ndarray] | None
    factors: tuple[np.ndarray, np.ndarray] | None
    constants: tuple[float, float]
    plain: float

    @staticmethod
    def fit(n: np.ndarray, means: np.ndarray, within: np.ndarray, shrink: float, ridge: float) -> Discriminant:
        """From each class's number of rows, mean and sum of outer products of deviations from it. Classes of identical rows have none; the ridge alone is their covariance."""
        plain = float(n[1] / n.sum()) if n.sum() else 0.5
        d = means.shape[1]
        if min(n) < 2:
            return Discriminant(None, None, (0.0, 0.0), plain)
        pooled = within.sum(0) / (n.sum() - 2)
        unit = np.eye(d) * (np.trace(pooled) / d + 1e-9)
        factors, constants = [], []
        for k in (0, 1):
            own = within[k] / (n[k] - 1)
            mixed = (1 - ridge) * ((1 - shrink) * own + shrink * pooled) + ridge * unit
            factor = np.linalg.cholesky(mixed)
            factors.append(np.linalg.solve(factor, np.eye(d)))  # once, so that a batch is a product
            constants.append(float(np.log(n[k] / n.sum()) - np.log(np.diag(factor)).sum()))
        return Discriminant((means[0], means[1]), (factors[0], factors[1]), (constants[0], constants[1]), plain)

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.means is None or self.factors is None:
            return np.full(len(x), self.plain)
        density = [c - 0.5 * ((x - m) @ f.T) ** 2 @ np.ones(x.shape[1]) for m, f, c in zip(self.means, self.factors, self.constants, strict=True)]
        return 1 / (1 + np.exp(np.clip(density[0] - density[1], -700, 700)))


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and x, the statistics of each text."""

    def of(batches):
        for batch in batches:
            raw, off = text_buffer(batch.column("text"))
            for i, j in base.row_runs(off):
                x = statistics(raw[off[i] : off[j]], off[i : j + 1] - off[i])
                yield pa.RecordBatch.from_arrays([batch.column("id")[i:j], pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))], ["doc_id", "x"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(of, "doc_id long, x array<double>")


def matrix(column: pa.Array, d: int = len(STATISTICS)) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _summed(rows: DataFrame, size: int, of_class) -> np.ndarray:
    """For both classes of `rows` (x, y), the sum of the `size` numbers that `of_class` (class, its rows) makes, added up where the rows are."""

    def of(batches):
        total = np.zeros((2, size))
        for batch in batches:
            x, y = matrix(batch.column("x")), batch.column("y").to_numpy()
            for k in (0, 1):
                total[k] += of_class(k, x[y == k])
        yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], ["y", "v"])

    parts = rows.select("x", F.col("y").cast("int").alias("y")).mapInArrow(of, "y int, v array<double>")
    out = np.zeros((2, size))
    for r in parts.select("y", F.posexplode("v")).groupBy("y", "pos").agg(F.sum("col").alias("v")).collect():  # two classes, a fixed number of sums
        out[r["y"], r["pos"]] = r["v"]
    return out


def moments(rows: DataFrame, d: int = len(STATISTICS)) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of rows, means and sums of outer products of deviations of the classes of `rows` (x, y). Means come first: sums of squares that are not centred would cancel to noise."""
    sums = _summed(rows, 1 + d, lambda _, x: np.concatenate([[len(x)], x.sum(0)]))
    n, means = sums[:, 0], sums[:, 1:] / np.maximum(sums[:, :1], 1)
    within = _summed(rows, d * d, lambda k, x: ((x - means[k]).T @ (x - means[k])).ravel())
    return n, means, within.reshape(2, d, d)


def quality_scores(docs: DataFrame, labels: DataFrame, folds: int = 5, threshold: float = 0.3, shrink: float = 0.1, ridge: float = 1e-4, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """doc_id, held_out, score, predicted for each document.

    All labelled rows outside of the held-out fold (crc32 of the id as text, modulo `folds`, is 0) are learned from. Labels other than 0 and 1
    and null ids teach nothing; a null id is not held out; a null text is empty and gets the score of its statistics; a document
    that stands twice or has two labels counts as often, and classes of identical texts are no less defined; with fewer than two rows of a class the score is the share of label 1 (0.5
    without labels); an empty table gives an empty result; other columns are ignored.
    """
    known = stage(document_statistics(docs, id_col, text_col), "statistics")
    told = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).filter("y in (0, 1) and doc_id is not null")
    lessons = stage(known.join(told.filter(crc32_mod(F.col("doc_id"), folds) != 0), "doc_id").select("x", "y"), "lessons")
    model = Discriminant.fit(*moments(lessons), shrink, ridge)

    def of(batches):
        for batch in batches:
            score = model.score(matrix(batch.column("x")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    scored = known.mapInArrow(of, "doc_id long, score double, predicted int")
    return scored.select("doc_id", F.coalesce(crc32_mod(F.col("doc_id"), folds) == 0, F.lit(False)).alias("held_out"), "score", "predicted")
