"""What the operators of this subpackage share: stage folders, row keys, Arrow text access, hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Text handled at once inside a Python worker; bounds the worker's temporaries.
SLICE_BYTES = 1 << 20


# ---------------------------------------------------------------- stage tables


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors share: spark.checkpoint.dir, or in local mode a new one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = getattr(spark, "_tidemark_shared", None)
    if made is None:
        made = spark._tidemark_shared = f"file://{tempfile.mkdtemp(prefix='tidemark-')}"
    return made


#: Narrow rows (some 100 bytes) in a file of a stage table whose rows are counted.
ROWS_A_FILE = 1 << 16


def stage(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write `df` as a table in the shared folder and read it again: lineage ends there and lost executors cost no more than their running tasks.

    rows: for narrow rows, as many at most. They go to as many files as they need, not to one for each partition: executors create files, and
    set their permissions, by starting processes.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // ROWS_A_FILE)))
    path = f"{shared_dir(spark)}/stages/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_stages(spark: SparkSession) -> None:
    """Deletes all stage tables of the shared folder. Results that are not written yet may still read theirs."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/stages")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small_side(df: DataFrame, name: str, most: int = 10_000) -> DataFrame:
    """`df` written to a stage table, and marked for broadcast if it has at most `most` rows; beyond that Spark joins it as any other."""
    written = stage(df, name)
    return F.broadcast(written) if written.limit(most + 1).count() <= most else written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def key_columns(id_col: str = "doc_id", text_col: str = "text") -> dict[str, Column]:
    """_k1, _k2: they name a row by id and text, also where ids are null or repeated. Rows that share both are alike, so they share results."""
    ident = F.col(id_col).cast("long")
    return {"_k1": F.coalesce(ident, F.lit(-(2**63)).cast("long")), "_k2": F.xxhash64(F.col(text_col).cast("string"), ident.isNull())}


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(k1, k2, id, text): the key of each row, its id and its text."""
    key = key_columns(id_col, text_col)
    return docs.select(key["_k1"].alias("k1"), key["_k2"].alias("k2"), F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))


def set_aside(docs: DataFrame, known: tuple[str, ...]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """`docs` with all columns but the `known` ones in one column, and what turns a table with these columns back to the columns of `docs`.

    So an operator that keeps all columns may use names of its own without meeting one of the user's.
    """
    own = [c for c in docs.columns if c in known]
    others = [c for c in docs.columns if c not in known]
    name = lambda c: F.col("`" + c.replace("`", "``") + "`")
    if not others:
        return docs, lambda done: done.select(*own)
    packed = docs.select(*own, F.struct(*(name(c).alias(f"c{k}") for k, c in enumerate(others))).alias("others"))
    place = {c: k for k, c in enumerate(others)}
    return packed, lambda done: done.select(*(F.col("others")[f"c{place[c]}"].alias(c) if c in place else F.col(c) for c in docs.columns))


def crc32_mod(id_col: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(id_col.cast("string").cast("binary")) % n


# ---------------------------------------------------------------- Arrow access


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes (or those of binary values) of all rows in one array, and the n + 1 offsets of the rows. Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, b"").cast(pa.large_binary()) if pa.types.is_binary(column.type) else pc.fill_null(column, "").cast(pa.large_string())
    n, (_, offsets, data) = len(column), column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def row_runs(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows [i, j) of about `limit` bytes; a longer row makes a run of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j
        i = j


# ---------------------------------------------------------------- hashing


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, element by element."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


class Poly:
    """Hashes of stretches of a sequence of 64-bit units: polynomial modulo 2**64 over prefix sums, then mixed."""

    _tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, units: np.ndarray, base: int):
        powers, inverse = self._powers(base, len(units) + 1)
        with np.errstate(over="ignore"):
            self.sums = np.zeros(len(units) + 1, U64)
            np.cumsum(units * powers[: len(units)], out=self.sums[1:])
        self.inverse = inverse

    @classmethod
    def _powers(cls, base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        have = cls._tables.get(base)
        if have is None or len(have[0]) < n:
            size, got = max(n, 1 << 16), []
            for b in (base, pow(base, -1, 1 << 64)):
                steps = np.full(size, b, U64)
                steps[0] = 1
                with np.errstate(over="ignore"):
                    got.append(np.multiply.accumulate(steps))
            if n > 1 << 22:  # a very long text: not kept
                return got[0], got[1]
            have = cls._tables[base] = (got[0], got[1])
        return have

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[end] - self.sums[start]) * self.inverse[start])

    def windows(self, width: int) -> np.ndarray:
        """Hash of each stretch of `width` units."""
        n = len(self.sums) - width
        if n <= 0:
            return np.zeros(0, U64)
        with np.errstate(over="ignore"):
            return mix((self.sums[width:] - self.sums[:n]) * self.inverse[:n])


#: Odd multipliers of the hashes.
BASE_A, BASE_B = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
#: A random-looking 64-bit unit for each byte value.
BYTE_UNITS = mix(np.arange(1, 257, dtype=U64) * U64(BASE_A))

SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_spans(raw: np.ndarray, offsets: np.ndarray, breaks: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (byte positions) of the words, `[^\\x20\\x09-\\x0D]+` unless other bytes break them, and for each row the number of its first word (n + 1 entries). Words end at row ends."""
    inside = ~breaks[raw]
    before = np.zeros(len(raw), bool)
    before[1:] = inside[:-1]
    after = np.zeros(len(raw), bool)
    after[:-1] = inside[1:]
    edges = offsets[:-1][offsets[:-1] < len(raw)]
    before[edges] = False
    edges = offsets[1:][offsets[1:] > 0] - 1
    after[edges] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_units(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    return Poly(BYTE_UNITS[raw], BASE_B).of(starts, ends)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def unsigned_order(x: np.ndarray) -> np.ndarray:
    return x.view(U64)
