"""Shared parts of the training-data operators.

Conventions that hold for every operator here:

* a document table has at least ``doc_id``, an integer (read as a long), and ``text``; other columns are ignored unless an
  operator says otherwise, so clashing names in them do no harm;
* a null text counts as the empty text, a null ``doc_id`` sorts after every other id;
* rows that repeat a ``doc_id`` stay separate rows of the result.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A null doc_id, while keys are compared.
NO_ID = 2**63 - 1
#: The white space of the contracts: space and U+0009 to U+000D.
SPACE_RE = r"[\x20\x09-\x0D]+"
#: Bytes of text that the numpy helpers work on at once; one document may be longer.
PIECE = 1 << 20

_SPACES = np.zeros(256, bool)
_SPACES[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x5851F42D4C957F2D  # odd, so it has an inverse modulo 2**64
_MASK = (1 << 64) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``; only where that is unset (tests) a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.gettempdir() + "/inkweave-checkpoints"
    return base.rstrip("/")


def settle(df: DataFrame) -> DataFrame:
    """Writes a frame to the shared folder as Parquet and returns the reader of it.

    It cuts lineage, so nothing above is computed twice, and it survives lost executors since every executor can read
    the folder.
    """
    path = f"{shared_folder(df.sparkSession)}/inkweave-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def keyed(docs: DataFrame, keep: bool = False) -> DataFrame:
    """doc_id, text (never null), ``_id`` (never null), ``_row``, unique to each row, and with keep ``_all``, the row itself.

    A null doc_id is ``NO_ID``, after every other.  Where doc_ids are unique they are the row keys.  Otherwise rows are
    numbered once and written, so that every later reading of them sees the same numbers; nothing rests on a hash.
    """
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("_id"), *([F.struct(*docs.columns).alias("_all")] if keep else []))
    if d.groupBy("_id").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        return d.withColumn("_row", F.col("_id"))
    return settle(d.withColumn("_row", F.monotonically_increasing_id()))


def release() -> None:
    """Gives freed memory back to the system, where the C library can; a Python worker keeps it otherwise."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def tidy(run):
    """run, a function for mapInArrow, that gives its memory back at the end: Python workers outlive their tasks."""

    def tidied(batches):
        yield from run(batches)
        release()

    return tidied


def octets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow string column and the offsets of its rows, without copying; nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, wide, len(column) + 1, column.offset * np.dtype(wide).itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def pieces(at: np.ndarray, limit: int = PIECE):
    """(first row, end row) of runs of rows of about ``limit`` bytes."""
    first, n = 0, len(at) - 1
    while first < n:
        end = max(first + 1, int(np.searchsorted(at, at[first] + limit, side="right")) - 1)
        yield first, end
        first = end


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x81DADEF4BC2DD44D)
    h ^= h >> np.uint64(33)
    return h


class _Powers:
    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            base, inverse = np.full(size, _BASE, np.uint64), np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
            base[0] = inverse[0] = 1
            self.up, self.down = np.cumprod(base), np.cumprod(inverse)
        return self.up[:n], self.down[:n]


_powers = _Powers()


def words(raw: np.ndarray, at: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each maximal run of non-space bytes and the offsets of each row's words among them.

    Hashes are differences of prefix sums of byte * base**position, divided by base**start: equal words hash alike
    wherever they stand.
    """
    n = len(raw)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    if lower:
        raw = _LOWER[raw]
    inside = ~_SPACES[raw]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    rows = at[:-1][at[:-1] < n]
    start[rows] = inside[rows]
    end = inside.copy()
    end[:-1] &= ~inside[1:]
    last = at[1:][at[1:] > 0] - 1
    end[last] = inside[last]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    up, down = _powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    return mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64)), np.searchsorted(s, at)
