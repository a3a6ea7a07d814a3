"""Helpers shared by the corpus operators: sessions, Arrow batches, words and hashes.

A *word* is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]``; in UTF-8 these
bytes never occur inside a longer code point, so bytes and characters agree.
"""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that one vectorised step works on; a longer document is a step of its own.
STEP_BYTES = 1 << 20
#: Rows in one Arrow batch, so that batches of long documents stay small.
BATCH_ROWS = 512
#: Stands for a null document id inside joins; it sorts after every other id.
NO_ID = (1 << 63) - 1

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0xD1342543DE82EF95


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bounds the rows of Arrow batches; the bound has no influence on results."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def release() -> None:
    """Gives memory that earlier groups of a Python worker left free back to the system, where glibc allows it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def with_checkpoints(spark: SparkSession) -> None:
    """Uses the session's spark.checkpoint.dir; sets a temporary one only if there is none."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="checkpoints-"))


def n_words(text: Column) -> Column:
    """Number of words; 0 for null. Each word becomes one letter, and the letters are counted."""
    return F.coalesce(F.length(F.translate(F.regexp_replace(text, WORD, "w"), " \t\n\x0b\x0c\r", "")), F.lit(0)).cast("long")


def crc_mod(column: str, n: int) -> Column:
    """crc32 of the id written as text, modulo n."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and len+1 offsets into them; null reads as empty."""
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind, (_, offsets, data) = (np.int64 if wide else np.int32), column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def steps(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cuts batches into slices of about STEP_BYTES of text: the slice, its bytes and offsets."""
    for batch in batches:
        data, offsets = utf8(batch.column(text))
        first = 0
        while first < batch.num_rows:
            last = int(np.searchsorted(offsets, offsets[first] + STEP_BYTES, "right")) - 1
            last = min(max(last, first + 1), batch.num_rows)
            yield batch.slice(first, last - first), data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
            first = last


def mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit values, one to one."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


#: A random 64-bit value for each byte.
BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, STEP_BYTES + 1), base % (1 << 64), np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if n <= 4 * STEP_BYTES:
            _powers[base] = have
    return have[:n]


class Rolling:
    """Rabin-Karp hashes of any slice of a symbol sequence, from prefix sums modulo 2**64.

    The odd base has an inverse, so hash(i, j) = (P[j] - P[i]) * base**-i depends on the
    symbols alone. Equal slices have equal hashes wherever they stand.
    """

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        self.prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(symbols * powers(_BASE, n), out=self.prefix[1:])
        self.inverse = powers(pow(_BASE, -1, 1 << 64), n + 1)

    def at(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        return mix((self.prefix[last] - self.prefix[first]) * self.inverse[first])

    def every(self, width: int) -> np.ndarray:
        """Of all slices of this width, by first position."""
        return mix((self.prefix[width:] - self.prefix[: len(self.prefix) - width]) * self.inverse[: len(self.prefix) - width])


_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last (exclusive) byte of each word, and len+1 offsets of documents into the words."""
    inside = ~_SPACE[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    begins[cuts] = inside[cuts]
    ends[cuts - 1] = inside[cuts - 1]
    first, last = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return first, last, np.searchsorted(first, offsets)


def word_hashes(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    return Rolling(BYTE_VALUE[data]).at(first, last)


def join_totals(rows: DataFrame, totals: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join of rows with a table aggregated by the same keys.

    The join runs on the complement of the first key: an aggregate already lies by its
    keys and would be joined where it lies, in one task for all rows of a hot key. So both
    sides are exchanged, and adaptive execution can split a hot key's rows.
    """
    first = keys[0]
    by = F.bitwise_not(F.col(first))
    return rows.withColumn("_by", by).join(totals.withColumn("_by", by).drop(first), ["_by", *keys[1:]]).drop("_by")
