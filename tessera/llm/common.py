"""Shared helpers: written tables in the shared folder, Arrow batches, and word hashes in numpy."""

from __future__ import annotations

import ctypes
import gc
import os
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.storage import drop_written, shared_dir, tidied, written

__all__ = ["drop_written", "shared_dir", "tidied", "written"]

#: White space of the word pattern ``[^\x20\x09-\x0D]+`` (ASCII only, so bytes suffice).
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
WORD_BREAK = r"[\x20\x09-\x0D]+"
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ODD = np.uint64(0x9E3779B97F4A7C15)


#: More ids than this are joined by a shuffle, fewer are broadcast.
BROADCAST_IDS = 500_000


def without(docs: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows of ``docs`` whose ``key`` isn't in the one column of ``ids``; rows with a null key stay."""
    ids = written(ids.toDF("_drop").filter("_drop IS NOT NULL").distinct(), "ids")
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return docs.join(ids, F.col(key) == F.col("_drop"), "left_anti")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def inner(docs: DataFrame, **columns: Column) -> DataFrame:
    """``row`` (all columns of ``docs`` as a struct) and the given columns: names made below can't clash with those of ``docs``."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *(c.alias(name) for name, c in columns.items()))


def outer(df: DataFrame, docs: DataFrame, *results: str) -> DataFrame:
    """The columns of ``docs`` again, and the results in place of columns of these names (in any case)."""
    taken = {r.lower() for r in results}
    return df.select(*(F.col("row")[c].alias(c) for c in docs.columns if c.lower() not in taken), *results)


def with_fields(df: DataFrame, made: Column, fields: dict[str, str]) -> DataFrame:
    """``df`` with columns from the fields of a struct that is computed once."""
    held = free_name(df, "_made")
    return df.withColumn(held, made).withColumns({c: F.col(held)[f] for c, f in fields.items()}).drop(held)


def small_batches(spark: SparkSession, rows: int = 256, size: int = 1 << 19) -> None:
    """Bound the rows and bytes of one Arrow batch, so that a batch of long texts fits a worker's memory.

    Frames are lazy and read these settings of the session when they run, so they stay set.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


#: What an operator keeps in a Python worker between tasks, by (operator, key).
_KEPT: dict[tuple[str, object], object] = {}


def kept_in_worker(operator: str, key: object, make: Callable[[], object]) -> object:
    """What ``make`` gives, made once in a worker and used by later tasks of the same operator and key; it replaces all else that is kept."""
    if (operator, key) not in _KEPT:
        free_worker()
        _KEPT[operator, key] = make()
    return _KEPT[operator, key]


def free_worker() -> None:
    """Give up what other operators keep in this worker, and give the memory back to the machine.

    Spark reuses workers, so tables of one operator would lie beside those of the next. Called as a task begins.
    """
    if _KEPT:
        _KEPT.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        if os.name == "posix" and (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)):
            trim(0)


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the public splitmix64 step)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)
_PLACE = mix(np.arange(1001, 1065, dtype=np.uint64) * _ODD) | np.uint64(1)


def text_bytes(column: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its offsets; nulls count as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.type != pa.large_string():
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
    buffer = column.buffers()[2] if n else None
    data = np.frombuffer(buffer, np.uint8)[offsets[0] : offsets[-1]] if buffer is not None and buffer.size else np.zeros(0, np.uint8)
    return _LOWER[data] if lower else data, offsets - offsets[0]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word of every text, and the first word's place of each text.

    Words are runs without the six ASCII blanks. Text i has the words ``[first[i], first[i + 1])``.
    """
    n = len(offsets) - 1
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    blank = SPACE[data]
    begins = ~blank
    begins[1:] &= blank[:-1]
    at = offsets[:-1][(offsets[:-1] < offsets[1:])]
    begins[at] = ~blank[at]
    starts = np.flatnonzero(begins)
    first = np.searchsorted(starts, offsets).astype(np.int64)
    if not len(starts):
        return np.zeros(0, np.uint64), first
    word = np.cumsum(begins) - 1
    place = np.arange(len(data)) - starts[np.maximum(word, 0)]
    longest = int(place[~blank].max()) + 1
    power = np.full(longest + 1, _ODD, np.uint64)
    power[0] = 1
    power = np.multiply.accumulate(power)
    place[blank] = 0
    value = _BYTE[data]
    value *= power[place]
    value[blank] = 0
    value[: starts[0]] = 0
    return mix(np.add.reduceat(value, starts) + _ODD), first


def shingle_hashes(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles by text; a text of fewer words gives its whole sequence as one."""
    n_words = np.diff(first)
    per = np.where(n_words >= k, n_words - k + 1, (n_words > 0).astype(np.int64))
    begin = np.zeros(len(first), np.int64)
    np.cumsum(per, out=begin[1:])
    out = np.zeros(begin[-1], np.uint64)
    if not len(out):
        return out, begin
    padded = np.concatenate([words, np.zeros(k, np.uint64)])
    text = np.repeat(np.arange(len(per)), per)
    at = np.arange(len(out)) - begin[text] + first[text]
    left = first[text + 1] - at
    for j in range(k):
        part = padded[at + j] * _PLACE[j]
        out += part if j == 0 else np.where(left > j, part, np.uint64(0))
    return mix(out + np.minimum(left, k).astype(np.uint64) * _ODD), begin
