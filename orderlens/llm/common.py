"""What the operators of this subpackage share: column picking, staging, word hashes."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orderlens.operators import settle
from orderlens.operators.settle import release, shared_folder

__all__ = ["pick", "ticket", "shared_folder", "stage", "scratch", "table", "row_slices", "WordHasher"]

# Staged copies made within ``scratch`` blocks that are open.
_open: list[list[DataFrame]] = []


def stage(df: DataFrame) -> DataFrame:
    """As ``settle.stage``; within a ``scratch`` block the copy is deleted at its end."""
    staged = settle.stage(df)
    if _open:
        _open[-1].append(staged)
    return staged


@contextmanager
def scratch():
    """Deletes the copies staged within the block once it is left; results have to be written before."""
    _open.append([])
    try:
        yield
    finally:
        for staged in _open.pop():
            release(staged)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Exactly the named columns, whatever else the table holds.

    Columns are taken by place, so extra columns that differ only in case, or
    repeat a name, are no obstacle (the first exact match counts).
    """
    places = [df.columns.index(name) for name in names]
    plain = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    return plain.select(*[F.col(f"_{i}").alias(n) for i, n in zip(places, names, strict=True)])


def ticket(column: Column) -> Column:
    """60 bits of a document's hash, the same in every engine that knows MD5."""
    text = F.coalesce(column.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def without_rows(documents: DataFrame, found: DataFrame, broadcast_rows: int = 500_000) -> DataFrame:
    """The rows that are not among ``found`` (doc_id, xxhash64 of the text; null is an id), all columns kept.

    ``found`` is computed first and counted: few enough are broadcast, so that the
    documents stay where they are, else both sides are shuffled.
    """
    names = documents.columns
    plain = documents.toDF(*[f"_{i}" for i in range(len(names))])
    gone = stage(found.toDF("_id", "_print").distinct())
    few = gone.count() <= broadcast_rows
    own = F.col(f"_{names.index('doc_id')}").eqNullSafe(F.col("_id"))
    same = own & (F.xxhash64(f"_{names.index('text')}") == F.col("_print"))
    return plain.join(F.broadcast(gone) if few else gone, same, "left_anti").toDF(*names)


def row_slices(batch: pa.RecordBatch, column: int, limit: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with about ``limit`` bytes of text each (one row at least)."""
    lengths = np.asarray(
        pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64
    )
    start, held = 0, 0
    for i, length in enumerate(lengths):
        if held and held + length > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(length)
    if start < batch.num_rows:
        yield batch.slice(start)


def give_back() -> None:
    """Return memory that a reused worker process holds from earlier tasks to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the public splitmix64 constants)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def flat_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts (null: none) as one array, and where every text begins and ends."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, ends, data = texts.buffers()
    if not len(texts):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    bounds = np.frombuffer(ends, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if bounds[-1] == bounds[0]:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(texts) + 1, dtype=np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[bounds[0] : bounds[-1]]
    return raw, bounds - bounds[0]


class WordHasher:
    """64-bit hashes of all words of many texts, computed on the flat bytes.

    ``separators`` are the single-byte characters that part words; bytes of
    other characters belong to words. A-Z count as a-z.
    """

    BASE = 0x9E3779B97F4A7C15 | 1

    def __init__(self, separators: bytes):
        values = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        values[65:91] = values[97:123]
        self.values = values
        self.inside = np.ones(256, dtype=bool)
        self.inside[list(separators)] = False
        # Room for a slice of 500,000 bytes; longer texts let it grow.
        self._grow(1 << 19)

    def _grow(self, n: int) -> None:
        inverse = pow(self.BASE, -1, 1 << 64)
        with np.errstate(over="ignore"):
            self.up = np.cumprod(np.full(n, self.BASE, dtype=np.uint64)) * np.uint64(inverse)
            down = np.cumprod(np.full(n, inverse, dtype=np.uint64))
            self.down = down * np.uint64(self.BASE)

    def spans(self, raw: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Hashes of stretches of bytes: prefix sums of byte value times power, brought to place 0."""
        n = len(raw)
        if n + 1 > len(self.up):
            self._grow(2 * n)
        with np.errstate(over="ignore"):
            sums = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum(self.values[raw] * self.up[:n], out=sums[1:])
            found = (sums[stop] - sums[start]) * self.down[start]
            return _mix(found + (stop - start).astype(np.uint64))

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words in order, and per text where its words begin (n + 1 places)."""
        raw, bounds = flat_bytes(texts)
        if not len(raw):
            return np.zeros(0, dtype=np.uint64), np.zeros(len(texts) + 1, dtype=np.int64)
        n = len(raw)
        inside = self.inside[raw]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        cut = bounds[1:-1]
        cut = cut[cut < n]
        first[cut] = inside[cut]
        last = inside.copy()
        last[:-1] &= ~inside[1:] | first[1:]
        start, stop = np.flatnonzero(first), np.flatnonzero(last) + 1
        words = self.spans(raw, start, stop)
        return words, np.searchsorted(start, bounds)


@lru_cache(maxsize=1)
def word_hasher(separators: bytes) -> WordHasher:
    """One per worker process; its tables are shared by all its tasks."""
    return WordHasher(separators)


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` words (``len(words) - width + 1`` of them)."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        total = np.zeros(n, dtype=np.uint64)
        for i in range(width):
            total = total * np.uint64(0xD1342543DE82EF95) + words[i : i + n]
        return _mix(total)
