"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from tidemark.sources.shared import cut_lineage, stored  # noqa: F401  for the operators


_LIBC = ctypes.CDLL(None)


def give_back() -> None:
    """Return memory that is free to the system: workers are kept for later steps, beside those of other steps."""
    pa.default_memory_pool().release_unused()
    trim = getattr(_LIBC, "malloc_trim", None)
    if trim is not None:
        trim(0)


def lean(f):
    """A function of batches that gives back memory when its partition ends."""

    @functools.wraps(f)
    def run(batches):
        try:
            yield from f(batches)
        finally:
            give_back()

    return run


def lean_group(f):
    """A function of (key, frame) that gives back memory after each group."""

    def run(key, frame):
        try:
            return f(key, frame)
        finally:
            give_back()

    return run


def lean_cogroup(f):
    """As ``lean_group``, of (key, left, right)."""

    def run(key, left, right):
        try:
            return f(key, left, right)
        finally:
            give_back()

    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column, end to end, and the offsets of its rows. Nulls are empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def row_blocks(offsets: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Consecutive row ranges of about ``limit`` bytes each; a longer row stands alone."""
    blocks, start = [], 0
    for i in range(1, len(offsets)):
        if offsets[i] - offsets[start] > limit and i - 1 > start:
            blocks.append((start, i - 1))
            start = i - 1
    if start < len(offsets) - 1:
        blocks.append((start, len(offsets) - 1))
    return blocks


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and xor-shift), in place."""
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    return x


def byte_table(seed: int) -> np.ndarray:
    """One pseudo-random 64-bit number for each byte value."""
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_hashes(data: np.ndarray, offsets: np.ndarray, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the whitespace-separated words of each row, and the first word of each row.

    Words are maximal runs of bytes other than ASCII white space; they never cross rows.
    """
    n = len(data)
    rows = len(offsets) - 1
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(rows + 1, np.int64)
    solid = ~SPACE[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    inner = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[inner] = solid[inner]
    starts = np.flatnonzero(first)
    # position-weighted sums: bytes times an odd power of their place in the word
    where = np.cumsum(first) - 1
    place = np.arange(n) - starts[np.maximum(where, 0)] if len(starts) else np.zeros(n, np.int64)
    place[~solid] = 0
    power = mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)) | np.uint64(1)
    value = byte_table(seed)[data]
    value *= power[place & 63] + (place >> 6).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1E)
    value[~solid] = 0
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(rows + 1, np.int64)
    words = np.add.reduceat(value, starts)
    return mix(words), np.searchsorted(starts, offsets)
