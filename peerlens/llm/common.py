"""Helpers shared by the text operators: byte views of Arrow batches, hashes, scratch tables.

Texts are handled as the UTF-8 bytes of an Arrow batch, without a Python object
per word.  A null text counts as empty everywhere unless an operator says
otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from peerlens.session import scratch_path

#: Bytes of text handled together in a task; arrays of eight bytes a byte stay near 16 MB.
CHUNK_BYTES = 2 << 20
#: Documents handled together, so that a 16-bit number can name one of them.
CHUNK_DOCS = 60_000

#: Bytes of a batch that a Python worker is sent at once, where much else is held.
BATCH_BYTES = 4 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_TABLE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

#: Word separators of the contracts: space and the bytes 9 to 13.
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def write_scratch(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared scratch folder and read it back.

    This cuts the lineage: a lost executor costs a re-read, not a recomputation.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What is run inside sends Python workers batches of BATCH_BYTES at most."""
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(limit, None)
    spark.conf.set(limit, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.unset(limit) if before is None else spark.conf.set(limit, before)


def shuffle_parts(spark: SparkSession) -> int:
    """The shuffle width the cluster was sized for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of a column, and the n + 1 offsets of the texts in them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
        column = column.fill_null(b"").cast(pa.large_binary())
    else:
        column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes each; a longer text stands alone."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), first + CHUNK_DOCS, n)
        yield first, last
        first = last


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (a bijection)."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


class SpanHash:
    """64-bit hashes of any spans of a byte array, from one prefix sum."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.inverse = np.cumprod(np.full(n + 1, _BASE_INVERSE, np.uint64))
        power = np.cumprod(np.full(n, _BASE, np.uint64))
        power *= _TABLE[data]
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(power, out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = (self.sums[end] - self.sums[start]) * self.inverse[start]
        return mix(raw + (np.asarray(end) - np.asarray(start)).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and the first word of each document (n + 1 numbers)."""
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = ~SPACE[data]
    edge = np.diff(inside)
    start_mark, end_mark = edge == 1, edge == -1
    # A document that ends inside a word ends that word.
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    if len(cut):
        cut = np.unique(cut)
        cut = cut[(inside[cut] == 1) & (inside[cut + 1] == 1)]
        start_mark[cut] = True
        end_mark[cut] = True
    starts, ends = np.flatnonzero(start_mark), np.flatnonzero(end_mark)
    return starts, ends, np.searchsorted(starts, offsets)


def windows(n_items: np.ndarray, size: int, short_whole: bool) -> tuple[np.ndarray, np.ndarray]:
    """For documents of ``n_items`` consecutive items: first item and document of each window.

    With ``short_whole`` a document of fewer items, but at least one, has one window.
    """
    count = np.maximum(n_items - size + 1, 0)
    if short_whole:
        count = np.where((count == 0) & (n_items > 0), 1, count)
    doc = np.repeat(np.arange(len(n_items)), count)
    base = np.concatenate(([0], np.cumsum(count)))[:-1]
    first_item = np.concatenate(([0], np.cumsum(n_items)))[:-1]
    return np.arange(count.sum()) - base[doc] + first_item[doc], doc


_STEP = [np.uint64(pow(0xC2B2AE3D27D4EB4F, i, 1 << 64)) for i in range(64)]


def shingles(word_hash: np.ndarray, n_words: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document of each ``size``-word shingle; short documents count as one whole."""
    first, doc = windows(n_words, size, short_whole=True)
    padded = np.concatenate((word_hash, np.zeros(size, np.uint64)))
    length = np.minimum(n_words, size)[doc]
    out = np.zeros(len(first), np.uint64)
    for i in range(size):
        part = padded[first + i] * _STEP[i + 1]
        out += part if i == 0 else np.where(i < length, part, np.uint64(0))
    return mix(out + length.astype(np.uint64)), doc


def distinct_per_doc(hashes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, hash) pairs, ordered by document, then hash."""
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    keep = np.ones(len(hashes), dtype=bool)
    keep[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    return hashes[keep], doc[keep]


def word_shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct word shingles of each document after lower-casing A-Z (hash, document)."""
    low = LOWER[data]
    starts, ends, first = words(low, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = SpanHash(low)(starts, ends)
    return distinct_per_doc(*shingles(h, np.diff(first), size))


def list_array(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """An Arrow list column from flat values and the number of values of each row."""
    offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
