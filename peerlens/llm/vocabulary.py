"""Exact word counts of a corpus under 64-bit codes that no two of its words share.

Words are counted by code where they stand, in numpy, and only a task's distinct words
leave it.  The counts are grouped by the word itself, so a code that two words share
shows; then everything is counted anew under another seed.  With the codes settled, later
passes name words by number alone and remain exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, SpanHash, chunks, mix, text_bytes, words, write_scratch

#: Distinct words that a task holds before it hands them on.
HELD_WORDS = 400_000
SEEDS = 16

_NONE = np.zeros(256, dtype=bool)


def part_codes(parts: pa.Array, seed: int) -> np.ndarray:
    """A number for each row's part, the same for equal strings."""
    if isinstance(parts, pa.ChunkedArray):
        parts = parts.combine_chunks()
    encoded = parts.dictionary_encode()
    known = np.array(
        [int.from_bytes(hashlib.blake2b(f"{seed}:{p}".encode(), digest_size=8).digest(), "little") for p in encoded.dictionary.to_pylist()],
        dtype=np.uint64,
    )
    return known[encoded.indices.to_numpy(zero_copy_only=False)] if len(known) else np.zeros(len(parts), np.uint64)


def coded_words(
    data: np.ndarray, offsets: np.ndarray, parts: np.ndarray, seed: int, breaks: np.ndarray = _NONE
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes, documents, pieces, starts and ends of the lower-cased words of some texts.

    Words end at the usual separators and at bytes marked in ``breaks``; words with such a
    byte between them are in different pieces.  A code is never 0.
    """
    low = LOWER[data]
    low[breaks[data]] = 10
    starts, ends, first = words(low, offsets)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    cuts = np.concatenate(([0], np.cumsum(breaks[data]))) if breaks.any() else np.zeros(len(data) + 1, np.int64)
    spread = np.random.default_rng(seed).permutation(256).astype(np.uint8) if seed else np.arange(256, dtype=np.uint8)
    code = mix(SpanHash(spread[low])(starts, ends) ^ parts[doc])
    code[code == 0] = 1
    return code, doc, cuts[starts], starts, ends


def _strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Spans of a byte array as an Arrow column of strings."""
    size = ends - starts
    offsets = np.concatenate(([0], np.cumsum(size))).astype(np.int64)
    at = np.arange(offsets[-1]) - np.repeat(offsets[:-1] - starts, size)
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[at]))).cast(pa.string())


def _counter(seed: int, breaks: np.ndarray):
    def fold(held: list[pa.Table]) -> pa.Table:
        table = pa.concat_tables(held).combine_chunks()
        return table.group_by(["code", "part", "word"]).aggregate([("n", "sum")]).rename_columns(["code", "part", "word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            parts = part_codes(batch.column("part"), seed)
            counted = batch.column("counted").to_numpy(zero_copy_only=False)
            for a, b in chunks(offsets):
                own = data[offsets[a] : offsets[b]]
                code, doc, _, starts, ends = coded_words(own, offsets[a : b + 1] - offsets[a], parts[a:b], seed, breaks)
                if not len(code):
                    continue
                some, first, of = np.unique(code, return_index=True, return_inverse=True)
                n = np.bincount(of, weights=counted[a:b][doc], minlength=len(some)).astype(np.int64)
                held.append(pa.table({
                    "code": pa.array(some.view(np.int64)), "part": batch.column("part").take(pa.array(doc[first] + a)),
                    "word": _strings(LOWER[own], starts[first], ends[first]), "n": pa.array(n),
                }))
                if sum(t.num_rows for t in held) > 2 * HELD_WORDS:
                    held = [fold(held)]
                    if held[0].num_rows > HELD_WORDS:
                        yield from held.pop().to_batches()
        if held:
            yield from fold(held).to_batches()

    return run


def count_words(texts: DataFrame, breaks: np.ndarray = _NONE) -> tuple[DataFrame, int]:
    """The words of each part with their codes and counts, and the seed of the codes.

    ``texts`` has columns part string, text string (null: no words) and counted int: words
    of a row count that many times, and 0 lists them without counting.  The result, a
    written table, has code long, part string, word string and n long, a row for each word
    of a part; (part, word) and code name each other.
    """
    for seed in range(SEEDS):
        found = write_scratch(
            texts.mapInArrow(_counter(seed, breaks), "code long, part string, word string, n long")
            .groupBy("code", "part", "word").agg(F.sum("n").alias("n")),
            "words",
        )
        if found.groupBy("code").count().where("count > 1").isEmpty():
            return found, seed
    raise RuntimeError("no seed gives every word a code of its own")
