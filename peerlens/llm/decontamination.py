"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Each benchmark item is cut into passages of at most ``PASSAGE`` bytes that overlap
by half, and into ones of ``SHORT`` bytes every ``STRIDE`` bytes.  Any ``QUOTE`` bytes
of an item hold a whole short passage; any ``SHORT`` bytes of it begin within half a
stride of one, which costs fewer edits than it may have, so a verbatim quote of that
length is found at every offset.  A region of a document within k edits of a passage of m bytes shares at
least m - q + 1 - k q of its q-grams with it, and all on diagonals at most k
apart.  So shared q-grams are counted in overlapping diagonal bands, only bands
that reach the bound are kept, and those are verified by a banded alignment of the
passage with the region.

Texts are compared as UTF-8 bytes after lower-casing A-Z and turning any white
space byte into a space; edits are counted in bytes.  The documents are scanned in
place (no shuffle).  The benchmark is the query set: it is split by a hash of the
item into blocks of bounded bytes, and each block is one broadcast and one scan.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, SPACE, chunks, mix, text_bytes

Q = 8
#: Edits allowed per byte of a passage.
RATE = 0.08
PASSAGE, SHORT, STRIDE = 120, 64, 8
#: Bytes of an item that hold a whole short passage at every offset.
QUOTE = SHORT + STRIDE - 1
#: Regions aligned at once; hits of whole items counted at once; bytes of text searched at once.
_ALIGNED = 1 << 14
_HITS = 1 << 18
_TEXT_BYTES = 1 << 18
#: Bytes of benchmark text in one broadcast.
BLOCK_BYTES = 4 << 20
_FILTER_BITS = 22
_FOLD = np.where(SPACE, np.uint8(32), LOWER)

HITS = "array<struct<item_id: long, start: int, end: int, edits: int>>"


def edit_budget(m: int, rate: float = RATE) -> int:
    """Edits for a passage of m bytes; few enough that a q-gram must be shared."""
    return max(0, min(int(rate * m), (m - Q) // Q))


@dataclass
class PassageIndex:
    """q-grams of a block of passages: sorted keys with their (passage, offset) occurrences."""

    item: np.ndarray
    text: list[np.ndarray]
    budget: np.ndarray
    need: np.ndarray
    keys: np.ndarray
    first: np.ndarray
    passage: np.ndarray
    offset: np.ndarray
    filter: np.ndarray
    #: The q-grams of whole items in the order of the keys: places by key, item's number, offset; least need of an item.
    home_first: np.ndarray
    home: np.ndarray
    home_offset: np.ndarray
    home_need: np.ndarray

    @staticmethod
    def build(items: list[tuple[int, str | None]], rate: float = RATE) -> PassageIndex:
        item, text, whole, source = [], [], [], []
        for key, value in items:
            data = _FOLD[np.frombuffer((value or "").encode("utf-8", "replace"), np.uint8)]
            whole.append(_grams(data))
            # An item that is one passage of SHORT bytes or fewer has that one only.
            cuts = [(PASSAGE, PASSAGE // 2), (SHORT, STRIDE)] if len(data) > SHORT else [(PASSAGE, PASSAGE)]
            for size, stride in cuts:
                for s in [*range(0, len(data) - size, stride), max(0, len(data) - size)]:
                    if len(part := data[s : s + size]) >= Q:
                        item.append(key)
                        text.append(part)
                        source.append(len(whole) - 1)
        sizes = np.array([len(t) for t in text], np.int64)
        budget = np.array([edit_budget(m, rate) for m in sizes], np.int64)
        gram = [_grams(t) for t in text]
        passage = np.repeat(np.arange(len(text)), [len(g) for g in gram])
        offset = np.concatenate([np.arange(len(g)) for g in gram]) if gram else np.zeros(0, np.int64)
        flat = np.concatenate(gram) if gram else np.zeros(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        keys, first = np.unique(flat[order], return_index=True)
        bits = np.zeros(1 << _FILTER_BITS, dtype=bool)
        bits[(mix(keys) >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
        need = sizes - Q + 1 - Q * budget
        flat_home = np.concatenate(whole) if whole else np.zeros(0, np.uint64)
        home = np.repeat(np.arange(len(whole)), [len(g) for g in whole])
        home_offset = np.concatenate([np.arange(len(g)) for g in whole]) if whole else np.zeros(0, np.int64)
        by_key = np.argsort(flat_home, kind="stable")
        home_need = np.full(len(whole), np.iinfo(np.int64).max)
        np.minimum.at(home_need, np.array(source, np.int64), need)
        return PassageIndex(
            np.array(item, np.int64), text, budget, need, keys, np.append(first, len(flat)),
            passage[order], offset[order], bits,
            np.append(np.searchsorted(flat_home[by_key], keys), len(flat_home)), home[by_key], home_offset[by_key], home_need,
        )


def _grams(data: np.ndarray) -> np.ndarray:
    """All q-grams of a byte array as 64-bit numbers."""
    if len(data) < Q:
        return np.zeros(0, np.uint64)
    data = np.ascontiguousarray(data)
    return np.ndarray((len(data) - Q + 1,), "<u8", data, strides=(1,))


def _ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... (count[i] numbers) for all i, concatenated."""
    base = np.concatenate(([0], np.cumsum(count)))[:-1]
    return np.arange(count.sum()) - np.repeat(base, count) + np.repeat(first, count)


def _promising(index: PassageIndex, place_in_doc: np.ndarray, slot: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Hits with enough others in a diagonal band of an item for its least demanding passage.

    A passage's diagonals are its item's but for a constant.  Bands are counted by a
    hash; a collision only lets more hits through.  A gram that many items have makes many
    hits: they are made twice, a slice at a time, first to be counted, then to be judged.
    """
    count = index.home_first[slot + 1] - index.home_first[slot]
    ends = np.cumsum(count)
    bits = min(20, max(16, int(2 * ends[-1]).bit_length() + 2))
    cuts = np.searchsorted(ends, np.arange(0, ends[-1] + _HITS, _HITS))
    cuts = np.unique(np.append(cuts, len(slot)))

    def hits() -> Iterator[tuple[np.ndarray, ...]]:
        for a, b in zip(cuts, cuts[1:]):
            place = _ranges(index.home_first[slot[a:b]], count[a:b])
            hit = np.repeat(np.arange(a, b), count[a:b])
            item = index.home[place]
            band = np.floor_divide(place_in_doc[hit] - index.home_offset[place], int(index.budget.max()) + 1)
            pair = mix((doc[hit] * len(index.home_need) + item).astype(np.uint64))
            one, two = ((mix(pair + x.astype(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64) for x in (band, band - 1))
            yield hit, item, one, two

    total = np.zeros(1 << bits, np.int64)
    for _, _, one, two in hits():
        total += np.bincount(one, minlength=1 << bits)
        total += np.bincount(two, minlength=1 << bits)
    keep = np.zeros(len(slot), dtype=bool)
    for hit, item, one, two in hits():
        keep[hit[np.maximum(total[one], total[two]) >= index.home_need[item]]] = True
    return keep


def _regions(index: PassageIndex, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Document, passage and first diagonal of the bands that reach the lemma's bound."""
    none = (np.zeros(0, np.int64),) * 4
    gram = _grams(data)
    if not len(gram) or not len(index.keys):
        return none
    # mix() in blocks keeps the scratch arrays in cache.
    maybe = np.concatenate([
        index.filter[(mix(gram[i : i + 65536].copy()) >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)]
        for i in range(0, len(gram), 65536)
    ])
    at = np.flatnonzero(maybe)
    slot = np.searchsorted(index.keys, gram[at])
    slot[slot == len(index.keys)] = 0
    hit = index.keys[slot] == gram[at]
    at, slot = at[hit], slot[hit]
    doc = np.searchsorted(offsets, at, side="right") - 1
    inside = at + Q <= offsets[doc + 1]
    at, slot, doc = at[inside], slot[inside], doc[inside]
    if not len(at):
        return none
    # A region spans at most PASSAGE + budget bytes; hits that are too lonely for any passage go.
    span = PASSAGE + int(index.budget.max())
    left, right = np.searchsorted(at, at - span), np.searchsorted(at, at + span, side="right")
    lonely = right - left < index.need.min()
    at, slot, doc = at[~lonely], slot[~lonely], doc[~lonely]
    if not len(at):
        return none
    keep = _promising(index, at - offsets[doc], slot, doc)
    at, slot, doc = at[keep], slot[keep], doc[keep]
    found = [_enough(index, *hits) for hits in _occurrences(index, at - offsets[doc], slot, doc)]
    doc, passage, band, shared = (np.concatenate([f[i] for f in found]) if found else none[i] for i in range(4))
    return doc, passage, band * (index.budget[passage] + 1), shared


def _occurrences(index: PassageIndex, place_in_doc: np.ndarray, slot: np.ndarray, doc: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Document, passage, offset in it and diagonal of all hits, some documents at a time.

    A document with very many hits goes by parts of the passages.
    """
    count = index.first[slot + 1] - index.first[slot]
    begin = np.flatnonzero(np.diff(doc, prepend=-1))
    ends = np.cumsum(count)
    upto = ends[np.append(begin[1:], len(doc)) - 1] if len(doc) else np.zeros(0, np.int64)
    for own in chunks(np.concatenate(([0], upto)), _HITS):
        a, b = begin[own[0]], (np.append(begin, len(doc)))[own[1]]
        parts = -(-int(count[a:b].sum()) // _HITS)
        inner = [(a + x, a + y) for x, y in chunks(np.concatenate(([0], np.cumsum(count[a:b]))), _HITS)] if parts > 1 else [(a, b)]
        for part in range(parts):
            pieces = []
            for x, y in inner:
                place, hit = _ranges(index.first[slot[x:y]], count[x:y]), np.repeat(np.arange(x, y), count[x:y])
                if parts > 1:
                    mine = index.passage[place] % parts == part
                    place, hit = place[mine], hit[mine]
                pieces.append((doc[hit], index.passage[place], index.offset[place], place_in_doc[hit] - index.offset[place]))
            yield tuple(np.concatenate(c) for c in zip(*pieces))


def _enough(index: PassageIndex, doc: np.ndarray, passage: np.ndarray, offset: np.ndarray, diagonal: np.ndarray) -> tuple[np.ndarray, ...]:
    """Document, passage, band and shared q-grams of the bands that have as many as the lemma asks for."""
    # Bands of width 2 s start every s = budget + 1 diagonals: any k + 1 neighbours share one.
    step = index.budget[passage] + 1
    band = np.floor_divide(diagonal, step)
    doc, passage, offset = np.tile(doc, 2), np.tile(passage, 2), np.tile(offset, 2)
    band = np.concatenate((band, band - 1))
    order = np.lexsort((offset, band, passage, doc))
    doc, passage, band, offset = doc[order], passage[order], band[order], offset[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (passage[1:] != passage[:-1]) | (band[1:] != band[:-1])
    fresh = new.copy()
    fresh[1:] |= offset[1:] != offset[:-1]
    begin = np.flatnonzero(new)
    shared = np.add.reduceat(fresh.astype(np.int64), begin) if len(begin) else np.zeros(0, np.int64)
    enough = shared >= index.need[passage[begin]]
    return doc[begin][enough], passage[begin][enough], band[begin][enough], shared[enough]


def banded_alignment(passage: np.ndarray, region: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Least edits of each row of ``passage`` against any stretch of that row of ``region``, and the stretch's end.

    Row r of ``region`` holds the bytes on diagonals 0 to width - 1 relative to the
    passage: region[r, i + d] faces passage[r, i] on diagonal d (0 pads, it equals no
    byte of a text).  Cells outside the band are not visited.
    """
    n, d = len(region), np.arange(width)
    cost = np.zeros((n, width), np.int32)  # a match may begin on any diagonal
    for i in range(passage.shape[1]):
        step = cost + (region[:, i : i + width] != passage[:, i : i + 1])
        step[:, :-1] = np.minimum(step[:, :-1], cost[:, 1:] + 1)
        cost = np.minimum.accumulate(step - d, axis=1) + d
    best = cost.argmin(1)
    return cost[np.arange(n), best], best + passage.shape[1]


def find_passages(index: PassageIndex, data: np.ndarray, offsets: np.ndarray) -> list[list[tuple[int, int, int, int]]]:
    """For each document: (item, start, end, edits), the best place of each item, by item."""
    best: list[dict[int, tuple[int, int, int]]] = [{} for _ in range(len(offsets) - 1)]
    for a, b in chunks(offsets, _TEXT_BYTES):
        at = offsets[a : b + 1] - offsets[a]
        text = _FOLD[data[offsets[a] : offsets[b]]]
        doc, passage, diagonal, _ = _regions(index, text, at)
        sizes = np.array([len(index.text[p]) for p in passage], np.int64)
        groups = [np.flatnonzero(sizes == m) for m in np.unique(sizes)]
        for mine in (g[i : i + _ALIGNED] for g in groups for i in range(0, len(g), _ALIGNED)):
            # Passages of one length have one budget.
            pattern, k = np.stack([index.text[p] for p in passage[mine]]), int(index.budget[passage[mine[0]]])
            m = pattern.shape[1]
            width = 2 * (k + 1) + 2 * k
            low = diagonal[mine] - k
            place = low[:, None] + np.arange(width + m)
            size = (at[doc[mine] + 1] - at[doc[mine]])[:, None]
            valid = (place >= 0) & (place < size)
            region = np.where(valid, text[np.clip(place + at[doc[mine]][:, None], 0, max(0, len(text) - 1))], 0)
            edits, end = banded_alignment(pattern, region, width)
            for r in np.flatnonzero(edits <= k):
                d, item = a + int(doc[mine[r]]), int(index.item[passage[mine[r]]])
                stop = int(min(max(0, low[r] + end[r]), size[r, 0]))
                found = (int(edits[r]), max(0, stop - m), stop)
                if item not in best[d] or found < best[d][item]:
                    best[d][item] = found
    return [[(item, x[1], x[2], x[0]) for item, x in sorted(hits.items())] for hits in best]


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, rate: float) -> list[PassageIndex]:
    """Indexes of the benchmark, each over about BLOCK_BYTES of its text at most."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(text_col).alias("text")).where("item IS NOT NULL")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // BLOCK_BYTES))
    for r in range(n):
        rows = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == r)
        yield PassageIndex.build(sorted(((x["item"], x["text"]) for x in rows.toLocalIterator()), key=str), rate)


def _finder(docs: DataFrame, index: PassageIndex):
    held = docs.sparkSession.sparkContext.broadcast(index)

    @F.arrow_udf(HITS)
    def find(texts: pa.Array) -> pa.Array:
        data, offsets = text_bytes(texts)
        hits = find_passages(held.value, data, offsets)
        flat = [h for x in hits for h in x]
        columns = [pa.array([h[i] for h in flat], pa.int64() if i == 0 else pa.int32()) for i in range(4)]
        rows = pa.StructArray.from_arrays(columns, names=["item_id", "start", "end", "edits"])
        ends = np.concatenate(([0], np.cumsum([len(x) for x in hits]))).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), rows)

    return find


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", rate: float = RATE,
) -> DataFrame:
    """Rows (doc_id, item_id, start, end, edits): items of which a passage occurs in a document.

    start and end are the byte offsets of the best region; its edits are at most
    ``rate`` of the passage's bytes.  Null and empty texts have no hits, nor have
    items of fewer than 8 bytes, null text or null id.  Repeated documents give
    repeated rows; of repeated items with one id the best place is kept.  Empty
    tables give no rows.  Other columns are not read.
    """
    out = None
    for index in _blocks(benchmark, item_col, item_text_col, rate):
        part = (
            docs.select(F.col(id_col).alias("doc_id"), _finder(docs, index)(F.col(text_col)).alias("hits"))
            .where(F.size("hits") > 0).select("doc_id", F.explode("hits").alias("hit"))
            .select("doc_id", "hit.item_id", "hit.start", "hit.end", "hit.edits")
        )
        out = part if out is None else out.unionByName(part)
    return out


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", rate: float = RATE
) -> DataFrame:
    """``docs`` without the rows in which a benchmark passage occurs; columns unchanged."""
    mark = "__benchmark_hits"
    for index in _blocks(benchmark, item_col, item_text_col, rate):
        docs = docs.withColumn(mark, F.size(_finder(docs, index)(F.col(text_col)))).where(F.col(mark) == 0).drop(mark)
    return docs
