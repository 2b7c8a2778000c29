"""Token ids in binary shard files with Elias-Fano document boundaries.

The documents are ordered by id over range partitions; each partition encodes its
texts and writes one or more shards: the concatenated ids (little-endian, two bytes
where the vocabulary allows, else four) and the documents' end positions in
Elias-Fano form.  n ends below u take about 2 + log2(u / n) bits each: the low bits
in a packed array, the high bits in unary in a bit vector.  A select directory (the
position of every 256th one) finds the k-th end with one lookup and a scan of a few
words, so no 64-bit table of offsets is stored.

A shard is a row of a Parquet table in the folder that executors share, written by
Spark's committer: a lost or repeated task leaves no half file, and no task opens a
path of its own.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SpanHash, chunks, shuffle_parts, small_batches, text_bytes

#: Bytes of ids in one shard, and of text encoded at once.
SHARD_BYTES, ENCODE_BYTES = 8 << 20, 1 << 20
#: Ones between two entries of the select directory.
SELECT_STEP = 256
#: Bytes that a generation of a Python worker's memory of encoded pieces may take, of two that it keeps,
#: and what an entry takes besides its characters and ids.
CACHE_BYTES, ENTRY_BYTES = 32 << 20, 40
#: Pieces that go to the library as one text.
GROUP = 4096


@dataclass
class EliasFano:
    """A non-decreasing sequence of numbers below ``universe``, n at least 0."""

    n: int
    universe: int
    low_bits: int
    low: bytes
    high: bytes
    directory: bytes

    @staticmethod
    def encode(values: np.ndarray, universe: int) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        low_bits = max(0, int(universe // max(n, 1)).bit_length() - 1)
        low = values & np.uint64((1 << low_bits) - 1)
        bits = (low[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1) if low_bits else np.zeros((n, 0))
        ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        high = np.zeros((int(ones[-1]) + 1) if n else 0, np.uint8)
        high[ones] = 1
        return EliasFano(
            n, int(universe), low_bits, np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes(),
            np.packbits(high, bitorder="little").tobytes(), ones[::SELECT_STEP].astype("<u4").tobytes(),
        )

    def select(self, k: int) -> int:
        """The k-th number, from 0."""
        if not 0 <= k < self.n:
            raise IndexError(k)
        high = np.frombuffer(self.high, np.uint8)
        at = int(np.frombuffer(self.directory, "<u4")[k // SELECT_STEP])
        left, byte = k % SELECT_STEP, at // 8
        bits = int(high[byte]) >> (at % 8) << (at % 8)
        while (ones := bits.bit_count()) <= left:
            left -= ones
            byte += 1
            bits = int(high[byte])
        for _ in range(left):
            bits &= bits - 1
        position = byte * 8 + (bits & -bits).bit_length() - 1
        low, start = 0, k * self.low_bits
        if self.low_bits:
            piece = int.from_bytes(self.low[start // 8 : (start + self.low_bits + 7) // 8], "little")
            low = (piece >> (start % 8)) & ((1 << self.low_bits) - 1)
        return ((position - k) << self.low_bits) | low

    def decode(self) -> np.ndarray:
        """All numbers."""
        ones = np.flatnonzero(np.unpackbits(np.frombuffer(self.high, np.uint8), bitorder="little"))[: self.n]
        out = (ones - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low_bits)
        if self.low_bits:
            bits = np.unpackbits(np.frombuffer(self.low, np.uint8), bitorder="little")[: self.n * self.low_bits]
            out |= bits.reshape(self.n, self.low_bits).astype(np.uint64) @ (np.uint64(1) << np.arange(self.low_bits, dtype=np.uint64))
        return out.astype(np.int64)


#: Classes of characters in the split that goes before the byte-level vocabulary's merges.
_OTHER, _LETTER, _NUMBER, _WHITE = range(4)
_CLASSES: list[np.ndarray] = []


def _classes() -> np.ndarray:
    """The class of every code point."""
    if not _CLASSES:
        import regex

        found, every = np.zeros(0x110000, np.uint8), "".join(map(chr, range(0x110000)))
        for kind, name in ((_LETTER, "L"), (_NUMBER, "N"), (_WHITE, "White_Space")):
            for run in regex.finditer(rf"\p{{{name}}}+", every):
                found[run.start() : run.end()] = kind
        _CLASSES.append(found)
    return _CLASSES[0]


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of spans, one span after another."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def split_pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the pieces of UTF-8 texts, and their kinds (1: a space and letters, 2: letters, 0: others).

    Pieces are what this finds, one after another: a run of letters, of numbers or of other
    characters, each with a space before it or none; 's, 't, 're, 've, 'm, 'll or 'd; white
    space without its last character if something follows; white space.
    """
    padded = np.concatenate((data, np.zeros(4, np.uint8)))
    at = np.flatnonzero((data & 0xC0) != 0x80)
    lead = data[at]
    table = _classes()
    kind = table[:256][lead]
    for low, high, size in ((0xC0, 0xE0, 2), (0xE0, 0xF0, 3), (0xF0, 0x100, 4)):
        wide = np.flatnonzero((lead >= low) & (lead < high))
        point = (lead[wide] & (0x7F >> size)).astype(np.int32)
        for i in range(1, size):
            point = (point << 6) | (padded[at[wide] + i] & 0x3F)
        kind[wide] = table[np.minimum(point, 0x10FFFF)]
    n = len(at)
    # One more character after the end, which begins a text.
    begins = np.zeros(n + 1, bool)
    begins[np.searchsorted(at, offsets)] = True
    starts = begins.copy()
    starts[1:n] |= kind[1:] != kind[:-1]
    after = np.flatnonzero((kind[1:] != _WHITE) & (kind[:-1] == _WHITE) & ~begins[1:n]) + 1
    starts[after - 1] = True
    starts[after[lead[after - 1] == 32]] = False
    short = np.flatnonzero((lead[:-1] == 39) & starts[: n - 1] & ~begins[1:n] & (kind[1:] == _LETTER))
    one, two = padded[at[short] + 1], padded[at[short] + 2]
    inside = ~begins[np.minimum(short + 2, n)]
    length = np.where(np.isin(one, np.frombuffer(b"stmd", np.uint8)), 1, 0)
    length[inside & (((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108))] = 2
    short, length = short[length > 0], length[length > 0]
    starts[short + 1] = False
    starts[short + 1 + length] = True
    first = np.flatnonzero(starts[:n])
    follows = np.append(kind, _OTHER)[first + 1]
    spaced = (lead[first] == 32) & ~starts[first + 1] & (follows == _LETTER)
    return at[first], np.where(spaced, 1, np.where(kind[first] == _LETTER, 2, 0))


class PieceMemory:
    """Pieces by the hash of their bytes, with their ids."""

    def __init__(self, kind: str):
        self.codes, self.rows = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # sorted hashes, and which entry each is
        self.ends, self.id_ends = np.zeros(1, np.int64), np.zeros(1, np.int64)  # of the entries
        self.pieces, self.ids = np.zeros(0, np.uint8), np.zeros(0, kind)

    def find(self, codes: np.ndarray) -> np.ndarray:
        """Entries of the hashes; -1: none."""
        if not len(self.codes):
            return np.full(len(codes), -1)
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        return np.where(self.codes[at] == codes, self.rows[at], -1)

    def spans(self, rows: np.ndarray) -> tuple[np.ndarray, ...]:
        """Starts and sizes of entries' pieces, then of their ids."""
        return self.ends[rows], self.ends[rows + 1] - self.ends[rows], self.id_ends[rows], self.id_ends[rows + 1] - self.id_ends[rows]

    def add(self, codes: np.ndarray, pieces: np.ndarray, sizes: np.ndarray, ids: np.ndarray, id_sizes: np.ndarray) -> None:
        """Entries with hashes that are new here, in any order."""
        order = np.argsort(codes)
        at = np.searchsorted(self.codes, codes[order])
        self.rows = np.insert(self.rows, at, len(self.rows) + order)
        self.codes = np.insert(self.codes, at, codes[order])
        self.ends = np.concatenate((self.ends, self.ends[-1] + np.cumsum(sizes)))
        self.id_ends = np.concatenate((self.id_ends, self.id_ends[-1] + np.cumsum(id_sizes)))
        self.pieces, self.ids = np.concatenate((self.pieces, pieces)), np.concatenate((self.ids, ids))


class Encoder:
    """Ids of texts by the tokenizers library, with a memory of pieces already encoded.

    Merges never cross the pieces of the vocabulary's split, so a piece's ids are
    kept and reused.  Unknown pieces are encoded by the library, words many at a
    time.  Pieces are found and looked up as bytes of whole batches, by hashes whose bytes
    are then compared.  Texts in which two pieces share a hash, texts that hold a special
    token's string, and tokenizers with another split, normalizer or post-processor, go to
    the library whole.
    """

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.tokenizer = Tokenizer.from_file(path)
        split = spec.get("pre_tokenizer") or {}
        self.by_piece = (
            split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
            and not spec.get("normalizer") and not spec.get("post_processor") and not spec.get("truncation")
        )
        self.special = [t["content"].encode() for t in spec.get("added_tokens", [])]
        self.kind = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.memory, self.older = PieceMemory(self.kind), None
        self.size = 0

    def _keep(self, codes: np.ndarray, pieces: np.ndarray, sizes: np.ndarray, ids: np.ndarray, id_sizes: np.ndarray) -> None:
        self.memory.add(codes, pieces, sizes, ids, id_sizes)
        self.size += pieces.nbytes + ids.nbytes + ENTRY_BYTES * len(codes)

    def _recall(self, codes: np.ndarray, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        """Entries of distinct pieces in the newer generation, which gets what it lacks; -1 where another piece has the hash.

        A full generation becomes the older one, which is let go.
        """
        if self.size > CACHE_BYTES:
            self.memory, self.older, self.size = PieceMemory(self.kind), self.memory, 0
        lacking = np.flatnonzero(self.memory.find(codes) < 0)
        if self.older is not None:
            rows = self.older.find(codes[lacking])
            again, rows = lacking[rows >= 0], rows[rows >= 0]
            at, n, id_at, id_n = self.older.spans(rows)
            self._keep(codes[again], self.older.pieces[_spread(at, n)], n, self.older.ids[_spread(id_at, id_n)], id_n)
            lacking = lacking[~np.isin(lacking, again)]
        if len(lacking):
            lacking = lacking[np.argsort(kinds[lacking], kind="stable")]
            pieces, ends = data[_spread(starts[lacking], sizes[lacking])], np.concatenate(([0], np.cumsum(sizes[lacking])))
            edges = np.searchsorted(kinds[lacking], (0, 1, 2, 3)).tolist()
            groups = [(kind, i, min(i + GROUP, b)) for kind, a, b in zip((0, 1, 2), edges, edges[1:]) for i in range(a, b, GROUP)]
            learned = [self._learn(kind, pieces[ends[i] : ends[j]], sizes[lacking[i:j]]) for kind, i, j in groups]
            self._keep(codes[lacking], pieces, sizes[lacking], *(np.concatenate([x[k] for x in learned]) for k in (0, 1)))
        rows = self.memory.find(codes)
        at, n, *_ = self.memory.spans(rows)
        same = n == sizes
        alike = np.flatnonzero(same)
        equal = self.memory.pieces[_spread(at[alike], n[alike])] == data[_spread(starts[alike], n[alike])]
        same[alike[np.repeat(np.arange(len(alike)), n[alike])[~equal]]] = False
        return np.where(same, rows, -1)

    def _learn(self, kind: int, pieces: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces of one kind, and how many each has."""
        ends = np.cumsum(sizes)
        if not kind:
            raw = pieces.tobytes()
            texts = [raw[a:b].decode() for a, b in zip((ends - sizes).tolist(), ends.tolist())]
            coded = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            return np.array([i for x in coded for i in x], self.kind), np.array([len(x) for x in coded], np.int64)
        # Words with a space before them stand next to each other; words without are
        # parted by line breaks, which are pieces of their own.
        step = kind
        if step == 2:
            pieces = np.insert(pieces, ends, 10)
        coded = self.tokenizer.encode(pieces.tobytes().decode(), add_special_tokens=False)
        ids, word = np.array(coded.ids, self.kind), np.array(coded.word_ids, np.int64)
        own = word % step == 0
        return ids[own], np.bincount(word[own] // step, minlength=len(sizes))

    def _encode_chunk(self, data: np.ndarray, offsets: np.ndarray) -> list[bytes | None]:
        """Ids of some texts as little-endian bytes; None where two pieces share a hash."""
        if not len(data):
            return [b""] * (len(offsets) - 1)
        starts, kinds = split_pieces(data, offsets)
        ends = np.append(starts[1:], len(data))
        sizes = ends - starts
        codes, first, of = np.unique(SpanHash(data)(starts, ends), return_index=True, return_inverse=True)
        rows = self._recall(codes, data, starts[first], sizes[first], kinds[first])
        text = np.searchsorted(starts, offsets)
        # All pieces of a hash must be the one that stands for it.
        same = (sizes == sizes[first][of]) & (rows >= 0)[of]
        shift = np.where(same, starts[first][of] - starts, 0)
        if not (equal := data == data[np.repeat(shift, sizes) + np.arange(len(data))]).all():
            same &= np.logical_and.reduceat(equal, starts)
        _, _, at, n = self.memory.spans(np.maximum(rows, 0))
        count = n[of]
        ids = self.memory.ids[_spread(at[of], count)].tobytes()
        place = np.concatenate(([0], np.cumsum(count)))[text] * np.dtype(self.kind).itemsize
        wrong = np.concatenate(([0], np.cumsum(~same)))[text]
        return [ids[a:b] if ok else None for a, b, ok in zip(place[:-1].tolist(), place[1:].tolist(), (np.diff(wrong) == 0).tolist())]

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        """Ids of each text as little-endian bytes."""
        data, offsets = text_bytes(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
        whole = np.full(len(offsets) - 1, not self.by_piece)
        raw = data.tobytes()
        for special in self.special:
            at = raw.find(special)
            while at >= 0:
                text = int(np.searchsorted(offsets, at, side="right")) - 1
                whole[text] |= at + len(special) <= offsets[text + 1]
                at = raw.find(special, at + 1)
        # A long text is cut where a space after a character begins a piece in any case.
        cuts = [np.zeros(0, np.int64)]
        for i in np.flatnonzero((np.diff(offsets) > ENCODE_BYTES) & ~whole):
            own = data[offsets[i] : offsets[i + 1]]
            able = np.flatnonzero((own[1:] == 32) & (own[:-1] > 32) & (own[:-1] < 127)) + 1
            picked = np.searchsorted(able, np.arange(ENCODE_BYTES, len(own), ENCODE_BYTES))
            cuts.append(np.unique(able[picked[picked < len(able)]]) + offsets[i])
        cut = np.concatenate(cuts)
        bounds, first = np.sort(np.concatenate((offsets, cut))), np.searchsorted(cut, offsets) + np.arange(len(offsets))
        coded: list[bytes | None] = [None] * (len(bounds) - 1)
        for a, b in chunks(bounds, ENCODE_BYTES) if self.by_piece else ():
            coded[a:b] = self._encode_chunk(data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a])
        out = []
        for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
            if whole[i] or None in coded[a:b]:
                text = raw[offsets[i] : offsets[i + 1]].decode()
                out.append(np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes())
            else:
                out.append(coded[a] if b == a + 1 else b"".join(coded[a:b]))
        return out


_ENCODERS: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    """The Python worker's encoder, kept from task to task.

    A task's own function comes with copies of the globals that it names; this one is
    named by its module, where they last.
    """
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]

SHARD = "part int, seq int, n_docs int, n_ids long, ids_kind string, ids binary, doc_ids binary, low_bits int, low binary, high binary, directory binary"


def _write_shards(path: str, end_id: int):
    def shard(part: int, seq: int, ids: list[bytes], kind: str, names: list[int | None]) -> pa.RecordBatch:
        width = int(kind[-1])
        ends = np.cumsum([len(x) // width for x in ids])
        total = int(ends[-1])
        # The end of document k is stored as end - 1, which is below the number of ids.
        ef = EliasFano.encode(ends - 1, total)
        known = np.array([x is not None for x in names])
        doc_ids = np.packbits(known).tobytes() + np.array([x or 0 for x in names], "<i8").tobytes()
        row = [part, seq, len(ids), total, kind, b"".join(ids), doc_ids, ef.low_bits, ef.low, ef.high, ef.directory]
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.int32()] + [pa.binary()] * 3
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=[c.split()[0] for c in SHARD.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = _encoder(path)
        end = np.array([end_id], encoder.kind).tobytes()
        part, seq, held, names, size = -1, 0, [], [], 0
        for batch in batches:
            for first in range(0, batch.num_rows, 1024):
                rows = batch.slice(first, 1024)
                part = rows.column(2)[0].as_py()
                for key, coded in zip(rows.column(0).to_pylist(), encoder.encode(rows.column(1))):
                    held.append(coded + end)
                    names.append(key)
                    size += len(coded)
                    if size >= SHARD_BYTES:
                        yield shard(part, seq, held, encoder.kind, names)
                        seq, held, names, size = seq + 1, [], [], 0
        if held:
            yield shard(part, seq, held, encoder.kind, names)

    return run


def write_tokens(
    docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None
) -> None:
    """Encode ``docs`` in ascending order of the id and write the shards under ``path``.

    ``end_id`` follows every document.  A null text is empty: its document is the end
    id alone.  A null id goes first; repeated ids stand next to each other, ordered
    by text.  An empty table writes no shard.  Other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # A third of all rows may repeat one id: the text's hash splits it, whatever the range.
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ranged = rows.repartitionByRange(parts or 2 * shuffle_parts(docs.sparkSession), *order)
    ordered = ranged.withColumn("part", F.spark_partition_id()).sortWithinPartitions(*order)
    with small_batches(docs.sparkSession):
        ordered.mapInArrow(_write_shards(tokenizer_path, end_id), SHARD).write.parquet(path)


_READ = "part int, seq int, doc_id long, local long, n_tokens long, ids_crc32 long"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ef = EliasFano(row["n_docs"], row["n_ids"], row["low_bits"], row["low"], row["high"], row["directory"])
            ends = ef.decode() + 1
            starts = np.concatenate(([0], ends[:-1]))
            ids = np.frombuffer(row["ids"], row["ids_kind"]).astype("<u4")
            n = row["n_docs"]
            known = np.unpackbits(np.frombuffer(row["doc_ids"], np.uint8, (n + 7) // 8))[:n].astype(bool)
            names = np.frombuffer(row["doc_ids"], "<i8", n, (n + 7) // 8)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(n, row["part"], np.int32)), pa.array(np.full(n, row["seq"], np.int32)),
                    pa.array(names, mask=~known), pa.array(starts), pa.array(ends - starts),
                    pa.array([zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts, ends)], pa.int64()),
                ],
                names=[c.split()[0] for c in _READ.split(", ")],
            )


def read_boundaries(spark, path: str) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids_crc32) from the shards; start counts the ids of all documents before.

    A shard's first position is the sum of the lengths of the shards before it,
    from the shards' headers: a window over the shards of each range partition and
    one over the partitions' totals.
    """
    table = spark.read.schema(SHARD).parquet(path)
    heads = table.select("part", "seq", "n_ids")
    in_part = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = heads.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("from"))
    base = heads.withColumn("base", F.coalesce(F.sum("n_ids").over(in_part), F.lit(0))).join(parts, "part").select(
        "part", "seq", (F.col("base") + F.col("from")).alias("base")
    )
    return table.mapInArrow(_read, _READ).join(base, ["part", "seq"]).select(
        "doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32"
    )
