"""Hard negatives from blocks of vectors along a Hilbert curve.

Vectors are scaled to whole numbers and ordered along a Hilbert curve, which keeps near
vectors together, and written as Parquet rows of one block each, with the least and the
greatest value of every dimension in the block (its zone).  Columns of a Parquet file are
read one by one, so the zones are read without the vectors.

For an anchor, interval arithmetic over a zone bounds the inner products with all of a
block's rows from both sides.  A block is read for an anchor only if these bounds let one
of its rows into what the anchor looks for: among the nearest rows of its own label, or
among the first negatives of one of its score windows.  What an anchor's own block gives
is known first and sets the marks that other blocks have to reach.  Anchors travel in
tiles of neighbours on the curve; a block's share of the work is a matrix product.  What
is chosen is a bit for each anchor: a crowd of tiles meets a run of blocks in one task,
so vectors are sent once for each such meeting and not once for each pair.

The queries are a stated set (the anchors) against all rows, in blocks: where the zones
exclude nothing, as with vectors without clusters in many dimensions, every anchor meets
every block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peerlens.session import scratch_path

from .common import write_scratch

#: Rows of a block; anchors of a tile; blocks whose zones are looked at together.
BLOCK_ROWS = 1024
TILE_ANCHORS = 256
PAGE_BLOCKS = 512
#: Bits of a dimension that place a vector on the curve.
HILBERT_BITS = 6
#: Bytes of vectors in one part of the written blocks.
PART_BYTES = 32 << 20
#: Bytes of vectors of a run of blocks and of a crowd of tiles, which meet in one task.
RUN_BYTES, CROWD_BYTES = 16 << 20, 4 << 20
#: Found rows that a tile may hold beyond twice those it keeps.
HELD_ROWS = 1 << 12
#: At most so many parts are named when parts that nobody needs are left unread.
NAMED_PARTS = 5000

_NEVER = np.iinfo(np.int64).min


def hilbert_keys(points: np.ndarray, bits: int = HILBERT_BITS) -> list[bytes]:
    """Places of points (rows of whole numbers below 2**bits) on a Hilbert curve, as sortable bytes.

    The axes become the transposed index by exclusive ors, the highest bit first (the
    well-known method of Skilling, 2004); its bits are then read dimension by dimension.
    """
    x = points.astype(np.int64).T.copy()
    n = len(x)
    for b in range(bits - 1, 0, -1):
        q, low = 1 << b, (1 << b) - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, 0, -1):
        t ^= np.where((x[n - 1] & (1 << b)) != 0, (1 << b) - 1, 0)
    x ^= t
    planes = np.stack([(x >> b) & 1 for b in range(bits - 1, -1, -1)])  # bit, dimension, row
    packed = np.packbits(planes.reshape(bits * n, -1).astype(np.uint8).T, axis=1)
    return [row.tobytes() for row in packed]


def inner_bounds(anchors: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the inner products of each anchor with any vector between ``low`` and ``high`` (a row for each block)."""
    up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
    return product(up, low) + product(down, high), product(up, high) + product(down, low)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two matrices of whole numbers."""
    size = a.shape[1] * float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0))
    if size < 2**24:  # every sum is exact in a float
        return (a.astype(np.float32) @ b.astype(np.float32).T).astype(np.int64)
    if size < 2**52:  # every sum is exact in a double
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def _unpack(values: bytes, dims: int) -> np.ndarray:
    return np.frombuffer(values, np.int32).reshape(-1, dims).astype(np.int64)


def _longs(values: bytes) -> np.ndarray:
    return np.frombuffer(values, np.int64)


def _whole(vector: Column, dims: int, scale: int) -> Column:
    """floor(scale * x) for each component, kept where sums of products fit 64 bits; 0 beyond the vector's end."""
    most = 1 << min(30, (62 - max(1, dims - 1).bit_length()) // 2)
    at = F.transform(vector, lambda x: F.greatest(F.least(F.floor(x.cast("double") * scale), F.lit(most)), F.lit(-most)).cast("int"))
    return F.concat(at, F.array_repeat(F.lit(0), F.lit(dims) - F.size(vector)))


def _place(dims: int, low: np.ndarray, high: np.ndarray):
    span = np.maximum(high - low, 1e-9)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column("q").flatten().to_numpy()
            grid = np.clip((flat.reshape(-1, dims) - low) / span * (1 << HILBERT_BITS), 0, (1 << HILBERT_BITS) - 1).astype(np.int64)
            yield pa.record_batch(
                [batch.column("id"), batch.column("label"), batch.column("anchor"), batch.column("q"), pa.array(hilbert_keys(grid), pa.binary())],
                names=["id", "label", "anchor", "q", "spot"],
            )

    return run


_BLOCK = "part int, block long, ids binary, labels binary, anchors binary, vectors binary, low binary, high binary, first_label long, last_label long"


def _cut_blocks(dims: int):
    """Blocks of neighbours; rows that are the same altogether are one, those in a block are in order of the id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, cut, before = TaskContext.get().partitionId(), [], 0, None

        def block(rows: pa.Table) -> pa.RecordBatch | None:
            nonlocal before, cut
            ids, labels = (rows.column(c).to_numpy() for c in ("id", "label"))
            anchors = rows.column("anchor").to_numpy()
            vectors = rows.column("q").combine_chunks().flatten().to_numpy().reshape(-1, dims)
            # Equal rows stand next to each other, also across the edge of a block.
            new = np.ones(len(ids), dtype=bool)
            if before is not None:
                new[0] = (ids[0], labels[0]) != before[:2] or bool((vectors[0] != before[2]).any())
            new[1:] = (ids[1:] != ids[:-1]) | (labels[1:] != labels[:-1]) | (vectors[1:] != vectors[:-1]).any(1)
            before = (ids[-1], labels[-1], vectors[-1].copy())
            order = np.flatnonzero(new)
            order = order[np.lexsort((labels[order], ids[order]))]
            if not len(order):
                return None
            vectors = vectors[order].astype(np.int32)
            cut += 1
            bytes_ = [x.tobytes() for x in (ids[order], labels[order], anchors[order].astype(np.int8), vectors, vectors.min(0), vectors.max(0))]
            return pa.record_batch(
                [pa.array([part], pa.int32()), pa.array([(part << 32) + cut], pa.int64())]
                + [pa.array([x], pa.binary()) for x in bytes_]
                + [pa.array([int(labels[order].min())], pa.int64()), pa.array([int(labels[order].max())], pa.int64())],
                names=[c.split()[0] for c in _BLOCK.split(", ")],
            )

        for batch in batches:
            held.append(batch)
            while sum(b.num_rows for b in held) >= BLOCK_ROWS:
                table = pa.Table.from_batches(held)
                if (out := block(table.slice(0, BLOCK_ROWS))) is not None:
                    yield out
                held = table.slice(BLOCK_ROWS).to_batches()
        if sum(b.num_rows for b in held):
            if (out := block(pa.Table.from_batches(held))) is not None:
                yield out

    return run


def write_blocks(rows: DataFrame, dims: int, ranges: list[tuple[float, float]], n_rows: int) -> tuple[DataFrame, str]:
    """The blocks of ``rows`` (id, label, anchor, q) as a written table, one folder for each part of the curve."""
    spark = rows.sparkSession
    low, high = (np.array(x) for x in zip(*ranges))
    parts = max(1, -(-n_rows * dims * 4 // PART_BYTES))
    blocks = (
        rows.mapInArrow(_place(dims, low, high), "id long, label long, anchor boolean, q array<int>, spot binary")
        .repartitionByRange(parts, "spot", "id", "label").sortWithinPartitions("spot", "id", "label", "q")
        .drop("spot").mapInArrow(_cut_blocks(dims), _BLOCK)
    )
    path = scratch_path(spark, "blocks")
    blocks.write.partitionBy("part").parquet(path)
    schema = ", ".join([c for c in _BLOCK.split(", ") if c != "part int"] + ["part int"])
    return spark.read.schema(schema).parquet(path), path


_TILE = "tile long, ids binary, labels binary, vectors binary, marks binary, tops binary"
_ANCHOR = "tile long, part int, block long, anchor_id long, anchor_row long, label long, vector binary, win int, mark long, top long"


def _anchors(dims: int, positives: int):
    """Anchors with their block, and the score that a positive must reach by what that block holds.

    A tile is named after the block that begins it, so its anchors are neighbours.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, size = 0, TILE_ANCHORS
        names = [c.split()[0] for c in _ANCHOR.split(", ")]
        for batch in batches:
            for row in batch.to_pylist():
                ids, labels, vectors = _longs(row["ids"]), _longs(row["labels"]), _unpack(row["vectors"], dims)
                mine = np.flatnonzero(np.frombuffer(row["anchors"], np.int8))
                for a in range(0, len(mine), TILE_ANCHORS):
                    some = mine[a : a + TILE_ANCHORS]
                    if size + len(some) > TILE_ANCHORS:
                        tile, size = row["block"] * (BLOCK_ROWS // TILE_ANCHORS + 1) + a // TILE_ANCHORS, 0
                    size += len(some)
                    scores = product(vectors[some], vectors)
                    scores[(labels[some][:, None] != labels[None, :]) | (ids[some][:, None] == ids[None, :])] = _NEVER
                    best = np.sort(scores, axis=1)[:, ::-1]
                    marks = best[:, positives - 1] if best.shape[1] >= positives else np.full(len(some), _NEVER)
                    n = len(some)
                    yield pa.record_batch([
                        pa.array(np.full(n, tile)), pa.array(np.full(n, row["part"], np.int32)), pa.array(np.full(n, row["block"])), pa.array(ids[some]),
                        pa.array([row_hash(int(labels[i]), vectors[i]) for i in some], pa.int64()), pa.array(labels[some]),
                        pa.array([vectors[i].astype(np.int32).tobytes() for i in some], pa.binary()), pa.array(np.zeros(n, np.int32)),
                        pa.array(marks), pa.array(np.full(n, np.iinfo(np.int64).max)),
                    ], names=names)

    return run


def _packed(key: str, windows: int):
    """The anchors of a tile (or of a block, which is then their tile), each once with all its windows, as one row."""

    def run(table: pa.Table) -> pa.Table:
        seen: dict[tuple[int, int], int] = {}
        marks, tops, ids, labels, vectors = [], [], [], [], []
        for r in table.to_pylist():
            who = r["anchor_id"], r["anchor_row"]
            if who not in seen:
                seen[who] = len(ids)
                ids.append(r["anchor_id"]), labels.append(r["label"]), vectors.append(r["vector"])
                marks.append([1] * windows), tops.append([0] * windows)
            marks[seen[who]][r["win"]], tops[seen[who]][r["win"]] = r["mark"], r["top"]
        values = [np.array(ids, np.int64).tobytes(), np.array(labels, np.int64).tobytes(), b"".join(vectors)]
        values += [np.array(x, np.int64).tobytes() for x in (marks, tops)]
        columns = [table.column(key).slice(0, 1)] + [pa.array([v], pa.binary()) for v in values]
        return pa.table(columns, names=[c.split()[0] for c in _TILE.split(", ")])

    return run


_PAGE = "page long, parts binary, blocks binary, low binary, high binary, first_label binary, last_label binary"


def _pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The zones of some hundred blocks as one row."""
    part, made, held = TaskContext.get().partitionId(), 0, []

    def page() -> pa.RecordBatch:
        nonlocal made, held
        made += 1
        pick = lambda c: [r[c] for r in held]
        values = [np.array(pick("part"), np.int64).tobytes(), np.array(pick("block"), np.int64).tobytes(), b"".join(pick("low")), b"".join(pick("high"))]
        values += [np.array(pick(c), np.int64).tobytes() for c in ("first_label", "last_label")]
        held = []
        return pa.record_batch([pa.array([(part << 32) + made], pa.int64())] + [pa.array([v], pa.binary()) for v in values], names=[c.split()[0] for c in _PAGE.split(", ")])

    for batch in batches:
        for row in batch.to_pylist():
            held.append(row)
            if len(held) == PAGE_BLOCKS:
                yield page()
    if held:
        yield page()


_TASK = "part int, block long, tile long, who binary"


def _choose(dims: int, same_label: bool):
    """For each tile and page: the blocks to read, each with a bit for every anchor: whether it needs the block.

    An anchor needs a block if a row there may score from its mark up to its top; the
    marks and tops of an anchor are one for its positives, one for each window for its
    negatives (a window that cannot be met has its mark above its top).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                vectors, ids, labels = _unpack(row["vectors"], dims), _longs(row["ids"]), _longs(row["labels"])
                marks, tops = (_longs(row[c]).reshape(len(ids), -1) for c in ("marks", "tops"))
                parts, blocks, first, last = (_longs(row[c]) for c in ("parts", "blocks", "first_label", "last_label"))
                least, most = inner_bounds(vectors, _unpack(row["low"], dims), _unpack(row["high"], dims))
                need = np.zeros(least.shape, dtype=bool)
                for w in range(marks.shape[1]):
                    need |= (most >= marks[:, w : w + 1]) & (least <= tops[:, w : w + 1]) & (marks[:, w] <= tops[:, w])[:, None]
                if same_label:
                    need &= (labels[:, None] >= first) & (labels[:, None] <= last)
                else:
                    need &= (labels[:, None] != first) | (first != last)
                some = np.flatnonzero(need.any(0))
                if len(some):
                    who = np.packbits(need[:, some], axis=0).T
                    columns = [pa.array(parts[some].astype(np.int32)), pa.array(blocks[some]), pa.array(np.full(len(some), row["tile"]))]
                    yield pa.record_batch([*columns, pa.array([w.tobytes() for w in who], pa.binary())], names=[c.split()[0] for c in _TASK.split(", ")])

    return run


_FOUND = "anchor_id long, anchor_row long, win int, id long, score long"


def _score(dims: int, keep: int, same_label: bool):
    """The first ``keep`` rows of each anchor and window of a crowd of tiles among a run of blocks.

    An anchor is named by its id and a hash of its label and vector, as rows may share an id.
    """

    def best(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows (anchor, window, id, score): the first of each anchor and window, by score, then id; which are the last that fit."""
        rows = rows[np.lexsort((rows[:, 2], -rows[:, 3], rows[:, 1], rows[:, 0]))]
        edge = np.flatnonzero(np.concatenate(([True], (rows[1:, :2] != rows[:-1, :2]).any(1))))
        place = np.arange(len(rows)) - np.repeat(edge, np.diff(np.append(edge, len(rows))))
        return rows[place < keep], (place == keep - 1)[place < keep]

    def tile_rows(row: dict, there: dict[int, tuple[np.ndarray, ...]]) -> list[np.ndarray]:
        ids, labels, vectors = _longs(row["ids"]), _longs(row["labels"]), _unpack(row["vectors"], dims)
        marks, tops = (_longs(row[c]).reshape(len(ids), -1).copy() for c in ("marks", "tops"))
        held, kept, n_held = [np.zeros((0, 4), np.int64)], 0, 0
        for ask in row["asks"]:
            block_ids, block_labels, block_vectors = there[ask["block"]]
            some = np.flatnonzero(np.unpackbits(np.frombuffer(ask["who"], np.uint8), count=len(ids)))
            scores = product(vectors[some], block_vectors)
            open_ = marks[some] <= tops[some]
            low = np.where(open_, marks[some], np.iinfo(np.int64).max).min(1)
            high = np.where(open_, tops[some], _NEVER).max(1)
            same = labels[some][:, None] == block_labels
            i, j = np.nonzero((scores >= low[:, None]) & (scores <= high[:, None]) & (same if same_label else ~same))
            if same_label:
                other = ids[some[i]] != block_ids[j]
                i, j = i[other], j[other]
            anchor, value = some[i], scores[i, j]
            for w in range(marks.shape[1]):
                ok = np.flatnonzero((value >= marks[anchor, w]) & (value <= tops[anchor, w]))
                held.append(np.stack([anchor[ok], np.full(len(ok), w), block_ids[j[ok]], value[ok]], axis=1))
                n_held += len(ok)
            if n_held > 2 * kept + HELD_ROWS:
                rows, last = best(np.concatenate(held))
                marks[rows[last, 0], rows[last, 1]] = rows[last, 3]  # a later row must reach the last one kept
                held, kept, n_held = [rows], len(rows), len(rows)
        rows, _ = best(np.concatenate(held))
        named = np.unique(rows[:, 0])
        who = np.zeros(len(ids), np.int64)
        who[named] = [row_hash(int(labels[i]), vectors[i]) for i in named]
        return [ids[rows[:, 0]], who[rows[:, 0]], rows[:, 1], rows[:, 2], rows[:, 3]]

    def run(tiles: pa.Table, blocks: pa.Table) -> pa.Table:
        there = {r["block"]: (_longs(r["ids"]), _longs(r["labels"]), _unpack(r["vectors"], dims)) for r in blocks.to_pylist()} if tiles.num_rows else {}
        found = [tile_rows(row.as_py(), there) for batch in tiles.to_batches() for row in batch.to_struct_array()]
        columns = [np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(5)]
        columns[2] = columns[2].astype(np.int32)
        return pa.table([pa.array(c) for c in columns], names=[c.split()[0] for c in _FOUND.split(", ")])

    return run


def row_hash(label: int, vector: np.ndarray) -> int:
    import zlib

    data = vector.astype(np.int32).tobytes()
    return (zlib.crc32(data, label & 0xFFFFFFFF) << 31) ^ zlib.adler32(data[::-1], 1)


def _runs(blocks: DataFrame, dims: int, n_rows: int) -> Column:
    """The run of a row's part and block: blocks one after the other of about RUN_BYTES, whatever the size of the parts."""
    n_parts = (blocks.agg(F.max("part")).first()[0] or 0) + 1
    n_runs, in_part = max(1, -(-n_rows * dims * 4 // RUN_BYTES)), max(1, -(-n_rows // (n_parts * BLOCK_ROWS)))
    # Blocks of a part are numbered from 1.
    at = F.least(F.col("block").bitwiseAND(F.lit((1 << 32) - 1)) - 1, F.lit(in_part - 1))
    return F.call_function("div", (F.col("part").cast("long") * in_part + at) * n_runs, F.lit(n_parts * in_part)).cast("int").alias("run")


def _read_for(tasks: DataFrame, tiles: DataFrame, blocks: DataFrame, run: Column, dims: int, keep: int, same_label: bool) -> DataFrame:
    """Rank rows in the chosen blocks: anchor_id, anchor_row, win, id, score, place.

    Bits and vectors are not broadcast: what repeats is written in a few bytes, by which
    Spark would take it to be small.
    """
    tasks = write_scratch(tasks, "chosen")
    parts = [r[0] for r in tasks.select("part").distinct().limit(NAMED_PARTS + 1).collect()]
    if len(parts) <= NAMED_PARTS:  # folders of parts that nobody needs are not listed for reading
        blocks = blocks.where(F.col("part").isin(parts)) if parts else blocks.where("false")
    # Tiles go in crowds by their order, as neighbours need the same blocks.
    size = max(1, CROWD_BYTES // (TILE_ANCHORS * dims * 4))
    crowds = tiles.select("tile", F.floor((F.row_number().over(Window.orderBy("tile")) - 1) / size).cast("int").alias("crowd"))
    asks = tasks.join(crowds.hint("merge"), "tile").groupBy(run, "crowd", "tile").agg(
        F.sort_array(F.collect_list(F.struct("block", "who"))).alias("asks"))
    asks = write_scratch(asks, "asks")
    crowd = asks.join(tiles.hint("merge"), "tile").drop("tile")
    # Some numbers a row, so it may be broadcast, which spares the blocks a move.
    wanted = write_scratch(asks.select("run", "crowd", F.explode("asks.block").alias("block")).distinct(), "wanted")
    there = blocks.select("block", "ids", "labels", "vectors").join(wanted, "block")
    key = "run", "crowd"
    found = crowd.groupBy(*key).cogroup(there.groupBy(*key)).applyInArrow(_score(dims, keep, same_label), _FOUND)
    order = Window.partitionBy("anchor_id", "anchor_row", "win").orderBy(F.col("score").desc(), "id")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= keep)


def hard_negatives(
    rows: DataFrame, anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", *,
    scale: int = 256, positives: int = 5, negatives: int = 10, floor_pct: int = 30, ceil_pct: int = 90, base_pct: int = 100,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: the hard negatives of anchors.

    A component x counts as floor(scale * x) and a score is an inner product of such
    vectors.  An anchor (a row for which ``anchor`` holds) has the first ``positives`` other
    rows of its label as positives; for each of them, the negatives are the first
    ``negatives`` rows of another label with floor_pct * p <= base_pct * score <= ceil_pct * p,
    p being the positive's score.  Higher scores come first, then smaller ids.

    Rows with a null id, label or vector, or a null or non-finite component take no part.
    Shorter vectors count as followed by zeros; components are held within what keeps sums
    of products below 2**62.  Rows that agree in id, label and scaled vector are one; rows
    that share only the id are rows of their own, but no positives of each other.  Columns
    of other names are not read; an empty table gives no rows.
    """
    vector = F.col(vector_col)
    usable = F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & vector.isNotNull()
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    some = rows.where(usable & F.coalesce(fine, F.lit(False))).select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), vector.alias("v")
    )
    spark, empty = rows.sparkSession, "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    size = some.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dims")).first()
    if not size.n:
        return spark.createDataFrame([], empty)
    dims = max(1, size.dims)
    whole = some.select("id", "label", "anchor", _whole(F.col("v"), dims, scale).alias("q"))
    # One number pair for each dimension reaches the driver.
    seen = {r["d"]: (float(r["a"]), float(r["b"])) for r in whole.select(F.posexplode("q").alias("d", "x")).groupBy("d").agg(F.min("x").alias("a"), F.max("x").alias("b")).collect()}
    blocks, _ = write_blocks(whole, dims, [seen[d] for d in range(dims)], size.n)
    run = _runs(blocks, dims, size.n)
    pages = write_scratch(blocks.select("part", "block", "low", "high", "first_label", "last_label").mapInArrow(_pages, _PAGE), "pages")
    numbered = write_scratch(pages.withColumn("at", F.row_number().over(Window.orderBy("page")) - 1), "pages")
    n_pages = numbered.count()
    anchors = write_scratch(blocks.select("part", "block", "ids", "labels", "anchors", "vectors").mapInArrow(_anchors(dims, positives), _ANCHOR), "anchors")

    def packed(of: DataFrame, key: str, windows: int) -> DataFrame:
        return write_scratch(of.groupBy(key).applyInArrow(_packed(key, windows), _TILE), "tiles")

    def choose(tiles: DataFrame, same_label: bool) -> DataFrame:
        dealt = tiles.withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(n_pages - 1))))
        return dealt.join(numbered.hint("merge"), "at").drop("at", "page").mapInArrow(_choose(dims, same_label), _TASK)

    tiles = packed(anchors, "tile", 1)
    best = write_scratch(_read_for(choose(tiles, True), tiles, blocks, run, dims, positives, True), "positives")
    percent = lambda pct: F.lit(pct) * F.col("score")
    wanted = write_scratch(
        anchors.drop("win", "mark", "top").join(best, ["anchor_id", "anchor_row"]).where("score >= 0").select(
            "tile", "part", "block", "anchor_id", "anchor_row", "label", "vector", (F.col("place") - 1).alias("win"),
            (-F.call_function("div", -percent(floor_pct), F.lit(base_pct))).alias("mark"), F.call_function("div", percent(ceil_pct), F.lit(base_pct)).alias("top"),
        ),
        "windows",
    )
    # What the own block holds of each window first: the last of that is the mark for other blocks.
    own = packed(wanted, "block", positives)
    every = own.select((F.shiftright("tile", 32)).cast("int").alias("part"), F.col("tile").alias("block"), "tile", F.unhex(F.repeat(F.lit("FF"), F.ceil(F.octet_length("ids") / 64).cast("int"))).alias("who"))
    near = write_scratch(_read_for(every, own, blocks, run, dims, negatives, False), "near")
    known = near.where(F.col("place") == negatives).select("anchor_id", "anchor_row", "win", F.col("score").alias("known"))
    raised = wanted.join(known, ["anchor_id", "anchor_row", "win"], "left").withColumn("mark", F.greatest("mark", "known")).drop("known")
    tiles = packed(raised, "tile", positives)
    found = _read_for(choose(tiles, False), tiles, blocks, run, dims, negatives, False)
    positive = best.select("anchor_id", "anchor_row", (F.col("place") - 1).alias("win"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return found.join(positive, ["anchor_id", "anchor_row", "win"]).select(
        "anchor_id", "positive_id", F.col("place").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"),
    )
