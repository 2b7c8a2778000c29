"""N-gram Jaccard join: documents whose word-shingle sets overlap by a share or more.

Method: size-banded tiles with hashed bitmap signatures.

1. One pass over the texts sends every shingle (32 bits of its hash) once per
   block of texts to its range of hash values; there it is seen which shingles
   occur in one document only.  A document in which more than 1 - t of the
   shingles are its own has no partner, so only the rest goes on.
2. Of those, each document posts its rarest (1 - t) n + 1 shingles, enough for
   any two linked documents to meet.  A tile holds the documents of one posted
   shingle and size band; neighbouring bands meet too, as linked sizes differ by
   a factor t at most.
3. In a tile all compare with its leader first, then each with the nearest
   document of another component, as links join documents to components.  Then all
   pairs of different components that are left are compared.  Large tiles are
   compared in square blocks, and none is left out.
4. A pair is compared by its 512-bit parity signatures first: the bits in which
   they differ bound the sets' difference from below, so the overlap from above.
   Sets of more shingles than that have signatures as wide as they are large
   besides (a power of two), since the bits of a narrow one agree by chance.
   Only what may still link is intersected exactly, over the sorted arrays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import (
    chunks, list_array, mix, shuffle_parts, text_bytes, word_shingle_sets, write_scratch,
)
from .components import components

SIZE, PERCENT = 5, 75
#: Documents of a tile that are compared with each other in one task.
BLOCK = 1024
SIGNATURE = 8
_MANY = 0xFFFF


def _set_keys(h: np.ndarray, doc: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size and two order-free 64-bit sums of each document's set."""
    n = np.bincount(doc, minlength=n_docs)
    edge = np.concatenate(([0], np.cumsum(n)))
    sums = []
    for salt in (0x243F6A8885A308D3, 0x13198A2E03707344):
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(h ^ np.uint64(salt)))))
        sums.append((total[edge[1:]] - total[edge[:-1]]).view(np.int64))
    return n, sums[0], sums[1]


_SPREAD = "p int, batch binary, n_docs int, h binary, doc binary, ids array<long>, n array<int>, k1 array<long>, k2 array<long>, sure binary"


def _spread(parts: int, size: int):
    schema = pa.schema([
        ("p", pa.int32()), ("batch", pa.binary()), ("n_docs", pa.int32()), ("h", pa.binary()), ("doc", pa.binary()),
        ("ids", pa.list_(pa.int64())), ("n", pa.list_(pa.int32())), ("k1", pa.list_(pa.int64())),
        ("k2", pa.list_(pa.int64())), ("sure", pa.binary()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            all_ids = batch.column(0).cast(pa.int64())
            data, offsets = text_bytes(batch.column(1))
            for a, b in chunks(offsets):
                at = offsets[a : b + 1] - offsets[a]
                h, doc = word_shingle_sets(data[offsets[a] : offsets[b]], at, size)
                n, k1, k2 = _set_keys(h, doc, b - a)
                ids = all_ids.slice(a, b - a)
                # Equal sets of a block speak once, and so does a shingle of several sets.
                _, lead = np.unique(np.stack((k1, k2), 1), axis=0, return_index=True)
                speaks = np.zeros(b - a, dtype=bool)
                speaks[lead] = True
                own = speaks[doc]
                short, who = (h[own] >> np.uint64(32)).astype(np.uint32), doc[own]
                order = np.argsort(short, kind="stable")
                short, who = short[order], who[order]
                first = np.ones(len(short), dtype=bool)
                first[1:] = short[1:] != short[:-1]
                begin = np.flatnonzero(first)
                length = np.diff(np.append(begin, len(short)))
                several = np.repeat(length > 1, length)
                sure = np.bincount(who[several], minlength=b - a).astype(np.uint32)
                keep = ~several | first
                short, who = short[keep], np.where(several[keep], _MANY, who[keep]).astype(np.uint16)
                name = hashlib.blake2b(
                    k1.tobytes() + k2.tobytes() + ids.fill_null(-1).to_numpy(zero_copy_only=False).tobytes(), digest_size=16
                ).digest()
                edges = np.searchsorted(short, (np.arange(1, parts) * ((1 << 32) / parts)).astype(np.uint32))
                edges = np.concatenate(([0], edges, [len(short)]))
                home = int.from_bytes(name[:4], "little") % parts
                # Other blocks' copies of a silent set: it takes over what its speaker gets.
                for p in range(parts):
                    x, y = edges[p], edges[p + 1]
                    if x == y and p != home:
                        continue
                    here = p == home
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([p], pa.int32()), pa.array([name], pa.binary()), pa.array([b - a], pa.int32()),
                            pa.array([short[x:y].astype("<u4").tobytes()], pa.binary()),
                            pa.array([who[x:y].astype("<u2").tobytes()], pa.binary()),
                            pa.array([ids.to_pylist() if here else None], pa.list_(pa.int64())),
                            pa.array([n.tolist() if here else None], pa.list_(pa.int32())),
                            pa.array([k1.tolist() if here else None], pa.list_(pa.int64())),
                            pa.array([k2.tolist() if here else None], pa.list_(pa.int64())),
                            pa.array([sure.tobytes() if here else None], pa.binary()),
                        ],
                        schema=schema,
                    )

    return run


_SEEN = "batch binary, n_docs int, shared binary, ids array<long>, n array<int>, k1 array<long>, k2 array<long>"


def _seen(table: pa.Table) -> pa.Table:
    """For one range of hash values: how many shingles of each document others have too."""
    h = [np.frombuffer(x, "<u4") for x in table.column("h").to_pylist()]
    row = np.repeat(np.arange(len(h)), [len(x) for x in h])
    doc = np.frombuffer(b"".join(table.column("doc").to_pylist()), "<u2")
    h = np.concatenate(h) if h else np.zeros(0, np.uint32)
    order = np.argsort(h, kind="stable")
    h, row, doc = h[order], row[order], doc[order]
    begin = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.zeros(0, int)
    length = np.diff(np.append(begin, len(h)))
    more = np.repeat(length > 1, length) & (doc != _MANY)
    row, doc = row[more], doc[more]
    n_docs = table.column("n_docs").to_numpy()
    base = np.concatenate(([0], np.cumsum(n_docs)))
    counts = np.bincount(base[row] + doc, minlength=base[-1]).astype("<u4")
    sure = table.column("sure").to_pylist()
    shared = []
    for i in range(len(n_docs)):
        mine = counts[base[i] : base[i + 1]]
        if sure[i] is not None:
            mine = mine + np.frombuffer(sure[i], "<u4")
        shared.append(mine.astype("<u4").tobytes())
    return pa.table({
        "batch": table.column("batch"), "n_docs": table.column("n_docs"), "shared": pa.array(shared, pa.binary()),
        **{c: table.column(c) for c in ("ids", "n", "k1", "k2")},
    })


_DOCS = "doc_id long, n int, k1 long, k2 long, shared long"


def _add_up(table: pa.Table) -> pa.Table:
    """The counts of one block of texts over all ranges, one row per document."""
    total = np.zeros(table.column("n_docs")[0].as_py(), np.int64)
    for x in table.column("shared").to_pylist():
        total += np.frombuffer(x, "<u4")
    home = next(i for i, x in enumerate(table.column("ids").to_pylist()) if x is not None)
    get = lambda c: table.column(c)[home].values
    return pa.table({
        "doc_id": get("ids"), "n": get("n"), "k1": get("k1"), "k2": get("k2"), "shared": pa.array(total),
    })


def shingle_profile(docs: DataFrame, id_col: str, text_col: str, size: int = SIZE) -> DataFrame:
    """Per document: set size n, set key (k1, k2) and an upper bound of its shared shingles.

    Documents with equal sets have equal keys.  ``shared`` counts shingles that
    some other set may hold too; within a block of texts only one of several
    equal sets is counted, the others may show 0.
    """
    parts = max(2, shuffle_parts(docs.sparkSession))
    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return (
        narrow.mapInArrow(_spread(parts, size), _SPREAD)
        .groupBy("p").applyInArrow(_seen, _SEEN)
        .groupBy("batch").applyInArrow(_add_up, _DOCS)
    )


_SETS = "k1 long, k2 long, n int, arr array<long>, wide binary, " + ", ".join(f"s{i} long" for i in range(SIGNATURE))


def _wide_signature(hashes: np.ndarray) -> bytes:
    """Parity bits of a set's hashes, at least as many as there are hashes; its halves' XOR is the next narrower one."""
    width = 1 << max(0, len(hashes) - 1).bit_length()
    parity = np.bincount((hashes & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(parity.astype(np.uint8)).tobytes()


class _WideSignatures:
    """The wide signatures of a block by width, each also folded to the next narrower one."""

    def __init__(self, wide: list[bytes | None]):
        self.width = np.array([0 if x is None else len(x) for x in wide])
        self.at: dict[int, np.ndarray] = {}
        self.bits: dict[int, np.ndarray] = {}
        for w in {int(x) for x in self.width if x} | {int(x) // 2 for x in self.width if x}:
            rows = np.flatnonzero((self.width == w) | (self.width == 2 * w))
            self.at[w] = np.full(len(wide), -1)
            self.at[w][rows] = np.arange(len(rows))
            out = np.empty((len(rows), w), np.uint8)
            for k, i in enumerate(rows):
                x = np.frombuffer(wide[i], np.uint8)
                out[k] = x if len(x) == w else x[:w] ^ x[w:]
            self.bits[w] = out.view(np.uint64)

    def sharpen(self, i: int, other: np.ndarray, differ: np.ndarray) -> None:
        """Raise the numbers of differing bits of row ``i`` and others where both have wide signatures."""
        own = int(self.width[i])
        if not own:
            return
        widths = self.width[other]
        for w, fit in ((own, (widths == own) | (widths == 2 * own)), (own // 2, widths == own // 2)):
            if fit.any():
                bits, at = self.bits[w], self.at[w]
                sharp = np.bitwise_count(bits[at[other[fit]]] ^ bits[at[i]]).sum(1).astype(np.int64)
                differ[fit] = np.maximum(differ[fit], sharp)


def _sets(size: int):
    """Sorted shingle arrays and parity signatures of the documents that were asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(0))
            for a, b in chunks(offsets):
                h, doc = word_shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], size)
                n, k1, k2 = _set_keys(h, doc, b - a)
                bit = (h & np.uint64(511)).astype(np.int64)
                parity = (np.bincount(doc * 512 + bit, minlength=(b - a) * 512) & 1).astype(np.uint8)
                sig = np.packbits(parity.reshape(b - a, 512), axis=1).view(">i8").astype(np.int64)
                signed = h.view(np.int64)
                order = np.lexsort((signed, doc))
                edge = np.concatenate(([0], np.cumsum(n)))
                wide = [_wide_signature(h[edge[i] : edge[i + 1]]) if n[i] > 64 * SIGNATURE else None for i in range(b - a)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(k1), pa.array(k2), pa.array(n.astype(np.int32)), list_array(signed[order], n), pa.array(wide, pa.binary()),
                        *[pa.array(np.ascontiguousarray(sig[:, i])) for i in range(SIGNATURE)],
                    ],
                    names=["k1", "k2", "n", "arr", "wide", *[f"s{i}" for i in range(SIGNATURE)]],
                )

    return run


def _overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact size of the intersection of two sorted arrays, row by row."""
    for batch in batches:
        x, y = batch.column(2), batch.column(3)
        xv, xo = x.values.to_numpy(), x.offsets.to_numpy()
        yv, yo = y.values.to_numpy(), y.offsets.to_numpy()
        out = np.zeros(batch.num_rows, np.int64)
        for i in range(batch.num_rows):
            a, b = xv[xo[i] : xo[i + 1]], yv[yo[i] : yo[i + 1]]
            at = np.searchsorted(b, a)
            at[at == len(b)] = 0
            out[i] = np.count_nonzero(b[at] == a)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out)], names=["a", "b", "both"])


def _may_link(percent: int) -> Column:
    """Upper bound of the overlap from the signatures (columns of two sides, suffix _b)."""
    differ = sum((F.bit_count(F.col(f"s{i}").bitwiseXOR(F.col(f"s{i}_b"))) for i in range(SIGNATURE)), F.lit(0))
    total = F.col("n") + F.col("n_b")
    return (100 + percent) * (total - differ) >= 2 * percent * total


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links among the pairs (a, b): signature bound first, then the exact intersection."""
    slim = sets.select("sid", "n", *[f"s{i}" for i in range(SIGNATURE)])
    right = slim.select(F.col("sid").alias("b"), *[F.col(c).alias(f"{c}_b") for c in slim.columns[1:]])
    left = slim.withColumnRenamed("sid", "a")
    near = pairs.join(left, "a").join(right, "b").where(_may_link(percent)).select("a", "b", "n", "n_b")
    arrays = sets.select(F.col("sid").alias("a"), F.col("arr").alias("x"))
    exact = (
        near.select("a", "b")
        .join(arrays, "a")
        .join(arrays.select(F.col("a").alias("b"), F.col("x").alias("y")), "b")
        .select("a", "b", "x", "y")
        .mapInArrow(_overlap, "a long, b long, both long")
    )
    sizes = sets.select(F.col("sid").alias("a"), "n")
    return (
        exact.join(sizes, "a").join(sizes.select(F.col("a").alias("b"), F.col("n").alias("n_b")), "b")
        .where((100 + percent) * F.col("both") >= percent * (F.col("n") + F.col("n_b")))
        .select("a", "b")
    )


def _postings(sets: DataFrame, percent: int) -> DataFrame:
    """The rarest shingles of each set, as many as two linked sets need to meet."""
    rows = sets.select("sid", "n", F.explode("arr").alias("h"))
    df = rows.groupBy("h").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    ranked = (
        rows.join(df, "h").groupBy("sid", "n")
        .agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("known"))
    )
    # n - ceil(t n) + 1 shingles; those that only this set has come first and post nothing.
    prefix = F.col("n") - F.ceil(F.col("n") * percent / F.lit(100)).cast("int") + 1
    take = prefix - (F.col("n") - F.size("known"))
    return ranked.where(take > 0).select(
        "sid", "n", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent))).cast("int").alias("band"),
        F.explode(F.slice("known", F.lit(1), take)).alias("k"),
    ).select("sid", "n", "band", F.col("k.h").alias("h"))


def _sizes_fit(percent: int) -> Column:
    return (F.least("n", "n_b") * 100) >= (F.greatest("n", "n_b") * percent)


def _leader_pairs(postings: DataFrame, percent: int) -> DataFrame:
    """Every posting with the leader of its tile and of the neighbouring size bands' tiles."""
    leaders = postings.groupBy("h", "band").agg(
        F.min_by(F.struct("sid", "n"), F.xxhash64("sid")).alias("lead")
    )
    near = leaders.select("h", F.explode(F.array(*[F.col("band") + d for d in (-1, 0, 1)])).alias("band"),
                          F.col("lead.sid").alias("b"), F.col("lead.n").alias("n_b"))
    return (
        postings.join(near, ["h", "band"]).where(_sizes_fit(percent) & (F.col("sid") != F.col("b")))
        .select(F.least("sid", "b").alias("a"), F.greatest("sid", "b").alias("b")).distinct()
    )


_TILE = "a long, b long"


def _tile_pairs(percent: int, nearest: bool):
    """Pairs of different components within a block pair that the signatures let pass.

    With ``nearest`` each document names only the one that its signature is nearest to.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = [], []
            for rows in batch.column("rows"):
                part = rows.values
                f = lambda c: part.field(c).to_numpy()
                sid, n, root, side = f("sid"), f("n").astype(np.int64), f("root"), f("side")
                sig = np.stack([f(f"s{i}") for i in range(SIGNATURE)], 1).view(np.uint64)
                one, two = np.flatnonzero(side & 1), np.flatnonzero(side & 2)
                wide = _WideSignatures(part.field("wide").to_pylist())
                for i in one:
                    other = two[(root[two] != root[i]) & (sid[two] != sid[i])]
                    small, large = np.minimum(n[other], n[i]), np.maximum(n[other], n[i])
                    other = other[small * 100 >= large * percent]
                    differ = np.bitwise_count(sig[other] ^ sig[i]).sum(1).astype(np.int64)
                    total = n[other] + n[i]
                    if wide.width[i]:
                        near = np.flatnonzero((100 + percent) * (total - differ) >= 2 * percent * total)
                        other, differ, total = other[near], differ[near], total[near]
                        wide.sharpen(i, other, differ)
                    passes = (100 + percent) * (total - differ) >= 2 * percent * total
                    if nearest and passes.any():
                        passes = np.flatnonzero(passes)
                        passes = passes[[(differ[passes] / total[passes]).argmin()]]
                    other = other[passes]
                    left.append(np.minimum(sid[other], sid[i]))
                    right.append(np.maximum(sid[other], sid[i]))
            a = np.concatenate(left) if left else np.zeros(0, np.int64)
            b = np.concatenate(right) if right else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return run


def _cross_pairs(postings: DataFrame, sets: DataFrame, roots: DataFrame, percent: int, nearest: bool) -> DataFrame:
    """All pairs (or the nearest of each document) of a posted shingle that lie in different components, in square blocks."""
    known = postings.join(roots, postings.sid == roots.node, "left").select(
        "h", "sid", F.coalesce("root", "sid").alias("root")
    )
    mixed = known.groupBy("h").agg(
        F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("members")
    ).where("lo < hi").select("h", F.ceil(F.col("members") / BLOCK).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int")
    # Block i meets every block j >= i: a row goes to (i, own) and (own, j).
    placed = known.join(mixed, "h").withColumn("own", own).select(
        "h", "sid", "root", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with")
    ).select(
        "h", "sid", "root", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"),
        F.when(F.col("own") == F.col("with"), 3).when(F.col("own") < F.col("with"), 1).otherwise(2).alias("side"),
    )
    slim = sets.select("sid", "n", "wide", *[f"s{i}" for i in range(SIGNATURE)])
    return (
        placed.join(slim, "sid").groupBy("h", "i", "j")
        .agg(F.collect_list(F.struct("sid", "n", "root", "side", "wide", *[f"s{i}" for i in range(SIGNATURE)])).alias("rows"))
        .select("rows").mapInArrow(_tile_pairs(percent, nearest), _TILE).distinct()
    )


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, percent: int = PERCENT, rounds: int = 2
) -> DataFrame:
    """One row per document: (doc_id, n_shingles, component_id).

    Two documents are linked when ``100 * common >= percent * union`` over their
    distinct ``size``-word shingles; component_id is the smallest id reachable by
    links.  A text with fewer words is one shingle; null, empty or blank texts have
    an empty set and are linked with nothing, so their component is their own id.
    Equal sets are one class throughout and are never paired.  A null id stays
    null and its component is the smallest id of the class's component (null if
    none).  Repeated rows give repeated results.  Ids are cast to long; other
    columns are not read.  ``rounds`` only says how often the nearest documents are
    tried before the exact rest; it does not change the result.
    """
    profile = write_scratch(shingle_profile(docs, id_col, text_col, size), "profile")
    # Every document of a class speaks for it: a silent one in a block has its speaker's count.
    reps = profile.where("n > 0").groupBy("k1", "k2").agg(
        F.max("shared").alias("shared"), F.first("n").alias("n"), F.min("doc_id").alias("doc_id")
    ).where((F.col("shared") * 100 >= F.col("n") * percent))
    reps = write_scratch(reps.select("k1", "k2", "doc_id", F.monotonically_increasing_id().alias("sid")), "reps")
    wanted = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(
        reps.select("doc_id").hint("shuffle_hash"), "doc_id", "left_semi"
    )
    sets = write_scratch(
        wanted.select("text").mapInArrow(_sets(size), _SETS)
        .join(reps.select("k1", "k2", "sid"), ["k1", "k2"]).drop("k1", "k2").dropDuplicates(["sid"]),
        "sets",
    )
    postings = write_scratch(_postings(sets, percent), "postings")
    links = write_scratch(_verified(_leader_pairs(postings, percent), sets, percent), "links")
    roots = components(links)
    for turn in range(rounds + 1):
        pairs = _cross_pairs(postings, sets, roots, percent, nearest=turn < rounds)
        found = write_scratch(_verified(pairs, sets, percent), "links")
        if not found.isEmpty():
            links = links.unionByName(found)
            roots = components(links)
    keyed = reps.select("sid", "k1", "k2")
    lead = keyed.select(F.col("sid").alias("root"), F.col("k1").alias("l1"), F.col("k2").alias("l2"))
    label = keyed.join(roots, keyed.sid == roots.node).join(lead, "root").select("k1", "k2", "l1", "l2")
    named = profile.join(label, ["k1", "k2"], "left").select(
        "doc_id", "n", F.coalesce("l1", "k1").alias("l1"), F.coalesce("l2", "k2").alias("l2")
    )
    smallest = named.where("n > 0").groupBy("l1", "l2").agg(F.min("doc_id").alias("least"))
    return named.join(smallest, ["l1", "l2"], "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"),
    )


def keep_representatives(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, percent: int = PERCENT
) -> DataFrame:
    """``docs`` with one row of each component, that of the smallest id.

    Documents with an empty set (null, empty or blank text) and rows without an id
    stay.  Rows that repeat id and text (with at least a word) count once; rows of
    one id with different texts share the id's fate.  Columns are unchanged,
    whatever their names.
    """
    found = near_duplicates(docs, id_col, text_col, size, percent)
    gone = found.where("n_shingles > 0 AND doc_id <> component_id").select(F.col("doc_id").alias("__id")).distinct()
    kept = docs.join(gone, F.col(id_col).cast("long") == F.col("__id"), "left_anti")
    ids = found.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("__id")).count()
    again = ids.where("count > 1").select("__id")
    if again.isEmpty():
        return kept
    repeated = F.col(id_col).cast("long") == F.col("__id")
    once = kept.join(again, repeated, "left_anti")
    return once.unionByName(kept.join(again, repeated, "left_semi").dropDuplicates([id_col, text_col]))
