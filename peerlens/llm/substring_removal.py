"""Removal of repeated substrings by a sparse distributed suffix sort.

Sorting every suffix would exchange many times the input.  A string of ``length``
bytes always contains the minimum of the hashes of its K-byte windows (K about half
of ``length``); that place, its anchor, is the same in every copy of the string.  So
only suffixes at anchors are looked at, about one in a hundred:

1. One pass over the texts finds the anchors.  The hash of an anchor's window and
   of its context (all strings that it stands for) go to a range of hash values,
   where it is seen which windows occur once (no string of that anchor repeats) and
   which contexts occur again (all of its strings repeat).
2. What is neither goes into the suffix sort: each task sorts its anchors' suffixes
   into a run and sends it front-coded (length of the prefix shared with the one
   before, and the rest) to ranges of suffixes.  A range merges its runs with a
   loser tree that keeps, at each node, how much the loser shares with the winner:
   suffixes that share different lengths are ordered without looking at a byte, and
   equal lengths are compared from there on.
3. The merged order gives the common prefixes of neighbours for nothing.  Within the
   suffixes of one window, the contexts to the left are ordered too, and both orders
   give each anchor the longest match through it that another place also has.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SpanHash, mix, shuffle_parts, text_bytes, write_scratch

LENGTH = 400
#: Starts of strings handled together; positions in a segment fit in 20 bits.
SEGMENT = 1 << 19
#: Bytes of a suffix that choose its range; at most so many sampled ones reach the driver.
SPLIT_BYTES, SPLIT_SAMPLE = 24, 20_000
_BATCH_SAMPLE = 8


def anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """For pieces of the texts: text, anchor, first and last start it stands for, window hash, context hash.

    Positions are offsets in ``data``.
    """
    k = length // 2
    w = length - k + 1
    sizes = np.diff(offsets)
    pieces, first = [], 0
    # Texts are taken together up to a segment; a longer one is cut into overlapping segments.
    for text in range(len(sizes) + 1):
        if text == len(sizes) or offsets[text + 1] - offsets[first] > SEGMENT:
            if text > first:
                pieces.append((first, text, offsets[first], offsets[text]))
            if text < len(sizes) and sizes[text] > SEGMENT:
                for at in range(offsets[text], offsets[text + 1] - length + 1, SEGMENT):
                    pieces.append((text, text + 1, at, min(at + SEGMENT + length - 1, offsets[text + 1])))
                first = text + 1
            else:
                first = text
    for a, b, low, high in pieces:
        n = high - low
        if n < length:
            continue
        part = data[low:high]
        span = SpanHash(part)
        at = np.arange(n - k + 1)
        window = span(at, at + k)
        packed = (window & ~np.uint64((1 << 20) - 1)) | at.astype(np.uint64)
        pad = (-len(packed)) % w
        rows = np.concatenate((packed, np.full(pad, ~np.uint64(0)))).reshape(-1, w)
        ahead = np.minimum.accumulate(rows, axis=1).ravel()
        back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        edges = np.clip(offsets[a : b + 1] - low, 0, n)
        text = np.repeat(np.arange(a, b), np.maximum(np.diff(edges) - length + 1, 0))
        if not len(text):
            continue
        starts = np.concatenate([np.arange(x, y - length + 1) for x, y in zip(edges[:-1], edges[1:]) if y - x >= length])
        least = np.minimum(back[starts], ahead[starts + w - 1])
        new = np.ones(len(starts), dtype=bool)
        new[1:] = (least[1:] != least[:-1]) | (text[1:] != text[:-1])
        begin = np.flatnonzero(new)
        place = (least[begin] & np.uint64((1 << 20) - 1)).astype(np.int64)
        lo, hi = starts[begin], starts[np.append(begin[1:], len(starts)) - 1]
        context = mix(span(lo, hi + length) + (place - lo).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        yield text[begin], place + low, lo + low, hi + low, window[place], context


_SPREAD = "p int, batch binary, n int, w binary, c binary, i binary, twice binary, texts binary, home binary, sample array<binary>"


def _spread(parts: int, length: int):
    names = [c.split()[0] for c in _SPREAD.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_pylist()
            data, offsets = text_bytes(batch.column(1))
            for a in range(0, len(keys), 2048):
                b = min(a + 2048, len(keys))
                found = list(anchors(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], length))
                if not found:
                    continue
                text, place, lo, hi, window, context = (np.concatenate(x) for x in zip(*found))
                base = offsets[a : b + 1] - offsets[a]
                home = np.stack([text, place - base[text], lo - base[text], hi - base[text]], 1).astype("<u4")
                n = len(text)
                # A context that the batch has several times is known to repeat and is sent once.
                order = np.lexsort((context, window))
                w, c = window[order], context[order]
                first = np.ones(n, dtype=bool)
                first[1:] = (w[1:] != w[:-1]) | (c[1:] != c[:-1])
                run_length = np.diff(np.append(np.flatnonzero(first), n))
                lead = order[first]
                twice = np.zeros(n, np.uint8)
                twice[order] = np.repeat(run_length > 1, run_length)
                w, c = window[lead], context[lead]
                texts = b"".join(keys[a:b])
                name = hashlib.blake2b(texts + home.tobytes(), digest_size=16).digest()
                edges = np.searchsorted(w, [np.uint64(((1 << 64) * p) // parts) for p in range(1, parts)])
                edges = np.concatenate(([0], edges, [len(w)]))
                at_home = int.from_bytes(name[:4], "little") % parts
                low = data[offsets[a] : offsets[b]]
                picked = [low[x : x + SPLIT_BYTES].tobytes() for x in place[:: max(1, n // _BATCH_SAMPLE)][:_BATCH_SAMPLE]]
                for p in range(parts):
                    x, y = edges[p], edges[p + 1]
                    here = p == at_home
                    if x == y and not here:
                        continue
                    values = [
                        p, name, n, w[x:y].tobytes(), c[x:y].tobytes(), lead[x:y].astype("<u4").tobytes(), twice[lead[x:y]].tobytes(),
                        texts if here else None, (home.tobytes() + twice.tobytes() + _leaders(order, first).tobytes()) if here else None, picked if here else None,
                    ]
                    kinds = [pa.int32(), pa.binary(), pa.int32()] + [pa.binary()] * 6 + [pa.list_(pa.binary())]
                    yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=names)

    return run


def _leaders(order: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each anchor of a batch, the one that was sent for its context."""
    out = np.zeros(len(order), "<u4")
    out[order] = order[first][np.cumsum(first) - 1]
    return out


_SEEN = "batch binary, n int, i binary, state binary, texts binary, home binary, sample array<binary>"
#: States of an anchor: its window occurs once; its context repeats; it has to be sorted (or both).
ONCE, REPEATS, SORT = 0, 1, 2


def _seen(table: pa.Table) -> pa.Table:
    """States of the anchors sent to one range of window hashes."""
    w = [np.frombuffer(x, "<u8") for x in table.column("w").to_pylist()]
    row = np.repeat(np.arange(len(w)), [len(x) for x in w])
    w = np.concatenate(w)
    join = lambda c, kind: np.frombuffer(b"".join(table.column(c).to_pylist()), kind)
    c, twice = join("c", "<u8"), join("twice", np.uint8)
    order = np.lexsort((row, c, w))
    ws, cs = w[order], c[order]
    new_c = np.ones(len(ws), dtype=bool)
    new_c[1:] = (ws[1:] != ws[:-1]) | (cs[1:] != cs[:-1])
    begin_c = np.flatnonzero(new_c)
    count_c = np.diff(np.append(begin_c, len(ws)))
    repeats = np.repeat((count_c > 1) | (np.maximum.reduceat(twice[order], begin_c) > 0 if len(begin_c) else False), count_c)
    new_w = np.ones(len(ws), dtype=bool)
    new_w[1:] = ws[1:] != ws[:-1]
    begin_w = np.flatnonzero(new_w)
    contexts = np.add.reduceat(new_c.astype(np.int64), begin_w) if len(begin_w) else np.zeros(0, np.int64)
    several = np.repeat(contexts > 1, np.diff(np.append(begin_w, len(ws))))
    # One place of each context is sorted where its window has several contexts.
    state = np.zeros(len(ws), np.uint8)
    state[order] = np.where(repeats, REPEATS, 0) + np.where(several & new_c, SORT, 0)
    edge = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=table.num_rows))))
    states = [state[edge[r] : edge[r + 1]].tobytes() for r in range(table.num_rows)]
    return pa.table({
        "batch": table.column("batch"), "n": table.column("n"), "i": table.column("i"), "state": pa.array(states, pa.binary()),
        **{x: table.column(x) for x in ("texts", "home", "sample")},
    })


_MARKED = "key binary, covered array<int>, todo array<int>, sample array<binary>"


def _marked(length: int):
    def run(table: pa.Table) -> pa.Table:
        """The anchors' states of one batch, by text: covered ranges, and anchors to sort."""
        n = table.column("n")[0].as_py()
        state = np.zeros(n, np.uint8)
        home = None
        for i, s, t, h, sample in zip(*(table.column(c).to_pylist() for c in ("i", "state", "texts", "home", "sample"))):
            state[np.frombuffer(i, "<u4")] = np.frombuffer(s, np.uint8)
            if h is not None:
                home, texts, picked = h, t, sample
        text, place, lo, hi = np.frombuffer(home, "<u4", 4 * n).reshape(n, 4).astype(np.int64).T
        twice = np.frombuffer(home, np.uint8, n, 16 * n)
        leader = np.frombuffer(home, "<u4", n, 17 * n)
        # The others of a context repeat where it does; only the one that was sent is sorted.
        repeats = (twice > 0) | (state[leader] & REPEATS > 0)
        sort = state & SORT > 0
        keys = [texts[16 * i : 16 * i + 16] for i in range(len(texts) // 16)]
        covered: list[list[int]] = [[] for _ in keys]
        todo: list[list[int]] = [[] for _ in keys]
        for t, x, y in zip(text[repeats].tolist(), lo[repeats].tolist(), (hi[repeats] + length).tolist()):
            mine = covered[t]
            if mine and mine[-1] >= x:
                mine[-1] = max(mine[-1], y)
            else:
                mine += [x, y]
        for t, a, x, y, known in zip(*(v[sort].tolist() for v in (text, place, lo, hi + length, repeats))):
            todo[t] += [a, x, y, int(known)]
        some = [i for i in range(len(keys)) if covered[i] or todo[i]]
        rows = [i for i in some] + [-1]
        return pa.table({
            "key": pa.array([keys[i] if i >= 0 else None for i in rows], pa.binary()),
            "covered": pa.array([covered[i] if i >= 0 else [] for i in rows], pa.list_(pa.int32())),
            "todo": pa.array([todo[i] if i >= 0 else [] for i in rows], pa.list_(pa.int32())),
            "sample": pa.array([[] if i >= 0 else picked for i in rows], pa.list_(pa.binary())),
        })

    return run


def common_prefix(x: bytes, y: bytes, start: int) -> int:
    """Length of the common prefix of x and y, known to be ``start`` at least."""
    end, step = min(len(x), len(y)), 64
    while start < end:
        if x[start : start + step] == y[start : start + step]:
            start = min(start + step, end)
        elif step == 1:
            return start
        else:
            step //= 8
    return start


def front_code(strings: list[bytes]) -> tuple[list[int], list[bytes]]:
    """Of sorted strings: the prefix shared with the one before, and the rest."""
    shared, rest, last = [], [], b""
    for s in strings:
        h = common_prefix(last, s, 0)
        shared.append(h)
        rest.append(s[h:])
        last = s
    return shared, rest


def merge_runs(runs: list[Iterator[tuple[int, bytes]]]) -> Iterator[tuple[int, bytes, int]]:
    """Merge front-coded sorted runs: (run, string, prefix shared with the string before it).

    A loser tree over the runs' heads.  Every head carries how much it shares with
    the string that left the tree last; a loser shares that much with its winner.
    """
    k = 1
    while k < len(runs):
        k *= 2
    head: list[bytes | None] = [None] * k
    share = [0] * k
    loser = [0] * k

    def advance(r: int) -> None:
        got = next(runs[r], None) if r < len(runs) else None
        if got is None:
            head[r] = None
        else:
            # Its own front coding is against the string that this run gave last: the winner.
            share[r] = got[0]
            head[r] = (head[r] or b"")[: got[0]] + got[1]

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's share becomes that with the winner."""
        if head[a] is None or head[b] is None:
            return (b, a) if head[a] is None else (a, b)
        if share[a] != share[b]:
            return (a, b) if share[a] > share[b] else (b, a)
        h = common_prefix(head[a], head[b], share[a])
        if head[a][h : h + 1] <= head[b][h : h + 1]:
            share[b] = h
            return a, b
        share[a] = h
        return b, a

    for r in range(k):
        advance(r)
    level = list(range(k))
    node = k
    while len(level) > 1:
        node //= 2
        winners = []
        for j in range(0, len(level), 2):
            win, lose = play(level[j], level[j + 1])
            loser[node + j // 2] = lose
            winners.append(win)
        level = winners
    win = level[0]
    while head[win] is not None:
        yield win, head[win], share[win]
        advance(win)
        at = (win + k) // 2
        while at:
            win, loser[at] = play(win, loser[at])
            at //= 2


_RUNS = "part int, run binary, shared binary, rest binary, rest_len binary, left binary, left_len binary, refs binary"


def _runs(splits: list[bytes]):
    names = [c.split()[0] for c in _RUNS.split(", ")]

    def blob(parts: list[bytes]) -> tuple[bytes, bytes]:
        return b"".join(parts), np.array([len(p) for p in parts], "<u2").tobytes()

    def emit(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        rows.sort()
        run = hashlib.blake2b(b"".join(r[2] for r in rows[:64]) + len(rows).to_bytes(8, "little") + rows[0][0], digest_size=12).digest()
        part = [bisect_right(splits, r[0][:SPLIT_BYTES]) for r in rows]
        first = 0
        while first < len(rows):
            last = bisect_right(part, part[first])
            mine = rows[first:last]
            shared, rest = front_code([r[0] for r in mine])
            tail, tail_len = blob(rest)
            left, left_len = blob([r[1] for r in mine])
            values = [
                part[first], run, np.array(shared, "<u2").tobytes(), tail, tail_len, left, left_len, b"".join(r[2] for r in mine),
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array([v], pa.int32() if j == 0 else pa.binary()) for j, v in enumerate(values)], names=names
            )
            first = last

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            keys, todo = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            data, offsets = text_bytes(batch.column(1))
            for i, (key, items) in enumerate(zip(keys, todo)):
                text = data[offsets[i] : offsets[i + 1]].tobytes()
                for a, lo, end, known in zip(*[iter(items)] * 4):
                    ref = key + a.to_bytes(4, "little") + known.to_bytes(1, "little")
                    rows.append((text[a:end], text[lo:a][::-1], ref))
                    held += end - lo
                # A run is as much as a task keeps at once.
                if held > 32 << 20:
                    yield from emit(rows)
                    rows, held = [], 0
        if rows:
            yield from emit(rows)

    return run


_REF = 21


def longest_matches(right: list[int], left: list[bytes], length: int) -> list[tuple[int, int]]:
    """For the contexts of one window, in the order of their suffixes: longest matches (to the left, to the right).

    ``right[i]`` is the prefix that suffix i shares with suffix i - 1 (within the
    contexts), ``left`` the reversed left contexts.  A match of x with y counts if its
    two sides add up to ``length``; (0, 0) says that x has none.
    """
    n = len(left)
    order = sorted(range(n), key=left.__getitem__)
    rank = [0] * n
    for r, x in enumerate(order):
        rank[x] = r
    toward = [0] + [common_prefix(left[order[r - 1]], left[order[r]], 0) for r in range(1, n)]
    near_right = [max(right[i] if i else 0, right[i + 1] if i + 1 < n else 0) for i in range(n)]
    near_left = [max(toward[r] if r else 0, toward[r + 1] if r + 1 < n else 0) for r in range(n)]
    # Range minima of the right side, for pairs far apart in the suffix order.
    table = [np.array(right, np.int32)]
    while (1 << len(table)) < n:
        half, last = 1 << (len(table) - 1), table[-1]
        table.append(np.minimum(last[:-half], last[half:]))
    across = [np.array(toward, np.int32)]
    while (1 << len(across)) < n:
        half, last = 1 << (len(across) - 1), across[-1]
        across.append(np.minimum(last[:-half], last[half:]))

    def shared(levels: list[np.ndarray], i: int, j: int) -> int:
        i, j = (i + 1, j) if i < j else (j + 1, i)
        k = (j - i + 1).bit_length() - 1
        return int(min(levels[k][i], levels[k][j - (1 << k) + 1]))

    def walk(steps: list[int], own: int, other_best: int, levels: list[np.ndarray], place: list[int], inverse: list[int] | None) -> int:
        """Nearest first in one order: the longest side there that the other side completes.

        It ends as soon as no partner, however long on the other side, can do.
        """
        best = 0
        for direction in (-1, 1):
            at, here = own, 1 << 30
            while True:
                edge = at if direction < 0 else at + 1
                at += direction
                if not 0 <= at < n:
                    break
                here = min(here, steps[edge])
                if here <= best or here + other_best < length:
                    break
                x, y = (own, at) if inverse is None else (inverse[own], inverse[at])
                if here + shared(levels, place[x], place[y]) >= length:
                    best = here
                    break
        return best

    out = []
    identity = list(range(n))
    for x in range(n):
        if near_right[x] + near_left[rank[x]] < length:
            out.append((0, 0))
            continue
        to_left = walk(toward, rank[x], near_right[x], table, identity, order)
        to_right = walk(right, x, near_left[rank[x]], across, rank, None)
        # A match without any byte to the left is a string that starts at the anchor.
        out.append((to_left, to_right) if to_right else (0, 0))
    return out


_FOUND = "key binary, covered array<int>"


def _merge(length: int):
    k = length // 2

    def run(table: pa.Table) -> pa.Table:
        count = table.num_rows
        cols = {c: table.column(c).to_pylist() for c in ("run", "shared", "rest", "rest_len", "left", "left_len", "refs")}
        order = sorted(range(count), key=lambda r: cols["run"][r])

        def read(r: int) -> Iterator[tuple[int, bytes]]:
            rest, at = cols["rest"][r], 0
            for h, size in zip(np.frombuffer(cols["shared"][r], "<u2").tolist(), np.frombuffer(cols["rest_len"][r], "<u2").tolist()):
                yield h, rest[at : at + size]
                at += size

        lefts = [np.concatenate(([0], np.cumsum(np.frombuffer(cols["left_len"][r], "<u2").astype(np.int64)))).tolist() for r in order]
        taken = [0] * count
        keys, ranges = [], []
        group: list[tuple[int, bytes, bytes]] = []

        def close() -> None:
            if len(group) > 1:
                for (_, _, ref), (to_left, to_right) in zip(group, longest_matches([g[0] for g in group], [g[1] for g in group], length)):
                    if to_right and not ref[20]:
                        a = int.from_bytes(ref[16:20], "little")
                        keys.append(ref[:16])
                        ranges.append([a - to_left, a + to_right])
            group.clear()

        for r, _, shared in merge_runs([read(r) for r in order]):
            if shared < k:
                close()
            i = taken[r]
            taken[r] += 1
            source = order[r]
            left = cols["left"][source][lefts[r][i] : lefts[r][i + 1]]
            group.append((shared, left, cols["refs"][source][_REF * i : _REF * i + _REF]))
        close()
        return pa.table({"key": pa.array(keys, pa.binary()), "covered": pa.array(ranges, pa.list_(pa.int32()))})

    return run


def _kept(text: bytes, covered: list[list[int]] | None) -> tuple[bytes, int, int]:
    """The remaining bytes, and number of bytes and maximal runs removed."""
    pairs = sorted((c[i], c[i + 1]) for c in covered or () for i in range(0, len(c), 2))
    spans: list[list[int]] = []
    for a, b in pairs:
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], b)
        else:
            spans.append([a, b])
    out, at = [], 0
    for a, b in spans:
        out.append(text[at:a])
        at = b
    out.append(text[at:])
    return b"".join(out), sum(b - a for a, b in spans), len(spans)


def repeated_ranges(docs: DataFrame, text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """Rows (key, covered): for the md5 of a text, ranges [start, end, ...] of bytes in repeated strings."""
    spark = docs.sparkSession
    parts = max(2, shuffle_parts(spark))
    keyed = docs.select(F.unhex(F.md5(F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")))).alias("key"), F.col(text_col).cast("binary").alias("text")).where(F.octet_length("text") >= length)
    marked = write_scratch(
        keyed.mapInArrow(_spread(parts, length), _SPREAD).groupBy("p").applyInArrow(_seen, _SEEN)
        .groupBy("batch").applyInArrow(_marked(length), _MARKED),
        "anchors",
    )
    sample = (
        marked.where(F.size("sample") > 0).select(F.explode("sample").alias("s"))
        .orderBy(F.xxhash64("s")).limit(SPLIT_SAMPLE).collect()
    )
    sample = sorted(r["s"] for r in sample)
    splits = sorted({bytes(sample[len(sample) * i // parts]) for i in range(1, parts)}) if sample else []
    todo = marked.where(F.size("todo") > 0).select("key", "todo").dropDuplicates(["key", "todo"]).groupBy("key").agg(
        F.flatten(F.collect_list("todo")).alias("todo"))
    runs = keyed.join(todo, "key").dropDuplicates(["key"]).select("key", "text", "todo").mapInArrow(_runs(splits), _RUNS)
    found = runs.groupBy("part").applyInArrow(_merge(length), _FOUND)
    whole = marked.where(F.size("covered") > 0).select("key", "covered").unionByName(found)
    return whole.groupBy("key").agg(F.collect_set("covered").alias("covered"))


def remove_repeats(docs: DataFrame, text_col: str = "text", length: int = LENGTH, kept_col: str = "kept_bytes") -> DataFrame:
    """``docs`` with n_bytes, n_removed, n_spans and ``kept_col`` (binary).

    Every byte that lies in a string of ``length`` bytes of the text's UTF-8 form
    which also starts elsewhere, in this text or another, is removed; overlapping
    occurrences count and matches never cross texts.  A null or empty text has 0
    bytes; shorter texts lose nothing.  Repeated rows of a long enough text lose all.
    Columns with the results' names are replaced, others pass through.
    """
    return _removed(docs, text_col, length, kept_col, False)


def removal_digest(docs: DataFrame, text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """``docs`` with n_bytes, n_removed, n_spans and kept_sha256 (lowercase hex) instead of the kept bytes."""
    return _removed(docs, text_col, length, "kept_sha256", True)


def _removed(docs: DataFrame, text_col: str, length: int, result: str, digest: bool) -> DataFrame:
    ranges = write_scratch(repeated_ranges(docs, text_col, length), "ranges").withColumnRenamed("key", "__key").withColumnRenamed("covered", "__covered")
    kind = "string" if digest else "binary"
    schema = f"struct<n_bytes: long, n_removed: long, n_spans: long, kept: {kind}>"

    def apply(texts: pa.Array, covered: pa.Array) -> pa.Array:
        data, offsets = text_bytes(texts)
        rows = []
        for i, c in enumerate(covered.to_pylist()):
            text = data[offsets[i] : offsets[i + 1]].tobytes()
            kept, n, spans = _kept(text, c)
            rows.append((len(text), n, spans, hashlib.sha256(kept).hexdigest() if digest else kept))
        kinds = [pa.int64()] * 3 + [pa.string() if digest else pa.binary()]
        return pa.StructArray.from_arrays(
            [pa.array([r[j] for r in rows], kinds[j]) for j in range(4)], names=["n_bytes", "n_removed", "n_spans", "kept"]
        )

    names = ("n_bytes", "n_removed", "n_spans", result)
    docs = docs.drop(*[c for c in names if c != text_col])
    keyed = docs.withColumn("__key", F.unhex(F.md5(F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")))))
    joined = keyed.join(ranges, "__key", "left")
    done = joined.withColumn("__done", F.arrow_udf(apply, schema)(F.col(text_col), F.col("__covered")))
    return done.select(
        *docs.columns, *[F.col(f"__done.{c}").alias(c) for c in names[:3]], F.col("__done.kept").alias(result)
    )
