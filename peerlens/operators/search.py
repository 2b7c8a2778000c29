"""The weight search of safe coverage: candidate vectors, local samples, coordinate moves.

A search judges thousands of weight vectors against the same units, so the units are laid
out once: the positive volumes in parts that hold whole units, each part's rows in order
of unit and metric.  A vector is one number for each governed peer (a bounded list that
travels with the task); judging a block of vectors is a product of a part's volumes with
the block, sums and largest values over the runs of a unit and metric, AND over metrics,
OR over rules.  No row is multiplied by the vectors, and only counts leave a task.

Coordinate moves keep the state of a unit between vectors: changing one peer's weight
alters a unit through its total and that peer's own value alone, so totals and the few
largest other values give every grid value of every peer of a unit in one pass.  Peers
that share no unit cannot disturb each other and move together.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peerlens.operators.cells import CELL
from peerlens.operators.rules import PROTECTED_CAP, RULES
from peerlens.operators.weights import COMPARISON_EPSILON
from peerlens.session import cut_lineage, join_keys

#: Points of a coordinate grid, widths of the local stage, sample counts.
GRID_SIZE = 31
LOCAL_WIDTHS = (1.0, 0.5, 0.25)
SAMPLES = 4096
SEED = 20260805
#: Numbers in a block of candidate vectors, and in a task's working matrix.
BLOCK_VALUES = 4_000_000
WORK_VALUES = 1 << 18
#: Governed peers that a weight vector may have.
MOST_PEERS = 1 << 20
#: Rows of the universe in a part: with SAMPLES vectors a task of about a second.
PART_ROWS = 8192
#: Distances from neutral that differ by less count as equal.
SAME_DISTANCE = 1e-12


@dataclass
class Universe:
    """The units laid out for judging: parts of whole units, and the peers in order."""

    rows: DataFrame
    peers: list[str]
    overlay: int
    dense: bool

    def vector(self, weights: DataFrame) -> np.ndarray:
        """A table ``peer, w`` as a vector; peers it leaves out have weight 1."""
        known = {r["peer"]: r["w"] for r in weights.join(self.peer_table(), "peer", "left_semi").collect()}
        return np.array([1.0 if known.get(p) is None else known[p] for p in self.peers])

    def table(self, vector: np.ndarray) -> DataFrame:
        """A vector as a table ``peer, w``."""
        rows = [(p, float(w)) for p, w in zip(self.peers, vector)]
        return self.rows.sparkSession.createDataFrame(rows, "peer string, w double")

    def peer_table(self) -> DataFrame:
        return self.rows.sparkSession.createDataFrame([(p,) for p in self.peers], "peer string")


def lay_out(volumes: DataFrame, units: DataFrame, overlay_entity: str | None = None) -> Universe:
    """The positive volumes of the units in parts of whole units.

    ``volumes`` is ``CELL, metric, peer, v``, ``units`` as ``candidate_units`` returns them.
    Only the names of the peers reach the driver, at most MOST_PEERS.
    """
    placed = join_keys(volumes.where(F.col("v") > 0), units.select(*CELL, "unit_key", "rules"), CELL)
    names = F.transform("rules", lambda r: r["rule"])
    mask = F.lit(0)
    for i, r in enumerate(RULES):
        mask = mask + F.when(F.array_contains(names, r.name), 1 << i).otherwise(0)
    placed = cut_lineage(placed.select("unit_key", "metric", "peer", "v", mask.alias("rules")))
    listed = placed.groupBy("peer").agg(F.countDistinct("unit_key").alias("n")).orderBy("peer").limit(MOST_PEERS + 1).collect()
    if len(listed) > MOST_PEERS:
        raise ValueError(f"a weight vector has at most {MOST_PEERS} peers")
    sizes = placed.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("unit_key").alias("units")).first()
    spark = volumes.sparkSession
    peers = [r["peer"] for r in listed]
    numbers = spark.createDataFrame([(p, i) for i, p in enumerate(peers)], "peer string, p int")
    parts = max(1, -(-sizes["rows"] // PART_ROWS))
    rows = placed.join(numbers, "peer").select("unit_key", "metric", "p", "v", "rules")
    rows = cut_lineage(rows.repartition(parts, "unit_key").sortWithinPartitions("unit_key", "metric", "p"))
    overlay = peers.index(overlay_entity) if overlay_entity in peers else -1
    # Where some peer is in every unit, no two peers of a unit can move at once.
    return Universe(rows, peers, overlay, any(r["n"] == sizes["units"] for r in listed))


@dataclass
class _Chunk:
    """Whole units of a part as arrays; ``group`` is a unit and metric, ``start`` where it begins."""

    p: np.ndarray
    v: np.ndarray
    start: np.ndarray
    group: np.ndarray
    unit_start: np.ndarray  # first group of each unit
    rules: np.ndarray  # of each unit
    size: np.ndarray  # peers of each group


def _units(batches: Iterator[pa.RecordBatch], values: int) -> Iterator[_Chunk]:
    """Chunks of whole units with at most about ``values`` rows (a unit is never cut)."""
    left = None
    for batch in batches:
        table = pa.Table.from_batches([batch]) if left is None else pa.concat_tables([left, pa.Table.from_batches([batch])])
        code = table.column("unit_key").combine_chunks().dictionary_encode().indices.to_numpy()
        edge = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
        begin = 0
        for a, b in zip(edge, np.append(edge[1:], -1)):
            # The last unit may go on in the next batch.
            if b < 0 or b - begin >= values:
                if a > begin:
                    yield _chunk(table.slice(begin, a - begin))
                begin = a
        left = table.slice(begin)
    if left is not None and left.num_rows:
        yield _chunk(left)


def _chunk(table: pa.Table) -> _Chunk:
    unit, metric = (table.column(c).combine_chunks().dictionary_encode() for c in ("unit_key", "metric"))
    unit, metric = (x.indices.to_numpy() for x in (unit, metric))
    p, v, rules = (table.column(c).to_numpy() for c in ("p", "v", "rules"))
    start = np.flatnonzero(np.concatenate(([True], (unit[1:] != unit[:-1]) | (metric[1:] != metric[:-1]))))
    size = np.diff(np.append(start, len(p)))
    unit_start = np.flatnonzero(np.concatenate(([True], unit[start][1:] != unit[start][:-1])))
    return _Chunk(p, v, start, np.repeat(np.arange(len(start)), size), unit_start, rules[start][unit_start], size)


def _largest(x: np.ndarray, c: _Chunk, k: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The ``k`` largest values of each group (0 where there are fewer), and the rows that hold them (-1)."""
    x = x.copy()
    tops, rows = [], []
    at = np.arange(len(x))[:, None]
    for i in range(k):
        top = np.maximum.reduceat(x, c.start, axis=0)
        first = np.minimum.reduceat(np.where(x == top[c.group], at, len(x)), c.start, axis=0)
        some = top > -np.inf
        tops.append(np.where(some, top, 0.0))
        rows.append(np.where(some, first, -1))
        if i + 1 < k:
            g, j = np.nonzero(some)
            x[first[g, j], j] = -np.inf
    return tops, rows


_DEEPEST = max((need for r in RULES for need, _ in r.cumulative()), default=1)


def _passes(tops: list[np.ndarray], total: np.ndarray, size: np.ndarray, rule) -> np.ndarray:
    """Whether a rule holds, from the largest values in order; all arrays broadcast together."""
    share = lambda k: np.divide(tops[k - 1], total, out=np.zeros(np.broadcast_shapes(tops[k - 1].shape, total.shape)), where=total > 0) * 100.0
    ok = (size >= rule.min_entities) & (share(1) <= rule.cap + COMPARISON_EPSILON)
    for need, threshold in rule.cumulative():
        ok = ok & (share(need) + COMPARISON_EPSILON >= threshold)
    return ok


def _released(c: _Chunk, per_rule: list[np.ndarray | None], held: np.ndarray) -> np.ndarray:
    """Units that pass: AND over metrics, OR over the unit's rules, and the overlay."""
    out = np.zeros((len(c.unit_start), held.shape[1]), dtype=bool)
    for i, ok in enumerate(per_rule):
        if ok is None:  # a rule that no unit here may use
            continue
        may = (c.rules >> i & 1).astype(bool)[:, None]
        out |= may & np.logical_and.reduceat(ok, c.unit_start, axis=0)
    return out & np.logical_and.reduceat(held, c.unit_start, axis=0)


def _judge(vectors: np.ndarray, overlay: int):
    """Released units of a part for each vector (a column)."""
    thresholds = sorted({t for r in RULES for _, t in r.tiers})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(vectors.shape[1], np.int64)
        for c in _units(batches, 2048):
            for a in range(0, vectors.shape[1], step := max(1, WORK_VALUES // max(1, len(c.p)))):
                x = vectors[c.p, a : a + step] * c.v[:, None]
                total = np.add.reduceat(x, c.start, axis=0)
                x /= (total / 100.0)[c.group]
                largest = np.maximum.reduceat(x, c.start, axis=0)
                held = np.ones(total.shape, dtype=bool)
                if overlay >= 0:
                    own = np.flatnonzero(c.p == overlay)
                    held[c.group[own]] = x[own] <= PROTECTED_CAP + COMPARISON_EPSILON
                reach = {t: np.add.reduceat(x >= t - COMPARISON_EPSILON, c.start, axis=0, dtype=np.int32) for t in thresholds}
                per_rule = []
                for i, r in enumerate(RULES):
                    if not (c.rules >> i & 1).any():
                        per_rule.append(None)
                        continue
                    ok = (c.size >= r.min_entities)[:, None] & (largest <= r.cap + COMPARISON_EPSILON)
                    for need, t in r.cumulative():
                        ok &= reach[t] >= need
                    per_rule.append(ok)
                count[a : a + step] += _released(c, per_rule, held).sum(0)
        yield pa.record_batch({"cand": pa.array(np.arange(len(count))), "n": pa.array(count)})

    return run


def scores(universe: Universe, vectors: np.ndarray) -> np.ndarray:
    """Units that each vector (a column) would release."""
    out = np.zeros(vectors.shape[1], np.int64)
    step = max(1, BLOCK_VALUES // max(1, vectors.shape[0]))
    for a in range(0, vectors.shape[1], step):
        block = vectors[:, a : a + step]
        found = universe.rows.mapInArrow(_judge(block, universe.overlay), "cand long, n long").groupBy("cand").agg(F.sum("n").alias("n"))
        for r in found.collect():
            out[a + r["cand"]] = r["n"]
    return out


def best_of(universe: Universe, vectors: np.ndarray) -> tuple[np.ndarray, int]:
    """The vector with most units, then nearest to neutral, then first; and its units."""
    score = scores(universe, vectors)
    distance = np.abs(np.log(vectors)).sum(0)
    top = np.flatnonzero(score == score.max())
    pick = top[np.flatnonzero(distance[top] <= distance[top].min() + SAME_DISTANCE)[0]]
    return vectors[:, pick].copy(), int(score[pick])


def _moves(vector: np.ndarray, grid: np.ndarray, overlay: int):
    """For each peer and grid value of a part: by how much the released units change."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = np.zeros((len(vector), len(grid)), np.int64)
        for c in _units(batches, max(1, WORK_VALUES // (8 * (len(grid) + 1)))):
            x = c.v * vector[c.p]
            total = np.add.reduceat(x, c.start)
            tops, rows = _largest(x[:, None], c, _DEEPEST + 1)
            tops, rows = [t[:, 0] for t in tops], [r[:, 0] for r in rows]
            # Column 0 is the vector as it is; a row tries its peer's weight at each grid value.
            own = c.v[:, None] * np.concatenate([vector[c.p][:, None], np.broadcast_to(grid, (len(c.p), len(grid)))], axis=1)
            all_ = (total[c.group] - x)[:, None] + own
            all_[:, 0] = total[c.group]
            # The largest values of the others: skip the row itself.
            others, skipped = [], np.zeros(len(x), dtype=np.int64)
            at = np.arange(len(x))
            stack = np.stack(tops + [np.zeros(len(total))])
            for k in range(_DEEPEST):
                skipped = np.where((skipped == 0) & (rows[k][c.group] == at), 1, skipped)
                others.append(stack[k + skipped, c.group])
            ranked = []
            for k in range(_DEEPEST):
                # The k-th largest of the others and the own value.
                above = others[k - 1][:, None] if k else np.inf
                ranked.append(np.minimum(above, np.maximum(own, others[k][:, None])))
            held = np.ones(own.shape, dtype=bool)
            if overlay >= 0:
                weight_of = np.zeros(len(total))
                mine = np.flatnonzero(c.p == overlay)
                weight_of[c.group[mine]] = x[mine]
                protected = np.broadcast_to(weight_of[c.group][:, None], own.shape).copy()
                protected[mine] = own[mine]
                held = protected / all_ * 100.0 <= PROTECTED_CAP + COMPARISON_EPSILON
            per_rule = [_passes(ranked, all_, c.size[c.group][:, None], r) for r in RULES]
            # Verdicts of a unit for a peer's move: metrics in which the peer is absent stay as they are.
            now = [_passes(tops, total, c.size, r) for r in RULES]
            now_held = np.ones(len(total), dtype=bool)
            if overlay >= 0:
                now_held = weight_of / total * 100.0 <= PROTECTED_CAP + COMPARISON_EPSILON
            unit_of = np.zeros(len(total), np.int64)
            unit_of[c.unit_start] = 1
            unit_of = np.cumsum(unit_of) - 1
            groups = np.diff(np.append(c.unit_start, len(total)))
            unit = unit_of[c.group]
            order = np.lexsort((c.p, unit))
            begin = np.flatnonzero(np.concatenate(([True], (unit[order][1:] != unit[order][:-1]) | (c.p[order][1:] != c.p[order][:-1]))))
            of_unit, of_peer = unit[order][begin], c.p[order][begin]
            present = np.diff(np.append(begin, len(order)))

            def over_metrics(ok: np.ndarray, base: np.ndarray) -> np.ndarray:
                seen = np.logical_and.reduceat(ok[order], begin, axis=0)
                # With the peer in every metric of the unit that is all; else the others must hold as they are.
                bad = np.add.reduceat((~base).astype(np.int64), c.unit_start)[of_unit]
                bad_here = np.add.reduceat((~base[c.group][order]).astype(np.int64), begin)
                return seen & ((bad - bad_here) == 0)[:, None] if (present < groups[of_unit]).any() else seen

            passed = np.zeros((len(begin), own.shape[1]), dtype=bool)
            for i in range(len(RULES)):
                may = (c.rules[of_unit] >> i & 1).astype(bool)[:, None]
                passed |= may & over_metrics(per_rule[i], now[i])
            passed &= over_metrics(held, now_held)
            change = passed[:, 1:].astype(np.int64) - passed[:, :1]
            np.add.at(gain, of_peer, change)
        p, g = np.nonzero(np.ones(gain.shape, dtype=bool))
        yield pa.record_batch({"p": pa.array(p.astype(np.int64)), "g": pa.array(g.astype(np.int64)), "gain": pa.array(gain.ravel())})

    return run


def _blocked(priority: np.ndarray):
    """Peers that share a unit with a peer of lower (better) priority number; 0 is no wish to move."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lost = np.zeros(len(priority), dtype=bool)
        for c in _units(batches, WORK_VALUES // 8):
            unit = np.searchsorted(c.unit_start, c.group, side="right") - 1
            wish = priority[c.p]
            first = np.minimum.reduceat(np.where(wish > 0, wish, len(priority) + 1), c.start[c.unit_start])
            lost[c.p[(wish > 0) & (wish > first[unit])]] = True
        yield pa.record_batch({"p": pa.array(np.flatnonzero(lost))})

    return run


def coordinate_gains(universe: Universe, vector: np.ndarray, grid: np.ndarray) -> np.ndarray:
    """Change of the released units for each peer (row) and grid value (column) set alone."""
    out = np.zeros((len(vector), len(grid)), np.int64)
    found = universe.rows.mapInArrow(_moves(vector, grid, universe.overlay), "p long, g long, gain long").where("gain <> 0")
    for r in found.groupBy("p", "g").agg(F.sum("gain").alias("n")).collect():
        out[r["p"], r["g"]] = r["n"]
    return out


def improving_moves(vector: np.ndarray, gains: np.ndarray, grid: np.ndarray) -> list[tuple[int, float, int, int]]:
    """Each peer's best grid value if it improves the result, best first: (-gain, change of distance, peer, grid number).

    Better is more units, or as many at less distance from neutral.
    """
    nearer = np.abs(np.log(grid))[None, :] - np.abs(np.log(vector))[:, None]
    out = []
    for p in np.flatnonzero(((gains > 0) | ((gains == 0) & (nearer < -SAME_DISTANCE))).any(1)):
        g = min(range(len(grid)), key=lambda i: (-gains[p, i], nearer[p, i], i))
        out.append((-int(gains[p, g]), float(nearer[p, g]), int(p), g))
    return sorted(out)


@dataclass
class Found:
    """What a search ends with."""

    vector: np.ndarray
    released: int
    complete: bool
    moves: int
    rounds: int
    judged: int


def grid_of(low: float, high: float, size: int = GRID_SIZE) -> np.ndarray:
    return np.geomspace(low, high, size)


def search(
    universe: Universe, starts: list[np.ndarray], low: float, high: float, *, samples: int = SAMPLES, grid_size: int = GRID_SIZE,
    most_rounds: int | None = None,
) -> Found:
    """The best vector found from ``starts``, log-uniform samples, local samples and coordinate moves.

    As many samples as fit a block of BLOCK_VALUES numbers are drawn where there are very
    many peers.  Coordinate rounds go on until no grid value of any peer improves the
    result: then the search is complete.  ``most_rounds`` may end it before.
    """
    n = len(universe.peers)
    samples = max(1, min(samples, BLOCK_VALUES // max(1, n)))
    log_low, log_high = math.log(low), math.log(high)
    # An additive recurrence in n dimensions: powers of the root of x ** (n + 1) = x + 1.
    root = 2.0
    for _ in range(60):
        root = (1 + root) ** (1 / (n + 1))
    step = (1 / root) ** np.arange(1, n + 1) % 1.0
    cube = (0.5 + np.outer(step, np.arange(1, samples + 1))) % 1.0
    wide = np.exp(log_low + cube * (log_high - log_low))
    best, released = best_of(universe, np.column_stack([*starts, np.ones(n), wide]))
    judged = len(starts) + 1 + samples
    rng = np.random.default_rng(SEED)
    if high > low:
        for width in LOCAL_WIDTHS:
            near = np.exp(np.log(best)[:, None] + rng.normal(0.0, width, (n, samples)))
            best, released = best_of(universe, np.column_stack([best, np.clip(near, low, high)]))
            judged += samples
    grid = grid_of(low, high, grid_size)
    moves = rounds = 0
    while most_rounds is None or rounds < most_rounds:
        rounds += 1
        judged += n * grid_size
        wishes = improving_moves(best, coordinate_gains(universe, best, grid), grid)
        if not wishes:
            return Found(best, released, True, moves, rounds, judged)
        go = wishes[:1]
        if len(wishes) > 1 and not universe.dense:
            priority = np.zeros(n, np.int64)
            priority[[p for _, _, p, _ in wishes]] = np.arange(1, len(wishes) + 1)
            lost = {r["p"] for r in universe.rows.mapInArrow(_blocked(priority), "p long").distinct().collect()}
            go = [m for m in wishes if m[2] not in lost]
        for minus_gain, _, p, g in go:
            best[p] = grid[g]
            released -= minus_gain
            moves += 1
    return Found(best, released, False, moves, rounds, judged)
