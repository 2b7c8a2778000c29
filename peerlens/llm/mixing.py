"""Mixing sources to target weights by cube-method balanced sampling.

A source with target T and size S takes every document floor(T / S) times and one
time more with inclusion probability T / S - floor(T / S).  The extra copies are
chosen by the cube method: the vector of probabilities walks inside the unit cube
along directions that keep the source's expected words and documents, until every
step has rounded a coordinate and too few fractional ones are left for a balanced
direction.  The walk runs in chunks of each source (in parallel, each leaves a
dozen fractional documents), then over the chunks' remainders, level by level;
the landing phase rounds the last two documents of a source so that its words end
nearest to the target.

A walk needs two numbers for each document, so texts are only read to count words,
and the sampled documents are joined back by a fingerprint of the whole row.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import write_scratch

#: Most copies of a document in the mix.
MOST = 3
#: Documents that walk together.
CHUNK = 20_000
#: Shorter documents of a source that wait for the landing, besides the two that the walk leaves.
HELD = 10
_WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of maximal runs of characters other than space and \\t to \\r; null counts 0."""
    # Runs become one letter each, everything else goes: no array of words is built.
    return F.coalesce(F.length(F.regexp_replace(F.regexp_replace(text, _WORD, "\x01"), r"[\x20\x09-\x0D]+", "")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, budget: float | None = None, weights: tuple[float, ...] = (1.0, 2.0, 3.0)) -> DataFrame:
    """Rows (source, source_size, docs, target) from rows (source, size).

    Sources in code point order, null last, weigh ``weights`` in turn.  They share
    ``budget`` words (default: all there are) in proportion, but none gets more than
    MOST times its size; the excess is shared again among the others until none is
    above.  If all are at their limit the rest of the budget stays unused.
    """
    by_source = write_scratch(
        sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"), F.count(F.lit(1)).alias("docs")), "sources"
    )
    # Sources are numbered within ranges of names and ranges are offset, so no task holds all of them.
    order = F.when(F.col("source").isNull(), 1).otherwise(0)
    key = F.encode(F.coalesce("source", F.lit("")), "UTF-8")
    ranged = write_scratch(by_source.repartitionByRange(order, key).withColumn("part", F.spark_partition_id()), "ranges")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n")).withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    place = F.row_number().over(Window.partitionBy("part").orderBy(order, key)) + F.col("start") - 1
    numbered = ranged.join(starts.select("part", "start"), "part").withColumn("turn", F.pmod(place, F.lit(len(weights))))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("turn") + 1).cast("int"))
    state = write_scratch(numbered.select("source", "source_size", "docs", weight.alias("weight"), F.lit(False).alias("full")), "targets")
    while True:
        sums = state.agg(
            F.sum(F.when(~F.col("full"), F.col("weight"))), F.sum(F.when(F.col("full"), MOST * F.col("source_size"))), F.sum("source_size")
        ).first()
        open_weight, used, total = (float(x or 0) for x in sums)
        rest = (total if budget is None else budget) - used
        share = F.col("weight") * F.lit(rest / open_weight if open_weight else 0.0)
        now_full = F.col("full") | (share > MOST * F.col("source_size"))
        after = write_scratch(state.withColumn("full", now_full), "targets")
        if after.where("full").count() == state.where("full").count():
            return state.select(
                "source", "source_size", "docs", F.when(F.col("full"), MOST * F.col("source_size").cast("double")).otherwise(share).alias("target")
            )
        state = after


def flight(p: np.ndarray, size: np.ndarray, rng: np.random.Generator, held: int = 0, eps: float = 1e-9) -> np.ndarray:
    """Walk probabilities through the null space of (documents, words).

    At most two of them stay fractional, and ``held`` of the shorter half, which do not walk.
    """
    p = p.copy()
    p[p <= eps], p[p >= 1 - eps] = 0.0, 1.0
    open_ids = np.flatnonzero((p > 0) & (p < 1)).tolist()
    if held:
        # Of all sizes in the shorter half: their sums come near to any number of words.
        wait = {open_ids[int(i)] for i in np.linspace(len(open_ids) / 2, len(open_ids) - 1, held)} if open_ids else set()
        open_ids = [i for i in open_ids if i not in wait]
    hand, rest = open_ids[:3], iter(open_ids[3:])
    draws = iter(rng.random(len(open_ids) + 3).tolist())
    while len(hand) == 3:
        i, j, k = hand
        a, b, c = size[i], size[j], size[k]
        # Null vector of [[1, 1, 1], [a, b, c]] (all sizes equal: move two against each other).
        v = (b - c, c - a, a - b)
        if not any(v):
            v = (1.0, -1.0, 0.0)
        up = down = np.inf
        for x, d in zip((p[i], p[j], p[k]), v):
            if d > 0:
                up, down = min(up, (1 - x) / d), min(down, x / d)
            elif d < 0:
                up, down = min(up, -x / d), min(down, (x - 1) / d)
        step = up if next(draws) < down / (up + down) else -down
        left = []
        for i, d in zip(hand, v):
            x = p[i] + step * d
            if x <= eps or x >= 1 - eps:
                p[i] = 0.0 if x <= eps else 1.0
            else:
                p[i] = x
                left.append(i)
        while len(left) < 3 and (new := next(rest, None)) is not None:
            left.append(new)
        hand = left
    return p


def landing(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Round the last fractional probabilities: words nearest to what was due, then documents, then the first."""
    p = p.copy()
    last = np.flatnonzero((p > 0) & (p < 1))
    taken = (np.arange(1 << len(last))[:, None] >> np.arange(len(last))) & 1
    words_off = np.abs(taken @ size[last] - p[last] @ size[last])
    docs_off = np.abs(taken.sum(1) - p[last].sum())
    p[last] = taken[np.lexsort((docs_off, words_off))[0]]
    return p


_STATE = "source string, key binary, nth int, size long, whole int, p double"


def _walk(seed: int, last: bool):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        # Long documents walk first, so that those left over are short.
        rows = rows.sort_values(["size", "draw", "key", "nth"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
        size = rows["size"].to_numpy(np.float64)
        rng = np.random.default_rng([seed, int(rows["chunk"].iloc[0]), len(rows)])
        p = flight(rows["p"].to_numpy(np.float64), size, rng, HELD)
        rows["p"] = landing(p, size) if last else p
        return rows[["source", "key", "nth", "size", "whole", "p"]]

    return run


def _placed(rows: DataFrame, chunks: DataFrame, seed: int) -> DataFrame:
    """Deal the documents of each source to its chunks by a hash."""
    draw = F.xxhash64("key", "nth", F.lit(seed))
    return rows.join(chunks, rows.source.eqNullSafe(chunks.of)).drop("of").withColumn("draw", draw).withColumn(
        "chunk", F.pmod(F.xxhash64("draw"), F.col("chunks")).cast("int")
    )


def balanced_copies(units: DataFrame, targets: DataFrame, seed: int = 7) -> DataFrame:
    """Rows (source, key, nth, size, copies) for units (source, key, nth, size) and source targets.

    (key, nth) names a unit.  copies is between 0 and MOST.  Reruns agree: the
    order of a walk and its draws come from hashes of the units.
    """
    of = targets.select(
        F.col("source").alias("of"), "docs",
        F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(MOST)))).otherwise(0.0).alias("ratio"),
    )
    rows = units.join(of, units.source.eqNullSafe(of.of)).select(
        "source", "key", "nth", "size", F.floor("ratio").cast("int").alias("whole"), (F.col("ratio") - F.floor("ratio")).alias("p")
    )
    done, level = None, 0
    count = of.select("of", F.col("docs").alias("n"))
    while True:
        # One chunk in each source: its remainder lands.
        chunks = count.select("of", F.greatest(F.lit(1), F.ceil(F.col("n") / CHUNK)).cast("int").alias("chunks"))
        dealt = _placed(rows, chunks, seed + level)
        alone = dealt.where("chunks = 1").groupBy("source", "chunk").applyInPandas(_walk(seed + level, True), _STATE)
        more = dealt.where("chunks > 1").groupBy("source", "chunk").applyInPandas(_walk(seed + level, False), _STATE)
        walked = write_scratch(alone.unionByName(more), "walk")
        rounded = walked.where("p = 0 OR p = 1")
        done = rounded if done is None else done.unionByName(rounded)
        rows = walked.where("p > 0 AND p < 1")
        if rows.isEmpty():
            break
        count = rows.groupBy(F.col("source").alias("of")).agg(F.count(F.lit(1)).alias("n"))
        level += 1
    return done.select("source", "key", "nth", "size", (F.col("whole") + F.col("p").cast("int")).alias("copies"))


def sampled_mix(docs: DataFrame, source_col: str = "source", text_col: str = "text", budget: float | None = None, seed: int = 7,
                weights: tuple[float, ...] = (1.0, 2.0, 3.0), key: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """The units with their copies (source, key, nth, size, copies), and the targets.

    key is binary, by default a fingerprint of the whole row; nth numbers rows of
    equal source, key and size.
    """
    units = write_scratch(_units(docs, source_col, text_col, fingerprint(docs) if key is None else key), "units")
    targets = write_scratch(source_targets(units.select("source", "size"), budget, weights), "targets")
    return balanced_copies(units, targets, seed), targets


def fingerprint(docs: DataFrame) -> Column:
    """A 128-bit fingerprint of all columns of a row; equal rows have equal ones."""
    parts = []
    for name, kind in docs.dtypes:
        column = F.col(f"`{name}`")
        text = column if kind == "string" else column.cast("string") if not kind.startswith(("array", "map", "struct")) else F.to_json(F.struct(column))
        parts += [F.when(column.isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), F.length(text).cast("string"), F.lit(":"))), F.coalesce(text, F.lit(""))]
    return F.unhex(F.md5(F.concat(*parts).cast("binary")))


def _units(docs: DataFrame, source_col: str, text_col: str, key: Column) -> DataFrame:
    rows = docs.select(
        F.col(source_col).cast("string").alias("source"), key.alias("key"), word_count(F.col(text_col)).alias("size")
    )
    same = rows.groupBy("source", "key", "size").agg(F.count(F.lit(1)).cast("int").alias("m"))
    return same.select("source", "key", F.explode(F.sequence(F.lit(1), "m")).alias("nth"), "size")


def mix_sources(docs: DataFrame, source_col: str = "source", text_col: str = "text", budget: float | None = None, seed: int = 7,
                weights: tuple[float, ...] = (1.0, 2.0, 3.0)) -> DataFrame:
    """The mixed corpus: rows of ``docs``, each as often as it was taken (0 to 3 times).

    Words are maximal runs of characters other than space and \\t to \\r.  Rows with a
    null or wordless text have size 0: they are drawn at their source's rate and
    take no words.  A null source is a source.  Equal rows are separate documents.
    A source without words takes nothing.  Any other columns pass through, whatever
    their names.  An empty table gives an empty one.
    """
    copies, _ = sampled_mix(docs, source_col, text_col, budget, seed, weights)
    total = copies.groupBy("key").agg(F.sum("copies").cast("int").alias("__copies"), F.count(F.lit(1)).alias("__rows")).withColumnRenamed("key", "__key")
    taken = docs.withColumn("__key", fingerprint(docs)).join(total.where("__copies > 0"), "__key")
    single, repeated = taken.where("__rows = 1"), taken.where("__rows > 1").dropDuplicates(["__key"])
    out = single.unionByName(repeated)
    return out.withColumn("__key", F.explode(F.sequence(F.lit(1), "__copies"))).drop("__key", "__copies", "__rows")
