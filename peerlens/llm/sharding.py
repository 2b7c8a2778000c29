"""Sharding by a k-d tree: split at weighted medians along the widest metadata dimension.

Documents with equal texts form a group that is never split.  A group is a point
with coordinates (source, language, length, each scaled to 0..1) and a weight (its
bytes).  A node that stands for several leaves is cut along the dimension with the
widest spread among its groups, at the weight that its two halves' leaves call for,
until each leaf is one shard.  Medians are found by distributed histograms over the
bits of the coordinate, 12 bits a pass; only bucket sums of the open nodes reach
the driver.  Ties in a coordinate are broken by the group's hash, so that groups of
one source or language can be cut anywhere.

Heavy groups cannot be balanced by a cut, so those above a small share of a leaf
(a bounded number of them) are placed first, each in the emptiest leaf, and the cuts
fill what the leaves have left.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import write_scratch

DIMENSIONS = ("x_source", "x_lang", "x_length")
#: A group heavier than this share of a leaf is placed by itself: at most 500 a leaf.
HEAVY = 1 / 500
_SCALE_BITS, _HASH_BITS, _PASS_BITS = 20, 40, 12
#: Rows that are numbered together when slots are given out.
SLOT_ROWS = 20_000


def _number(text: Column) -> Column:
    """The first six bytes of a text as a number in the order of the texts."""
    return F.conv(F.rpad(F.substring(F.hex(F.encode(F.coalesce(text, F.lit("")), "UTF-8")), 1, 12), 12, "0"), 16, 10).cast("double")


def text_groups(docs: DataFrame, text_col: str, source_col: str, lang_col: str) -> DataFrame:
    """Rows (g, weight, docs, source, lang, length): groups of equal texts; g is their md5, null text its own."""
    text = F.col(text_col)
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1
    rows = docs.select(
        group_key(text).alias("g"), size.alias("size"), F.col(source_col).cast("string").alias("source"), F.col(lang_col).cast("string").alias("lang")
    )
    return rows.groupBy("g").agg(
        F.sum("size").alias("weight"), F.count(F.lit(1)).alias("docs"), F.min("source").alias("source"), F.min("lang").alias("lang"),
        F.max("size").alias("length"),
    )


def group_key(text: Column) -> Column:
    return F.coalesce(F.md5(F.encode(text, "UTF-8")), F.lit("null"))


def _points(groups: DataFrame) -> DataFrame:
    """Coordinates scaled to the spread of the whole table, on 20 bits."""
    raw = groups.select(
        "g", "weight", F.coalesce(F.substring("g", 1, 10), F.lit("0")).alias("h"), _number(F.col("source")).alias("x_source"),
        _number(F.col("lang")).alias("x_lang"), F.log2(F.col("length").cast("double")).alias("x_length"),
    )
    edges = raw.agg(*[f(d).alias(f"{n}{d}") for d in DIMENSIONS for f, n in ((F.min, "lo"), (F.max, "hi"))]).first()
    out = raw.select("g", "weight", F.coalesce(F.conv(F.when(F.col("h").rlike("^[0-9a-f]{10}$"), F.col("h")).otherwise("0"), 16, 10).cast("long"), F.lit(0)).alias("h"), *DIMENSIONS)
    for d in DIMENSIONS:
        lo, hi = edges[f"lo{d}"] or 0.0, edges[f"hi{d}"] or 0.0
        scaled = (F.col(d) - lo) / (hi - lo) * ((1 << _SCALE_BITS) - 1) if hi > lo else F.lit(0.0)
        out = out.withColumn(d, F.floor(scaled).cast("long"))
    return out


def _with_nodes(points: DataFrame, rows: list[tuple], schema: str, how: str = "inner") -> DataFrame:
    """The points with what is known of their nodes (a table of at most n_shards rows)."""
    return points.join(points.sparkSession.createDataFrame(rows, f"node int, {schema}"), "node", how)


def _coordinate() -> Column:
    return F.element_at(F.array(*DIMENSIONS), F.col("dim")) * (1 << _HASH_BITS) + F.col("h")


def _cuts(points: DataFrame, wanted: dict[int, float], dims: dict[int, int]) -> dict[int, int]:
    """For each node: the coordinate below which about the wanted weight lies."""
    prefix, below, bits = dict.fromkeys(wanted, 0), dict.fromkeys(wanted, 0.0), _SCALE_BITS + _HASH_BITS
    while bits:
        bits -= _PASS_BITS
        sums = (
            _with_nodes(points, [(n, dims[n], prefix[n]) for n in wanted], "dim int, inside long")
            .select("node", "weight", "inside", _coordinate().alias("x"))
            .where(F.shiftright("x", bits + _PASS_BITS) == F.col("inside"))
            .groupBy("node", F.shiftright("x", bits).alias("bucket")).agg(F.sum("weight").alias("w")).collect()
        )
        for n in wanted:
            mine = sorted((r["bucket"], r["w"]) for r in sums if r["node"] == n)
            prefix[n] = prefix[n] << _PASS_BITS
            for bucket, w in mine:
                prefix[n] = bucket
                if below[n] + w > wanted[n]:
                    break
                below[n] += w
            else:
                if mine:  # all of it is wanted: cut above the last bucket
                    prefix[n] = mine[-1][0] + 1
    return prefix


def shard_groups(groups: DataFrame, n_shards: int) -> DataFrame:
    """Rows (g, shard) for groups (g, weight, ...): the leaves of the tree, near equal in weight."""
    total, most = groups.agg(F.sum("weight"), F.count(F.lit(1))).first()
    total = float(total or 0)
    target = total / n_shards
    # At most 1 / HEAVY groups a leaf can weigh so much: a bounded list.
    heavy = groups.where(F.col("weight") > target * HEAVY).select("g", "weight").orderBy(F.desc("weight"), "g").collect() if most else []
    load = [(0.0, s) for s in range(n_shards)]
    placed = []
    for r in heavy:
        at, s = heapq.heappop(load)
        placed.append((r["g"], s))
        heapq.heappush(load, (at + r["weight"], s))
    loads = {s: at for at, s in load}
    # What each leaf still takes; leaves above the common level take nothing.
    light = total - sum(r["weight"] for r in heavy)
    ranked, level = sorted(loads.values()), 0.0
    for i in range(n_shards):
        level = (light + sum(ranked[: i + 1])) / (i + 1)
        if i + 1 == n_shards or level <= ranked[i + 1]:
            break
    room = {s: max(0.0, level - loads[s]) for s in range(n_shards)}
    spark = groups.sparkSession
    fixed = spark.createDataFrame(placed, "g string, shard int")
    points = write_scratch(_points(groups.where(F.col("weight") <= target * HEAVY)).withColumn("node", F.lit(0)), "points")
    leaves = {0: list(range(n_shards))}
    while any(len(x) > 1 for x in leaves.values()):
        split = {n: x for n, x in leaves.items() if len(x) > 1}
        spread = {
            r["node"]: max(range(len(DIMENSIONS)), key=lambda i: r[DIMENSIONS[i]]) + 1 for r in
            points.groupBy("node").agg(*[(F.max(d) - F.min(d)).alias(d) for d in DIMENSIONS]).collect()
        }
        wanted = {n: sum(room[s] for s in x[: len(x) // 2]) for n, x in split.items() if n in spread}
        if wanted:
            cut = _cuts(points, wanted, spread)
            # Children: 2 n + 1 and 2 n + 2; leaves keep their node.
            child = F.when(_coordinate() < F.col("cut"), 2 * F.col("node") + 1).otherwise(2 * F.col("node") + 2)
            moved = _with_nodes(points, [(n, spread[n], cut[n]) for n in cut], "dim int, cut long", "left")
            node = F.when(F.col("cut").isNull(), F.col("node")).otherwise(child).cast("int")
            points = write_scratch(moved.select("g", "weight", "h", *DIMENSIONS, node.alias("node")), "points")
        for n, x in split.items():
            half = len(x) // 2
            del leaves[n]
            leaves[2 * n + 1], leaves[2 * n + 2] = x[:half], x[half:]
    named = _with_nodes(points, [(n, x[0]) for n, x in leaves.items()], "shard int")
    return named.select("g", "shard").unionByName(fixed)


def shard_documents(
    docs: DataFrame, n_shards: int | None = 16, target_bytes: int | None = None, id_col: str = "doc_id", text_col: str = "text",
    source_col: str = "source", lang_col: str = "lang",
) -> DataFrame:
    """``docs`` with shard (int, from 0) and slot (long, gapless from 0 in each shard).

    A document weighs the UTF-8 bytes of its text plus 1 (null: 1).  The number of
    shards is given, or follows from ``target_bytes`` a leaf.  Documents with equal
    texts (null texts too) share a shard; a group heavier than a shard's part makes
    that shard heavier.  Null source or language sorts first.  Slots are dealt in
    runs of hash ranges of the id; equal rows get different slots.  Columns named
    shard or slot are replaced; an empty table gives an empty one.
    """
    docs = docs.drop("shard", "slot")
    groups = write_scratch(text_groups(docs, text_col, source_col, lang_col), "groups")
    if n_shards is None:
        total = groups.agg(F.sum("weight")).first()[0] or 0
        n_shards = max(1, -(-total // target_bytes))
    shards = write_scratch(shard_groups(groups, n_shards), "shards").select(F.col("g").alias("__g"), F.col("shard"))
    placed = docs.withColumn("__g", group_key(F.col(text_col))).join(shards, "__g").drop("__g")
    return number_slots(placed, groups, id_col, text_col)


def number_slots(placed: DataFrame, groups: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Slots from 0 in each shard: numbers within bounded hash buckets plus the buckets' offsets.

    The rows are numbered by id and written once, without their other columns; the
    offsets are sums over buckets, not over rows.
    """
    rows = groups.agg(F.sum("docs")).first()[0] or 0
    buckets = max(1, -(-rows // SLOT_ROWS))
    marked = placed.withColumn("__bucket", F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(buckets)).cast("int"))
    counts = write_scratch(marked.groupBy("shard", "__bucket").agg(F.count(F.lit(1)).alias("n")), "counts")
    before = Window.partitionBy("shard").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "__bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__offset"))
    inside = Window.partitionBy("shard", "__bucket").orderBy(F.col(id_col).asc_nulls_first(), F.crc32(F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")))
    return (
        marked.join(offsets, ["shard", "__bucket"])
        .withColumn("slot", (F.row_number().over(inside) - 1 + F.col("__offset")).cast("long"))
        .drop("__bucket", "__offset")
        .select(*[c for c in placed.columns if c != "shard"], "shard", "slot")
    )
