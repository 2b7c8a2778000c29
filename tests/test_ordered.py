import math
import random
import struct

from pyspark.sql import functions as F

from peerlens.functions import ordered
from peerlens.functions.ordered import (
    distributed_rank,
    largest_k,
    order_bits,
    plain_percentile,
    weighted_percentile,
    weighted_percentile_or_plain,
)


def brute_weighted(pairs, p):
    total = sum(w for _, w in pairs)
    cumulative = 0.0
    for x, w in sorted(pairs):
        cumulative += w
        if cumulative >= p * total:
            return x
    return max(x for x, _ in pairs)


def test_bits_are_those_in_memory(spark):
    """The image equals the IEEE bits of a double, negated below zero; null first, NaN last."""
    rng = random.Random(1)
    values = [0.0, 5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.0, 1.5, 2.0, math.nextafter(2, 0), math.nextafter(2, 3), 1e300, 1.7976931348623157e308, math.inf]
    values += [2.0**e for e in range(-1074, 1024, 13)] + [math.nextafter(2.0**e, 0) for e in range(-1060, 1024, 7)]
    values += [struct.unpack("<d", struct.pack("<q", rng.getrandbits(63)))[0] for _ in range(500)]
    values = [v for v in values if not math.isnan(v)]
    values += [-v for v in values]
    bits = lambda v: struct.unpack("<q", struct.pack("<d", abs(v)))[0] * (-1 if v < 0 else 1)
    got = {r.x: r.b for r in spark.createDataFrame([(v,) for v in values], "x double").select("x", order_bits(F.col("x")).alias("b")).collect()}
    assert got == {v: bits(v) for v in values}
    ends = spark.createDataFrame([(None,), (math.nan,)], "x double").select(order_bits(F.col("x"))).collect()
    assert [r[0] for r in ends] == [-(2**63), 2**63 - 1]


def test_a_hot_bucket_never_meets_in_one_task(spark, monkeypatch):
    """Of 100 000 values within one percent of each other, which one bucket holds, no task gets more than a small part."""
    sizes, plain = [], ordered.cut_lineage

    def watched(df):
        out = plain(df)
        sizes.append(out.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect())
        return out

    monkeypatch.setattr(ordered, "cut_lineage", watched)
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        df = spark.range(100_000).select(F.lit("g").alias("g"), (1.0 + F.col("id") / 1e7).alias("x"), (F.col("id") % 7 + 0.25).alias("w"))
        got = weighted_percentile(df, ["g"], "x", "w", 0.85).first()["percentile"]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == brute_weighted([(1.0 + i / 1e7, i % 7 + 0.25) for i in range(100_000)], 0.85)
    assert max(max(s) for s in sizes) <= 100_000 / 5


def test_ties_do_not_depend_on_the_order_of_rows(spark):
    """Weights of which sums of doubles differ by order; half of the total ends exactly between two values."""
    rng = random.Random(9)
    left = [0.1, 0.2, 0.3, 1e6 + 0.7, 3.3, 1e-7] * 20
    rows = [(1.0, w) for w in left] + [(2.0, w) for w in left]
    got = set()
    for i in range(5):
        rng.shuffle(rows)
        df = spark.createDataFrame(rows, "x double, w double").repartition(i + 2)
        got.add(weighted_percentile(df, [], "x", "w", 0.5).first()["percentile"])
    assert got == {1.0}


def test_values_and_weights_of_all_sizes(spark):
    rng = random.Random(12)
    rows = [(g, rng.choice((-1, 1)) * 10 ** rng.uniform(-300, 300), 10 ** rng.uniform(-6, 12)) for g in "ab" for _ in range(300)]
    rows += [("c", 5.0, 1.0), ("d", -math.inf, 1.0), ("d", math.inf, 1.0), ("d", 0.0, 1.0), ("e", -0.0, 1.0), ("e", 0.0, 2.0)]
    df = spark.createDataFrame(rows, "g string, x double, w double")
    for p in (0.15, 0.5, 0.9):
        got = {r["g"]: r["percentile"] for r in weighted_percentile(df, ["g"], "x", "w", p).collect()}
        assert got == {g: brute_weighted([(x, w) for h, x, w in rows if h == g], p) for g in "abcde"}
    empty = spark.createDataFrame([], "g string, x double, w double")
    assert weighted_percentile(empty, ["g"], "x", "w", 0.5).count() == 0


def test_weighted_percentile_equals_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for group in range(6):
        hot = rng.random() * 50
        for _ in range(200):
            # A third of the rows of a group share one value.
            x = hot if rng.random() < 0.33 else round(rng.gauss(0, 30), 3)
            rows.append((f"g{group}", x, float(rng.randint(1, 50))))
    df = spark.createDataFrame(rows, "g string, x double, w double")
    for p in (0.15, 0.5, 0.85, 1.0):
        got = {r["g"]: r["percentile"] for r in weighted_percentile(df, ["g"], "x", "w", p).collect()}
        for group in range(6):
            pairs = [(x, w) for g, x, w in rows if g == f"g{group}"]
            assert got[f"g{group}"] == brute_weighted(pairs, p)


def test_plain_percentile_interpolates(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (1, 2, 3, 10)] + [("b", 7.0)], "g string, x double")
    got = {r["g"]: r["percentile"] for r in plain_percentile(df, ["g"], "x", 0.85).collect()}
    assert abs(got["a"] - (3 + 0.55 * 7)) < 1e-9
    assert got["b"] == 7.0


def test_no_weight_falls_back_to_plain(spark):
    df = spark.createDataFrame(
        [("a", 1.0, 0.0), ("a", 3.0, 0.0), ("b", 1.0, 1.0), ("b", 3.0, 1.0)], "g string, x double, w double"
    )
    got = {r["g"]: r["percentile"] for r in weighted_percentile_or_plain(df, ["g"], "x", "w", 0.5).collect()}
    assert got == {"a": 2.0, "b": 1.0}


def test_distributed_rank_is_a_full_ranking(spark):
    rng = random.Random(1)
    rows = [(f"p{i:03d}", float(rng.randint(0, 20))) for i in range(300)]
    df = spark.createDataFrame(rows, "peer string, x double").repartition(7)
    got = {r["peer"]: r["rank"] for r in distributed_rank(df, [F.col("x").desc(), F.col("peer")], "rank").collect()}
    want = {p: i for i, (p, _) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])), start=1)}
    assert got == want


def test_distributed_rank_per_group(spark):
    rows = [("a", 3), ("a", 1), ("b", 2), ("b", 9), ("b", 5)]
    df = spark.createDataFrame(rows, "g string, x int")
    got = {(r["g"], r["x"]): r["r"] for r in distributed_rank(df, [F.col("x")], "r", ["g"]).collect()}
    assert got == {("a", 1): 1, ("a", 3): 2, ("b", 2): 1, ("b", 5): 2, ("b", 9): 3}


def test_largest_k_limits_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), F.col("id").alias("x"), F.col("id").alias("t"))
    top = largest_k(df, ["g"], F.col("x"), "t", 2)
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()
    assert sorted(r["x"] for r in top.collect()) == [994, 995, 996, 997, 998, 999]


def test_percentiles_keep_only_the_open_buckets(spark, monkeypatch):
    """No table of all values is written on the way, only those of the bucket that holds the answer."""
    kept, plain = [], ordered.cut_lineage
    monkeypatch.setattr(ordered, "cut_lineage", lambda df: (kept.append(plain(df)), kept[-1])[1])
    df = spark.range(20_000).select(F.lit("g").alias("g"), (F.col("id") + 1.0).alias("x"), F.lit(1.0).alias("w"))
    assert weighted_percentile_or_plain(df, ["g"], "x", "w", 0.5).first()["percentile"] == 10_000.0
    none = df.withColumn("w", F.lit(0.0))
    assert weighted_percentile_or_plain(none, ["g"], "x", "w", 0.5).first()["percentile"] == 10_000.5
    assert max(t.count() for t in kept) < 1000
