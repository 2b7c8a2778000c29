"""The settled weight fit: the largest weights under which all caps hold, whatever way they are found."""

import random

import pytest
from pyspark.sql import functions as F

from peerlens.operators import weights

SCHEMA = "run_id string, dimension string, category string, time_period string, peer string, v double, cap double"


def cells(spark, seed=1, runs=("a", "b"), peers=9, groups=60):
    rng = random.Random(seed)
    rows = []
    for run in runs:
        cap = rng.choice((22.0, 30.0))
        for g in range(groups):
            for p in range(peers):
                if rng.random() < 0.9:
                    v = rng.expovariate(1) * (4 if p == 0 else 1) * rng.choice((0.0, 1.0, 1.0, 1.0))
                    rows.append((run, "xy"[g % 2], f"c{g}", None if g % 3 else "t", f"P{p}", v, 18.0 if p == 1 else cap))
    return spark.createDataFrame(rows, SCHEMA)


def greatest(rows, low=0.2):
    """Plain scaling from 1 until nothing moves."""
    m = {(r["run_id"], r["peer"]): 1.0 for r in rows}
    groups = {}
    for r in rows:
        groups.setdefault((r["run_id"], r["dimension"], r["category"], r["time_period"]), []).append(r)
    while True:
        factor = dict.fromkeys(m, 1.0)
        for members in groups.values():
            total = sum(r["v"] * m[r["run_id"], r["peer"]] for r in members)
            for r in members:
                key = (r["run_id"], r["peer"])
                own = r["v"] * m[key]
                if own > 0 and own / total * 100 > r["cap"]:
                    factor[key] = min(factor[key], r["cap"] * (total - own) / ((100 - r["cap"]) * own))
        new = {k: max(low, m[k] * factor[k]) for k in m}
        if max(abs(1 - new[k] / m[k]) for k in m) < 1e-14:
            return new
        m = new


def start(df):
    return df.select("run_id", F.lit("*").alias("scope"), "peer", F.lit(1.0).alias("m")).distinct()


@pytest.mark.parametrize("rows_in_a_task, worst", [(500_000, 4), (500_000, 1), (1, 4), (300, 1)])
def test_all_ways_find_the_same_weights(spark, monkeypatch, rows_in_a_task, worst):
    """In tasks by cutting planes, by plain rounds, and by both in turn."""
    monkeypatch.setattr(weights, "SOLVED_ROWS", rows_in_a_task)
    monkeypatch.setattr(weights, "WORST_CELLS", worst)
    df = cells(spark)
    settled = 1e-9 if rows_in_a_task < 1000 else weights.SETTLED
    got = weights.settle(df.withColumn("scope", F.lit("*")), start(df), 0.2, 10.0, settled).collect()
    want = greatest(df.collect())
    assert len(got) == len(want)
    for r in got:
        assert r["m"] == pytest.approx(want[r["run_id"], r["peer"]], rel=1e-6)
    assert min(want.values()) < 0.9


def test_few_rounds(spark, monkeypatch):
    """Many cells settle in a dozen rounds at most, of which the last finds nothing broken."""
    seen = []
    plain = weights.add_group_values
    monkeypatch.setattr(weights, "add_group_values", lambda *a, **k: (seen.append(1), plain(*a, **k))[1])
    df = cells(spark, seed=3, runs=("a",), groups=400)
    weights.settle(df.withColumn("scope", F.lit("*")), start(df), 0.2, 10.0)
    assert len(seen) <= 12


def test_settled_runs_are_not_looked_at_again(spark):
    """A run within its caps keeps weight 1 beside one that is not; a peer without cells too."""
    rows = [("calm", "x", "c", None, p, 1.0, 40.0) for p in "ABCDE"] + [("hard", "x", "c", None, p, 9.0 if p == "A" else 1.0, 30.0) for p in "ABCDE"]
    df = spark.createDataFrame(rows, SCHEMA)
    extra = spark.createDataFrame([("hard", "Z")], "run_id string, peer string")
    people = df.select("run_id", "peer").distinct().unionByName(extra)
    got = {(r["run_id"], r["peer"]): r["multiplier"] for r in weights.fit_weights(df, people, low=0.01, high=10.0).collect()}
    assert all(got["calm", p] == pytest.approx(1.0) for p in "ABCDE")
    own, others = got["hard", "A"] * 9, sum(got["hard", p] for p in "BCDE")
    assert own / (own + others) == pytest.approx(0.3) and got["hard", "Z"] == pytest.approx(got["hard", "B"])


def test_nothing_to_govern(spark):
    df = spark.createDataFrame([], SCHEMA)
    people = spark.createDataFrame([("r", "A"), ("r", "B")], "run_id string, peer string")
    assert {r["multiplier"] for r in weights.fit_weights(df, people).collect()} == {1.0}
