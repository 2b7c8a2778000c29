"""Digests of exact sums: the same however the facts lie, and naming what differs."""

import random

import pytest
from pyspark.sql import functions as F

from peerlens import Roles
from peerlens.functions.scalar import exact_sum
from peerlens.operators import cells, coverage

COVER = Roles("issuer", ("region",), metric="amount", secondary=("cnt",), time="q")
SCHEMA = "issuer string, region string, q string, amount double, cnt double"


@pytest.fixture(scope="module")
def rows():
    """Amounts whose sum in doubles depends on the order: tiny beside huge."""
    rng = random.Random(4)
    return [(p, f"r{u}", "q1", rng.choice((1e15, 0.1, 1e-3, 1 / 3, 7e9)) * rng.random(), rng.random()) for u in range(6) for p in "ABCDEF" for _ in range(30)]


def digests(df):
    volumes = coverage.unit_volumes(df, COVER)
    units = coverage.candidate_units(volumes)
    return coverage.unit_digests(volumes, units), coverage.universe_digest(volumes, units).first()["digest"]


def test_the_order_of_facts_does_not_matter(spark, rows):
    seen, sums = set(), set()
    for i in range(5):
        some = rows[:]
        random.Random(i).shuffle(some)
        df = spark.createDataFrame(some, SCHEMA).repartition(i + 1)
        seen.add(digests(df)[1])
        seen.add(digests(cells.prepare_cells(df, COVER, exact=True))[1])
        sums.add(tuple(sorted(tuple(r) for r in df.groupBy("issuer").agg(F.sum("amount"), exact_sum(F.col("cnt"))).collect())))
    assert len(seen) == 1


def test_exact_sum_of_strange_values(spark):
    df = spark.createDataFrame([("a", 1e16), ("a", 1.0), ("a", -1e16), ("b", float("inf")), ("b", 1.0), ("c", None), ("d", float("nan"))], "k string, v double")
    got = {r["k"]: r["s"] for r in df.groupBy("k").agg(exact_sum(F.col("v")).alias("s")).collect()}
    assert got["a"] == 1.0 and got["b"] == float("inf") and got["c"] is None and got["d"] != got["d"]


def test_a_difference_names_its_units(spark, rows):
    before, root = digests(spark.createDataFrame(rows, SCHEMA))
    first = next(i for i, r in enumerate(rows) if r[1] == "r3")
    changed = [(*r[:4], r[4] + 1e-4) if i == first else r for i, r in enumerate(rows) if r[1] != "r5"] + [(p, "r9", "q1", 1.0, 1.0) for p in "ABCDEF"]
    after, other = digests(spark.createDataFrame(changed, SCHEMA))
    got = {r["difference"]: r["unit_key"] for r in coverage.digest_differences(before, after).collect()}
    assert root != other and coverage.digest_differences(before, after).count() == 3
    assert "r3" in got["changed"] and "r5" in got["missing"] and "r9" in got["added"]
    assert coverage.digest_differences(before, before).count() == 0


def test_exact_parts_cut_at_the_point(spark):
    """Whole numbers leave nothing to a cast from double to decimal; the parts still make the number."""
    from peerlens.functions.scalar import as_double, exact_parts

    values = [12345.67, -12345.67, 7.0, 0.0, 1e20, 2.0**53]
    whole, rest = exact_parts(F.col("x"))
    rows = spark.createDataFrame([(v,) for v in values], "x double").select("x", whole.alias("w"), rest.alias("r"), as_double(whole, rest).alias("d")).collect()
    assert [int(r["w"]) for r in rows[:4]] == [12345, -12345, 7, 0] and all(r["d"] == r["x"] for r in rows)
    strange = spark.createDataFrame([(float("inf"),), (float("nan"),), (None,)], "x double").select(whole.alias("w"), rest.alias("r")).collect()
    assert all(r["w"] is None and r["r"] is None for r in strange)
