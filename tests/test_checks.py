"""A whole validation reads the facts once, and its issues say where they are."""

import pytest

from peerlens import Roles
from peerlens.operators import quality

SHARE = Roles("e", ("d", "g"), metric="v", time="t", target="A")
RATE = Roles("e", ("d", "g"), total="v", numerators={"x": "n"}, time="t", target="A")


@pytest.fixture
def facts(spark):
    rows = [("A", "k", "p", "1", 50.0, 1.0), ("B", None, "p", "1", 60.0, 2.0), ("C", "k", "q", "1", None, 2.0), ("D", "m", "q", None, -5.0, 2.0),
            (None, "k", "p", "2", 900.0, 2.0), ("F", "k", "p", "2", 99.0, 120.0), ("B", "m", "p", "2", 5000.0, 2.0)]
    return spark.createDataFrame(rows, "e string, d string, g string, t string, v double, n double").repartition(3)


def counted(spark, df):
    passed = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            passed.add(b.num_rows)
            yield b

    return df.mapInArrow(count, df.schema), passed


@pytest.mark.parametrize("validate, roles", [(quality.validate_share_input, SHARE), (quality.validate_rate_input, RATE)])
def test_facts_are_read_once(spark, facts, validate, roles):
    df, passed = counted(spark, facts)
    issues = validate(df, roles)
    assert len(issues.collect()) > 3 and issues.count() > 3
    assert passed.value == 7


def test_issues_by_hand(spark, facts):
    share = {(r["check"], r["subject"]): r for r in quality.validate_share_input(facts, SHARE).collect()}
    assert share["null_values", "v"]["n_rows"] == 1 and share["null_values", "e"]["pct"] == pytest.approx(100 / 7)
    assert share["negative_values", "v"]["severity"] == "ERROR" and share["insufficient_peers", "e"]["n_rows"] == 4
    assert share["high_concentration", "B"]["pct"] == pytest.approx(5060 / (5000 + 60 + 50 + 99 - 5) * 100)
    assert share["small_categories", "d"]["details"] == {"examples": "m"} and share["small_categories", "g"]["details"] == {"examples": "q"}
    rate = {(r["check"], r["subject"]): r for r in quality.validate_rate_input(facts, RATE).collect()}
    assert rate["low_denominator", "v"]["n_rows"] == 3 and rate["low_denominator", "v"]["details"] == {"d": "k=2,<missing>=1", "g": "p=3"}
    assert rate["invalid_rate", "x"]["n_rows"] == 2 and rate["null_values", "v"]["details"] is None
    alone = quality.check_low_denominator(facts, RATE).first()
    assert alone["details"] == rate["low_denominator", "v"]["details"] and alone["n_rows"] == 3


def test_validations_of_an_empty_table(spark, facts):
    assert [r["check"] for r in quality.validate_share_input(facts.where("false"), SHARE).collect()] == ["insufficient_peers"]
    assert [r["check"] for r in quality.validate_rate_input(facts.where("false"), RATE).collect()] == ["insufficient_peers"]


def test_no_dimensions(spark, facts):
    got = {r["check"] for r in quality.validate_share_input(facts, Roles("e", (), metric="v")).collect()}
    assert got == {"null_values", "negative_values", "high_concentration"}
