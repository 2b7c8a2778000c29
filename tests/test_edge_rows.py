"""Rows that tidy tables do not have: unusable facts, peers without a weight, rules beyond the standard ones."""

import pytest
from pyspark.sql import functions as F

from peerlens import Roles
from peerlens.functions.scalar import bps_columns
from peerlens.operators import cells, coverage, impact, rules
from peerlens.sources import files

ROLES = Roles("issuer", ("card",), metric="txn", target="T")


def test_impact_on_a_prepared_table_leaves_unusable_rows_out(spark):
    facts = spark.createDataFrame(
        [("T", "x", 100.0), ("T", "x", -50.0), ("P", "x", 100.0), ("Q", "x", -40.0), ("Q", "x", None), ("P", "y", -1.0)],
        "issuer string, card string, txn double",
    )
    plain = impact.share_impact(facts, ROLES, None).orderBy("category").collect()
    prepared = impact.share_impact(cells.prepare_cells(facts, ROLES, ["txn"]), ROLES, None).orderBy("category").collect()
    assert plain == prepared and plain[0]["raw_share_pct"] == pytest.approx(50.0) and len(plain) == 1


def test_a_rule_of_ones_own_gets_a_verdict(spark):
    own = (rules.Rule("4/45", 4, 45.0, ((2, 12.0),)),)
    shares = spark.createDataFrame([("a", s) for s in (44.0, 30.0, 13.0, 13.0)] + [("b", s) for s in (46.0, 30.0, 12.0, 12.0)], "g string, share double")
    got = {r["g"]: (r["cap_passed"], r["tiers_passed"], r["strict_passed"]) for r in rules.evaluate_rules(shares, ["g"], own).collect()}
    assert got == {"a": (True, True, True), "b": (False, True, False)}


def test_a_peer_without_weight_counts_with_weight_one(spark):
    names = "ABCDEF"
    volumes = spark.createDataFrame([("d", "c", "2024-01", "m", p, 10.0) for p in names], "dimension string, category string, time_period string, metric string, peer string, v double")
    units = volumes.select("dimension", "category", "time_period").distinct().select(
        "*", F.lit("u").alias("unit_key"), rules.rules_array((rules.rule_named("5/25"),)).alias("rules"))
    some = spark.createDataFrame([(p, 1.0) for p in "ABCD"], "peer string, w double")
    assert coverage.release_partition(volumes, units, some).first()["released"]
    candidates = some.withColumn("cand", F.lit(1))
    assert coverage.score_candidates(volumes, units, candidates).first()["score"] == 1


def test_words_that_are_no_rates():
    names = ["fraud_rate_pct", "fraud_rate_numerator", "fraud_rate_multiplier", "fraud_distortion_rate_pct", "fraud_distance_rate"]
    assert bps_columns(names) == ["fraud_rate_pct", "fraud_distance_rate"]


def test_one_statement_file_only(spark, tmp_path):
    (tmp_path / "a.sql").write_text("SELECT 1 AS x;")
    assert files.read_sql_query(spark, str(tmp_path)).first()[0] == 1
    (tmp_path / "b.sql").write_text("SELECT 2 AS x")
    with pytest.raises(ValueError):
        files.read_sql_query(spark, str(tmp_path))


def test_facts_named_like_cells_are_facts(spark):
    facts = spark.createDataFrame(
        [("T", "x", "a", "b", "c", "d", 1.0)], "issuer string, card string, dimension string, category string, time_period string, peer string, txn double"
    )
    assert not cells.is_prepared(facts)
    assert cells.is_prepared(cells.prepare_cells(facts.drop("dimension", "category", "time_period", "peer"), ROLES, ["txn"]))
