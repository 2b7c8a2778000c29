import random

import pytest
from pyspark.sql import functions as F

from peerlens.operators import audit, coverage, rules, suppression, weights
from peerlens.operators.cells import CELL, cell_shares, governed_cells
from peerlens.plans import strategy
from peerlens.roles import Roles
from tests.fixtures import SHARE, TIMED, facts, rows_of


def verdict(spark, shares, rule):
    df = spark.createDataFrame([("g", float(s)) for s in shares], "g string, share double")
    return rows_of(rules.evaluate_rules(df, ["g"]), "rule")[(rule,)]


@pytest.mark.parametrize(
    "rule, shares, passed",
    [
        ("5/25", [25, 25, 25, 20, 5], True),
        ("5/25", [25.00001, 24.99999, 25, 20, 5], False),
        ("5/25", [25, 25, 25, 25], False),
        ("6/30", [30, 30, 20, 10, 6, 4], True),
        ("6/30", [30, 30, 28, 4, 4, 4], True),
        ("6/30", [30, 30, 6.9, 6.9, 6.9, 6.9], False),
        ("7/35", [35, 20, 15, 10, 8, 7, 5], True),
        ("7/35", [35, 14, 14, 14, 9, 7, 7], False),
        ("10/40", [40, 20, 10, 5, 5, 5, 5, 4, 3, 3], True),
        ("10/40", [40, 20, 9, 9, 6, 5, 4, 3, 2, 2], False),
        ("4/35", [35, 35, 20, 10], True),
    ],
)
def test_rule_boundaries(spark, rule, shares, passed):
    assert verdict(spark, shares, rule)["strict_passed"] is passed


def test_applicable_and_undominated(spark):
    df = spark.createDataFrame([(4,), (6,), (12,)], "n int")
    got = {
        r["n"]: (
            [x["rule"] for x in r["a"]],
            [x["rule"] for x in r["b"]],
            r["chosen"],
        )
        for r in df.select(
            "n",
            rules.applicable(F.col("n"), True).alias("a"),
            rules.undominated(rules.applicable(F.col("n"), True)).alias("b"),
            rules.select_rule(F.col("n"), True).alias("chosen"),
        ).collect()
    }
    assert got[4] == (["4/35"], ["4/35"], "4/35")
    assert got[6] == (["5/25", "6/30", "4/35"], ["4/35"], "6/30")
    assert got[12][1:] == (["10/40", "4/35"], "10/40")


def test_sweep_statuses(spark):
    base = dict(
        contains_peer_data=True, merchant_scope=False, metric_context="issuer_spend",
        concentration_basis="volume", participants=5, max_share=25.0, n_7=5, n_8=5, n_10=4, n_15=4,
        n_20=3, protected_included=False, competitor_receives=False, protected_share=None,
    )
    cases = [
        ("ok", {}),
        ("none", {"contains_peer_data": False}),
        ("high", {"max_share": 40.0, "n_7": 3, "n_8": 3, "n_10": 3, "n_15": 2, "n_20": 2}),
        ("blocked", {"protected_included": True, "competitor_receives": True, "protected_share": 25.01, "max_share": 25.0}),
        ("missing", {"n_10": None}),
        ("over", {"max_share": 101.0}),
        ("basis", {"metric_context": "issuer_fraud"}),
    ]
    columns = list(base)
    df = spark.createDataFrame(
        [tuple([name] + [({**base, **change})[c] for c in columns]) for name, change in cases],
        "name string, contains_peer_data boolean, merchant_scope boolean, metric_context string, concentration_basis string, "
        "participants bigint, max_share double, n_7 bigint, n_8 bigint, n_10 bigint, n_15 bigint, n_20 bigint, "
        "protected_included boolean, competitor_receives boolean, protected_share double",
    )
    got = rows_of(rules.rule_sweep(df, ["name"]), "name")
    assert got[("ok",)]["status"] == "compliant" and got[("ok",)]["authorizing"] == "5/25"
    assert got[("none",)]["status"] == "not_subject"
    assert got[("high",)]["status"] == "noncompliant"
    # A protected share above the largest share contradicts itself.
    assert got[("blocked",)]["status"] == "invalid"
    assert "missing_evidence:n_10" in got[("missing",)]["failures"]
    assert "over_100_evidence:max_share" in got[("over",)]["failures"]
    assert got[("basis",)]["failures"] == "incorrect_concentration_basis"


def test_cap_entities_matches_the_round_by_round_definition(spark):
    values = {"A": 700.0, "B": 200.0, "C": 60.0, "D": 40.0}
    df = spark.createDataFrame([("g", p, v) for p, v in values.items()], "g string, peer string, v double")
    got = rows_of(rules.cap_entities(df, ["g"], 35.0), "peer")
    current, factor = dict(values), {p: 1.0 for p in values}
    for _ in range(10):
        limit = sum(current.values()) * (0.35 - 0.0001)
        over = [p for p, v in current.items() if v > limit]
        if not over:
            break
        for p in over:
            factor[p] = limit / current[p]
            current[p] = limit
    for p in values:
        assert got[(p,)]["v"] == pytest.approx(current[p])
        assert got[(p,)]["adjustment_factor"] == pytest.approx(factor[p])


def test_thin_cells_and_wildcard(spark):
    df = spark.createDataFrame(
        [("A", "x", "m1", 1.0), ("B", "x", "m1", 1.0), ("A", "x", "m2", 1.0), ("B", "x", "m2", 0.0),
         ("A", "y", "m1", 1.0), ("A", None, "m1", 1.0), ("B", None, "m1", 2.0)],
        "issuer string, d string, m string, v double",
    )
    roles = Roles("issuer", ("d",), metric="v", time="m")
    infeasible = spark.createDataFrame([("d", "x"), ("d", "y")], "dimension string, category string")
    records = suppression.suppress_thin_cells(df, roles, 2, infeasible)
    got = {(r["category"], r["time_period"]): (r["participants"], r["reason"]) for r in records.collect()}
    assert got == {
        ("x", "m2"): (1, "below_min_entities"),
        ("y", "m1"): (1, "below_min_entities"),
        ("y", None): (1, "below_min_entities"),
        ("x", None): (0, "structurally_infeasible"),
    }
    rows = spark.createDataFrame(
        [("d", "x", "m1"), ("d", "x", "m2"), ("d", "y", "m9"), ("d", None, "m1"), ("e", "y", "m1")],
        "dimension string, category string, time_period string",
    )
    thin = suppression.suppress_thin_cells(df, roles, 2)
    kept = {tuple(r) for r in suppression.filter_suppressed(rows, thin).collect()}
    assert kept == {("d", "x", "m1"), ("d", None, "m1"), ("e", "y", "m1")}


def fit(spark, cells, cap, **more):
    runs = cells.select(
        F.lit("r").alias("run_id"), *CELL, "peer", "v", F.lit(cap).alias("cap"), F.lit(5).alias("min_entities")
    )
    return strategy.fit_for_runs(runs, runs.select("run_id", "peer").distinct(), **more)


def test_fit_keeps_caps_bounds_and_mean(spark):
    cells = governed_cells(facts(spark), TIMED)
    table = fit(spark, cells, 35.0, tolerance=0.0)
    placed = weights.attach_weights(cells, table.drop("run_id"))
    assert cell_shares(placed).agg(F.max("share")).first()[0] <= 35.0 + 1e-5
    stats = table.agg(F.min("multiplier"), F.max("multiplier"), F.avg("multiplier")).first()
    assert stats[0] >= 0.01 and stats[1] <= 10.0 and stats[2] == pytest.approx(1.0)


def test_fit_ignores_cells_that_nothing_can_fix(spark):
    cells = spark.createDataFrame(
        [("d", "x", None, "A", 1.0), ("d", "x", None, "B", 99.0)]
        + [("d", "y", None, p, 20.0) for p in "ABCDE"],
        "dimension string, category string, time_period string, peer string, v double",
    )
    table = fit(spark, cells, 25.0)
    assert weights.weights_are_identity(table).first()["identity"] is True


def test_waterfill_reaches_the_mean(spark):
    df = spark.createDataFrame([("r", p, m) for p, m in (("A", 9.0), ("B", 0.5), ("C", 0.4), ("D", 0.1))], "run_id string, peer string, m double")
    out = [r["m"] for r in weights.waterfill_mean(df, ["run_id"], 0.05, 2.0).collect()]
    assert sum(out) / 4 == pytest.approx(1.0) and max(out) <= 2.0 and min(out) >= 0.05


def test_audit_accounts_for_every_peer_and_time_totals_once(spark):
    df = facts(spark).where(~((F.col("issuer") == "P6") & (F.col("card") == "DEBIT")))
    cells = governed_cells(df, TIMED)
    volumes = df.where("issuer <> 'Target'").groupBy(F.col("issuer").alias("peer")).agg(F.sum("txn").alias("volume"))
    out = audit.privacy_validation(cells, volumes, None, rules.rule_named("6/30"), dynamic=False)
    per_cell = out.groupBy(*CELL).agg(F.sum("peers").alias("n"), F.sum("balanced_share_pct").alias("s")).collect()
    assert all(r["n"] == 6 and r["s"] == pytest.approx(100.0) for r in per_cell)
    assert len(per_cell) == 2 * (2 + 2 + 1)
    absent = out.where("peer is null")
    assert {(r["category"], r["peers"], r["original_volume"]) for r in absent.collect()} == {("DEBIT", 1, 0.0)}
    counts = audit.strict_validation_counts(out).first()
    assert counts["rows"] == 60 and counts["participant_fail_categories"] == 0


# Coverage -----------------------------------------------------------------------

COVER = Roles("issuer", ("region",), metric="amount", secondary=("cnt",), time="q")


def coverage_facts(spark):
    """Safe, one peer at 70 percent, and safe on the amount but 80 percent on the count."""
    rows = []
    for i, p in enumerate("ABCDEF"):
        even = 100.0 + i
        rows += [
            (p, "safe", "q1", even, even),
            (p, "dominated", "q1", 1200.0 if p == "A" else 100.0, even),
            (p, "hidden", "q1", even, 2000.0 if p == "B" else 100.0),
        ]
    return spark.createDataFrame(rows, "issuer string, region string, q string, amount double, cnt double")


def neutral(volumes):
    return volumes.select("peer").distinct().select("peer", F.lit(1.0).alias("w"))


def test_release_is_exact_and_verifies(spark):
    volumes = coverage.unit_volumes(coverage_facts(spark), COVER)
    units = coverage.candidate_units(volumes)
    partition = coverage.release_partition(volumes, units, neutral(volumes))
    got = {r["category"]: (r["released"], r["authorizing_rule"]) for r in partition.collect()}
    assert got == {"safe": (True, "5/25"), "dominated": (False, None), "hidden": (False, None)}
    failures = coverage.verify_release(volumes, units, partition, neutral(volumes), 0.5, 2.0)
    assert failures.agg(F.sum("n")).first()[0] == 0
    assert coverage.release_decision(failures, partition, search_complete=True).first()["authorized"] is True


@pytest.mark.parametrize(
    "change, code",
    [
        (lambda p: p.withColumn("released", F.lit(True)), "weight_partition_mismatch"),
        (lambda p: p.withColumn("released", F.lit(False)), "hidden_passing_unit"),
        (lambda p: p.withColumn("authorizing_rule", F.lit("9/99")), "authorizing_rule_unknown"),
        (lambda p: p.withColumn("authorizing_rule", F.lit("10/40")), "authorizing_rule_inapplicable"),
        (lambda p: p.where("category <> 'hidden'"), "release_partition_mismatch"),
        (lambda p: p.unionByName(p.where("released")), "duplicate_release_key"),
    ],
)
def test_tampering_is_found(spark, change, code):
    volumes = coverage.unit_volumes(coverage_facts(spark), COVER)
    units = coverage.candidate_units(volumes)
    partition = coverage.release_partition(volumes, units, neutral(volumes))
    found = coverage.verify_release(volumes, units, change(partition), neutral(volumes), 0.5, 2.0)
    assert found.where((F.col("code") == code) & (F.col("n") > 0)).count() == 1


def test_weight_and_digest_tampering(spark):
    volumes = coverage.unit_volumes(coverage_facts(spark), COVER)
    units = coverage.candidate_units(volumes)
    partition = coverage.release_partition(volumes, units, neutral(volumes))
    digest = coverage.universe_digest(volumes, units)
    changed = volumes.withColumn("v", F.when(F.col("peer") == "A", F.col("v") + 0.5).otherwise(F.col("v")))
    heavy = neutral(volumes).withColumn("w", F.when(F.col("peer") == "A", 3.0).when(F.col("peer") == "B", float("nan")).otherwise(1.0))
    codes = {
        r["code"]
        for r in coverage.verify_release(changed, units, partition, heavy, 0.5, 2.0, recorded_digest=digest)
        .where("n > 0")
        .collect()
    }
    assert {"weight_out_of_bounds", "weight_nonfinite", "universe_digest_mismatch"} <= codes
    lost = coverage.verify_release(volumes, units, partition, neutral(volumes).where("peer <> 'C'"), 0.5, 2.0)
    assert lost.where("code = 'weight_missing' and n > 0").count() == 1


def test_bad_volumes_are_refused(spark):
    df = coverage_facts(spark).withColumn("amount", F.when(F.col("issuer") == "A", -1.0).otherwise(F.col("amount")))
    with pytest.raises(Exception, match="finite and non-negative"):
        coverage.unit_volumes(df, COVER).collect()


def test_interval_classes_agree_with_sampled_weights(spark):
    rng = random.Random(7)
    cases = [(rng.random(), cap) for cap in (25.0, 30.0, 35.0, 40.0) for _ in range(40)]
    df = spark.createDataFrame(cases, "f double, cap double")
    out = df.select(
        "f", "cap",
        coverage.classify_cap(F.col("f"), F.col("cap"), 0.5, 2.0).alias("c"),
        coverage.classify_tier_witness(F.col("f"), F.col("cap"), 0.5, 2.0).alias("t"),
    ).collect()
    for r in out:
        for _ in range(60):
            own, others = rng.uniform(0.5, 2), rng.uniform(0.5, 2)
            share = 100 * r["f"] * own / (r["f"] * own + (1 - r["f"]) * others)
            if r["c"] != "uncertain":
                assert (share <= r["cap"] + 1e-6) == (r["c"] == "always")
            if r["t"] != "uncertain":
                assert (share + 1e-6 >= r["cap"]) == (r["t"] == "always")


def test_coordinate_scores_equal_full_scoring(spark):
    rng = random.Random(3)
    rows = [
        (p, f"r{u}", "q1", rng.expovariate(0.01) + 1, rng.expovariate(0.01) + 1)
        for u in range(12) for p in "ABCDEFGHIJK" if rng.random() < 0.85
    ]
    df = spark.createDataFrame(rows, "issuer string, region string, q string, amount double, cnt double")
    volumes = coverage.unit_volumes(df, COVER)
    units = coverage.candidate_units(volumes)
    start = volumes.select("peer").distinct().select("peer", (0.7 + F.pmod(F.hash("peer"), F.lit(5)) / 10.0).alias("w"))
    moves = coverage.coordinate_scores(volumes, units, start, 0.5, 2.0, grid_size=5, overlay_entity="B").collect()
    base = {r["peer"]: r["w"] for r in start.collect()}
    vectors, names = [], {}
    for i, m in enumerate(moves):
        names[i] = (m["peer"], m["grid"])
        vectors += [(i, p, m["w"] if p == m["peer"] else w) for p, w in base.items()]
    vectors += [(-1, p, w) for p, w in base.items()]
    candidates = spark.createDataFrame(vectors, "cand int, peer string, w double")
    scores = {r["cand"]: r["score"] for r in coverage.score_candidates(volumes, units, candidates, "B").collect()}
    for i, m in enumerate(moves):
        assert m["gain"] == scores[i] - scores[-1], names[i]


def test_refined_weights_release_no_less_than_neutral(spark):
    volumes = coverage.unit_volumes(coverage_facts(spark), COVER)
    units = coverage.candidate_units(volumes)
    found = coverage.refine_weights(volumes, units, neutral(volumes), 0.25, 4.0, samples=8, sweeps=2)
    released = coverage.release_partition(volumes, units, found).where("released").count()
    assert released >= 1
    assert found.where("w < 0.25 - 1e-9 or w > 4.0 + 1e-9").count() == 0


def test_subset_search_prefers_the_largest_feasible(spark):
    rows = [(p, p, "all", 10.0) for p in "ABCDEF"]
    df = spark.createDataFrame(rows, "issuer string, bad string, good string, v double")
    roles = Roles("issuer", ("bad", "good"), metric="v")
    out = rows_of(strategy.search_dimension_subsets(df, roles, 25.0, 5, rounds=2), "dimensions")
    assert out[("good",)]["best"] is True and out[("bad,good",)]["feasible"] is False
    chain = strategy.search_dimension_subsets(df, roles, 25.0, 5, rounds=2, greedy=True)
    assert {r["dimensions"] for r in chain.collect()} == {"bad,good", "good"}
    assert [r[0] for r in strategy.removed_dimensions(chain, roles.dimensions).collect()] == ["bad"]


def test_strategy_by_peer_count(spark):
    out = strategy.single_rule_outcome(facts(spark), SHARE).first()
    assert out["rule"] == "6/30" and out["governed_groups"] == 4
