import pytest
from pyspark.sql import functions as F

from peerlens.operators import analysis, balanced, cells, impact, weights
from peerlens.roles import Roles
from tests.fixtures import MONTHS, PEERS, RATE, SHARE, TIMED, facts, rows_of


def flat_weights(spark, **values):
    return spark.createDataFrame(
        [(None, p, m) for p, m in values.items()], "dimension string, peer string, multiplier double"
    )


def test_cells_and_time_totals(spark):
    df = facts(spark)
    timed = rows_of(cells.build_cells_timed(df, TIMED), "dimension", "category", "time_period", "peer")
    one = timed[("card", "CREDIT", MONTHS[0], "P2")]
    assert one["category_volume"] == pytest.approx(120.0)
    assert ("card", "CREDIT", MONTHS[0], "Target") not in timed
    totals = cells.build_time_totals(df, TIMED)
    sums = totals.groupBy("time_period").agg(F.sum("share_pct").alias("s")).collect()
    assert all(r["s"] == pytest.approx(100.0) for r in sums)


def test_prepared_table_gives_the_same_results(spark):
    df = facts(spark).withColumn("card", F.when(F.col("issuer") != "P3", F.col("card")))
    prepared = cells.prepare_cells(df, TIMED, ["txn"])
    for run in (analysis.share_analysis, impact.share_impact):
        extra = (None,) if run is impact.share_impact else ()
        a = sorted(map(str, run(df, TIMED, *extra).select(*sorted(run(df, TIMED, *extra).columns)).collect()))
        b = sorted(map(str, run(prepared, TIMED, *extra).select(*sorted(run(df, TIMED, *extra).columns)).collect()))
        assert a == b
    assert rows_of(cells.peer_volumes(df, SHARE), "peer") == rows_of(cells.peer_volumes(prepared, SHARE), "peer")


def test_share_analysis_by_hand(spark):
    df = spark.createDataFrame(
        [("A", "x", 30.0), ("A", "y", 70.0), ("B", "y", 50.0), ("C", "x", 10.0), ("T", "x", 5.0), ("T", "y", 5.0)],
        "issuer string, d string, v double",
    )
    roles = Roles("issuer", ("d",), metric="v", target="T")
    table = flat_weights(spark, A=0.5, B=2.0)
    got = rows_of(analysis.share_analysis(df, roles, table), "category")
    x = got[("x",)]
    # Numerator 0.5*30 + 10, denominator 0.5*100 + 2*50 + 10; absent B counts with share 0.
    assert x["balanced_peer_average_pct"] == pytest.approx(25.0 / 160.0 * 100)
    assert x["original_peer_average_pct"] == pytest.approx(40.0 / 160.0 * 100)
    # Shares 0 (weight 100), 30 (50), 100 (10): 85 % of 160 is 136.
    assert x["bic_pct"] == pytest.approx(30.0)
    assert x["target_share_pct"] == pytest.approx(50.0)


def test_category_without_peers_is_omitted(spark):
    df = spark.createDataFrame([("A", "x", 1.0), ("T", "z", 5.0)], "issuer string, d string, v double")
    roles = Roles("issuer", ("d",), metric="v", target="T")
    assert [r["category"] for r in analysis.share_analysis(df, roles).collect()] == ["x"]


def test_null_labels_vanish_but_null_periods_count_in_general(spark):
    df = spark.createDataFrame(
        [("A", "x", "m1", 1.0), ("A", None, "m1", 9.0), ("B", "x", None, 4.0), (None, "x", "m1", 100.0)],
        "issuer string, d string, m string, v double",
    )
    roles = Roles("issuer", ("d",), metric="v", time="m")
    got = rows_of(analysis.share_analysis(df, roles), "category", "time_period")
    assert set(got) == {("x", "m1"), ("x", "General")}
    assert got[("x", "General")]["original_total_volume"] == 5.0


def test_rate_analysis_uses_its_percentile_per_rate(spark):
    df = spark.createDataFrame(
        [(p, "x", 100.0, a, f) for p, a, f in (("A", 90.0, 1.0), ("B", 80.0, 2.0), ("C", 70.0, 3.0), ("T", 50.0, 9.0))],
        "issuer string, d string, total double, ok double, bad double",
    )
    roles = Roles("issuer", ("d",), total="total", numerators={"approval": "ok", "fraud": "bad"}, target="T")
    got = rows_of(analysis.rate_analysis(df, roles), "rate")
    assert got[("approval",)]["bic_pct"] == 90.0
    assert got[("fraud",)]["bic_pct"] == 1.0
    assert got[("approval",)]["distance_to_peer_pp"] == pytest.approx(-30.0)


def test_impact_is_zero_without_weights_and_signed_with(spark):
    df = facts(spark)
    none = impact.share_impact(df, TIMED, None)
    assert none.where(F.abs("impact_pp") > 1e-12).count() == 0
    lighter = impact.share_impact(df, TIMED, flat_weights(spark, P1=0.5))
    assert lighter.where(F.col("impact_pp") <= 0).count() == 0
    summary = rows_of(impact.impact_summary(lighter), "aggregation", "level")
    assert set(summary) == {
        ("Overall", "All Data"), ("By Dimension", "card"), ("By Dimension", "channel"),
        ("By Time Period", MONTHS[0]), ("By Time Period", MONTHS[1]),
    }


def test_results_do_not_depend_on_row_order_partitions_or_split_rows(spark):
    df = facts(spark)
    halves = df.withColumn("txn", F.col("txn") / 2)
    variants = [df, df.repartition(13), df.orderBy(F.rand(3)), halves.unionByName(halves)]
    outputs = []
    for v in variants:
        out = analysis.share_analysis(v, TIMED, flat_weights(spark, P1=0.4, P4=1.7))
        rounded = out.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])
        outputs.append(sorted(map(str, rounded.collect())))
    assert all(o == outputs[0] for o in outputs)


def test_shares_of_a_period_sum_to_100(spark):
    out = analysis.share_analysis(facts(spark), TIMED, flat_weights(spark, P1=0.3))
    sums = out.groupBy("dimension", "time_period").agg(F.sum("balanced_peer_average_pct").alias("s"))
    assert all(r["s"] == pytest.approx(100.0) for r in sums.collect())


def test_weights_order_of_precedence(spark):
    table = spark.createDataFrame(
        [(None, "A", 0.5), ("d", "A", 3.0), (None, "B", 2.0)], "dimension string, peer string, multiplier double"
    )
    rows = spark.createDataFrame(
        [("d", "A"), ("e", "A"), ("e", "B"), ("e", "C")], "dimension string, peer string"
    )
    got = {(r["dimension"], r["peer"]): r["m"] for r in weights.attach_weights(rows, table).collect()}
    assert got == {("d", "A"): 3.0, ("e", "A"): 0.5, ("e", "B"): 2.0, ("e", "C"): 1.0}


def test_balanced_rate_export_hides_what_is_suppressed(spark):
    df = facts(spark)
    hidden = spark.createDataFrame(
        [("card", "CREDIT", None, "approval"), ("card", "CREDIT", MONTHS[0], "fraud")],
        "dimension string, category string, time_period string, output string",
    )
    out = balanced.balanced_export_rate(df, RATE, None, suppressed_outputs=hidden)
    got = rows_of(out, "dimension", "category", "time_period")
    assert ("card", "CREDIT", MONTHS[0]) not in got
    assert got[("card", "CREDIT", MONTHS[1])]["approved"] is None
    assert got[("card", "CREDIT", MONTHS[1])]["total"] is not None
    assert got[("card", "DEBIT", MONTHS[0])]["approved"] == pytest.approx(
        sum(n * 0.4 * 2 * 1.8 for p, n in PEERS.items() if p != "P1") + 400 * 0.4 * 2.5 * 1.8
    )
