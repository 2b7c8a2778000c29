"""Whole runs: one scan, the rule and its fit, what is kept back, and the verdict."""

import pytest

from peerlens import Roles
from peerlens.plans import run

SHARE = Roles("e", ("d",), metric="v", time="t", target="T")
RATE = Roles("e", ("d",), total="v", numerators={"x": "n"}, time="t", target="T")


def facts(spark, peers="ABCDEFGH", heavy=3.0, thin=True):
    rows = []
    for t in ("2024-01", "2024-02"):
        for p in (*peers, "T"):
            for d in ("k", "m"):
                rows += [(p, d, t, (heavy if p == "A" and d == "k" else 1.0) * 300.0, 30.0)] * 3
            if thin and p in "ABT":
                rows += [(p, "z", t, 200.0, 20.0)] * 2
    return spark.createDataFrame(rows, "e string, d string, t string, v double, n double").repartition(3)


@pytest.mark.parametrize("whole, roles", [(run.run_share, SHARE), (run.run_rate, RATE)])
def test_a_run_reads_the_facts_once(spark, whole, roles):
    df, passed = facts(spark), spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            passed.add(b.num_rows)
            yield b

    out = whole(df.mapInArrow(count, df.schema), roles)
    for table in (out.issues, out.weights, out.records, out.results, out.impact, out.export, out.verdict):
        table.collect()
    assert passed.value == df.count()


def test_share_run_by_hand(spark):
    out = run.run_share(facts(spark), SHARE)
    assert out.rule == "7/35"
    weights = {r["peer"]: r["multiplier"] for r in out.weights.collect()}
    assert set(weights) == set("ABCDEFGH") and all(w == pytest.approx(1.0) for w in weights.values())
    # Peers A and B alone are in z: kept back in every table, as are its periods together.
    assert {(r["category"], r["time_period"]) for r in out.records.collect()} == {("z", "2024-01"), ("z", "2024-02"), ("z", None)}
    for table in (out.results, out.impact, out.export):
        assert {r["category"] for r in table.collect()} == {"k", "m"}
    shown = {(r["category"], r["time_period"]): r for r in out.results.collect()}
    assert shown["k", "2024-01"]["original_total_volume"] == pytest.approx(900 * 7 + 2700)
    verdict = out.verdict.first()
    # In k: A has 30 percent, the others 10, so not two have 15; in m nobody has; whole periods as well.
    assert (verdict["errors"], verdict["cap_failures"], verdict["verdict"]) == (0, 0, "best_effort")
    assert verdict["governed_cells"] == 6 and verdict["rule_failures"] == 6


def test_a_heavy_peer_is_brought_under_the_cap(spark):
    out = run.run_share(facts(spark, heavy=9.0, thin=False), SHARE)
    weights = {r["peer"]: r["multiplier"] for r in out.weights.collect()}
    own, others = 9 * weights["A"], sum(w for p, w in weights.items() if p != "A")
    assert own / (own + others) == pytest.approx(0.35) and out.verdict.first()["cap_failures"] == 0


def test_too_few_peers_publish_nothing(spark):
    for whole, roles in ((run.run_share, SHARE), (run.run_rate, RATE)):
        out = whole(facts(spark, peers="ABC"), roles)
        assert out.rule == "insufficient" and out.verdict.first()["verdict"] == "blocked"
        assert out.results.count() == out.impact.count() == out.export.count() == out.weights.count() == 0


def test_input_errors_block(spark):
    df = facts(spark)
    bad = df.unionByName(spark.createDataFrame([("A", "k", "2024-01", -1.0, 0.0)], df.schema))
    verdict = run.run_share(bad, SHARE).verdict.first()
    assert verdict["errors"] == 1 and verdict["verdict"] == "blocked"
