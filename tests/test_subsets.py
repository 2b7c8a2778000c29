"""The level-wise subset search against fitting every subset."""

import json
from itertools import combinations

import pytest

from peerlens import Roles
from peerlens.operators.cells import governed_cells
from peerlens.plans import strategy

DIMS = ("a", "b", "c,x", "d", "e", "f")
ROLES = Roles("issuer", DIMS, metric="v", time="t")


@pytest.fixture(scope="module")
def facts(spark):
    """Six dimensions: one with thin cells, and two that fit alone but clash, as too many peers give way."""
    rows = []
    for n, peer in enumerate("ABCDEFGH"):
        for t in ("2024-01", "2024-02"):
            for i in range(60):
                row = {d: "xyz"[(i // 3**k + n) % 3] for k, d in enumerate(DIMS[:3])} | {"f": "xyz"[i % 3]}
                row["b"] = "x" if peer in "ABCD" else "y"
                rare = "x" if i % 10 == 0 else "yz"[i % 2]
                row["d"] = "x" if peer in "AB" else rare
                row["e"] = "x" if peer in "CD" else rare
                rows.append((peer, t, *[row[d] for d in DIMS], 1.0))
    names = ", ".join(f"`{d}` string" for d in DIMS)
    return spark.createDataFrame(rows, f"issuer string, t string, {names}, v double").cache()


def attempts(df, **kw):
    rows = strategy.search_dimension_subsets(df, ROLES, 20.0, 5, **kw).collect()
    return {tuple(r["dims"]): r for r in rows}, rows


def test_levels_find_what_full_enumeration_finds(spark, facts):
    everything = [tuple(sorted(s)) for size in range(1, 7) for s in combinations(DIMS, size)]
    log = strategy.fit_subsets(governed_cells(facts, ROLES).cache(), everything, 20.0, 5).collect()
    fits = {tuple(json.loads(r["run_id"])): r["over_cap_rows"] == 0 and r["thin_cells"] == 0 for r in log}
    assert len(fits) == 63 and 1 < sum(fits.values()) < 63
    # A set with a part that does not fit does not fit.
    assert not any(fits[s] and not fits[p] for s in fits for p in fits if set(p) < set(s))
    got, rows = attempts(facts)
    assert len(got) == len(rows) < 63 and not any(r["cut"] for r in rows)
    assert all(r["feasible"] == fits[s] for s, r in got.items())
    assert {s for s in fits if fits[s]} == {s for s, r in got.items() if r["feasible"]}
    most = max(len(s) for s in fits if fits[s])
    assert [s for s, r in got.items() if r["best"]] == [min(s for s in fits if fits[s] and len(s) == most)]


def test_a_cut_search_says_so(facts):
    got, rows = attempts(facts, max_tests=8)
    assert len(rows) == 8 and all(r["cut"] for r in rows)
    assert not any(r["cut"] for r in attempts(facts, max_tests=7, greedy=True)[1])
    assert all(r["cut"] for r in attempts(facts, max_tests=2, greedy=True)[1])


def test_greedy_drops_the_most_unbalanced_first(spark, facts):
    got, rows = attempts(facts, greedy=True)
    assert sorted(len(s) for s in got) == [1, 2, 3, 4, 5, 6]
    sizes = {len(s): set(s) for s in got}
    assert "d" in sizes[6] and "d" not in sizes[5] and "e" not in sizes[4]
    best = next(r for r in rows if r["best"])
    log = strategy.search_dimension_subsets(facts, ROLES, 20.0, 5, greedy=True)
    gone = {r["dimension"] for r in strategy.removed_dimensions(log, DIMS).collect()}
    assert gone == set(DIMS) - set(best["dims"])


def test_thin_cells_do_not_fit(spark):
    """A category with fewer peers than the minimum, though no cap is broken; periods count on their own."""
    rows = [(p, t, "x", "u" if p in "ABCDEF" else "v", 1.0) for p in "ABCDEFGHI" for t in ("1", "2")]
    df = spark.createDataFrame(rows, "issuer string, t string, g string, h string, v double")
    roles = Roles("issuer", ("g", "h"), metric="v", time="t")
    got = {r["dimensions"]: r for r in strategy.search_dimension_subsets(df, roles, 50.0, 5).collect()}
    assert got["g"]["best"] and got["h"]["thin_cells"] == 2 and not got["h"]["feasible"] and got["h"]["over_cap_rows"] == 0


def test_levels_are_grown_from_what_fits():
    fit = {("a",), ("b",), ("c",), ("a", "b"), ("a", "c"), ("b", "c")}
    assert strategy.next_level(fit, 3) == [("a", "b", "c")] and strategy.next_level(fit - {("b", "c")}, 3) == []
    assert strategy.next_level({("a",), ("b",)}, 2) == [("a", "b")] and strategy.next_level(set(), 2) == []
