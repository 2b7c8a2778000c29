"""Composite runs: rule strategies, presets and dimension subsets.

Each alternative is a ``run_id``.  All alternatives go through one weight fit and
one evaluation instead of a driver loop over fits.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peerlens.operators.audit import residual_by_run
from peerlens.operators.cells import (
    CELL,
    WHOLE,
    aggregate_cells,
    cell_shares,
    dimension_unbalance,
    governed_cells,
    peers_only,
)
from peerlens.operators.impact import rate_impact_of_cells, share_impact_of_cells
from peerlens.operators.rules import (
    PROTECTED_CAP,
    RULES,
    applicable,
    evaluate_rules,
    select_rule,
)
from peerlens.operators.weights import (
    COMPARISON_EPSILON,
    attach_weights,
    fit_weights,
    fixable_cells,
)
from peerlens.roles import Roles
from peerlens.session import cut_lineage

LOW, HIGH, TOLERANCE = 0.01, 10.0, 1.0


def fit_for_runs(
    runs_cells: DataFrame,
    population: DataFrame,
    *,
    per_dimension: bool = False,
    low: float = LOW,
    high: float = HIGH,
    tolerance: float = TOLERANCE,
    rounds: int | None = None,
) -> DataFrame:
    """Fit every run over the cells it can fix.

    ``runs_cells`` is ``run_id, CELL, peer, v, cap, min_entities``.
    """
    governed = fixable_cells(
        runs_cells, F.col("cap"), F.col("min_entities"), low, high, tolerance, ["run_id"]
    )
    return fit_weights(
        governed.select("run_id", *CELL, "peer", "v", "cap"),
        population,
        per_dimension=per_dimension,
        low=low,
        high=high,
        rounds=rounds,
    )


def per_rule_runs(
    cells: DataFrame, peers: DataFrame, merchant: bool, protected: str | None = None
) -> DataFrame:
    """One run per rule that the peer population may use; a protected peer has its own cap."""
    usable = peers.agg(applicable(F.count("peer"), merchant)).scalar()
    cap = F.when(F.col("peer") == F.lit(protected), F.least(F.col("r.cap"), F.lit(PROTECTED_CAP)))
    return cells.select("*", F.explode(usable).alias("r")).select(
        F.col("r.rule").alias("run_id"), *CELL, "peer", "v", F.coalesce(cap, F.col("r.cap")).alias("cap"),
        "r.min_entities",
    )


def strategy_outcome(
    df: DataFrame,
    roles: Roles,
    *,
    merchant: bool = False,
    protected: str | None = None,
    rounds: int | None = None,
) -> DataFrame:
    """Sweep strategy: a fit per applicable rule, then every rule on the chosen output.

    One row per rule: status of its own fit, whether it is the display rule (the
    rule by peer count if feasible, else the first feasible one), and its verdict
    on the chosen output.  Only positive weighted volumes count, and cells below
    the output rule's minimum are not governed.
    """
    cells = cut_lineage(governed_cells(df, roles))
    peers = cells.select("peer").distinct()
    runs = cut_lineage(per_rule_runs(cells, peers, merchant, protected))
    population = runs.select("run_id", "peer").distinct()
    weights = cut_lineage(fit_for_runs(runs, population, rounds=rounds))
    weighted = attach_weights(
        runs.select("run_id", *CELL, "peer", "v", F.col("min_entities").alias("_min")),
        weights,
        ["run_id"],
    )
    shares = cell_shares(weighted.where(F.col("v") * F.col("m") > 0), ["run_id"])
    # Every rule on the output of every run, over the run's governed groups.
    verdicts = evaluate_rules(shares, ["run_id", "_min", *CELL]).where(
        F.col("participants") >= F.col("_min")
    )
    judged = verdicts.groupBy("run_id", "rule").agg(
        F.min("strict_passed").alias("passed"), F.count("*").alias("groups")
    )
    held = (
        shares.groupBy("run_id", "_min", *CELL)
        .agg(
            F.count("*").alias("_n"),
            F.max(F.when(F.col("peer") == F.lit(protected), F.col("share"))).alias("_p"),
        )
        .where(F.col("_n") >= F.col("_min"))
        .groupBy("run_id")
        .agg(F.coalesce(F.max("_p") <= PROTECTED_CAP + COMPARISON_EPSILON, F.lit(True)).alias("overlay_passed"))
    )
    size = peers.agg(F.count("peer").alias("peers"))
    by_count = size.select(select_rule(F.col("peers"), merchant)).scalar()
    order = F.element_at(
        F.create_map(*[x for i, r in enumerate(RULES) for x in (F.lit(r.name), F.lit(i))]),
        F.col("run_id"),
    )
    own = cut_lineage(judged.join(held, "run_id"))
    feasible = own.where(
        (F.col("run_id") == F.col("rule")) & F.col("passed") & F.col("overlay_passed")
    )
    display = feasible.agg(
        F.min_by(
            "run_id", F.struct((F.col("run_id") != by_count).alias("late"), order.alias("pos"))
        ).alias("display")
    ).scalar()
    chosen = own.withColumn("_display", display).where(F.col("run_id") == F.col("_display")).select(
        "rule", F.col("passed").alias("output_passed"), F.col("overlay_passed").alias("output_overlay")
    )
    attempts = own.where(F.col("run_id") == F.col("rule")).select(
        "rule", F.col("passed").alias("fit_passed"), F.col("overlay_passed").alias("fit_overlay")
    )
    # The rule list is a literal exploded on the one-row population size.
    listed = size.select(
        F.explode(F.array(*[F.lit(r.name) for r in RULES])).alias("rule"),
        F.transform(applicable(F.col("peers"), merchant), lambda r: r["rule"]).alias("_may"),
        display.alias("display_rule"),
    )
    joined = listed.join(attempts, "rule", "left").join(chosen, "rule", "left")
    may = F.array_contains("_may", F.col("rule"))
    return joined.select(
        "rule",
        F.when(~may, "not_applicable")
        .when(F.coalesce("fit_passed", F.lit(False)) & F.coalesce("fit_overlay", F.lit(False)), "feasible")
        .otherwise("infeasible")
        .alias("fit_status"),
        F.coalesce(F.col("rule") == F.col("display_rule"), F.lit(False)).alias("is_display"),
        F.when(~may, "not_applicable")
        .when(F.coalesce("output_passed", F.lit(False)), "passed")
        .otherwise("failed")
        .alias("output_status"),
        (may & F.coalesce("output_passed", F.lit(False)) & F.coalesce("output_overlay", F.lit(False))).alias(
            "authorizing"
        ),
    )


def single_rule_outcome(
    df: DataFrame, roles: Roles, *, merchant: bool = False, rounds: int | None = None
) -> DataFrame:
    """Strategy by peer count: one rule, one fit, one verdict."""
    cells = cut_lineage(governed_cells(df, roles))
    peers = cells.select("peer").distinct()
    name = peers.agg(select_rule(F.count("peer"), merchant)).scalar()
    runs = per_rule_runs(cells, peers, merchant).where(F.col("run_id") == name)
    weights = fit_for_runs(runs, runs.select("run_id", "peer").distinct(), rounds=rounds)
    weighted = attach_weights(runs.withColumnRenamed("min_entities", "_min"), weights, ["run_id"])
    shares = cell_shares(weighted.where(F.col("v") * F.col("m") > 0), ["run_id"])
    verdicts = evaluate_rules(shares, ["run_id", "_min", *CELL]).where(
        (F.col("participants") >= F.col("_min")) & (F.col("rule") == F.col("run_id"))
    )
    return verdicts.groupBy(F.col("run_id").alias("rule")).agg(
        F.min("strict_passed").alias("passed"),
        F.count("*").alias("governed_groups"),
        F.count_if(~F.col("cap_passed")).alias("cap_failures"),
        F.count_if(~F.col("tiers_passed")).alias("tier_failures"),
        F.max("max_share").alias("max_share"),
    )


@dataclass(frozen=True)
class Preset:
    """A named parameter set of the fit.

    A preset whose ``posture`` is ``accuracy_first`` may leave caps broken, so it is run
    only for a caller who says that this is understood.
    """

    name: str
    cap: float
    min_entities: int = 5
    posture: str = "strict"


BLOCKED = "blocked: accuracy_first acknowledgement required"
VARIANTS = (("global", False), ("per_dimension", True))


def preset_comparison(
    df: DataFrame,
    roles: Roles,
    presets: tuple[Preset, ...],
    *,
    rounds: int | None = None,
    acknowledge_accuracy_first: bool = False,
) -> DataFrame:
    """Every preset with global and per-dimension weights, and its impact.

    With numerators in ``roles`` rates are compared, with weights fitted to the total; else
    shares of the metric.  One fit per weight form covers all presets.  Every preset and
    form has a row: ``ok``, ``no_impact`` where there is nothing to compare, or why it was not run.
    """
    rate = bool(roles.numerators)
    columns = [roles.total, *dict.fromkeys(roles.numerators.values())] if rate else [roles.metric]
    usable = df if rate else df.where(F.col(roles.metric) >= 0)
    cells = aggregate_cells(usable, roles, columns, with_whole=False)
    if roles.time:
        cells = cells.where(F.col("time_period").isNotNull())
    cells = cut_lineage(cells.withColumn("v", F.col(columns[0])))
    allowed = [p for p in presets if p.posture != "accuracy_first" or acknowledge_accuracy_first]
    spark = df.sparkSession
    listed = spark.createDataFrame(
        [(p.name, v, "ok" if p in allowed else BLOCKED) for p in presets for v, _ in VARIANTS], "preset string, variant string, status string"
    )
    if not allowed or not roles.dimensions:
        nothing = F.lit(None).cast("double")
        rows = listed if roles.dimensions else listed.where("false")
        return rows.select("preset", "variant", nothing.alias("mean_abs_impact_pp"), nothing.alias("max_abs_impact_pp"), "status")
    each = F.array(
        *[
            F.struct(
                F.lit(p.name).alias("run_id"),
                F.lit(p.cap).alias("cap"),
                F.lit(p.min_entities).alias("min_entities"),
            )
            for p in allowed
        ]
    )
    runs = cut_lineage(cells.select("*", F.explode(each).alias("_p")).select("_p.*", *cells.columns))
    peers = peers_only(runs, roles.target)
    population = peers.select("run_id", "peer").distinct()
    parts = []
    for variant, per_dimension in VARIANTS:
        weights = fit_for_runs(
            peers.select("run_id", *CELL, "peer", "v", "cap", "min_entities"), population, per_dimension=per_dimension, rounds=rounds
        )
        if rate:
            impact = rate_impact_of_cells(runs, roles, weights, ["run_id"])
        else:
            impact = share_impact_of_cells(runs.select("run_id", *CELL, "peer", "v"), roles.target, weights, ["run_id"])
        parts.append(impact.select(F.lit(variant).alias("variant"), "run_id", "impact_pp"))
    size = F.abs(F.col("impact_pp"))
    summary = (
        parts[0]
        .unionByName(parts[1])
        .groupBy(F.col("run_id").alias("preset"), "variant")
        .agg(F.avg(size).alias("mean_abs_impact_pp"), F.max(size).alias("max_abs_impact_pp"))
    )
    missing = (F.col("status") == "ok") & F.col("mean_abs_impact_pp").isNull()
    return listed.join(summary, ["preset", "variant"], "left").select(
        "preset", "variant", "mean_abs_impact_pp", "max_abs_impact_pp", F.when(missing, "no_impact").otherwise(F.col("status")).alias("status")
    )


def best_preset(comparison: DataFrame) -> DataFrame:
    """The successful variant with the least mean impact, ties by name."""
    best = comparison.where(F.col("status") == "ok").agg(
        F.min(F.struct("mean_abs_impact_pp", "preset", "variant")).alias("_b")
    )
    return best.select("_b.preset", "_b.variant", "_b.mean_abs_impact_pp")


Subset = tuple[str, ...]


def next_level(feasible: set[Subset], size: int) -> list[Subset]:
    """The sets of ``size`` dimensions all of whose parts with one fewer are feasible, in canonical order."""
    names = sorted({d for s in feasible for d in s})
    grown = {tuple(sorted({*s, d})) for s in feasible if len(s) == size - 1 for d in names if d not in s}
    return sorted(g for g in grown if all(tuple(x for x in g if x != d) in feasible for d in g))


def fit_subsets(cells: DataFrame, subsets: list[Subset], cap: float, min_entities: int, rounds: int | None = None) -> DataFrame:
    """One row per subset: what a joint fit of its cells leaves over the cap, and its thin cells.

    All subsets are fitted together, each as a run.  Whole-period cells belong to every
    subset.  A cell with some positive peers, but fewer than ``min_entities``, is thin.
    """
    names = [json.dumps(s) for s in subsets]
    tests = F.array(
        *[
            F.struct(F.lit(n).alias("run_id"), F.array(*[F.lit(d) for d in s]).alias("dims"))
            for n, s in zip(names, subsets)
        ]
    )
    mine = F.filter(tests, lambda t: F.array_contains(t["dims"], F.col("dimension")) | (F.col("dimension") == WHOLE))
    runs = cut_lineage(
        cells.select("*", F.explode(mine).alias("_t")).select(
            F.col("_t.run_id").alias("run_id"), *CELL, "peer", "v", F.lit(cap).alias("cap")
        )
    )
    population = runs.select("run_id", "peer").distinct()
    weights = fit_weights(runs, population, low=LOW, high=HIGH, rounds=rounds)
    shares = cell_shares(attach_weights(runs, weights, ["run_id"]), ["run_id"])
    thin = (
        runs.groupBy("run_id", *CELL).agg(F.count_if(F.col("v") > 0).alias("_n"))
        .groupBy("run_id").agg(F.count_if((F.col("_n") > 0) & (F.col("_n") < min_entities)).alias("thin_cells"))
    )
    return residual_by_run(shares, TOLERANCE).join(thin, "run_id")


def search_dimension_subsets(
    df: DataFrame,
    roles: Roles,
    cap: float,
    min_entities: int,
    *,
    max_tests: int = 200,
    rounds: int | None = None,
    greedy: bool = False,
) -> DataFrame:
    """Attempt log of dimension subsets; ``best`` marks the largest one that fits.

    A subset fits if weights exist under which no cell is over the cap and tolerance, and
    it has no thin cell; cells that no weights can fix count, since a subset is wanted that
    avoids them.  More dimensions bind the same weights more, so a set with a part that
    does not fit cannot fit: after the whole set and the single dimensions, each job fits
    the sets of one size all of whose parts fit, until there are none.  So the log holds
    every set up to the border, and what it leaves out does not fit.  ``greedy`` tries the
    chain that drops the most unbalanced dimension each time.  With a time column, cells
    are by period, and whole periods count in every subset.

    No more than ``max_tests`` subsets are tried; ``cut`` says on every row whether some were
    left out for that.  ``dims`` are a subset's dimensions, ``dimensions`` the same as text.
    """
    cells = cut_lineage(governed_cells(df, roles))
    everything = tuple(sorted(roles.dimensions))
    if greedy:
        # One row per dimension to the driver, to order the chain.
        scores = dimension_unbalance(cells.where(F.col("dimension") != WHOLE)).collect()
        order = sorted(scores, key=lambda r: (-r["unbalance_pct"], r["dimension"]))
        names = [r["dimension"] for r in order]
        levels = [[tuple(sorted(names[i:])) for i in range(len(names))]]
    else:
        levels = [list(dict.fromkeys([everything, *[(d,) for d in everything]]))]
    parts, feasible, tried, cut, size = [], set(), 0, False, 1
    while levels:
        level = levels.pop()
        if not greedy:
            level = [s for s in level if s not in feasible]
        cut = cut or len(level) > max_tests - tried
        level = level[: max_tests - tried]
        if not level:
            break
        tried += len(level)
        log = cut_lineage(fit_subsets(cells, level, cap, min_entities, rounds))
        parts.append(log)
        # The names of the subsets of a level that fit reach the driver.
        fitting = log.where((F.col("over_cap_rows") == 0) & (F.col("thin_cells") == 0)).select("run_id").collect()
        feasible |= {tuple(json.loads(r["run_id"])) for r in fitting}
        size += 1
        if not greedy and not cut and everything not in feasible and size < len(everything):
            levels.append(next_level(feasible, size))
    if not parts:
        parts = [cut_lineage(fit_subsets(cells.where("false"), [everything], cap, min_entities, rounds))]
    log = reduce(DataFrame.unionByName, parts).withColumn("dims", F.from_json("run_id", "array<string>"))
    log = log.withColumn("dimensions", F.array_join("dims", ",")).withColumn("size", F.size("dims"))
    fits = (F.col("over_cap_rows") == 0) & (F.col("thin_cells") == 0)
    best = log.where(fits).agg(F.min(F.struct((-F.col("size")).alias("s"), "dims", "run_id"))["run_id"]).scalar()
    return log.select(
        "dims",
        "dimensions",
        "size",
        "over_cap_rows",
        "max_excess_pp",
        "sum_excess_pp",
        "thin_cells",
        fits.alias("feasible"),
        F.coalesce(F.col("run_id") == best, F.lit(False)).alias("best"),
        F.lit(cut).alias("cut"),
    )


def removed_dimensions(attempts: DataFrame, dimensions: tuple[str, ...]) -> DataFrame:
    """Dimensions that the best subset leaves out."""
    chosen = attempts.where("best").select(F.explode("dims").alias("dimension"))
    everything = attempts.select(
        F.explode(F.array(*[F.lit(d) for d in dimensions])).alias("dimension")
    ).distinct()
    return everything.exceptAll(chosen)
