"""A whole run: facts through checks, rule, fit, suppression, analysis, export and verdict.

The facts are read once, into the prepared table; the input checks are counted on the way.
Everything else works on that table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peerlens.operators import analysis, balanced, impact, quality, schema, suppression
from peerlens.operators.cells import CELL, cell_shares, governed_cells, peers_only, prepare_cells
from peerlens.operators.rules import passes, rule_named, select_rule, sweep_evidence
from peerlens.operators.weights import attach_weights
from peerlens.plans.strategy import fit_for_runs
from peerlens.roles import Roles
from peerlens.session import cut_lineage


@dataclass
class Run:
    """What a run gives: ``weights``, ``records`` and the tables are empty where no rule applies."""

    issues: DataFrame
    rule: str
    weights: DataFrame
    records: DataFrame
    results: DataFrame
    impact: DataFrame
    export: DataFrame
    verdict: DataFrame


def run_share(df: DataFrame, roles: Roles, *, merchant: bool = False) -> Run:
    """A share run: every table a report needs, with fitted weights."""
    schema.check_required_columns(df, [c for c in (roles.metric, roles.entity, *roles.dimensions, roles.time) if c])
    checks = quality.share_checks(roles)
    prepared = _prepared(df, roles, [roles.metric], checks)
    issues = cut_lineage(quality.share_issues(_checked(prepared, checks, [roles.metric]), roles, checks))
    rule, cells, weights, records = _weighted(prepared, roles, roles.metric, merchant)
    return Run(
        issues, rule, weights, records,
        suppression.filter_suppressed(analysis.share_analysis(prepared, roles, weights), records),
        suppression.filter_suppressed(impact.share_impact(prepared, roles, weights), records),
        balanced.balanced_export_share(prepared, roles, weights, records),
        verdict_of(issues, cells, weights, rule),
    )


def run_rate(df: DataFrame, roles: Roles, *, merchant: bool = False) -> Run:
    """A rate run; the weights are fitted to the totals, which rates are weighted by."""
    numbers = [roles.total, *dict.fromkeys(roles.numerators.values())]
    schema.check_required_columns(df, [c for c in (*numbers, roles.entity, *roles.dimensions, roles.time) if c])
    checks = quality.rate_checks(roles)
    prepared = _prepared(df, roles, numbers, checks)
    issues = cut_lineage(quality.rate_issues(_checked(prepared, checks, numbers), roles, checks))
    rule, cells, weights, records = _weighted(prepared, roles, roles.total, merchant)
    return Run(
        issues, rule, weights, records,
        suppression.filter_suppressed(analysis.rate_analysis(prepared, roles, weights), records),
        suppression.filter_suppressed(impact.rate_impact(prepared, roles, weights), records),
        suppression.filter_suppressed(balanced.balanced_export_rate(prepared, roles, weights), records),
        verdict_of(issues, cells, weights, rule),
    )


def _prepared(df: DataFrame, roles: Roles, metrics: list[str], checks: list[quality.Check]) -> DataFrame:
    return prepare_cells(df, roles, metrics, hits={f"_c{i}": condition for i, (_, _, condition, _) in enumerate(checks)})


def _checked(prepared: DataFrame, checks: list[quality.Check], sums: list[str]) -> DataFrame:
    """The prepared table without its periods, as ``quality.checked_table`` would make it from the facts."""
    counts = ["_n", *[f"_c{i}" for i in range(len(checks))]]
    return prepared.groupBy("dimension", "category", "peer").agg(*[F.sum(c).alias(c) for c in (*counts, *sums)])


def _weighted(prepared: DataFrame, roles: Roles, metric: str, merchant: bool) -> tuple[str, DataFrame, DataFrame, DataFrame]:
    """The rule by peer count, the governed cells, the weights fitted to its cap, and what it keeps from publication."""
    plain = Roles(roles.entity, roles.dimensions, metric=metric, time=roles.time, target=roles.target)
    cells = cut_lineage(governed_cells(prepared, plain))
    peers = peers_only(prepared.where(F.col("peer").isNotNull()).select("peer").distinct(), roles.target)
    # One value to the driver: the rule decides the cap and the minimum of everything that follows.
    name = peers.agg(select_rule(F.count("peer"), merchant)).first()[0]
    if name == "insufficient":
        none = "dimension string, peer string, multiplier double"
        spark = prepared.sparkSession
        every = prepared.select("dimension", "category").distinct().select("dimension", "category", F.lit(None).cast("string").alias("time_period"))
        hidden = every.select(*CELL, F.lit(0).cast("bigint").alias("participants"), F.lit("insufficient_peers").alias("reason"))
        return name, cells, spark.createDataFrame([], none), hidden
    rule = rule_named(name)
    runs = cells.select(
        F.lit(name).alias("run_id"), *CELL, "peer", "v", F.lit(rule.cap).alias("cap"), F.lit(rule.min_entities).alias("min_entities")
    )
    population = peers.select(F.lit(name).alias("run_id"), "peer")
    weights = cut_lineage(fit_for_runs(runs, population).drop("run_id"))
    return name, cells, weights, cut_lineage(suppression.suppress_thin_cells(prepared, plain, rule.min_entities))


def verdict_of(issues: DataFrame, cells: DataFrame, weights: DataFrame, rule: str) -> DataFrame:
    """One row: what the input checks, the rule's caps and its tiers say of the published cells.

    ``blocked`` on an input error or without a rule, ``non_compliant`` where a weighted
    share is over the cap, ``best_effort`` where only tiers are missed, else
    ``strict_compliant``.
    """
    found = issues.agg(
        F.count_if(F.col("severity") == "ERROR").alias("errors"), F.count_if(F.col("severity") == "WARNING").alias("warnings")
    )
    if rule == "insufficient":
        return found.select(
            F.lit(rule).alias("rule"), "errors", "warnings", *[F.lit(0).cast("bigint").alias(c) for c in ("governed_cells", "cap_failures", "rule_failures")],
            F.lit("blocked").alias("verdict"),
        )
    active = rule_named(rule)
    shares = cell_shares(attach_weights(cells, weights)).where(F.col("v") > 0)
    judged = sweep_evidence(shares, CELL).where(F.col("participants") >= active.min_entities).agg(
        F.count("*").alias("governed_cells"), F.count_if(F.col(f"above_{active.cap:g}") > 0).alias("cap_failures"),
        F.count_if(~passes(active)).alias("rule_failures"),
    )
    posture: Column = (
        F.when(F.col("errors") > 0, "blocked").when(F.col("cap_failures") > 0, "non_compliant")
        .when(F.col("rule_failures") > 0, "best_effort").otherwise("strict_compliant")
    )
    both = found.select("*", *[judged.select(c).scalar().alias(c) for c in ("governed_cells", "cap_failures", "rule_failures")])
    return both.select(F.lit(rule).alias("rule"), "*", posture.alias("verdict"))
