"""Structural limits, the full privacy audit, compliance and verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peerlens.operators.cells import CELL, cell_shares, constraint_stats
from peerlens.operators.rules import (
    DynamicSettings,
    Rule,
    rules_array,
    sweep_evidence,
    tier_outcome,
    with_verdict,
)
from peerlens.operators.weights import COMPARISON_EPSILON, attach_weights, lowest_share
from peerlens.session import add_group_values, cut_lineage, join_keys


def structural_caps(
    cells: DataFrame, cap: float, low: float = 0.01, high: float = 10.0, tolerance: float = 1.0
) -> DataFrame:
    """Peers that stay over the cap in a cell at any weights in bounds."""
    totals = add_group_values(cells, CELL, _total=F.sum("v"))
    share = lowest_share(F.col("v"), F.col("_total"), low, high)
    return (
        totals.withColumn("min_share_pct", share)
        .withColumn("margin_pp", F.col("min_share_pct") - cap - tolerance)
        .where(F.col("margin_pp") > 0)
        .select(*CELL, "peer", "min_share_pct", "margin_pp")
    )


def structural_by_dimension(detail: DataFrame) -> DataFrame:
    """Infeasible categories, peer rows and worst margin per dimension."""
    per_cell = detail.groupBy(*CELL).agg(
        F.count("*").alias("_rows"), F.max("margin_pp").alias("_worst")
    )
    return per_cell.groupBy("dimension").agg(
        F.count("*").alias("infeasible_categories"),
        F.sum("_rows").alias("infeasible_peers"),
        F.max("_worst").alias("worst_margin_pp"),
    )


def structural_summary(detail: DataFrame) -> DataFrame:
    """One row: totals and the worst dimension and category."""
    summary = structural_by_dimension(detail).agg(
        F.coalesce(F.sum("infeasible_categories"), F.lit(0)).alias("infeasible_categories"),
        F.coalesce(F.sum("infeasible_peers"), F.lit(0)).alias("infeasible_peers"),
        F.coalesce(F.max("worst_margin_pp"), F.lit(0.0)).alias("worst_margin_pp"),
    )
    # Ties go to the first label: the least of (-margin, label).
    worst = detail.agg(
        F.min(F.struct((-F.col("margin_pp")).alias("m"), *CELL)).alias("_w")
    )
    return (
        summary.withColumn("_w", worst.select("_w").scalar())
        .withColumn("has_structural_infeasibility", F.col("infeasible_peers") > 0)
        .withColumn("top_infeasible_dimension", F.col("_w.dimension"))
        .withColumn("top_infeasible_category", F.col("_w.category"))
        .drop("_w")
    )


def share_violation(share: Column, cap: Column | float, tolerance: float) -> Column:
    """Over the cap beyond tolerance and comparison slack."""
    return share > cap + tolerance + COMPARISON_EPSILON


def cap_violations(shares: DataFrame, cap: float, tolerance: float = 1.0) -> DataFrame:
    """Peer and dimension pairs whose weighted share breaks the cap somewhere."""
    return (
        shares.where(share_violation(F.col("share"), cap, tolerance))
        .groupBy("dimension", "peer")
        .agg(F.count("*").alias("cells"), F.max("share").alias("worst_share"))
    )


def privacy_validation(
    cells: DataFrame,
    volumes: DataFrame,
    weights: DataFrame | None,
    rule: Rule,
    *,
    tolerance: float = 1.0,
    low: float = 0.01,
    high: float = 10.0,
    settings: DynamicSettings = DynamicSettings(),
    dynamic: bool = True,
) -> DataFrame:
    """Audit rows: shares before and after weighting, cap and tier outcome, margins.

    ``cells`` is ``CELL, peer, v`` (whole-period cells under their reserved name);
    ``volumes`` is ``peer, volume`` of the whole population.  Column ``peers`` tells
    how many peers a row stands for: one, or, with a null ``peer``, all the peers
    that do not occur in the cell.  Those are alike in every value (no volume,
    share 0, cap kept), so one row per cell accounts for them instead of a cell x
    peer grid.  Whole-period rows come once per period and are capped only.
    """
    cells = cut_lineage(cells)
    if weights is not None:
        weights = cut_lineage(weights)
    shares = cut_lineage(cell_shares(attach_weights(cells, weights)))
    stats = constraint_stats(cells, volumes)
    outcome = tier_outcome(
        shares.select(*CELL, "peer", "share"), stats, rule, settings, dynamic
    ).select(
        *CELL,
        "enforce",
        "tiers_passed",
        "relaxed",
        F.when(F.col("enforce"), "Enforced")
        .when(F.col("reason") == "no_additional", "Not applicable")
        .when(F.col("reason") == "time_total", "Time total cap validation")
        .otherwise(F.format_string("Skipped (%s)", F.col("reason")))
        .alias("tier_detail"),
    )
    margin = F.greatest(
        lowest_share(F.col("v"), F.col("raw_total"), low, high) - rule.cap - tolerance, F.lit(0.0)
    )
    rows = shares.withColumn("structural_margin_peer_pp", margin)
    per_cell = join_keys(
        rows.groupBy(*CELL).agg(
            F.max("structural_margin_peer_pp").alias("structural_margin_category_pp")
        ),
        outcome,
        CELL,
    )
    present = rows.groupBy(*CELL).agg(F.count("*").alias("_present"))
    population = volumes.agg(F.count("*")).scalar()
    absent = (
        join_keys(per_cell, present, CELL)
        .withColumn("peers", population - F.col("_present"))
        .where(F.col("peers") > 0)
        .select(
            *CELL,
            F.lit(None).cast("string").alias("peer"),
            "peers",
            F.lit(None).cast("double").alias("m"),
            *[F.lit(0.0).alias(c) for c in ("v", "raw_share", "share", "structural_margin_peer_pp")],
            *[c for c in per_cell.columns if c not in CELL],
        )
    )
    rows = (
        join_keys(rows, per_cell, CELL)
        .withColumn("peers", F.lit(1).cast("bigint"))
        .select(*absent.columns)
        .unionByName(absent)
    )
    over = share_violation(F.col("share"), rule.cap, tolerance)
    return rows.select(
        *CELL,
        "peer",
        "peers",
        F.lit(rule.name).alias("rule"),
        F.col("m").alias("multiplier"),
        F.col("v").alias("original_volume"),
        F.col("raw_share").alias("original_share_pct"),
        (F.col("v") * F.coalesce("m", F.lit(1.0))).alias("balanced_volume"),
        F.col("share").alias("balanced_share_pct"),
        F.lit(rule.cap).alias("cap_pct"),
        (~over).alias("cap_passed"),
        F.col("enforce").alias("tiers_enforced"),
        "tiers_passed",
        F.col("relaxed").alias("relaxation_used"),
        "tier_detail",
        (F.col("structural_margin_peer_pp") > 0).alias("structural_peer"),
        (F.col("structural_margin_category_pp") > 0).alias("structural_category"),
        "structural_margin_peer_pp",
        "structural_margin_category_pp",
        F.when(over, F.col("share") - rule.cap).otherwise(0.0).alias("violation_margin_pct"),
        (~over & F.col("tiers_passed") & ~F.col("relaxed")).alias("strict_compliant"),
    )


def strict_failures(validation: DataFrame) -> DataFrame:
    """Audit rows that are not strictly compliant."""
    return validation.where(~F.col("strict_compliant"))


def structural_counts(validation: DataFrame) -> DataFrame:
    """Rows and distinct cells flagged structurally infeasible in the audit."""
    per_cell = validation.groupBy(*CELL).agg(
        F.coalesce(F.sum(F.when(F.col("structural_peer"), F.col("peers"))), F.lit(0)).alias("_rows"),
        F.max("structural_category").alias("_hit"),
    )
    return per_cell.agg(
        F.sum("_rows").alias("structural_peer_rows"),
        F.count_if(F.col("_hit")).alias("structural_categories"),
    )


def strict_validation_counts(validation: DataFrame) -> DataFrame:
    """Recount violations from the audit rows against the plain rules.

    Cap rows, cells below the participant minimum, cells failing tiers and rows
    that needed relaxation; a null share fails the cap and counts as -1 for tiers.
    """
    share = F.col("balanced_share_pct")
    over = (share > F.col("cap_pct") + COMPARISON_EPSILON) | share.isNull() | F.isnan(share)

    def rows_where(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("peers"))), F.lit(0))

    rows = validation.agg(
        F.struct(
            F.coalesce(F.sum("peers"), F.lit(0)).alias("rows"),
            rows_where(over).alias("cap_fail_rows"),
            rows_where(F.col("relaxation_used")).alias("relaxed_rows"),
        ).alias("r")
    )
    # Absent peers take part with share 0, which reaches no tier threshold.
    keys = [*CELL, "_rule"]
    shares = validation.select(
        *CELL, F.col("rule").alias("_rule"), "peers", F.coalesce(share, F.lit(-1.0)).alias("share")
    )
    evidence = sweep_evidence(shares, keys).drop("participants")
    counted = shares.groupBy(*keys).agg(F.sum("peers").alias("participants"))
    verdicts = with_verdict(
        join_keys(evidence, counted, keys).withColumn("r", F.explode(rules_array()))
    ).where(F.col("rule") == F.col("_rule"))
    return (
        verdicts.agg(
            F.count_if(~F.col("participants_passed")).alias("participant_fail_categories"),
            F.count_if(~F.col("tiers_passed")).alias("tier_fail_categories"),
        )
        .withColumn("r", rows.scalar())
        .select(
            "r.rows",
            "r.cap_fail_rows",
            "participant_fail_categories",
            "tier_fail_categories",
            "r.relaxed_rows",
            (
                F.col("r.cap_fail_rows")
                + F.col("participant_fail_categories")
                + F.col("tier_fail_categories")
                + F.col("r.relaxed_rows")
            ).alias("total_violations"),
        )
    )


def compliance_summary(
    counts: DataFrame,
    postures: tuple[str, ...] = ("strict", "best_effort", "accuracy_first"),
    *,
    structural: DataFrame | None = None,
    issues: DataFrame | None = None,
    acknowledged: bool = False,
    blocked_reason: str | None = None,
) -> DataFrame:
    """Run status and verdict per posture from the recounted violations.

    ``issues`` is the severity count table of the input checks; unpublishable
    input adds one violation under the strict posture.
    """
    errors = (
        issues.where(F.col("severity") == "ERROR").agg(F.coalesce(F.sum("n"), F.lit(0))).scalar()
        if issues is not None
        else F.lit(0)
    )
    has_structural = (
        structural.select("has_structural_infeasibility").scalar()
        if structural is not None
        else F.lit(False)
    )
    base = (
        counts.select("total_violations", F.explode(F.array(*[F.lit(p) for p in postures])).alias("posture"))
        .withColumn("_bad_input", (F.col("posture") == "strict") & (errors > 0))
        .withColumn("_structural", has_structural)
        .withColumn("violations", F.col("total_violations") + F.col("_bad_input").cast("bigint"))
    )
    found = F.col("violations") > 0
    blocked = F.lit(blocked_reason is not None)
    return base.select(
        "posture",
        "violations",
        F.when(blocked, "blocked")
        .when(F.col("posture") == "strict", F.when(found, "non_compliant").otherwise("compliant"))
        .when(
            F.col("posture") == "best_effort",
            F.when(found, "completed_with_warnings").otherwise("compliant"),
        )
        .when(F.col("posture") == "accuracy_first", "completed_accuracy_first")
        .otherwise("completed")
        .alias("run_status"),
        F.when(blocked, "blocked")
        .when(F.col("_bad_input"), "not_publishable_input")
        .when(found, "violations_detected")
        .when(F.col("_structural"), "structural_infeasibility")
        .otherwise("fully_compliant")
        .alias("compliance_verdict"),
        F.lit(
            "acknowledged"
            if acknowledged
            else "required_missing" if blocked_reason is not None else "not_required"
        ).alias("acknowledgement_state"),
        (~blocked & ~((F.col("posture") == "strict") & found)).alias("posture_consistent"),
    )


def weighting_verdict(residual_cells: Column, passed: Column, relaxed: Column, converged: Column) -> Column:
    """strict_compliant / best_effort / non_compliant for one fit."""
    return (
        F.when(~passed | (residual_cells > 0), "non_compliant")
        .when(relaxed | ~converged, "best_effort")
        .otherwise("strict_compliant")
    )


def redact_peer_tables(rows: DataFrame, reason: str) -> DataFrame:
    """Replace a peer-level table by one row saying that it is withheld.

    No value and no row count of the peer table is revealed.
    """
    return rows.agg(F.lit("withheld").alias("status")).select(
        "status", F.lit(reason).alias("reason")
    )


def residual_by_run(shares: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """Cells and size of what stays over the cap after a fit, per ``run_id``."""
    excess = F.greatest(F.col("share") - F.col("cap") - tolerance, F.lit(0.0))
    return shares.groupBy("run_id").agg(
        F.count_if(F.col("share") > F.col("cap") + tolerance + COMPARISON_EPSILON).alias(
            "over_cap_rows"
        ),
        F.max(excess).alias("max_excess_pp"),
        F.sum(excess).alias("sum_excess_pp"),
    )
