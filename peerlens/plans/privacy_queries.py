"""Queries: rules, evidence, suppression, structural limits, fits and the audit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peerlens.functions.scalar import safe_pct
from peerlens.operators import audit, quality, rules, suppression, weights
from peerlens.operators import cells as cell_ops
from peerlens.operators.cells import CELL
from peerlens.plans import strategy
from peerlens.plans import workload as w
from peerlens.plans.registry import query, tidy
from peerlens.roles import Roles
from peerlens.session import add_group_values, cut_lineage, join_keys

# Skewed peers by brand and month: thin, dominated and healthy cells all occur.
THIN = Roles("entity", ("brand", "linestatus"), metric="amount", time="month", target="E3")
AUDIT = Roles("entity", ("returnflag", "priority"), metric="amount", time="period")
BOUNDS = {"low": 0.5, "high": 2.0}
LIST_COLUMNS = ["rule", "participants", "max_share", "cap_failures", "cap_passed", "participants_passed", "tiers_passed", "strict_passed"]


def day_sums(spark: SparkSession, sf_dir: str, *metrics: str) -> DataFrame:
    """Entity sums per order day: peer groups of very different size."""
    df = w.fact(spark, sf_dir, ("entity", "order_day", *metrics))
    return df.groupBy("order_day", F.col("entity").alias("peer")).agg(
        *[F.sum(m).alias(m) for m in metrics]
    )


def audit_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_lineage(cell_ops.governed_cells(w.fact_for(spark, sf_dir, AUDIT), AUDIT))


def population(cells: DataFrame) -> DataFrame:
    """Each peer's total, from the whole-period cells."""
    return (
        cells.where(F.col("dimension") == cell_ops.WHOLE)
        .groupBy("peer")
        .agg(F.sum("v").alias("volume"))
    )


def fitted(cells: DataFrame, cap: float, per_dimension: bool = False) -> DataFrame:
    """The settled weights at one cap."""
    runs = cells.select(
        F.lit("r").alias("run_id"), *CELL, "peer", "v", F.lit(cap).alias("cap"),
        F.lit(5).alias("min_entities"),
    )
    return cut_lineage(
        strategy.fit_for_runs(
            runs, runs.select("run_id", "peer").distinct(), per_dimension=per_dimension
        )
    )


def weighted_shares(cells: DataFrame, table: DataFrame) -> DataFrame:
    return cell_ops.cell_shares(weights.attach_weights(cells, table.drop("run_id")))


@query
def select_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule by the number of entities that sold on a day, with and without merchant scope."""
    sizes = day_sums(spark, sf_dir, "amount").groupBy("order_day").agg(F.count("*").alias("peers"))
    return sizes.select(
        "order_day",
        "peers",
        rules.select_rule(F.col("peers")).alias("rule"),
        rules.select_rule(F.col("peers"), merchant=True).alias("merchant_rule"),
    )


@query
def applicable_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = day_sums(spark, sf_dir, "amount").groupBy("order_day").agg(F.count("*").alias("peers"))
    return sizes.select(
        "order_day", "peers", F.explode(rules.applicable(F.col("peers"), True)).alias("r")
    ).select("order_day", "peers", "r.rule")


@query
def rule_dominance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that stay after dominated ones are dropped, per day's population."""
    sizes = day_sums(spark, sf_dir, "amount").groupBy("order_day").agg(F.count("*").alias("peers"))
    both = sizes.select(
        "order_day",
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(scope).alias("merchant"),
                        rules.undominated(rules.applicable(F.col("peers"), scope)).alias("kept"),
                    )
                    for scope in (True, False)
                ]
            )
        ).alias("_s"),
    )
    return both.select("order_day", "_s.merchant", F.explode("_s.kept").alias("r")).select(
        "order_day", "merchant", "r.rule"
    )


@query
def evaluate_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rules on the raw shares of every day."""
    sums = day_sums(spark, sf_dir, "amount").withColumnRenamed("amount", "v")
    out = rules.evaluate_rules(rules.raw_shares(cut_lineage(sums), ["order_day"]), ["order_day"])
    return tidy(out.select("order_day", *LIST_COLUMNS))


@query
def sweep_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = day_sums(spark, sf_dir, "amount").withColumnRenamed("amount", "v")
    out = rules.sweep_evidence(rules.raw_shares(cut_lineage(sums), ["order_day"]), ["order_day"])
    return tidy(out.select("order_day", "participants", "max_share", *[f"n_{t:g}" for t in rules.THRESHOLDS]))


def day_evidence(spark: SparkSession, sf_dir: str, mixed: bool) -> DataFrame:
    """Evidence per day.  ``mixed`` takes its parts from different metrics."""
    sums = cut_lineage(day_sums(spark, sf_dir, "amount", "qty", "fraud"))

    def of(metric: str) -> DataFrame:
        named = sums.select("order_day", "peer", F.col(metric).alias("v"))
        return rules.raw_shares(named, ["order_day"])

    amount = of("amount")
    evidence = rules.sweep_evidence(amount, ["order_day"])
    mine = amount.groupBy("order_day").agg(
        F.max(F.when(F.col("peer") == "E1", F.col("share"))).alias("protected_share"),
        F.max(F.col("peer") == "E1").alias("protected_included"),
    )
    if mixed:
        top = rules.sweep_evidence(of("fraud"), ["order_day"]).select("order_day", "max_share")
        counts = rules.sweep_evidence(of("qty"), ["order_day"]).drop("participants", "max_share")
        evidence = join_keys(
            join_keys(evidence.select("order_day", "participants"), top, ["order_day"], "left"),
            counts,
            ["order_day"],
        )
    month = F.month("order_day")
    return join_keys(evidence, mine, ["order_day"]).select(
        "*",
        F.when(month < 12, True).otherwise(F.lit(not mixed)).alias("contains_peer_data"),
        F.when(month != 2, month > 6).alias("merchant_scope"),
        F.when(month == 3, "issuer_fraud").otherwise("issuer_spend").alias("metric_context"),
        F.when(month < 5, "clearing_spend").otherwise("volume").alias("concentration_basis"),
        (month >= 6).alias("competitor_receives"),
    )


@query
def validate_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contradictions in evidence whose parts come from different metrics."""
    out = rules.validate_evidence(day_evidence(spark, sf_dir, mixed=True))
    return out.select("order_day", F.array_join(F.array_sort("failures"), ";").alias("failures"))


@query
def rule_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rules.rule_sweep(day_evidence(spark, sf_dir, mixed=False), ["order_day"])
    return out.select("order_day", "statuses", "overlay", "status", "authorizing")


@query
def protected_entity_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = day_sums(spark, sf_dir, "amount").withColumnRenamed("amount", "v")
    return tidy(rules.protected_overlay(rules.raw_shares(cut_lineage(sums), ["order_day"]), ["order_day"], "E1"))


def day_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = day_sums(spark, sf_dir, "amount", "fraud")
    return cut_lineage(sums.unpivot(["order_day", "peer"], ["amount", "fraud"], "metric", "v"))


@query
def validate_peer_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every day's peer group against every rule on two metrics, E1 protected."""
    out = rules.validate_peer_group(day_metrics(spark, sf_dir), ["order_day"], protected=("E1",))
    return tidy(out.drop("rule_pos"))


@query
def fallback_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = rules.validate_peer_group(day_metrics(spark, sf_dir), ["order_day"])
    return rules.fallback_rule(checked, ["order_day"])


@query
def concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = day_sums(spark, sf_dir, "fraud").withColumnRenamed("fraud", "v")
    return tidy(rules.concentration(sums, ["order_day"]).select("order_day", "peer", "v", "share"))


@query
def cap_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = day_sums(spark, sf_dir, "qty").withColumnRenamed("qty", "v")
    out = rules.cap_entities(sums, ["order_day"], 35.0)
    return tidy(out.select("order_day", "peer", "v", "adjustment_factor", "rounds"))


@query
def top_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = day_sums(spark, sf_dir, "amount").withColumnRenamed("amount", "v")
    out = rules.top_shares(rules.raw_shares(cut_lineage(sums), ["order_day"]), ["order_day"])
    return tidy(out)


@query
def tier_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = day_sums(spark, sf_dir, "amount").withColumnRenamed("amount", "v")
    shares = rules.raw_shares(cut_lineage(sums), ["order_day"])
    return tidy(rules.tier_shortfalls(shares, ["order_day"], rules.rule_named("7/35")))


# Suppression ------------------------------------------------------------------


def with_null_labels(df: DataFrame) -> DataFrame:
    """Some labels missing, since the null category is a group of its own here."""
    return df.withColumn("brand", F.when(F.col("brand") != "Brand#11", F.col("brand")))


@query
def suppress_thin_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = cell_ops.prepare_cells(with_null_labels(w.fact_for(spark, sf_dir, THIN)), THIN)
    cells = cell_ops.governed_cells(df, THIN).where(F.col("dimension") != cell_ops.WHOLE)
    infeasible = audit.structural_caps(cells, 25.0, **BOUNDS).select("dimension", "category")
    return suppression.suppress_thin_cells(df, THIN, 8, infeasible)


@query
def metric_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = w.fact_for(spark, sf_dir, THIN, "fraud", "discount")
    return suppression.metric_suppression(df, THIN, ["fraud", "discount"], 6, basis="fraud")


def thin_results(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    df = w.prepared_for(spark, sf_dir, THIN, "qty")
    sums = cell_ops.aggregate_cells(df, THIN, ["amount", "qty"], with_whole=False)
    results = sums.groupBy(*CELL).agg(F.sum("amount").alias("amount"), F.sum("qty").alias("qty"))
    return df, results, suppression.suppress_thin_cells(df, THIN, 7)


@query
def filter_suppressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, results, records = thin_results(spark, sf_dir)
    return tidy(suppression.filter_suppressed(results, records), ("amount",))


@query
def filter_metric_suppressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, results, _ = thin_results(spark, sf_dir)
    records = suppression.metric_suppression(df, THIN, ["qty"], 7)
    return tidy(suppression.filter_metric_suppressed(results, records, {"qty": ["qty"]}), ("amount",))


@query
def filter_release_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Released units are the unsuppressed cells; ``General`` rows match none."""
    _, results, records = thin_results(spark, sf_dir)
    released = suppression.filter_suppressed(results, records)
    general = results.groupBy("dimension", "category").agg(
        F.sum("amount").alias("amount"), F.sum("qty").alias("qty")
    )
    rows = results.unionByName(general.withColumn("time_period", F.lit("General")))
    return tidy(suppression.filter_release_set(rows, released), ("amount",))


@query
def filter_safe_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, _, records = thin_results(spark, sf_dir)
    safe = suppression.safe_entities(df, THIN, records)
    facts = w.fact_for(spark, sf_dir, THIN)
    diagnostics = facts.groupBy(F.col("entity").alias("peer")).agg(F.count("*").alias("n_rows"))
    return suppression.filter_safe_entities(diagnostics, safe)


@query
def filter_safe_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, _, _ = thin_results(spark, sf_dir)
    records = suppression.suppress_thin_cells(df, THIN, 9)
    facts = w.fact_for(spark, sf_dir, THIN)
    totals = facts.groupBy(F.col("month").alias("time_period")).agg(F.count("*").alias("n_rows"))
    return suppression.filter_safe_periods(totals, suppression.safe_entities(df, THIN, records))


# Structure and fits -----------------------------------------------------------


def thin_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = w.fact_for(spark, sf_dir, THIN)
    cells = cell_ops.governed_cells(df, THIN).where(F.col("dimension") != cell_ops.WHOLE)
    return cut_lineage(cells)


@query
def constraint_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = audit_cells(spark, sf_dir)
    return tidy(
        cell_ops.constraint_stats(cells, population(cells)), ("category_total", "dimension_total")
    )


@query
def dimension_unbalance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(cell_ops.dimension_unbalance(thin_cells(spark, sf_dir)))


@query
def structural_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(audit.structural_caps(thin_cells(spark, sf_dir), 25.0, **BOUNDS))


@query
def structural_by_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(audit.structural_by_dimension(audit.structural_caps(thin_cells(spark, sf_dir), 25.0, **BOUNDS)))


@query
def structural_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    detail = cut_lineage(audit.structural_caps(thin_cells(spark, sf_dir), 25.0, **BOUNDS))
    return tidy(audit.structural_summary(detail))


@query
def fit_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Global multipliers at a cap of 25 percent."""
    return tidy(fitted(audit_cells(spark, sf_dir), 25.0).drop("run_id", "dimension"))


@query
def fit_weights_per_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(fitted(audit_cells(spark, sf_dir), 25.0, per_dimension=True).drop("run_id"))


@query
def fit_weights_converged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fit run until it settles: what must hold of it over the cells it governs."""
    cells = audit_cells(spark, sf_dir)
    runs = cells.select(
        F.lit("r").alias("run_id"), *CELL, "peer", "v", F.lit(30.0).alias("cap"),
        F.lit(5).alias("min_entities"),
    )
    table = cut_lineage(strategy.fit_for_runs(runs, runs.select("run_id", "peer").distinct()))
    governed = weights.fixable_cells(
        runs, F.col("cap"), F.col("min_entities"), strategy.LOW, strategy.HIGH, strategy.TOLERANCE, ["run_id"]
    )
    shares = weighted_shares(governed.drop("run_id"), table).withColumn("run_id", F.lit("r"))
    residual = audit.residual_by_run(shares).select(
        "run_id", "over_cap_rows", F.round("max_excess_pp", 5).alias("max_excess_pp")
    )
    rows = shares.agg(F.count("*").alias("governed_rows"))
    bounds = table.groupBy("run_id").agg(
        F.count("*").alias("peers"),
        (F.min("multiplier") >= strategy.LOW).alias("above_low"),
        (F.max("multiplier") <= strategy.HIGH).alias("below_high"),
        (F.abs(F.avg("multiplier") - 1.0) < 1e-6).alias("mean_one"),
    )
    return tidy(residual.join(bounds, "run_id").drop("run_id").withColumn("governed_rows", rows.scalar()))


@query
def rescale_mean_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peers' volume ratios brought to mean 1 within bounds."""
    raw = raw_multipliers(spark, sf_dir)
    return tidy(weights.rescale_mean_one(raw, ["run_id"], 0.05, 3.0).drop("run_id"))


def raw_multipliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = audit_cells(spark, sf_dir)
    volumes = population(cells).withColumn("run_id", F.lit("r"))
    tops = add_group_values(volumes, ["run_id"], _top=F.max("volume"))
    return tops.select("run_id", "peer", F.round(F.col("volume") / F.col("_top"), 4).alias("m"))


@query
def waterfill_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = cut_lineage(raw_multipliers(spark, sf_dir))
    return tidy(weights.waterfill_mean(raw, ["run_id"], 0.05, 3.0).drop("run_id"))


@query
def worst_excess(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The worst share over 25 percent that weights fitted at 30 percent leave."""
    cells = audit_cells(spark, sf_dir)
    out = weights.worst_excess(weighted_shares(cells, fitted(cells, 30.0)), 25.0)
    return tidy(out.select(*CELL, "peer", "share", "excess"))


@query
def nudge_borderline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cap is set just under the largest share, so one peer is borderline."""
    cells = audit_cells(spark, sf_dir)
    table = fitted(cells, 25.0).select("peer", "multiplier")
    shares = cut_lineage(
        weighted_shares(cells, table.withColumn("dimension", F.lit(None).cast("string")))
    )
    # One number to the driver: the cap of this demonstration.
    cap = shares.agg(F.max("share")).first()[0] - 5e-4
    return tidy(weights.nudge_borderline(table, shares, cap, 0.01, 10.0))


@query
def cap_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What weights fitted at a cap of 30 percent leave over a cap of 25."""
    cells = audit_cells(spark, sf_dir)
    return tidy(audit.cap_violations(weighted_shares(cells, fitted(cells, 30.0)), 25.0, 0.0))


@query
def cap_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slack over a cap of 25 percent of weights fitted at 30."""
    cells = audit_cells(spark, sf_dir)
    rows = weights.attach_weights(cells, fitted(cells, 30.0).drop("run_id"))
    return tidy(weights.cap_slack(cut_lineage(rows), 25.0), ("max_slack", "sum_slack"))


@query
def weighting_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on a cap of 40 percent of fits at caps of 25, 30 and 40."""
    cells = audit_cells(spark, sf_dir)
    parts = []
    for cap in (25.0, 30.0, 40.0):
        shares = weighted_shares(cells, fitted(cells, cap))
        parts.append(shares.select(F.lit(f"cap_{cap:g}").alias("run_id"), "share", F.lit(40.0).alias("cap")))
    left = audit.residual_by_run(parts[0].unionByName(parts[1]).unionByName(parts[2]))
    over = F.col("over_cap_rows")
    return tidy(
        left.select(
            "run_id",
            "over_cap_rows",
            audit.weighting_verdict(
                over, F.col("max_excess_pp") <= 0.5, F.lit(False), F.col("max_excess_pp") <= 1e-6
            ).alias("verdict"),
        )
    )


LOOSE = rules.DynamicSettings(4, 2.0, 0.001, 0.0005, 0.1)


@query
def dynamic_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = thin_cells(spark, sf_dir)
    stats = cell_ops.constraint_stats(cells, thin_population(cells))
    out = rules.dynamic_thresholds(
        stats, rules.rule_named("7/35"), thin_population(cells).agg(F.count("*")).scalar()
    )
    return tidy(out.select(*CELL, *tier_columns(), "enforce", "relaxed"))


def thin_population(cells: DataFrame) -> DataFrame:
    return (
        cells.where(F.col("dimension") == "linestatus")
        .groupBy("peer")
        .agg(F.sum("v").alias("volume"))
    )


def tier_columns() -> list[str]:
    return ["tier_1_count", "tier_1_threshold", "tier_2_count", "tier_2_threshold"]


@query
def dynamic_thresholds_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = thin_cells(spark, sf_dir)
    stats = cell_ops.constraint_stats(cells, thin_population(cells))
    out = rules.dynamic_thresholds_strict(stats, rules.rule_named("7/35"), LOOSE)
    return tidy(out.select(*CELL, *tier_columns(), "reason", "enforce", "relaxed"))


@query
def tier_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = thin_cells(spark, sf_dir)
    stats = cell_ops.constraint_stats(cells, thin_population(cells))
    shares = cell_ops.cell_shares(cells.withColumn("m", F.lit(1.0))).select(*CELL, "peer", "share")
    out = rules.tier_violations(
        cut_lineage(shares), stats, rules.rule_named("7/35"), LOOSE, dynamic=False
    )
    return tidy(
        out.select(*CELL, "participants", "effective_peers", "representativeness", *tier_columns(), "top_shares")
    )


@query
def violation_penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of three weight vectors, neutral and fitted at 40 and 25 percent; one peer has a cap of its own."""
    cells = audit_cells(spark, sf_dir)
    vectors = [
        cells.select("peer").distinct().select("peer", F.lit(1.0).alias("multiplier")),
        fitted(cells, 40.0).select("peer", "multiplier"),
        fitted(cells, 25.0).select("peer", "multiplier"),
    ]
    named = [v.select(F.lit(f"v{i}").alias("run_id"), "*") for i, v in enumerate(vectors)]
    table = cut_lineage(named[0].unionByName(named[1]).unionByName(named[2]))
    rows = cells.join(table.withColumnRenamed("multiplier", "m"), "peer")
    shares = cut_lineage(cell_ops.cell_shares(rows, ["run_id"]))
    stats = cell_ops.constraint_stats(cells, population(cells))
    caps = cells.select("peer").distinct().where(F.col("peer") == "E1").withColumn("cap", F.lit(18.0))
    out = rules.violation_penalty(
        shares, stats, table, 25.0, rules.rule_named("7/35"), caps=caps, settings=LOOSE, tolerance=0.0
    )
    return out.select(
        "run_id",
        *[F.round(c, 3).alias(c) for c in ("cap_penalty", "tier_penalty", "deviation", "penalty")],
    )


# Audit ------------------------------------------------------------------------


# Many peers are absent from a brand's month.
AUDIT_THIN = Roles("entity", ("brand", "returnflag"), metric="amount", time="month")


def audit_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = cut_lineage(cell_ops.governed_cells(w.fact_for(spark, sf_dir, AUDIT_THIN), AUDIT_THIN))
    return audit.privacy_validation(
        cells,
        population(cells),
        fitted(cells, 40.0).drop("run_id"),
        rules.rule_named("10/40"),
        tolerance=0.0,
        settings=LOOSE,
        **BOUNDS,
    )


AUDIT_COLUMNS = [
    *CELL, "peer", "peers", "multiplier", "original_volume", "original_share_pct", "balanced_share_pct",
    "cap_passed", "tiers_enforced", "tiers_passed", "relaxation_used", "tier_detail",
    "structural_peer", "structural_category", "violation_margin_pct", "strict_compliant",
]


@query
def privacy_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(audit_table(spark, sf_dir).select(*AUDIT_COLUMNS), ("original_volume",))


@query
def strict_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = audit.strict_failures(audit_table(spark, sf_dir))
    return tidy(out.select(*CELL, "peer", "peers", "balanced_share_pct", "cap_passed", "tiers_passed"))


@query
def structural_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(audit.structural_counts(audit_table(spark, sf_dir)))


@query
def strict_validation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(audit.strict_validation_counts(cut_lineage(audit_table(spark, sf_dir))))


@query
def compliance_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = w.fact_for(spark, sf_dir, AUDIT)
    issues = quality.issue_severity_counts(quality.validate_share_input(df, AUDIT))
    counts = audit.strict_validation_counts(cut_lineage(audit_table(spark, sf_dir)))
    return tidy(audit.compliance_summary(counts, issues=issues))


@query
def redact_peer_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A peer-level table is withheld, however many rows it has."""
    sums = day_sums(spark, sf_dir, "amount")
    return audit.redact_peer_tables(sums, "peer_level_data_withheld")


@query
def safe_pct_per_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = day_sums(spark, sf_dir, "fraud", "txn")
    return tidy(
        sums.select("order_day", "peer", safe_pct(F.col("fraud"), F.col("txn") - 1).alias("rate"))
    )
