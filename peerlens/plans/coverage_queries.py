"""Queries: safe coverage, strategies, presets, subsets and reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peerlens.operators import balanced, coverage, reconcile, suppression
from peerlens.operators.cells import CELL
from peerlens.operators.impact import rate_impact
from peerlens.operators.rules import RULES, THRESHOLDS
from peerlens.plans import strategy
from peerlens.plans import workload as w
from peerlens.plans.benchmark_queries import volume_weights
from peerlens.plans.registry import query, tidy
from peerlens.roles import Roles
from peerlens.session import cut_lineage

COVER = Roles("entity", ("brand", "linestatus"), metric="amount", secondary=("qty", "fraud"), time="month")
LOW, HIGH = 0.5, 2.0
PROTECTED = "E1"


def universe(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Volumes and candidate units, both materialised."""
    df = w.prepared_for(spark, sf_dir, COVER, exact=True)
    volumes = cut_lineage(coverage.unit_volumes(df, COVER))
    records = suppression.suppress_thin_cells(df, COVER, 6)
    return volumes, cut_lineage(coverage.candidate_units(volumes, records, overlay_entity=PROTECTED))


def some_weights(volumes: DataFrame) -> DataFrame:
    """Weights from the data: square root of mean over own volume, in bounds."""
    totals = volumes.where(F.col("metric") == "amount").groupBy("peer").agg(F.sum("v").alias("t"))
    mean = totals.agg(F.avg("t")).scalar()
    return totals.select(
        "peer", F.least(F.greatest(F.round(F.sqrt(mean / F.col("t")), 4), F.lit(LOW)), F.lit(HIGH)).alias("w")
    )


@query
def candidate_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, units = universe(spark, sf_dir)
    names = F.array_join(F.transform("rules", lambda r: r["rule"]), ";")
    return tidy(units.select("unit_key", "participants", "metrics", names.alias("rules")))


@query
def coverage_min_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    peers = w.fact(spark, sf_dir, ("entity",)).select(F.col("entity").alias("peer")).distinct()
    return tidy(coverage.coverage_min_entities(peers))


@query
def classify_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every peer of every unit against every applicable cap over the weight box."""
    volumes, units = universe(spark, sf_dir)
    rows = coverage.fractions(volumes, units)
    labels = [
        coverage.classify_cap(F.col("f"), cap, LOW, HIGH).alias(f"cap_{cap:g}")
        for cap in sorted({r.cap for r in RULES})
    ]
    return rows.select("unit_key", "metric", "peer", *labels)


@query
def classify_tier_witness(spark: SparkSession, sf_dir: str) -> DataFrame:
    volumes, units = universe(spark, sf_dir)
    rows = coverage.fractions(volumes, units)
    labels = [
        coverage.classify_tier_witness(F.col("f"), t, LOW, HIGH).alias(f"tier_{t:g}")
        for t in THRESHOLDS
    ]
    return rows.select("unit_key", "metric", "peer", *labels)


@query
def classify_protected(spark: SparkSession, sf_dir: str) -> DataFrame:
    volumes, units = universe(spark, sf_dir)
    rows = coverage.fractions(volumes, units).where(F.col("peer") == PROTECTED)
    return rows.select(
        "unit_key", "metric", coverage.classify_protected(F.col("f"), LOW, HIGH).alias("protected")
    )


@query
def prune_unit_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    volumes, units = universe(spark, sf_dir)
    return tidy(coverage.prune_unit_rules(volumes, units, LOW, HIGH))


@query
def score_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    volumes, units = universe(spark, sf_dir)
    vectors = coverage.quasi_random_weights(volumes.select("peer").distinct(), 8, LOW, HIGH)
    return tidy(coverage.score_candidates(volumes, units, cut_lineage(vectors), PROTECTED))


@query
def best_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    volumes, units = universe(spark, sf_dir)
    vectors = coverage.quasi_random_weights(volumes.select("peer").distinct(), 8, LOW, HIGH)
    scores = coverage.score_candidates(volumes, units, cut_lineage(vectors), PROTECTED)
    return tidy(coverage.best_candidate(scores))


def searched(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The universe and the weights of a whole search."""
    volumes, units = universe(spark, sf_dir)
    found = coverage.refine_weights(volumes, units, some_weights(volumes), LOW, HIGH, overlay_entity=PROTECTED)
    return volumes, units, cut_lineage(found)


@query
def refine_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of searched weights, found without the search's own scoring.

    Per peer: its weight is in bounds, and no grid value of it alone releases more units,
    or as many nearer to neutral; the search ended by itself, its count is that of the
    exact partition, and neither the neutral nor the fitted vector releases more.
    """
    volumes, units, found = searched(spark, sf_dir)
    vector = found.select("peer", "w")
    moves = coverage.coordinate_scores(volumes, units, vector, LOW, HIGH, overlay_entity=PROTECTED)
    better = (F.col("gain") > 0) | ((F.col("gain") == 0) & (F.col("distance_change") < -1e-12))
    per_peer = moves.groupBy("peer").agg(F.count_if(better).alias("improving_moves"))
    count = lambda w: coverage.release_partition(volumes, units, w, PROTECTED).agg(F.count_if("released")).scalar()
    return found.join(per_peer, "peer", "left").select(
        "peer",
        ((F.col("w") >= LOW) & (F.col("w") <= HIGH)).alias("in_bounds"),
        F.coalesce("improving_moves", F.lit(0)).alias("improving_moves"),
        "search_state",
        (F.col("released_units") == count(vector)).alias("count_is_exact"),
        (F.col("released_units") >= count(vector.withColumn("w", F.lit(1.0)))).alias("not_below_neutral"),
        (F.col("released_units") >= count(some_weights(volumes))).alias("not_below_fitted"),
    )


def partition_of(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    volumes, units = universe(spark, sf_dir)
    vector = cut_lineage(some_weights(volumes))
    return volumes, units, vector, cut_lineage(
        coverage.release_partition(volumes, units, vector, PROTECTED)
    )


@query
def release_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    *_, partition = partition_of(spark, sf_dir)
    return partition.select("unit_key", "released", "authorizing_rule")


@query
def released_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, units, _, partition = partition_of(spark, sf_dir)
    return tidy(coverage.released_units(units, partition).select("unit_key", *CELL, "participants"))


@query
def check_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The recorded keys with one unit listed twice and every unit of a month lost."""
    _, units, _, partition = partition_of(spark, sf_dir)
    released = partition.where("released")
    doubled = released.unionByName(released.where(F.col("dimension") == "linestatus"))
    hidden = partition.where(~F.col("released") & (F.col("time_period") != "1997-03"))
    return coverage.check_partition(units, doubled, hidden)


@query
def verify_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A faithful record verifies; the codes of a tampered one are listed beside it."""
    volumes, units, vector, partition = partition_of(spark, sf_dir)
    digest = cut_lineage(coverage.universe_digest(volumes, units))
    tampered = partition.withColumn(
        "released", F.col("released") & (F.col("time_period") != "1997-03")
    ).withColumn("authorizing_rule", F.when(F.col("dimension") == "brand", "10/40").otherwise(F.col("authorizing_rule")))
    good = coverage.verify_release(volumes, units, partition, vector, LOW, HIGH, PROTECTED, digest)
    bad = coverage.verify_release(volumes, units, tampered, vector, LOW, HIGH, PROTECTED, digest)
    return good.select(F.lit("faithful").alias("record"), "*").unionByName(
        bad.select(F.lit("tampered").alias("record"), "*")
    )


@query
def coverage_certificate(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, vector, partition = partition_of(spark, sf_dir)
    return tidy(coverage.coverage_certificate(partition, vector))


@query
def release_mask_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    *_, partition = partition_of(spark, sf_dir)
    return coverage.release_mask_digest(partition)


@query
def universe_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    volumes, units = universe(spark, sf_dir)
    return coverage.universe_digest(volumes, units)


@query
def digest_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units by which a record differs whose every seventh month lost a peer, and which lacks a dimension."""
    volumes, units = universe(spark, sf_dir)
    seventh = F.substring("time_period", 6, 2) == "07"
    before = volumes.where(~(seventh & (F.col("peer") == "E4"))).where(F.col("dimension") != "linestatus")
    found = coverage.digest_differences(coverage.unit_digests(before, units), coverage.unit_digests(volumes, units))
    return found.select("unit_key", "difference")


@query
def release_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions on a release by stated weights and on one by searched weights.

    The first takes the caller's word that nothing is left to search, the second reads how
    the search ended.  Both tell how many units the stated weights release, and whether
    the release decided on has as many.
    """
    volumes, units, found = searched(spark, sf_dir)
    stated = cut_lineage(some_weights(volumes))
    rows = []
    for name, vector, complete in (("stated", stated, True), ("searched", found.select("peer", "w"), found)):
        partition = cut_lineage(coverage.release_partition(volumes, units, vector, PROTECTED))
        if name == "stated":
            count = partition.agg(F.count_if("released").alias("n"), F.count_if(~F.col("released")).alias("left"))
        failures = coverage.verify_release(volumes, units, partition, vector, LOW, HIGH, PROTECTED)
        rows.append(coverage.release_decision(failures, partition, complete).withColumn("weights", F.lit(name)))
    return rows[0].unionByName(rows[1]).crossJoin(count).select(
        "weights", "failures", F.col("n").alias("released_units"), F.col("left").alias("suppressed_units"),
        (F.col("released_units") >= F.col("n")).alias("reached"), "authorized", "withholding_reason",
    )


@query
def denial_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit row of a release by weights of which nobody says that a search ended."""
    volumes, units, vector, partition = partition_of(spark, sf_dir)
    failures = coverage.verify_release(volumes, units, partition, vector, LOW, HIGH, PROTECTED)
    decision = coverage.release_decision(failures, partition, search_complete=False)
    rules = partition.where("released").select(
        F.col("authorizing_rule").alias("rule"), F.lit("passed").alias("status")
    )
    return coverage.denial_audit(decision, rules, "sweep_any_applicable").drop("rule_set_digest")


# Strategies -------------------------------------------------------------------

STRATEGY = Roles("entity", ("returnflag", "priority"), metric="amount")
SUBSETS = Roles("entity", ("brand", "linestatus", "priority", "returnflag"), metric="amount", time="period")
PRESETS = (
    strategy.Preset("tight", 25.0),
    strategy.Preset("middle", 30.0),
    strategy.Preset("loose", 40.0),
    strategy.Preset("open", 60.0, posture="accuracy_first"),
)


@query
def strategy_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = w.fact_for(spark, sf_dir, STRATEGY)
    return strategy.strategy_outcome(df, STRATEGY, merchant=True, protected=PROTECTED)


@query
def single_rule_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = w.fact_for(spark, sf_dir, STRATEGY)
    return tidy(strategy.single_rule_outcome(df, STRATEGY))


def presets(spark: SparkSession, sf_dir: str) -> DataFrame:
    roles = Roles("entity", ("returnflag", "priority"), metric="amount", target="E3")
    return strategy.preset_comparison(w.fact_for(spark, sf_dir, roles), roles, PRESETS)


@query
def preset_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(presets(spark, sf_dir))


@query
def preset_comparison_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The presets by their effect on rates, with the weights fitted to the totals."""
    df = w.prepared_for(spark, sf_dir, w.RATE)
    return tidy(strategy.preset_comparison(df, w.RATE, PRESETS, acknowledge_accuracy_first=True))


@query
def best_preset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(strategy.best_preset(presets(spark, sf_dir)))


def subsets(spark: SparkSession, sf_dir: str, greedy: bool = False) -> DataFrame:
    df = w.prepared_for(spark, sf_dir, SUBSETS)
    return strategy.search_dimension_subsets(df, SUBSETS, 14.0, 5, greedy=greedy)


@query
def search_dimension_subsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(subsets(spark, sf_dir).drop("dims"))


@query
def greedy_dimension_subsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chain of subsets that drops the most unbalanced dimension each time."""
    return tidy(subsets(spark, sf_dir, greedy=True).drop("dims"))


@query
def removed_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strategy.removed_dimensions(cut_lineage(subsets(spark, sf_dir)), SUBSETS.dimensions)


@query
def reconcile_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The balanced rate export against the rates it should show, some of them edited."""
    df = w.prepared_for(spark, sf_dir, w.RATE, "amount")
    table = cut_lineage(volume_weights(df, w.RATE))
    export = balanced.balanced_export_rate(df, w.RATE, table)
    mine = reconcile.rates_of_export(export, "txn", {"approval": "approved", "fraud": "fraud"})
    theirs = rate_impact(df, w.RATE, table).select(
        "dimension",
        "category",
        "time_period",
        "rate",
        F.when(F.col("category") == "1-URGENT", F.col("balanced_pct") + 0.5)
        .otherwise(F.col("balanced_pct"))
        .alias("value"),
    )
    kept = theirs.where(F.col("category") != "5-LOW").unionByName(
        theirs.where(F.col("category") == "2-HIGH")
    )
    return reconcile.reconcile_export(mine, kept)
