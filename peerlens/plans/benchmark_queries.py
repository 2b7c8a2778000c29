"""Queries: cells, weights, share and rate analysis, impact, balanced tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peerlens.functions.ordered import weighted_percentile_or_plain
from peerlens.operators import analysis, balanced, cells, impact, suppression, weights
from peerlens.plans import workload as w
from peerlens.plans.registry import query, tidy
from peerlens.roles import Roles
from peerlens.session import cut_lineage

MONEY = ("v", "volume", "category_volume", "amount")


def fact_for(spark: SparkSession, sf_dir: str, roles: Roles, *more: str) -> DataFrame:
    return w.fact_for(spark, sf_dir, roles, *more)


def volume_weights(df: DataFrame, roles: Roles) -> DataFrame:
    """Weights from the data: large peers lighter, with an override on returnflag."""
    amounts = Roles(roles.entity, roles.dimensions, metric="amount", target=roles.target)
    volumes = cells.peer_volumes(df, amounts)
    mean = F.col("_mean")
    placed = cut_lineage(volumes.withColumn("_mean", volumes.agg(F.avg("volume")).scalar()))
    everywhere = placed.select(
        F.lit(None).cast("string").alias("dimension"),
        "peer",
        weights.clamp(F.round(F.sqrt(mean / F.col("volume")), 4), 0.5, 2.0).alias("multiplier"),
    )
    special = placed.where(F.col("volume") > mean).select(
        F.lit("returnflag").alias("dimension"), "peer", F.lit(0.75).alias("multiplier")
    )
    return everywhere.unionByName(special)


@query
def build_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cells.build_cells(fact_for(spark, sf_dir, w.SHARE), w.SHARE)
    return tidy(out.drop("time_period"), MONEY)


@query
def build_cells_timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(cells.build_cells_timed(fact_for(spark, sf_dir, w.SHARE_TIMED), w.SHARE_TIMED), MONEY)


@query
def build_time_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(cells.build_time_totals(fact_for(spark, sf_dir, w.SHARE_TIMED), w.SHARE_TIMED), MONEY)


@query
def peer_volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(cells.peer_volumes(fact_for(spark, sf_dir, w.SHARE), w.SHARE), MONEY)


@query
def run_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(cells.run_facts(fact_for(spark, sf_dir, w.SHARE), w.SHARE))


@query
def canonical_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct labels sorted by their text."""
    df = w.fact(spark, sf_dir, ("entity",))
    return df.select(F.col("entity").cast("string").alias("label")).distinct().orderBy("label")


@query
def distinct_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pick list of a column."""
    df = w.table(spark, sf_dir, "part")
    return df.select(F.col("p_type").alias("value")).where(F.col("value").isNotNull()).distinct().orderBy("value")


@query
def attach_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = w.prepared_for(spark, sf_dir, w.SHARE)
    rows = cells.governed_cells(df, w.SHARE)
    return tidy(weights.attach_weights(rows, volume_weights(df, w.SHARE)).drop("time_period"), MONEY)


@query
def cell_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = w.prepared_for(spark, sf_dir, w.SHARE)
    rows = weights.attach_weights(cells.governed_cells(df, w.SHARE), volume_weights(df, w.SHARE))
    out = cells.cell_shares(cut_lineage(rows))
    return tidy(out.select("dimension", "category", "peer", "raw_share", "share"))


@query
def weighted_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """85th percentile of line prices weighted by quantity; one group has no weight."""
    df = w.table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("returnflag"),
        F.col("l_linestatus").alias("linestatus"),
        F.col("l_extendedprice").alias("x"),
        F.when((F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "F"), 0.0)
        .otherwise(F.col("l_quantity"))
        .alias("w"),
    )
    out = weighted_percentile_or_plain(df, ["returnflag", "linestatus"], "x", "w", 0.85, "p85")
    return tidy(out, ("p85",))


@query
def share_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: timed share analysis of the target with weighted peers."""
    df = w.prepared_for(spark, sf_dir, w.SHARE_TIMED)
    out = analysis.share_analysis(df, w.SHARE_TIMED, volume_weights(df, w.SHARE_TIMED))
    return tidy(out, ("original_total_volume",))


@query
def share_analysis_peer_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = fact_for(spark, sf_dir, w.PEER_ONLY)
    out = analysis.share_analysis(df, w.PEER_ONLY)
    return tidy(out.drop("time_period"), ("original_total_volume",))


# Thin cells: many peer and category pairs do not occur, so absent peers matter.
SPARSE = Roles("nation", ("brand",), metric="amount", time="month", target="NATION_3")


@query
def share_analysis_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share analysis where most cells lack some peers."""
    df = fact_for(spark, sf_dir, SPARSE)
    return tidy(analysis.share_analysis(df, SPARSE), ("original_total_volume",))


@query
def rate_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = w.prepared_for(spark, sf_dir, w.RATE, "amount")
    return tidy(analysis.rate_analysis(df, w.RATE, volume_weights(df, w.RATE)))


@query
def rate_analysis_peer_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    roles = Roles("entity", w.RATE.dimensions, total="txn", numerators=w.RATE.numerators)
    out = analysis.rate_analysis(fact_for(spark, sf_dir, roles), roles)
    return tidy(out.drop("time_period"))


@query
def zero_bic_warning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best-in-class values of practically zero on thin rate cells."""
    roles = Roles("nation", ("brand", "linestatus"), total="txn", numerators={"fraud": "fraud"}, time="month")
    return tidy(analysis.zero_bic_warning(analysis.rate_analysis(fact_for(spark, sf_dir, roles), roles)))


@query
def share_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = w.prepared_for(spark, sf_dir, w.SHARE_TIMED)
    out = impact.share_impact(df, w.SHARE_TIMED, volume_weights(df, w.SHARE_TIMED))
    return tidy(
        impact.with_distortion_alias(out),
        ("entity_volume", "raw_total_volume", "balanced_total_volume"),
    )


@query
def rate_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = w.prepared_for(spark, sf_dir, w.RATE, "amount")
    out = impact.rate_impact(df, w.RATE, volume_weights(df, w.RATE))
    return tidy(impact.with_weight_effect_alias(out))


@query
def impact_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = w.prepared_for(spark, sf_dir, w.SHARE_TIMED)
    out = impact.share_impact(df, w.SHARE_TIMED, volume_weights(df, w.SHARE_TIMED))
    return tidy(impact.impact_summary(out))


@query
def impact_summary_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = w.prepared_for(spark, sf_dir, w.RATE, "amount")
    out = impact.rate_impact(df, w.RATE, volume_weights(df, w.RATE))
    return tidy(impact.impact_summary(out, rate=True))


@query
def impact_summary_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = w.prepared_for(spark, sf_dir, w.SHARE_TIMED)
    out = impact.share_impact(df, w.SHARE_TIMED, volume_weights(df, w.SHARE_TIMED))
    return tidy(impact.impact_summary_filtered(out))


@query
def weights_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = w.prepared_for(spark, sf_dir, w.SHARE)
    out = weights.weights_table(volume_weights(df, w.SHARE), cells.peer_volumes(df, w.SHARE))
    return tidy(out.withColumn("balanced_volume", F.round("balanced_volume", 4)), ("raw_volume",))


@query
def rank_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = w.prepared_for(spark, sf_dir, w.SHARE)
    table = weights.weights_table(volume_weights(df, w.SHARE), cells.peer_volumes(df, w.SHARE))
    return tidy(weights.rank_changes(table.where(F.col("weight_scope") == "Global")))


@query
def method_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = w.prepared_for(spark, sf_dir, w.SHARE)
    peers = cells.peer_volumes(df, w.SHARE).select("peer")
    return tidy(
        weights.method_breakdown(volume_weights(df, w.SHARE), peers, list(w.SHARE.dimensions))
    )


@query
def weights_are_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = volume_weights(fact_for(spark, sf_dir, w.SHARE), w.SHARE)
    keyed = table.withColumn("weight_scope", F.coalesce("dimension", F.lit("Global")))
    return weights.weights_are_identity(keyed, ["weight_scope"])


@query
def representativeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = w.prepared_for(spark, sf_dir, w.SHARE_TIMED)
    table = volume_weights(df, w.SHARE_TIMED)
    moved = impact.share_impact(df, w.SHARE_TIMED, table).agg(
        F.avg(F.abs("impact_pp")).alias("mean_abs_impact_pp")
    )
    return tidy(weights.representativeness(table, 0.5, moved))


BALANCED = Roles(
    "entity",
    ("brand", "linestatus"),
    metric="amount",
    total="txn",
    numerators={"approval": "approved", "fraud": "fraud"},
    secondary=("qty", "discount"),
    time="month",
    target="E3",
)


def thin_metric_records(df: DataFrame, roles: Roles, metrics: list[str], minimum: int) -> DataFrame:
    return suppression.metric_suppression(df, roles, metrics, minimum)


def hidden_outputs(df: DataFrame, roles: Roles, minimum: int) -> DataFrame:
    """Rate outputs to hide where their numerator is thin."""
    thin = thin_metric_records(df, roles, list(roles.numerators.values()), minimum)
    names = {c: n for n, c in roles.numerators.items()}
    output = F.coalesce(*[F.when(F.col("metric") == c, n) for c, n in names.items()])
    return thin.withColumn("output", output)


@query
def balanced_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = w.prepared_for(spark, sf_dir, BALANCED)
    records = suppression.suppress_thin_cells(df, BALANCED, 6)
    out = balanced.balanced_metrics(
        df,
        BALANCED,
        volume_weights(df, BALANCED),
        records,
        thin_metric_records(df, BALANCED, ["qty", "discount"], 7),
        hidden_outputs(df, BALANCED, 6),
    )
    return tidy(out)


@query
def balanced_export_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    roles = Roles("entity", ("brand", "linestatus"), metric="amount", secondary=("qty",), time="month", target="E3")
    df = w.prepared_for(spark, sf_dir, roles)
    out = balanced.balanced_export_share(
        df,
        roles,
        volume_weights(df, roles),
        suppression.suppress_thin_cells(df, roles, 6),
        thin_metric_records(df, roles, ["qty"], 7),
        calculated=True,
    )
    return tidy(out)


@query
def balanced_export_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = w.prepared_for(spark, sf_dir, BALANCED)
    out = balanced.balanced_export_rate(
        df,
        BALANCED,
        volume_weights(df, BALANCED),
        suppression.suppress_thin_cells(df, BALANCED, 5),
        thin_metric_records(df, BALANCED, ["txn", "qty", "discount"], 6),
        hidden_outputs(df, BALANCED, 5),
    )
    return tidy(out)


@query
def balanced_export_rate_calculated(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = w.prepared_for(spark, sf_dir, BALANCED)
    out = balanced.balanced_export_rate(
        df,
        BALANCED,
        volume_weights(df, BALANCED),
        None,
        None,
        hidden_outputs(df, BALANCED, 6),
        calculated=True,
    )
    return tidy(out)


