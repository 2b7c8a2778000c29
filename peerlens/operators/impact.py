"""What weighting does to published figures, and summaries of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peerlens.operators.cells import CELL, aggregate_cells, is_prepared, percent, usable
from peerlens.operators.weights import attach_weights
from peerlens.roles import Roles


def share_impact(df: DataFrame, roles: Roles, weights: DataFrame | None, extra: list[str] | None = None) -> DataFrame:
    """Target's market share raw and with weighted peers, per cell.

    Rows with a null or negative metric are left out.  The target keeps weight 1.
    With ``extra`` keys (such as ``run_id``) in ``weights``, every run is answered
    at once.
    """
    if is_prepared(df):
        # Cells all of whose rows are unusable do not exist, as if made from the facts.
        name = usable(roles.metric)
        kept, value = df.where(F.col(name).isNotNull()), name
    else:
        kept, value = df.where(F.col(roles.metric) >= 0), roles.metric
    cells = aggregate_cells(kept, roles, [value], with_whole=False).withColumnRenamed(value, "v")
    if roles.time:
        cells = cells.where(F.col("time_period").isNotNull())
    return share_impact_of_cells(cells, roles.target, weights, extra)


def share_impact_of_cells(
    cells: DataFrame, target: str, weights: DataFrame | None, extra: list[str] | None = None
) -> DataFrame:
    """``share_impact`` from ready cells ``[extra,] CELL, peer, v`` (target included)."""
    keys = [*(extra or []), *CELL]
    rows = attach_weights(cells, weights, extra)
    mine = F.col("peer") == F.lit(target)
    sums = rows.groupBy(*keys).agg(
        F.sum(F.when(mine, F.col("v")).otherwise(0.0)).alias("entity_volume"),
        F.sum("v").alias("raw_total_volume"),
        F.sum(F.when(mine, F.col("v")).otherwise(F.col("v") * F.col("m"))).alias(
            "balanced_total_volume"
        ),
    )
    raw = percent(F.col("entity_volume"), F.col("raw_total_volume"))
    balanced = percent(F.col("entity_volume"), F.col("balanced_total_volume"))
    return sums.withColumn("raw_share_pct", raw).withColumn("balanced_share_pct", balanced).withColumn(
        "impact_pp", F.col("balanced_share_pct") - F.col("raw_share_pct")
    )


def rate_impact(df: DataFrame, roles: Roles, weights: DataFrame | None) -> DataFrame:
    """Raw and weighted peer rate per cell and rate, long form with column ``rate``."""
    columns = [roles.total, *dict.fromkeys(roles.numerators.values())]
    cells = aggregate_cells(df, roles, columns, with_whole=False)
    if roles.time:
        cells = cells.where(F.col("time_period").isNotNull())
    return rate_impact_of_cells(cells, roles, weights)


def rate_impact_of_cells(
    cells: DataFrame, roles: Roles, weights: DataFrame | None, extra: list[str] | None = None
) -> DataFrame:
    """``rate_impact`` from ready cells ``[extra,] CELL, peer, total and numerators``, the target included."""
    keys = [*(extra or []), *CELL]
    if roles.target is not None:
        cells = cells.where(F.col("peer") != F.lit(roles.target))
    rows = attach_weights(cells, weights, extra)
    sums = rows.groupBy(*keys).agg(
        F.sum(roles.total).alias("_d"),
        F.sum(F.col(roles.total) * F.col("m")).alias("_wd"),
        *[F.sum(c).alias(f"_n_{name}") for name, c in roles.numerators.items()],
        *[F.sum(F.col(c) * F.col("m")).alias(f"_wn_{name}") for name, c in roles.numerators.items()],
    )
    per_rate = F.array(
        *[
            F.struct(
                F.lit(name).alias("rate"),
                percent(F.col(f"_n_{name}"), F.col("_d")).alias("raw_pct"),
                percent(F.col(f"_wn_{name}"), F.col("_wd")).alias("balanced_pct"),
            )
            for name in roles.numerators
        ]
    )
    return (
        sums.select(*keys, F.explode(per_rate).alias("_r"))
        .select(*keys, "_r.*")
        .withColumn("impact_pp", F.col("balanced_pct") - F.col("raw_pct"))
    )


def with_distortion_alias(impact: DataFrame) -> DataFrame:
    """Legacy column name of share impact."""
    return impact.withColumn("distortion_pp", F.col("impact_pp"))


def with_weight_effect_alias(impact: DataFrame) -> DataFrame:
    """Legacy column name of rate impact."""
    return impact.withColumn("weight_effect_pp", F.col("impact_pp"))


def impact_summary(impact: DataFrame, rate: bool = False) -> DataFrame:
    """Mean, extremes, sample deviation and count: overall, by dimension, by period.

    Share mode summarises by period too (null periods left out); rate mode does it
    per rate instead.
    """
    lead = ["rate"] if rate else []
    by = ["dimension"] if rate else ["dimension", "time_period"]
    # One pass: grouping sets over the (already small) impact rows.
    sets = [lead, *[[*lead, b] for b in by]]
    grouped = impact.groupingSets(sets, *lead, *by).agg(
        F.grouping("dimension").alias("_gd"),
        (F.lit(1) if rate else F.grouping("time_period")).alias("_gt"),
        F.avg("impact_pp").alias("mean_impact_pp"),
        F.min("impact_pp").alias("min_impact_pp"),
        F.max("impact_pp").alias("max_impact_pp"),
        F.coalesce(F.stddev_samp("impact_pp"), F.lit(0.0)).alias("std_impact_pp"),
        F.count("*").alias("n"),
    )
    level = F.when(F.col("_gd") == 0, F.col("dimension"))
    if not rate:
        # A null period is no period of its own.
        grouped = grouped.where((F.col("_gt") == 1) | F.col("time_period").isNotNull())
        level = level.when(F.col("_gt") == 0, F.col("time_period"))
    return grouped.select(
        *lead,
        F.when(F.col("_gd") == 0, "By Dimension")
        .when(F.col("_gt") == 0, "By Time Period")
        .otherwise("Overall")
        .alias("aggregation"),
        level.otherwise("All Data").alias("level"),
        "mean_impact_pp",
        "min_impact_pp",
        "max_impact_pp",
        "std_impact_pp",
        "n",
    )


def impact_summary_filtered(impact: DataFrame, rate: bool = False) -> DataFrame:
    """Overall and per-dimension size of the impact on the authorised rows.

    With several rates each cell first averages over its rates.
    """
    if rate:
        impact = impact.groupBy(*CELL).agg(F.avg("impact_pp").alias("impact_pp"))
    size = F.abs(F.col("impact_pp"))
    per_dimension = impact.groupBy("dimension").agg(
        F.sum("impact_pp").alias("_s"),
        F.sum(size).alias("_a"),
        F.max(size).alias("max_abs_impact_pp"),
        F.min("impact_pp").alias("min_impact_pp"),
        F.max("impact_pp").alias("max_impact_pp"),
        F.count("impact_pp").alias("n"),
        F.stddev_samp("impact_pp").alias("_sd"),
    )
    by_dimension = per_dimension.select(
        "dimension",
        (F.col("_s") / F.col("n")).alias("mean_impact_pp"),
        (F.col("_a") / F.col("n")).alias("mean_abs_impact_pp"),
        "max_abs_impact_pp",
        F.coalesce("_sd", F.lit(0.0)).alias("std_impact_pp"),
        "min_impact_pp",
        "max_impact_pp",
        "n",
    )
    overall = impact.agg(
        F.avg("impact_pp").alias("mean_impact_pp"),
        F.avg(size).alias("mean_abs_impact_pp"),
        F.max(size).alias("max_abs_impact_pp"),
        F.coalesce(F.stddev_samp("impact_pp"), F.lit(0.0)).alias("std_impact_pp"),
        F.min("impact_pp").alias("min_impact_pp"),
        F.max("impact_pp").alias("max_impact_pp"),
        F.count("impact_pp").alias("n"),
    ).select(F.lit("All Data").alias("dimension"), "*")
    return overall.unionByName(by_dimension)
