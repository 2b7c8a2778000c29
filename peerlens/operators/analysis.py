"""Share and rate analysis of a target against its weighted peers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peerlens.functions.ordered import weighted_percentile
from peerlens.operators.cells import (
    CELL,
    GENERAL,
    over_all_periods,
    percent,
    ready_cells,
)
from peerlens.operators.weights import attach_weights
from peerlens.roles import Roles
from peerlens.session import join_keys

# Best-in-class percentiles.
SHARE_PERCENTILE = 0.85
RATE_PERCENTILES = {"approval": 0.85, "fraud": 0.15}


def with_general_rows(cells: DataFrame, roles: Roles, metrics: list[str]) -> DataFrame:
    """Timed runs report each period and a ``General`` row over all periods."""
    if not roles.time:
        return cells
    timed = cells.where(F.col("time_period").isNotNull())
    return timed.unionByName(over_all_periods(cells, metrics, GENERAL))


def share_analysis(
    df: DataFrame,
    roles: Roles,
    weights: DataFrame | None = None,
    percentile: float = SHARE_PERCENTILE,
) -> DataFrame:
    """How each entity's metric splits over categories, target against peers.

    A peer missing from a category has share 0 there and keeps its total in the
    denominator.  Those absent peers all look alike, so each cell gets one row
    carrying their combined weight instead of a category x peer grid.
    """
    summed = ready_cells(df, roles, [roles.metric])
    cells = with_general_rows(summed, roles, [roles.metric]).withColumnRenamed(roles.metric, "v")
    block = ["dimension", "time_period"]
    is_target = (
        F.col("peer") == F.lit(roles.target) if roles.target is not None else F.lit(False)
    )
    own = attach_weights(
        cells.groupBy(*block, "peer").agg(F.sum("v").alias("own_total")), weights
    ).withColumn("is_target", is_target)
    peer_total = F.when(~F.col("is_target"), F.col("own_total"))
    per_block = own.groupBy(*block).agg(
        F.sum(peer_total * F.col("m")).alias("_weighted_total"),
        F.sum(peer_total).alias("_raw_total"),
        F.sum(F.when(peer_total > 0, peer_total * F.col("m"))).alias("_all_weight"),
        F.sum(F.when(peer_total > 0, 1).otherwise(0)).alias("_all_peers"),
        F.max(F.when(F.col("is_target"), F.col("own_total"))).alias("_target_total"),
    )
    rows = join_keys(cells, own, [*block, "peer"])
    peer_v = F.when(~F.col("is_target"), F.col("v"))
    counted = (~F.col("is_target")) & (F.col("own_total") > 0)
    per_cell = rows.groupBy(*CELL).agg(
        F.sum(peer_v * F.col("m")).alias("_weighted"),
        F.sum(peer_v).alias("_raw"),
        F.count(peer_v).alias("_rows"),
        F.sum(F.when(counted, F.col("own_total") * F.col("m")).otherwise(0.0)).alias("_weight"),
        F.sum(F.when(counted, 1).otherwise(0)).alias("_peers"),
        F.sum(F.when(F.col("is_target"), F.col("v")).otherwise(0.0)).alias("_target"),
    )
    published = join_keys(per_cell.where(F.col("_rows") > 0), per_block, block)
    present = rows.where(counted).select(
        *CELL,
        (F.col("v") / F.col("own_total") * 100.0).alias("x"),
        (F.col("own_total") * F.col("m")).alias("w"),
    )
    absent = published.where(F.col("_all_peers") > F.col("_peers")).select(
        *CELL, F.lit(0.0).alias("x"), (F.col("_all_weight") - F.col("_weight")).alias("w")
    )
    bic = weighted_percentile(present.unionByName(absent), CELL, "x", "w", percentile, "bic_pct")
    result = join_keys(published, bic, CELL, "left").select(
        *CELL,
        percent(F.col("_weighted"), F.col("_weighted_total")).alias("balanced_peer_average_pct"),
        F.coalesce("bic_pct", F.lit(0.0)).alias("bic_pct"),
        percent(F.col("_raw"), F.col("_raw_total")).alias("original_peer_average_pct"),
        F.col("_raw").alias("original_total_volume"),
        F.coalesce(
            percent(F.col("_target"), F.col("_target_total")), F.lit(0.0)
        ).alias("target_share_pct"),
    )
    result = result.withColumn(
        "impact_pp", F.col("balanced_peer_average_pct") - F.col("original_peer_average_pct")
    )
    if roles.target is None:
        return result.drop("target_share_pct")
    return result.withColumn(
        "distance_to_peer_pp", F.col("target_share_pct") - F.col("balanced_peer_average_pct")
    )


def rate_cells(df: DataFrame, roles: Roles) -> DataFrame:
    """Cells of all rates, long: ``rate, CELL, peer, num, den``."""
    columns = [roles.total, *dict.fromkeys(roles.numerators.values())]
    summed = ready_cells(df, roles, columns)
    cells = with_general_rows(summed, roles, columns)
    pairs = F.array(
        *[
            F.struct(F.lit(name).alias("rate"), F.col(column).alias("num"))
            for name, column in roles.numerators.items()
        ]
    )
    return cells.select(*CELL, "peer", F.col(roles.total).alias("den"), F.explode(pairs).alias("_r")).select(
        F.col("_r.rate").alias("rate"), *CELL, "peer", F.col("_r.num").alias("num"), "den"
    )


def rate_analysis(
    df: DataFrame,
    roles: Roles,
    weights: DataFrame | None = None,
    percentiles: dict[str, float] | None = None,
) -> DataFrame:
    """Target rate, weighted peer rate and best-in-class rate, all rates at once."""
    percentiles = percentiles or RATE_PERCENTILES
    p = F.coalesce(
        *[F.when(F.col("rate") == name, F.lit(percentiles.get(name, 0.85))) for name in roles.numerators]
    )
    is_target = (
        F.col("peer") == F.lit(roles.target) if roles.target is not None else F.lit(False)
    )
    rows = attach_weights(rate_cells(df, roles), weights).withColumn("is_target", is_target)
    keys = ["rate", *CELL]
    peer = ~F.col("is_target")
    counted = peer & (F.col("den") > 0)
    per_cell = rows.groupBy(*keys).agg(
        F.sum(F.when(counted, F.col("num") * F.col("m")).otherwise(0.0)).alias("_wn"),
        F.sum(F.when(peer, F.col("den") * F.col("m"))).alias("_wd"),
        F.sum(F.when(peer, F.col("num"))).alias("_n"),
        F.sum(F.when(peer, F.col("den"))).alias("_d"),
        F.sum(F.when(F.col("is_target"), F.col("num")).otherwise(0.0)).alias("_tn"),
        F.sum(F.when(F.col("is_target"), F.col("den")).otherwise(0.0)).alias("_td"),
    ).where(F.col("_d").isNotNull())
    values = rows.where(counted).select(
        *keys,
        (F.col("num") / F.col("den") * 100.0).alias("x"),
        (F.col("den") * F.col("m")).alias("w"),
        p.alias("p"),
    )
    bic = weighted_percentile(values, keys, "x", "w", "p", "bic_pct")
    result = join_keys(per_cell, bic, keys, "left").select(
        *keys,
        percent(F.col("_wn"), F.col("_wd")).alias("balanced_peer_average_pct"),
        F.coalesce("bic_pct", F.lit(0.0)).alias("bic_pct"),
        percent(F.col("_n"), F.col("_d")).alias("original_peer_average_pct"),
        F.col("_n").alias("original_total_numerator"),
        F.col("_d").alias("original_total_denominator"),
        percent(F.col("_tn"), F.col("_td")).alias("target_rate_pct"),
    )
    result = result.withColumn(
        "impact_pp", F.col("balanced_peer_average_pct") - F.col("original_peer_average_pct")
    )
    if roles.target is None:
        return result.drop("target_rate_pct")
    return result.withColumn(
        "distance_to_peer_pp", F.col("target_rate_pct") - F.col("balanced_peer_average_pct")
    )


def zero_bic_warning(results: DataFrame) -> DataFrame:
    """Count of rate results whose best-in-class value is practically zero."""
    hit = F.abs(F.col("bic_pct")) <= 1e-9
    return results.groupBy("rate", "dimension").agg(
        F.count_if(hit).alias("zero_bic_rows"), F.max(hit).alias("warn")
    )
