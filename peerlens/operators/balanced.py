"""Weighted metric tables for publication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peerlens.operators.cells import CELL, aggregate_cells, percent
from peerlens.operators.suppression import (
    filter_metric_suppressed,
    filter_suppressed,
    mark_suppressed,
)
from peerlens.operators.weights import attach_weights
from peerlens.roles import Roles


def _published_cells(
    df: DataFrame, roles: Roles, metrics: list[str], suppressed: DataFrame | None
) -> DataFrame:
    cells = aggregate_cells(df, roles, metrics, with_whole=False)
    if roles.time:
        cells = cells.where(F.col("time_period").isNotNull())
    return cells if suppressed is None else filter_suppressed(cells, suppressed)


def _mark_outputs(rows: DataFrame, records: DataFrame | None, outputs: list[str]) -> DataFrame:
    """Columns ``_hide_<output>`` for the rate outputs."""
    if records is None:
        return rows.select("*", *[F.lit(False).alias(f"_hide_{o}") for o in outputs])
    return mark_suppressed(rows, records, {o: f"_hide_{o}" for o in outputs}, "output")


def balanced_metrics(
    df: DataFrame,
    roles: Roles,
    weights: DataFrame | None = None,
    suppressed: DataFrame | None = None,
    suppressed_metrics: DataFrame | None = None,
    suppressed_outputs: DataFrame | None = None,
) -> DataFrame:
    """Weighted sums of every metric per cell; the target counts with weight 1.

    ``suppressed_metrics`` has column ``metric``; ``suppressed_outputs`` has column
    ``output`` (``approval`` governs the total as well, or ``fraud``).
    """
    outputs: dict[str, str] = {}
    if roles.metric:
        outputs[roles.metric] = f"balanced_{roles.metric}"
    if roles.total and (not roles.numerators or "approval" in roles.numerators):
        outputs[roles.total] = "balanced_total"
    for name, column in roles.numerators.items():
        outputs[column] = f"balanced_{name}_total"
    for column in roles.secondary:
        outputs[column] = column
    rows = attach_weights(_published_cells(df, roles, list(outputs), suppressed), weights)
    sums = rows.groupBy(*CELL).agg(
        *[F.sum(F.col(c) * F.col("m")).alias(o) for c, o in outputs.items()]
    )
    sums = filter_metric_suppressed(sums, suppressed_metrics, {c: [o] for c, o in outputs.items()})
    by_output = {
        "approval": ["balanced_total", "balanced_approval_total"],
        "fraud": ["balanced_fraud_total"],
    }
    return filter_metric_suppressed(sums, suppressed_outputs, by_output, "output")


def balanced_export_share(
    df: DataFrame,
    roles: Roles,
    weights: DataFrame | None = None,
    suppressed: DataFrame | None = None,
    suppressed_metrics: DataFrame | None = None,
    calculated: bool = False,
) -> DataFrame:
    """Weighted peer sums per cell without the target.

    ``calculated`` adds raw sums and, with a target, its share against raw and
    weighted peers and the difference.
    """
    metrics = [roles.metric, *roles.secondary]
    rows = attach_weights(_published_cells(df, roles, metrics, suppressed), weights)
    mine = F.col("peer") == F.lit(roles.target) if roles.target is not None else F.lit(False)
    sums = rows.groupBy(*CELL).agg(
        *[
            F.sum(F.when(~mine, F.col(c) * F.col("m")).otherwise(0.0)).alias(f"balanced_{c}")
            for c in metrics
        ],
        *[F.sum(F.when(~mine, F.col(c)).otherwise(0.0)).alias(f"raw_{c}") for c in metrics],
        *[F.sum(F.when(mine, F.col(c)).otherwise(0.0)).alias(f"_t_{c}") for c in metrics],
    )
    columns: dict[str, list[str]] = {}
    for c in metrics:
        columns[c] = [f"balanced_{c}"]
        if not calculated:
            continue
        columns[c] += [f"raw_{c}", f"raw_{c}_share_pct", f"balanced_{c}_share_pct", f"{c}_impact_pp"]
        target = F.col(f"_t_{c}") if roles.target is not None else F.lit(None).cast("double")
        for kind in ("raw", "balanced"):
            whole = target + F.col(f"{kind}_{c}")
            sums = sums.withColumn(
                f"{kind}_{c}_share_pct", F.when(whole.isNotNull(), percent(target, whole))
            )
        sums = sums.withColumn(
            f"{c}_impact_pp", F.col(f"balanced_{c}_share_pct") - F.col(f"raw_{c}_share_pct")
        )
    sums = filter_metric_suppressed(sums, suppressed_metrics, columns)
    return sums.select(*CELL, *[x for names in columns.values() for x in names])


def balanced_export_rate(
    df: DataFrame,
    roles: Roles,
    weights: DataFrame | None = None,
    suppressed: DataFrame | None = None,
    suppressed_metrics: DataFrame | None = None,
    suppressed_outputs: DataFrame | None = None,
    calculated: bool = False,
) -> DataFrame:
    """Weighted total and numerators of the peers per cell, target left out.

    The total shows only where some numerator of the cell may; a zero weighted
    numerator becomes null in the short form; rows with nothing but keys drop out.
    ``calculated`` replaces the short columns by totals, rates and impacts.
    """
    numerators = roles.numerators
    metrics = [roles.total, *numerators.values(), *roles.secondary]
    cells = _published_cells(df, roles, metrics, suppressed)
    rows = attach_weights(cells, weights)
    peers = (
        (F.col("peer") != F.lit(roles.target)) if roles.target is not None else F.lit(True)
    )
    sums = rows.groupBy(*CELL).agg(
        *[F.sum(F.when(peers, F.col(c) * F.col("m")).otherwise(0.0)).alias(f"_b_{c}") for c in metrics],
        *[F.sum(F.when(peers, F.col(c)).otherwise(0.0)).alias(f"_r_{c}") for c in metrics],
    )
    sums = _mark_outputs(sums, suppressed_outputs, list(numerators))
    shown = F.lit(False)
    for name in numerators:
        shown = shown | ~F.col(f"_hide_{name}")
    total = roles.total
    if suppressed_metrics is not None:
        flags = {m: f"_hide_m_{m}" for m in (total, *roles.secondary)}
        sums = mark_suppressed(sums, suppressed_metrics, flags)
        shown = shown & ~F.col(f"_hide_m_{total}")
    made: dict[str, Column] = {}
    if calculated:
        made["raw_total"] = F.when(shown, F.col(f"_r_{total}"))
        made["balanced_total"] = F.when(shown, F.col(f"_b_{total}"))
        for name, c in numerators.items():
            visible = ~F.col(f"_hide_{name}")
            raw = percent(F.col(f"_r_{c}"), F.col(f"_r_{total}"))
            weighted = percent(F.col(f"_b_{c}"), F.col(f"_b_{total}"))
            made[f"balanced_{name}_total"] = F.when(visible, F.col(f"_b_{c}"))
            made[f"raw_{name}_rate_pct"] = F.when(visible, raw)
            made[f"balanced_{name}_rate_pct"] = F.when(visible, weighted)
            made[f"{name}_impact_pp"] = F.when(visible, weighted - raw)
    else:
        made[total] = F.when(shown, F.col(f"_b_{total}"))
        for name, c in numerators.items():
            made[c] = F.when(~F.col(f"_hide_{name}") & (F.col(f"_b_{c}") > 0), F.col(f"_b_{c}"))
        for c in roles.secondary:
            made[c] = F.col(f"_b_{c}")
            if suppressed_metrics is not None:
                made[c] = F.when(~F.col(f"_hide_m_{c}"), made[c])
    # A cell with every surface hidden would be a row of keys only.
    visible_any = shown
    for name in numerators:
        visible_any = visible_any | ~F.col(f"_hide_{name}")
    for c in () if calculated else roles.secondary:
        visible_any = visible_any | made[c].isNotNull()
    return sums.where(visible_any).select(*CELL, *[v.alias(n) for n, v in made.items()])
