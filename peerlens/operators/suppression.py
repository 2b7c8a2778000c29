"""Suppression of thin cells and the joins that keep suppressed cells out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peerlens.operators.cells import (
    CELL,
    GENERAL,
    is_prepared,
    peers_only,
    positive,
    summed_with_flags,
)
from peerlens.roles import Roles
from peerlens.session import join_keys

REASONS = ("below_min_entities", "structurally_infeasible")


def participation(df: DataFrame, roles: Roles, metrics: list[str]) -> DataFrame:
    """Which entity has a positive row of which metric in which cell.

    ``CELL, peer, metric, positive, total``; the null category is a group of its
    own here.
    """
    timed = roles.time is not None
    if is_prepared(df):
        grouped = df.where(F.col("dimension").isin(*roles.dimensions))
    else:
        grouped = summed_with_flags(df, roles, metrics)
    grouped = peers_only(grouped, roles.target)
    if not timed:
        grouped = grouped.withColumn("time_period", F.lit(None).cast("string"))
        grouped = grouped.groupBy(*CELL, "peer").agg(
            *[F.max(positive(m)).alias(positive(m)) for m in metrics],
            *[F.sum(m).alias(m) for m in metrics],
        )
    per_metric = F.array(
        *[
            F.struct(
                F.lit(m).alias("metric"),
                F.coalesce(F.col(positive(m)), F.lit(False)).alias("positive"),
                F.coalesce(F.col(m), F.lit(0.0)).alias("total"),
            )
            for m in metrics
        ]
    )
    return grouped.select(*CELL, "peer", F.explode(per_metric).alias("_x")).select(
        *CELL, "peer", "_x.*"
    )


def thin_records(taking_part: DataFrame, min_entities: int, timed: bool) -> DataFrame:
    """Cells, and with a period also categories over all periods, below the minimum.

    A null ``time_period`` in a record stands for all periods.
    """
    keys = ["metric", *CELL]
    who = F.when(F.col("positive"), F.col("peer"))
    per_cell = taking_part.groupBy(*keys).agg(
        F.count(who).alias("participants"), F.sum("total").alias("cell_total")
    )
    if timed:
        overall = (
            taking_part.groupBy("metric", "dimension", "category", "peer")
            .agg(F.max("positive").alias("positive"), F.sum("total").alias("total"))
            .groupBy("metric", "dimension", "category")
            .agg(F.count(who).alias("participants"), F.sum("total").alias("cell_total"))
            .withColumn("time_period", F.lit(None).cast("string"))
        )
        per_cell = per_cell.where(F.col("time_period").isNotNull()).unionByName(overall)
    return per_cell.where(F.col("participants") < min_entities)


def suppress_thin_cells(
    df: DataFrame,
    roles: Roles,
    min_entities: int,
    infeasible: DataFrame | None = None,
) -> DataFrame:
    """Records of cells that must not be published, with the reason.

    ``infeasible`` is ``dimension, category`` of structurally infeasible pairs; a
    pair already recorded for all periods keeps its first reason.
    """
    thin = thin_records(
        participation(df, roles, [roles.metric]), min_entities, roles.time is not None
    ).select(*CELL, "participants", F.lit(0).alias("_order"))
    if infeasible is not None:
        thin = thin.unionByName(
            infeasible.select("dimension", "category").distinct().select(
                "dimension",
                "category",
                F.lit(None).cast("string").alias("time_period"),
                F.lit(0).cast("bigint").alias("participants"),
                F.lit(1).alias("_order"),
            )
        )
    first = thin.groupBy(*CELL).agg(F.min(F.struct("_order", "participants")).alias("_first"))
    return first.select(
        *CELL,
        F.col("_first.participants").alias("participants"),
        F.element_at(F.array(*[F.lit(r) for r in REASONS]), F.col("_first._order") + 1).alias("reason"),
    )


def metric_suppression(
    df: DataFrame, roles: Roles, metrics: list[str], min_entities: int, basis: str | None = None
) -> DataFrame:
    """Thin cells per secondary metric.

    A zero-total cell publishes nothing and is ignored, unless the metric is the
    mandatory ``basis`` of a rate.
    """
    thin = thin_records(participation(df, roles, metrics), min_entities, roles.time is not None)
    counts = (F.col("cell_total") != 0) | (
        F.col("metric") == F.lit(basis) if basis is not None else F.lit(False)
    )
    return thin.where(counts).select("metric", *CELL, "participants")


def filter_suppressed(rows: DataFrame, records: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """Drop rows with a record of the same cell, or of its category for all periods.

    The wildcard is split into two hashed anti joins instead of one join on an
    OR condition, which Spark could only run as a nested loop.
    """
    extra = extra or []
    anywhere = records.where(F.col("time_period").isNull()).select(*extra, "dimension", "category")
    exact = records.where(F.col("time_period").isNotNull()).select(*extra, *CELL)
    kept = join_keys(rows, anywhere.distinct(), [*extra, "dimension", "category"], "left_anti")
    return join_keys(kept, exact.distinct(), [*extra, *CELL], "left_anti")


def mark_suppressed(
    rows: DataFrame, records: DataFrame, flags: dict[str, str], column: str = "metric"
) -> DataFrame:
    """Boolean columns telling which values of ``column`` are suppressed in a row's cell.

    ``flags`` maps value to column name.  All values share one pair of joins: the
    records are first folded to one row of flags per cell.
    """

    def folded(part: DataFrame, keys: list[str], prefix: str) -> DataFrame:
        return part.groupBy(*keys).agg(
            *[F.max(F.col(column) == v).alias(f"{prefix}{i}") for i, v in enumerate(flags)]
        )

    wanted = records.where(F.col(column).isin(*flags))
    anywhere = folded(wanted.where(F.col("time_period").isNull()), ["dimension", "category"], "_a")
    exact = folded(wanted.where(F.col("time_period").isNotNull()), CELL, "_e")
    joined = join_keys(rows, anywhere, ["dimension", "category"], "left")
    joined = join_keys(joined, exact, CELL, "left")
    marks = [
        (F.coalesce(f"_a{i}", F.lit(False)) | F.coalesce(f"_e{i}", F.lit(False))).alias(name)
        for i, name in enumerate(flags.values())
    ]
    return joined.select(*rows.columns, *marks)


def filter_metric_suppressed(
    rows: DataFrame, records: DataFrame | None, metrics: dict[str, list[str]], column: str = "metric"
) -> DataFrame:
    """Null out a metric's columns where that metric is suppressed; keep the row.

    ``metrics`` maps metric name to output columns.
    """
    if records is None or not metrics:
        return rows
    flags = {metric: f"_s{i}" for i, metric in enumerate(metrics)}
    marked = mark_suppressed(rows, records, flags, column)
    hidden = {c: flags[m] for m, names in metrics.items() for c in names}
    return marked.select(
        *[
            (F.when(~F.col(hidden[c]), F.col(c)) if c in hidden else F.col(c)).alias(c)
            for c in rows.columns
        ]
    )


def filter_release_set(rows: DataFrame, released: DataFrame) -> DataFrame:
    """Keep rows whose cell is released; ``General`` and blank mean no period.

    With a period column the ``General`` rows match no released unit and drop out.
    """
    label = F.trim(F.col("time_period"))
    period = F.when((label == "") | (label == GENERAL), F.lit(None)).otherwise(label)
    keyed = rows.withColumn("_period", period)
    units = released.select("dimension", "category", F.col("time_period").alias("_period")).distinct()
    return join_keys(keyed, units, ["dimension", "category", "_period"], "left_semi").drop("_period")


def safe_entities(df: DataFrame, roles: Roles, records: DataFrame) -> DataFrame:
    """Entities with a positive metric in at least one unsuppressed cell, by period."""
    everyone = Roles(roles.entity, roles.dimensions, time=roles.time)
    present = participation(df, everyone, [roles.metric]).where(F.col("positive"))
    return filter_suppressed(present, records).select("peer", "time_period").distinct()


def filter_safe_entities(diagnostics: DataFrame, safe: DataFrame) -> DataFrame:
    """Keep diagnostics rows of safe entities only."""
    return diagnostics.join(safe.select("peer").distinct(), "peer", "left_semi")


def filter_safe_periods(totals: DataFrame, safe: DataFrame) -> DataFrame:
    """Keep whole-period rows only for periods that still show a safe entity."""
    return totals.join(
        safe.where(F.col("time_period").isNotNull()).select("time_period").distinct(),
        "time_period",
        "left_semi",
    )
