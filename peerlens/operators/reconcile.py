"""Compare an exported table with the results it should agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peerlens.functions.scalar import period_to_date

KEYS = ["dimension", "category", "time_period", "rate"]


def rates_of_export(export: DataFrame, total: str, numerators: dict[str, str]) -> DataFrame:
    """``KEYS, value`` from exported totals; a non-positive total gives no value."""
    pairs = F.array(
        *[
            F.struct(
                F.lit(name).alias("rate"),
                F.when(F.col(total) > 0, F.col(c) / F.col(total) * 100.0).alias("value"),
            )
            for name, c in numerators.items()
        ]
    )
    return export.select(
        "dimension", "category", "time_period", F.explode(pairs).alias("_r")
    ).select("dimension", "category", "time_period", "_r.*")


def reconcile_export(left: DataFrame, right: DataFrame, tolerance: float = 1e-4) -> DataFrame:
    """Outcome per key of two result tables ``KEYS, value``.

    ``passed`` within the tolerance, ``failed`` beyond it, ``skipped`` where a side
    is missing, null or ambiguous.  Periods are compared as ISO dates.
    """

    def side(df: DataFrame, name: str) -> DataFrame:
        keyed = df.withColumn("time_period", period_to_date(F.col("time_period")))
        return keyed.groupBy(*KEYS).agg(
            F.count("*").alias(f"{name}_rows"), F.max("value").alias(f"{name}_value")
        )

    mine, theirs = side(left, "left"), side(right, "right")
    renamed = theirs.select(*[F.col(k).alias(f"_k_{k}") for k in KEYS], "right_rows", "right_value")
    condition = None
    for k in KEYS:
        equal = mine[k].eqNullSafe(renamed[f"_k_{k}"])
        condition = equal if condition is None else condition & equal
    both = mine.join(renamed, condition, "full_outer")
    # A null key on both sides is a match, so presence is told by the row counts.
    keys = [
        F.when(F.col("left_rows").isNotNull(), F.col(k)).otherwise(F.col(f"_k_{k}")).alias(k)
        for k in KEYS
    ]
    reason = (
        F.when(F.col("left_rows").isNull() | F.col("right_rows").isNull(), "missing")
        .when((F.col("left_rows") > 1) | (F.col("right_rows") > 1), "ambiguous")
        .when(F.col("left_value").isNull() | F.col("right_value").isNull(), "null_value")
    )
    close = F.abs(F.col("left_value") - F.col("right_value")) <= tolerance
    return both.select(
        *keys,
        F.when(reason.isNotNull(), "skipped")
        .when(close, "passed")
        .otherwise("failed")
        .alias("outcome"),
        reason.alias("skip_reason"),
    )


def reconciliation_totals(outcomes: DataFrame) -> DataFrame:
    """Counts of passed, failed and skipped keys per dimension."""
    return outcomes.groupBy("dimension").agg(
        *[
            F.count_if(F.col("outcome") == name).alias(name)
            for name in ("passed", "failed", "skipped")
        ]
    )


