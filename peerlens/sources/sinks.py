"""Result writers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peerlens.functions.scalar import sanitize_cell


def write_results(results: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV with header, one folder per dimension."""
    results.write.mode(mode).partitionBy("dimension").option("header", True).csv(path)


def write_results_json(results: DataFrame, path: str, analysis: str, mode: str = "errorifexists") -> None:
    """JSON records that carry the schema version and kind of analysis."""
    result_records(results, analysis).write.mode(mode).json(path)


def result_records(results: DataFrame, analysis: str) -> DataFrame:
    return results.select(
        F.lit(1).alias("schema_version"), F.lit(analysis).alias("analysis_type"), "*"
    )


def sanitized(rows: DataFrame) -> DataFrame:
    """Make every text column safe for spreadsheets."""
    return rows.select(
        *[
            (sanitize_cell(F.col(name)) if kind == "string" else F.col(name)).alias(name)
            for name, kind in rows.dtypes
        ]
    )


def write_balanced(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Balanced export, globally sorted by dimension, period and category."""
    order = [c for c in ("dimension", "time_period", "category") if c in rows.columns]
    sanitized(rows).orderBy(*order).write.mode(mode).option("header", True).csv(path)
