"""Registered queries over the star-schema tables: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(run: Query) -> Query:
    """Register a query under its function name."""
    QUERIES[run.__name__] = run
    return run


def tidy(df: DataFrame, money: tuple[str, ...] = ()) -> DataFrame:
    """Round at the edge: money to cents, other doubles to six places."""
    out = []
    for name, kind in df.dtypes:
        column = F.col(f"`{name}`")
        if kind == "double":
            column = F.round(column, 2 if name in money else 6)
        elif kind in ("int", "smallint", "tinyint"):
            column = column.cast("bigint")
        out.append(column.alias(name))
    return df.select(*out)
