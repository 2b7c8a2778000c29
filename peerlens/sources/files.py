"""Tabular sources: CSV, SQL text and tables, with pruning and pre-aggregation."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from peerlens.operators.schema import normalize_columns, normalized_names
from peerlens.roles import Roles

IDENTIFIER = r"[A-Za-z_]\w*(\.[A-Za-z_]\w*)?"


def read_long_csv(
    spark: SparkSession, path: str, schema: T.StructType | None = None, limit: int | None = None
) -> DataFrame:
    """Header CSV with normalised names.

    Without a ``schema`` a column is a number if all its values are, else text, so
    labels such as ``2024-01`` stay as they are.  Finding that out takes one more
    pass; give a schema for large inputs.
    """
    reader = spark.read.option("header", True)
    df = normalize_columns(reader.schema(schema).csv(path) if schema else reader.csv(path))
    if limit is not None:
        df = df.limit(limit)
    if schema:
        return df
    number = {c: F.expr(f"try_cast(`{c}` AS DOUBLE)") for c in df.columns}
    # One row of flags to the driver.
    numeric = df.agg(
        *[((F.count(c) > 0) & (F.count(c) == F.count(number[c]))).alias(c) for c in df.columns]
    ).first()
    return df.select(*[(number[c] if numeric[c] else F.col(c)).alias(c) for c in df.columns])


def requested_columns(roles: Roles, dimensions_known: bool = True) -> list[str] | None:
    """Columns a run needs, or ``None`` (all) when dimensions are still unknown."""
    if not dimensions_known:
        return None
    wanted = [
        roles.entity,
        *roles.dimensions,
        roles.time,
        roles.metric,
        roles.total,
        *roles.numerators.values(),
        *roles.secondary,
    ]
    return normalized_names(dict.fromkeys(c for c in wanted if c))


def project_requested(df: DataFrame, columns: list[str] | None) -> tuple[DataFrame, list[str]]:
    """Only the requested columns, and the names that were not found."""
    if columns is None:
        return df, []
    present = [c for c in columns if c in df.columns]
    return df.select(*present), [c for c in columns if c not in df.columns]


def preaggregate(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Sum the values by key: null keys stay, unreadable numbers become null.

    An all-null sum stays null.
    """
    numbers = [F.sum(F.expr(f"try_cast(`{v}` AS DOUBLE)")).alias(v) for v in values]
    return df.groupBy(*keys).agg(*numbers)


def read_sql_query(spark: SparkSession, path: str) -> DataFrame:
    """Run the statement held in a text file against the session catalog.

    The path must name exactly one file.
    """
    texts = spark.read.text(path, wholetext=True).take(2)
    if len(texts) != 1:
        raise ValueError(f"not exactly one statement file: {path!r}")
    return normalize_columns(spark.sql(texts[0]["value"].strip().rstrip(";")))


def read_sql_table(spark: SparkSession, name: str) -> DataFrame:
    """All columns of ``table`` or ``schema.table``; anything else is refused."""
    if not re.fullmatch(IDENTIFIER, name):
        raise ValueError(f"not a table name: {name!r}")
    return normalize_columns(spark.table(name))


def read_jdbc(spark: SparkSession, url: str, *, query: str | None = None, table: str | None = None, **options: str) -> DataFrame:
    """The same two forms over JDBC; partitioning options pass through."""
    reader = spark.read.format("jdbc").option("url", url).options(**options)
    if query is not None:
        return normalize_columns(reader.option("query", query).load())
    if table is None or not re.fullmatch(IDENTIFIER, table):
        raise ValueError(f"not a table name: {table!r}")
    return normalize_columns(reader.option("dbtable", table).load())
