"""Session helpers shared by the operators."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Make reliable checkpoints possible.

    The folder comes from ``spark.checkpoint.dir``.  A throw-away folder is made
    only in local mode; on a cluster a missing setting is an error, because a
    machine-local folder would not survive the loss of an executor.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        context.setCheckpointDir(configured)
    elif context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="peerlens-checkpoint-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a shared folder")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back.

    Used for compact tables that a run reads several times (the facts are then
    scanned once) and between fitting rounds (the plan stays short, and a lost
    executor costs only a re-read).
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def join_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` where null matches null; right keys are dropped.

    Spark turns ``<=>`` into an ordinary hashed join key, so this stays a
    shuffled or broadcast hash/merge join.
    """
    renamed = right.select(
        *[F.col(k).alias(f"_r_{k}") for k in keys],
        *[c for c in right.columns if c not in keys],
    )
    condition: Column = reduce(
        lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"_r_{k}"]) for k in keys], F.lit(True)
    )
    joined = left.join(renamed, condition, how)
    if how in ("left_semi", "left_anti"):
        return joined
    return joined.drop(*[f"_r_{k}" for k in keys])


def add_group_values(df: DataFrame, keys: list[str], **aggregates: Column) -> DataFrame:
    """Attach group aggregates to every row.

    Equivalent to unordered window aggregates, but built from a map-side
    combined ``groupBy`` and a join on the (one row per group) result, so a group
    holding a large part of all rows is never gathered into one task.
    """
    totals = df.groupBy(*keys).agg(*[c.alias(n) for n, c in aggregates.items()])
    return join_keys(df, totals, keys)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared checkpoint folder for a written table."""
    ensure_checkpoint_dir(spark)
    base = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return f"{base}/{name}-{uuid.uuid4().hex}"


def small_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as files in the shared folder and read it back, so that joins know how small it is."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
