"""Queries: whole runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from peerlens.plans import run
from peerlens.plans import workload as w
from peerlens.plans.registry import query, tidy
from peerlens.roles import Roles
from peerlens.session import cut_lineage

RUN_SHARE = Roles("entity", ("brand", "linestatus"), metric="amount", time="month", target="E3")


def with_verdict(out: run.Run) -> DataFrame:
    """The published results, each row with the run's verdict."""
    verdict = cut_lineage(out.verdict)
    return out.results.select("*", *[verdict.select(c).scalar().alias(c) for c in verdict.columns])


@query
def run_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole share run by brand, line status and month."""
    out = run.run_share(w.fact_for(spark, sf_dir, RUN_SHARE), RUN_SHARE)
    return tidy(with_verdict(out), ("original_total_volume",))


@query
def run_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole rate run by priority, line status and year."""
    return tidy(with_verdict(run.run_rate(w.fact_for(spark, sf_dir, w.RATE), w.RATE)))
