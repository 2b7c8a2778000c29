"""The driver contract on the smallest data."""

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, compare

SF = "/root/testdata/sf0.001"
SAMPLE = (
    "share_analysis", "rate_analysis", "balanced_export_rate", "suppress_thin_cells", "evaluate_rule", "rule_sweep",
    "fit_weights", "privacy_validation", "release_partition", "prune_unit_rules", "who_report", "usage_stream",
)


def test_every_oracle_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, con, name):
    problem, _ = compare(entry.queries()[name](spark, SF), con, entry.oracle_sql()[name])
    assert problem is None
