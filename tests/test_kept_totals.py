"""Totals that a stream keeps against the batch reports, with late events, restarts and batches that run twice."""

import datetime
import random

import pytest

from peerlens.sources import events as ev
from peerlens.streaming import usage

SCHEMA = "ts timestamp, user string, event string, surface string, action string, session_id string"
KINDS = ("session_start", "session_end", "surface_viewed", "action_attempted", "action_completed", "action_refused", "action_failed")


def some_events(n, seed=1):
    """Events in no order of time, some of them many days late, in a session or two of few users."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        kind = rng.choice(KINDS)
        ts = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc) + datetime.timedelta(seconds=rng.randrange(20 * 86400))
        surface = rng.choice(("share", "rate", "other")) if kind == "surface_viewed" else None
        action = rng.choice(("share_analysis", "rate_analysis", "x")) if kind.startswith("action") else None
        out.append((ts, rng.choice("abc"), kind, surface, action, f"s{rng.randrange(9)}"))
    return out


def arrive(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def run(spark, folder, path, state, fan_in):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    usage.keep_totals(stream, path, state, fan_in).awaitTermination()


def equal(spark, path, rows, fan_in):
    events, totals = spark.createDataFrame(rows, SCHEMA), usage.read_totals(spark, path, fan_in).cache()
    assert sorted(usage.who_of_totals(totals).collect()) == sorted(ev.who_report(events).collect())
    assert sorted(usage.summary_of_totals(totals).collect()) == sorted(ev.usage_summary(events).collect())
    got = {(r["day"].isoformat(), r["event"]): r["n"] for r in usage.daily_counts(totals).collect()}
    want = {}
    for ts, _, kind, *_ in rows:
        want[ts.date().isoformat(), kind] = want.get((ts.date().isoformat(), kind), 0) + 1
    assert got == want


@pytest.fixture
def folders(tmp_path):
    return [str(tmp_path / n) for n in ("in", "totals", "state")]


def test_totals_equal_the_batch_reports(spark, folders):
    """After each of several runs of a stream, over batches that fill two levels."""
    folder, path, state = folders
    rows = some_events(220)
    for a, b in ((0, 30), (30, 170), (170, 220)):
        for i in range(a, b, 20):
            arrive(spark, folder, rows[i : min(i + 20, b)])
        run(spark, folder, path, state, 3)
        equal(spark, path, rows[:b], 3)
    levels = usage._complete(spark, path)
    assert set(levels) == {0, 1, 2} and len(levels[0]) == 12


def test_a_batch_that_runs_again_counts_once(spark, folders):
    """Also one that filled a level, and one whose folding was lost."""
    _, path, _ = folders
    rows = some_events(90, seed=5)
    parts = [spark.createDataFrame(rows[i : i + 10], SCHEMA) for i in range(0, 90, 10)]
    for i, part in enumerate(parts):
        usage.add_batch(part, i, path, 3)
        if i in (1, 2, 8):
            usage.add_batch(part, i, path, 3)
    equal(spark, path, rows, 3)


def test_unfinished_tables_do_not_count(spark, folders, tmp_path):
    """Until a part's writing is finished readers do not see it, and a folded one stands in for its children."""
    _, path, _ = folders
    rows = some_events(40, seed=6)
    for i in range(4):
        usage.add_batch(spark.createDataFrame(rows[i * 10 : i * 10 + 10], SCHEMA), i, path, 2)
    half = tmp_path / "totals" / "level-0" / "part-000000000004"
    usage.added_totals(spark.createDataFrame(rows, SCHEMA)).write.parquet(str(half))
    (half / "_SUCCESS").unlink()
    equal(spark, path, rows, 2)


def test_whole_days_and_nothing(spark, folders):
    _, path, _ = folders
    assert usage.read_totals(spark, path).count() == 0
    rows = some_events(50, seed=7)
    usage.add_batch(spark.createDataFrame(rows, SCHEMA), 0, path)
    usage.add_batch(spark.createDataFrame([], SCHEMA), 1, path)
    equal(spark, path, rows, usage.FAN_IN)
    from pyspark.sql import functions as F

    day = lambda d: F.lit(datetime.date(2024, 1, d))
    kept = usage.between(usage.read_totals(spark, path), day(5), day(9)).agg(F.sum("n")).first()[0]
    assert kept == sum(5 <= r[0].day <= 9 for r in rows)
