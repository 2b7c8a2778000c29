"""The event reports kept up to date over an append-only stream.

Totals that a stream keeps (``keep_totals``) are what each batch adds, written under the
batch's number: a batch that is run again after a loss replaces what it wrote, and an event
counts whenever it arrives, since what is added for an old day is one more row of that
day.  Every FAN_IN batches are folded into one table, FAN_IN of those again, so a report
reads few of them however long the stream has run.  Nothing waits for a watermark and no
state is held between batches.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from peerlens.sources.events import VOCABULARY, seen_values, zero_filled_counts

# How late an event may arrive; older ones are left to the batch report.
LATENESS = "1 day"


def usage_counts(events: DataFrame, window: str = "1 day", lateness: str = LATENESS) -> DataFrame:
    """Events per window and kind, with watermark, from a stream ``ts, event``."""
    return (
        events.withWatermark("ts", lateness)
        .groupBy(F.window("ts", window).alias("w"), "event")
        .agg(F.count("*").alias("n"))
        .select(F.col("w.start").alias("window_start"), "event", "n")
    )


def started_sessions(events: DataFrame, start: str = "session_start", lateness: str = LATENESS) -> DataFrame:
    """Each started session once: exact within the watermark."""
    return (
        events.where(F.col("event") == start)
        .withWatermark("ts", lateness)
        .dropDuplicatesWithinWatermark(["user", "session_id"])
        .select("user", "session_id", "ts")
    )


def append_available(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Process what has arrived and append the final rows to Parquet files.

    The file sink commits each batch once, so a restart after a lost executor or
    driver neither repeats nor drops rows.  Windows still open at the watermark
    stay in the state until a later run closes them.
    """
    return (
        stream.writeStream.outputMode("append")
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


# Totals that count late events and open days ---------------------------------------

#: Tables of a level that are folded into one of the next.
FAN_IN = 16
KEYS = ["day", "user", "event", "surface", "action", "session_id"]
TOTALS = "day date, user string, event string, surface string, action string, session_id string, n long, last_seen timestamp"


def added_totals(events: DataFrame, start: str = "session_start") -> DataFrame:
    """What events add to the totals: counts and the last time by day, user, kind and, for starts, session."""
    session = F.when(F.col("event") == start, F.col("session_id"))
    return (
        events.groupBy(F.to_date("ts").alias("day"), "user", "event", "surface", "action", session.alias("session_id"))
        .agg(F.count("*").alias("n"), F.max("ts").alias("last_seen"))
    )


def merge_totals(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEYS).agg(F.sum("n").alias("n"), F.max("last_seen").alias("last_seen"))


def _complete(spark: SparkSession, path: str) -> dict[int, set[int]]:
    """Numbers of the finished tables by level."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    store = root.getFileSystem(spark._jsc.hadoopConfiguration())
    done: dict[int, set[int]] = {}
    for status in store.globStatus(jvm.org.apache.hadoop.fs.Path(root, "level-*/part-*/_SUCCESS")) or ():
        found = re.search(r"level-(\d+)/part-(\d+)/_SUCCESS$", status.getPath().toString())
        done.setdefault(int(found[1]), set()).add(int(found[2]))
    return done


def _part(path: str, level: int, number: int) -> str:
    return f"{path}/level-{level}/part-{number:012d}"


def _read(spark: SparkSession, path: str, parts: list[tuple[int, int]]) -> DataFrame:
    if not parts:
        return spark.createDataFrame([], TOTALS)
    return spark.read.schema(TOTALS).parquet(*[_part(path, *p) for p in parts])


def add_batch(batch: DataFrame, number: int, path: str, fan_in: int = FAN_IN) -> None:
    """Write what batch ``number`` adds, and fold the levels that it fills.

    Running it again with the same batch leaves the same tables: each is replaced whole,
    and counts only once its writing is finished.
    """
    spark = batch.sparkSession
    added_totals(batch).write.mode("overwrite").parquet(_part(path, 0, number))
    level, width = 0, fan_in
    while (number + 1) % width == 0:
        parent = number // width
        children = [(level, c) for c in range(parent * fan_in, (parent + 1) * fan_in) if c in _complete(spark, path).get(level, ())]
        merge_totals(_read(spark, path, children)).write.mode("overwrite").parquet(_part(path, level + 1, parent))
        level, width = level + 1, width * fan_in


def keep_totals(events: DataFrame, path: str, checkpoint: str, fan_in: int = FAN_IN) -> StreamingQuery:
    """Add what has arrived on the stream ``events`` to the totals under ``path``.

    ``events`` has ``ts, user, event, surface, action, session_id``; the stream goes on
    from ``checkpoint`` the next time.
    """
    return (
        events.writeStream.outputMode("update")
        .foreachBatch(lambda batch, number: add_batch(batch, number, path, fan_in))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_totals(spark: SparkSession, path: str, fan_in: int = FAN_IN) -> DataFrame:
    """The kept totals, one row per key: each batch once, from the highest level that holds it."""
    done = _complete(spark, path)
    top, parts = max(done, default=0), []
    for level in range(top, -1, -1):
        for number in sorted(done.get(level, ())):
            above = (number // fan_in ** (up - level) in done.get(up, ()) for up in range(level + 1, top + 1))
            if not any(above):
                parts.append((level, number))
    return merge_totals(_read(spark, path, parts))


def between(totals: DataFrame, first: Column | None = None, last: Column | None = None) -> DataFrame:
    """Totals of whole days from ``first`` to ``last``."""
    kept = totals if first is None else totals.where(F.col("day") >= first)
    return kept if last is None else kept.where(F.col("day") <= last)


def daily_counts(totals: DataFrame) -> DataFrame:
    """Events per day and kind."""
    return totals.groupBy("day", "event").agg(F.sum("n").alias("n"))


def who_of_totals(totals: DataFrame, completed: str = "action_completed") -> DataFrame:
    """``who_report`` from totals."""
    return totals.groupBy("user").agg(
        F.count_distinct("session_id").alias("sessions"),
        F.max("last_seen").alias("last_seen"),
        F.sum(F.when(F.col("event") == completed, F.col("n")).otherwise(0)).alias("completed"),
    )


def summary_of_totals(totals: DataFrame, vocabulary: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """``usage_summary`` from totals."""
    vocabulary = vocabulary or VOCABULARY
    counts = totals.select("n", F.explode(seen_values(vocabulary)).alias("_s")).select("n", "_s.*")
    return zero_filled_counts(counts.groupBy("kind", "value").agg(F.sum("n").alias("n")), vocabulary)
