"""Queries: sources, sinks, the usage-event log in batch and as a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from peerlens.functions.scalar import user_token
from peerlens.operators import analysis, balanced
from peerlens.plans import workload as w
from peerlens.plans.quality_queries import dirty
from peerlens.plans.registry import query, tidy
from peerlens.roles import Roles
from peerlens.session import scratch_path
from peerlens.sources import events as ev
from peerlens.sources import files, sinks
from peerlens.streaming import usage

CSV_ROLES = Roles("Issuer Name", ("Brand",), metric="Amount", time="Year Month")


def monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = w.fact(spark, sf_dir, ("entity", "brand", "month", "amount", "qty"))
    return df.groupBy("entity", "brand", "month").agg(F.sum("amount").alias("amount"), F.sum("qty").alias("qty"))


@query
def read_long_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A long CSV with untidy header, read back, pruned and summed."""
    path = scratch_path(spark, "long-csv")
    untidy = monthly(spark, sf_dir).toDF("Issuer Name", "Brand", "Year Month", "Amount", "Qty-Total")
    untidy.write.option("header", True).csv(path)
    df, missing = files.project_requested(
        files.read_long_csv(spark, path), files.requested_columns(CSV_ROLES)
    )
    assert not missing
    return tidy(
        df.groupBy("issuer_name", "year_month").agg(F.count("*").alias("n_rows"), F.sum("amount").alias("amount")),
        ("amount",),
    )


@query
def project_requested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the wanted columns; the names that do not exist are reported, not fatal."""
    df, missing = files.project_requested(
        w.table(spark, sf_dir, "orders"), ["o_orderstatus", "o_totalprice", "no_such_column"]
    )
    return tidy(
        df.groupBy("o_orderstatus").agg(
            F.sum("o_totalprice").alias("amount"), F.lit(",".join(missing)).alias("missing")
        ),
        ("amount",),
    )


@query
def preaggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null keys kept, unreadable text as null, all-null sums null."""
    return tidy(
        files.preaggregate(
            dirty(spark, sf_dir), ["entity", "brand", "returnflag", "month"], ["quantity_text", "amount"]
        ),
        ("amount", "quantity_text"),
    )


@query
def read_sql_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    w.table(spark, sf_dir, "orders").createOrReplaceTempView("peerlens_orders")
    path = scratch_path(spark, "sql-text")
    text = "SELECT o_orderstatus AS `Order Status`, count(*) AS `N Rows` FROM peerlens_orders GROUP BY 1;"
    spark.range(1).select(F.lit(text).alias("value")).coalesce(1).write.text(path)
    return files.read_sql_query(spark, path)


@query
def read_sql_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    w.table(spark, sf_dir, "supplier").createOrReplaceTempView("peerlens_supplier")
    return tidy(files.read_sql_table(spark, "peerlens_supplier"))


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = w.fact_for(spark, sf_dir, w.PEER_ONLY)
    return tidy(
        analysis.share_analysis(df, w.PEER_ONLY).select("dimension", "category", "balanced_peer_average_pct", "bic_pct")
    )


@query
def write_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results written as CSV per dimension, read back."""
    path = scratch_path(spark, "results")
    sinks.write_results(results(spark, sf_dir), path)
    return spark.read.option("header", True).schema(
        "category string, balanced_peer_average_pct double, bic_pct double, dimension string"
    ).csv(path)


@query
def write_results_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "results-json")
    sinks.write_results_json(results(spark, sf_dir), path, "share")
    return tidy(
        spark.read.schema(
            "schema_version int, analysis_type string, dimension string, category string, "
            "balanced_peer_average_pct double, bic_pct double"
        ).json(path)
    )


@query
def write_balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balanced export with spreadsheet-unsafe labels, written sorted and read back."""
    df = w.fact_for(spark, sf_dir, w.SHARE_TIMED).withColumn("returnflag", F.concat(F.lit("="), "returnflag"))
    path = scratch_path(spark, "balanced")
    sinks.write_balanced(tidy(balanced.balanced_export_share(df, w.SHARE_TIMED), ("balanced_amount",)), path)
    return spark.read.option("header", True).schema(
        "dimension string, category string, time_period string, balanced_amount double"
    ).csv(path)


# Usage events -------------------------------------------------------------------


def session_of(key: Column) -> Column:
    """A UUID-shaped session id from the property ``k`` of an event."""
    digest = F.md5(key.cast("binary"))
    parts = [F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat_ws("-", *parts)


def usage_events(events: DataFrame) -> DataFrame:
    """The event table in the vocabulary of the usage log."""
    kind = F.col("event_type")
    odd = F.col("user_id") % 2 == 1
    return events.select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("user"),
        session_of(F.get_json_object("props", "$.k")).alias("session_id"),
        F.when(kind == "signup", "session_start")
        .when(kind == "view", "surface_viewed")
        .when(kind == "click", "action_attempted")
        .when(kind == "purchase", "action_completed")
        .otherwise("action_failed")
        .alias("event"),
        F.when(kind == "signup", "tui").alias("launch_context"),
        F.when(kind == "view", F.when(odd, "rate").otherwise("share")).alias("surface"),
        F.when(kind.isin("click", "purchase", "error"), F.when(odd, "rate_analysis").otherwise("share_analysis")).alias("action"),
        F.when(kind == "error", F.when(F.col("value") > 50, "other").otherwise("input")).alias("category"),
        "user_id",
        "value",
    )


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as log lines, some of them breaking the contract."""
    rows = usage_events(w.table(spark, sf_dir, "events"))
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    record = F.struct(
        F.when(F.col("value") < 2, 2).otherwise(1).alias("schema_version"),
        F.concat(stamp, F.when(F.col("user_id") % 10 == 3, "+00:00").otherwise("Z")).alias("ts"),
        "event",
        "user",
        F.when(F.col("user_id") % 10 == 7, F.upper("session_id")).otherwise(F.col("session_id")).alias("session_id"),
        F.when((F.col("value") >= 40) & (F.col("value") < 42), F.repeat(F.lit("9"), 70)).otherwise("1.2.0").alias("app_version"),
        F.struct("launch_context", "surface", "action", "category").alias("props"),
        F.when((F.col("value") >= 30) & (F.col("value") < 32), "x").alias("extra"),
    )
    text = F.to_json(record)
    torn = F.when((F.col("value") >= 20) & (F.col("value") < 21), F.expr("left(line, length(line) - 1)"))
    return rows.withColumn("line", text).select("event_id", F.coalesce(torn, F.col("line")).alias("value"))


@query
def validate_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ev.validate_events(event_lines(spark, sf_dir))
    return out.select("event_id", "user", "event", "session_id", "surface", "action", "category")


@query
def read_events_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same lines written as text files and read as a log."""
    path = scratch_path(spark, "event-log")
    event_lines(spark, sf_dir).select("value").write.text(path)
    out = ev.read_events_jsonl(spark, path, "*.txt")
    return out.groupBy("user", "event").agg(F.count("*").alias("n"))


@query
def file_owner_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files shared by several users; one counts if its first event is its owner's."""
    rows = usage_events(w.table(spark, sf_dir, "events"))
    owner = F.concat(F.lit("user_"), (F.col("user_id") % 40).cast("string"))
    placed = rows.withColumn("file", F.concat(F.lit("log/"), user_token(owner), F.lit(".jsonl"))).withColumn(
        "position", F.struct(F.lit(0).alias("block"), F.col("event_id").alias("id"))
    )
    return ev.file_owner_gate(placed).select("event_id", "user")


def now() -> Column:
    """The moment the reports are asked for."""
    return F.lit("2024-01-20 12:00:00").cast("timestamp")


@query
def events_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = usage_events(w.table(spark, sf_dir, "events"))
    return ev.events_window(rows, now(), 7).select("event_id", "user", "event")


@query
def who_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ev.events_window(usage_events(w.table(spark, sf_dir, "events")), now())
    out = ev.who_report(rows)
    return out.withColumn("last_seen", F.date_format("last_seen", "yyyy-MM-dd HH:mm:ss"))


@query
def usage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(ev.usage_summary(ev.events_window(usage_events(w.table(spark, sf_dir, "events")), now())))


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table as an append-only file stream."""
    schema = w.table(spark, sf_dir, "events").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return usage_events(source)


def kept_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The totals that a stream over the event table has kept when it has read everything."""
    path = scratch_path(spark, "usage-totals")
    usage.keep_totals(event_stream(spark, sf_dir), path, scratch_path(spark, "usage-batches")).awaitTermination()
    return usage.read_totals(spark, path)


@query
def usage_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily event counts kept by a stream, the open day and late events included."""
    out = usage.daily_counts(kept_totals(spark, sf_dir))
    return out.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "event", "n")


@query
def who_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report by user from the stream's totals."""
    out = usage.who_of_totals(kept_totals(spark, sf_dir))
    return out.withColumn("last_seen", F.date_format("last_seen", "yyyy-MM-dd HH:mm:ss"))


@query
def usage_summary_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surfaces, actions and outcomes from the stream's totals."""
    return tidy(usage.summary_of_totals(kept_totals(spark, sf_dir)))


@query
def closed_days_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily event counts that a stream appends once its watermark has closed the day."""
    path = scratch_path(spark, "usage-counts")
    counts = usage.usage_counts(event_stream(spark, sf_dir))
    usage.append_available(counts, path, scratch_path(spark, "usage-state")).awaitTermination()
    out = spark.read.schema("window_start timestamp, event string, n bigint").parquet(path)
    return out.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event", "n")


@query
def sessions_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct started sessions per user, de-duplicated by the stream."""
    path = scratch_path(spark, "sessions")
    started = usage.started_sessions(event_stream(spark, sf_dir), lateness="60 days")
    usage.append_available(started, path, scratch_path(spark, "sessions-state")).awaitTermination()
    out = spark.read.schema("user string, session_id string, ts timestamp").parquet(path)
    return out.groupBy("user").agg(F.count("*").alias("sessions"))
