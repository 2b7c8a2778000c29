"""Usage-event log: strict reading, ownership gate, and the two reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from peerlens.functions.scalar import user_token
from peerlens.session import join_keys

# Limits and vocabulary of the event log.
SCHEMA_VERSION = 1
MAX_RECORD_BYTES = 8192
FUTURE_SKEW_S = 300
MAX_DURATION_S = 31_536_000
MAX_NAME_BYTES = 64
DEFAULT_DAYS = 30
LAUNCH_CONTEXTS = ("cli_share", "cli_rate", "tui")
SURFACES = ("share", "rate")
ACTIONS = ("share_analysis", "rate_analysis")
REFUSAL_REASONS = ("configuration", "input_validation", "compliance_policy")
FAILURE_CATEGORIES = ("input", "analysis", "output", "unexpected")
OUTCOMES = ("completed", "cancelled", "refused", "failed")
ACTION_EVENTS = ("action_attempted", *[f"action_{o}" for o in OUTCOMES])

ENVELOPE = (
    r"^OBJECT<app_version: STRING, event: STRING, props: OBJECT<.*>, schema_version: BIGINT, "
    r"session_id: STRING, ts: STRING, user: STRING>$"
)
TIMESTAMP = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,6})?Z$"
UUID = r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
CONTROL = r"\p{C}"


def read_event_lines(spark: SparkSession, path: str) -> DataFrame:
    """Raw lines with file and position; an unterminated last line is dropped.

    Lines end at line feeds alone, so their bytes are known exactly, and a carriage return
    before one is taken off afterwards: a file whose bytes are one short of lines plus
    line feeds lacks the final one.  Which line that is comes from the same pass, by its
    text: of lines that are equal to it, one is left out.  ``position`` orders the lines of
    a file within a run; it is never compared between runs.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_size").alias("_size"),
        F.struct(
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("id"),
        ).alias("position"),
    )
    open_files = lines.groupBy("file").agg(
        F.max_by("value", "position").alias("_tail"),
        (F.sum(F.octet_length("value") + 1) > F.max("_size")).alias("_open"),
    ).where("_open")
    joined = join_keys(lines.drop("_size"), open_files.drop("_open"), ["file"], "left")
    is_tail = F.coalesce(F.col("value") == F.col("_tail"), F.lit(False))
    again = joined.where(is_tail).groupBy("value", "file").agg(F.min("position").alias("_p"), F.count("*").alias("_n"))
    others = again.where("_n > 1").select(
        "value", "file", F.explode(F.array_repeat("_p", (F.col("_n") - 1).cast("int"))).alias("position")
    )
    kept = joined.where(~is_tail).select("value", "file", "position").unionByName(others)
    return kept.withColumn("value", F.regexp_replace("value", "\r$", ""))


def _text(path: str) -> Column:
    return F.try_variant_get("v", f"$.{path}", "string")


def _name_ok(name: Column) -> Column:
    return (
        (name != "")
        & ~name.isin(".", "..")
        & ~name.rlike(r"[/\\]")
        & ~name.rlike(CONTROL)
        & (F.octet_length(name) <= 255)
    )


def validate_events(lines: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Events that meet the exact contract, from text column ``value``.

    The variant type string tells key set and JSON types in one comparison.
    """
    keep = keep or [c for c in lines.columns if c != "value"]
    fields = F.struct(
        F.schema_of_variant("v").alias("_type"),
        F.try_variant_get("v", "$.schema_version", "bigint").alias("schema_version"),
        _text("ts").alias("_ts"),
        _text("event").alias("event"),
        _text("user").alias("user"),
        _text("session_id").alias("session_id"),
        _text("app_version").alias("app_version"),
        *[
            _text(f"props.{n}").alias(n)
            for n in ("launch_context", "surface", "action", "reason", "category")
        ],
        F.try_variant_get("v", "$.props.duration_s", "double").alias("duration_s"),
    )
    # Exploding one-element arrays keeps the tests below from being pushed into
    # the parsing, where every test would parse the line again.
    parsed = (
        lines.where(F.octet_length("value") <= MAX_RECORD_BYTES)
        .select(*keep, F.explode(F.array(F.try_parse_json("value"))).alias("v"))
        .where(F.col("v").isNotNull())
        .select(*keep, F.explode(F.array(fields)).alias("_f"))
        .select(*keep, "_f.*")
        .where(F.col("_type").rlike(ENVELOPE))
        .withColumn("_props", F.regexp_extract("_type", "props: (OBJECT<.*>), schema_version", 1))
        .withColumn("ts", F.try_to_timestamp("_ts"))
    )
    event, props = F.col("event"), F.col("_props")

    def shape(*names: str) -> Column:
        return props == "OBJECT<" + ", ".join(f"{n}: STRING" for n in names) + ">"

    action = F.col("action").isin(*ACTIONS)
    duration = F.round("duration_s", 3)
    per_event = (
        F.when(
            event == "session_start",
            shape("launch_context") & F.col("launch_context").isin(*LAUNCH_CONTEXTS),
        )
        .when(
            event == "session_end",
            props.rlike(r"^OBJECT<duration_s: (BIGINT|DOUBLE|FLOAT|DECIMAL\(\d+,\d+\))>$")
            & (F.col("duration_s") >= 0)
            & (duration <= MAX_DURATION_S),
        )
        .when(event == "surface_viewed", shape("surface") & F.col("surface").isin(*SURFACES))
        .when(
            event.isin("action_attempted", "action_completed", "action_cancelled"),
            shape("action") & action,
        )
        .when(
            event == "action_refused",
            shape("action", "reason") & action & F.col("reason").isin(*REFUSAL_REASONS),
        )
        .when(
            event == "action_failed",
            shape("action", "category") & action & F.col("category").isin(*FAILURE_CATEGORIES),
        )
        .otherwise(F.lit(False))
    )
    version = F.col("app_version")
    valid = (
        (F.col("schema_version") == SCHEMA_VERSION)
        & F.col("_ts").rlike(TIMESTAMP)
        & F.col("ts").isNotNull()
        & _name_ok(F.col("user"))
        & F.col("session_id").rlike(UUID)
        & (version != "")
        & ~version.rlike(CONTROL)
        & (F.octet_length(version) <= MAX_NAME_BYTES)
        & per_event
    )
    return parsed.where(valid).withColumn("duration_s", duration).drop("_ts", "_props", "_type")


def read_events_jsonl(spark: SparkSession, path: str, pattern: str = "*.jsonl") -> DataFrame:
    """Valid events of the log files in a folder, with their file and position."""
    return validate_events(read_event_lines(spark, f"{path.rstrip('/')}/{pattern}"))


def file_owner_gate(events: DataFrame) -> DataFrame:
    """A file counts only if named for the user of its first valid event.

    Events of other users inside an accepted file are dropped.
    """
    first = events.groupBy("file").agg(F.min_by("user", "position").alias("_owner"))
    joined = join_keys(events, first, ["file"])
    name = F.element_at(F.split("file", "/"), -1)
    expected = F.concat(user_token(F.col("_owner")), F.lit(".jsonl"))
    return joined.where(
        (F.try_url_decode(name) == expected) & (F.col("user") == F.col("_owner"))
    ).drop("_owner")


def events_window(events: DataFrame, now: Column, days: int | None = DEFAULT_DAYS, user: str | None = None) -> DataFrame:
    """Events from ``days`` before ``now`` up to the allowed clock skew after it."""
    kept = events.where(F.col("ts") <= now + F.expr(f"INTERVAL {FUTURE_SKEW_S} SECONDS"))
    if days is not None:
        kept = kept.where(F.col("ts") >= now - F.expr(f"INTERVAL {int(days)} DAYS"))
    return kept if user is None else kept.where(F.col("user") == user)


def who_report(
    events: DataFrame, start: str = "session_start", completed: str = "action_completed"
) -> DataFrame:
    """Per user: distinct started sessions, last event, completed actions."""
    return events.groupBy("user").agg(
        F.count_distinct(F.when(F.col("event") == start, F.col("session_id"))).alias("sessions"),
        F.max("ts").alias("last_seen"),
        F.count_if(F.col("event") == completed).alias("completed"),
    )


def zero_filled_counts(counts: DataFrame, vocabulary: dict[str, tuple[str, ...]]) -> DataFrame:
    """Counts ``kind, value, n`` in fixed order, zero where nothing was counted.

    The vocabulary is a short literal list; counts are one row per value.
    """
    collected = counts.agg(
        F.map_from_entries(F.collect_list(F.struct(F.concat_ws("/", "kind", "value"), "n"))).alias("_m")
    )
    entries = [(k, v) for k, values in vocabulary.items() for v in values]
    rows = F.array(
        *[
            F.struct(F.lit(i).alias("position"), F.lit(k).alias("kind"), F.lit(v).alias("value"))
            for i, (k, v) in enumerate(entries)
        ]
    )
    return collected.select("_m", F.explode(rows).alias("_r")).select(
        "_r.*",
        F.coalesce(F.element_at("_m", F.concat_ws("/", "_r.kind", "_r.value")), F.lit(0)).alias("n"),
    )


VOCABULARY = {"surface": SURFACES, "action": ACTIONS, "outcome": OUTCOMES}


def seen_values(vocabulary: dict[str, tuple[str, ...]]) -> Column:
    """The listed ``kind, value`` pairs that an event counts for, as an array."""
    event = F.col("event")
    pairs = (
        ("surface", F.when(event == "surface_viewed", F.col("surface"))),
        ("action", F.when(event.isin(*ACTION_EVENTS), F.col("action"))),
        ("outcome", F.when(event.isin(*[f"action_{o}" for o in OUTCOMES]), F.substring_index(event, "_", -1))),
    )
    seen = F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("value")) for k, v in pairs])
    known = F.array(*[F.lit(f"{k}/{v}") for k, values in vocabulary.items() for v in values])
    return F.filter(seen, lambda s: s["value"].isNotNull() & F.array_contains(known, F.concat(s["kind"], F.lit("/"), s["value"])))


def usage_summary(events: DataFrame, vocabulary: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """How often each surface was viewed, action used and outcome reached."""
    vocabulary = vocabulary or VOCABULARY
    counts = (
        events.select(F.explode(seen_values(vocabulary)).alias("_s"))
        .select("_s.*")
        .groupBy("kind", "value")
        .agg(F.count("*").alias("n"))
    )
    return zero_filled_counts(counts, vocabulary)
