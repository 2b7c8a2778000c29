import base64
import json

import pytest
from pyspark.sql import functions as F

from peerlens.functions import scalar
from peerlens.operators import quality, reconcile, schema
from peerlens.roles import Roles
from peerlens.sources import events as ev
from peerlens.sources import files, sinks
from peerlens.sources.synth import synth_long_dataset
from tests.fixtures import RATE, TIMED, facts, rows_of

UUID = "0f8fad5b-d9cb-469f-a165-70867728950e"


def line(**change):
    record = {
        "schema_version": 1, "ts": "2024-01-05T10:00:00Z", "event": "session_start", "user": "ann",
        "session_id": UUID, "app_version": "1.0", "props": {"launch_context": "tui"},
    }
    record.update(change)
    return json.dumps({k: v for k, v in record.items() if v is not ...})


@pytest.mark.parametrize(
    "text, ok",
    [
        (line(), True),
        (line(ts="2024-01-05T10:00:00.123456Z"), True),
        (line(event="session_end", props={"duration_s": 12.3456}), True),
        (line(event="session_end", props={"duration_s": 5}), True),
        (line(event="action_refused", props={"action": "rate_analysis", "reason": "configuration"}), True),
        (line(schema_version=2), False),
        (line(schema_version="1"), False),
        (line(schema_version=True), False),
        (line(extra=1), False),
        (line(app_version=...), False),
        (line(ts="2024-01-05T10:00:00+00:00"), False),
        (line(ts="2024-02-30T10:00:00Z"), False),
        (line(ts="2024-01-05T10:00:00.1234567Z"), False),
        (line(session_id=UUID.upper()), False),
        (line(session_id="not-a-uuid"), False),
        (line(user="../x"), False),
        (line(user=""), False),
        (line(app_version="9" * 65), False),
        (line(app_version="a\u0001"), False),
        (line(props={"launch_context": "tui", "x": 1}), False),
        (line(props={"launch_context": "desktop"}), False),
        (line(event="session_end", props={"duration_s": -1}), False),
        (line(event="session_end", props={"duration_s": "5"}), False),
        (line(event="session_end", props={"duration_s": 31536001}), False),
        (line(event="unknown"), False),
        (line()[:-1], False),
        ("[]", False),
        (line(app_version="1.0", user="u" * 8200), False),
    ],
)
def test_event_contract(spark, text, ok):
    df = spark.createDataFrame([(1, text)], "id int, value string")
    assert (ev.validate_events(df).count() == 1) is ok


def test_event_log_files(spark, tmp_path):
    def token(name):
        return base64.urlsafe_b64encode(name.encode()).decode().rstrip("=")

    (tmp_path / f"{token('ann')}.jsonl").write_text(
        "\n".join(["broken", line(), line(), line(user="bob", session_id=UUID), line(ts="2024-01-06T00:00:00Z", event="action_completed", props={"action": "share_analysis"})]) + "\n"
    )
    # Named for another user than its first valid event.
    (tmp_path / f"{token('carl')}.jsonl").write_text(line(user="dora") + "\n")
    # The last line was never finished.
    (tmp_path / f"{token('eve')}.jsonl").write_text(line(user="eve") + "\n" + line(user="eve", session_id=UUID.replace("0f", "1f")))
    events = ev.file_owner_gate(ev.read_events_jsonl(spark, str(tmp_path)))
    now = F.lit("2024-01-06 00:00:00").cast("timestamp")
    who = rows_of(ev.who_report(ev.events_window(events, now)), "user")
    assert {u[0]: (r["sessions"], r["completed"]) for u, r in who.items()} == {"ann": (1, 1), "eve": (1, 0)}
    summary = rows_of(ev.usage_summary(events), "kind", "value")
    assert summary[("outcome", "completed")]["n"] == 1 and summary[("surface", "rate")]["n"] == 0


def test_clock_skew_window(spark):
    df = spark.createDataFrame([("a", "2024-01-01 00:05:00"), ("b", "2024-01-01 00:05:01")], "user string, t string").select(
        "user", F.to_timestamp("t").alias("ts")
    )
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    assert [r["user"] for r in ev.events_window(df, now).collect()] == ["a"]
    assert ev.events_window(df, now, days=None, user="b").count() == 0


def test_names_and_schema():
    assert schema.normalized_names(["Issuer Name", "issuer.name", "Amount ($)", "__x--y "]) == [
        "issuer_name", "issuer_name_1", "amount", "x_y",
    ]
    assert schema.detect_schema(["issuer_name", "approved", "total"]) == "full"
    assert schema.detect_schema(["bank", "txn_cnt", "amount"]) == "minimal"
    assert schema.detect_schema(["a", "b"]) == "unknown"
    mapping = {"entity_identifier": ["e"], "transaction_count": ["n"], "transaction_amount": ["v"]}
    assert schema.detect_schema(["e", "n", "v"], mapping, "mapped") == "minimal"
    assert schema.detect_schema(["bank", "txn_cnt", "amount"], mapping, "mapped") == "unknown"
    assert schema.detect_export_kind(["dimension", "balanced_total", "month"])["kind"] == "rate"
    with pytest.raises(ValueError):
        schema.reject_reserved_dimension(["_TIME_x"])


def test_dimensions_by_substring(spark):
    df = spark.createDataFrame([("a", "b", "c", "d", 1)], "issuer string, width string, card string, month string, n int")
    assert schema.available_dimensions(df, "month") == ["card"]
    with pytest.raises(ValueError):
        schema.check_required_columns(df, ["card", "nope"])
    with pytest.raises(ValueError):
        schema.resolve_entity_column(df)


def test_csv_round_trip_and_sql(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text("Issuer Name,Year-Month,Txn Cnt\nA,2024-01,1.5\nB,2024-02,2\n")
    df = files.read_long_csv(spark, str(path))
    assert df.dtypes == [("issuer_name", "string"), ("year_month", "string"), ("txn_cnt", "double")]
    assert files.read_long_csv(spark, str(path), limit=1).count() == 1
    kept, missing = files.project_requested(df, files.requested_columns(Roles("Issuer Name", (), metric="nope")))
    assert kept.columns == ["issuer_name"] and missing == ["nope"]
    df.createOrReplaceTempView("t_in")
    sql = tmp_path / "q.sql"
    sql.write_text("SELECT `issuer_name` AS `Issuer Name`\nFROM t_in\nWHERE txn_cnt > 1.6;\n")
    assert [r["issuer_name"] for r in files.read_sql_query(spark, str(sql)).collect()] == ["B"]
    assert files.read_sql_table(spark, "t_in").count() == 2
    with pytest.raises(ValueError):
        files.read_sql_table(spark, "t_in; DROP TABLE x")


def test_preaggregate_keeps_null_keys_and_null_sums(spark):
    df = spark.createDataFrame([("A", None, "1"), ("A", None, "x"), ("B", "k", "bad")], "e string, d string, v string")
    got = {(r["e"], r["d"]): r["v"] for r in files.preaggregate(df, ["e", "d"], ["v"]).collect()}
    assert got == {("A", None): 1.0, ("B", "k"): None}


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("d1", "=x", "m1", 1.0), ("d2", "y", "m1", 2.0)], "dimension string, category string, time_period string, v double")
    sinks.write_results(rows, str(tmp_path / "csv"))
    assert (tmp_path / "csv" / "dimension=d1").exists()
    sinks.write_results_json(rows, str(tmp_path / "json"), "share")
    assert spark.read.json(str(tmp_path / "json")).first()["schema_version"] == 1
    sinks.write_balanced(rows, str(tmp_path / "bal"))
    back = spark.read.option("header", True).csv(str(tmp_path / "bal"))
    assert {r["category"] for r in back.collect()} == {"'=x", "y"}


def test_synthetic_table(spark):
    df = synth_long_dataset(spark, 12, 6, 4)
    assert df.count() == 12 * 6 * 16 and df.distinct().count() == 12 * 6 * 16
    last = df.where("issuer_name = 'Issuer 012' and year_month = '2024-06' and card_type = 'Card 4' and channel = 'Channel 4'")
    assert last.first()["txn_cnt"] == (1000 + 25 * 11) * 7


def test_scalar_functions(spark):
    df = spark.createDataFrame([("\x1b[31mred\x1b[0m é\t",)], "s string")
    assert df.select(scalar.sanitize_terminal(F.col("s"))).first()[0] == "red ?\t"
    words = spark.createDataFrame([(" YES ",), ("Failed",), ("",), ("maybe",), (None,)], "s string")
    assert [r[0] for r in words.select(scalar.parse_bool_text(F.col("s"), True)).collect()] == [True, False, False, True, True]
    names = spark.createDataFrame([("ann?>~ü",)], "s string")
    want = base64.urlsafe_b64encode("ann?>~ü".encode()).decode().rstrip("=")
    assert names.select(scalar.user_token(F.col("s"))).first()[0] == want
    assert scalar.bps_columns(["raw_fraud_rate_pct", "fraud_impact_pp", "approval_rate_pct"]) == ["raw_fraud_rate_pct"]


def test_digest_ignores_row_order_but_not_content(spark):
    df = spark.createDataFrame([("a", "1"), ("b", "0"), ("c", "1")], "unit_key string, f string")

    def digest(frame):
        return scalar.ordered_digest(frame, ["unit_key"], F.col("f")).first()[0]

    assert digest(df) == digest(df.orderBy(F.col("unit_key").desc()).repartition(3))
    swapped = spark.createDataFrame([("a", "0"), ("b", "1"), ("c", "1")], "unit_key string, f string")
    assert digest(df) != digest(swapped)


def test_reconciliation_outcomes(spark):
    schema_text = "dimension string, category string, time_period string, rate string, value double"
    left = spark.createDataFrame(
        [("d", "a", "2024-01", "r", 1.0), ("d", "b", "2024-01", "r", 1.0), ("d", "c", None, "r", 1.0), ("d", "e", "Q1", "r", None), ("d", "f", "Q1", "r", 2.0)],
        schema_text,
    )
    right = spark.createDataFrame(
        [("d", "a", "2024-01-01", "r", 1.00005), ("d", "b", "2024-01", "r", 1.1), ("d", "c", None, "r", 1.0), ("d", "c", None, "r", 1.0), ("d", "e", "Q1", "r", 1.0), ("d", "g", "Q1", "r", 2.0)],
        schema_text,
    )
    got = {r["category"]: (r["outcome"], r["skip_reason"]) for r in reconcile.reconcile_export(left, right).collect()}
    assert got == {
        "a": ("passed", None), "b": ("failed", None), "c": ("skipped", "ambiguous"),
        "e": ("skipped", "null_value"), "f": ("skipped", "missing"), "g": ("skipped", "missing"),
    }
    totals = reconcile.reconciliation_totals(reconcile.reconcile_export(left, right)).first()
    assert (totals["passed"], totals["failed"], totals["skipped"]) == (1, 1, 4)


def test_quality_of_clean_and_dirty_input(spark):
    assert quality.validate_share_input(facts(spark), TIMED).where("severity = 'ERROR'").count() == 0
    dirty = facts(spark).withColumn("approved", F.col("total") * 2)
    got = {(r["check"], r["subject"]): r["severity"] for r in quality.validate_rate_input(dirty, RATE).collect()}
    assert got[("invalid_rate", "approval")] == "ERROR"
    assert got[("outlier_rates", "approval")] == "WARNING"
    counts = {r["severity"]: r["abort"] for r in quality.issue_severity_counts(quality.validate_rate_input(dirty, RATE)).collect()}
    assert counts["ERROR"] is True and counts["WARNING"] is False
