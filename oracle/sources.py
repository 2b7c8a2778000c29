"""SQL for sources, sinks and the usage-event log."""

from __future__ import annotations

from oracle.benchmark import SQL as BENCHMARK
from oracle.parts import FACT, cells, statement
from oracle.quality import DIRTY

SQL: dict[str, str] = {}

SQL["read_long_csv"] = statement(
    FACT,
    "m AS (SELECT entity, brand, month, sum(amount) AS amount FROM fact GROUP BY ALL)",
    select="SELECT entity AS issuer_name, month AS year_month, count(*) AS n_rows, round(sum(amount), 2) AS amount FROM m GROUP BY 1, 2",
)
SQL["project_requested"] = (
    "SELECT o_orderstatus, round(sum(o_totalprice), 2) AS amount, 'no_such_column' AS missing FROM orders GROUP BY 1"
)
SQL["preaggregate"] = statement(
    FACT,
    DIRTY,
    select="SELECT entity, brand, returnflag, month, round(sum(try_cast(quantity_text AS DOUBLE)), 2) AS quantity_text, round(sum(amount), 2) AS amount "
    "FROM dirty GROUP BY 1, 2, 3, 4",
)
SQL["read_sql_query"] = "SELECT o_orderstatus AS order_status, count(*) AS n_rows FROM orders GROUP BY 1"
SQL["read_sql_table"] = "SELECT s_suppkey, s_name, CAST(s_nationkey AS BIGINT) AS s_nationkey, s_acctbal FROM supplier"
_results = f"SELECT dimension, category, balanced_peer_average_pct, bic_pct FROM ({BENCHMARK['share_analysis_peer_only']})"
SQL["write_results"] = _results
SQL["write_results_json"] = f"SELECT CAST(1 AS BIGINT) AS schema_version, 'share' AS analysis_type, * FROM ({_results})"
SQL["write_balanced"] = statement(
    FACT,
    cells(timed=True),
    select="SELECT dimension, CASE WHEN dimension = 'returnflag' THEN '''=' || category ELSE category END AS category, time_period, round(sum(v), 2) AS balanced_amount "
    "FROM cells GROUP BY 1, 2, 3",
)
MD5 = "md5(json_extract_string(props, '$.k'))"
EVENTS = (
    "ue AS (SELECT *, 'user_' || user_id AS usr, "
    + " || '-' || ".join(f"substr({MD5}, {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))
    + " AS session_id, CASE event_type WHEN 'signup' THEN 'session_start' WHEN 'view' THEN 'surface_viewed' WHEN 'click' THEN 'action_attempted' "
    "WHEN 'purchase' THEN 'action_completed' ELSE 'action_failed' END AS event, CASE WHEN event_type = 'view' THEN CASE WHEN user_id % 2 = 1 THEN 'rate' ELSE 'share' END END AS surface, "
    "CASE WHEN event_type IN ('click', 'purchase', 'error') THEN CASE WHEN user_id % 2 = 1 THEN 'rate_analysis' ELSE 'share_analysis' END END AS action, "
    "CASE WHEN event_type = 'error' THEN CASE WHEN value > 50 THEN 'other' ELSE 'input' END END AS category FROM events)"
)
VALID = (
    "ok AS (SELECT * FROM ue WHERE value >= 2 AND user_id % 10 <> 3 AND (user_id % 10 <> 7 OR upper(session_id) = session_id) AND NOT (value >= 40 AND value < 42) "
    "AND NOT (value >= 30 AND value < 32) AND NOT (value >= 20 AND value < 21) AND category IS DISTINCT FROM 'other')"
)
SQL["validate_events"] = statement(
    EVENTS, VALID, select='SELECT event_id, usr AS "user", event, session_id, surface, action, category FROM ok'
)
SQL["read_events_jsonl"] = statement(EVENTS, VALID, select='SELECT usr AS "user", event, count(*) AS n FROM ok GROUP BY 1, 2')
SQL["file_owner_gate"] = statement(
    EVENTS,
    "f AS (SELECT user_id % 40 AS g, min_by(usr, event_id) AS first_user FROM ue GROUP BY 1)",
    select='SELECT event_id, usr AS "user" FROM ue JOIN f ON f.g = user_id % 40 WHERE first_user = \'user_\' || g AND usr = first_user',
)
WINDOW = "ts <= TIMESTAMP '2024-01-20 12:05:00' AND ts >= TIMESTAMP '2024-01-20 12:00:00' - INTERVAL {days} DAY"
SQL["events_window"] = statement(
    EVENTS, select=f'SELECT event_id, usr AS "user", event FROM ue WHERE {WINDOW.format(days=7)}'
)
SQL["who_report"] = statement(
    EVENTS,
    select=f"SELECT usr AS \"user\", count(DISTINCT CASE WHEN event = 'session_start' THEN session_id END) AS sessions, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_seen, "
    f"count(*) FILTER (WHERE event = 'action_completed') AS completed FROM ue WHERE {WINDOW.format(days=30)} GROUP BY 1",
)
SQL["usage_summary"] = statement(
    EVENTS,
    f"w AS (SELECT * FROM ue WHERE {WINDOW.format(days=30)})",
    "vocab AS (SELECT * FROM (VALUES (0, 'surface', 'share'), (1, 'surface', 'rate'), (2, 'action', 'share_analysis'), (3, 'action', 'rate_analysis'), "
    "(4, 'outcome', 'completed'), (5, 'outcome', 'cancelled'), (6, 'outcome', 'refused'), (7, 'outcome', 'failed')) v(position, kind, value))",
    select="SELECT CAST(position AS BIGINT) AS position, kind, value, CASE kind WHEN 'surface' THEN (SELECT count(*) FROM w WHERE surface = v.value) WHEN 'action' THEN "
    "(SELECT count(*) FROM w WHERE action = v.value) ELSE (SELECT count(*) FROM w WHERE event = 'action_' || v.value) END AS n FROM vocab v",
)
SQL["usage_stream"] = statement(EVENTS, select="SELECT strftime(ts, '%Y-%m-%d') AS day, event, count(*) AS n FROM ue GROUP BY 1, 2")
SQL["who_stream"] = SQL["who_report"].split(" WHERE ts <=")[0] + " GROUP BY 1"
SQL["usage_summary_stream"] = SQL["usage_summary"].replace(f" WHERE {WINDOW.format(days=30)}", "")
SQL["closed_days_stream"] = statement(
    EVENTS,
    "wm AS (SELECT max(ts) - INTERVAL 1 DAY AS t FROM ue)",
    select="SELECT strftime(ts, '%Y-%m-%d') AS day, event, count(*) AS n FROM ue, wm WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= t GROUP BY 1, 2",
)
SQL["sessions_stream"] = statement(
    EVENTS,
    select="SELECT usr AS \"user\", count(DISTINCT session_id) AS sessions FROM ue WHERE event = 'session_start' GROUP BY 1",
)
