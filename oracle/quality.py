"""SQL for input and result checks, schema decisions and scalar functions."""

from __future__ import annotations

from oracle.benchmark import rate_ctes, share_sql
from oracle.parts import CELL, FACT, cells, pct, statement

SQL: dict[str, str] = {}

DIRTY = (
    "dirty AS (SELECT entity, CASE WHEN brand <> 'Brand#11' THEN brand END AS brand, CASE WHEN qty <> 7 THEN returnflag END AS returnflag, month, "
    "CASE WHEN qty > 1 THEN amount - 2000.0 END AS amount, qty - 1.0 AS total, discount * 300.0 AS approved, discount * 500.0 - 1.0 AS fraud, "
    "CASE WHEN qty > 48 THEN 'n/a' ELSE CAST(qty AS VARCHAR) END AS quantity_text FROM fact)"
)
NULL_SEVERITY = "CASE WHEN pct > 5.0 THEN 'ERROR' ELSE 'WARNING' END"


def issues(checks: list[tuple[str, str, str, str]]) -> str:
    return " UNION ALL ".join(
        f"SELECT {sev} AS severity, '{name}' AS check, '{subject}' AS subject, n AS n_rows, round(pct, 6) AS pct FROM (SELECT count(*) FILTER (WHERE {cond}) AS n, "
        f"count(*) FILTER (WHERE {cond}) / count(*) * 100.0 AS pct FROM dirty) WHERE n > 0"
        for name, subject, cond, sev in checks
    )


def nulls(columns):
    return [("null_values", c, f"{c} IS NULL", NULL_SEVERITY) for c in columns]


def negatives(columns):
    return [("negative_values", c, f"{c} < 0", "'ERROR'") for c in columns]


NUMERATORS = (("approval", "approved"), ("fraud", "fraud"))
NUM_GT = [("invalid_rate", n, f"{c} > total + 1e-9", "'ERROR'") for n, c in NUMERATORS]
RANGES = []
for _n, _c in NUMERATORS:
    _rate = f"(CASE WHEN total > 0 THEN 100.0 * {_c} / total END)"
    RANGES += [
        ("invalid_rates", _n, f"{_rate} > 100.0 + 1e-9", "'ERROR'"),
        ("outlier_rates", _n, f"{_rate} < -1e-9 OR {_rate} > 150.0 + 1e-9", "'WARNING'"),
    ]
SQL["check_nulls"] = statement(FACT, DIRTY, select=issues(nulls(["entity", "brand", "returnflag", "amount", "month"])))
SQL["check_negative"] = statement(FACT, DIRTY, select=issues(negatives(["amount", "total", "fraud"])))
SQL["check_num_gt_den"] = statement(FACT, DIRTY, select=issues(NUM_GT))
def low_breakdown(limit: int) -> list[str]:
    """CTE ``lowest``: the categories with most rows of a low total, as the text of a map."""
    counts = " UNION ALL ".join(
        f"SELECT '{d}' AS dimension, coalesce({d}, '<missing>') AS category, count(*) AS n_rows FROM dirty WHERE total > 0 AND total < {limit} GROUP BY 2"
        for d in ("brand", "returnflag")
    )
    return [
        f"lc AS ({counts})",
        "lr AS (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY n_rows DESC, category) AS rank FROM lc)",
        "lt AS (SELECT dimension, string_agg(category || '=' || n_rows, ',' ORDER BY rank) AS t FROM lr WHERE rank <= 5 GROUP BY 1)",
        """lowest AS (SELECT '{' || string_agg('"' || dimension || '":"' || t || '"', ',' ORDER BY dimension) || '}' AS details FROM lt)""",
    ]


SQL["check_low_denominator"] = statement(
    FACT, DIRTY, *low_breakdown(10),
    select="SELECT *, (SELECT details FROM lowest) AS details FROM (" + issues([("low_denominator", "total", "total > 0 AND total < 10", "'WARNING'")]) + ")",
)
SQL["issue_breakdown"] = statement(
    FACT, DIRTY,
    "ct AS ("
    + " UNION ALL ".join(
        f"SELECT '{d}' AS dimension, coalesce({d}, '<missing>') AS category, count(*) AS n_rows FROM dirty WHERE total > 0 AND total < 10 GROUP BY 2"
        for d in ("brand", "returnflag")
    )
    + ")",
    "rk AS (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY n_rows DESC, category) AS rank FROM ct)",
    select="SELECT * FROM rk WHERE rank <= 5",
)
SQL["check_rate_range"] = statement(FACT, DIRTY, select=issues(RANGES))
SQL["check_finite_nonneg"] = statement(
    FACT, DIRTY,
    select=issues(
        [("not_numeric", "quantity_text", "quantity_text IS NOT NULL AND try_cast(quantity_text AS DOUBLE) IS NULL", "'ERROR'")]
        + negatives(["amount", "total"])
    ),
)
SQL["preprocess"] = statement(
    FACT, DIRTY,
    "c AS (SELECT entity, coalesce(CASE WHEN amount > 0 THEN amount END, 0.0) AS a, coalesce(CASE WHEN approved > 20 THEN approved END, 0.0) AS b FROM dirty)",
    select="SELECT entity, count(*) AS n_rows, round(sum(a), 2) AS amount, round(sum(b), 2) AS approved FROM c WHERE a <> 0 OR b <> 0 GROUP BY entity",
)
SQL["check_entity_concentration"] = statement(
    FACT,
    "s AS (SELECT entity, sum(amount) / sum(sum(amount)) OVER () * 100.0 AS share FROM fact GROUP BY entity)",
    select="SELECT 'WARNING' AS severity, 'high_concentration' AS check, entity AS subject, CAST(1 AS BIGINT) AS n_rows, round(share, 6) AS pct FROM s WHERE share > 15.0",
)
SQL["check_peer_count"] = statement(
    FACT,
    "n AS (SELECT count(DISTINCT region) - count(DISTINCT CASE WHEN upper(region) = 'ASIA' THEN 1 END) AS n FROM fact)",
    select="SELECT 'ERROR' AS severity, 'insufficient_peers' AS check, 'region' AS subject, n AS n_rows, CAST(0.0 AS DOUBLE) AS pct FROM n WHERE n < 5",
)
SQL["check_small_categories"] = statement(
    FACT,
    "ct AS ("
    + " UNION ALL ".join(
        f"SELECT '{d}' AS dimension, CAST({d} AS VARCHAR) AS category, count(*) AS n FROM fact GROUP BY 2 HAVING count(*) < 16"
        for d in ("order_day", "part_size", "brand")
    )
    + ")",
    "rk AS (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY category) AS k FROM ct)",
    select="SELECT 'WARNING' AS severity, 'small_categories' AS check, dimension AS subject, count(*) AS n_rows, CAST(0.0 AS DOUBLE) AS pct, "
    "string_agg(category, ',' ORDER BY category) FILTER (WHERE k <= 5) AS examples FROM rk GROUP BY dimension",
)
SQL["check_peer_outlier_rate"] = """
WITH l AS (SELECT CAST(o_custkey AS VARCHAR) AS entity, 100.0 AS total, CASE WHEN l_quantity <= 1 AND l_discount >= 0.09 THEN 500.0 ELSE 1.0 END AS approved,
  CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END AS fraud FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
s AS (SELECT entity, 100.0 * CAST(sum(approved) AS DOUBLE) / CAST(sum(total) AS DOUBLE) AS a, 100.0 * CAST(sum(fraud) AS DOUBLE) / CAST(sum(total) AS DOUBLE) AS f FROM l GROUP BY entity),
r AS (SELECT 'approval' AS rate, entity, a AS v, median(a) OVER () AS med FROM s UNION ALL SELECT 'fraud', entity, f, median(f) OVER () FROM s)
SELECT 'WARNING' AS severity, 'peer_outlier_rate' AS check, rate || '/' || entity AS subject, round(v, 6) AS pct, round(med, 6) AS median
FROM r WHERE med > 0 AND v > 10.0 * med + 1e-9 AND v > 1.0 + 1e-9
"""
SMALL = " UNION ALL ".join(
    f"SELECT 'WARNING', 'small_categories', '{d}', n, 0.0, '{{\"examples\":\"' || x || '\"}}' FROM (SELECT count(*) AS n, string_agg(c, ',' ORDER BY c) FILTER (WHERE k <= 5) AS x FROM "
    f"(SELECT {d} AS c, row_number() OVER (ORDER BY {d}) AS k FROM dirty WHERE {d} IS NOT NULL GROUP BY {d} HAVING count(*) < 3)) WHERE n > 0"
    for d in ("brand", "returnflag")
)
SQL["validate_share_input"] = statement(
    FACT, DIRTY,
    "s AS (SELECT entity, sum(amount) / sum(sum(amount)) OVER () * 100.0 AS share FROM dirty GROUP BY entity)",
    select="SELECT *, CAST(NULL AS VARCHAR) AS details FROM (" + issues(nulls(["amount", "entity", "brand", "returnflag", "month"]) + negatives(["amount"])) + ")"
    + " UNION ALL " + SMALL
    + " UNION ALL SELECT 'WARNING', 'high_concentration', entity, 1, round(share, 6), NULL FROM s WHERE share > 50.0",
)
RATE_CHECKS = nulls(["total", "approved", "fraud"]) + negatives(["total", "approved", "fraud"]) + NUM_GT + RANGES + [
    ("low_denominator", "total", "total > 0 AND total < 100", "'WARNING'")
]
SQL["validate_rate_input"] = statement(
    FACT, DIRTY, *low_breakdown(100),
    select=f"SELECT *, CASE WHEN \"check\" = 'low_denominator' THEN (SELECT details FROM lowest) END AS details FROM ({issues(RATE_CHECKS)})",
)
SQL["issue_severity_counts"] = statement(
    FACT, DIRTY, f"i AS ({issues(RATE_CHECKS)})",
    select="SELECT severity, count(*) AS n, severity = 'ERROR' AS abort FROM i GROUP BY severity",
)
RESULTS = share_sql(("returnflag", "priority"), "entity", "period", "E3", False, True)
SQL["result_range_checks"] = f"""
WITH res AS ({RESULTS})
SELECT * FROM (VALUES
 ('balanced_peer_average_pct', (SELECT min(balanced_peer_average_pct) < -0.1 OR max(balanced_peer_average_pct) > 100.1 FROM res), FALSE, FALSE, (SELECT stddev_samp(balanced_peer_average_pct) = 0 FROM res)),
 ('target_share_pct', (SELECT min(target_share_pct) < -0.1 OR max(target_share_pct) > 100.1 FROM res), FALSE, FALSE, FALSE),
 ('distance_to_peer_pp', (SELECT min(distance_to_peer_pp) < -0.1 OR max(distance_to_peer_pp) > 100.1 FROM res), FALSE, FALSE, FALSE),
 ('original_total_volume', FALSE, (SELECT min(original_total_volume) < 0 FROM res), FALSE, FALSE),
 ('impact_pp', FALSE, (SELECT min(impact_pp) < 0 FROM res), FALSE, (SELECT stddev_samp(impact_pp) = 0 FROM res))) v("column", out_of_range, negative, infinite, flat)
"""
SQL["result_consistency_check"] = f"""
WITH res AS ({RESULTS}), d AS (SELECT {CELL}, abs(target_share_pct - balanced_peer_average_pct - round(distance_to_peer_pp, 1)) AS deviation FROM res)
SELECT {CELL}, round(deviation, 6) AS deviation FROM d WHERE deviation > 0.01
"""
SQL["duplicate_keys"] = "SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1"
SQL["share_mix_total"] = f"""
WITH own AS ({share_sql(("returnflag", "priority"), "entity", "period", None, False, True)})
SELECT dimension, time_period, CAST(100.0 AS DOUBLE) AS mix_total, sum(balanced_peer_average_pct) > 99.0 AND sum(balanced_peer_average_pct) < 101.0 AS ok FROM own GROUP BY 1, 2
"""
SQL["period_gaps"] = """
WITH d AS (SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS day FROM orders),
p AS (SELECT day, lag(day) OVER (ORDER BY day) AS previous FROM d)
SELECT day, previous, CAST(day - previous AS BIGINT) AS gap_days FROM p WHERE day - previous > 30
"""
SQL["normalize_columns"] = (
    "SELECT o_orderstatus AS order_status, round(sum(o_totalprice), 2) AS total_price, CAST(sum(o_orderkey) AS BIGINT) AS total_price_2 FROM orders GROUP BY 1"
)


def normalized(column: str) -> str:
    joined = f"regexp_replace(lower(trim({column})), '[\\s\\-.]+', '_', 'g')"
    kept = f"regexp_replace({joined}, '[^\\p{{L}}\\p{{N}}_]', '', 'g')"
    return f"regexp_replace(regexp_replace({kept}, '_+', '_', 'g'), '^_|_$', '', 'g')"


SQL["normalize_name"] = f"SELECT page_id, {normalized('url')} AS label FROM pages"
SQL["available_dimensions"] = statement(
    FACT,
    select="SELECT 'returnflag' AS dimension, returnflag AS category, count(*) AS n_rows FROM fact GROUP BY 2 UNION ALL SELECT 'priority', priority, count(*) FROM fact GROUP BY 2",
)
SQL["choose_roles"] = statement(
    FACT, select="SELECT entity AS peer, round(sum(amount), 2) AS volume, 'returnflag' AS dimensions, 'qty,txn' AS secondary FROM fact GROUP BY 1"
)
SQL["resolve_entity_column"] = statement(FACT, select="SELECT entity AS peer, count(*) AS n_rows FROM fact GROUP BY 1")
SQL["resolve_target"] = """
WITH m AS (SELECT DISTINCT CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE lower(c_mktsegment) END AS s FROM customer),
a AS (SELECT count(*) AS n FROM m WHERE upper(s) = 'MACHINERY')
SELECT 'building' AS requested, (SELECT count(DISTINCT c_mktsegment) FROM customer WHERE upper(c_mktsegment) = 'BUILDING') AS matches, 'BUILDING' AS resolved
UNION ALL SELECT 'Machinery', n, CASE WHEN n = 1 THEN (SELECT min(s) FROM m WHERE upper(s) = 'MACHINERY') END FROM a
UNION ALL SELECT 'MACHINERY', n, 'MACHINERY' FROM a UNION ALL SELECT 'nobody', 0, 'nobody'
"""
SQL["detect_schema"] = statement(
    FACT, select=f"SELECT entity, 'full' AS schema_kind, round({pct('sum(approved)', 'sum(txn)')}, 6) AS approval_pct FROM fact GROUP BY 1"
)
TARGET_SHARE = pct("sum(CASE WHEN peer = 'E3' THEN v ELSE 0.0 END)", "sum(v)")
SQL["detect_export_kind"] = statement(
    FACT, cells(timed=True, target=None),
    f"s AS (SELECT {CELL}, {TARGET_SHARE} AS x FROM cells GROUP BY ALL)",
    select="SELECT time_period, 'share_percent' AS kind, round(sum(x), 6) AS compared_total FROM s GROUP BY 1",
)
SQL["row_limit"] = "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 100"
SQL["union_results"] = statement(
    *rate_ctes(("priority", "linestatus"), "E3", False, True),
    select=f"SELECT rate || '_' || dimension AS rate_dimension, category, time_period, round({pct('sum(num)', 'sum(den)')}, 6) AS raw_pct FROM lw "
    "WHERE peer <> 'E3' AND time_period <> 'General' GROUP BY rate, dimension, category, time_period",
)
SQL["unit_key"] = statement(
    FACT, DIRTY,
    select="SELECT DISTINCT 'dimension=brand|category=' || coalesce(brand, '') || '|time_period=' || month || '|output_scope=' AS unit_key FROM dirty",
)
SQL["normalize_period"] = (
    "SELECT o_orderkey, CASE WHEN o_orderstatus NOT IN ('F', 'P') THEN strftime(o_orderdate, '%Y-%m') END AS period FROM orders"
)
SQL["period_to_date"] = """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN strftime(o_orderdate, '%Y-%m') || '-01' WHEN o_orderstatus = 'P' THEN strftime(o_orderdate, '%Y') || '-01-01'
  WHEN o_orderpriority = '5-LOW' THEN 'Q' || quarter(o_orderdate) ELSE strftime(o_orderdate, '%Y-%m-%d') END AS period FROM orders
"""
SQL["parse_bool_text"] = (
    "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CASE WHEN l_returnflag = 'R' THEN TRUE WHEN l_linestatus = 'O' THEN FALSE "
    "WHEN l_returnflag = 'N' THEN FALSE ELSE TRUE END AS flag FROM lineitem"
)
_raw = pct("n", "d")
SQL["to_bps"] = statement(
    *rate_ctes(("priority", "linestatus"), "E3", False, True),
    f"s AS (SELECT {CELL}, sum(CASE WHEN rate = 'approval' THEN num END) AS a, sum(CASE WHEN rate = 'fraud' THEN num END) AS f, sum(CASE WHEN rate = 'fraud' THEN den END) AS d "
    "FROM lw WHERE peer <> 'E3' AND time_period <> 'General' GROUP BY ALL)",
    select=f"SELECT {CELL}, round(a / d * 100.0, 6) AS raw_approval_rate_pct, round(a / d * 100.0, 6) AS balanced_approval_rate_pct, CAST(0.0 AS DOUBLE) AS approval_impact_pp, "
    "round(f / d * 100.0 * 100.0, 6) AS raw_fraud_rate_bps, round(f / d * 100.0 * 100.0, 6) AS balanced_fraud_rate_bps, CAST(0.0 AS DOUBLE) AS fraud_impact_pp FROM s",
)
SQL["sanitize_cell"] = """
WITH t AS (SELECT doc_id, CASE WHEN lang = 'en' THEN '=' || text ELSE text END AS x FROM documents)
SELECT doc_id, md5(CASE WHEN left(x, 1) IN ('=', '+', '-', '@', chr(9), chr(13)) THEN '''' || x ELSE x END) AS text_md5 FROM t
"""
SQL["sanitize_terminal"] = """
SELECT conv_id, turn, md5(regexp_replace(role || '? ' || text, '[^\\n\\t\\x20-\\x7e]', '?', 'g')) AS text_md5 FROM conversations
"""
SQL["user_token"] = "SELECT page_id, rtrim(replace(replace(to_base64(encode(url)), '+', '-'), '/', '_'), '=') AS token FROM pages"
SQL["rounding"] = (
    "SELECT l_quantity, round_even(max(l_quantity / 8.0), 2) AS r2, round_even(max(l_quantity / 8.0), 1) AS r1, count(*) AS n_rows FROM lineitem GROUP BY 1"
)
SQL["safe_pct"] = statement(
    FACT, DIRTY,
    "s AS (SELECT brand, month, sum(approved) AS a, sum(total) - 300.0 AS b FROM dirty GROUP BY ALL)",
    select=f"SELECT brand, month, round({pct('a', 'b')}, 6) AS pct FROM s",
)
