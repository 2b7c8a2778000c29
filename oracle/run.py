"""SQL of whole runs: checks, rule, settled weights, suppression, analysis, verdict."""

from __future__ import annotations

from oracle.benchmark import WEIGHTS, rate_sql, share_sql
from oracle.parts import CELL, RULE_ROWS, cells, fit, fixable, pct, statement
from oracle.privacy import ABOVE, TIERS, evidence

SQL: dict[str, str] = {}


def fitted_weights(dims: tuple[str, ...], metric: str, period: str) -> list[str]:
    """CTEs from ``fact`` to ``weights``, by way of the rule that the number of peers chooses."""
    return [
        RULE_ROWS,
        "g_n AS (SELECT count(DISTINCT entity) AS n FROM fact WHERE entity <> 'E3')",
        "g_rule AS (SELECT r.* FROM rules r, g_n WHERE r.rule = CASE WHEN n >= 10 THEN '10/40' WHEN n >= 7 THEN '7/35' WHEN n >= 6 THEN '6/30' WHEN n >= 5 THEN '5/25' END)",
        cells(dims, ((metric, "v"),), timed=True, target="E3", name="g_plain", period=period),
        f"g_cells AS MATERIALIZED (SELECT * FROM g_plain UNION ALL SELECT '_TIME_TOTAL_', {period}, {period}, entity, sum({metric}) FROM fact WHERE entity <> 'E3' GROUP BY 2, 3, 4)",
        "g_in AS (SELECT rule AS run_id, c.*, cap, min_entities FROM g_cells c, g_rule)",
        "g_pop AS (SELECT DISTINCT rule AS run_id, entity AS peer FROM fact, g_rule WHERE entity <> 'E3')",
        *fixable("g_in", "g_ok"),
        *fit("g_ok", population="g_pop", prefix="gw"),
        "weights AS (SELECT dimension, peer, multiplier FROM gw)",
    ]


def published(dims: tuple[str, ...], metric: str, period: str, results: str, warnings: str) -> list[str]:
    """CTEs from the weights and results to what is shown."""
    who = f"count(DISTINCT CASE WHEN {metric} > 0 THEN entity END)"
    thin = " UNION ALL ".join(
        f"SELECT '{d}' AS dimension, CAST({d} AS VARCHAR) AS category, {time} AS time_period, {who} AS n FROM fact WHERE entity <> 'E3' GROUP BY {group}"
        for d in dims for time, group in ((period, "2, 3"), ("CAST(NULL AS VARCHAR)", "2"))
    )
    return [
        f"g_thin AS (SELECT * FROM ({thin}), g_rule WHERE n < min_entities)",
        f"g_sh AS (SELECT {CELL}, peer, {pct('(v * multiplier)', 'sum(v * multiplier) OVER p')} AS share, v FROM g_cells JOIN (SELECT peer, multiplier FROM gw) USING (peer) "
        f"WINDOW p AS (PARTITION BY {CELL}))",
        "g_pos AS (SELECT * FROM g_sh WHERE v > 0)",
        evidence("g_pos", CELL),
        f"g_j AS (SELECT count(*) AS governed_cells, count(*) FILTER (WHERE NOT (({ABOVE}) = 0)) AS cap_failures, "
        f"count(*) FILTER (WHERE NOT (({ABOVE}) = 0 AND participants >= r.min_entities AND {TIERS})) AS rule_failures FROM ev e JOIN g_rule r ON participants >= r.min_entities)",
        f"g_v AS (SELECT (SELECT rule FROM g_rule) AS rule, CAST(0 AS BIGINT) AS errors, CAST({warnings} AS BIGINT) AS warnings, g_j.*, "
        "CASE WHEN cap_failures > 0 THEN 'non_compliant' WHEN rule_failures > 0 THEN 'best_effort' ELSE 'strict_compliant' END AS verdict FROM g_j)",
        f"res AS ({results})",
        "pub AS (SELECT * FROM res r WHERE NOT EXISTS (SELECT 1 FROM g_thin t WHERE t.dimension = r.dimension AND t.category = r.category "
        "AND (t.time_period IS NULL OR t.time_period = r.time_period)))",
    ]


_dims = ("brand", "linestatus")
_ctes, _results = share_sql(_dims, "entity", "month", "E3", True, True).removeprefix("WITH RECURSIVE ").rsplit("\nSELECT ", 1)
_warnings = "(SELECT count(*) FROM (SELECT entity FROM fact GROUP BY 1 HAVING sum(amount) > 0.5 * (SELECT sum(amount) FROM fact)))" + "".join(
    f" + (SELECT CASE WHEN count(*) > 0 THEN 1 ELSE 0 END FROM (SELECT 1 FROM fact GROUP BY {d} HAVING count(*) < 3))" for d in _dims
)
SQL["run_share"] = statement(
    _ctes.replace(WEIGHTS, ",\n".join(fitted_weights(_dims, "amount", "month"))),
    *published(_dims, "amount", "month", "SELECT " + _results, _warnings), select="SELECT pub.*, g_v.* FROM pub, g_v",
)

_dims = ("priority", "linestatus")
_list, _results = rate_sql(_dims, "E3", True, True)
_rates = ", ".join(f"sum({c}) / sum(txn) * 100.0 AS r_{c}" for c in ("approved", "fraud"))
_outliers = " + ".join(
    f"(SELECT count(*) FROM er, (SELECT median(r_{c}) AS med FROM er) WHERE med > 0 AND r_{c} > 10 * med + 1e-9 AND r_{c} > 1.0 + 1e-9)" for c in ("approved", "fraud")
)
SQL["run_rate"] = statement(
    *[c for x in _list for c in (fitted_weights(_dims, "txn", "period") if x == WEIGHTS else [x])],
    f"er AS (SELECT entity, {_rates} FROM fact GROUP BY 1)",
    *published(_dims, "txn", "period", _results, f"(SELECT CASE WHEN count(*) > 0 THEN 1 ELSE 0 END FROM fact WHERE txn > 0 AND txn < 100) + {_outliers}"),
    select="SELECT pub.*, g_v.* FROM pub, g_v",
)
