"""SQL for cells, weights, analysis, impact and balanced tables."""

from __future__ import annotations

from oracle.parts import CELL, FACT, cells, pct, statement, with_general

SQL: dict[str, str] = {}

WEIGHTS = (
    "pv AS (SELECT entity AS peer, sum(amount) AS vol FROM fact WHERE entity <> 'E3' GROUP BY entity), "
    "pvm AS (SELECT peer, vol, avg(vol) OVER () AS mean FROM pv), "
    "weights AS (SELECT CAST(NULL AS VARCHAR) AS dimension, peer, "
    "least(greatest(round(sqrt(mean / vol), 4), 0.5), 2.0) AS multiplier FROM pvm "
    "UNION ALL SELECT 'returnflag', peer, CAST(0.75 AS DOUBLE) FROM pvm WHERE vol > mean)"
)


def weighted(source: str, name: str) -> str:
    return (
        f"{name} AS (SELECT c.*, coalesce(wd.multiplier, wg.multiplier, 1.0) AS m FROM {source} c "
        "LEFT JOIN weights wd ON wd.dimension = c.dimension AND wd.peer = c.peer "
        "LEFT JOIN weights wg ON wg.dimension IS NULL AND wg.peer = c.peer)"
    )


SQL["build_cells"] = statement(
    FACT,
    cells(),
    select=f"SELECT dimension, category, peer, round(v, 2) AS category_volume, "
    f"round(sum(v) OVER p, 2) AS volume, round({pct('v', 'sum(v) OVER p')}, 6) AS share_pct "
    "FROM cells WINDOW p AS (PARTITION BY dimension, peer)",
)
SQL["build_cells_timed"] = statement(
    FACT,
    cells(timed=True),
    select=f"SELECT {CELL}, peer, round(v, 2) AS category_volume, round(sum(v) OVER p, 2) AS volume, "
    f"round({pct('v', 'sum(v) OVER p')}, 6) AS share_pct FROM cells "
    f"WINDOW p AS (PARTITION BY {CELL})",
)
SQL["build_time_totals"] = statement(
    FACT,
    "t AS (SELECT period, entity AS peer, sum(amount) AS v FROM fact WHERE entity <> 'E3' GROUP BY ALL)",
    select="SELECT '_TIME_TOTAL_' AS dimension, period AS category, period AS time_period, peer, "
    "round(v, 2) AS category_volume, round(sum(v) OVER p, 2) AS volume, "
    f"round({pct('v', 'sum(v) OVER p')}, 6) AS share_pct FROM t WINDOW p AS (PARTITION BY period)",
)
SQL["peer_volumes"] = statement(
    FACT, select="SELECT entity AS peer, round(sum(amount), 2) AS volume FROM fact WHERE entity <> 'E3' GROUP BY 1"
)
SQL["run_facts"] = statement(
    FACT,
    select="SELECT count(*) AS records, count(DISTINCT entity) AS unique_entities, "
    "count(DISTINCT entity) FILTER (WHERE entity <> 'E3') AS peers, CAST(2 AS BIGINT) AS dimensions FROM fact",
)
SQL["canonical_order"] = statement(FACT, select="SELECT DISTINCT entity AS label FROM fact ORDER BY 1")
SQL["distinct_values"] = "SELECT DISTINCT p_type AS value FROM part WHERE p_type IS NOT NULL ORDER BY 1"
SQL["attach_weights"] = statement(
    FACT,
    cells(),
    WEIGHTS,
    weighted("cells", "cw"),
    select="SELECT dimension, category, peer, round(v, 2) AS v, round(m, 6) AS m FROM cw",
)
SQL["cell_shares"] = statement(
    FACT,
    cells(),
    WEIGHTS,
    weighted("cells", "cw"),
    select=f"SELECT dimension, category, peer, round({pct('v', 'sum(v) OVER p')}, 6) AS raw_share, "
    f"round({pct('(v * m)', 'sum(v * m) OVER p')}, 6) AS share FROM cw "
    f"WINDOW p AS (PARTITION BY {CELL})",
)
SQL["weighted_percentile"] = """
WITH d AS (SELECT l_returnflag AS returnflag, l_linestatus AS linestatus, l_extendedprice AS x,
  CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 0.0 ELSE l_quantity END AS w FROM lineitem),
c AS (SELECT *, sum(w) OVER (PARTITION BY returnflag, linestatus ORDER BY x
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum,
  sum(w) OVER (PARTITION BY returnflag, linestatus) AS tot FROM d)
SELECT returnflag, linestatus, round(CASE WHEN max(tot) > 0
  THEN min(x) FILTER (WHERE cum >= tot * CAST(0.85 AS DOUBLE)) ELSE quantile_cont(x, 0.85) END, 2) AS p85
FROM c GROUP BY 1, 2
"""


def share_sql(dims, entity, period, target, weights, timed, drop_period=False):
    source = "timed" if timed else "cells"
    ctes = [FACT]
    if weights:
        ctes.append(WEIGHTS)
    ctes.append(cells(dims, timed=timed, target=None, name=source, entity=entity, period=period))
    if timed:
        ctes.append(with_general())
    ctes.append("own0 AS (SELECT dimension, time_period, peer, sum(v) AS own FROM cells GROUP BY ALL)")
    ctes.append(
        weighted("own0", "own") if weights else "own AS (SELECT *, 1.0::DOUBLE AS m FROM own0)"
    )
    not_target = f"peer <> '{target}'" if target else "TRUE"
    ctes += [
        f"shown AS (SELECT DISTINCT {CELL} FROM cells WHERE {not_target})",
        "grid AS (SELECT s.dimension, s.category, s.time_period, o.peer, o.own, o.m, coalesce(c.v, 0.0) AS v "
        "FROM shown s JOIN own o ON o.dimension = s.dimension AND o.time_period IS NOT DISTINCT FROM s.time_period "
        "LEFT JOIN cells c ON c.dimension = s.dimension AND c.category = s.category "
        f"AND c.time_period IS NOT DISTINCT FROM s.time_period AND c.peer = o.peer WHERE o.{not_target})"
        if target
        else "grid AS (SELECT s.dimension, s.category, s.time_period, o.peer, o.own, o.m, coalesce(c.v, 0.0) AS v "
        "FROM shown s JOIN own o ON o.dimension = s.dimension AND o.time_period IS NOT DISTINCT FROM s.time_period "
        "LEFT JOIN cells c ON c.dimension = s.dimension AND c.category = s.category "
        "AND c.time_period IS NOT DISTINCT FROM s.time_period AND c.peer = o.peer)",
        f"sums AS (SELECT {CELL}, {pct('sum(v * m)', 'sum(own * m)')} AS bal, {pct('sum(v)', 'sum(own)')} AS orig, "
        f"sum(v) AS vol FROM grid GROUP BY ALL)",
        f"ranked AS (SELECT {CELL}, v / own * 100.0 AS x, sum(own * m) OVER (PARTITION BY {CELL} ORDER BY v / own, peer "
        f"ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum, sum(own * m) OVER (PARTITION BY {CELL}) AS tot "
        "FROM grid WHERE own > 0)",
        f"bic AS (SELECT {CELL}, min(x) FILTER (WHERE cum >= tot * 0.85::DOUBLE) AS bic FROM ranked GROUP BY ALL)",
    ]
    keys = "s.dimension, s.category" if drop_period else "s.dimension, s.category, s.time_period"
    same = (
        "{0}.dimension = s.dimension AND {0}.category = s.category "
        "AND {0}.time_period IS NOT DISTINCT FROM s.time_period"
    )
    base = (
        f"SELECT {keys}, round(bal, 6) AS balanced_peer_average_pct, round(coalesce(bic, 0.0), 6) AS bic_pct, "
        "round(orig, 6) AS original_peer_average_pct, round(vol, 2) AS original_total_volume, "
        "round(bal - orig, 6) AS impact_pp"
    )
    joins = f" FROM sums s LEFT JOIN bic b ON {same.format('b')}"
    if target:
        base += ", round(coalesce(tv.v / tt.own * 100.0, 0.0), 6) AS target_share_pct, "
        base += "round(coalesce(tv.v / tt.own * 100.0, 0.0) - bal, 6) AS distance_to_peer_pp"
        joins += (
            f" LEFT JOIN cells tv ON {same.format('tv')} AND tv.peer = '{target}' LEFT JOIN own tt ON "
            f"tt.dimension = s.dimension AND tt.time_period IS NOT DISTINCT FROM s.time_period AND tt.peer = '{target}'"
        )
    return statement(*ctes, select=base + joins)


SQL["share_analysis"] = share_sql(("returnflag", "priority"), "entity", "period", "E3", True, True)
SQL["share_analysis_peer_only"] = share_sql(
    ("returnflag", "priority"), "entity", "period", None, False, False, drop_period=True
)
SQL["share_analysis_sparse"] = share_sql(("brand",), "nation", "month", "NATION_3", False, True)

RATE_SUMS = (("txn", "den"), ("approved", "approval"), ("fraud", "fraud"))


def rate_ctes(dims, target, weights, timed, entity="entity", period="period", sums=RATE_SUMS):
    source = "timed" if timed else "base"
    ctes = [FACT]
    if weights:
        ctes.append(WEIGHTS)
    ctes.append(cells(dims, sums, timed=timed, target=None, name=source, entity=entity, period=period))
    names = [a for _, a in sums]
    if timed:
        ctes.append(with_general(names, name="base"))
    unions = " UNION ALL ".join(
        f"SELECT '{n}' AS rate, {CELL}, peer, {n} AS num, den FROM base" for n in names if n != "den"
    )
    ctes.append(f"long AS ({unions})")
    ctes.append(weighted("long", "lw") if weights else "lw AS (SELECT *, 1.0::DOUBLE AS m FROM long)")
    return ctes


def rate_sql(dims, target, weights, timed, drop_period=False, **more):
    ctes = rate_ctes(dims, target, weights, timed, **more)
    peers = f"peer <> '{target}'" if target else "TRUE"
    keys = f"rate, {CELL}"
    ctes += [
        f"sums AS (SELECT {keys}, {pct('sum(num * m) FILTER (WHERE den > 0)', 'sum(den * m)')} AS bal, "
        f"{pct('sum(num)', 'sum(den)')} AS orig, sum(num) AS n, sum(den) AS d FROM lw WHERE {peers} GROUP BY ALL)",
        f"ranked AS (SELECT {keys}, num / den * 100.0 AS x, sum(den * m) OVER (PARTITION BY {keys} ORDER BY num / den, peer "
        f"ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum, sum(den * m) OVER (PARTITION BY {keys}) AS tot "
        f"FROM lw WHERE {peers} AND den > 0)",
        f"bic AS (SELECT {keys}, min(x) FILTER (WHERE cum >= tot * CASE WHEN rate = 'fraud' THEN 0.15::DOUBLE "
        "ELSE 0.85::DOUBLE END) AS bic FROM ranked GROUP BY ALL)",
    ]
    same = "b.rate = s.rate AND b.dimension = s.dimension AND b.category = s.category AND b.time_period IS NOT DISTINCT FROM s.time_period"
    shown = "s.rate, s.dimension, s.category" + ("" if drop_period else ", s.time_period")
    base = (
        f"SELECT {shown}, round(bal, 6) AS balanced_peer_average_pct, round(coalesce(bic, 0.0), 6) AS bic_pct, "
        "round(orig, 6) AS original_peer_average_pct, n AS original_total_numerator, "
        "d AS original_total_denominator, round(bal - orig, 6) AS impact_pp"
    )
    joins = f" FROM sums s LEFT JOIN bic b ON {same}"
    if target:
        rate = pct("coalesce(t.num, 0.0)", "coalesce(t.den, 0.0)")
        base += f", round({rate}, 6) AS target_rate_pct, round(({rate}) - bal, 6) AS distance_to_peer_pp"
        joins += f" LEFT JOIN long t ON {same.replace('b.', 't.')} AND t.peer = '{target}'"
    return ctes, base + joins


_ctes, _select = rate_sql(("priority", "linestatus"), "E3", True, True)
SQL["rate_analysis"] = statement(*_ctes, select=_select)
_ctes, _select = rate_sql(("priority", "linestatus"), None, False, False, drop_period=True)
SQL["rate_analysis_peer_only"] = statement(*_ctes, select=_select)
_ctes, _select = rate_sql(
    ("brand", "linestatus"), None, False, True, entity="nation", period="month",
    sums=(("txn", "den"), ("fraud", "fraud")),
)
SQL["zero_bic_warning"] = statement(
    *_ctes,
    f"res AS ({_select})",
    select="SELECT rate, dimension, count(*) FILTER (WHERE abs(bic_pct) <= 1e-9) AS zero_bic_rows, "
    "bool_or(abs(bic_pct) <= 1e-9) AS warn FROM res GROUP BY 1, 2",
)

IMPACT = [
    FACT,
    WEIGHTS,
    cells(timed=True, target=None),
    weighted("cells", "cw0"),
    "cw AS (SELECT * REPLACE (CASE WHEN peer = 'E3' THEN 1.0 ELSE m END AS m) FROM cw0)",
    f"sums AS (SELECT {CELL}, sum(CASE WHEN peer = 'E3' THEN v ELSE 0.0 END) AS ev, sum(v) AS rv, sum(v * m) AS bv "
    "FROM cw GROUP BY ALL)",
    f"impact AS (SELECT *, {pct('ev', 'rv')} AS rs, {pct('ev', 'bv')} AS bs, ({pct('ev', 'bv')}) - ({pct('ev', 'rv')}) "
    "AS impact_pp FROM sums)",
]
SQL["share_impact"] = statement(
    *IMPACT,
    select=f"SELECT {CELL}, round(ev, 2) AS entity_volume, round(rv, 2) AS raw_total_volume, "
    "round(bv, 2) AS balanced_total_volume, round(rs, 6) AS raw_share_pct, round(bs, 6) AS balanced_share_pct, "
    "round(impact_pp, 6) AS impact_pp, round(impact_pp, 6) AS distortion_pp FROM impact",
)
RATE_IMPACT = rate_ctes(("priority", "linestatus"), "E3", True, True) + [
    f"rsums AS (SELECT rate, {CELL}, sum(num) AS n, sum(den) AS d, sum(num * m) AS wn, sum(den * m) AS wd FROM lw "
    "WHERE peer <> 'E3' AND time_period <> 'General' GROUP BY ALL)",
    f"rimpact AS (SELECT rate, {CELL}, {pct('n', 'd')} AS raw_pct, {pct('wn', 'wd')} AS balanced_pct, "
    f"({pct('wn', 'wd')}) - ({pct('n', 'd')}) AS impact_pp FROM rsums)",
]
SQL["rate_impact"] = statement(
    *RATE_IMPACT,
    select=f"SELECT rate, {CELL}, round(raw_pct, 6) AS raw_pct, round(balanced_pct, 6) AS balanced_pct, "
    "round(impact_pp, 6) AS impact_pp, round(impact_pp, 6) AS weight_effect_pp FROM rimpact",
)
STATS = (
    "round(avg(impact_pp), 6) AS mean_impact_pp, round(min(impact_pp), 6) AS min_impact_pp, "
    "round(max(impact_pp), 6) AS max_impact_pp, round(coalesce(stddev_samp(impact_pp), 0.0), 6) AS std_impact_pp, "
    "count(*) AS n"
)
SQL["impact_summary"] = statement(
    *IMPACT,
    select=f"SELECT 'Overall' AS aggregation, 'All Data' AS level, {STATS} FROM impact UNION ALL "
    f"SELECT 'By Dimension', dimension, {STATS} FROM impact GROUP BY dimension UNION ALL "
    f"SELECT 'By Time Period', time_period, {STATS} FROM impact GROUP BY time_period",
)
SQL["impact_summary_rate"] = statement(
    *RATE_IMPACT,
    select=f"SELECT rate, 'Overall' AS aggregation, 'All Data' AS level, {STATS} FROM rimpact GROUP BY rate UNION ALL "
    f"SELECT rate, 'By Dimension', dimension, {STATS} FROM rimpact GROUP BY rate, dimension",
)
SIZES = STATS.replace(
    "round(min(", "round(avg(abs(impact_pp)), 6) AS mean_abs_impact_pp, round(max(abs(impact_pp)), 6) AS max_abs_impact_pp, round(min(", 1
)
SQL["impact_summary_filtered"] = statement(
    *IMPACT,
    select=f"SELECT 'All Data' AS dimension, {SIZES} FROM impact UNION ALL "
    f"SELECT dimension, {SIZES} FROM impact GROUP BY dimension",
)
TABLE = [
    FACT,
    WEIGHTS,
    "wt AS (SELECT coalesce(dimension, 'Global') AS weight_scope, w.peer, multiplier, coalesce(vol, 0.0) AS rv, "
    "coalesce(vol, 0.0) * multiplier AS bv FROM weights w LEFT JOIN pv ON pv.peer = w.peer)",
    f"wtab AS (SELECT *, {pct('rv', 'sum(rv) OVER p')} AS rs, {pct('bv', 'sum(bv) OVER p')} AS bs FROM wt "
    "WINDOW p AS (PARTITION BY weight_scope))",
]
SQL["weights_table"] = statement(
    *TABLE,
    select="SELECT weight_scope, peer, round(multiplier, 6) AS multiplier, round(rv, 2) AS raw_volume, "
    "round(rs, 6) AS raw_share_pct, round(bv, 4) AS balanced_volume, round(bs, 6) AS balanced_share_pct FROM wtab",
)
SQL["rank_changes"] = statement(
    *TABLE,
    "r AS (SELECT peer, rs, bs, row_number() OVER (ORDER BY rs DESC, peer) AS a, row_number() OVER (ORDER BY bs DESC, peer) "
    "AS b FROM wtab WHERE weight_scope = 'Global')",
    select="SELECT peer, round(rs, 6) AS raw_share_pct, round(bs, 6) AS balanced_share_pct, a AS base_rank, "
    "b AS adjusted_rank, b - a AS delta FROM r",
)
SQL["method_breakdown"] = statement(
    FACT,
    WEIGHTS,
    "g AS (SELECT d.dimension, p.peer FROM (VALUES ('returnflag'), ('priority')) d(dimension), pv p)",
    select="SELECT g.dimension, g.peer, coalesce(wd.multiplier, wg.multiplier, 1.0) AS multiplier, "
    "CASE WHEN wd.peer IS NOT NULL THEN 'Per-Dimension' WHEN wg.peer IS NOT NULL THEN 'Global' ELSE 'Unweighted' END "
    "AS method FROM g LEFT JOIN weights wd ON wd.dimension = g.dimension AND wd.peer = g.peer "
    "LEFT JOIN weights wg ON wg.dimension IS NULL AND wg.peer = g.peer",
)
SQL["weights_are_identity"] = statement(
    FACT,
    WEIGHTS,
    select="SELECT coalesce(dimension, 'Global') AS weight_scope, bool_and(abs(multiplier - 1.0) <= 1e-9) AS identity "
    "FROM weights GROUP BY 1",
)
SQL["representativeness"] = statement(
    *IMPACT,
    "per AS (SELECT peer, min(multiplier) AS lo, max(multiplier) AS hi, max(CASE WHEN multiplier <= 0.501 THEN 1 ELSE 0 END) "
    "AS fl FROM weights GROUP BY peer)",
    "f AS (SELECT min(lo) AS lo, max(hi) AS hi, CAST(sum(fl) AS BIGINT) AS fl FROM per)",
    "i AS (SELECT avg(abs(impact_pp)) AS x FROM impact)",
    select="SELECT round(lo, 6) AS multiplier_min, round(hi, 6) AS multiplier_max, round(hi / lo, 6) AS multiplier_ratio, "
    "fl AS peers_at_min_floor, round(x, 6) AS mean_abs_impact_pp, hi / lo > 20.0 AS warn_ratio, fl > 0 AS warn_floor, "
    "x > 10.0 AS warn_impact FROM f, i",
)

# Thin-cell records on the balanced tables (brand and linestatus by month).
BAL_DIMS = ("brand", "linestatus")
PARTS = [
    FACT,
    WEIGHTS,
    "part_in AS ("
    + " UNION ALL ".join(
        f"SELECT '{d}' AS dimension, {d} AS category, month AS time_period, entity AS peer, amount, txn, approved, fraud, "
        "qty, discount FROM fact"
        for d in BAL_DIMS
    )
    + ")",
]


def records(metric: str, minimum: int, name: str) -> str:
    """Thin cells of one metric; a null period means all periods."""
    who = f"count(DISTINCT CASE WHEN {metric} > 0 THEN peer END)"
    zero = f"sum({metric}) <> 0 AND" if metric != "amount" else ""
    return (
        f"{name} AS (SELECT dimension, category, time_period FROM part_in WHERE peer <> 'E3' GROUP BY ALL "
        f"HAVING {zero} {who} < {minimum} UNION ALL SELECT dimension, category, NULL FROM part_in WHERE peer <> 'E3' "
        f"GROUP BY dimension, category HAVING {zero} {who} < {minimum})"
    )


def hit(name: str, alias: str) -> str:
    return (
        f"EXISTS (SELECT 1 FROM {name} z WHERE z.dimension = {alias}.dimension AND z.category = {alias}.category "
        f"AND (z.time_period IS NULL OR z.time_period = {alias}.time_period))"
    )


BAL_SUMS = tuple((m, m) for m in ("amount", "txn", "approved", "fraud", "qty", "discount"))
BAL_CELLS = [
    cells(BAL_DIMS, BAL_SUMS, timed=True, target=None, period="month"),
    weighted("cells", "cw0"),
    "cw AS (SELECT * REPLACE (CASE WHEN peer = 'E3' THEN 1.0 ELSE m END AS m) FROM cw0)",
]
SQL["balanced_metrics"] = statement(
    *PARTS,
    records("amount", 6, "sup"),
    records("qty", 7, "sq"),
    records("discount", 7, "sd"),
    records("approved", 6, "sa"),
    records("fraud", 6, "sf"),
    *BAL_CELLS,
    f"b AS (SELECT {CELL}, " + ", ".join(f"sum({m} * m) AS {m}" for m, _ in BAL_SUMS) + " FROM cw GROUP BY ALL)",
    select=f"SELECT {CELL}, round(amount, 6) AS balanced_amount, "
    f"CASE WHEN NOT {hit('sa', 'b')} THEN round(txn, 6) END AS balanced_total, "
    f"CASE WHEN NOT {hit('sa', 'b')} THEN round(approved, 6) END AS balanced_approval_total, "
    f"CASE WHEN NOT {hit('sf', 'b')} THEN round(fraud, 6) END AS balanced_fraud_total, "
    f"CASE WHEN NOT {hit('sq', 'b')} THEN round(qty, 6) END AS qty, "
    f"CASE WHEN NOT {hit('sd', 'b')} THEN round(discount, 6) END AS discount "
    f"FROM b WHERE NOT {hit('sup', 'b')}",
)
_cols = []
for _m in ("amount", "qty"):
    _guard = "TRUE" if _m == "amount" else f"NOT {hit('sq', 'b')}"
    _raw, _bal = pct(f"t_{_m}", f"(t_{_m} + r_{_m})"), pct(f"t_{_m}", f"(t_{_m} + b_{_m})")
    for _name, _expr, _digits in (
        (f"balanced_{_m}", f"b_{_m}", 6),
        (f"raw_{_m}", f"r_{_m}", 6),
        (f"raw_{_m}_share_pct", _raw, 6),
        (f"balanced_{_m}_share_pct", _bal, 6),
        (f"{_m}_impact_pp", f"({_bal}) - ({_raw})", 6),
    ):
        _cols.append(f"CASE WHEN {_guard} THEN round({_expr}, {_digits}) END AS {_name}")
SQL["balanced_export_share"] = statement(
    *PARTS,
    records("amount", 6, "sup"),
    records("qty", 7, "sq"),
    *BAL_CELLS,
    f"b AS (SELECT {CELL}, "
    + ", ".join(
        f"sum(CASE WHEN peer <> 'E3' THEN {m} * m ELSE 0.0 END) AS b_{m}, sum(CASE WHEN peer <> 'E3' THEN {m} ELSE 0.0 END) "
        f"AS r_{m}, sum(CASE WHEN peer = 'E3' THEN {m} ELSE 0.0 END) AS t_{m}"
        for m in ("amount", "qty")
    )
    + " FROM cw GROUP BY ALL)",
    select=f"SELECT {CELL}, {', '.join(_cols)} FROM b WHERE NOT {hit('sup', 'b')}",
)
PEER_SUMS = (
    f"b AS (SELECT {CELL}, "
    + ", ".join(
        f"sum(CASE WHEN peer <> 'E3' THEN {m} * m ELSE 0.0 END) AS b_{m}, sum(CASE WHEN peer <> 'E3' THEN {m} ELSE 0.0 END) "
        f"AS r_{m}"
        for m in ("txn", "approved", "fraud", "qty", "discount")
    )
    + " FROM cw GROUP BY ALL)"
)
SQL["balanced_export_rate"] = statement(
    *PARTS,
    "sup AS (SELECT * FROM (SELECT dimension, category, time_period FROM part_in WHERE peer <> 'E3' GROUP BY ALL HAVING "
    "count(DISTINCT CASE WHEN amount > 0 THEN peer END) < 5 UNION ALL SELECT dimension, category, NULL FROM part_in "
    "WHERE peer <> 'E3' GROUP BY dimension, category HAVING count(DISTINCT CASE WHEN amount > 0 THEN peer END) < 5))",
    records("txn", 6, "st"),
    records("qty", 6, "sq"),
    records("discount", 6, "sd"),
    records("approved", 5, "sa"),
    records("fraud", 5, "sf"),
    *BAL_CELLS,
    PEER_SUMS,
    f"o AS (SELECT {CELL}, CASE WHEN NOT ({hit('sa', 'b')} AND {hit('sf', 'b')}) AND NOT {hit('st', 'b')} THEN round(b_txn, 6) END "
    f"AS txn, CASE WHEN NOT {hit('sa', 'b')} AND b_approved > 0 THEN round(b_approved, 6) END AS approved, "
    f"CASE WHEN NOT {hit('sf', 'b')} AND b_fraud > 0 THEN round(b_fraud, 6) END AS fraud, "
    f"CASE WHEN NOT {hit('sq', 'b')} THEN round(b_qty, 6) END AS qty, "
    f"CASE WHEN NOT {hit('sd', 'b')} THEN round(b_discount, 6) END AS discount, "
    f"NOT {hit('sa', 'b')} OR NOT {hit('sf', 'b')} AS vis FROM b WHERE NOT {hit('sup', 'b')})",
    select=f"SELECT {CELL}, txn, approved, fraud, qty, discount FROM o WHERE vis OR qty IS NOT NULL OR discount IS NOT NULL",
)
_calc = []
for _name, _c, _s in (("approval", "approved", "sa"), ("fraud", "fraud", "sf")):
    _raw, _bal = pct(f"r_{_c}", "r_txn"), pct(f"b_{_c}", "b_txn")
    for _o, _e, _d in (
        (f"balanced_{_name}_total", f"b_{_c}", 6),
        (f"raw_{_name}_rate_pct", _raw, 6),
        (f"balanced_{_name}_rate_pct", _bal, 6),
        (f"{_name}_impact_pp", f"({_bal}) - ({_raw})", 6),
    ):
        _calc.append(f"CASE WHEN NOT {hit(_s, 'b')} THEN round({_e}, {_d}) END AS {_o}")
SQL["balanced_export_rate_calculated"] = statement(
    *PARTS,
    records("approved", 6, "sa"),
    records("fraud", 6, "sf"),
    *BAL_CELLS,
    PEER_SUMS,
    f"v AS (SELECT {CELL}, NOT ({hit('sa', 'b')} AND {hit('sf', 'b')}) AS vis FROM b)",
    select=f"SELECT {CELL}, round(r_txn, 6) AS raw_total, round(b_txn, 6) AS balanced_total, {', '.join(_calc)} "
    f"FROM b WHERE NOT ({hit('sa', 'b')} AND {hit('sf', 'b')})",
)
