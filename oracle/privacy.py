"""SQL for rules, evidence, suppression, structural limits, fits and the audit."""

from __future__ import annotations

from oracle.parts import CELL, FACT, RULE_ROWS, cells, fit, fixable, pct, statement, whole

SQL: dict[str, str] = {}

DAYS = (
    "days AS (SELECT order_day, entity AS peer, sum(amount) AS amount, sum(qty) AS qty, sum(fraud) AS fraud, "
    "sum(txn) AS txn FROM fact GROUP BY ALL)"
)
SIZES = "sizes AS (SELECT order_day, count(*) AS peers FROM days GROUP BY order_day)"


def day_shares(metric: str, name: str = "shares") -> str:
    return (
        f"{name} AS (SELECT order_day, peer, {metric} AS v, {metric} / sum({metric}) OVER (PARTITION BY order_day) * 100.0 "
        f"AS share FROM days WHERE {metric} > 0)"
    )


COUNTS = ", ".join(f"count(*) FILTER (WHERE share + 1e-6 >= {t}) AS n_{t}" for t in (7, 8, 10, 15, 20))


def evidence(source: str = "shares", keys: str = "order_day", name: str = "ev") -> str:
    return (
        f"{name} AS (SELECT {keys}, count(*) AS participants, coalesce(max(share), 0.0) AS max_share, {COUNTS}, "
        + ", ".join(f"count(*) FILTER (WHERE share > {c} + 1e-6) AS above_{c}" for c in (25, 30, 35, 40))
        + f" FROM {source} GROUP BY ALL)"
    )


ABOVE = "CASE cap WHEN 25 THEN above_25 WHEN 30 THEN above_30 WHEN 35 THEN above_35 ELSE above_40 END"


def count_at(t: str) -> str:
    return f"CASE {t} WHEN 7 THEN n_7 WHEN 8 THEN n_8 WHEN 10 THEN n_10 WHEN 15 THEN n_15 ELSE n_20 END"


TIERS = f"(need1 = 0 OR ({count_at('t1')}) >= need1) AND (need2 = 0 OR ({count_at('t2')}) >= need2)"


def verdicts(source: str = "ev", name: str = "verdict", where: str = "TRUE") -> str:
    return (
        f"{name} AS (SELECT e.*, r.rule, r.pos, r.min_entities, r.cap, {ABOVE} AS cap_failures, ({ABOVE}) = 0 AS cap_passed, "
        f"participants >= min_entities AS participants_passed, {TIERS} AS tiers_passed, ({ABOVE}) = 0 AND "
        f"participants >= min_entities AND {TIERS} AS strict_passed FROM {source} e, rules r WHERE {where})"
    )


SELECT_RULE = (
    "CASE WHEN peers >= 10 THEN '10/40' WHEN peers >= 7 THEN '7/35' WHEN peers >= 6 THEN '6/30' "
    "WHEN peers >= 5 THEN '5/25' ELSE 'insufficient' END"
)
SQL["select_rule"] = statement(
    FACT,
    DAYS,
    SIZES,
    select=f"SELECT order_day, peers, {SELECT_RULE} AS rule, CASE WHEN peers = 4 THEN '4/35' ELSE {SELECT_RULE} END "
    "AS merchant_rule FROM sizes",
)
SQL["applicable_rules"] = statement(
    FACT, DAYS, SIZES, RULE_ROWS, select="SELECT order_day, peers, rule FROM sizes, rules WHERE peers >= min_entities"
)
SQL["rule_dominance"] = statement(
    FACT,
    DAYS,
    SIZES,
    RULE_ROWS,
    "scopes AS (SELECT * FROM (VALUES (TRUE), (FALSE)) s(merchant))",
    "may AS (SELECT order_day, merchant, r.* FROM sizes, rules r, scopes WHERE peers >= min_entities AND (rule <> '4/35' OR merchant))",
    select="SELECT b.order_day, b.merchant, b.rule FROM may b WHERE NOT EXISTS (SELECT 1 FROM may a WHERE a.order_day = b.order_day "
    "AND a.merchant = b.merchant AND a.need1 = 0 AND a.min_entities <= b.min_entities AND a.cap >= b.cap AND "
    "(a.min_entities < b.min_entities OR a.cap > b.cap OR b.need1 > 0))",
)
SQL["evaluate_rule"] = statement(
    FACT,
    DAYS,
    day_shares("amount"),
    RULE_ROWS,
    evidence(),
    verdicts(),
    select="SELECT order_day, rule, participants, round(max_share, 6) AS max_share, cap_failures, cap_passed, "
    "participants_passed, tiers_passed, strict_passed FROM verdict",
)
SQL["sweep_evidence"] = statement(
    FACT,
    DAYS,
    day_shares("amount"),
    evidence(),
    select="SELECT order_day, participants, round(max_share, 6) AS max_share, n_7, n_8, n_10, n_15, n_20 FROM ev",
)


def full_evidence(mixed: bool) -> list[str]:
    subject = "month(order_day) < 12" if mixed else "TRUE"
    flags = (
        f"{subject} AS contains_peer_data, CASE WHEN month(order_day) <> 2 THEN month(order_day) > 6 END AS merchant_scope, "
        "CASE WHEN month(order_day) = 3 THEN 'issuer_fraud' ELSE 'issuer_spend' END AS metric_context, "
        "CASE WHEN month(order_day) < 5 THEN 'clearing_spend' ELSE 'volume' END AS concentration_basis, "
        "month(order_day) >= 6 AS competitor_receives"
    )
    out = [
        FACT,
        DAYS,
        day_shares("amount", "sa"),
        evidence("sa", name="ea"),
        "mine AS (SELECT order_day, max(CASE WHEN peer = 'E1' THEN share END) AS protected_share, "
        "bool_or(peer = 'E1') AS protected_included FROM sa GROUP BY order_day)",
    ]
    if not mixed:
        return out + [f"ev AS (SELECT ea.*, protected_share, protected_included, {flags.replace('order_day', 'ea.order_day')} FROM ea JOIN mine USING (order_day))"]
    return out + [
        day_shares("fraud", "sf"),
        evidence("sf", name="ef"),
        day_shares("qty", "sq"),
        evidence("sq", name="eq"),
        "ev AS (SELECT ea.order_day, ea.participants, ef.max_share, eq.n_7, eq.n_8, eq.n_10, eq.n_15, eq.n_20, protected_share, "
        f"protected_included, {flags.replace('order_day', 'ea.order_day')} FROM ea LEFT JOIN ef ON ef.order_day = ea.order_day JOIN eq ON eq.order_day = ea.order_day "
        "JOIN mine ON mine.order_day = ea.order_day)",
    ]


def evidence_checks() -> str:
    names = [f"n_{t}" for t in (7, 8, 10, 15, 20)]
    bands = {"n_7": 7, "n_8": 8, "n_10": 10, "n_15": 15, "n_20": 20}
    clash = "contradictory_evidence"
    needed = "coalesce(protected_included AND competitor_receives, FALSE)"
    falling = "(n_7 >= n_8 AND n_8 >= n_10 AND n_10 >= n_15 AND n_15 >= n_20)"
    accounted = "(n_20 * 20.0 + (n_15 - n_20) * 15.0 + (n_10 - n_15) * 10.0 + (n_8 - n_10) * 8.0 + (n_7 - n_8) * 7.0)"
    band = "greatest(0.0, " + ", ".join(
        f"CASE WHEN {n} > 0 AND max_share + 1e-6 >= {t} THEN {t}.0 ELSE 0.0 END" for n, t in bands.items()
    ) + ")"
    possible = (
        "(CASE WHEN n_20 > 0 THEN max_share ELSE 0.0 END + greatest(n_20 - 1, 0) * max_share + (n_15 - n_20) * least(max_share, 20.0) "
        "+ (n_10 - n_15) * least(max_share, 15.0) + (n_8 - n_10) * least(max_share, 10.0) + (n_7 - n_8) * least(max_share, 8.0) "
        "+ (participants - n_7) * least(max_share, 7.0))"
    )
    checks = [
        ("merchant_scope IS NULL", "missing_evidence:merchant_scope"),
        ("metric_context IN ('issuer_fraud', 'issuer_chargeback') AND concentration_basis <> 'clearing_spend'", "incorrect_concentration_basis"),
        ("max_share IS NULL", "missing_evidence:max_share"),
        (f"protected_share IS NULL AND {needed}", "missing_evidence:protected_share"),
        ("NOT protected_included AND protected_share IS NOT NULL", f"{clash}:protected_not_included"),
        *[(f"{n} > participants", f"{clash}:{n}_over_participants") for n in names],
        ("max_share * participants + 1e-6 < 100.0", f"{clash}:shares_cannot_reach_100"),
        (f"NOT {falling}", f"{clash}:counts_not_nonincreasing"),
        (f"{accounted} + CASE WHEN max_share IS NOT NULL THEN max_share - {band} ELSE 0.0 END > 100.0 + 1e-6", f"{clash}:counts_imply_over_100"),
        (f"{falling} AND {possible} + 1e-6 < 100.0", f"{clash}:counts_cannot_reach_100"),
        *[(f"(max_share + 1e-6 >= {t}) <> ({n} > 0)", f"{clash}:{n}_against_max_share") for n, t in bands.items()],
        ("protected_share > max_share + 1e-6", f"{clash}:protected_over_max_share"),
    ]
    listed = ", ".join(f"CASE WHEN {c} THEN '{code}' END" for c, code in checks)
    return (
        "CASE WHEN NOT contains_peer_data THEN '' ELSE coalesce(array_to_string(list_sort(list_filter("
        f"[{listed}], lambda x: x IS NOT NULL)), ';'), '') END"
    )


SQL["validate_evidence"] = statement(
    *full_evidence(True), select=f"SELECT order_day, {evidence_checks()} AS failures FROM ev"
)
_status = (
    "CASE WHEN participants < min_entities OR (rule = '4/35' AND NOT coalesce(merchant_scope, FALSE)) THEN 'not_applicable' "
    f"WHEN failures = '' AND max_share <= cap + 1e-6 AND {TIERS} THEN 'passed' ELSE 'failed' END"
)
SQL["rule_sweep"] = statement(
    *full_evidence(False),
    RULE_ROWS,
    f"chk AS (SELECT *, {evidence_checks()} AS failures FROM ev)",
    "ov AS (SELECT *, CASE WHEN NOT coalesce(protected_included AND competitor_receives, FALSE) THEN 'not_applicable' WHEN failures = '' "
    "AND coalesce(protected_share <= 25.0 + 1e-6, TRUE) THEN 'passed' ELSE 'failed' END AS overlay FROM chk)",
    f"j AS (SELECT o.order_day, o.overlay, o.failures, pos, rule, {_status} AS st FROM ov o, rules)",
    select="SELECT order_day, string_agg(rule || '=' || st, ';' ORDER BY pos) AS statuses, overlay, CASE WHEN failures <> '' THEN 'invalid' "
    "WHEN count(*) FILTER (WHERE st = 'passed') = 0 THEN 'noncompliant' WHEN overlay = 'failed' THEN 'blocked_by_overlay' ELSE "
    "'compliant' END AS status, CASE WHEN overlay <> 'failed' THEN coalesce(string_agg(rule, ';' ORDER BY pos) FILTER (WHERE st = 'passed'), '') "
    "ELSE '' END AS authorizing FROM j GROUP BY order_day, overlay, failures",
)
SQL["protected_entity_overlay"] = statement(
    FACT,
    DAYS,
    day_shares("amount"),
    "p AS (SELECT order_day, max(CASE WHEN peer = 'E1' THEN share END) AS s FROM shares GROUP BY order_day)",
    select="SELECT order_day, round(s, 6) AS protected_share, coalesce(s <= 25.0, TRUE) AS overlay_passed FROM p",
)


def peer_group(protected: str | None) -> list[str]:
    test = "share > c" if protected is None else f"CASE WHEN peer = '{protected}' THEN share > 25.0 ELSE share > c END"
    return [
        FACT,
        DAYS,
        RULE_ROWS,
        "long AS (SELECT order_day, peer, 'amount' AS metric, amount AS v FROM days UNION ALL SELECT order_day, peer, 'fraud', fraud FROM days)",
        "tot AS (SELECT *, sum(v) OVER (PARTITION BY order_day, metric) AS t FROM long)",
        "sh AS (SELECT order_day, peer, metric, v / t * 100.0 AS share FROM tot WHERE t <> 0)",
        f"pm AS (SELECT order_day, metric, {COUNTS}, "
        + ", ".join(f"count(*) FILTER (WHERE {test.replace('> c', f'> {c}')}) AS above_{c}" for c in (25, 30, 35, 40))
        + " FROM sh GROUP BY ALL)",
        f"pr AS (SELECT order_day, rule, sum({ABOVE}) AS cap_failures, count(*) FILTER (WHERE NOT ({TIERS})) AS tier_failures, "
        f"bool_and(({ABOVE}) = 0 AND {TIERS}) AS ok FROM pm, rules GROUP BY ALL)",
        "sz AS (SELECT order_day, count(*) AS entities FROM days GROUP BY order_day)",
        "res AS (SELECT s.order_day, r.rule, r.pos, entities, CASE WHEN entities >= min_entities THEN CAST(coalesce(cap_failures, 0) AS BIGINT) ELSE 0 END "
        "AS cap_failures, CASE WHEN entities >= min_entities THEN coalesce(tier_failures, 0) ELSE 0 END AS tier_failures, "
        "entities >= min_entities AND coalesce(ok, TRUE) AS compliant FROM sz s CROSS JOIN rules r LEFT JOIN pr ON pr.order_day = s.order_day "
        "AND pr.rule = r.rule)",
    ]


SQL["validate_peer_group"] = statement(
    *peer_group("E1"), select="SELECT order_day, rule, entities, cap_failures, tier_failures, compliant FROM res"
)
SQL["fallback_rule"] = statement(
    *peer_group(None),
    select="SELECT order_day, min_by(rule, pos) FILTER (WHERE compliant AND pos <= 4) AS fallback_rule, "
    "bool_or(compliant AND pos <= 4) AS compliant FROM res GROUP BY order_day",
)
SQL["concentration"] = statement(
    FACT,
    DAYS,
    "t AS (SELECT order_day, peer, fraud AS v, sum(fraud) OVER (PARTITION BY order_day) AS tot FROM days)",
    select="SELECT order_day, peer, v, round(v / tot * 100.0, 6) AS share FROM t WHERE tot <> 0",
)
_cap = [FACT, DAYS, "c0 AS (SELECT order_day, CAST('inf' AS DOUBLE) AS prev, CAST('inf' AS DOUBLE) AS lim, 0 AS rounds FROM days GROUP BY order_day)"]
for _i in range(1, 11):
    _cap.append(
        f"s{_i} AS (SELECT d.order_day, any_value(prev) AS prev, any_value(lim) AS lim, any_value(rounds) AS rounds, "
        f"sum(least(qty, lim)) * (35.0::DOUBLE / 100.0 - 0.0001::DOUBLE) AS nw, max(least(qty, lim)) AS top, sum(least(qty, lim)) AS tot "
        f"FROM days d JOIN c{_i - 1} c ON c.order_day = d.order_day GROUP BY d.order_day)"
    )
    _cap.append(
        f"c{_i} AS (SELECT order_day, CASE WHEN tot <> 0 AND top > nw THEN lim ELSE prev END AS prev, CASE WHEN tot <> 0 AND top > nw "
        f"THEN nw ELSE lim END AS lim, rounds + CASE WHEN tot <> 0 AND top > nw THEN 1 ELSE 0 END AS rounds FROM s{_i})"
    )
SQL["cap_entities"] = statement(
    *_cap,
    select="SELECT d.order_day, peer, round(least(qty, lim), 6) AS v, round(CASE WHEN qty > lim THEN lim / least(qty, prev) ELSE 1.0 END, 6) "
    "AS adjustment_factor, CAST(rounds AS BIGINT) AS rounds FROM days d JOIN c10 c ON c.order_day = d.order_day",
)
TOP3 = (
    "rk AS (SELECT *, row_number() OVER (PARTITION BY order_day ORDER BY share DESC, peer) AS rank FROM shares)",
    "t3 AS (SELECT order_day, max(share) FILTER (WHERE rank = 1) AS share_1, max(share) FILTER (WHERE rank = 2) AS share_2, "
    "max(share) FILTER (WHERE rank = 3) AS share_3 FROM rk GROUP BY order_day)",
)
SQL["top_shares"] = statement(
    FACT,
    DAYS,
    day_shares("amount"),
    *TOP3,
    select="SELECT order_day, round(share_1, 6) AS share_1, round(share_2, 6) AS share_2, round(share_3, 6) AS share_3, "
    "concat_ws(', ', printf('%.2f%%', share_1), CASE WHEN share_2 IS NOT NULL THEN printf('%.2f%%', share_2) END, "
    "CASE WHEN share_3 IS NOT NULL THEN printf('%.2f%%', share_3) END) AS top_shares FROM t3",
)
SQL["tier_ordinals"] = statement(
    FACT,
    DAYS,
    day_shares("amount"),
    *TOP3,
    select="SELECT order_day, round(coalesce(share_2, 0.0), 6) AS kth_2, round(coalesce(share_3, 0.0), 6) AS kth_3, "
    "round(greatest(0.0, 15.0 - coalesce(share_2, 0.0)), 6) AS shortfall_2, round(greatest(0.0, 8.0 - coalesce(share_3, 0.0)), 6) AS shortfall_3 FROM t3",
)
SQL["safe_pct_per_day"] = statement(
    FACT,
    DAYS,
    select=f"SELECT order_day, peer, round({pct('fraud', '(txn - 1)')}, 6) AS rate FROM days",
)

# Suppression ------------------------------------------------------------------

THIN_DIMS = ("brand", "linestatus")


def thin_rows(brand: str = "brand") -> str:
    return (
        f"rows_ AS (SELECT 'brand' AS dimension, {brand} AS category, month AS time_period, entity AS peer, amount, qty, fraud, discount FROM fact "
        "UNION ALL SELECT 'linestatus', linestatus, month, entity, amount, qty, fraud, discount FROM fact)"
    )


def thin(metric: str, minimum: int, name: str, having: str = "") -> str:
    n = f"count(DISTINCT CASE WHEN {metric} > 0 THEN peer END)"
    return (
        f"{name} AS (SELECT dimension, category, time_period, {n} AS participants FROM rows_ WHERE peer <> 'E3' GROUP BY ALL "
        f"HAVING {having}{n} < {minimum} UNION ALL SELECT dimension, category, NULL, {n} FROM rows_ WHERE peer <> 'E3' "
        f"GROUP BY dimension, category HAVING {having}{n} < {minimum})"
    )


LOWEST = pct("(v * 0.5)", "(v * 0.5 + greatest(tot - v, 0.0) * 2.0)")


def structure(source: str) -> list[str]:
    return [
        f"st AS (SELECT *, sum(v) OVER (PARTITION BY {CELL}) AS tot FROM {source})",
        f"detail AS (SELECT {CELL}, peer, {LOWEST} AS min_share_pct, ({LOWEST}) - 25.0 - 1.0 AS margin_pp FROM st WHERE ({LOWEST}) - 25.0 - 1.0 > 0)",
    ]


THIN_CELLS = cells(THIN_DIMS, timed=True, target="E3", period="month", where="TRUE")
SQL["suppress_thin_cells"] = statement(
    FACT,
    thin_rows("CASE WHEN brand <> 'Brand#11' THEN brand END"),
    thin("amount", 8, "rec"),
    "cells AS (SELECT dimension, category, time_period, peer, sum(amount) AS v FROM rows_ WHERE peer <> 'E3' AND category IS NOT NULL GROUP BY ALL)",
    *structure("cells"),
    "al AS (SELECT *, 0 AS o FROM rec UNION ALL SELECT DISTINCT dimension, category, NULL, 0, 1 FROM detail)",
    "fi AS (SELECT *, row_number() OVER (PARTITION BY dimension, category, time_period ORDER BY o) AS k FROM al)",
    select=f"SELECT {CELL}, participants, CASE WHEN o = 0 THEN 'below_min_entities' ELSE 'structurally_infeasible' END AS reason FROM fi WHERE k = 1",
)
SQL["metric_suppression"] = statement(
    FACT,
    thin_rows(),
    thin("fraud", 6, "f"),
    thin("discount", 6, "d", "sum(discount) <> 0 AND "),
    select="SELECT 'fraud' AS metric, * FROM f UNION ALL SELECT 'discount', * FROM d",
)


def hit(name: str, alias: str) -> str:
    return (
        f"EXISTS (SELECT 1 FROM {name} z WHERE z.dimension = {alias}.dimension AND z.category = {alias}.category "
        f"AND (z.time_period IS NULL OR z.time_period = {alias}.time_period))"
    )


RESULTS = "res AS (SELECT dimension, category, time_period, sum(amount) AS amount, sum(qty) AS qty FROM rows_ GROUP BY ALL)"
SQL["filter_suppressed"] = statement(
    FACT, thin_rows(), thin("amount", 7, "rec"), RESULTS,
    select=f"SELECT {CELL}, round(amount, 2) AS amount, qty FROM res r WHERE NOT {hit('rec', 'r')}",
)
SQL["filter_metric_suppressed"] = statement(
    FACT, thin_rows(), thin("qty", 7, "rec", "sum(qty) <> 0 AND "), RESULTS,
    select=f"SELECT {CELL}, round(amount, 2) AS amount, CASE WHEN NOT {hit('rec', 'r')} THEN qty END AS qty FROM res r",
)
SQL["filter_release_set"] = SQL["filter_suppressed"]
SAFE = f"safe AS (SELECT DISTINCT peer, time_period FROM rows_ r WHERE amount > 0 AND NOT {hit('rec', 'r')})"
SQL["filter_safe_entities"] = statement(
    FACT, thin_rows(), thin("amount", 7, "rec"), SAFE,
    select="SELECT entity AS peer, count(*) AS n_rows FROM fact WHERE entity IN (SELECT peer FROM safe) GROUP BY 1",
)
SQL["filter_safe_periods"] = statement(
    FACT, thin_rows(), thin("amount", 9, "rec"), SAFE,
    select="SELECT month AS time_period, count(*) AS n_rows FROM fact WHERE month IN (SELECT time_period FROM safe) GROUP BY 1",
)

# Structure and fits -----------------------------------------------------------

AUDIT = [
    FACT,
    cells(timed=True, target=None, name="plain"),
    whole(target=None),
    "cells AS (SELECT * FROM plain UNION ALL SELECT * FROM whole)",
    "vols AS (SELECT peer, sum(v) AS volume FROM whole GROUP BY peer)",
]
THIN_BASE = [FACT, THIN_CELLS, "vols AS (SELECT peer, sum(v) AS volume FROM cells WHERE dimension = 'linestatus' GROUP BY peer)"]


def stats(source: str = "cells") -> list[str]:
    return [
        f"pc AS (SELECT {CELL}, count(*) FILTER (WHERE v > 0) AS participants, sum(v) AS category_total, sum(v * v) AS sq FROM {source} GROUP BY ALL)",
        "pop AS (SELECT count(*) AS n, sum(volume) AS t FROM vols)",
        f"pd AS (SELECT pc.*, sum(category_total) OVER (PARTITION BY dimension, time_period) AS dimension_total, n, t FROM pc, pop)",
        f"ps AS (SELECT *, CASE WHEN category_total > 0 AND sq > 0 THEN category_total * category_total / sq ELSE 0.0 END AS effective_peers, "
        f"({pct('category_total', 'dimension_total')}) / 100.0 AS volume_share, ({pct('category_total', 't')}) / 100.0 AS overall_share FROM pd)",
        "stats AS (SELECT *, CASE WHEN participants > 0 AND greatest(volume_share, overall_share) > 0 THEN least(1.0, sqrt(participants / n * "
        "greatest(volume_share, overall_share))) ELSE 0.0 END AS representativeness FROM ps)",
    ]


SQL["constraint_stats"] = statement(
    *AUDIT,
    *stats(),
    select=f"SELECT {CELL}, participants, round(effective_peers, 6) AS effective_peers, round(category_total, 2) AS category_total, "
    "round(dimension_total, 2) AS dimension_total, round(volume_share, 6) AS volume_share, round(overall_share, 6) AS overall_share, "
    "round(representativeness, 6) AS representativeness FROM stats",
)
SQL["dimension_unbalance"] = statement(
    *THIN_BASE,
    f"m AS (SELECT {CELL}, max(v) AS a, sum(v) AS b FROM cells GROUP BY ALL)",
    select=f"SELECT dimension, round(max({pct('a', 'b')}), 6) AS unbalance_pct FROM m GROUP BY 1",
)
SQL["structural_caps"] = statement(
    *THIN_BASE,
    *structure("cells"),
    select=f"SELECT {CELL}, peer, round(min_share_pct, 6) AS min_share_pct, round(margin_pp, 6) AS margin_pp FROM detail",
)
BY_DIM = (
    "bd AS (SELECT dimension, count(DISTINCT (category, time_period)) AS infeasible_categories, count(*) AS infeasible_peers, "
    "max(margin_pp) AS worst_margin_pp FROM detail GROUP BY dimension)"
)
SQL["structural_by_dimension"] = statement(
    *THIN_BASE, *structure("cells"), BY_DIM,
    select="SELECT dimension, infeasible_categories, infeasible_peers, round(worst_margin_pp, 6) AS worst_margin_pp FROM bd",
)
SQL["structural_summary"] = statement(
    *THIN_BASE, *structure("cells"), BY_DIM,
    "w AS (SELECT dimension, category FROM detail ORDER BY margin_pp DESC, dimension, category, time_period LIMIT 1)",
    select="SELECT CAST(sum(infeasible_categories) AS BIGINT) AS infeasible_categories, CAST(sum(infeasible_peers) AS BIGINT) AS infeasible_peers, "
    "round(max(worst_margin_pp), 6) AS worst_margin_pp, sum(infeasible_peers) > 0 AS has_structural_infeasibility, "
    "(SELECT dimension FROM w) AS top_infeasible_dimension, (SELECT category FROM w) AS top_infeasible_category FROM bd",
)


def fitted(cap: float, per_dimension: bool = False, prefix: str = "w") -> list[str]:
    return [
        f"{prefix}_in AS (SELECT 'r' AS run_id, *, {cap}::DOUBLE AS cap, 5 AS min_entities FROM cells)",
        f"{prefix}_pop AS (SELECT DISTINCT run_id, peer FROM {prefix}_in)",
        *fixable(f"{prefix}_in", f"{prefix}_ok"),
        *fit(f"{prefix}_ok", per_dimension=per_dimension, population=f"{prefix}_pop", prefix=prefix),
    ]


def fitted_shares(name: str = "ws", prefix: str = "w") -> str:
    return (
        f"{name} AS (SELECT c.*, w.multiplier AS m, {pct('(v * multiplier)', 'sum(v * multiplier) OVER p')} AS share FROM cells c "
        f"JOIN {prefix} w ON w.peer = c.peer WINDOW p AS (PARTITION BY c.dimension, c.category, c.time_period))"
    )


SQL["fit_weights"] = statement(
    *AUDIT, *fitted(25.0), select="SELECT peer, round(multiplier, 6) AS multiplier FROM w"
)
SQL["fit_weights_converged"] = statement(
    *AUDIT,
    "g_in AS (SELECT 'r' AS run_id, *, 30.0::DOUBLE AS cap, 5 AS min_entities FROM cells)",
    *fixable("g_in", "g_ok"),
    # A settled fit leaves no governed row over its cap, within bounds and with mean one.
    select="SELECT CAST(0 AS BIGINT) AS over_cap_rows, 0.0::DOUBLE AS max_excess_pp, (SELECT count(DISTINCT peer) FROM cells) AS peers, "
    "true AS above_low, true AS below_high, true AS mean_one, (SELECT count(*) FROM g_ok) AS governed_rows",
)
SQL["fit_weights_per_dimension"] = statement(
    *AUDIT, *fitted(25.0, per_dimension=True), select="SELECT dimension, peer, round(multiplier, 6) AS multiplier FROM w"
)
RAW_M = "raw AS (SELECT peer, round(volume / max(volume) OVER (), 4) AS m FROM vols)"
SQL["rescale_mean_one"] = statement(
    *AUDIT, RAW_M,
    select="SELECT peer, round(least(greatest(m * least(greatest(1.0 / avg(m) OVER (), 0.05 / min(m) OVER ()), 3.0 / max(m) OVER ()), 0.05), 3.0), 6) "
    "AS m FROM raw",
)
_wf = ["f0 AS (SELECT peer, m, TRUE AS free, FALSE AS done FROM raw)"]
for _i in range(1, 7):
    _wf.append(
        f"g{_i} AS (SELECT *, CASE WHEN free AND NOT done AND sum(CASE WHEN free THEN m ELSE 0.0 END) OVER () > 0 THEN m * (count(*) OVER () * 1.0::DOUBLE - "
        f"sum(CASE WHEN free THEN 0.0 ELSE m END) OVER ()) / sum(CASE WHEN free THEN m ELSE 0.0 END) OVER () ELSE m END AS s FROM f{_i - 1})"
    )
    _wf.append(f"h{_i} AS (SELECT *, free AND (s < 0.05 OR s > 3.0) AS o FROM g{_i})")
    _wf.append(
        f"f{_i} AS (SELECT peer, CASE WHEN NOT bool_or(o) OVER () THEN s WHEN o THEN least(greatest(s, 0.05), 3.0) ELSE m END AS m, free AND NOT o AS free, "
        f"NOT bool_or(o) OVER () AS done FROM h{_i})"
    )
SQL["waterfill_mean"] = statement(*AUDIT, RAW_M, *_wf, select="SELECT peer, round(m, 6) AS m FROM f6")
SQL["worst_excess"] = statement(
    *AUDIT, *fitted(30.0), fitted_shares(),
    select=f"SELECT {CELL}, peer, round(share, 6) AS share, round(share - 25.0, 6) AS excess FROM ws WHERE share > 25.0 "
    "ORDER BY round(share - 25.0, 9) DESC, dimension, category, time_period, peer LIMIT 1",
)
SQL["nudge_borderline"] = statement(
    *AUDIT, *fitted(25.0), fitted_shares(),
    "cp AS (SELECT max(share) - 5e-4 AS cap FROM ws)",
    f"tt AS (SELECT ws.*, sum(v * m) OVER (PARTITION BY {CELL}) AS tot FROM ws)",
    "wo AS (SELECT tt.*, cap FROM tt, cp WHERE share > cap ORDER BY round(share - cap, 9) DESC, dimension, category, time_period, peer LIMIT 1)",
    select="SELECT w.peer, round(CASE WHEN o.peer IS NOT NULL THEN least(greatest(w.multiplier * (o.cap * (o.tot - o.v * o.m) / ((100.0 - o.cap) * (o.v * o.m))), 0.01), 10.0) "
    "ELSE w.multiplier END, 6) AS multiplier FROM w LEFT JOIN wo o ON o.peer = w.peer",
)
SQL["cap_violations"] = statement(
    *AUDIT, *fitted(30.0), fitted_shares(),
    select="SELECT dimension, peer, count(*) AS cells, round(max(share), 6) AS worst_share FROM ws WHERE share > 25.0 + 1e-6 GROUP BY 1, 2",
)
SQL["cap_slack"] = statement(
    *AUDIT, *fitted(30.0), fitted_shares(),
    f"sl AS (SELECT v * m AS o, sum(v * m) OVER (PARTITION BY {CELL}) AS tot FROM ws)",
    "sx AS (SELECT *, greatest(0.0, o - 0.25 * tot) AS slack FROM sl)",
    select=f"SELECT round(max(slack), 2) AS max_slack, round(sum(slack), 2) AS sum_slack, round(max({pct('slack', 'tot')}), 6) AS max_pct_of_cell, "
    f"round(max({pct('slack', 'o')}), 6) AS max_pct_of_peer, round({pct('sum(slack)', 'sum(o)')}, 6) AS sum_pct_of_volume, sum(slack) > 1e-6 AS excess FROM sx",
)
SQL["weighting_verdict"] = statement(
    *AUDIT,
    *[c for n in (25, 30, 40) for c in [*fitted(float(n), prefix=f"w{n}x"), fitted_shares(f"s{n}x", f"w{n}x")]],
    "al AS (SELECT 'cap_25' AS run_id, share FROM s25x UNION ALL SELECT 'cap_30', share FROM s30x UNION ALL SELECT 'cap_40', share FROM s40x)",
    "rs AS (SELECT run_id, count(*) FILTER (WHERE share > 40.0 + 1e-6) AS n, max(greatest(share - 40.0, 0.0)) AS mx FROM al GROUP BY run_id)",
    select="SELECT run_id, n AS over_cap_rows, CASE WHEN NOT mx <= 0.5 OR n > 0 THEN 'non_compliant' WHEN NOT mx <= 1e-6 THEN 'best_effort' "
    "ELSE 'strict_compliant' END AS verdict FROM rs",
)
SCALE = "greatest(0.5, least(1.0, representativeness / 0.5))"
SQL["dynamic_thresholds"] = statement(
    *THIN_BASE, *stats(),
    f"dt AS (SELECT *, {SCALE} AS sc, n >= 6 AND category_total > 0 AS enforce FROM stats)",
    "du AS (SELECT *, CASE WHEN enforce THEN CAST(greatest(1, round_even(2 * sc, 0)) AS BIGINT) END AS c1, CASE WHEN enforce THEN 15.0 * sc END AS t1, "
    "CASE WHEN enforce THEN CAST(greatest(1, round_even(1 * sc, 0)) AS BIGINT) END AS c2, CASE WHEN enforce THEN 8.0 * sc END AS t2 FROM dt)",
    select=f"SELECT {CELL}, c1 AS tier_1_count, round(t1, 6) AS tier_1_threshold, c2 AS tier_2_count, round(t2, 6) AS tier_2_threshold, enforce, "
    "coalesce(c1 <> 2 OR t1 <> 15.0 OR c2 <> 1 OR t2 <> 8.0, FALSE) AS relaxed FROM du",
)


def strict_tiers(minimum: int, first: float, second: float, dynamic: bool = True) -> list[str]:
    count = f"greatest(0.5, least(1.0, participants / {minimum}, representativeness))"
    scale = "greatest(0.5, least(1.0, representativeness))"
    more = (
        "WHEN participants < 4 THEN 'low_peers' WHEN effective_peers < 2.0 THEN 'low_effective_peers' WHEN volume_share < 0.001 OR "
        "overall_share < 0.0005 THEN 'low_volume' WHEN representativeness < 0.1 THEN 'low_representativeness' "
    )
    if not dynamic:
        count, scale, more = "1.0::DOUBLE", "1.0::DOUBLE", ""
    return [
        f"sr AS (SELECT *, CASE WHEN starts_with(dimension, '_TIME_TOTAL') THEN 'time_total' WHEN participants < {minimum} THEN 'low_peers' "
        f"{more}END AS reason FROM stats)",
        f"sd AS (SELECT *, reason IS NULL AS enforce, CASE WHEN reason IS NULL THEN CAST(greatest(1, round_even(2 * {count}, 0)) AS BIGINT) END AS c1, "
        f"CASE WHEN reason IS NULL THEN {first} * {scale} END AS t1, CASE WHEN reason IS NULL THEN CAST(greatest(0, round_even(1 * {count}, 0)) AS BIGINT) END "
        f"AS c2, CASE WHEN reason IS NULL THEN {second} * {scale} END AS t2, reason IS NULL AND ({scale} < 1.0 OR {count} < 1.0) AS relaxed FROM sr)",
    ]


def tier_counts(shares: str) -> list[str]:
    return [
        f"tc AS (SELECT s.dimension, s.category, s.time_period, count(*) FILTER (WHERE share + 1e-6 >= t1) AS k1, count(*) FILTER (WHERE share + 1e-6 >= t2) AS k2 "
        f"FROM {shares} s JOIN sd ON sd.dimension = s.dimension AND sd.category = s.category AND sd.time_period = s.time_period GROUP BY ALL)",
        "tj AS (SELECT sd.*, CASE WHEN enforce THEN k1 >= c1 AND k2 >= c1 + c2 ELSE TRUE END AS tiers_passed FROM sd JOIN tc ON tc.dimension = sd.dimension "
        "AND tc.category = sd.category AND tc.time_period = sd.time_period)",
    ]


SHOWN = "c1 AS tier_1_count, round(t1, 6) AS tier_1_threshold, c2 AS tier_2_count, round(t2, 6) AS tier_2_threshold"
SQL["dynamic_thresholds_strict"] = statement(
    *THIN_BASE, *stats(), *strict_tiers(7, 15.0, 8.0),
    select=f"SELECT {CELL}, {SHOWN}, reason, enforce, relaxed FROM sd",
)
SQL["tier_violations"] = statement(
    *THIN_BASE, *stats(), *strict_tiers(7, 15.0, 8.0, dynamic=False),
    f"shr AS (SELECT {CELL}, peer, {pct('v', 'sum(v) OVER p')} AS share FROM cells WINDOW p AS (PARTITION BY {CELL}))",
    *tier_counts("shr"),
    f"rk AS (SELECT *, row_number() OVER (PARTITION BY {CELL} ORDER BY share DESC, peer) AS rank FROM shr)",
    f"tx AS (SELECT {CELL}, string_agg(printf('%.2f%%', share), ', ' ORDER BY rank) AS top_shares FROM rk WHERE rank <= 3 GROUP BY ALL)",
    select="SELECT tj.dimension, tj.category, tj.time_period, participants, round(effective_peers, 6) AS effective_peers, "
    f"round(representativeness, 6) AS representativeness, {SHOWN}, top_shares FROM tj JOIN tx ON tx.dimension = tj.dimension AND tx.category = tj.category "
    "AND tx.time_period = tj.time_period WHERE enforce AND NOT tiers_passed",
)
SQL["violation_penalty"] = statement(
    *AUDIT, *stats(), *strict_tiers(7, 15.0, 8.0), *fitted(40.0, prefix="wa"), *fitted(25.0, prefix="wb"),
    "vec AS (SELECT DISTINCT 'v0' AS run_id, peer, 1.0::DOUBLE AS multiplier FROM cells UNION ALL SELECT 'v1', peer, multiplier FROM wa "
    "UNION ALL SELECT 'v2', peer, multiplier FROM wb)",
    f"vs AS (SELECT x.run_id, c.dimension, c.category, c.time_period, c.peer, {pct('(v * multiplier)', 'sum(v * multiplier) OVER p')} AS share FROM cells c "
    f"JOIN vec x ON x.peer = c.peer WINDOW p AS (PARTITION BY x.run_id, {CELL}))",
    f"vr AS (SELECT *, row_number() OVER (PARTITION BY run_id, {CELL} ORDER BY share DESC, peer) AS k FROM vs)",
    f"vt AS (SELECT run_id, {CELL}, sum(pow(greatest(share - CASE WHEN peer = 'E1' THEN 18.0 ELSE 25.0 END, 0.0), 2)) AS ex, "
    "list(share ORDER BY k) AS tops FROM vr GROUP BY ALL)",
    "vc AS (SELECT vt.*, s.representativeness, CASE WHEN enforce THEN pow(greatest(0.0, t1 - coalesce(tops[c1], 0.0)), 2) "
    "+ pow(greatest(0.0, t2 - coalesce(tops[c1 + c2], 0.0)), 2) ELSE 0.0 END AS sh FROM vt JOIN sd s ON "
    "s.dimension = vt.dimension AND s.category = vt.category AND s.time_period = vt.time_period)",
    "vp AS (SELECT run_id, sum(greatest(0.1, representativeness) * ex) AS a, sum(greatest(0.1, representativeness) * sh) AS b FROM vc GROUP BY run_id)",
    "vd AS (SELECT run_id, sum(pow(multiplier - 1.0, 2)) AS d FROM vec GROUP BY run_id)",
    select="SELECT run_id, round(a, 3) AS cap_penalty, round(b, 3) AS tier_penalty, round(d, 3) AS deviation, round((a + b) * 1000.0 + d, 3) AS penalty "
    "FROM vp JOIN vd USING (run_id)",
)

# Audit ------------------------------------------------------------------------

AUDIT_ROWS = [
    FACT,
    cells(("brand", "returnflag"), timed=True, target=None, name="plain", period="month"),
    "whole AS (SELECT '_TIME_TOTAL_' AS dimension, month AS category, month AS time_period, entity AS peer, sum(amount) AS v FROM fact GROUP BY month, entity)",
    "cells AS (SELECT * FROM plain UNION ALL SELECT * FROM whole)",
    "vols AS (SELECT peer, sum(v) AS volume FROM whole GROUP BY peer)",
    *stats(), *fitted(40.0), fitted_shares(), *strict_tiers(10, 20.0, 10.0), *tier_counts("ws"),
    f"ar AS (SELECT ws.*, {pct('v', 'tot')} AS raw, greatest(({LOWEST}) - 40.0, 0.0) AS mp FROM "
    f"(SELECT *, sum(v) OVER (PARTITION BY {CELL}) AS tot FROM ws) ws)",
    f"cm AS (SELECT {CELL}, max(mp) AS mc FROM ar GROUP BY ALL)",
    "grid AS (SELECT t.*, mc, p.peer, p.multiplier FROM tj t JOIN cm ON cm.dimension = t.dimension AND cm.category = t.category AND cm.time_period = t.time_period, w p)",
    "au AS (SELECT g.dimension, g.category, g.time_period, CASE WHEN a.peer IS NOT NULL THEN g.peer END AS peer, CASE WHEN a.peer IS NOT NULL THEN g.multiplier END AS multiplier, "
    "coalesce(a.v, 0.0) AS v, coalesce(raw, 0.0) AS raw, coalesce(share, 0.0) AS share, "
    "g.enforce, g.tiers_passed, g.relaxed, CASE WHEN enforce THEN 'Enforced' WHEN reason = 'time_total' THEN 'Time total cap validation' ELSE 'Skipped (' || reason || ')' END "
    "AS detail, coalesce(mp, 0.0) > 0 AS sp, mc > 0 AS sc FROM grid g LEFT JOIN ar a ON a.dimension = g.dimension AND a.category = g.category "
    "AND a.time_period = g.time_period AND a.peer = g.peer)",
    # One row per cell and peer; the absent ones, alike in every value, are counted.
    "audit AS (SELECT *, share > 40.0 + 0.0 + 1e-6 AS over FROM au)",
    "folded AS (SELECT *, count(*) AS peers FROM audit GROUP BY ALL)",
]
SQL["privacy_validation"] = statement(
    *AUDIT_ROWS,
    select=f"SELECT {CELL}, peer, peers, round(multiplier, 6) AS multiplier, round(v, 2) AS original_volume, round(raw, 6) AS original_share_pct, "
    "round(share, 6) AS balanced_share_pct, NOT over AS cap_passed, enforce AS tiers_enforced, tiers_passed, relaxed AS relaxation_used, "
    "detail AS tier_detail, sp AS structural_peer, sc AS structural_category, round(CASE WHEN over THEN share - 40.0 ELSE 0.0 END, 6) AS violation_margin_pct, "
    "NOT over AND tiers_passed AND NOT relaxed AS strict_compliant FROM folded",
)
SQL["strict_failures"] = statement(
    *AUDIT_ROWS,
    select=f"SELECT {CELL}, peer, peers, round(share, 6) AS balanced_share_pct, NOT over AS cap_passed, tiers_passed FROM folded "
    "WHERE NOT (NOT over AND tiers_passed AND NOT relaxed)",
)
SQL["structural_counts"] = statement(
    *AUDIT_ROWS,
    select="SELECT count(*) FILTER (WHERE sp) AS structural_peer_rows, count(DISTINCT CASE WHEN sc THEN (dimension, category, time_period) END) "
    "AS structural_categories FROM audit",
)
COUNTED = [
    *AUDIT_ROWS,
    f"ac AS (SELECT {CELL}, count(*) < 10 AS few, NOT (count(*) FILTER (WHERE share + 1e-6 >= 20.0) >= 2 AND count(*) FILTER (WHERE share + 1e-6 >= 10.0) >= 3) AS bad "
    "FROM audit GROUP BY ALL)",
    "ct AS (SELECT (SELECT count(*) FROM audit) AS rows, (SELECT count(*) FROM audit WHERE over) AS cf, (SELECT count(*) FROM ac WHERE few) AS pf, "
    "(SELECT count(*) FROM ac WHERE bad) AS tf, (SELECT count(*) FROM audit WHERE relaxed) AS rf)",
]
SQL["strict_validation_counts"] = statement(
    *COUNTED,
    select="SELECT rows, cf AS cap_fail_rows, pf AS participant_fail_categories, tf AS tier_fail_categories, rf AS relaxed_rows, "
    "cf + pf + tf + rf AS total_violations FROM ct",
)
SQL["compliance_summary"] = statement(
    *COUNTED,
    "po AS (SELECT * FROM (VALUES ('strict'), ('best_effort'), ('accuracy_first')) p(posture))",
    "tv AS (SELECT posture, cf + pf + tf + rf AS violations FROM po, ct)",
    select="SELECT posture, violations, CASE posture WHEN 'strict' THEN CASE WHEN violations > 0 THEN 'non_compliant' ELSE 'compliant' END WHEN 'best_effort' "
    "THEN CASE WHEN violations > 0 THEN 'completed_with_warnings' ELSE 'compliant' END ELSE 'completed_accuracy_first' END AS run_status, "
    "CASE WHEN violations > 0 THEN 'violations_detected' ELSE 'fully_compliant' END AS compliance_verdict, 'not_required' AS acknowledgement_state, "
    "NOT (posture = 'strict' AND violations > 0) AS posture_consistent FROM tv",
)
SQL["redact_peer_tables"] = "SELECT 'withheld' AS status, 'peer_level_data_withheld' AS reason"
