"""SQL for safe coverage, strategies, presets, subsets and reconciliation."""

from __future__ import annotations

import math

from oracle.benchmark import rate_ctes
from oracle.parts import CELL, FACT, RULE_ROWS, cells, fit, fixable, pct, statement, whole
from oracle.privacy import ABOVE, TIERS, evidence, hit

SQL: dict[str, str] = {}

LOW, HIGH = 0.5, 2.0
KEY = "'dimension=' || dimension || '|category=' || category || '|time_period=' || time_period || '|output_scope='"


def long_volumes() -> str:
    parts = [
        f"SELECT '{d}' AS dimension, {d} AS category, month AS time_period, '{m}' AS metric, entity AS peer, sum({m}) AS v FROM fact GROUP BY {d}, month, entity"
        for d in ("brand", "linestatus")
        for m in ("amount", "qty", "fraud")
    ]
    return "volumes AS (" + " UNION ALL ".join(parts) + ")"


def thin_units() -> str:
    parts = []
    for d in ("brand", "linestatus"):
        n = "count(DISTINCT CASE WHEN amount > 0 THEN entity END)"
        parts.append(f"SELECT '{d}' AS dimension, {d} AS category, month AS time_period FROM fact GROUP BY {d}, month HAVING {n} < 6")
        parts.append(f"SELECT '{d}', {d}, NULL FROM fact GROUP BY {d} HAVING {n} < 6")
    return "rec AS (" + " UNION ALL ".join(parts) + ")"


UNIVERSE = [
    FACT,
    RULE_ROWS,
    long_volumes(),
    thin_units(),
    f"um AS (SELECT {CELL}, metric, count(*) FILTER (WHERE v > 0) AS n, sum(v) AS t FROM volumes GROUP BY ALL)",
    f"u0 AS (SELECT {CELL}, min(n) AS participants, count(*) AS metrics, min(t) AS lo FROM um GROUP BY ALL)",
    f"units AS (SELECT {CELL}, {KEY} AS unit_key, participants, metrics FROM u0 u WHERE participants > 0 AND lo > 0 AND NOT {hit('rec', 'u')})",
    "ur AS (SELECT units.*, r.* FROM units, rules r WHERE participants >= min_entities AND rule <> '4/35')",
    f"fr AS (SELECT u.unit_key, v.*, v / sum(v) OVER (PARTITION BY u.unit_key, metric) AS f FROM volumes v JOIN units u ON u.dimension = v.dimension "
    "AND u.category = v.category AND u.time_period = v.time_period WHERE v > 0)",
]
SQL["candidate_units"] = statement(
    *UNIVERSE,
    select="SELECT u.unit_key, u.participants, u.metrics, coalesce(string_agg(rule, ';' ORDER BY pos), '') AS rules FROM units u LEFT JOIN ur ON ur.unit_key = u.unit_key GROUP BY 1, 2, 3",
)
SQL["coverage_min_entities"] = statement(
    FACT, RULE_ROWS,
    "n AS (SELECT count(DISTINCT entity) AS peers FROM fact)",
    select="SELECT peers, CAST(coalesce((SELECT min(min_entities) FROM rules WHERE rule <> '4/35' AND min_entities <= peers), 5) AS BIGINT) AS min_entities FROM n",
)


def cap_class(cap: str, buffer: str = "(1e-6 - 1e-9)") -> str:
    c = f"({cap} + {buffer})"
    return (
        f"CASE WHEN ({c} - 100.0) * f * {HIGH} + {c} * (1.0 - f) * {LOW} >= 0 THEN 'always' "
        f"WHEN ({c} - 100.0) * f * {LOW} + {c} * (1.0 - f) * {HIGH} < 0 THEN 'never' ELSE 'uncertain' END"
    )


def tier_class(t: str) -> str:
    c = f"({t} - 1e-6 + 1e-9)"
    return (
        f"CASE WHEN (100.0 - {c}) * f * {LOW} - {c} * (1.0 - f) * {HIGH} >= 0 THEN 'always' "
        f"WHEN (100.0 - {c}) * f * {HIGH} - {c} * (1.0 - f) * {LOW} < 0 THEN 'impossible' ELSE 'uncertain' END"
    )


SQL["classify_cap"] = statement(
    *UNIVERSE,
    select="SELECT unit_key, metric, peer, " + ", ".join(f"{cap_class(f'{c}.0')} AS cap_{c}" for c in (25, 30, 35, 40)) + " FROM fr",
)
SQL["classify_tier_witness"] = statement(
    *UNIVERSE,
    select="SELECT unit_key, metric, peer, " + ", ".join(f"{tier_class(f'{t}.0')} AS tier_{t}" for t in (7, 8, 10, 15, 20)) + " FROM fr",
)
SQL["classify_protected"] = statement(
    *UNIVERSE, select=f"SELECT unit_key, metric, {cap_class('25.0', '0.0')} AS protected FROM fr WHERE peer = 'E1'"
)
SQL["prune_unit_rules"] = statement(
    *UNIVERSE,
    f"pm AS (SELECT {', '.join('ur.' + c for c in ('dimension', 'category', 'time_period', 'unit_key', 'rule', 'min_entities', 'cap', 'need1', 'need2'))}, metric, count(*) AS n, "
    f"count(*) FILTER (WHERE {cap_class('cap')} = 'never') AS nv, count(*) FILTER (WHERE {cap_class('cap')} = 'uncertain') AS nu, "
    f"count(*) FILTER (WHERE {tier_class('t1')} <> 'impossible') AS r1, count(*) FILTER (WHERE {tier_class('t2')} <> 'impossible') AS r2 "
    "FROM fr JOIN ur ON ur.unit_key = fr.unit_key GROUP BY ALL)",
    f"pr AS (SELECT {CELL}, unit_key, rule, bool_or(n < min_entities) AS too_few, bool_or(nv > 0) AS cap_never, "
    "bool_or((need1 > 0 AND r1 < need1) OR (need2 > 0 AND r2 < need2)) AS tier_unreachable, CAST(sum(nu) AS BIGINT) AS uncertain_peers FROM pm GROUP BY ALL)",
    "dm AS (SELECT b.unit_key, b.rule, EXISTS (SELECT 1 FROM ur a WHERE a.unit_key = b.unit_key AND a.need1 = 0 AND a.min_entities <= b.min_entities "
    "AND a.cap >= b.cap AND (a.min_entities < b.min_entities OR a.cap > b.cap OR b.need1 > 0)) AS dominated FROM ur b)",
    select=f"SELECT {CELL}, rule, dominated, too_few, cap_never, tier_unreachable, uncertain_peers, NOT (dominated OR too_few OR cap_never OR tier_unreachable) AS active "
    "FROM pr JOIN dm USING (unit_key, rule)",
)
VECTORS = (
    "cands AS (SELECT CAST(c.i AS BIGINT) AS cand, p.peer, CASE WHEN c.i = 0 THEN 1.0 ELSE exp("
    f"{math.log(LOW)!r}::DOUBLE + ((0.5 + c.i * a) - floor(0.5 + c.i * a)) * {math.log(HIGH) - math.log(LOW)!r}::DOUBLE) END AS w "
    "FROM (SELECT peer, CAST(('0x' || substr(md5(peer), 1, 6)) AS BIGINT) / 16777216.0::DOUBLE AS a FROM (SELECT DISTINCT peer FROM volumes)) p, range(0, 9) c(i))"
)


def outcomes(weights: str, by: str = "") -> list[str]:
    """Per unit (and candidate): first passing rule by name and the overlay."""
    lead = f"{by}, " if by else ""
    same = f"AND e.{by} = x.{by} " if by else ""
    return [
        f"sh AS (SELECT {'c.' + lead if by else ''}fr.unit_key, fr.metric, fr.peer, fr.v * c.w / sum(fr.v * c.w) OVER (PARTITION BY {'c.' + lead if by else ''}fr.unit_key, fr.metric) * 100.0 AS share "
        f"FROM fr JOIN {weights} c ON c.peer = fr.peer)",
        evidence("sh", f"{lead}unit_key, metric"),
        f"vd AS (SELECT {lead}e.unit_key, ur.rule, bool_and(({ABOVE}) = 0 AND e.participants >= min_entities AND {TIERS}) AS ok FROM ev e JOIN ur ON ur.unit_key = e.unit_key GROUP BY ALL)",
        f"fs AS (SELECT {lead}unit_key, min(rule) FILTER (WHERE ok) AS rule FROM vd GROUP BY ALL)",
        f"pt AS (SELECT {lead}unit_key, max(share) FILTER (WHERE peer = 'E1') AS ps FROM sh GROUP BY ALL)",
        f"oc AS (SELECT {'x.' + lead if by else ''}x.unit_key, x.rule, coalesce(e.ps <= 25.0 + 1e-6, TRUE) AS held FROM fs x LEFT JOIN pt e ON e.unit_key = x.unit_key {same})",
    ]


SCORES = [
    *UNIVERSE, VECTORS, *outcomes("cands", "cand"),
    "sc AS (SELECT cand, count(*) FILTER (WHERE rule IS NOT NULL AND held) AS score FROM oc GROUP BY cand)",
    "ds AS (SELECT cand, sum(abs(ln(w))) AS distance FROM cands GROUP BY cand)",
]
SQL["score_candidates"] = statement(
    *SCORES, select="SELECT ds.cand, coalesce(score, 0) AS score, round(distance, 6) AS distance FROM ds LEFT JOIN sc ON sc.cand = ds.cand"
)
SQL["best_candidate"] = statement(
    *SCORES,
    select="SELECT ds.cand, coalesce(score, 0) AS score, round(round(distance, 12), 6) AS distance FROM ds LEFT JOIN sc ON sc.cand = ds.cand "
    "ORDER BY coalesce(score, 0) DESC, round(distance, 12), ds.cand LIMIT 1",
)
VECTOR = (
    f"vt AS (SELECT peer, sum(v) AS t FROM volumes WHERE metric = 'amount' GROUP BY peer)",
    f"vec AS (SELECT peer, least(greatest(round(sqrt(avg(t) OVER () / t), 4), {LOW}), {HIGH}) AS w FROM vt)",
)
PARTITION = [
    *UNIVERSE, *VECTOR, *outcomes("vec"),
    f"pa AS (SELECT u.*, coalesce(held, FALSE) AND rule IS NOT NULL AS released, CASE WHEN coalesce(held, FALSE) THEN rule END AS authorizing_rule FROM units u LEFT JOIN oc ON oc.unit_key = u.unit_key)",
]
SQL["release_partition"] = statement(*PARTITION, select="SELECT unit_key, released, authorizing_rule FROM pa")
SQL["released_units"] = statement(
    *PARTITION, select=f"SELECT unit_key, {CELL}, participants FROM pa WHERE released"
)
SQL["check_partition"] = statement(
    *PARTITION,
    select="SELECT 'duplicate_release_key' AS code, count(*) FILTER (WHERE released AND dimension = 'linestatus') AS n FROM pa UNION ALL "
    "SELECT 'unknown_release_key', 0 UNION ALL SELECT 'release_partition_mismatch', count(*) FILTER (WHERE NOT released AND time_period = '1997-03') FROM pa",
)
_codes = (
    "duplicate_release_key", "unknown_release_key", "release_partition_mismatch", "weight_nonfinite", "weight_out_of_bounds", "weight_missing",
    "authorizing_rule_unknown", "authorizing_rule_inapplicable", "authorizing_rule_failed", "overlay_failed", "hidden_passing_unit",
    "weight_partition_mismatch", "universe_digest_mismatch",
)
_tampered = {
    "authorizing_rule_inapplicable": "released AND time_period <> '1997-03' AND dimension = 'brand' AND participants < 10",
    "authorizing_rule_failed": "released AND time_period <> '1997-03' AND dimension = 'brand' AND participants >= 10 AND NOT coalesce(ok10, FALSE)",
    "hidden_passing_unit": "released AND time_period = '1997-03'",
    "weight_partition_mismatch": "released AND (time_period = '1997-03' OR (dimension = 'brand' AND authorizing_rule <> '10/40'))",
}
SQL["verify_release"] = statement(
    *PARTITION,
    "pk AS (SELECT pa.*, (SELECT ok FROM vd WHERE vd.unit_key = pa.unit_key AND vd.rule = '10/40') AS ok10 FROM pa)",
    select=" UNION ALL ".join(
        [f"SELECT 'faithful' AS record, '{c}' AS code, CAST(0 AS BIGINT) AS n" for c in _codes]
        + [
            f"SELECT 'tampered', '{c}', " + (f"(SELECT count(*) FROM pk WHERE {_tampered[c]})" if c in _tampered else "0")
            for c in _codes
        ]
    ),
)
def digest(source: str, order: list[str], text: str, prefix: str = "") -> list[str]:
    line = " || chr(31) || ".join([*order, text])
    pieces = ", ".join(f"sum(CAST(('0x' || substr(h, {1 + 15 * i}, 15)) AS BIGINT)::HUGEINT) AS p{i}" for i in range(4))
    return [
        f"{prefix}lf AS (SELECT sha256({line}) AS h FROM {source})",
        f"{prefix}gp AS (SELECT substr(h, 1, 2) AS g, count(*) AS n, {pieces} FROM {prefix}lf GROUP BY 1)",
        f"{prefix}dg AS (SELECT sha256(string_agg(l, ';' ORDER BY l)) AS digest FROM (SELECT g || ':' || n || ':' || p0 || ':' || p1 || ':' || p2 || ':' || p3 AS l FROM {prefix}gp))",
    ]


RULE_TEXT = "5/25:5:25:;6/30:6:30:3@7;7/35:7:35:2@15,3@8;10/40:10:40:2@20,3@10;4/35:4:35:"
SQL["coverage_certificate"] = statement(
    *PARTITION,
    "rel AS (SELECT * FROM pa WHERE released)",
    *digest("rel", ["unit_key"], "authorizing_rule", "v_"), *digest("vec", ["peer"], "printf('%.6f', w)", "w_"),
    "ct AS (SELECT count(*) AS candidate_units, count(*) FILTER (WHERE released) AS released_units, count(*) FILTER (WHERE NOT released) AS suppressed_units, "
    "coalesce(array_to_string(list_sort(list(DISTINCT authorizing_rule) FILTER (WHERE authorizing_rule IS NOT NULL)), ';'), '') AS authorizing_rules, "
    "round(count(*) FILTER (WHERE released) / count(*) * 100.0, 6) AS coverage_pct, (SELECT digest FROM v_dg) AS visible_digest, "
    f"(SELECT digest FROM w_dg) AS weights_digest, sha256('{RULE_TEXT}') AS rule_set_digest FROM pa)",
    select="SELECT *, sha256(concat_ws('|', candidate_units, released_units, suppressed_units, authorizing_rules, visible_digest, weights_digest, rule_set_digest)) "
    "AS certificate_digest FROM ct",
)


SQL["release_mask_digest"] = statement(
    *PARTITION, *digest("pa", ["unit_key"], "CASE WHEN released THEN '1' ELSE '0' END"), select="SELECT digest FROM dg"
)
def unit_digests(source: str) -> list[str]:
    """CTEs of the digest of each unit from unit_key, metric, peer, v; and of all units."""
    pieces = lambda h: ", ".join(f"sum(CAST(('0x' || substr({h}, {1 + 15 * i}, 15)) AS BIGINT)::HUGEINT) AS p{i}" for i in range(4))
    ps = " || ':' || ".join(f"p{i}" for i in range(4))
    return [
        f"z_l AS (SELECT unit_key, sha256(metric || chr(31) || peer || chr(31) || printf('%.6f', v)) AS h FROM {source})",
        f"z_g AS (SELECT unit_key, count(*) AS n, {pieces('h')} FROM z_l GROUP BY 1)",
        f"z_u AS (SELECT unit_key, sha256(unit_key || ':' || n || ':' || {ps}) AS digest FROM z_g)",
        f"z_b AS (SELECT substr(sha256(unit_key), 1, 2) AS g, count(*) AS n, {pieces('sha256(digest)')} FROM z_u GROUP BY 1)",
        f"z_r AS (SELECT sha256(string_agg(l, ';' ORDER BY l)) AS digest FROM (SELECT g || ':' || n || ':' || {ps} AS l FROM z_b))",
    ]


PLACED = (
    "px AS (SELECT u.unit_key, v.* FROM volumes v JOIN units u ON u.dimension = v.dimension AND u.category = v.category AND u.time_period = v.time_period)"
)
SQL["universe_digest"] = statement(*UNIVERSE, PLACED, *unit_digests("px"), select="SELECT digest FROM z_r")
SQL["digest_differences"] = statement(
    *UNIVERSE, PLACED,
    select="SELECT unit_key, CASE WHEN dimension = 'linestatus' THEN 'added' ELSE 'changed' END AS difference FROM px "
    "WHERE dimension = 'linestatus' OR (substr(time_period, 6, 2) = '07' AND peer = 'E4') GROUP BY 1, 2",
)
SQL["release_decision"] = statement(
    *PARTITION,
    "rd AS (SELECT count(*) FILTER (WHERE released) AS released_units, count(*) FILTER (WHERE NOT released) AS suppressed_units FROM pa)",
    select="SELECT w.weights, CAST(0 AS BIGINT) AS failures, released_units, suppressed_units, TRUE AS reached, released_units > 0 AS authorized, "
    "CASE WHEN released_units = 0 THEN 'empty_release' END AS withholding_reason FROM rd, (VALUES ('stated'), ('searched')) w(weights)",
)
# What must hold of every governed peer after a search that ended by itself.
SQL["refine_weights"] = statement(
    *UNIVERSE,
    select="SELECT DISTINCT peer, TRUE AS in_bounds, CAST(0 AS BIGINT) AS improving_moves, 'search_complete' AS search_state, "
    "TRUE AS count_is_exact, TRUE AS not_below_neutral, TRUE AS not_below_fitted FROM volumes WHERE metric = 'amount'",
)
SQL["denial_audit"] = statement(
    *PARTITION,
    select="SELECT 'non_publishable_privacy_audit' AS artifact_type, FALSE AS publishable, 'withheld' AS run_status, 'search_incomplete' AS withholding_reason, "
    "'sweep_any_applicable' AS strategy, array_to_string(list_sort(list(DISTINCT authorizing_rule) FILTER (WHERE authorizing_rule IS NOT NULL)), ';') AS applicable_rules FROM pa",
)

# Strategies -------------------------------------------------------------------


def attach(source: str, weights: str, name: str) -> str:
    return (
        f"{name} AS (SELECT c.*, coalesce(wd.multiplier, wg.multiplier, 1.0) AS m FROM {source} c LEFT JOIN {weights} wd ON wd.run_id = c.run_id "
        f"AND wd.dimension = c.dimension AND wd.peer = c.peer LEFT JOIN {weights} wg ON wg.run_id = c.run_id AND wg.dimension IS NULL AND wg.peer = c.peer)"
    )


def runs_for(where: str, cap: str = "r.cap") -> list[str]:
    return [
        FACT,
        RULE_ROWS,
        cells(target=None),
        "np AS (SELECT count(DISTINCT peer) AS n FROM cells)",
        f"runs AS (SELECT r.rule AS run_id, c.*, {cap} AS cap, r.min_entities FROM cells c, rules r, np WHERE {where})",
        "pop AS (SELECT DISTINCT run_id, peer FROM runs)",
        *fixable("runs", "ok_runs"),
        *fit("ok_runs", population="pop"),
        attach("runs", "w", "rw"),
        "sh AS (SELECT run_id, min_entities AS mn, dimension, category, peer, v * m / sum(v * m) OVER (PARTITION BY run_id, dimension, category) * 100.0 AS share FROM rw WHERE v * m > 0)",
        evidence("sh", "run_id, mn, dimension, category"),
    ]


SQL["strategy_outcome"] = statement(
    *runs_for("n >= r.min_entities", "CASE WHEN peer = 'E1' THEN least(r.cap, 25.0) ELSE r.cap END"),
    f"jd AS (SELECT run_id, r.rule, bool_and(({ABOVE}) = 0 AND participants >= r.min_entities AND {TIERS}) AS passed FROM ev e, rules r WHERE participants >= mn GROUP BY ALL)",
    "hl AS (SELECT run_id, coalesce(max(ps) <= 25.0 + 1e-6, TRUE) AS held FROM (SELECT run_id, mn, dimension, category, count(*) AS k, max(share) FILTER (WHERE peer = 'E1') AS ps FROM sh GROUP BY ALL) WHERE k >= mn GROUP BY run_id)",
    "ow AS (SELECT jd.*, held FROM jd JOIN hl USING (run_id))",
    "dp AS (SELECT o.run_id AS d FROM ow o JOIN rules r ON r.rule = o.run_id, np WHERE o.run_id = o.rule AND passed AND held ORDER BY (o.run_id <> CASE WHEN n >= 10 THEN '10/40' "
    "WHEN n >= 7 THEN '7/35' WHEN n >= 6 THEN '6/30' WHEN n >= 5 THEN '5/25' ELSE 'insufficient' END), r.pos LIMIT 1)",
    select="SELECT r.rule, CASE WHEN n < r.min_entities THEN 'not_applicable' WHEN coalesce(a.passed, FALSE) AND coalesce(a.held, FALSE) THEN 'feasible' ELSE 'infeasible' END AS fit_status, "
    "coalesce(r.rule = (SELECT d FROM dp), FALSE) AS is_display, CASE WHEN n < r.min_entities THEN 'not_applicable' WHEN coalesce(b.passed, FALSE) THEN 'passed' ELSE 'failed' END AS output_status, "
    "n >= r.min_entities AND coalesce(b.passed, FALSE) AND coalesce(b.held, FALSE) AS authorizing FROM rules r CROSS JOIN np LEFT JOIN ow a ON a.run_id = r.rule AND a.rule = r.rule "
    "LEFT JOIN ow b ON b.run_id = (SELECT d FROM dp) AND b.rule = r.rule",
)
SQL["single_rule_outcome"] = statement(
    *runs_for(
        "r.rule = CASE WHEN n >= 10 THEN '10/40' WHEN n >= 7 THEN '7/35' WHEN n >= 6 THEN '6/30' WHEN n >= 5 THEN '5/25' END"
    ),
    f"jd AS (SELECT e.*, ({ABOVE}) = 0 AS a, participants >= r.min_entities AS b, {TIERS} AS c FROM ev e JOIN rules r ON r.rule = e.run_id WHERE participants >= mn)",
    select="SELECT run_id AS rule, bool_and(a AND b AND c) AS passed, count(*) AS governed_groups, count(*) FILTER (WHERE NOT a) AS cap_failures, count(*) FILTER (WHERE NOT c) AS tier_failures, "
    "round(max(max_share), 6) AS max_share FROM jd GROUP BY run_id",
)


def preset_ctes() -> list[str]:
    out = [
        FACT,
        cells(target=None),
        "ps AS (SELECT * FROM (VALUES ('tight', 25.0::DOUBLE), ('middle', 30.0::DOUBLE), ('loose', 40.0::DOUBLE)) p(run_id, cap))",
        "runs AS (SELECT ps.run_id, c.*, ps.cap, 5 AS min_entities FROM cells c, ps)",
        "pruns AS (SELECT * FROM runs WHERE peer <> 'E3')",
        "pop AS (SELECT DISTINCT run_id, peer FROM pruns)",
        *fixable("pruns", "ok_runs"),
        *fit("ok_runs", population="pop", prefix="wg"),
        *fit("ok_runs", population="pop", prefix="wd", per_dimension=True),
    ]
    for p, name in (("wg", "global"), ("wd", "per_dimension")):
        out += [
            attach("runs", p, f"{p}_r"),
            f"{p}_i AS (SELECT '{name}' AS variant, run_id, dimension, category, sum(CASE WHEN peer = 'E3' THEN v ELSE 0.0 END) AS ev, sum(v) AS rv, "
            f"sum(CASE WHEN peer = 'E3' THEN v ELSE v * m END) AS bv FROM {p}_r GROUP BY ALL)",
        ]
    out += [
        "im AS (SELECT *, ({0}) - ({1}) AS x FROM (SELECT * FROM wg_i UNION ALL SELECT * FROM wd_i))".format(pct("ev", "bv"), pct("ev", "rv")),
        "pc AS (SELECT run_id AS preset, variant, avg(abs(x)) AS a, max(abs(x)) AS b FROM im GROUP BY 1, 2)",
    ]
    return out


SQL["preset_comparison"] = statement(
    *preset_ctes(),
    select="SELECT preset, variant, round(a, 6) AS mean_abs_impact_pp, round(b, 6) AS max_abs_impact_pp, 'ok' AS status FROM pc "
    "UNION ALL SELECT 'open', unnest(['global', 'per_dimension']), NULL, NULL, 'blocked: accuracy_first acknowledgement required'",
)
_sums = (("txn", "v"), ("approved", "approved"), ("fraud", "fraud"))
SQL["preset_comparison_rate"] = statement(
    FACT,
    cells(("priority", "linestatus"), _sums, timed=True),
    "ps AS (SELECT * FROM (VALUES ('tight', 25.0::DOUBLE), ('middle', 30.0::DOUBLE), ('loose', 40.0::DOUBLE), ('open', 60.0::DOUBLE)) p(run_id, cap))",
    "runs AS (SELECT ps.run_id, c.*, ps.cap, 5 AS min_entities FROM cells c, ps)",
    "pop AS (SELECT DISTINCT run_id, peer FROM runs)",
    *fixable("runs", "ok_runs"),
    *fit("ok_runs", population="pop", prefix="wg"),
    *fit("ok_runs", population="pop", prefix="wd", per_dimension=True),
    *[
        c
        for p, name in (("wg", "global"), ("wd", "per_dimension"))
        for c in (
            attach("runs", p, f"{p}_r"),
            f"{p}_s AS (SELECT '{name}' AS variant, run_id, dimension, category, time_period, sum(v) AS d, sum(v * m) AS wd, sum(approved) AS a, sum(approved * m) AS wa, "
            f"sum(fraud) AS f, sum(fraud * m) AS wf FROM {p}_r GROUP BY ALL)",
        )
    ],
    "un AS (SELECT * FROM wg_s UNION ALL SELECT * FROM wd_s)",
    f"im AS (SELECT run_id, variant, abs(({pct('wa', 'wd')}) - ({pct('a', 'd')})) AS x FROM un UNION ALL SELECT run_id, variant, abs(({pct('wf', 'wd')}) - ({pct('f', 'd')})) FROM un)",
    select="SELECT run_id AS preset, variant, round(avg(x), 6) AS mean_abs_impact_pp, round(max(x), 6) AS max_abs_impact_pp, 'ok' AS status FROM im GROUP BY 1, 2",
)
SQL["best_preset"] = statement(
    *preset_ctes(), select="SELECT preset, variant, round(a, 6) AS mean_abs_impact_pp FROM pc ORDER BY a, preset, variant LIMIT 1"
)


SUBSET_DIMS = ("brand", "linestatus", "priority", "returnflag")


def subset_ctes() -> list[str]:
    """Every subset fitted, and which of them a search by levels looks at."""
    rows = []
    for mask in range(1, 1 << len(SUBSET_DIMS)):
        chosen = [d for i, d in enumerate(SUBSET_DIMS) if mask >> i & 1]
        rows += [f"({mask}, '{','.join(chosen)}', {len(chosen)}, '{d}')" for d in [*chosen, "_TIME_TOTAL_"]]
    return [
        FACT,
        cells(SUBSET_DIMS, target=None, timed=True, name="plain"),
        whole(target=None),
        "cells AS MATERIALIZED (SELECT * FROM plain UNION ALL SELECT * FROM whole)",
        f"ss AS (SELECT * FROM (VALUES {', '.join(rows)}) s(mask, run_id, size, dimension))",
        "runs AS (SELECT s.mask, s.run_id, s.size, c.*, 14.0::DOUBLE AS cap FROM cells c JOIN ss s ON s.dimension = c.dimension)",
        "pop AS (SELECT DISTINCT run_id, peer FROM runs)",
        *fit("runs", population="pop"),
        attach("runs", "w", "rw"),
        f"sh AS (SELECT mask, run_id, size, {pct('(v * m)', 'sum(v * m) OVER p')} AS share FROM rw WINDOW p AS (PARTITION BY run_id, dimension, category, time_period))",
        "th AS (SELECT run_id, count(*) FILTER (WHERE k > 0 AND k < 5) AS thin FROM (SELECT run_id, dimension, category, time_period, count(*) FILTER (WHERE v > 0) AS k FROM runs GROUP BY ALL) GROUP BY 1)",
        "lg AS (SELECT sh.mask, sh.run_id, sh.size, any_value(thin) AS thin, count(*) FILTER (WHERE share > 14.0 + 1.0 + 1e-6) AS n, max(greatest(share - 14.0 - 1.0, 0.0)) AS a, "
        "sum(greatest(share - 14.0 - 1.0, 0.0)) AS b FROM sh JOIN th ON th.run_id = sh.run_id GROUP BY 1, 2, 3)",
        "lf AS (SELECT *, n = 0 AND thin = 0 AS fits FROM lg)",
    ]


def subset_log(chosen: str) -> str:
    return (
        "SELECT run_id AS dimensions, CAST(size AS BIGINT) AS size, n AS over_cap_rows, round(a, 6) AS max_excess_pp, round(b, 6) AS sum_excess_pp, thin AS thin_cells, "
        f"fits AS feasible, coalesce(run_id = (SELECT run_id FROM {chosen} WHERE fits ORDER BY size DESC, run_id LIMIT 1), FALSE) AS best, FALSE AS cut FROM {chosen}"
    )


_whole_set = (1 << len(SUBSET_DIMS)) - 1
TRIED = (
    f"tr AS (SELECT * FROM lf l WHERE size = 1 OR mask = {_whole_set} OR (NOT (SELECT fits FROM lf WHERE mask = {_whole_set}) "
    "AND NOT EXISTS (SELECT 1 FROM lf p WHERE (p.mask & l.mask) = p.mask AND p.mask <> l.mask AND NOT p.fits)))"
)
SQL["search_dimension_subsets"] = statement(*subset_ctes(), TRIED, select=subset_log("tr"))
SQL["greedy_dimension_subsets"] = statement(
    *subset_ctes(),
    "ub AS (SELECT dimension, max(x) AS u FROM (SELECT dimension, max(v) / sum(v) * 100.0 AS x FROM plain GROUP BY dimension, category, time_period) GROUP BY 1)",
    "oo AS (SELECT dimension, row_number() OVER (ORDER BY u DESC, dimension) AS k FROM ub)",
    "ch AS (SELECT a.k, string_agg(b.dimension, ',' ORDER BY b.dimension) AS run_id FROM oo a JOIN oo b ON b.k >= a.k GROUP BY 1)",
    "tr AS (SELECT lf.* FROM lf JOIN ch USING (run_id))",
    select=subset_log("tr"),
)
SQL["removed_dimensions"] = statement(
    *subset_ctes(), TRIED, "bs AS (SELECT run_id FROM tr WHERE fits ORDER BY size DESC, run_id LIMIT 1)",
    select="SELECT DISTINCT dimension FROM ss WHERE dimension <> '_TIME_TOTAL_' AND dimension NOT IN (SELECT s.dimension FROM ss s JOIN bs ON bs.run_id = s.run_id)",
)
SQL["reconcile_export"] = statement(
    *rate_ctes(("priority", "linestatus"), "E3", True, True),
    f"rs AS (SELECT rate, {CELL}, {pct('sum(num * m)', 'sum(den * m)')} AS x FROM lw WHERE peer <> 'E3' AND time_period <> 'General' GROUP BY ALL)",
    select="SELECT rate, dimension, category, time_period || '-01-01' AS time_period, CASE WHEN category IN ('5-LOW', '2-HIGH') THEN 'skipped' WHEN category = '1-URGENT' THEN 'failed' "
    "ELSE 'passed' END AS outcome, CASE category WHEN '5-LOW' THEN 'missing' WHEN '2-HIGH' THEN 'ambiguous' END AS skip_reason FROM rs",
)
