"""Building blocks of the DuckDB statements."""

from __future__ import annotations

ENTITY = (
    "CASE WHEN n_nationkey <= 9 THEN 'E0' WHEN n_nationkey <= 14 THEN 'E1' "
    "WHEN n_nationkey <= 17 THEN 'E2' ELSE 'E' || CAST(n_nationkey - 15 AS VARCHAR) END"
)

COLUMNS = {
    "entity": ENTITY,
    "nation": "n_name",
    "region": "r_name",
    "returnflag": "l_returnflag",
    "linestatus": "l_linestatus",
    "priority": "o_orderpriority",
    "segment": "c_mktsegment",
    "part_type": "p_type",
    "brand": "p_brand",
    "part_size": "p_size",
    "period": "CAST(year(o_orderdate) AS VARCHAR)",
    "month": "strftime(o_orderdate, '%Y-%m')",
    "order_day": "CAST(o_orderdate AS DATE)",
    "amount": "l_extendedprice",
    "qty": "l_quantity",
    "discount": "l_discount",
    "txn": "CAST(1 AS DOUBLE)",
    "approved": "CASE WHEN l_returnflag = 'R' THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END",
    "fraud": "CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END",
}

FACT = (
    "fact AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in COLUMNS.items()) + " FROM lineitem "
    "JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey "
    "JOIN region ON n_regionkey = r_regionkey JOIN orders ON l_orderkey = o_orderkey "
    "JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey)"
)

DIMENSIONS = ("returnflag", "priority")
CELL = "dimension, category, time_period"


def pct(part: str, whole: str) -> str:
    return f"CASE WHEN {whole} > 0 THEN {part} / {whole} * 100.0 ELSE 0.0 END"


def cells(
    dims=DIMENSIONS,
    sums=(("amount", "v"),),
    timed=False,
    target="E3",
    name="cells",
    source="fact",
    entity="entity",
    period="period",
    where="TRUE",
) -> str:
    """CTE ``cells``: one row per dimension, category, period and peer."""
    values = ", ".join(f"sum({m}) AS {a}" for m, a in sums)
    keep = where if target is None else f"{where} AND {entity} <> '{target}'"
    time = period if timed else "CAST(NULL AS VARCHAR)"
    group = f"{{d}}, {period}, {entity}" if timed else f"{{d}}, {entity}"
    return (
        f"{name} AS ("
        + " UNION ALL ".join(
            f"SELECT '{d}' AS dimension, CAST({d} AS VARCHAR) AS category, {time} AS time_period, "
            f"{entity} AS peer, {values} FROM {source} WHERE {keep} GROUP BY {group.format(d=d)}"
            for d in dims
        )
        + ")"
    )


def whole(sums=(("amount", "v"),), target="E3", name="whole") -> str:
    """CTE of whole-period cells."""
    values = ", ".join(f"sum({m}) AS {a}" for m, a in sums)
    keep = "TRUE" if target is None else f"entity <> '{target}'"
    return (
        f"{name} AS (SELECT '_TIME_TOTAL_' AS dimension, period AS category, period AS time_period, "
        f"entity AS peer, {values} FROM fact WHERE {keep} GROUP BY period, entity)"
    )


def with_general(sums=("v",), source="timed", name="cells") -> str:
    values = ", ".join(f"sum({s}) AS {s}" for s in sums)
    return (
        f"{name} AS (SELECT * FROM {source} UNION ALL SELECT dimension, category, 'General', peer, "
        f"{values} FROM {source} GROUP BY dimension, category, peer)"
    )


def statement(*ctes: str, select: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n" + select


RULE_ROWS = (
    "rules AS (SELECT * FROM (VALUES "
    "(1, '5/25', 5, 25.0, 0, 0.0, 0, 0.0), "
    "(2, '6/30', 6, 30.0, 3, 7.0, 0, 0.0), "
    "(3, '7/35', 7, 35.0, 2, 15.0, 3, 8.0), "
    "(4, '10/40', 10, 40.0, 2, 20.0, 3, 10.0), "
    "(5, '4/35', 4, 35.0, 0, 0.0, 0, 0.0)) "
    "r(pos, rule, min_entities, cap, need1, t1, need2, t2))"
)


def fit(
    source: str,
    low: float = 0.01,
    high: float = 10.0,
    per_dimension: bool = False,
    population: str = "population",
    prefix: str = "w",
) -> list[str]:
    """CTEs that scale the weights down until no cap moves them, then ``<prefix>`` rescaled.

    ``source`` is run_id, dimension, category, time_period, peer, v, cap.
    """
    scope = "dimension" if per_dimension else "'*'"
    it = f"{prefix}_it"
    if per_dimension:
        start = (
            f"SELECT p.run_id, d.scope, p.peer FROM {population} p "
            f"JOIN (SELECT DISTINCT run_id, scope FROM {prefix}_cells) d ON p.run_id = d.run_id"
        )
    else:
        start = f"SELECT run_id, '*' AS scope, peer FROM {population}"
    new = f"least(greatest(w.m * coalesce(f, 1.0), {low}), {high})"
    part = "OVER (PARTITION BY run_id, scope)"
    return [
        f"{prefix}_cells AS MATERIALIZED (SELECT *, {scope} AS scope FROM {source})",
        f"{it} AS (SELECT 0 AS step, run_id, scope, peer, 1.0::DOUBLE AS m, 1.0::DOUBLE AS moved FROM ({start}) UNION ALL "
        f"SELECT w.step + 1, w.run_id, w.scope, w.peer, {new}, max(abs(1.0 - {new} / w.m)) OVER () FROM {it} w LEFT JOIN "
        f"(SELECT run_id, scope, peer, min(CASE WHEN v * m > 0 AND ({pct('(v * m)', 'tot')}) > cap THEN cap * (tot - v * m) / ((100.0 - cap) * (v * m)) "
        f"ELSE 1.0 END) AS f FROM (SELECT c.*, x.m, sum(v * x.m) OVER (PARTITION BY c.run_id, c.scope, dimension, category, time_period) AS tot "
        f"FROM {prefix}_cells c JOIN {it} x ON c.run_id = x.run_id AND c.scope = x.scope AND c.peer = x.peer) GROUP BY run_id, scope, peer) f "
        f"ON w.run_id = f.run_id AND w.scope = f.scope AND w.peer = f.peer WHERE w.moved > 1e-14)",
        f"{prefix} AS (SELECT run_id, CASE WHEN scope <> '*' THEN scope END AS dimension, peer, "
        f"least(greatest(m * least(greatest(1.0 / avg(m) {part}, {low} / min(m) {part}), "
        f"{high} / max(m) {part}), {low}), {high}) AS multiplier FROM {it} WHERE step = (SELECT max(step) FROM {it}))",
    ]


def fixable(source: str, name: str, low=0.01, high=10.0, tolerance=1.0, by="run_id, ") -> list[str]:
    """CTE keeping only cells that some weights in bounds can satisfy (cap, need in columns)."""
    part = f"OVER (PARTITION BY {by}dimension, category, time_period)"
    return [
        f"{name}_t AS (SELECT *, sum(v) {part} AS tt, sum(CASE WHEN v > 0 THEN 1 ELSE 0 END) {part} "
        f"AS nn FROM {source})",
        f"{name}_b AS (SELECT *, max(CASE WHEN "
        f"({pct(f'(v * {low})', f'(v * {low} + greatest(tt - v, 0.0) * {high})')}) > cap + {tolerance} "
        f"THEN 1 ELSE 0 END) {part} AS bad FROM {name}_t)",
        f"{name} AS (SELECT * EXCLUDE (tt, nn, bad) FROM {name}_b WHERE bad = 0 AND nn >= min_entities)",
    ]
