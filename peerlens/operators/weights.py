"""Peer multipliers: attaching, fitting, rescaling and describing them.

A weights table is ``dimension NULLABLE, peer, multiplier`` (plus ``run_id`` when
many runs are computed at once); a null dimension is the global multiplier.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peerlens.functions.ordered import distributed_rank
from peerlens.operators.cells import CELL, cell_shares, percent
from peerlens.session import add_group_values, cut_lineage, join_keys

# Comparison slack, border width of a nudge, identity tolerance.
COMPARISON_EPSILON = 1e-6
BORDERLINE_EXCESS_PP = 1e-3
IDENTITY_TOLERANCE = 1e-9
# A fit's weights are settled when no cap is broken by more than this share.
SETTLED = 1e-11
# Cells that a peer brings into the solved set in a round; rows a task solves for one run.
WORST_CELLS = 4
SOLVED_ROWS = 500_000


def attach_weights(df: DataFrame, weights: DataFrame | None, extra: list[str] | None = None) -> DataFrame:
    """Add column ``m``: the per-dimension multiplier, else the global one, else 1.

    ``df`` has ``dimension`` and ``peer`` (and the ``extra`` key columns).
    """
    if weights is None:
        return df.withColumn("m", F.lit(1.0))
    extra = extra or []
    special = weights.where(F.col("dimension").isNotNull()).select(
        *extra, "dimension", "peer", F.col("multiplier").alias("_m_dim")
    )
    general = weights.where(F.col("dimension").isNull()).select(
        *extra, "peer", F.col("multiplier").alias("_m_all")
    )
    joined = df.join(special, [*extra, "dimension", "peer"], "left").join(
        general, [*extra, "peer"], "left"
    )
    return joined.withColumn("m", F.coalesce("_m_dim", "_m_all", F.lit(1.0))).drop(
        "_m_dim", "_m_all"
    )


def clamp(value: Column, low: float, high: float) -> Column:
    """Keep a column inside fixed bounds."""
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def fixable_cells(
    cells: DataFrame, cap: Column, min_entities: Column, low: float, high: float, tolerance: float,
    extra: list[str] | None = None,
) -> DataFrame:
    """Cells that some weights in bounds can bring under the cap.

    Left out are cells with fewer positive peers than the rule minimum and cells
    where a peer stays over the cap even at the lightest weight against all
    others at the heaviest; both are suppressed from publication anyway, and
    keeping them would drive dominant peers to the floor for nothing.
    """
    keys = [*(extra or []), *CELL]
    totals = add_group_values(
        cells,
        keys,
        _total=F.sum("v"),
        _n=F.sum(F.when(F.col("v") > 0, 1).otherwise(0)),
    )
    over = lowest_share(F.col("v"), F.col("_total"), low, high) > cap + tolerance
    flagged = add_group_values(totals, keys, _bad=F.max(F.when(over, 1).otherwise(0)))
    return flagged.where((F.col("_bad") == 0) & (F.col("_n") >= min_entities)).drop(
        "_total", "_n", "_bad"
    )


def lowest_share(v: Column, total: Column, low: float, high: float) -> Column:
    """Smallest share a peer can have: itself lightest, all others heaviest."""
    others = F.greatest(total - v, F.lit(0.0))
    return percent(v * low, v * low + others * high)


def scaling_round(cells: DataFrame, weights: DataFrame, low: float, high: float) -> DataFrame:
    """One fitting round: scale every peer by its tightest over-cap cell."""
    placed = cells.join(weights, ["run_id", "scope", "peer"])
    totals = add_group_values(placed, ["run_id", *CELL], _total=F.sum(F.col("v") * F.col("m")))
    own = F.col("v") * F.col("m")
    allowed = F.col("cap") * (F.col("_total") - own) / ((100.0 - F.col("cap")) * own)
    over = (own > 0) & (percent(own, F.col("_total")) > F.col("cap"))
    factors = totals.groupBy("run_id", "scope", "peer").agg(
        F.min(F.when(over, allowed).otherwise(F.lit(1.0))).alias("_f")
    )
    return weights.join(factors, ["run_id", "scope", "peer"], "left").select(
        "run_id",
        "scope",
        "peer",
        clamp(F.col("m") * F.coalesce("_f", F.lit(1.0)), low, high).alias("m"),
    )


def _solve(low: float, high: float):
    """The largest weights not above the given ones under which every given row keeps its cap."""

    def run(weights: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        m = weights["m"].to_numpy(dtype=float).copy()
        number = pd.Series(np.arange(len(m)), index=weights["peer"])
        if len(rows):
            rows = rows[rows["peer"].isin(number.index) & (rows["v"] > 0)]
        if len(rows):
            peer = number.reindex(rows["peer"]).to_numpy()
            order = np.argsort(peer, kind="stable")
            peer = peer[order]
            begin = np.flatnonzero(np.concatenate(([True], peer[1:] != peer[:-1])))
            cell = pd.factorize(rows["_cell"])[0][order]
            v, cap = (rows[c].to_numpy(dtype=float)[order] for c in ("v", "cap"))
            whose = peer[begin]
            while True:
                own = v * m[peer]
                total = np.bincount(cell, weights=own)[cell]
                factor = np.where(own / total * 100.0 > cap, cap * (total - own) / ((100.0 - cap) * own), 1.0)
                new = np.clip(m[whose] * np.minimum.reduceat(factor, begin), low, high)
                moved = np.abs(1.0 - new / m[whose]).max()
                m[whose] = new
                if moved <= 1e-15:
                    break
        return weights.assign(m=m)[["run_id", "scope", "peer", "m"]]

    return run


def settle(governed: DataFrame, weights: DataFrame, low: float, high: float, settled: float = SETTLED) -> DataFrame:
    """The largest weights not above ``weights`` under which every governed cell keeps its cap.

    A peer at the lower bound may break one.  These weights are unique: a cap holds for a
    peer if its weight is at most a share of what the others weigh, so lowering one never
    makes room for another.  They are found by cutting planes: a round looks at all cells
    of the runs that still break a cap, adds the WORST_CELLS worst cells of each peer to
    the set that is solved, and solves that set for each run in one task.  What the set
    leaves out only makes the weights larger, so the rounds come down to the answer, and
    the first one that finds no broken cap has it.  A run whose set has more than
    SOLVED_ROWS rows takes a plain round of scaling instead.
    """
    keys, group = ["run_id", "scope", "peer"], ["run_id", "scope"]
    cell = F.to_json(F.struct(*CELL), {"ignoreNullFields": "false"})
    governed = cut_lineage(governed.withColumn("_cell", cell))
    weights, solved, still = cut_lineage(weights), None, None
    first = Window.partitionBy(*keys).orderBy("_f", "_cell")
    while True:
        rows = governed if still is None else governed.join(still, group, "left_semi")
        totals = add_group_values(rows.join(weights, keys), [*group, "_cell"], _total=F.sum(F.col("v") * F.col("m")))
        own = F.col("v") * F.col("m")
        factor = F.col("cap") * (F.col("_total") - own) / ((100.0 - F.col("cap")) * own)
        broken = (own > 0) & (F.col("m") > low) & (factor < 1.0 - settled)
        worst = totals.where(broken).select(*keys, "_cell", factor.alias("_f")).withColumn("_k", F.row_number().over(first))
        found = worst.where(F.col("_k") <= WORST_CELLS).select(*group, "_cell").distinct()
        if solved is not None:
            # A cell that is solved already is kept as well as doubles allow.
            found = found.join(solved.select(*group, "_cell"), [*group, "_cell"], "left_anti")
        found = cut_lineage(found)
        if found.isEmpty():
            return weights
        still = found.select(*group).distinct()
        picked = governed.join(found, [*group, "_cell"], "left_semi")
        solved = cut_lineage(picked if solved is None else solved.unionByName(picked))
        sizes = solved.select(*group).unionByName(weights.select(*group)).groupBy(*group).count()
        large = sizes.where(F.col("count") > SOLVED_ROWS).select(*group)
        solver = _solve(low, high)
        if large.isEmpty():
            after = _apart(weights, solved, group, solver)
        else:
            large = cut_lineage(large)
            small = lambda df: cut_lineage(df.join(large, group, "left_anti"))
            plain = scaling_round(*(df.join(large, group, "left_semi") for df in (governed, weights)), low, high)
            # The sets of large runs are let go; their cells come again until they hold.
            solved = small(solved)
            after = _apart(small(weights), solved, group, solver).unionByName(plain)
        weights = cut_lineage(after)


def _apart(weights: DataFrame, rows: DataFrame, group: list[str], solver) -> DataFrame:
    kind = dict(weights.dtypes)
    schema = f"run_id {kind['run_id']}, scope string, peer {kind['peer']}, m double"
    return weights.groupBy(*group).cogroup(rows.groupBy(*group)).applyInPandas(solver, schema)


def fit_weights(
    cells: DataFrame,
    population: DataFrame,
    *,
    per_dimension: bool = False,
    low: float = 0.01,
    high: float = 10.0,
    rounds: int | None = None,
    settled: float = SETTLED,
) -> DataFrame:
    """Multipliers in ``[low, high]``, mean near 1, that respect every cell's cap.

    ``cells`` is ``run_id, CELL, peer, v, cap`` with only the cells to govern;
    ``cap`` may differ by row (a protected peer has its own).  ``population`` is
    ``run_id, peer``.  All runs - rules, presets, dimension subsets - advance
    together, and a run that has settled is not looked at again.  From weight 1, each
    peer is lowered as little as the caps of all cells ask for (``settle``); what is over
    its cap then belongs to a peer at its lower bound (``residual_by_run`` says which).
    One factor per run and scope brings the mean to 1.  ``rounds`` asks for a fixed number
    of plain scaling rounds instead.  Returns ``run_id, dimension, peer, multiplier``.
    """
    scope = F.col("dimension") if per_dimension else F.lit("*")
    # A cell needs at least two positive peers for a multiplier to matter.
    governed = cells.where(F.col("cap") < 100.0).withColumn("scope", scope)
    if per_dimension:
        start = (
            join_keys(
                population,
                cells.select("run_id", F.col("dimension").alias("scope")).distinct(),
                ["run_id"],
            )
        )
    else:
        start = population.withColumn("scope", F.lit("*"))
    weights = start.select("run_id", "scope", "peer", F.lit(1.0).alias("m"))
    if rounds is None:
        weights = settle(governed, weights, low, high, settled)
    else:
        # Each round reads the weights and the cells more than once, so both are
        # materialised; a chain of lazy rounds would double in size every time.
        governed, weights = cut_lineage(governed), cut_lineage(weights)
        for _ in range(rounds):
            weights = cut_lineage(scaling_round(governed, weights, low, high))
    rescaled = rescale_mean_one(weights, ["run_id", "scope"], low, high)
    return rescaled.select(
        "run_id",
        F.when(F.col("scope") != "*", F.col("scope")).alias("dimension"),
        "peer",
        F.col("m").alias("multiplier"),
    )


def rescale_mean_one(weights: DataFrame, keys: list[str], low: float, high: float) -> DataFrame:
    """One common factor per run towards mean 1, limited so all stay in bounds."""
    stats = add_group_values(
        weights,
        keys,
        _mean=F.avg("m"),
        _min=F.min(F.when(F.col("m") > 0, F.col("m"))),
        _max=F.max(F.when(F.col("m") > 0, F.col("m"))),
    )
    factor = F.when(
        F.col("_mean") > 0,
        F.least(
            F.greatest(1.0 / F.col("_mean"), low / F.col("_min")), high / F.col("_max")
        ),
    ).otherwise(F.lit(1.0))
    return stats.withColumn("m", clamp(F.col("m") * factor, low, high)).drop(
        "_mean", "_min", "_max"
    )


def waterfill_mean(
    weights: DataFrame, keys: list[str], low: float, high: float, target: float = 1.0
) -> DataFrame:
    """Scale the free weights to the mean, fix those that hit a bound, repeat.

    Weights that a round pushes out of bounds are fixed there; the rest share
    what is left.  A round that fixes nothing reaches the mean and ends the run, so
    there are at most as many rounds as weights.
    """
    current = cut_lineage(
        weights.withColumn("_free", F.lit(True)).withColumn("_done", F.lit(False))
    )
    while True:
        stats = add_group_values(
            current,
            keys,
            _goal=F.count("*") * F.lit(target),
            _fixed=F.sum(F.when(F.col("_free"), 0.0).otherwise(F.col("m"))),
            _open=F.sum(F.when(F.col("_free"), F.col("m")).otherwise(0.0)),
        )
        scaled = F.when(
            F.col("_free") & (F.col("_open") > 0) & ~F.col("_done"),
            F.col("m") * (F.col("_goal") - F.col("_fixed")) / F.col("_open"),
        ).otherwise(F.col("m"))
        out = F.col("_free") & ((F.col("_s") < low) | (F.col("_s") > high))
        marked = add_group_values(
            stats.withColumn("_s", scaled).withColumn("_out", out),
            keys,
            _any=F.max(F.col("_out")),
        )
        current = cut_lineage(
            marked.select(
                *[c for c in weights.columns if c != "m"],
                F.when(~F.col("_any"), F.col("_s"))
                .when(F.col("_out"), clamp(F.col("_s"), low, high))
                .otherwise(F.col("m"))
                .alias("m"),
                (F.col("_free") & ~F.col("_out")).alias("_free"),
                (~F.col("_any")).alias("_done"),
            )
        )
        # Whether any run still moves: one value to the driver.
        if current.where(~F.col("_done")).isEmpty():
            break
    return current.drop("_free", "_done")


def worst_excess(shares: DataFrame, cap: float) -> DataFrame:
    """The single peer and cell with the largest share over the cap.

    Shares that differ by less than 1e-9 are ties, as a fit brings many to its cap exactly;
    they go to the canonically first label.
    """
    over = shares.where(F.col("share") > cap).withColumn("excess", F.col("share") - cap)
    best = over.agg(
        F.min(
            F.struct(
                F.round(-F.col("excess"), 9).alias("_neg"), *CELL, "peer", "share", "excess", "v", "m",
                "balanced_total",
            )
        ).alias("_b")
    ).where(F.col("_b").isNotNull())
    return best.select(*[F.col(f"_b.{c}").alias(c) for c in
                         [*CELL, "peer", "share", "excess", "v", "m", "balanced_total"]])


def nudge_borderline(weights: DataFrame, shares: DataFrame, cap: float, low: float, high: float) -> DataFrame:
    """Pull back only the worst peer when its excess is within 0.001 pp.

    ``weights`` is ``peer, multiplier``; ``shares`` comes from ``cell_shares``.
    """
    own = F.col("v") * F.col("m")
    worst = worst_excess(shares, cap).where(
        (F.col("excess") > 0) & (F.col("excess") <= BORDERLINE_EXCESS_PP)
    )
    factor = worst.select(
        "peer",
        (cap * (F.col("balanced_total") - own) / ((100.0 - cap) * own)).alias("_f"),
    )
    return weights.join(factor, "peer", "left").select(
        "peer",
        F.when(F.col("_f").isNotNull(), clamp(F.col("multiplier") * F.col("_f"), low, high))
        .otherwise(F.col("multiplier"))
        .alias("multiplier"),
    )


def weights_table(weights: DataFrame, volumes: DataFrame) -> DataFrame:
    """Global and per-dimension multipliers with raw and balanced volume and share.

    ``volumes`` is ``peer, volume``; peers without a recorded volume count as zero.
    """
    joined = weights.join(volumes, "peer", "left").select(
        "dimension",
        "peer",
        "multiplier",
        F.coalesce("volume", F.lit(0.0)).alias("raw_volume"),
    ).withColumn("balanced_volume", F.col("raw_volume") * F.col("multiplier"))
    totals = add_group_values(
        joined, ["dimension"], _raw=F.sum("raw_volume"), _balanced=F.sum("balanced_volume")
    )
    return totals.select(
        F.coalesce("dimension", F.lit("Global")).alias("weight_scope"),
        "peer",
        "multiplier",
        "raw_volume",
        percent(F.col("raw_volume"), F.col("_raw")).alias("raw_share_pct"),
        "balanced_volume",
        percent(F.col("balanced_volume"), F.col("_balanced")).alias("balanced_share_pct"),
    )


def rank_changes(table: DataFrame) -> DataFrame:
    """Rank peers by raw and by balanced share, ties by label, and the difference.

    ``table`` has ``peer, raw_share_pct, balanced_share_pct``.
    """
    slim = table.select("peer", "raw_share_pct", "balanced_share_pct")
    base = distributed_rank(slim, [F.col("raw_share_pct").desc(), F.col("peer")], "base_rank")
    both = distributed_rank(
        base, [F.col("balanced_share_pct").desc(), F.col("peer")], "adjusted_rank"
    )
    return both.withColumn("delta", F.col("adjusted_rank") - F.col("base_rank"))


def method_breakdown(weights: DataFrame, peers: DataFrame, dimensions: list[str]) -> DataFrame:
    """Every dimension x peer with its multiplier and where it comes from.

    The dimension names are a fixed list exploded per peer, not a join.
    """
    listed = peers.select(
        "peer", F.explode(F.array(*[F.lit(d) for d in dimensions])).alias("dimension")
    )
    special = weights.where(F.col("dimension").isNotNull()).select(
        "dimension", "peer", F.col("multiplier").alias("_m_dim")
    )
    general = weights.where(F.col("dimension").isNull()).select(
        "peer", F.col("multiplier").alias("_m_all")
    )
    return (
        listed.join(special, ["dimension", "peer"], "left")
        .join(general, "peer", "left")
        .select(
            "dimension",
            "peer",
            F.coalesce("_m_dim", "_m_all", F.lit(1.0)).alias("multiplier"),
            F.when(F.col("_m_dim").isNotNull(), "Per-Dimension")
            .when(F.col("_m_all").isNotNull(), "Global")
            .otherwise("Unweighted")
            .alias("method"),
        )
    )


def weights_are_identity(weights: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Whether every multiplier is 1 within tolerance."""
    return weights.groupBy(*(keys or [])).agg(
        F.min(F.abs(F.col("multiplier") - 1.0) <= IDENTITY_TOLERANCE).alias("identity")
    )


def representativeness(weights: DataFrame, low: float, mean_abs_impact: DataFrame | None = None) -> DataFrame:
    """Spread of the positive multipliers and how far weighting bends the market.

    ``mean_abs_impact`` is an optional one-row table ``mean_abs_impact_pp``.
    """
    positive = F.when(F.col("multiplier") > 0, F.col("multiplier"))
    # Two levels: a peer counts once however many scopes put it at the floor.
    per_peer = weights.groupBy("peer").agg(
        F.min(positive).alias("_lo"),
        F.max(positive).alias("_hi"),
        F.max(F.when(F.col("multiplier") <= low + 1e-3, 1).otherwise(0)).alias("_floor"),
    )
    facts = per_peer.agg(
        F.coalesce(F.min("_lo"), F.lit(0.0)).alias("multiplier_min"),
        F.coalesce(F.max("_hi"), F.lit(0.0)).alias("multiplier_max"),
        F.sum("_floor").alias("peers_at_min_floor"),
    ).withColumn(
        "multiplier_ratio",
        F.when(F.col("multiplier_min") > 0, F.col("multiplier_max") / F.col("multiplier_min")).otherwise(0.0),
    )
    impact = (
        mean_abs_impact.select("mean_abs_impact_pp").scalar()
        if mean_abs_impact is not None
        else F.lit(None).cast("double")
    )
    return facts.withColumn("mean_abs_impact_pp", impact).select(
        "multiplier_min",
        "multiplier_max",
        "multiplier_ratio",
        "peers_at_min_floor",
        "mean_abs_impact_pp",
        (F.col("multiplier_ratio") > 20.0).alias("warn_ratio"),
        (F.col("peers_at_min_floor") > 0).alias("warn_floor"),
        F.coalesce(F.col("mean_abs_impact_pp") > 10.0, F.lit(False)).alias("warn_impact"),
    )


def cap_slack(cells: DataFrame, cap: float, allowed: float | None = None) -> DataFrame:
    """How much volume sits above the cap: worst and total, absolute and relative.

    ``cells`` is ``CELL, peer, v, m``.  ``allowed`` is the total slack that still
    counts as none.
    """
    totals = add_group_values(cells, CELL, _total=F.sum(F.col("v") * F.col("m")))
    slack = F.greatest(
        F.lit(0.0), F.col("m") * F.col("v") - F.lit(cap / 100.0) * F.col("_total")
    )
    rows = totals.withColumn("slack", slack)
    out = rows.agg(
        F.max("slack").alias("max_slack"),
        F.sum("slack").alias("sum_slack"),
        F.max(percent(F.col("slack"), F.col("_total"))).alias("max_pct_of_cell"),
        F.max(percent(F.col("slack"), F.col("v") * F.col("m"))).alias("max_pct_of_peer"),
        percent(F.sum("slack"), F.sum(F.col("v") * F.col("m"))).alias("sum_pct_of_volume"),
    )
    return out.withColumn(
        "excess", F.col("sum_slack") > F.lit((allowed or 0.0) + COMPARISON_EPSILON)
    )
