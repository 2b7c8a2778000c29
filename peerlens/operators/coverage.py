"""Verified safe coverage: release exactly the units that pass, and prove it.

A *unit* is one publishable cell with all governed metrics, released as a whole
or not at all.  ``volumes(CELL, metric, peer, v)`` is the long form all steps
work on; ``units(CELL, unit_key, participants, rules, overlay)`` names them.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peerlens.functions.ordered import largest_k
from peerlens.functions.scalar import (
    PIECES,
    digest_line,
    hash_pieces,
    ordered_digest,
    root_digest,
    summed_pieces,
    unit_key,
)
from peerlens.operators.cells import CELL, aggregate_cells, peers_only, percent
from peerlens.operators.rules import (
    PROTECTED_CAP,
    RULES,
    applicable,
    passes,
    sweep_evidence,
    undominated,
    with_verdict,
)
from peerlens.operators.search import BLOCK_VALUES, GRID_SIZE, SAMPLES, lay_out, scores, search
from peerlens.operators.suppression import filter_suppressed
from peerlens.operators.weights import COMPARISON_EPSILON
from peerlens.roles import Roles
from peerlens.session import add_group_values, cut_lineage, join_keys

UNIT_METRIC = [*CELL, "metric"]
# Comparison buffer of the interval tests, weight bound slack.
NUMERIC_BUFFER = 1e-9
BOUND_TOLERANCE = 1e-9


def unit_volumes(df: DataFrame, roles: Roles) -> DataFrame:
    """``volumes``: every governed metric of every peer in every cell.

    Negative or non-finite volumes stop the job.  The sums are exact, so a digest of them
    does not depend on how the facts lie; a prepared table has to be made with ``exact``.
    """
    metrics = [roles.metric, *roles.secondary]
    cells = peers_only(aggregate_cells(df, roles, metrics, with_whole=False, exact=True), roles.target)
    if roles.time:
        cells = cells.where(F.col("time_period").isNotNull())
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in metrics])
    long = cells.select(*CELL, "peer", F.explode(pairs).alias("_x")).select(*CELL, "peer", "_x.*")
    fine = (F.col("v") >= 0) & (F.col("v") < float("inf"))
    return long.withColumn(
        "v",
        F.when(fine, F.col("v")).otherwise(
            F.raise_error(F.lit("unit volumes must be finite and non-negative")).cast("double")
        ),
    )


def candidate_units(
    volumes: DataFrame,
    suppressed: DataFrame | None = None,
    merchant: bool = False,
    overlay_entity: str | None = None,
) -> DataFrame:
    """Units eligible for release, with the rules their thinnest metric allows.

    A unit where some metric has no positive peer drops out.
    """
    per_metric = volumes.groupBy(*UNIT_METRIC).agg(
        F.count_if(F.col("v") > 0).alias("_n"), F.sum("v").alias("_total")
    )
    units = (
        per_metric.groupBy(*CELL)
        .agg(
            F.min("_n").alias("participants"),
            F.count("*").alias("metrics"),
            F.max(F.col("_total") <= 0).alias("_empty"),
        )
        .where((F.col("participants") > 0) & ~F.col("_empty"))
        .drop("_empty")
    )
    if suppressed is not None:
        units = filter_suppressed(units, suppressed)
    return units.select(
        *CELL,
        unit_key(F.col("dimension"), F.col("category"), F.col("time_period")).alias("unit_key"),
        "participants",
        "metrics",
        applicable(F.col("participants"), merchant).alias("rules"),
        F.lit(overlay_entity is not None).alias("overlay"),
    )


def coverage_min_entities(peers: DataFrame, merchant: bool = False) -> DataFrame:
    """Suppression minimum: least minimum over the rules the population may use."""
    counted = peers.agg(F.count("peer").alias("peers"))
    usable = applicable(F.col("peers"), merchant)
    return counted.select(
        "peers",
        F.coalesce(
            F.array_min(F.transform(usable, lambda r: r["min_entities"])), F.lit(5)
        ).alias("min_entities"),
    )


def fractions(volumes: DataFrame, units: DataFrame) -> DataFrame:
    """Positive peers' fraction ``f`` of their unit and metric."""
    placed = join_keys(volumes.where(F.col("v") > 0), units.select(*CELL, "unit_key"), CELL)
    return add_group_values(placed, UNIT_METRIC, _total=F.sum("v")).withColumn(
        "f", F.col("v") / F.col("_total")
    )


def _interval_class(worst: Column, best: Column, always: str, never: str) -> Column:
    return F.when(worst >= 0, always).when(best < 0, never).otherwise("uncertain")


def classify_cap(f: Column, cap: Column | float, low: float, high: float, buffered: bool = True) -> Column:
    """Can a peer with raw fraction ``f`` exceed the cap for weights in bounds?

    ``always`` under it, ``never`` under it, or ``uncertain``.
    """
    limit = cap + (COMPARISON_EPSILON - NUMERIC_BUFFER if buffered else 0.0)
    worst = (limit - 100.0) * f * high + limit * (1.0 - f) * low
    best = (limit - 100.0) * f * low + limit * (1.0 - f) * high
    return _interval_class(worst, best, "always", "never")


def classify_tier_witness(f: Column, threshold: Column | float, low: float, high: float) -> Column:
    """Can a peer with raw fraction ``f`` reach a tier threshold for weights in bounds?"""
    limit = threshold - COMPARISON_EPSILON + NUMERIC_BUFFER
    worst = (100.0 - limit) * f * low - limit * (1.0 - f) * high
    best = (100.0 - limit) * f * high - limit * (1.0 - f) * low
    return _interval_class(worst, best, "always", "impossible")


def classify_protected(f: Column, low: float, high: float) -> Column:
    """``classify_cap`` for the protected entity; without volume it always passes."""
    return F.when(f <= 0, "always").otherwise(
        classify_cap(f, PROTECTED_CAP, low, high, buffered=False)
    )


def prune_unit_rules(volumes: DataFrame, units: DataFrame, low: float, high: float) -> DataFrame:
    """Which rules each unit could still pass for some weights in bounds.

    Per unit and applicable rule: dominated by a looser rule, too few peers, a
    peer that never fits the cap, or a tier that cannot be reached.
    """
    planned = units.select(
        *CELL,
        F.explode("rules").alias("r"),
        F.transform(undominated(F.col("rules")), lambda r: r["rule"]).alias("_kept"),
    )
    rows = join_keys(
        fractions(volumes, units).select(*CELL, "metric", "peer", "f"), planned, CELL
    )
    # As many tiers as any rule of the units has (one number to the driver).
    tiers = range(planned.agg(F.max(F.size("r.tiers"))).first()[0] or 0)
    need = {i: F.get(F.col("r.tiers"), F.lit(i))["need"] for i in tiers}
    tier = {i: F.get(F.col("r.tiers"), F.lit(i))["threshold"] for i in tiers}
    cap_class = classify_cap(F.col("f"), F.col("r.cap"), low, high)
    reach = {i: classify_tier_witness(F.col("f"), tier[i], low, high) for i in tiers}
    per_metric = rows.groupBy(*CELL, "metric", "r", "_kept").agg(
        F.count("*").alias("_n"),
        F.count_if(cap_class == "never").alias("_never"),
        F.count_if(cap_class == "uncertain").alias("_open"),
        *[
            F.count_if(tier[i].isNotNull() & (reach[i] != "impossible")).alias(f"_reach{i}")
            for i in tiers
        ],
    )
    short = F.lit(False)
    for i in tiers:
        short = short | (need[i].isNotNull() & (F.col(f"_reach{i}") < need[i]))
    per_rule = per_metric.groupBy(*CELL, F.col("r.rule").alias("rule")).agg(
        F.max(~F.array_contains("_kept", F.col("r.rule"))).alias("dominated"),
        F.max(F.col("_n") < F.col("r.min_entities")).alias("too_few"),
        F.max(F.col("_never") > 0).alias("cap_never"),
        F.max(short).alias("tier_unreachable"),
        F.sum("_open").alias("uncertain_peers"),
    )
    return per_rule.withColumn(
        "active",
        ~(F.col("dominated") | F.col("too_few") | F.col("cap_never") | F.col("tier_unreachable")),
    )


def unit_outcomes(
    volumes: DataFrame, units: DataFrame, weights: DataFrame, overlay_entity: str | None = None
) -> DataFrame:
    """Per unit: the first passing rule by name and whether the overlay holds.

    ``weights`` is ``peer, w``; a peer that it leaves out has weight 1.
    """
    positive = join_keys(volumes.where(F.col("v") > 0), units.select(*CELL), CELL, "left_semi")
    weighted = positive.join(weights, "peer", "left").withColumn(
        "_x", F.col("v") * F.coalesce("w", F.lit(1.0))
    )
    shares = add_group_values(weighted, UNIT_METRIC, _total=F.sum("_x")).withColumn(
        "share", percent(F.col("_x"), F.col("_total"))
    )
    evidence = sweep_evidence(shares, UNIT_METRIC)
    verdicts = with_verdict(
        join_keys(evidence, units.select(*CELL, F.explode("rules").alias("r")), CELL)
    )
    per_rule = verdicts.groupBy(*CELL, "rule").agg(F.min("strict_passed").alias("_passed"))
    first = per_rule.groupBy(*CELL).agg(
        F.min(F.when(F.col("_passed"), F.col("rule"))).alias("rule")
    )
    if overlay_entity is None:
        return first.withColumn("overlay_passed", F.lit(True))
    held = (
        shares.where(F.col("peer") == overlay_entity)
        .groupBy(*CELL)
        .agg(F.max("share").alias("_protected"))
    )
    return (
        join_keys(first, held, CELL, "left")
        .withColumn(
            "overlay_passed",
            F.coalesce(
                F.col("_protected") <= PROTECTED_CAP + COMPARISON_EPSILON, F.lit(True)
            ),
        )
        .drop("_protected")
    )


def score_candidates(
    volumes: DataFrame, units: DataFrame, candidates: DataFrame, overlay_entity: str | None = None
) -> DataFrame:
    """Units each weight vector would release, and its distance from neutral.

    ``candidates`` is ``cand, peer, w``; a peer that a vector leaves out has weight 1.
    Every candidate shows up, even with nothing released.  The vectors are judged in
    blocks of a bounded size against units that are laid out once (``search``).
    """
    universe = lay_out(volumes, units, overlay_entity)
    distance = cut_lineage(candidates.groupBy("cand").agg(F.sum(F.abs(F.ln("w"))).alias("distance")))
    names = [r["cand"] for r in distance.select("cand").orderBy("cand").collect()]
    number = {p: i for i, p in enumerate(universe.peers)}
    step = max(1, BLOCK_VALUES // max(1, len(number)))
    rows: list[tuple] = []
    for a in range(0, len(names), step):
        some = {c: i for i, c in enumerate(names[a : a + step])}
        block = candidates.where(F.col("cand").between(names[a], names[min(a + step, len(names)) - 1]))
        vectors = np.ones((len(number), len(some)))
        for r in block.where(F.col("w").isNotNull()).collect():
            if r["peer"] in number:
                vectors[number[r["peer"]], some[r["cand"]]] = r["w"]
        rows += [(c, int(n)) for c, n in zip(some, scores(universe, vectors))]
    kind = candidates.schema["cand"].dataType.simpleString()
    score = volumes.sparkSession.createDataFrame(rows, f"cand {kind}, score long")
    return distance.join(score, "cand").select("cand", "score", "distance")


def best_candidate(scores: DataFrame) -> DataFrame:
    """Most units, then nearest to neutral, then first."""
    best = scores.agg(
        F.min(
            F.struct(
                (-F.col("score")).alias("_s"), F.round("distance", 12).alias("_d"), "cand"
            )
        ).alias("_b")
    )
    return best.select(
        F.col("_b.cand").alias("cand"),
        (-F.col("_b._s")).alias("score"),
        F.col("_b._d").alias("distance"),
    )


def quasi_random_weights(peers: DataFrame, count: int, low: float, high: float) -> DataFrame:
    """``count`` log-uniform weight vectors from an additive recurrence.

    Candidate ``i`` puts peer ``p`` at the fractional part of ``1/2 + i * a(p)``,
    with ``a(p)`` taken from a hash of the label; candidate 0 is neutral.  The
    index range is exploded per peer.
    """
    step = F.conv(F.substring(F.md5(F.col("peer").cast("binary")), 1, 6), 16, 10).cast("double") / 16777216.0
    spot = F.lit(0.5) + F.col("cand") * F.col("_a")
    u = spot - F.floor(spot)
    log_low, log_span = math.log(low), math.log(high) - math.log(low)
    return (
        peers.select("peer", step.alias("_a"))
        .withColumn("cand", F.explode(F.sequence(F.lit(0), F.lit(count))))
        .select(
            F.col("cand").cast("int").alias("cand"),
            "peer",
            F.when(F.col("cand") == 0, F.lit(1.0))
            .otherwise(F.exp(F.lit(log_low) + u * log_span))
            .alias("w"),
        )
    )


def coordinate_scores(
    volumes: DataFrame,
    units: DataFrame,
    weights: DataFrame,
    low: float,
    high: float,
    grid_size: int = GRID_SIZE,
    overlay_entity: str | None = None,
) -> DataFrame:
    """Gain in released units of setting one peer's weight to one grid value.

    ``weights`` is ``peer, w``.  Changing peer ``p`` alters a unit only through
    its total and through ``p``'s own value, and no rule looks past the third
    largest share; so the four largest weighted values of a unit are all that is
    needed about the others, and the work is linear in rows times grid size.
    Returns ``peer, w, gain, distance_change``.
    """
    grid = [low * (high / low) ** (i / (grid_size - 1)) for i in range(grid_size)]
    positive = (
        join_keys(volumes, units.select(*CELL), CELL, "left_semi")
        .join(weights, "peer", "left").withColumn("w", F.coalesce("w", F.lit(1.0)))
    )
    rows = positive.withColumn("x", F.col("v") * F.col("w"))
    tops = (
        largest_k(rows.where(F.col("x") > 0), UNIT_METRIC, F.col("x"), "peer", 4)
        .groupBy(*UNIT_METRIC)
        .agg(
            *[
                F.max(F.when(F.col("rank") == i, F.struct("peer", "x"))).alias(f"_t{i}")
                for i in (1, 2, 3, 4)
            ]
        )
    )
    sums = rows.groupBy(*UNIT_METRIC).agg(
        F.sum("x").alias("_total"),
        F.count_if(F.col("v") > 0).alias("participants"),
        *(
            [F.max(F.when(F.col("peer") == overlay_entity, F.col("x"))).alias("_px")]
            if overlay_entity is not None
            else [F.lit(None).cast("double").alias("_px")]
        ),
    )
    context = join_keys(join_keys(rows, sums, UNIT_METRIC), tops, UNIT_METRIC)
    context = join_keys(context, units.select(*CELL, "rules"), CELL)
    # The unchanged vector is grid position -1 and doubles as the base line.
    steps = F.array(
        F.struct(F.lit(-1).alias("g"), F.col("w").alias("nw")),
        *[F.struct(F.lit(i).alias("g"), F.lit(value).alias("nw")) for i, value in enumerate(grid)],
    )
    tried = context.withColumn("_s", F.explode(steps)).select("*", "_s.g", "_s.nw").drop("_s")
    own = F.col("nw") * F.col("v")
    total = F.col("_total") - F.col("x") + own
    others = F.filter(
        F.array("_t1", "_t2", "_t3", "_t4"), lambda t: t.isNotNull() & (t["peer"] != F.col("peer"))
    )
    values = F.array_sort(
        F.concat(F.transform(others, lambda t: -t["x"]), F.when(own > 0, F.array(-own)).otherwise(F.array().cast("array<double>")))
    )
    tried = tried.withColumn("_own", own).withColumn("_all", total).withColumn("_v", values)

    def kth(k: Column) -> Column:
        return F.coalesce(-F.get(F.col("_v"), k - 1) / F.col("_all") * 100.0, F.lit(0.0))

    passed = F.transform(
        "rules",
        lambda r: F.struct(
            r["rule"].alias("rule"),
            (
                (F.col("_all") > 0)
                & (F.col("participants") >= r["min_entities"])
                & (kth(F.lit(1)) <= r["cap"] + COMPARISON_EPSILON)
                & F.forall(
                    r["tiers"], lambda t: kth(t["need"]) + COMPARISON_EPSILON >= t["threshold"]
                )
            ).alias("ok"),
        ),
    )
    protected = (
        F.lit(True)
        if overlay_entity is None
        else F.coalesce(
            F.when(F.col("peer") == overlay_entity, F.col("_own")).otherwise(F.col("_px"))
            / F.col("_all")
            * 100.0
            <= PROTECTED_CAP + COMPARISON_EPSILON,
            F.lit(True),
        )
    )
    judged = tried.select(
        *CELL, "metric", "peer", "g", "nw", "w", protected.alias("_held"), F.explode(passed).alias("_p")
    )
    per_rule = judged.groupBy(*CELL, "peer", "g", "nw", "w", F.col("_p.rule").alias("rule")).agg(
        F.min(F.col("_p.ok") & F.col("_held")).alias("ok")
    )
    per_unit = per_rule.groupBy(*CELL, "peer", "g", "nw", "w").agg(F.max("ok").alias("ok"))
    counted = per_unit.groupBy("peer", "g", "nw", "w").agg(F.count_if("ok").alias("released"))
    base = counted.where(F.col("g") == -1).select("peer", F.col("released").alias("_base"))
    return (
        counted.where(F.col("g") >= 0)
        .join(base, "peer")
        .select(
            "peer",
            F.col("g").alias("grid"),
            F.col("nw").alias("w"),
            (F.col("released") - F.col("_base")).alias("gain"),
            (F.abs(F.ln("nw")) - F.abs(F.ln("w"))).alias("distance_change"),
        )
    )


def refine_weights(
    volumes: DataFrame,
    units: DataFrame,
    start: DataFrame,
    low: float,
    high: float,
    *,
    samples: int = SAMPLES,
    sweeps: int | None = None,
    overlay_entity: str | None = None,
) -> DataFrame:
    """Search for weights that release more units.

    Candidates are the fitted ``start`` (``peer, w``), the neutral vector, log-uniform
    samples, and three rounds of samples around the best so far, each narrower than the
    one before; from the best of them, coordinate moves go on until no grid value of any
    peer improves the result.  ``sweeps`` may end them before.  Returns ``peer, w`` for
    the peers of ``start`` (1 for a peer that no unit holds) with ``released_units``,
    ``search_state`` (``search_complete`` or ``search_incomplete``), ``moves`` and
    ``vectors_judged``; the same on every run.
    """
    universe = lay_out(volumes, units, overlay_entity)
    fitted = np.clip(universe.vector(start), low, high)
    found = search(universe, [fitted], low, high, samples=samples, most_rounds=sweeps)
    known = universe.table(found.vector).withColumnRenamed("w", "_w")
    return start.select("peer").join(known, "peer", "left").select(
        "peer",
        F.coalesce("_w", F.lit(1.0)).alias("w"),
        F.lit(found.released).cast("long").alias("released_units"),
        F.lit("search_complete" if found.complete else "search_incomplete").alias("search_state"),
        F.lit(found.moves).cast("long").alias("moves"),
        F.lit(found.judged).cast("long").alias("vectors_judged"),
    )


def release_partition(
    volumes: DataFrame, units: DataFrame, weights: DataFrame, overlay_entity: str | None = None
) -> DataFrame:
    """Exact outcome: overlay first, then the first passing rule by name authorises."""
    outcomes = unit_outcomes(volumes, units, weights, overlay_entity)
    joined = join_keys(units.select(*CELL, "unit_key"), outcomes, CELL, "left")
    ok = F.coalesce("overlay_passed", F.lit(False)) & F.col("rule").isNotNull()
    return joined.select(
        *CELL, "unit_key", ok.alias("released"), F.when(ok, F.col("rule")).alias("authorizing_rule")
    )


def released_units(units: DataFrame, partition: DataFrame) -> DataFrame:
    """Units restricted to the released keys, in canonical order."""
    kept = units.join(partition.where("released").select("unit_key"), "unit_key", "left_semi")
    return kept.orderBy("unit_key")


def check_partition(universe: DataFrame, released: DataFrame, suppressed: DataFrame) -> DataFrame:
    """Released and suppressed keys must split the universe exactly: code and count.

    One grouped pass over the keys instead of several set operations.
    """
    tagged = (
        universe.select("unit_key", F.lit(1).alias("u"), F.lit(0).alias("r"), F.lit(0).alias("s"))
        .unionByName(released.select("unit_key", F.lit(0).alias("u"), F.lit(1).alias("r"), F.lit(0).alias("s")))
        .unionByName(suppressed.select("unit_key", F.lit(0).alias("u"), F.lit(0).alias("r"), F.lit(1).alias("s")))
        .groupBy("unit_key")
        .agg(F.sum("u").alias("u"), F.sum("r").alias("r"), F.sum("s").alias("s"))
    )
    checks = {
        "duplicate_release_key": F.col("r") > 1,
        "unknown_release_key": (F.col("r") > 0) & (F.col("u") == 0),
        "release_partition_mismatch": ((F.col("r") > 0) & (F.col("s") > 0))
        | ((F.col("u") > 0) != ((F.col("r") > 0) | (F.col("s") > 0))),
    }
    counted = tagged.agg(*[F.count_if(c).alias(n) for n, c in checks.items()])
    return counted.select(
        F.explode(
            F.array(*[F.struct(F.lit(n).alias("code"), F.col(n).alias("n")) for n in checks])
        ).alias("_c")
    ).select("_c.*")


def _volume_texts() -> list[Column]:
    """What a volume row adds to its unit's digest."""
    return [F.col("metric"), F.col("peer"), F.col("v").cast("decimal(38,6)")]


def unit_digests(volumes: DataFrame, units: DataFrame) -> DataFrame:
    """``unit_key, digest`` over a unit's metrics, peers and volumes, in any order of rows."""
    placed = join_keys(volumes, units.select(*CELL, "unit_key"), CELL)
    sums = placed.groupBy("unit_key").agg(F.count("*").alias("_n"), *summed_pieces(_volume_texts()))
    return sums.select("unit_key", F.sha2(digest_line("unit_key", "_n", PIECES), 256).alias("digest"))


def universe_digest(volumes: DataFrame, units: DataFrame) -> DataFrame:
    """One digest over all units with all their metrics, peers and volumes."""
    return root_digest(unit_digests(volumes, units), "unit_key", "digest")


def digest_differences(recorded: DataFrame, fresh: DataFrame) -> DataFrame:
    """Where two tables of ``unit_digests`` differ: ``bucket, unit_key, difference``.

    Buckets of the key are compared first, and units only in those that differ.
    """
    bucket = F.substring(F.sha2(F.col("unit_key"), 256), 1, 2).alias("bucket")
    both = recorded.select(bucket, "unit_key", "digest", F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionByName(
        fresh.select(bucket, "unit_key", "digest", F.lit(0).alias("_a"), F.lit(1).alias("_b"))
    )
    signed = [F.sum(p * (F.col("_a") - F.col("_b"))).alias(n) for p, n in zip(hash_pieces([F.col("unit_key"), F.col("digest")]), PIECES)]
    off = both.groupBy("bucket").agg(*signed).where(" OR ".join(f"{n} <> 0" for n in PIECES)).select("bucket")
    units = both.join(off, "bucket", "left_semi").groupBy("bucket", "unit_key").agg(
        F.max(F.when(F.col("_a") == 1, F.col("digest"))).alias("_x"), F.max(F.when(F.col("_b") == 1, F.col("digest"))).alias("_y")
    )
    return units.where(~F.col("_x").eqNullSafe(F.col("_y"))).select(
        "bucket", "unit_key", F.when(F.col("_y").isNull(), "missing").when(F.col("_x").isNull(), "added").otherwise("changed").alias("difference")
    )


def release_mask_digest(partition: DataFrame) -> DataFrame:
    return ordered_digest(
        partition, ["unit_key"], F.when(F.col("released"), "1").otherwise("0")
    )


def rule_set_text() -> str:
    """The active numeric rules as canonical text."""
    return ";".join(
        f"{r.name}:{r.min_entities}:{r.cap:g}:" + ",".join(f"{n}@{t:g}" for n, t in r.cumulative())
        for r in RULES
    )


def rule_set_digest() -> Column:
    return F.sha2(F.lit(rule_set_text()), 256)


def verify_release(
    volumes: DataFrame,
    units: DataFrame,
    recorded: DataFrame,
    weights: DataFrame,
    low: float,
    high: float,
    overlay_entity: str | None = None,
    recorded_digest: DataFrame | None = None,
) -> DataFrame:
    """Independent recomputation of a recorded release: ``code, n`` of what fails.

    ``recorded`` is ``unit_key, released, authorizing_rule``.  Shares are computed
    anew from the volumes here, not taken from the search.
    """
    bad_weight = F.isnan("w") | (F.abs(F.col("w")) == float("inf")) | F.col("w").isNull()
    bounds = weights.agg(
        F.count_if(bad_weight).alias("weight_nonfinite"),
        F.count_if(
            ~bad_weight & ((F.col("w") < low - BOUND_TOLERANCE) | (F.col("w") > high + BOUND_TOLERANCE))
        ).alias("weight_out_of_bounds"),
    )
    # Evidence, overlay, missing weights and digest of a unit come from one read of its volumes.
    placed = join_keys(volumes, units.select(*CELL, "unit_key", "rules"), CELL).join(weights, "peer", "left")
    used = F.when(F.col("v") > 0, F.col("v") * F.coalesce("w", F.lit(1.0)))
    key = ["unit_key", "metric"]
    rows = cut_lineage(placed.select(*key, "peer", "v", "rules", used.alias("_x"), ((F.col("v") > 0) & F.col("w").isNull()).alias("_lacks")))
    totals = rows.groupBy(*key).agg(F.sum("_x").alias("_t"))
    share = F.when(F.col("_x").isNotNull(), percent(F.col("_x"), F.col("_t")))
    shares = join_keys(rows, totals, key).withColumn("share", share)
    per_metric = sweep_evidence(
        shares, [*key, "rules"], more=[
            F.max(F.when(F.col("peer") == F.lit(overlay_entity), F.col("share"))).alias("_protected"),
            F.count_if("_lacks").alias("_lacking"), F.count("*").alias("_n"), *summed_pieces(_volume_texts()),
        ],
    )
    passing = F.array_compact(F.array(*[F.when(F.col(f"_ok{i}"), F.lit(r.name)) for i, r in enumerate(RULES)]))
    allowed = F.transform("rules", lambda r: r["rule"])
    expected = (
        per_metric.where(F.col("participants") > 0)
        .groupBy("unit_key").agg(
            F.first("rules").alias("rules"), *[F.min(passes(r)).alias(f"_ok{i}") for i, r in enumerate(RULES)], F.max("_protected").alias("_protected"),
        )
        .select(
            "unit_key", allowed.alias("_allowed"), F.array_intersect(passing, allowed).alias("_passing"),
            F.coalesce(F.col("_protected") <= PROTECTED_CAP + COMPARISON_EPSILON, F.lit(True)).alias("_overlay"),
        )
    )
    counted = per_metric.groupBy("unit_key").agg(F.sum("_lacking").alias("_lacking"), F.sum("_n").alias("_n"), *[F.sum(p).alias(p) for p in PIECES])
    listed = recorded.groupBy("unit_key").agg(
        F.count_if("released").alias("_r"), F.count_if(~F.col("released")).alias("_s"),
        F.collect_set(F.struct(F.coalesce("released", F.lit(False)).alias("on"), F.col("authorizing_rule").alias("rule"))).alias("_said"),
    )
    compared = cut_lineage(
        units.groupBy("unit_key").agg(F.count("*").alias("_u"))
        .join(counted, "unit_key", "left").join(expected, "unit_key", "left").join(listed, "unit_key", "full")
    )
    found = long_counts(bounds).unionByName(long_counts(_outcome(compared)))
    if recorded_digest is not None:
        leaves = compared.where("_n IS NOT NULL").select("unit_key", F.sha2(digest_line("unit_key", "_n", PIECES), 256).alias("digest"))
        fresh = root_digest(leaves, "unit_key", "digest").select(
            (
                F.col("digest") != recorded_digest.select("digest").scalar()
            ).cast("bigint").alias("universe_digest_mismatch")
        )
        found = found.unionByName(long_counts(fresh))
    return found


def _outcome(compared: DataFrame) -> DataFrame:
    """Failures by code from one row per unit: what it holds, what it should show and what is recorded."""
    known_unit, names = F.col("_u") > 0, [r.name for r in RULES]
    r, s, said = F.coalesce("_r", F.lit(0)), F.coalesce("_s", F.lit(0)), F.coalesce("_said", F.array().cast("array<struct<on:boolean,rule:string>>"))
    on = F.exists(said, lambda x: x["on"])
    first = F.array_min("_passing")
    should = F.coalesce("_overlay", F.lit(False)) & first.isNotNull()
    shown = lambda test: F.exists(said, lambda x: x["on"] & test(x["rule"]))
    known = lambda rule: F.coalesce(rule.isin(*names), F.lit(False))
    may = lambda rule: F.coalesce(F.array_contains("_allowed", rule), F.lit(False))
    held = lambda rule: F.coalesce(F.array_contains("_passing", rule), F.lit(False))
    here = F.coalesce(known_unit, F.lit(False))
    checks = {
        "duplicate_release_key": r > 1,
        "unknown_release_key": (r > 0) & ~here,
        "release_partition_mismatch": ((r > 0) & (s > 0)) | (here != ((r > 0) | (s > 0))),
        "authorizing_rule_unknown": here & shown(lambda rule: ~known(rule)),
        "authorizing_rule_inapplicable": here & shown(lambda rule: known(rule) & ~may(rule)),
        "authorizing_rule_failed": here & shown(lambda rule: may(rule) & ~held(rule)),
        "overlay_failed": here & on & ~F.coalesce("_overlay", F.lit(True)),
        "hidden_passing_unit": here & ~on & should,
        "weight_partition_mismatch": here & ((on != should) | shown(lambda rule: ~rule.eqNullSafe(first))),
    }
    return compared.agg(
        *[F.count_if(c).alias(n) for n, c in checks.items()],
        F.coalesce(F.sum(F.when(here & on, F.col("_lacking"))), F.lit(0)).alias("weight_missing"),
    )


def long_counts(df: DataFrame) -> DataFrame:
    """One row of counts as rows ``code, n``."""
    return df.select(
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("code"), F.col(c).alias("n")) for c in df.columns])
        ).alias("_c")
    ).select("_c.*")


def coverage_certificate(partition: DataFrame, weights: DataFrame) -> DataFrame:
    """Counts and percentage, visible keys by rule, digests; no suppressed key."""
    counts = partition.agg(
        F.count("*").alias("candidate_units"),
        F.count_if("released").alias("released_units"),
        F.count_if(~F.col("released")).alias("suppressed_units"),
        F.array_join(
            F.array_sort(F.collect_set(F.col("authorizing_rule"))), ";"
        ).alias("authorizing_rules"),
    )
    visible = ordered_digest(
        partition.where("released"), ["unit_key"], F.col("authorizing_rule"), "visible_digest"
    )
    spread = ordered_digest(weights, ["peer"], F.format_string("%.6f", F.col("w")), "weights_digest")
    out = (
        counts.withColumn(
            "coverage_pct",
            percent(F.col("released_units").cast("double"), F.col("candidate_units")),
        )
        .withColumn("visible_digest", visible.scalar())
        .withColumn("weights_digest", spread.scalar())
        .withColumn("rule_set_digest", rule_set_digest())
    )
    return out.withColumn(
        "certificate_digest",
        F.sha2(
            F.concat_ws(
                "|",
                "candidate_units",
                "released_units",
                "suppressed_units",
                "authorizing_rules",
                "visible_digest",
                "weights_digest",
                "rule_set_digest",
            ),
            256,
        ),
    )


def release_decision(
    failures: DataFrame, partition: DataFrame, search_complete: bool | DataFrame
) -> DataFrame:
    """Authorised only when verified, searched to the end and not empty.

    ``search_complete`` is what ``refine_weights`` returned, whose state is read, or the
    caller's statement about weights that come from elsewhere; it has no default, so that
    nobody claims it by leaving it out.
    """
    released = partition.agg(F.count_if("released")).scalar()
    if isinstance(search_complete, DataFrame):
        ended = F.coalesce(F.min(F.col("search_state") == "search_complete"), F.lit(False))
        complete = search_complete.agg(ended).scalar()
    else:
        complete = F.lit(search_complete)
    verdict = (
        failures.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("failures"))
        .withColumn("released_units", released).withColumn("_complete", complete)
    )
    reason = (
        F.when(F.col("failures") > 0, "verifier_failed")
        .when(~F.col("_complete"), "search_incomplete")
        .when(F.col("released_units") == 0, "empty_release")
    )
    return verdict.withColumn("authorized", reason.isNull()).withColumn("withholding_reason", reason).drop("_complete")


def denial_audit(decision: DataFrame, rules: DataFrame, strategy: str) -> DataFrame:
    """Audit row of a withheld run: only allow-listed, value-free fields.

    ``rules`` is ``rule, status`` of the rule evaluations.
    """
    listed = rules.agg(
        F.array_join(
            F.array_sort(F.collect_set(F.when(F.col("status") != "not_applicable", F.col("rule")))), ";"
        )
    ).scalar()
    return decision.select(
        F.lit("non_publishable_privacy_audit").alias("artifact_type"),
        F.lit(False).alias("publishable"),
        F.lit("withheld").alias("run_status"),
        F.coalesce("withholding_reason", F.lit("none")).alias("withholding_reason"),
        F.lit(strategy).alias("strategy"),
        rule_set_digest().alias("rule_set_digest"),
        listed.alias("applicable_rules"),
    )
