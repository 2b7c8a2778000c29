"""The central table: one row per dimension x category x period x peer.

``cells(dimension, category, time_period, peer, <metrics>)`` holds every
dimension in one long table, built in a single pass over the fact data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peerlens.functions.scalar import exact_sum
from peerlens.roles import Roles
from peerlens.session import add_group_values, cut_lineage, join_keys

CELL = ["dimension", "category", "time_period"]
# Reserved label of the row that totals a whole period over all categories.
WHOLE = "_TIME_TOTAL_"
GENERAL = "General"


def filled_sum(column: str | Column) -> Column:
    """Sum where an all-null group counts as zero."""
    return F.coalesce(F.sum(column), F.lit(0.0))


def _unpivoted(
    df: DataFrame, roles: Roles, metrics: list[str], whole: bool, flags: bool, exact: bool = False, hits: dict[str, Column] | None = None
) -> DataFrame:
    """Facts summed by dimension, category, period and entity, null labels kept.

    All dimensions are handled in one scan; rows are combined before the shuffle.  With
    ``exact`` the sums are the same whatever the order of rows.
    """
    add = exact_sum if exact else F.sum
    # Sums of usable rows are for impacts, which read the run's metric or one asked for besides.
    others = {roles.total, *roles.numerators.values(), *roles.secondary} - {roles.metric}
    marked = [m for m in metrics if m not in others] or metrics[:1]
    labels = list(roles.dimensions)
    sums = [f"_m{i}" for i in range(len(metrics))]
    wide = df.select(
        F.col(roles.entity).cast("string").alias("peer"),
        (F.col(roles.time).cast("string") if roles.time else F.lit(None).cast("string")).alias(
            "time_period"
        ),
        *[F.col(d).cast("string").alias(d) for d in labels],
        *([F.lit("all").alias(WHOLE)] if whole else []),
        *[F.col(m).cast("double").alias(s) for m, s in zip(metrics, sums)],
        *[condition.cast("int").alias(name) for name, condition in (hits or {}).items()],
    )
    long = wide.unpivot(
        ["peer", "time_period", *sums, *(hits or {})],
        labels + ([WHOLE] if whole else []),
        "dimension",
        "category",
    )
    return long.groupBy(*CELL, "peer").agg(
        *[add(F.col(s)).alias(m) for m, s in zip(metrics, sums)],
        *([F.max(F.col(s) > 0).alias(positive(m)) for m, s in zip(metrics, sums)] if flags else []),
        *([add(F.when(F.col(s) >= 0, F.col(s))).alias(usable(m)) for m, s in zip(metrics, sums) if m in marked] if flags else []),
        *([F.count("*").alias("_n")] if hits is not None else []),
        *[F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in hits or {}],
    )


def summed_with_flags(
    df: DataFrame, roles: Roles, metrics: list[str], exact: bool = False, hits: dict[str, Column] | None = None
) -> DataFrame:
    """Sums and positivity flags per cell and entity, null labels kept."""
    return _unpivoted(df, roles, metrics, whole=False, flags=True, exact=exact, hits=hits)


def positive(metric: str) -> str:
    """Name of the prepared flag: some fact row of the metric is positive."""
    return f"{metric}__positive"


def usable(metric: str) -> str:
    """Name of the prepared sum over fact rows whose metric is neither null nor negative."""
    return f"{metric}__usable"


def prepare_cells(
    df: DataFrame, roles: Roles, metrics: list[str] | None = None, exact: bool = False, hits: dict[str, Column] | None = None
) -> DataFrame:
    """Scan the facts once for a whole run and write the compact result.

    The operators accept this table in place of the facts (``CELL, peer``, sums, positivity
    flags, and sums of usable rows of the metric; null labels and the target included), so that a run
    with suppression, weights and exports does not read the facts once for each.  A run
    whose figures are digested asks for ``exact`` sums.  ``hits`` are conditions on fact
    rows; with them the table also has the number of rows (``_n``) and of each one's hits.
    """
    named = [roles.metric, roles.total, *roles.numerators.values(), *roles.secondary]
    wanted = metrics or list(dict.fromkeys(m for m in named if m))
    return cut_lineage(summed_with_flags(df, roles, wanted, exact, hits))


def is_prepared(df: DataFrame) -> bool:
    """Whether ``df`` comes from ``prepare_cells``: it alone writes the marked sums.

    Facts that happen to have columns named like a cell's are still facts.
    """
    return {*CELL, "peer"} <= set(df.columns) and any(usable(c) in df.columns for c in df.columns)


def of_first_dimension(prepared: DataFrame, roles: Roles) -> DataFrame:
    """Every fact exactly once: the prepared rows of one dimension."""
    return prepared.where(F.col("dimension") == roles.dimensions[0])


def aggregate_cells(df: DataFrame, roles: Roles, metrics: list[str], *, with_whole: bool = True, exact: bool = False) -> DataFrame:
    """Sum ``metrics`` by dimension, category, period and entity.

    Null entities and categories are left out, null periods are kept (they still
    count in figures over all periods).  With ``with_whole`` a pseudo-dimension
    carries each entity's own total per period.  The target is kept; callers
    split it off.  ``df`` is the facts or a table from ``prepare_cells``.
    """
    values = [F.coalesce(m, F.lit(0.0)).alias(m) for m in metrics]
    if not is_prepared(df):
        cells = _unpivoted(
            df.where(F.col(roles.entity).isNotNull()), roles, metrics, with_whole, flags=False, exact=exact
        ).where(F.col("category").isNotNull())
        return cells.select(*CELL, "peer", *values)
    known = df.where(F.col("peer").isNotNull())
    cells = known.where(
        F.col("category").isNotNull() & F.col("dimension").isin(*roles.dimensions)
    ).select(*CELL, "peer", *values)
    if with_whole:
        whole = (
            of_first_dimension(known, roles)
            .groupBy("time_period", "peer")
            .agg(*[filled_sum(m).alias(m) for m in metrics])
        )
        cells = cells.unionByName(
            whole.select(F.lit(WHOLE).alias("dimension"), F.lit("all").alias("category"), "*")
        )
    return cells if roles.time else over_all_periods(cells, metrics, exact=exact)


def ready_cells(df: DataFrame, roles: Roles, metrics: list[str]) -> DataFrame:
    """Cells that may be read several times: prepared already, or written now."""
    cells = aggregate_cells(df, roles, metrics, with_whole=False)
    return cells if is_prepared(df) else cut_lineage(cells)


def over_all_periods(cells: DataFrame, metrics: list[str], label: str | None = None, exact: bool = False) -> DataFrame:
    """Fold the period away; partial sums are re-aggregated, not the facts."""
    add = exact_sum if exact else F.sum
    return (
        cells.groupBy("dimension", "category", "peer")
        .agg(*[add(F.col(m)).alias(m) for m in metrics])
        .select(
            "dimension",
            "category",
            F.lit(label).cast("string").alias("time_period"),
            "peer",
            *metrics,
        )
    )


def peers_only(cells: DataFrame, target: str | None) -> DataFrame:
    """Drop the target entity's rows."""
    return cells if target is None else cells.where(F.col("peer") != F.lit(target))


def build_cells(df: DataFrame, roles: Roles) -> DataFrame:
    """Untimed cells: ``category_volume``, the peer's own total, and its share of it."""
    flat = Roles(roles.entity, roles.dimensions, target=roles.target)
    cells = peers_only(
        aggregate_cells(df, flat, [roles.metric], with_whole=False), roles.target
    ).withColumnRenamed(roles.metric, "category_volume")
    totals = add_group_values(cells, ["dimension", "peer"], volume=F.sum("category_volume"))
    return totals.withColumn("share_pct", percent(F.col("category_volume"), F.col("volume")))


def build_cells_timed(df: DataFrame, roles: Roles) -> DataFrame:
    """Cells per period: ``volume`` is the cell total over peers, share is in the cell."""
    cells = (
        peers_only(aggregate_cells(df, roles, [roles.metric], with_whole=False), roles.target)
        .where(F.col("time_period").isNotNull())
        .withColumnRenamed(roles.metric, "category_volume")
    )
    totals = add_group_values(cells, CELL, volume=F.sum("category_volume"))
    return totals.withColumn("share_pct", percent(F.col("category_volume"), F.col("volume")))


def build_time_totals(df: DataFrame, roles: Roles) -> DataFrame:
    """Whole-period cells: each peer's share of the period over all categories."""
    if is_prepared(df):
        sums = (
            of_first_dimension(df, roles)
            .where(F.col("peer").isNotNull() & F.col("time_period").isNotNull())
            .groupBy("time_period", "peer")
            .agg(filled_sum(roles.metric).alias("category_volume"))
        )
    else:
        sums = (
            df.where(F.col(roles.entity).isNotNull() & F.col(roles.time).isNotNull())
            .groupBy(
                F.col(roles.time).cast("string").alias("time_period"),
                F.col(roles.entity).cast("string").alias("peer"),
            )
            .agg(filled_sum(F.col(roles.metric).cast("double")).alias("category_volume"))
        )
    cells = peers_only(sums, roles.target).select(
        F.lit(WHOLE).alias("dimension"),
        F.col("time_period").alias("category"),
        "time_period",
        "peer",
        "category_volume",
    )
    totals = add_group_values(cells, CELL, volume=F.sum("category_volume"))
    return totals.withColumn("share_pct", percent(F.col("category_volume"), F.col("volume")))


def peer_volumes(df: DataFrame, roles: Roles) -> DataFrame:
    """Each peer's metric over everything."""
    if is_prepared(df):
        rows, value = of_first_dimension(df, roles), F.col(roles.metric)
    else:
        rows = df.withColumn("peer", F.col(roles.entity).cast("string"))
        value = F.col(roles.metric).cast("double")
    sums = (
        rows.where(F.col("peer").isNotNull()).groupBy("peer").agg(filled_sum(value).alias("volume"))
    )
    return peers_only(sums, roles.target)


def governed_cells(df: DataFrame, roles: Roles, metric: str | None = None) -> DataFrame:
    """The peer cells the privacy rules govern: ``CELL, peer, v``.

    Timed runs carry one cell per period plus the whole-period cells.
    """
    metric = metric or roles.metric
    cells = peers_only(
        aggregate_cells(df, roles, [metric], with_whole=roles.time is not None), roles.target
    )
    if roles.time:
        cells = cells.where(F.col("time_period").isNotNull()).withColumn(
            "category",
            F.when(F.col("dimension") == WHOLE, F.col("time_period")).otherwise(F.col("category")),
        )
    return cells.select(*CELL, "peer", F.col(metric).alias("v"))


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole, zero where the whole is not positive."""
    return F.when(whole > 0, part / whole * 100.0).otherwise(F.lit(0.0))


def cell_shares(cells: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """Raw and weighted share of each peer in its cell.

    Input ``CELL, peer, v, m`` (plus ``extra`` key columns such as ``run_id``).
    """
    keys = [*(extra or []), *CELL]
    totals = add_group_values(
        cells,
        keys,
        raw_total=F.sum("v"),
        balanced_total=F.sum(F.col("v") * F.col("m")),
    )
    return totals.withColumn("raw_share", percent(F.col("v"), F.col("raw_total"))).withColumn(
        "share", percent(F.col("v") * F.col("m"), F.col("balanced_total"))
    )


def constraint_stats(cells: DataFrame, volumes: DataFrame) -> DataFrame:
    """Per cell: participants, effective peers and representativeness.

    ``cells`` is ``CELL, peer, v``; ``volumes`` is ``peer, volume`` for the whole
    peer population.
    """
    per_cell = cells.groupBy(*CELL).agg(
        F.sum(F.when(F.col("v") > 0, 1).otherwise(0)).cast("bigint").alias("participants"),
        F.sum("v").alias("category_total"),
        F.sum(F.col("v") * F.col("v")).alias("_squares"),
    )
    per_block = per_cell.groupBy("dimension", "time_period").agg(
        F.sum("category_total").alias("dimension_total")
    )
    population = volumes.agg(
        F.struct(
            F.greatest(F.count("*"), F.lit(1)).alias("peers"), F.sum("volume").alias("overall")
        ).alias("population")
    )
    joined = (
        join_keys(per_cell, per_block, ["dimension", "time_period"])
        .withColumn("_population", population.scalar())
        .withColumn("_peers", F.col("_population.peers"))
        .withColumn("_overall", F.col("_population.overall"))
    )
    total = F.col("category_total")
    coverage = F.greatest(F.col("volume_share"), F.col("overall_share"))
    return (
        joined.withColumn(
            "effective_peers",
            F.when((total > 0) & (F.col("_squares") > 0), total * total / F.col("_squares")).otherwise(
                F.lit(0.0)
            ),
        )
        .withColumn("volume_share", percent(total, F.col("dimension_total")) / 100.0)
        .withColumn("overall_share", percent(total, F.col("_overall")) / 100.0)
        .withColumn(
            "representativeness",
            F.when(
                (F.col("participants") > 0) & (coverage > 0),
                F.least(
                    F.lit(1.0), F.sqrt(F.col("participants") / F.col("_peers") * coverage)
                ),
            ).otherwise(F.lit(0.0)),
        )
        .select(
            *CELL,
            "participants",
            "effective_peers",
            "category_total",
            "dimension_total",
            "volume_share",
            "overall_share",
            "representativeness",
        )
    )


def dimension_unbalance(cells: DataFrame) -> DataFrame:
    """Largest peer fraction in any cell, in percent, per dimension."""
    per_cell = cells.groupBy(*CELL).agg(F.max("v").alias("_top"), F.sum("v").alias("_total"))
    return per_cell.groupBy("dimension").agg(
        F.max(percent(F.col("_top"), F.col("_total"))).alias("unbalance_pct")
    )


def run_facts(df: DataFrame, roles: Roles) -> DataFrame:
    """Record count, distinct entities, peers and number of dimensions."""
    entity = F.col(roles.entity).cast("string")
    per_entity = df.groupBy(entity.alias("peer")).agg(F.count("*").alias("_rows"))
    hit = (
        F.sum(F.when(F.col("peer") == F.lit(roles.target), 1).otherwise(0))
        if roles.target is not None
        else F.lit(0)
    )
    return per_entity.agg(
        F.sum("_rows").alias("records"),
        F.count("peer").alias("unique_entities"),
        (F.count("peer") - hit).cast("bigint").alias("peers"),
        F.lit(len(roles.dimensions)).cast("bigint").alias("dimensions"),
    )
