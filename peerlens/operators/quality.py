"""Input and result checks.

An issue is one row ``severity, check, subject, n_rows, pct, details``.  A whole validation
reads the facts once: what the row checks count is added up with the metrics by dimension,
category and entity (``checked_table``), and every check of rows, entities and categories
is answered from that compact table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peerlens.functions.ordered import largest_k, plain_percentile
from peerlens.operators.cells import percent
from peerlens.operators.rules import concentration
from peerlens.operators.schema import check_required_columns
from peerlens.roles import Roles
from peerlens.session import cut_lineage, join_keys

# Thresholds of the input checks.
MAX_NULL_PCT = 5.0
MIN_DENOMINATOR = 100
MIN_ROWS_PER_CATEGORY = 3
MIN_PEERS = 5
MIN_PEERS_MERCHANT = 4
MAX_ENTITY_SHARE = 50.0
MAX_RATE_DEVIATION = 50.0
MAX_PEER_RATE_RATIO = 10.0
BREAKDOWN_TOP = 5
RATE_EPSILON = 1e-9

ISSUE = ["severity", "check", "subject", "n_rows", "pct"]


def _issues(df: DataFrame, checks: list[tuple[str, str, Column, Column]]) -> DataFrame:
    """Count every check in one pass; keep those that hit.

    A check is (name, subject, condition, severity as a column of ``n``/``pct``).
    """
    counted = df.agg(
        F.count("*").alias("_all"),
        *[F.count_if(condition).alias(f"_c{i}") for i, (_, _, condition, _) in enumerate(checks)],
    )
    return _hits(counted, checks)


def _hits(counted: DataFrame, checks: list[tuple[str, str, Column, Column]]) -> DataFrame:
    """Issues from one row of counts: all rows and those that each check hits."""
    rows = F.array(
        *[
            F.struct(
                F.lit(i).alias("i"),
                F.lit(name).alias("check"),
                F.lit(subject).alias("subject"),
                F.col(f"_c{i}").alias("n_rows"),
                percent(F.col(f"_c{i}").cast("double"), F.col("_all")).alias("pct"),
            )
            for i, (name, subject, _, _) in enumerate(checks)
        ]
    )
    severity = F.coalesce(*[F.when(F.col("i") == i, s) for i, (_, _, _, s) in enumerate(checks)])
    return (
        counted.select(F.explode(rows).alias("_r"))
        .select("_r.*")
        .where(F.col("n_rows") > 0)
        .select(severity.alias("severity"), "check", "subject", "n_rows", "pct")
    )


def checked_table(df: DataFrame, roles: Roles, checks: list[tuple[str, str, Column, Column]], sums: list[str]) -> DataFrame:
    """Rows, hits of each check and sums by ``dimension, category, peer``, from one scan, written once.

    Null labels are kept.  Every fact row is in it once for each dimension (or once, as
    ``all``, where there is none).
    """
    labels = list(roles.dimensions)
    hits, values = [f"_c{i}" for i in range(len(checks))], [f"_s{i}" for i in range(len(sums))]
    wide = df.select(
        F.col(roles.entity).cast("string").alias("_peer"),
        *[F.col(d).cast("string").alias(d) for d in labels],
        *([] if labels else [F.lit("all").alias("all")]),
        *[condition.cast("int").alias(n) for n, (_, _, condition, _) in zip(hits, checks)],
        *[F.col(c).cast("double").alias(n) for n, c in zip(values, sums)],
    )
    long = wide.unpivot(["_peer", *hits, *values], labels or ["all"], "dimension", "category")
    return cut_lineage(
        long.groupBy("dimension", "category", F.col("_peer").alias("peer")).agg(
            F.count("*").alias("_n"), *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in hits],
            *[F.sum(n).alias(c) for n, c in zip(values, sums)],
        )
    )


def _once(table: DataFrame, roles: Roles) -> DataFrame:
    """Every fact row of a checked table once."""
    return table.where(F.col("dimension") == (roles.dimensions[0] if roles.dimensions else "all"))


def _row_issues(table: DataFrame, roles: Roles, checks: list[tuple[str, str, Column, Column]]) -> DataFrame:
    counted = _once(table, roles).agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("_all"), *[F.coalesce(F.sum(f"_c{i}"), F.lit(0)).alias(f"_c{i}") for i in range(len(checks))]
    )
    return _hits(counted, checks)


def _sums_of(table: DataFrame, roles: Roles, columns: list[str]) -> DataFrame:
    return (
        _once(table, roles).where(F.col("peer").isNotNull()).groupBy("peer")
        .agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in columns])
    )


def null_severity() -> Column:
    return F.when(F.col("pct") > MAX_NULL_PCT, "ERROR").otherwise("WARNING")


def check_nulls(df: DataFrame, columns: list[str]) -> DataFrame:
    """Null share per column: over 5 percent is an error, any other a warning."""
    return _issues(df, [("null_values", c, F.col(c).isNull(), null_severity()) for c in columns])


def check_negative(df: DataFrame, columns: list[str]) -> DataFrame:
    return _issues(
        df, [("negative_values", c, F.col(c) < 0, F.lit("ERROR")) for c in columns]
    )


def check_num_gt_den(df: DataFrame, roles: Roles) -> DataFrame:
    """Rows whose numerator exceeds the total."""
    return _issues(
        df,
        [
            ("invalid_rate", name, F.col(c) > F.col(roles.total) + RATE_EPSILON, F.lit("ERROR"))
            for name, c in roles.numerators.items()
        ],
    )


def low_denominator(roles: Roles, minimum: float = MIN_DENOMINATOR) -> Column:
    return (F.col(roles.total) > 0) & (F.col(roles.total) < minimum)


def check_low_denominator(df: DataFrame, roles: Roles, minimum: float = MIN_DENOMINATOR) -> DataFrame:
    """Rows whose positive total is small; ``details`` names the categories where most of them are."""
    low = low_denominator(roles, minimum)
    issue = _issues(df, [("low_denominator", roles.total, low, F.lit("WARNING"))])
    where = breakdown_text(issue_breakdown(df, low, list(roles.dimensions))) if roles.dimensions else None
    return _as_issues(issue, where.scalar() if where is not None else None)


def check_rate_range(df: DataFrame, roles: Roles) -> DataFrame:
    """Rates above 100 are errors; below 0 or above 150 they are outliers."""
    checks = []
    for name, c in roles.numerators.items():
        rate = F.when(F.col(roles.total) > 0, 100.0 * F.col(c) / F.col(roles.total))
        checks.append(("invalid_rates", name, rate > 100.0 + RATE_EPSILON, F.lit("ERROR")))
        outlier = (rate < -RATE_EPSILON) | (rate > 100.0 + MAX_RATE_DEVIATION + RATE_EPSILON)
        checks.append(("outlier_rates", name, outlier, F.lit("WARNING")))
    return _issues(df, checks)


def check_finite_nonneg(df: DataFrame, columns: list[str]) -> DataFrame:
    """A governing metric must be numeric, finite and not negative."""
    checks = []
    for c in columns:
        number = F.expr(f"try_cast(`{c}` AS DOUBLE)")
        checks += [
            ("not_numeric", c, F.col(c).isNotNull() & number.isNull(), F.lit("ERROR")),
            ("not_finite", c, F.isnan(number) | (F.abs(number) == float("inf")), F.lit("ERROR")),
            ("negative_values", c, ~F.isnan(number) & (number < 0), F.lit("ERROR")),
        ]
    return _issues(df, checks)


def preprocess(df: DataFrame, fill: float = 0, drop_all_zero: bool = True) -> DataFrame:
    """Fill null numbers, then drop rows whose numbers are all zero."""
    numbers = [c for c, t in df.dtypes if t in ("int", "bigint", "double", "float", "smallint", "tinyint") or t.startswith("decimal")]
    filled = df.fillna(fill, numbers)
    if not (drop_all_zero and numbers):
        return filled
    some = F.lit(False)
    for c in numbers:
        some = some | (F.col(c) != 0)
    return filled.where(some)


def entity_sums(df: DataFrame, roles: Roles, columns: list[str]) -> DataFrame:
    """Sums per entity, null entities left out."""
    return (
        df.where(F.col(roles.entity).isNotNull())
        .groupBy(F.col(roles.entity).cast("string").alias("peer"))
        .agg(*[F.coalesce(F.sum(F.col(c).cast("double")), F.lit(0.0)).alias(c) for c in columns])
    )


def check_entity_concentration(df: DataFrame, roles: Roles, limit: float = MAX_ENTITY_SHARE) -> DataFrame:
    """Entities holding more than half of the metric."""
    return _concentrated(entity_sums(df, roles, [roles.metric]), roles, limit)


def _concentrated(sums: DataFrame, roles: Roles, limit: float = MAX_ENTITY_SHARE) -> DataFrame:
    return (
        concentration(sums.withColumnRenamed(roles.metric, "v"), [])
        .where((F.col("total") > 0) & (F.col("share") > limit))
        .select(
            F.lit("WARNING").alias("severity"),
            F.lit("high_concentration").alias("check"),
            F.col("peer").alias("subject"),
            F.lit(1).cast("bigint").alias("n_rows"),
            F.col("share").alias("pct"),
        )
    )


def check_peer_count(df: DataFrame, roles: Roles, minimum: int = MIN_PEERS) -> DataFrame:
    """Too few peers once the target, if found, is taken off."""
    per_entity = df.where(F.col(roles.entity).isNotNull()).select(F.col(roles.entity).cast("string").alias("peer")).distinct()
    return _few_peers(per_entity, roles, minimum)


def _few_peers(per_entity: DataFrame, roles: Roles, minimum: int = MIN_PEERS) -> DataFrame:
    found = (
        F.count_if(F.upper("peer") == F.upper(F.lit(roles.target)))
        if roles.target is not None
        else F.lit(0)
    )
    return (
        per_entity.agg(
            (F.count("*") - F.least(found, F.lit(1))).cast("bigint").alias("n_rows")
        )
        .where(F.col("n_rows") < minimum)
        .select(
            F.lit("ERROR").alias("severity"),
            F.lit("insufficient_peers").alias("check"),
            F.lit(roles.entity).alias("subject"),
            "n_rows",
            F.lit(0.0).alias("pct"),
        )
    )


def category_counts(df: DataFrame, dimensions: list[str], missing: str | None = None) -> DataFrame:
    """Rows per category of every dimension, in one pass."""
    labels = [
        (F.coalesce(F.col(d).cast("string"), F.lit(missing)) if missing else F.col(d).cast("string")).alias(d)
        for d in dimensions
    ]
    return (
        df.select(*labels)
        .unpivot([], dimensions, "dimension", "category")
        .where(F.col("category").isNotNull())
        .groupBy("dimension", "category")
        .agg(F.count("*").alias("n_rows"))
    )


def check_small_categories(df: DataFrame, roles: Roles, minimum: int = MIN_ROWS_PER_CATEGORY) -> DataFrame:
    """Dimensions with categories of fewer than three rows; the first five named."""
    return _small(category_counts(df, list(roles.dimensions)), minimum)


def _small(counts: DataFrame, minimum: int = MIN_ROWS_PER_CATEGORY) -> DataFrame:
    small = counts.where(F.col("n_rows") < minimum)
    order = Window.partitionBy("dimension").orderBy("category")
    totals = small.groupBy("dimension").agg(F.count("*").alias("_n"))
    named = (
        small.withColumn("_i", F.row_number().over(order))
        .where(F.col("_i") <= 5)
        .groupBy("dimension")
        .agg(F.array_join(F.array_sort(F.collect_list("category")), ",").alias("examples"))
    )
    return totals.join(named, "dimension").select(
        F.lit("WARNING").alias("severity"),
        F.lit("small_categories").alias("check"),
        F.col("dimension").alias("subject"),
        F.col("_n").alias("n_rows"),
        F.lit(0.0).alias("pct"),
        "examples",
    )


def issue_breakdown(df: DataFrame, condition: Column, dimensions: list[str], top: int = BREAKDOWN_TOP) -> DataFrame:
    """The categories with most offending rows per dimension."""
    counts = category_counts(df.where(condition), dimensions, missing="<missing>")
    return largest_k(counts, ["dimension"], F.col("n_rows"), "category", top)


def check_peer_outlier_rate(df: DataFrame, roles: Roles) -> DataFrame:
    """Entities whose rate is over ten times the median entity rate (and over 1 %).

    The median includes the target; a rate needs two valid entities and a positive
    median.
    """
    return _outliers(entity_sums(df, roles, [roles.total, *roles.numerators.values()]), roles)


def _outliers(sums: DataFrame, roles: Roles) -> DataFrame:
    sums = sums.where(F.col(roles.total) > 0)
    pairs = F.array(
        *[
            F.struct(
                F.lit(name).alias("rate"),
                (100.0 * F.col(c) / F.col(roles.total)).alias("value"),
            )
            for name, c in roles.numerators.items()
        ]
    )
    rates = sums.select("peer", F.explode(pairs).alias("_r")).select("peer", "_r.*")
    median = plain_percentile(rates, ["rate"], "value", 0.5, "median")
    sizes = rates.groupBy("rate").agg(F.count("*").alias("_n"))
    joined = join_keys(join_keys(rates, median, ["rate"]), sizes, ["rate"])
    return joined.where(
        (F.col("_n") >= 2)
        & (F.col("median") > 0)
        & (F.col("value") > MAX_PEER_RATE_RATIO * F.col("median") + RATE_EPSILON)
        & (F.col("value") > 1.0 + RATE_EPSILON)
    ).select(
        F.lit("WARNING").alias("severity"),
        F.lit("peer_outlier_rate").alias("check"),
        F.concat_ws("/", "rate", "peer").alias("subject"),
        F.col("value").alias("pct"),
        "median",
    )


def _as_issues(df: DataFrame, details: Column | None = None) -> DataFrame:
    return df.select(
        *[F.col(c) for c in ISSUE],
        (details if details is not None else F.lit(None)).cast("map<string,string>").alias("details"),
    )


Check = tuple[str, str, Column, Column]


def share_checks(roles: Roles) -> list[Check]:
    """The row checks of a share run."""
    required = [roles.metric, roles.entity, *roles.dimensions, *([roles.time] if roles.time else [])]
    checks = [("null_values", c, F.col(c).isNull(), null_severity()) for c in required]
    return [*checks, ("negative_values", roles.metric, F.col(roles.metric) < 0, F.lit("ERROR"))]


def rate_checks(roles: Roles) -> list[Check]:
    """The row checks of a rate run; the last one is that of low denominators."""
    numbers = [roles.total, *roles.numerators.values()]
    checks = [("null_values", c, F.col(c).isNull(), null_severity()) for c in numbers]
    checks += [("negative_values", c, F.col(c) < 0, F.lit("ERROR")) for c in numbers]
    for name, c in roles.numerators.items():
        rate = F.when(F.col(roles.total) > 0, 100.0 * F.col(c) / F.col(roles.total))
        checks += [
            ("invalid_rate", name, F.col(c) > F.col(roles.total) + RATE_EPSILON, F.lit("ERROR")),
            ("invalid_rates", name, rate > 100.0 + RATE_EPSILON, F.lit("ERROR")),
            (
                "outlier_rates",
                name,
                (rate < -RATE_EPSILON) | (rate > 100.0 + MAX_RATE_DEVIATION + RATE_EPSILON),
                F.lit("WARNING"),
            ),
        ]
    return [*checks, ("low_denominator", roles.total, low_denominator(roles), F.lit("WARNING"))]


def share_issues(table: DataFrame, roles: Roles, checks: list[Check]) -> DataFrame:
    """All share-mode findings from a checked table."""
    peers = table.where(F.col("peer").isNotNull()).select("peer").distinct()
    counts = table.where(F.col("category").isNotNull()).groupBy("dimension", "category").agg(F.sum("_n").alias("n_rows"))
    small = _small(counts if roles.dimensions else counts.where("false"))
    return (
        _as_issues(_row_issues(table, roles, checks))
        .unionByName(_as_issues(_few_peers(peers, roles)))
        .unionByName(_as_issues(small, F.create_map(F.lit("examples"), F.col("examples"))))
        .unionByName(_as_issues(_concentrated(_sums_of(table, roles, [roles.metric]), roles)))
    )


def rate_issues(table: DataFrame, roles: Roles, checks: list[Check]) -> DataFrame:
    """All rate-mode findings from a checked table."""
    peers = table.where(F.col("peer").isNotNull()).select("peer").distinct()
    numbers = [roles.total, *roles.numerators.values()]
    outliers = _outliers(_sums_of(table, roles, numbers), roles).withColumn("n_rows", F.lit(1).cast("bigint"))
    # Where the rows with a low denominator are: the first categories of each dimension.
    hits = table.groupBy("dimension", F.coalesce("category", F.lit("<missing>")).alias("category")).agg(
        F.sum(f"_c{len(checks) - 1}").alias("n_rows")
    ).where(F.col("n_rows") > 0)
    where = breakdown_text(largest_k(hits, ["dimension"], F.col("n_rows"), "category", BREAKDOWN_TOP)).scalar()
    rows = _row_issues(table, roles, checks)
    return (
        _as_issues(rows.where(F.col("check") != "low_denominator"))
        .unionByName(_as_issues(rows.where(F.col("check") == "low_denominator"), where))
        .unionByName(_as_issues(_few_peers(peers, roles)))
        .unionByName(
            _as_issues(outliers, F.create_map(F.lit("median"), F.col("median").cast("string")))
        )
    )


def validate_share_input(df: DataFrame, roles: Roles) -> DataFrame:
    """All share-mode checks as one issue table; missing columns stop at once."""
    check_required_columns(df, [roles.metric, roles.entity, *roles.dimensions, *([roles.time] if roles.time else [])])
    checks = share_checks(roles)
    return share_issues(checked_table(df, roles, checks, [roles.metric]), roles, checks)


def validate_rate_input(df: DataFrame, roles: Roles) -> DataFrame:
    """All rate-mode checks as one issue table."""
    numbers = [roles.total, *roles.numerators.values()]
    check_required_columns(
        df, [*numbers, roles.entity, *roles.dimensions, *([roles.time] if roles.time else [])]
    )
    checks = rate_checks(roles)
    return rate_issues(checked_table(df, roles, checks, numbers), roles, checks)


def breakdown_text(ranked: DataFrame) -> DataFrame:
    """One map from each dimension to its first categories with their rows, from ``issue_breakdown``."""
    place = F.struct("rank", F.concat_ws("=", "category", F.col("n_rows").cast("string")).alias("text"))
    per_dimension = ranked.groupBy("dimension").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(place)), lambda x: x["text"]), ",").alias("text")
    )
    return per_dimension.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("dimension", "text")))).alias("details"))


def issue_severity_counts(issues: DataFrame) -> DataFrame:
    """Issues per severity; ``abort`` tells whether any error stops the run."""
    return issues.groupBy("severity").agg(F.count("*").alias("n")).withColumn(
        "abort", F.col("severity") == "ERROR"
    )


def result_range_checks(
    results: DataFrame, percents: list[str], positives: list[str], balanced: list[str]
) -> DataFrame:
    """Range, sign, infinity and flatness findings per result column, in one pass."""
    columns = [*dict.fromkeys([*percents, *positives, *balanced])]
    stats = results.agg(
        *[
            F.struct(
                F.min(c).cast("double").alias("lo"),
                F.max(c).cast("double").alias("hi"),
                F.count(c).alias("n"),
                F.stddev_samp(c).alias("sd"),
                F.count_if(F.abs(F.col(c)) == float("inf")).alias("inf"),
            ).alias(f"_s{i}")
            for i, c in enumerate(columns)
        ]
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("column"),
                (
                    F.lit(c in percents)
                    & ((F.col(f"_s{i}.lo") < -0.1) | (F.col(f"_s{i}.hi") > 100.1))
                ).alias("out_of_range"),
                (F.lit(c in positives) & (F.col(f"_s{i}.lo") < 0)).alias("negative"),
                (F.col(f"_s{i}.inf") > 0).alias("infinite"),
                (
                    F.lit(c in balanced)
                    & (F.col(f"_s{i}.n") > 1)
                    & F.coalesce(F.col(f"_s{i}.sd") == 0, F.lit(False))
                ).alias("flat"),
            )
            for i, c in enumerate(columns)
        ]
    )
    return stats.select(F.explode(rows).alias("_r")).select("_r.*")


def result_consistency_check(results: DataFrame, target: str, peer: str, distance: str) -> DataFrame:
    """Rows whose distance is not target minus peer; nulls count as zero."""
    gap = F.abs(
        F.coalesce(target, F.lit(0.0)) - F.coalesce(peer, F.lit(0.0)) - F.coalesce(distance, F.lit(0.0))
    )
    return results.withColumn("deviation", gap).where(F.col("deviation") > 0.01)


def duplicate_keys(results: DataFrame, keys: list[str]) -> DataFrame:
    """Key combinations that a result table repeats."""
    return results.groupBy(*keys).agg(F.count("*").alias("n_rows")).where(F.col("n_rows") > 1)


def share_mix_total(results: DataFrame, column: str = "balanced_peer_average_pct") -> DataFrame:
    """Shares of a dimension and period should sum to about 100."""
    return (
        results.groupBy("dimension", "time_period")
        .agg(F.sum(column).alias("mix_total"))
        .withColumn("ok", (F.col("mix_total") > 99.0) & (F.col("mix_total") < 101.0))
    )


def period_gaps(df: DataFrame, date: str, limit_days: int = 45) -> DataFrame:
    """Steps between successive dates that hint at a missing month.

    The window has no partition, but runs over distinct calendar days only.
    """
    days = df.select(F.to_date(date).alias("day")).where(F.col("day").isNotNull()).distinct()
    stepped = days.withColumn("previous", F.lag("day").over(Window.orderBy("day")))
    return (
        stepped.where(F.col("previous").isNotNull())
        .withColumn("gap_days", F.datediff("day", "previous"))
        .where(F.col("gap_days") > limit_days)
    )
