"""Order statistics that never gather a whole group into one task.

A double is turned into a whole number of 64 bits in the same order.  A percentile is found
by radix descent: totals by steps of the logarithm, the group's bucket that holds
the answer, then the same among its rows by these bits, until a bucket holds a single
value.  Only the rows of the one open bucket of each group go on, spread over tasks, and
weights are added as decimals, so that no sum depends on the order of rows.  The whole input
is only read, never shuffled or written: its totals by bucket are made before the shuffle, and
what is kept of it is the first open bucket, about a hundredth.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peerlens.functions.scalar import as_double, exact_parts
from peerlens.session import cut_lineage, join_keys, small_table

# The first pass has 64 buckets in a doubling of the value.  Bits below the bucket in the
# passes after it: 12 bits of the mantissa more each time.
STEPS = 64
SHIFTS = (34, 22, 10, 0)
# The rows of an open bucket are dealt out to so many keys of the join that picks them.
SPREAD = 32


def order_bits(value: Column) -> Column:
    """The 64-bit image of a double: ``a < b`` if and only if the images are so; null comes first, NaN last.

    For a finite number, its bits as written in memory (negated for a negative one),
    from exact steps: powers of two and quotients by them.
    """
    value = value.cast("double")
    size = F.abs(value)
    guess = F.floor(F.least(F.greatest(F.log2(size), F.lit(-1022.0)), F.lit(1023.0))).cast("int")
    low, high = F.pow(F.lit(2.0), guess), F.pow(F.lit(2.0), guess + 1)
    exponent = F.when(size < low, guess - 1).when(size >= high, guess + 1).otherwise(guess)
    fraction = ((size / F.pow(F.lit(2.0), exponent) - 1.0) * float(1 << 52)).cast("long")
    normal = F.shiftleft((exponent + 1023).cast("long"), 52) + fraction
    # Below 2 ** -1022 there is no leading one; the number is a multiple of 2 ** -1074.
    small = (F.least(size, F.lit(2.0**-1022)) * 2.0**537 * 2.0**537).cast("long")
    bits = (
        F.when(size == 0, F.lit(0).cast("long")).when(size < 2.0**-1022, small)
        .when(size == float("inf"), F.lit(0x7FF0 << 48)).otherwise(normal)
    )
    return (
        F.when(value.isNull(), F.lit(-(1 << 63))).when(F.isnan(value), F.lit((1 << 63) - 1))
        .when(value < 0, -bits).otherwise(bits)
    )


def _step(value: Column) -> Column:
    """The bucket of the first pass: ``a < b`` never has the larger one; null comes first, NaN last."""
    value = value.cast("double")
    size = F.abs(value)
    far = F.when(size == float("inf"), 2048 * STEPS).otherwise(F.floor(F.log2(size) * STEPS) + 1024 * 2 * STEPS).cast("long")
    return (
        F.when(value.isNull(), F.lit(-(1 << 40))).when(F.isnan(value), F.lit(1 << 40))
        .when(value == 0, F.lit(0).cast("long")).when(value < 0, -far).otherwise(far)
    )


_EXACT = {"_w": "decimal(38,0)", "_r": "decimal(38,18)"}


def _weighed(df: DataFrame, keys: list[str], value: str, weight: str | None, *more: Column) -> DataFrame:
    """Rows ``keys, _x, _b, _g`` and ``more``: value, bucket of the first pass and weight."""
    return df.select(*keys, F.col(value).alias("_x"), _step(F.col(value)).alias("_b"), (F.col(weight) if weight else F.lit(1.0)).alias("_g"), *more)


def _parts() -> dict[str, Column]:
    """The weight ``_g`` in exact parts; what is none counts nothing."""
    return {c: F.coalesce(part, F.lit(0)).cast(kind) for (c, kind), part in zip(_EXACT.items(), exact_parts(F.col("_g")))}


def _totals(rows: DataFrame, keys: list[str], *more: Column) -> DataFrame:
    """The weights, rows and values of the first pass's buckets, added up before the shuffle."""
    return small_table(
        rows.groupBy(*keys, "_b").agg(
            *[F.coalesce(F.sum(part), F.lit(0)).cast(_EXACT[c]).alias(c) for c, part in zip(_EXACT, exact_parts(F.col("_g")))], F.count("*").alias("_n"),
            F.min("_x").eqNullSafe(F.max("_x")).alias("_single"), F.min("_x").alias("_x"), *more,
        ),
        "buckets",
    )


def _crossing(sums: DataFrame, keys: list[str]) -> DataFrame:
    """The bucket of each group in which the cumulative weight reaches its aim.

    ``sums`` is one row per occupied bucket, at most some 2 ** 18 of a group and mostly a
    few hundred: ``_b, _w, _r, _p``, weight before (``_bw``, ``_br``) and to reach (``_target``).
    """
    group = Window.partitionBy(*keys)
    scan = group.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    before_w = F.sum("_w").over(scan) + F.col("_bw") - F.col("_w")
    before_r = F.sum("_r").over(scan) + F.col("_br") - F.col("_r")
    total = as_double(F.sum("_w").over(group), F.sum("_r").over(group)) * F.col("_p")
    placed = sums.select(
        *keys, "_b", "_single", "_x", F.coalesce("_target", total).alias("_target"),
        before_w.cast(_EXACT["_w"]).alias("_bw"), before_r.cast(_EXACT["_r"]).alias("_br"),
        as_double(before_w + F.col("_w"), before_r + F.col("_r")).alias("_c"), F.max("_b").over(group).alias("_last"),
    )
    return small_table(
        # The last bucket answers if rounding keeps every sum below the target.
        placed.where((F.col("_c") >= F.col("_target")) | (F.col("_b") == F.col("_last")))
        .groupBy(*keys)
        .agg(F.min(F.struct("_b", "_single", "_x", "_bw", "_br", "_target")).alias("_h"))
        .select(*keys, "_h.*"),
        "crossing",
    )


def _descend(rows: DataFrame, totals: DataFrame, goals: DataFrame, keys: list[str], result: str) -> DataFrame:
    """Percentiles ``keys, _end, result`` for ``goals`` (``keys, _end, _p``) of ``rows`` and their ``totals``.

    The end ``at`` goes by weight, others by number of rows.
    """
    def of_end(count: Column) -> list[Column]:
        plain = F.col("_end") != "at"
        return [F.when(plain, count.cast(_EXACT["_w"])).otherwise(F.col("_w")).alias("_w"), F.when(plain, F.lit(0).cast(_EXACT["_r"])).otherwise(F.col("_r")).alias("_r")]

    by, found = [*keys, "_end"], []
    nothing = [F.lit(0).cast(kind).alias(c) for c, kind in zip(("_bw", "_br"), _EXACT.values())]
    first = join_keys(totals, goals, keys)
    crossing = _crossing(first.select(*by, "_b", "_single", "_x", *of_end(F.col("_n")), "_p", *nothing, F.lit(None).cast("double").alias("_target")), by)
    found.append(crossing.where("_single").select(*by, F.col("_x").alias(result)))
    wide = crossing.where("NOT _single").select(*by, "_b", "_bw", "_br", "_target")
    if wide.isEmpty():
        return found[0]
    # Rows are dealt out to some keys of a group, should the join not be a broadcast.
    dealt = small_table(wide.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1)))), "open")
    inside = join_keys(rows.withColumn("_s", F.pmod(F.hash("_x"), F.lit(SPREAD))), dealt, [*keys, "_b", "_s"])
    rows = cut_lineage(inside.withColumns(_parts()).select(*by, "_x", order_bits(F.col("_x")).alias("_i"), *of_end(F.lit(1)), "_bw", "_br", "_target"))
    for shift in SHIFTS:
        sums = rows.groupBy(*by, F.shiftright("_i", shift).alias("_b")).agg(
            *[F.sum(c).cast(kind).alias(c) for c, kind in _EXACT.items()], F.lit(0.0).alias("_p"), F.max("_bw").alias("_bw"), F.max("_br").alias("_br"),
            F.max("_target").alias("_target"), (F.min("_i") == F.max("_i")).alias("_single"), F.min("_x").alias("_x"),
        )
        crossing = _crossing(sums, by)
        single = F.col("_single") if shift else F.lit(True)
        found.append(crossing.where(single).select(*by, F.col("_x").alias(result)))
        wide = crossing.where(~single).select(*by, "_b", "_bw", "_br", "_target")
        if shift == 0 or wide.isEmpty():
            break
        dealt = small_table(wide.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1)))), "open")
        inside = rows.drop("_bw", "_br", "_target").withColumns(
            {"_b": F.shiftright("_i", shift), "_s": F.pmod(F.hash("_i"), F.lit(SPREAD))}
        )
        rows = cut_lineage(join_keys(inside, dealt, [*by, "_b", "_s"]).drop("_b", "_s"))
    return reduce(DataFrame.unionByName, found)


def weighted_percentile(
    df: DataFrame,
    keys: list[str],
    value: str,
    weight: str,
    p: float | str,
    result: str = "percentile",
) -> DataFrame:
    """Weighted percentile per group: one row of ``keys`` + ``result``.

    The answer is the first value, ascending, whose cumulative weight reaches
    ``p`` times the total weight, whatever the order of rows.  Values are compared as
    doubles.  Weights must be positive (see ``weighted_percentile_or_plain``) and count to
    18 decimals.  ``p`` is a number or the name of a column that is constant within a group.
    The input is read twice.
    """
    share = F.lit(float(p)) if isinstance(p, (int, float)) else F.col(p).cast("double")
    rows = _weighed(df, keys, value, weight, share.alias("_p"))
    totals = _totals(rows, keys, F.max("_p").alias("_p"))
    goals = totals.groupBy(*keys).agg(F.max("_p").alias("_p")).withColumn("_end", F.lit("at"))
    return _descend(rows.drop("_p"), totals.drop("_p"), goals, keys, result).drop("_end")


def _aims(rows: Column, p: float) -> Column:
    """Where a plain percentile's two neighbours lie, as shares of ``rows`` rows.

    Aiming half a row past the wanted rank always lands on it.
    """
    position = (rows - 1) * p
    return F.array(*[F.struct(F.lit(n).alias("_end"), ((of(position) + 0.5) / rows).alias("_p")) for n, of in (("low", F.floor), ("high", F.ceil))])


def _of_groups(rows: DataFrame, totals: DataFrame, sizes: DataFrame, keys: list[str], p: float, aims: Column, result: str) -> DataFrame:
    """Percentiles by each group's ``aims``; the two ends of a plain one are interpolated."""
    goals = sizes.select(*keys, F.explode(aims).alias("_a")).select(*keys, "_a.*")
    of = lambda end: F.max(F.when(F.col("_end") == end, F.col("_v")))
    found = _descend(rows, totals, goals, keys, "_v").groupBy(*keys).agg(of("at").alias("_vat"), of("low").alias("_vlo"), of("high").alias("_vhi"))
    position = (F.col("_rows") - 1) * p
    part = sizes.select(*keys, (position - F.floor(position)).alias("_part"))
    between = F.col("_vlo") + (F.col("_vhi") - F.col("_vlo")) * F.col("_part")
    return join_keys(found, part, keys).select(*keys, F.coalesce("_vat", between).alias(result))


def plain_percentile(df: DataFrame, keys: list[str], value: str, p: float, result: str = "percentile") -> DataFrame:
    """Linearly interpolated percentile per group."""
    rows = _weighed(df.where(F.col(value).isNotNull()), keys, value, None)
    totals = _totals(rows, keys)
    sizes = totals.groupBy(*keys).agg(F.sum("_n").alias("_rows"))
    return _of_groups(rows, totals, sizes, keys, p, _aims(F.col("_rows"), p), result)


def weighted_percentile_or_plain(
    df: DataFrame, keys: list[str], value: str, weight: str, p: float, result: str = "percentile"
) -> DataFrame:
    """Weighted percentile; the plain one where a group's total weight is not positive.

    The input is read twice: for the totals by bucket, and for the rows of the open buckets.
    """
    rows = _weighed(df.where(F.col(value).isNotNull()), keys, value, weight, F.col(weight).isNotNull().alias("_known"))
    totals = _totals(rows, keys, F.max("_known").alias("_known"))
    sizes = totals.groupBy(*keys).agg(as_double(F.sum("_w"), F.sum("_r")).alias("_tw"), F.sum("_n").alias("_rows"), F.max("_known").alias("_known"))
    by_weight = F.array(F.struct(F.lit("at").alias("_end"), F.lit(float(p)).alias("_p")))
    aims = F.when(F.col("_tw") > 0, by_weight).otherwise(_aims(F.col("_rows"), p))
    return _of_groups(rows.drop("_known"), totals.drop("_known"), sizes.where("_known"), keys, p, aims, result)


def distributed_rank(df: DataFrame, order: list[Column], name: str, by: list[str] | None = None) -> DataFrame:
    """Add a 1-based rank (per ``by`` group) without a single-task window.

    Rows are range-sorted across partitions and written to the checkpoint folder;
    each partition then needs only the row counts of the partitions before it.
    ``order`` must be a total order within a group.
    """
    by = by or []
    placed = cut_lineage(
        df.orderBy(*[F.col(k) for k in by], *order).withColumn(
            "_id", F.monotonically_increasing_id()
        )
    )
    part = F.shiftright("_id", 33)
    counts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_rows"))
    # One row per partition of the sort.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before")
    )
    numbered = (
        placed.withColumn("_part", part)
        .join(offsets, "_part")
        .withColumn("_pos", F.col("_before") + F.col("_id").bitwiseAND((1 << 33) - 1) + 1)
        .drop("_part", "_before", "_id")
    )
    if not by:
        return numbered.withColumnRenamed("_pos", name)
    first = numbered.groupBy(*by).agg((F.min("_pos") - 1).alias("_first"))
    return (
        join_keys(numbered, first, by)
        .withColumn(name, F.col("_pos") - F.col("_first"))
        .drop("_pos", "_first")
    )


def largest_k(df: DataFrame, keys: list[str], value: Column, tiebreak: str, k: int) -> DataFrame:
    """The ``k`` largest rows per group with their ordinal in column ``rank``.

    The filter on ``row_number`` lets Spark keep only ``k`` rows per group in each
    task before the shuffle.
    """
    order = Window.partitionBy(*keys).orderBy(value.desc(), F.col(tiebreak))
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
