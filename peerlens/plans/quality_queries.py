"""Queries: input and result checks, schema decisions, scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peerlens.functions import scalar
from peerlens.operators import analysis, balanced, cells, impact, quality, schema
from peerlens.plans import workload as w
from peerlens.plans.registry import query, tidy
from peerlens.roles import Roles


def dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with the faults the checks look for, all taken from the data."""
    df = w.fact(spark, sf_dir, ("entity", "brand", "returnflag", "month", "amount", "qty", "discount", "period"))
    return df.select(
        "entity",
        F.when(F.col("brand") != "Brand#11", F.col("brand")).alias("brand"),
        F.when(F.col("qty") != 7, F.col("returnflag")).alias("returnflag"),
        "month",
        F.when(F.col("qty") > 1, F.col("amount") - 2000.0).alias("amount"),
        (F.col("qty") - 1.0).alias("total"),
        (F.col("discount") * 300.0).alias("approved"),
        (F.col("discount") * 500.0 - 1.0).alias("fraud"),
        F.when(F.col("qty") > 48, "n/a").otherwise(F.col("qty").cast("string")).alias("quantity_text"),
    )


DIRTY_SHARE = Roles("entity", ("brand", "returnflag"), metric="amount", time="month", target="e3")
DIRTY_RATE = Roles(
    "entity",
    ("brand", "returnflag"),
    total="total",
    numerators={"approval": "approved", "fraud": "fraud"},
    time="month",
    target="E3",
)


def shown(issues: DataFrame) -> DataFrame:
    """Issues with their details as text."""
    return tidy(issues.withColumn("details", F.to_json("details")))


@query
def check_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(quality.check_nulls(dirty(spark, sf_dir), ["entity", "brand", "returnflag", "amount", "month"]))


@query
def check_negative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(quality.check_negative(dirty(spark, sf_dir), ["amount", "total", "fraud"]))


@query
def check_num_gt_den(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(quality.check_num_gt_den(dirty(spark, sf_dir), DIRTY_RATE))


@query
def check_low_denominator(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(quality.check_low_denominator(dirty(spark, sf_dir), DIRTY_RATE, 10))


@query
def issue_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories with most low-denominator rows."""
    low = quality.low_denominator(DIRTY_RATE, 10)
    return tidy(quality.issue_breakdown(dirty(spark, sf_dir), low, ["brand", "returnflag"]))


@query
def check_rate_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(quality.check_rate_range(dirty(spark, sf_dir), DIRTY_RATE))


@query
def check_finite_nonneg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(quality.check_finite_nonneg(dirty(spark, sf_dir), ["amount", "quantity_text", "total"]))


@query
def preprocess(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nulls filled and all-zero rows dropped, then summed by entity."""
    df = dirty(spark, sf_dir).select(
        "entity",
        F.when(F.col("amount") > 0, F.col("amount")).alias("amount"),
        F.when(F.col("approved") > 20, F.col("approved")).alias("approved"),
    )
    cleaned = quality.preprocess(df)
    return tidy(
        cleaned.groupBy("entity").agg(
            F.count("*").alias("n_rows"), F.sum("amount").alias("amount"), F.sum("approved").alias("approved")
        ),
        ("amount", "approved"),
    )


@query
def check_entity_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    roles = Roles("entity", (), metric="amount")
    return tidy(quality.check_entity_concentration(w.fact(spark, sf_dir, ("entity", "amount")), roles, 15.0))


@query
def check_peer_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five regions less the target leave too few peers."""
    df = w.fact(spark, sf_dir, ("region", "amount"))
    return tidy(quality.check_peer_count(df, Roles("region", (), metric="amount", target="asia")))


@query
def check_small_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = w.fact(spark, sf_dir, ("order_day", "part_size", "brand"))
    roles = Roles("entity", ("order_day", "part_size", "brand"))
    return tidy(quality.check_small_categories(df, roles, 16))


@query
def check_peer_outlier_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers whose rate is far over the median customer's."""
    lines = w.table(spark, sf_dir, "lineitem").join(
        w.table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")
    )
    rare = (F.col("l_quantity") <= 1) & (F.col("l_discount") >= 0.09)
    df = lines.select(
        F.col("o_custkey").cast("string").alias("entity"),
        F.lit(100.0).alias("total"),
        F.when(rare, 500.0).otherwise(1.0).alias("approved"),
        F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0).alias("fraud"),
    )
    roles = Roles("entity", (), total="total", numerators={"approval": "approved", "fraud": "fraud"})
    return tidy(quality.check_peer_outlier_rate(df, roles))


@query
def validate_share_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(quality.validate_share_input(dirty(spark, sf_dir), DIRTY_SHARE))


@query
def validate_rate_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(quality.validate_rate_input(dirty(spark, sf_dir), DIRTY_RATE))


@query
def issue_severity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    issues = quality.validate_rate_input(dirty(spark, sf_dir), DIRTY_RATE)
    return quality.issue_severity_counts(issues)


def share_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = w.fact_for(spark, sf_dir, w.SHARE_TIMED)
    return analysis.share_analysis(df, w.SHARE_TIMED)


@query
def result_range_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = share_results(spark, sf_dir)
    return quality.result_range_checks(
        results,
        ["balanced_peer_average_pct", "target_share_pct", "distance_to_peer_pp"],
        ["original_total_volume", "impact_pp"],
        ["balanced_peer_average_pct", "impact_pp"],
    )


@query
def result_consistency_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result rows whose distance was rounded to one place."""
    results = tidy(share_results(spark, sf_dir)).withColumn(
        "distance_to_peer_pp", F.round("distance_to_peer_pp", 1)
    )
    out = quality.result_consistency_check(
        results, "target_share_pct", "balanced_peer_average_pct", "distance_to_peer_pp"
    )
    return tidy(out.select("dimension", "category", "time_period", "deviation"))


@query
def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.duplicate_keys(w.table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query
def share_mix_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = w.fact_for(spark, sf_dir, w.PEER_ONLY_TIMED)
    return tidy(quality.share_mix_total(analysis.share_analysis(df, w.PEER_ONLY_TIMED)))


@query
def period_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of more than 30 days between the months that have orders."""
    df = w.table(spark, sf_dir, "orders").select(F.trunc("o_orderdate", "month").alias("day"))
    return tidy(quality.period_gaps(df, "day", 30))


# Schema decisions, followed by the work they decide about ----------------------


@query
def normalize_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table with untidy, colliding names, normalised and summed."""
    raw = w.table(spark, sf_dir, "orders").select(
        F.col("o_orderstatus").alias(" Order Status "),
        F.col("o_totalprice").alias("Total-Price ($)"),
        F.col("o_orderkey").alias("Total.Price"),
    )
    df = schema.normalize_columns(raw)
    return tidy(
        df.groupBy("order_status").agg(
            F.sum("total_price").alias("total_price"), F.sum("total_price_2").alias("total_price_2")
        ),
        ("total_price",),
    )


@query
def normalize_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = w.table(spark, sf_dir, "pages")
    return df.select("page_id", scalar.normalize_text(F.col("url")).alias("label"))


@query
def available_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row counts of every category of the dimensions found by name and type."""
    df = w.fact(spark, sf_dir, ("entity", "returnflag", "priority", "part_size", "amount", "period"))
    return quality.category_counts(df, schema.available_dimensions(df, "period"))


@query
def choose_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles picked from the columns, then the volumes of the picked entity and metric."""
    df = w.fact(spark, sf_dir, ("entity", "returnflag", "qty", "amount", "txn"))
    roles = schema.choose_roles(df, entity=("issuer_name", "entity"), metric=("amount",), total=("txn",))
    return tidy(
        cells.peer_volumes(df, roles).select(
            "peer",
            "volume",
            F.lit(",".join(roles.dimensions)).alias("dimensions"),
            F.lit(",".join(roles.secondary)).alias("secondary"),
        ),
        ("volume",),
    )


@query
def resolve_entity_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = w.fact(spark, sf_dir, ("entity", "amount")).withColumnRenamed("entity", "issuer_name")
    name = schema.resolve_entity_column(df, "bank_name")
    return df.groupBy(F.col(name).alias("peer")).agg(F.count("*").alias("n_rows"))


@query
def resolve_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target spelled in another case, among ambiguous spellings, and not at all."""
    df = w.table(spark, sf_dir, "customer").select(
        "c_mktsegment",
        F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).otherwise(F.lower("c_mktsegment")).alias("mixed"),
    )
    found = schema.resolve_target(df, "c_mktsegment", "building")
    unclear = schema.resolve_target(df, "mixed", "Machinery")
    exact = schema.resolve_target(df, "mixed", "MACHINERY", prefer_exact=True)
    absent = schema.resolve_target(df, "mixed", "nobody")
    return found.unionByName(unclear).unionByName(exact).unionByName(absent)


@query
def detect_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schema kind by names, and the rates that a full schema allows."""
    df = w.fact(spark, sf_dir, ("entity", "txn", "approved", "linestatus")).withColumnRenamed("txn", "total_cnt")
    kind = schema.detect_schema(df.columns)
    return tidy(
        df.groupBy("entity").agg(
            F.lit(kind).alias("schema_kind"),
            scalar.safe_pct(F.sum("approved"), F.sum("total_cnt")).alias("approval_pct"),
        )
    )


@query
def detect_export_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kind of a balanced export, and the compared column summed by its period."""
    df = w.fact_for(spark, sf_dir, w.SHARE_TIMED)
    export = balanced.balanced_export_share(df, w.SHARE_TIMED, calculated=True)
    kind = schema.detect_export_kind(export.columns)
    return tidy(
        export.groupBy(F.col(kind["period"]).alias("time_period")).agg(
            F.lit(kind["kind"]).alias("kind"), F.sum(kind["column"]).alias("compared_total")
        )
    )


@query
def row_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred orders by key: a limit with a stated order."""
    return w.table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy("o_orderkey").limit(100)


@query
def union_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rate results of all rates and dimensions stacked under one key."""
    df = w.fact_for(spark, sf_dir, w.RATE)
    return tidy(
        impact.rate_impact(df, w.RATE, None).select(
            F.concat_ws("_", "rate", "dimension").alias("rate_dimension"), "category", "time_period", "raw_pct"
        )
    )


# Scalar functions --------------------------------------------------------------


@query
def unit_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = dirty(spark, sf_dir).select("brand", "month").distinct()
    return df.select(scalar.unit_key(F.lit("brand"), F.col("brand"), F.col("month")).alias("unit_key"))


@query
def normalize_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = w.table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") == "F", F.lit("  "))
        .when(F.col("o_orderstatus") == "P", F.lit("NaN"))
        .otherwise(F.concat(F.lit(" "), F.date_format("o_orderdate", "yyyy-MM")))
        .alias("label"),
    )
    return df.select("o_orderkey", scalar.normalize_period(F.col("label")).alias("period"))


@query
def period_to_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as date, month, year and free text, by order status and priority."""
    day = F.col("o_orderdate")
    df = w.table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") == "F", F.date_format(day, "yyyy-MM"))
        .when(F.col("o_orderstatus") == "P", F.date_format(day, "yyyy"))
        .when(F.col("o_orderpriority") == "5-LOW", F.concat(F.lit("Q"), F.quarter(day).cast("string")))
        .otherwise(F.date_format(day, "yyyy-MM-dd HH:mm:ss"))
        .alias("label"),
    )
    return df.select("o_orderkey", scalar.period_to_date(F.col("label")).alias("period"))


@query
def parse_bool_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = w.table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.when(F.col("l_returnflag") == "R", F.lit(" Yes"))
        .when(F.col("l_linestatus") == "O", F.lit("FAILED "))
        .otherwise(F.col("l_returnflag"))
        .alias("word"),
    )
    return tidy(df.select("l_orderkey", "l_linenumber", scalar.parse_bool_text(F.col("word"), True).alias("flag")))


@query
def to_bps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fraud rates per cell shown in basis points; impacts stay as they are."""
    df = w.fact_for(spark, sf_dir, w.RATE)
    rows = balanced.balanced_export_rate(df, w.RATE, calculated=True)
    return tidy(scalar.to_bps(rows.drop("balanced_total", "balanced_approval_total", "balanced_fraud_total", "raw_total")))


@query
def sanitize_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole document texts, with a formula sign before some."""
    df = w.table(spark, sf_dir, "documents")
    text = F.when(F.col("lang") == "en", F.concat(F.lit("="), F.col("text"))).otherwise(F.col("text"))
    return df.select("doc_id", F.md5(scalar.sanitize_cell(text).cast("binary")).alias("text_md5"))


@query
def sanitize_terminal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole conversation turns with control sequences around the role."""
    df = w.table(spark, sf_dir, "conversations")
    text = F.concat(F.lit("\x1b[1;31m"), F.col("role"), F.lit("\x1b[0m\x07 "), F.col("text"))
    return df.select("conv_id", "turn", F.md5(scalar.sanitize_terminal(text).cast("binary")).alias("text_md5"))


@query
def user_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = w.table(spark, sf_dir, "pages")
    return df.select("page_id", scalar.user_token(F.col("url")).alias("token"))


@query
def rounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half-even rounding at two, four and six places of line values."""
    df = w.table(spark, sf_dir, "lineitem")
    value = F.col("l_quantity") / 8.0
    return tidy(
        df.groupBy("l_quantity").agg(
            F.bround(F.max(value), 2).alias("r2"), F.bround(F.max(value), 1).alias("r1"), F.count("*").alias("n_rows")
        )
    )


@query
def safe_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = dirty(spark, sf_dir).groupBy("brand", "month").agg(
        F.sum("approved").alias("a"), (F.sum("total") - 300.0).alias("b")
    )
    return tidy(sums.select("brand", "month", scalar.safe_pct(F.col("a"), F.col("b")).alias("pct")))


