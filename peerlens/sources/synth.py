"""Deterministic synthetic fact table of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def synth_long_dataset(spark: SparkSession, entities: int, months: int, categories: int) -> DataFrame:
    """Entities x months x card type x channel, spread over the cluster by row id.

    Volume is (1000 + 25 * entity) * (1 + card + channel); the indices come from
    the row id, so no join is needed.
    """
    rows = spark.range(entities * months * categories * categories)
    channel = F.col("id") % categories
    card = F.floor(F.col("id") / categories) % categories
    month = F.floor(F.col("id") / (categories * categories)) % months
    entity = F.floor(F.col("id") / (categories * categories * months))
    base = (1000.0 + 25.0 * entity) * (1.0 + card + channel)
    start = F.to_date(F.lit("2024-01-01"))
    return rows.select(
        F.format_string("Issuer %03d", entity + 1).alias("issuer_name"),
        F.date_format(F.add_months(start, month.cast("int")), "yyyy-MM").alias("year_month"),
        F.format_string("Card %d", card + 1).alias("card_type"),
        F.format_string("Channel %d", channel + 1).alias("channel"),
        base.alias("txn_cnt"),
        (base * 1.1).alias("total"),
        base.alias("approved"),
        (base * 0.01).alias("fraud"),
        (base * 50.0).alias("clearing_spend"),
    )
