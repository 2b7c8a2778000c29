"""The star-schema tables seen as a long-format benchmark fact table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from peerlens.operators.cells import prepare_cells
from peerlens.roles import Roles

ORDER_COLUMNS = {"priority", "period", "month", "order_day", "segment"}


_schemas: dict[str, StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables; its schema is read from the file footer only once."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _schemas:
        _schemas[path] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[path]).parquet(path)


def skewed_entity(nation_key: Column) -> Column:
    """Ten uneven entities: three large ones and seven single nations."""
    return (
        F.when(nation_key <= 9, "E0")
        .when(nation_key <= 14, "E1")
        .when(nation_key <= 17, "E2")
        .otherwise(F.concat(F.lit("E"), (nation_key - 15).cast("string")))
    )


def fact(spark: SparkSession, sf_dir: str, columns: tuple[str, ...]) -> DataFrame:
    """Line items with the wanted benchmark columns; only needed tables are joined."""
    wanted = set(columns)
    df = table(spark, sf_dir, "lineitem")
    if wanted & {"entity", "region", "nation"}:
        nation = table(spark, sf_dir, "nation")
        if "region" in wanted:
            nation = nation.join(
                table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")
            )
        suppliers = table(spark, sf_dir, "supplier").join(
            nation, F.col("s_nationkey") == F.col("n_nationkey")
        )
        df = df.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    if wanted & ORDER_COLUMNS:
        orders = table(spark, sf_dir, "orders")
        if "segment" in wanted:
            orders = orders.join(
                table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")
            )
        df = df.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    if wanted & {"part_type", "brand", "part_size"}:
        df = df.join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    returned = F.col("l_returnflag") == "R"
    expressions = {
        "entity": skewed_entity(F.col("n_nationkey")),
        "nation": F.col("n_name"),
        "region": F.col("r_name"),
        "returnflag": F.col("l_returnflag"),
        "linestatus": F.col("l_linestatus"),
        "priority": F.col("o_orderpriority"),
        "segment": F.col("c_mktsegment"),
        "part_type": F.col("p_type"),
        "brand": F.col("p_brand"),
        "part_size": F.col("p_size"),
        "period": F.year("o_orderdate").cast("string"),
        "month": F.date_format("o_orderdate", "yyyy-MM"),
        "order_day": F.to_date("o_orderdate"),
        "amount": F.col("l_extendedprice"),
        "qty": F.col("l_quantity"),
        "discount": F.col("l_discount"),
        "txn": F.lit(1.0),
        "approved": F.when(returned, 0.0).otherwise(1.0),
        "fraud": F.when(returned, 1.0).otherwise(0.0),
    }
    return df.select(*[expressions[c].alias(c) for c in columns])


DIMENSIONS = ("returnflag", "priority")
SHARE = Roles("entity", DIMENSIONS, metric="amount", target="E3")
SHARE_TIMED = Roles("entity", DIMENSIONS, metric="amount", time="period", target="E3")
PEER_ONLY = Roles("entity", DIMENSIONS, metric="amount")
PEER_ONLY_TIMED = Roles("entity", DIMENSIONS, metric="amount", time="period")
RATE = Roles(
    "entity",
    ("priority", "linestatus"),
    total="txn",
    numerators={"approval": "approved", "fraud": "fraud"},
    time="period",
    target="E3",
)


def columns_of(roles: Roles, *more: str) -> tuple[str, ...]:
    """The columns a run reads, so that the scans stay narrow."""
    named = [
        roles.entity,
        *roles.dimensions,
        roles.metric,
        roles.total,
        *roles.numerators.values(),
        *roles.secondary,
        roles.time,
        *more,
    ]
    return tuple(dict.fromkeys(c for c in named if c))


def fact_for(spark: SparkSession, sf_dir: str, roles: Roles, *more: str) -> DataFrame:
    return fact(spark, sf_dir, columns_of(roles, *more))


def prepared_for(
    spark: SparkSession, sf_dir: str, roles: Roles, *more: str, exact: bool = False
) -> DataFrame:
    """The facts of a run scanned once into a compact table."""
    metrics = [c for c in columns_of(roles, *more) if c not in (roles.entity, roles.time, *roles.dimensions)]
    return prepare_cells(fact_for(spark, sf_dir, roles, *more), roles, metrics, exact)
