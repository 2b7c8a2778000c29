"""Decisions taken from column names and types alone (driver, metadata only)."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from peerlens.roles import Roles

# Name tokens that give a column its part.
TOKENS = {
    "count": {"count", "counts", "cnt", "txn_count", "transaction_count"},
    "amount": {"amount", "amt", "tpv", "volume", "value"},
    "entity": {"entity", "issuer", "merchant", "bank", "institution"},
    "approved": {"approved", "approval", "appr"},
    "total": {"total", "overall"},
    "declined": {"declined", "decline", "rejected"},
}
# Substrings that keep a column from being a dimension.
NOT_DIMENSIONS = ("entity", "issuer", "merchant", "id", "code", "name")
RESERVED_PREFIX = "_TIME_"


def normalize_name(name: str) -> str:
    """Lower case, separators to one underscore, other characters dropped."""
    text = re.sub(r"[\s\-.]+", "_", str(name).strip().lower())
    return re.sub(r"_+", "_", re.sub(r"[^\w]", "", text)).strip("_")


def normalized_names(names: Iterable[str]) -> list[str]:
    """Normalised names; a repeated one gets its position as suffix."""
    seen: set[str] = set()
    out: list[str] = []
    for position, name in enumerate(names):
        label = normalize_name(name)
        if not label or label in seen:
            label = f"{label or 'column'}_{position}"
        seen.add(label)
        out.append(label)
    return out


def normalize_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*normalized_names(df.columns))


def _plays(name: str, part: str) -> bool:
    return bool(set(normalize_name(name).split("_")) & TOKENS[part])


def detect_schema(columns: list[str], mapping: dict[str, list[str]] | None = None, mode: str = "hybrid") -> str:
    """``full``, ``minimal`` or ``unknown``, by an explicit role map or name tokens.

    ``mapping`` goes from canonical role to column names; mode ``mapped`` trusts
    only the map, ``hybrid`` falls back to tokens, ``heuristic`` ignores the map.
    """
    roles = mapping or {}

    def mapped(*names: str) -> bool:
        return any(set(roles.get(n, ())) & set(columns) for n in names)

    def named(part: str) -> bool:
        return any(_plays(c, part) for c in columns)

    full = minimal = False
    if roles and mode in ("mapped", "hybrid"):
        entity = mapped("entity_identifier")
        full = (
            mapped("approved_count", "approved_amount")
            and mapped("total_count", "total_amount", "declined_count", "declined_amount")
            and entity
        )
        minimal = mapped("transaction_count") and mapped("transaction_amount") and entity
    if not (roles and mode == "mapped"):
        entity = named("entity")
        full = full or (named("approved") and (named("total") or named("declined")) and entity)
        minimal = minimal or (named("count") and named("amount") and entity)
    return "full" if full else "minimal" if minimal else "unknown"


def available_dimensions(df: DataFrame, time: str | None = None) -> list[str]:
    """Non-numeric columns whose name holds none of the excluded substrings."""
    return [
        f.name
        for f in df.schema.fields
        if not isinstance(f.dataType, T.NumericType)
        and f.name != time
        and not any(part in f.name.lower() for part in NOT_DIMENSIONS)
    ]


def choose_roles(
    df: DataFrame,
    entity: tuple[str, ...] = ("issuer_name", "entity_identifier"),
    metric: tuple[str, ...] = (),
    total: tuple[str, ...] = (),
    time: tuple[str, ...] = (),
) -> Roles:
    """First preferred name present, else the first column of the fitting type."""
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    labels = [f.name for f in df.schema.fields if not isinstance(f.dataType, T.NumericType)]

    def pick(preferred: tuple[str, ...], pool: list[str]) -> str | None:
        return next((c for c in preferred if c in df.columns), pool[0] if pool else None)

    chosen_entity = pick(entity, labels)
    chosen_time = next((c for c in time if c in df.columns), None)
    chosen_metric = pick(metric, numeric)
    dimensions = [c for c in labels if c not in (chosen_entity, chosen_time)][:2]
    return Roles(
        chosen_entity,
        tuple(dimensions),
        metric=chosen_metric,
        total=next((c for c in total if c in df.columns), None),
        secondary=tuple([c for c in numeric if c != chosen_metric][:2]),
        time=chosen_time,
    )


def resolve_entity_column(df: DataFrame, preferred: str | None = None) -> str:
    """The preferred column, else a conventional one, else an error."""
    for name in (preferred, "issuer_name", "entity_identifier"):
        if name and name in df.columns:
            return name
    raise ValueError("no entity column found")


def resolve_target(df: DataFrame, entity: str, target: str, prefer_exact: bool = False) -> DataFrame:
    """How a target name matches the entities, ignoring case: one row.

    One spelling resolves to it, none leaves the input as it is, several are
    ambiguous (null) unless ``prefer_exact`` finds the very spelling.
    """
    spellings = (
        df.where(F.upper(F.col(entity)) == F.upper(F.lit(target)))
        .groupBy(F.col(entity).alias("spelling"))
        .agg(F.lit(1).alias("_one"))
    )
    exact = F.max(F.col("spelling") == target) if prefer_exact else F.lit(False)
    return spellings.agg(
        F.count("*").alias("matches"), F.min("spelling").alias("_only"), exact.alias("_exact")
    ).select(
        F.lit(target).alias("requested"),
        "matches",
        F.when(F.col("matches") == 0, F.lit(target))
        .when(F.col("_exact"), F.lit(target))
        .when(F.col("matches") == 1, F.col("_only"))
        .alias("resolved"),
    )


def missing_columns(df: DataFrame, required: Iterable[str | None]) -> list[str]:
    return [c for c in required if c is not None and c not in df.columns]


def check_required_columns(df: DataFrame, required: Iterable[str | None]) -> None:
    """Refuse to go on without the columns a run names."""
    missing = missing_columns(df, required)
    if missing:
        raise ValueError(f"required columns not found: {missing}")


def reject_reserved_dimension(dimensions: Iterable[str]) -> None:
    """Dimensions may not use the prefix kept for whole-period cells."""
    for name in dimensions:
        if name.startswith(RESERVED_PREFIX):
            raise ValueError(f"dimension {name!r} uses the reserved prefix {RESERVED_PREFIX!r}")



def detect_export_kind(columns: list[str]) -> dict[str, str | None]:
    """Kind of an exported table and the columns to compare."""
    lower = {c.lower(): c for c in columns}
    period = next(
        (lower[n] for n in ("time_period", "period", "year_month", "month", "quarter", "date") if n in lower),
        None,
    )
    share = next((c for c in columns if re.fullmatch(r"(?i)balanced_.+_share(_%|_pct)", c)), None)
    if "balanced_total" in lower:
        return {"kind": "rate", "column": lower["balanced_total"], "period": period}
    if share:
        return {"kind": "share_percent", "column": share, "period": period}
    metric = next((c for c in columns if c.lower().startswith("balanced_")), None)
    if metric:
        return {"kind": "share_metric", "column": metric, "period": period}
    return {"kind": "unknown", "column": None, "period": period}
