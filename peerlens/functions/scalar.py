"""Column functions: labels, keys, digests and display values."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Texts read as yes or no.
TRUE_WORDS = ("yes", "true", "1", "y", "pass", "passed")
FALSE_WORDS = ("no", "false", "0", "n", "fail", "failed", "")
# Terminal control sequences (CSI and OSC).
ANSI = r"(?:\x1b\[[0-?]*[ -/]*[@-~]|\x1b\][^\x07\x1b]*(?:\x07|\x1b\\))"


def normalize_text(label: Column) -> Column:
    """The column-name normalisation, applied to data."""
    joined = F.regexp_replace(F.lower(F.trim(label)), r"[\s\-.]+", "_")
    kept = F.regexp_replace(joined, r"[^\p{L}\p{N}_]", "")
    return F.regexp_replace(F.regexp_replace(kept, "_+", "_"), "^_|_$", "")


def safe_pct(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole * 100.0).otherwise(F.lit(0.0))


def unit_key(dimension: Column, category: Column, time_period: Column, output_scope: Column | None = None) -> Column:
    """Readable key of a publication unit; null parts stay empty."""
    scope = output_scope if output_scope is not None else F.lit(None).cast("string")
    parts = (
        ("dimension", dimension),
        ("category", category),
        ("time_period", time_period),
        ("output_scope", scope),
    )
    return F.concat_ws("|", *[F.concat(F.lit(f"{n}="), F.coalesce(c, F.lit(""))) for n, c in parts])


def normalize_period(value: Column) -> Column:
    """Null, NaN and blank mean no period; anything else is trimmed text."""
    text = F.trim(value.cast("string"))
    return F.when((text != "") & (F.lower(text) != "nan"), text)


def period_to_date(value: Column) -> Column:
    """ISO date where the label is a date, month or year, else the label."""
    text = F.trim(value.cast("string"))
    day = F.coalesce(
        F.try_to_timestamp(text, F.lit("yyyy-MM-dd")),
        F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")),
        F.try_to_timestamp(text, F.lit("yyyy-MM")),
        F.try_to_timestamp(text, F.lit("yyyy/MM/dd")),
        F.try_to_timestamp(text, F.lit("yyyy")),
    )
    return F.coalesce(F.date_format(day, "yyyy-MM-dd"), text)


def parse_bool_text(value: Column, default: bool = False) -> Column:
    word = F.lower(F.trim(value.cast("string")))
    return (
        F.when(word.isin(*TRUE_WORDS), True)
        .when(word.isin(*FALSE_WORDS), False)
        .otherwise(F.lit(default))
    )


# Words that keep a column out of the basis-point display.
NOT_RATES = (
    "impact",
    "effect",
    "distortion",
    "weight",
    "multiplier",
    "total",
    "volume",
    "count",
    "numerator",
    "denominator",
)


def bps_columns(columns: list[str], metric: str = "fraud", every_rate: bool = False) -> list[str]:
    """Rate columns shown in basis points: those of the metric, or all of them."""
    out = []
    for name in columns:
        text = name.lower()
        is_rate = "%" in text or text.endswith("_pct") or "rate" in text
        if is_rate and not any(word in text for word in NOT_RATES) and (every_rate or metric in text):
            out.append(name)
    return out


def to_bps(df: DataFrame, metric: str = "fraud", every_rate: bool = False) -> DataFrame:
    """Multiply fraud rates by 100 and rename them to basis points."""
    for name in bps_columns(df.columns, metric, every_rate):
        renamed = re.sub(r"(_pct|\(%\)|%)$", "", name).rstrip("_ ") + "_bps"
        df = df.withColumn(name, F.col(name) * 100.0).withColumnRenamed(name, renamed)
    return df


def sanitize_cell(value: Column) -> Column:
    """Quote text that a spreadsheet would run as a formula."""
    return F.when(value.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), value)).otherwise(value)


def sanitize_terminal(value: Column) -> Column:
    """Strip control sequences; other non-printables become question marks."""
    return F.regexp_replace(F.regexp_replace(value, ANSI, ""), r"[^\n\t\x20-\x7e]", "?")


def user_token(user: Column) -> Column:
    """URL-safe base64 of a user name without padding."""
    return F.rtrim(F.translate(F.base64(F.encode(user, "utf-8")), "+/=\r\n", "-_ "))


def exact_parts(value: Column) -> tuple[Column, Column]:
    """A double as a whole decimal and what is left: their sums are exact in any order of rows.

    Null for what is not finite or too large.
    """
    number = value.cast("double")
    # Below 2 ** 53 a long cuts the number, at a fraction of a cast from double to decimal.
    fits = F.abs(number) < float(1 << 53)
    cut = F.when(fits, number.cast("long"))
    whole = F.when(fits, cut.cast("decimal(28,0)")).otherwise(number.try_cast("decimal(28,0)"))
    rest = (
        F.when(number == cut.cast("double"), F.lit(0).cast("decimal(28,18)"))
        .when(fits, (number - cut.cast("double")).try_cast("decimal(28,18)"))
        .otherwise((number - whole.cast("double")).try_cast("decimal(28,18)"))
    )
    return whole, rest


def as_double(whole: Column, rest: Column) -> Column:
    """The double that two exact parts make."""
    return whole.cast("double") + rest.cast("double")


def exact_sum(value: Column) -> Column:
    """Sum of doubles that does not depend on the order of rows; a plain sum where one is not finite."""
    whole, rest = exact_parts(value)
    strange = F.max(value.isNotNull() & whole.isNull())
    return F.when(strange, F.sum(value)).otherwise(as_double(F.sum(whole), F.sum(rest)))


def hash_pieces(texts: list[Column]) -> list[Column]:
    """SHA-256 of some texts with null marked, as four whole decimals that may be added in any order."""
    line = F.concat_ws("\u001f", *[F.coalesce(t.cast("string"), F.lit("\u0000")) for t in texts])
    h = F.sha2(line, 256)
    return [F.conv(F.substring(h, 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)") for i in range(4)]


def digest_line(key: Column | str, count: Column | str, pieces: list[str]) -> Column:
    """The text that stands for a group in the next level of a digest."""
    return F.concat_ws(":", key, count, *[F.col(p).cast("string") for p in pieces])


PIECES = [f"_p{i}" for i in range(4)]


def summed_pieces(texts: list[Column]) -> list[Column]:
    return [F.sum(p).alias(n) for p, n in zip(hash_pieces(texts), PIECES)]


def root_digest(leaves: DataFrame, key: str, line: str, name: str = "digest") -> DataFrame:
    """One digest of rows ``key, line`` by 256 buckets of the key, one row out.

    Rows are hashed and added up in a bucket; at most 256 rows reach the last step.
    """
    bucket = F.substring(F.sha2(F.col(key), 256), 1, 2).alias("_g")
    grouped = leaves.groupBy(bucket).agg(F.count("*").alias("_n"), *summed_pieces([F.col(line)]))
    lines = F.array_sort(F.collect_list(digest_line("_g", "_n", PIECES)))
    return grouped.agg(F.sha2(F.array_join(lines, ";"), 256).alias(name))


def ordered_digest(df: DataFrame, order: list[str], text: Column, name: str = "digest") -> DataFrame:
    """SHA-256 that depends on all rows and their order, one row out.

    Each row is hashed with its sort key; the hashes are combined in key order in
    256 fixed groups and once more over the groups, so no task and no buffer ever
    holds more than its group.
    """
    leaf = df.select(
        F.sha2(F.concat_ws("\u001f", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in order], text), 256).alias("_h")
    ).withColumn("_g", F.substring("_h", 1, 2))
    # Summing 60-bit pieces is order-free; the sort key inside each leaf pins order.
    pieces = [F.conv(F.substring("_h", 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)") for i in range(4)]
    grouped = leaf.groupBy("_g").agg(
        F.count("*").alias("_n"), *[F.sum(p).alias(f"_p{i}") for i, p in enumerate(pieces)]
    )
    # At most 256 rows reach this last step.
    line = F.concat_ws(":", "_g", "_n", *[F.col(f"_p{i}").cast("string") for i in range(4)])
    return grouped.agg(
        F.sha2(F.array_join(F.array_sort(F.collect_list(line)), ";"), 256).alias(name)
    )
