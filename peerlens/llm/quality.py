"""Quality rules whose thresholds adapt to each language and source.

Signals of every whole text are counted in one pass.  Their distributions are held
in quantile sketches with relative error (logarithmic buckets with counts), one for
each (language, source); sketches merge by adding counts, so they are built by an
ordinary map-side combined aggregation, do not depend on the order of rows, and
those of a language or of the whole corpus are sums of the finer ones.  A threshold
is a fence beyond the quartiles of the document's own group (of its language or of
everything where the group is too small to tell); documents meet their group's
thresholds in a join.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peerlens.session import join_keys

from .common import SpanHash, chunks, text_bytes, windows, words, write_scratch

#: Relative error of a quantile is about half of GAMMA - 1.
GAMMA = 1.02
#: Values up to here share the lowest bucket.
LEAST = 1e-6
#: A fence lies this many quartile distances beyond the quartile, and SLACK further.
REACH = 3.0
#: Absolute slack by signal, so that a group in which nearly all values agree has room.
SLACK = {"symbol_share": 0.05, "dup_line_share": 0.5, "repeat_share": 0.3, "mean_word": 1.0}
#: Signals with a lower fence too.
TWO_SIDED = ("mean_word",)
#: Groups of fewer documents use their language's sketch, then the corpus's.
LEAST_ROWS = 100

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True

SIGNALS = "struct<n_words: long, word_chars: long, n_symbols: long, n_lines: long, n_dup_lines: long, n_repeat_words: long>"


def _first_of_equal(hashes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by (doc, hash), and the length of the run of equal ones, for each in that order."""
    order = np.lexsort((hashes, doc))
    h, d = hashes[order], doc[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    begin = np.flatnonzero(new)
    return order, np.repeat(np.diff(np.append(begin, len(h))), np.diff(np.append(begin, len(h))))


def text_signals(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The counts of SIGNALS, one array each, for the texts of a byte array."""
    n = len(offsets) - 1
    starts, ends, first = words(data, offsets)
    n_words = np.diff(first)
    span = SpanHash(data)

    def total(mark: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(mark)))
        return sums[offsets[1:]] - sums[offsets[:-1]]

    inside = np.zeros(len(data) + 1, dtype=np.int32)
    np.add.at(inside, starts, 1)
    np.add.at(inside, ends, -1)
    in_word = np.cumsum(inside)[:-1] > 0
    word_chars = total(in_word & ((data & 0xC0) != 0x80))
    # Three-word windows that a text has twice or more; a word counts once.
    h = span(starts, ends)
    at, doc = windows(n_words, 3, short_whole=False)
    repeated = np.zeros(len(h) + 1, dtype=np.int32)
    if len(at):
        three = h[at] * np.uint64(3) + (h[at + 1] ^ (h[at + 1] >> np.uint64(7))) * np.uint64(0xC2B2AE3D27D4EB4F) + (
            h[at + 2] ^ (h[at + 2] >> np.uint64(13))) * np.uint64(0x9E3779B97F4A7C15)
        order, run = _first_of_equal(three, doc)
        twice = at[order[run > 1]]
        np.add.at(repeated, twice, 1)
        np.add.at(repeated, twice + 3, -1)
    covered = np.concatenate(([0], np.cumsum(np.cumsum(repeated)[:-1] > 0)))
    # Lines with a word.
    breaks = np.flatnonzero(data == 10)
    line_end = np.sort(np.concatenate((breaks, offsets[1:])), kind="stable")
    line_doc = np.concatenate((np.searchsorted(offsets[1:], breaks, side="right"), np.arange(n)))
    line_doc = np.sort(line_doc, kind="stable")
    line_start = np.concatenate(([0], line_end[:-1]))
    same = np.concatenate(([False], line_doc[1:] == line_doc[:-1]))
    line_start = np.where(same, line_start + 1, offsets[line_doc])
    worded = np.searchsorted(starts, line_end) > np.searchsorted(starts, line_start)
    line_start, line_end, line_doc = line_start[worded], line_end[worded], line_doc[worded]
    order, run = _first_of_equal(span(line_start, line_end), line_doc)
    n_lines = np.bincount(line_doc, minlength=n)
    # Runs of r equal lines have r - 1 repeats: each line weighs 1 - 1 / r.
    n_dup = np.rint(np.bincount(line_doc[order], weights=1 - 1 / run, minlength=n)).astype(np.int64)
    return [n_words, word_chars, total(_SYMBOL[data]), n_lines, n_dup, covered[first[1:]] - covered[first[:-1]]]


def _signals(texts: pa.Array) -> pa.Array:
    data, offsets = text_bytes(texts)
    parts = [text_signals(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in chunks(offsets)]
    names = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
    columns = [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0) for i in range(len(names))]
    return pa.StructArray.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=list(names))


def signals(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without the text but with the counts and base_failed.

    Words are maximal runs of characters other than space and \\t to \\r; a null text
    has none.  Columns named like the results are replaced.
    """
    names = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
    out = docs.withColumn("__signals", F.arrow_udf(_signals, SIGNALS)(F.col(text_col)))
    out = out.drop(text_col, *names, "base_failed").select("*", "__signals.*").drop("__signals")
    return out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def _shares() -> dict[str, Column]:
    per = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return {
        "symbol_share": per("n_symbols", "word_chars"), "dup_line_share": per("n_dup_lines", "n_lines"),
        "repeat_share": per("n_repeat_words", "n_words"), "mean_word": per("word_chars", "n_words"),
    }


def sketches(counted: DataFrame, lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Rows (lang, source, signal, bucket, n): the sketches of the documents that pass the base rules."""
    shares = _shares()
    rows = counted.where(~F.col("base_failed")).select(
        F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"),
        F.explode(F.array(*[F.struct(F.lit(k).alias("signal"), v.alias("value")) for k, v in shares.items()])).alias("s"),
    )
    bucket = F.when(F.col("s.value") <= LEAST, F.lit(-10_000)).otherwise(F.ceil(F.log("s.value") / F.log(F.lit(GAMMA)))).cast("int")
    return rows.groupBy("lang", "source", F.col("s.signal").alias("signal"), bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def merge(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """The sketches of coarser groups: counts of equal buckets are added."""
    return sketch.groupBy(*keys, "signal", "bucket").agg(F.sum("n").alias("n"))


def fences(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (keys, signal, rows, low, high) from a sketch; the windows run over buckets, not documents."""
    group = Window.partitionBy(*keys, "signal")
    ordered = group.orderBy("bucket")
    value = F.when(F.col("bucket") == -10_000, 0.0).otherwise(2 * F.pow(F.lit(GAMMA), F.col("bucket")) / (GAMMA + 1))
    ranked = sketch.select(
        *keys, "signal", value.alias("value"), F.sum("n").over(ordered).alias("upto"), F.sum("n").over(group).alias("rows")
    )
    quartile = lambda q: F.min(F.when(F.col("upto") >= q * F.col("rows"), F.col("value")))
    at = ranked.groupBy(*keys, "signal").agg(F.max("rows").alias("rows"), quartile(0.25).alias("q1"), quartile(0.75).alias("q3"))
    slack = F.element_at(F.create_map(*[F.lit(x) for kv in SLACK.items() for x in kv]), F.col("signal"))
    reach = REACH * (F.col("q3") - F.col("q1")) + slack
    low = F.when(F.col("signal").isin(*TWO_SIDED), F.col("q1") - reach).otherwise(F.lit(float("-inf")))
    return at.select(*keys, "signal", "rows", low.alias("low"), (F.col("q3") + reach).alias("high"))


def thresholds(sketch: DataFrame) -> DataFrame:
    """One row for each (lang, source): low_* and high_* of each signal, from the finest large group."""
    fine = fences(sketch, ["lang", "source"])
    by_lang = fences(merge(sketch, ["lang"]), ["lang"]).select("lang", "signal", *[F.col(c).alias(f"lang_{c}") for c in ("rows", "low", "high")])
    overall = fences(merge(sketch, []), []).select("signal", F.col("low").alias("all_low"), F.col("high").alias("all_high"))
    both = join_keys(join_keys(fine, by_lang, ["lang", "signal"]), overall, ["signal"])
    choose = lambda c: (
        F.when(F.col("rows") >= LEAST_ROWS, F.col(c)).when(F.col("lang_rows") >= LEAST_ROWS, F.col(f"lang_{c}")).otherwise(F.col(f"all_{c}"))
    )
    names = list(SLACK)
    return both.groupBy("lang", "source").agg(
        *[F.max(F.when(F.col("signal") == s, choose(c))).alias(f"{c}_{s}") for s in names for c in ("low", "high")]
    )


def judge_quality(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``docs`` without the text, with the signals, base_failed and kept.

    kept is false where a base rule fails (fewer than 50 words, or more than half
    of them in repeated three-word windows) or a signal lies outside its group's
    fences.  Null language and source are groups of their own; a group without a
    document that passes the base rules keeps none.  Repeated rows are judged alike.
    """
    counted = write_scratch(signals(docs, text_col), "signals")
    limits = thresholds(write_scratch(sketches(counted, lang_col, source_col), "sketches"))
    names = {lang_col: "lang", source_col: "source"}
    limits = limits.select(*[F.col(new).alias(old) for old, new in names.items()], *[c for c in limits.columns if c not in names.values()])
    joined = join_keys(counted, limits, [lang_col, source_col], "left")
    inside = F.lit(True)
    for signal, share in _shares().items():
        inside = inside & (share <= F.col(f"high_{signal}")) & (share >= F.col(f"low_{signal}"))
    return joined.withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(False))).drop(
        *[f"{c}_{s}" for s in SLACK for c in ("low", "high")]
    )
