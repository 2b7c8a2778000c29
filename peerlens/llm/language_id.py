"""Language identification by hierarchical discrimination.

First a linear support vector machine per language family (one against the rest)
picks the family; then one-versus-one linear machines among the family's
languages vote.  Features are hashed byte 3-grams and 5-grams of the whole text,
as shares of the text's n-grams, so the margin of a text is a mean of weights and
long texts need no more memory than short ones.

Training uses a bounded sample of labelled rows (``per_label`` rows of each label,
chosen by a hash of the id) and runs as one Spark task per machine.  Prediction
reads every text once, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, chunks, list_array, text_bytes

#: Language families by ISO 639-1 code. A label not listed is its own family.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fy", "is", "lb", "nl", "no", "nb", "nn", "sv", "yi"),
    "romance": ("ca", "es", "fr", "gl", "it", "la", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "indo-aryan": ("bn", "gu", "hi", "mr", "ne", "pa", "si", "ur"),
    "iranian": ("fa", "ku", "ps", "tg"),
    "uralic": ("et", "fi", "hu"),
    "turkic": ("az", "kk", "ky", "tr", "tt", "uz"),
    "semitic": ("am", "ar", "he", "mt"),
    "dravidian": ("kn", "ml", "ta", "te"),
    "sinitic": ("yue", "zh"),
}
BITS = 16
UNKNOWN = "und"
#: Passes of the solver at most, and the weight of a training error.
EPOCHS, COST = 40, 40.0


def family_of(label: str) -> str:
    return next((name for name, members in FAMILIES.items() if label in members), f"only {label}")


@dataclass
class LanguageModel:
    """Machines in order: ``names`` are (kind, yes, no); a row of ``weights`` each."""

    labels: list[str]
    names: list[tuple[str, str, str]] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros((0, 1 << BITS), np.float32))
    bias: np.ndarray = field(default_factory=lambda: np.zeros(0))
    slope: np.ndarray = field(default_factory=lambda: np.zeros(0))

    @property
    def families(self) -> list[str]:
        return sorted({family_of(x) for x in self.labels})


def _ngrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature of each n-gram start (3-grams, then 5-grams), and whether the n-gram lies in one text."""
    n = len(data)
    low = np.zeros(n + 4, np.uint32)
    low[:n] = LOWER[data]
    three = low[:n] * np.uint32(0x01000193) + low[1 : n + 1] * np.uint32(0x0085EBCB) + low[2 : n + 2] * np.uint32(0x27D4EB2F)
    five = three * np.uint32(0x9E3779B1) + low[3 : n + 3] * np.uint32(0xC2B2AE3D) + low[4 : n + 4] * np.uint32(0x165667B1)
    half = np.uint32(32 - BITS + 1)
    out = np.concatenate((three * np.uint32(0x9E3779B1) >> half, (five * np.uint32(0x85EBCA77) >> half) | np.uint32(1 << (BITS - 1))))
    left = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(n)
    return out.astype(np.int32), np.concatenate((left >= 3, left >= 5))


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_bytes(batch.column(1))
        for a, b in chunks(offsets):
            index, share = [], []
            for i in range(a, b):
                feature, whole = _ngrams(data[offsets[i] : offsets[i + 1]], np.array([0, offsets[i + 1] - offsets[i]]))
                at, count = np.unique(feature[whole], return_counts=True)
                index.append(at.astype(np.int32))
                share.append((count / max(1, count.sum())).astype(np.float32))
            sizes = np.array([len(x) for x in index])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a), list_array(np.concatenate(index), sizes), list_array(np.concatenate(share), sizes)],
                names=["label", "at", "share"],
            )


def _train(rows: pd.DataFrame) -> pd.DataFrame:
    """Dual coordinate descent for a linear machine with squared hinge loss."""
    rows = rows.sort_values(["label", "order"], kind="stable")
    y = np.where(rows["yes"].to_numpy(), 1.0, -1.0)
    x = [(np.asarray(i), np.asarray(v, np.float64) * 20) for i, v in zip(rows["at"], rows["share"])]
    balance = COST * np.where(y > 0, len(y) / max(1, 2 * (y > 0).sum()), len(y) / max(1, 2 * (y < 0).sum()))
    square = np.array([v @ v + 1.0 for _, v in x]) + 0.5 / balance
    w, bias, alpha = np.zeros(1 << BITS), 0.0, np.zeros(len(y))
    rng = np.random.default_rng(5)
    for _ in range(EPOCHS):
        moved = 0.0
        for i in rng.permutation(len(y)):
            at, v = x[i]
            gradient = y[i] * (w[at] @ v + bias) - 1 + alpha[i] * 0.5 / balance[i]
            new = max(0.0, alpha[i] - gradient / square[i])
            step = (new - alpha[i]) * y[i]
            alpha[i] = new
            w[at] += step * v
            bias += step
            moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    margin = y * np.array([w[at] @ v + bias for at, v in x])
    # One-parameter calibration: the logistic slope that fits the sample best.
    slopes = np.array([0.5, 1, 2, 3, 4, 6, 8])
    loss = [np.mean(np.log1p(np.exp(-np.clip(s * margin, -50, 50)))) for s in slopes]
    return pd.DataFrame({
        "machine": [rows["machine"].iloc[0]], "weights": [(w * 20).astype(np.float32)], "bias": [bias],
        "slope": [float(slopes[int(np.argmin(loss))])],
    })


def train_language_model(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", per_label: int = 300
) -> LanguageModel:
    """Fit the machines on at most ``per_label`` labelled rows of each label.

    Rows with a null label or text are not used.  The counts by label are exact;
    the sample takes the rows with the smallest hash of the id (ties: by text
    hash), so a rerun fits the same model.  With no labelled row the model knows
    no language; with one label it has no machine and always answers it.
    """
    given = docs.where(F.col(label_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(label_col).cast("string").alias("label"), F.col(text_col).alias("text"),
        F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(1 << 30)).alias("draw"),
    )
    counts = {r["label"]: r["n"] for r in given.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    model = LanguageModel(sorted(counts))
    if len(counts) < 2:
        return model
    # Twice the expected share first, without a shuffle; the exact bound on what is left.
    limit = F.lit(0)
    for label, n in counts.items():
        limit = F.when(F.col("label") == label, F.lit(int(min(1.0, 2 * per_label / n) * (1 << 30)))).otherwise(limit)
    some = given.where(F.col("draw") < limit)
    best = Window.partitionBy("label").orderBy("draw", F.xxhash64("text"))
    sample = some.withColumn("order", F.row_number().over(best)).where(F.col("order") <= per_label)
    families = model.families
    if len(families) > 1:
        model.names += [("family", f, "") for f in families]
    for f in families:
        model.names += [("pair", a, b) for a, b in combinations([x for x in model.labels if family_of(x) == f], 2)]
    # The order within a label is fixed by the row number, kept through the feature step in the label text.
    featured = sample.select(F.concat_ws("\x01", "label", F.lpad(F.col("order").cast("string"), 9, "0")).alias("label"), "text").mapInArrow(
        _sparse, "label string, at array<int>, share array<float>"
    ).select(
        F.split("label", "\x01")[0].alias("label"), F.split("label", "\x01")[1].cast("int").alias("order"), "at", "share"
    )
    roles = [
        (m, label, (family_of(label) == yes) if kind == "family" else label == yes)
        for m, (kind, yes, no) in enumerate(model.names)
        for label in model.labels
        if kind == "family" or label in (yes, no)
    ]
    roles = docs.sparkSession.createDataFrame(roles, "machine int, label string, yes boolean")
    fitted = (
        featured.join(roles, "label").groupBy("machine")
        .applyInPandas(_train, "machine int, weights array<float>, bias double, slope double").collect()
    )
    fitted = sorted(fitted, key=lambda r: r["machine"])
    model.weights = np.stack([np.asarray(r["weights"], np.float32) for r in fitted])
    model.bias = np.array([r["bias"] for r in fitted])
    model.slope = np.array([r["slope"] for r in fitted])
    return model


def _decide(model: LanguageModel, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Label number and score of each text (a row of margins)."""
    n = len(margins)
    p = 1 / (1 + np.exp(-np.clip(margins * model.slope, -50, 50)))
    families = model.families
    rows = {name: m for m, name in enumerate(model.names)}
    if len(families) > 1:
        by_family = p[:, [rows["family", f, ""] for f in families]] + 1e-12
        pick = margins[:, [rows["family", f, ""] for f in families]].argmax(1)
        sure = by_family[np.arange(n), pick] / by_family.sum(1)
    else:
        pick, sure = np.zeros(n, int), np.ones(n)
    label, score = np.zeros(n, int), np.zeros(n)
    for k, f in enumerate(families):
        members = [i for i, x in enumerate(model.labels) if family_of(x) == f]
        mine = np.flatnonzero(pick == k)
        votes, belief = np.zeros((len(mine), len(members))), np.zeros((len(mine), len(members)))
        for i, j in combinations(range(len(members)), 2):
            q = p[mine, rows["pair", model.labels[members[i]], model.labels[members[j]]]]
            votes[:, i] += q >= 0.5
            votes[:, j] += q < 0.5
            belief[:, i] += q
            belief[:, j] += 1 - q
        best = (votes + belief / (len(members) + 1)).argmax(1)
        rival = max(1, len(members) - 1)
        label[mine] = np.array(members)[best]
        score[mine] = sure[mine] * (belief[np.arange(len(mine)), best] / rival if len(members) > 1 else 1.0)
    return label, np.clip(score, 0.0, 1.0)


def predict_languages(docs: DataFrame, model: LanguageModel, text_col: str = "text", lang_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """``docs`` with the columns lang_pred (string) and score (double, 0 to 1).

    A null text, an empty one and one without a letter are ``und`` with score 0, as
    is every text when the model knows no language.  A text shorter than an n-gram
    is decided by the machines' biases.  All other columns pass through unread;
    columns that have the names of the two results are replaced.
    """
    docs = docs.drop(lang_col, score_col)
    if not model.labels:
        return docs.withColumns({lang_col: F.lit(UNKNOWN), score_col: F.lit(0.0)})
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        m = held.value
        data, offsets = text_bytes(pa.array(texts, pa.string()))
        margins = np.tile(m.bias, (len(texts), 1))
        for a, b in chunks(offsets, 1 << 20):
            at = offsets[a : b + 1] - offsets[a]
            feature, whole = _ngrams(data[offsets[a] : offsets[b]], at)
            count = np.maximum(at[1:] - at[:-1] - 2, 0) + np.maximum(at[1:] - at[:-1] - 4, 0)
            half = len(feature) // 2
            for k in range(len(m.names)):
                value = np.where(whole, m.weights[k][feature], np.float32(0))
                sums = np.concatenate(([0.0], np.cumsum(value[:half] + value[half:], dtype=np.float64)))
                margins[a:b, k] += (sums[at[1:]] - sums[at[:-1]]) / np.maximum(count, 1)
        label, score = _decide(m, margins)
        return pd.DataFrame({"lang_pred": np.array(m.labels, dtype=object)[label], "score": score})

    lettered = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    # The shuffle-free projection: columns other than the text never enter Python.
    out = docs.withColumn("__language_of_text", predict(F.coalesce(F.col(text_col), F.lit(""))))
    return out.withColumns({
        lang_col: F.when(lettered, F.col("__language_of_text.lang_pred")).otherwise(F.lit(UNKNOWN)),
        score_col: F.when(lettered, F.col("__language_of_text.score")).otherwise(F.lit(0.0)),
    }).drop("__language_of_text")


def held_out(id_col: str = "doc_id"):
    """Rows kept from training: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", min_score: float = 0.3) -> DataFrame:
    """The pipeline's filter: documents whose language is predicted with enough score."""
    model = train_language_model(docs.where(~held_out(id_col)), id_col, text_col, label_col)
    scored = predict_languages(docs, model, text_col, "_pred", "_pred_score")
    return scored.where((F.col("_pred") != UNKNOWN) & (F.col("_pred_score") >= min_score)).drop("_pred", "_pred_score")
