"""Personal data: generated candidates, boosted trees, calibrated thresholds.

Everything on the way from texts to spans is built-in column functions: a document
is one row from scan to result, without explode, join or shuffle.

1. Base patterns (email, ip, card, phone) with their checks; their spans always stay.
2. High-recall generators propose further, overlapping spans: anything like an
   address, a long number, a long opaque token, a value given to a secret's name.
3. Boosted trees score a candidate from its format and context, not from check
   digits: they are fitted to candidates that a base pattern or a secret's name
   vouches for, against background candidates; candidates that have a base format
   but fail its check are left out of the fit, so they score like their peers.
4. A threshold per generator, calibrated on rows left out of the fit for a wanted
   precision, selects the spans to add.

Patterns are linear on long runs: a match starts where a run starts (or where the
last match ended), and repetitions are possessive.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import write_scratch

_LOCAL = "[A-Za-z0-9._%+-]"
#: Base patterns by kind, in the order of the result; same matches as the contract's.
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Generators: pattern and the group that is the span.
GENERATORS = {
    "address": r"(?<![^\s\"'<>()@])[^\s\"'<>()@]++@[^\s\"'<>()@]++",
    "number": r"(?<![0-9])\+?[0-9](?:[\x20().-]{0,2}+[0-9]){6,}+",
    "opaque": r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{24,}+",
    "named": r"(?i)(?<![a-z])(?:api[_-]?key|token|secret|passw(?:or)?d)(?![a-z])[\"']?\s{0,3}[:=]\s{0,3}[\"']?[^\s\"']{6,}+",
}
KINDS = (*BASE, "secret")
#: What a score is made of.
FEATURES = (
    "length", "digit_share", "letter_share", "upper_share", "symbol_share", "n_digits", "n_groups", "distinct_share", "has_at",
    "dots_after_at", "starts_plus", "hex_only", "mixed", "quoted", "assigned", "word_before", "space_after",
)
CONTEXT = 24


@dataclass
class PiiModel:
    """``score`` maps the feature columns to a probability; ``thresholds`` by generator."""

    score: Callable[[Callable[[str], Column]], Column] | None
    thresholds: dict[str, float]


def _spans(text: Column, pattern: str, gate: Column) -> Column:
    """array<struct<s, e, m>> of all matches: code point offsets from the gaps between them."""
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    empty = F.array().cast("array<struct<s:int,e:int,m:string>>")

    def step(at: Column, x: Column) -> Column:
        start = at["at"] + F.length(x["gap"])
        end = start + F.length(x["m"])
        one = F.array(F.struct(start.alias("s"), end.alias("e"), x["m"].alias("m")))
        return F.when(x["m"].isNull(), at).otherwise(F.struct(end.alias("at"), F.concat(at["out"], one).alias("out")))

    zipped = F.arrays_zip(gaps.alias("gap"), found.alias("m"))
    walked = F.aggregate(zipped, F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda at: at["out"])
    return F.when(gate, walked).otherwise(empty)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda x, i: F.when(i % 2 == 0, x.cast("int")).otherwise(
        (x.cast("int") * 2) % 10 + F.floor(x.cast("int") / 5).cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def _checks(kind: str) -> Callable[[Column], Column]:
    if kind == "ip":
        part = lambda p: (F.length(F.regexp_replace(p, "^0+(?=.)", "")) <= 3) & (F.substring(F.regexp_replace(p, "^0+(?=.)", ""), 1, 3).cast("int") <= 255)
        return lambda x: F.forall(F.split(x["m"], r"\."), part)
    if kind == "card":
        return lambda x: F.length(_digits(x["m"])).between(13, 19) & F.when(F.length(_digits(x["m"])).between(13, 19), luhn(_digits(x["m"]))).otherwise(False)
    if kind == "phone":
        return lambda x: F.length(_digits(x["m"])).between(9, 15)
    return lambda x: F.lit(True)


def with_base(docs: DataFrame, text_col: str) -> DataFrame:
    """``docs`` with the arrays __email, __ip, __card and __phone of checked base spans; null text is empty."""
    docs = docs.withColumn("__text", F.coalesce(F.col(text_col), F.lit("")))
    text = F.col("__text")
    docs = docs.withColumn("__digit", text.rlike("[0-9]"))
    digit = F.col("__digit")
    gates = {
        "email": F.contains(text, F.lit("@")), "ip": digit & text.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"),
        "card": digit & text.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"), "phone": F.contains(text, F.lit("+")) & digit,
    }
    return docs.withColumns({f"__{kind}": F.filter(_spans(text, pattern, gates[kind]), _checks(kind)) for kind, pattern in BASE.items()})


def _features(x: Column) -> dict[str, Column]:
    """The FEATURES of a candidate (m, before, after) as doubles."""
    m, before, after = x["m"], x["before"], x["after"]
    n = F.length(m)
    left = lambda c: F.length(F.regexp_replace(m, c, ""))
    share = lambda c: ((n - left(c)) / n)
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    values = {
        "length": n, "digit_share": share("[0-9]"), "letter_share": share(r"\p{L}"), "upper_share": share(r"\p{Lu}"),
        "symbol_share": share(r"[^\p{L}0-9\x20]"), "n_digits": n - left("[0-9]"), "n_groups": F.size(F.split(m, "[^0-9]+")),
        "distinct_share": F.size(F.array_distinct(F.split(m, ""))) / n, "has_at": flag(F.contains(m, F.lit("@"))),
        "dots_after_at": F.length(F.regexp_replace(F.regexp_extract(m, "@(.*)$", 1), r"[^.]", "")), "starts_plus": flag(m.startswith("+")),
        "hex_only": flag(m.rlike("^[0-9a-fA-F]+$")), "mixed": flag(m.rlike("[0-9]") & m.rlike("[A-Za-z]")),
        "quoted": flag(before.rlike("[\"']$")), "assigned": flag(before.rlike(r"[:=]\s*[\"']?$") | m.rlike(r"^[^:=]+\s*[:=]")),
        "word_before": flag(before.rlike(r"(?i)(?:token|key|secret|passw|mail|phone|tel|call|card|ip|address|account|ssn|id)\W*$")),
        "space_after": flag((after == "") | after.rlike(r"[\s.,;:!?\"')#$%&*]")),
    }
    return {k: v.cast("double") for k, v in values.items()}


def _found(background: bool = False) -> Column:
    """The generators' spans in a row of with_base(): array<struct<s, e, m, g, before, after>>.

    With ``background`` long words are proposed too, as examples of what is nothing.
    """
    text, digit = F.col("__text"), F.col("__digit")
    gates = {
        "address": F.contains(text, F.lit("@")), "number": digit & text.rlike(r"[0-9](?:[\x20().-]{0,2}+[0-9]){6}"),
        "opaque": text.rlike(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{24}"),
        "named": text.rlike(r"(?i)(?:key|token|secret|passw(?:or)?d)[\"']?\s{0,3}[:=]"),
    }
    patterns = dict(GENERATORS)
    if background:
        patterns["word"] = r"(?<!\p{L})\p{L}{11,}+"
        gates["word"] = F.lit(True)
    before = lambda x: F.substring(text, F.greatest(F.lit(1), x["s"] - CONTEXT + 1), F.least(x["s"], F.lit(CONTEXT)))
    tag = lambda g: lambda x: F.struct(
        x["s"].alias("s"), x["e"].alias("e"), x["m"].alias("m"), F.lit(g).alias("g"),
        before(x).alias("before"), F.substring(text, x["e"] + 1, F.lit(1)).alias("after"))
    return F.concat(*[F.transform(_spans(text, p, gates[g]), tag(g)) for g, p in patterns.items()])


def with_candidates(docs: DataFrame) -> DataFrame:
    """The rows of with_base() with __cand: the generators' spans and their features."""
    scored = lambda x: F.struct(*[x[c].alias(c) for c in ("s", "e", "g", "m")], *[v.alias(k) for k, v in _features(x).items()])
    return docs.withColumn("__cand", F.transform(_found(), scored))


def _tree(node, value: Callable[[str], Column]) -> Column:
    if node.subtreeDepth() == 0:
        return F.lit(float(node.prediction()))
    split = node.split()
    return F.when(value(FEATURES[split.featureIndex()]) <= float(split.threshold()), _tree(node.leftChild(), value)).otherwise(_tree(node.rightChild(), value))


def train_pii_model(docs: DataFrame, text_col: str = "text", precision: float = 0.95, trees: int = 10) -> PiiModel:
    """Fit and calibrate the trees on the candidates of all documents.

    Alike examples are one row with their number as its weight.  A third of the texts, by
    a hash, is left out of the fit and calibrates.  Documents with only one class give a
    model that adds nothing.
    """
    fold = F.pmod(F.xxhash64(text_col), F.lit(3)).alias("__fold")
    based = with_base(docs.select(text_col, fold), text_col)
    base = F.concat(*[F.transform(f"__{k}", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))) for k in BASE])
    formats = r"^(?:[^@]+@[^@]+\.[^@]+|[0-9]+(?:\.[0-9]+){3}|[0-9](?:[\x20-]?[0-9]){12,18}|\+[0-9][\x20().0-9-]+[0-9])$"
    # explode() alone makes Spark find all candidates twice: first to ask whether a document has any.
    rows = based.select("__fold", F.explode_outer(_found(background=True)).alias("c"), base.alias("__base")).where("c IS NOT NULL")
    vouched = F.exists("__base", lambda b: (b["s"] < F.col("c.e")) & (b["e"] > F.col("c.s"))) | (F.col("c.g") == "named")
    rows = rows.withColumn("label", F.when(vouched, 1.0).otherwise(0.0)).where(
        (F.col("label") == 1.0) | ~F.col("c.m").rlike(formats)
    ).select("label", "c.g", F.col("__fold").alias("fold"), *[v.alias(k) for k, v in _features(F.col("c")).items()])
    # The fit and the calibration read the examples many times; they are made once.
    rows = write_scratch(rows.groupBy("label", "g", "fold", *FEATURES).agg(F.count(F.lit(1)).cast("double").alias("n")), "examples")
    fit = rows.where("fold > 0")
    classes = {r["label"] for r in fit.select("label").distinct().collect()}
    if len(classes) < 2:
        return PiiModel(None, {})
    assembled = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    model = GBTClassifier(maxIter=trees, maxDepth=3, maxBins=32, seed=3, labelCol="label", weightCol="n").fit(assembled.transform(fit))
    parts = [(w, t._call_java("rootNode")) for w, t in zip(model.treeWeights, model.trees)]

    def score(value: Callable[[str], Column]) -> Column:
        margin = sum((F.lit(float(w)) * _tree(root, value) for w, root in parts), F.lit(0.0))
        return 1 / (1 + F.exp(-2 * margin))

    bins = (
        rows.where("fold = 0").select("g", "label", "n", F.floor(score(F.col) * 20).alias("bin"))
        .groupBy("g", "bin").agg(F.sum(F.col("label") * F.col("n")).alias("good"), F.sum("n").alias("n")).collect()
    )
    thresholds = {}
    for g in GENERATORS:
        mine = sorted(((r["bin"], r["good"], r["n"]) for r in bins if r["g"] == g), reverse=True)
        best, good, n = 0.5, 0, 0
        for b, x, k in mine:
            good, n = good + x, n + k
            if good >= precision * n:
                best = min(best, b / 20)
        # Never below one half: what the left-out rows do not show is not redacted on a guess.
        thresholds[g] = max(0.5, best)
    return PiiModel(score, thresholds)


def _added_kind(x: Column) -> Column:
    n = x["n_digits"]
    return (
        F.when(x["g"] == "address", "email")
        .when((x["g"] == "number") & x["m"].rlike(r"^[0-9]+(?:\.[0-9]+){3}$"), "ip")
        .when((x["g"] == "number") & (x["starts_plus"] == 0) & (n >= 13), "card")
        .when(x["g"] == "number", "phone").otherwise("secret")
    )


def find_pii(docs: DataFrame, model: PiiModel, text_col: str = "text", spans_col: str = "pii") -> DataFrame:
    """``docs`` with ``spans_col``: array<struct<kind, start, end, base>>, by kind (KINDS), then start.

    Offsets are code points, end exclusive.  Base spans are those of the contract's
    patterns; kinds may overlap.  An added span overlaps no base span and no added
    span before it.  A null or empty text has none.  Other columns pass through.
    """
    docs = with_base(docs.drop(spans_col), text_col)
    keep = lambda kind: lambda x: F.struct(F.lit(KINDS.index(kind)).alias("k"), x["s"].alias("s"), x["e"].alias("e"), F.lit(True).alias("base"))
    docs = docs.withColumn("__base", F.concat(*[F.transform(f"__{kind}", keep(kind)) for kind in BASE]))
    none = F.array().cast("array<struct<k:int,s:int,e:int,base:boolean>>")
    added = none
    if model.score is not None:
        docs = with_candidates(docs)
        rank = lambda x: F.coalesce(*[F.when(_added_kind(x) == k, F.lit(i)) for i, k in enumerate(KINDS)])

        def chosen(x: Column) -> Column:
            cut = F.element_at(F.create_map(*[F.lit(v) for kv in model.thresholds.items() for v in kv]), x["g"])
            clear = ~F.exists("__base", lambda b: (b["s"] < x["e"]) & (b["e"] > x["s"]))
            return clear & (model.score(lambda name: x[name]) >= cut)

        docs = docs.withColumn("__chosen", F.array_sort(F.transform(
            F.filter("__cand", chosen), lambda x: F.struct(x["s"].alias("s"), (-x["e"]).alias("minus_e"), rank(x).alias("k")))))

        def step(at: Column, x: Column) -> Column:
            one = F.array(F.struct(x["k"].alias("k"), x["s"].alias("s"), (-x["minus_e"]).alias("e"), F.lit(False).alias("base")))
            return F.when(x["s"] < at["end"], at).otherwise(F.struct((-x["minus_e"]).alias("end"), F.concat(at["out"], one).alias("out")))

        added = F.aggregate("__chosen", F.struct(F.lit(0).alias("end"), none.alias("out")), step, lambda at: at["out"])
    names = F.array(*[F.lit(k) for k in KINDS])
    docs = docs.withColumn("__all", F.array_sort(F.concat("__base", added))).withColumn(spans_col, F.transform("__all", lambda x: F.struct(
        F.element_at(names, x["k"] + 1).alias("kind"), x["s"].alias("start"), x["e"].alias("end"), x["base"].alias("base"))))
    return docs.drop("__text", "__digit", "__base", "__cand", "__chosen", "__all", *[f"__{k}" for k in BASE])


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(docs: DataFrame, model: PiiModel, text_col: str = "text") -> DataFrame:
    """``docs`` with every span of the text replaced by its kind in brackets; overlapping spans become one."""
    found = find_pii(docs, model, text_col, "__pii")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(at: Column, x: Column) -> Column:
        gap = F.substring(F.col(text_col), at["at"] + 1, F.greatest(F.lit(0), x["start"] - at["at"]))
        fresh = F.when(x["start"] >= at["at"], F.concat(gap, F.lit("["), x["kind"], F.lit("]"))).otherwise("")
        return F.struct(F.greatest(at["at"], x["end"]).alias("at"), F.concat(at["out"], fresh).alias("out"))

    ordered = F.array_sort(F.transform("__pii", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
    done = F.aggregate(ordered, start, step, lambda at: F.concat(at["out"], F.substring(F.col(text_col), at["at"] + 1, F.length(text_col))))
    return found.withColumn(text_col, F.when(F.size("__pii") > 0, done).otherwise(F.col(text_col))).drop("__pii")
