"""Collocations: phrases that occur together more often than their parts would.

The corpus' suffix tree, cut at a depth of three words, is built in parts.  A vertical
partitioning chooses them: the suffixes below a word prefix go to one group, and a prefix
that heads more suffixes than a share of a group's memory budget is extended by the next
word, and once more, until what it heads fits.  Prefixes are dealt out to as many groups
as the budget asks for.  Suffixes that are equal are added up in the task that reads them,
so what a prefix brings to its group are distinct suffixes of each task.  Each group then
builds its subtrees on its own: it sorts its suffixes, and a node's count is the total of
the leaves below it.

Words are 64-bit numbers that belong to one word of one language alone (``vocabulary``),
so all counts are exact.  A prefix of two words that was extended is counted when that is
decided, and needs no sum over groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, mix, shuffle_parts, text_bytes, write_scratch
from .vocabulary import coded_words, count_words, part_codes

#: Suffixes in the memory budget of a group (about 28 bytes each, three times so while they are sorted).
GROUP_SUFFIXES = 1 << 20
#: Words whose suffixes a task adds up before it hands them on.
HELD_WORDS = 1 << 19
#: Parts of a language whose phrases are ranked apart before all are.
PARTS = 64

#: Bytes that end a piece: . , ; : ! ? and \n to \r.
BREAKS = np.zeros(256, dtype=bool)
BREAKS[list(b".,;:!?\n\x0b\x0c\r")] = True

_STEP = np.uint64(0x9E3779B97F4A7C15)


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * _STEP + (b ^ (b >> np.uint64(29))))


def _coded(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Three arrays: each word's code and those of the next two in its piece (0: none)."""
    held, size = [], 0
    for batch in batches:
        data, offsets = text_bytes(batch.column("text"))
        parts = part_codes(batch.column("part"), seed)
        for a, b in chunks(offsets):
            code, doc, piece, _, _ = coded_words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], parts[a:b], seed, BREAKS)
            if not len(code):
                continue
            follows = (doc[1:] == doc[:-1]) & (piece[1:] == piece[:-1])
            second = np.zeros(len(code), np.uint64)
            second[:-1] = np.where(follows, code[1:], np.uint64(0))
            third = np.zeros(len(code), np.uint64)
            third[:-2] = np.where(follows[:-1] & follows[1:], code[2:], np.uint64(0))
            held.append((code, second, third))
            size += len(code)
            if size >= HELD_WORDS:
                yield tuple(np.concatenate(x) for x in zip(*held))
                held, size = [], 0
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held))


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(values), dtype=bool)
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return known[at] == values


def _heavy_pairs(seed: int, heavy: np.ndarray):
    """Counts of the pairs of adjacent words that are both heavy."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for one, two, _ in _coded(batches, seed):
            some = _among(one, heavy) & _among(two, heavy)
            pairs, n = np.unique(np.stack((one[some], two[some]), axis=1), axis=0, return_counts=True)
            yield pa.record_batch({
                "c1": pa.array(pairs[:, 0].copy().view(np.int64)), "c2": pa.array(pairs[:, 1].copy().view(np.int64)), "n": pa.array(n.astype(np.int64)),
            })

    return run


def _suffixes(seed: int, n_groups: int, heavy: np.ndarray, heavy_pairs: np.ndarray):
    """The distinct suffixes of two and three words with their counts, as one row for each group.

    A row holds the first words as runs, since a group's suffixes are ordered by them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for one, two, three in _coded(batches, seed):
            more = two != 0
            one, two, three = one[more], two[more], three[more]
            if not len(one):
                continue
            both = _pair(one, two)
            prefix = np.where(_among(one, heavy), both, mix(one))
            prefix = np.where(_among(both, heavy_pairs), _pair(both, three), prefix)
            group = (prefix >> np.uint64(8)) % np.uint64(n_groups)
            # Group, some bits of the first word, some of the whole suffix: equal ones come together.
            bits = np.uint64(max(1, int(n_groups - 1).bit_length()))
            whole = _pair(both, three)
            key = (group << (np.uint64(64) - bits)) | (one >> np.uint64(44) << (np.uint64(44) - bits)) | (whole >> (np.uint64(20) + bits))
            order = np.argsort(key)
            one, two, three, group = one[order], two[order], three[order], group[order]
            new = np.ones(len(one), dtype=bool)
            new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1]) | (three[1:] != three[:-1])
            at = np.flatnonzero(new)
            n = np.diff(np.append(at, len(one))).astype(np.uint32)
            one, two, three, group = one[at], two[at], three[at], group[at]
            edge = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
            rows: dict[str, list] = {"grp": [], "heads": [], "runs": [], "c2": [], "c3": [], "n": []}
            for a, b in zip(edge, np.append(edge[1:], len(one))):
                begin = np.flatnonzero(np.concatenate(([True], one[a + 1 : b] != one[a : b - 1])))
                rows["grp"].append(int(group[a]))
                rows["heads"].append(one[a:b][begin].tobytes())
                rows["runs"].append(np.diff(np.append(begin, b - a)).astype(np.uint32).tobytes())
                rows["c2"].append(two[a:b].tobytes())
                rows["c3"].append(three[a:b].tobytes())
                rows["n"].append(n[a:b].tobytes())
            yield pa.record_batch([pa.array(rows["grp"], pa.int32())] + [pa.array(rows[k], pa.binary()) for k in list(rows)[1:]], names=list(rows))

    return run


def _subtree(least: int, heavy_pairs: np.ndarray):
    """The nodes of a group's subtrees that head at least ``least`` leaves."""

    def run(table: pa.Table) -> pa.Table:
        def column(name: str, kind) -> np.ndarray:
            return np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in table.column(name)])

        one = np.repeat(column("heads", np.uint64), column("runs", np.uint32))
        two, three, n = column("c2", np.uint64), column("c3", np.uint64), column("n", np.uint32).astype(np.int64)
        order = np.lexsort((three, two, one))
        one, two, three, n = one[order], two[order], three[order], n[order]
        deep = np.concatenate(([True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])))
        at2 = np.flatnonzero(deep)
        at3 = np.flatnonzero(np.concatenate(([True], deep[1:] | (three[1:] != three[:-1]))))
        n2, n3 = np.add.reduceat(n, at2), np.add.reduceat(n, at3)
        # Extended pairs lie in several groups and are counted already.
        at2, n2 = (x[(n2 >= least) & ~_among(_pair(one[at2], two[at2]), heavy_pairs)] for x in (at2, n2))
        at3, n3 = (x[(n3 >= least) & (three[at3] != 0)] for x in (at3, n3))
        third = np.concatenate((np.zeros(len(at2), np.uint64), three[at3]))
        at = np.concatenate((at2, at3))
        columns = [one[at].view(np.int64), two[at].view(np.int64), third.view(np.int64), np.concatenate((n2, n3))]
        return pa.table(dict(zip(("c1", "c2", "c3", "f"), map(pa.array, columns))))

    return run


def phrase_counts(texts: DataFrame, seed: int, vocabulary: DataFrame, least: int, group_suffixes: int = GROUP_SUFFIXES) -> DataFrame:
    """c1, c2, c3, f: phrases of two (c3 0) and three words that occur ``least`` times or more.

    ``vocabulary`` is what ``count_words`` returns for the same ``texts``.  The heavy words
    that reach the driver are at most 4 / group_suffixes of all words of the corpus, one
    for each quarter of a group.
    """
    limit = max(1, group_suffixes // 4)
    total = vocabulary.agg(F.sum("n")).first()[0] or 0
    n_groups = max(shuffle_parts(texts.sparkSession), -(-2 * total // group_suffixes))
    codes = lambda rows: np.sort(np.array([r[0] for r in rows], np.int64).view(np.uint64))
    heavy = codes(vocabulary.where(F.col("n") > limit).select("code").collect())
    extended, pairs = None, np.zeros(0, np.uint64)
    if len(heavy):
        extended = write_scratch(
            texts.mapInArrow(_heavy_pairs(seed, heavy), "c1 long, c2 long, n long")
            .groupBy("c1", "c2").agg(F.sum("n").alias("f")).where(F.col("f") > limit),
            "pairs",
        )
        rows = np.array([(r.c1, r.c2) for r in extended.collect()], np.int64).reshape(-1, 2).view(np.uint64)
        pairs = np.sort(_pair(rows[:, 0], rows[:, 1]))
    suffixes = texts.mapInArrow(_suffixes(seed, n_groups, heavy, pairs), "grp int, heads binary, runs binary, c2 binary, c3 binary, n binary")
    nodes = suffixes.groupBy("grp").applyInArrow(_subtree(least, pairs), "c1 long, c2 long, c3 long, f long")
    if extended is not None:
        nodes = nodes.unionByName(extended.where(F.col("f") >= least).select("c1", "c2", F.lit(0).cast("long").alias("c3"), "f"))
    return write_scratch(nodes, "phrases")


def score_of(a: Column, l: Column, r: Column) -> Column:  # noqa: E741
    """floor(1000000 a a / (l r)) in decimals of 38 digits, exact while a is below 10 ** 15."""
    top = F.lit(1_000_000).cast("decimal(7,0)") * a.cast("decimal(15,0)") * a.cast("decimal(15,0)")
    return F.call_function("div", top, l.cast("decimal(18,0)") * r.cast("decimal(18,0)"))


def collocations(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 10, top: int = 2000,
    inside_pct: int = 50, group_suffixes: int = GROUP_SUFFIXES,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``top`` phrases of two or three words.

    A-Z count as a-z.  Phrases do not cross . , ; : ! ? or line ends.  a is how often the
    phrase occurs, n the words of the language; l and r belong to the cut with the lowest
    score floor(1000000 a a / (l r)), the first of equal ones.  Phrases of fewer than
    ``least`` occurrences do not count, and a phrase goes if one of three words holds it
    and occurs ``inside_pct`` percent as often or more.  Order: score and a descending,
    then the phrase by its bytes.

    A null language is ``und``, a null or empty text has no words, repeated rows count
    each time, other columns are not read; an empty table gives no rows.
    """
    texts = docs.select(
        F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("part"), F.col(text_col).alias("text"), F.lit(1).alias("counted")
    )
    vocabulary, seed = count_words(texts, BREAKS)
    nodes = phrase_counts(texts, seed, vocabulary, least, group_suffixes)
    known = vocabulary.where(F.col("n") >= least)
    word = lambda k: known.select(F.col("code").alias(f"c{k}"), F.col("word").alias(f"w{k}"), F.col("n").alias(f"f{k}"))
    two = nodes.where("c3 = 0").select("c1", "c2", "f")
    three = nodes.where("c3 <> 0")
    # How often the most frequent longer phrase around a pair occurs.
    around = (
        three.select("c1", "c2", "f").unionByName(three.select(F.col("c2").alias("c1"), F.col("c3").alias("c2"), "f"))
        .groupBy("c1", "c2").agg(F.max("f").alias("around"))
    )
    pairs = (
        two.join(around, ["c1", "c2"], "left")
        .where(F.col("around").isNull() | (100 * F.col("around") < inside_pct * F.col("f")))
        .join(word(1), "c1").join(word(2), "c2")
        .select("c1", F.concat_ws(" ", "w1", "w2").alias("phrase"), F.col("f").alias("a"), F.array(F.struct(F.col("f1").alias("l"), F.col("f2").alias("r"))).alias("cuts"))
    )
    head = two.select("c1", "c2", F.col("f").alias("head"))
    tail = two.select(F.col("c1").alias("c2"), F.col("c2").alias("c3"), F.col("f").alias("tail"))
    triples = (
        three.join(head, ["c1", "c2"]).join(tail, ["c2", "c3"]).join(word(1), "c1").join(word(2).drop("f2"), "c2").join(word(3), "c3")
        .select(
            "c1", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), F.col("f").alias("a"),
            F.array(F.struct(F.col("f1").alias("l"), F.col("tail").alias("r")), F.struct(F.col("head").alias("l"), F.col("f3").alias("r"))).alias("cuts"),
        )
    )
    scored = pairs.unionByName(triples).select(
        "c1", "phrase", "a",
        # The first of equal scores: cuts are in order of k.
        F.array_min(F.transform("cuts", lambda c, k: F.struct(score_of(F.col("a"), c["l"], c["r"]).alias("score"), k.alias("k"), c["l"].alias("l"), c["r"].alias("r")))).alias("cut"),
    )
    langs = known.select(F.col("code").alias("c1"), F.col("part").alias("lang"))
    totals = vocabulary.groupBy(F.col("part").alias("lang")).agg(F.sum("n").alias("n"))
    first = [F.col("score").desc(), F.col("a").desc(), "phrase"]
    # A language's first ones are among the first of its parts, however many tasks hand on theirs.
    part = Window.partitionBy("lang", "part").orderBy(*first)
    order = Window.partitionBy("lang").orderBy(*first)
    return (
        scored.join(langs, "c1").select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score", F.pmod(F.hash("phrase"), F.lit(PARTS)).alias("part"))
        .withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= top)
        .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
        .join(totals, "lang")
        .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
    )
