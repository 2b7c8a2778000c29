"""Phrase mining, hard negatives and the language model against brute force, with odd rows."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from peerlens.llm import hard_negatives, phrases, recurrent_lm, vocabulary

SCHEMA = "doc_id long, text string, lang string, rank long, score double, n long, row long, code long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows and clashing column names."""
    rnd = random.Random(8)
    vocab = [f"W{i}" if i % 5 else f"é{i}" for i in range(30)]
    new = lambda n: "".join(rnd.choice(vocab) + rnd.choice((" ", " ", " ", "  ", ". ", "\t", "\n", ", ")) for _ in range(n))
    rows = [(i, new(rnd.randint(0, 80)), rnd.choice(("de", "en", None)), 1, 0.5, 2, 3, 4) for i in range(60)]
    rows += rows[:4] + [
        (None, new(20), "en", None, None, None, None, None), (None, None, None, None, None, None, None, None), (100, "", "fr", 1, 1.0, 1, 1, 1),
        (101, " \n\t. ", "fr", 1, 1.0, 1, 1, 1), (102, new(30_000), "en", 1, 1.0, 1, 1, 1), (103, "x" * 60_000, "en", 1, 1.0, 1, 1, 1),
        (104, "one", "und", 1, 1.0, 1, 1, 1), (105, "a b " * 40, None, 1, 1.0, 1, 1, 1),
    ]
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute_phrases(rows, top=2000, least=10):
    f, n = Counter(), Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for size in (1, 2, 3):
                f.update((lang or "und", *w[i : i + size]) for i in range(len(w) - size + 1))
    out = {}
    cand = {k: v for k, v in f.items() if len(k) > 2 and v >= least}
    for key, a in cand.items():
        lang, w = key[0], key[1:]
        if len(w) == 2 and any(k[0] == lang and len(k) == 4 and 100 * v >= 50 * a and w in (k[1:3], k[2:4]) for k, v in cand.items()):
            continue
        cuts = [(10**6 * a * a // (f[lang, *w[:k]] * f[lang, *w[k:]]), k, f[lang, *w[:k]], f[lang, *w[k:]]) for k in range(1, len(w))]
        score, _, l, r = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), l, r))
    return {
        (lang, i + 1, p.decode(), -a, l, r, n[lang], -s)
        for lang, found in out.items() for i, (s, a, p, l, r) in enumerate(sorted(found)[:top])
    }


@pytest.mark.parametrize("group_suffixes", [1 << 20, 400])
def test_collocations_equal_brute_force(odd, group_suffixes):
    """Also where most words, and pairs of words, are too heavy for a group and are extended."""
    got = phrases.collocations(odd, top=50, group_suffixes=group_suffixes).collect()
    want = brute_phrases([(r.text, r.lang) for r in odd.collect()], top=50)
    assert len(got) == len(want) > 50 and {tuple(r) for r in got} == want


def test_collocations_of_an_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert phrases.collocations(empty).count() == 0
    assert phrases.collocations(spark.createDataFrame([(1, None, None)], "doc_id long, text string, lang string")).count() == 0


def test_exact_phrase_score_beyond_64_bits(spark):
    """The score's products pass 64 bits: floor(1000000 a a / (l r)) with a of four billion."""
    a, l, r = 4_000_000_007, 4_000_000_009, 4_000_000_021
    rows = spark.createDataFrame([(a, l, r)], "a long, l long, r long")
    got = rows.select(phrases.score_of(F.col("a"), F.col("l"), F.col("r")).alias("s")).first().s
    assert got == 10**6 * a * a // (l * r)


def test_word_counts_name_each_word_once(odd):
    texts = odd.select(F.coalesce("lang", F.lit("und")).alias("part"), "text", F.lit(1).alias("counted"))
    words, _ = vocabulary.count_words(texts)
    got = {(r.part, r.word): r.n for r in words.collect()}
    want = Counter((r.lang or "und", w) for r in odd.collect() for w in WORD.findall(lower(r.text)))
    assert got == want and words.select("code").distinct().count() == len(want)


def test_hilbert_curve_visits_neighbours():
    """All points of a small grid: the keys differ and successive points are one step apart."""
    points = np.array([(a, b, c) for a in range(8) for b in range(8) for c in range(8)])
    keys = hard_negatives.hilbert_keys(points, bits=3)
    path = points[sorted(range(len(points)), key=lambda i: keys[i])]
    assert len(set(keys)) == 512 and (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_interval_bounds_hold():
    rng = np.random.default_rng(1)
    anchors, vectors = rng.integers(-9, 9, (20, 6)), rng.integers(-9, 9, (50, 6))
    low, high = hard_negatives.inner_bounds(anchors, vectors.min(0)[None], vectors.max(0)[None])
    scores = anchors @ vectors.T
    assert (low[:, 0] <= scores.min(1)).all() and (scores.max(1) <= high[:, 0]).all()


def brute_negatives(rows, step=7, positives=5, negatives=10):
    q = {}
    for i, vec, label in rows:
        if i is None or label is None or vec is None or any(x is None or not math.isfinite(x) for x in vec):
            continue
        q[i, label, tuple(math.floor(256 * x) for x in vec)] = None
    size = max((len(v) for _, _, v in q), default=0)
    q = [(i, label, np.array(v + (0,) * (size - len(v)), dtype=object)) for i, label, v in q]
    out = []
    for i, label, v in q:
        if i % step:
            continue
        scored = [(-int((v * w).sum()), j, other) for j, other, w in q]
        for s, j, _ in sorted(x for x in scored if x[2] == label and x[1] != i)[:positives]:
            fits = [x for x in scored if x[2] != label and 30 * -s <= 100 * -x[0] <= 90 * -s]
            out += [(i, j, k + 1, y, -s, -t) for k, (t, y, _) in enumerate(sorted(fits)[:negatives])]
    return sorted(out)


def mined(df, **kw):
    return sorted(tuple(r) for r in hard_negatives.hard_negatives(df, F.col("vec_id") % 7 == 0, **kw).collect())


EMBEDDINGS = "vec_id long, embedding array<float>, label int, id long, score long, part int"


def test_hard_negatives_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", 16)
    rnd = random.Random(5)
    centres = [[rnd.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    rows = []
    for i in range(300):
        c = rnd.choice(centres)
        rows.append((i, [float(np.float32(x + rnd.gauss(0, 0.4))) for x in c], rnd.randint(0, 3), 1, 2, 3))
    copies = [(500 + i, rows[0][1], i % 4, 1, 2, 3) for i in range(80)]  # ties, and a group of copies
    odd = [
        (None, [1.0] * 6, 1, 1, 1, 1), (900, None, 1, 1, 1, 1), (901, [1.0] * 6, None, 1, 1, 1), (902, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1, 1, 1, 1),
        (903, [float("nan")] * 6, 1, 1, 1, 1), (904, [float("inf")] + [0.0] * 5, 1, 1, 1, 1), (910, [], 1, 1, 1, 1), (917, [0.5, 0.5], 2, 1, 1, 1),
        (7, rows[20][1], 9, None, None, None), (924, [0.0] * 6, 1, None, None, None), (931, [-1.0] * 6, 77, None, None, None),
    ]
    rows += copies + odd + rows[:9]
    got = mined(spark.createDataFrame(rows, EMBEDDINGS).repartition(4))
    want = brute_negatives([r[:3] for r in rows])
    assert len(got) > 500 and got == want


def test_zones_leave_blocks_unread(spark, monkeypatch):
    """In clustered data few blocks are chosen, and the result is the same."""
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", 32)
    chosen = []
    plain = hard_negatives._read_for
    monkeypatch.setattr(hard_negatives, "_read_for", lambda tasks, *a: (chosen.append(tasks.count()), plain(tasks, *a))[1])
    rng = np.random.default_rng(3)
    rows = []
    for i in range(1200):
        v = np.zeros(4)
        v[i % 4] = 10 + rng.normal() * 0.1
        rows.append((i, [float(np.float32(x)) for x in v + rng.normal(size=4) * 0.01], i // 4 % 2, 0, 0, 0))
    df = spark.createDataFrame(rows, EMBEDDINGS)
    got = sorted(tuple(r) for r in hard_negatives.hard_negatives(df, F.col("vec_id") % 100 == 0, ceil_pct=101).collect())
    assert len(got) == 12 * 5 * 10
    pairs = 12 * (1200 // 32 + 1)
    assert chosen[-1] < pairs / 2


def test_vectors_are_not_sent_for_each_pair(spark, monkeypatch):
    """What is chosen is some bits for each tile and block, however many blocks an anchor meets; no side with vectors is broadcast."""
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", 16)
    monkeypatch.setattr(hard_negatives, "RUN_BYTES", 16 * 16 * 4 * 3, raising=False)
    monkeypatch.setattr(hard_negatives, "CROWD_BYTES", 1, raising=False)
    chosen, plans = [], []
    plain = hard_negatives._read_for

    def read_for(tasks, *rest):
        rows = tasks.collect()
        chosen.append((len(rows), sum(len(v) for r in rows for v in r if isinstance(v, (bytes, bytearray)))))
        out = plain(tasks, *rest)
        plans.append(out._jdf.queryExecution().optimizedPlan().toString())
        return out

    monkeypatch.setattr(hard_negatives, "_read_for", read_for)
    rng = np.random.default_rng(8)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=16)], int(rng.integers(3)), 0, 0, 0) for i in range(400)]
    assert mined(spark.createDataFrame(rows, EMBEDDINGS)) == brute_negatives([r[:3] for r in rows])
    assert chosen and all(n and size <= 32 * n for n, size in chosen)  # an anchor has a bit, of 64 bytes of vector each
    assert all("strategy=merge" in p for p in plans)


def test_hard_negatives_of_empty_and_one_sided_tables(spark):
    assert mined(spark.createDataFrame([], EMBEDDINGS)) == []
    assert mined(spark.createDataFrame([(0, [1.0], 1, 0, 0, 0), (7, [1.0], 1, 0, 0, 0)], EMBEDDINGS)) == []
    assert mined(spark.createDataFrame([(0, [], 1, 0, 0, 0), (7, [], 1, 0, 0, 0)], EMBEDDINGS)) == []


# Language model -----------------------------------------------------------------


def learns():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10 != 0


def small_vocabulary(n_words, monkeypatch=None):
    rng = np.random.default_rng(2)
    counts = np.sort(rng.integers(1, 1000, n_words))[::-1]
    counts = np.concatenate(([50], counts))
    own = min(40, len(counts))
    classes = np.minimum(np.arange(own) // 6, 5)
    starts = np.searchsorted(classes, np.arange(classes.max() + 2))
    return recurrent_lm.Vocabulary(
        np.arange(1, n_words + 1).astype(np.uint64), np.arange(1, n_words + 1), counts, np.concatenate((classes, starts.size - 1 + np.arange(2))),
        starts, np.array([own, len(counts)]), np.array([int(counts[own:].sum()), 30]), 5, int(counts.sum()) + 30, n_words + 5, 0,
    )


def test_probabilities_add_up_to_one():
    v = small_vocabulary(60)
    w = recurrent_lm.first_weights(v, 8)
    states = np.random.default_rng(1).normal(size=(1, 8)).astype(np.float32)
    inputs = np.arange(len(v.class_of), dtype=np.int32)
    p = np.exp(recurrent_lm._log_p(w, v, np.repeat(states, len(inputs), 0), inputs))
    assert p.sum() == pytest.approx(1, abs=1e-5)


def test_gradient_against_differences():
    """One step of training moves each weight against the slope of the loss over a window."""
    v = small_vocabulary(60)
    w = recurrent_lm.first_weights(v, 4)
    rng = np.random.default_rng(4)
    w = {k: (x + rng.normal(size=x.shape) * 0.1).astype(np.float32) for k, x in w.items()}
    stream = rng.integers(1, len(v.class_of), recurrent_lm.WINDOW).astype(np.int32)
    stream[10] = 0

    def loss(weights):
        weights = {k: x.astype(np.float64) for k, x in weights.items()}
        sizes = np.array([11, len(stream) - 11 + 1])
        total = recurrent_lm.score_texts(weights, v, np.append(stream, 0), sizes).sum()
        states, h, x = [], np.zeros((1, 4)), np.array([0])
        for y in stream:
            h = np.where(x[:, None] == 0, 0.0, h)
            h = recurrent_lm._gates(weights, x, h)[-1]
            states.append(h[0])
            x = np.array([y])
        h = np.where(x[:, None] == 0, 0.0, h)
        last = recurrent_lm._log_p(weights, v, recurrent_lm._gates(weights, x, h)[-1], np.array([0]))[0]
        assert recurrent_lm._log_p(weights, v, np.array(states), stream).sum() + last == pytest.approx(total, rel=1e-4)
        return -recurrent_lm._log_p(weights, v, np.array(states), stream).mean()

    moved = recurrent_lm.train_on(w, v, stream)
    checked = 0
    for k in w:
        move = (moved[k] - w[k]).ravel()
        for i in np.argsort(-np.abs(move))[:6]:
            up, down = ({n: x.astype(np.float64).copy() for n, x in w.items()} for _ in range(2))
            up[k].ravel()[i] += 1e-4
            down[k].ravel()[i] -= 1e-4
            slope = (loss(up) - loss(down)) / 2e-4
            # Of one step from even squares: step * g / sqrt(1e-4 + g * g).
            assert move[i] == pytest.approx(-recurrent_lm.STEP * slope / math.sqrt(1e-4 + slope * slope), rel=0.02, abs=2e-5)
            checked += 1
    assert checked == 36


def test_lanes_do_not_change_scores():
    v = small_vocabulary(60)
    w = recurrent_lm.first_weights(v, 8)
    rng = np.random.default_rng(6)
    sizes = np.array([1, 70, 3, 1, 500, 33, 32, 31, 2] * 9)
    numbers = np.concatenate([np.append(rng.integers(1, len(v.class_of), n - 1), 0) for n in sizes]).astype(np.int32)
    together = recurrent_lm.score_texts(w, v, numbers, sizes)
    at = np.concatenate(([0], np.cumsum(sizes)))
    alone = [recurrent_lm.score_texts(w, v, numbers[a:b], np.array([b - a]))[0] for a, b in zip(at, at[1:])]
    assert together == pytest.approx(alone, rel=1e-5)


def test_base_scores_equal_brute_force(odd, monkeypatch):
    """Also with few known words, so that most meet their counts in the join."""
    rows = odd.collect()
    learned = [r for r in rows if zlib.crc32(str(r.doc_id if r.doc_id is not None else "").encode()) % 10]
    c = Counter(w for r in learned for w in [*WORD.findall(lower(r.text)), None])
    n, v = sum(c.values()), len(c)
    for known, own in ((1 << 16, 4095), (12, 5)):
        monkeypatch.setattr(recurrent_lm, "KNOWN_WORDS", known)
        monkeypatch.setattr(recurrent_lm, "OWN_WORDS", own)
        got = recurrent_lm.score_documents(odd, learns(), share=0.5).collect()
        assert len(got) == len(rows) and {"lang", "rank", "row", "code"} <= set(got[0].asDict())
        want = []
        for r in rows:
            tokens = [*WORD.findall(lower(r.text)), None]
            base = sum(math.log10((c[t] + 0.1) / (n + 0.1 * (v + 1))) for t in tokens)
            want.append((r.doc_id or -1, len(tokens), sum(c[t] > 0 for t in tokens), n, round(base, 5)))
        assert sorted((r.doc_id or -1, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == sorted(want)
        assert all(math.isfinite(r.score) and r.score < 0 for r in got)


def test_language_model_of_odd_tables(spark, odd):
    empty = spark.createDataFrame([], SCHEMA)
    assert recurrent_lm.score_documents(empty, learns()).count() == 0
    named = odd.withColumns({"a b": F.lit(1), "score": F.lit("mine"), "x.y": F.array(F.lit(1))})
    rows = recurrent_lm.score_documents(named.where("doc_id < 20"), F.lit(False)).collect()
    assert {"a b", "x.y"} <= set(rows[0].asDict()) and isinstance(rows[0]["score"], float)
    assert rows and all(r.n_known == 0 and r.train_tokens == 0 for r in rows)


def test_the_model_learns_order(spark):
    """On held-out texts of a language in which words follow one another, the state must help."""
    rnd = random.Random(2)
    step = {i: [rnd.randrange(50) for _ in range(2)] for i in range(50)}

    def text():
        w, out = rnd.randrange(50), []
        for _ in range(200):
            out.append(f"w{w}")
            w = rnd.choice(step[w])
        return " ".join(out)

    docs = spark.createDataFrame([(i, text()) for i in range(600)], "doc_id long, text string").coalesce(1)
    held = [r for r in recurrent_lm.score_documents(docs, learns(), share=1.0).collect() if zlib.crc32(str(r.doc_id).encode()) % 10 == 0]
    score, base = (sum(r[k] for r in held) / sum(r.n_tokens for r in held) for k in ("score", "base_score"))
    assert score > 0.75 * base


def test_pii_learns_from_every_document(spark, monkeypatch):
    """No document and no long word is left out of the examples."""
    from peerlens.llm import pii

    kept, plain = [], pii.write_scratch
    monkeypatch.setattr(pii, "write_scratch", lambda df, name: (kept.append(plain(df, name)), kept[-1])[1])
    texts = [(f"an incomprehensible{chr(97 + i % 26)}{chr(97 + i // 26 % 26)} word, mail to user{i}@example.org now",) for i in range(6000)]
    pii.train_pii_model(spark.createDataFrame(texts, "text string").repartition(4))
    seen = {r["g"]: r["n"] for r in kept[0].groupBy("g").agg(F.sum("n").alias("n")).collect()}
    assert seen["word"] == 6000 and seen["address"] == 6000


def test_pii_examples_are_found_once(spark, monkeypatch):
    """The scan of the training does not look for all candidates a second time, to ask whether there are any."""
    from peerlens.llm import pii

    plans, plain = [], pii.write_scratch
    monkeypatch.setattr(pii, "write_scratch", lambda df, name: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), plain(df, name))[1])
    pii.train_pii_model(spark.createDataFrame([("nothing to see here",)], "text string"))
    assert plans[0].count("regexp_extract_all(__text#") + plans[0].count("regexp_extract_all(coalesce(") == len(pii.BASE) + len(pii.GENERATORS) + 1


def test_recurrent_model_trains_on_every_stream(spark, monkeypatch):
    """The default leaves no document out of the weights' training."""
    kept, plain = [], recurrent_lm.write_scratch
    monkeypatch.setattr(recurrent_lm, "write_scratch", lambda df, name: (kept.append((name, plain(df, name))), kept[-1][1])[1])
    docs = spark.createDataFrame([(i, f"one two three number{i % 50}") for i in range(400)], "doc_id long, text string").repartition(2)
    recurrent_lm.score_documents(docs, F.lit(True)).count()
    streams = next(t for name, t in kept if name == "streams")
    assert sum(len(r["numbers"]) // 4 for r in streams.collect()) == 400 * 5


def test_scoring_holds_few_bytes_a_word(monkeypatch):
    """Until texts are scored together, a known word takes a few bytes, and nothing as wide as all words meets at the end."""
    import tracemalloc
    from dataclasses import replace
    from types import SimpleNamespace

    import pyarrow as pa

    monkeypatch.setattr(recurrent_lm, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    text = " ".join(f"number{i % 60:06}" for i in range(1000))
    code = next(recurrent_lm._numbered(small_vocabulary(60), pa.array([text])))[1]
    v = replace(small_vocabulary(60), codes=np.unique(code))
    w = recurrent_lm.first_weights(v, 4)
    batch = pa.record_batch({"kept": pa.array(range(100)), "text": pa.array([text] * 100)})
    run = recurrent_lm._scorer(v, recurrent_lm.pack(w), w, "kept")
    tracemalloc.start()
    try:
        rows = sum(b.num_rows for b in run(iter([batch] * 24)))
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert rows == 2400 and most < 40 * 2.4e6
