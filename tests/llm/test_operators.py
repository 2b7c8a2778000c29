"""The text operators against brute force, round trips and held-out accuracy, on small tables with odd rows."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from peerlens.llm import (
    decontamination, fuzzy_passages, language_id, mixing, ngram_join, pii, quality, sharding, substring_removal, tokens,
)

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n long, size long, key string, kept boolean"


def words(n, rnd, letters="abcdeé"):
    return " ".join("".join(rnd.choice(letters) for _ in range(rnd.randint(1, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows, near copies, clashing column names."""
    rnd = random.Random(4)
    base = [words(rnd.randint(30, 200), rnd) for _ in range(12)]
    rows = []
    for i in range(60):
        w = rnd.choice(base).split(" ")
        for _ in range(rnd.choice((0, 0, 1, 2, 8))):
            w[rnd.randrange(len(w))] = words(1, rnd)
        rows.append((i, " ".join(w), rnd.choice(("de", "en", "fr", None)), rnd.choice(("a", "b", None)), i, 7, "k", True))
    rows += rows[:3]
    rows += [
        (100, None, "en", "a", None, None, None, None), (101, "", None, None, 1, 1, "", False), (102, " \n\t ", "en", "b", 1, 1, "", False),
        (None, base[0], "en", "a", 1, 1, "", True), (None, None, None, None, None, None, None, None), (103, "one", "fr", "c", 1, 1, "", True),
        (104, words(30_000, rnd), "de", "a", 1, 1, "", True), (105, "x" * 50_000, "de", "a", 1, 1, "", True), (106, "one", "fr", "c", 1, 1, "", True),
    ]
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_longest_matches_and_merge():
    rnd = random.Random(1)
    runs = [sorted(bytes(rnd.choice(b"ab") for _ in range(rnd.randint(0, 9))) for _ in range(rnd.randint(0, 40))) for _ in range(7)]
    coded = [iter(list(zip(*substring_removal.front_code(r)))) for r in runs]
    merged = list(substring_removal.merge_runs(coded))
    assert [s for _, s, _ in merged] == sorted(s for r in runs for s in r)
    for (_, x, _), (_, y, shared) in zip(merged, merged[1:]):
        assert shared == substring_removal.common_prefix(x, y, 0)
    for _ in range(60):
        n, length = rnd.randint(2, 9), 6
        items = sorted((b"aa" + bytes(rnd.choice(b"ab") for _ in range(rnd.randint(0, 5))), bytes(rnd.choice(b"ab") for _ in range(rnd.randint(0, 4)))) for _ in range(n))
        cp = substring_removal.common_prefix
        right = [0] + [cp(items[i - 1][0], items[i][0], 0) for i in range(1, n)]
        got = substring_removal.longest_matches(right, [x[1] for x in items], length)
        for i, (a, b) in enumerate(items):
            ok = [(cp(b, q, 0), cp(a, p, 0)) for j, (p, q) in enumerate(items) if j != i]
            ok = [(x, y) for x, y in ok if x + y >= length]
            assert got[i] == ((max(x for x, _ in ok), max(y for _, y in ok)) if ok else (0, 0))


def brute_removal(texts, length):
    count = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[i : i + length] = b"\x01" * length
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = sum(1 for j in range(len(t)) if gone[j] and (j == 0 or not gone[j - 1]))
        out.append((len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def test_substring_removal(odd, empty):
    rows = substring_removal.removal_digest(odd.where("doc_id <> 104 OR doc_id IS NULL"), length=60).collect()
    want = brute_removal([(r.text or "").encode() for r in rows], 60)
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows] == want
    assert any(r.n_removed for r in rows) and len(rows) == odd.count() - 1
    assert substring_removal.remove_repeats(empty).columns[:8] == empty.columns
    assert substring_removal.removal_digest(empty).count() == 0


def test_fuzzy_passages(spark, docs, odd, empty):
    found = fuzzy_passages.find_fuzzy_passages(docs).collect()
    texts = {r.doc_id: WORD.findall(r.text.lower()) for r in docs.collect()}
    for r in found:
        assert min(r.end - r.start, r.other_end - r.other_start) >= 40 and r.similarity >= 0.75 and r.doc_id != r.other_id
        x, y = texts[r.doc_id][r.start : r.end], texts[r.other_id][r.other_start : r.other_end]
        assert fuzzy_passages.equal_words(np.array(x[:150]), np.array(y[:150])) >= 0.5 * min(len(x), len(y), 150)
    runs = {}
    for i, w in texts.items():
        for k in range(len(w) - 50):
            runs.setdefault(tuple(w[k : k + 51]), set()).add(i)
    shared = set().union(*[v for v in runs.values() if len(v) > 1])
    assert shared and shared <= {r.doc_id for r in found}
    assert fuzzy_passages.find_fuzzy_passages(odd).count() > 0
    assert fuzzy_passages.find_fuzzy_passages(empty).count() == 0


def test_chain_equals_quadratic_search():
    rnd = random.Random(3)
    cost = fuzzy_passages.GAP_COST
    for _ in range(50):
        parts = sorted({(rnd.randint(0, 60), rnd.randint(0, 60), rnd.randint(5, 9), 1) for _ in range(12)})
        best = [float(p[2]) for p in parts]
        for i, (x, y, n, _) in enumerate(parts):
            for j, (u, v, m, _) in enumerate(parts):
                if u + m <= x and v + m <= y:
                    best[i] = max(best[i], n + best[j] - cost * (x - u - m + y - v - m))
        first = fuzzy_passages.chain(parts)[0]
        value = sum(parts[i][2] for i in first) - sum(
            cost * (parts[b][0] - parts[a][0] - parts[a][2] + parts[b][1] - parts[a][1] - parts[a][2]) for a, b in zip(first, first[1:]))
        assert value == pytest.approx(max(best))


def test_passages_around_a_unique_body_are_found(spark):
    """A header and a footer that both documents have, with bodies of their own between, are two passages."""
    rnd = random.Random(21)
    new = lambda n: [f"w{rnd.randrange(10**9)}" for _ in range(n)]
    for size, one, two in ((60, 150, 150), (60, 90, 140), (60, 250, 180), (300, 1500, 1100)):
        head, foot = new(size), new(size)
        rows = [(1, " ".join(head + new(one) + foot)), (2, " ".join(head + new(two) + foot))]
        found = fuzzy_passages.find_fuzzy_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        n = {1: 2 * size + one, 2: 2 * size + two}
        for r in found:
            assert r.similarity >= 0.95
        for first in (True, False):
            assert any(
                all(b <= 3 and e >= size - 3 if first else b <= n[d] - size + 3 and e >= n[d] - 3
                    for d, b, e in ((r.doc_id, r.start, r.end), (r.other_id, r.other_start, r.other_end)))
                for r in found
            ), (size, one, two, first)


def test_passages_whose_seeds_all_begin_elsewhere_are_found(spark):
    """Of texts that share two seeds' worth of words, every pair with a passage is in one class, whichever comes first."""
    rnd = random.Random(5)
    new = lambda n: [f"w{rnd.randrange(10**9)}" for _ in range(n)]
    line, passages = new(16), [new(60) for _ in range(6)]
    # A line in all texts; each passage, with the line in its midst, in two of them; the others have the line alone.
    rows = [(2 * i + k, new(30) + p[:30] + line + p[30:] + new(30)) for i, p in enumerate(passages) for k in (0, 1)]
    rows += [(100 + i, new(50) + line + new(50)) for i in range(60)]
    # Pieces of every passage stand alone in further texts, so that these may come first at any seed.
    pieces = [p[a : a + 16] for p in passages for a in range(0, 48, 4)]
    rows += [(200 + i, new(40) + p + new(40)) for i, p in enumerate(pieces * 20)]
    found = fuzzy_passages.find_fuzzy_passages(spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")).collect()
    assert {frozenset((r.doc_id, r.other_id)) for r in found} == {frozenset((2 * i, 2 * i + 1)) for i in range(6)}
    for r in found:
        assert r.start <= 33 and r.end >= 103 and r.similarity >= 0.9


def test_a_written_step_leaves_no_shuffle_files(spark):
    live = spark.sparkContext._jsc.sc().env().mapOutputTracker().shuffleStatuses().size
    spark.sparkContext._jvm.System.gc()
    time.sleep(2)  # files go in the background
    before = live()
    for _ in range(4):
        assert fuzzy_passages.write_scratch(spark.range(100).repartition(3, "id"), "step").count() == 100
    time.sleep(2)
    assert live() - before < 3


def test_chains_are_aligned_some_at_a_time(spark, docs, monkeypatch):
    some = docs.where("doc_id % 6 = 0")
    want = Counter(fuzzy_passages.find_fuzzy_passages(some).collect())
    monkeypatch.setattr(fuzzy_passages, "SENT_BLOCKS", 100)
    monkeypatch.setattr(fuzzy_passages, "SENT_TIMES", 0)
    assert Counter(fuzzy_passages.find_fuzzy_passages(some).collect()) == want


def test_first_texts_of_seeds_across_batches():
    """Batches may cut a seed's texts anywhere, and a seed may fill several of them."""
    rnd = random.Random(8)
    for size in (1, 2, 3, 7, 1000):
        rows = sorted({(rnd.randint(-6, 6), rnd.randint(-9, 9)): 0 for _ in range(120)} | {(7, u): 0 for u in range(40)})
        rows = [(h, u, 100 * h + u) for h, u in rows for _ in range(rnd.randint(1, 2))]
        cuts = [rows[i : i + size] for i in range(0, len(rows), size)]
        kinds = (pa.int64(), pa.int64(), pa.int32())
        batches = [pa.RecordBatch.from_arrays([pa.array([r[k] for r in c], t) for k, t in enumerate(kinds)], names=["h", "uid", "pos"]) for c in cuts]
        got = sorted(tuple(r.values()) for b in fuzzy_passages._star(iter(batches)) for r in b.to_pylist())
        want = []
        for h in {r[0] for r in rows}:
            own = sorted({r[1:] for r in rows if r[0] == h})
            if len(own) > 1:
                want.append((h, own[0][0], own[-1][0], own[0][1], own[-1][1], len(own)))
                want += [(h, u, own[0][0], x, own[0][1], 0) for u, x in own[1:]]
        assert got == sorted(want)


def test_equal_texts_hang_on_the_smallest_id(spark):
    text = " ".join(f"word{i}" for i in range(50))
    rows = [(7, text), (3, text), (9, text), (9, text), (None, text), (11, "few words " * 10)]
    found = fuzzy_passages.find_fuzzy_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {((r.doc_id or -1), r.other_id, r.start, r.end, r.similarity) for r in found} == {(3, 9, 0, 50, 1.0)} | {(i, 3, 0, 50, 1.0) for i in (-1, 7, 9)} and len(found) == 4


def test_cut_finds_every_stretch_of_passage_length():
    """cut() against all stretches of one diagonal, and its rows against their words."""
    rnd = random.Random(22)
    for _ in range(60):
        x = np.arange(rnd.randint(90, 240))
        y = x.copy()
        for _ in range(rnd.randint(1, 4)):
            at, n, share = rnd.randrange(len(x)), rnd.randint(10, 120), rnd.choice((0.2, 0.5, 1.0))
            for i in range(at, min(len(x), at + n)):
                if rnd.random() < share:
                    y[i] = -1
        same = x == y
        sums = np.concatenate(([0], np.cumsum(same)))
        got = fuzzy_passages.cut(x, y, [(0, 0, len(x))])
        free = np.ones(len(x), bool)
        for a, b, c, d, equal in got:
            assert (a, b) == (c, d) and free[a:b].all() and b - a >= 40
            assert equal == sums[b] - sums[a] >= 0.75 * (b - a)
            free[a:b] = False
        for i in range(len(x)):
            for j in range(i + 40, len(x) + 1):
                if same[i] and same[j - 1] and sums[j] - sums[i] >= 0.75 * (j - i):
                    assert not free[i:j].all()


def test_sharding(odd, empty):
    out = sharding.shard_documents(odd, 5).collect()
    assert len(out) == odd.count() and list(out[0].asDict())[-2:] == ["shard", "slot"]
    by_text, slots, load = {}, {}, Counter()
    for r in out:
        by_text.setdefault(r.text, set()).add(r.shard)
        slots.setdefault(r.shard, []).append(r.slot)
        load[r.shard] += len((r.text or "").encode()) + 1
    assert all(len(v) == 1 for v in by_text.values())
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    # The two long texts are groups of their own; the other three shards share the rest evenly.
    rest = sorted(load.values())[:3]
    assert rest[-1] - rest[0] <= 0.2 * rest[-1]
    assert sharding.shard_documents(empty, 4).count() == 0
    assert sharding.shard_documents(odd, None, target_bytes=40_000).agg(F.max("shard")).first()[0] >= 3


def test_language_id(docs, odd, empty):
    model = language_id.train_language_model(docs.where(~language_id.held_out()))
    out = language_id.predict_languages(docs.withColumn("held", language_id.held_out()), model).collect()
    held = [r for r in out if r.held]
    assert len(out) == docs.count() and sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in out)
    got = {r.doc_id: r.lang_pred for r in language_id.predict_languages(odd, model).collect()}
    assert got[100] == got[101] == got[102] == "und" and got[103] != "und"
    nothing = language_id.train_language_model(empty)
    assert language_id.predict_languages(odd, nothing).where("lang_pred <> 'und'").count() == 0
    one = language_id.train_language_model(odd.where("lang = 'en'"))
    assert {r.lang_pred for r in language_id.predict_languages(odd, one).select("lang_pred").distinct().collect()} == {"en", "und"}
    assert language_id.keep_identified(odd).columns == odd.columns


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def checked(kind, text):
    digits = re.sub("[^0-9]", "", text)
    if kind == "ip":
        return all(int(p) <= 255 for p in text.split("."))
    if kind == "phone":
        return 9 <= len(digits) <= 15
    if kind == "card":
        total = sum(int(c) if i % 2 == 0 else (2 * int(c)) % 10 + 2 * int(c) // 10 for i, c in enumerate(reversed(digits)))
        return 13 <= len(digits) <= 19 and total % 10 == 0
    return True


def test_pii(spark, docs):
    rnd = random.Random(2)
    tricky = [
        None, "", "a@b.c@d.e", "a@b.com_x@y.com é@é.é z@z", "1.2.3.4.5.6.7.8 256.1.1.1 0000255.1.1.001", "4111 1111-1111 1111 and 4111111111111112",
        "+1 (743) 555-3824 +12 34", "x" * 20_000 + "@", "7" * 20_000, "😀 a.b%c@x-y.z 😀+49 30 123456", 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"',
    ] + ["".join(rnd.choice("@.a1+- (2é\n") for _ in range(60)) for _ in range(300)]
    rows = spark.createDataFrame(list(enumerate(tricky)), "doc_id long, text string").unionByName(docs.select("doc_id", "text"))
    model = pii.train_pii_model(docs)
    for r in pii.find_pii(rows, model).collect():
        base = [(k, m.start(), m.end()) for k, p in BASE.items() for m in re.finditer(p, r.text or "") if checked(k, m.group())]
        assert [(x.kind, x.start, x.end) for x in r.pii if x.base] == base, r.text
        order = [(pii.KINDS.index(x.kind), x.start) for x in r.pii]
        assert order == sorted(order)
    assert pii.redact(rows, model).where("text LIKE '%@example.com%'").count() == 0
    assert pii.train_pii_model(rows.where("doc_id < 0")).score is None


def test_elias_fano_round_trip():
    rnd = np.random.default_rng(0)
    for n, u in ((0, 10), (1, 1), (5, 5), (1000, 10_000_000), (3000, 3000)):
        values = np.sort(rnd.integers(0, u, n))
        ef = tokens.EliasFano.encode(values, u)
        assert ef.decode().tolist() == values.tolist()
        assert all(ef.select(k) == values[k] for k in range(0, n, 7))
        if n >= 1000:
            assert 8 * (len(ef.low) + len(ef.high) + len(ef.directory)) <= n * (3 + max(0, np.log2(u / n)))


def test_tokens(odd, empty, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    rows = odd.select("doc_id", "text").unionByName(odd.sparkSession.createDataFrame([(500, "a<|endoftext|>b  \x1c\n\n c's")], "doc_id long, text string"))
    tokens.write_tokens(rows, str(tmp_path / "t"), path, end_id=0)
    got = tokens.read_boundaries(odd.sparkSession, str(tmp_path / "t")).orderBy("start").collect()
    want = {}
    for r in rows.collect():
        ids = np.array(plain.encode(r.text or "", add_special_tokens=False).ids + [0], "<u4")
        want.setdefault(r.doc_id, []).append((len(ids), zlib.crc32(ids.tobytes())))
    have, at = {}, 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
        have.setdefault(r.doc_id, []).append((r.n_tokens, r.ids_crc32))
    assert {k: sorted(v) for k, v in have.items()} == {k: sorted(v) for k, v in want.items()}
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda x: (x is not None, x or 0))
    tokens.write_tokens(empty, str(tmp_path / "e"), path)
    assert tokens.read_boundaries(odd.sparkSession, str(tmp_path / "e")).count() == 0


def test_flight_keeps_totals():
    rng = np.random.default_rng(1)
    size = rng.integers(1, 500, 400).astype(float)
    p = rng.random(400)
    walked = mixing.flight(p, size, rng)
    assert ((walked > 0) & (walked < 1)).sum() <= 2
    assert walked.sum() == pytest.approx(p.sum()) and walked @ size == pytest.approx(p @ size)
    landed = mixing.landing(mixing.flight(p, size, rng, 10), size)
    assert set(landed) <= {0.0, 1.0} and abs(landed @ size - p @ size) <= 5
    mean = np.mean([mixing.flight(np.full(6, 0.3), np.arange(1.0, 7.0), np.random.default_rng(s)) for s in range(600)], 0)
    assert np.allclose(mean, 0.3, atol=0.08)


def test_mixing(docs, odd, empty):
    copies, targets = mixing.sampled_mix(docs)
    rows, of = copies.collect(), {r.source: r for r in targets.collect()}
    total = sum(r.source_size for r in of.values())
    weights = {s: 1.0 + i % 3 for i, s in enumerate(sorted(of))}
    want, full = {}, set()
    while True:
        rest = total - sum(3 * of[s].source_size for s in full)
        share = {s: weights[s] * rest / sum(weights[x] for x in of if x not in full) for s in of if s not in full}
        more = {s for s, t in share.items() if t > 3 * of[s].source_size}
        if not more:
            break
        full |= more
    want = {**share, **{s: 3.0 * of[s].source_size for s in full}}
    taken = Counter()
    for r in rows:
        assert 0 <= r.copies <= 3
        taken[r.source] += r.copies * r["size"]
    assert all(of[s].target == pytest.approx(want[s]) for s in of)
    assert np.mean([abs(taken[s] - want[s]) / want[s] for s in of]) < 0.1
    again = mixing.sampled_mix(docs)[0]
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again.collect()))
    mixed = mixing.mix_sources(odd)
    assert mixed.columns == odd.columns and mixed.count() > 0
    assert mixing.mix_sources(empty).count() == 0


def brute_signals(text):
    w = WORD.findall(text)
    three = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    count = Counter(three)
    covered = {i + k for i, x in enumerate(three) if count[x] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_quality(docs, odd, empty):
    for table in (docs.select("doc_id", "text", "lang", "source"), odd.select("doc_id", "text", "lang", "source")):
        texts = Counter(brute_signals(r.text or "") for r in table.collect())
        out = quality.judge_quality(table).collect()
        assert Counter((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in out) == texts
        for r in out:
            assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
            assert not (r.base_failed and r.kept)
    assert quality.judge_quality(empty).count() == 0


def test_quality_sketch_quantiles(spark):
    rows = spark.range(2000).select(
        F.lit(False).alias("base_failed"), F.lit("x").alias("lang"), F.lit(None).cast("string").alias("source"), F.lit(100).alias("n_words"),
        (F.col("id") + 1).alias("word_chars"), F.lit(0).alias("n_symbols"), F.lit(1).alias("n_lines"), F.lit(0).alias("n_dup_lines"), F.lit(0).alias("n_repeat_words"))
    fence = quality.fences(quality.sketches(rows), ["lang", "source"]).where("signal = 'mean_word'").first()
    q1, q3 = 5.0, 15.0
    assert fence.high == pytest.approx(q3 + 3 * (q3 - q1) + 1, rel=0.03) and fence.rows == 2000


def brute_components(rows):
    sets = {}
    for i, text in rows:
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_ngram_join(docs, odd, empty, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 3)
    for table in (docs, odd.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(table).collect()}
        assert got == brute_components([(r.doc_id, r.text) for r in table.collect()])
    assert ngram_join.near_duplicates(odd).count() == odd.count()
    assert ngram_join.near_duplicates(empty).count() == 0
    kept = ngram_join.keep_representatives(odd)
    assert kept.columns == odd.columns
    assert {100, 101, 102, 103} <= {r.doc_id for r in kept.collect()} and kept.where("doc_id = 106").count() == 0


def edit_distance_within(pattern, text):
    cost = list(range(len(pattern) + 1))
    best = cost[-1]
    for c in text:
        last, cost[0] = cost[0], 0
        for i, p in enumerate(pattern, 1):
            last, cost[i] = cost[i], min(cost[i] + 1, cost[i - 1] + 1, last + (p != c))
        best = min(best, cost[-1])
    return best


def test_decontamination(spark, odd, empty):
    rnd = random.Random(9)
    items = [(i, words(rnd.randint(3, 40), rnd)) for i in range(12)] + [(50, None), (None, "some item text here"), (51, "tiny")]
    rows = []
    for i in range(80):
        text = words(rnd.randint(5, 60), rnd)
        if rnd.random() < 0.6:
            item = rnd.choice(items[:12])[1]
            for _ in range(rnd.choice((0, 1, 2, 4, 8, 12))):
                at = rnd.randrange(len(item))
                item = item[:at] + rnd.choice(("", "q", "zz")) + item[at + rnd.choice((0, 1)) :]
            text = f"{text} {item.upper() if rnd.random() < 0.3 else item} {words(4, rnd)}"
        rows.append((i, text))
    table = spark.createDataFrame([*rows, (90, None), (91, "")], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.find_contamination(table, bench).collect()}
    index = decontamination.PassageIndex.build([x for x in items if x[0] is not None])
    fold = lambda t: decontamination._FOLD[np.frombuffer(t.encode(), np.uint8)].tobytes()
    want = {
        (d, int(i)) for d, t in rows for i, p, k in zip(index.item, index.text, index.budget)
        if edit_distance_within(p.tobytes(), fold(t)) <= k
    }
    assert got == want and len(want) > 10
    clean = {r.doc_id for r in decontamination.decontaminate(table, bench).collect()}
    assert clean == ({d for d, _ in rows} | {90, 91}) - {d for d, _ in want}
    assert decontamination.find_contamination(empty, bench).count() == 0
    assert decontamination.decontaminate(odd, bench.limit(0)).count() == odd.count()


def test_parts_without_a_near_passage_have_no_hits(monkeypatch):
    """Texts are searched some at a time; in some of these parts hits are too few for a passage."""
    rnd = random.Random(35)
    item = words(60, rnd, "abcdefghij")
    index = decontamination.PassageIndex.build([(7, item)])
    texts = [item[40:48], "", words(9, rnd, "vwxyz"), "v " + item + " w", item[:8] + " v", item[100:200]]
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    for size in (1, 30, 1 << 18):
        monkeypatch.setattr(decontamination, "_TEXT_BYTES", size)
        assert [[h[0] for h in hits] for hits in decontamination.find_passages(index, data, offsets)] == [[], [], [], [7], [], [7]]


def test_quotes_of_the_stated_length_are_found_at_every_offset():
    rnd = random.Random(31)
    item = words(90, rnd).encode()[:300].decode(errors="ignore")
    index = decontamination.PassageIndex.build([(7, item)])
    data = item.encode()
    noise = lambda: words(8, rnd, "vwxyz").encode()
    docs = [noise() + b" " + data[i : i + 130] + b" " + noise() for i in range(len(data) - 130 + 1)]
    docs += [noise() + b" " + data[i : i + decontamination.SHORT] + b" " + noise() for i in range(len(data) - decontamination.SHORT + 1)]
    for i in range(len(data) - decontamination.QUOTE + 1):
        quote = bytearray(data[i : i + decontamination.QUOTE])
        for _ in range(decontamination.edit_budget(decontamination.SHORT)):
            quote[rnd.randrange(len(quote))] = ord("#")
        docs.append(noise() + b" " + bytes(quote) + b" " + noise())
    clean = [noise() for _ in range(20)]
    offsets = np.concatenate(([0], np.cumsum([len(d) for d in docs + clean]))).astype(np.int64)
    found = decontamination.find_passages(index, np.frombuffer(b"".join(docs + clean), np.uint8), offsets)
    assert all([h[0] for h in hits] == [7] for hits in found[: len(docs)])
    assert not any(found[len(docs) :])


def test_wide_signatures_keep_long_texts_apart():
    """300 texts of 2 000 words that share a line and nothing else give no pair; near copies of them all do."""
    import pyarrow as pa

    rnd = random.Random(31)
    line = " ".join(f"l{i}" for i in range(12))
    texts = [line + " " + " ".join(f"w{rnd.randrange(10**9)}" for _ in range(rnd.choice((600, 1000, 2000)))) for _ in range(300)]

    def pairs(rows):
        batch = pa.record_batch({"text": pa.array(rows)})
        sets = pa.Table.from_batches(list(ngram_join._sets(5)(iter([batch]))))
        n = sets.num_rows
        struct = pa.StructArray.from_arrays(
            [pa.array(np.arange(n)), sets["n"].combine_chunks(), pa.array(np.arange(n)), pa.array(np.full(n, 3, np.int32)), sets["wide"].combine_chunks()]
            + [sets[f"s{i}"].combine_chunks() for i in range(ngram_join.SIGNATURE)],
            names=["sid", "n", "root", "side", "wide"] + [f"s{i}" for i in range(ngram_join.SIGNATURE)],
        )
        lists = pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), struct)
        out = next(iter(ngram_join._tile_pairs(75, False)(iter([pa.record_batch({"rows": lists})]))))
        return {(a, b) for a, b in zip(out["a"].to_pylist(), out["b"].to_pylist())}

    assert pairs(texts) == set()
    copies = [t + " " + " ".join(f"n{rnd.randrange(10**9)}" for _ in range(len(t.split()) // 5)) for t in texts[:40]]
    assert {(i, 300 + i) for i in range(40)} <= pairs(texts + copies)


def test_memory_of_pieces_is_bounded(monkeypatch):
    """Ids stay right while pieces are let go, and no generation passes its bytes by more than one group's."""
    import public_tokenizers

    monkeypatch.setattr(tokens, "CACHE_BYTES", 20_000)
    encoder = tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    rnd = random.Random(3)
    most = 0
    for _ in range(40):
        texts = [words(60, rnd, "abcdefghé1.,") for _ in range(4)]
        for text, coded in zip(texts, encoder.encode(texts)):
            assert np.frombuffer(coded, encoder.kind).tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids
        most = max(most, encoder.size)
    assert encoder.older and most < 20_000 + 4 * 60 * 2 * (tokens.ENTRY_BYTES + 40)


def test_an_encoder_serves_all_tasks_of_a_worker(monkeypatch):
    """Each task gets a copy of its function; the tokenizer and the memory of pieces stay."""
    import pyarrow as pa
    import public_tokenizers
    from pyspark import cloudpickle

    made, begin = [], tokens.Encoder.__init__
    monkeypatch.setattr(tokens.Encoder, "__init__", lambda self, path: (made.append(path), begin(self, path))[1])
    tokens._ENCODERS.clear()
    sent = cloudpickle.dumps(tokens._write_shards(public_tokenizers.path("byte_bpe_50k.json"), 0))
    batch = pa.record_batch({"doc_id": pa.array([1, 2]), "text": pa.array(["one text", None]), "part": pa.array([0, 0], pa.int32())})
    for _ in range(3):
        assert sum(b.num_rows for b in cloudpickle.loads(sent)(iter([batch]))) == 1
    assert len(made) == 1


def test_ids_of_long_texts_and_of_pieces_that_share_a_hash(monkeypatch):
    """Texts cut for their length, texts with special tokens, and hashes that say nothing change no id."""
    import public_tokenizers

    rnd = random.Random(8)
    alphabet = "streéd'  \n\t 漢7½.,!🙂lm"
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.choice((0, 3, 30, 400)))) for _ in range(60)]
    texts += ["it's <|endoftext|> and 'll 'rest", "<|endof", "text|>", " ", "'"]
    encoder = tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    want = [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    plain = tokens.SpanHash
    for limit, few in ((1 << 20, False), (64, False), (1 << 20, True)):
        encoder = tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
        monkeypatch.setattr(tokens, "ENCODE_BYTES", limit)
        if few:
            monkeypatch.setattr(tokens, "SpanHash", lambda data: lambda a, b: plain(data)(a, b) % np.uint64(97))
        for _ in range(2):
            assert [np.frombuffer(x, encoder.kind).tolist() for x in encoder.encode(texts)] == want
