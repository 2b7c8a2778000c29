"""A gated recurrent language model over words, trained by truncated backpropagation in numpy.

Words are counted over all documents that the model learns from (``vocabulary``).  The most
frequent ones, and the end of a text, have vectors of their own and are dealt out to
classes of equal weight (by the square root of their counts); the next ones fall into
classes by rank, and all others, unknown words too, share the last class.  The output is
factored: the probability of a word is that of its class, a softmax over the recurrent
state, times that within the class, a softmax too, or for the classes by rank the word's
share of the class's occurrences in the corpus.

Training is data-parallel.  The learning documents are cut into
streams of word numbers; in each round the tasks train from the same weights on their own
streams, with the state carried from window to window and backpropagation within a
window, and the weights that come out are averaged by number of words, a few at a time.
What is counted and what is trained on both grow with the corpus; the model does not.

Scoring reads every whole text, many side by side, and carries the state from a text's
first word to its end.  Occurrences of words in the last class meet their counts in a join.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import chunks, list_array, small_batches, text_bytes, write_scratch
from .vocabulary import coded_words, count_words, part_codes

#: Words with vectors of their own; words whose counts every task knows; classes of the former.
OWN_WORDS = 4095
KNOWN_WORDS = 1 << 16
CLASSES = 64
#: Size of the state, words of a window, texts side by side in training (in short and in whole streams),
#: most side by side in scoring.
HIDDEN = 16
WINDOW = 32
TRAIN_LANES = (64, 512)
LANES = 384
#: Logits that lie as near each other have exponentials that float32 holds.
SAFE_RANGE = 80
#: Words whose output is computed together in scoring.
OUTPUT_WORDS = 1 << 14
#: Words of a training stream; text scored together (bytes).
STREAM_WORDS = 1 << 20
SCORE_BYTES = 16 << 20
#: Share of the learning documents whose streams train the weights (all, unless a caller asks for less),
#: and rounds of averaging.
SHARE = 1.0
ROUNDS = 3
#: Weights that meet in one task when they are averaged.
FAN_IN = 16
STEP = 0.6
#: Counts are smoothed by this much.
ALPHA = 0.1
#: All words are counted as one part.
PART = ""


@dataclass
class Vocabulary:
    """The known words by rank, and how numbers map to classes; number 0 is the end of a text."""

    codes: np.ndarray  # of known words, sorted
    numbers: np.ndarray  # for each of them: its rank + 1
    counts: np.ndarray  # by number
    class_of: np.ndarray  # by input number: own words, then a number for each class by rank
    class_start: np.ndarray  # first own word of each class, and their end
    rare_start: np.ndarray  # first number of each class by rank but the last, and their end
    rare_total: np.ndarray  # occurrences of the words of each class by rank, the last included
    rest_words: int  # distinct words in the last class
    tokens: int
    distinct: int
    seed: int

    @property
    def own(self) -> int:
        return int(self.class_start[-1])

    def inputs(self, number: np.ndarray) -> np.ndarray:
        """Input numbers: an own word's number, or one for the class by rank (number -1: the last class)."""
        rare = np.searchsorted(self.rare_start, number, side="right") - 1
        rare = np.where(number < 0, len(self.rare_start) - 1, rare)
        return np.where((number >= 0) & (number < self.own), number, self.own + rare).astype(np.int32)

    def look_up(self, code: np.ndarray) -> np.ndarray:
        """Numbers of coded words; -1: not among the known ones."""
        if not len(self.codes):
            return np.full(len(code), -1)
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where(self.codes[at] == code, self.numbers[at], -1)

    def base(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + ALPHA) / (self.tokens + ALPHA * (self.distinct + 1)))


def _count_passed_by(words: DataFrame, most: int) -> int:
    """The least count that no more than ``most`` words are above, from numbers of words by count.

    First by eighths of a doubling (some hundred rows to the driver), then within the one
    that holds the limit.
    """
    eighth, passed = F.floor(F.log2("n") * 8), 0
    for r in sorted(words.groupBy(eighth.alias("e")).count().collect(), key=lambda r: -r["e"]):
        if passed + r["count"] > most:
            break
        passed += r["count"]
    for r in sorted(words.where(eighth == r["e"]).groupBy("n").count().collect(), key=lambda r: -r["n"]):
        if passed + r["count"] > most:
            return r["n"]
        passed += r["count"]
    return 0


def build_vocabulary(words: DataFrame, seed: int, n_texts: int) -> Vocabulary:
    """``words`` as ``count_words`` returns them; at most KNOWN_WORDS rows reach the driver.

    Known are the words above a count that at most KNOWN_WORDS words pass.
    """
    seen = words.where("n > 0")
    sums = seen.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    least = _count_passed_by(seen, KNOWN_WORDS) if sums.v > KNOWN_WORDS else 0
    top = sorted(seen.where(F.col("n") > least).select("code", "n").collect(), key=lambda r: (-r.n, r.code))
    codes = np.array([r.code for r in top], np.int64).view(np.uint64)
    counts = np.concatenate(([n_texts], np.array([r.n for r in top], np.int64)))
    own = min(OWN_WORDS + 1, len(counts))
    weight = np.cumsum(np.sqrt(counts[:own]))
    classes = np.minimum((weight - np.sqrt(counts[:own]) / 2) / max(weight[-1], 1e-9) * CLASSES, CLASSES - 1).astype(np.int64)
    classes = np.unique(classes, return_inverse=True)[1] if own > 1 or counts[0] else np.zeros(own, np.int64)
    class_start = np.searchsorted(classes, np.arange(classes.max(initial=0) + 2))
    rare = [own]
    while rare[-1] < len(counts):
        rare.append(min(2 * rare[-1], len(counts)))
    sizes = [int(counts[a:b].sum()) for a, b in zip(rare, rare[1:])]
    n_classes = len(class_start) - 1
    order = np.argsort(codes)
    return Vocabulary(
        codes[order], (order + 1).astype(np.int64), counts, np.concatenate((classes, n_classes + np.arange(len(rare)))), class_start, np.array(rare),
        np.array(sizes + [int(sums.n - counts[1:].sum())]), int(sums.v - len(top)), int(sums.n + n_texts), int(sums.v + (n_texts > 0)), seed,
    )


Weights = dict[str, np.ndarray]


def first_weights(vocabulary: Vocabulary, hidden: int = HIDDEN) -> Weights:
    """Small random vectors; biases that make the untrained model the words' shares."""
    rng = np.random.default_rng(11)
    n_in, n_classes = len(vocabulary.class_of), int(vocabulary.class_of.max()) + 1
    own = vocabulary.own
    count = vocabulary.counts[:own] + ALPHA
    starts = vocabulary.class_start[:-1]
    by_class = np.concatenate((np.add.reduceat(count, starts), vocabulary.rare_total + ALPHA))
    draw = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
    embed = draw(n_in, 3 * hidden)
    embed[:, :hidden] += 1  # the state is kept at first
    return {
        "embed": embed, "state": draw(hidden, 3 * hidden), "cls": draw(hidden, n_classes) * 0.1, "cls_bias": np.log(by_class / by_class.sum()).astype(np.float32),
        "word": draw(own, hidden) * 0.1, "word_bias": np.log(count).astype(np.float32),
    }


def pack(weights: Weights) -> bytes:
    return b"".join(weights[k].astype(np.float32).tobytes() for k in sorted(weights))


def unpack(data: bytes, like: Weights) -> Weights:
    out, at = {}, 0
    flat = np.frombuffer(data, np.float32)
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape).copy()
        at += like[k].size
    return out


def _gates(weights: Weights, x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
    """Update gate, reset gate, new content, the state's part in it, and the next state."""
    n = h.shape[1]
    given, kept = weights["embed"][x], h @ weights["state"]
    gates = np.tanh((given[:, : 2 * n] + kept[:, : 2 * n]) * np.float32(0.5)) * np.float32(0.5) + np.float32(0.5)
    keep, reset = gates[:, :n], gates[:, n:]
    own = kept[:, 2 * n :]
    new = np.tanh(given[:, 2 * n :] + reset * own)
    return keep, reset, new, own, new + keep * (h - new)


def _lowered(logits: np.ndarray) -> np.ndarray:
    """The logits less what keeps their exponentials finite: one number for all rows, if none of them vanishes by that."""
    top = logits.max()
    logits -= top if top - logits.min() < SAFE_RANGE else logits.max(1, keepdims=True)
    return logits


def _row_sums(a: np.ndarray) -> np.ndarray:
    return a @ np.ones(a.shape[1], a.dtype)


def _softmax_less(logits: np.ndarray, at: np.ndarray, share: np.float32) -> np.ndarray:
    """The softmax of each row less 1 at one place, times ``share``; the logits are used up."""
    np.exp(_lowered(logits), out=logits)
    logits *= (share / _row_sums(logits))[:, None]
    logits[np.arange(len(at)), at] -= share
    return logits


def _log_softmax_at(logits: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of each row, the log of the softmax at one place; the logits are used up."""
    picked = _lowered(logits)[np.arange(len(at)), at]
    np.exp(logits, out=logits)
    return picked - np.log(_row_sums(logits))


def _by_class(classes: np.ndarray, n_own: int) -> Iterator[tuple[int, np.ndarray]]:
    """The classes of own words that occur, each with the places where."""
    order = np.argsort(classes, kind="stable")
    edge = np.searchsorted(classes[order], np.arange(n_own + 1))
    for c in np.flatnonzero(np.diff(edge)):
        yield int(c), order[edge[c] : edge[c + 1]]


def _log_p(weights: Weights, vocabulary: Vocabulary, states: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Natural log probability of each input number after its state (of its class only, for the classes by rank)."""
    classes = vocabulary.class_of[target]
    out = _log_softmax_at(states @ weights["cls"] + weights["cls_bias"], classes).astype(np.float64)
    for c, at in _by_class(classes, len(vocabulary.class_start) - 1):
        a, b = vocabulary.class_start[c], vocabulary.class_start[c + 1]
        if b - a > 1:
            out[at] += _log_softmax_at(states[at] @ weights["word"][a:b].T + weights["word_bias"][a:b], target[at] - a)
    return out


def train_on(weights: Weights, vocabulary: Vocabulary, stream: np.ndarray) -> Weights:
    """Weights after one pass over a stream of input numbers; 0 ends a text and clears the state."""
    weights = {k: v.copy() for k, v in weights.items()}
    squares = {k: np.full(v.shape, 1e-4, np.float32) for k, v in weights.items()}
    n = weights["state"].shape[0]
    least, most = TRAIN_LANES
    # A longer stream has more lanes, not more windows: what a step costs does not depend much on its lanes.
    lanes = max(1, min(max(least, min(most, len(stream) // (WINDOW * least))), len(stream) // WINDOW))
    steps = -(-len(stream) // lanes)
    padded = np.concatenate((stream, np.full(steps * lanes - len(stream), -1, stream.dtype))).reshape(lanes, steps).T
    before = np.vstack((np.zeros((1, lanes), stream.dtype), padded[:-1]))
    n_own = len(vocabulary.class_start) - 1
    h = np.zeros((lanes, n), np.float32)

    def update(name: str, grad: np.ndarray, at: slice | np.ndarray = slice(None)) -> None:
        grad = np.clip(grad, -1, 1)
        squares[name][at] += grad * grad
        weights[name][at] -= np.float32(STEP) * grad / np.sqrt(squares[name][at])

    for t in range(0, steps, WINDOW):
        xs, ys = np.maximum(before[t : t + WINDOW], 0), padded[t : t + WINDOW]
        given = np.flatnonzero(ys.ravel() >= 0)
        if not len(given):
            break
        old, keep, reset, new, own, states = (np.empty((len(xs), lanes, n), np.float32) for _ in range(6))
        for i, x in enumerate(xs):
            old[i] = np.where((x == 0)[:, None], np.float32(0), h)
            keep[i], reset[i], new[i], own[i], h = _gates(weights, x, old[i])
            states[i] = h
        target, s = ys.ravel()[given], states.reshape(-1, n)[given]
        share = np.float32(1 / len(given))
        # Output: class, then word within its class.
        classes = vocabulary.class_of[target]
        logits = s @ weights["cls"]
        logits += weights["cls_bias"]
        d = _softmax_less(logits, classes, share)
        d_state = d @ weights["cls"].T
        steps_out = [("cls", s.T @ d, slice(None)), ("cls_bias", d.sum(0), slice(None))]
        for c, at in _by_class(classes, n_own):
            a, b = vocabulary.class_start[c], vocabulary.class_start[c + 1]
            if b - a == 1:
                continue
            here = s[at]
            logits = here @ weights["word"][a:b].T
            logits += weights["word_bias"][a:b]
            d = _softmax_less(logits, target[at] - a, share)
            d_state[at] += d @ weights["word"][a:b]
            steps_out += [("word", d.T @ here, slice(a, b)), ("word_bias", d.sum(0), slice(a, b))]
        d_out = np.zeros((len(xs) * lanes, n), np.float32)
        d_out[given] = d_state
        d_out = d_out.reshape(len(xs), lanes, n)
        # Backwards through the window; what does not depend on the order of steps at once.
        by_new, by_keep, by_reset = (1 - keep) * (1 - new * new), (old - new) * keep * (1 - keep), own * reset * (1 - reset)
        going = (xs != 0)[:, :, None]
        through, back, u_t = np.empty((len(xs), lanes, 3 * n), np.float32), np.zeros((lanes, n), np.float32), weights["state"].T
        d_new = np.empty((len(xs), lanes, n), np.float32)
        for i in range(len(xs) - 1, -1, -1):
            dh = d_out[i] + back
            d_new[i] = dh * by_new[i]
            through[i, :, :n] = dh * by_keep[i]
            through[i, :, n : 2 * n] = d_new[i] * by_reset[i]
            through[i, :, 2 * n :] = d_new[i] * reset[i]
            back = (dh * keep[i] + through[i] @ u_t) * going[i]
        d_u = old.reshape(-1, n).T @ through.reshape(-1, 3 * n)
        d_embed = through
        d_embed[:, :, 2 * n :] = d_new
        flat = xs.ravel()
        order = np.argsort(flat, kind="stable")
        some, begin = np.unique(flat[order], return_index=True)
        steps_out += [("state", d_u, slice(None)), ("embed", np.add.reduceat(d_embed.reshape(-1, 3 * n)[order], begin, axis=0), some)]
        for name, grad, at in steps_out:
            update(name, grad, at)
    return weights


def score_texts(weights: Weights, vocabulary: Vocabulary, numbers: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Natural log probability of each text: input numbers one after another, ``sizes`` of each, ends included.

    Texts are dealt out to lanes that advance together, the longest first, and each
    lane's texts follow one another; the state starts anew with a text.
    """
    if not len(sizes):
        return np.zeros(0)
    first = np.concatenate(([0], np.cumsum(sizes)))
    lanes = int(min(len(sizes), max(32, min(LANES, first[-1] / max(1, sizes.max())))))
    ready = [(0, i) for i in range(lanes)]
    dealt: list[list[int]] = [[] for _ in range(lanes)]
    for text in np.argsort(-sizes, kind="stable"):
        used, lane = heapq.heappop(ready)
        dealt[lane].append(int(text))
        heapq.heappush(ready, (used + int(sizes[text]), lane))
    dealt.sort(key=lambda own: -int(sizes[own].sum()))
    used = np.array([int(sizes[own].sum()) for own in dealt])
    rows = np.zeros((used[0], lanes), np.int32)
    for lane, own in enumerate(dealt):
        rows[: used[lane], lane] = np.concatenate([numbers[first[i] : first[i + 1]] for i in own])
    found = np.zeros(rows.shape)
    n = weights["state"].shape[0]
    h, x = np.zeros((lanes, n), np.float32), np.zeros(lanes, np.int32)
    span = max(WINDOW, OUTPUT_WORDS // lanes)
    for t in range(0, len(rows), span):
        ys = rows[t : t + span]
        active = np.searchsorted(-used, -(t + np.arange(len(ys))), side="left")  # lanes with more words than t
        states = np.empty((int(active.sum()), n), np.float32)
        at = 0
        for y, k in zip(ys, active):
            if (x[:k] == 0).any():
                h[:k][x[:k] == 0] = 0
            h[:k] = _gates(weights, x[:k], h[:k])[-1]
            states[at : at + k] = h[:k]
            at += k
            x[:k] = y[:k]
        inside = np.arange(lanes)[None, :] < active[:, None]
        found[t : t + span][inside] = _log_p(weights, vocabulary, states, ys[inside])
    out = np.zeros(len(sizes))
    for lane, own in enumerate(dealt):
        begin = np.concatenate(([0], np.cumsum(sizes[own])[:-1]))
        out[own] = np.add.reduceat(found[: used[lane], lane], begin)
    return out


def _numbered(vocabulary: Vocabulary, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Row ranges of a batch of texts with their words' codes and numbers, and words by row."""
    data, offsets = text_bytes(column)
    part = part_codes(pa.array([PART]), vocabulary.seed)
    for a, b in chunks(offsets):
        code, doc, *_ = coded_words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], np.repeat(part, b - a), vocabulary.seed)
        yield a, code, vocabulary.look_up(code), np.bincount(doc, minlength=b - a)


def _with_ends(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The values of consecutive texts with a 0 after each text."""
    return np.insert(values, np.cumsum(sizes), 0)


def _streams(vocabulary: Vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, made, part = [], 0, 0, TaskContext.get().partitionId()

        def out(values: np.ndarray) -> pa.RecordBatch:
            nonlocal made
            made += 1
            return pa.record_batch([pa.array([(part << 32) + made], pa.int64()), pa.array([values.astype(np.int32).tobytes()], pa.binary())], names=["stream", "numbers"])

        for batch in batches:
            for _, _, number, sizes in _numbered(vocabulary, batch.column("text")):
                held.append(_with_ends(vocabulary.inputs(number), sizes))
                size += len(held[-1])
                while size >= STREAM_WORDS:
                    whole = np.concatenate(held)
                    yield out(whole[:STREAM_WORDS])
                    held, size = [whole[STREAM_WORDS:]], size - STREAM_WORDS
        if size:
            yield out(np.concatenate(held))

    return run


def _trainer(vocabulary: Vocabulary, like: Weights, start: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for stream, numbers in zip(batch.column("stream").to_pylist(), batch.column("numbers").to_pylist()):
                numbers = np.frombuffer(numbers, np.int32)
                trained = pack(train_on(unpack(start, like), vocabulary, numbers))
                yield pa.record_batch([pa.array([stream]), pa.array([trained], pa.binary()), pa.array([len(numbers)], pa.int64())], names=["stream", "weights", "n"])

    return run


def _average(table: pa.Table) -> pa.Table:
    total = sum(table.column("n").to_pylist())
    out = None
    for weights, n in zip(table.column("weights"), table.column("n").to_pylist()):
        part = np.frombuffer(weights.as_buffer(), np.float32) * np.float64(n / total)
        out = part if out is None else out + part
    return pa.table([table.column("stream").slice(0, 1), pa.array([out.astype(np.float32).tobytes()], pa.binary()), pa.array([total], pa.int64())], names=["stream", "weights", "n"])


def train(texts: DataFrame, vocabulary: Vocabulary, share: float = SHARE, rounds: int = ROUNDS, hidden: int = HIDDEN) -> Weights:
    """Weights trained on ``share`` of the rows of ``texts`` (text), chosen by a hash of the text.

    Each of the ``rounds`` takes its own part of the streams.  Only averaged weights, one
    row of fixed size a round, reach the driver.
    """
    like = first_weights(vocabulary, hidden)
    chosen = F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < int(share * (1 << 20))
    streams = write_scratch((texts if share >= 1 else texts.where(chosen)).select("text").mapInArrow(_streams(vocabulary), "stream long, numbers binary"), "streams")
    count, now = streams.count(), pack(like)
    schema, draw = "stream long, weights binary, n long", F.pmod(F.xxhash64("stream"), F.lit(1 << 30))
    for r in range(rounds):
        mine = streams if count < rounds else streams.where(F.pmod(F.xxhash64("stream", F.lit(7)), F.lit(rounds)) == r)
        spread = mine.repartition(max(1, count // rounds), "stream")
        averaged = spread.mapInArrow(_trainer(vocabulary, like, now), schema)
        groups = max(1, count // FAN_IN)
        while groups > 1:
            averaged = averaged.groupBy(F.pmod(draw, F.lit(groups)).alias("g")).applyInArrow(_average, schema)
            groups //= FAN_IN
        last = averaged.groupBy(F.lit(0).alias("g")).applyInArrow(_average, schema).collect()
        if last:
            now = bytes(last[0].weights)
    return unpack(now, like)


_SCORED = "row long, words long, known long, base double, score double, rest array<long>, times array<int>"


def _scorer(vocabulary: Vocabulary, weights: bytes, like: Weights, keep: str):
    """Each text's totals without what its words of the last class add; those words, with how often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = unpack(weights, like)
        part, rows = TaskContext.get().partitionId(), 0
        count = np.append(vocabulary.counts, 0)  # the last one for words that are not known
        base = vocabulary.base(count)
        base[-1] = 0
        within = np.zeros(len(count))  # log10 of a word's share of its class, for the classes by rank
        for c, (a, b) in enumerate(zip(vocabulary.rare_start, vocabulary.rare_start[1:])):
            within[a:b] = np.log10(count[a:b] / vocabulary.rare_total[c])

        def totalled(keeps: pa.Array, code: np.ndarray, number: np.ndarray, sizes: np.ndarray) -> tuple:
            """What is held of some texts until they are scored: no text, and four bytes for a word that is known."""
            text = np.repeat(np.arange(len(sizes)), sizes)
            total = lambda v: np.bincount(text, weights=v, minlength=len(sizes))
            far = number < 0
            pairs = pa.table({"text": text[far], "code": code[far].view(np.int64)}).group_by(["text", "code"]).aggregate([([], "count_all")]).sort_by("text")
            return (
                pa.concat_arrays([keeps, keeps.slice(0, 0)]), _with_ends(vocabulary.inputs(number), sizes), sizes + 1,
                total(count[number] > 0).astype(np.int64) + int(count[0] > 0), total(base[number]) + base[0], total(within[number]),
                np.bincount(pairs.column("text").to_numpy(), minlength=len(sizes)), pairs.column("code").to_numpy(), pairs.column("count_all").to_numpy().astype(np.int32),
            )

        def scored(held: list) -> pa.RecordBatch:
            nonlocal rows
            kept = pa.concat_arrays([x[0] for x in held])
            sizes, known, based, shares, per_text, far, times = (np.concatenate([x[i] for x in held]) for i in range(2, 9))
            numbers = np.concatenate([x[1] for x in held])
            held.clear()
            log_p = score_texts(model, vocabulary, numbers, sizes)
            out = pa.record_batch([
                kept, pa.array((part << 33) + rows + np.arange(len(sizes))), pa.array(sizes), pa.array(known), pa.array(based),
                pa.array(log_p / np.log(10) + shares), list_array(far, per_text), list_array(times, per_text),
            ], names=[keep] + [c.split()[0] for c in _SCORED.split(", ")])
            rows += len(sizes)
            return out

        held, size = [], 0
        for batch in batches:
            begun = 0
            column, keeps = batch.column("text"), batch.column(keep)
            for a, code, number, sizes in _numbered(vocabulary, column):
                held.append(totalled(keeps.slice(a, len(sizes)), code, number, sizes))
                size += 6 * len(code)
                begun = a + len(sizes)
                if size >= SCORE_BYTES:
                    yield scored(held)
                    size = 0
            assert begun == len(column)
        if held:
            yield scored(held)

    return run


def score_documents(
    docs: DataFrame, learn: Column, text_col: str = "text", *, share: float = SHARE, rounds: int = ROUNDS, hidden: int = HIDDEN
) -> DataFrame:
    """``docs`` without the text, with n_tokens, n_known, train_tokens, base_score and score.

    The model learns from the rows for which ``learn`` holds (null: it does not).  Words are
    maximal runs of characters other than space and \\t to \\r after lower-casing A-Z; a
    text's tokens are its words and one end, so a null or empty text has one token.
    base_score sums log10((c + 0.1) / (N + 0.1 (V + 1))) over the tokens, with c the count of
    the token, N and V the number of tokens and distinct tokens in what is learned from;
    score is the model's log10 probability of the whole text.  n_known counts tokens with
    c > 0, train_tokens is N.

    Repeated rows are scored and learned each time; columns named like the results are
    replaced, others stay.  With nothing to learn from, every word is unknown; an empty
    table gives no rows.
    """
    with small_batches(docs.sparkSession):
        return _score_documents(docs, learn, text_col, share, rounds, hidden)


def _score_documents(docs: DataFrame, learn: Column, text_col: str, share: float, rounds: int, hidden: int) -> DataFrame:
    names = ("n_tokens", "n_known", "train_tokens", "base_score", "score")
    learns = F.coalesce(learn, F.lit(False))
    words, seed = count_words(docs.select(F.lit(PART).alias("part"), F.col(text_col).alias("text"), learns.cast("int").alias("counted")))
    learned = docs.where(learns).select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    vocabulary = build_vocabulary(words, seed, learned.count())
    like = first_weights(vocabulary, hidden)
    weights = pack(train(learned, vocabulary, share, rounds, hidden))
    kept = [c for c in docs.columns if c != text_col and c not in names]
    quoted = ["`" + c.replace("`", "``") + "`" for c in kept]
    packed = docs.select(F.struct(*[F.col(c) for c in quoted]).alias("kept") if kept else F.lit(0).alias("kept"), F.col(text_col).cast("string").alias("text"))
    schema = StructType([packed.schema["kept"], *StructType.fromDDL(_SCORED).fields])
    scored = write_scratch(packed.mapInArrow(_scorer(vocabulary, weights, like, "kept"), schema), "scored")
    rest = scored.select("row", F.explode(F.arrays_zip("rest", "times")).alias("x")).select("row", F.col("x.rest").alias("code"), F.col("x.times").alias("times"))
    counted = rest.join(words.where("n > 0").select("code", "n"), "code", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    smooth = lambda total, distinct: F.log10((F.col("n") + ALPHA) / F.lit(float(total + ALPHA * (distinct + 1))))
    more = counted.groupBy("row").agg(
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("more_known"),
        F.sum(F.col("times") * smooth(vocabulary.tokens, vocabulary.distinct)).alias("more_base"),
        F.sum(F.col("times") * smooth(int(vocabulary.rare_total[-1]), vocabulary.rest_words)).alias("more_score"),
    )
    plus = lambda a, b: F.col(a) + F.coalesce(b, F.lit(0))
    return scored.drop("rest", "times").join(more, "row", "left").select(
        *[F.col(f"kept.{c}") for c in quoted], F.col("words").alias("n_tokens"), plus("known", "more_known").alias("n_known"),
        F.lit(vocabulary.tokens).cast("long").alias("train_tokens"), plus("base", "more_base").alias("base_score"), plus("score", "more_score").alias("score"),
    )
