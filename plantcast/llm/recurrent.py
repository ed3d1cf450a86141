r"""Scoring texts with a gated recurrent language model in numpy.

A text is its words ``[^\x20\x09-\x0D]+`` (A-Z as a-z) and an end. A GRU reads it from the end mark on;
the output softmax is factored by class: the class of the next token, then the token within its class.
Classes of the ``MODEL_WORDS`` most frequent words are runs of the frequency order of about equal root
mass; the end is a class, and so are all other words together, among which a word has its share by count
plus one (a word never seen counts 0), so that probabilities sum to 1 over known words and one unknown.

All counts come from every learning text: words by 128-bit hash, summed in Spark. Tasks know the counts of
the ``LEXICON`` most frequent words (a bound, not a cap: all others are joined with the count table by
Spark). The network's weights are fitted by truncated back-propagation on every learning text, whole. The texts lie
in the order of a hash in shards, whose number grows with the words; each of ``ROUNDS`` rounds takes an arc of that order, which
is its even share, or more where there are less than ``ROUND_WORDS`` words to a round, so that the arcs cover all texts.
In a round every shard trains from the same weights in its own task, ``CHUNK_WORDS`` words after the other, and the mean of the
weights (about 2 MB each, added up by Spark) goes on. Training reads a text of more than ``RUN`` tokens in runs that lie in lanes
side by side; a run first reads the ``WARM`` tokens before it, so that all tokens are learnt, once, after what came before. Scoring carries the state of every text across windows to its
end: a long text is never cut.

Texts are scored in lanes, one after the other in each, the longest first; the number of lanes follows from the
longest text, so that it does not leave the others waiting.

Defined results: null and empty texts consist of their end; repeated rows are scored each; without learning
texts N and V are 0 and the network is untrained. Empty tables give an empty table.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantcast.llm.common import _BYTE, SPACE, _mix, span_hashes, staged, text_chunks, word_spans, work_folder

LEXICON = 1 << 17
MODEL_WORDS = 4096
CLASSES = 64
HIDDEN = 32
SHARDS, SHARD_WORDS, ROUNDS = 6, 1_000_000, 4  # shards at least, words of one in a round, about
ROUND_WORDS, CHUNK_WORDS = 1_200_000, 1_250_000  # a chunk holds all of a common shard's round
HASHES = 1 << 40
ADDERS = 4  # tasks that add up the weights of shards
RATES = (0.01, 0.006, 0.004, 0.002)
LANES, MOST_LANES, WINDOW, LEAST_STEPS = 32, 512, 24, 64  # of training
RUN, WARM = 1024, 32  # tokens of a run of training, and those before it that it reads first
SCORE_LANES, SCORE_WINDOW = 512, 32
SCORE_TOKENS = 1 << 14  # of a window of scoring, about
GROUP_BYTES = 1 << 24
FAR = 40.0  # exponents beyond that are taken less the greatest of their row
FEW = 8  # rows of a word that are added one by one for all such words together
STEP = 1 << 15  # weights that take a step together
BLOCK = 1024  # targets whose classes are weighed at once
HASH_BYTES = 1 << 16  # of texts hashed at once: their arrays stay in the processor's cache
SLOT_BITS = 18  # of a word's hash, by which its place in the lexicon is looked up

_SECOND = _mix(_BYTE + np.uint64(1))


def _word_pairs(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both hashes of every word, and per text the position of its first word (one more than texts)."""
    starts, ends = word_spans(raw, offsets, ~SPACE)
    spans = [(starts, ends)]
    h1, h2 = (span_hashes(raw, spans, values)[0].view(np.int64) for values in (_BYTE, _SECOND))
    return h1, h2, np.searchsorted(starts, offsets)


def word_counts(texts: DataFrame) -> DataFrame:
    """(h1, h2, n) of every word of the column ``text``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, raw, offsets in text_chunks(batch.column(0)):
                texts = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(raw))
                pairs = [_word_pairs(*run)[:2] for _, *run in text_chunks(texts, HASH_BYTES)]
                h1, h2 = (np.concatenate(h) for h in zip(*pairs, strict=True))
                _, at, n = np.unique(h1, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h1[at]), pa.array(h2[at]), pa.array(n)], ["h1", "h2", "n"])

    return texts.select("text").mapInArrow(count, "h1 long, h2 long, n long").groupBy("h1", "h2").agg(F.sum("n").alias("n"))


def _slots(h1: np.ndarray) -> np.ndarray:
    return (h1 >> (64 - SLOT_BITS)) + (1 << (SLOT_BITS - 1))


def slot_starts(h1: np.ndarray) -> np.ndarray:
    """Where the hashes of every slot begin in the sorted ones, and the end of the last."""
    return np.searchsorted(_slots(h1), np.arange((1 << SLOT_BITS) + 1))


class Lexicon:
    """The most frequent words with their counts, the head of them that the network knows, and its classes."""

    def __init__(self, counts: DataFrame, texts: int, size: int | None = None) -> None:
        size = LEXICON if size is None else size
        level = F.floor(F.log2("n") * 16).cast("int")
        levels = counts.groupBy(level.alias("level")).agg(F.count("*").alias("words"), F.sum("n").alias("n")).orderBy(F.desc("level")).collect()
        lowest, held = 1 << 20, 0
        for row in levels:  # 1,024 of them at most
            if held + row["words"] > size:
                break
            lowest, held = row["level"], held + row["words"]
        table = counts.filter(level >= lowest).toArrow()
        h1, h2, n = (table.column(k).to_numpy() for k in range(3))
        order = np.lexsort((h2, h1, -n))
        self.lowest = lowest
        self.texts = texts
        self.tokens = sum(r["n"] for r in levels) + texts
        self.types = sum(r["words"] for r in levels) + (texts > 0)
        head = n[order][:MODEL_WORDS]
        self.words = len(head)
        self.end, self.tail = self.words, self.words + 1
        rest = self.tokens - int(head.sum()) - texts
        self.tail_total = rest + self.types - self.words - (texts > 0) + 1
        rank = np.empty(len(n), np.int64)
        rank[order] = np.arange(len(n))
        by_hash = np.lexsort((h2, h1))
        self.h1, self.h2, self.n = h1[by_hash], h2[by_hash], n[by_hash]
        self.starts = slot_starts(self.h1)
        self.rank = np.where(rank < self.words, rank, self.tail)[by_hash].astype(np.int32)
        # classes: runs of words, then the end, then all other words
        root = np.sqrt(head)
        place = np.floor((np.cumsum(root) - root) / max(root.sum(), 1e-9) * CLASSES)
        cuts = np.flatnonzero(np.diff(place, prepend=-1)).tolist() if len(head) else []
        self.bounds = [*cuts, self.words]
        self.classes = len(cuts) + 2
        self.class_of = np.empty(self.words + 2, np.int32)
        for k in range(len(cuts)):
            self.class_of[self.bounds[k] : self.bounds[k + 1]] = k
        self.class_of[self.end], self.class_of[self.tail] = self.classes - 2, self.classes - 1
        mass = [float(head[self.bounds[k] : self.bounds[k + 1]].sum()) for k in range(len(cuts))]
        self.class_bias = np.log(np.array([*mass, texts, rest]) + 1.0)
        self.word_bias = np.log(head.astype(float))

    def find(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Place of each word in the lexicon, -1 where it has none."""
        found = np.full(len(h1), -1)
        slot = _slots(h1)
        at, ends = self.starts.take(slot), self.starts.take(slot + 1)
        rows = np.flatnonzero(at < ends)
        at, ends = at.take(rows), ends.take(rows)
        while len(rows):  # few words share a slot
            hit = (self.h1.take(at) == h1.take(rows)) & (self.h2.take(at) == h2.take(rows))
            found[rows[hit]] = at[hit]
            at += 1
            on = np.flatnonzero(~hit & (at < ends))
            rows, at, ends = rows.take(on), at.take(on), ends.take(on)
        return found

    def ids(self, at: np.ndarray) -> np.ndarray:
        return np.where(at >= 0, self.rank[at], self.tail).astype(np.int32) if len(self.rank) else np.full(len(at), self.tail, np.int32)


def first_weights(lexicon: Lexicon) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(7)
    words, classes = lexicon.words, lexicon.classes

    def draw(*shape: int) -> np.ndarray:
        return rng.normal(0, 1 / np.sqrt(HIDDEN), shape).astype(np.float32)

    return {
        "gates": draw(words + 2, 3 * HIDDEN), "update": draw(HIDDEN, 2 * HIDDEN), "new": draw(HIDDEN, HIDDEN),
        "to_class": 0.1 * draw(HIDDEN, classes), "class_bias": (lexicon.class_bias - lexicon.class_bias.max()).astype(np.float32),
        "to_word": 0.1 * draw(words, HIDDEN), "word_bias": lexicon.word_bias.astype(np.float32),
    }


class Lanes:
    """Texts, or runs of their tokens, laid out in lanes, one behind the other: arrays by step and lane."""

    def __init__(self, ids: np.ndarray, bounds: np.ndarray, end: int, lanes: int, run: int | None = None) -> None:
        """``ids``: tokens of all texts without ends; ``bounds``: where texts begin, one more than texts.

        With ``run``, a longer text lies in runs of so many tokens. Each but the first reads the ``WARM``
        tokens before it, which are no targets there, so that every token is a target once.
        """
        whole = np.diff(bounds) + 1
        first = np.concatenate([[0], np.cumsum(whole)])
        tokens = np.full(int(first[-1]), end, np.int32)
        is_word = np.ones(len(tokens), bool)
        is_word[first[1:] - 1] = False
        tokens[is_word] = ids
        before = np.full(len(tokens), end, np.int32)
        before[1:] = tokens[:-1]  # a text's first input is the end of the one before
        runs = np.ones(len(whole), np.int64) if run is None else -(-whole // run)
        of_text = np.repeat(np.arange(len(whole)), runs)
        behind = (np.arange(len(of_text)) - np.repeat(np.cumsum(runs) - runs, runs)) * (run or 0)
        warm = np.minimum(behind, WARM)
        begin = first[of_text] + behind - warm
        sizes = (first[of_text + 1] if run is None else np.minimum(begin + warm + run, first[of_text + 1])) - begin
        lanes = max(1, min(lanes, len(sizes), -(-int(sizes.sum()) // int(sizes.max()))))
        heap = [(0, k) for k in range(lanes)]
        lane, start = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
        for k in np.argsort(-sizes, kind="stable").tolist():
            used, mine = heap[0]
            lane[k], start[k] = mine, used
            heapq.heapreplace(heap, (used + int(sizes[k]), mine))
        steps = max(used for used, _ in heap)
        mine = np.repeat(np.arange(len(sizes)), sizes)
        place = np.arange(len(mine)) - (np.cumsum(sizes) - sizes)[mine]
        at = (place + start[mine]) * lanes + lane[mine]
        source = place + begin[mine]
        learnt = np.where(place < warm[mine], -1, tokens[source])
        shape = (steps, lanes)
        self.inputs = np.full(shape, end, np.int32)
        self.targets = np.full(shape, -1, np.int32)
        self.text = np.full(shape, -1, np.int32)
        self.going_on = np.ones(shape, np.float32)
        self.inputs.ravel()[at], self.targets.ravel()[at], self.text.ravel()[at] = before[source], learnt, of_text[mine]
        self.going_on.ravel()[start * lanes + lane] = 0.0


def _sigmoid_of_twice(x: np.ndarray) -> np.ndarray:
    """The logistic function of ``2 * x``, in place."""
    np.tanh(x, out=x)
    x *= 0.5
    x += 0.5
    return x


def read_window(w: dict, state: np.ndarray, inputs: np.ndarray, going_on: np.ndarray, trace: list | None = None) -> np.ndarray:
    """States after each step of a window; ``trace`` keeps what the way back needs."""
    states = np.empty((*inputs.shape, HIDDEN), np.float32)
    # Every gate in an array of its own: steps over slices of wide rows take several times as long.
    into = np.stack([0.5 * w["gates"][:, :HIDDEN], 0.5 * w["gates"][:, HIDDEN : 2 * HIDDEN]])
    into_new = np.ascontiguousarray(w["gates"][:, 2 * HIDDEN :])
    by = np.stack([0.5 * w["update"][:, :HIDDEN], 0.5 * w["update"][:, HIDDEN:]])
    begun = going_on == 0
    some = begun.any(1).tolist()
    for t in range(len(inputs)):
        old = state
        if some[t]:
            old = state.copy()
            old[begun[t]] = 0
        gates = old @ by
        gates += into.take(inputs[t], 1, mode="clip")
        renew, reset = _sigmoid_of_twice(gates)
        part = reset * old
        new = part @ w["new"]
        new += into_new.take(inputs[t], 0, mode="clip")
        np.tanh(new, out=new)
        state = new - old
        state *= renew
        state += old
        states[t] = state
        if trace is not None:
            trace.append((old, renew, reset, part, new))
    return states


def _log_and_shares(x: np.ndarray, at: np.ndarray, scale: float | None) -> np.ndarray:
    """Logarithm of the softmax at one column of every row; ``scale`` times the softmax itself, less 1 there, is left in ``x``."""
    cell = np.arange(0, x.size, x.shape[1]) + at
    if x.max() > FAR or x[:, 0].min() < -FAR:  # else no row sums up to too much or too little
        x -= x.max(1, keepdims=True)
    picked = x.ravel()[cell]
    np.exp(x, out=x)
    total = x @ np.ones(x.shape[1], x.dtype)
    if scale is not None:
        x *= (scale / total)[:, None]
        x.ravel()[cell] -= scale
    return picked - np.log(total)


def log_probabilities(
    w: dict, lexicon: Lexicon, states: np.ndarray, targets: np.ndarray, slopes: dict | None = None
) -> tuple[np.ndarray, np.ndarray | None]:
    """Natural logarithm of each target's class and of its place in the class (other words: of the class alone).

    With ``slopes``, those of the mean negative logarithm are added to it, and that by the states is returned.
    """
    kinds = lexicon.class_of[targets].astype(np.int16)
    order = np.argsort(kinds, kind="stable")
    kinds, states, places = kinds.take(order), states.take(order, 0), targets.take(order)
    logs = np.empty(len(targets))
    scale = None if slopes is None else 1.0 / len(targets)
    back = None if slopes is None else np.empty_like(states)
    for low in range(0, len(targets), BLOCK):
        part = slice(low, low + BLOCK)
        x = states[part] @ w["to_class"]
        x += w["class_bias"]
        logs[part] = _log_and_shares(x, kinds[part], scale)
        if slopes is not None:
            slopes["to_class"] += states[part].T @ x
            slopes["class_bias"] += x.sum(0)
            np.matmul(x, w["to_class"].T, out=back[part])
    ends = np.searchsorted(kinds, np.arange(lexicon.classes - 1))
    for k in range(lexicon.classes - 2):
        mine, low, high = slice(ends[k], ends[k + 1]), lexicon.bounds[k], lexicon.bounds[k + 1]
        if high - low < 2 or ends[k] == ends[k + 1]:
            continue
        x = states[mine] @ w["to_word"][low:high].T
        x += w["word_bias"][low:high]
        logs[mine] += _log_and_shares(x, places[mine] - low, scale)
        if slopes is not None:
            slopes["to_word"][low:high] += x.T @ states[mine]
            slopes["word_bias"][low:high] += x.sum(0)
            back[mine] += x @ w["to_word"][low:high]
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return logs.take(place), None if slopes is None else back.take(place, 0)


def add_rows(total: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """Add every row to that of ``total`` which ``at`` names."""
    order = np.argsort(at.astype(np.int16), kind="stable")
    names, first, n = np.unique(at[order], return_index=True, return_counts=True)
    rows = rows.take(order, 0)
    for k in np.flatnonzero(n > FEW).tolist():
        total[names[k]] += rows[first[k] : first[k] + n[k]].sum(0)
    few = np.flatnonzero(n <= FEW)
    few = few[np.argsort(-n[few], kind="stable")]
    first, left = first[few], np.cumsum(np.bincount(n[few], minlength=FEW + 1)[::-1])[::-1]  # words of so many rows at least
    sums = rows.take(first, 0)
    for place in range(1, FEW):
        sums[: left[place + 1]] += rows.take(first[: left[place + 1]] + place, 0)
    total[names[few]] += sums


def window_slopes(w: dict, lexicon: Lexicon, state: np.ndarray, inputs: np.ndarray, targets: np.ndarray, going_on: np.ndarray) -> tuple[dict, np.ndarray, float]:
    """Slopes of the mean negative logarithm over a window, its last state, and that mean."""
    trace: list = []
    states = read_window(w, state, inputs, going_on, trace)
    slopes = {name: np.zeros_like(value) for name, value in w.items()}
    known = np.flatnonzero(targets >= 0)
    logs, back = log_probabilities(w, lexicon, states.reshape(-1, HIDDEN).take(known, 0), targets.take(known), slopes)
    if len(known) < targets.size:
        down = np.zeros_like(states)
        down.reshape(-1, HIDDEN)[known] = back
    else:
        down = back.reshape(states.shape)
    later = np.zeros_like(state)
    inner = np.empty((*inputs.shape, 3 * HIDDEN), down.dtype)
    through_new, through_gates = (np.ascontiguousarray(w[name].T) for name in ("new", "update"))
    for t in range(len(inputs) - 1, -1, -1):
        old, renew, reset, part, new = trace[t]
        d_renew, d_reset, d_new = (inner[t][:, k * HIDDEN : (k + 1) * HIDDEN] for k in range(3))
        d = later
        d += down[t]
        kept = 1 - renew
        x = new * new
        np.subtract(1, x, out=x)
        x *= renew
        x *= d
        d_new[:] = x
        d_part = x @ through_new
        np.subtract(new, old, out=x)
        x *= renew
        x *= kept
        np.multiply(x, d, out=d_renew)
        np.subtract(1, reset, out=x)
        x *= part
        np.multiply(x, d_part, out=d_reset)
        d *= kept
        d_part *= reset
        d += d_part
        d += inner[t][:, : 2 * HIDDEN] @ through_gates
        d[going_on[t] == 0] = 0
    flat = inner.reshape(-1, 3 * HIDDEN)
    olds, parts = (np.concatenate([step[k] for step in trace]) for k in (0, 3))
    slopes["update"] += olds.T @ flat[:, : 2 * HIDDEN]
    slopes["new"] += parts.T @ flat[:, 2 * HIDDEN :]
    add_rows(slopes["gates"], inputs.ravel(), flat)
    return slopes, states[-1], float(-logs.mean())


class Trainer:
    """Weights on their way over texts, with the running means of their slopes."""

    def __init__(self, weights: dict, lexicon: Lexicon, rate: float) -> None:
        self.lexicon, self.rate, self.steps = lexicon, rate, 0
        self.w = {name: value.copy() for name, value in weights.items()}
        self.mean, self.square = ({name: np.zeros_like(value) for name, value in weights.items()} for _ in range(2))
        self.losses: list[float] = []

    def train(self, ids: np.ndarray, bounds: np.ndarray) -> None:
        """One pass over the texts, window by window."""
        words = len(ids) + len(bounds) - 1
        width = min(MOST_LANES, max(LANES, words // (LEAST_STEPS * WINDOW)))
        lanes = Lanes(ids, bounds, self.lexicon.end, width, RUN)
        state = np.zeros((lanes.inputs.shape[1], HIDDEN), np.float32)
        window = max(WINDOW, LANES * WINDOW // len(state))  # few lanes beside a very long text
        for low in range(0, len(lanes.inputs), window):
            part = slice(low, low + window)
            if not (lanes.targets[part] >= 0).any():
                continue
            slopes, state, loss = window_slopes(self.w, self.lexicon, state, lanes.inputs[part], lanes.targets[part], lanes.going_on[part])
            self.losses.append(loss)
            self._step(slopes)

    def _step(self, slopes: dict) -> None:
        self.steps += 1
        size = np.sqrt(sum(float(np.vdot(g, g)) for g in slopes.values()))
        cut = min(1.0, 1.0 / max(float(size), 1e-9))
        even, wide = 1 - 0.9**self.steps, 1 - 0.99**self.steps
        for name in slopes:
            every = [x[name].reshape(-1) for x in (slopes, self.mean, self.square, self.w)]
            for low in range(0, len(every[0]), STEP):  # a part that the processor's cache holds
                g, mean, square, w = (x[low : low + STEP] for x in every)
                g *= cut
                mean *= 0.9
                mean += 0.1 * g
                square *= 0.99
                np.multiply(g, g, out=g)
                g *= 0.01
                square += g
                np.divide(square, wide, out=g)
                np.sqrt(g, out=g)
                g += 1e-6
                np.divide(mean, g, out=g)
                g *= self.rate / even
                w -= g


def train_shard(w: dict, lexicon: Lexicon, ids: np.ndarray, bounds: np.ndarray, rate: float) -> tuple[dict, float]:
    """The weights after one pass over the texts, and the mean negative logarithm met."""
    trainer = Trainer(w, lexicon, rate)
    trainer.train(ids, bounds)
    return trainer.w, float(np.mean(trainer.losses)) if trainer.losses else 0.0


def _tokens(lexicon: Lexicon, texts: pa.Array, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Network tokens of whole texts, up to about ``most`` words, and where the texts begin."""
    ids, sizes = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    total = 0
    for _, raw, offsets in text_chunks(texts, HASH_BYTES):
        h1, h2, bounds = _word_pairs(raw, offsets)
        keep = len(bounds) - 1
        if most is not None:
            keep = int(np.searchsorted(bounds[1:], most - total, "right"))
        ids.append(lexicon.ids(lexicon.find(h1, h2))[: bounds[keep]])
        sizes.append(np.diff(bounds[: keep + 1]))
        total += int(bounds[keep])
        if keep < len(bounds) - 1:
            break
    return np.concatenate(ids), np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int64)


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Tokens of runs of whole texts of about ``CHUNK_WORDS`` words, and where the texts begin; no text is left out."""
    ids, sizes, held = [], [], 0
    for batch in batches:
        lists = batch.column(0)
        bounds, flat, low = lists.offsets.to_numpy(), lists.values.to_numpy(), 0
        while low < len(lists):
            high = max(low + 1, int(np.searchsorted(bounds, bounds[low] + CHUNK_WORDS - held, "right")) - 1)
            ids.append(flat[bounds[low] : bounds[high]])
            sizes.append(np.diff(bounds[low : high + 1]))
            held, low = held + len(ids[-1]), high
            if held >= CHUNK_WORDS or low < len(lists):
                yield np.concatenate(ids), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
                ids, sizes, held = [], [], 0
    if ids:
        yield np.concatenate(ids), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])


class Model:
    """Counts of all learning texts and the fitted network."""

    def __init__(self, learning: DataFrame, rounds: int = ROUNDS) -> None:
        """``learning``: its column ``text``."""
        self.spark = learning.sparkSession
        self.folder = work_folder(self.spark, "recurrent")
        texts = learning.count()
        self.counts = staged(word_counts(learning), f"{self.folder}/counts")
        self.lexicon = Lexicon(self.counts, texts)
        self.weights = first_weights(self.lexicon)
        self.losses: list[float] = []
        self.trained: list[int] = []  # tokens, by round
        if texts:
            self._fit(learning, texts, rounds)

    def _fit(self, learning: DataFrame, texts: int, rounds: int) -> None:
        words = self.lexicon.tokens
        share = min(1.0, max(1 / rounds, ROUND_WORDS / words))
        shards = max(SHARDS, round(words * share / SHARD_WORDS))
        lexicon = self.spark.sparkContext.broadcast(self.lexicon)

        def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, bounds = _tokens(lexicon.value, batch.column(1))
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["draw", "ids"])

        draw = F.pmod(F.xxhash64("text"), F.lit(HASHES))
        read = learning.select(draw.alias("draw"), "text").mapInArrow(tokens, "draw long, ids array<int>")
        dealt = read.repartitionById(shards, F.pmod(F.xxhash64("draw"), F.lit(shards)).cast("int"))
        dealt = staged(dealt.sortWithinPartitions("draw", "ids"), f"{self.folder}/tokens")
        for k in range(rounds):
            self._round(dealt.filter(self._arc(k / rounds, share)).select("ids"), RATES[min(k, len(RATES) - 1)], lexicon)

    @staticmethod
    def _arc(begin: float, share: float) -> Column:
        """Texts of an arc of the order of hashes; it goes on from the first hash behind the last."""
        low, high = int(begin * HASHES), int((begin + share) * HASHES) + 1
        return ((F.col("draw") >= low) & (F.col("draw") < high)) | (F.col("draw") < high - HASHES)

    def _round(self, dealt: DataFrame, rate: float, lexicon: Broadcast) -> None:
        """Every task trains on all of its texts from the same weights; their mean by words goes on."""
        weights = self.spark.sparkContext.broadcast(self.weights)
        names = ["words", "loss", "weights"]

        def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            trainer = Trainer(weights.value, lexicon.value, rate)
            words = 0
            for ids, bounds in chunks(batches):
                trainer.train(ids, bounds)
                words += len(ids) + len(bounds) - 1
            if words:
                scaled = {name: w * np.float64(words) for name, w in trainer.w.items()}
                loss = float(np.mean(trainer.losses)) * words
                yield pa.RecordBatch.from_arrays([pa.array([words]), pa.array([loss]), pa.array([pickle.dumps(scaled)])], names)

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words, loss, total = 0, 0.0, None
            for batch in batches:
                for n, lost, blob in zip(*(batch.column(k) for k in range(3)), strict=True):
                    mine = pickle.loads(blob.as_py())
                    words, loss = words + n.as_py(), loss + lost.as_py()
                    total = mine if total is None else {name: total[name] + w for name, w in mine.items()}
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([words]), pa.array([loss]), pa.array([pickle.dumps(total)])], names)

        schema = "words long, loss double, weights binary"
        fitted = dealt.mapInArrow(fit, schema).withColumn("part", F.spark_partition_id())
        fitted = fitted.repartitionById(ADDERS, F.col("part") % ADDERS).sortWithinPartitions("part").select(*names)
        found = fitted.mapInArrow(add, schema).collect()  # ADDERS rows at most
        total = sum(r["words"] for r in found)
        self.trained.append(total)
        if total:
            parts = [pickle.loads(r["weights"]) for r in found]
            self.weights = {name: (sum(p[name] for p in parts) / total).astype(np.float32) for name in self.weights}
            self.losses.append(sum(r["loss"] for r in found) / total)
        weights.unpersist()

    def _read(self, documents: DataFrame, keep: list[str]) -> DataFrame:
        """The columns in ``keep``, sums over the words that tasks know, and the hashes of the others."""
        lexicon, weights = (self.spark.sparkContext.broadcast(x) for x in (self.lexicon, self.weights))
        width = len(keep)
        names = [*keep, "words", "known", "base", "network", "h1", "h2"]

        def score_group(group: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
            ids = np.concatenate([i for i, _ in group])
            bounds = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(b) for _, b in group]))])
            lanes = Lanes(ids, bounds, lexicon.value.end, SCORE_LANES)
            out = np.zeros(len(bounds) - 1)
            state = np.zeros((lanes.inputs.shape[1], HIDDEN), np.float32)
            window = max(SCORE_WINDOW, SCORE_TOKENS // len(state))
            for low in range(0, len(lanes.inputs), window):
                part = slice(low, low + window)
                states = read_window(weights.value, state, lanes.inputs[part], lanes.going_on[part])
                state = states[-1]
                targets = lanes.targets[part]
                known = np.flatnonzero(targets >= 0)
                logs, _ = log_probabilities(weights.value, lexicon.value, states.reshape(-1, HIDDEN).take(known, 0), targets.take(known))
                out += np.bincount(lanes.text[part].take(known), logs, minlength=len(out))
            return out

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lex = lexicon.value
            log_base = np.log10((lex.n + 1) / (lex.tokens + lex.types + 1))
            log_tail = np.where(lex.rank == lex.tail, np.log10((lex.n + 1) / lex.tail_total), 0.0)
            for batch in batches:
                begun, group, rows, size = 0, [], [], 0

                def finished(end: int, batch=batch) -> pa.RecordBatch:  # noqa: B023
                    words, known, base, tail, h1, h2, counts = (np.concatenate(c) for c in zip(*rows, strict=True))  # noqa: B023
                    network = score_group(group) / np.log(10) + tail  # noqa: B023
                    ends = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
                    columns = [batch.column(k).slice(begun, end - begun) for k in range(width)]  # noqa: B023
                    lists = [pa.ListArray.from_arrays(ends, pa.array(h)) for h in (h1, h2)]
                    return pa.RecordBatch.from_arrays([*columns, *map(pa.array, (words, known, base, network)), *lists], names)

                for first, raw, offsets in text_chunks(batch.column(width), HASH_BYTES):
                    if size and size + len(raw) > GROUP_BYTES:
                        yield finished(first)
                        begun, group, rows, size = first, [], [], 0
                    h1, h2, bounds = _word_pairs(raw, offsets)
                    at = lex.find(h1, h2)
                    n = len(bounds) - 1
                    row = np.repeat(np.arange(n), np.diff(bounds))
                    hit = at >= 0
                    per = lambda values, n=n, row=row, hit=hit: np.bincount(row[hit], values, minlength=n).astype(float)
                    counts = np.bincount(row[~hit], minlength=n)
                    rows.append((np.diff(bounds), np.bincount(row[hit], minlength=n), per(log_base[at[hit]]), per(log_tail[at[hit]]), h1[~hit], h2[~hit], counts))
                    group.append((lex.ids(at), bounds))
                    size += len(raw)
                if rows:
                    yield finished(len(batch))

        kinds = dict(documents.dtypes)
        schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "words long, known long, base double, network double, h1 array<long>, h2 array<long>"])
        return documents.select(*keep, F.col("text").cast("string")).mapInArrow(read, schema)

    def score(self, documents: DataFrame, keep: list[str]) -> DataFrame:
        """``keep`` and n_tokens, n_known, train_tokens, base_score, score of every row."""
        lex = self.lexicon
        packed = documents.select(F.struct(*keep).alias("kept"), "text")
        read = self._read(packed, ["kept"]).withColumn("row", F.monotonically_increasing_id())
        read = staged(read, f"{self.folder}/read")
        rare = read.select("row", F.inline(F.arrays_zip("h1", "h2")))
        level = F.floor(F.log2("n") * 16).cast("int")
        rest = self.counts.filter(level < lex.lowest)
        sums = rare.join(rest, ["h1", "h2"], "left").groupBy("row").agg(
            F.count("n").alias("rare_known"), F.count("*").alias("rare"), F.sum(F.log10(F.coalesce("n", F.lit(0)) + 1)).alias("logs")
        )
        whole = read.drop("h1", "h2").join(sums, "row", "left").fillna(0, ["rare_known", "rare", "logs"])
        base_total, tail_total = float(lex.tokens + lex.types + 1), float(lex.tail_total)
        end = float(np.log10((lex.texts + 1) / base_total))
        return whole.select(
            *[F.col("kept")[c].alias(c) for c in keep],
            (F.col("words") + 1).alias("n_tokens"),
            (F.col("known") + F.col("rare_known") + int(lex.texts > 0)).alias("n_known"),
            F.lit(int(lex.tokens)).cast("long").alias("train_tokens"),
            (F.col("base") + end + F.col("logs") - F.col("rare") * float(np.log10(base_total))).alias("base_score"),
            (F.col("network") + F.col("logs") - F.col("rare") * float(np.log10(tail_total))).alias("score"),
        )
