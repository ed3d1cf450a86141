"""The recurrent language model: slopes, probabilities, counts and whole texts."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plantcast.llm import recurrent
from plantcast.llm.recurrent import HIDDEN, Lanes, Lexicon, Model

ROW = "doc_id long, text string, held_out boolean"


def words(text):
    lower = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return [w for w in re.split(r"[\x20\x09-\x0D]+", lower) if w]


def two_tongues(n, seed):
    """Texts of either of two vocabularies, so that what came before tells what comes."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        tongue = rng.choice(["a", "b"])
        out.append(" ".join(f"{tongue}{min(int(rng.expovariate(0.1)), 300)}" for _ in range(rng.randint(5, 120))))
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    rows = [(k, t, k % 7 == 2) for k, t in enumerate(two_tongues(500, 1))]
    rows += [
        (1000, None, False), (1001, "", True), (1002, " \t\n\x0b ", False), (1003, "never seen befÖre ÉÉ A1 a1", True),
        (1004, " ".join(t for t in two_tongues(300, 5) if t[0] == "a"), True), (None, "b1 b2", False), (7000, "a1 a2", False), (7000, "a1 a2", False),
    ]
    return rows


@pytest.fixture(scope="module")
def model(spark, rows):
    df = spark.createDataFrame(rows, ROW)
    return Model(df.filter("NOT held_out"), rounds=2)


def test_counts_and_base(spark, rows, model):
    df = spark.createDataFrame(rows, ROW).repartition(3).withColumns({"row": F.lit("x"), "n": F.lit(1), "known": F.lit("y"), "h1": F.lit(None)})
    got = model.score(df, ["doc_id", "held_out", "row", "n", "known"]).collect()
    counts = Counter()
    for _, text, held_out in rows:
        if not held_out:
            counts.update([*words(text), None])
    total, types = sum(counts.values()), len(counts)
    want = {}
    for i, text, held_out in rows:
        tokens = [*words(text), None]
        base = sum(math.log10((counts[t] + 1) / (total + types + 1)) for t in tokens)
        want.setdefault(i, []).append((held_out, len(tokens), sum(counts[t] > 0 for t in tokens), total, base))
    assert len(got) == len(rows)
    for r in got:
        exact = want[r["doc_id"]][0]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == exact[:4]
        assert r["base_score"] == pytest.approx(exact[4], abs=1e-8)
        assert r["score"] < 0 and (r["row"], r["n"], r["known"]) == ("x", 1, "y")
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held) + 0.1 * sum(r["n_tokens"] for r in held)


def test_words_outside_of_the_lexicon_are_joined(spark, rows, model, monkeypatch):
    """With a lexicon of a few words most counts come from the join; base scores are the same."""
    monkeypatch.setattr(recurrent, "LEXICON", 40)
    df = spark.createDataFrame(rows, ROW)
    small = Model(df.filter("NOT held_out"), rounds=1)
    assert len(small.lexicon.h1) <= 40
    key = [F.xxhash64("doc_id")]
    a, b = (m.score(df, ["doc_id"]).orderBy(*key).collect() for m in (model, small))
    assert [(r["doc_id"], r["n_tokens"], r["n_known"]) for r in a] == [(r["doc_id"], r["n_tokens"], r["n_known"]) for r in b]
    assert [r["base_score"] for r in a] == pytest.approx([r["base_score"] for r in b], abs=1e-8)


def test_probabilities_sum_to_one(model):
    lex = model.lexicon
    rng = np.random.default_rng(0)
    states = rng.normal(size=(3, HIDDEN)).astype(np.float32)
    every = np.arange(lex.words + 2, dtype=np.int32)
    for s in states:
        logs, _ = recurrent.log_probabilities(model.weights, lex, np.repeat(s[None], len(every), 0), every)
        assert np.exp(logs).sum() == pytest.approx(1.0, abs=1e-4)
    rest = lex.n[lex.rank == lex.tail]
    assert ((rest + 1) / lex.tail_total).sum() + 1 / lex.tail_total == pytest.approx(1.0)


def test_slopes_against_differences():
    class Small:
        words, end, tail, classes, bounds = 5, 5, 6, 4, [0, 2, 5]
        class_of = np.array([0, 0, 1, 1, 1, 2, 3], np.int32)
        class_bias, word_bias = np.zeros(4), np.zeros(5)

    w = {k: v.astype(np.float64) for k, v in recurrent.first_weights(Small).items()}
    rng = np.random.default_rng(1)
    inputs, targets = rng.integers(0, 7, (6, 3)), rng.integers(0, 7, (6, 3))
    targets[4:, 2] = -1
    going_on = np.ones((6, 3))
    going_on[0], going_on[3, 1] = 0, 0
    state = np.zeros((3, HIDDEN))

    def loss(weights):
        states = recurrent.read_window(weights, state, inputs, going_on).astype(np.float64)
        known = targets >= 0
        return -recurrent.log_probabilities(weights, Small, states[known], targets[known])[0].mean()

    slopes, _, _ = recurrent.window_slopes(w, Small, state, inputs, targets, going_on)
    for name, value in w.items():
        for at in rng.integers(0, value.size, 5).tolist():
            ends = []
            for step in (1e-2, -1e-2):
                moved = {**w, name: value.copy()}
                moved[name].ravel()[at] += step
                ends.append(loss(moved))
            assert slopes[name].ravel()[at] == pytest.approx((ends[0] - ends[1]) / 2e-2, abs=2e-4), name


def test_state_runs_through_whole_texts(model):
    """Any lanes and windows give what one text alone in one window gives."""
    rng = np.random.default_rng(3)
    sizes = [0, 1, 700, 5, 33, 0, 64, 2]
    texts = [rng.integers(0, model.lexicon.words, n).astype(np.int32) for n in sizes]
    want = []
    for ids in texts:
        lanes = Lanes(ids, np.array([0, len(ids)]), model.lexicon.end, 1)
        states = recurrent.read_window(model.weights, np.zeros((1, HIDDEN), np.float32), lanes.inputs, lanes.going_on)
        want.append(recurrent.log_probabilities(model.weights, model.lexicon, states[:, 0], lanes.targets[:, 0])[0].sum())
    lanes = Lanes(np.concatenate(texts), np.concatenate([[0], np.cumsum(sizes)]), model.lexicon.end, 3)
    out, state = np.zeros(len(sizes)), np.zeros((lanes.inputs.shape[1], HIDDEN), np.float32)
    for low in range(0, len(lanes.inputs), 7):
        part = slice(low, low + 7)
        states = recurrent.read_window(model.weights, state, lanes.inputs[part], lanes.going_on[part])
        state, known = states[-1], lanes.targets[part] >= 0
        logs = recurrent.log_probabilities(model.weights, model.lexicon, states[known], lanes.targets[part][known])[0]
        out += np.bincount(lanes.text[part][known], logs, minlength=len(sizes))
    assert out == pytest.approx(want, rel=1e-5)


def test_small_groups_of_texts_give_the_same(spark, rows, model):
    df = spark.createDataFrame(rows, ROW)
    a = {r["doc_id"]: r["score"] for r in model.score(df.coalesce(1), ["doc_id"]).collect()}
    b = {r["doc_id"]: r["score"] for r in model.score(df.repartition(40), ["doc_id"]).collect()}
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], rel=1e-5) for k in a)


def test_empty_tables(spark):
    none = spark.createDataFrame([], ROW)
    one = spark.createDataFrame([(1, "a b", True), (2, None, True)], ROW)
    untrained = Model(none)
    assert untrained.score(none, ["doc_id"]).collect() == []
    got = {r["doc_id"]: r for r in untrained.score(one, ["doc_id"]).collect()}
    assert (got[1]["n_tokens"], got[1]["n_known"], got[1]["train_tokens"], got[1]["base_score"]) == (3, 0, 0, 0.0)
    assert Model(one.filter("doc_id = 2"), rounds=1).score(one, ["doc_id"]).filter("n_known = 1").count() == 2


def test_training_takes_whole_texts_up_to_the_bound(model):
    ids, bounds = recurrent._tokens(model.lexicon, pa.array(["a1 a2", None, "a3", "a4 a5 a6 a7", "a1"]), 4)
    assert bounds.tolist() == [0, 2, 2, 3] and len(ids) == 3


def test_every_learning_text_trains(spark, monkeypatch):
    """No bound on texts or words: over the rounds every text comes once, with few words to a round once in each."""
    texts = [*(f"a{k % 9} b{k % 7} c{k}" for k in range(6000)), "a1 b2 c3 " * 1000, None]
    tokens = sum(len(words(t)) + 1 for t in texts)
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    assert Model(df, rounds=2).trained == [tokens, tokens]
    monkeypatch.setattr(recurrent, "ROUND_WORDS", 500)
    model = Model(df, rounds=3)
    assert len(model.trained) == 3 and sum(model.trained) == tokens and len(model.losses) == 3


def test_chunks_hold_whole_texts_once(monkeypatch):
    monkeypatch.setattr(recurrent, "CHUNK_WORDS", 6)
    texts = [[1, 2], [], [3] * 20, [4], [5, 6, 7], [8, 9], [], [10]]
    batches = [pa.RecordBatch.from_arrays([pa.array(part, pa.list_(pa.int32()))], ["ids"]) for part in (texts[:5], texts[5:])]
    got = list(recurrent.chunks(iter(batches)))
    read = [ids[low:high].tolist() for ids, bounds in got for low, high in zip(bounds[:-1], bounds[1:], strict=True)]
    assert read == texts and len(got) > 2


@pytest.mark.parametrize(("rounds", "share"), [(4, 0.25), (4, 0.4), (4, 1.0), (3, 1 / 3), (1, 1.0)])
def test_arcs_cover_all_hashes(spark, rounds, share):
    draws = spark.range(0, recurrent.HASHES, recurrent.HASHES // 997).withColumnRenamed("id", "draw")
    taken = [draws.filter(Model._arc(k / rounds, share)) for k in range(rounds)]
    met = {r["draw"] for part in taken for r in part.collect()}
    assert len(met) == draws.count()


def test_runs_of_a_long_text_learn_every_token_once():
    """A long text lies in lanes side by side, each run behind the tokens that came before it."""
    rng = np.random.default_rng(5)
    sizes = [300, 0, 2500, 1023, 1024, 7]
    ids, bounds = rng.integers(0, 50, sum(sizes)).astype(np.int32), np.concatenate([[0], np.cumsum(sizes)])
    lanes = Lanes(ids, bounds, 50, 64, recurrent.RUN)
    assert len(lanes.inputs) <= recurrent.RUN + recurrent.WARM
    learnt = lanes.targets >= 0
    assert learnt.sum() == sum(sizes) + len(sizes)
    for text, (low, high) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        mine = lanes.targets[learnt & (lanes.text == text)]
        assert sorted(mine.tolist()) == sorted([*ids[low:high].tolist(), 50])
    for lane in range(lanes.inputs.shape[1]):
        for t in np.flatnonzero(learnt[:, lane] & (lanes.going_on[:, lane] > 0)).tolist():
            if learnt[t - 1, lane]:
                assert lanes.inputs[t, lane] == lanes.targets[t - 1, lane]


def test_softmax_of_far_apart_rows():
    """Rows whose exponents would sum up to too much or too little are weighed by their greatest."""
    x = np.array([[200.0, 0, 1], [-300, -301, -302], [0, 1, 2]], np.float32)
    at = np.array([1, 0, 2])
    want = [math.log(1 / (math.exp(200) + 1 + math.e)), -math.log(1 + math.exp(-1) + math.exp(-2)), -math.log(1 + math.exp(-1) + math.exp(-2))]
    for rows in ([0, 1, 2], [1], [2]):
        got = recurrent._log_and_shares(x[rows].copy(), at[rows], None)
        assert got.tolist() == pytest.approx([want[r] for r in rows], rel=1e-5)


def test_words_are_found_by_slots():
    """Hashes that share a slot, or all but the second half, are told apart."""
    rng = np.random.default_rng(6)
    h1 = np.concatenate([rng.integers(-(1 << 63), 1 << 63, 500), np.arange(7) + (5 << 50), [-(1 << 63), (1 << 63) - 1, 9, 9]])
    h2 = np.concatenate([rng.integers(-(1 << 63), 1 << 63, len(h1) - 2), [1, 2]])
    order = np.lexsort((h2, h1))
    lex = Lexicon.__new__(Lexicon)
    lex.h1, lex.h2 = h1[order], h2[order]
    lex.starts = recurrent.slot_starts(lex.h1)
    assert lex.find(lex.h1, lex.h2).tolist() == list(range(len(h1)))
    assert lex.find(lex.h1, lex.h2 + 7).tolist() == [-1] * len(h1)
    assert lex.find(lex.h1 + 1000, lex.h2).tolist() == [-1] * len(h1)
    lex.h1, lex.h2, lex.starts = h1[:0], h2[:0], recurrent.slot_starts(h1[:0])
    assert lex.find(h1, h2).tolist() == [-1] * len(h1)


@pytest.mark.parametrize("n", [0, 1, 255, 256, 700])
def test_sums_over_rows(n):
    rng = np.random.default_rng(n)
    b, at = rng.normal(size=(n, 3)), np.minimum(rng.zipf(1.3, n), 90)
    got, want = np.ones((91, 3)), np.ones((91, 3))
    recurrent.add_rows(got, at, b)
    np.add.at(want, at, b)
    assert got == pytest.approx(want)
