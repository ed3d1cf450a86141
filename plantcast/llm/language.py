"""Language identification with error-correcting output codes.

Every language has a codeword; each bit has a binary classifier over hashed byte n-grams of the
lower-cased text: the log ratio of the n-gram's share in the languages whose bit is 1 and in those
whose bit is 0. The classifiers are learned from counts over all learning rows. Decoding sums, per
codeword, the logistic loss of every bit's mean log ratio, weighted by how much text there is, and
takes the language of least loss; the score is that language's share of exp(-loss), and a text is
ambiguous when the runner-up is close.

Defined results: null texts and texts without a letter are ``und`` with score 0; so is every text if
there is nothing to learn from. Rows with null language teach nothing. An empty table gives an empty
table; repeated rows get equal predictions; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantcast.llm.common import staged, text_chunks, work_folder

SLOTS = 1 << 13
ORDERS = (1, 2, 3)
SHARE_UNITS = 1e14  # shares are added up as whole numbers of this part, alike in any order
LOSSES = 1 << 22  # losses that are computed together
EVIDENCE = 200.0  # n-grams from which on more text adds no weight
LETTER = re.compile(r"[^\W\d_]")


def _gram_counts(texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """First row and n-gram counts (rows by slots) of runs of texts."""
    for row, raw, offsets in text_chunks(pc.utf8_lower(texts.cast(pa.large_string()))):
        n = len(offsets) - 1
        grams, code = [], np.zeros(len(raw), np.uint32)
        for order in ORDERS:
            length = max(len(raw) - order + 1, 0)
            code = code[:length] * np.uint32(257) + raw[order - 1 :].astype(np.uint32) + np.uint32(1)
            grams.append(((code * np.uint32(2654435761)) >> np.uint32(32 - 13)).astype(np.int64))
        for low in range(0, n, 128):
            block = np.zeros((min(128, n - low), SLOTS), np.float32)
            for i in range(len(block)):
                begin, end = offsets[low + i], offsets[low + i + 1]
                for order, gram in zip(ORDERS, grams, strict=True):
                    if end - begin >= order:
                        block[i] += np.bincount(gram[begin : end - order + 1], minlength=SLOTS)
            yield row + low, block


def gram_totals(learning: DataFrame) -> DataFrame:
    """(lang, slot, n) over the rows (text, lang) of ``learning``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), object)
            for row, block in _gram_counts(batch.column(0)):
                shares = block / np.maximum(block.sum(1, keepdims=True), 1)  # every text counts alike
                here = langs[row : row + len(block)]
                for lang in set(here):
                    total = totals.setdefault(lang, np.zeros(SLOTS))
                    total += shares[here == lang].sum(0)
        for lang, total in totals.items():
            slots = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(slots), pa.string()), pa.array(slots, pa.int32()), pa.array(total[slots])],
                ["lang", "slot", "n"],
            )

    rows = learning.select("text", "lang").mapInArrow(count, "lang string, slot int, n double")
    # Whole millionths add up alike in any order.
    return rows.groupBy("lang", "slot").agg(F.sum(F.rint(F.col("n") * 1e6).cast("long")).alias("n"))


def codebook(languages: int) -> np.ndarray:
    """Codewords of -1 and 1, one row per language: all splits for few languages, seeded random ones for many."""
    if languages <= 1:
        return np.ones((languages, 1))
    if languages <= 6:
        return np.array([(1, *rest) for rest in product((1, -1), repeat=languages - 1) if -1 in rest], float).T
    bits = 12 * int(np.ceil(np.log2(languages)))
    if languages > 1000:  # comparing all pairs would grow with the square; longer words keep random ones apart
        return np.random.default_rng(0).choice([-1.0, 1.0], (languages, 2 * bits))
    tries = [np.random.default_rng(k).choice([-1.0, 1.0], (languages, bits)) for k in range(50)]
    return max(tries, key=lambda code: -(code @ code.T - 2 * bits * np.eye(languages)).max())


def bit_totals(totals: DataFrame, languages: list[str], code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the languages' shares by bit and slot, of those whose bit is 1 and of those whose bit is -1."""
    bits = code.shape[1]
    ones = {lang: code[k] > 0 for k, lang in enumerate(languages)}

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, bits, SLOTS), np.int64)
        for batch in batches:
            for lang, slots, n in zip(*batch.to_pydict().values(), strict=True):
                counts = np.zeros(SLOTS)
                counts[slots] = n
                counts += counts.sum() * 1e-7 + 1
                share = np.rint(counts / counts.sum() * SHARE_UNITS).astype(np.int64)
                sums[0, ones[lang]] += share
                sums[1, ~ones[lang]] += share
        if sums.any():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(2 * bits)), pa.array([*sums.reshape(2 * bits, SLOTS)], pa.list_(pa.int64()))], ["row", "shares"]
            )

    # collected by slot, so that every language is one row of at most SLOTS counts
    rows = totals.groupBy("lang").agg(F.collect_list("slot").alias("slots"), F.collect_list("n").alias("n"))
    parts = rows.mapInArrow(add, "row long, shares array<long>")
    summed = parts.select("row", F.posexplode("shares").alias("slot", "n")).groupBy("row", "slot").agg(F.sum("n").alias("n"))
    found, out = summed.toArrow(), np.zeros((2 * bits, SLOTS))
    out[found["row"].to_numpy(), found["slot"].to_numpy()] = found["n"].to_numpy()
    return out[:bits], out[bits:]


def learn(learning: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, codebook, weights by slot and bit) of all labels; two sums per bit and slot reach the driver."""
    usable = learning.filter("lang IS NOT NULL AND text IS NOT NULL AND text <> ''")
    totals = staged(gram_totals(usable), work_folder(learning.sparkSession, "grams"))
    languages = sorted(r["lang"] for r in totals.select("lang").distinct().collect())
    code = codebook(len(languages))
    weights = np.zeros((SLOTS, code.shape[1] if len(languages) > 1 else 1))
    if len(languages) > 1:
        ones, zeros = bit_totals(totals, languages, code)
        n_ones, n_zeros = (code > 0).sum(0)[:, None], (code < 0).sum(0)[:, None]
        weights = np.log(ones / n_ones).T - np.log(zeros / n_zeros).T
    return languages, code, weights.astype(np.float32)


def decode(block: np.ndarray, code: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index of the nearest codeword, its score and whether the choice is ambiguous, per row of counts."""
    n = block.sum(1)
    mean = (block @ weights) / np.maximum(n, 1)[:, None]
    sure = np.minimum(n, EVIDENCE)[:, None] * mean
    loss = np.empty((len(block), len(code)))
    step = max(1, LOSSES // max(1, len(block) * code.shape[1]))
    for low in range(0, len(code), step):
        loss[:, low : low + step] = np.logaddexp(0.0, -code[None, low : low + step] * sure[:, None, :]).sum(2)
    order = np.argsort(loss, axis=1, kind="stable")
    best = order[:, 0]
    share = np.exp(loss.min(1, keepdims=True) - loss)
    score = 1 / share.sum(1)
    if loss.shape[1] == 1:
        return best, score, np.zeros(len(best), bool)
    ranked = np.take_along_axis(loss, order[:, :2], 1)
    return best, score, ranked[:, 1] - ranked[:, 0] < 2.0


def identify(documents: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray]) -> DataFrame:
    """(doc_id, lang_pred, score, ambiguous) of every document."""
    languages, code, weights = model

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array(languages, object)
        for batch in batches:
            ids, texts = batch.columns
            letters = np.array([t is not None and LETTER.search(t) is not None for t in texts.to_pylist()], bool)
            pred = np.full(len(ids), "und", object)
            score, unsure = np.zeros(len(ids)), np.ones(len(ids), bool)
            if languages:
                for row, block in _gram_counts(texts):
                    at = slice(row, row + len(block))
                    best, score[at], unsure[at] = decode(block, code, weights)
                    pred[at] = names[best]
            pred[~letters], score[~letters], unsure[~letters] = "und", 0.0, True
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(pred, pa.string()), pa.array(score), pa.array(unsure)], ["doc_id", "lang_pred", "score", "ambiguous"]
            )

    kind = dict(documents.dtypes)["doc_id"]
    return documents.select("doc_id", "text").mapInArrow(
        predict, f"doc_id {kind}, lang_pred string, score double, ambiguous boolean"
    )
