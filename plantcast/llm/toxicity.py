"""Toxicity scores: gradient-boosted trees over dense features, with isotonic calibration.

The lexicon is learned: words and word beginnings, hashed to slots, with the log ratio of their
document frequencies in toxic and other learning texts. A slot counts only if it was seen in toxic
texts after at least ``MIN_CONTEXTS`` different words, so that passages repeated in copies teach
nothing. Digits and signs that stand for letters hash like those letters. Features per document are
densities and counts of lexicon words and beginnings, the strongest of each, lexicon words near a
second-person pronoun, rates of capitals, punctuation, repeated punctuation and obfuscated words, and
the length. For learning rows the row's own share is taken out of the lexicon counts first.

Defined results: null and empty texts have all features 0 and are scored like others; repeated rows
get equal scores; with no learning rows of both kinds every score is the share of toxic ones (0
without any); an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantcast.llm import common
from plantcast.llm.common import broadcast_if_few, drop_folder, span_hashes, staged, text_chunks, word_spans, work_folder

SLOTS = 1 << 19
BEGINNINGS = (4, 5)  # bytes
MIN_CONTEXTS = 4
NEAR_WORDS = 5
FEATURE_BYTES = 1 << 19  # of text at once; a worker holds some hundred bytes for each
SAMPLE = {1: 8_000, 0: 16_000}  # learning rows of each kind at most, chosen by hash of doc_id
# Second-person pronouns, and signs written for letters.
SECOND_PERSON = "you your yours yourself u du dich dir dein deine ihr euch tu te toi ton ta vous votre tú ti usted ustedes vos".split()
FOR_LETTERS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
FEATURES = (
    "word_density word_hits begin_density begin_hits word_most begin_most log_odds near_person capitals punctuation "
    "repeated_punctuation obfuscated log_words"
).split()

_WORD = common.ALNUM.copy()
_WORD[[ord("@"), ord("$")]] = True
_VALUES = common._BYTE.copy()
for _sign, _letter in FOR_LETTERS.items():
    _VALUES[ord(_sign)] = _VALUES[ord(_letter)]
_OBFUSCATION = np.zeros(256, bool)
_OBFUSCATION[[ord(c) for c in FOR_LETTERS]] = True
_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True
_LETTER = _UPPER.copy()
_LETTER[0x61:0x7B] = True
_LETTER[0x80:] = True
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True


def _term_slots(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row of each word, word hash, slots by term kind, starts, ends) of a run of texts; -1 for no term."""
    starts, ends = word_spans(raw, offsets, _WORD)
    row = np.searchsorted(offsets, starts, "right") - 1
    cuts = [(starts, np.minimum(starts + n, ends)) for n in BEGINNINGS]
    hashes = span_hashes(raw, [(starts, ends), *cuts], _VALUES) if len(raw) else [np.zeros(0, np.uint64)] * 3
    slots = np.empty((len(hashes), len(starts)), np.int64)
    for k, h in enumerate(hashes):
        slots[k] = ((h + np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 19)
        if k:
            slots[k][ends - starts <= BEGINNINGS[k - 1]] = -1
    return row, hashes[0], slots, starts, ends


def _person_hashes() -> np.ndarray:
    raw = np.frombuffer(" ".join(SECOND_PERSON).encode(), np.uint8)
    return np.sort(span_hashes(raw, [word_spans(raw, np.array([0, len(raw)]), _WORD)], _VALUES)[0])


def lexicon_counts(learning: DataFrame) -> DataFrame:
    """(slot, toxic, other, contexts): document frequencies and a bit map of words before, in toxic texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs = np.zeros((2, SLOTS), np.int64)
        contexts = np.zeros(SLOTS, np.uint64)
        for batch in batches:
            labels = np.array(batch.column(1).to_pylist(), np.int64)
            last = np.zeros(1, np.uint64)  # the word before goes on from run to run
            for first, raw, offsets in text_chunks(batch.column(0), FEATURE_BYTES):
                row, words, slots, _, _ = _term_slots(raw, offsets)
                before = np.concatenate([last, words])[:-1]
                last = words[-1:] if len(words) else last
                bit = np.uint64(1) << (before >> np.uint64(58))
                toxic_word = labels[first + row] == 1
                for s in slots:
                    used = s >= 0
                    seen = np.unique(row[used] * SLOTS + s[used])
                    for label in (0, 1):
                        mine = seen[labels[first + seen // SLOTS] == label] % SLOTS
                        docs[label] += np.bincount(mine, minlength=SLOTS)
                    np.bitwise_or.at(contexts, s[used & toxic_word], bit[used & toxic_word])
        slots = np.flatnonzero(docs.any(0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(slots), pa.array(docs[1][slots]), pa.array(docs[0][slots]), pa.array(contexts[slots].view(np.int64))],
            ["slot", "toxic", "other", "contexts"],
        )

    rows = learning.select("text", "toxic").mapInArrow(count, "slot long, toxic long, other long, contexts long")
    return rows.groupBy("slot").agg(
        F.sum("toxic").alias("toxic"), F.sum("other").alias("other"), F.bit_or("contexts").alias("contexts")
    )


class Lexicon:
    """Document frequencies by slot, for the slots that pass; ``SLOTS`` rows at most."""

    def __init__(self, counts: DataFrame, toxic: int, other: int) -> None:
        # Slots more frequent, by share, in toxic texts; all others have log ratio 0.
        passing = counts.filter(F.bit_count("contexts") >= MIN_CONTEXTS).filter(
            (F.col("toxic") + 0.5) * (other + 1) > 3 * (F.col("other") + 0.5) * (toxic + 1)
        )
        kept = passing.toPandas().sort_values("slot")
        self.slots = kept["slot"].to_numpy()
        self.toxic, self.other = kept["toxic"].to_numpy(), kept["other"].to_numpy()
        self.totals = (toxic, other)

    def table(self) -> np.ndarray:
        at = np.full(SLOTS + 1, -1, np.int32)
        at[self.slots] = np.arange(len(self.slots))
        return at

    def log_ratio(self, entry: np.ndarray, own: np.ndarray | None) -> np.ndarray:
        """Log ratios of entries (-1: none); ``own`` is the label of the row itself, to be taken out."""
        if len(self.slots) == 0:
            return np.zeros(len(entry))
        toxic, other = self.toxic[entry].astype(float), self.other[entry].astype(float)
        n_toxic, n_other = self.totals
        if own is not None:
            toxic, other = np.maximum(toxic - (own == 1), 0), np.maximum(other - (own == 0), 0)
        ratio = np.log((toxic + 0.5) / (n_toxic + 1)) - np.log((other + 0.5) / (n_other + 1))
        return np.where(entry >= 0, np.maximum(ratio, 0), 0.0)


def features(rows: DataFrame, lexicon: Lexicon, keep: list[str], own_label: str | None = None) -> DataFrame:
    """The columns in ``keep`` and one double per feature; ``own_label`` for learning rows."""
    person = _person_hashes()

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = lexicon.table()
        for batch in batches:
            texts = batch.column(len(keep))
            labels = np.array(batch.column(len(keep) + 1).to_pylist(), np.int64) if own_label else None
            out = np.zeros((len(texts), len(FEATURES)))
            for first, raw, offsets in text_chunks(texts, FEATURE_BYTES):
                n = len(offsets) - 1
                row, words, slots, starts, ends = _term_slots(raw, offsets)
                own = labels[first + row] if own_label else None
                ratio = [lexicon.log_ratio(table[s], own) for s in slots]
                begin = np.maximum(ratio[1], ratio[2])
                count = np.bincount(row, minlength=n)
                per = lambda x: np.bincount(row, x, minlength=n)
                hit, begin_hit = ratio[0] > 2, begin > 2
                said = np.zeros(len(words) + 1, np.int64)
                at = np.minimum(np.searchsorted(person, words), len(person) - 1)
                np.cumsum(person[at] == words, out=said[1:])
                index = np.arange(len(words))
                lo = np.maximum(index - NEAR_WORDS, np.searchsorted(row, row))
                hi = np.minimum(index + NEAR_WORDS + 1, np.searchsorted(row, row, "right"))
                near = hit & (said[hi] > said[lo])
                most, begin_most = np.zeros(n), np.zeros(n)
                np.maximum.at(most, row, ratio[0])
                np.maximum.at(begin_most, row, begin)

                def rate(mask: np.ndarray, offsets: np.ndarray = offsets) -> np.ndarray:
                    sums = np.concatenate([[0], np.cumsum(mask)])
                    return (sums[offsets[1:]] - sums[offsets[:-1]]).astype(float)

                letters = rate(_LETTER[raw])
                signs = _PUNCTUATION[raw]
                twice = signs.copy()
                twice[1:] &= signs[:-1]
                twice[:1] = False
                odd = np.concatenate([[0], np.cumsum(_OBFUSCATION[raw])])
                alpha = np.concatenate([[0], np.cumsum(_LETTER[raw])])
                obfuscated = (odd[ends] > odd[starts]) & (alpha[ends] > alpha[starts])
                some, size = np.maximum(count, 1), np.maximum(np.diff(offsets), 1)
                out[first : first + n] = np.column_stack([
                    per(hit) / some, np.log1p(per(hit)), per(begin_hit) / some, np.log1p(per(begin_hit)), most, begin_most,
                    per(ratio[0]) / some, np.log1p(per(near)), rate(_UPPER[raw]) / np.maximum(letters, 1),
                    rate(signs) / size, rate(twice) / size, per(obfuscated) / some, np.log1p(count),
                ])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *map(pa.array, out.T)], [*keep, *FEATURES])

    kinds = dict(rows.dtypes)
    schema = ", ".join(chain((f"`{c}` {kinds[c]}" for c in keep), (f"{c} double" for c in FEATURES)))
    return rows.select(*keep, "text", *([own_label] if own_label else [])).mapInArrow(extract, schema)


def learning_sample(labels: DataFrame) -> DataFrame:
    """At most ``SAMPLE`` (doc_id, toxic, weight) of each kind, those of least hash; weights restore the shares."""
    usable = labels.filter("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    parts = []
    for kind, bound in SAMPLE.items():
        mine = usable.filter(F.col("toxic") == kind)
        chosen = mine.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
        parts.append(chosen.withColumn("weight", mine.agg(F.greatest(F.count("*") / F.lit(bound), F.lit(1.0))).scalar()))
    return parts[0].unionByName(parts[1])


class Model:
    """Lexicon, trees and calibration; without rows of both kinds only the share of toxic ones."""

    def __init__(self, documents: DataFrame, labels: DataFrame) -> None:
        spark = documents.sparkSession
        folder = work_folder(spark, "toxicity")
        sample = staged(learning_sample(labels), f"{folder}/sample")
        rows = documents.select("doc_id", "text").join(broadcast_if_few(sample), "doc_id")
        rows = staged(rows.repartition(8, F.xxhash64("doc_id")), f"{folder}/rows")
        sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
        toxic, other = sizes.get(1, 0), sizes.get(0, 0)
        self.share = toxic / max(toxic + other, 1)
        self.lexicon, self.trees, self.calibration = None, None, None
        if toxic and other:
            self.lexicon = Lexicon(lexicon_counts(rows), toxic, other)
            table = features(rows, self.lexicon, ["doc_id", "weight", "toxic"], "toxic")
            table = staged(self._assembled(table).withColumn("label", F.col("toxic").cast("double")), f"{folder}/features")
            table = table.coalesce(4)
            self.trees = GBTClassifier(
                maxIter=12, maxDepth=3, stepSize=0.3, weightCol="weight", seed=7, minInstancesPerNode=3, maxBins=64
            ).fit(table)
            margins = self._margins(table).select("margin", "label", "weight")
            self.calibration = IsotonicRegression(featuresCol="margin", weightCol="weight").fit(margins)
        drop_folder(spark, folder)

    @staticmethod
    def _assembled(table: DataFrame) -> DataFrame:
        return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(table).drop(*FEATURES)

    def _margins(self, table: DataFrame) -> DataFrame:
        out = self.trees.setRawPredictionCol("raw").setPredictionCol("class").setProbabilityCol("sure").transform(table)
        return out.withColumn("margin", F.get(vector_to_array("raw"), F.lit(1))).drop("raw", "class", "sure", "features")

    def score(self, documents: DataFrame, keep: list[str]) -> DataFrame:
        """The columns in ``keep`` and ``score``, from 0 to 1."""
        if self.lexicon is None:
            return documents.select(*keep, F.lit(self.share).alias("score"))
        margins = self._margins(self._assembled(features(documents, self.lexicon, keep)))
        calibrated = self.calibration.setPredictionCol("score").transform(margins)
        return calibrated.select(*keep, F.least(F.greatest("score", F.lit(0.0)), F.lit(1.0)).alias("score"))
