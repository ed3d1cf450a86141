r"""Phrase collocation mining by external streams of counts.

A word is ``[^\x20\x09]+`` within a piece of a text, pieces end at ``[.,;:!?\x0A-\x0D]``, A-Z count as a-z.
Every language (null: ``und``) is counted for itself.

Only words with ``least`` occurrences or more can be part of a candidate. Each such word occurrence makes
one record: the word and up to four before it in its piece, as far as they are frequent too. The records
are dealt by range and sorted in suffix order (last word first), where the occurrences of every phrase
of any length are one run; one pass adds up all lengths at once. A phrase that is cut by a border of two
ranges leaves a part in each, which are added afterwards. So a hot word or pair spreads over many tasks.

The phrases that reach ``least`` then form two streams, in suffix and in prefix order. Walking one of
them, the counts of all the suffixes (prefixes) of a phrase are those of the runs it lies in, and its most
frequent extension by a word to the left (right) is the largest run within its own. Both streams, sorted by
phrase, are joined by merging. Scores are exact integers in decimals.

Words travel as integers: the ``CODES`` most frequent as small ones, which tasks receive as a table of
bounded size, others as 63-bit hashes; a bitmap of fixed size says which others may be frequent. Runs of texts
(about 2 MB) report a word with each hash; should a frequent one come with two words, all hashes are drawn anew.

A candidate is dropped if a longer one that contains it is as frequent: then so is an extension by one word.

Defined results: null and empty texts have no words; repeated rows count each; ties in the ranking go by
phrase in byte order. Empty tables give an empty table; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plantcast.llm.common import _mix, drop_folder, scan_tasks, span_hashes, staged, text_chunks, word_spans, work_folder

LONGEST = 5
CODES = 1 << 18
BITMAP_BITS = 24
SALTS = 8
SAMPLE_DOCUMENTS = 4096  # for the borders of the ranges only
SAMPLE_ROWS = 100_000
WORDS = [f"w{k}" for k in range(1, LONGEST + 1)]
WORD_COLUMNS = ", ".join(f"{w} long" for w in WORDS)
PARTS = [f"p{k}" for k in range(1, LONGEST)]
BUCKETS = 64

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09]] = True
_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_WORD = ~(_SPACE | _BREAK)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def _lang_seeds(langs: pa.Array, salt: int) -> np.ndarray:
    """A 64-bit number for every row's language."""
    encoded = langs.dictionary_encode()
    seeds = [hashlib.blake2b(s.encode(), digest_size=8, salt=bytes([salt])).digest() for s in encoded.dictionary.to_pylist()]
    return np.array([int.from_bytes(s, "little") for s in seeds], np.uint64)[encoded.indices.to_numpy()]


def _runs(batch: pa.RecordBatch, salt: int, bits: int) -> Iterator[tuple]:
    """For runs of texts of (lang, text): bytes, starts and ends of words, their row, their hash, whether a piece begins."""
    seeds = _lang_seeds(batch.column(0), salt)
    for first, raw, offsets in text_chunks(batch.column(1)):
        starts, ends = word_spans(raw, offsets, _WORD)
        if not len(starts):
            continue
        row = np.searchsorted(offsets, starts, "right") - 1
        hashes = _mix(span_hashes(raw, [(starts, ends)])[0] ^ seeds[first + row]) >> np.uint64(64 - bits)
        breaks = np.concatenate([[0], np.cumsum(_BREAK[raw])])[starts]
        begins = np.ones(len(starts), bool)
        begins[1:] = (row[1:] != row[:-1]) | (breaks[1:] != breaks[:-1])
        yield raw, starts, ends, first + row, hashes.astype(np.int64), begins


def _texts(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The spans as lower-cased strings."""
    lengths = ends - starts
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    at = np.repeat(starts - offsets[:-1], lengths) + np.arange(offsets[-1])
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(_LOWER[raw[at]]))


def vocabulary(documents: DataFrame, salt: int, bits: int) -> DataFrame:
    """(lang, hash, word, n) of every word of (lang, text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw, starts, ends, row, hashes, _ in _runs(batch, salt, bits):
                _, at, n = np.unique(hashes, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row[at])), pa.array(hashes[at]), _texts(raw, starts[at], ends[at]), pa.array(n)],
                    ["lang", "hash", "word", "n"],
                )

    counted = documents.mapInArrow(count, "lang string, hash long, word string, n long")
    return counted.groupBy("lang", "hash", "word").agg(F.sum("n").alias("n"))


def frequent_words(documents: DataFrame, least: int, folder: str, bits: int = 63) -> tuple[DataFrame, DataFrame, int]:
    """Words with ``least`` occurrences (lang, hash, word, n), the words of every language, and the salt of the hashes."""
    for salt in range(SALTS):
        words = staged(vocabulary(documents, salt, bits), f"{folder}/words{salt}")
        by_hash = words.groupBy("hash").agg(F.count("*").alias("words"), F.sum("n").alias("total"))
        clash = (F.col("words") > 1) | (F.col("hash") <= CODES)
        if by_hash.filter((F.col("total") >= least) & clash).limit(1).count() == 0:
            frequent = staged(words.filter(F.col("n") >= least), f"{folder}/frequent")
            totals = staged(words.groupBy("lang").agg(F.sum("n").alias("n_words")), f"{folder}/totals")
            drop_folder(words.sparkSession, f"{folder}/words{salt}")
            return frequent, totals, salt
        drop_folder(words.sparkSession, f"{folder}/words{salt}")
    raise RuntimeError(f"words share hashes of {bits} bits under each of {SALTS} salts")


class Codes:
    """Integer codes of words by hash: small ones from a table of bounded size, else the hash, 0 for rare words."""

    def __init__(self, frequent: DataFrame) -> None:
        level = F.floor(F.log2("n") * 16).cast("int")
        levels = frequent.groupBy(level.alias("level")).agg(F.count("*").alias("words")).orderBy(F.desc("level")).collect()
        self.lowest, held = None, 0
        for level_row in levels:  # 1,024 of them at most
            if held + level_row["words"] > CODES:
                break
            self.lowest, held = level_row["level"], held + level_row["words"]
        chosen = frequent.filter(level >= self.lowest) if self.lowest is not None else frequent.limit(0)
        table = chosen.select("hash", "n").toArrow()
        hashes, n = (table.column(k).to_numpy() for k in (0, 1))
        rank = np.empty(len(hashes), np.int64)
        rank[np.lexsort((hashes, -n))] = np.arange(1, len(hashes) + 1)
        order = np.argsort(hashes)
        self.hashes, self.codes = hashes[order], rank[order]
        self.bitmap = None
        if held < sum(r["words"] for r in levels):
            rest = frequent.filter(level < self.lowest) if self.lowest is not None else frequent
            bit = F.col("hash").bitwiseAND((1 << BITMAP_BITS) - 1)
            cells = rest.groupBy(F.shiftright(bit, 3).alias("at")).agg(F.bit_or(F.expr("1 << CAST(hash & 7 AS int)")).alias("bits")).toArrow()
            self.bitmap = np.zeros(1 << (BITMAP_BITS - 3), np.uint8)
            self.bitmap[cells.column("at").to_numpy()] = cells.column("bits").to_numpy().astype(np.uint8)

    def of(self, hashes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(hashes), np.int64)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            out = np.where(self.hashes[at] == hashes, self.codes[at], 0)
        if self.bitmap is not None:
            low = hashes & ((1 << BITMAP_BITS) - 1)
            maybe = (self.bitmap[low >> 3] >> (low & 7).astype(np.uint8)) & 1
            out = np.where((out == 0) & (maybe == 1), hashes, out)
        return out

    def table(self, frequent: DataFrame) -> DataFrame:
        """(code, lang, word, n) of the frequent words."""
        spark = frequent.sparkSession
        own = pa.table({"hash": pa.array(self.hashes, pa.int64()), "code": pa.array(self.codes, pa.int64())})
        small = spark.createDataFrame(own) if len(self.hashes) else spark.createDataFrame([], "hash long, code long")
        return frequent.join(small, "hash", "left").select(F.coalesce("code", "hash").alias("code"), "lang", "word", "n")


def _windows(codes: np.ndarray, begins: np.ndarray) -> list[np.ndarray]:
    """Each word and the four before it in its piece, a column each; 0 from the first rare word or border on."""
    columns, inside = [codes], codes != 0
    piece = np.cumsum(begins)
    for k in range(1, LONGEST):
        before, same = np.zeros_like(codes), np.zeros(len(codes), bool)
        before[k:], same[k:] = codes[:-k], piece[k:] == piece[:-k]
        inside = inside & same & (before != 0)
        columns.append(np.where(inside, before, 0))
    keep = columns[1] != 0
    return [c[keep] for c in columns]


def _combined(columns: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows in order, and how often each occurs."""
    values, rank = np.unique(np.stack(columns), return_inverse=True)
    bits = max(len(values).bit_length(), 1)
    if 3 * bits > 63:
        order = np.lexsort(columns[::-1])
    else:
        rank = rank.reshape(LONGEST, -1).astype(np.int64)
        order = np.lexsort((rank[3] << bits | rank[4], (rank[0] << bits | rank[1]) << bits | rank[2]))
    columns = [c[order] for c in columns]
    new = np.ones(len(order), bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    at = np.flatnonzero(new)
    return [c[at] for c in columns], np.diff(np.append(at, len(order)))


def _range_of(columns: list[np.ndarray], borders: np.ndarray) -> np.ndarray:
    """The range of each of the sorted rows; a row at or after border k belongs to k + 1 or later."""
    cuts = []
    for border in borders:
        low, high = 0, len(columns[0])
        for column, value in zip(columns, border, strict=True):
            part = column[low:high]
            low, high = low + int(np.searchsorted(part, value)), low + int(np.searchsorted(part, value, "right"))
            if low == high:
                break
        cuts.append(low)
    return np.searchsorted(np.array(cuts, np.int64), np.arange(len(columns[0])), "right").astype(np.int32)


def suffix_records(documents: DataFrame, codes: Codes, salt: int, bits: int, borders: np.ndarray) -> DataFrame:
    """(range, w1 to w5, n): words and those before them, the last first; equal ones of a run of texts once."""

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, _, _, hashes, begins in _runs(batch, salt, bits):
                columns = _windows(codes.of(hashes), begins)
                if not len(columns[0]):
                    continue
                columns, n = _combined(columns)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_range_of(columns, borders)), *map(pa.array, columns), pa.array(n)], ["range", *WORDS, "n"]
                )

    return documents.mapInArrow(records, f"range int, {WORD_COLUMNS}, n long")


def range_borders(documents: DataFrame, codes: Codes, salt: int, bits: int, ranges: int) -> np.ndarray:
    """Borders of ranges of about equal size, from a bounded sample; they decide where records go, not what is counted."""
    share = min(1.0, SAMPLE_DOCUMENTS / max(documents.count(), 1))
    sample = documents.sample(share, 1) if share < 1 else documents
    rows = suffix_records(sample, codes, salt, bits, np.zeros((0, LONGEST), np.int64))
    table = rows.orderBy(F.xxhash64(*WORDS)).limit(SAMPLE_ROWS).select(*WORDS).toArrow()
    if not len(table):
        return np.zeros((0, LONGEST), np.int64)
    columns, n = _combined([c.to_numpy() for c in table.columns])
    at = np.searchsorted(np.cumsum(n), len(table) * np.arange(1, ranges) / ranges)
    return np.unique(np.stack([c[at] for c in columns], 1), axis=0)


def run_counts(ordered: DataFrame, least: int) -> DataFrame:
    """(w1 to w5, n) of the runs of two words or more; runs below ``least`` only where a task begins or ends."""

    def emit(rows: list[tuple[np.ndarray, np.ndarray]], length: int) -> pa.RecordBatch:
        codes = np.concatenate([c for c, _ in rows])
        codes = np.concatenate([codes[:, :length], np.zeros((len(codes), LONGEST - length), np.int64)], 1)
        return pa.RecordBatch.from_arrays([*map(pa.array, codes.T), pa.array(np.concatenate([n for _, n in rows]))], [*WORDS, "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, count, first = None, [0] * LONGEST, [True] * LONGEST  # of the open runs, by length
        for batch in batches:
            if not len(batch):
                continue
            codes = np.stack([batch.column(k).to_numpy() for k in range(LONGEST)], 1)
            sums = np.concatenate([[0], np.cumsum(batch.column(LONGEST).to_numpy())])
            before = np.concatenate([codes[:1] if last is None else last[None], codes[:-1]])
            differs = np.logical_or.accumulate(codes != before, axis=1)
            for length in range(2, LONGEST + 1):
                starts = np.flatnonzero(differs[:, length - 1])
                if not len(starts):
                    count[length - 1] += int(sums[-1])
                    continue
                total = np.diff(np.concatenate([[0], sums[starts]]))  # up to each start
                total[0] += count[length - 1]
                runs = before[starts]
                keep = total >= least
                keep[0] |= first[length - 1]
                keep &= (runs[:, length - 1] != 0) & (total > 0)
                if keep.any():
                    yield emit([(runs[keep], total[keep])], length)
                count[length - 1], first[length - 1] = int(sums[-1] - sums[starts[-1]]), False
            last = codes[-1]
        if last is not None:
            for length in range(2, LONGEST + 1):
                if last[length - 1] != 0:
                    yield emit([(last[None], np.array([count[length - 1]]))], length)

    return ordered.select(*WORDS, "n").mapInArrow(add, f"{WORD_COLUMNS}, n long")


def lockstep(ordered: DataFrame) -> DataFrame:
    """(w1 to w5, n, p1 to p4, extension): each phrase with the counts of its first 1 to 4 words and of its most
    frequent extension by a word behind, from a stream in which phrases follow their beginnings."""
    names = [*WORDS, "n", *PARTS, "extension"]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, len(names)), np.int64)  # phrases that the last one lies in: not yet closed
        for batch in batches:
            if not len(batch):
                continue
            rows = np.zeros((len(held) + len(batch), len(names)), np.int64)
            rows[: len(held)] = held
            for k in range(LONGEST + 1):
                rows[len(held) :, k] = batch.column(k).to_numpy()
            length = (rows[:, :LONGEST] != 0).sum(1)
            index = np.arange(len(rows))
            latest = np.stack([np.maximum.accumulate(np.where(length == k, index, -1)) for k in range(1, LONGEST + 1)], 1)
            for k in range(1, LONGEST):
                longer = np.flatnonzero(length > k)
                rows[longer, LONGEST + k] = rows[latest[longer, k - 1], LONGEST]
                child = np.flatnonzero(length == k + 1)
                np.maximum.at(rows[:, -1], latest[child, k - 1], rows[child, LONGEST])
            keep = np.zeros(len(rows), bool)
            keep[latest[-1, : length[-1]]] = True
            held = rows[keep]
            yield pa.RecordBatch.from_arrays(list(map(pa.array, rows[~keep].T)), names)
        if len(held):
            yield pa.RecordBatch.from_arrays(list(map(pa.array, held.T)), names)

    return ordered.select(*WORDS, "n").mapInArrow(walk, ", ".join(f"{c} long" for c in names))


def _reversed() -> list:
    """The words of a phrase in the other order."""
    words = F.reverse(F.filter(F.array(*WORDS), lambda w: w != 0))
    return [F.coalesce(F.get(words, F.lit(k)), F.lit(0)).alias(w) for k, w in enumerate(WORDS)]


def phrase_counts(documents: DataFrame, least: int, folder: str, bits: int = 63) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Phrases of one to five words with ``least`` occurrences (w1 to w5 from the last word, n); words by code; words by language."""
    tasks = scan_tasks(documents)
    frequent, totals, salt = frequent_words(documents, least, folder, bits)
    codes = Codes(frequent)
    words = staged(codes.table(frequent), f"{folder}/codes")
    borders = range_borders(documents, codes, salt, bits, tasks)
    records = suffix_records(documents, codes, salt, bits, borders)
    ordered = records.repartitionById(tasks, "range").sortWithinPartitions(*WORDS)
    runs = run_counts(ordered, least).groupBy(*WORDS).agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    single = words.select(F.col("code").alias("w1"), *[F.lit(0).cast("long").alias(w) for w in WORDS[1:]], "n")
    return staged(single.union(runs), f"{folder}/phrases"), words, totals


def scored_candidates(phrases: DataFrame, words: DataFrame, totals: DataFrame, tasks: int) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of the candidates that no extension of the same count replaces."""
    suffixes = lockstep(phrases.repartition(tasks, "w1").sortWithinPartitions(*WORDS))
    prefixes = lockstep(phrases.select(*_reversed(), "n").repartition(tasks, "w1").sortWithinPartitions(*WORDS))
    back = suffixes.filter("w2 <> 0").select(*WORDS, F.col("n").alias("a"), *[F.col(p).alias(f"s{p}") for p in PARTS], F.col("extension").alias("left_extension"))
    ahead = prefixes.filter("w2 <> 0").select(*_reversed(), *PARTS, "extension")
    both = back.join(ahead.hint("merge"), WORDS).filter("a > left_extension AND a > extension")
    spelled = (
        both.select(*WORDS, F.posexplode(F.reverse(F.filter(F.array(*WORDS), lambda w: w != 0))).alias("at", "code"))
        .join(words.select("code", "lang", "word"), "code")
        .groupBy(*WORDS)
        .agg(F.max("lang").alias("lang"), F.array_join(F.sort_array(F.collect_list(F.struct("at", "word"))).getField("word"), " ").alias("phrase"), F.count("*").alias("length"))
    )
    whole = both.join(spelled, WORDS).join(totals.withColumnRenamed("n_words", "n"), "lang")
    exact = "CAST({} AS DECIMAL(19, 0))".format
    cuts = []
    for k in range(1, LONGEST):
        rest = F.get(F.array(*[f"s{p}" for p in PARTS]), F.col("length").cast("int") - 1 - k)
        cuts.append(F.when(F.col("length") > k, F.struct(F.lit(k).alias("k"), F.col(PARTS[k - 1]).alias("l"), rest.alias("r"))))
    cut = whole.withColumn("cut", F.explode(F.array_compact(F.array(*cuts))))
    score = F.expr(f"({exact('a * 1000')} * {exact('n')}) DIV ({exact('cut.l')} * {exact('cut.r')})")
    lowest = F.min(F.struct(score.alias("score"), F.col("cut.k"), F.col("cut.l"), F.col("cut.r"))).alias("low")
    return cut.groupBy("lang", "phrase", "a", "n").agg(lowest).select("lang", "phrase", "a", "low.l", "low.r", "n", "low.score")


def collocations(documents: DataFrame, least: int = 100, most: int = 2000, bits: int = 63) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``most`` best phrases."""
    spark = documents.sparkSession
    folder = work_folder(spark, "phrases")
    texts = documents.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    phrases, words, totals = phrase_counts(texts, least, folder, bits)
    scored = staged(scored_candidates(phrases, words, totals, scan_tasks(documents)), f"{folder}/scored")
    for name in ("frequent", "codes", "totals", "phrases"):
        drop_folder(spark, f"{folder}/{name}")
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    # The best of every language are among the best of its buckets, so no task ranks all of a language.
    bucket = F.pmod(F.xxhash64("phrase"), F.lit(BUCKETS))
    part = scored.withColumn("place", F.row_number().over(Window.partitionBy("lang", bucket).orderBy(*order))).filter(F.col("place") <= most)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")
    ranked = part.withColumn("rank", rank).filter(F.col("rank") <= most)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
