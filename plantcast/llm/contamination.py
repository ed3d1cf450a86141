"""Benchmark decontamination by SimHash over item-sized windows.

Words are runs of letters and digits, lower-cased. A document window has as many words as the item
it is compared with; a text shorter than the item is one window. The similarity of a window is the weight of the item's
shingles that it has, over the weight of all of them; a shingle weighs 1 + ln(items / items that have it). An item is
found if its best candidate window has ``threshold`` or more.

1. The shingles that a whole text shares with an item bound all its windows from above. Texts whose bound stays under
   the threshold for every item are left out; none of their windows can pass.
2. In the others, windows of an item's size that begin at a shared shingle, align one with its first place in the item,
   or end the text get SimHash fingerprints of ``BITS`` bits, one vote per word.
3. Fingerprints of windows and items of equal size meet in an index of ``BLOCKS`` bit blocks. Two within ``RADIUS`` bits
   differ by RADIUS // BLOCKS or less in some block, and a window looks every block up under all values that near, so none within
   the radius is missed.
4. Candidates are verified by their exact similarity. Aligned windows win ties, then the first.

A window that shares the part p of its words with an item differs in about acos(p) / pi of the bits, 0.3 at 0.6. With 256 bits
that is 75 of them with a deviation of 7; the radius lies 20 above, and unrelated windows, at 128, stay out.

Items are read in slices of about ``SLICE_WORDS`` words and at most about ``SLICE_ITEMS`` items, so the index that tasks
receive is bounded, and so is the driver, which holds one slice at a time; the weights are those of the whole benchmark.

Defined results: null and empty texts and items never match; an item shorter than a shingle is one
shingle; rows that repeat a doc_id give one row per (doc_id, item_id), the best; further ties of
windows go to the first. Empty tables give an empty table. Further columns are ignored. Both ids keep their type.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantcast.llm.common import ALNUM, SMALL_BYTES, _mix, drop_folder, shingle_hashes, staged, text_chunks, word_hashes, work_folder

WIDTH = 3
BITS = 256
RADIUS = 95
BLOCKS = 32
BLOCK_BITS = BITS // BLOCKS
ROWS = 256  # texts that are lower-cased together
SPAN = 4096  # words whose votes are summed up together
PAIRS = 1 << 18  # windows and items that are compared together
SLICE_WORDS = 500_000
SLICE_ITEMS = 8192
HITS = 1 << 18  # shared shingles, one per item, that are looked at together
ROUNDING = 1e-9
NEAR_VALUES = np.array(
    [sum(1 << b for b in bits) for r in range(RADIUS // BLOCKS + 1) for bits in combinations(range(BLOCK_BITS), r)]
)


def _words(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for low in range(0, len(texts), ROWS):
        for row, raw, offsets in text_chunks(pc.utf8_lower(texts.slice(low, ROWS).cast(pa.large_string())), SMALL_BYTES):
            yield low + row, *word_hashes(raw, offsets, ALNUM)


def fingerprints(words: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """SimHash of the windows of ``length`` words at ascending ``starts``, one row of ``BITS`` / 8 bytes each."""
    out = np.zeros((len(starts), BITS // 8), np.uint8)
    low = 0
    while low < len(starts):
        high = int(np.searchsorted(starts, starts[low] + SPAN))
        part = words[starts[low] : starts[high - 1] + length]
        wide = np.stack([_mix(part + np.uint64(k)) for k in range(BITS // 64)], 1)
        votes = np.zeros((len(part) + 1, BITS), np.int32)
        np.cumsum(np.unpackbits(wide.view(np.uint8), axis=1), axis=0, out=votes[1:])
        first = starts[low:high] - starts[low]
        out[low:high] = np.packbits((votes[first + length] - votes[first]) * 2 > length, axis=1)
        low = high
    return out


class BlockIndex:
    """Fingerprints of items of one length by the values of their bit blocks."""

    def __init__(self, prints: np.ndarray) -> None:
        self.prints = prints
        self.order = np.argsort(prints, axis=0, kind="stable").T
        values = np.arange((1 << BLOCK_BITS) + 1)
        self.begin = np.stack([np.searchsorted(p[o], values) for p, o in zip(prints.T, self.order, strict=True)])

    def near(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) of all fingerprints within the radius."""
        found = [np.zeros(0, np.int64)]
        step = max(1, PAIRS // (BLOCKS * len(NEAR_VALUES) + 5 * len(self.prints)))
        for low in range(0, len(windows), step):
            part, keys = windows[low : low + step], []
            for block in range(BLOCKS):
                value = part[:, block, None].astype(np.int64) ^ NEAR_VALUES
                lo, hi = self.begin[block][value].ravel(), self.begin[block][value + 1].ravel()
                some = np.flatnonzero(hi > lo)
                count = (hi - lo)[some]
                at = np.repeat(lo[some] - (np.cumsum(count) - count), count) + np.arange(count.sum())
                keys.append(np.repeat(some // len(NEAR_VALUES), count) * len(self.prints) + self.order[block][at])
            pairs = np.unique(np.concatenate(keys))
            window, item = np.divmod(pairs, len(self.prints))
            differ = np.bitwise_count(part[window].view(np.uint64) ^ self.prints[item].view(np.uint64)).sum(1)
            found.append(pairs[differ <= RADIUS] + low * len(self.prints))
        return np.divmod(np.concatenate(found), len(self.prints))


def shingle_weight(items: int, having: int) -> float:
    return float(1 + np.log(items / having))


class ItemIndex:
    """Shingles and fingerprint blocks of a bounded slice of the benchmark, with the weights of its shingles."""

    def __init__(self, items: list[str], weight: dict[int, float] | None = None) -> None:
        words = {}
        for row, hashes, bounds in _words(pa.array(items, pa.string())):
            for i in range(len(bounds) - 1):
                if bounds[i + 1] > bounds[i]:
                    words[row + i] = hashes[bounds[i] : bounds[i + 1]]
        self.ids = list(words)  # positions in ``items``
        self.words = list(words.values())
        self.shingles = [shingle_hashes(w, min(WIDTH, len(w))) for w in self.words]
        own = [np.unique(s, return_index=True) for s in self.shingles]
        self.distinct, self.place = [hashes for hashes, _ in own], [place for _, place in own]
        if weight is None:  # the slice is the whole benchmark
            seen: dict[int, int] = defaultdict(int)
            for s in self.distinct:
                for h in s.tolist():
                    seen[h] += 1
            weight = {h: shingle_weight(len(self.words), n) for h, n in seen.items()}
        self.weights = [np.array([weight[h] for h in s.tolist()]) for s in self.distinct]
        self.weight_of = [dict(zip(s.tolist(), w.tolist(), strict=True)) for s, w in zip(self.distinct, self.weights, strict=True)]
        self.total = np.array([math.fsum(w) for w in self.weights])
        self.length = np.array([len(w) for w in self.words], np.int64)
        self.width = np.minimum(self.length, WIDTH)
        # one seed for every shingle of every item, by hash; those of hash k are begin[k] to begin[k + 1]
        seed = np.concatenate([np.zeros(0, np.uint64), *self.distinct])
        item = np.repeat(np.arange(len(self.words)), [len(s) for s in self.distinct])
        order = np.lexsort((item, seed))
        self.seed_item = item[order]
        self.seed_weight = np.concatenate([np.zeros(0), *self.weights])[order]
        self.hashes, begin = np.unique(seed[order], return_index=True)
        self.begin = np.append(begin, len(seed))
        self.bitmap = np.zeros(1 << 22, bool)
        self.bitmap[self.hashes >> np.uint64(42)] = True
        self.of_length = {n: np.flatnonzero(self.length == n) for n in np.unique(self.length).tolist()}
        zero = np.zeros(1, np.int64)
        self.prints = np.concatenate(
            [np.zeros((0, BITS // 8), np.uint8), *[fingerprints(w, zero, len(w)) for w in self.words]]
        )
        self.blocks = {n: BlockIndex(self.prints[items]) for n, items in self.of_length.items()}

    def _passing(self, row: np.ndarray, known: np.ndarray, width: int, threshold: float) -> Iterator[tuple[int, int]]:
        """(row, item) whose shared shingles weigh enough in the whole text; ``known`` says which hash a place has."""
        if not len(row):
            return
        keys = np.unique(row * len(self.hashes) + known)  # one per text and hash, by text
        row, known = np.divmod(keys, len(self.hashes))
        count = self.begin[known + 1] - self.begin[known]
        until, low = np.cumsum(count), 0
        texts = np.append(np.flatnonzero(np.diff(row)) + 1, len(row))  # where the texts end
        while low < len(row):
            # whole texts of about HITS seeds; one text has each seed once
            before = until[low] - count[low]
            stop = texts[max(np.searchsorted(until[texts - 1], before + HITS, "right") - 1, np.searchsorted(texts, low, "right"))]
            times, first = count[low:stop], self.begin[known[low:stop]]
            seed = np.repeat(first - (np.cumsum(times) - times), times) + np.arange(times.sum())
            pair, at = np.unique(np.repeat(row[low:stop], times) * len(self.words) + self.seed_item[seed], return_inverse=True)
            shared = np.bincount(at, self.seed_weight[seed])
            item = pair % len(self.words)
            enough = (self.width[item] == width) & (shared >= threshold * self.total[item] - ROUNDING)
            yield from zip((pair[enough] // len(self.words)).tolist(), item[enough].tolist(), strict=True)
            low = stop

    def _starts(self, item: int, place: np.ndarray, shingles: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """First words of the windows to look at, those aligned with the item, and all, of a text that has ``shingles`` at ``place``."""
        mine = self.distinct[item]
        local = np.minimum(np.searchsorted(mine, shingles), len(mine) - 1)
        hit = mine[local] == shingles
        last = max(end - int(self.length[item]), 0)
        aligned = np.unique(np.clip(place[hit] - self.place[item][local[hit]], 0, last))
        return aligned, np.union1d(aligned, np.minimum(place[hit], last))

    def similarity(self, item: int, shingles: np.ndarray) -> float:
        """Weight of the item's shingles among ``shingles``, of all it has."""
        weight = self.weight_of[item]
        return math.fsum(weight[h] for h in weight.keys() & shingles.tolist()) / self.total[item]

    def matches(self, words: np.ndarray, bounds: np.ndarray, threshold: float) -> Iterator[tuple[int, int, int, float]]:
        """(row, item, first word, similarity) of the best candidate window of every text and item that pass."""
        looked: dict[tuple[int, int], list[np.ndarray]] = defaultdict(list)  # by length of item and window, the starts
        aligned: dict[tuple[int, int], set[int]] = {}
        of_width = {width: shingle_hashes(words, width) for width in np.unique(self.width).tolist()}
        for width, shingles in of_width.items():
            at = np.flatnonzero(self.bitmap[shingles >> np.uint64(42)])
            known = np.minimum(np.searchsorted(self.hashes, shingles[at]), len(self.hashes) - 1)
            row = np.searchsorted(bounds, at, "right") - 1
            inside = (self.hashes[known] == shingles[at]) & (at + width <= bounds[row + 1])
            at, known, row = at[inside], known[inside], row[inside]
            for text, item in self._passing(row, known, width, threshold):
                first, stop = np.searchsorted(row, [text, text + 1])
                begin, end, length = int(bounds[text]), int(bounds[text + 1]), int(self.length[item])
                fit, starts = self._starts(item, at[first:stop] - begin, shingles[at[first:stop]], end - begin)
                aligned[text, item] = set((fit + begin).tolist())
                looked[length, min(length, end - begin)].append(starts + begin)
        best: dict[tuple[int, int], tuple[float, bool, int]] = {}
        for (length, size), parts in looked.items():
            starts = np.unique(np.concatenate(parts))
            window, near = self.blocks[length].near(fingerprints(words, starts, size))
            width = min(WIDTH, length)
            n = size - width + 1  # shingles of a window
            for first, item in zip(starts[window].tolist(), self.of_length[length][near].tolist(), strict=True):
                text = int(np.searchsorted(bounds, first, "right")) - 1
                value = self.similarity(item, of_width[width][first : first + n])
                if value >= threshold:
                    rank = value, first in aligned.get((text, item), ()), -first
                    best[text, item] = max(rank, best.get((text, item), rank))
        for (text, item), (value, _, first) in sorted(best.items()):
            yield text, item, -first - int(bounds[text]), float(value)


def _item_shingles(benchmark: DataFrame) -> DataFrame:
    """(slice, shingle) of the distinct shingles of every item, and a null shingle for every item that has words."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, words, bounds in _words(batch.column(1)):
                texts = [words[bounds[i] : bounds[i + 1]] for i in range(len(bounds) - 1)]
                own = [np.unique(shingle_hashes(w, min(WIDTH, len(w)))) if len(w) else w for w in texts]
                own = [s.view(np.int64) for s in own]
                here = batch.column(0).to_numpy()[row : row + len(own)]
                some = here[[len(s) > 0 for s in own]]
                slices = np.concatenate([np.repeat(here, [len(s) for s in own]), some])
                shingles = pa.concat_arrays([pa.array(np.concatenate(own)), pa.nulls(len(some), pa.int64())])
                yield pa.RecordBatch.from_arrays([pa.array(slices, pa.int64()), shingles], ["slice", "shingle"])

    return benchmark.select("slice", "text").mapInArrow(cut, "slice long, shingle long")


def item_slices(benchmark: DataFrame) -> Iterator[tuple[pa.Table, dict[int, float] | None]]:
    """The items (item_id, text) in slices of about ``SLICE_WORDS`` words, each with the weights of its shingles.

    One slice at a time reaches the driver. Weights are counted over the whole benchmark; a single
    slice counts its own.
    """
    usable = benchmark.filter("text IS NOT NULL").select("item_id", "text")
    size = usable.agg(F.sum(F.octet_length("text") / 4).alias("words"), F.count("*").alias("items")).first()
    slices = int(max((size["words"] or 0) // SLICE_WORDS, size["items"] // SLICE_ITEMS)) + 1
    usable = usable.withColumn("slice", F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)).cast("long"))
    spark, folder = benchmark.sparkSession, None
    if slices > 1:
        folder = work_folder(spark, "shingles")
        per_slice = _item_shingles(usable).groupBy("slice", "shingle").agg(F.count("*").alias("n"))
        per_slice = staged(per_slice, f"{folder}/slices")
        n = per_slice.filter("shingle IS NULL").agg(F.sum("n")).first()[0]
        counts = per_slice.groupBy("shingle").agg(F.sum("n").alias("having"))
        known = staged(per_slice.select("slice", "shingle").join(counts, "shingle"), f"{folder}/counts")
    for k in range(slices):
        part = usable.filter(F.col("slice") == k).select("item_id", "text").orderBy("item_id", "text")
        weight = None
        if slices > 1:
            own = known.filter(F.col("slice") == k).select("shingle", "having").toArrow()
            hashes = own["shingle"].to_numpy().view(np.uint64).tolist()
            weight = {h: shingle_weight(n, c) for h, c in zip(hashes, own["having"].to_pylist(), strict=True)}
        yield part.toArrow(), weight
    if folder:
        drop_folder(spark, folder)


def _found(
    documents: DataFrame, items: pa.Table, item_kind: str, weight: dict[int, float] | None, threshold: float
) -> DataFrame:
    """What a slice of the benchmark finds; a slice goes to the tasks whole."""
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = ItemIndex(items["text"].to_pylist(), weight)
        ids = items["item_id"].combine_chunks()
        for batch in batches:
            for row, words, bounds in _words(batch.column(1)):
                hits = list(index.matches(words, bounds, threshold))
                if hits:
                    rows, which, first, value = zip(*hits, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).take(pa.array([row + r for r in rows])),
                            ids.take(pa.array([index.ids[i] for i in which])),
                            pa.array(value, pa.float64()),
                            pa.array(first, pa.int64()),
                        ],
                        ["doc_id", "item_id", "similarity", "first_word"],
                    )

    kind = dict(documents.dtypes)["doc_id"]
    schema = f"doc_id {kind}, item_id {item_kind}, similarity double, first_word long"
    return documents.select("doc_id", "text").mapInArrow(search, schema)


def contaminated(documents: DataFrame, benchmark: DataFrame, threshold: float = 0.6) -> DataFrame:
    """(doc_id, item_id, similarity, first_word): every item found in a document, at its best window.

    Documents are read once per slice; with more than one, what each finds is written before the next one is read.
    """
    item_kind, found = dict(benchmark.dtypes)["item_id"], None
    folder = work_folder(documents.sparkSession, "found")
    for k, (items, weight) in enumerate(item_slices(benchmark)):
        part = _found(documents, items, item_kind, weight, threshold)
        if weight is not None:
            part = staged(part, f"{folder}/{k}")
        found = part if found is None else found.unionByName(part)
    return found.groupBy("doc_id", "item_id").agg(
        F.max("similarity").alias("similarity"), F.min_by("first_word", F.struct(-F.col("similarity"), "first_word")).alias("first_word")
    )
