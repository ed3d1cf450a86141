r"""Word-shingle Jaccard join with a count-vector R-tree.

A document is the set of its distinct ``width``-word shingles, as 64-bit hashes; words are
``[^\x20\x09-\x0D]+`` with A-Z lower-cased. Documents of equal sets are one class. Two classes link
when den * intersection >= num * union. In any common order of the hashes, such sets share one of their
first n - ceil(num n / den) + 1, which bring them together in buckets. The order puts the most common
shingles last, so that a passage or line of many documents brings few of them together; it is otherwise by
value. Which shingles count as common decides on the size of buckets only, never on the result, so their
list can be bounded and estimated: each run of rows of a task reports the shingles that more than one of them has,
and those with more than ``COMMON`` reports in all are taken, the ``MOST_COMMON`` first of them. Each set also
has a count vector: its hashes dealt into groups (a quarter to a half as many as the set is large, a power of two). The sum of the coordinates'
minima bounds the intersection. Within buckets, points are packed into R-trees whose nodes hold the
maxima of their coordinates and the range of sizes. A set that meets another first at its k-th shingle
shares no more than what is left from there, which bounds the intersection too. A last bound comes from parities:
a shingle turns one of ``PARITIES`` bits of its set, so two sets differ in as many shingles as bits at least. A pair is
named in the first bucket that it shares: each row carries the first ``BEFORE`` open buckets of its set that come before its own,
and pairs with one of them in common are left to that one. (Pairs without one in these lists are named in each.) Pairs that
the bounds let through are verified on the texts.

Links inside a large group of near copies need not all be found to know its component: first every
class is compared with two hubs of its buckets (the least id, and the least hash of an id), then only
pairs in different components so far are searched. Buckets of more than ``TILE`` unresolved rows are
cut into blocks, every pair of blocks a tile.

Defined results: null texts, empty texts and texts without words have an empty set, link with
nothing and are their own component; rows that share a doc_id are one node; a null doc_id has the
component of equal documents or null. A doc_id is a whole number, other types are refused. An empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantcast.llm.common import (
    SMALL_BYTES,
    SPACE,
    broadcast_if_few,
    components,
    drop_folder,
    require_whole,
    scan_tasks,
    shingle_hashes,
    shingle_set,
    staged,
    text_chunks,
    word_hashes,
    work_folder,
)

TILE = 2048
FANOUT = 16
BEFORE = 6
PARITIES = 256
HUB_SPOKES = 512
COMMON = 64
MOST_COMMON = 100_000
SET = ["n_shingles", "s1", "s2"]


def shingle_sets(texts: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """Row and sorted shingle set of every text."""
    for first, raw, offsets in text_chunks(texts, SMALL_BYTES):
        words, bounds = word_hashes(raw, offsets, ~SPACE)
        shingles = shingle_hashes(words, width)
        for i in range(len(offsets) - 1):
            lo, hi = bounds[i], bounds[i + 1]
            yield first + i, shingle_set(words[lo:hi], width, shingles[lo : max(hi - width + 1, lo)])


def group_counts(shingles: np.ndarray) -> np.ndarray:
    """Counts by group, below 16 each and two in a byte; a power of two groups, at least 8 and as many as that takes."""
    groups = 1 << max(3, len(shingles).bit_length() - 2)
    while True:
        counts = np.bincount((shingles & np.uint64(groups - 1)).astype(np.int64), minlength=groups)
        if counts.max() < 16:
            counts = counts.astype(np.uint8)
            return counts[0::2] | counts[1::2] << 4
        groups *= 2


def parities(shingles: np.ndarray) -> np.ndarray:
    """Whether the number of shingles dealt to each of ``PARITIES`` places is odd, eight in a byte."""
    return np.packbits(np.bincount((shingles >> np.uint64(32)).astype(np.int64) % PARITIES, minlength=PARITIES) & 1)


def prefix_length(n: int, num: int, den: int) -> int:
    """Shingles of a set of ``n`` that it cannot all lack in common with a set it links to."""
    return n - -(-num * n // den) + 1


def common_shingles(documents: DataFrame, width: int, num: int, den: int) -> np.ndarray:
    """Sorted shingles that come last in the order, from thrice the prefix of every document."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads = [s[: 3 * prefix_length(len(s), num, den)] for _, s in shingle_sets(batch.column(0), width)]
            keys, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *heads]), return_counts=True)
            keys, n = keys[n > 1], n[n > 1]
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], ["key", "n"])

    counts = documents.select("text").mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    most = counts.filter(F.col("n") > COMMON).orderBy(F.desc("n"), "key").limit(MOST_COMMON).select("key")
    return np.sort(most.toArrow().column("key").to_numpy().view(np.uint64))


def common_last(shingles: np.ndarray, common: np.ndarray) -> np.ndarray:
    """A sorted set with its common shingles behind the others."""
    if not len(common):
        return shingles
    late = common[np.minimum(np.searchsorted(common, shingles), len(common) - 1)] == shingles
    return np.concatenate([shingles[~late], shingles[late]])


def document_sets(documents: DataFrame, width: int, num: int, den: int, common: np.ndarray) -> DataFrame:
    """(doc_id, n_shingles, s1, s2, keys, counts, parity) of every document."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, s1, s2, keys, counts, parity = [], [], [], [], [], []
            for _, s in shingle_sets(batch.column(1), width):
                n = len(s)
                size.append(n)
                s1.append(int(np.bitwise_xor.reduce(s)) if n else 0)
                s2.append(int((s * (s >> np.uint64(7) | np.uint64(1))).sum(dtype=np.uint64)) if n else 0)
                first = common_last(s, common)[: prefix_length(n, num, den) if n else 0]
                keys.append(first.view(np.int64))
                counts.append(group_counts(s).tobytes() if n else b"")
                parity.append(parities(s).tobytes())
            sums = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (s1, s2)]
            ends = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
            flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size, pa.int64()), *sums, lists, *(pa.array(x, pa.binary()) for x in (counts, parity))],
                ["doc_id", *SET, "keys", "counts", "parity"],
            )

    kind = dict(documents.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_shingles long, s1 long, s2 long, keys array<long>, counts binary, parity binary"
    return documents.select("doc_id", "text").mapInArrow(build, schema)


class Points:
    """Count vectors of different lengths, by row, from two counts in a byte."""

    def __init__(self, blobs: list[bytes]) -> None:
        self.groups = np.array([2 * len(b) for b in blobs], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.groups)])
        pairs = np.frombuffer(b"".join(blobs), np.uint8)
        self.flat = np.stack([pairs & 15, pairs >> 4], 1).ravel()

    def folded(self, rows: np.ndarray, groups: int) -> np.ndarray:
        """Matrix of the rows' counts, groups beyond ``groups`` added to those of equal low bits."""
        out = np.zeros((len(rows), groups), np.int32)
        for g in np.unique(self.groups[rows]).tolist():
            mine = np.flatnonzero(self.groups[rows] == g)
            for low in range(0, len(mine), max(1, (1 << 20) // g)):
                part = mine[low : low + max(1, (1 << 20) // g)]
                full = self.flat[self.starts[rows[part]][:, None] + np.arange(g)]
                out[part] = full.reshape(len(part), g // groups, groups).sum(1, dtype=np.int32)
        return out


def overlap_bound(a: Points, i: np.ndarray, b: Points, j: np.ndarray) -> np.ndarray:
    """Upper bound of the intersections of pairs: sums of coordinate minima."""
    out = np.zeros(len(i), np.int64)
    common = np.minimum(a.groups[i], b.groups[j])
    for g in np.unique(common).tolist():
        mine = np.flatnonzero(common == g)
        for low in range(0, len(mine), max(1, (1 << 20) // g)):
            part = mine[low : low + max(1, (1 << 20) // g)]
            out[part] = np.minimum(a.folded(i[part], g), b.folded(j[part], g)).sum(1, dtype=np.int64)
    return out


def minima_sums(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sums of the minima of rows a[i] and b[j], a bounded part of them at a time."""
    out = np.zeros(len(i), np.int64)
    step = max(1, (1 << 20) // a.shape[1])
    for low in range(0, len(i), step):
        part = slice(low, low + step)
        out[part] = np.minimum(a[i[part]], b[j[part]]).sum(1, dtype=np.int64)
    return out


def can_link(bound: np.ndarray, n: np.ndarray, m: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether an intersection up to the bound can reach num / den of the union."""
    return (den + num) * np.minimum(bound, np.minimum(n, m)) >= num * (n + m)


def parity_bound(a: np.ndarray, n: np.ndarray, b: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Upper bound of the intersections of pairs of sets of ``n`` and ``m``, by rows of parities."""
    return (n + m - np.bitwise_count(a ^ b).sum(1, dtype=np.int64)) // 2


def share_one(lists: pa.ListArray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether lists i and j, of ``BEFORE`` numbers at most, have a number in common."""
    sizes = lists.value_lengths().to_numpy()
    held = np.arange(BEFORE) < sizes[:, None]
    table = np.zeros(held.shape, np.int64)
    table[held] = lists.flatten().to_numpy()
    out = np.zeros(len(i), bool)
    for low in range(0, len(i), 1 << 14):
        x, y = i[low : low + (1 << 14)], j[low : low + (1 << 14)]
        for k in range(BEFORE):
            out[low : low + (1 << 14)] |= ((table[x, k, None] == table[y]) & held[x, k, None] & held[y]).any(1)
    return out


class RTree:
    """Packed R-tree over one bucket's points, ordered by size and then by their fullest group."""

    def __init__(self, points: Points, sizes: np.ndarray, left: np.ndarray) -> None:
        """``left``: shingles of each set from the bucket's one on."""
        self.points, self.sizes, self.left = points, sizes, left
        self.groups = int(points.groups.min())
        counts = points.folded(np.arange(len(sizes)), self.groups)
        self.order = np.lexsort([counts.argmax(1), sizes])
        self.counts, self.ordered = counts[self.order], sizes[self.order]
        self.levels = []  # (maxima, least size, greatest size, most left), leaves first
        most, least, greatest, rest = self.counts, self.ordered, self.ordered, left[self.order]
        while len(most) > FANOUT or not self.levels:
            cuts = np.arange(0, len(most), FANOUT)
            most = np.maximum.reduceat(most, cuts)
            least, greatest = np.minimum.reduceat(least, cuts), np.maximum.reduceat(greatest, cuts)
            rest = np.maximum.reduceat(rest, cuts)
            self.levels.append((most, least, greatest, rest))

    def pairs(self, num: int, den: int, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows (i, j) of different labels whose bound lets them link, each pair once."""
        total, found = len(self.order), []
        label, left = labels[self.order], self.left[self.order]
        for low in range(0, total, 256):
            query = np.arange(low, min(low + 256, total))
            top = len(self.levels[-1][0])
            q, node = np.repeat(query, top), np.tile(np.arange(top), len(query))
            for depth in range(len(self.levels) - 1, -1, -1):
                most, least, greatest, rest = self.levels[depth]
                size = np.clip(self.ordered[q], least[node], greatest[node])
                fits = (node + 1) * FANOUT ** (depth + 1) > q + 1
                fits &= (den * np.minimum(self.ordered[q], size) >= num * np.maximum(self.ordered[q], size))
                q, node = q[fits], node[fits]
                bound = np.minimum(minima_sums(self.counts, q, most, node), np.minimum(left[q], rest[node]))
                best = np.clip(np.minimum(bound, self.ordered[q]), least[node], greatest[node])  # of the node's sizes
                fits = can_link(bound, self.ordered[q], best, num, den)
                q, node = np.repeat(q[fits], FANOUT), (node[fits][:, None] * FANOUT + np.arange(FANOUT)).ravel()
                inside = node < (len(self.levels[depth - 1][0]) if depth else total)
                q, node = q[inside], node[inside]
            keep = (node > q) & (label[q] != label[node])
            q, node = q[keep], node[keep]
            bound = np.minimum(minima_sums(self.counts, q, self.counts, node), np.minimum(left[q], left[node]))
            keep = can_link(bound, self.ordered[q], self.ordered[node], num, den)
            i, j = self.order[q[keep]], self.order[node[keep]]
            bound = overlap_bound(self.points, i, self.points, j)
            keep = can_link(bound, self.sizes[i], self.sizes[j], num, den)
            found.append((i[keep], j[keep]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def bounded_pairs(pairs: DataFrame, points: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) whose count vectors let them link."""
    side = {s: points.select(F.col("rep").alias(s), F.col("n_shingles").alias(f"n_{s}"), F.col("counts").alias(f"c_{s}")) for s in "ab"}

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = Points(batch.column(3).to_pylist()), Points(batch.column(5).to_pylist())
            rows = np.arange(len(batch))
            n, m = (np.array(batch.column(k).to_pylist(), np.int64) for k in (2, 4))
            keep = can_link(overlap_bound(a, rows, b, rows), n, m, num, den)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    joined = pairs.join(side["a"], "a").join(side["b"], "b").select("a", "b", "n_a", "c_a", "n_b", "c_b")
    size = F.least("n_a", "n_b") * den >= F.greatest("n_a", "n_b") * num
    return joined.filter(size).mapInArrow(bound, "a long, b long").distinct()


def with_before(open_rows: DataFrame, reps: DataFrame) -> DataFrame:
    """``open_rows`` with ``before``: the first ``BEFORE`` open buckets of the set that come before the row's own.

    Sets that share a doc_id have no order in common: their rows name a pair in every bucket.
    """
    several = reps.groupBy("rep").count().filter("count > 1").select("rep")
    heads = open_rows.groupBy("rep").agg(F.slice(F.sort_array(F.collect_list(F.struct("pos", "key"))), 1, BEFORE).alias("heads"))
    heads = heads.join(broadcast_if_few(several), "rep", "left_anti")
    before = F.transform(F.filter("heads", lambda head: head["pos"] < F.col("pos")), lambda head: head["key"])
    none = F.array().cast("array<long>")
    return open_rows.join(heads, "rep", "left").withColumn("before", F.coalesce(before, none)).drop("heads")


def tree_pairs(rows: DataFrame, num: int, den: int, tasks: int) -> DataFrame:
    """Pairs (a, b) from R-trees over the tiles of (key, pos, rep, label, n_shingles, counts, parity, before)."""
    block = F.pmod(F.xxhash64("rep"), "blocks")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    counts = rows.groupBy("key").agg(F.ceil(F.count("*") / (TILE / 2)).cast("int").alias("blocks"))
    tiled = (
        rows.join(counts, "key")
        .withColumn("other", other)
        .select("key", F.least(block, "other").alias("i"), F.greatest(block, "other").alias("j"), "rep", "label", "n_shingles", "counts", "pos", "parity", "before")
    )

    def found(table: pa.Table, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
        """Those of the pairs whose parities let them link."""
        used, at = np.unique(np.concatenate([i, j]), return_inverse=True)
        x, y = at[: len(i)], at[len(i) :]
        rep, n = (table.column(k).to_numpy()[used] for k in (3, 5))
        parity = np.frombuffer(b"".join(table.column(8).take(pa.array(used)).to_pylist()), np.uint64).reshape(-1, PARITIES // 64)
        keep = can_link(parity_bound(parity[x], n[x], parity[y], n[y]), n[x], n[y], num, den)
        a, b = np.minimum(rep[x], rep[y])[keep], np.maximum(rep[x], rep[y])[keep]
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    def whole_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
        """Tables that end where a tile ends, with the bounds of their tiles."""
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch] if rest is None else [*rest.to_batches(), batch])
            keys = np.stack([table.column(k).to_numpy() for k in range(3)], 1)
            bounds = np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1])
            yield table.slice(0, bounds[-1]), bounds
            rest = table.slice(bounds[-1])
        if rest is not None:
            yield rest, np.array([0, len(rest)])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in whole_tiles(batches):
            rep, label, n = (table.column(k).to_numpy() for k in (3, 4, 5))
            left = n - table.column(7).to_numpy()
            sizes = np.diff(bounds)
            tile = np.repeat(np.arange(len(sizes)), sizes)
            # A tile of one leaf: its pairs, each pair of the table once.
            pairs = [np.zeros((2, 0), np.int64)]
            for step in range(1, FANOUT):
                i = np.flatnonzero((tile[step:] == tile[:-step]) & (sizes[tile[step:]] <= FANOUT))
                j = i + step
                keep = (label[i] != label[j]) & can_link(np.minimum(left[i], left[j]), n[i], n[j], num, den)
                pairs.append(np.stack([i[keep], j[keep]]))
            i, j = np.concatenate(pairs, 1)
            before = table.column(9).combine_chunks()
            new = ~share_one(before, i, j)
            i, j = i[new], j[new]
            if len(i):
                ids = np.stack([np.minimum(rep[i], rep[j]), np.maximum(rep[i], rep[j])], 1)
                once = np.unique(ids, axis=0, return_index=True)[1]
                i, j = i[once], j[once]
                used, at = np.unique(np.concatenate([i, j]), return_inverse=True)
                points = Points(table.column(6).take(pa.array(used)).to_pylist())
                bound = overlap_bound(points, at[: len(i)], points, at[len(i) :])
                keep = can_link(bound, n[i], n[j], num, den)
                yield found(table, i[keep], j[keep])
            for k in np.flatnonzero(sizes > FANOUT).tolist():
                rows = slice(int(bounds[k]), int(bounds[k + 1]))
                if (label[rows] == label[rows][0]).all():
                    continue
                blobs = table.column(6).slice(rows.start, rows.stop - rows.start).to_pylist()
                i, j = RTree(Points(blobs), n[rows], left[rows]).pairs(num, den, label[rows])
                new = ~share_one(before.slice(rows.start, rows.stop - rows.start), i, j)
                yield found(table, rows.start + i[new], rows.start + j[new])

    dealt = tiled.repartition(tasks, "key", "i", "j").sortWithinPartitions("key", "i", "j")
    return dealt.mapInArrow(search, "a long, b long")


def verified_pairs(pairs: DataFrame, documents: DataFrame, width: int, num: int, den: int, tasks: int) -> DataFrame:
    """The pairs (a, b) whose shingle sets link; texts of b stream past those of a."""
    slots = pairs.groupBy("a").agg(F.ceil(F.count("*") / HUB_SPOKES).cast("int").alias("slots"))
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    texts = documents.select("doc_id", "text").join(broadcast_if_few(ids, 500_000), "doc_id", "left_semi")
    hubs = (
        texts.join(slots, texts.doc_id == slots.a)
        .withColumn("slot", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)))
        .select("a", "slot", F.lit(None).cast("long").alias("b"), "text")
    )
    spokes = pairs.join(slots, "a").withColumn("slot", F.pmod(F.xxhash64("b"), "slots").cast("int"))
    spokes = spokes.join(texts, spokes.b == texts.doc_id).select("a", "slot", "b", "text")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, sets = None, []
        for batch in batches:
            hub_ids, slot_ids, others = (batch.column(k).to_pylist() for k in range(3))
            linked = []
            for row, s in shingle_sets(batch.column(3), width):
                if (hub_ids[row], slot_ids[row]) != hub:
                    hub, sets = (hub_ids[row], slot_ids[row]), []
                if others[row] is None:
                    sets.append(s)
                    continue
                for t in sets:
                    both = len(np.intersect1d(s, t, assume_unique=True))
                    if den * both >= num * (len(s) + len(t) - both) > 0:
                        linked.append(row)
                        break
            yield batch.select(["a", "b"]).take(pa.array(linked, pa.int64()))

    dealt = hubs.union(spokes).repartition(tasks, "a", "slot").sortWithinPartitions("a", "slot", F.asc_nulls_first("b"))
    return dealt.mapInArrow(verify, "a long, b long")


def unresolved(labelled: DataFrame, num: int, den: int, folder: str) -> DataFrame:
    """Rows (key, pos, rep, label) of buckets with more than one label, whose size has a neighbour that can link.

    Sizes that can link lie in one class of sizes or in two next to each other. Buckets and classes are only
    aggregated, so a hot bucket is one row a task before it is shuffled.
    """
    mixed = labelled.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    mixed = staged(mixed.filter("low <> high").select("key"), f"{folder}/mixed")
    step = max(1.001 * math.log(den / num), 1e-9)  # a little wide, so that rounding parts no pair by two classes
    rows = labelled.join(broadcast_if_few(mixed), "key").withColumn("sizes", F.floor(F.log("n_shingles") / step))
    classes = rows.groupBy("key", "sizes").agg(
        F.count("*").alias("n"), F.min("n_shingles").alias("least"), F.max("n_shingles").alias("greatest")
    )
    none = F.lit(None).cast("long")
    seen = (
        classes.select("key", "sizes", "n", none.alias("below"), none.alias("above"))
        .union(classes.select("key", F.col("sizes") + 1, F.lit(0), "greatest", none))
        .union(classes.select("key", F.col("sizes") - 1, F.lit(0), none, "least"))
    )
    beside = seen.groupBy("key", "sizes").agg(
        F.sum("n").alias("n"), F.max("below").alias("below"), F.min("above").alias("above")
    )
    near = (F.col("below") * den >= F.col("n_shingles") * num) | (F.col("n_shingles") * den >= F.col("above") * num)
    return rows.join(beside, ["key", "sizes"]).filter((F.col("n") > 1) | near).select("key", "pos", "rep", "label")


def near_documents(documents: DataFrame, width: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row."""
    require_whole(documents, "doc_id")
    spark, tasks = documents.sparkSession, scan_tasks(documents)
    folder = work_folder(spark, "jaccard")
    common = common_shingles(documents, width, num, den)
    sets = staged(document_sets(documents, width, num, den, common), f"{folder}/sets")
    slim = staged(sets.select("doc_id", *SET), f"{folder}/slim")
    reps = (
        sets.filter("n_shingles > 0 AND doc_id IS NOT NULL")
        .groupBy(*SET)
        .agg(F.min("doc_id").alias("rep"), F.first("keys").alias("keys"), F.first("counts").alias("counts"), F.first("parity").alias("parity"))
    )
    reps = staged(reps, f"{folder}/reps")
    drop_folder(spark, f"{folder}/sets")
    points = reps.select("rep", "n_shingles", "counts")

    postings = reps.select(F.posexplode("keys").alias("pos", "key"), "rep", "n_shingles")
    hubs = postings.groupBy("key").agg(
        F.min("rep").alias("low"), F.min(F.xxhash64("rep")).alias("draw"), F.count("*").alias("n")
    )
    hubs = staged(hubs.filter("n > 1").drop("n"), f"{folder}/hubs")
    members = staged(postings.join(hubs, "key"), f"{folder}/members")
    drawn = reps.select(F.xxhash64("rep").alias("draw"), F.col("rep").alias("hub")).distinct()
    least = members.groupBy("rep").agg(F.min("low").alias("low"), F.min("draw").alias("draw"))
    stars = least.select("rep", F.col("low").alias("hub")).union(least.join(drawn, "draw").select("rep", "hub"))
    stars = stars.filter("rep <> hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()
    candidates = staged(bounded_pairs(stars, points, num, den), f"{folder}/stars")
    first = staged(verified_pairs(candidates, documents, width, num, den, tasks), f"{folder}/first")
    labels = components(reps.select(F.col("rep").alias("id")).distinct(), first, f"{folder}/cc1")
    labels = staged(labels, f"{folder}/labels")

    labelled = members.join(labels.withColumnRenamed("id", "rep"), "rep").select("key", "pos", "rep", "n_shingles", F.col("component_id").alias("label"))
    open_rows = unresolved(staged(labelled, f"{folder}/labelled"), num, den, folder)
    open_rows = staged(open_rows, f"{folder}/open")
    for done in ("members", "labelled", "mixed"):
        drop_folder(spark, f"{folder}/{done}")
    marked = with_before(open_rows, reps).join(reps.select("rep", "n_shingles", "counts", "parity"), "rep")
    second = staged(tree_pairs(marked, num, den, tasks).distinct(), f"{folder}/pairs")
    second = staged(verified_pairs(second, documents, width, num, den, tasks), f"{folder}/second")
    edges = first.union(second)
    grouped = components(reps.select(F.col("rep").alias("id")).distinct(), edges, f"{folder}/cc2")
    classes = reps.select(*SET, F.col("rep").alias("id")).join(grouped, "id").drop("id")
    # Rows that share a doc_id but not their text are one node: its least component holds.
    found = slim.join(classes, SET, "left")
    return found.select(
        "doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    )
