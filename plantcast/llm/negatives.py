"""Hard negatives by inner product: a BOND scan over vertical (columnar) tiles of vectors.

Components are quantised to floor(scale * x), so all scores are exact integers. Vectors are dealt by
hash into tiles that store one array per dimension; anchors stream past every tile. For an anchor the
dimensions are read in descending order of its own magnitudes. What the unread dimensions can still
add lies between sums of least and greatest contributions (from the tile's extremes per dimension);
these bounds clear bits of the candidate bitmap: vectors that cannot be among the anchor's best
positives any more, or that lie outside of every window or behind enough sure members of it. What is
left when the dimensions are read has exact scores.

Two scans: the first finds each anchor's positives (the best other rows of its label), whose scores
set the windows of the second, over rows of other labels. Each tile returns at most the number asked
for by anchor and window, and the best over all tiles are taken by rank; a tile is of bounded size, and
the number of anchors that pass it is of no matter for its memory. The work is anchors x rows, as the
query set is stated; nothing is collected.

Defined results: rows with a null id, label or vector, or with a null or non-finite component take no
part, nor do vectors with a quantised component beyond 2**22 or more than 2**14 components (scores would
leave 64 bits). Only vectors of equal dimension are compared; a vector without components scores 0. Ids
and labels are integers. An id is a key: rows that repeat an id are never positives of an anchor of that id, and are listed each
where they rank, ties of score and id by label and vector; equal anchor rows count once. An anchor
without positives gives no rows. Empty tables give an empty table; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plantcast.llm.common import drop_folder, scan_tasks, staged, work_folder

TILE = 32_768
LEAST_TILE = 512
STEP = 8  # dimensions read between two looks at the bounds
MOST_VALUE = 1 << 22
MOST_DIMENSIONS = 1 << 14
EXACT = 1 << 53


class VerticalTile:
    """Vectors of one dimension, one array per component."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray) -> None:
        """``x``: integers, a row per vector."""
        order = np.argsort(ids, kind="stable")
        self.ids, self.labels = ids[order], labels[order]
        self.columns = np.ascontiguousarray(x[order].T)
        self.least, self.greatest = x.min(0), x.max(0)
        self.most = int(np.abs(x).max(initial=0))

    def scan(self, anchor: np.ndarray, alive: np.ndarray, prune) -> tuple[np.ndarray, np.ndarray]:
        """Rows that stay alive, and their exact scores.

        ``prune(low, high)`` gets bounds of the alive rows' scores and says which of them stay.
        """
        order = np.argsort(-np.abs(anchor), kind="stable")
        used = order[anchor[order] != 0]
        exact = np.int64 if len(anchor) * self.most * int(np.abs(anchor).max(initial=0)) >= EXACT else np.float64
        ends = [anchor[used] * self.least[used], anchor[used] * self.greatest[used]]
        rest = [np.concatenate([np.cumsum(end[::-1])[::-1], [0]]) for end in (np.minimum(*ends), np.maximum(*ends))]
        rows = np.flatnonzero(alive)
        total = np.zeros(len(rows), exact)
        for done in range(0, len(used), STEP):
            part = used[done : done + STEP]
            if 2 * len(rows) > len(self.ids):
                total += (anchor[part].astype(exact) @ self.columns[part].astype(exact))[rows]
            else:
                total += anchor[part].astype(exact) @ self.columns[np.ix_(part, rows)].astype(exact)
            after = min(done + STEP, len(used))
            keep = prune(total + rest[0][after], total + rest[1][after])
            if not keep.all():
                rows, total = rows[keep], total[keep]
            if not len(rows):
                break
        return rows, total.astype(np.int64)


def _kth(values: np.ndarray, k: int) -> float:
    return np.partition(values, len(values) - k)[len(values) - k] if len(values) >= k else -np.inf


def best_rows(tile: VerticalTile, anchor: np.ndarray, alive: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` best of the rows in ``alive``, best first, ties by id."""
    rows, score = tile.scan(anchor, alive, lambda low, high: high >= _kth(low, k))
    first = np.lexsort((rows, -score))[:k]  # rows are in the order of ids
    return rows[first], score[first]


def best_in_windows(
    tile: VerticalTile, anchor: np.ndarray, alive: np.ndarray, windows: list[tuple[int, int]], k: int
) -> list[tuple[np.ndarray, np.ndarray]]:
    """For every window (least, greatest score) the ``k`` best of the rows in ``alive`` within it."""

    def prune(low: np.ndarray, high: np.ndarray) -> np.ndarray:
        keep = np.zeros(len(low), bool)
        for least, greatest in windows:
            if least <= greatest:
                sure = low[(low >= least) & (high <= greatest)]
                keep |= (high >= max(least, _kth(sure, k))) & (low <= greatest)
        return keep

    rows, score = tile.scan(anchor, alive, prune)
    found = []
    for least, greatest in windows:
        inside = np.flatnonzero((score >= least) & (score <= greatest))
        first = inside[np.lexsort((rows[inside], -score[inside]))[:k]]
        found.append((rows[first], score[first]))
    return found


def _integers(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), dim)


def _quantised(rows: DataFrame, scale: float) -> DataFrame:
    """(vec_id, label, x, dim) of the rows that take part."""
    q = F.transform("embedding", lambda v: F.floor(v.cast("double") * scale))
    fits = F.forall(
        "embedding",
        lambda v: v.isNotNull() & ~F.isnan(v) & F.coalesce(F.abs(v.cast("double") * scale) < MOST_VALUE, F.lit(False)),
    )
    usable = fits & F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("embedding") <= MOST_DIMENSIONS)
    return rows.filter(usable).select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("label").cast("long").alias("label"),
        q.cast("array<int>").alias("x"),
        F.size("embedding").alias("dim"),
    )


TILE_KEY = ["dim", "block"]
SEARCH = [*TILE_KEY, "anchor", "vec_id", "label", "x", "ends"]


def _scan_tiles(tiled: DataFrame, k: int) -> DataFrame:
    """(anchor, window, score, other) from rows of ``SEARCH``: a tile's vectors (no anchor), then its anchors.

    ``ends`` holds an anchor's positive scores; without it the anchor's positives are looked for.
    """

    def results(tile: VerticalTile, anchor: int, vec_id: int, label: int, x: np.ndarray, scores: list[int] | None) -> list:
        if scores is None:
            found = [best_rows(tile, x, (tile.labels == label) & (tile.ids != vec_id), k)]
        else:
            windows = [(-(-4 * p // 5), p) for p in scores]  # 80 p <= 100 n <= 100 p
            found = best_in_windows(tile, x, tile.labels != label, windows, k)
        return [(anchor, w, int(s), int(tile.ids[r])) for w, (rows, score) in enumerate(found) for r, s in zip(rows, score, strict=True)]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, homes, tile = None, [], None
        for batch in batches:
            dims, blocks = (batch.column(c).to_numpy() for c in (0, 1))
            is_home = batch.column(2).is_null().to_numpy(zero_copy_only=False)
            change = (dims[1:] != dims[:-1]) | (blocks[1:] != blocks[:-1]) | (is_home[1:] != is_home[:-1])
            cuts = [0, *(np.flatnonzero(change) + 1).tolist(), len(batch)]
            out = []
            for at, end in zip(cuts[:-1], cuts[1:], strict=True):
                if at == end:
                    continue
                here = (int(dims[at]), int(blocks[at]))
                if here != key:
                    key, homes, tile = here, [], None
                part = batch.slice(at, end - at)
                ids, labels = (part.column(c).to_numpy() for c in (3, 4))
                x = _integers(part.column(5), here[0])
                if is_home[at]:
                    homes.append((ids, labels, x))
                    continue
                if not homes and tile is None:
                    continue
                if tile is None:
                    tile, homes = VerticalTile(*map(np.concatenate, zip(*homes, strict=True))), []
                anchors, ends = part.column(2).to_pylist(), part.column(6).to_pylist()
                for row in range(len(part)):
                    out += results(tile, anchors[row], int(ids[row]), int(labels[row]), x[row], ends[row])
            if out:
                columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)]
                yield pa.RecordBatch.from_arrays(columns, ["anchor", "window", "score", "other"])

    return tiled.mapInArrow(search, "anchor long, window int, score long, other long")


def hard_negatives(
    embeddings: DataFrame, is_anchor, positives: int = 5, negatives: int = 5, scale: float = 256.0
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score), all long but the int rank.

    ``is_anchor`` is a condition on ``vec_id``. Negatives score between 80 and 100 % of the positive.
    """
    spark, tasks = embeddings.sparkSession, scan_tasks(embeddings)
    folder = work_folder(spark, "negatives")
    rows = staged(_quantised(embeddings, scale), f"{folder}/rows")
    count = rows.count()
    blocks = max(-(-count // TILE), min(tasks, -(-count // LEAST_TILE)), 1)
    # An anchor row has a number of its own, fixed by being written.
    anchors = rows.filter(is_anchor).distinct().withColumn("anchor", F.monotonically_increasing_id())
    anchors = staged(anchors, f"{folder}/anchors")
    none = F.lit(None)
    homes = rows.withColumns({"block": F.pmod(F.xxhash64("vec_id", "label", "x"), F.lit(blocks)).cast("int"), "anchor": none.cast("long"), "ends": none.cast("array<long>")})

    def scanned(asking: DataFrame, k: int) -> DataFrame:
        visits = asking.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        both = homes.select(*SEARCH).union(visits.select(*SEARCH))
        dealt = both.repartition(tasks, *TILE_KEY).sortWithinPartitions(*TILE_KEY, F.asc_nulls_first("anchor"))
        return _scan_tiles(dealt, k)

    best = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "other")
    first = scanned(anchors.withColumn("ends", none.cast("array<long>")), positives)
    chosen = first.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= positives)
    chosen = staged(chosen.select("anchor", (F.col("rank") - 1).alias("window"), F.col("score").alias("positive_score"), F.col("other").alias("positive_id")), f"{folder}/positives")
    scores = chosen.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("window", "positive_score"))).alias("ends"))
    asking = anchors.join(scores.select("anchor", F.col("ends.positive_score").alias("ends")), "anchor")
    second = scanned(asking, negatives)
    ranked = second.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= negatives)
    ranked = staged(ranked, f"{folder}/ranked")
    found = (
        ranked.join(chosen, ["anchor", "window"])
        .join(anchors.select("anchor", F.col("vec_id").alias("anchor_id")), "anchor")
        .select("anchor_id", "positive_id", "rank", F.col("other").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
    )
    drop_folder(spark, f"{folder}/rows")
    return found
