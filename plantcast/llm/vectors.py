"""Near-duplicate vectors by cosine: PCA-ordered, tiled comparison.

Only vectors of equal label and dimension are compared. Unit vectors are rotated to the principal
axes of a bounded sample, so that leading coordinates carry most of every product. Vectors within
the threshold differ by at most w = sqrt(2 - 2 threshold) in every coordinate: cells of width w in
the first two coordinates only meet themselves and their neighbours. Cells are cut into home blocks
of at most ``TILE`` rows; rows that visit a block stream past it. A product is accumulated over the
leading coordinates first; what the rest can add is bounded by the product of the suffix norms, and
pairs that cannot reach the threshold stop there. Survivors are decided on the original values in
double precision. Equal vectors are compared once and counted with their number.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and
vectors without a label, link with nothing; rows with a null vec_id count as links of others but have
a null component; repeated rows link with each other like equal vectors. An empty table gives an
empty table. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantcast.llm.common import broadcast_if_few, components, scan_tasks, staged, work_folder

TILE = 2048
SAMPLE_VALUES = 4_000_000  # numbers in the sample for the principal axes
KEY = ["label", "dim", "h1", "h2"]
SLACK = 1e-9


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # no overflow or underflow in the squares
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def principal_axes(classes: DataFrame) -> dict[int, np.ndarray]:
    """Rotation for every dimension, from the vectors of least hash."""
    axes = {}
    for (dim,) in classes.select("dim").distinct().collect():
        rows = classes.filter(F.col("dim") == dim).orderBy("h1", "h2", "label").limit(max(SAMPLE_VALUES // dim, 1))
        unit = _unit(_matrix(rows.select("embedding").toArrow().column(0).combine_chunks(), dim))
        values, basis = np.linalg.eigh(unit.T @ unit)
        axes[dim] = basis[:, np.argsort(-values)]
    return axes


class Tile:
    """A home block of vectors and the links found to those that stream past."""

    def __init__(self, ids: np.ndarray, counts: np.ndarray, x: np.ndarray, axes: np.ndarray, threshold: float) -> None:
        self.ids, self.counts, self.x, self.axes, self.threshold = ids, counts, x, axes, threshold
        self.norm = np.sqrt((x * x).sum(1))
        self.u = _unit(x) @ axes
        self.cuts = sorted({max(1, x.shape[1] // 4), max(1, x.shape[1] // 2)})
        self.links = np.zeros(len(ids), np.int64)
        self.root = np.arange(len(ids))
        left, right = self.pairs(x, self.u, triangle=True)
        np.add.at(self.links, left, counts[right])
        np.add.at(self.links, right, counts[left])
        for a, b in zip(left.tolist(), right.tolist(), strict=True):
            self.unite(a, b)

    def find(self, a: int) -> int:
        while self.root[a] != a:
            self.root[a] = self.root[self.root[a]]
            a = self.root[a]
        return a

    def unite(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        self.root[max(a, b)] = min(a, b)

    def pairs(self, x: np.ndarray, u: np.ndarray, triangle: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Indices (home, other) of all pairs at the threshold or above."""
        first = self.cuts[0]

        def rest(v: np.ndarray, k: int) -> np.ndarray:
            return np.sqrt((v[:, k:] ** 2).sum(1))

        found = []
        for low in range(0, len(u), 512):
            part = u[low : low + 512]
            product = self.u[:, :first] @ part[:, :first].T
            alive = product + np.outer(rest(self.u, first), rest(part, first)) >= self.threshold - SLACK
            home, other = np.nonzero(alive)
            if triangle:
                keep = home < other + low
                home, other = home[keep], other[keep]
            value, done = product[home, other], first
            for cut in self.cuts[1:]:
                value = value + np.einsum("ij,ij->i", self.u[home, done:cut], part[other, done:cut])
                keep = value + rest(self.u, cut)[home] * rest(part, cut)[other] >= self.threshold - SLACK
                home, other, value, done = home[keep], other[keep], value[keep], cut
            value = value + np.einsum("ij,ij->i", self.u[home, done:], part[other, done:])
            keep = value >= self.threshold - SLACK
            found.append(np.stack([home[keep], other[keep] + low]))
        home, other = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
        cosine = np.einsum("ij,ij->i", self.x[home], x[other]) / (self.norm[home] * np.sqrt((x[other] ** 2).sum(1)))
        keep = cosine >= self.threshold
        return home[keep], other[keep]

    def visit(self, ids: np.ndarray, counts: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(id, links, a linked id) of the visitors that have links; homes linked by one visitor unite."""
        home, other = self.pairs(x, _unit(x) @ self.axes)
        np.add.at(self.links, home, counts[other])
        order = np.argsort(other, kind="stable")
        home, other = home[order], other[order]
        same = np.flatnonzero(other[1:] == other[:-1])
        for k in same.tolist():
            self.unite(int(home[k]), int(home[k + 1]))
        who, first = np.unique(other, return_index=True)
        links = np.bincount(other, self.counts[home], minlength=len(ids))[who].astype(np.int64)
        return ids[who], links, self.ids[home[first]]

    def result(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same of the home rows, each linked to the first of its group."""
        linked = np.flatnonzero(self.links)
        return self.ids[linked], self.links[linked], self.ids[[self.find(k) for k in linked.tolist()]]


def tile_links(tiled: DataFrame, axes: dict[int, np.ndarray], threshold: float) -> DataFrame:
    """(id, links, other): links of every row within its tiles, and edges that connect what is linked."""
    names = ["id", "links", "other"]

    def rows(ids: np.ndarray, links: np.ndarray, other: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(links), pa.array(other)], names)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, tile, homes = None, None, []
        for batch in batches:
            keys = list(zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True))
            visits = np.array(batch.column(5).to_pylist(), bool)
            at = 0
            while at < len(keys):
                end = at
                while end < len(keys) and keys[end] == keys[at] and visits[end] == visits[at]:
                    end += 1
                if keys[at] != key:
                    if tile is None and homes:
                        yield rows(*Tile(*map(np.concatenate, zip(*homes, strict=True)), axes[key[1]], threshold).result())
                    elif tile is not None:
                        yield rows(*tile.result())
                    key, tile, homes = keys[at], None, []
                part = batch.slice(at, end - at)
                ids, counts = (np.array(part.column(k).to_pylist(), np.int64) for k in (6, 7))
                data = (ids, counts, _matrix(part.column(8), key[1]))
                if not visits[at]:
                    homes.append(data)
                elif homes:
                    if tile is None:
                        tile = Tile(*map(np.concatenate, zip(*homes, strict=True)), axes[key[1]], threshold)
                    yield rows(*tile.visit(*data))
                at = end
        if tile is None and homes:
            tile = Tile(*map(np.concatenate, zip(*homes, strict=True)), axes[key[1]], threshold)
        if tile is not None:
            yield rows(*tile.result())

    return tiled.mapInArrow(search, "id long, links long, other long")


def _placed(classes: DataFrame, axes: dict[int, np.ndarray], width: float) -> DataFrame:
    """The classes with their cell."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.array(batch.column(1).to_pylist(), np.int64)
            cells = np.zeros((len(dims), 2), np.int64)
            for dim in np.unique(dims).tolist():
                mine = np.flatnonzero(dims == dim)
                u = _unit(_matrix(batch.column(4).take(pa.array(mine)), dim)) @ axes[dim][:, :2]
                cells[mine, : u.shape[1]] = np.floor(u / width)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cells[:, 0]), pa.array(cells[:, 1])],
                ["label", "dim", "id", "n", "embedding", "c1", "c2"],
            )

    kinds = dict(classes.dtypes)
    return classes.select("label", "dim", "id", "n", "embedding").mapInArrow(
        place, f"label {kinds['label']}, dim int, id long, n long, embedding {kinds['embedding']}, c1 long, c2 long"
    )


def near_vectors(embeddings: DataFrame, threshold: float = 0.98) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    spark = embeddings.sparkSession
    folder = work_folder(spark, "vectors")
    inf = F.lit(float("inf"))
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < inf))
    usable = finite & F.exists("embedding", lambda v: v != 0) & F.col("label").isNotNull() & (F.size("embedding") > 0)
    plain = F.transform("embedding", lambda v: F.when(v == 0, F.lit(0).cast("float")).otherwise(v))
    # Equal vectors share both hashes; minus zero counts as zero.
    rows = embeddings.select("vec_id", "label", plain.alias("embedding")).withColumn("usable", F.coalesce(usable, F.lit(False)))
    rows = rows.withColumns(
        {
            "dim": F.when(F.col("usable"), F.size("embedding")),
            "h1": F.when(F.col("usable"), F.xxhash64("embedding")),
            "h2": F.when(F.col("usable"), F.xxhash64(F.lit("second"), "embedding")),
        }
    )
    classes = rows.filter("usable").groupBy(*KEY).agg(
        F.min("vec_id").alias("id"), F.count("*").alias("n"), F.first("embedding").alias("embedding")
    )
    classes = staged(classes, f"{folder}/classes")
    axes = principal_axes(classes)
    width = float(np.sqrt(2 - 2 * threshold)) + 1e-6
    placed = staged(_placed(classes.filter("id IS NOT NULL"), axes, width), f"{folder}/placed")
    cell = ["label", "dim", "c1", "c2"]
    blocks = placed.groupBy(*cell).agg(F.ceil(F.count("*") / TILE).cast("int").alias("blocks"))
    blocks = staged(blocks, f"{folder}/blocks")
    moves = [(0, 0), (0, 1), (1, -1), (1, 0), (1, 1)]
    shift = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in moves]))
    spread = placed.withColumn("m", shift).withColumns({"c1": F.col("c1") + F.col("m.a"), "c2": F.col("c2") + F.col("m.b")})
    own = (F.col("m.a") == 0) & (F.col("m.b") == 0)
    home = F.pmod(F.xxhash64("id"), "blocks").cast("int")
    last = F.when(own, home).otherwise(F.col("blocks") - 1)
    tiled = (
        spread.join(broadcast_if_few(blocks), cell)
        .withColumn("block", F.explode(F.sequence(F.lit(0), last)))
        .select(*cell, "block", (~own | (F.col("block") != home)).alias("visits"), "id", "n", "embedding")
    )
    tile = [*cell, "block"]
    streamed = tiled.repartition(scan_tasks(embeddings), *tile).sortWithinPartitions(*tile, "visits")
    found = staged(tile_links(streamed, axes, threshold), f"{folder}/found")
    edges = found.select(F.col("id").alias("a"), F.col("other").alias("b"))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    grouped = components(classes.filter("id IS NOT NULL").select("id").distinct(), edges, folder)
    known = classes.select(*KEY, "id", "n").join(links, "id", "left").join(grouped, "id", "left")
    known = known.withColumn("own", F.coalesce("links", F.lit(0)) + F.col("n") - 1).select(*KEY, "own", "component_id")
    component = F.coalesce("component_id", "vec_id")
    return rows.join(known, KEY, "left").select(
        "vec_id",
        F.coalesce("own", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("vec_id").isNotNull(), component).alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )
