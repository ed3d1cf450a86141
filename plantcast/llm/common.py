"""Helpers shared by the operators: staged tables, word hashes, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
CHUNK_BYTES = 1 << 21
SMALL_BYTES = 1 << 19  # where runs of texts are not aggregated; hashing takes some 50 bytes for each


def work_folder(spark: SparkSession, name: str) -> str:
    """Fresh folder below ``spark.checkpoint.dir``; a local session without it gets one of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="llm-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, folder: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, survives lost executors."""
    df.write.mode("overwrite").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def drop_folder(spark: SparkSession, folder: str) -> None:
    """Remove a staged folder whose table is no longer read."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def require_whole(df: DataFrame, *columns: str) -> None:
    """Refuse ids that are not whole numbers, by name of the column."""
    for name in columns:
        kind = dict(df.dtypes)[name]
        if kind not in ("tinyint", "smallint", "int", "bigint"):
            raise TypeError(f"{name} must be a whole number, not {kind}")


def scan_tasks(df: DataFrame) -> int:
    """Partitions for a shuffle of the whole of ``df``: the session's setting, at least one per core."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def text_chunks(texts: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Cut a string array into runs of whole texts of about ``size`` bytes.

    Yields the first row of the run, its bytes and the offsets of its texts (one more than texts).
    Nulls have no bytes.
    """
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    n = len(texts)
    ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        last = int(np.searchsorted(ends, ends[row] + size, "right")) - 1
        last = min(max(last, row + 1), n)
        yield row, raw[ends[row] : ends[last]], ends[row : last + 1] - ends[row]
        row = last


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BYTE[0x41:0x5B] = _BYTE[0x61:0x7B]  # A-Z count as a-z
_BASE = 0xD1342543DE82EF95
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0], _powers[1]


def word_spans(raw: np.ndarray, offsets: np.ndarray, word_byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every run of bytes with ``word_byte``; runs do not cross texts."""
    n = len(raw)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = word_byte[raw]
    begin = np.zeros(n + 1, bool)
    begin[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | begin[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    return starts, np.flatnonzero(inside & (~after | begin[1:])) + 1


def span_hashes(raw: np.ndarray, spans: list[tuple[np.ndarray, np.ndarray]], values: np.ndarray | None = None) -> list:
    """64-bit hashes of lists of byte spans, A-Z as a-z; ``values`` can count other bytes as equal too."""
    n = len(raw)
    values = _BYTE if values is None else values
    power, inverse = _power_tables(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values[raw] * power[:n], out=sums[1:])
    return [_mix((sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64)) for s, e in spans]


def word_hashes(raw: np.ndarray, offsets: np.ndarray, word_byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash every word of the texts; a word is a run of bytes with ``word_byte``, A-Z as a-z.

    Returns the 64-bit hashes in order and, per text, the position of its first word (one more
    than texts).
    """
    starts, ends = word_spans(raw, offsets, word_byte)
    return span_hashes(raw, [(starts, ends)])[0], np.searchsorted(starts, offsets)


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of the ``width`` words from every position on; the caller leaves out those that run over an end."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k in range(width):
        total = _mix(total * np.uint64(0x9E3779B97F4A7C15) + words[k : k + n])
    return total


def shingle_set(words: np.ndarray, width: int, shingles: np.ndarray | None = None) -> np.ndarray:
    """Sorted distinct shingles of one text; a shorter text is one shingle, an empty one has none."""
    if len(words) == 0:
        return np.zeros(0, np.uint64)
    if len(words) < width:
        return shingle_hashes(words, len(words))
    return np.unique(shingle_hashes(words, width) if shingles is None else shingles)


def broadcast_if_few(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """Broadcast hint after a count; a larger table is left to a shuffled join. For narrow rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def components(nodes: DataFrame, edges: DataFrame, folder: str, rounds: int = 60) -> DataFrame:
    """(id, component_id): the smallest id reachable over ``edges`` (a, b); nodes without a link keep their own.

    Every round sends each node's smallest known label to its neighbours and then follows
    labels of labels, so that long chains shrink by doubling. State is one row per linked
    node, written to the shared folder; nothing but a count comes to the driver.
    """
    both = edges.filter("a <> b").select("a", "b").union(edges.filter("a <> b").selectExpr("b", "a")).distinct()
    both = staged(both, f"{folder}/links")
    labels = staged(both.groupBy(F.col("a").alias("id")).agg(F.least("id", F.min("b")).alias("label")), f"{folder}/r0")
    for k in range(1, rounds + 1):
        heard = both.join(labels, both.b == labels.id).groupBy(F.col("a").alias("id")).agg(F.min("label").alias("heard"))
        near = labels.join(heard, "id").select("id", "label", F.least("label", "heard").alias("near"))
        jump = labels.select(F.col("id").alias("near"), F.col("label").alias("far"))
        stepped = near.join(jump, "near", "left").select("id", F.least("near", F.coalesce("far", "near")).alias("next"), "label")
        stepped = staged(stepped, f"{folder}/r{k}")
        changed = stepped.filter("next <> label").limit(1).count()
        labels = stepped.select("id", F.col("next").alias("label"))
        if not changed:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return nodes.join(labels, "id", "left").select("id", F.coalesce("label", "id").alias("component_id"))
