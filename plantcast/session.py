"""Session settings the engine is designed for."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    # Runtime re-planning: joins switch to broadcast only on measured sizes, small
    # shuffle partitions are merged, and a join partition swollen by a hot key is split.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Where Spark's size limits allow it, order lines without an order in the look-back window are
    # dropped before the shuffle. Plans do not rely on it: the day layout prunes them at the scan.
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    # Streaming state is kept on disk beside the heap, and checkpoints write its changes only.
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state."
    "RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # No Python call site is recorded for every column expression.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(app: str = "plantcast", master: str | None = None, **extra: str) -> SparkSession:
    """Session with ``SETTINGS``; ``extra`` names use ``__`` for the dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
