"""Machine health over a stream of readings."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from plantcast.config import PlanConfig
from plantcast.operators.telemetry import reading_health


def score_stream(readings: DataFrame, cfg: PlanConfig) -> DataFrame:
    """Score every reading as it arrives; stateless."""
    return reading_health(readings, cfg)


ROWS_PER_STATE = 125_000  # readings; each may be alone in its hour and so in all windows around it


def state_partitions(spark: SparkSession, readings: int) -> int:
    """Partitions of the state for so many readings in it: one per core at least, and none that grows with the readings."""
    return max(spark.sparkContext.defaultParallelism, -(-readings // ROWS_PER_STATE))


def rolling_health(readings: DataFrame, cfg: PlanConfig, slide: str = "1 hour") -> DataFrame:
    """Mean health per machine over sliding windows of ``telemetry_hours``.

    Readings are first summed per machine and slide, and the windows are built from those
    sums: a reading is not copied into every window it belongs to. A slide closes when the
    watermark, which trails by ``lateness_minutes``, passes its end; later readings of it are
    dropped and counted by ``LateRows``. The number of state partitions is fixed when a query first
    starts, as ``spark.sql.shuffle.partitions`` of its session; ``state_partitions`` gives it for an expected
    number of readings. Within that time the result does not depend on how the
    readings are cut into batches. Window ends fall on multiples of ``slide``.
    """
    scored = reading_health(readings, cfg).withColumn("created_at", F.col("created_at").cast("timestamp"))
    slots = (
        scored.filter("machine_id IS NOT NULL")
        .withWatermark("created_at", f"{cfg.lateness_minutes} minutes")
        .groupBy("machine_id", F.window("created_at", slide).alias("slot"))
        .agg(F.expr("sum(health_score) AS health"), F.expr("count(*) AS readings"))
    )
    span = F.window("slot", f"{cfg.telemetry_hours} hours", slide).alias("span")
    return (
        slots.groupBy("machine_id", span)
        .agg(F.expr("sum(health) / sum(readings) AS machine_health"), F.expr("sum(readings) AS readings"))
        .select(
            "machine_id",
            F.col("span.start").cast("timestamp_ntz").alias("window_start"),
            F.col("span.end").cast("timestamp_ntz").alias("window_end"),
            "machine_health",
            "readings",
        )
    )


class LateRows(StreamingQueryListener):
    """Counts what streams drop because it comes behind the watermark, by query name or id.

    Spark counts rows as they reach the state: readings of one machine and slide that came together
    are one row there. Add it with ``spark.streams.addListener``.
    """

    def __init__(self) -> None:
        self.dropped: Counter[str] = Counter()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        # Only the first operator meets readings; those behind it get what it has let through.
        operators = p.stateOperators
        if operators:
            self.dropped[p.name or str(p.id)] += operators[-1].numRowsDroppedByWatermark

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def run_to_files(stream: DataFrame, path: str, checkpoint: str) -> int:
    """Process what is available, append it to Parquet files; the number of rows that came too late."""
    query = (
        stream.writeStream.outputMode("append")
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    operators = [p["stateOperators"][-1] for p in query.recentProgress if p["stateOperators"]]
    return sum(o["numRowsDroppedByWatermark"] for o in operators)
