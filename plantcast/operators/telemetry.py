"""Machine readings: selection, health and the capacity factor."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantcast.config import PlanConfig
from plantcast.functions.health import blended_capacity, continuous_score, step_score
from plantcast.functions.values import half_even, literal, number_or, number_sql

READING = ["machine_id", "temperature", "vibration", "rpm", "created_at"]


def _since(readings: DataFrame, moment: datetime) -> DataFrame:
    """Readings from ``moment`` on; a day-partitioned store is pruned by its folder."""
    if "reading_date" in readings.columns:
        readings = readings.filter(f"reading_date >= {literal(moment.date())}")
    return readings.filter(f"created_at >= {literal(moment)}").select(*READING)


def recent_readings(machine_data: DataFrame, cfg: PlanConfig) -> DataFrame:
    """Readings of the last ``telemetry_hours``."""
    return _since(machine_data, cfg.telemetry_cutoff)


def retain_recent(machine_data: DataFrame, cfg: PlanConfig) -> DataFrame:
    """Readings that the retention rule keeps."""
    return _since(machine_data, cfg.retention_cutoff)


def _newest_days(machine_data: DataFrame, n: int, days: DataFrame | None = None) -> DataFrame:
    """Readings of the days that hold the newest ``n``: each day with fewer than ``n`` after it.

    The window runs over one row per calendar day. The first day is a scalar subquery on the
    partition column, so older folders are not read. ``days`` (reading_date, readings) are the counts
    that a store has kept; without them the readings are counted.
    """
    if days is None:
        days = machine_data.groupBy("reading_date").agg(F.expr("count(*) AS readings"))
    after = "sum(readings) OVER (ORDER BY reading_date DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    needed = days.selectExpr("reading_date", f"coalesce({after}, 0) AS readings_after").filter(f"readings_after < {n}")
    return machine_data.filter(F.col("reading_date") >= needed.agg(F.min("reading_date")).scalar())


def latest_readings(machine_data: DataFrame, cfg: PlanConfig, days: DataFrame | None = None) -> DataFrame:
    """Newest readings over all machines; the other columns break ties."""
    if "reading_date" in machine_data.columns:
        machine_data = _newest_days(machine_data, cfg.latest_readings, days)
    newest = F.desc("created_at"), "machine_id", "temperature", "vibration", "rpm"
    return machine_data.select(*READING).orderBy(*newest).limit(cfg.latest_readings)


def clean_readings(readings: DataFrame, cfg: PlanConfig) -> DataFrame:
    """Sensor values as doubles, a missing or unreadable one at its harmless level."""
    return readings.select(
        "machine_id",
        number_or("temperature", cfg.temp_base).alias("temperature"),
        number_or("vibration", cfg.vib_base).alias("vibration"),
        number_or("rpm", cfg.rpm_target).alias("rpm"),
        "created_at",
    )


def reading_health(readings: DataFrame, cfg: PlanConfig) -> DataFrame:
    """Cleaned readings with their continuous health score; works on streams."""
    return clean_readings(readings, cfg).withColumn("health_score", continuous_score(cfg))


def reading_health_step(readings: DataFrame, cfg: PlanConfig) -> DataFrame:
    """Readings with the step score."""
    return readings.withColumn("health_score", step_score(cfg))


def machine_health(scored: DataFrame) -> DataFrame:
    """Mean score per machine; a machine with most of the readings is pre-averaged per task."""
    return (
        scored.filter("machine_id IS NOT NULL")
        .groupBy("machine_id")
        .agg(F.expr("avg(health_score) AS machine_health"))
    )


def capacity_factor(machines: DataFrame, cfg: PlanConfig) -> DataFrame:
    """One row: mean and worst machine health, and the capacity factor made of them."""
    mean, worst = "avg(machine_health)", "min(machine_health)"
    return machines.agg(
        F.expr(f"coalesce({mean}, 1.0D) AS avg_health"),
        F.expr(f"coalesce({worst}, 1.0D) AS min_health"),
        F.expr(f"{blended_capacity(mean, worst, cfg)} AS capacity_factor"),
    )


def capacity_factor_step(scored: DataFrame) -> DataFrame:
    """One row: the mean score over the readings is the factor."""
    mean = "coalesce(avg(health_score), 1.0D)"
    return scored.agg(F.expr(f"{mean} AS avg_health"), F.expr(f"{mean} AS capacity_factor"))


def _stamp(c: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias("x")


def machine_series(scored: DataFrame) -> DataFrame:
    """Display series, ordered by machine and time.

    Rows stay flat: the sort splits a busy machine over many range partitions, where an
    array per machine would have to fit one task.
    """
    return (
        scored.filter("machine_id IS NOT NULL")
        .orderBy("machine_id", "created_at")
        .select(
            "machine_id",
            _stamp("created_at"),
            half_even("temperature", 2).alias("temperature"),
            half_even("vibration", 4).alias("vibration"),
            half_even("rpm").alias("rpm"),
            half_even("health_score", 3).alias("health_score"),
        )
    )


def latest_series(latest: DataFrame) -> DataFrame:
    """Display series of the newest readings over all machines, oldest first."""
    return latest.orderBy("created_at").select(
        _stamp("created_at"),
        half_even(number_sql("temperature"), 2).alias("temperature"),
        half_even(number_sql("vibration"), 4).alias("vibration"),
    )
