"""Calendar helpers. A run's dates are constants, so no calendar table is joined."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame

from plantcast.config import PlanConfig
from plantcast.functions.values import literal


def history_days(cfg: PlanConfig) -> str:
    return f"sequence({literal(cfg.history_start)}, {literal(cfg.history_end)})"


def forecast_days(cfg: PlanConfig) -> str:
    return f"sequence({literal(cfg.forecast_start)}, {literal(cfg.forecast_end)})"


def in_history(cfg: PlanConfig, c: str = "order_date") -> str:
    return f"{c} BETWEEN {literal(cfg.history_start)} AND {literal(cfg.history_end)}"


def weekday_counts(start: date, days: int) -> list[int]:
    """How often each weekday (Monday first) falls in a run of days."""
    counts = [days // 7] * 7
    for i in range(days % 7):
        counts[(start + timedelta(days=i)).weekday()] += 1
    return counts


def filled(c: str, days: int) -> str:
    """Per-day array of doubles, all zero where a left join found nothing."""
    return f"coalesce({c}, array_repeat(0.0D, {days})) AS {c}"


def per_day(df: DataFrame, cfg: PlanConfig, keys: list[str], **arrays: str) -> DataFrame:
    """Spread per-day arrays to one row per key and forecast day; a keyword names an output column.

    The arrays are indexed after the explode, so one that nobody reads is pruned away
    together with everything computed for it.
    """
    sources = list(dict.fromkeys(arrays.values()))
    spread = df.selectExpr(*keys, *sources, f"posexplode({forecast_days(cfg)}) AS (day_no, forecast_date)")
    values = [f"get({source}, day_no) AS {name}" for name, source in arrays.items()]
    return spread.selectExpr("forecast_date", *keys, *values)
