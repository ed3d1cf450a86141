"""Input validation and source profile."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantcast.config import PlanConfig


class MissingInput(ValueError):
    """A plan was asked for without stock or without orders."""


def _checked(history: DataFrame, cfg: PlanConfig, parts: DataFrame | None) -> list[tuple[str, DataFrame, str]]:
    """Name, table and the message if it is empty."""
    found = [("order_history", history, f"no orders in the last {cfg.lookback_days} days")]
    if parts is not None:
        found.append(("parts", parts, "the parts table is empty, inventory cannot be projected"))
    return found


def input_checks(history: DataFrame, cfg: PlanConfig, parts: DataFrame | None = None) -> DataFrame:
    """One row per check: name, rows found, passed, message."""
    checks = [
        df.agg(F.count("*").alias("row_count")).select(
            F.lit(name).alias("check_name"),
            "row_count",
            (F.col("row_count") > 0).alias("passed"),
            F.when(F.col("row_count") == 0, message).alias("message"),
        )
        for name, df, message in _checked(history, cfg, parts)
    ]
    return reduce(DataFrame.unionByName, checks)


def require_inputs(checks: DataFrame) -> None:
    """Raise on the first failed check; reads one row."""
    failed = checks.filter(~F.col("passed")).select("message").first()
    if failed:
        raise MissingInput(failed.message)


def require_rows(products: DataFrame, cfg: PlanConfig, parts: DataFrame | None = None) -> None:
    """The same checks on a table that the plan has written: no counts, and no join of the order lines.

    ``products`` has one row per product of the order history, so it is empty exactly if the history is.
    """
    for _, table, message in _checked(products, cfg, parts):
        if table.isEmpty():
            raise MissingInput(message)


def source_profile(tables: dict[str, tuple[DataFrame, str | None]]) -> DataFrame:
    """Rows and time range of every table; ``tables`` maps a name to table and time column."""

    def profile(name: str, df: DataFrame, time: str | None) -> DataFrame:
        moment = F.col(time).cast("timestamp_ntz") if time else F.lit(None).cast("timestamp_ntz")
        return df.agg(
            F.count("*").alias("row_count"), F.min(moment).alias("first_time"), F.max(moment).alias("last_time")
        ).select(F.lit(name).alias("source_name"), "row_count", "first_time", "last_time")

    return reduce(DataFrame.unionByName, [profile(n, df, t) for n, (df, t) in tables.items()])
