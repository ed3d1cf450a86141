"""Weekday forecast and what the machines can make of it.

A product's forecast travels as one row with an array over the forecast days; it is
spread to one row per day only where a table per day is asked for. Joins and shuffles
on the way thus carry ``forecast_days`` times fewer rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantcast.config import PlanConfig
from plantcast.functions.days import forecast_days, per_day
from plantcast.functions.values import whole_sql


def _expected(day: str) -> str:
    return whole_sql(f"coalesce(get(weekday_mean, weekday({day})), overall_mean, 0.0D)")


def forecast(profile: DataFrame, cfg: PlanConfig) -> DataFrame:
    """One row per product and forecast day, with both means."""
    spread = profile.selectExpr("*", f"explode({forecast_days(cfg)}) AS forecast_date")
    return spread.selectExpr(
        "forecast_date",
        "weekday(forecast_date) AS dow",
        "product_id",
        "get(weekday_mean, weekday(forecast_date)) AS weekday_mean_qty",
        "overall_mean AS overall_mean_qty",
        f"{_expected('forecast_date')} AS forecast_demand_qty",
    )


def forecast_arrays(profile: DataFrame, cfg: PlanConfig) -> DataFrame:
    """product_id and ``demand``, an array over the forecast days."""
    return profile.selectExpr("product_id", f"transform({forecast_days(cfg)}, day -> {_expected('day')}) AS demand")


def with_capacity(products: DataFrame, factor: DataFrame) -> DataFrame:
    """Add the capacity factor (a one-row table, read as a scalar) and the array ``output``."""
    scaled = products.withColumn("capacity_factor", factor.select("capacity_factor").scalar())
    # The factor comes in as a second array: a scalar subquery cannot sit inside a lambda.
    factors = "array_repeat(capacity_factor, size(demand))"
    return scaled.withColumn("output", F.expr(f"zip_with(demand, {factors}, (qty, f) -> {whole_sql('qty * f')})"))


def capacity_plan(products: DataFrame, cfg: PlanConfig) -> DataFrame:
    """Demand, expected output and gap per product and day."""
    plan = per_day(
        products,
        cfg,
        ["product_id", "capacity_factor"],
        forecast_demand_qty="demand",
        expected_output_qty="output",
    )
    return plan.withColumn("gap_qty", F.expr("greatest(forecast_demand_qty - expected_output_qty, 0L)"))


def capacity_plan_adjusted(products: DataFrame, cfg: PlanConfig) -> DataFrame:
    """Original forecast and the forecast cut to capacity, which then counts as the demand."""
    return per_day(
        products,
        cfg,
        ["product_id", "capacity_factor"],
        original_forecast_qty="demand",
        forecast_qty="output",
    )


def day_totals(products: DataFrame, cfg: PlanConfig) -> DataFrame:
    """One row: demand, output and gap over all products as arrays over the days."""

    def sums(value: str, name: str) -> str:
        days = [f"coalesce(sum({value.format(i=i)}), 0L)" for i in range(cfg.forecast_days)]
        return f"array({', '.join(days)}) AS {name}"

    return products.agg(
        F.expr(sums("get(demand, {i})", "demand")),
        F.expr(sums("get(output, {i})", "output")),
        F.expr(sums("greatest(get(demand, {i}) - get(output, {i}), 0L)", "gap")),
        F.count("*").alias("products"),
    )


def demand_compare(totals: DataFrame, cfg: PlanConfig) -> DataFrame:
    """Demand, output and gap per day over all products; no rows without products."""
    return per_day(
        totals.filter("products > 0"),
        cfg,
        [],
        forecast_demand_qty="demand",
        expected_output_qty="output",
        gap_qty="gap",
    )


def demand_compare_adjusted(totals: DataFrame, cfg: PlanConfig) -> DataFrame:
    return per_day(
        totals.filter("products > 0"), cfg, [], original_forecast_qty="demand", forecast_qty="output"
    )
