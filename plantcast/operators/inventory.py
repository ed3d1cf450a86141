"""Inventory projection and purchase proposals."""

from __future__ import annotations

from pyspark.sql import DataFrame

from plantcast.config import PlanConfig
from plantcast.functions.days import filled, per_day


def stock_days(parts: DataFrame, demand: DataFrame, incoming: DataFrame, cfg: PlanConfig) -> DataFrame:
    """Stock, demand and incoming of every part, one row per part with arrays over the days.

    All three sides hold one row per part; the two aggregated ones are already partitioned
    by part, so only the stock table is shuffled. Parts nobody stocks drop out.
    """
    joined = parts.join(demand, "part_no", "left").join(incoming, "part_no", "left")
    arrays = [filled(c, cfg.forecast_days) for c in ("part_demand", "output_need", "incoming")]
    return joined.selectExpr("part_no", "stock_qty", "safety_qty", *arrays)


def sim_grid(days: DataFrame, cfg: PlanConfig) -> DataFrame:
    """One row per part and forecast day."""
    return per_day(
        days,
        cfg,
        ["part_no", "stock_qty", "safety_qty"],
        part_demand="part_demand",
        planned_output_part_demand="output_need",
        incoming_qty="incoming",
    )


def inventory_projection(grid: DataFrame) -> DataFrame:
    """Stock at the end of each day: a running sum, as nothing feeds back.

    A window holds ``forecast_days`` rows and inherits the part partitioning.
    """
    moved = (
        "sum(incoming_qty - part_demand) OVER (PARTITION BY part_no ORDER BY forecast_date "
        "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    )
    return grid.selectExpr("*", f"stock_qty + {moved} AS end_available").selectExpr(
        "*", "end_available + part_demand AS start_available"
    )


def mrp_plan(projection: DataFrame, cfg: PlanConfig) -> DataFrame:
    """Shortage flags and orders scheduled back from the day of need."""
    short = "safety_qty - end_available > 0"
    return projection.selectExpr(
        "forecast_date",
        "part_no",
        "part_demand",
        "planned_output_part_demand",
        "incoming_qty",
        "stock_qty",
        "safety_qty",
        "start_available",
        "end_available",
        "end_available < safety_qty AS below_safety",
        "end_available < 0 AS below_zero",
        # Subtracted, not negated: an empty stock is short by 0.0, not by -0.0.
        "greatest(0.0D - end_available, 0.0D) AS shortage_qty",
        "greatest(safety_qty - end_available, 0.0D) AS recommended_po_qty",
        f"CASE WHEN {short} THEN date_sub(forecast_date, {cfg.lead_time_days}) END AS suggested_order_date",
        f"CASE WHEN {short} THEN forecast_date END AS required_eta_date",
    )


def mrp_feedback(days: DataFrame, cfg: PlanConfig) -> DataFrame:
    """Orders placed on the day of shortage arrive a lead time later and count as stock.

    The order size depends on earlier orders, so no running sum gives it; each part's days
    are folded into the array of its day-end stocks. An order is what a day-end stock lacks
    to the safety stock, so past orders follow from that array. With lead time 0 an order
    never lands, and orders due after the last day do not land either.
    """
    lead = cfg.lead_time_days or cfg.forecast_days
    # Null before the first arrival, which greatest() skips.
    arrival = f"greatest(safety_qty - get(ends, i - {lead}), 0.0D)"
    ends = (
        f"aggregate(sequence(0, {cfg.forecast_days - 1}), CAST(array() AS array<double>), (ends, i) -> concat(ends, "
        f"array(coalesce(get(ends, i - 1), stock_qty) + get(incoming, i) + {arrival} - get(part_demand, i))))"
    )
    folded = days.selectExpr("*", f"{ends} AS ends").selectExpr("*", f"transform(ends, (e, i) -> {arrival}) AS arrivals")
    plan = per_day(
        folded,
        cfg,
        ["part_no", "stock_qty", "safety_qty"],
        part_demand="part_demand",
        incoming_qty="incoming",
        po_arrival_qty_today="arrivals",
        end_available="ends",
    )
    short = "safety_qty - end_available > 0"
    return plan.selectExpr(
        "forecast_date",
        "part_no",
        "part_demand",
        "incoming_qty",
        "po_arrival_qty_today",
        "stock_qty",
        "safety_qty",
        "end_available + part_demand AS start_available",
        "end_available",
        "end_available < safety_qty AS shortage",
        "greatest(safety_qty - end_available, 0.0D) AS recommended_po_qty",
        f"CASE WHEN {short} THEN date_add(forecast_date, {cfg.lead_time_days}) END AS po_eta_date",
    )
