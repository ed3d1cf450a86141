"""Bills of material, stock, open purchases, and demand exploded into parts."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantcast.config import PlanConfig
from plantcast.functions.days import per_day
from plantcast.functions.values import leading_integer, literal, number_or


def bom(header: DataFrame, detail: DataFrame) -> DataFrame:
    """product_id, part_no, bom_qty: one row per bill-of-material line."""
    products = header.select("bom_id", leading_integer("product_code").alias("product_id"))
    lines = detail.select("bom_id", "part_no", number_or("qty", 0.0).alias("bom_qty"))
    return products.filter("product_id IS NOT NULL").join(lines, "bom_id").select("product_id", "part_no", "bom_qty")


def stock(parts: DataFrame) -> DataFrame:
    """part_no, stock_qty, safety_qty; the table holds one row per part."""
    return parts.filter("part_no IS NOT NULL").select(
        F.expr("CAST(part_no AS string) AS part_no"),
        number_or("stock_qty", 0.0).alias("stock_qty"),
        number_or("safety_stock", 0.0).alias("safety_qty"),
    )


def _pending(purchase: DataFrame) -> DataFrame:
    """Open purchases with a date; the stored collation ignores case in the status."""
    return purchase.filter("lower(status) = 'pending' AND delivery_date IS NOT NULL")


def incoming_by_day(purchase: DataFrame) -> DataFrame:
    return (
        _pending(purchase)
        .select("part_no", F.expr("to_date(delivery_date) AS eta_date"), number_or("order_qty", 0.0).alias("qty"))
        .groupBy("part_no", "eta_date")
        .agg(F.expr("sum(qty) AS incoming_qty"))
    )


def incoming_arrays(purchase: DataFrame, cfg: PlanConfig) -> DataFrame:
    """part_no and ``incoming``, an array over the forecast days.

    Dates outside the forecast never reach the projection, so the raw column is compared
    with the window's ends, which pushes the range into the scan.
    """
    after = cfg.forecast_end + timedelta(days=1)
    due = _pending(purchase).filter(
        f"delivery_date >= {literal(cfg.forecast_start)} AND delivery_date < {literal(after)}"
    )
    rows = due.select("part_no", F.expr("to_date(delivery_date) AS eta"), number_or("order_qty", 0.0).alias("qty"))
    days = [f"sum(CASE WHEN eta = {literal(d)} THEN qty ELSE 0.0D END)" for d in cfg.forecast_dates]
    return rows.groupBy("part_no").agg(F.expr(f"array({', '.join(days)}) AS incoming"))


def product_lines(products: DataFrame, lines: DataFrame) -> DataFrame:
    """Join products with their bill of material.

    The products come out of an aggregation on ``product_id``; joined on that same column
    they would share its exchange, and Spark splits a skewed join only where both sides
    come straight from an exchange of their own. The text key gives them one, so a product
    that owns a large share of all lines is spread over several tasks.
    """
    left = products.selectExpr("*", "CAST(product_id AS string) AS product_key")
    right = lines.selectExpr("CAST(product_id AS string) AS product_key", "part_no", "bom_qty")
    return left.join(right, "product_key").drop("product_key")


def bom_explosion(products: DataFrame, lines: DataFrame, cfg: PlanConfig) -> DataFrame:
    """Requirement per day, product and bill line, for the demand and for the planned output."""
    days = per_day(
        product_lines(products, lines),
        cfg,
        ["product_id", "part_no", "bom_qty"],
        demand="demand",
        output="output",
    )
    return days.selectExpr(
        "forecast_date",
        "product_id",
        "part_no",
        "bom_qty",
        "demand * bom_qty AS part_demand_for_customer_demand",
        "output * bom_qty AS part_demand_for_planned_output",
    )


def part_demand(products: DataFrame, lines: DataFrame, cfg: PlanConfig) -> DataFrame:
    """part_no with the arrays ``part_demand`` and ``output_need`` over the forecast days."""
    return part_sums(product_lines(products, lines), cfg)


def part_sums(lines: DataFrame, cfg: PlanConfig) -> DataFrame:
    """The same from product lines that carry ``demand`` and ``output``.

    Both requirements come from one aggregation, one row per bill line going in.
    """

    def sums(array: str, name: str) -> str:
        days = [f"sum(get({array}, {i}) * bom_qty)" for i in range(cfg.forecast_days)]
        return f"array({', '.join(days)}) AS {name}"

    needs = F.expr(sums("demand", "part_demand")), F.expr(sums("output", "output_need"))
    return lines.filter("part_no IS NOT NULL").groupBy("part_no").agg(*needs)


def daily_part_demand(demand: DataFrame, cfg: PlanConfig) -> DataFrame:
    """``part_demand`` spread to one row per day and part."""
    return per_day(
        demand, cfg, ["part_no"], part_demand="part_demand", planned_output_part_demand="output_need"
    )
