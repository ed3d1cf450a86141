"""Order history: from order lines to demand per product and weekday."""

from __future__ import annotations

from datetime import datetime, time, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantcast.config import PlanConfig
from plantcast.functions.days import history_days, in_history, weekday_counts
from plantcast.functions.values import literal
from plantcast.sources.tables import Sources

WEEKDAYS = range(7)  # Monday first


def order_lines(orders: DataFrame, items: DataFrame, cfg: PlanConfig) -> DataFrame:
    """Lines of uncancelled orders since the cutoff: order_date, product_id, qty.

    There is no upper bound, so today's and later orders are kept. Items stored by
    ``order_date`` (see ``sources.layout``) or ``order_month`` (``sources.orders``) are pruned to the window
    before the join; those under null have come before their order and are read always.
    An order that holds a large share of all lines is split by the adaptive skew join:
    both sides reach the join straight from their scan's exchange.
    """
    month = literal(cfg.history_start.replace(day=1))
    if "order_month" in orders.columns:
        orders = orders.filter(f"order_month >= {month}")
    window = orders.filter(
        f"status <> 'cancelled' AND created_at >= {literal(cfg.order_cutoff)}"
    ).selectExpr("id AS order_id", "to_date(created_at) AS order_date")
    if "order_date" in items.columns:
        items = items.filter(f"order_date >= {literal(cfg.history_start)} OR order_date IS NULL")
    elif "order_month" in items.columns:
        items = items.filter(f"order_month >= {month} OR order_month IS NULL")
    lines = items.selectExpr("order_id", "try_cast(product_id AS bigint) AS product_id", "quantity AS qty").filter(
        "product_id IS NOT NULL AND qty IS NOT NULL"
    )
    return window.join(lines, "order_id").select("order_date", "product_id", "qty")


def window_lines(sources: Sources, cfg: PlanConfig) -> DataFrame:
    """The same from stored daily sums where the sources have them, a row then being a day's sum of a product.

    The look-back begins at a time of day, so of its first day the order lines are read.
    """
    daily = sources.daily_demand
    if daily is None:
        return order_lines(sources.orders, sources.order_items, cfg)
    if cfg.order_cutoff.time() == time():
        return daily.filter(f"order_date >= {literal(cfg.history_start)}").select("order_date", "product_id", "qty")
    orders, items = sources.orders, sources.order_items
    month = literal(cfg.history_start.replace(day=1))
    orders = orders.filter(f"created_at < {literal(datetime.combine(cfg.history_start + timedelta(days=1), time()))}")
    if "order_month" in orders.columns:
        orders = orders.filter(f"order_month <= {month}")
    if "order_date" in items.columns:
        items = items.filter(f"order_date <= {literal(cfg.history_start)} OR order_date IS NULL")
    elif "order_month" in items.columns:
        items = items.filter(f"order_month <= {month} OR order_month IS NULL")
    later = daily.filter(f"order_date > {literal(cfg.history_start)}").select("order_date", "product_id", "qty")
    return later.union(order_lines(orders, items, cfg))


def order_history(lines: DataFrame) -> DataFrame:
    """Quantity per day and product."""
    return lines.groupBy("order_date", "product_id").agg(F.expr("sum(qty) AS qty"))


def history_today(history: DataFrame, cfg: PlanConfig) -> DataFrame:
    """History rows of the running day, which the grid leaves out."""
    return history.filter(f"order_date = {literal(cfg.today)}")


def history_grid(history: DataFrame, cfg: PlanConfig) -> DataFrame:
    """Every day of the look-back for every product seen in the history."""
    products = history.select("product_id").distinct()
    return products.selectExpr(f"explode({history_days(cfg)}) AS order_date", "product_id")


def complete_history(history: DataFrame, cfg: PlanConfig) -> DataFrame:
    """History on the full day grid, with zero on days without orders.

    The history has one row per product and day, so a product gathers at most
    ``lookback_days`` entries here; the missing days are added beside them, and the grid
    is never shuffled or joined.
    """
    entry = "named_struct('order_date', order_date, 'qty', CAST(qty AS double))"
    known = history.groupBy("product_id").agg(
        F.expr(f"collect_list(CASE WHEN {in_history(cfg)} THEN {entry} END) AS known")
    )
    missing = (
        f"transform(array_except({history_days(cfg)}, known.order_date), "
        "day -> named_struct('order_date', day, 'qty', 0.0D))"
    )
    return known.selectExpr("product_id", f"inline(concat(known, {missing}))").selectExpr(
        "order_date", "product_id", "qty", "weekday(order_date) AS dow"
    )


def demand_profile(lines: DataFrame, cfg: PlanConfig) -> DataFrame:
    """Weekday means (Monday first) and overall mean per product on the full day grid.

    Days without orders count as zero, so a mean is a sum over a number of days known in
    advance. One aggregation straight from the lines replaces grid, join and two group-bys;
    a product with most of the lines shrinks to one row per task before the shuffle.
    ``lines`` may be order lines or the daily history.
    """
    sized = lines.selectExpr(
        "product_id",
        "weekday(order_date) AS dow",
        f"CASE WHEN {in_history(cfg)} THEN CAST(qty AS double) ELSE 0.0D END AS qty",
    )
    days = weekday_counts(cfg.history_start, cfg.lookback_days)
    means = [
        f"sum(CASE WHEN dow = {d} THEN qty ELSE 0.0D END) / {literal(days[d])}" if days[d] else "CAST(NULL AS double)"
        for d in WEEKDAYS
    ]
    return sized.groupBy("product_id").agg(
        F.expr(f"array({', '.join(means)}) AS weekday_mean"),
        F.expr(f"sum(qty) / {literal(cfg.lookback_days)} AS overall_mean"),
    )


def sparse_profile(history: DataFrame) -> DataFrame:
    """The same means over the days with orders only, today's and later days included."""
    means = [f"avg(CASE WHEN dow = {d} THEN qty END)" for d in WEEKDAYS]
    return (
        history.selectExpr("product_id", "weekday(order_date) AS dow", "CAST(qty AS double) AS qty")
        .groupBy("product_id")
        .agg(F.expr(f"array({', '.join(means)}) AS weekday_mean"), F.expr("avg(qty) AS overall_mean"))
    )


def weekday_mean(profile: DataFrame) -> DataFrame:
    """One row per product and weekday that has a mean."""
    return profile.selectExpr("product_id", "posexplode(weekday_mean) AS (dow, weekday_mean_qty)").filter(
        "weekday_mean_qty IS NOT NULL"
    )


def overall_mean(profile: DataFrame) -> DataFrame:
    return profile.selectExpr("product_id", "overall_mean AS overall_mean_qty")
