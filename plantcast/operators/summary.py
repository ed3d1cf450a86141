"""Risk, purchase and key-figure summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plantcast.config import PlanConfig
from plantcast.functions.values import half_even, half_even_sql, truncated_sql

AT_RISK = "days_below_safety > 0 OR days_below_zero > 0"
HAS_ORDER = "first_shortage_date IS NOT NULL"
HAS_ORDER_FEEDBACK = "first_order_date IS NOT NULL"


def _aggregate(df: DataFrame, *expressions: str) -> DataFrame:
    return df.agg(*[F.expr(e) for e in expressions])


def part_outlook(plan: DataFrame) -> DataFrame:
    """Risk and purchase figures of every part in one pass.

    The plan is already partitioned by part, so this adds no shuffle.
    """
    return _aggregate(
        plan.groupBy("part_no"),
        "count_if(below_safety) AS days_below_safety",
        "count_if(below_zero) AS days_below_zero",
        "min(end_available) AS min_available",
        "max(shortage_qty) AS max_shortage_qty",
        "sum(recommended_po_qty) AS total_recommended_qty",
        "min(CASE WHEN recommended_po_qty > 0 THEN forecast_date END) AS first_shortage_date",
        "min(suggested_order_date) AS first_suggested_order_date",
        "min(required_eta_date) AS first_required_eta",
        "max(CASE WHEN recommended_po_qty > 0 THEN shortage_qty END) AS ordered_max_shortage_qty",
    )


def part_risk_summary(outlook: DataFrame) -> DataFrame:
    return outlook.select(
        "part_no",
        "days_below_safety",
        "days_below_zero",
        "min_available",
        "max_shortage_qty",
        "total_recommended_qty",
    )


def _top(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """First ``n`` rows with their rank; the window sees the ``n`` survivors only."""
    rank = F.row_number().over(W.orderBy(*order)).cast("bigint")
    return df.orderBy(*order).limit(n).withColumn("rank", rank)


def risk_parts(outlook: DataFrame, cfg: PlanConfig) -> DataFrame:
    """Most endangered parts, worst first."""
    order = [F.desc("days_below_zero"), F.desc("days_below_safety"), F.desc("max_shortage_qty"), F.asc("part_no")]
    return _top(outlook.filter(AT_RISK), order, cfg.risk_limit).select(
        "rank", "part_no", "days_below_zero", "days_below_safety", "max_shortage_qty"
    )


def po_summary(outlook: DataFrame) -> DataFrame:
    """Parts with a purchase proposal."""
    return outlook.filter(HAS_ORDER).selectExpr(
        "part_no",
        "total_recommended_qty",
        "first_shortage_date",
        "first_suggested_order_date",
        "first_required_eta",
        "ordered_max_shortage_qty AS max_shortage_qty",
        "days_below_safety",
        "days_below_zero",
        "min_available",
    )


def _largest(po: DataFrame, n: int) -> DataFrame:
    return _top(po, [F.desc("total_recommended_qty"), F.asc("part_no")], n)


def po_chart(po: DataFrame, cfg: PlanConfig) -> DataFrame:
    """Largest proposals as chart labels and values; serves both variants."""
    return _largest(po, cfg.chart_limit).select(
        "rank", F.col("part_no").alias("label"), half_even("total_recommended_qty", 2).alias("value")
    )


def _iso(c: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd").alias(c)


def _rounded(c: str) -> Column:
    return half_even(c, 2).alias(c)


TABLE_COLUMNS = (
    "part_no total_recommended_qty first_shortage_date first_suggested_order_date first_required_eta "
    "max_shortage_qty days_below_safety days_below_zero min_available"
).split()


def _displayed(df: DataFrame) -> DataFrame:
    """Dates as text and quantities with two digits, as the purchase table shows them."""
    dates = ("first_shortage_date", "first_suggested_order_date", "first_required_eta")
    quantities = ("total_recommended_qty", "max_shortage_qty", "min_available")
    return df.withColumns({c: _iso(c) for c in dates} | {c: _rounded(c) for c in quantities})


def po_table(po: DataFrame, cfg: PlanConfig) -> DataFrame:
    """Largest proposals as display rows."""
    return _displayed(_largest(po, cfg.table_limit)).select("rank", *TABLE_COLUMNS)


def part_outlook_feedback(plan: DataFrame) -> DataFrame:
    """Risk flag and purchase figures of every part, feedback variant."""
    return _aggregate(
        plan.groupBy("part_no"),
        "bool_or(shortage) AS shortage",
        "sum(recommended_po_qty) AS total_recommended_qty",
        "min(CASE WHEN recommended_po_qty > 0 THEN forecast_date END) AS first_order_date",
        "min(po_eta_date) AS first_eta",
    )


def risk_parts_feedback(outlook: DataFrame, cfg: PlanConfig) -> DataFrame:
    """Parts short on any day, by part number."""
    short = outlook.filter("shortage").select("part_no")
    return _top(short, [F.asc("part_no")], cfg.risk_limit).select("rank", "part_no")


def po_summary_feedback(outlook: DataFrame) -> DataFrame:
    return outlook.filter(HAS_ORDER_FEEDBACK).select("part_no", "total_recommended_qty", "first_order_date", "first_eta")


def po_table_feedback(po: DataFrame, cfg: PlanConfig) -> DataFrame:
    return _largest(po, cfg.table_limit).select(
        "rank", "part_no", "total_recommended_qty", _iso("first_order_date"), _iso("first_eta")
    )


# One-row figures. They are joined as scalar subqueries, never as cross joins.


def _row(df: DataFrame) -> Column:
    return df.select(F.struct("*")).scalar()


def outlook_counts(outlook: DataFrame) -> DataFrame:
    """One row: parts at risk, proposed quantity, parts that run out, parts with a proposal."""
    return _aggregate(
        outlook,
        f"count_if({AT_RISK}) AS risk_count",
        f"{truncated_sql('sum(total_recommended_qty)')} AS total_po_qty",
        "count_if(days_below_zero > 0) AS days_below_zero_parts",
        f"count_if({HAS_ORDER}) AS po_count",
    )


def outlook_counts_feedback(outlook: DataFrame) -> DataFrame:
    return _aggregate(
        outlook,
        "count_if(shortage) AS risk_count",
        f"{truncated_sql('sum(total_recommended_qty)')} AS total_po_qty",
        f"count_if({HAS_ORDER_FEEDBACK}) AS po_count",
    )


def need_totals(demand: DataFrame, cfg: PlanConfig) -> DataFrame:
    """One row: part quantity for the demand and for the planned output, over all parts."""

    def total(array: str, name: str) -> str:
        per_part = " + ".join(f"get({array}, {i})" for i in range(cfg.forecast_days))
        return f"coalesce(sum({per_part}), 0.0D) AS {name}"

    return _aggregate(
        demand, total("part_demand", "total_demand_part_qty"), total("output_need", "total_output_part_qty")
    )


def _sum(array: str) -> str:
    return f"aggregate({array}, 0L, (total, qty) -> total + qty)"


# Reported figures by name, over the counts with ``health``, ``days`` and ``need`` beside them.

KPIS = {
    "avg_health": half_even_sql("health.avg_health", 3),
    "min_health": half_even_sql("health.min_health", 3),
    "capacity_factor": half_even_sql("health.capacity_factor", 3),
    "total_forecast_demand": _sum("days.demand"),
    "total_expected_output": _sum("days.output"),
    "total_gap_qty": _sum("days.gap"),
    "risk_count": "risk_count",
    "total_po_qty": "total_po_qty",
    "days_below_zero_parts": "days_below_zero_parts",
}
KPIS_FEEDBACK = {
    "avg_health": half_even_sql("health.avg_health", 2),
    "capacity_factor": half_even_sql("health.capacity_factor", 2),
    "total_original_qty": _sum("days.demand"),
    "total_forecast_qty": _sum("days.output"),
    "risk_count": "risk_count",
    "total_po_qty": "total_po_qty",
}


def _totals(cfg: PlanConfig) -> dict[str, str]:
    return {
        "lookback_days": str(cfg.lookback_days),
        "forecast_days": str(cfg.forecast_days),
        "po_count": "po_count",
        "total_demand_part_qty": half_even_sql("need.total_demand_part_qty", 2),
        "total_output_part_qty": half_even_sql("need.total_output_part_qty", 2),
    }


def _totals_feedback(cfg: PlanConfig) -> dict[str, str]:
    return {"lookback_days": str(cfg.lookback_days), "forecast_days": str(cfg.forecast_days), "po_count": "po_count"}


def _columns(figures: dict[str, str]) -> list[str]:
    return [f"{sql} AS {name}" for name, sql in figures.items()]


def _struct(figures: dict[str, str]) -> str:
    return f"named_struct({', '.join(f"'{name}', {sql}" for name, sql in figures.items())})"


def _beside(counts: DataFrame, **rows: DataFrame) -> DataFrame:
    """Other one-row tables as struct columns beside the counts."""
    return counts.withColumns({name: _row(df) for name, df in rows.items()})


def kpis(factor: DataFrame, totals: DataFrame, counts: DataFrame) -> DataFrame:
    """One row of key figures from three one-row tables."""
    return _beside(counts, health=factor, days=totals).selectExpr(*_columns(KPIS))


def kpis_feedback(factor: DataFrame, totals: DataFrame, counts: DataFrame) -> DataFrame:
    return _beside(counts, health=factor, days=totals).selectExpr(*_columns(KPIS_FEEDBACK))


def plan_totals(need: DataFrame, counts: DataFrame, cfg: PlanConfig) -> DataFrame:
    """One row: parameters, number of proposals, part quantity for demand and for output."""
    return _beside(counts, need=need).selectExpr(*_columns(_totals(cfg)))


def plan_totals_feedback(counts: DataFrame, cfg: PlanConfig) -> DataFrame:
    return counts.selectExpr(*_columns(_totals_feedback(cfg)))


def _ranked_lists(
    outlook: DataFrame, at_risk: str, has_order: str, risk_order: list[str], entry: str, cfg: PlanConfig
) -> DataFrame:
    """One row with the risk list and the purchase list of a snapshot.

    Each list is the head of its own sort, so every task keeps only that many rows whatever the limits are.
    """
    risk = outlook.filter(at_risk).orderBy(*[F.expr(k) for k in risk_order], "part_no").limit(cfg.risk_limit)
    orders = outlook.filter(has_order).orderBy(F.expr("-total_recommended_qty"), "part_no")
    orders = orders.limit(max(cfg.table_limit, cfg.chart_limit))
    fields = ", ".join([*(f"'k{n}', {key}" for n, key in enumerate(risk_order)), "'part_no', part_no"])
    risk_list = _aggregate(risk, f"array_sort(collect_list(named_struct({fields}))).part_no AS risk_parts")
    po_row = f"named_struct('k', -total_recommended_qty, 'part_no', part_no, 'row', {entry})"
    return _beside(_aggregate(orders, f"array_sort(collect_list({po_row})).row AS po"), risk=risk_list).selectExpr(
        "risk.risk_parts AS risk_parts", "po"
    )


def _document(one: DataFrame, kpi: dict[str, str], summary: dict[str, str], series: str, cfg: PlanConfig) -> DataFrame:
    """Snapshot from one row of figures; the chart shows the head of the purchase table, with two digits."""
    dates = ", ".join(f"'{d.isoformat()}'" for d in cfg.forecast_dates)
    shown = f"slice(lists.po, 1, {cfg.chart_limit})"
    values = f"transform({shown}.total_recommended_qty, qty -> {half_even_sql('qty', 2)})"
    return one.selectExpr(
        f"'{cfg.as_of:%Y-%m-%d %H:%M:%S}' AS updated_at",
        f"{_struct(kpi)} AS kpi",
        "lists.risk_parts AS risk_parts",
        f"{_struct(summary)} AS summary",
        f"named_struct('compare', named_struct('x', array({dates}), {series}), 'po', "
        f"named_struct('labels', {shown}.part_no, 'values', {values})) AS charts",
        f"slice(lists.po, 1, {cfg.table_limit}) AS po_table",
    )


def snapshot(
    factor: DataFrame, totals: DataFrame, need: DataFrame, counts: DataFrame, outlook: DataFrame, cfg: PlanConfig
) -> DataFrame:
    """One document with everything of bounded size that a plan reports.

    The lists are limited by the configuration (top-k reports, forecast days). The machine
    series grows with the readings and is written as a table of its own beside it.
    """
    entry = {
        "part_no": "part_no",
        "total_recommended_qty": half_even_sql("total_recommended_qty", 2),
        "first_shortage_date": "date_format(first_shortage_date, 'yyyy-MM-dd')",
        "first_suggested_order_date": "date_format(first_suggested_order_date, 'yyyy-MM-dd')",
        "first_required_eta": "date_format(first_required_eta, 'yyyy-MM-dd')",
        "max_shortage_qty": half_even_sql("ordered_max_shortage_qty", 2),
        "days_below_safety": "days_below_safety",
        "days_below_zero": "days_below_zero",
        "min_available": half_even_sql("min_available", 2),
    }
    worst = ["-days_below_zero", "-days_below_safety", "-max_shortage_qty"]
    lists = _ranked_lists(outlook, AT_RISK, HAS_ORDER, worst, _struct(entry), cfg)
    one = _beside(counts, health=factor, days=totals, need=need, lists=lists)
    series = "'demand', days.demand, 'output', days.output, 'gap', days.gap"
    return _document(one, KPIS, _totals(cfg), series, cfg)


def snapshot_feedback(
    factor: DataFrame, totals: DataFrame, counts: DataFrame, outlook: DataFrame, cfg: PlanConfig
) -> DataFrame:
    entry = {
        "part_no": "part_no",
        "total_recommended_qty": "total_recommended_qty",
        "first_order_date": "date_format(first_order_date, 'yyyy-MM-dd')",
        "first_eta": "date_format(first_eta, 'yyyy-MM-dd')",
    }
    lists = _ranked_lists(outlook, "shortage", HAS_ORDER_FEEDBACK, [], _struct(entry), cfg)
    one = _beside(counts, health=factor, days=totals, lists=lists)
    series = "'original', days.demand, 'adjusted', days.output"
    return _document(one, KPIS_FEEDBACK, _totals_feedback(cfg), series, cfg)
