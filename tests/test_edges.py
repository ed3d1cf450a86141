"""Semantics that are easy to get wrong."""

from dataclasses import replace
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from seed import AS_OF, CFG, day, seed, sources, table

from plantcast import BackwardPlan, ForwardPlan
from plantcast.functions.days import weekday_counts
from plantcast.functions.health import penalty
from plantcast.functions.values import half_even, leading_integer, number, whole_sql
from plantcast.operators import checks, demand, materials, telemetry
from plantcast.sources.legacy import adapt_tables


def at(offset: int, hour: int = 9) -> datetime:
    return datetime.combine(day(offset), datetime.min.time()) + timedelta(hours=hour)


def values(df, column):
    return [r[column] for r in df.collect()]


def test_rounding_is_half_even(spark):
    df = spark.createDataFrame([(v,) for v in (0.5, 1.5, 2.5, 3.5, 7.5, -0.5, -1.5)], "v double")
    assert values(df.select(F.expr(whole_sql("v")).alias("v")), "v") == [0, 2, 2, 4, 8, 0, -2]
    assert values(df.select(half_even("2.675D", 2).alias("v")), "v")[0] == 2.68


def test_product_codes(spark):
    codes = ["1001", " 1001 ", "12ab", "ab", "", None, "-5", "99999999999999999999"]
    df = spark.createDataFrame([(c,) for c in codes], "c string").select(leading_integer("c").alias("v"))
    assert values(df, "v") == [1001, 1001, 12, 0, 0, None, 0, None]


def test_coercion(spark):
    df = spark.createDataFrame([("1.5",), ("n/a",), ("NaN",), (None,)], "c string").select(number("c").alias("v"))
    assert values(df, "v") == [1.5, None, None, None]


@pytest.mark.parametrize("days", [1, 5, 7, 30, 31, 365])
def test_weekday_counts(days):
    start = CFG.history_start
    expected = [0] * 7
    for i in range(days):
        expected[(start + timedelta(days=i)).weekday()] += 1
    assert weekday_counts(start, days) == expected


def test_history_window_is_asymmetric(spark):
    src = sources(
        spark,
        orders=[
            (1, at(-30, 9), "completed"),  # an hour before the cutoff's time of day
            (2, at(-30, 10), "completed"),
            (3, at(0), "completed"),
            (4, at(3), "completed"),
            (5, at(-1), "Cancelled"),
            (6, at(-1), "cancelled"),
            (7, at(-1), None),
        ],
        order_items=[(1, 10, 1), (2, 10, 2), (3, 11, 4), (4, 12, 8), (5, 13, 16), (6, 14, 32), (7, 15, 64), (9, 16, 1)],
    )
    plan = BackwardPlan(src, CFG)
    assert {(r.order_date, r.product_id, r.qty) for r in plan.order_history.collect()} == {
        (day(-30), 10, 2), (day(0), 11, 4), (day(3), 12, 8), (day(-1), 13, 16),
    }
    full = plan.complete_history.collect()
    assert len(full) == 4 * 30
    assert sum(r.qty for r in full) == 18
    assert {r.forecast_demand_qty for r in plan.forecast.filter("product_id IN (11, 12)").collect()} == {0}
    assert values(demand.history_today(plan.order_history, CFG), "product_id") == [11]
    # The sparse history does see today and later days.
    sparse = ForwardPlan(src, CFG).forecast.filter("product_id = 12 AND forecast_date = date'2024-02-03'").first()
    assert sparse.weekday_mean_qty == 8 and sparse.dow == 5


def test_null_quantity_is_no_order(spark):
    src = sources(
        spark,
        orders=[(1, at(-1), "completed"), (2, at(-2), "completed")],
        order_items=[(1, 10, None), (2, 10, 3), (1, 11, None), (1, None, 5)],
    )
    plan = BackwardPlan(src, CFG)
    assert [tuple(r) for r in plan.order_history.collect()] == [(day(-2), 10, 3)]
    assert values(plan.profile, "product_id") == [10]


@pytest.mark.parametrize("lookback", [1, 5, 7, 30])
def test_profile_equals_means_over_the_grid(spark, lookback):
    cfg = replace(CFG, lookback_days=lookback)
    src = seed(spark)
    plan = BackwardPlan(src, cfg)
    grid = plan.complete_history.cache()
    weekday = {(r.product_id, r.dow): r.m for r in grid.groupBy("product_id", "dow").agg(F.avg("qty").alias("m")).collect()}
    overall = {r.product_id: r.m for r in grid.groupBy("product_id").agg(F.avg("qty").alias("m")).collect()}
    got = {(r.product_id, r.dow): r.weekday_mean_qty for r in demand.weekday_mean(plan.profile).collect()}
    assert got == pytest.approx(weekday)
    assert {r.product_id: r.overall_mean_qty for r in demand.overall_mean(plan.profile).collect()} == pytest.approx(overall)
    # The daily history gives the same profile as the lines.
    assert sorted(demand.demand_profile(plan.order_history, cfg).collect()) == sorted(plan.profile.collect())
    # Weekdays outside a short look-back fall back to the overall mean.
    for r in plan.forecast.collect():
        if r.weekday_mean_qty is None:
            assert r.forecast_demand_qty == round(r.overall_mean_qty)
    grid.unpersist()


def test_no_telemetry_means_full_capacity(spark):
    src = seed(spark).replaced(machine_data=table(spark, "machine_data", []))
    plan = BackwardPlan(src, CFG)
    assert tuple(plan.capacity_factor.first()) == (1.0, 1.0, 1.0)
    assert plan.machine_series.count() == 0
    row = plan.kpis.first()
    assert (row.total_forecast_demand, row.total_expected_output, row.total_gap_qty) == (69, 69, 0)
    assert tuple(ForwardPlan(src, CFG).capacity_factor.first()) == (1.0, 1.0)


def test_missing_sensor_values_are_harmless(spark):
    nan = float("nan")
    rows = [("M-1", None, None, None, at(0)), ("M-2", nan, nan, nan, at(0)), (None, 99.0, 1.0, 1.0, at(0))]
    readings = table(spark, "machine_data", rows)
    scored = telemetry.reading_health(readings, CFG)
    assert {r.machine_id: r.health_score for r in scored.collect()} == {"M-1": 1.0, "M-2": 1.0, None: pytest.approx(0.0)}
    assert sorted(values(telemetry.machine_health(scored), "machine_id")) == ["M-1", "M-2"]
    steps = telemetry.reading_health_step(readings, CFG)
    assert [r.health_score for r in steps.collect()] == [1.0, 1.0, 0.5]


def test_reading_window_edges(spark):
    rows = [("M-1", 70.0, 0.01, 1500.0, AS_OF - timedelta(hours=24, seconds=s)) for s in (-1, 0, 1)]
    readings = table(spark, "machine_data", rows)
    assert telemetry.recent_readings(readings, CFG).count() == 2
    rows = [("M-1", 70.0, 0.01, 1500.0, AS_OF - timedelta(minutes=m)) for m in (29, 30, 31)]
    assert telemetry.retain_recent(table(spark, "machine_data", rows), CFG).count() == 2


def test_latest_readings_are_global(spark):
    rows = [(f"M-{i % 3}", 70.0, 0.01, 1500.0, AS_OF - timedelta(days=i)) for i in range(80)]
    latest = telemetry.latest_readings(table(spark, "machine_data", rows), CFG)
    assert min(values(latest, "created_at")) == AS_OF - timedelta(days=49)
    series = telemetry.latest_series(latest)
    assert values(series, "x") == sorted(values(series, "x"))
    assert series.count() == 50


def test_penalty_range(spark):
    df = spark.createDataFrame([(70.0,), (75.0,), (85.0,), (95.0,), (120.0,)], "t double")
    assert values(df.select(F.expr(penalty("t", 75.0, 95.0)).alias("p")), "p") == [0.0, 0.0, 0.5, 1.0, 1.0]
    assert set(values(df.select(F.expr(penalty("t", 95.0, 75.0)).alias("p")), "p")) == {0.0}


def test_health_stays_in_range_and_falls_with_heat(spark):
    grid = spark.range(60, 131).crossJoin(spark.range(0, 20)).toDF("t", "v")
    readings = grid.select(
        F.concat_ws("-", "t", "v").alias("machine_id"),
        F.col("t").cast("double").alias("temperature"),
        (F.col("v") / 100.0).alias("vibration"),
        F.lit(1700).alias("rpm"),
        F.lit("2024-01-31 09:00:00").cast("timestamp_ntz").alias("created_at"),
    )
    score = {(r.vibration, r.temperature): r.health_score for r in telemetry.reading_health(readings, CFG).collect()}
    assert all(0.0 <= s <= 1.0 for s in score.values())
    assert all(score[v, t] >= score[v, t + 1] for v, t in score if (v, t + 1) in score)


def test_purchases_outside_the_horizon_and_status_case(spark):
    rows = [
        ("P", day(0), 1, "pending"), ("P", day(-3), 2, "pending"), ("P", day(8), 4, "pending"),
        ("P", day(7), 8, "PENDING"), ("P", day(7), 16, "Pending"), ("P", day(1), 32, "received"),
        ("P", None, 64, "pending"), ("Q", day(2), 128, "pending"),
    ]
    src = sources(spark, parts=[("P", 0, 0)], purchase=rows)
    plan = BackwardPlan(src, CFG)
    assert {(r.part_no, r.eta_date): r.incoming_qty for r in plan.incoming_by_day.collect()} == {
        ("P", day(0)): 1, ("P", day(-3)): 2, ("P", day(8)): 4, ("P", day(7)): 24, ("Q", day(2)): 128,
    }
    rows = sorted(plan.mrp_plan.collect())
    assert [r.incoming_qty for r in rows] == [0, 0, 0, 0, 0, 0, 24]
    assert {r.part_no for r in rows} == {"P"}
    # With no demand the stock stays at zero: no shortage, and no negative zero either.
    assert str(rows[0].shortage_qty) == "0.0" and not rows[0].below_safety


def bom_sources(spark):
    return sources(
        spark,
        orders=[(i, at(-i), "completed") for i in range(1, 29)],
        order_items=[(i, p, 5) for i in range(1, 29) for p in (1, 2, 3)],
        bom_header=[(1, "1"), (2, "2"), (4, "4")],
        bom_detail=[(1, "A", 2), (1, "A", 2), (1, "X", 1), (4, "A", 9), (2, None, 3), (1, "B", None)],
        parts=[("A", 100, 0), ("B", 5, 6), (None, 1, 1)],
    )


def test_bom_oddities(spark):
    plan = BackwardPlan(bom_sources(spark), CFG)
    need = {(r.part_no, r.forecast_date): r.part_demand for r in plan.daily_part_demand.collect()}
    # Duplicate lines add up; product 3 has no bill, product 4 no orders, a null part no demand.
    assert set(p for p, _ in need) == {"A", "X", "B"}
    assert need["A", day(1)] == 4 * plan.forecast.filter("product_id = 1").orderBy("forecast_date").first().forecast_demand_qty
    assert need["B", day(1)] == 0
    # X is not stocked: it is left out of the projection but counts in the totals.
    assert {r.part_no for r in plan.mrp_plan.collect()} == {"A", "B"}
    total = plan.plan_totals.first().total_demand_part_qty
    assert total == sum(need.values())
    assert sum(v for (p, _), v in need.items() if p == "X") > 0


def test_explosion_matches_arrays(spark):
    plan = BackwardPlan(bom_sources(spark), CFG)
    long = (
        plan.bom_explosion.filter("part_no IS NOT NULL")
        .groupBy("forecast_date", "part_no")
        .agg(
            F.sum("part_demand_for_customer_demand").alias("part_demand"),
            F.sum("part_demand_for_planned_output").alias("planned_output_part_demand"),
        )
    )
    assert sorted(long.collect()) == sorted(plan.daily_part_demand.collect())


def test_negative_demand_gives_no_gap(spark):
    src = sources(
        spark,
        orders=[(1, at(-7), "completed")],
        order_items=[(1, 1, -40)],
        machine_data=[("M", 95.0, 0.12, 1500.0, AS_OF)],
    )
    rows = BackwardPlan(src, CFG).capacity_plan.collect()
    assert min(r.forecast_demand_qty for r in rows) < 0
    assert all(r.gap_qty == max(0, r.forecast_demand_qty - r.expected_output_qty) for r in rows)


def test_input_checks(spark):
    empty = BackwardPlan(sources(spark), CFG)
    rows = {r.check_name: r for r in empty.input_checks.collect()}
    assert not rows["parts"].passed and not rows["order_history"].passed
    with pytest.raises(checks.MissingInput):
        checks.require_inputs(empty.input_checks)
    checks.require_inputs(BackwardPlan(seed(spark), CFG).input_checks)
    # The feedback variant does not check the parts.
    assert ForwardPlan(sources(spark), CFG).input_checks.count() == 1


def test_empty_inputs_give_zero_figures(spark):
    plan = BackwardPlan(sources(spark), CFG)
    assert tuple(plan.kpis.first()) == (1.0, 1.0, 1.0, 0, 0, 0, 0, 0, 0)
    assert tuple(plan.plan_totals.first()) == (30, 7, 0, 0.0, 0.0)
    doc = plan.snapshot.first()
    assert doc.risk_parts == [] and doc.po_table == []


def test_empty_purchases(spark):
    src = seed(spark).replaced(purchase=table(spark, "purchase", []))
    assert {r.incoming_qty for r in BackwardPlan(src, CFG).mrp_plan.collect()} == {0.0}


def test_labels(spark):
    plan = ForwardPlan(seed(spark), CFG)
    assert plan.labelled_plan("en").columns[:3] == ["Date", "Part No", "Demand"]
    assert "當日建議下單量" in plan.labelled_plan("zh").columns
    with pytest.raises(KeyError):
        plan.labelled_plan("fr")


def test_older_table_names(spark):
    src = seed(spark)
    old = {
        "bom主檔": src.bom_header.withColumnRenamed("product_code", "英文編碼"),
        "bom明細": src.bom_detail.withColumnsRenamed({"part_no": "圖號", "qty": "需求數量"}),
        "零件": src.parts.withColumnsRenamed({"part_no": "圖號", "stock_qty": "數量", "safety_stock": "安全量"}),
        "purchase": src.purchase.withColumnsRenamed(
            {"part_no": "圖號", "delivery_date": "交貨日期", "order_qty": "叫貨數量", "status": "到貨狀態"}
        ).withColumn("到貨狀態", F.when(F.col("到貨狀態") == "pending", "未到貨").otherwise("已到貨")),
    }
    adapted = src.replaced(**adapt_tables(old))
    assert sorted(ForwardPlan(adapted, CFG).po_summary.collect()) == sorted(ForwardPlan(src, CFG).po_summary.collect())


def test_risk_list_limit_and_ties(spark):
    parts = [(f"P{i:02d}", 0, 1) for i in range(30)]
    plan = BackwardPlan(sources(spark, parts=parts), CFG)
    rows = sorted(plan.risk_parts.collect())
    assert [r.part_no for r in rows] == [f"P{i:02d}" for i in range(20)]
    assert [r.rank for r in rows] == list(range(1, 21))
    assert plan.kpis.first().risk_count == 30
    assert plan.po_chart.count() == 10 and plan.po_table.count() == 15
