"""Projection and feedback against plain loops."""

import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F
from seed import CFG

from plantcast.operators import inventory

DAYS = "part_no string, stock_qty double, safety_qty double, part_demand array<double>, output_need array<double>, incoming array<double>"


def make_days(spark, horizon, parts=150, seed=7):
    rng = random.Random(seed + horizon)
    rows = []
    for i in range(parts):
        numbers = [[float(rng.choice([0, 0, rng.randint(0, 30)])) for _ in range(horizon)] for _ in range(3)]
        rows.append((f"P{i}", float(rng.randint(0, 60)), float(rng.randint(-5, 25)), *numbers))
    return rows, spark.createDataFrame(rows, DAYS)


def loop(row, lead, feedback):
    _, stock, safety, need, _, incoming = row
    arrivals, out = {}, []
    for t in range(len(need)):
        arrival = arrivals.get(t, 0.0) if feedback else 0.0
        stock = stock + incoming[t] + arrival - need[t]
        order = max(0.0, safety - stock)
        if order > 0 and feedback:
            arrivals[t + lead] = arrivals.get(t + lead, 0.0) + order
        out.append((arrival, stock, order))
    return out


def collected(df, *columns):
    found = {}
    for r in sorted(df.collect(), key=lambda r: r.forecast_date):
        found.setdefault(r.part_no, []).append(tuple(r[c] for c in columns))
    return found


@pytest.mark.parametrize("horizon", [1, 7, 20])
def test_projection_equals_loop(spark, horizon):
    cfg = replace(CFG, forecast_days=horizon)
    rows, days = make_days(spark, horizon)
    plan = inventory.mrp_plan(inventory.inventory_projection(inventory.sim_grid(days, cfg)), cfg)
    got = collected(plan, "end_available", "recommended_po_qty")
    assert got == {row[0]: [v[1:] for v in loop(row, cfg.lead_time_days, False)] for row in rows}
    for r in plan.collect():
        assert r.start_available == r.end_available + r.part_demand
        assert r.below_safety == (r.end_available < r.safety_qty)
        assert (r.suggested_order_date is None) == (r.recommended_po_qty == 0)


@pytest.mark.parametrize("lead", range(6))
def test_feedback_equals_loop(spark, lead):
    cfg = replace(CFG, lead_time_days=lead)
    rows, days = make_days(spark, cfg.forecast_days)
    got = collected(inventory.mrp_feedback(days, cfg), "po_arrival_qty_today", "end_available", "recommended_po_qty")
    # With lead 0 the order is registered after the day's stock, so it never lands.
    assert got == {row[0]: loop(row, lead or 999, True) for row in rows}


def test_feedback_by_hand(spark):
    cfg = replace(CFG, forecast_days=6)
    zero = [0.0] * 6
    days = spark.createDataFrame(
        [("P", 10.0, 5.0, [8.0, 2.0, 0.0, 0.0, 1.0, 0.0], zero, [0.0, 0.0, 1.0, 0.0, 0.0, 0.0])], DAYS
    )
    rows = sorted(inventory.mrp_feedback(days, cfg).collect())
    assert [r.end_available for r in rows] == [2, 0, 1, 4, 8, 12]
    assert [r.recommended_po_qty for r in rows] == [3, 5, 4, 1, 0, 0]
    assert [(r.po_eta_date - r.forecast_date).days for r in rows if r.po_eta_date] == [3, 3, 3, 3]


def test_parts_without_any_movement_stay(spark):
    parts = spark.createDataFrame([("A", 4.0, 1.0)], "part_no string, stock_qty double, safety_qty double")
    demand = spark.createDataFrame([], "part_no string, part_demand array<double>, output_need array<double>")
    incoming = spark.createDataFrame([], "part_no string, incoming array<double>")
    grid = inventory.sim_grid(inventory.stock_days(parts, demand, incoming, CFG), CFG)
    assert grid.count() == CFG.forecast_days
    assert grid.agg(F.sum("part_demand"), F.sum("incoming_qty")).first() == (0.0, 0.0)
