"""Both variants on the seed data, against values worked out beside Spark."""

from datetime import date

import pytest
from seed import CFG, day, seed

from plantcast import BackwardPlan, ForwardPlan


@pytest.fixture(scope="module")
def backward(spark):
    return BackwardPlan(seed(spark), CFG)


@pytest.fixture(scope="module")
def forward(spark):
    return ForwardPlan(seed(spark), CFG)


def by_part(plan, column):
    found = {}
    for row in sorted(plan.collect(), key=lambda r: (r.part_no, r.forecast_date)):
        found.setdefault(row.part_no[-1], []).append(row[column])
    return found


def test_order_history(backward):
    rows = backward.order_history.collect()
    assert len(rows) == 56
    assert sum(r.qty for r in rows) == 300
    assert sum(r.order_date == CFG.today for r in rows) == 2


def test_machine_health_and_factor(backward):
    health = {r.machine_id: r.machine_health for r in backward.machine_health.collect()}
    assert health == pytest.approx({"M-01": 0.8547535714, "M-02": 0.8044821429})
    row = backward.capacity_factor.first()
    assert tuple(row) == pytest.approx((0.8296178571, 0.8044821429, 0.8220771429))


def test_forecast_rounds_ties_to_even(backward):
    rows = {(r.forecast_date.day, r.product_id): r for r in backward.forecast.collect()}
    means = {d: (rows[d, 1001].weekday_mean_qty, rows[d, 1002].weekday_mean_qty) for d in range(1, 8)}
    assert means == {
        1: (7.5, 4.75), 2: (7.5, 5.0), 3: (3.5, 2.5), 4: (3.5, 2.5), 5: (4.6, 3.2), 6: (6.2, 4.0), 7: (7.5, 5.25),
    }
    assert [rows[d, 1001].forecast_demand_qty for d in range(1, 8)] == [8, 8, 4, 4, 5, 6, 8]
    assert [rows[d, 1002].forecast_demand_qty for d in range(1, 8)] == [5, 5, 2, 2, 3, 4, 5]


def test_demand_compare(backward):
    rows = sorted(backward.demand_compare.collect())
    assert [r.forecast_date for r in rows] == [day(i) for i in range(1, 8)]
    assert [r.forecast_demand_qty for r in rows] == [13, 13, 6, 6, 8, 10, 13]
    assert [r.expected_output_qty for r in rows] == [11, 11, 5, 5, 6, 8, 11]
    assert [r.gap_qty for r in rows] == [2, 2, 1, 1, 2, 2, 2]


def test_plan_by_part(backward):
    plan = backward.mrp_plan
    assert by_part(plan, "part_demand") == {
        "A": [16, 16, 8, 8, 10, 12, 16],
        "B": [18, 18, 8, 8, 11, 14, 18],
        "C": [8, 8, 4, 4, 5, 6, 8],
        "D": [15, 15, 6, 6, 9, 12, 15],
        "E": [5, 5, 2, 2, 3, 4, 5],
    }
    assert by_part(plan, "end_available") == {
        "A": [2, -6, -14, -22, -32, -44, -60],
        "B": [2, -16, -24, -32, -43, -57, -75],
        "C": [2, -6, -10, -14, -19, -25, -33],
        "D": [-6, -21, -27, -23, -32, -44, -59],
        "E": [0, -5, -3, -5, -8, -12, -17],
    }
    assert by_part(plan, "recommended_po_qty") == {
        "A": [13, 21, 29, 37, 47, 59, 75],
        "B": [16, 34, 42, 50, 61, 75, 93],
        "C": [6, 14, 18, 22, 27, 33, 41],
        "D": [22, 37, 43, 39, 48, 60, 75],
        "E": [10, 15, 13, 15, 18, 22, 27],
    }
    start = by_part(plan, "start_available")
    assert start["A"][:3] == [18, 10, -6]


def test_summaries(backward):
    risk = {r.part_no[-1]: r for r in backward.part_risk_summary.collect()}
    assert {p: (r.days_below_safety, r.days_below_zero) for p, r in risk.items()} == {
        "A": (7, 6), "B": (7, 6), "C": (7, 6), "D": (7, 7), "E": (7, 6),
    }
    assert {p: r.max_shortage_qty for p, r in risk.items()} == {"A": 60, "B": 75, "C": 33, "D": 59, "E": 17}
    assert [r.part_no[-1] for r in sorted(backward.risk_parts.collect())] == list("DBACE")
    po = {r.part_no[-1]: r for r in backward.po_summary.collect()}
    assert {p: r.total_recommended_qty for p, r in po.items()} == {"A": 281, "B": 371, "C": 161, "D": 324, "E": 120}
    for r in po.values():
        assert (r.first_shortage_date, r.first_suggested_order_date, r.first_required_eta) == (
            date(2024, 2, 1), date(2024, 1, 29), date(2024, 2, 1),
        )
    assert [r.label[-1] for r in sorted(backward.po_chart.collect())] == list("BDACE")
    table = sorted(backward.po_table.collect())
    assert table[0].first_suggested_order_date == "2024-01-29"
    assert (table[0].min_available, table[0].days_below_zero) == (-75, 6)


def test_kpis_and_totals(backward):
    assert tuple(backward.kpis.first()) == (0.83, 0.804, 0.822, 69, 57, 12, 5, 1257, 5)
    assert tuple(backward.plan_totals.first()) == (30, 7, 5, 328.0, 270.0)


def test_snapshot_document(backward):
    doc = backward.snapshot.first().asDict(recursive=True)
    assert doc["updated_at"] == "2024-01-31 10:00:00"
    assert doc["kpi"]["total_po_qty"] == 1257
    assert [p[-1] for p in doc["risk_parts"]] == list("DBACE")
    assert doc["charts"]["compare"]["gap"] == [2, 2, 1, 1, 2, 2, 2]
    assert doc["charts"]["compare"]["x"][0] == "2024-02-01"
    assert doc["charts"]["po"]["values"] == [371, 324, 281, 161, 120]
    assert doc["summary"]["po_count"] == len(doc["po_table"]) == 5
    table = [r.asDict() for r in sorted(backward.po_table.drop("rank").collect(), key=lambda r: -r.total_recommended_qty)]
    assert doc["po_table"] == table


def test_series_is_ordered_and_rounded(backward):
    rows = backward.machine_series.collect()
    assert [r.machine_id for r in rows] == ["M-01"] * 10 + ["M-02"] * 10
    assert [r.x for r in rows[:2]] == ["2024-01-31 09:42:00", "2024-01-31 09:44:00"]
    assert rows[1].vibration == 0.0305


def test_feedback_forecast(forward):
    assert tuple(forward.capacity_factor.first()) == pytest.approx((0.89, 0.89))
    rows = {(r.forecast_date.day, r.product_id): r.weekday_mean_qty for r in forward.forecast.collect()}
    assert [rows[d, 1001] for d in (5, 6, 7)] == pytest.approx([23 / 3, 7.75, 7.6])
    assert [rows[d, 1002] for d in (5, 6, 7)] == pytest.approx([16 / 3, 5.0, 5.0])
    assert tuple(forward.kpis.first()) == (0.89, 0.89, 77, 67, 5, 425)


def test_feedback_plan(forward):
    plan = forward.mrp_plan
    assert by_part(plan, "part_demand")["B"] == [15, 15, 8, 8, 15, 15, 15]
    assert by_part(plan, "end_available") == {
        "A": [4, -2, -10, -7, -4, 7, 15],
        "B": [5, -10, -18, -13, 0, 21, 37],
        "C": [3, -4, -8, -7, -2, 7, 15],
        "D": [-3, -15, -21, 2, 21, 46, 48],
        "E": [1, -3, -1, 6, 15, 22, 22],
    }
    assert by_part(plan, "recommended_po_qty") == {
        "A": [11, 17, 25, 22, 19, 8, 0],
        "B": [13, 28, 36, 31, 18, 0, 0],
        "C": [5, 12, 16, 15, 10, 1, 0],
        "D": [19, 31, 37, 14, 0, 0, 0],
        "E": [9, 13, 11, 4, 0, 0, 0],
    }
    po = {r.part_no[-1]: r for r in forward.po_summary.collect()}
    assert {p: r.total_recommended_qty for p, r in po.items()} == {"A": 102, "B": 126, "C": 59, "D": 101, "E": 37}
    assert {(r.first_order_date, r.first_eta) for r in po.values()} == {(date(2024, 2, 1), date(2024, 2, 4))}
    assert [r.label[-1] for r in sorted(forward.po_chart.collect())] == list("BADCE")
    assert [r.part_no[-1] for r in sorted(forward.risk_parts.collect())] == list("ABCDE")


def test_staged_plan_gives_the_same(spark, backward, tmp_path):
    plan = BackwardPlan(seed(spark), CFG)
    plan.stage(str(tmp_path))
    assert plan.kpis.first() == backward.kpis.first()
    assert sorted(plan.po_summary.collect()) == sorted(backward.po_summary.collect())
