"""Daily sums of order lines: equal to the lines after every kind of load, and only touched days written."""

import os

import pytest
from seed import CFG, seed

from plantcast import BackwardPlan, ForwardPlan
from plantcast.operators import demand
from plantcast.sources.daily import DailyDemand
from plantcast.sources.orders import OrderStore


@pytest.fixture
def daily(spark, tmp_path):
    store = OrderStore(spark, str(tmp_path / "orders"), buckets=3)
    yield DailyDemand(spark, str(tmp_path / "demand"), store)
    store.close()


def sources_of(src, daily):
    return src.replaced(orders=daily.store.orders, order_items=daily.store.order_items, daily_demand=daily.read())


def history_of(src, daily):
    return sorted(BackwardPlan(sources_of(src, daily), CFG).order_history.collect())


def expected(orders, items):
    return sorted(demand.order_history(demand.order_lines(orders, items, CFG)).collect())


def files_of(daily):
    return {os.path.join(d, f) for d, _, names in os.walk(daily.path) for f in names if f.endswith(".parquet")}


def test_every_kind_of_load(spark, daily):
    src = seed(spark)
    even, odd = src.order_items.filter("quantity % 2 = 0"), src.order_items.filter("quantity % 2 <> 0")
    none = src.orders.limit(0)
    daily.append(src.orders, even, load=0)
    assert history_of(src, daily) == expected(src.orders, even)
    for _ in range(2):  # late lines, delivered twice
        daily.append(none, odd, load=1)
        assert history_of(src, daily) == expected(src.orders, src.order_items)
    daily.append(none, odd.limit(0), load=1)  # written again with less
    assert history_of(src, daily) == expected(src.orders, even)
    cancelled = src.orders.selectExpr("id", "created_at", "'cancelled' AS status")  # days without any line are left
    daily.append(cancelled, odd.limit(0), load=2)
    assert history_of(src, daily) == [] and daily.read().count() == 0
    daily.append(src.orders, odd, load=3)
    assert history_of(src, daily) == expected(src.orders, src.order_items)
    stored = sources_of(src, daily)
    for plan in (BackwardPlan, ForwardPlan):
        assert sorted(plan(stored, CFG).po_summary.collect()) == sorted(plan(src, CFG).po_summary.collect())


def test_only_touched_days_are_written(spark, daily):
    src = seed(spark)
    daily.append(src.orders, src.order_items, load=0)
    before = files_of(daily)
    order = src.orders.filter("status <> 'cancelled'").orderBy("id").first()
    late = spark.createDataFrame([(order.id, 1, 5)], "order_id int, product_id int, quantity int")
    daily.append(src.orders.limit(0), late, load=1)
    changed = {os.path.basename(os.path.dirname(f)) for f in before ^ files_of(daily)}
    assert changed == {f"order_date={order.created_at.date()}"}
    assert history_of(src, daily) == expected(src.orders, src.order_items.unionByName(late))


def test_a_load_that_broke_off(spark, daily, monkeypatch):
    src = seed(spark)
    daily.append(src.orders, src.order_items, load=0)
    with monkeypatch.context() as broken:
        broken.setattr(daily, "_sum_days", lambda days: 1 / 0)
        with pytest.raises(ZeroDivisionError):  # stored with less, but not summed
            daily.append(src.orders, src.order_items.filter("quantity % 2 = 0"), load=0)
    daily.append(src.orders, src.order_items.limit(0), load=0)
    assert history_of(src, daily) == []


def test_lines_before_their_order_and_empty_store(spark, daily):
    src = seed(spark)
    assert history_of(src, daily) == []
    early, late = src.orders.filter("id <= 12"), src.orders.filter("id > 12")
    daily.append(early, src.order_items, load=0)
    assert history_of(src, daily) == expected(early, src.order_items)
    daily.append(late, src.order_items.limit(0), load=1)
    assert history_of(src, daily) == expected(src.orders, src.order_items)


def test_a_plan_opens_lines_of_its_first_day_only(spark, daily):
    src = seed(spark)
    daily.append(src.orders, src.order_items, load=0)
    plan = BackwardPlan(sources_of(src, daily), CFG).order_history._jdf.queryExecution().executedPlan().toString()
    month = CFG.history_start.replace(day=1)
    scans = [line for line in plan.splitlines() if "FileScan parquet" in line and "order_month" in line]
    assert len(scans) == 2 and all("order_month#" in s and str((month - month.replace(1970, 1, 1)).days) in s or str(month) in s for s in scans)
    assert any("FileScan parquet" in line and "order_date" in line and "PartitionFilters: [isnotnull(order_date" in line for line in plan.splitlines())
