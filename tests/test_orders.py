"""Orders and lines in buckets: no shuffle below the join, nothing lost, nothing twice."""

import pytest
from seed import CFG, seed

import __spark_entry__
from plantcast import BackwardPlan
from plantcast.operators import demand
from plantcast.sources import orders
from plantcast.sources.layout import write_items_by_day
from plantcast.sources.orders import OrderStore


@pytest.fixture
def store(spark, tmp_path):
    opened = OrderStore(spark, str(tmp_path), buckets=3)
    yield opened
    opened.close()


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def lines_of(store):
    return sorted(demand.order_lines(store.orders, store.order_items, CFG).collect())


def test_join_has_no_exchange_and_opens_the_window(spark, store, settings):
    settings(spark__sql__autoBroadcastJoinThreshold="-1")
    src = seed(spark)
    store.append(src.orders, src.order_items, load=0)
    lines = demand.order_lines(store.orders, store.order_items, CFG)
    text = plan_of(lines)
    assert "SortMergeJoin" in text and "Exchange" not in text
    assert text.count("Bucketed: true") == 2 and text.count("PartitionFilters: [") == 2 and "PartitionFilters: []" not in text
    assert sorted(lines.collect()) == sorted(demand.order_lines(src.orders, src.order_items, CFG).collect())
    stored = src.replaced(orders=store.orders, order_items=store.order_items)
    assert sorted(BackwardPlan(stored, CFG).po_summary.collect()) == sorted(BackwardPlan(src, CFG).po_summary.collect())
    # the same layout without buckets shuffles both sides
    assert plan_of(demand.order_lines(src.orders, src.order_items, CFG)).count("Exchange hashpartitioning") == 2


def test_late_lines_and_repeated_loads(spark, store):
    src = seed(spark)
    want = sorted(demand.order_lines(src.orders, src.order_items, CFG).collect())
    even, odd = src.order_items.filter("quantity % 2 = 0"), src.order_items.filter("quantity % 2 <> 0")
    store.append(src.orders, even, load=0)
    store.append(src.orders.limit(0), odd, load=1)
    assert lines_of(store) == want
    store.append(src.orders.limit(0), odd, load=1)
    assert lines_of(store) == want
    store.append(src.orders.limit(0), odd.limit(0), load=1)  # a load written again may hold less
    assert len(lines_of(store)) == demand.order_lines(src.orders, even, CFG).count()


def test_lines_before_their_order(spark, store):
    src = seed(spark)
    early, late = src.orders.filter("id <= 12"), src.orders.filter("id > 12")
    store.append(early, src.order_items, load=0)
    assert len(lines_of(store)) == demand.order_lines(early, src.order_items, CFG).count()
    store.append(late, src.order_items.limit(0), load=1)
    assert lines_of(store) == sorted(demand.order_lines(src.orders, src.order_items, CFG).collect())


def test_order_of_a_later_load_counts(spark, store):
    src = seed(spark)
    store.append(src.orders, src.order_items, load=0)
    cancelled = src.orders.filter("id = 3").selectExpr("id", "created_at", "'cancelled' AS status")
    store.append(cancelled, src.order_items.limit(0), load=1)
    changed = src.orders.filter("id <> 3").unionByName(cancelled)
    assert lines_of(store) == sorted(demand.order_lines(changed, src.order_items, CFG).collect())
    assert store.orders.count() == src.orders.count()


def test_store_opened_again(spark, store):
    src = seed(spark)
    store.append(src.orders, src.order_items, load=0)
    again = OrderStore(spark, store.root, buckets=3)
    assert lines_of(again) == lines_of(store)
    again.close()


def test_empty_store(store):
    assert lines_of(store) == [] and store.orders.count() == 0


def test_second_write_of_a_day_keeps_the_first(spark, tmp_path):
    """Lines stored by day only: a late line joins those of its day, a repeated load replaces itself."""
    src = seed(spark)
    path = str(tmp_path / "items")
    first, second = src.order_items.filter("id % 2 = 0"), src.order_items.filter("id % 2 <> 0")
    for load, part in ((0, first), (1, second), (1, second)):
        write_items_by_day(src.orders.filter("id <> 5"), part, path, load)
    stored = spark.read.parquet(path)
    assert stored.count() == src.order_items.count()
    lines = demand.order_lines(src.orders, stored, CFG)  # the order of the null day has come since
    assert sorted(lines.collect()) == sorted(demand.order_lines(src.orders, src.order_items, CFG).collect())
    assert "PartitionFilters: [" in plan_of(lines) and "PartitionFilters: []" not in plan_of(lines).split("FileScan parquet")[1][:900]


def test_buckets_grow_with_the_lines(spark, monkeypatch):
    """The registered query sizes its store by its lines, so that no task's share of them grows."""
    assert [orders.buckets_for(n) for n in (0, 600_000, 8_000_000, 8_000_001, 216_000_000)] == [4, 4, 4, 5, 108]
    monkeypatch.setattr(orders, "BUCKET_LINES", 500)
    made = []
    monkeypatch.setattr(__spark_entry__, "OrderStore", lambda *args, buckets: made.append(OrderStore(*args, buckets=buckets)) or made[-1])
    sf_dir = "/root/testdata/sf0.001"
    stored = __spark_entry__._order_history_stored(spark, sf_dir)
    assert made[0].buckets == -(-__spark_entry__.read_star(spark, sf_dir, "lineitem").count() // 500) > 4
    assert sorted(stored.collect()) == sorted(__spark_entry__.backward(spark, sf_dir).order_history.collect())
