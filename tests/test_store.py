"""Stored tables: readings, layout by day, plan outputs, JDBC slices."""

import os
from dataclasses import replace
from datetime import timedelta

import pytest
from pyspark.sql import functions as F
from seed import AS_OF, CFG, seed, sources, table

from plantcast import BackwardPlan, ForwardPlan
from plantcast.operators import demand, materials, telemetry
from plantcast.operators.checks import MissingInput
from plantcast.plans.publish import publish
from plantcast.sources import tables
from plantcast.sources.legacy import Names
from plantcast.sources.layout import write_items_by_day
from plantcast.sources.store import append_readings, work_folder, write_tables


def readings(spark, *minutes_ago):
    rows = [("M-1", 81.23456, 0.0312345, 1500.0, AS_OF - timedelta(minutes=m)) for m in minutes_ago]
    return table(spark, "machine_data", rows)


def test_appended_readings_have_the_stored_types(spark, tmp_path):
    path = str(tmp_path / "readings")
    append_readings(readings(spark, 1, 2), path)
    append_readings(readings(spark, 3, 60 * 24 * 3), path)
    stored = spark.read.parquet(path)
    assert stored.count() == 4
    row = stored.first()
    assert (str(row.temperature), str(row.vibration), row.rpm) == ("81.23", "0.0312", 1500)
    assert sorted(d for d in os.listdir(path) if d.startswith("reading_date")) == [
        "reading_date=2024-01-28", "reading_date=2024-01-31",
    ]
    recent = telemetry.recent_readings(stored, CFG)
    assert recent.count() == 3
    assert "PartitionFilters: [isnotnull(reading_date" in recent._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("wanted,days", [(1, 1), (2, 1), (3, 2), (5, 3), (50, 4)])
def test_latest_readings_open_the_newest_days_only(spark, tmp_path, wanted, days):
    """Two readings on each of four days."""
    path = str(tmp_path / "readings")
    append_readings(readings(spark, *[60 * 24 * d + m for d in range(4) for m in (0, 7)]), path)
    cfg = replace(CFG, latest_readings=wanted)
    latest = telemetry.latest_readings(spark.read.parquet(path), cfg)
    expected = telemetry.latest_readings(spark.read.parquet(path).drop("reading_date"), cfg)
    assert latest.collect() == expected.collect()
    opened = telemetry._newest_days(spark.read.parquet(path), wanted)
    assert opened.select("reading_date").distinct().count() == days
    assert "PartitionFilters: [isnotnull(reading_date" in opened._jdf.queryExecution().executedPlan().toString()


def test_replayed_batch_is_stored_once(spark, tmp_path):
    path = str(tmp_path / "readings")
    append_readings(readings(spark, 1, 2), path, batch_id=0)
    append_readings(readings(spark, 3), path, batch_id=1)
    append_readings(readings(spark, 3), path, batch_id=1)
    assert spark.read.parquet(path).count() == 3


def test_retained_readings_move_to_a_new_store(spark, tmp_path):
    append_readings(readings(spark, 1, 29, 31, 300), str(tmp_path / "all"))
    kept = telemetry.retain_recent(spark.read.parquet(str(tmp_path / "all")), CFG)
    append_readings(kept, str(tmp_path / "kept"))
    assert spark.read.parquet(str(tmp_path / "kept")).count() == 2


def test_items_by_day_are_pruned(spark, tmp_path):
    src = seed(spark)
    path = str(tmp_path / "items")
    write_items_by_day(src.orders, src.order_items, path)
    stored = spark.read.parquet(path)
    assert stored.count() == 60
    lines = demand.order_lines(src.orders, stored, CFG)
    expected = demand.order_lines(src.orders, src.order_items, CFG)
    assert sorted(lines.collect()) == sorted(expected.collect())
    assert "PartitionFilters: [((order_date" in lines._jdf.queryExecution().executedPlan().toString()


def test_plan_tables_are_written(spark, tmp_path):
    plan = BackwardPlan(seed(spark), CFG)
    out = str(tmp_path)
    write_tables({"po_summary": plan.po_summary, "snapshot": plan.snapshot}, out)
    assert spark.read.parquet(f"{out}/po_summary").count() == 5
    doc = spark.read.json(f"{out}/snapshot").first()
    assert doc.kpi.total_po_qty == 1257 and doc.charts.compare.demand == [13, 13, 6, 6, 8, 10, 13]


@pytest.mark.parametrize("variant", [BackwardPlan, ForwardPlan])
def test_published_plan(spark, tmp_path, variant):
    publish(variant(seed(spark), CFG), str(tmp_path))
    expected = variant(seed(spark), CFG)
    for name in variant.REPORTS:
        if name == "snapshot":
            doc = spark.read.json(f"{tmp_path}/snapshot").first()
            assert doc.kpi.total_po_qty == expected.kpis.first().total_po_qty
        else:
            got = spark.read.parquet(f"{tmp_path}/{name}")
            assert got.columns == getattr(expected, name).columns
            assert got.count() == getattr(expected, name).count() > 0


def test_no_plan_without_inputs(spark, tmp_path):
    with pytest.raises(MissingInput):
        publish(BackwardPlan(sources(spark), CFG), str(tmp_path))
    assert os.listdir(tmp_path) == []


@pytest.mark.parametrize("variant", [BackwardPlan, ForwardPlan])
def test_publish_checks_without_reading_the_order_lines(spark, tmp_path, variant, monkeypatch):
    """The input checks of a plan are not built, only what it has written is looked at."""
    monkeypatch.setattr(variant, "input_checks", property(lambda self: pytest.fail("order lines joined to check them")))
    root = spark.conf.get("spark.checkpoint.dir")
    before = {f for _, folders, _ in os.walk(root) for f in folders if f.startswith("plan-")}
    publish(variant(seed(spark), CFG), f"{tmp_path}/good")
    assert sorted(os.listdir(f"{tmp_path}/good")) == sorted(variant.REPORTS)
    with pytest.raises(MissingInput, match="no orders"):
        publish(variant(sources(spark), CFG), f"{tmp_path}/none")
    no_parts = seed(spark).replaced(parts=sources(spark).parts)
    if variant is BackwardPlan:
        with pytest.raises(MissingInput, match="parts table is empty"):
            publish(variant(no_parts, CFG), f"{tmp_path}/none")
    assert not os.path.exists(f"{tmp_path}/none")
    assert {f for _, folders, _ in os.walk(root) for f in folders if f.startswith("plan-")} == before


def test_stored_inputs_give_the_same_plan(spark, tmp_path):
    src = seed(spark)
    for name in tables.SCHEMAS:
        getattr(src, name).write.parquet(f"{tmp_path}/{name}")
    stored = tables.from_parquet(spark, str(tmp_path))
    assert sorted(BackwardPlan(stored, CFG).po_summary.collect()) == sorted(BackwardPlan(src, CFG).po_summary.collect())


def test_hash_slices_cover_every_row():
    slices = tables.hash_slices("part_no", 3)
    assert slices == [
        "MOD(CRC32(part_no), 3) = 0 OR part_no IS NULL",
        "MOD(CRC32(part_no), 3) = 1",
        "MOD(CRC32(part_no), 3) = 2",
    ]


def test_work_folder_follows_the_session(spark):
    shared = spark.conf.get("spark.checkpoint.dir")
    first, second = work_folder(spark, "x"), work_folder(spark, "x")
    assert first.startswith(f"{shared}/plantcast/x-") and first != second


def test_work_folder_needs_a_shared_folder_on_a_cluster():
    class Session:
        class conf:
            get = staticmethod(lambda key, default: default)

        class sparkContext:
            master = "yarn"

    with pytest.raises(ValueError):
        work_folder(Session(), "x")


def test_range_bounds_of_split_tables(spark, monkeypatch):
    """The reader asks for the ends of the key, then opens one slice per range."""
    calls = {}

    class Reader:
        def format(self, name):
            return self

        def options(self, **options):
            calls["query"] = options["query"]
            return self

        def load(self):
            return spark.createDataFrame([(5, 104)], "lo int, hi int")

        def jdbc(self, url, name, **options):
            calls.update(options, name=name)
            return spark.range(1)

    class Session:
        read = Reader()

    tables.jdbc_table(Session(), "jdbc:x", "orders", {"user": "u"}, slices=8)
    assert calls["query"] == "SELECT MIN(id) AS lo, MAX(id) AS hi FROM orders"
    assert (calls["column"], calls["lowerBound"], calls["upperBound"], calls["numPartitions"]) == ("id", 5, 105, 8)
    assert calls["properties"]["user"] == "u"
    tables.jdbc_table(Session(), "jdbc:x", "parts", slices=2, physical_name="零件")
    assert len(calls["predicates"]) == 2 and calls["name"] == "零件"


def test_older_names_are_exchanged_at_the_scan(spark, tmp_path):
    """Tables under their physical names: the same plan, and filters reach the files."""
    src, names = seed(spark), Names()
    for name in tables.SCHEMAS:
        names.physical(name, getattr(src, name)).write.parquet(f"{tmp_path}/{names.table(name)}")
    assert {"bom主檔", "bom明細", "零件"} <= set(os.listdir(tmp_path))
    stored = tables.from_parquet(spark, str(tmp_path), names)
    assert sorted(BackwardPlan(stored, CFG).po_summary.collect()) == sorted(BackwardPlan(src, CFG).po_summary.collect())
    plan = materials.incoming_arrays(stored.purchase, CFG)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(`交貨日期`" in plan.split("PushedFilters: [")[1].split("]")[0]
    assert "id" not in plan.split("ReadSchema: struct<")[1].split(">")[0].split(":")


def test_declared_tables(spark, tmp_path):
    """Empty folders are empty tables; no job runs to learn a schema; a type that does not fit stops the query."""
    for name in tables.SCHEMAS:
        os.makedirs(tmp_path / name)
    empty = tables.from_parquet(spark, str(tmp_path))
    assert BackwardPlan(empty, CFG).po_summary.collect() == []
    assert [r.row_count for r in BackwardPlan(empty, CFG).input_checks.collect()] == [0, 0]
    spark.sql("SELECT 'x' AS part_no, 'many' AS stock_qty, 1 AS safety_stock").write.mode("append").parquet(f"{tmp_path}/parts")
    with pytest.raises(Exception, match="(?i)convert"):
        empty.replaced(parts=tables.stored_table(spark, str(tmp_path), "parts")).parts.collect()
    assert tables._layout(spark, f"{tmp_path}/parts") == []


def test_slices_on_the_physical_key(spark):
    calls = {}

    class Session:
        class read:
            @staticmethod
            def jdbc(url, name, **options):
                calls.update(options, name=name)
                return spark.createDataFrame([("p", 1, 2)], "`圖號` string, `數量` int, `安全量` int")

    df = tables.jdbc_table(Session(), "jdbc:x", "parts", slices=2, names=Names())
    assert calls["name"] == "零件" and all("圖號" in p for p in calls["predicates"])
    assert df.columns == ["part_no", "stock_qty", "safety_stock"]


def test_seed_tables_load(spark):
    src = seed(spark)
    assert src.orders.count() == 30
    assert src.order_items.agg(F.count("*"), F.sum("quantity")).first()[0] == 60
    with pytest.raises(AttributeError):
        _ = src.bom


def test_unusable_values_are_stored_as_null(spark, tmp_path):
    bad = spark.sql(
        "SELECT 'M-1' AS machine_id, 12000.0D AS temperature, double('nan') AS vibration, double('nan') AS rpm, "
        "timestamp_ntz'2024-01-31 09:00:00' AS created_at"
    )
    append_readings(bad, str(tmp_path / "bad"), batch_id=0)
    row = spark.read.parquet(str(tmp_path / "bad")).first()
    assert (row["temperature"], row["vibration"], row["rpm"]) == (None, None, None)
