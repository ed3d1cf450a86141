"""Streams against their batch counterparts."""

from dataclasses import replace
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from seed import AS_OF, CFG, seed, sources, table

import __spark_entry__
from plantcast import BackwardPlan, ForwardPlan
from plantcast.operators import telemetry
from plantcast.operators.checks import MissingInput
from plantcast.streaming import health
from plantcast.streaming.health import LateRows, rolling_health, run_to_files, score_stream
from plantcast.streaming.replan import Replanner, last_run

SCHEMA = "machine_id string, temperature double, vibration double, rpm double, created_at timestamp_ntz"
NOON = datetime(2024, 1, 31, 12)


def arrive(spark, path, *rows):
    """Put one file of readings into the input folder."""
    table(spark, "machine_data", list(rows)).coalesce(1).write.mode("append").parquet(path)


def stream(spark, path):
    return spark.readStream.schema(SCHEMA).parquet(path)


def reading(moment, temperature=85.0, machine="M-1"):
    return (machine, temperature, 0.01, 1500.0, moment)


def test_scores_equal_batch(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    machine_data = seed(spark).machine_data
    machine_data.write.parquet(src)
    run_to_files(score_stream(stream(spark, src), CFG), out, str(tmp_path / "state"))
    assert sorted(spark.read.parquet(out).collect()) == sorted(telemetry.reading_health(machine_data, CFG).collect())


def test_aligned_window_equals_batch(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [reading(NOON - timedelta(hours=h), 76.0 + h, f"M-{h % 2}") for h in range(1, 25)]
    arrive(spark, src, *rows, reading(NOON - timedelta(hours=25), 99.0), reading(NOON + timedelta(hours=2), 99.0, "late"))
    run_to_files(rolling_health(stream(spark, src), CFG), out, str(tmp_path / "state"))
    got = {
        r.machine_id: r.machine_health
        for r in spark.read.parquet(out).filter(F.col("window_end") == F.lit(NOON).cast("timestamp_ntz")).collect()
    }
    cfg = BackwardPlan(seed(spark).replaced(machine_data=table(spark, "machine_data", rows)), CFG).cfg
    batch = telemetry.machine_health(telemetry.reading_health(table(spark, "machine_data", rows), cfg))
    assert got == pytest.approx({r.machine_id: r.machine_health for r in batch.collect()})


def test_reading_behind_the_watermark_is_dropped(spark, tmp_path):
    src, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    arrive(spark, src, reading(NOON - timedelta(hours=30)), reading(NOON))
    run_to_files(rolling_health(stream(spark, src), CFG), out, state)
    before = spark.read.parquet(out).count()
    # 31 hours before noon: every window it belongs to has been emitted. One at noon is kept.
    arrive(spark, src, reading(NOON - timedelta(hours=54, minutes=1)), reading(NOON + timedelta(hours=26)))
    run_to_files(rolling_health(stream(spark, src), CFG), out, state)
    rows = spark.read.parquet(out)
    assert rows.filter(F.col("window_start") < F.lit(NOON - timedelta(hours=54)).cast("timestamp_ntz")).count() == 0
    assert rows.count() > before
    assert rows.groupBy("machine_id", "window_start").count().filter("count > 1").count() == 0


def test_late_rows_are_counted(spark, tmp_path):
    """Two machines late by more than the bound in a batch that moves on; one within it is used."""
    src, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    cfg = replace(CFG, lateness_minutes=90)
    late = LateRows()
    spark.streams.addListener(late)
    try:
        arrive(spark, src, reading(NOON), reading(NOON + timedelta(hours=5)))
        assert run_to_files(rolling_health(stream(spark, src), cfg), out, state) == 0
        arrive(
            spark, src, reading(NOON + timedelta(hours=1), machine="A"), reading(NOON + timedelta(hours=1), machine="B"),
            reading(NOON + timedelta(hours=4), 95.0), reading(NOON + timedelta(hours=40)),
        )
        assert run_to_files(rolling_health(stream(spark, src), cfg), out, state) == 2
        spark._jsparkSession.sparkContext().listenerBus().waitUntilEmpty()
    finally:
        spark.streams.removeListener(late)
    assert sum(late.dropped.values()) == 2
    used = spark.read.parquet(out).filter(F.col("window_end") == F.lit(NOON + timedelta(hours=6)).cast("timestamp_ntz"))
    assert [(r.machine_id, r.readings) for r in used.collect()] == [("M-1", 3)]


def test_batches_cut_anywhere_give_the_same(spark, tmp_path):
    cfg = replace(CFG, lateness_minutes=240)
    rows = [reading(NOON + timedelta(hours=h), 70.0 + h, f"M-{h % 2}") for h in (0, 2, 1, 4, 3, 5, 2, 6)]
    results = []
    for k, cuts in enumerate(([8], [3, 8], [1, 2, 5, 8])):
        src, out, state = (str(tmp_path / f"{n}{k}") for n in ("in", "out", "state"))
        dropped, low = 0, 0
        for high in cuts:
            arrive(spark, src, *rows[low:high])
            dropped, low = dropped + run_to_files(rolling_health(stream(spark, src), cfg), out, state), high
        arrive(spark, src, reading(NOON + timedelta(hours=99), machine="end"))
        dropped += run_to_files(rolling_health(stream(spark, src), cfg), out, state)
        found = spark.read.parquet(out).withColumn("machine_health", F.round("machine_health", 12))
        results.append((dropped, sorted(found.collect())))
    assert results[0] == results[1] == results[2] and results[0][0] == 0 and results[0][1]


def test_replan_keeps_up_with_batches(spark, tmp_path):
    inbox, out = str(tmp_path / "in"), str(tmp_path / "plans")
    base = seed(spark)
    tables = ("kpis", "capacity_plan", "po_summary", "machine_series")
    planner = Replanner(base, CFG, str(tmp_path / "readings"), out, clock=None, tables=tables)
    rows = sorted(base.machine_data.collect(), key=lambda r: r.created_at)
    for batch in (rows[:8], rows[8:]):
        arrive(spark, inbox, *[tuple(r) for r in batch])
        planner.start(stream(spark, inbox), str(tmp_path / "state"), availableNow=True).awaitTermination()
    expected = BackwardPlan(base, CFG)
    for name in tables:
        got, want = spark.read.parquet(f"{out}/run=1/{name}"), getattr(expected, name)
        if name == "capacity_plan":  # the mean's last bit depends on the order of summation
            got, want = (df.withColumn("capacity_factor", F.round("capacity_factor", 12)) for df in (got, want))
        assert sorted(got.collect()) == sorted(want.collect()), name
    assert last_run(spark, out) == f"{out}/run=1"
    first = spark.read.parquet(f"{out}/run=0/kpis").first()
    assert first.capacity_factor != expected.kpis.first().capacity_factor


def test_replan_of_the_forward_variant(spark, tmp_path):
    """All its reports, and no run that counts as complete before they are written."""
    base, out = seed(spark), str(tmp_path / "plans")
    planner = Replanner(base, CFG, str(tmp_path / "readings"), out, clock=None, plan=ForwardPlan)
    planner(base.machine_data, 0)
    got, want = spark.read.parquet(f"{out}/run=0/po_summary"), ForwardPlan(base, CFG).po_summary
    assert sorted(got.collect()) == sorted(want.collect()) and last_run(spark, out) == f"{out}/run=0"
    assert spark.read.json(f"{out}/run=0/snapshot").first().kpi.total_po_qty == 425


def test_replan_needs_inputs(spark, tmp_path):
    empty = sources(spark)
    planner = Replanner(empty, CFG, str(tmp_path / "readings"), str(tmp_path / "plans"), clock=None)
    with pytest.raises(MissingInput):
        planner.start(stream(spark, str(tmp_path)), str(tmp_path / "state"), availableNow=True)


def test_replan_by_the_clock(spark, tmp_path):
    planner = Replanner(
        seed(spark), CFG, str(tmp_path / "readings"), str(tmp_path / "plans"), tables=("capacity_factor",),
        clock=lambda: AS_OF + timedelta(hours=24),
    )
    batch = table(spark, "machine_data", [reading(AS_OF, 95.0), reading(AS_OF - timedelta(seconds=1), 75.0)])
    planner(batch, 0)
    assert spark.read.parquet(f"{tmp_path}/plans/run=0/capacity_factor").first().avg_health == pytest.approx(0.65)


def test_state_partitions_grow_with_the_readings(spark, monkeypatch):
    """The registered query spreads its state by its readings, so that no task's share of them grows."""
    cores = spark.sparkContext.defaultParallelism
    assert [health.state_partitions(spark, n) for n in (0, 1000, 36_000_000)] == [cores, cores, 288]
    sf_dir = "/root/testdata/sf0.001"
    readings = __spark_entry__.read_star(spark, sf_dir, "events").count()
    monkeypatch.setattr(health, "ROWS_PER_STATE", -(-readings // 11))
    used = []
    monkeypatch.setattr(
        __spark_entry__, "rolling_health", lambda rows, cfg: used.append(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) or rolling_health(rows, cfg)
    )
    assert __spark_entry__._stream_rolling_health(spark, sf_dir).count() > 0 and used == ["11"]
