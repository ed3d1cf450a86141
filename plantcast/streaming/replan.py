"""Plan again whenever new readings have arrived."""

from __future__ import annotations

from collections.abc import Callable, Hashable, Sequence
from dataclasses import replace
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from plantcast.config import PlanConfig
from plantcast.operators.checks import MissingInput
from plantcast.plans.backward import BackwardPlan
from plantcast.sources.readings import ReadingsStore
from plantcast.sources.store import remove_folder, work_folder, write_tables
from plantcast.sources.tables import Sources

def last_run(spark: SparkSession, output_path: str) -> str:
    """Folder of the newest run whose tables are all written."""
    runs = spark.read.schema("run int").parquet(f"{output_path}/completed")
    return f"{output_path}/run={runs.agg(F.max('run')).first()[0]}"


class Replanner:
    """``foreachBatch`` handler: store the batch, then write the plan's tables anew.

    A batch of readings changes the capacity factor only. Demand, bill lines with their product's demand,
    stock and purchases are computed once per day and ``version`` of the planning data and kept as tables; a
    batch goes on from these and opens no order line. ``sources`` can be a function that reads the inputs
    anew for every such version; ``version`` returns anything that changes with them, a load number say.
    The look-back window of a frozen demand ends at the moment it was frozen.

    Each run has its own folder ``run=<batch>``, which a repeated batch replaces. Its entry in
    ``completed`` is written last: readers that ask ``last_run`` never see half a plan.

    Every ``fold_every`` batches the store's days are folded. With ``keep_days`` older days of readings are
    removed, never such that the telemetry window reaches; with ``keep_runs`` only the newest runs stay.

    ``clock`` gives the moment each run plans for; ``None`` plans every run for ``cfg.as_of``, which
    suits a replay only, so it has to be said. Inputs are checked once, before the first batch.
    """

    def __init__(
        self,
        sources: Sources | Callable[[], Sources],
        cfg: PlanConfig,
        readings_path: str,
        output_path: str,
        clock: Callable[[], datetime] | None,
        tables: Sequence[str] | None = None,
        plan: type = BackwardPlan,
        version: Callable[[], Hashable] = lambda: None,
        fold_every: int = 50,
        keep_days: int | None = None,
        keep_runs: int | None = None,
    ) -> None:
        self.sources = sources if callable(sources) else lambda: sources
        self.cfg = cfg
        self.readings_path = readings_path
        self.output_path = output_path
        self.tables = plan.REPORTS if tables is None else tables
        self.clock = clock
        self.plan = plan
        self.version = version
        self.fold_every, self.keep_days, self.keep_runs = fold_every, keep_days, keep_runs
        self._frozen_for: tuple | None = None
        self._frozen_folder: str | None = None

    def current(self) -> PlanConfig:
        return self.cfg if self.clock is None else replace(self.cfg, as_of=self.clock(), telemetry_as_of=None)

    def freeze(self, spark: SparkSession, cfg: PlanConfig) -> None:
        """Write the tables that no reading changes, once per day and version."""
        key = cfg.today, self.version()
        if key != self._frozen_for:
            before, self._frozen_folder = self._frozen_folder, work_folder(spark, "frozen")
            self._inputs = self.sources()
            self._frozen = self.plan(self._inputs, cfg).freeze(self._frozen_folder)
            self._frozen_for = key
            if before:
                remove_folder(spark, before)

    def planned(self, spark: SparkSession, cfg: PlanConfig) -> BackwardPlan:
        """The plan of what is stored now, over the frozen tables of its day and version."""
        self.freeze(spark, cfg)
        store = ReadingsStore(spark, self.readings_path)
        plan = self.plan(self._inputs.replaced(machine_data=store.read(), reading_days=store.day_counts()), cfg)
        plan.use(self._frozen)
        return plan

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        store = ReadingsStore(spark, self.readings_path)
        store.append(batch, batch_id)
        cfg = self.current()
        plan = self.planned(spark, cfg)
        run = f"{self.output_path}/run={batch_id}"
        completed, staging = f"{self.output_path}/completed/run={batch_id}", work_folder(spark, "replan")
        remove_folder(spark, completed)
        plan.stage(staging)
        write_tables({name: getattr(plan, name) for name in self.tables}, run)
        spark.range(1, numPartitions=1).write.mode("overwrite").parquet(completed)
        remove_folder(spark, staging)
        self._maintain(spark, store, cfg, batch_id)

    def _maintain(self, spark: SparkSession, store: ReadingsStore, cfg: PlanConfig, batch_id: int) -> None:
        if (batch_id + 1) % self.fold_every == 0:
            store.fold(cfg.telemetry_now.date() + timedelta(days=1))
            if self.keep_days is not None:
                oldest = cfg.telemetry_now.date() - timedelta(days=self.keep_days)
                store.drop_before(min(oldest, cfg.telemetry_cutoff.date()))
        if self.keep_runs is not None:
            runs = spark.read.schema("run int").parquet(f"{self.output_path}/completed").select("run").distinct()
            for (run,) in runs.filter(f"run <= {batch_id - self.keep_runs}").collect():
                remove_folder(spark, f"{self.output_path}/completed/run={run}")
                remove_folder(spark, f"{self.output_path}/run={run}")

    def start(self, readings: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """Freeze what the first batch needs, check it for missing inputs, and start."""
        spark, cfg = readings.sparkSession, self.current()
        self.freeze(spark, cfg)
        try:
            self.plan(self._inputs, cfg).require_inputs(self._frozen["demand_arrays"])
        except MissingInput:
            remove_folder(spark, self._frozen_folder)
            self._frozen_for = self._frozen_folder = None
            raise
        return (
            readings.writeStream.foreachBatch(self)
            .option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"processingTime": "5 seconds"}))
            .start()
        )
