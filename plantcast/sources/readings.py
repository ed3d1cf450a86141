"""A store of machine readings that stays small: batches come in, closed days are folded, old days go."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plantcast.functions.values import literal
from plantcast.sources.store import remove_folder, stored_readings

READING_TYPES = "machine_id string, temperature decimal(6,2), vibration decimal(8,4), rpm int, created_at timestamp_ntz"
MANIFEST = (
    "closed_before date, through_batch bigint, kept_from date, "
    "days array<struct<reading_date: date, fold: bigint, readings: bigint>>, version bigint"
)


class ReadingsStore:
    """Readings below ``root``, in three places.

    ``open/batch_id=N/reading_date=D`` holds what batch N brought; a repeated batch replaces it. With it
    goes ``counts/batch_id=N``, its readings by day. ``days/fold=V/reading_date=D`` holds closed days, each
    folded out of all its batches. ``manifest/version=V`` has one row: which fold is valid for every day,
    and that batches up to ``through_batch`` have been folded for all days before ``closed_before``.

    Readers go by the newest manifest. A fold writes its days first and its manifest, one file, last, and
    then removes what the manifest has made useless; readers never look there, so a fold that breaks off
    anywhere has either happened or not, and a batch that is repeated after it does not count again.
    A late reading comes with a new batch, counts at once, and is folded into its day the next time. Readings
    without a time belong to no day; no plan can use them, and they go when their batch is folded. There is
    one writer.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    # Files

    def _path(self, folder: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{folder}")

    def _files(self):
        return self._path("").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        files, path = self._files(), self._path(folder)
        return sorted(s.getPath().getName() for s in files.listStatus(path)) if files.exists(path) else []

    def folders(self) -> list[str]:
        """Every folder of readings, open and folded: what a reader has to list."""
        found = []
        for top in ("open", "days"):
            for name in self._names(top):
                found += [f"{top}/{name}/{day}" for day in self._names(f"{top}/{name}") if "=" in day]
        return found

    def _table(self, folder: str, schema: str) -> DataFrame:
        if not self._names(folder):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{folder}")

    # State

    def manifest(self):
        """The newest manifest row, or None."""
        return self._table("manifest", MANIFEST).orderBy(F.desc("version")).first()

    def _commit(self, state: DataFrame, version: int) -> None:
        state.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/manifest/version={version}")
        for name in self._names("manifest"):
            if name.startswith("version=") and int(name.split("=")[1]) < version:
                remove_folder(self.spark, f"{self.root}/manifest/{name}")

    def _unfolded(self, rows: DataFrame, state) -> DataFrame:
        """Those of (batch_id, reading_date) that no fold holds."""
        if state is None:
            return rows
        if state.closed_before is not None:
            rows = rows.filter(f"batch_id > {state.through_batch} OR reading_date >= {literal(state.closed_before)}")
        if state.kept_from is not None:
            rows = rows.filter(f"reading_date >= {literal(state.kept_from)}")
        return rows

    def _folded(self, days: list) -> DataFrame:
        schema = f"{READING_TYPES}, fold bigint, reading_date date"
        if not days:
            return self.spark.createDataFrame([], schema)
        paths = [f"{self.root}/days/fold={d.fold}/reading_date={d.reading_date}" for d in days]
        return self.spark.read.schema(schema).option("basePath", f"{self.root}/days").parquet(*paths)

    # Use

    def append(self, batch: DataFrame, batch_id: int) -> None:
        """Store a batch, and how many readings it has of each day."""
        folder = f"{self.root}/open/batch_id={batch_id}"
        stored_readings(batch).write.mode("overwrite").partitionBy("reading_date").parquet(folder)
        stored = self.spark.read.schema(f"{READING_TYPES}, reading_date date").parquet(folder)
        counts = stored.groupBy("reading_date").agg(F.count("*").alias("readings"))
        counts.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/counts/batch_id={batch_id}")

    def read(self) -> DataFrame:
        """All readings, each once, with their day; filters on the day reach the folders."""
        state = self.manifest()
        columns = ["machine_id", "temperature", "vibration", "rpm", "created_at", "reading_date"]
        fresh = self._unfolded(self._table("open", f"{READING_TYPES}, batch_id bigint, reading_date date"), state)
        return fresh.select(columns).unionByName(self._folded(state.days if state else []).select(columns))

    def day_counts(self) -> DataFrame:
        """(reading_date, readings) from what was noted when they were stored; no reading is opened."""
        state = self.manifest()
        noted = self._unfolded(self._table("counts", "reading_date date, readings bigint, batch_id bigint"), state)
        known = [(d.reading_date, d.readings) for d in (state.days if state else [])]
        rows = noted.select("reading_date", "readings").union(self.spark.createDataFrame(known, "reading_date date, readings bigint"))
        return rows.groupBy("reading_date").agg(F.sum("readings").alias("readings"))

    def fold(self, closed_before: date) -> None:
        """Fold the days before ``closed_before`` out of their batches, each into one folder."""
        state = self.manifest()
        names = [n for n in self._names("open") if n.startswith("batch_id=")]
        if not names:
            return
        through = max(int(n.split("=")[1]) for n in names)
        bound = max(closed_before, state.closed_before) if state and state.closed_before else closed_before
        noted = self._unfolded(self._table("counts", "reading_date date, readings bigint, batch_id bigint"), state)
        touched = [r.reading_date for r in noted.filter(f"reading_date < {literal(bound)}").select("reading_date").distinct().collect()]
        version = (state.version if state else 0) + 1
        days = {d.reading_date: d for d in (state.days if state else [])}
        if touched:
            dates = ", ".join(literal(d) for d in touched)
            rows = self.read().filter(f"reading_date IN ({dates})")
            rows.hint("rebalance", "reading_date").write.mode("overwrite").partitionBy("reading_date").parquet(f"{self.root}/days/fold={version}")
            fresh = self.spark.read.schema(f"{READING_TYPES}, reading_date date").parquet(f"{self.root}/days/fold={version}")
            for r in fresh.groupBy("reading_date").agg(F.count("*").alias("readings")).collect():
                days[r.reading_date] = (r.reading_date, version, r.readings)
        row = (bound, through, state.kept_from if state else None, sorted(map(tuple, days.values())), version)
        self._commit(self.spark.createDataFrame([row[:4]], MANIFEST.rsplit(",", 1)[0]), version)
        self.clean()

    def drop_before(self, kept_from: date) -> None:
        """Remove every day before ``kept_from`` for good."""
        state = self.manifest()
        if state and state.kept_from:
            kept_from = max(kept_from, state.kept_from)
        days = [tuple(d) for d in (state.days if state else []) if d.reading_date >= kept_from]
        bound, through = (state.closed_before, state.through_batch) if state else (None, None)
        row = (bound, through, kept_from, days)
        version = (state.version if state else 0) + 1
        self._commit(self.spark.createDataFrame([row], MANIFEST.rsplit(",", 1)[0]), version)
        self.clean()

    def clean(self) -> None:
        """Remove folders that the newest manifest has made useless."""
        state = self.manifest()
        if state is None:
            return
        valid = {(d.fold, str(d.reading_date)) for d in state.days}
        for name in self._names("days"):
            inside = [n for n in self._names(f"days/{name}") if n.startswith("reading_date=")]
            gone = [n for n in inside if (int(name.split("=")[1]), n.split("=")[1]) not in valid]
            for day in gone:
                remove_folder(self.spark, f"{self.root}/days/{name}/{day}")
            if len(gone) == len(inside):
                remove_folder(self.spark, f"{self.root}/days/{name}")
        for name in self._names("open"):
            if not name.startswith("batch_id="):
                continue
            number = int(name.split("=")[1])
            inside = [n for n in self._names(f"open/{name}") if n.startswith("reading_date=")]
            left = len(inside)
            for day in inside:
                value = day.split("=")[1]
                folded = state.closed_before is not None and number <= state.through_batch and value < str(state.closed_before)
                old = state.kept_from is not None and value < str(state.kept_from)
                if value.startswith("__HIVE"):
                    folded, old = state.closed_before is not None and number <= state.through_batch, False
                if folded or old:
                    remove_folder(self.spark, f"{self.root}/open/{name}/{day}")
                    left -= 1
            if not left and state.through_batch is not None and number <= state.through_batch:
                remove_folder(self.spark, f"{self.root}/open/{name}")
                remove_folder(self.spark, f"{self.root}/counts/{name}")
