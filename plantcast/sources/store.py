"""Written tables: appended readings, staged intermediates, plan outputs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def work_folder(spark: SparkSession, name: str) -> str:
    """Fresh folder below the shared folder that ``spark.checkpoint.dir`` names.

    Only a local session without that setting falls back to a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="plantcast-")
    return f"{root.rstrip('/')}/plantcast/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, folder: str) -> DataFrame:
    """Write a table and read it back: shared work is done once, and a lost executor
    costs a re-read instead of the whole lineage."""
    df.write.mode("overwrite").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def stored_readings(readings: DataFrame) -> DataFrame:
    """Readings in the stored types, with the day they are partitioned by.

    A value that the type cannot hold (NaN, out of range, unreadable) is stored as null, which
    ``clean_readings`` replaces by the default, so one bad reading does not stop a stream.
    """
    return readings.select(
        "machine_id",
        F.col("temperature").try_cast("decimal(6,2)").alias("temperature"),
        F.col("vibration").try_cast("decimal(8,4)").alias("vibration"),
        F.col("rpm").try_cast("int").alias("rpm"),
        F.col("created_at").cast("timestamp_ntz").alias("created_at"),
        F.to_date("created_at").alias("reading_date"),
    )


def append_readings(readings: DataFrame, path: str, batch_id: int | None = None) -> None:
    """Append readings, one folder per day.

    A numbered batch has a folder of its own that a replay overwrites, so a batch that is
    delivered twice is stored once.
    """
    rows = stored_readings(readings)
    if batch_id is None:
        rows.write.mode("append").partitionBy("reading_date").parquet(path)
    else:
        rows.write.mode("overwrite").partitionBy("reading_date").parquet(f"{path}/batch_id={batch_id}")


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Remove a folder whose tables are no longer read."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def write_tables(tables: dict[str, DataFrame], path: str) -> None:
    """Write result tables below ``path``, documents with nested values as JSON."""
    for name, df in tables.items():
        if any(t.startswith(("array", "struct")) for _, t in df.dtypes):
            df.write.mode("overwrite").json(f"{path}/{name}")
        else:
            df.write.mode("overwrite").parquet(f"{path}/{name}")
