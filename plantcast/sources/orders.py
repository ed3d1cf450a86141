"""Orders and their lines in equal buckets of the order number, partitioned by month and load."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plantcast.sources.store import remove_folder

ORDER_COLUMNS = {"id": "bigint", "created_at": "timestamp_ntz", "status": "string"}
LINE_COLUMNS = {"order_id": "bigint", "product_id": "bigint", "quantity": "int"}


BUCKET_LINES = 2_000_000


def buckets_for(lines: int, least: int = 4) -> int:
    """Buckets for a store that is to hold so many lines: the task of a bucket sorts ``BUCKET_LINES`` of them, about."""
    return max(least, -(-lines // BUCKET_LINES))


class OrderStore:
    """Two tables below ``root``: an order and its lines meet in one task without a shuffle.

    Both are partitioned by the month of the order, so a plan opens those of its window only, and by load. A load
    is written once per partition and bucket; written again it replaces itself, so a repeated load is
    stored once and late lines never touch what is there. An order that a later load brings again
    (a cancelled one, say) takes the place of the earlier one; it keeps the month it was made in. Lines whose order is not known yet lie
    under the null month, which every plan reads, and find their order when it comes.

    The number of buckets belongs to the stored data: open a store with the number it was written with. Choose it by the lines
    the store is to hold (``buckets_for``), since one task writes and joins a bucket.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64) -> None:
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        name = uuid.uuid4().hex
        self._orders = self._register(f"orders_{name}", "orders", ORDER_COLUMNS, "id")
        self._lines = self._register(f"lines_{name}", "lines", LINE_COLUMNS, "order_id")

    def _register(self, name: str, folder: str, columns: dict[str, str], key: str) -> str:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{folder}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)
        declared = ", ".join(f"{c} {t}" for c, t in {**columns, "order_month": "date", "load": "int"}.items())
        self.spark.sql(
            f"CREATE TABLE {name} ({declared}) USING parquet PARTITIONED BY (order_month, load) "
            f"CLUSTERED BY ({key}) SORTED BY ({key}) INTO {self.buckets} BUCKETS LOCATION '{self.root}/{folder}'"
        )
        self.spark.sql(f"ALTER TABLE {name} RECOVER PARTITIONS")
        return name

    def close(self) -> None:
        """Forget the tables; the files stay."""
        for name in (self._orders, self._lines):
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def _write(self, table: str, rows: DataFrame, key: str, load: int) -> None:
        # A load that is written again may have lost a month, so those it had before go first.
        for (spec,) in self.spark.sql(f"SHOW PARTITIONS {table}").collect():
            month, stored = spec.split("/")
            if stored == f"load={load}":
                month = month.removeprefix("order_month=")
                value = "NULL" if month.startswith("__HIVE") or month == "null" else f"DATE'{month}'"
                self.spark.sql(f"ALTER TABLE {table} DROP IF EXISTS PARTITION (order_month = {value}, load = {load})")
                remove_folder(self.spark, f"{self.root}/{table.split('_')[0]}/{spec}")
        # One task per bucket writes one file for each of its months.
        dealt = rows.withColumn("load", F.lit(load)).repartition(self.buckets, key)
        before = self.spark.conf.get("spark.sql.sources.partitionOverwriteMode")
        self.spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
        try:
            dealt.write.insertInto(table, overwrite=True)
        finally:
            self.spark.conf.set("spark.sql.sources.partitionOverwriteMode", before)

    def append(self, orders: DataFrame, items: DataFrame, load: int) -> None:
        """Store a load of new orders, and of lines of these or of stored orders."""
        fresh = orders.select(*[F.col(c).cast(t).alias(c) for c, t in ORDER_COLUMNS.items()])
        fresh = fresh.withColumn("order_month", F.to_date(F.trunc("created_at", "month")))
        self._write(self._orders, fresh, "id", load)
        months = self._newest().select(F.col("id").alias("order_id"), "order_month")
        lines = items.select(*[F.col(c).try_cast(t).alias(c) for c, t in LINE_COLUMNS.items()])
        self._write(self._lines, lines.join(months, "order_id", "left"), "order_id", load)

    def days_of(self, load: int) -> DataFrame:
        """Days, as ``order_date``, of the orders that a load brings or has lines of, in all versions of these orders."""
        orders, lines = self.spark.table(self._orders), self.spark.table(self._lines)
        touched = orders.filter(f"load = {load}").select("id").union(lines.filter(f"load = {load}").select("order_id"))
        days = orders.join(touched, "id", "left_semi").select(F.to_date("created_at").alias("order_date"))
        return days.filter("order_date IS NOT NULL").distinct()

    def _newest(self) -> DataFrame:
        """Each order as its last load has it; both the scan and the grouping keep to the buckets."""
        newest = F.max(F.struct("load", "created_at", "status")).alias("last")
        grouped = self.spark.table(self._orders).groupBy("order_month", "id").agg(newest)
        return grouped.select(
            "id", F.col("last.created_at").alias("created_at"), F.col("last.status").alias("status"), "order_month"
        )

    @property
    def orders(self) -> DataFrame:
        return self._newest()

    @property
    def order_items(self) -> DataFrame:
        """Lines with the month of their order, null where it came after them."""
        return self.spark.table(self._lines).drop("load")
