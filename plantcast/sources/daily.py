"""Demand per day and product, kept up to date with every load of an order store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plantcast.functions.values import literal
from plantcast.sources.orders import OrderStore
from plantcast.sources.store import remove_folder


class DailyDemand:
    """Sums of uncancelled order lines below ``path``, one folder per day of the order.

    A load is stored through ``append``, which sums the days anew that it touches, from the lines of their
    months, and leaves the other days' files alone. A late line, a cancelled order and a load that is written again
    with less count in their day. Days are replaced, not added to, so a repeated load changes nothing. The days a
    load is about to touch are noted before it is stored: one that broke off is put right when it is repeated.

    ``read`` is the ``daily_demand`` of ``Sources``: a plan then opens one row per product and day, and order
    lines of the day only in which its look-back begins.
    """

    def __init__(self, spark: SparkSession, path: str, store: OrderStore) -> None:
        self.spark, self.path, self.store = spark, path.rstrip("/"), store

    def append(self, orders: DataFrame, items: DataFrame, load: int) -> None:
        """Store a load (see ``OrderStore.append``) and sum the days it touches."""
        noted = f"{self.path}-pending/load={load}"
        self.store.days_of(load).write.mode("append").parquet(noted)
        self.store.append(orders, items, load)
        before = self.spark.read.schema("order_date date").parquet(noted)
        self._sum_days([d for (d,) in before.union(self.store.days_of(load)).distinct().collect()])
        remove_folder(self.spark, noted)

    def _sum_days(self, days: list) -> None:
        """Replace some days. Each gets a row without product too, so that a day without lines is replaced as well."""
        if not days:
            return
        months = ", ".join(sorted({literal(d.replace(day=1)) for d in days}))
        orders = self.store.orders.filter(f"order_month IN ({months}) AND status <> 'cancelled'").selectExpr(
            "id AS order_id", "to_date(created_at) AS order_date"
        )
        orders = orders.filter(F.col("order_date").isin(days))
        lines = self.store.order_items.filter(f"order_month IN ({months}) OR order_month IS NULL")
        sums = (
            orders.join(lines.filter("product_id IS NOT NULL AND quantity IS NOT NULL"), "order_id")
            .groupBy("product_id", "order_date")
            .agg(F.sum("quantity").alias("qty"))
        )
        marks = self.spark.createDataFrame([(None, d, None) for d in days], "product_id bigint, order_date date, qty bigint")
        (
            sums.select("product_id", "order_date", "qty")
            .union(marks)
            .hint("rebalance", "order_date")
            .select("product_id", "qty", "order_date")
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("order_date")
            .parquet(self.path)
        )

    def read(self) -> DataFrame:
        """One row per day and product: order_date, product_id, qty."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)
        stored = self.spark.read.schema("product_id bigint, qty bigint, order_date date").parquet(self.path)
        return stored.filter("product_id IS NOT NULL").select("order_date", "product_id", "qty")
