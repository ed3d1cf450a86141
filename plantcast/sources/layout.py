"""Storage layout that lets the look-back window prune the order lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_items_by_day(orders: DataFrame, items: DataFrame, path: str, load: int = 0) -> None:
    """Store order items under the day of their order.

    Items carry no date of their own, so without this every plan scans all of them. The
    lines are dealt by day, a day beyond the advisory partition size to several tasks, and a plan
    then reads only the folders of its window (see ``operators.demand.order_lines``).

    Every load has a folder of its own: late lines of a day lie beside the earlier ones, and a load
    that is written again replaces itself only. ``orders`` are all orders that the lines can belong to;
    a line without one is kept under the null day, which plans read too, until its order is known.
    """
    days = orders.select(F.col("id").alias("order_id"), F.to_date("created_at").alias("order_date"))
    (
        items.drop("order_date", "load")
        .join(days, "order_id", "left")
        .hint("rebalance", "order_date")
        .write.mode("overwrite")
        .partitionBy("order_date")
        .parquet(f"{path}/load={load}")
    )
