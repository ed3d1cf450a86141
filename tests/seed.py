"""Seed data at a fixed date, and builders for small inputs."""

from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from plantcast.config import PlanConfig
from plantcast.sources.tables import SCHEMAS, Sources

AS_OF = datetime(2024, 1, 31, 10)
CFG = PlanConfig(as_of=AS_OF)
TODAY = CFG.today

READINGS = {
    "M-01": [
        (72.5, 0.0310, 1500, 18), (73.2, 0.0305, 1490, 16), (74.1, 0.0320, 1510, 14), (75.0, 0.0340, 1525, 12),
        (76.8, 0.0370, 1530, 10), (78.4, 0.0390, 1540, 8), (81.0, 0.0450, 1555, 6), (84.2, 0.0520, 1560, 4),
        (86.4, 0.0810, 1570, 2), (87.3, 0.0840, 1575, 1),
    ],
    "M-02": [
        (70.8, 0.0290, 1450, 18), (71.9, 0.0310, 1460, 16), (73.6, 0.0340, 1470, 14), (77.2, 0.0410, 1490, 12),
        (82.5, 0.0550, 1510, 10), (85.9, 0.0790, 1520, 8), (88.1, 0.0830, 1535, 6), (89.0, 0.0860, 1540, 4),
        (83.3, 0.0600, 1515, 2), (79.5, 0.0440, 1495, 1),
    ],
}


def day(offset: int) -> date:
    return TODAY + timedelta(days=offset)


def table(spark, name: str, rows: list[tuple]):
    """Rows without the running id where the schema starts with one that nothing reads."""
    schema = SCHEMAS[name]
    if name in ("order_items", "bom_detail", "purchase", "machine_data"):
        schema = schema.removeprefix("id int, ")
    if name == "machine_data":  # plain numbers, so that NaN and nulls can be given
        schema = schema.replace("decimal(6,2)", "double").replace("decimal(8,4)", "double").replace("rpm int", "rpm double")
    return spark.createDataFrame(rows, schema)


def sources(spark, **rows) -> Sources:
    """Small inputs; tables that are not named are empty."""
    return Sources(**{name: table(spark, name, rows.get(name, [])) for name in SCHEMAS})


def seed_orders(spark):
    number = spark.range(1, 31).select(F.col("id").cast("int").alias("id"))
    start = F.lit(datetime(2024, 1, 31, 9).isoformat(sep=" ")).cast("timestamp_ntz")
    return number.select(
        "id",
        (start - F.make_dt_interval(days=F.lit(30) - F.col("id"))).alias("created_at"),
        F.when(F.col("id").isin(8, 21), "cancelled").otherwise("completed").alias("status"),
    )


def seed_items(orders):
    working = F.weekday("created_at") < 5
    n = F.col("id")
    first = F.when(working, 6 + n % 4).otherwise(3 + n % 2)
    second = F.when(working, 4 + n % 3).otherwise(2 + n % 2)
    lines = F.array(
        F.struct(F.lit(1001).alias("product_id"), first.alias("quantity")),
        F.struct(F.lit(1002).alias("product_id"), second.alias("quantity")),
    )
    return orders.select(n.alias("order_id"), F.inline(lines))


def seed(spark) -> Sources:
    orders = seed_orders(spark)
    readings = [
        (machine, float(t), v, float(r), AS_OF - timedelta(minutes=ago))
        for machine, rows in READINGS.items()
        for t, v, r, ago in rows
    ]
    return Sources(
        orders=orders,
        order_items=seed_items(orders),
        bom_header=table(spark, "bom_header", [(1, "1001"), (2, "1002")]),
        bom_detail=table(
            spark,
            "bom_detail",
            [(1, "PART-A", 2), (1, "PART-B", 1), (1, "PART-C", 1), (2, "PART-B", 2), (2, "PART-D", 3), (2, "PART-E", 1)],
        ),
        parts=table(
            spark,
            "parts",
            [("PART-A", 18, 15), ("PART-B", 14, 18), ("PART-C", 10, 8), ("PART-D", 9, 16), ("PART-E", 5, 10)],
        ),
        purchase=table(
            spark,
            "purchase",
            [
                ("PART-A", day(2), 8, "pending"),
                ("PART-B", day(1), 6, "pending"),
                ("PART-D", day(4), 10, "pending"),
                ("PART-E", day(3), 4, "pending"),
                ("PART-C", day(-2), 5, "received"),
            ],
        ),
        machine_data=table(spark, "machine_data", readings),
    )
