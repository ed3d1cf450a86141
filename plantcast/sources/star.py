"""Planning inputs taken from the star-schema test tables, whole tables throughout."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plantcast.config import PlanConfig
from plantcast.sources.tables import Sources

STAR_CONFIG = PlanConfig(as_of=datetime(2001, 6, 1, 10), telemetry_as_of=datetime(2024, 1, 31))

# Declared, so that no job has to read file footers before a query.
STAR_SCHEMAS = {
    "orders": "o_orderkey bigint, o_orderstatus string, o_orderdate timestamp_ntz",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_quantity double, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "part": "p_partkey bigint, p_size int",
    "events": "ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}


def read_star(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(STAR_SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def readings_from_events(events: DataFrame, *keep: str) -> DataFrame:
    """One machine per user, beside the event columns in ``keep``; batch or stream."""
    k = "CAST(get_json_object(props, '$.k') AS int)"
    return events.selectExpr(
        *keep,
        "concat('M-', user_id) AS machine_id",
        "60.0D + least(value, 350.0D) / 10.0D AS temperature",
        f"0.01D + {k} / 1000.0D AS vibration",
        f"1000 + 6 * {k} AS rpm",
        "ts AS created_at",
    )


def from_star(spark: SparkSession, sf_dir: str) -> Sources:
    def table(name: str, *columns: str):
        return lambda: read_star(spark, sf_dir, name).selectExpr(*columns)

    def bom_detail() -> DataFrame:
        """Every product is built from three parts, spread over the whole part table."""
        part = read_star(spark, sf_dir, "part")
        slots = part.selectExpr("p_partkey", "explode(array(0, 1, 2)) AS k")
        return slots.withColumn("n", part.agg(F.count("*")).scalar()).selectExpr(
            "p_partkey AS bom_id",
            "concat('PART-', (p_partkey * 7 + k * 13) % n) AS part_no",
            "CAST(1 + (p_partkey + k) % 4 AS int) AS qty",
        )

    return Sources(
        orders=table(
            "orders",
            "o_orderkey AS id",
            "o_orderdate AS created_at",
            "CASE WHEN o_orderstatus = 'P' THEN 'cancelled' ELSE 'completed' END AS status",
        ),
        order_items=table(
            "lineitem", "l_orderkey AS order_id", "l_partkey AS product_id", "CAST(l_quantity AS int) AS quantity"
        ),
        bom_header=table("part", "p_partkey AS bom_id", "CAST(p_partkey AS string) AS product_code"),
        bom_detail=bom_detail,
        parts=table(
            "part",
            "concat('PART-', p_partkey) AS part_no",
            "p_size AS stock_qty",
            "CAST(p_partkey % 20 AS int) AS safety_stock",
        ),
        purchase=table(
            "lineitem",
            "concat('PART-', l_partkey) AS part_no",
            "l_shipdate AS delivery_date",
            "CAST(l_quantity AS int) AS order_qty",
            "CASE WHEN l_linestatus = 'O' THEN 'pending' ELSE 'received' END AS status",
        ),
        machine_data=lambda: readings_from_events(read_star(spark, sf_dir, "events")),
    )
