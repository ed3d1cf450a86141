"""Input tables: declared schemas, Parquet and JDBC readers."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from plantcast.sources.legacy import Names

SCHEMAS = {
    "orders": "id int, created_at timestamp_ntz, status string",
    "order_items": "id int, order_id int, product_id int, quantity int",
    "bom_header": "bom_id int, product_code string",
    "bom_detail": "id int, bom_id int, part_no string, qty int",
    "parts": "part_no string, stock_qty int, safety_stock int",
    "purchase": "id int, part_no string, delivery_date date, order_qty int, status string",
    "machine_data": "id int, machine_id string, temperature decimal(6,2), vibration decimal(8,4), "
    "rpm int, created_at timestamp_ntz",
}

# Tables that some stores offer beside the seven: readings by day, counted when they were stored, and the demand of
# every day and product, summed when its order lines were stored.
OPTIONAL = {
    "reading_days": "reading_date date, readings bigint",
    "daily_demand": "order_date date, product_id bigint, qty bigint",
}

# Column by which a table is cut into JDBC partitions; parts has a text key only.
SPLIT_COLUMN = {
    "orders": "id",
    "order_items": "id",
    "bom_header": "bom_id",
    "bom_detail": "id",
    "purchase": "id",
    "machine_data": "id",
}


class Sources:
    """The seven logical input tables, each read when it is first used; an optional one may be None."""

    def __init__(self, **tables: DataFrame | Callable[[], DataFrame]) -> None:
        missing = SCHEMAS.keys() - tables.keys()
        if missing or tables.keys() - SCHEMAS.keys() - OPTIONAL.keys():
            raise TypeError(f"expected the tables {', '.join(SCHEMAS)}")
        self._tables = tables

    def __getattr__(self, name: str) -> DataFrame:
        if name in OPTIONAL and name not in self._tables:
            return None
        if name.startswith("_") or name not in self._tables:
            raise AttributeError(name)
        table = self._tables[name]
        if not isinstance(table, DataFrame):
            table = self._tables[name] = table()
        return table

    def replaced(self, **tables: DataFrame | Callable[[], DataFrame]) -> Sources:
        """The same inputs with some tables exchanged."""
        return Sources(**{**self._tables, **tables})


def declared_columns(table: str) -> list[tuple[str, str]]:
    """Names and types of a table's columns."""
    return [tuple(c.split(" ", 1)) for c in SCHEMAS[table].split(", ")]


# Columns that stored layouts add as folders.
LAYOUT_COLUMNS = {"order_date": "date", "load": "int", "reading_date": "date", "batch_id": "bigint"}


def _layout(spark: SparkSession, path: str) -> list[str]:
    """Names of the partition columns below ``path``, from its folders' names."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names: list[str] = []
    while files.exists(folder):
        inside = [s.getPath() for s in files.listStatus(folder) if s.isDirectory() and "=" in s.getPath().getName()]
        if not inside:
            break
        names.append(inside[0].getName().split("=")[0])
        folder = inside[0]
    return names


def stored_table(spark: SparkSession, root: str, name: str, names: Names | None = None) -> DataFrame:
    """One table in its declared schema: no file is opened to learn it, and an empty folder is an empty table.

    ``names`` are the physical names of an older database. They are exchanged right at the scan, so
    filters and the choice of columns reach the files. Whole numbers of either width fit; a file whose types do not fit stops the query that meets it.
    """
    folder = names.table(name) if names else name
    layout = [f"{c} {LAYOUT_COLUMNS.get(c, 'string')}" for c in _layout(spark, f"{root}/{folder}")]
    wide = {"int": "bigint"}
    declared = [f"`{names.column(name, c) if names else c}` {wide.get(t, t)}" for c, t in declared_columns(name)]
    read = spark.read.schema(", ".join([*declared, *layout])).parquet(f"{root}/{folder}")
    return names.logical(name, read) if names else read


def from_parquet(spark: SparkSession, root: str, names: Names | None = None) -> Sources:
    """Read ``root/<table>``; partition columns of the stored layout are picked up."""
    return Sources(**{name: partial(stored_table, spark, root, name, names) for name in SCHEMAS})


def hash_slices(column: str, slices: int) -> list[str]:
    """Predicates that cut a text-keyed MySQL table into disjoint slices covering every row."""
    parts = [f"MOD(CRC32({column}), {slices}) = {i}" for i in range(slices)]
    parts[0] += f" OR {column} IS NULL"
    return parts


def jdbc_table(
    spark: SparkSession,
    url: str,
    table: str,
    properties: dict[str, str] | None = None,
    slices: int = 64,
    physical_name: str | None = None,
    names: Names | None = None,
) -> DataFrame:
    """Read one table over ``slices`` parallel connections.

    Spark pushes filters and the choice of columns into the database. With ``names`` the table has the
    physical names of an older database; slices are cut on the physical key, and filters on logical
    columns reach the physical ones.
    """
    name = physical_name or (names.table(table) if names else table)
    logical = partial(names.logical, table) if names else lambda df: df
    key = names.column(table, "part_no") if names else "part_no"
    properties = dict(properties or {})
    split = SPLIT_COLUMN.get(table)
    if split is None:
        return logical(spark.read.jdbc(url, name, predicates=hash_slices(key, slices), properties=properties))
    ends = (
        spark.read.format("jdbc")
        .options(url=url, query=f"SELECT MIN({split}) AS lo, MAX({split}) AS hi FROM {name}", **properties)
        .load()
        .first()
    )
    lo, hi = (ends[0] or 0), (ends[1] or 0)
    return logical(
        spark.read.jdbc(
            url,
            name,
            column=split,
            lowerBound=int(lo),
            upperBound=int(hi) + 1,
            numPartitions=max(1, min(slices, int(hi) + 1 - int(lo))),
            properties={"preferTimestampNTZ": "true", **properties},
        )
    )


def from_jdbc(
    spark: SparkSession,
    orders_url: str,
    erp_url: str,
    orders_properties: dict[str, str] | None = None,
    erp_properties: dict[str, str] | None = None,
    slices: int = 64,
    erp_names: Names | None = None,
) -> Sources:
    """Order tables from one database, materials and telemetry from another, which may have older names."""
    shop = ("orders", "order_items")
    return Sources(
        **{t: partial(jdbc_table, spark, orders_url, t, orders_properties, slices) for t in shop},
        **{
            t: partial(jdbc_table, spark, erp_url, t, erp_properties, slices, names=erp_names)
            for t in SCHEMAS
            if t not in shop
        },
    )
