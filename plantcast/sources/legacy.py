"""The older physical table and column names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Physical names and the pending status of the older database.
TABLE_NAMES = {
    "bom主檔": "bom_header",
    "bom明細": "bom_detail",
    "零件": "parts",
    "purchase": "purchase",
}
COLUMN_NAMES = {
    "bom_header": {"英文編碼": "product_code"},
    "bom_detail": {"圖號": "part_no", "需求數量": "qty"},
    "parts": {"圖號": "part_no", "數量": "stock_qty", "安全量": "safety_stock"},
    "purchase": {
        "圖號": "part_no",
        "交貨日期": "delivery_date",
        "叫貨數量": "order_qty",
        "到貨狀態": "status",
    },
}
PENDING_STATUS = "未到貨"


class Names:
    """Physical names of tables and columns, and what they are called here; further ones are left alone."""

    def __init__(
        self,
        tables: dict[str, str] = TABLE_NAMES,
        columns: dict[str, dict[str, str]] = COLUMN_NAMES,
        pending: str = PENDING_STATUS,
    ) -> None:
        """Both map physical to logical names, columns by logical table."""
        self._tables = {logical: physical for physical, logical in tables.items()}
        self._columns = columns
        self._pending = pending

    def table(self, name: str) -> str:
        return self._tables.get(name, name)

    def column(self, table: str, name: str) -> str:
        physical = {logical: p for p, logical in self._columns.get(table, {}).items()}
        return physical.get(name, name)

    def logical(self, table: str, df: DataFrame) -> DataFrame:
        """A physical table under its logical names."""
        df = df.withColumnsRenamed(self._columns.get(table, {}))
        if table == "purchase":
            status = F.when(F.col("status") == self._pending, "pending").otherwise(F.col("status"))
            df = df.withColumn("status", status)
        return df

    def physical(self, table: str, df: DataFrame) -> DataFrame:
        """The way back, for writing a table as the older database has it."""
        if table == "purchase":
            status = F.when(F.lower("status") == "pending", self._pending).otherwise(F.col("status"))
            df = df.withColumn("status", status)
        return df.withColumnsRenamed({logical: p for p, logical in self._columns.get(table, {}).items()})


def adapt_table(name: str, df: DataFrame) -> DataFrame:
    """Logical form of one physical table; other tables pass through."""
    return Names().logical(TABLE_NAMES.get(name, name), df)


def adapt_tables(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    return {TABLE_NAMES.get(name, name): adapt_table(name, df) for name, df in tables.items()}
