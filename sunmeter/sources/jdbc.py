"""Relational tables over JDBC, reading and writing.

Addresses and credentials come from the caller only (D10).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sunmeter.schema import PANEL_LENGTH, POWER_PRECISION, POWER_SCALE, RAW_TABLE

# K7: column types of the raw table where the writer creates it.
RAW_COLUMN_TYPES = (
    f"Panel_id VARCHAR({PANEL_LENGTH}), "
    f"power_panel DECIMAL({POWER_PRECISION},{POWER_SCALE}), "
    "current_status INT, time_data TIMESTAMP"
)


def table_options(url: str, table: str, **more: str | int) -> dict[str, str]:
    """S3: options for one table; ``more`` takes driver, user, password and sizes."""
    return {"url": url, "dbtable": table} | {name: str(value) for name, value in more.items()}


def ranged(
    options: dict[str, str], column: str, lower: str, upper: str, connections: int,
) -> dict[str, str]:
    """Read in ``connections`` ranges of ``column``; without it one task reads all."""
    return options | {
        "partitionColumn": column,
        "lowerBound": lower,
        "upperBound": upper,
        "numPartitions": str(connections),
    }


def read_table(spark: SparkSession, options: dict[str, str]) -> DataFrame:
    """Filters and the column list are pushed into the database's query."""
    return spark.read.format("jdbc").options(**options).load()


def raw_table_options(url: str, table: str = RAW_TABLE, **more: str | int) -> dict[str, str]:
    """K7: writer options for the raw table; where it is absent it is made with its types."""
    return table_options(url, table, **more) | {"createTableColumnTypes": RAW_COLUMN_TYPES}


def append_batches(
    options: dict[str, str], batch_column: str | None = None,
) -> Callable[[DataFrame, int], None]:
    """A per-batch callback that appends to a table, with its columns only.

    JDBC appends are at least once: a batch that is tried again is appended
    again.  A table that has a column for it can keep the batch's number in
    ``batch_column``, by which readers tell repeats; for window updates the newest
    value of a window is then the same whether or not it was appended twice.
    """
    def append(batch: DataFrame, batch_id: int) -> None:
        if batch_column:
            batch = batch.withColumn(batch_column, F.lit(batch_id).cast("long"))
        batch.write.format("jdbc").options(**options).mode("append").save()

    return append
