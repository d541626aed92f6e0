"""Tables of raw readings, window power and status, written and read back."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sunmeter.functions.columns import stored_power, z_value
from sunmeter.operators.quality import is_ahead, is_reject, is_timed
from sunmeter.operators.windows import latest_emission, merged_parts
from sunmeter.schema import (
    CLOCK_AHEAD, EVENT_TIME, PANEL, PANEL_LENGTH, PARTS_SCHEMA, POWER, POWER_PRECISION,
    POWER_SCALE, RAW_SCHEMA, RAW_TABLE, STATUS, STATUS_SCHEMA, WINDOW_SCHEMA, WINDOW_START,
)
from sunmeter.sinks.folded import BATCH, Folded

VALID, REJECT = "valid", "reject"
MEASURED = "measured_power"  # the power as it was sent; the raw table's is rounded and bounded
NO_DAY = "1970-01-01"
DAY_SECONDS = 24 * 60 * 60

BY_KIND_SCHEMA = T.StructType([
    T.StructField("kind", T.StringType()),
    *RAW_SCHEMA.fields[:4],
    T.StructField("topic", T.StringType()),
    T.StructField("partition", T.IntegerType()),
    T.StructField("offset", T.LongType()),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("raw_value", T.StringType()),
    T.StructField(MEASURED, T.DoubleType()),
])


LEDGER_SCHEMA = T.StructType([
    *[T.StructField(name, T.LongType()) for name in (
        "batch", "read", "valid", "rejected", "late")],
    T.StructField("noted", T.TimestampType()),
])
FINAL_SCHEMA = T.StructType([*WINDOW_SCHEMA.fields, T.StructField("day", T.DateType())])


def create_raw_table(spark: SparkSession, name: str = RAW_TABLE, path: str | None = None) -> None:
    """K7: create the raw table if it is absent, by day; at ``path``, if given."""
    place = f"LOCATION '{path}'" if path else ""
    spark.sql(f"""
        CREATE TABLE IF NOT EXISTS {name} (
            Panel_id VARCHAR({PANEL_LENGTH}) NOT NULL,
            power_panel DECIMAL({POWER_PRECISION},{POWER_SCALE}) NOT NULL,
            current_status INT NOT NULL,
            time_data TIMESTAMP,
            day DATE
        ) USING parquet PARTITIONED BY (day) {place}
    """)


def with_day(rows: DataFrame, time: str = EVENT_TIME) -> DataFrame:
    return rows.withColumn("day", F.to_date(time))


def write_clustered(rows: DataFrame, path: str, time: str = EVENT_TIME) -> None:
    """A new table by day, within a day in order of panel and time; refuses a path in use.

    Range partitioning cuts by size: a day or a panel that holds much of the
    table is spread over many files, and small ones share a file.  The input
    partition is the last key, so that even copies of a single row are split.
    Sorted by panel, the row groups' minima and maxima let a lookup skip almost
    all.  The input is evaluated twice, once for the sample the ranges come from.
    """
    order = ["day", PANEL, time]
    (with_day(rows, time)
        .withColumn("input_partition", F.spark_partition_id())
        .repartitionByRange(*order, "input_partition")
        .drop("input_partition")
        .sortWithinPartitions(*order)
        .write.partitionBy("day").mode("errorifexists").parquet(path))


def by_kind(decoded: DataFrame, ahead: str = CLOCK_AHEAD) -> DataFrame:
    """Raw rows and rejects as one table: ``kind`` tells them apart, rejects keep their text."""
    kind = F.when(is_reject() | is_ahead(ahead), REJECT).otherwise(VALID)
    text = F.when(F.col("kind") == REJECT, F.col("raw_value"))
    return decoded.withColumn("kind", kind).select(
        "kind", PANEL, stored_power(F.col(POWER)).alias(POWER), STATUS, EVENT_TIME, "topic",
        "partition", "offset", "timestamp", text.alias("raw_value"), F.col(POWER).alias(MEASURED))


def _day_of(time: Column) -> Column:
    return F.coalesce(F.to_date(time), F.lit(NO_DAY).cast("date"))


def readings_table(spark: SparkSession, path: str) -> Folded:
    """K1: rows with panel and time by the day of their stamp, others by that of their arrival.

    So a day's windows are made of that day's files alone, rejects that they take included.
    """
    time = F.when(is_timed(), F.col(EVENT_TIME)).otherwise(F.col("timestamp"))
    return Folded(spark, path, BY_KIND_SCHEMA, _day_of(time),
                  order=("kind", panel_and_time(), PANEL, EVENT_TIME), looked_up=(PANEL,))


Z_BITS = 8


def panel_and_time() -> Column:
    """Z-order of panels, by a hash, and times within a day.

    A row group then holds some panels for some of the day: a range of time passes most
    row groups by through their least and greatest times, and a lookup of a
    panel through their Bloom filters, where an order by panel alone serves lookups only.
    """
    cells = 1 << Z_BITS
    panel = F.pmod(F.xxhash64(PANEL), F.lit(cells))
    second = F.coalesce(F.unix_seconds(EVENT_TIME), F.lit(0)) % DAY_SECONDS
    return z_value(panel, F.floor(second * cells / DAY_SECONDS), bits=Z_BITS)


def read_kind(rows: Folded, kind: str, days: Iterable[date] | None = None) -> DataFrame:
    return rows.read(days).filter(F.col("kind") == kind)


def read_raw(rows: Folded, days: Iterable[date] | None = None) -> DataFrame:
    """The raw readings of a readings table, all or those of ``days``."""
    return with_day(read_kind(rows, VALID, days).select(*RAW_SCHEMA.names[:4]))


def read_rejects(rows: Folded) -> DataFrame:
    """The rejects of a readings table, with where they came from."""
    return read_kind(rows, REJECT).select("topic", "partition", "offset", "raw_value")


def is_windowed(ahead: str = CLOCK_AHEAD) -> Column:
    """A row of a readings table that the windows take, whether the raw table can hold it or not."""
    return (F.col("kind") == VALID) | (is_timed() & ~is_ahead(ahead))


def read_timed(
    rows: Folded, ahead: str = CLOCK_AHEAD, days: Iterable[date] | None = None,
) -> DataFrame:
    """The readings that the windows take, with the power as it was sent; those of ``days``.

    Rows that were stored before that was kept have the raw table's power.
    """
    power = F.coalesce(MEASURED, F.col(POWER).cast("double"))
    return with_day(rows.read(days).filter(is_windowed(ahead)).select(
        PANEL, power.alias(POWER), EVENT_TIME))


def windows_table(spark: SparkSession, path: str) -> Folded:
    """K2: window power by the day a window starts, the newest value of each window."""
    def merge(rows: DataFrame) -> DataFrame:
        return latest_emission(rows, BATCH, keep=True)

    return Folded(spark, path, WINDOW_SCHEMA, _day_of(F.col(WINDOW_START)), merge,
                  (PANEL, WINDOW_START))


def parts_table(spark: SparkSession, path: str) -> Folded:
    """K2: what each batch added to the windows, by the day a window starts; added up when read."""
    def merge(rows: DataFrame) -> DataFrame:
        return merged_parts(rows, BATCH)

    return Folded(spark, path, PARTS_SCHEMA, _day_of(F.col(WINDOW_START)), merge,
                  (PANEL, WINDOW_START))


def ledger_table(spark: SparkSession, path: str) -> Folded:
    """A row per batch of the ingest, by the day it was noted."""
    return Folded(spark, path, LEDGER_SCHEMA, _day_of(F.col("noted")), order=("batch",))


def _newest_status(rows: DataFrame) -> DataFrame:
    return rows.groupBy(PANEL, "partition").agg(
        *[F.max_by(name, BATCH).alias(name) for name in (STATUS, "timestamp", "offset")],
        F.max(BATCH).alias(BATCH))


def status_table(spark: SparkSession, path: str) -> Folded:
    """A5: the last status of each panel per partition, all as one day."""
    return Folded(spark, path, STATUS_SCHEMA, F.lit(NO_DAY).cast("date"), _newest_status, (PANEL,))


def in_files(rows: DataFrame, files: int | None) -> DataFrame:
    """Rows gathered into ``files`` files; None leaves one for each task.

    A stateful stream has a task per state partition, whose output per batch is
    small: the extra shuffle moves that output only, the state stays put.
    """
    return rows if files is None else rows.repartition(files)
