"""Ordered time series, whole or limited."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sunmeter.operators.windows import panel_power
from sunmeter.schema import (
    EVENT_TIME, PANEL, POWER, WINDOW_DURATION, WINDOW_END, WINDOW_POWER,
)
from sunmeter.session import scratch

PLACE, INPUT = "series_place", "series_input"
PARTITION_BITS = 33  # of a row's number within its partition


def panel_series(raw: DataFrame, limit: int | None = None) -> DataFrame:
    """Power over time, long form: the panel id tells the series apart.

    With ``limit`` the first rows only, by time, panel and power.
    """
    rows = raw.select(EVENT_TIME, POWER, PANEL)
    return rows if limit is None else first_rows(rows, limit, EVENT_TIME, PANEL, POWER)


def window_series(windows: DataFrame, limit: int | None = None) -> DataFrame:
    """Window power over time, long form; with ``limit`` the first rows only."""
    rows = windows.select(WINDOW_END, WINDOW_POWER, PANEL)
    return rows if limit is None else first_rows(rows, limit, WINDOW_END, PANEL, WINDOW_POWER)


def first_windows(
    readings: DataFrame, limit: int, duration: str = WINDOW_DURATION,
) -> DataFrame:
    """The first ``limit`` rows of the window series, straight from the readings.

    The windows are first counted by the hour they end in, from panels and times alone.
    Then only the readings up to the hour in which the limit falls are read, by a bound
    on their stored time, and their windows computed and stored, once.
    """
    end = F.window(EVENT_TIME, duration)["end"]
    ends = readings.select(PANEL, end.alias(WINDOW_END)).distinct()
    cut = _cut(ends, F.date_trunc("hour", WINDOW_END), limit)
    near = readings
    if cut is not None:
        past = F.lit(cut["bucket"]).cast(readings.schema[EVENT_TIME].dataType) + F.expr(
            "INTERVAL '1' HOUR")
        near = readings.filter(F.col(EVENT_TIME) < past)
    rows = window_series(panel_power(near, duration))
    if cut is None:
        return rows
    rows = rows.filter(F.col(WINDOW_END) < past)
    path = scratch(readings.sparkSession, "first-windows")
    rows.write.parquet(path)
    return window_series(readings.sparkSession.read.schema(rows.schema).parquet(path), limit)


def first_rows(rows: DataFrame, limit: int, time: str, *ties: str) -> DataFrame:
    """L1: the first ``limit`` rows by ``(time, *ties)``, as a set; NULL times last.

    ``orderBy().limit(n)`` sends up to n rows of every task to a single one,
    which a limit of millions over a large table does not survive.  Here the
    rows are counted per hour, and everything before the hour the limit falls
    in is kept by a filter, without sort or shuffle.  That hour is dealt out in
    order, each part numbered on its own and stored; the parts' sizes, one number
    each, tell which parts are kept whole and how much of the next.  Copies of a
    row are told apart by the task they came from, so even they are divided.
    ``time`` and ``ties`` must name all columns of ``rows``.
    """
    if set(rows.columns) != {time, *ties}:
        raise ValueError("time and ties must name all columns")
    hour = F.date_trunc("hour", time)
    cut = _cut(rows, hour, limit)
    if cut is None:  # the limit takes all
        return rows
    before, rest = _divide(rows, hour, time, cut["bucket"])
    return before.unionAll(_first_of(rest, limit - cut["before"], time, *ties))


def _first_of(rows: DataFrame, limit: int, time: str, *ties: str) -> DataFrame:
    """The first ``limit`` of ``rows``, which are more."""
    spark = rows.sparkSession
    order = [F.asc_nulls_last(name) for name in (time, *ties)]
    dealt = rows.withColumn(INPUT, F.spark_partition_id())
    numbered = dealt.repartitionByRange(*order, INPUT).sortWithinPartitions(
        *order, INPUT).withColumn(PLACE, F.monotonically_increasing_id())
    path = scratch(spark, "first-rows")
    numbered.write.parquet(path)
    stored = spark.read.schema(numbered.schema).parquet(path)
    part = F.shiftright(PLACE, PARTITION_BITS)
    sizes = {r["part"]: r["count"] for r in stored.groupBy(part.alias("part")).count().collect()}
    end = 0
    for number in sorted(sizes):
        end = (number << PARTITION_BITS) + min(limit, sizes[number])
        limit -= min(limit, sizes[number])
        if not limit:
            break
    return stored.filter(F.col(PLACE) < end).select(*rows.columns)


def _cut(rows: DataFrame, key: Column, limit: int):
    """The bucket of ``key`` the limit falls in; None if no row is cut off.

    The running sum goes over one row per bucket, not over the rows.
    """
    in_order = Window.orderBy(F.asc_nulls_last("bucket")).rowsBetween(
        Window.unboundedPreceding, 0)
    counts = rows.groupBy(key.alias("bucket")).agg(F.count(F.lit(1)).alias("rows"))
    cuts = (
        counts.withColumn("upto", F.sum("rows").over(in_order))
        .filter(F.col("upto") > limit)
        .agg(
            F.min("upto").alias("upto"),
            F.min_by("rows", "upto").alias("rows"),
            F.min_by("bucket", "upto").cast("string").alias("bucket"),
        )
        .withColumn("before", F.col("upto") - F.col("rows"))
    )
    cut = cuts.first()
    return None if cut["upto"] is None else cut


def _divide(
    rows: DataFrame, key: Column, time: str, bucket: str | None,
) -> tuple[DataFrame, DataFrame]:
    """Rows before the cut hour and rows in it, as ranges of the time column itself."""
    if bucket is None:
        return rows.filter(key.isNotNull()), rows.filter(key.isNull())
    edge = F.lit(bucket).cast(rows.schema[time].dataType)
    past = edge + F.expr("INTERVAL '1' HOUR")
    column = F.col(time)
    return rows.filter(column < edge), rows.filter((column >= edge) & (column < past))
