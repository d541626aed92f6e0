"""Fleet-wide figures over the window table, and the latest status per panel."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sunmeter.functions.columns import bucket_start, window_hours
from sunmeter.operators.lookup import around
from sunmeter.operators.windows import panel_power
from sunmeter.schema import (
    EVENT_TIME, HISTOGRAM_OFFSET, PANEL, POWER, STATUS, WINDOW_DURATION, WINDOW_END, WINDOW_POWER,
    WINDOW_START,
)
from sunmeter.session import scratch

LEAST_DIGIT = -9  # smaller values are counted in cells of 1e-9


def fleet_power(windows: DataFrame) -> DataFrame:
    """A2: power of all panels together per window; an absent panel adds nothing."""
    return windows.groupBy(WINDOW_END).agg(F.sum(WINDOW_POWER).alias(WINDOW_POWER))


def fleet_energy(windows: DataFrame) -> DataFrame:
    """A3: Wh of the fleet per window, by the window's own length."""
    hours = window_hours(F.min(WINDOW_START), F.col(WINDOW_END))
    return windows.groupBy(WINDOW_END).agg(
        (F.sum(WINDOW_POWER) * hours).alias("energy_wh"))


def fleet_energy_closed(readings: DataFrame, duration: str = WINDOW_DURATION) -> DataFrame:
    """A2, A3 on a stream: Wh of the fleet per window, once, when the watermark has passed it.

    Two aggregates in a row: the mean of each panel's window, then the sum over the panels.
    The window of the first is the event time of the second, which gets a window's
    rows when it closes.  ``readings`` have a watermark; append mode only.
    """
    means = readings.groupBy(F.window(EVENT_TIME, duration).alias("of_panel"), PANEL).agg(
        F.avg(F.col(POWER).cast("double")).alias(WINDOW_POWER))
    fleet = means.groupBy(F.window(F.window_time("of_panel"), duration).alias("of_fleet")).agg(
        F.sum(WINDOW_POWER).alias(WINDOW_POWER))
    hours = window_hours(F.col("of_fleet.start"), F.col("of_fleet.end"))
    return fleet.select(
        F.col("of_fleet.end").alias(WINDOW_END), (F.col(WINDOW_POWER) * hours).alias("energy_wh"))


def total_energy(windows: DataFrame) -> DataFrame:
    """A4: Wh over all panels and windows.

    The sum over time of the per-window sums is the sum over all rows, so no
    shuffle by window is needed: one partial sum per task.
    """
    hours = window_hours(F.col(WINDOW_START), F.col(WINDOW_END))
    return windows.agg(F.sum(F.col(WINDOW_POWER) * hours).alias("energy_wh"))


def fleet_power_around(
    readings: DataFrame, as_of: str, back: str = "4 hours", ahead: str = "1 hour",
    duration: str = WINDOW_DURATION,
) -> DataFrame:
    """F3 on A2: the fleet power of the windows that end in a range of time.

    The readings are filtered too, by the range and one window before it, so the
    scan skips what lies outside.
    """
    near = around(readings, as_of, f"{back} {duration}", ahead)
    return fleet_power(around(panel_power(near, duration), as_of, back, ahead, WINDOW_END))


def latest_fleet_power(readings: DataFrame, duration: str = WINDOW_DURATION) -> DataFrame:
    """The fleet power of the last window; no row without timed readings.

    The last time, one value of each task, tells the window, and only readings
    from its start on are summed up: all others are skipped by the scan.
    """
    start = readings.agg(F.max(F.window(EVENT_TIME, duration)["start"]).cast(
        readings.schema[EVENT_TIME].dataType).cast("string")).first()[0]
    if start is None:
        return fleet_power(panel_power(readings.limit(0), duration))
    first = F.lit(start).cast(readings.schema[EVENT_TIME].dataType)
    return fleet_power(panel_power(readings.filter(F.col(EVENT_TIME) >= first), duration))


def latest_status(readings: DataFrame, order: str) -> DataFrame:
    """A5: last non-NULL status per panel by ``order``, the ingest order as a rule.

    Event time is a poor order: panel clocks run ahead of heartbeats, so an
    offline panel would look active for that long (D4).  A single number or
    time as order keeps the aggregate hash based, one row per panel and task.
    """
    return readings.filter(F.col(STATUS).isNotNull()).groupBy(PANEL).agg(
        F.max_by(STATUS, order).alias(STATUS)
    )


def latest_per_partition(readings: DataFrame) -> DataFrame:
    """A5, first step: the last status of each panel in each partition of the topic.

    Offsets order a partition, so plain numbers are compared.  As a stream this is
    the state to keep: one row per panel and partition.
    """
    return readings.filter(F.col(STATUS).isNotNull()).groupBy(PANEL, "partition").agg(
        F.max_by(STATUS, "offset").alias(STATUS),
        F.max_by("timestamp", "offset").alias("timestamp"),
        F.max("offset").alias("offset"),
    )


def latest_of_partitions(last: DataFrame) -> DataFrame:
    """A5, second step: of a panel's partitions the one with the newest broker time.

    Offsets don't compare across partitions: the order is broker time, partition,
    offset (D4).
    """
    ingest_order = F.struct("timestamp", "partition", "offset")
    return last.groupBy(PANEL).agg(F.max_by(STATUS, ingest_order).alias(STATUS))


def latest_status_of_topic(readings: DataFrame) -> DataFrame:
    """A5 in the order of a topic: broker time, partition, offset.

    Only the last rows of a panel per partition are compared by all three; a max
    over structs of all rows would have to sort them.
    """
    return latest_of_partitions(latest_per_partition(readings))


def power_histogram(
    windows: DataFrame,
    width: float = 20.0,
    offset: float = HISTOGRAM_OFFSET,
    combine: bool = False,
) -> DataFrame:
    """Number of window values per bucket, per panel or for all (``combine``)."""
    keys = [] if combine else [PANEL]
    bucket = bucket_start(F.col(WINDOW_POWER), width, offset).alias("bucket_start")
    known = windows.filter(F.col(WINDOW_POWER).isNotNull())
    return known.select(*keys, bucket).groupBy(*keys, "bucket_start").agg(
        F.count(F.lit(1)).alias("windows")
    )


def nice_width(span: float, buckets: int) -> float:
    """The smallest of 1, 2 and 5 times a power of ten that covers ``span`` in so many steps."""
    least = span / buckets
    if least <= 0:
        return 1.0
    power = 10.0 ** math.floor(math.log10(least))
    return next(step * power for step in (1.0, 2.0, 5.0, 10.0) if least <= step * power)


def power_histogram_auto(
    windows: DataFrame, buckets: int = 30, combine: bool = False,
) -> DataFrame:
    """A7 with a width that follows the data: about so many buckets over the range of values.

    One pass over the windows.  It counts values by their first three digits, cells
    whose widths are powers of ten, and notes the least and the greatest value.  These
    tell the width (``nice_width``), of which each cell then lies in one bucket; buckets
    begin at its multiples.  Cells are some hundreds a panel, however many windows
    there are.  Only where all values are within about a hundredth of their size are the cells
    too wide, and the windows are read once more.
    """
    keys = [] if combine else [PANEL]
    value = F.col(WINDOW_POWER)
    known = windows.filter(value.isNotNull()).select(*keys, WINDOW_POWER)
    digits = F.when(value == 0, F.lit(LEAST_DIGIT)).otherwise(F.greatest(
        F.floor(F.log10(F.abs(value))) - 2, F.lit(LEAST_DIGIT)))
    wide = F.col("digit") >= 0
    scale = F.pow(F.lit(10.0), F.abs("digit"))
    cell = F.floor(F.when(wide, value / scale).otherwise(value * scale))
    counted = known.withColumn("digit", digits).withColumn("cell", cell).groupBy(
        *keys, "digit", "cell").agg(
        F.count(F.lit(1)).alias("windows"), F.min(value).alias("least"), F.max(value).alias("most"))
    path = scratch(windows.sparkSession, "cells")
    counted.write.parquet(path)
    cells = windows.sparkSession.read.schema(counted.schema).parquet(path)
    found = cells.agg(F.min("least"), F.max("most"), F.max("digit")).first()
    width = nice_width(found[1] - found[0], buckets) if found[0] is not None else 1.0
    power = math.floor(math.log10(width) + 1e-9)
    if found[2] is not None and found[2] > power:
        return power_histogram(known, width, 0.0, combine).withColumn("width", F.lit(width))
    cells_a_bucket = round(width / 10.0 ** power) * F.pow(F.lit(10.0), power - F.col("digit"))
    return cells.groupBy(*keys, (F.floor(F.col("cell") / cells_a_bucket) * width).alias(
        "bucket_start")).agg(F.sum("windows").alias("windows")).withColumn("width", F.lit(width))


def panels_wide(windows: DataFrame, panels: Sequence[str]) -> DataFrame:
    """R2: one row per window end, a column for each listed panel, aligned on time.

    The power of all panels not listed is in ``other_panels``, so each row still
    adds up to the fleet power.  One pass with conditional aggregates: the list
    sets the number of columns, so keep it to what a chart can show.
    """
    panel = F.col(PANEL)
    columns = [
        F.max(F.when(panel == name, F.col(WINDOW_POWER))).alias(f"panel_{name}")
        for name in panels
    ]
    others = F.sum(F.when(~panel.isin(*panels), F.col(WINDOW_POWER))).alias("other_panels")
    return windows.groupBy(WINDOW_END).agg(*columns, others)
