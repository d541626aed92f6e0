"""Tumbling-window mean power per panel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sunmeter.schema import (
    EVENT_TIME, PANEL, POWER, POWER_SUM, READINGS, STATUS, STATUS_ACTIVE, THROUGH,
    WATERMARK_DELAY, WINDOW_DURATION, WINDOW_END, WINDOW_POWER, WINDOW_START,
)


def panel_power(readings: DataFrame, duration: str = WINDOW_DURATION) -> DataFrame:
    """Mean power per panel and epoch-aligned window.

    The mean is summed up before the shuffle, so a panel or window that holds
    most of the rows sends one row per task.  Rows without a time fall out (F2).
    Takes decoded readings and rows of the raw table alike.
    """
    mean = F.avg(F.col(POWER).cast("double")).alias(WINDOW_POWER)
    window = F.window(EVENT_TIME, duration)
    if readings.isStreaming:  # the watermark frees state by the whole window
        per_window = readings.groupBy(window, PANEL).agg(mean)
        start, end = F.col("window.start"), F.col("window.end")
    else:  # the start alone is a key of 8 bytes
        start = F.col(WINDOW_START)
        end = start + F.expr(f"INTERVAL '{duration}'")
        timed = readings.select(PANEL, POWER, window.start.alias(WINDOW_START))
        per_window = timed.groupBy(WINDOW_START, PANEL).agg(mean)
    return per_window.select(
        PANEL, WINDOW_POWER, start.alias(WINDOW_START), end.alias(WINDOW_END),
    )


def power_parts(readings: DataFrame, duration: str = WINDOW_DURATION) -> DataFrame:
    """T4: what the readings add to each panel's windows, by partition of the topic.

    Sums and counts instead of means: parts of the same window from any two batches
    are added up (``merged_parts``), however late the second one comes.  ``readings``
    carry ``partition`` and ``offset``.
    """
    power = F.col(POWER).cast("double")
    timed = readings.select(
        PANEL, power.alias(POWER), "partition", "offset",
        F.window(EVENT_TIME, duration).start.alias(WINDOW_START))
    return timed.groupBy(PANEL, WINDOW_START, "partition").agg(
        F.sum(POWER).alias(POWER_SUM), F.count(POWER).alias(READINGS),
        F.max("offset").alias(THROUGH))


def merged_parts(parts: DataFrame, *latest: str) -> DataFrame:
    """One part per panel, window and partition; of columns ``latest`` the largest value."""
    return parts.groupBy(PANEL, WINDOW_START, "partition").agg(
        F.sum(POWER_SUM).alias(POWER_SUM), F.sum(READINGS).alias(READINGS),
        *[F.max(name).alias(name) for name in (THROUGH, *latest)])


def power_of_parts(parts: DataFrame, duration: str = WINDOW_DURATION) -> DataFrame:
    """A1: mean power per panel and window from parts, merged or not."""
    total, n = F.sum(POWER_SUM), F.sum(READINGS)
    start = F.col(WINDOW_START)
    return parts.groupBy(PANEL, WINDOW_START).agg(
        F.try_divide(total, n).alias(WINDOW_POWER)).select(
        PANEL, WINDOW_POWER, WINDOW_START,
        (start + F.expr(f"INTERVAL '{duration}'")).alias(WINDOW_END))


def with_lateness(readings: DataFrame, delay: str = WATERMARK_DELAY) -> DataFrame:
    """Watermark on the column the windows are built on, so state is freed."""
    return readings.withWatermark(EVENT_TIME, delay)


def once_each(
    readings: DataFrame, delay: str = WATERMARK_DELAY,
    keys: Sequence[str] = (PANEL, EVENT_TIME, POWER, STATUS),
) -> DataFrame:
    """Each reading once, though its producer sends it again.

    A reading is known again for ``delay`` after its stamp, by the newest stamp; what comes
    later is dropped as late, seen before or not.  So the state holds the readings
    of that time only.  Two readings of one stamp that differ are two.
    """
    return readings.withWatermark(EVENT_TIME, delay).dropDuplicatesWithinWatermark(list(keys))


def with_two_clocks(readings: DataFrame, delay: str = WINDOW_DURATION) -> DataFrame:
    """A watermark for active panels and one for heartbeats, whose clocks are apart.

    Each follows its own stamps, ``delay`` behind the newest; a window is closed when
    both have passed it (the ``min`` policy, which is Spark's own).  So neither makes the
    other's readings late, however far apart they are; where one of them falls
    silent, windows stay open until it sends again.
    """
    def watermarked(is_active: Column) -> DataFrame:
        return readings.filter(is_active).withWatermark(EVENT_TIME, delay)

    active = F.col(STATUS).eqNullSafe(STATUS_ACTIVE)
    return watermarked(active).unionByName(watermarked(~active))


def latest_emission(updates: DataFrame, order: str = "batch_id", keep: bool = False) -> DataFrame:
    """D3: the newest value of each window among all that update mode emitted.

    With ``keep`` the rows still carry ``order``, so they can be merged again.
    """
    newest = updates.groupBy(PANEL, WINDOW_START, WINDOW_END).agg(
        F.max_by(WINDOW_POWER, order).alias(WINDOW_POWER), F.max(order).alias(order))
    columns = [PANEL, WINDOW_POWER, WINDOW_START, WINDOW_END]
    return newest.select(*columns, order) if keep else newest.select(*columns)
