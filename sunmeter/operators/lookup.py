"""Single-panel lookup and time range."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sunmeter.functions.columns import second_text
from sunmeter.schema import EVENT_TIME, PANEL, POWER, STATUS

BACK, AHEAD = timedelta(hours=4), timedelta(hours=1)


def panel_rows(raw: DataFrame, panel: str) -> DataFrame:
    """All stored readings of one panel; none for an unknown id."""
    return raw.filter(F.col(PANEL) == F.lit(panel)).select(
        PANEL, POWER, STATUS, second_text(F.col(EVENT_TIME)).alias(EVENT_TIME),
    )


def panel_rows_json(raw: DataFrame, panel: str) -> DataFrame:
    """K6: the lookup as JSON objects, one per row; the power is exact, hence text.

    A panel may own any share of the table, so the objects are not gathered
    into one array here: writers put the brackets around the stream of rows.
    """
    fields = F.struct(PANEL, STATUS, F.col(POWER).cast("string").alias(POWER), EVENT_TIME)
    return panel_rows(raw, panel).select(F.to_json(fields).alias("reading"))


def days_around(as_of: str, back: timedelta = BACK, ahead: timedelta = AHEAD) -> set[date]:
    """The days of the rows from ``back`` before to ``ahead`` after ``as_of``."""
    now = datetime.fromisoformat(as_of)
    first, last = (now - back).date(), (now + ahead).date()
    return {first + timedelta(days=k) for k in range((last - first).days + 1)}


def around(
    readings: DataFrame,
    as_of: str,
    back: str = "4 hours",
    ahead: str = "1 hour",
    time: str = EVENT_TIME,
) -> DataFrame:
    """rows from ``back`` before to ``ahead`` after ``as_of``.

    The bounds take the type of the column, so the comparison reaches the scan;
    a table with a ``day`` column is pruned to the days touched, and one more on
    either side, as the day may be that of a window's other end.
    """
    now = F.lit(as_of).cast(readings.schema[time].dataType)
    low = now - F.expr(f"INTERVAL '{back}'")
    high = now + F.expr(f"INTERVAL '{ahead}'")
    rows = readings.filter(F.col(time).between(low, high))
    if "day" in readings.columns:
        days = F.date_sub(F.to_date(low), 1), F.date_add(F.to_date(high), 1)
        rows = rows.filter(F.col("day").between(*days))
    return rows
