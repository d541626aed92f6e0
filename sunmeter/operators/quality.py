"""Valid rows, rejects and the stored form of a reading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sunmeter.functions.columns import stored_power
from sunmeter.schema import (
    BROKER_TIME, CLOCK_AHEAD, EVENT_TIME, PANEL, PANEL_LENGTH, POWER, POWER_PRECISION, POWER_SCALE, STATUS,
    WATERMARK_DELAY,
)

POWER_BOUND = float(10 ** (POWER_PRECISION - POWER_SCALE))


def is_timed() -> Column:
    """A reading that windows can take: panel and time known."""
    return F.col(PANEL).isNotNull() & F.col(EVENT_TIME).isNotNull()


def is_valid() -> Column:
    """A reading the raw table can hold: timed, id and power in range."""
    storable = (F.length(PANEL) <= PANEL_LENGTH) & (F.abs(POWER) < F.lit(POWER_BOUND))
    return is_timed() & storable


def with_arrival(messages: DataFrame) -> DataFrame:
    """Messages whose ``timestamp`` no producer's clock can have set ahead.

    By default a topic's timestamps are the producers', and a panel whose clock is
    wrong stamps both its reading and its message.  So only a timestamp that the broker
    set (``timestampType``) counts as it is; any other is cut at the time the batch
    is processed, which Spark keeps with the batch, so a batch that is tried again
    cuts alike.  Two queries take a message at different times: what a producer stamps
    ahead may pass the one by the pause between them and fail the other.
    """
    now = F.current_timestamp()
    is_later = ~F.col("timestampType").eqNullSafe(BROKER_TIME) & (F.col("timestamp") > now)
    return messages.withColumn("timestamp", F.when(is_later, now).otherwise(F.col("timestamp")))


def is_ahead(ahead: str = CLOCK_AHEAD, arrival: str = "timestamp") -> Column:
    """A reading stamped further ahead of its arrival (``with_arrival``) than clocks run.

    One such stamp would move the watermark of all panels, for good; so these rows
    are rejects, kept with their text, and reach no stream that has a watermark.
    A row without a stamp or an arrival is not ahead.
    """
    limit = F.col(arrival) + F.expr(f"INTERVAL '{ahead}'")
    return F.coalesce(F.col(EVENT_TIME) > limit, F.lit(False))


def is_late(ahead: str = CLOCK_AHEAD, delay: str = WATERMARK_DELAY) -> Column:
    """A reading that a watermark may have passed before it arrived.

    The watermark is ``delay`` behind the newest stamp, which is ``ahead`` of its
    arrival at most; so only rows that arrive later than the difference can have been dropped.
    """
    earliest = F.col("timestamp") + F.expr(f"INTERVAL '{ahead}'") - F.expr(f"INTERVAL '{delay}'")
    return F.col(EVENT_TIME) < earliest


def is_reject() -> Column:
    """The complement of ``is_valid``; an unknown (NULL) power is a reject too."""
    return ~F.coalesce(is_valid(), F.lit(False))


def split_valid(decoded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """the storable rows and the rest; every row is in exactly one of them."""
    return decoded.filter(is_valid()), decoded.filter(is_reject())


def to_raw(readings: DataFrame, whole_seconds: bool = False) -> DataFrame:
    """Readings as the raw table stores them.

    ``whole_seconds`` rounds the time to seconds, as a table whose timestamps
    hold no fraction would.
    """
    time = F.col(EVENT_TIME)
    if whole_seconds:
        time = F.date_trunc("second", time + F.expr("INTERVAL '0.5' SECOND"))
    return readings.select(
        PANEL, stored_power(F.col(POWER)).alias(POWER), STATUS, time.alias(EVENT_TIME),
    )
