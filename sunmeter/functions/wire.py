"""The JSON wire format of a reading, both ways."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sunmeter.functions.columns import wire_time
from sunmeter.schema import (
    EVENT_TIME, PANEL, POWER, READING_SCHEMA, STATUS, STATUS_ACTIVE, STATUS_OFFLINE,
)


def reading_json() -> Column:
    """JSON text of a reading, with numbers as numbers."""
    return F.to_json(F.struct(
        PANEL, POWER, STATUS, wire_time(F.col(EVENT_TIME)).alias(EVENT_TIME),
    ))


def heartbeat_json() -> Column:
    """JSON text of an offline heartbeat: the same fields, zeros sent as strings."""
    return F.to_json(F.struct(
        PANEL,
        F.lit("0").alias(POWER),
        F.lit("0").alias(STATUS),
        wire_time(F.col(EVENT_TIME)).alias(EVENT_TIME),
    ))


def encode(readings: DataFrame, heartbeats: bool = False, *keep: str) -> DataFrame:
    """K5: one keyed message per reading, ready for a message sink.

    With ``heartbeats``, offline readings take the heartbeat form.  Columns
    named in ``keep`` are carried along.
    """
    text = reading_json()
    if heartbeats:
        text = F.when(F.col(STATUS) == STATUS_OFFLINE, heartbeat_json()).otherwise(text)
    return readings.select(
        F.col(PANEL).cast("binary").alias("key"), text.cast("binary").alias("value"), *keep,
    )


def decode(messages: DataFrame, *keep: str, raw: bool = False) -> DataFrame:
    """Typed readings from message values; bad input never fails the job.

    Text that is no JSON, or lacks a field, gives NULLs; NULL numbers become 0,
    a NULL panel or time stays NULL (``split_valid`` takes those rows out).
    A quoted number does not parse as a number, so it also becomes 0.
    ``keep`` carries message columns along (ingest order), ``raw`` the text.

    The struct is unfolded by a generator, not by a projection: a later filter
    on the fields would be pushed into a projection and the text parsed again
    for every field the filter names.
    """
    text = F.col("value").cast("string")
    extra = [F.col(name) for name in keep]
    if raw:
        extra.append(text.alias("raw_value"))
    parsed = F.inline(F.array(F.from_json(text, READING_SCHEMA)))
    return messages.select(parsed, *extra).na.fill(0, subset=[POWER, STATUS])


def shift_event_time(
    readings: DataFrame, interval: str, status: int = STATUS_ACTIVE,
) -> DataFrame:
    """Move the event time of rows with ``status`` by ``interval`` ('-1 hour').

    For fleets whose active panels run their clocks ahead of the heartbeats.
    """
    moved = F.col(EVENT_TIME) + F.expr(f"INTERVAL '{interval}'")
    return readings.withColumn(
        EVENT_TIME, F.when(F.col(STATUS) == status, moved).otherwise(F.col(EVENT_TIME)),
    )
