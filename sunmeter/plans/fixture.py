"""The test tables seen as panel readings and as messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sunmeter.functions.wire import encode
from sunmeter.schema import EVENT_TIME, PANEL, POWER, STATUS, STATUS_ACTIVE, STATUS_OFFLINE, TOPIC
from sunmeter.session import prepare


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as readings: an error event is an offline panel.

    ``ingest_seq`` is the order of arrival.  The time stays without a zone, as
    the table has it, so ranges of it are compared on the stored column.
    """
    return to_readings(table(prepare(spark), sf_dir, "events"))


def to_readings(events: DataFrame) -> DataFrame:
    offline = F.col("event_type") == "error"
    return events.select(
        F.col("user_id").cast("string").alias(PANEL),
        F.when(offline, F.lit(0.0)).otherwise(F.col("value")).alias(POWER),
        F.when(offline, STATUS_OFFLINE).otherwise(STATUS_ACTIVE).alias(STATUS),
        F.col("ts").alias(EVENT_TIME),
        F.col("event_id").alias("ingest_seq"),
    )


def panel_readings(spark: SparkSession, sf_dir: str, panel: str) -> DataFrame:
    """The readings of one panel, compared in the type the id is stored in."""
    events = table(prepare(spark), sf_dir, "events")
    return to_readings(events.filter(
        F.col("user_id") == F.lit(panel).cast(events.schema["user_id"].dataType)))


def messages(
    rows: DataFrame, arrival: Column | None = None, partition: Column | None = None,
    offset: Column | None = None, stamped: Column | None = None,
) -> DataFrame:
    """Readings as the topic would hand them over, offline ones as heartbeats.

    ``stamped`` is the time on the message, where a producer's clock sets it.
    """
    arrival = F.col(EVENT_TIME) if arrival is None else arrival
    meta = rows.withColumns({
        "timestamp": (arrival if stamped is None else stamped).cast("timestamp"),
        "topic": F.lit(TOPIC),
        "partition": (F.lit(0) if partition is None else partition).cast("int"),
        "offset": F.col("ingest_seq") if offset is None else offset,
    }).withColumn(EVENT_TIME, F.col(EVENT_TIME).cast("timestamp"))
    return encode(meta, True, "topic", "partition", "offset", "timestamp")


BLOCK = 100


def moving_partition() -> dict[str, Column]:
    """Partition and offset where blocks of readings take turns on two partitions.

    So panels move between them, and offsets don't compare across partitions.
    """
    seq = F.col("ingest_seq")
    block = F.floor(seq / BLOCK)
    return {"partition": block % 2, "offset": F.floor(block / 2) * BLOCK + seq % BLOCK}


def skewed_arrival() -> Column:
    """Active panels stamp readings one hour ahead; heartbeats are on time."""
    time = F.col(EVENT_TIME)
    ahead = time - F.expr("INTERVAL '1' HOUR")
    return F.when(F.col(STATUS) == STATUS_ACTIVE, ahead).otherwise(time)


def days_late(stamp: str = EVENT_TIME) -> Column:
    """Arrival up to nine days behind the stamp."""
    return F.col(stamp) + F.make_dt_interval(days=(F.col("ingest_seq") * 37 % 10).cast("int"))


def by_arrival(arrival: Column) -> Column:
    """Offsets that rise with the time of arrival."""
    return F.unix_micros(arrival.cast("timestamp"))


def slices(
    rows: DataFrame, count: int, arrival: Column | None = None, **meta: Column,
) -> list[DataFrame]:
    """All readings as ``count`` message sets of equal time spans, in order of arrival.

    The span of the table is one row of minimum and maximum.
    """
    arrival = F.col(EVENT_TIME) if arrival is None else arrival
    span = rows.select(
        F.unix_micros(F.min(arrival).cast("timestamp")).alias("first"),
        F.unix_micros(F.max(arrival).cast("timestamp")).alias("last"),
    ).first()
    if span["first"] is None:
        return [messages(rows, arrival, **meta)]
    width = (span["last"] - span["first"]) // count + 1
    out = []
    for i in range(count):
        low = _time_at(span["first"] + i * width, rows)
        high = _time_at(span["first"] + (i + 1) * width, rows)
        inside = (arrival >= low) & (arrival < high)
        if i == count - 1:
            inside = inside | arrival.isNull()
        out.append(messages(rows.filter(inside), arrival, **meta))
    return out


def _time_at(micros: int, rows: DataFrame) -> Column:
    return F.timestamp_micros(F.lit(micros)).cast(rows.schema[EVENT_TIME].dataType)
