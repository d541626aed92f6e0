"""Message topics as DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from sunmeter.schema import MESSAGE_SCHEMA, TOPIC


def topic_options(
    brokers: Sequence[str],
    topic: str = TOPIC,
    starting_offsets: str = "earliest",
    **more: str | int,
) -> dict[str, str]:
    """Reader options; all brokers in one list, so the client fails over.

    ``more`` takes further source options, for large topics above all
    ``maxOffsetsPerTrigger`` and ``minPartitions``.
    """
    if not brokers:
        raise ValueError("at least one broker is needed")
    options = {
        "kafka.bootstrap.servers": ",".join(brokers),
        "subscribe": topic,
        "startingOffsets": starting_offsets,
    }
    return options | {name: str(value) for name, value in more.items()}


def read_topic(spark: SparkSession, options: dict[str, str], stream: bool = True) -> DataFrame:
    """The topic as a stream, or as a bounded batch."""
    reader = spark.readStream if stream else spark.read
    return reader.format("kafka").options(**options).load()


def sink_options(brokers: Sequence[str], topic: str = TOPIC) -> dict[str, str]:
    """K5: writer options for publishing encoded readings."""
    return {"kafka.bootstrap.servers": ",".join(brokers), "topic": topic}


def read_landing(spark: SparkSession, path: str, **options: str | int) -> DataFrame:
    """A stream of messages that were landed as Parquet, shaped like a topic."""
    return spark.readStream.schema(MESSAGE_SCHEMA).options(**options).parquet(path)
