"""Publishing readings to a message topic."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from sunmeter.functions.wire import encode


def publish(readings: DataFrame, options: dict[str, str]) -> None:
    """K5: a batch of readings, keyed by panel, so a panel stays in one partition."""
    encode(readings).write.format("kafka").options(**options).save()


def start_publish(
    readings: DataFrame, options: dict[str, str], checkpoint: str,
) -> StreamingQuery:
    """K5 as a stream; at least once, as the topic sink is."""
    return (encode(readings).writeStream.format("kafka").options(**options)
            .option("checkpointLocation", checkpoint).start())
