"""Play a bounded set of messages through streaming queries, slice by slice."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def replay(
    slices: Iterable[DataFrame], landing: str, start: Callable[[], list[StreamingQuery]],
) -> list[StreamingQuery]:
    """Land each slice, then run the queries on it to the end, from the same checkpoints.

    The next slice lands only when all have stopped, so slices reach them in
    order whatever the number of files, and every step is also a restart.
    """
    runs = []
    for messages in slices:
        messages.write.mode("append").parquet(landing)
        queries = start()
        for query in queries:
            query.awaitTermination()
        runs += queries
    return runs
