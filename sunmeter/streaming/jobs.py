"""Streaming jobs: raw ingest, window power, latest status.

Each takes a stream and starts one query.  A checkpoint is always required, so
a restart goes on where the query stopped instead of replaying the topic (D5).
The number of state partitions is ``spark.sql.shuffle.partitions`` at the first
start of a checkpoint and cannot change afterwards.
"""

from __future__ import annotations

import logging
import time
from collections import Counter
from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery, StreamingQueryListener

from sunmeter.functions.wire import decode
from sunmeter.operators.fleet import fleet_energy_closed, latest_per_partition
from sunmeter.operators.quality import (
    is_ahead, is_late, is_reject, is_timed, is_valid, to_raw, with_arrival,
)
from sunmeter.operators.windows import (
    once_each, panel_power, power_parts, with_lateness, with_two_clocks,
)
from sunmeter.schema import (
    CLOCK_AHEAD, THROUGH, WATERMARK_DELAY, WINDOW_DURATION, WINDOW_END, WINDOW_START,
)
from sunmeter.sinks.files import exists
from sunmeter.sinks.folded import Folded
from sunmeter.sinks.tables import REJECT, VALID, by_kind, in_files, is_windowed, with_day

Trigger = dict[str, object]
ALL_AVAILABLE: Trigger = {"availableNow": True}
log = logging.getLogger(__name__)


def _writer(rows: DataFrame, checkpoint: str, mode: str, trigger: Trigger | None) -> DataStreamWriter:
    writer = rows.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    return writer.trigger(**trigger) if trigger else writer


REJECTS = "rejects"


def _counted(readings: DataFrame) -> DataFrame:
    """Readings that tell in the query's progress how many are rejects."""
    return readings.observe(REJECTS, F.count_if(is_reject()).alias(REJECTS))


def _windowable(readings: DataFrame, ahead: str = CLOCK_AHEAD) -> DataFrame:
    """Readings that may move a watermark; the guard needs their ``timestamp`` of arrival."""
    timed = readings.filter(is_timed())
    return timed.filter(~is_ahead(ahead)) if "timestamp" in readings.columns else timed


def start_raw(
    readings: DataFrame, path: str, checkpoint: str, trigger: Trigger | None = None,
    files: int | None = None,
) -> StreamingQuery:
    """Append valid readings to the raw table, each exactly once, by day.

    Rejects are counted (``DropCounter``) and not kept; ``start_ingest`` keeps them.
    """
    rows = with_day(to_raw(_counted(readings).filter(is_valid())))
    return (_writer(in_files(rows, files), checkpoint, "append", trigger)
            .partitionBy("day").format("parquet").start(path))


def start_raw_batches(
    readings: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str,
    trigger: Trigger | None = None,
) -> StreamingQuery:
    """Valid readings in stored form to a per-batch callback, such as a JDBC append.

    Rejects are counted (``DropCounter``) and not kept; ``start_ingest`` keeps them.
    """
    rows = to_raw(_counted(readings).filter(is_valid()))
    return _writer(rows, checkpoint, "append", trigger).foreachBatch(write).start()


def start_ingest(
    messages: DataFrame, table: Folded, checkpoint: str, trigger: Trigger | None = None,
    files: int | None = None, ahead: str = CLOCK_AHEAD, ledger: Folded | None = None,
    delay: str = WATERMARK_DELAY,
) -> StreamingQuery:
    """One pass over the topic that stores the raw readings and the rejects.

    Two queries would read and parse the topic twice.  Both kinds of row go to
    one table, so a batch commits them together.  ``ledger`` gets a row per batch: how many
    messages it had, how many of them are raw readings and rejects, and how many came so
    late that a watermark ``delay`` behind may have passed them.
    """
    decoded = decode(
        with_arrival(messages), "topic", "partition", "offset", "timestamp", raw=True)
    write = table.write(files) if ledger is None else _accounted(
        table, ledger, files, ahead, delay)
    return (_writer(by_kind(decoded, ahead), checkpoint, "append", trigger)
            .foreachBatch(write).start())


def _accounted(
    table: Folded, ledger: Folded, files: int | None, ahead: str, delay: str,
) -> Callable[[DataFrame, int], None]:
    """Writes a batch and then its row of the ledger, counted while it is written.

    A batch that is tried again replaces both.
    """
    counts = {
        "read": F.count(F.lit(1)),
        "valid": F.count_if(F.col("kind") == VALID),
        "rejected": F.count_if(F.col("kind") == REJECT),
        "late": F.count_if(is_windowed(ahead) & is_late(ahead, delay)),
    }

    def write(batch: DataFrame, batch_id: int) -> None:
        seen = Observation()
        table.write(files, lambda rows: rows.observe(
            seen, *[count.alias(name) for name, count in counts.items()]))(batch, batch_id)
        found = seen.get
        row = (batch_id, *[found.get(name, 0) for name in counts])
        names = ledger.schema.fieldNames()[:len(row)]
        ledger.write(1)(table.spark.createDataFrame(
            [row], ", ".join(f"{name} long" for name in names)).withColumn(
            "noted", F.current_timestamp()), batch_id)

    return write


def timed_readings(messages: DataFrame, ahead: str = CLOCK_AHEAD) -> DataFrame:
    """Readings that a watermark may see: panel and time known, the clock not far ahead."""
    return decode(with_arrival(messages), "timestamp").filter(is_timed() & ~is_ahead(ahead))


def start_panel_power_append(
    readings: DataFrame, path: str, checkpoint: str, delay: str = WATERMARK_DELAY,
    duration: str = WINDOW_DURATION, trigger: Trigger | None = None, files: int | None = None,
) -> StreamingQuery:
    """Each window once, when the watermark has passed its end."""
    timed = with_lateness(_windowable(readings), delay)
    rows = with_day(panel_power(timed, duration), WINDOW_START)
    return (_writer(in_files(rows, files), checkpoint, "append", trigger)
            .partitionBy("day").format("parquet").start(path))


def start_panel_power_update(
    readings: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str,
    delay: str = WATERMARK_DELAY, duration: str = WINDOW_DURATION, trigger: Trigger | None = None,
    two_clocks: bool = False,
) -> StreamingQuery:
    """Every window a batch touched, at once, to a per-batch callback.

    With ``two_clocks`` active panels and heartbeats have a watermark each (D2).
    """
    timed = readings.filter(is_timed())
    late = with_two_clocks(timed, delay) if two_clocks else with_lateness(timed, delay)
    rows = panel_power(late, duration)
    return _writer(rows, checkpoint, "update", trigger).foreachBatch(write).start()


def start_panel_power_parts(
    messages: DataFrame, table: Folded, checkpoint: str, trigger: Trigger | None = None,
    files: int | None = None, duration: str = WINDOW_DURATION,
) -> StreamingQuery:
    """What each batch adds to the windows, as sums and counts, to a table of parts.

    A batch is summed up by itself: there is no state, no watermark and no clock to guard,
    and a reading of any day is added to its window when it comes.  A stamp that is
    wrong makes a window of its own.  A batch that is tried again replaces its part.

    The parts say how far each partition has been counted.  So a checkpoint that is
    new, as the old one was lost, goes on behind that: the topic is read again, but
    what the table has is not added twice (D5).
    """
    first, passed = _resumed(table, checkpoint)
    readings = decode(messages, "partition", "offset").filter(is_timed())
    if passed:
        counted = F.create_map(*[F.lit(value) for pair in passed.items() for value in pair])
        readings = readings.filter(
            F.col("offset") > F.coalesce(F.element_at(counted, F.col("partition")), F.lit(-1)))
    write_part = table.write(files)

    def write(batch: DataFrame, batch_id: int) -> None:
        write_part(power_parts(batch, duration), first + batch_id)

    return _writer(readings, checkpoint, "append", trigger).foreachBatch(write).start()


STARTS_SCHEMA = "checkpoint string, number long, first long, passed map<int,long>"


def _resumed(table: Folded, checkpoint: str) -> tuple[int, dict[int, int]]:
    """The number of a checkpoint's first batch, and the offsets that were counted before it.

    Both are noted when a checkpoint begins, and hold for its whole life.  Offsets
    are one number per partition of the topic.
    """
    spark, path = table.spark, f"{table.path}/starts"
    starts = (spark.read.schema(STARTS_SCHEMA).parquet(path) if exists(spark, path)
              else spark.createDataFrame([], STARTS_SCHEMA))
    if exists(spark, f"{checkpoint}/offsets"):
        known = starts.filter(F.col("checkpoint") == checkpoint).orderBy(F.desc("number")).first()
        return (known["first"], known["passed"]) if known else (0, {})
    first = table.last_batch() + 1
    passed = {row["partition"]: row["through"] for row in table.rows().groupBy("partition").agg(
        F.max(THROUGH).alias("through")).collect()} if first else {}
    number = starts.count()
    spark.createDataFrame([(checkpoint, number, first, passed)], STARTS_SCHEMA).coalesce(
        1).write.mode("append").parquet(path)
    return first, passed


def start_latest_status(
    readings: DataFrame, table: Folded, checkpoint: str, trigger: Trigger | None = None,
    files: int | None = None,
) -> StreamingQuery:
    """A5 as a stream: the panels whose status a batch touched, per partition of the topic.

    ``readings`` carry the messages' partition, offset and timestamp.
    """
    rows = latest_per_partition(readings)
    return _writer(rows, checkpoint, "update", trigger).foreachBatch(table.write(files)).start()


def supervise(
    spark: SparkSession, starts: dict[str, Callable[[], StreamingQuery]],
    restarts: int = 5, pause: float = 2.0, longest: float = 300.0, quiet: float = 600.0,
) -> None:
    """Run all queries; start a failed one again from its checkpoint, without end.

    The pause before a restart doubles with each failure in a row, up to
    ``longest`` seconds; a query that ran for ``quiet`` seconds begins anew.  Only
    after ``restarts`` failures in a row are the other queries stopped and the
    failure raised, as then something is wrong that does not pass.
    """
    running = {name: start() for name, start in starts.items()}
    began = dict.fromkeys(running, time.monotonic())
    failed: Counter[str] = Counter()
    while running:
        try:
            spark.streams.awaitAnyTermination()
        except StreamingQueryException:
            pass  # looked up below, per query
        spark.streams.resetTerminated()
        for name, query in list(running.items()):
            if query.isActive:
                continue
            failure = query.exception()
            if failure is None:
                del running[name]
                continue
            if time.monotonic() - began[name] >= quiet:
                failed[name] = 0
            failed[name] += 1
            if failed[name] > restarts:
                for other in running.values():
                    other.stop()
                raise failure
            log.warning("%s failed, restart %d: %s", name, failed[name], failure)
            time.sleep(min(longest, pause * 2 ** (failed[name] - 1)))
            running[name] = starts[name]()
            began[name] = time.monotonic()


def start_fleet_energy(
    readings: DataFrame, path: str, checkpoint: str, delay: str = WATERMARK_DELAY,
    duration: str = WINDOW_DURATION, trigger: Trigger | None = None, files: int | None = None,
) -> StreamingQuery:
    """The fleet's energy of each window, once, when the watermark has passed it."""
    rows = with_day(fleet_energy_closed(with_lateness(readings, delay), duration), WINDOW_END)
    return (_writer(in_files(rows, files), checkpoint, "append", trigger)
            .partitionBy("day").format("parquet").start(path))


def start_raw_once(
    messages: DataFrame, path: str, checkpoint: str, delay: str = WATERMARK_DELAY,
    trigger: Trigger | None = None, files: int | None = None, ahead: str = CLOCK_AHEAD,
) -> StreamingQuery:
    """Valid readings to the raw table by day, each once though it was sent again.

    The checkpoint keeps a restart from storing a message twice; the state keeps two
    messages of one reading apart from two readings.
    """
    readings = timed_readings(messages, ahead).filter(is_valid())
    rows = with_day(to_raw(once_each(readings, delay)))
    return (_writer(in_files(rows, files), checkpoint, "append", trigger)
            .partitionBy("day").format("parquet").start(path))


class DropCounter(StreamingQueryListener):
    """Rows the watermark dropped, over the whole life of each query, by its id;
    and rejects that a query leaves out.

    Counted after the partial aggregate: rows of one panel, window and task are
    one.  Register it with ``spark.streams.addListener`` before the start; each
    report with drops is logged.  The rows are in the raw table all the same.
    """

    def __init__(self):
        self.dropped: Counter[str] = Counter()
        self.rejected: Counter[str] = Counter()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        dropped = sum(state.numRowsDroppedByWatermark for state in progress.stateOperators)
        if dropped:
            self.dropped[str(progress.id)] += dropped
            log.warning("%s: %d rows too late for their windows in batch %d",
                        progress.name or progress.id, dropped, progress.batchId)
        rejected = progress.observedMetrics.get(REJECTS)
        if rejected and rejected[REJECTS]:
            self.rejected[str(progress.id)] += rejected[REJECTS]
            log.warning("%s: %d rejects left out in batch %d",
                        progress.name or progress.id, rejected[REJECTS], progress.batchId)

    def onQueryTerminated(self, event) -> None:
        pass
