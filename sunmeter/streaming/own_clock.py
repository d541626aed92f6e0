"""Windows that close by the clock of their own panel, not by one watermark for all."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from sunmeter.functions.wire import decode
from sunmeter.operators.quality import is_timed
from sunmeter.schema import (
    EVENT_TIME, PANEL, PARTS_SCHEMA, POWER, POWER_SUM, READINGS, WATERMARK_DELAY, WINDOW_DURATION,
    WINDOW_START,
)
from sunmeter.sinks.folded import Folded
from sunmeter.streaming.jobs import Trigger

QUIET = "2 hours"
EMPTY_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"
BUCKET, BUCKETS = "bucket", 4096  # panels by hash; a checkpoint's number is that of its first start
STATE = "panels"  # the name of the state's only variable
SUMMED = (f"{BUCKET} int, {PANEL} string, start long, {POWER_SUM} double, {READINGS} long, "
          "newest long")

# A panel's clock, its newest stamp; its open windows, by their starts; and when it counts as
# silent, by the time of processing; stamps in microseconds, that in milliseconds.
PANEL_SCHEMA = T.StructType([
    T.StructField(PANEL, T.StringType()),
    T.StructField("clock", T.LongType()),
    T.StructField("starts", T.ArrayType(T.LongType())),
    T.StructField("sums", T.ArrayType(T.DoubleType())),
    T.StructField("counts", T.ArrayType(T.LongType())),
    T.StructField("due", T.LongType()),
])
STATE_SCHEMA = T.StructType([
    T.StructField(STATE, T.ArrayType(PANEL_SCHEMA)),
    T.StructField("has_timer", T.BooleanType()),
])
# The parts that a bucket says at once, side by side; unfolded to a row per part after it.
SAID_SCHEMA = T.StructType([
    T.StructField("panels", T.ArrayType(T.StringType())),
    *PANEL_SCHEMA.fields[2:5],
])
SAID = Row(*SAID_SCHEMA.names)
SAID_AT_ONCE = 10_000


def micros(spark: SparkSession, interval: str) -> int:
    epoch = "timestamp_seconds(0)"
    return spark.sql(f"SELECT unix_micros({epoch} + INTERVAL '{interval}')").first()[0]


class PanelClock(StatefulProcessor):
    """The open windows of the panels of a bucket, and a clock for each of them.

    A window is said when its panel's newest stamp is ``delay`` past its end, and leaves
    the state.  A reading for a window that was said before is said at once, as one more part
    of it.  So each reading is in exactly one part, whatever the clocks do.
    A panel that sends nothing for ``quiet`` (by the time of processing) has all its
    windows said, and its state goes: the state is that of panels that live.

    The state is read and written by bucket: what a batch costs for that does not grow with
    the panels, each of which would take several calls to the JVM.  A bucket that has panels has
    one timer, at the first time one may count as silent.  Rows only put that off; the timer
    says what is due when it goes off, and is set anew for the next.
    """

    def __init__(self, delay: int, width: int, quiet: int):
        self.delay, self.width, self.quiet = delay, width, quiet

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState(STATE, STATE_SCHEMA)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        panels, has_timer = self._stored()
        touched = set()
        for _, panel, start, total, n, newest in rows:
            if panel not in touched:
                touched.add(panel)
                clock, windows, _ = panels.get(panel, (newest, {}, 0))
                panels[panel] = [clock, windows, self._due(timerValues)]
            own = panels[panel]
            own[0] = max(own[0], newest)
            have = own[1].setdefault(start, [0.0, 0])
            have[0] += total or 0.0
            have[1] += n
        said = []
        for panel in touched:
            clock, windows, _ = panels[panel]
            last = clock - self.delay - self.width
            said += [(panel, start, *windows.pop(start))
                     for start in sorted(windows) if start <= last]
        if not has_timer:
            self.handle.registerTimer(self._due(timerValues))
        self._store(panels)
        return _in_rows(said)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentProcessingTimeInMs()
        panels, _ = self._stored()
        silent = [panel for panel, own in panels.items() if own[2] <= now]
        said = [(panel, start, *have) for panel in silent
                for start, have in panels.pop(panel)[1].items()]
        if panels:
            self.handle.registerTimer(min(own[2] for own in panels.values()))
            self._store(panels)
        else:
            self.state.clear()
        return _in_rows(said)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        """Take over what a state read by ``open_windows`` has of the bucket's panels."""
        due = self._due(timerValues)
        self.handle.registerTimer(due)
        self._store({own[PANEL]: (own["clock"], _by_start(own["starts"], own["sums"], own["counts"]), due)
                     for own in initialState[STATE]})

    def _due(self, timerValues) -> int:
        return timerValues.getCurrentProcessingTimeInMs() + self.quiet

    def _stored(self) -> tuple[dict, bool]:
        panels, has_timer = self.state.get() or ((), False)
        return {panel: (clock, _by_start(*windows), due)
                for panel, clock, *windows, due in panels}, has_timer

    def _store(self, panels: dict) -> None:
        rows = []
        for panel, (clock, windows, due) in panels.items():
            starts = sorted(windows)
            rows.append((panel, clock, starts, [windows[s][0] for s in starts],
                         [windows[s][1] for s in starts], due))
        self.state.update((rows, True))

    def close(self) -> None:
        pass


def _by_start(starts: list[int], sums: list[float], counts: list[int]) -> dict[int, list]:
    return {start: part for start, *part in zip(starts, sums, counts)}


def _in_rows(parts: list[tuple[str, int, float, int]]) -> Iterator[Row]:
    """The parts as few rows, of a bounded number of parts each."""
    for at in range(0, len(parts), SAID_AT_ONCE):
        yield SAID(*map(list, zip(*parts[at:at + SAID_AT_ONCE])))


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each batch of rows adds to each window: a panel with many rows has few after it."""
    for batch in batches:
        if batch.num_rows:
            table = pa.Table.from_batches([batch]).group_by([BUCKET, PANEL, "start"]).aggregate(
                [(POWER, "sum"), (POWER, "count"), ("time", "max")])
            columns = [BUCKET, PANEL, "start", f"{POWER}_sum", f"{POWER}_count", "time_max"]
            yield from table.select(columns).rename_columns(
                [BUCKET, PANEL, "start", POWER_SUM, READINGS, "newest"]).combine_chunks().to_batches()


def panel_power_own_clock(
    readings: DataFrame, delay: str = WATERMARK_DELAY, duration: str = WINDOW_DURATION,
    quiet: str = QUIET, state: DataFrame | None = None,
) -> DataFrame:
    """The parts of windows as they close, and of late readings as they come.

    There is a clock for each panel, so no panel's clock can make another one's
    readings late, and none needs a guard.  Rows are summed up by window before they are dealt out
    by buckets of panels.  ``state`` is what ``open_windows`` read of another query's checkpoint.
    """
    spark = readings.sparkSession
    bucket = F.pmod(F.xxhash64(PANEL), F.lit(BUCKETS)).cast("int").alias(BUCKET)
    rows = readings.filter(is_timed()).select(
        bucket, PANEL, F.unix_micros(F.window(EVENT_TIME, duration).start).alias("start"),
        F.col(POWER).cast("double").alias(POWER), F.unix_micros(EVENT_TIME).alias("time"))
    clock = PanelClock(micros(spark, delay), micros(spark, duration), micros(spark, quiet) // 1000)
    if state is not None:
        state = state.groupBy(bucket).agg(
            F.collect_list(F.struct(*PANEL_SCHEMA.names)).alias(STATE)).groupBy(BUCKET)
    said = rows.mapInArrow(_summed, SUMMED).groupBy(BUCKET).transformWithState(
        clock, SAID_SCHEMA, "Append", "ProcessingTime", initialState=state)
    said = said.select(F.inline(F.arrays_zip(*SAID_SCHEMA.names)))
    return said.select(*[{
        WINDOW_START: F.timestamp_micros("starts").alias(WINDOW_START),
        PANEL: F.col("panels").alias(PANEL), POWER_SUM: F.col("sums").alias(POWER_SUM),
        READINGS: F.col("counts").alias(READINGS),
    }.get(field.name, F.lit(None).cast(field.dataType).alias(field.name))
        for field in PARTS_SCHEMA])


def open_windows(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The panels' clocks and open windows from the checkpoint of a query that has stopped.

    A checkpoint's number of state partitions is fixed by its first start.  A
    new query may begin with these rows and another number.
    """
    rows = spark.read.format("statestore").option("path", checkpoint).option(
        "stateVarName", STATE).load()
    return rows.select(F.inline(f"value.{STATE}"))


def start_panel_power_own_clock(
    messages: DataFrame, table: Folded, checkpoint: str, delay: str = WATERMARK_DELAY,
    duration: str = WINDOW_DURATION, quiet: str = QUIET, trigger: Trigger | None = None,
    files: int | None = None, state: DataFrame | None = None,
) -> StreamingQuery:
    """Windows that their panel's clock has closed, and late readings, to a table of parts.

    With timers Spark has a batch at each trigger, with rows or without, and so a run
    over what is available would never end.  Such a run has batches with rows only; the
    timers that are due go off in the next.
    """
    rows = panel_power_own_clock(decode(messages), delay, duration, quiet, state)
    writer = rows.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
    writer = writer.trigger(**trigger) if trigger else writer
    conf = messages.sparkSession.conf
    before = conf.get(EMPTY_BATCHES)
    if trigger and trigger.get("availableNow"):
        conf.set(EMPTY_BATCHES, "false")
    try:
        return writer.foreachBatch(table.write(files)).start()
    finally:
        conf.set(EMPTY_BATCHES, before)
