"""The whole pipeline over one topic: raw readings, rejects and window power.

    spark-submit --packages <topic connector> --py-files sunmeter.zip \\
        sunmeter/streaming/pipeline.py --brokers host1:9092,host2:9092 --root <shared folder>

Upkeep, once a day or so: ``Tables(spark, root).upkeep(delay)``.
"""

from __future__ import annotations

import argparse
from collections.abc import Callable, Iterable
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sunmeter.operators.quality import is_late
from sunmeter.operators.windows import panel_power, power_of_parts
from sunmeter.schema import (
    CLOCK_AHEAD, EVENT_TIME, TOPIC, WATERMARK_DELAY, WINDOW_DURATION, WINDOW_END, WINDOW_SCHEMA,
    WINDOW_START,
)
from sunmeter.session import SHUFFLE_PARTITIONS, prepare
from sunmeter.sinks.files import exists
from sunmeter.sinks.rollup import Rollup
from sunmeter.sinks.tables import (
    is_windowed, ledger_table, parts_table, read_raw, read_rejects, read_timed, readings_table,
    windows_table,
)
from sunmeter.sources.messages import read_topic, topic_options
from sunmeter.streaming import jobs


REPAIRS_SCHEMA = "day date, number long, repaired boolean"


class Tables:
    """What the pipeline writes below ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.repairs = spark, f"{root}/repairs"
        self.readings = readings_table(spark, f"{root}/readings")
        self.windows = windows_table(spark, f"{root}/windows")
        self.parts = parts_table(spark, f"{root}/parts")
        self.rollup = Rollup(spark, f"{root}/rollup", self.parts)
        self.ledger = ledger_table(spark, f"{root}/ledger")

    def raw(self, days: Iterable[date] | None = None) -> DataFrame:
        """The raw readings, or those of ``days``, of whose folders alone are then read."""
        return read_raw(self.readings, days)

    def rejects(self) -> DataFrame:
        return read_rejects(self.readings)

    def current_windows(self) -> DataFrame:
        """All windows with their newest value, open ones too."""
        return self.windows.read()

    def merged_windows(
        self, duration: str = WINDOW_DURATION, days: Iterable[date] | None = None,
    ) -> DataFrame:
        """All windows, or those of ``days``, from the parts of the "parts" query.

        Late rows are in it as soon as they have come: their parts are added up
        with those of before, and no reading is looked at again.
        """
        return power_of_parts(self.parts.rows(days), duration)

    def final_windows(
        self, delay: str = WATERMARK_DELAY, duration: str = WINDOW_DURATION,
    ) -> DataFrame:
        """Windows that have ended at least ``delay`` before the newest one began."""
        current = self.current_windows()
        newest = current.agg(F.max(WINDOW_END).cast("string")).first()[0]
        last = F.lit(newest).cast("timestamp") - F.expr(f"INTERVAL '{delay}'") - F.expr(
            f"INTERVAL '{duration}'")
        return current.filter(F.col(WINDOW_END) <= last)

    def late_days(
        self, delay: str = WATERMARK_DELAY, duration: str = WINDOW_DURATION,
        ahead: str = CLOCK_AHEAD,
    ) -> list[date]:
        """Days with windows that rows since the last fold may have missed (``is_late``)."""
        late = self.readings.unfolded().filter(is_windowed(ahead) & is_late(ahead, delay))
        day = F.to_date(F.window(EVENT_TIME, duration)["start"])
        return sorted(row["day"] for row in late.select(day.alias("day")).distinct().collect())

    def due_days(
        self, duration: str = WINDOW_DURATION, ahead: str = CLOCK_AHEAD,
    ) -> list[date]:
        """Days marked late before whose repair broke off, or that batches since have touched.

        The two queries need not be equally far.  A windows query that lags may say
        a repaired window again without the late row, which it drops only later;
        and an ingest query that lags may not have had all rows of the day.
        """
        known = self._repairs().groupBy("day").agg(
            F.max_by("repaired", F.struct("number", "repaired")).alias("repaired")).collect()
        done = {row["day"] for row in known if row["repaired"]}
        due = {row["day"] for row in known} - done
        if done:
            stamped = self.readings.unfolded().filter(is_windowed(ahead)).select(
                F.window(EVENT_TIME, duration)["start"].alias(WINDOW_START))
            touched = stamped.union(self.windows.unfolded().select(WINDOW_START)).select(
                F.to_date(WINDOW_START).alias("day"))
            due |= {row["day"] for row in touched.filter(
                F.col("day").isin(*done)).distinct().collect()}
        return sorted(due)

    def _repairs(self) -> DataFrame:
        """One small row for each time a day was marked or repaired."""
        if not exists(self.spark, self.repairs):
            return self.spark.createDataFrame([], REPAIRS_SCHEMA)
        return self.spark.read.schema(REPAIRS_SCHEMA).parquet(self.repairs)

    def _mark(self, days: Iterable[date], repaired: bool) -> None:
        number = (self._repairs().agg(F.max("number")).first()[0] or 0) + 1
        rows = [(day, number, repaired) for day in days]
        if rows:
            self.spark.createDataFrame(rows, REPAIRS_SCHEMA).coalesce(1).write.mode(
                "append").parquet(self.repairs)

    def repair(
        self, days: Iterable[date], duration: str = WINDOW_DURATION, ahead: str = CLOCK_AHEAD,
    ) -> None:
        """The windows of these days anew from all timed readings, in place of what is there.

        They have the power as it was sent, and rows that the raw table can't hold
        too, as in the stream.  Settled batches are folded first, so what the
        stream says later still counts, and ``due_days`` looks at it.
        """
        days = set(days)
        if not days:
            return
        self.windows.fold()
        near = {day + timedelta(days=shift) for day in days for shift in (-1, 0, 1)}
        timed = read_timed(self.readings, ahead, near)
        rows = panel_power(timed.filter(F.col("day").isin(*near)), duration)
        rows = rows.filter(F.to_date(WINDOW_START).isin(*days)).select(*WINDOW_SCHEMA.names)
        self.windows.replace_days(rows, days)

    def upkeep(
        self, delay: str = WATERMARK_DELAY, duration: str = WINDOW_DURATION,
        ahead: str = CLOCK_AHEAD,
    ) -> None:
        """Fold settled batches, repair the windows of late rows, remove what is folded.

        The cost follows the batches since the last upkeep and the days they touch.
        Days are marked before the fold, so none is forgotten if it breaks off.
        """
        late = {*self.late_days(delay, duration, ahead), *self.due_days(duration, ahead)}
        self._mark(late, False)
        self.readings.fold()
        self.windows.fold()
        self.repair(late, duration, ahead)
        self._mark(late, True)
        self.parts.fold()
        self.rollup.update()
        self.rollup.fold()
        self.ledger.fold()
        for table in (self.readings, self.windows, self.parts, self.ledger):
            table.clean()


def starts(
    messages: DataFrame, root: str, delay: str = WATERMARK_DELAY,
    trigger: jobs.Trigger | None = None, files: int | None = None, ahead: str = CLOCK_AHEAD,
) -> dict[str, Callable[[], StreamingQuery]]:
    """How to start the queries; each has its checkpoint below ``root``.

    "ingest" stores what the topic says.  The windows are kept in one of two ways:
    "parts" adds up sums and counts in a table, so no row is ever too late;
    "windows" keeps a state behind a watermark, says each window again when a row
    changes it, and leaves late rows to a repair by ``Tables.upkeep``.  ``files``
    is the number of files a batch adds to a table.
    """
    tables = Tables(messages.sparkSession, root)
    return {
        "ingest": lambda: jobs.start_ingest(
            messages, tables.readings, f"{root}/checkpoints/ingest", trigger, files, ahead,
            tables.ledger, delay),
        "windows": lambda: jobs.start_panel_power_update(
            jobs.timed_readings(messages, ahead), tables.windows.write(files),
            f"{root}/checkpoints/windows", delay, trigger=trigger),
        "parts": lambda: jobs.start_panel_power_parts(
            messages, tables.parts, f"{root}/checkpoints/parts", trigger, files),
    }


def main() -> None:
    options = argparse.ArgumentParser(description=__doc__)
    options.add_argument("--brokers", required=True)
    options.add_argument("--topic", default=TOPIC)
    options.add_argument("--root", required=True)
    options.add_argument("--windows", choices=("parts", "windows"), default="parts",
                         help="how windows are kept: added up, or as state behind a watermark")
    options.add_argument("--delay", default=WATERMARK_DELAY)
    options.add_argument("--ahead", default=CLOCK_AHEAD)
    options.add_argument("--every", default="30 seconds")
    options.add_argument("--max-offsets", type=int, default=50_000_000)
    options.add_argument("--files", type=int, help="files a batch adds to a table")
    options.add_argument("--state-partitions", type=int, help="fixed by the first start")
    given = options.parse_args()
    spark = prepare(SparkSession.builder.appName("sunmeter").getOrCreate())
    if given.state_partitions:
        spark.conf.set(SHUFFLE_PARTITIONS, str(given.state_partitions))
    source = topic_options(
        given.brokers.split(","), given.topic, maxOffsetsPerTrigger=given.max_offsets)
    every = {"processingTime": given.every}
    spark.streams.addListener(jobs.DropCounter())
    known = starts(
        read_topic(spark, source), given.root, given.delay, every, given.files, given.ahead)
    jobs.supervise(spark, {name: known[name] for name in ("ingest", given.windows)})


if __name__ == "__main__":
    main()
