"""Fleet energy at several grains, kept up to date as the windows' parts are folded."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sunmeter.functions.columns import window_hours
from sunmeter.operators.windows import power_of_parts
from sunmeter.schema import WINDOW_DURATION, WINDOW_END, WINDOW_POWER, WINDOW_START
from sunmeter.sinks.folded import BATCH, Folded

START, ENERGY, POWER, WINDOWS, VERSION = "start", "energy_wh", "power", "windows", "version"
GRAINS = ("1 hour", "1 day")  # above the windows; each a whole number of the one before

ROLLUP_SCHEMA = T.StructType([
    T.StructField(START, T.TimestampType()),
    T.StructField(ENERGY, T.DoubleType()),
    T.StructField(POWER, T.DoubleType()),  # summed over the windows, so means can be made
    T.StructField(WINDOWS, T.LongType()),
    T.StructField(VERSION, T.LongType()),  # of the day's parts
])


def fleet_windows(parts: DataFrame, duration: str = WINDOW_DURATION) -> DataFrame:
    """A2, A3: power and energy of all panels together per window, as the finest grain."""
    hours = window_hours(F.col(WINDOW_START), F.col(WINDOW_END))
    return power_of_parts(parts, duration).groupBy(WINDOW_START, WINDOW_END).agg(
        F.sum(WINDOW_POWER).alias(POWER)).select(
        F.col(WINDOW_START).alias(START), (F.col(POWER) * hours).alias(ENERGY), POWER,
        F.lit(1).cast("long").alias(WINDOWS))


def coarser(rows: DataFrame, grain: str, *largest: str) -> DataFrame:
    """The same figures at a coarser grain: sums of sums and of counts."""
    return rows.groupBy(F.window(START, grain).start.alias(START)).agg(
        *[F.sum(name).alias(name) for name in (ENERGY, POWER, WINDOWS)],
        *[F.max(name).alias(name) for name in largest])


def _newest(rows: DataFrame) -> DataFrame:
    names = [name for name in ROLLUP_SCHEMA.names if name != START]
    return rows.groupBy(START).agg(
        *[F.max_by(name, BATCH).alias(name) for name in names], F.max(BATCH).alias(BATCH))


class Rollup:
    """A pyramid over a table of parts: windows, hours and days, each a small table.

    ``update`` looks at the days that were folded since: it makes their windows anew
    from their parts, the hours from the windows, and the days from the hours.  A day's
    row says which version of the parts it was made of, and is written last, so a day
    whose update broke off is simply made again.  Days that batches not yet folded touch
    are computed when they are asked for, all others are read.
    """

    def __init__(
        self, spark: SparkSession, path: str, parts: Folded, duration: str = WINDOW_DURATION,
        grains: Iterable[str] = GRAINS,
    ):
        self.spark, self.parts, self.duration = spark, parts, duration
        self.grains = (duration, *grains)
        day, month = F.to_date(START), F.to_date(F.trunc(F.to_date(START), "month"))
        self.tables = {
            grain: Folded(spark, f"{path}/{grain.replace(' ', '-')}", ROLLUP_SCHEMA,
                          day if grain == duration else month, _newest, (START,))
            for grain in self.grains}

    def stale(self) -> dict[date, int]:
        """Folded days that have changed since they were rolled up, with their versions."""
        days = self.tables[self.grains[-1]].read().select(F.to_date(START).alias("day"), VERSION)
        known = {row["day"]: row[VERSION] for row in days.collect()}  # a row per day
        return {day: version for day, version in self.parts.versions().items()
                if known.get(day) != version}

    def update(self) -> int:
        """Roll up the days that have changed; how many."""
        days = self.stale()
        if not days:
            return 0
        versions = F.create_map(*[F.lit(value) for pair in days.items() for value in pair])
        rows = self._windows(self.parts.folded_rows(days)).withColumn(
            VERSION, F.element_at(versions, F.to_date(START)).cast("long"))
        before = None
        for grain, table in self.tables.items():
            if before is not None:
                stored = self.spark.read.schema(table.schema).parquet(before).drop(BATCH)
                rows = coarser(stored, grain, VERSION)
            number = table.last_batch() + 1
            table.write(1)(rows, number)
            before = table.batch_folder(number)
        return len(days)

    def fold(self) -> None:
        for table in self.tables.values():
            table.fold()
            table.clean()

    def read(self, grain: str | None = None, days: Iterable[date] | None = None) -> DataFrame:
        """(start, energy_wh, power, windows) at one of the grains, of all days or of some.

        A day's figure reads day rows only, but for the days that new batches touch.
        Of ``days`` at least those rows are there; files of others are not read.
        """
        grain = grain or self.grains[-1]
        wanted = None if days is None else set(days)
        stored = self.tables[grain].read(
            wanted if wanted is None or grain == self.duration
            else {day.replace(day=1) for day in wanted}).drop(VERSION)
        live = {*self.parts.new_days(), *self.stale()}
        if wanted is not None:
            stored = stored.filter(F.to_date(START).isin(*wanted))
            live &= wanted
        if not live:
            return stored
        fresh = self._windows(self.parts.rows(live))
        if grain != self.duration:
            fresh = coarser(fresh, grain)
        return stored.filter(~F.to_date(START).isin(*live)).unionByName(fresh)

    def between(self, begin: str, end: str) -> DataFrame:
        """Energy, summed power and number of the windows that start in [begin, end).

        Whole days are taken from the days' table, whole hours at their ends from the
        hours', and what is left from the windows': a range of years reads a few
        thousand rows.
        """
        low, high = (F.lit(text).cast("timestamp") for text in (begin, end))
        ends = {datetime.fromisoformat(text).date() for text in (begin, end)}
        taken, outside = None, F.lit(True)
        for grain in reversed(self.grains):
            first = _edge(low, grain, up=True)
            past = F.greatest(first, _edge(high, grain, up=False))
            if grain == self.duration:
                first, past = low, high
            inside = (F.col(START) >= first) & (F.col(START) < past)
            rows = self.read(grain, None if taken is None else ends).filter(inside & outside)
            # What finer grains add lies before or behind what coarser ones hold.
            outside = outside & ((F.col(START) < first) | (F.col(START) >= past))
            taken = rows if taken is None else taken.unionByName(rows)
        return taken.agg(*[F.sum(name).alias(name) for name in (ENERGY, POWER, WINDOWS)])

    def _windows(self, parts: DataFrame) -> DataFrame:
        return fleet_windows(parts, self.duration)


def _edge(time: Column, grain: str, up: bool) -> Column:
    """The start of a grain at or behind ``time``, or at or before it."""
    unit = grain.split()[-1]
    floor = F.date_trunc(unit, time)
    if not up:
        return floor
    return F.when(floor < time, floor + F.expr(f"INTERVAL '{grain}'")).otherwise(floor)
