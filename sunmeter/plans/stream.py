"""Streaming queries: the test tables are landed as messages, played through a
job in several steps, and the job's output table is read back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sunmeter.functions.wire import decode
from sunmeter.operators.fleet import latest_of_partitions
from sunmeter.operators.lookup import around, days_around, panel_rows
from sunmeter.operators.windows import power_of_parts
from sunmeter.plans import fixture
from sunmeter.plans.batch import AS_OF, LOOKUP_PANEL, mixed_topic, plain
from sunmeter.plans.replay import replay
from sunmeter.schema import (
    EVENT_TIME, PANEL, POWER, RAW_SCHEMA, WATERMARK_DELAY, WINDOW_END, WINDOW_POWER,
)
from sunmeter.session import CHANGELOG, SHUFFLE_PARTITIONS, scratch
from sunmeter.sinks.rollup import Rollup
from sunmeter.sinks.tables import FINAL_SCHEMA, parts_table, read_rejects, status_table
from sunmeter.sources.messages import read_landing
from sunmeter.streaming import jobs, own_clock, pipeline

STEPS = 3
LATE_STEPS = 6
STATE_PARTITIONS = 8
NEVER_LATE = "11 days"
BROKEN_STAMP = "2999-01-01 00:00:00"
FAR_PANEL, FAR_AHEAD = "8", "975 years"
OWN_DELAY = "30 seconds"
RESENT_DELAY = "26 hours"
SOME_WEEKS = ("2024-01-04 05:17:30", "2024-01-19 21:40:00")

# job(stream of messages, its folder) -> running queries
Job = Callable[[DataFrame, str], list[StreamingQuery]]


def play(
    spark: SparkSession, name: str, slices: list[DataFrame], job: Job,
    partitions: int = STATE_PARTITIONS,
) -> str:
    """Run ``job`` over the slices; its folder.

    A stateful query has as many ``partitions`` of state, whatever the batch
    setting is: the first start of a checkpoint fixes the number.  Each slice is one large
    batch before a stop, so the state is saved whole with every batch: saved as
    changes, each start would put in and remove again what all slices before had.
    """
    root = scratch(spark, name)
    batch, changelog = spark.conf.get(SHUFFLE_PARTITIONS), spark.conf.get(CHANGELOG)
    spark.conf.set(SHUFFLE_PARTITIONS, partitions)
    spark.conf.set(CHANGELOG, "false")
    try:
        replay(slices, f"{root}/landing", lambda: job(read_landing(spark, f"{root}/landing"), root))
    finally:
        spark.conf.set(SHUFFLE_PARTITIONS, batch)
        spark.conf.set(CHANGELOG, changelog)
    return root


def _pipeline(*names: str, delay: str = WATERMARK_DELAY) -> Job:
    """The pipeline's queries of these names.

    A batch is written by the tasks that read or sum it up: a set number of files would
    bring all rows of a large batch to as many tasks.
    """
    def job(messages: DataFrame, root: str) -> list[StreamingQuery]:
        starts = pipeline.starts(messages, root, delay, jobs.ALL_AVAILABLE)
        return [starts[name]() for name in names]

    return job


def _raw_job(messages: DataFrame, root: str) -> list[StreamingQuery]:
    return [jobs.start_raw(
        decode(messages), f"{root}/raw", f"{root}/checkpoint", jobs.ALL_AVAILABLE)]


def _append_job(messages: DataFrame, root: str) -> list[StreamingQuery]:
    return [jobs.start_panel_power_append(
        decode(messages), f"{root}/windows", f"{root}/checkpoint", trigger=jobs.ALL_AVAILABLE)]


def _status_job(messages: DataFrame, root: str) -> list[StreamingQuery]:
    readings = decode(messages, "partition", "offset", "timestamp")
    return [jobs.start_latest_status(
        readings, status_table(messages.sparkSession, f"{root}/status"), f"{root}/checkpoint",
        jobs.ALL_AVAILABLE)]


def _ordered(spark: SparkSession, sf_dir: str, steps: int = STEPS) -> list[DataFrame]:
    return fixture.slices(fixture.readings(spark, sf_dir), steps)


def stream_raw_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = play(spark, "raw", _ordered(spark, sf_dir), _raw_job)
    return plain(spark.read.schema(RAW_SCHEMA).parquet(f"{root}/raw").drop("day"))


def stream_restart_exactly_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half the messages, a stop, the other half from the same checkpoint."""
    root = play(spark, "restart", _ordered(spark, sf_dir, 2), _pipeline("ingest"))
    return plain(pipeline.Tables(spark, root).raw().drop("day"))


def compacted_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All raw rows, after all but the newest batch was folded by day and removed."""
    root = play(spark, "compact", _ordered(spark, sf_dir), _pipeline("ingest"))
    tables = pipeline.Tables(spark, root)
    tables.readings.fold()
    tables.readings.clean()
    return plain(tables.raw().drop("day"))


def _live(spark: SparkSession, sf_dir: str) -> pipeline.Tables:
    """Tables whose older batches are folded, while the newest is as it came."""
    root = play(spark, "live", _ordered(spark, sf_dir), _pipeline("ingest"))
    tables = pipeline.Tables(spark, root)
    tables.readings.fold()
    return tables


def panel_lookup_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stored readings of one panel, of folded days and of open batches."""
    rows = panel_rows(_live(spark, sf_dir).raw(), LOOKUP_PANEL)
    return rows.withColumn(POWER, F.col(POWER).cast("string"))


def readings_in_range_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored readings around a time, of the days' folders that it touches."""
    tables = _live(spark, sf_dir)
    return plain(around(tables.raw(days_around(AS_OF)), AS_OF).drop("day"))


def stream_rejected_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    topic = mixed_topic(spark, sf_dir, broken=True)
    root = play(spark, "rejects", [topic], _pipeline("ingest"))
    return read_rejects(pipeline.Tables(spark, root).readings).select("partition", "raw_value")


def stream_panel_power_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = play(spark, "append", _ordered(spark, sf_dir), _append_job)
    stored = spark.read.schema(FINAL_SCHEMA).parquet(f"{root}/windows")
    return plain(stored.drop("day"), WINDOW_POWER)


def stream_panel_power_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = play(spark, "update", _ordered(spark, sf_dir), _pipeline("windows"))
    return plain(pipeline.Tables(spark, root).current_windows(), WINDOW_POWER)


def stream_current_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All windows from the pipeline's one state, after its upkeep."""
    root = play(spark, "current", _ordered(spark, sf_dir), _pipeline("ingest", "windows"))
    tables = pipeline.Tables(spark, root)
    tables.upkeep()
    return plain(tables.current_windows(), WINDOW_POWER)


def stream_bad_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every thousandth stamp is centuries ahead, of every other one the message's time too;
    no other window is lost for it."""
    broken = F.col("ingest_seq") % 1000 == 0
    rows = fixture.readings(spark, sf_dir).withColumn("sent", F.col(EVENT_TIME))
    kind = rows.schema[EVENT_TIME].dataType
    rows = rows.withColumn(EVENT_TIME, F.when(broken, F.lit(BROKEN_STAMP).cast(kind)).otherwise(
        F.col(EVENT_TIME)))
    stamped = F.when(F.col("ingest_seq") % 2000 == 0, F.col(EVENT_TIME)).otherwise(F.col("sent"))
    late = fixture.slices(rows, STEPS, F.col("sent"), stamped=stamped)
    root = play(spark, "clock", late, _pipeline("windows"))
    return plain(pipeline.Tables(spark, root).current_windows(), WINDOW_POWER)


def _late(spark: SparkSession, sf_dir: str, steps: int = LATE_STEPS) -> list[DataFrame]:
    return fixture.slices(fixture.readings(spark, sf_dir), steps, fixture.days_late())


def _counting_drops(spark: SparkSession, run: Callable[[], str]) -> tuple[str, int]:
    """What ``run`` gives, and how many rows watermarks dropped meanwhile."""
    drops = jobs.DropCounter()
    spark.streams.addListener(drops)
    try:
        found = run()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    finally:
        spark.streams.removeListener(drops)
    return found, sum(drops.dropped.values())


def late_readings_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages up to nine days behind their stamps, and a watermark that waits longer."""
    root = play(spark, "late", _late(spark, sf_dir), _pipeline("windows", delay=NEVER_LATE))
    return plain(pipeline.Tables(spark, root).current_windows(), WINDOW_POWER)


def late_readings_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same messages, a watermark that drops most of them, and a repair from the raw rows."""
    delay = "30 seconds"
    root, dropped = _counting_drops(spark, lambda: play(
        spark, "repair", _late(spark, sf_dir), _pipeline("ingest", "windows", delay=delay)))
    if not dropped:
        raise AssertionError("no row was late")
    tables = pipeline.Tables(spark, root)
    tables.upkeep(delay)
    return plain(tables.current_windows(), WINDOW_POWER)


def late_readings_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same messages, added up as they come; the table is folded between, and the
    checkpoint lost halfway, so that the topic is read from its start again."""
    def job(messages: DataFrame, root: str) -> list[StreamingQuery]:
        tables = pipeline.Tables(spark, root)
        step = tables.parts.last_batch() + 1
        tables.parts.fold()
        tables.parts.clean()
        return [jobs.start_panel_power_parts(
            messages, tables.parts, f"{root}/checkpoint-{step < LATE_STEPS // 2}",
            jobs.ALL_AVAILABLE)]

    arrival = fixture.days_late()
    slices = fixture.slices(fixture.readings(spark, sf_dir), LATE_STEPS, arrival,
                            offset=fixture.by_arrival(arrival))
    root = play(spark, "merged", slices, job)
    return plain(pipeline.Tables(spark, root).merged_windows(), WINDOW_POWER)


def _far_ahead(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Messages up to nine days late, and one panel whose clock is centuries ahead."""
    rows = fixture.readings(spark, sf_dir).withColumn("sent", F.col(EVENT_TIME))
    far = F.col("sent") + F.expr(f"INTERVAL '{FAR_AHEAD}'")
    rows = rows.withColumn(EVENT_TIME, F.when(F.col(PANEL) == FAR_PANEL, far).otherwise(
        F.col("sent")))
    return fixture.slices(rows, STEPS, fixture.days_late("sent"))


def _own_clock_job(messages: DataFrame, root: str, number: int = 0, **options) -> StreamingQuery:
    return own_clock.start_panel_power_own_clock(
        messages, parts_table(messages.sparkSession, f"{root}/parts-{number}"),
        f"{root}/checkpoint-{number}", OWN_DELAY, trigger=jobs.ALL_AVAILABLE, **options)


def stream_panel_own_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows that end 30 s before their own panel's newest stamp, with all late rows."""
    root = play(spark, "own-clock", _far_ahead(spark, sf_dir),
                lambda messages, root: [_own_clock_job(messages, root)])
    return plain(power_of_parts(parts_table(spark, f"{root}/parts-0").rows()), WINDOW_POWER)


def stream_repartitioned_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, by a query with 8 partitions of state and one with 5 that takes it over."""
    first, *rest = _far_ahead(spark, sf_dir)
    old = play(spark, "state", [first], lambda messages, root: [_own_clock_job(messages, root)])
    state = own_clock.open_windows(spark, f"{old}/checkpoint-0")
    new = play(spark, "state", rest, lambda messages, root: [
        _own_clock_job(messages, root, 1, state=state)], partitions=5)
    parts = parts_table(spark, f"{old}/parts-0").rows().unionByName(
        parts_table(spark, f"{new}/parts-1").rows())
    return plain(power_of_parts(parts), WINDOW_POWER)


def stream_fleet_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fleet's energy of each window that the watermark has passed, by two states in a row."""
    def job(messages: DataFrame, root: str) -> list[StreamingQuery]:
        return [jobs.start_fleet_energy(
            jobs.timed_readings(messages), f"{root}/energy", f"{root}/checkpoint",
            trigger=jobs.ALL_AVAILABLE)]

    root = play(spark, "energy", _ordered(spark, sf_dir), job)
    stored = spark.read.schema(
        f"{WINDOW_END} timestamp, energy_wh double, day date").parquet(f"{root}/energy")
    return plain(stored.drop("day"), "energy_wh")


def stream_resent_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message twice, a day apart, so that many come again after a restart."""
    def job(messages: DataFrame, root: str) -> list[StreamingQuery]:
        return [jobs.start_raw_once(
            messages, f"{root}/raw", f"{root}/checkpoint", RESENT_DELAY, jobs.ALL_AVAILABLE)]

    rows = fixture.readings(spark, sf_dir).withColumn("again", F.explode(F.array(
        F.lit(0), F.lit(1))))
    arrival = F.col(EVENT_TIME) + F.make_dt_interval(days="again")
    slices = fixture.slices(rows, STEPS, arrival, offset=F.col("ingest_seq") * 2 + F.col("again"))
    root = play(spark, "resent", slices, job)
    return plain(spark.read.schema(RAW_SCHEMA).parquet(f"{root}/raw").drop("day"))


def stream_two_clocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active panels an hour ahead of heartbeats, 30 s of patience with each, nothing dropped."""
    def job(messages: DataFrame, root: str) -> list[StreamingQuery]:
        tables = pipeline.Tables(spark, root)
        return [jobs.start_panel_power_update(
            jobs.timed_readings(messages), tables.windows.write(), f"{root}/checkpoint",
            "30 seconds", trigger=jobs.ALL_AVAILABLE, two_clocks=True)]

    slices = fixture.slices(
        fixture.readings(spark, sf_dir), LATE_STEPS, fixture.skewed_arrival())
    root, dropped = _counting_drops(spark, lambda: play(spark, "clocks", slices, job))
    if dropped:
        raise AssertionError(f"{dropped} rows were late")
    return plain(pipeline.Tables(spark, root).current_windows(), WINDOW_POWER)


def _rolled_up(spark: SparkSession, sf_dir: str) -> Rollup:
    """The rollup of a table of parts; the last step's batch is not folded yet."""
    def job(messages: DataFrame, root: str) -> list[StreamingQuery]:
        tables = pipeline.Tables(spark, root)
        tables.parts.fold(newest=True)
        tables.parts.clean()
        tables.rollup.update()
        return [pipeline.starts(messages, root, trigger=jobs.ALL_AVAILABLE)["parts"]()]

    root = play(spark, "rollup", _late(spark, sf_dir, STEPS), job)
    return pipeline.Tables(spark, root).rollup


def fleet_energy_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fleet's energy per window, hour and day, from the pyramid."""
    rollup = _rolled_up(spark, sf_dir)
    rows = [rollup.read(grain).select(F.lit(grain).alias("grain"), "start", "energy_wh", "windows")
            for grain in rollup.grains]
    return plain(rows[0].unionByName(rows[1]).unionByName(rows[2]), "energy_wh")


def fleet_energy_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fleet's energy in some two weeks: days, then hours, then windows at the ends."""
    found = _rolled_up(spark, sf_dir).between(*SOME_WEEKS)
    return plain(found.select("energy_wh", "windows"), "energy_wh")


def ingest_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each batch of the ingest read, stored, rejected and found late."""
    mixed = mixed_topic(spark, sf_dir, broken=True)
    root = play(spark, "ledger", [mixed, *_late(spark, sf_dir)], _pipeline("ingest"))
    tables = pipeline.Tables(spark, root)
    tables.ledger.fold()
    tables.ledger.clean()
    return tables.ledger.read().drop("noted")


def stream_latest_panel_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Panels that move between two partitions, whose offsets don't compare."""
    rows = fixture.readings(spark, sf_dir)
    slices = fixture.slices(rows, STEPS, **fixture.moving_partition())
    root = play(spark, "status", slices, _status_job)
    status = status_table(spark, f"{root}/status")
    status.fold()
    return latest_of_partitions(status.read())


QUERIES = {
    query.__name__: query
    for query in (
        stream_raw_readings, stream_restart_exactly_once, compacted_readings, panel_lookup_live,
        readings_in_range_live,
        stream_rejected_readings, stream_panel_power_append, stream_panel_power_update,
        stream_current_windows, stream_bad_clock, late_readings_kept, late_readings_repaired,
        late_readings_merged, stream_panel_own_clock, stream_repartitioned_state,
        stream_fleet_energy, stream_resent_readings, stream_two_clocks, fleet_energy_rollup,
        fleet_energy_between, ingest_ledger,
        stream_latest_panel_status,
    )
}
