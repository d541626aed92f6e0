"""Batch queries: each takes the session and the folder of the test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sunmeter.functions.columns import expected_power
from sunmeter.functions.wire import decode, encode, shift_event_time
from sunmeter.operators import fleet, lookup, series
from sunmeter.operators.quality import is_timed, split_valid, to_raw
from sunmeter.operators.windows import panel_power
from sunmeter.plans import fixture
from sunmeter.schema import (
    EVENT_TIME, PANEL, POWER, STATUS, WINDOW_END, WINDOW_POWER,
)
from sunmeter.session import scratch
from sunmeter.sinks.tables import create_raw_table, with_day, write_clustered

LOOKUP_PANEL = "8"
AS_OF = "2024-01-15 12:00:00"
FIRST_ROWS = 1_000
FIRST_WINDOWS = 500
WIDE_PANELS = ("0", "1", "2", "3", "4")


def plain(rows: DataFrame, *digits: str) -> DataFrame:
    """Results as they are compared: times without zone, decimals as text, named
    sums at 6 digits."""
    def column(name: str, kind: str) -> Column:
        if kind == "timestamp":
            return F.col(name).cast("timestamp_ntz").alias(name)
        if kind.startswith("decimal"):
            return F.col(name).cast("string").alias(name)
        if name in digits:
            return F.round(name, 6).alias(name)
        return F.col(name)

    return rows.select(*[column(name, kind) for name, kind in rows.dtypes])


def _windows(spark: SparkSession, sf_dir: str, duration: str = "30 seconds") -> DataFrame:
    return panel_power(fixture.readings(spark, sf_dir), duration)


def broken_text() -> Column:
    """Messages that are JSON but no readings the raw table can hold, of four kinds."""
    def text(panel: str, power: str, time: str) -> Column:
        return F.concat(F.lit("{"), F.expr(panel), F.lit(f'"power_panel":{power},"current_status":1,'
                        '"time_data":"'), F.expr(time), F.lit('"}'))

    seq = F.col("event_id")
    day = "'2024-01-15 12:00:00'"
    return (F.when(seq % 4 == 0, text("""'"Panel_id":"8",'""", "1.5", "concat('not a time ', event_id)"))
            .when(seq % 4 == 1, text("''", "1.5", day))
            .when(seq % 4 == 2, text("""concat('"Panel_id":"', repeat('x', 251), '",')""", "1.5", day))
            .otherwise(text("""'"Panel_id":"8",'""", "123456789012345678.0", day)))


def mixed_topic(spark: SparkSession, sf_dir: str, broken: bool = False) -> DataFrame:
    """The topic with foreign traffic: JSON that is no reading, and plain text.

    ``broken`` adds readings with a bad stamp, no panel, too long an id or too high
    a power.
    """
    good = fixture.messages(fixture.readings(spark, sf_dir))
    shape = {field.name: field.dataType for field in good.schema}

    def foreign(name: str, text: Column, partition: int) -> DataFrame:
        values = {"value": text.cast("binary"), "partition": F.lit(partition)}
        return fixture.table(spark, sf_dir, name).select(*[
            values.get(column, F.lit(None)).cast(kind).alias(column)
            for column, kind in shape.items()
        ])

    topic = good.unionAll(foreign("events", F.col("props"), 1)).unionAll(
        foreign("conversations", F.col("text"), 2))
    return topic.unionAll(foreign("events", broken_text(), 3)) if broken else topic


def decode_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(decode(fixture.messages(fixture.readings(spark, sf_dir))))


def wire_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys and texts as published, heartbeats with their quoted zeros."""
    sent = encode(fixture.readings(spark, sf_dir), True)
    return sent.select(F.col("key").cast("string"), F.col("value").cast("string"))


def wire_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(decode(encode(fixture.readings(spark, sf_dir))))


def accepted_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    valid, _ = split_valid(decode(mixed_topic(spark, sf_dir)))
    return plain(valid)


def rejected_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    topic = mixed_topic(spark, sf_dir, broken=True)
    _, rejects = split_valid(decode(topic, "partition", raw=True))
    return rejects.select("partition", "raw_value")


def shifted_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event times with the clocks of active panels set back by an hour."""
    shifted = shift_event_time(fixture.readings(spark, sf_dir), "-1 hour")
    return shifted.select(PANEL, POWER, STATUS, EVENT_TIME)


def raw_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(to_raw(fixture.readings(spark, sf_dir)))


def raw_readings_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written by day, clustered by panel, and read back."""
    path = scratch(spark, "raw")
    write_clustered(to_raw(fixture.readings(spark, sf_dir)), path)
    return plain(spark.read.parquet(path).drop("day"))


def raw_table_created(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw table made with its types, filled, and read by its name."""
    path = scratch(spark, "created")
    name = path.rsplit("/", 1)[-1].replace("-", "_")
    create_raw_table(spark, name, path)
    with_day(to_raw(fixture.readings(spark, sf_dir))).write.insertInto(name)
    return plain(spark.table(name).drop("day"))


def panel_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = to_raw(fixture.panel_readings(spark, sf_dir, LOOKUP_PANEL))
    return plain(lookup.panel_rows(rows, LOOKUP_PANEL))


def panel_lookup_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = to_raw(fixture.panel_readings(spark, sf_dir, LOOKUP_PANEL))
    return lookup.panel_rows_json(rows, LOOKUP_PANEL)


def panel_lookup_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lookup on the clustered table, which skips what has other panels."""
    path = scratch(spark, "raw")
    write_clustered(to_raw(fixture.readings(spark, sf_dir)), path)
    return plain(lookup.panel_rows(spark.read.parquet(path), LOOKUP_PANEL))


def panel_power_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(series.panel_series(to_raw(fixture.readings(spark, sf_dir))))


def panel_power_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rows of the series, which is what the limit is for."""
    return plain(series.panel_series(to_raw(fixture.readings(spark, sf_dir)), FIRST_ROWS))


def panel_window_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(series.window_series(_windows(spark, sf_dir)), WINDOW_POWER)


def panel_window_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first windows of an hour each, cut among those that end at the same time."""
    return plain(series.first_windows(
        fixture.readings(spark, sf_dir), FIRST_WINDOWS, "1 hour"), WINDOW_POWER)


def readings_in_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lookup.around(fixture.readings(spark, sf_dir), AS_OF)
    return rows.select(PANEL, POWER, STATUS, EVENT_TIME)


def panel_power_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(_windows(spark, sf_dir), WINDOW_POWER)


def panel_power_window_1h(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(_windows(spark, sf_dir, "1 hour"), WINDOW_POWER)


def fleet_power_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(fleet.fleet_power(_windows(spark, sf_dir)), WINDOW_POWER)


def fleet_power_in_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a dashboard shows at one moment: the fleet over the last hours."""
    return plain(fleet.fleet_power_around(fixture.readings(spark, sf_dir), AS_OF), WINDOW_POWER)


def fleet_power_from_wire(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole way: topic, decode, timed rows, windows, fleet."""
    timed = decode(mixed_topic(spark, sf_dir)).filter(is_timed())
    return plain(fleet.fleet_power(panel_power(timed)), WINDOW_POWER)


def panel_power_of_timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of readings some of which have a panel but no time."""
    time = F.when(F.col("ingest_seq") % 7 != 0, F.col(EVENT_TIME))
    rows = fixture.readings(spark, sf_dir).withColumn(EVENT_TIME, time)
    return plain(panel_power(rows), WINDOW_POWER)


def fleet_energy_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(fleet.fleet_energy(_windows(spark, sf_dir)), "energy_wh")


def fleet_energy_window_1h(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(fleet.fleet_energy(_windows(spark, sf_dir, "1 hour")), "energy_wh")


def fleet_energy_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(fleet.total_energy(_windows(spark, sf_dir)), "energy_wh")


def latest_panel_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fleet.latest_status(fixture.readings(spark, sf_dir), "ingest_seq")


def latest_panel_status_of_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from the messages, by broker time, partition and offset."""
    valid, _ = split_valid(
        decode(mixed_topic(spark, sf_dir), "timestamp", "partition", "offset"))
    return fleet.latest_status_of_topic(valid)


def latest_fleet_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(fleet.latest_fleet_power(fixture.readings(spark, sf_dir)), WINDOW_POWER)


def panel_power_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fleet.power_histogram(_windows(spark, sf_dir))


def fleet_power_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fleet.power_histogram(_windows(spark, sf_dir), combine=True)


def panel_power_histogram_auto(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fleet.power_histogram_auto(_windows(spark, sf_dir))


def panel_power_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = fleet.panels_wide(_windows(spark, sf_dir), WIDE_PANELS)
    return plain(wide, *[name for name in wide.columns if name != WINDOW_END])


def expected_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The curve with a start for each panel."""
    panel = F.col(PANEL).cast("long")
    curve = expected_power(F.col(EVENT_TIME), start_hour=6 + panel % 12, start_minute=panel % 60)
    rows = fixture.readings(spark, sf_dir).select(PANEL, EVENT_TIME, curve.alias("expected_power"))
    return plain(rows, "expected_power")


def expected_output_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wide curve: a six-hour day from nine o'clock, exponent 1."""
    curve = expected_power(F.col(EVENT_TIME), start_hour=9, hours=6, exponent=1)
    rows = fixture.readings(spark, sf_dir).select(PANEL, EVENT_TIME, curve.alias("expected_power"))
    return plain(rows, "expected_power")


QUERIES = {
    query.__name__: query
    for query in (
        decode_readings, wire_messages, wire_roundtrip, accepted_readings, rejected_readings,
        shifted_readings, raw_readings, raw_readings_stored, raw_table_created, panel_lookup,
        panel_lookup_json, panel_lookup_stored, panel_power_series, panel_power_first,
        panel_window_series, panel_window_first, readings_in_range, panel_power_window,
        panel_power_window_1h, panel_power_of_timed, fleet_power_window, fleet_power_in_range,
        fleet_power_from_wire, fleet_energy_window, fleet_energy_window_1h, fleet_energy_total,
        latest_panel_status,
        latest_panel_status_of_topic, latest_fleet_power, panel_power_histogram,
        fleet_power_histogram, panel_power_histogram_auto, panel_power_wide, expected_output, expected_output_day,
    )
}
