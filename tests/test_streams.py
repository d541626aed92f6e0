from datetime import date
from decimal import Decimal

import pytest
from helpers import messages, rows, wire
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F
from pyspark.sql import types as T
from sunmeter.functions.wire import decode
from sunmeter.operators.fleet import latest_of_partitions
from sunmeter.operators.windows import panel_power
from sunmeter.plans import stream
from sunmeter.plans.replay import replay
from sunmeter.schema import RAW_SCHEMA
from sunmeter.sinks import tables
from sunmeter.sinks.files import names
from sunmeter.sources.messages import read_landing
from sunmeter.streaming import jobs, pipeline

NOW = jobs.ALL_AVAILABLE
EVER = "30000 days"  # messages() counts broker time from 1970


class Site:
    """Folders of one streaming job."""

    def __init__(self, spark, path):
        self.spark = spark
        self.landing, self.out, self.checkpoint = (
            str(path / n) for n in ("landing", "out", "checkpoint"))
        self.sent = 0

    def batch(self, *texts):
        df = messages(self.spark, list(texts), self.sent)
        self.sent += len(texts)
        return df

    def stream(self):
        return read_landing(self.spark, self.landing)

    def play(self, batches, start):
        return replay([self.batch(*texts) for texts in batches], self.landing, start)


@pytest.fixture
def site(spark, tmp_path):
    return Site(spark, tmp_path)


def at(minute, second=0, hour=12, panel="a", power=1.0):
    return wire(panel, power, f"2024-01-15 {hour:02}:{minute:02}:{second:02}")


def test_raw_rows_once_across_restarts(spark, site):
    def start():
        return [jobs.start_raw(decode(site.stream()), site.out, site.checkpoint, NOW, files=1)]

    site.play([[at(0), "nope"], [at(1), at(2, panel="b")]], start)
    start()[0].awaitTermination()  # nothing new
    got = spark.read.parquet(site.out)
    assert rows(got, "Panel_id", "time_data") == [
        ("a", "2024-01-15 12:00:00"), ("a", "2024-01-15 12:01:00"), ("b", "2024-01-15 12:02:00")]
    assert "day" in got.columns


def test_ingest_splits_in_one_pass(spark, site):
    table = tables.readings_table(spark, site.out)

    def start():
        return [jobs.start_ingest(
            site.stream(), table, site.checkpoint, NOW, files=1, ahead=EVER)]

    site.play([[at(0, power=390.25), "nope", None], ["{}", at(1)]], start)
    assert [str(p) for p, in rows(tables.read_raw(table), "power_panel")] == ["1.000", "390.250"]
    assert rows(tables.read_rejects(table), "offset", "raw_value") == [
        (1, "nope"), (2, None), (3, "{}")]
    assert table.read().filter("kind = 'valid' and raw_value is not null").count() == 0


def windows_job(site, **options):
    table = tables.windows_table(site.spark, site.out)

    def start():
        return [jobs.start_panel_power_update(
            decode(site.stream()), table.write(1), site.checkpoint, trigger=NOW, **options)]

    return table, start


def test_update_emits_again_and_the_latest_wins(spark, site):
    table, start = windows_job(site)
    site.play([[at(0, 0, power=100), at(0, 10, power=200)], [at(0, 20, power=300)]], start)
    emitted = spark.read.parquet(f"{site.out}/batches")
    assert rows(emitted, "total_power") == [(150.0,), (200.0,)]
    assert rows(table.read(), "Panel_id", "total_power") == [("a", 200.0)]


def skewed():
    """An active panel one hour ahead of the heartbeats of another."""
    return [[at(2 * i, hour=13, panel="on"), at(2 * i, panel="off", power=0.0)] for i in range(4)]


@pytest.fixture
def drops(spark):
    counter = jobs.DropCounter()
    spark.streams.addListener(counter)
    yield counter
    spark.streams.removeListener(counter)


def total(spark, drops):
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    return sum(drops.dropped.values())


def test_heartbeats_one_hour_behind_are_kept(spark, site, drops):
    table, start = windows_job(site)
    site.play(skewed(), start)
    assert total(spark, drops) == 0
    batch = panel_power(decode(spark.read.parquet(site.landing)))
    assert rows(table.read()) == rows(batch) and table.read().count() == 8


def test_a_short_delay_drops_them_and_tells(spark, site, drops):
    table, start = windows_job(site, delay="30 seconds")
    site.play(skewed(), start)
    got = table.read()
    assert got.filter("Panel_id = 'off'").count() == 1
    assert got.filter("Panel_id = 'on'").count() == 4
    assert total(spark, drops) == 3  # over all four runs of the query


def test_append_gives_each_closed_window_once(spark, site):
    def start():
        return [jobs.start_panel_power_append(
            decode(site.stream()), site.out, site.checkpoint, delay="1 minute", trigger=NOW)]

    site.play([[at(0, power=10), at(0, 20, power=20)], [at(5, power=7)], [at(9)]], start)
    got = spark.read.parquet(site.out)
    assert rows(got, "window_end", "total_power") == [
        ("2024-01-15 12:00:30", 15.0), ("2024-01-15 12:05:30", 7.0)]


def test_latest_status_stream(spark, site):
    table = tables.status_table(spark, site.out)

    def start():
        readings = decode(site.stream(), "partition", "offset", "timestamp")
        return [jobs.start_latest_status(readings, table, site.checkpoint, NOW)]

    def sent(partition, offset, second, status, panel="a"):
        text = wire(panel, 0.0, "2024-01-15 11:00:00", status=status)
        return messages(spark, [text], offset).withColumn("partition", F.lit(partition)).withColumn(
            "timestamp", F.timestamp_seconds(F.lit(second)))

    moved = [sent(0, 100, 10, 1), sent(1, 0, 20, 0), sent(1, 1, 15, 1, "b")]
    replay(moved, site.landing, start)  # a smaller offset, on another partition, later
    assert rows(latest_of_partitions(table.read())) == [("a", 0), ("b", 1)]
    table.fold()
    table.clean()
    assert rows(latest_of_partitions(table.read())) == [("a", 0), ("b", 1)]
    replay([sent(0, 101, 30, 1)], site.landing, start)
    assert rows(latest_of_partitions(table.read())) == [("a", 1), ("b", 1)]


def test_a_failed_batch_is_replaced_not_repeated(spark, site):
    table = tables.windows_table(spark, site.out)
    failures = ["first try"]

    def write_then_fail(batch, batch_id):
        table.write(1)(batch, batch_id)
        if failures:
            raise RuntimeError(failures.pop())

    def start():
        return jobs.start_panel_power_update(
            decode(site.stream()), write_then_fail, site.checkpoint, trigger=NOW)

    site.batch(at(0, power=5.0)).write.parquet(site.landing)
    jobs.supervise(spark, {"power": start}, restarts=1, pause=0)
    assert not failures
    assert rows(spark.read.parquet(f"{site.out}/batches"), "total_power", "batch_id") == [(5.0, 0)]


def failing(site, times):
    left = [None] * times

    def fail(batch, batch_id):
        if left:
            left.pop()
            raise RuntimeError("again")

    def start():
        return jobs.start_panel_power_update(
            decode(site.stream()), fail, site.checkpoint, trigger=NOW)

    return start, left


def test_failures_in_a_row_are_bounded(spark, site):
    start, _ = failing(site, 99)
    site.batch(at(0)).write.parquet(site.landing)
    with pytest.raises(StreamingQueryException):
        jobs.supervise(spark, {"power": start}, restarts=1, pause=0)


def test_failures_with_quiet_between_them_are_not(spark, site):
    start, left = failing(site, 4)
    site.batch(at(0)).write.parquet(site.landing)
    jobs.supervise(spark, {"power": start}, restarts=1, pause=0, quiet=0)
    assert not left


def test_raw_batches_in_stored_form(spark, site):
    def write(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{site.out}/batch_id={batch_id}")

    def start():
        return [jobs.start_raw_batches(decode(site.stream()), write, site.checkpoint, NOW)]

    site.play([[at(0, power=0.0005), "nope"], [at(1)]], start)
    got = spark.read.schema(T.StructType([*RAW_SCHEMA.fields[:4], T.StructField(
        "batch_id", T.LongType())])).parquet(site.out)
    assert [(str(p), b) for p, b in rows(got, "power_panel", "batch_id")] == [
        ("0.001", 0), ("1.000", 1)]


def run_pipeline(spark, site, *batches, **options):
    for batch in batches:
        site.batch(*batch).write.mode("append").parquet(site.landing)
        starts = pipeline.starts(
            site.stream(), site.out, trigger=NOW, files=1, ahead=EVER, **options)
        jobs.supervise(spark, {name: starts[name] for name in ("ingest", "windows")}, restarts=0)
    return pipeline.Tables(spark, site.out)


def test_pipeline_feeds_all_tables(spark, site):
    found = run_pipeline(
        spark, site, [at(0, power=10.0), "nope"], [at(0, 20, power=20.0), at(9, hour=14)])
    want = [(1.0, "2024-01-15 14:09:30"), (15.0, "2024-01-15 12:00:30")]
    for _ in range(2):
        assert found.raw().count() == 3
        assert rows(found.rejects(), "raw_value") == [("nope",)]
        assert rows(found.current_windows(), "total_power", "window_end") == want
        assert rows(found.final_windows(), "total_power") == [(15.0,)]
        found.upkeep()


def test_nothing_has_come_yet(spark, site):
    found = pipeline.Tables(spark, site.out)
    found.upkeep()
    assert found.raw().count() == found.current_windows().count() == 0
    assert found.final_windows().count() == 0


def test_late_rows_are_repaired_from_the_raw_table(spark, site):
    found = run_pipeline(
        spark, site, [at(0, power=10.0), at(30, hour=13)], [at(0, 20, power=20.0), at(40, hour=13)],
        delay="1 minute")
    missed = found.current_windows().filter("window_start < '2024-01-15 13:00:00'")
    assert rows(missed, "total_power") == [(10.0,)]
    found.repair([date(2024, 1, 15)])
    assert rows(found.current_windows(), "total_power", "window_start") == [
        (1.0, "2024-01-15 13:30:00"), (1.0, "2024-01-15 13:40:00"), (15.0, "2024-01-15 12:00:00")]


def test_only_days_of_rows_that_could_be_dropped_are_repaired(spark, site):
    def sent(offset, day, arrived):
        rows_of = messages(spark, [wire("a", 1.0, f"2024-01-{day} 12:00:00")], offset)
        return rows_of.withColumn("timestamp", F.lit(f"2024-01-{arrived}").cast("timestamp"))

    def start():
        return [jobs.start_ingest(site.stream(), found.readings, site.checkpoint, NOW, files=1)]

    found = pipeline.Tables(spark, site.out)
    replay([sent(0, 15, "15 12:00:10"), sent(1, 16, "16 12:00:16"), sent(2, 17, "20 00:00:00"),
            sent(3, 18, "18 11:00:00")], site.landing, start)
    assert found.late_days() == [date(2024, 1, 16), date(2024, 1, 17)]
    assert found.late_days(ahead="1 hour 30 seconds")[0] == date(2024, 1, 15)
    found.readings.fold(newest=True)
    assert found.late_days() == []


def test_a_broken_clock_is_a_reject_and_stops_no_window(spark, site):
    sent = messages(spark, [wire("b", 1.0, "2999-01-01 00:00:00"), at(0)])
    noon = F.lit("2024-01-15 12:00:00").cast("timestamp")
    batches = [sent, messages(spark, [at(1)], 2), messages(spark, [at(2)], 3)]

    def start():
        starts = pipeline.starts(site.stream(), site.out, trigger=NOW, files=1)
        return [starts[name]() for name in ("ingest", "windows")]

    replay([batch.withColumn("timestamp", noon) for batch in batches], site.landing, start)
    found = pipeline.Tables(spark, site.out)
    assert found.current_windows().count() == found.raw().count() == 3
    assert rows(found.rejects(), "offset") == [(0,)]


def test_repaired_days_keep_what_the_raw_table_cannot_hold(spark, site):
    long, huge = "p" * 251, 1e18
    found = run_pipeline(
        spark, site, [at(0, power=10.0), at(0, power=huge, panel="b"), at(0, panel=long, power=2.0),
                      at(1, power=0.0004), at(30, hour=13)],
        [at(0, 20, power=huge), at(0, 20, panel=long, power=4.0), at(40, hour=13)],
        delay="1 minute")
    early = "window_start < '2024-01-15 13:00:00'"
    found.repair([date(2024, 1, 15)], ahead=EVER)
    assert rows(found.current_windows().filter(early), "Panel_id", "total_power") == sorted(
        [("a", (10.0 + huge) / 2), ("a", 0.0004), ("b", huge), (long, 3.0)])


def test_late_rejects_are_seen(spark, site):
    def sent(offset, panel, power, day):
        return messages(spark, [wire(panel, power, f"2024-01-{day} 12:00:00")], offset).withColumn(
            "timestamp", F.lit("2024-01-20").cast("timestamp"))

    def start():
        return [jobs.start_ingest(site.stream(), found.readings, site.checkpoint, NOW, files=1)]

    found = pipeline.Tables(spark, site.out)
    replay([sent(0, "p" * 251, 1.0, 15), sent(1, "a", 1e18, 16)], site.landing, start)
    assert found.late_days() == [date(2024, 1, 15), date(2024, 1, 16)]


def test_a_windows_query_that_lags_loses_no_repair(spark, site):
    def sent(offset, time, power, arrived):
        return messages(spark, [wire("a", power, f"2024-01-{time}")], offset).withColumn(
            "timestamp", F.lit(f"2024-01-{arrived}").cast("timestamp"))

    def start(name, messages_of):
        return lambda: [pipeline.starts(
            messages_of(), site.out, trigger=NOW, files=1, delay="1 minute")[name]()]

    batches = [sent(0, "15 12:00:00", 10.0, "15 12:00:00"),
               sent(1, "16 12:00:00", 1.0, "16 12:00:00"),
               sent(2, "15 12:00:20", 20.0, "16 12:00:10"), sent(3, "17 12:00:00", 1.0, "17 12:00:00"),
               sent(4, "18 12:00:00", 1.0, "18 12:00:00")]
    found = pipeline.Tables(spark, site.out)
    noon = "window_start = '2024-01-15 12:00:00'"
    for batch in batches:
        replay([batch], site.landing, start("ingest", site.stream))
    found.upkeep("1 minute")
    assert rows(found.current_windows().filter(noon), "total_power") == [(15.0,)]
    again = site.landing + "2"
    for batch in batches:  # the windows query comes to the same messages afterwards
        replay([batch], again, start("windows", lambda: read_landing(spark, again)))
    assert rows(found.current_windows().filter(noon), "total_power") == [(10.0,)]
    found.upkeep("1 minute")
    assert rows(found.current_windows().filter(noon), "total_power") == [(15.0,)]


def test_each_reading_once_though_sent_again(spark, site):
    def start():
        return [jobs.start_raw_once(
            site.stream(), site.out, site.checkpoint, "10 minutes", NOW, files=1, ahead=EVER)]

    first = [at(0), at(1), at(0, panel="b"), at(1, power=2.0)]
    runs = site.play([first + first, first, [at(40)], first], start)
    assert rows(spark.read.parquet(site.out), "Panel_id", "power_panel", "time_data") == sorted([
        *[(p, power, f"2024-01-15 12:{m:02}:00") for p, power, m in (
            ("a", Decimal("1.000"), 0), ("a", Decimal("1.000"), 1), ("b", Decimal("1.000"), 0),
            ("a", Decimal("2.000"), 1), ("a", Decimal("1.000"), 40))]], key=repr)
    left = [query.lastProgress.stateOperators[0].numRowsTotal for query in runs]
    assert max(left) <= 5 and left[-1] == 1  # what the watermark has passed is forgotten


def test_fleet_energy_of_closed_windows(spark, site):
    def start():
        return [jobs.start_fleet_energy(
            decode(site.stream()), site.out, site.checkpoint, "1 minute", trigger=NOW)]

    site.play([[at(0, power=100.0), at(0, 10, power=300.0), at(0, 20, power=50.0, panel="b"), "no"],
               [at(0, 25, power=150.0, panel="b")], [at(5)], [at(9)]], start)
    got = spark.read.parquet(site.out)
    assert rows(got.withColumn("energy_wh", F.round("energy_wh", 6)), "window_end", "energy_wh") == [
        ("2024-01-15 12:00:30", 2.5), ("2024-01-15 12:05:30", 0.008333)]


def test_two_clocks_need_no_patience(spark, site, drops):
    table, start = windows_job(site, delay="30 seconds", two_clocks=True)
    site.play(skewed(), start)
    assert total(spark, drops) == 0
    batch = panel_power(decode(spark.read.parquet(site.landing)))
    assert rows(table.read()) == rows(batch) and table.read().count() == 8


def test_the_ledger_adds_up(spark, site):
    found = run_pipeline(
        spark, site, [at(0), "nope", at(1), None], ["{}", at(2)], [at(30, hour=9)])
    want = [(0, 4, 2, 2, 2), (1, 2, 1, 1, 1), (2, 1, 1, 0, 1)]  # all may be late, guard off
    for _ in range(2):
        assert rows(found.ledger.read().drop("noted")) == want
        found.upkeep()
    rows_of = spark.read.parquet(site.landing).count()
    assert found.ledger.read().agg(F.sum("read")).first()[0] == rows_of


def test_the_ledger_counts_what_may_be_late(spark, site):
    table, ledger = tables.readings_table(spark, site.out), tables.ledger_table(
        spark, site.out + "-ledger")

    def start():
        return [jobs.start_ingest(
            site.stream(), table, site.checkpoint, NOW, files=1, ledger=ledger)]

    sent = [messages(spark, [at(0), at(1), "x"]).withColumn(
        "timestamp", F.lit(f"2024-01-15 12:01:{s}").cast("timestamp")) for s in ("10", "20")]
    replay(sent, site.landing, start)
    assert rows(ledger.read().drop("noted")) == [(0, 3, 2, 1, 1), (1, 3, 2, 1, 2)]


def test_rejects_that_are_left_out_are_counted(spark, site, drops):
    def start():
        return [jobs.start_raw(decode(site.stream()), site.out, site.checkpoint, NOW, files=1)]

    site.play([[at(0), "nope", "{}"], [at(1), None]], start)
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    assert sum(drops.rejected.values()) == 3


def test_a_null_panel_makes_no_window_and_a_bad_stamp_ends_no_stream(spark, site):
    noon = F.lit("2024-01-15 12:10:00").cast("timestamp")

    def start():
        return [jobs.start_panel_power_append(
            decode(site.stream(), "timestamp"), site.out, site.checkpoint, "1 minute", trigger=NOW)]

    sent = [messages(spark, list(texts), 5 * k).withColumn("timestamp", noon) for k, texts in enumerate((
        [at(0), wire("b", 1.0, "2999-01-01 00:00:00"), '{"time_data":"2024-01-15 12:00:00"}'],
        [at(0, 20, power=3.0), at(9)]))]
    replay(sent, site.landing, start)
    assert rows(spark.read.parquet(site.out), "Panel_id", "total_power") == [("a", 2.0)]


@pytest.mark.parametrize("name", ["ingest", "windows"])
def test_a_large_batch_is_written_by_many_tasks(spark, name):
    sent = messages(spark, [
        wire(f"p{i}", 1.0, f"2024-01-15 12:{i % 60:02}:00") for i in range(200)]).withColumn(
        "timestamp", F.lit("2024-01-15 12:59:00").cast("timestamp")).repartition(4)
    root = stream.play(spark, "tasks", [sent], stream._pipeline(name))
    kept = pipeline.Tables(spark, root)
    table = {"ingest": kept.readings, "windows": kept.windows}[name]
    files = [file for file in names(spark, table.batch_folder(0)) if file.startswith("part")]
    assert len(files) >= 4 and table.rows().count() == 200


def test_state_of_a_slice_is_saved_whole(spark):
    """A start reads what is left of the state, not all that the slices before put in and removed."""
    late = stream._late(spark, "/root/testdata/sf0.001", 2)
    root = stream.play(spark, "whole", late, stream._pipeline("windows", delay="30 seconds"))
    for part in range(stream.STATE_PARTITIONS):
        saved = names(spark, f"{root}/checkpoints/windows/state/0/{part}")
        assert not [name for name in saved if name.endswith(".changelog")]
        assert {f"{version}.zip" for version in (1, 2, 3)} <= set(saved)
