"""Windows as sums and counts that are added up: late rows, lost checkpoints, pruned reads."""

import re
from datetime import date, timedelta

import pytest
from helpers import messages, rows, scans, wire
from pyspark.sql import functions as F

from sunmeter.functions.wire import decode
from sunmeter.operators.quality import is_ahead, with_arrival
from sunmeter.operators.windows import merged_parts, panel_power, power_of_parts, power_parts
from sunmeter.plans.replay import replay
from sunmeter.sinks import tables
from sunmeter.sinks.files import exists, names
from sunmeter.sources.messages import read_landing
from sunmeter.streaming import jobs, pipeline

NOW = jobs.ALL_AVAILABLE


def at(time, power=1.0, panel="a"):
    return wire(panel, power, f"2024-01-{time}")


class Topic:
    """A landing folder and the table of parts that a job makes of it."""

    def __init__(self, spark, path):
        self.spark, self.landing, self.root = spark, str(path / "landing"), str(path / "out")
        self.checkpoint, self.sent = str(path / "checkpoint"), 0
        self.tables = pipeline.Tables(spark, self.root)

    def play(self, *texts, partition=0):
        sent = messages(self.spark, list(texts), self.sent).withColumn(
            "partition", F.lit(partition))
        self.sent += len(texts)
        replay([sent] if texts else [sent.limit(0)], self.landing, lambda: [
            jobs.start_panel_power_parts(
                read_landing(self.spark, self.landing), self.tables.parts, self.checkpoint, NOW, 1)])

    def windows(self, **options):
        return rows(self.tables.merged_windows(**options), "Panel_id", "total_power", "window_start")


@pytest.fixture
def topic(spark, tmp_path):
    return Topic(spark, tmp_path)


def test_parts_of_any_split_make_the_same_means(spark):
    sent = messages(spark, [at(f"15 12:00:{s:02}", 10.0 * s, p) for s in range(60) for p in "ab"])
    readings = decode(sent, "partition", "offset")
    want = rows(panel_power(readings))
    halves = [power_parts(readings.filter(F.col("offset") % 2 == k)) for k in (0, 1)]
    parts = halves[0].unionAll(halves[1])
    assert rows(power_of_parts(parts)) == want == rows(power_of_parts(merged_parts(parts)))
    assert rows(merged_parts(parts), "through") == rows(power_parts(readings), "through")


def test_windows_without_any_power_have_none(spark):
    readings = decode(messages(spark, [at("15 12:00:00")]), "partition", "offset").withColumn(
        "power_panel", F.lit(None).cast("double"))
    assert rows(power_of_parts(power_parts(readings)), "total_power") == [(None,)]


def test_late_rows_are_added_whenever_they_come(topic):
    topic.play(at("15 12:00:00", 10.0), at("15 12:00:10", 30.0), "nope")
    topic.play(at("20 12:00:00", 5.0))
    topic.tables.upkeep()
    topic.play(at("15 12:00:20", 50.0), at("16 12:00:00", 7.0))
    topic.play(at("15 12:00:25", 70.0))
    want = [("a", 40.0, "2024-01-15 12:00:00"), ("a", 5.0, "2024-01-20 12:00:00"),
            ("a", 7.0, "2024-01-16 12:00:00")]
    for _ in range(2):
        assert topic.windows() == want
        topic.tables.upkeep()
    assert topic.windows(days=[date(2024, 1, 15)]) == want[:1]
    assert topic.windows(days=[]) == []


def test_no_reading_is_read_for_them(topic):
    topic.play(at("15 12:00:00"))
    topic.play(at("15 12:00:10"))
    topic.tables.parts.fold()
    text = scans(topic.tables.merged_windows())
    assert names(topic.spark, topic.root) == ["parts"]
    assert "value" not in re.findall(r"ReadSchema: (.*)", text)[0] and "/readings" not in text
    assert text.count("Exchange hashpartitioning") == 1 or text.count("+- Exchange") == 1


def test_a_lost_checkpoint_counts_nothing_twice(topic, tmp_path):
    topic.play(at("15 12:00:00", 10.0), at("15 12:00:05", 20.0))
    topic.play(at("15 12:00:10", 30.0), partition=1)
    for folded in (False, True):
        if folded:
            topic.tables.parts.fold(newest=True)
            topic.tables.parts.clean()
        topic.checkpoint = str(tmp_path / f"new-{folded}")
        topic.play()  # the whole topic from its start
        assert topic.windows() == [("a", 20.0, "2024-01-15 12:00:00")]
    topic.play(at("15 12:00:15", 60.0))
    topic.play(at("15 12:00:20", 30.0), partition=7)
    assert topic.windows() == [("a", 30.0, "2024-01-15 12:00:00")]


def test_a_batch_that_broke_off_is_replaced(topic, tmp_path):
    topic.play(at("15 12:00:00", 10.0))
    path = topic.tables.parts.path
    half = topic.spark.read.parquet(f"{path}/batches").drop("batch_id")
    half.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(
        f"{path}/batches/batch_id=1")
    assert not exists(topic.spark, f"{path}/batches/batch_id=1/_SUCCESS")
    topic.checkpoint = str(tmp_path / "new")
    topic.play(at("15 12:00:10", 30.0))
    assert topic.windows() == [("a", 20.0, "2024-01-15 12:00:00")]


def test_repair_reads_the_files_of_its_days_only(spark, tmp_path):
    table = tables.readings_table(spark, str(tmp_path / "readings"))
    first = date(2024, 1, 1)
    sent = [wire("a", 1.0, f"{first + timedelta(days=k)} 12:00:00") for k in range(30)]
    sent += [wire("p" * 251, 2.0, f"{first + timedelta(days=k)} 12:00:00") for k in range(30)]
    arrived = messages(spark, sent).withColumn("timestamp", F.lit("2024-02-20").cast("timestamp"))
    write = table.write(1)
    decoded = decode(arrived, "topic", "partition", "offset", "timestamp", raw=True)
    write(tables.by_kind(decoded), 0)
    table.fold(newest=True)
    table.clean()
    near = [first + timedelta(days=k) for k in (9, 10, 11)]
    found = tables.read_timed(table, days=near)
    assert len({re.search(r"day=([\d-]+)", name)[1] for name in found.inputFiles()}) == 3
    assert len(tables.read_timed(table).inputFiles()) >= 30
    assert rows(found, "power_panel", "day") == [
        (power, day) for power in (1.0, 2.0) for day in near]  # rejects lie by their stamps too


def test_only_the_brokers_clock_may_be_ahead_of_ours(spark):
    later = F.lit("2999-01-01").cast("timestamp")
    sent = messages(spark, [wire("a", 1.0, "2999-01-01 00:00:00")] * 4).withColumn(
        "timestamp", F.when(F.col("offset") < 3, later)).withColumn(
        "timestampType", F.when(F.col("offset") < 2, F.col("offset").cast("int")))
    found = with_arrival(sent)
    known = decode(found, "offset", "timestamp").withColumn("is_ahead", is_ahead())
    assert rows(known, "offset", "is_ahead") == [(0, True), (1, False), (2, True), (3, False)]
    assert rows(found.filter("timestamp < '2900-01-01'"), "offset") == [(0,), (2,)]
