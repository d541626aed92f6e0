"""Windows that close by their own panel's clock; states handed on between checkpoints."""

import pytest
from helpers import messages, rows, wire
from pyspark.sql import functions as F

from sunmeter.functions.wire import decode
from sunmeter.operators.windows import panel_power, power_of_parts
from sunmeter.plans.replay import replay
from sunmeter.session import SHUFFLE_PARTITIONS
from sunmeter.sinks.tables import parts_table
from sunmeter.sources.messages import read_landing
from sunmeter.streaming import jobs, own_clock

NOW = jobs.ALL_AVAILABLE


def at(time, power=1.0, panel="a", day="2024-01-15"):
    return wire(panel, power, f"{day} {time}")


class Site:
    def __init__(self, spark, path):
        self.spark, self.path, self.sent = spark, path, 0
        self.landing = str(path / "landing")
        self.table = parts_table(spark, str(path / "parts"))

    def play(self, *texts, checkpoint="checkpoint", **options):
        sent = messages(self.spark, list(texts), self.sent)
        self.sent += len(texts)
        found = replay([sent], self.landing, lambda: [own_clock.start_panel_power_own_clock(
            read_landing(self.spark, self.landing), self.table, str(self.path / checkpoint),
            "1 minute", trigger=NOW, files=1, **options)])
        return found[0]

    def windows(self):
        return rows(power_of_parts(self.table.rows()), "Panel_id", "total_power", "window_start")


@pytest.fixture
def site(spark, tmp_path):
    return Site(spark, tmp_path)


def test_a_broken_clock_closes_its_own_windows_only(site):
    site.play(at("12:00:00", 10.0, "b"), at("00:00:00", 9.0, "a", "2999-01-01"))
    site.play(at("12:00:10", 30.0, "b"), at("12:05:00", 5.0, "b"))
    site.play(at("12:00:00", 7.0), at("00:09:00", 1.0, "a", "2999-01-01"))
    assert site.windows() == [("a", 7.0, "2024-01-15 12:00:00"), ("a", 9.0, "2999-01-01 00:00:00"),
                              ("b", 20.0, "2024-01-15 12:00:00")]


def test_late_readings_are_parts_of_what_was_said(site):
    site.play(at("12:00:00", 10.0), at("12:09:00"))
    assert site.windows() == [("a", 10.0, "2024-01-15 12:00:00")]
    site.play(at("12:00:20", 40.0), at("12:00:25", 10.0))
    assert site.windows() == [("a", 20.0, "2024-01-15 12:00:00")]


def test_many_readings_in_any_order_lose_nothing(spark, site):
    def texts(k):
        return [at(f"12:{(7 * i + k) % 60:02}:{(13 * i) % 60:02}", float(i), panel)
                for i in range(60) for panel in "abc"]

    for k in range(3):
        site.play(*texts(k), "nope", None)
    last = [at("18:00:00", panel=panel) for panel in "abc"]
    site.play(*last)
    sent = messages(spark, [text for k in range(3) for text in texts(k)])
    assert rows(power_of_parts(site.table.rows())) == rows(panel_power(decode(sent)))


def test_silent_panels_leave_the_state(spark, site):
    site.play(at("12:00:00", 10.0), at("12:00:00", 3.0, "b"), quiet="1 millisecond")
    assert site.windows() == []
    query = site.play(at("12:00:00", 3.0, "c"), quiet="2 hours")
    assert site.windows() == [("a", 10.0, "2024-01-15 12:00:00"), ("b", 3.0, "2024-01-15 12:00:00")]
    state = own_clock.open_windows(spark, str(site.path / "checkpoint"))
    assert rows(state, "Panel_id") == [("c",)]
    assert query.lastProgress is not None
    site.play(at("12:00:10", 30.0))  # what comes after all is a part like any other
    site.play(at("12:30:00"))
    assert ("a", 20.0, "2024-01-15 12:00:00") in site.windows()


def test_a_state_goes_on_with_other_partitions(spark, site):
    site.play(at("12:00:00", 10.0), at("12:00:00", 4.0, "b"))
    state = own_clock.open_windows(spark, str(site.path / "checkpoint"))
    before = spark.conf.get(SHUFFLE_PARTITIONS)
    spark.conf.set(SHUFFLE_PARTITIONS, 3)
    site.landing += "-new"
    site.table = parts_table(spark, str(site.path / "new"))
    try:
        site.play(at("12:00:10", 30.0), at("12:09:00"), at("12:09:00", 1.0, "b"),
                  checkpoint="new-checkpoint", state=state)
    finally:
        spark.conf.set(SHUFFLE_PARTITIONS, before)
    assert site.windows() == [("a", 20.0, "2024-01-15 12:00:00"), ("b", 4.0, "2024-01-15 12:00:00")]
    again = own_clock.open_windows(spark, str(site.path / "new-checkpoint"))
    numbers = spark.read.format("statestore").option("path", str(
        site.path / "new-checkpoint")).option("stateVarName", own_clock.STATE).load()
    assert again.count() == 2 and numbers.agg(F.max("partition_id")).first()[0] < 3


def test_state_is_by_bucket_and_silence_by_panel(spark, site, monkeypatch):
    monkeypatch.setattr(own_clock, "BUCKETS", 2, raising=False)
    site.play(*[at("12:00:00", float(i), f"p{i}") for i in range(40)])
    stored = spark.read.format("statestore").option("path", str(
        site.path / "checkpoint")).option("stateVarName", own_clock.STATE).load()
    assert stored.count() <= 2
    assert own_clock.open_windows(spark, str(site.path / "checkpoint")).count() == 40
    site.play(at("12:00:10", 3.0, "p1"), at("12:09:00", 5.0, "p1"))
    assert site.windows() == [("p1", 2.0, "2024-01-15 12:00:00")]


def test_a_silent_panel_goes_and_its_buckets_others_stay(spark, site, monkeypatch):
    monkeypatch.setattr(own_clock, "BUCKETS", 1, raising=False)
    site.play(at("12:00:00", 10.0), at("12:00:00", 3.0, "b"), quiet="1 millisecond")
    site.play(at("12:00:10", 30.0), quiet="2 hours")  # "a" sends, and the timer goes off
    assert site.windows() == [("b", 3.0, "2024-01-15 12:00:00")]
    state = own_clock.open_windows(spark, str(site.path / "checkpoint"))
    assert rows(state, "Panel_id") == [("a",)]
    site.play(at("12:09:00"))
    assert ("a", 20.0, "2024-01-15 12:00:00") in site.windows()
