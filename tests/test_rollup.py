"""The pyramid of windows, hours and days against sums over the windows."""

from datetime import date

import pytest
from helpers import messages, rows, scans, wire
from pyspark.sql import functions as F

from sunmeter.functions.wire import decode
from sunmeter.operators.fleet import fleet_energy
from sunmeter.operators.windows import power_of_parts, power_parts
from sunmeter.sinks.rollup import Rollup
from sunmeter.sinks.tables import parts_table

GRAINS = ("30 seconds", "1 hour", "1 day")


class Pyramid:
    def __init__(self, spark, path):
        self.spark, self.path, self.number = spark, str(path), 0
        self.parts = parts_table(spark, f"{path}/parts")
        self.rollup = Rollup(spark, f"{path}/rollup", self.parts)

    def add(self, *readings):
        sent = messages(self.spark, [
            wire(panel, power, f"2024-{time}") for panel, power, time in readings])
        self.parts.write(1)(power_parts(decode(sent, "partition", "offset")), self.number)
        self.number += 1

    def wanted(self, grain):
        unit = {"30 seconds": "second", "1 hour": "hour", "1 day": "day"}[grain]
        energy = fleet_energy(power_of_parts(self.parts.rows())).withColumn(
            "start", F.date_trunc(unit, F.col("window_end") - F.expr("INTERVAL '30 seconds'")))
        return rows(energy.groupBy("start").agg(
            F.round(F.sum("energy_wh"), 9).alias("energy_wh"), F.count("*").alias("windows")))

    def got(self, grain):
        return rows(self.rollup.read(grain).select(
            "start", F.round("energy_wh", 9).alias("energy_wh"), "windows"))

    def check(self):
        for grain in GRAINS:
            assert self.got(grain) == self.wanted(grain)


@pytest.fixture
def pyramid(spark, tmp_path):
    return Pyramid(spark, tmp_path)


def test_nothing_yet(pyramid):
    assert pyramid.rollup.update() == 0
    assert pyramid.got("1 day") == []


def test_late_parts_change_their_days_only(pyramid):
    pyramid.add(("a", 100.0, "01-15 12:00:00"), ("b", 50.0, "01-15 12:00:10"),
                ("a", 7.0, "01-15 13:30:00"), ("a", 8.0, "01-31 23:59:59"))
    pyramid.check()  # not folded: all is computed
    pyramid.parts.fold(newest=True)
    pyramid.check()
    assert pyramid.rollup.update() == 2 and pyramid.rollup.update() == 0
    pyramid.check()
    pyramid.add(("a", 300.0, "01-15 12:00:20"), ("c", 1.0, "02-01 00:00:00"))
    pyramid.check()
    pyramid.parts.fold(newest=True)
    assert set(pyramid.rollup.stale()) == {date(2024, 1, 15), date(2024, 2, 1)}
    assert pyramid.rollup.update() == 2
    pyramid.check()
    pyramid.rollup.fold()
    pyramid.check()


def test_an_update_that_broke_off_is_made_again(pyramid):
    pyramid.add(("a", 100.0, "01-15 12:00:00"))
    pyramid.parts.fold(newest=True)
    write = pyramid.rollup.tables["1 day"].write

    def fail(files):
        raise RuntimeError("broken off")

    pyramid.rollup.tables["1 day"].write = fail
    with pytest.raises(RuntimeError):
        pyramid.rollup.update()
    pyramid.rollup.tables["1 day"].write = write
    pyramid.check()
    assert pyramid.rollup.update() == 1
    pyramid.check()


def test_a_days_figure_reads_day_rows_only(pyramid):
    pyramid.add(("a", 100.0, "01-15 12:00:00"), ("a", 9.0, "01-16 12:00:00"))
    pyramid.parts.fold(newest=True)
    pyramid.parts.clean()
    pyramid.rollup.update()
    found = pyramid.rollup.read("1 day")
    assert {path.split("/rollup/")[1].split("/")[0] for path in found.inputFiles()} == {"1-day"}
    assert "/parts" not in scans(found)


def test_ranges_are_sums_of_their_windows(spark, pyramid):
    pyramid.add(*[("ab"[k % 2], 10.0 + k, f"01-{10 + k // 24 % 5} {k % 24:02}:{k * 7 % 60:02}:30")
                  for k in range(120)])
    pyramid.parts.fold(newest=True)
    pyramid.rollup.update()
    pyramid.add(("a", 77.0, "01-12 05:00:00"))  # not folded
    fine = pyramid.rollup.read("30 seconds")
    for begin, end in (("2024-01-10 03:20:30", "2024-01-13 17:05:30"),
                       ("2024-01-11 00:00:00", "2024-01-13 00:00:00"),
                       ("2024-01-11 05:10:00", "2024-01-11 05:40:00"),
                       ("2024-01-11 05:10:00", "2024-01-11 09:00:00"),
                       ("2024-01-11 22:10:00", "2024-01-12 03:40:00"),
                       ("2023-01-01 00:00:00", "2025-01-01 00:00:00")):
        inside = fine.filter((F.col("start") >= begin) & (F.col("start") < end))
        want = inside.agg(F.sum("energy_wh"), F.sum("windows")).first()
        got = pyramid.rollup.between(begin, end).select("energy_wh", "windows").first()
        assert got[1] == want[1] and got[0] == pytest.approx(want[0])
    assert pyramid.rollup.between("2030-01-01 00:00:00", "2031-01-01 00:00:00").first()[0] is None
