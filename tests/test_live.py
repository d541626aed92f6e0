"""Lookups and ranges on a table that a stream fills: how many stored rows they touch."""

from datetime import datetime, timedelta

import pytest
from helpers import messages, rows, wire
from pyspark.sql import functions as F

from sunmeter.functions.columns import z_value
from sunmeter.functions.wire import decode
from sunmeter.operators.lookup import around, days_around, panel_rows
from sunmeter.sinks import tables

PANELS, TIMES = 150, 144
DAY = datetime(2024, 1, 15)


def scanned(df):
    """Rows that the scans hand on: those of the row groups that are not passed by."""
    plan = df._jdf.queryExecution().executedPlan()
    plan.executeCollect()
    leaves = plan.collectLeaves()
    return sum(leaves.apply(k).metrics().apply("numOutputRows").value()
               for k in range(leaves.size()))


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    found = tables.readings_table(spark, str(tmp_path_factory.mktemp("live") / "readings"))
    found.options |= {"parquet.block.size": "8192", "parquet.page.size": "2048"}
    texts = [wire(f"panel-{(p * 7919) % PANELS}", float(p), str(DAY + timedelta(minutes=10 * t)))
             for t in range(TIMES) for p in range(PANELS)]
    write = found.write(1)

    def batch(some, number):
        decoded = decode(messages(spark, some), "topic", "partition", "offset", "timestamp", raw=True)
        write(tables.by_kind(decoded, "30000 days"), number)

    batch(texts, 0)
    found.fold(newest=True)
    found.clean()
    batch([wire(f"panel-{p}", 1.0, "2024-01-16 06:00:00") for p in range(0, 100, 2)] * 40, 1)
    return found


def test_bits_are_interleaved(spark):
    got = spark.range(16).select(F.floor(F.col("id") / 4).alias("a"), (F.col("id") % 4).alias("b"))
    z = got.select(z_value(F.col("a"), F.col("b"), bits=2).alias("z")).collect()
    assert [r["z"] for r in z] == [0, 1, 4, 5, 2, 3, 6, 7, 8, 9, 12, 13, 10, 11, 14, 15]


def test_a_lookup_reads_few_row_groups(spark, table):
    everything = scanned(tables.read_raw(table))
    assert everything == PANELS * TIMES + 2000
    found = panel_rows(tables.read_raw(table), "panel-30")
    assert found.count() == TIMES + 40
    folded = panel_rows(tables.read_raw(table, [DAY.date()]), "panel-30")
    assert folded.count() == TIMES and scanned(folded) <= PANELS * TIMES / 5
    assert scanned(panel_rows(tables.read_raw(table), "panel-no")) == 0


def test_open_batches_are_passed_by_too(spark, table):
    new = panel_rows(tables.read_raw(table, [DAY.date() + timedelta(days=1)]), "panel-31")
    assert new.count() == 0 and scanned(new) == 0


def test_a_range_reads_few_row_groups(spark, table):
    as_of = "2024-01-15 12:00:00"
    found = around(tables.read_raw(table, days_around(as_of)), as_of, "1 hour", "30 minutes")
    assert found.count() == 10 * PANELS
    assert scanned(found) <= PANELS * TIMES / 3
    text = [r["time_data"] for r in found.select(F.col("time_data").cast("string")).distinct().collect()]
    assert min(text) == "2024-01-15 11:00:00" and max(text) == "2024-01-15 12:30:00"


def test_days_around_a_time():
    assert days_around("2024-03-01 02:00:00") == {
        datetime(2024, 2, 29).date(), datetime(2024, 3, 1).date()}
    assert days_around("2024-03-01 23:30:00") == {
        datetime(2024, 3, 1).date(), datetime(2024, 3, 2).date()}


def test_the_order_changes_no_row(spark, table):
    got = tables.read_raw(table, [DAY.date()])
    assert rows(got.groupBy("Panel_id").count().select("count").distinct()) == [(TIMES,)]
