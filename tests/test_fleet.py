import pytest
from helpers import plan, readings, rows, scans, windows
from pyspark.sql import functions as F
from sunmeter.operators import fleet
from sunmeter.operators.lookup import around
from sunmeter.operators.windows import panel_power

T0, T1 = "2024-01-15 12:00:00", "2024-01-15 12:00:30"


@pytest.fixture
def agg(spark):
    return windows(spark, [
        ("a", 100.0, T0), ("b", 250.0, T0), ("a", 300.0, T1), ("c", None, T1), ("d", 398.0, T0)])


@pytest.mark.parametrize("values, width", (
    ([0.0, 1.0, 29.0], 1.0), ([0.0, 31.0], 2.0), ([5.0, 120.0, 450.5, 20.0, 40.0], 20.0),
    ([-3.5, 0.25, 7.75], 0.5), ([1e6, 1e6 + 300.0], 10.0), ([7.0, 7.0], 1.0),
    ([0.001, 0.0043, 0.0], 0.0002), ([1e9, 2.0], 5e7)))
def test_bucket_width_follows_the_data(spark, values, width):
    rows_of = windows(spark, [(f"p{k % 2}", v, f"2024-01-15 12:{k:02}:00")
                              for k, v in enumerate(values)] + [("p0", None, "2024-01-15 13:00:00")])
    for combine in (False, True):
        got = fleet.power_histogram_auto(rows_of, combine=combine)
        want = fleet.power_histogram(rows_of, width, 0.0, combine).withColumn("width", F.lit(width))
        kept = [name for name in got.columns if name != "bucket_start"]

        def rounded(df):
            return rows(df.withColumn("bucket_start", F.round("bucket_start", 9)),
                        *kept, "bucket_start")

        assert rounded(got) == rounded(want)


def test_no_value_makes_no_bucket(spark):
    none = windows(spark, [("a", None, "2024-01-15 12:00:00")])
    assert fleet.power_histogram_auto(none).count() == 0


def test_windows_are_read_once_for_buckets(spark):
    text = plan(fleet.power_histogram_auto(windows(spark, [("a", 5.0, "2024-01-15 12:00:00")])))
    assert "LocalTableScan" not in text and text.count("FileScan parquet") == 1


def test_fleet_power_sums_the_panels_present(agg):
    assert rows(fleet.fleet_power(agg)) == [
        ("2024-01-15 12:00:30", 748.0), ("2024-01-15 12:01:00", 300.0)]


def test_total_energy_is_the_sum_of_window_energies(agg):
    parts = [e for _, e in rows(fleet.fleet_energy(agg))]
    total = rows(fleet.total_energy(agg))[0][0]
    assert total == pytest.approx(sum(parts)) == pytest.approx(1048.0 / 120, rel=1e-8)
    assert fleet.total_energy(agg.limit(0)).first().energy_wh is None


def test_energy_follows_the_length_of_the_window(spark):
    hour = windows(spark, [("a", 100.0, T0), ("b", 50.0, T0)]).withColumn(
        "window_end", F.expr("window_start + INTERVAL 1 HOUR"))
    assert rows(fleet.fleet_energy(hour), "energy_wh") == [(150.0,)]
    assert rows(fleet.total_energy(hour)) == [(150.0,)]
    half_minute = windows(spark, [("a", 100.0, T0)])
    assert rows(fleet.total_energy(half_minute)) == [(100 * 0.0083333333,)]


@pytest.fixture
def stored(spark, tmp_path):
    spark.range(5000).select(
        F.concat(F.lit("p"), F.col("id") % 7).alias("Panel_id"), F.lit(1).alias("current_status"),
        (F.col("id") % 11).cast("double").alias("power_panel"),
        F.timestamp_seconds(F.lit(1705276800) + F.col("id") * 10).alias("time_data"),
    ).write.parquet(str(tmp_path / "r"))
    return spark.read.parquet(str(tmp_path / "r"))


def test_latest_fleet_power_reads_the_last_window_only(spark, stored):
    got = fleet.latest_fleet_power(stored)
    whole = fleet.fleet_power(panel_power(stored))
    assert rows(got) == rows(whole)[-1:]
    assert "GreaterThanOrEqual(time_data,2024-01-15" in scans(got)
    assert rows(fleet.latest_fleet_power(readings(spark, []))) == []


def test_fleet_power_in_a_range_reads_the_range_only(stored):
    now = "2024-01-15 05:00:10"
    got = fleet.fleet_power_around(stored, now)
    whole = fleet.fleet_power(panel_power(stored))
    assert rows(got) == rows(around(whole, now, time="window_end")) and got.count() == 600
    assert "GreaterThanOrEqual(time_data,2024-01-15" in scans(got)


def test_histogram_counts_are_the_rows(agg):
    known = agg.filter("total_power is not null")
    per_panel = fleet.power_histogram(known, 20.0)
    assert rows(per_panel) == [
        ("a", 298.0, 1), ("a", 98.0, 1), ("b", 238.0, 1), ("d", 398.0, 1)]
    combined = fleet.power_histogram(known, 200.0, combine=True)
    assert rows(combined) == [(-2.0, 1), (198.0, 2), (398.0, 1)]
    assert sum(n for *_, n in rows(combined)) == known.count()


def test_wide_rows_add_up_to_the_fleet(agg):
    wide = fleet.panels_wide(agg, ["a", "b", "zz"])
    assert wide.columns == ["window_end", "panel_a", "panel_b", "panel_zz", "other_panels"]
    assert rows(wide) == [
        ("2024-01-15 12:00:30", 100.0, 250.0, None, 398.0),
        ("2024-01-15 12:01:00", 300.0, None, None, None)]
    assert plan(wide).count("Exchange") == 1


DDL = "Panel_id string, current_status int, timestamp timestamp, partition int, offset long"


def test_latest_status_by_arrival(spark):
    df = spark.createDataFrame(
        [("a", 1, 10), ("a", 0, 12), ("a", None, 13), ("b", 1, 5), ("b", 0, 4)],
        "Panel_id string, current_status int, ingest_seq long")
    got = fleet.latest_status(df, "ingest_seq")
    assert rows(got) == [("a", 0), ("b", 1)]
    assert "SortAggregate" not in plan(got)


def test_latest_status_of_topic_follows_a_panel_to_its_new_partition(spark):
    from datetime import datetime as d
    df = spark.createDataFrame([
        ("a", 1, d(2024, 1, 1, 0), 0, 100), ("a", 0, d(2024, 1, 1, 2), 1, 3),
        ("a", 1, d(2024, 1, 1, 1), 1, 2), ("a", None, d(2024, 1, 1, 9), 1, 9),
        ("b", 1, d(2024, 1, 1, 0), 0, 2), ("b", 0, d(2024, 1, 1, 0), 0, 1),
        ("b", 0, d(2024, 1, 1, 0), 2, 1),
    ], DDL)
    assert rows(fleet.latest_status_of_topic(df)) == [("a", 0), ("b", 0)]
