from helpers import plan, readings, rows
from pyspark.sql import functions as F
from sunmeter.operators.windows import latest_emission, panel_power


def test_window_edges(spark):
    df = readings(spark, [
        ("a", 1.0, 1, "2024-01-15 12:00:00"), ("a", 3.0, 1, "2024-01-15 12:00:29.999999"),
        ("a", 7.0, 1, "2024-01-15 12:00:30"), ("b", 5.0, 1, "2024-01-15 12:00:00"),
        ("b", 9.0, 1, None),
    ])
    assert rows(panel_power(df)) == [
        ("a", 2.0, "2024-01-15 12:00:00", "2024-01-15 12:00:30"),
        ("a", 7.0, "2024-01-15 12:00:30", "2024-01-15 12:01:00"),
        ("b", 5.0, "2024-01-15 12:00:00", "2024-01-15 12:00:30"),
    ]
    assert panel_power(df).columns == ["Panel_id", "total_power", "window_start", "window_end"]


def test_times_before_the_epoch_fall_in_the_window_below(spark):
    df = readings(spark, [("a", 1.0, 1, "1969-12-31 23:59:59")])
    assert rows(panel_power(df), "window_start") == [("1969-12-31 23:59:30",)]


def test_duration_is_a_parameter(spark):
    df = readings(spark, [("a", float(m), 1, f"2024-01-15 12:{m:02}:10") for m in range(60)])
    assert rows(panel_power(df, "1 hour"), "total_power", "window_start") == [
        (29.5, "2024-01-15 12:00:00")]


def test_empty_input(spark):
    assert rows(panel_power(readings(spark, []))) == []


def test_a_hot_panel_is_reduced_before_the_shuffle(spark):
    panel = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string"))
    base = spark.range(0, 30_000, 1, 8).select(
        panel.alias("Panel_id"), F.lit(2.0).alias("power_panel"),
        F.lit(1).alias("current_status"),
        F.lit("1970-01-01 00:00:00").cast("timestamp").alias("time_data"))
    got = panel_power(base)
    assert got.count() == 20_001
    assert got.filter("Panel_id = 'hot'").first().total_power == 2.0
    text = plan(got)
    assert "partial_avg" in text and "SortAggregate" not in text
    assert text.count("Exchange") == 1


def test_latest_emission_wins(spark):
    ddl = "Panel_id string, total_power double, window_start string, window_end string, batch_id long"
    updates = spark.createDataFrame([
        ("a", 150.0, "s", "e", 0), ("a", 200.0, "s", "e", 3), ("a", 9.0, "s2", "e2", 1),
        ("b", 1.0, "s", "e", 2), ("a", 200.0, "s", "e", 3),
    ], ddl)
    assert rows(latest_emission(updates)) == [
        ("a", 200.0, "s", "e"), ("a", 9.0, "s2", "e2"), ("b", 1.0, "s", "e")]
    assert "SortAggregate" not in plan(latest_emission(updates))
