import random

import pytest
from helpers import readings, rows
from pyspark.sql import functions as F
from sunmeter.operators import series
from sunmeter.operators.windows import panel_power


def brute(data, n):
    return sorted(sorted(data, key=lambda r: (r[0] is None, r[0] or "", r[1], r[2]))[:n], key=repr)


def frame(spark, data, kind="timestamp"):
    return spark.createDataFrame(data, "t string, p string, w double").withColumn(
        "t", F.col("t").cast(kind)).repartition(5)


def spread(seed):
    rnd = random.Random(seed)
    hot = ["1970-01-01 00:00:00", "2024-01-15 12:00:00"]
    out = []
    for _ in range(400):
        t = rnd.choice(hot) if rnd.random() < 0.6 else (
            f"2024-01-15 {rnd.randrange(11, 14)}:00:{rnd.randrange(3):02}.{rnd.randrange(3):06}"
            .replace(".000000", "") if rnd.random() < 0.9 else None)
        out.append((t, rnd.choice("abc"), float(rnd.randrange(3))))
    return out


@pytest.mark.parametrize("n", [0, 1, 57, 130, 199, 280, 399, 400, 1000])
def test_first_rows_equal_sort_and_limit(spark, n):
    data = spread(n)
    got = series.first_rows(frame(spark, data), n, "t", "p", "w")
    assert rows(got) == brute(data, n)


def test_times_without_a_zone(spark):
    data = spread(1)
    got = series.first_rows(frame(spark, data, "timestamp_ntz"), 200, "t", "p", "w")
    assert got.schema["t"].dataType.typeName() == "timestamp_ntz"
    assert rows(got) == brute(data, 200)


def test_all_rows_alike(spark):
    data = [("2024-01-15 12:00:00", "hot", 0.0)] * 50
    got = series.first_rows(frame(spark, data), 7, "t", "p", "w")
    assert rows(got) == data[:7]


def test_no_task_takes_the_whole_hour(spark):
    """The cut hour is dealt out, copies of one row too."""
    rows_of = frame(spark, [("2024-01-15 12:00:00", "hot", 0.0)] * 400).repartition(4)
    got = series.first_rows(rows_of, 100, "t", "p", "w")
    assert got.count() == 100
    text = got._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in text and "TakeOrdered" not in text


def test_without_a_limit_the_series_is_whole(spark):
    raw = spark.createDataFrame([("a", 1.0, None)], "Panel_id string, power_panel double, time_data timestamp")
    assert series.panel_series(raw.union(raw)).count() == 2


def test_empty(spark):
    assert rows(series.first_rows(frame(spark, []), 5, "t", "p", "w")) == []


def test_order_must_cover_the_columns(spark):
    with pytest.raises(ValueError):
        series.first_rows(frame(spark, []), 5, "t", "p")


def test_rows_before_the_cut_are_a_pushed_range(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(2000).select(
        F.timestamp_seconds(F.lit(1705276800) + F.col("id") * 60).alias("time_data"),
        F.col("id").cast("decimal(20,3)").alias("power_panel"),
        F.lit("a").alias("Panel_id")).write.parquet(path)
    got = series.panel_series(spark.read.parquet(path), 130)
    assert got.count() == 130
    assert got.agg(F.max("power_panel")).first()[0] == 129
    text = got._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(time_data,2024-01-15" in text


@pytest.mark.parametrize("limit", (1, 7, 50, 120, 10_000))
def test_first_windows_are_those_of_the_whole_series(spark, limit):
    known = readings(spark, [
        (f"p{k % 3}", float(k), 1, f"2024-01-15 {10 + k % 5}:{k % 60:02}:{k * 7 % 60:02}")
        for k in range(150)] + [("p", 1.0, 1, None)])
    want = series.window_series(panel_power(known), limit)
    assert rows(series.first_windows(known, limit)) == rows(want)


def test_first_windows_read_no_later_readings(spark, tmp_path):
    path = str(tmp_path / "r")
    readings(spark, [("a", 1.0, 1, f"2024-01-{day:02} 12:00:00") for day in range(1, 29)]).write.parquet(path)
    found = series.first_windows(spark.read.parquet(path), 3)
    assert rows(found, "window_end") == [(f"2024-01-{day:02} 12:00:30",) for day in (1, 2, 3)]
    assert "/r" not in {p.rsplit("/", 2)[1] for p in found.inputFiles()}  # from the stored windows
