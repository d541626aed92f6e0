import math

import pytest
from helpers import readings
from pyspark.sql import functions as F
from sunmeter.functions.columns import expected_power


def curve(spark, times, **options):
    df = readings(spark, [("a", 0.0, 1, f"2024-01-15 {t}") for t in times])
    return [r[0] for r in df.select(expected_power(F.col("time_data"), **options)).collect()]


def test_start_peak_and_end(spark):
    got = curve(spark, ["12:00:00", "12:30:00", "13:00:00"])
    assert got == pytest.approx([10.892008, 400.0, 10.892008], abs=1e-6)


def test_far_tail_is_zero(spark):
    got = curve(spark, ["00:00:00", "23:59:59"], minutes=-59, hours=1)
    assert got == [0.0, 0.0]


def test_wide_variant(spark):
    got = curve(spark, ["09:00:00", "12:00:00"], start_hour=9, hours=6, exponent=1)
    assert got == pytest.approx([400 / math.cosh(3), 400.0])


def test_minutes_move_the_middle(spark):
    # middle of the span 40 min later; the curve reaches x = 0 there
    assert curve(spark, ["12:40:00"], minutes=20) == pytest.approx([400.0])


def test_fraction_of_second_is_ignored_and_peak_may_be_a_column(spark):
    df = readings(spark, [("a", 123.0, 1, "2024-01-15 12:30:00.999999")])
    assert df.select(expected_power(F.col("time_data"), F.col("power_panel"))).first()[0] == 123.0


def test_each_panel_has_its_start(spark):
    df = readings(spark, [("6", 0.0, 1, "2024-01-15 07:00:00"), ("9", 0.0, 1, "2024-01-15 10:00:00")])
    hour = F.col("Panel_id").cast("int")
    got = df.select(expected_power(F.col("time_data"), start_hour=hour, start_minute=hour * 0 + 30))
    assert [r[0] for r in got.collect()] == pytest.approx([400.0, 400.0])


def test_empty_span_is_an_error():
    with pytest.raises(ValueError):
        expected_power(None, hours=0, minutes=0)
