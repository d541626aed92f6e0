"""Plans the operators promise: one parse, hash aggregates, pruned and pushed scans."""

import pytest
from helpers import plan, scans

import __spark_entry__ as entries
from sunmeter.functions.wire import decode
from sunmeter.operators.quality import split_valid
from sunmeter.operators.windows import panel_power
from sunmeter.plans import oracles
from sunmeter.schema import MESSAGE_SCHEMA
from sunmeter.sinks.tables import by_kind

SF = "/root/testdata/sf0.001"
LAZY = [name for name in oracles.ORACLES
        if name.startswith(("fleet", "panel_power_w", "panel_power_h", "latest"))]


@pytest.fixture(scope="module")
def topic(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("topic") / "m")
    spark.createDataFrame([], MESSAGE_SCHEMA).write.parquet(path)
    return spark.read.schema(MESSAGE_SCHEMA).parquet(path)


def test_valid_rows_and_windows_parse_once(topic):
    valid, rejects = split_valid(decode(topic, raw=True))
    for df in (valid, rejects, panel_power(valid), by_kind(decode(
            topic, "topic", "partition", "offset", "timestamp", raw=True))):
        assert plan(df).count("from_json") == 1


def test_decode_reads_the_value_only(topic):
    assert "ReadSchema: struct<value:binary>" in scans(panel_power(decode(topic)))


@pytest.mark.parametrize("name", LAZY)
def test_aggregates_are_hashed_and_nothing_is_joined(spark, name):
    text = plan(entries.queries()[name](spark, SF))
    assert "partial_" in text
    assert "Join" not in text and "CartesianProduct" not in text
    if name != "latest_panel_status_of_topic":  # its second, small step compares structs
        assert "SortAggregate" not in text


def test_batch_windows_shuffle_on_start_and_panel(spark):
    text = plan(entries.queries()["panel_power_window"](spark, SF))
    assert text.count("Exchange") == 1
    assert "hashpartitioning(window_start" in text


def test_scan_reads_the_columns_used(spark):
    text = scans(entries.queries()["latest_panel_status"](spark, SF))
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint,event_type:string>" in text


def test_range_is_pushed_to_the_stored_time(spark):
    text = scans(entries.queries()["readings_in_range"](spark, SF))
    assert "GreaterThanOrEqual(ts,2024-01-15T08:00)" in text


def test_lookups_are_pushed_in_the_stored_type(spark):
    for name in ("panel_lookup", "panel_lookup_json"):
        assert "EqualTo(user_id,8)" in scans(entries.queries()[name](spark, SF))
    assert "EqualTo(Panel_id,8)" in scans(entries.queries()["panel_lookup_stored"](spark, SF))


def test_ranges_and_the_last_window_are_pushed(spark):
    text = scans(entries.queries()["fleet_power_in_range"](spark, SF))
    assert "GreaterThanOrEqual(ts,2024-01-15T07:59:30)" in text and "LessThanOrEqual(ts" in text
    assert "GreaterThanOrEqual(ts,20" in scans(entries.queries()["latest_fleet_power"](spark, SF))


def test_status_per_partition_is_hashed(spark):
    text = plan(entries.queries()["latest_panel_status_of_topic"](spark, SF))
    first = text[text.rindex("Exchange"):]
    assert "HashAggregate" in first and "SortAggregate" not in first
