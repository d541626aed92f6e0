from decimal import Decimal

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from helpers import messages, readings, rows, wire
from pyspark.sql import functions as F
from sunmeter.functions.wire import decode
from sunmeter.operators.quality import is_ahead, is_timed, split_valid, to_raw

TIME = "2024-01-15 12:00:00"


def test_storage_rounds_half_up(spark):
    df = readings(spark, [("a", p, 1, TIME) for p in (0.0005, 0.0015, 0.0004, 390.25, 2.0005)])
    assert sorted(r.power_panel for r in to_raw(df).collect()) == [
        Decimal("0.000"), Decimal("0.001"), Decimal("0.002"), Decimal("2.001"),
        Decimal("390.250")]


def test_whole_seconds_round(spark):
    df = readings(spark, [("a", 1.0, 1, TIME + ".499999"), ("b", 1.0, 1, TIME + ".5")])
    assert rows(to_raw(df, whole_seconds=True), "Panel_id", "time_data") == [
        ("a", TIME), ("b", "2024-01-15 12:00:01")]


def test_what_the_table_cannot_hold_is_a_reject(spark):
    texts = [
        wire("a", 1.0, TIME), wire("a", 1e30, TIME), wire("x" * 251, 1.0, TIME),
        wire("x" * 250, 1.0, TIME), wire("a", '"Infinity"', TIME), wire("a", 1.0, "never"),
        "{}", "nope", None,
    ]
    valid, rejects = split_valid(decode(messages(spark, texts), "offset"))
    assert [r.offset for r in valid.orderBy("offset").collect()] == [0, 3]
    assert [r.offset for r in rejects.orderBy("offset").collect()] == [1, 2, 4, 5, 6, 7, 8]
    assert to_raw(valid).filter("power_panel is null").count() == 0


def test_windows_take_what_only_the_raw_table_cannot(spark):
    texts = [wire("x" * 251, 1.0, TIME), wire("a", 1e30, TIME), wire("a", 1.0, "never"), "{}"]
    timed = decode(messages(spark, texts), "offset").filter(is_timed())
    assert [r.offset for r in timed.orderBy("offset").collect()] == [0, 1]


def test_clocks_far_ahead_of_the_broker(spark):
    df = readings(spark, [("a", 1.0, 1, f"2024-01-15 {t}") for t in ("11:00:00", "14:00:00", "14:00:01")]
                  + [("b", 1.0, 1, None)]).withColumn("timestamp", F.lit(TIME).cast("timestamp"))
    ahead = df.filter(is_ahead("2 hours"))
    assert rows(ahead, "time_data") == [("2024-01-15 14:00:01",)]
    assert df.withColumn("timestamp", F.lit(None).cast("timestamp")).filter(is_ahead()).count() == 0


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.text(max_size=20), st.just(wire("a", 1.0, TIME))), min_size=1))
def test_valid_and_rejects_are_all_rows(spark, texts):
    texts = [t if t is None else t.encode("utf-8", "replace").decode() for t in texts]
    decoded = decode(messages(spark, texts))
    valid, rejects = split_valid(decoded)
    assert valid.count() + rejects.count() == len(texts)
    assert valid.count() >= sum(t == wire("a", 1.0, TIME) for t in texts)
