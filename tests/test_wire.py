import json

import pytest
from pyspark.sql import functions as F

from helpers import messages, readings, rows, wire
from sunmeter.functions.wire import decode, encode, shift_event_time

TIME = "2024-01-15 12:00:00"
CASES = {
    "active": (wire("a", 390.25, TIME + ".123456"), ("a", 390.25, 1, TIME + ".123456")),
    "heartbeat": ('{"Panel_id":"a","power_panel":"0","current_status":"0","time_data":"%s"}' % TIME,
                  ("a", 0.0, 0, TIME)),
    "quoted": ('{"Panel_id":"a","power_panel":"12.5","current_status":"1","time_data":"%s"}' % TIME,
               ("a", 0.0, 0, TIME)),
    "no numbers": ('{"Panel_id":"a","time_data":"%s"}' % TIME, ("a", 0.0, 0, TIME)),
    "fractional status": (wire("a", 1.0, TIME, 1.5), ("a", 1.0, 0, TIME)),
    "numeric id": ('{"Panel_id":7,"power_panel":1,"current_status":1,"time_data":"%s"}' % TIME,
                   ("7", 1.0, 1, TIME)),
    "extra field": ('{"Panel_id":"a","power_panel":1,"current_status":1,"time_data":"%s","x":1}' % TIME,
                    ("a", 1.0, 1, TIME)),
    "bad time": (wire("a", 5.0, "garbage"), ("a", 5.0, 1, None)),
    "garbage": ("not json", (None, 0.0, 0, None)),
    "empty": ("", (None, 0.0, 0, None)),
    "null": (None, (None, 0.0, 0, None)),
    "array": ("[]", (None, 0.0, 0, None)),
}


@pytest.mark.parametrize("case", CASES)
def test_decode(spark, case):
    text, expected = CASES[case]
    assert rows(decode(messages(spark, [text]))) == [expected]


def test_decode_keeps_every_message_and_its_place(spark):
    texts = [text for text, _ in CASES.values()]
    got = decode(messages(spark, texts), "offset", raw=True)
    assert [(r.offset, r.raw_value) for r in got.orderBy("offset").collect()] == list(
        enumerate(texts))


def test_fill_leaves_message_columns_alone(spark):
    unplaced = messages(spark, ["x"]).withColumn("offset", F.lit(None).cast("long"))
    assert rows(decode(unplaced, "offset"), "power_panel", "offset") == [(0.0, None)]


def test_encode_writes_the_producers_form(spark):
    df = readings(spark, [("a", 12.5, 1, TIME + ".120000"), ("a", 0.0, 0, TIME)])
    texts = [json.loads(bytes(r.value)) for r in encode(df, True).collect()]
    assert texts == [
        {"Panel_id": "a", "power_panel": 12.5, "current_status": 1, "time_data": TIME + ".120000"},
        {"Panel_id": "a", "power_panel": "0", "current_status": "0", "time_data": TIME},
    ]
    assert [bytes(r.key) for r in encode(df).collect()] == [b"a", b"a"]


def test_roundtrip_keeps_microseconds(spark):
    given = [("a", 0.1 + 0.2, 1, TIME + ".000001"), ("é\"", 1e-7, 0, "1999-12-31 23:59:59.999999")]
    df = readings(spark, given)
    assert rows(decode(encode(df))) == rows(df)


def test_shift_event_time_moves_active_rows_only(spark):
    df = readings(spark, [("a", 1.0, 1, "2024-01-15 13:00:00"), ("b", 0.0, 0, TIME)])
    assert rows(shift_event_time(df, "-1 hour"), "Panel_id", "time_data") == [
        ("a", TIME), ("b", TIME)]
