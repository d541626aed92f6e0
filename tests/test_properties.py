"""Random small fleets against plain Python."""

import math
from collections import defaultdict

import pytest
from helpers import readings
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from sunmeter.operators import fleet
from sunmeter.operators.windows import panel_power

reading = st.tuples(
    st.sampled_from(["a", "b", "c"]),
    st.floats(0, 500).map(lambda p: round(p, 3)),
    st.sampled_from([0, 1]),
    st.integers(0, 200),  # seconds after noon
)


def clock(second):
    return f"2024-01-15 12:{second // 60:02}:{second % 60:02}"


@settings(max_examples=6, deadline=None,
          suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(reading, min_size=1, max_size=60))
def test_windows_fleet_energy_and_histogram(spark, data):
    df = readings(spark, [(p, w, s, clock(t)) for p, w, s, t in data])
    groups = defaultdict(list)
    for panel, power, _, second in data:
        groups[panel, second // 30].append(power)
    means = {key: sum(v) / len(v) for key, v in groups.items()}
    agg = panel_power(df).cache()

    got = {(r.Panel_id, (r.window_start.minute * 60 + r.window_start.second) // 30): r.total_power
           for r in agg.collect()}
    assert got == pytest.approx(means)

    per_window = defaultdict(float)
    for (_, window), mean in means.items():
        per_window[window] += mean
    totals = sorted(r.total_power for r in fleet.fleet_power(agg).collect())
    assert totals == pytest.approx(sorted(per_window.values()))
    assert fleet.total_energy(agg).first().energy_wh == pytest.approx(
        sum(per_window.values()) * 0.0083333333)

    buckets = defaultdict(int)
    for value in got.values():
        buckets[math.floor((value - 398) / 20) * 20 + 398] += 1
    combined = fleet.power_histogram(agg, combine=True).collect()
    assert {r.bucket_start: r.windows for r in combined} == buckets
    agg.unpersist()
