"""The same results in SQL over the test tables."""

from __future__ import annotations

from sunmeter.plans.batch import AS_OF, FIRST_ROWS, FIRST_WINDOWS, LOOKUP_PANEL, WIDE_PANELS
from sunmeter.plans.stream import SOME_WEEKS

READINGS = """
with readings as (
  select cast(user_id as varchar) as Panel_id,
         case when event_type = 'error' then cast(0 as double) else value end as power_panel,
         case when event_type = 'error' then 0 else 1 end as current_status,
         ts as time_data, event_id as ingest_seq
  from events)
"""


def _windows(duration: str = "30 seconds", where: str = "true") -> str:
    return READINGS.rstrip() + f""",
agg as (
  select Panel_id, avg(power_panel) as total_power,
         time_bucket(interval '{duration}', time_data) as window_start,
         time_bucket(interval '{duration}', time_data) + interval '{duration}' as window_end
  from readings where {where} group by Panel_id, 3, 4),
fleet as (
  select window_end, sum(total_power) as total_power from agg group by window_end)
"""


def _curve(start: str, hours: int, exponent: int) -> str:
    second = "(hour(time_data) * 3600 + minute(time_data) * 60 + second(time_data))"
    slope = f"({hours} * 0.5e0 / ({hours} * 3600 / 2e0))"
    x = f"({second} - ({start})) * {slope} - {hours} * 0.5e0"
    return READINGS + f"""
      select Panel_id, time_data,
             round(400e0 / pow(cosh({x}), {exponent}), 6) as expected_power
      from readings"""


_AGG = _windows()
_STORED = "cast(power_panel as decimal(20,3))"
_STORED_VALUE = f"cast({_STORED} as varchar)"
_SECONDS = "strftime(time_data, '%Y-%m-%d %H:%M:%S')"

_SHOWN = f"""between timestamp '{AS_OF}' - interval 4 hour
                          and timestamp '{AS_OF}' + interval 1 hour"""

_ALL_READINGS = READINGS + "select Panel_id, power_panel, current_status, time_data from readings"
_ALL_RAW = READINGS + f"""
  select Panel_id, {_STORED_VALUE} as power_panel, current_status, time_data from readings"""
_RAW_SERIES = READINGS + f"""
  select time_data, {_STORED_VALUE} as power_panel, Panel_id from readings"""
_WINDOW_SERIES = """
  select window_end, round(total_power, 6) as total_power, Panel_id from agg"""
_LOOKUP = READINGS + f"""
  select Panel_id, {_STORED_VALUE} as power_panel, current_status, {_SECONDS} as time_data
  from readings where Panel_id = '{LOOKUP_PANEL}'"""
_ALL_WINDOWS = """
  select Panel_id, round(total_power, 6) as total_power, window_start, window_end from agg"""
_FLEET = _AGG + "select window_end, round(total_power, 6) as total_power from fleet"
_REJECTS = """
  select cast(1 as integer) as partition, props as raw_value from events
  union all
  select cast(2 as integer), text from conversations
  union all
  select cast(3 as integer), '{' || case event_id % 4 when 1 then ''
           when 2 then '"Panel_id":"' || repeat('x', 251) || '",' else '"Panel_id":"8",' end
         || '"power_panel":'
         || case event_id % 4 when 3 then '123456789012345678.0' else '1.5' end
         || ',"current_status":1,"time_data":"'
         || case event_id % 4 when 0 then 'not a time ' || event_id else '2024-01-15 12:00:00' end
         || '"}' from events"""
_ROLLUP = _AGG.rstrip() + """,
energy as (
  select window_end - interval 30 second as start, total_power * 0.0083333333e0 as wh from fleet)
"""
# Six spans of equal length by arrival, up to nine days behind the stamp; late is
# what arrives more than 15 s behind it.
_LEDGER = """
with arrived as (
  select ts, ts + to_days(cast(event_id * 37 % 10 as integer)) as arrival from events),
span as (
  select epoch_us(min(arrival)) as low,
         (epoch_us(max(arrival)) - epoch_us(min(arrival))) // 6 + 1 as width from arrived),
later as (
  select (epoch_us(arrival) - low) // width as step, count(*) as n,
         count(*) filter (where ts < arrival - interval 15 second) as late
  from arrived, span group by 1),
sizes as (
  select (select count(*) from events) as e, (select count(*) from conversations) as c)
select 0::bigint as batch, 3 * e + c as read, e as valid, 2 * e + c as rejected,
       0::bigint as late from sizes
union all
select step + 1, n, n, 0, late from later
"""
_FAR = """
  with readings as (
    select cast(user_id as varchar) as Panel_id,
           case when event_type = 'error' then 0.0 else value end as power_panel,
           case when user_id = 8 then ts + interval 975 year else ts end as time_data
    from events),
  agg as (
    select Panel_id, avg(power_panel) as total_power,
           time_bucket(interval '30 seconds', time_data) as window_start,
           time_bucket(interval '30 seconds', time_data) + interval '30 seconds' as window_end
    from readings group by Panel_id, 3, 4),
  clocks as (select Panel_id, max(time_data) as newest from readings group by Panel_id)
  select Panel_id, round(total_power, 6) as total_power, window_start, window_end
  from agg join clocks using (Panel_id) where window_end <= newest - interval 30 second"""
_LATEST = READINGS + """
  select Panel_id, arg_max(current_status, ingest_seq) as current_status
  from readings group by Panel_id"""

_WIRE_TIME = f"""case when date_trunc('second', time_data) = time_data then {_SECONDS}
              else strftime(time_data, '%Y-%m-%d %H:%M:%S.%f') end"""
_WIRE = READINGS + f"""
  select Panel_id as key,
         '{{"Panel_id":"' || Panel_id || '","power_panel":'
         || case when current_status = 0 then '"0"' else cast(power_panel as varchar) end
         || ',"current_status":' || case when current_status = 0 then '"0"' else '1' end
         || ',"time_data":"' || ({_WIRE_TIME}) || '"}}' as value
  from readings"""

_WIDE_COLUMNS = ", ".join(
    f"round(max(total_power) filter (where Panel_id = '{name}'), 6) as panel_{name}"
    for name in WIDE_PANELS
)
_WIDE_NAMES = ", ".join(f"'{name}'" for name in WIDE_PANELS)

ORACLES = {
    "decode_readings": _ALL_READINGS,
    "wire_messages": _WIRE,
    "wire_roundtrip": _ALL_READINGS,
    "accepted_readings": _ALL_READINGS,
    "rejected_readings": _REJECTS,
    "shifted_readings": READINGS + """
      select Panel_id, power_panel, current_status,
             case when current_status = 1 then time_data - interval 1 hour else time_data end
               as time_data
      from readings""",
    "raw_readings": _ALL_RAW,
    "raw_readings_stored": _ALL_RAW,
    "raw_table_created": _ALL_RAW,
    "compacted_readings": _ALL_RAW,
    "panel_lookup": _LOOKUP,
    "panel_lookup_stored": _LOOKUP,
    "panel_lookup_live": _LOOKUP,
    "readings_in_range_live": _ALL_RAW + f" where time_data {_SHOWN}",
    "panel_lookup_json": READINGS + f"""
      select '{{"Panel_id":"' || Panel_id || '","current_status":' || current_status
             || ',"power_panel":"' || {_STORED} || '","time_data":"' || {_SECONDS}
             || '"}}' as reading
      from readings where Panel_id = '{LOOKUP_PANEL}'""",
    "panel_power_series": _RAW_SERIES,
    "panel_power_first": _RAW_SERIES + f"""
      order by time_data, Panel_id, {_STORED} limit {FIRST_ROWS}""",
    "panel_window_series": _AGG + _WINDOW_SERIES,
    "panel_window_first": _windows("1 hour") + _WINDOW_SERIES + f"""
      order by window_end, Panel_id, agg.total_power limit {FIRST_WINDOWS}""",
    "readings_in_range": READINGS + f"""
      select Panel_id, power_panel, current_status, time_data from readings
      where time_data {_SHOWN}""",
    "panel_power_window": _AGG + _ALL_WINDOWS,
    "panel_power_window_1h": _windows("1 hour") + _ALL_WINDOWS,
    "panel_power_of_timed": _windows(where="ingest_seq % 7 <> 0") + _ALL_WINDOWS,
    "fleet_power_window": _FLEET,
    "fleet_power_in_range": _FLEET + f" where window_end {_SHOWN}",
    "fleet_power_from_wire": _FLEET,
    "fleet_energy_window": _AGG + """
      select window_end, round(total_power * 0.0083333333e0, 6) as energy_wh from fleet""",
    "fleet_energy_window_1h": _windows("1 hour") + """
      select window_end, round(total_power * 1e0, 6) as energy_wh from fleet""",
    "fleet_energy_total": _AGG + """
      select round(sum(total_power * 0.0083333333e0), 6) as energy_wh from fleet""",
    "latest_panel_status": _LATEST,
    "latest_panel_status_of_topic": _LATEST,
    "latest_fleet_power": _AGG + """
      select max(window_end) as window_end,
             round(arg_max(total_power, window_end), 6) as total_power from fleet""",
    "panel_power_histogram": _AGG + """
      select Panel_id, floor((total_power - 398) / 20) * 20 + 398 as bucket_start,
             count(*) as windows from agg group by 1, 2""",
    "fleet_power_histogram": _AGG + """
      select floor((total_power - 398) / 20) * 20 + 398 as bucket_start,
             count(*) as windows from agg group by 1""",
    "panel_power_histogram_auto": _AGG + """,
spans as (select (max(total_power) - min(total_power)) / 30 as least from agg),
powers as (select least, pow(10e0, floor(log10(least))) as p from spans),
widths as (
  select case when least <= p then p when least <= 2 * p then 2 * p
              when least <= 5 * p then 5 * p else 10 * p end as width from powers)
      select Panel_id, floor(total_power / width) * width as bucket_start,
             count(*) as windows, width from agg, widths group by 1, 2, 4""",
    "panel_power_wide": _AGG + f"""
      select window_end, {_WIDE_COLUMNS},
             round(sum(total_power) filter (where Panel_id not in ({_WIDE_NAMES})), 6)
               as other_panels
      from agg group by window_end""",
    "expected_output": _curve(
        "(6 + Panel_id::bigint % 12) * 3600 + (Panel_id::bigint % 60) * 60", 1, 30),
    "expected_output_day": _curve("9 * 3600", 6, 1),
    "stream_raw_readings": _ALL_RAW,
    "stream_restart_exactly_once": _ALL_RAW,
    "stream_rejected_readings": _REJECTS,
    "stream_panel_power_append": _AGG + _ALL_WINDOWS + """
      where window_end <= (select max(ts) from events) - interval 3630 second""",
    "stream_panel_power_update": _AGG + _ALL_WINDOWS,
    "stream_current_windows": _AGG + _ALL_WINDOWS,
    "stream_bad_clock": _windows(where="ingest_seq % 1000 <> 0") + _ALL_WINDOWS,
    "late_readings_kept": _AGG + _ALL_WINDOWS,
    "late_readings_repaired": _AGG + _ALL_WINDOWS,
    "late_readings_merged": _AGG + _ALL_WINDOWS,
    "stream_panel_own_clock": _FAR,
    "stream_fleet_energy": _AGG + """
      select window_end, round(total_power * 0.0083333333e0, 6) as energy_wh from fleet
      where window_end <= (select max(ts) from events) - interval 3630 second""",
    "stream_resent_readings": _ALL_RAW,
    "stream_two_clocks": _AGG + _ALL_WINDOWS,
    "fleet_energy_rollup": _ROLLUP + " union all ".join(f"""
      select '{grain}' as grain, {start} as start, round(sum(wh), 6) as energy_wh,
             count(*) as windows from energy group by 2""" for grain, start in (
          ("30 seconds", "start"), ("1 hour", "date_trunc('hour', start)"),
          ("1 day", "cast(date_trunc('day', start) as timestamp)"))),
    "fleet_energy_between": _ROLLUP + f"""
      select round(sum(wh), 6) as energy_wh, count(*) as windows from energy
      where start >= timestamp '{SOME_WEEKS[0]}' and start < timestamp '{SOME_WEEKS[1]}'""",
    "ingest_ledger": _LEDGER,
    "stream_repartitioned_state": _FAR,
    "stream_latest_panel_status": _LATEST,
}
