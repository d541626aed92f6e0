"""Column names, types and constants of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

# The names, types and numbers existing producers, tables and
# dashboards already use.  They must not change.
PANEL = "Panel_id"
POWER = "power_panel"
STATUS = "current_status"
EVENT_TIME = "time_data"
WINDOW_POWER = "total_power"  # the mean W of the panel in the window
WINDOW_START = "window_start"
WINDOW_END = "window_end"
TOPIC = "panelInfo"
RAW_TABLE = "panelData"
WINDOW_TABLE = "panelDataAgg"
WINDOW_DURATION = "30 seconds"
WINDOW_HOURS = 0.0083333333  # 30 s in hours, to ten digits
HISTOGRAM_OFFSET = 398.0
STATUS_ACTIVE = 1
STATUS_OFFLINE = 0
POWER_PRECISION, POWER_SCALE = 20, 3
PANEL_LENGTH = 250

READING_SCHEMA = T.StructType([
    T.StructField(PANEL, T.StringType()),
    T.StructField(POWER, T.DoubleType()),
    T.StructField(STATUS, T.IntegerType()),
    T.StructField(EVENT_TIME, T.TimestampType()),
])

POWER_STORED = T.DecimalType(POWER_PRECISION, POWER_SCALE)

# The raw table as stored: the power is exact, the day prunes scans.
RAW_SCHEMA = T.StructType([
    T.StructField(PANEL, T.StringType(), False),
    T.StructField(POWER, POWER_STORED, False),
    T.StructField(STATUS, T.IntegerType(), False),
    T.StructField(EVENT_TIME, T.TimestampType()),
    T.StructField("day", T.DateType()),
])

WINDOW_SCHEMA = T.StructType([
    T.StructField(PANEL, T.StringType()),
    T.StructField(WINDOW_POWER, T.DoubleType()),
    T.StructField(WINDOW_START, T.TimestampType()),
    T.StructField(WINDOW_END, T.TimestampType()),
])

# What a batch adds to a window: sums instead of a mean, so rows of any time can
# be added later.  ``through`` is the last offset of the partition among them.
POWER_SUM, READINGS, THROUGH = "power_sum", "readings", "through"
PARTS_SCHEMA = T.StructType([
    T.StructField(PANEL, T.StringType()),
    T.StructField(WINDOW_START, T.TimestampType()),
    T.StructField("partition", T.IntegerType()),
    T.StructField(POWER_SUM, T.DoubleType()),
    T.StructField(READINGS, T.LongType()),
    T.StructField(THROUGH, T.LongType()),
])

# The last status of a panel in each partition of the topic.
STATUS_SCHEMA = T.StructType([
    T.StructField(PANEL, T.StringType()),
    T.StructField("partition", T.IntegerType()),
    T.StructField(STATUS, T.IntegerType()),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("offset", T.LongType()),
])

# What the message broker's source hands over.
MESSAGE_SCHEMA = T.StructType([
    T.StructField("key", T.BinaryType()),
    T.StructField("value", T.BinaryType()),
    T.StructField("topic", T.StringType()),
    T.StructField("partition", T.IntegerType()),
    T.StructField("offset", T.LongType()),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("timestampType", T.IntegerType()),
])
BROKER_TIME = 1  # the type of a timestamp that the broker set; others are the producer's

# Panels stamp their readings up to one hour ahead of the offline heartbeats
# (clock skew), and 30 s is the lateness the pipeline declares (D1, D2).  The
# watermark drops what comes later than that; such rows stay in the raw table,
# from which their windows are repaired.
WATERMARK_DELAY = "1 hour 30 seconds"

# A stamp further ahead of the broker's time than this is a broken clock.  It is
# below the delay, so no clock that passes makes the watermark drop rows on time.
CLOCK_AHEAD = "1 hour 15 seconds"
