"""Analytics over solar-panel telemetry as plain Spark DataFrame functions.

Every operator takes DataFrames and returns DataFrames built from Spark's own
expressions, so the same function serves a batch table and a stream.  The IDs
"""
