"""Sinks: Parquet tables and per-batch outputs."""
