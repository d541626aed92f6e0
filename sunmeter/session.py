"""Session settings the operators rely on, and the shared scratch folder."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CHANGELOG = "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled"
STORED_TIMES = "spark.sql.parquet.outputTimestampType"
SHUFFLE_PARTITIONS = "spark.sql.shuffle.partitions"


def prepare(spark: SparkSession) -> SparkSession:
    """Set what results depend on; sizing is the deployer's and the adaptive planner's.

    Wire times carry no zone, so the session zone decides what they mean: UTC.
    State goes to RocksDB, which keeps it off the JVM heap when there are many
    panels, and a batch saves its changes only, not whole snapshots.  Times are
    written as numbers of microseconds: the form that Spark writes by default has no least and
    greatest values, by which ranges of time pass files and row groups by.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set(STATE_STORE, ROCKSDB)
    spark.conf.set(CHANGELOG, "true")
    spark.conf.set(STORED_TIMES, "TIMESTAMP_MICROS")
    return spark


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder all executors share.

    That is ``spark.checkpoint.dir``; a session without one, as in tests, uses its
    warehouse, which is shared by the same rule.  Old runs are the deployer's to
    remove, by the age of their folders.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    root = root or f"{spark.conf.get('spark.sql.warehouse.dir')}/scratch"
    return f"{root.rstrip('/')}/sunmeter/{name}-{uuid.uuid4().hex}"
