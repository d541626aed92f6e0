"""Folders in whatever store Spark writes to."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _opened(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    store, place = _opened(spark, path)
    return store.exists(place)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it is absent."""
    store, place = _opened(spark, path)
    if not store.exists(place):
        return []
    return [found.getPath().getName() for found in store.listStatus(place)]


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder and all it holds; nothing happens if it is absent."""
    store, place = _opened(spark, path)
    store.delete(place, True)
