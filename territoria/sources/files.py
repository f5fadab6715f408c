"""Folders in whatever store a path names, through Spark's own file system layer."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    place, store = _at(spark, path)
    return store.exists(place)


def children(spark: SparkSession, path: str) -> list[str]:
    """Full paths of a folder's entries; none if it does not exist."""
    place, store = _at(spark, path)
    return [str(s.getPath().toString()) for s in store.listStatus(place)] if store.exists(place) else []


def remove(spark: SparkSession, path: str) -> None:
    place, store = _at(spark, path)
    store.delete(place, True)


def remove_at_end(spark: SparkSession, path: str) -> None:
    """The store deletes the folder when the driver's process ends."""
    place, store = _at(spark, path)
    store.deleteOnExit(place)
