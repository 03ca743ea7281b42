"""File-system questions asked through Spark's own Hadoop client."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _path(spark: SparkSession, uri: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, uri: str) -> bool:
    path, fs = _path(spark, uri)
    found = fs.globStatus(path)
    return found is not None and len(found) > 0


def path_bytes(spark: SparkSession, uri: str) -> int:
    path, fs = _path(spark, uri)
    return int(fs.getContentSummary(path).getLength())
