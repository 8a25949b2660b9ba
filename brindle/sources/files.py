"""Folders and files through the file systems that Spark knows, local or not."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _system(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def is_folder(spark: SparkSession, path: str) -> bool:
    if "*" in path:
        return False
    system, target = _system(spark, path)
    return system.exists(target) and system.getFileStatus(target).isDirectory()


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names of what a folder holds, in order."""
    system, target = _system(spark, path)
    return sorted(s.getPath().getName() for s in system.listStatus(target))
