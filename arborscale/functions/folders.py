"""Shared folders through Hadoop's file systems, so that every store works that Spark can open."""

from __future__ import annotations

import hashlib

from pyspark.sql import SparkSession


def _system(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    system, place = _system(spark, path)
    return system.exists(place)


def names(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder, none if there is no such folder."""
    system, place = _system(spark, path)
    return sorted(s.getPath().getName() for s in system.listStatus(place)) if system.exists(place) else []


def delete(spark: SparkSession, path: str) -> None:
    system, place = _system(spark, path)
    system.delete(place, True)


def move(spark: SparkSession, path: str, to: str) -> bool:
    """Rename a folder; false if the new name is taken."""
    system, place = _system(spark, path)
    target = _system(spark, to)[1]
    return not system.exists(target) and system.rename(place, target)


def fingerprint(spark: SparkSession, *paths: str) -> str:
    """A digest of the files below the paths, by name, size and time of change."""
    found = []
    for path in paths:
        system, place = _system(spark, path)
        stack = [place]
        while stack:
            for s in system.listStatus(stack.pop()):
                if s.isDirectory():
                    stack.append(s.getPath())
                else:
                    found.append(f"{s.getPath()} {s.getLen()} {s.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()
