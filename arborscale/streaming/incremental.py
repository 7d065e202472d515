"""Rollups and report folds as streams: the aggregates of both are associative by key."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborscale.operators import reports


def city_species_counts(stream: DataFrame) -> DataFrame:
    """Trees by city and species, for ``update`` mode."""
    return stream.groupBy("city", "species").agg(F.count("*").alias("trees"))


def latest_reports(stream: DataFrame, key: str, order: str, field: str) -> DataFrame:
    """The latest value of a field for each key, for ``update`` mode."""
    return stream.where(F.col(field).isNotNull()).groupBy(key).agg(F.max_by(field, order).alias(field))


def repeated_keys(stream: DataFrame, keys: Sequence[str], page: str) -> DataFrame:
    """Keys that repeat or hold a null, over all pages so far, with their ``rows``, ``first_page`` and ``last_page``, for ``update`` and ``complete``
    mode. Keys already seen are the state of the stream, spread over its partitions, so a page is checked against all before it
    and no page is read twice."""
    null = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    return stream.groupBy(*keys).agg(F.count("*").alias("rows"), F.min(page).alias("first_page"), F.max(page).alias("last_page")).where((F.col("rows") > 1) | null)


def corrections(stream: DataFrame) -> DataFrame:
    """Corrections by tree from a stream of reports (``reports.EXPORT`` with a ``place``), for ``update`` and ``complete`` mode: a late report
    takes its place by its stamp, whatever came before it."""
    return reports.corrections(reports.folded(stream))


def windowed_counts(stream: DataFrame, stamp: str, late: str, width: str, *keys: str) -> DataFrame:
    """Counts by event-time window and keys; rows later than the watermark are not counted."""
    return stream.withColumn(stamp, F.col(stamp).cast("timestamp")).withWatermark(stamp, late).groupBy(F.window(stamp, width), *keys).agg(F.count("*").alias("n"))
