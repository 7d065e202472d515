"""Scans in an order over range partitions: places, running sums and maxima, and exact order statistics, none of which
passes a table through one task as a window without a partition does."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborscale.functions.lineage import checkpointed

#: Buckets of a narrowing pass, and values that are few enough to be sorted as they are.
BUCKETS, FEW = 1024, 4096


def ranged(df: DataFrame, *order: Column | str) -> DataFrame:
    """Rows in range partitions by the order, each with its range ``range_`` and place ``at_`` in it, from a checkpoint. Rows that
    are equal in the order lie in one range, so the order should tell rows apart."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    along = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # its low bits count the rows of a partition
    return checkpointed(along.withColumn("range_", F.spark_partition_id()).withColumn("at_", place))


def _before(along: DataFrame, totals: Mapping[str, Column], merge) -> DataFrame:
    """What lies before each range, a row a range: few enough for every task."""
    sums = along.groupBy(F.col("range_").alias("of_range_")).agg(*[c.alias(name) for name, c in totals.items()])
    earlier = Window.orderBy("of_range_").rowsBetween(Window.unboundedPreceding, -1)
    return F.broadcast(sums.select("of_range_", *[merge(name).over(earlier).alias(name) for name in totals]))


def positions(df: DataFrame, name: str, *order: Column | str) -> DataFrame:
    """The rows with their place in the order, from 0, without gaps."""
    along = ranged(df, *order)
    before = _before(along, {"before_": F.count("*")}, F.sum)
    placed = along.join(before, F.col("range_") == F.col("of_range_"))
    return placed.withColumn(name, F.col("at_") + F.coalesce("before_", F.lit(0))).drop("range_", "at_", "of_range_", "before_")


def scanned(df: DataFrame, order: Sequence[Column | str], sums: Mapping[str, str] | None = None, maxima: Mapping[str, str] | None = None) -> DataFrame:
    """The rows with running sums and maxima of columns up to and with each row in the order."""
    sums, maxima = sums or {}, maxima or {}
    along = ranged(df, *order)
    here = Window.partitionBy("range_").orderBy("at_").rowsBetween(Window.unboundedPreceding, 0)
    for columns, of, merge in ((sums, F.sum, lambda here, before: here + F.coalesce(before, F.lit(0))), (maxima, F.max, F.greatest)):
        if columns:
            before = _before(along, {f"{name}_before_": of(c) for name, c in columns.items()}, of)
            along = along.withColumns({f"{name}_here_": of(c).over(here) for name, c in columns.items()}).join(before, F.col("range_") == F.col("of_range_")).drop("of_range_")
            along = along.withColumns({name: merge(F.col(f"{name}_here_"), F.col(f"{name}_before_")) for name in columns}).drop(*[f"{name}_{k}_" for name in columns for k in ("here", "before")])
    return along.drop("range_", "at_")


def order_statistics(df: DataFrame, value: Column, ranks: Sequence[int]) -> dict[int, float]:
    """The values at some places (from 0) of the sorted values that are numbers; places beyond them have none.

    Each pass counts the values of an interval in buckets and goes on with the bucket that holds the place, until it holds one
    value or few; nothing is sorted or shuffled but counters."""
    values = df.select(value.cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    whole = values.agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).head()
    found: dict[int, float] = {}
    todo = [(whole["low"], whole["high"], 0, whole["n"], sorted({r for r in ranks if 0 <= r < whole["n"]}))]
    while todo:
        low, high, before, n, wanted = todo.pop()
        if not wanted:
            continue
        if low == high:
            found |= dict.fromkeys(wanted, low)
            continue
        inside = values.where(F.col("v").between(low, high))
        if n <= FEW:
            few = sorted(r["v"] for r in inside.collect())
            found |= {r: few[r - before] for r in wanted}
            continue
        bucket = F.least(F.floor((F.col("v") - low) / (high - low) * BUCKETS), F.lit(BUCKETS - 1))
        for b in sorted(inside.groupBy(bucket.alias("b")).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect()):
            todo.append((b["low"], b["high"], before, b["n"], [r for r in wanted if before <= r < before + b["n"]]))
            before += b["n"]
    return found


def quantiles(df: DataFrame, value: Column, at: Sequence[float]) -> list[float | None]:
    """Exact quantiles with linear interpolation, as ``percentile`` gives them; None of no values."""
    n = df.select(value.cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v")).count()
    if not n:
        return [None] * len(at)
    places = [(n - 1) * p for p in at]
    found = order_statistics(df, value, [r for h in places for r in (int(h), min(int(h) + 1, n - 1))])
    return [found[int(h)] + (found[min(int(h) + 1, n - 1)] - found[int(h)]) * (h - int(h)) for h in places]
