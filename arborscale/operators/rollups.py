"""Rollups, conditional aggregates, quantiles and profiles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def classes(c: Column, bounds: Sequence[float], names: Sequence[str]) -> Column:
    """The name of the first bound that the value lies below, the last name from there on; null stays null."""
    out = F.when(c < bounds[0], names[0])
    for bound, name in zip(bounds[1:], names[1:], strict=False):
        out = out.when(c < bound, name)
    return out.when(c.isNotNull(), names[-1])


def dbh_class(c: Column) -> Column:
    return classes(c, (6, 12, 24, 36), ("<6", "6-12", "12-24", "24-36", "36+"))


def crown_class(c: Column) -> Column:
    return classes(c, (3, 5, 8, 12), ("<3", "3-5", "5-8", "8-12", "12+"))


def count_by(df: DataFrame, *keys: str | Column) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("trees"))


def canopy_rollup(df: DataFrame, observed: str, predicted: Column) -> DataFrame:
    """Trees and canopy area by city, species and crown class; the predicted width fills in for a missing one."""
    width = F.coalesce(F.col(observed), predicted)
    return df.withColumn("width", width).groupBy("city", "species", crown_class(F.col("width")).alias("crown_class")).agg(F.count("*").alias("trees"), F.sum(F.pi() * (F.col("width") / 2) ** 2).alias("canopy_m2"))


def re_aggregated(rollup: DataFrame, *keys: str) -> DataFrame:
    """A coarser count from a stored rollup."""
    return rollup.groupBy(*keys).agg(F.sum("trees").alias("trees"))


def ols(df: DataFrame, keys: Sequence[str], x: Column, y: Column) -> DataFrame:
    """Ordinary least squares of y on x by group, from moments that combine map-side: n, slope, intercept, residual
    deviation, r2 and the largest x."""
    points = df.withColumn("x_", x).withColumn("y_", y).where("x_ is not null and y_ is not null")
    m = points.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("x_").alias("mx"), F.avg("y_").alias("my"), F.regr_sxx("y_", "x_").alias("sxx"), F.regr_syy("y_", "x_").alias("syy"), F.regr_sxy("y_", "x_").alias("sxy"), F.max("x_").alias("x_max"))
    slope = F.when(F.col("sxx") > 0, F.col("sxy") / F.col("sxx"))
    left = F.greatest(F.col("syy") - slope * F.col("sxy"), F.lit(0.0))
    return m.select(*keys, "n", slope.alias("b"), (F.col("my") - slope * F.col("mx")).alias("a"), F.when(F.col("n") > 2, F.sqrt(left / (F.col("n") - 2))).alias("sigma"), F.when((F.col("syy") > 0) & (F.col("sxx") > 0), F.col("sxy") ** 2 / F.col("sxx") / F.col("syy")).alias("r2"), "x_max")


def quantiles(df: DataFrame, keys: Sequence[str], value: Column, at: Mapping[str, float], plausible: Column) -> DataFrame:
    """Exact quantiles with linear interpolation over plausible values."""
    return df.where(plausible).groupBy(*keys).agg(*[F.percentile(value, F.lit(p)).alias(name) for name, p in at.items()], F.count("*").alias("n"))


def profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Present, null, least, greatest, distinct and median (of numbers) of each column, a row each, from one pass."""
    one = df.agg(*[a for c in columns for a in (F.count(c).alias(f"n_{c}"), F.count_if(F.col(c).isNull()).alias(f"z_{c}"), F.min(c).cast("string").alias(f"lo_{c}"), F.max(c).cast("string").alias(f"hi_{c}"), F.countDistinct(c).alias(f"d_{c}"), F.percentile(F.col(c).try_cast("double"), F.lit(0.5)).alias(f"m_{c}"))])
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"n_{c}").alias("present"), F.col(f"z_{c}").alias("nulls"), F.col(f"lo_{c}").alias("least"), F.col(f"hi_{c}").alias("greatest"), F.col(f"d_{c}").alias("kinds"), F.col(f"m_{c}").alias("median")) for c in columns])
    return one.select(F.inline(rows))


def vocabulary_coverage(df: DataFrame, key: str, vocabulary: DataFrame) -> DataFrame:
    """How many rows have a value of the vocabulary, and the distinct values that it lacks."""
    by_value = df.groupBy(key).agg(F.count("*").alias("n")).join(vocabulary.select(key).distinct().withColumn("known_", F.lit(True)), key, "left")
    known = F.col("known_").isNotNull()
    return by_value.agg(F.sum(F.when(known, F.col("n")).otherwise(0)).alias("covered"), F.sum("n").alias("total"), F.count_if(~known).alias("unsupported"))


def unsupported(df: DataFrame, key: str, vocabulary: DataFrame) -> DataFrame:
    """Values that a vocabulary lacks, with their rows."""
    return df.groupBy(key).agg(F.count("*").alias("rows")).where(F.col(key).isNotNull()).join(vocabulary.select(key).distinct(), key, "left_anti")


def support_table(rows: DataFrame, cities_: Sequence[str] | None = None) -> DataFrame:
    """Each species with its trees, distinct chips and blocks, and a column of trees for each city: those given, or else all, which
    may not be more than Spark pivots."""
    n = rows.groupBy("species").agg(F.count("*").alias("trees"), F.countDistinct("chip").alias("chips"), F.countDistinct("block").alias("blocks"))
    cities = rows.groupBy("species").pivot("city", None if cities_ is None else list(cities_)).count().na.fill(0)
    return n.join(cities.withColumnRenamed("species", "of_"), F.col("species").eqNullSafe(F.col("of_"))).drop("of_")


def unpivoted_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The distinct values of each column as ``kind``, ``value``."""
    return df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).cast("string").alias("value")) for c in columns])).alias("p")).select("p.*").where("value is not null").distinct()


def badge_statistics(events: DataFrame) -> DataFrame:
    """Counts of each user's contributions (``tree_id``, ``ts``, ``photo``, ``rare``, ``dbh``, ``age``): distinct trees,
    rare, large (48 inches and more) and old ones (100 years and more) among them, photos, hours and days."""
    trees = lambda condition: F.countDistinct(F.when(condition, F.col("tree_id")))
    return events.groupBy("user_id").agg(
        F.countDistinct("tree_id").alias("trees"), F.count_if("photo").alias("photos"), F.count_if(F.hour("ts") < 6).alias("at_night"), trees(F.col("rare")).alias("rare"), F.max("dbh").alias("largest"),
        trees(F.col("dbh") >= 48).alias("giants"), trees(F.col("age") >= 100).alias("veterans"), F.countDistinct(F.to_date("ts")).alias("days")
    )


def mission_progress(events: DataFrame, targets: Mapping[str, int]) -> DataFrame:
    """Progress of each user in the missions of the cities that they contributed to: distinct trees against the city's
    target."""
    target = F.element_at(F.create_map(*[F.lit(x) for k, t in targets.items() for x in (k, t)]), F.col("mission")).cast("long")
    n = events.where(F.col("city").isin(*targets)).groupBy("user_id", F.col("city").alias("mission")).agg(F.countDistinct("tree_id").alias("n"))
    return n.select("user_id", "mission", F.least(target, "n").alias("progress"), (F.col("n") >= target).alias("earned"))


def badge_progress(metrics: DataFrame, metric: str, targets: Mapping[str, int]) -> DataFrame:
    """Progress of each user on each badge: a row for each, by exploding the fixed list of badges."""
    badges = F.array(*[F.struct(F.lit(k).alias("badge"), F.lit(t).cast("long").alias("target")) for k, t in targets.items()])
    b = metrics.withColumn("b", F.explode(badges))
    return b.select("user_id", "b.badge", F.least("b.target", metric).alias("progress"), (F.col(metric) >= F.col("b.target")).alias("earned"))
