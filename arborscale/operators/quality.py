"""Publish guards, validation, freshness and folds of reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborscale.operators import clean


def grain_violations(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that repeat or hold a null, with their rows."""
    null = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).where((F.col("rows") > 1) | null)


def kept(new: DataFrame, old: DataFrame, keys: Sequence[str] = (), share: float = 0.75) -> DataFrame:
    """Whether each group, or the whole, keeps its share of the previous rows; a group that is gone fails."""
    n = new.groupBy(*keys).agg(F.count("*").alias("now"))
    o = old.groupBy(*keys).agg(F.count("*").alias("before"))
    both = o.join(n, [*keys], "full") if keys else o.crossJoin(F.broadcast(n))
    now, before = F.coalesce("now", F.lit(0)), F.coalesce("before", F.lit(0))
    return both.select(*keys, before.alias("before"), now.alias("now"), (now >= before * share).alias("ok"))


def bounds_report(df: DataFrame, lat: Column, lon: Column, box: tuple[float, float, float, float], most_null: float = 0.1) -> DataFrame:
    """One row: rows, null coordinates, rows out of bounds by cause, and whether the table may be published."""
    s, n, w, e = box
    r = df.agg(F.count("*").alias("rows"), F.count_if(lat.isNull() | lon.isNull()).alias("nulls"), F.count_if((lat < s) | (lat > n)).alias("latitude_out"), F.count_if((lon < w) | (lon > e)).alias("longitude_out"))
    return r.withColumn("ok", (F.col("rows") > 0) & (F.col("nulls") <= most_null * F.col("rows")))


def within_bounds(df: DataFrame, lat: Column, lon: Column, box: tuple[float, float, float, float]) -> DataFrame:
    """Rows whose coordinates are there and lie in the box."""
    s, n, w, e = box
    return df.where(lat.between(s, n) & lon.between(w, e))


def disjoint_union(parts: Mapping[str, DataFrame], label: str) -> tuple[DataFrame, DataFrame]:
    """The parts as one table, and the labels that stand in more than one of them."""
    named = [df.withColumn("part", F.lit(k)) for k, df in parts.items()]
    one = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)
    return one, one.groupBy(label).agg(F.count_distinct("part").alias("parts")).where("parts > 1")


def freshness(sources: DataFrame, published: Column, today: Column) -> DataFrame:
    """Rebuild if a source (``stamp``) is newer than what is published, or a week has begun since that was published, even
    if no source has changed."""
    newer, turned = F.coalesce(F.col("newest") > published, F.lit(False)), F.date_trunc("week", today) > F.date_trunc("week", published)
    return sources.agg(F.max("stamp").alias("newest")).select("newest", newer.alias("newer"), turned.alias("week_turned"), (newer | turned).alias("rebuild"))


def reconciled(blocks: DataFrame, rows: DataFrame) -> DataFrame:
    """Whether block counts (``block``, ``city``, ``n``) sum to the rows of each city."""
    b = blocks.groupBy("city").agg(F.sum("n").alias("in_blocks"))
    return b.join(rows.groupBy("city").agg(F.count("*").alias("rows")), "city", "full").select("city", F.coalesce("in_blocks", F.lit(0)).alias("in_blocks"), F.coalesce("rows", F.lit(0)).alias("rows"), F.col("in_blocks").eqNullSafe(F.col("rows")).alias("ok"))


def manifest_report(blocks: DataFrame, rows: DataFrame, previous: DataFrame, key: str, share: float = 0.75) -> DataFrame:
    """One row about block counts (``block``, ``city``, ``n``) of a table (``city`` and a key) and the city counts (``city``,
    ``rows``) published before: rows in blocks and in the table, keys that repeat, the share kept, cities lost, and
    ``ok``."""
    b, r = blocks.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("in_blocks")), rows.agg(F.count("*").alias("rows"))
    repeated = rows.groupBy(key).agg(F.count("*").alias("n_")).where("n_ > 1").agg(F.count("*").alias("repeated_keys"))
    lost = previous.join(rows.select("city").distinct(), "city", "left_anti").agg(F.count("*").alias("lost_cities"))
    p = previous.agg(F.sum("rows").alias("before"))
    one = b.crossJoin(F.broadcast(r)).crossJoin(F.broadcast(repeated)).crossJoin(F.broadcast(lost)).crossJoin(F.broadcast(p))
    ok = (F.col("in_blocks") == F.col("rows")) & (F.col("repeated_keys") == 0) & (F.col("lost_cities") == 0) & (F.col("rows") >= share * F.col("before"))
    return one.select("in_blocks", "rows", "repeated_keys", "lost_cities", (F.col("rows") / F.col("before")).alias("kept"), ok.alias("ok"))


def asset_report(df: DataFrame, key: str, ranges: Mapping[str, tuple[float, float]]) -> DataFrame:
    """One row: rows, distinct keys, and the values out of each range."""
    return df.agg(F.count("*").alias("rows"), F.countDistinct(key).alias("keys"), *[F.count_if(~F.col(c).between(*r)).alias(f"out_{c}") for c, r in ranges.items()])


def out_of_season(date: Column, year: int, months: tuple[int, int]) -> Column:
    """Whether a date is missing, of another year, or outside the months."""
    return ~F.coalesce((F.year(date) == year) & F.month(date).between(*months), F.lit(False))


def seasonal_report(df: DataFrame, key: str, ranges: Mapping[str, tuple[float, float]], date: str, year: int, months: tuple[int, int]) -> DataFrame:
    """One row: rows, distinct keys, rows with a value that is missing, not finite or out of its range, those out of
    season, and whether the asset is ``valid``: it has rows, no key repeats or is null, and no row is out."""
    bad = reduce(lambda a, b: a | b, [~F.coalesce(F.col(c).between(*r) & ~F.isnan(c), F.lit(False)) for c, r in ranges.items()])
    counts = df.agg(F.count("*").alias("rows"), F.countDistinct(key).alias("keys"), F.count_if(bad).alias("out_of_range"), F.count_if(out_of_season(F.col(date), year, months)).alias("out_of_season"))
    return counts.withColumn("valid", F.expr("rows > 0 and rows = keys and out_of_range = 0 and out_of_season = 0"))


def latest_values(reports: DataFrame, key: str, order: Sequence[str], fields: Sequence[str], flag: Column) -> DataFrame:
    """Reports folded in order: the latest value of each field that is not null, and the latest ``missing`` flag.

    The latest is the greatest by order, so the fold is an aggregate that combines map-side."""
    at = F.struct(*order)
    return reports.groupBy(key).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in fields], F.coalesce(F.max_by(flag, F.when(flag.isNotNull(), at)), F.lit(False)).alias("missing"))


def visible(trees: DataFrame, kinds: Sequence[str] | None = None) -> DataFrame:
    """Trees that a map shows: with coordinates on the globe, survivors of their cluster or in none, neither reported missing nor
    marked a duplicate (null counts as not), and of one of the source kinds if some are given."""
    finite = reduce(lambda a, b: a & b, [F.col(c).between(-most, most) & ~F.isnan(c) for c, most in (("latitude", 90), ("longitude", 180))])
    there = ~F.coalesce("missing", F.lit(False)) & ~F.coalesce("duplicate", F.lit(False)) & F.coalesce(F.col("tree_id") == F.col("cluster_id"), F.lit(True))
    of_kind = F.lit(True) if kinds is None else clean.source_kind(F.col("data_source")).isin(*kinds)
    return trees.where(finite & there & of_kind)


def purge(dimension: DataFrame, key: str, cleaned: Column, aliases: DataFrame, published: DataFrame) -> DataFrame:
    """Dimension rows that can be reached: the cleaned key is the key itself, or it is an alias or still published, or
    cleaning gives null."""
    keep = aliases.select(F.col(aliases.columns[0]).alias(key)).union(published.select(F.col(published.columns[0]).alias(key))).distinct()
    marked = dimension.withColumn("clean_", cleaned).withColumn("direct_", F.coalesce(F.col("clean_") == F.col(key), F.lit(True)))
    return marked.where("direct_").unionByName(marked.where("not direct_").join(keep, key, "left_semi")).drop("clean_", "direct_")


def top_coverage(counts: DataFrame, profiles: DataFrame, k: int) -> DataFrame:
    """One row: how many of the ``k`` commonest species (``species``, ``trees``) have a profile, and their share of the
    trees of these."""
    top = counts.where("species is not null").orderBy(F.desc("trees"), "species").limit(k)
    has = top.join(profiles.select("species", F.lit(True).alias("has_")).distinct(), "species", "left")
    covered = F.sum(F.when(F.col("has_"), F.col("trees")).otherwise(0))
    return has.agg(F.count("*").alias("species"), F.count("has_").alias("profiled"), (covered / F.sum("trees")).alias("share"))


def weighted_completeness(rows: DataFrame, weight: str, columns: Sequence[str]) -> DataFrame:
    """Share of the weight whose columns are filled, a row each."""
    one = rows.agg(F.sum(weight).alias("all"), *[F.sum(F.when(F.col(c).isNotNull(), F.col(weight)).otherwise(0)).alias(f"w_{c}") for c in columns])
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), (F.col(f"w_{c}") / F.col("all")).alias("share")) for c in columns])))
