"""Ranks, shares, top-k and samples by order."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborscale.functions import ordered
from arborscale.functions.groups import join_back


def with_group_counts(df: DataFrame, keys: Sequence[str], counts: Mapping[str, Column]) -> DataFrame:
    """Rows with counts over their group. The aggregate combines map-side and is joined back, so a group with a third
    of all rows is never sorted in one task, as a window would."""
    n = df.groupBy(*keys).agg(*[F.count_if(c).alias(name) for name, c in counts.items()])
    return join_back(df, n, keys)


def rarity(counts: DataFrame) -> DataFrame:
    """Share of a city's identified trees and tier of each species, from a rollup with ``trees``; trees without a species
    have neither and don't count."""
    known = F.col("species").isNotNull()
    total = F.sum(F.when(known, F.col("trees"))).over(Window.partitionBy("city"))
    n = F.when(known, F.col("trees"))
    tier = F.when(F.col("species").isNotNull(), F.when(n * 100 <= total, "rare").when(n * 20 <= total, "unusual").otherwise("common"))
    return counts.withColumn("share", n / total).withColumn("tier", tier)


def size_rank(df: DataFrame, key: str, value: str) -> DataFrame:
    """Competition rank of positive finite values in their group, largest first; other rows have none. A null
    group is a group like others.

    A rank is one more than the number of larger values, so it is summed over the distinct values of a group and joined
    back instead of sorting every row of a group in one task."""
    by_value = df.where((F.col(value) > 0) & (F.col(value) < float("inf"))).groupBy(key, value).agg(F.count("*").alias("n_"))
    over = Window.partitionBy(key).orderBy(F.desc(value)).rowsBetween(Window.unboundedPreceding, -1)
    ranks = by_value.withColumn("size_rank", (F.coalesce(F.sum("n_").over(over), F.lit(0)) + 1).cast("int")).drop("n_")
    named = ranks.select(F.col(key).alias("of_key_"), F.col(value).alias("of_value_"), "size_rank")
    return df.join(named, F.col(key).eqNullSafe(F.col("of_key_")) & (F.col(value) == F.col("of_value_")), "left").drop("of_key_", "of_value_")


def numbered(table: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """Rows of a table of any size numbered from 1 in an order that tells them apart."""
    return ordered.positions(table, name, *order).withColumn(name, (F.col(name) + 1).cast("int"))


def ranked(table: DataFrame, order: Sequence[Column], name: str, how: Column | None = None) -> DataFrame:
    """Rank over a small aggregated table, such as species or genera."""
    return table.withColumn(name, (F.rank() if how is None else how).over(Window.orderBy(*order)))


def cumulative(counts: DataFrame, name: str) -> DataFrame:
    """Running total ``upto`` of an aggregated table by trees and name, and the ``total``."""
    w = Window.orderBy(F.desc("trees"), name)
    return counts.withColumn("upto", F.sum("trees").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("trees").over(Window.partitionBy()))


def top_each(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group; Spark limits each task's groups before the shuffle."""
    return df.withColumn("rank_", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank_") <= k).drop("rank_")


def nested_top(counts: DataFrame, outer: str, inner: str, n: int, k: int) -> DataFrame:
    """The leading outer groups by trees, and the leading inner ones in each."""
    lead = counts.groupBy(outer).agg(F.sum("trees").alias("t_")).orderBy(F.desc("t_"), outer).limit(n).select(outer)
    return top_each(counts.join(F.broadcast(lead), outer), [outer], [F.desc("trees"), F.asc(inner)], k)


def outliers(df: DataFrame, key: str, value: str, least: float, factor: float, few: int, exempt: Column) -> DataFrame:
    """Values over ``least`` and over ``factor`` times the mean of their group, if it has ``few`` values or more."""
    mean = df.groupBy(key).agg(F.avg(value).alias("mean_"), F.count(value).alias("n_"))
    v = F.col(value)
    flag = (v >= least) & (v > factor * F.col("mean_")) & (F.col("n_") >= few) & ~exempt
    return join_back(df, mean, [key]).withColumn("outlier", F.coalesce(flag, F.lit(False))).drop("mean_", "n_")


def queue(df: DataFrame, key: str, strata: Sequence[tuple[Column, Sequence[Column], int]]) -> DataFrame:
    """Disjoint strata filled in order, each with its condition, order and quota."""
    taken: DataFrame | None = None
    for i, (condition, order, quota) in enumerate(strata, 1):
        rest = df.where(condition) if taken is None else df.where(condition).join(taken, key, "left_anti")
        part = rest.orderBy(*order).limit(quota).select(key, F.lit(i).alias("stratum"))
        taken = part if taken is None else taken.union(part)
    return taken


def diverse_order(rows: DataFrame) -> DataFrame:
    """An order of rows (``id``, ``split``, ``value``, ``species``, ``block``) that shows much early: within each split and
    quarter of its values one row of each species comes first, then one of each block, then the rest, each by a hash.
    Reading place by place over the buckets takes them in turn.

    The places are counts of the rows before, summed over ranges of the hash, so no bucket is sorted in one task."""
    at = ["split", "quarter"]
    cuts = rows.groupBy("split").agg(F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("cuts_"))
    above = sum(((F.col("value") > F.get("cuts_", F.lit(i))).cast("int") for i in range(3)), F.lit(1))
    r = join_back(rows, cuts, ["split"]).withColumn("quarter", above).drop("cuts_").withColumn("h_", F.md5(F.col("id").cast("string")))
    r = join_back(r, r.groupBy(*at, "species").agg(F.min("h_").alias("s_")), [*at, "species"])
    rest = F.when(F.col("h_") != F.col("s_"), F.col("h_"))
    r = join_back(r, r.groupBy(*at, "block").agg(F.min(rest).alias("b_")), [*at, "block"])
    r = r.withColumn("stage", F.when(F.col("h_") == F.col("s_"), 0).when(F.col("h_") == F.col("b_"), 1).otherwise(2)).withColumn("range_", F.left("h_", F.lit(3)))
    n = r.groupBy(*at, "stage", "range_").agg(F.count("*").alias("n_"))
    before = n.withColumn("n_", F.coalesce(F.sum("n_").over(Window.partitionBy(*at).orderBy("stage", "range_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = F.row_number().over(Window.partitionBy(*at, "stage", "range_").orderBy("h_", "id"))
    return join_back(r, before, [*at, "stage", "range_"]).withColumn("place", F.col("n_") + within).drop("h_", "s_", "b_", "range_", "n_")


def audit_sample(chips: DataFrame, size: int) -> DataFrame:
    """``size`` chips (``chip``, ``city``, ``density``, ``reviewed``, ``priority``) of each city: half of them drawn by a hash,
    evenly from the density classes and then from all to fill up; the other half by priority, those not reviewed first."""
    half, h, columns = size // 2, F.md5(F.concat_ws("|", "city", "chip")), chips.columns
    # a null city or class is a group like others, so rows are joined on keys without nulls
    group = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))
    chips = chips.withColumn("city_", group("city")).withColumn("density_", group("density"))
    n = chips.groupBy("city_", "density_", "density").agg(F.count("*").alias("n_"))
    nth = F.row_number().over(Window.partitionBy("city_").orderBy("density")) - 1
    quota = n.withColumn("quota_", F.least(F.lit(half // 3) + (nth < half % 3).cast("int"), F.col("n_"))).drop("n_", "density")
    place = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(h, "chip"))
    drawn = chips.withColumn("p_", place("city_", "density_")).where(F.col("p_") <= half // 3 + 1).join(quota, ["city_", "density_"]).where("p_ <= quota_").drop("p_", "quota_")
    short = quota.groupBy("city_").agg((F.lit(half) - F.sum("quota_")).alias("short_"))
    rest = chips.join(drawn.select("city_", "chip"), ["city_", "chip"], "left_anti")
    more = rest.withColumn("p_", place("city_")).where(F.col("p_") <= half).join(short, "city_").where("p_ <= short_").drop("p_", "short_")
    audit = drawn.unionByName(more)
    left = chips.join(audit.select("city_", "chip"), ["city_", "chip"], "left_anti")
    many = audit.groupBy("city_").agg((F.lit(size) - F.count("*")).alias("many_"))
    worst = F.row_number().over(Window.partitionBy("city_").orderBy("reviewed", F.desc("priority"), "chip"))
    diagnostic = left.withColumn("p_", worst).where(F.col("p_") <= size).join(many, "city_").where("p_ <= many_").drop("p_", "many_")
    return audit.withColumn("queue", F.lit("audit")).unionByName(diagnostic.withColumn("queue", F.lit("diagnostic"))).select(*columns, "queue")


def share_with_fallback(df: DataFrame, least: Mapping[str, int], member: Column) -> DataFrame:
    """Share of members at the first level that has rows enough, for each combination of the levels."""
    rows = df.withColumn("m_", member.cast("int"))
    out = rows.select(*least).distinct()
    for level, n in least.items():
        share = rows.groupBy(level).agg(F.avg("m_").alias(f"s_{level}"), F.count("m_").alias("n_")).where(F.col("n_") >= n).drop("n_")
        out = out.join(share, level, "left")
    level = F.coalesce(*[F.when(F.col(f"s_{c}").isNotNull(), F.lit(c)) for c in least])
    return out.select(*least, F.coalesce(*[F.col(f"s_{c}") for c in least]).alias("share"), level.alias("level"))


def foliage_shares(trees: DataFrame, least: int = 20) -> DataFrame:
    """For each cell of a degree (``cell``) and ``genus`` the share of deciduous trees among its identified ones, from the first ``level`` with
    enough of them: the ``cell``, the ``region`` of five degrees, the ``genus`` everywhere; null of none. ``open_trees`` counts the rest.

    Trees (``latitude``, ``longitude``, ``genus``, ``identified``, ``deciduous``) are summed by cell once; regions and genera are
    sums of cells. Trees without a position or genus are in none."""
    cell = (F.floor("latitude") + 90) * 360 + F.floor("longitude") + 180
    region = (F.floor(F.col("latitude") / 5) + 18) * 72 + F.floor(F.col("longitude") / 5) + 36
    known = F.coalesce("identified", F.lit(False))
    n = trees.where(cell.isNotNull() & F.col("genus").isNotNull()).groupBy("genus", cell.alias("cell"), region.alias("region")).agg(F.count_if(known).alias("n_cell"), F.count_if(known & F.col("deciduous")).alias("d_cell"), F.count_if(~known).alias("open_trees"))
    for level, keys in (("region", ["genus", "region"]), ("genus", ["genus"])):
        n = n.join(n.groupBy(*keys).agg(F.sum("n_cell").alias(f"n_{level}"), F.sum("d_cell").alias(f"d_{level}")), keys)
    levels = ("cell", "region", "genus")
    share = F.coalesce(*[F.when(F.col(f"n_{k}") >= least, F.col(f"d_{k}") / F.col(f"n_{k}")) for k in levels])
    return n.select("cell", "genus", share.alias("deciduous_share"), F.coalesce(*[F.when(F.col(f"n_{k}") >= least, F.lit(k)) for k in levels]).alias("level"), "open_trees")


def observed_interval(stamps: DataFrame, keys: Sequence[str], stamp: str, planned: float) -> DataFrame:
    """Median gap in days between consecutive stamps of each key, and a verdict against the plan at a factor of 2."""
    gap = F.datediff(stamp, F.lag(stamp).over(Window.partitionBy(*keys).orderBy(stamp)))
    median = stamps.withColumn("gap_", gap).where("gap_ is not null").groupBy(*keys).agg(F.percentile("gap_", F.lit(0.5)).alias("gap"))
    return median.withColumn("verdict", F.when(F.col("gap") > 2 * planned, "slower").when(F.col("gap") < planned / 2, "faster").otherwise("as planned"))


def smoothed_density(points: DataFrame) -> DataFrame:
    """Each point's density: counts by cell, spread to the 3 x 3 neighbours with falling weights, looked up by cell."""
    counts = points.groupBy("cx", "cy").agg(F.count("*").alias("n"))
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(1 / (1.0 + i * i + j * j)).alias("w")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    spread = counts.withColumn("s", F.explode(steps)).groupBy((F.col("cx") + F.col("s.i")).alias("cx"), (F.col("cy") + F.col("s.j")).alias("cy")).agg(F.sum(F.col("n") * F.col("s.w")).alias("density"))
    return points.join(spread, ["cx", "cy"])
