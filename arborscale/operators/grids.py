"""Rasters as tables: disks on cells, nearest open cells, masks and views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborscale.operators import cells


def disk_cells(crowns: DataFrame, size: float, low: float, high: float) -> DataFrame:
    """Cells (``cx``, ``cy``) whose centre lies in a crown's circle (``id``, ``x``, ``y``, ``r``), the radius held to
    bounds; each cell keeps the crown with the least distance by radius, of ties the taller and then the lower id."""
    r = F.greatest(F.lit(low), F.least("r", F.lit(high)))
    span = lambda c: F.sequence(F.floor((F.col(c) - F.col("r_")) / size), F.floor((F.col(c) + F.col("r_")) / size))
    near = crowns.withColumn("r_", r).withColumn("cx", F.explode(span("x"))).withColumn("cy", F.explode(span("y")))
    d = F.sqrt(((F.col("cx") + 0.5) * size - F.col("x")) ** 2 + ((F.col("cy") + 0.5) * size - F.col("y")) ** 2)
    inside = near.withColumn("ratio", d / F.col("r_")).where("ratio <= 1")
    return inside.groupBy("cx", "cy").agg(F.min(F.struct("ratio", (-F.col("height")).alias("down"), "id")).alias("m")).select("cx", "cy", F.col("m.id").alias("id"), F.col("m.ratio").alias("ratio"))


def nearest_open(blocked: DataFrame, reach: int, stop) -> DataFrame:
    """For each blocked cell (``cx``, ``cy``) the nearest cell that isn't, and its distance in cells, up to ``reach``.

    Only open cells that touch a blocked one can be nearest, so the frontier is found first. Passes widen the ring that
    is searched, and a pass accepts only distances that no wider ring can beat; the last pass takes what is in reach."""
    ring = cells.neighbours(blocked, "cx", "cy").select(F.col("nx").alias("cx"), F.col("ny").alias("cy")).distinct()
    frontier = stop(ring.join(blocked, ["cx", "cy"], "left_anti").select(F.col("cx").alias("ox"), F.col("cy").alias("oy")))
    rest, done = blocked.select("cx", "cy"), None
    width = 2
    while True:
        width = min(width, reach)
        near = cells.pairs_within(rest.select(F.col("cx").alias("x"), F.col("cy").alias("y")), frontier.select(F.col("ox").alias("x"), F.col("oy").alias("y")), float(width))
        best = near.groupBy(F.col("l_x").alias("cx"), F.col("l_y").alias("cy")).agg(F.min(F.struct("distance", F.col("r_x").alias("ox"), F.col("r_y").alias("oy"))).alias("m"))
        found = stop(best.select("cx", "cy", "m.ox", "m.oy", "m.distance"))
        done = found if done is None else done.union(found)
        rest = stop(rest.join(found, ["cx", "cy"], "left_anti"))
        if width >= reach or rest.isEmpty():
            return done
        width *= 2


def pixel_ok(bits: Column, bad: int, value: Column, low: float, high: float) -> Column:
    """Whether a pixel has none of the bad bits and lies within the thresholds."""
    return (bits.bitwiseAND(bad) == 0) & value.between(low, high)


def raster_cells(pixels: DataFrame, least_land: float, least_cover: float, least_pixels: int) -> DataFrame:
    """Pixels (``cx``, ``cy``, ``day``, ``value``, ``valid``, ``wet``) by cell: all pixels, those on land, the valid ones and
    their mean, the mean of each day in order, and whether the cell is ``eligible``: enough of it is land, enough of the
    land is valid, and enough pixels are.

    Days are summed first, so that what is gathered for a cell is a row a day."""
    ok = F.coalesce(F.col("valid"), F.lit(False))
    value = F.when(ok, F.col("value"))
    land = F.count_if(~F.coalesce(F.col("wet"), F.lit(False)))
    daily = pixels.groupBy("cx", "cy", "day").agg(F.sum(value).alias("s"), F.count_if(ok).alias("n"), F.count("*").alias("p"), land.alias("l"))
    mean = F.when(F.col("n") > 0, F.struct("day", (F.col("s") / F.col("n")).alias("mean")))
    cells_ = daily.groupBy("cx", "cy").agg(F.sum("p").alias("pixels"), F.sum("l").alias("land"), F.sum("n").alias("valid"), F.sum("s").alias("s"), F.array_sort(F.collect_list(mean)).alias("days"))
    eligible = (F.col("land") > 0) & (F.col("land") >= least_land * F.col("pixels")) & (F.col("valid") >= least_cover * F.col("land")) & (F.col("valid") >= least_pixels)
    return cells_.withColumn("mean", F.col("s") / F.nullif("valid", F.lit(0))).withColumn("eligible", eligible).drop("s")


def view_deltas(cells_: DataFrame, views: DataFrame) -> DataFrame:
    """Eligible cells (``cx``, ``cy``, ``value``) in each view (``view``, ``x0``, ``y0``, ``n`` cells on a side): the
    delta to the mean of the view. Cells join on the cells of the views, which are exploded."""
    side = F.sequence(F.lit(0).cast("long"), (F.col("n") - 1).cast("long"))
    member = views.withColumn("i", F.explode(side)).withColumn("j", F.explode(side)).select("view", (F.col("x0") + F.col("i")).alias("cx"), (F.col("y0") + F.col("j")).alias("cy"))
    inside = cells_.join(member, ["cx", "cy"])
    mean = inside.groupBy("view").agg(F.avg("value").alias("mean"), F.count("*").alias("cells"))
    return inside.join(mean, "view").select("view", "cx", "cy", (F.col("value") - F.col("mean")).alias("delta"), "cells")


def covered_share(crowns: DataFrame, size: float, block: int) -> DataFrame:
    """Share of the small cells of each block (``block`` cells on a side) that a crown covers."""
    c = disk_cells(crowns, size, 0.0, 1e9)
    return c.groupBy(F.floor(F.col("cx") / block).alias("bx"), F.floor(F.col("cy") / block).alias("by")).agg((F.count("*") / (block * block)).alias("share"))


def extremes(rows: DataFrame, key: str, value: str, id_: str) -> DataFrame:
    """The highest and lowest row of each view, ties by id."""
    return rows.groupBy(key).agg(F.min_by(id_, F.struct(-F.col(value), F.col(id_))).alias("hottest"), F.min_by(id_, F.struct(F.col(value), F.col(id_))).alias("coolest"))


def cell_owner(covers: DataFrame) -> DataFrame:
    """Each cell to the nearest of the views that cover it, ties by name (``cell``, ``view``, ``distance``)."""
    return covers.groupBy("cell").agg(F.min(F.struct("distance", "view")).alias("m")).select("cell", "m.view", "m.distance")
