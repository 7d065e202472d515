"""Nearest rows of another table without a limit on the distance, and the calibration of grid sizes against them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arborscale.functions.lineage import checkpointed
from arborscale.operators import cells


def _placed(df: DataFrame) -> DataFrame:
    return df.select("id", "x", "y").where(F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan("x") & ~F.isnan("y"))


def _least(df: DataFrame, keys: Sequence[str], order: Sequence[str], most: int) -> DataFrame:
    """The first rows of each group, cut before they are shuffled."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("place") <= most)


def nearest_two(left: DataFrame, right: DataFrame, same: bool = False, widen: int = 4) -> DataFrame:
    """For each row of ``left`` (``id``, ``x``, ``y``) its ``nearest`` row of ``right`` (least id of equals), the distance ``d1`` and the distance
    ``d2`` of the second; null where there is none. With ``same`` both are one table and no row is near itself.

    Cells start about as wide as rows of ``right`` are apart. Whoever has two rows within a cell's width is decided, since nothing
    outside the neighbouring cells is nearer; cells widen for the others only, until they are as wide as all places."""
    left, right = checkpointed(_placed(left)), checkpointed(_placed(right))
    box = right.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.count("*").alias("n")).head()
    other = left.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")).head()
    if not box["n"] or other["x0"] is None:
        return left.select("id", F.lit(None).cast(dict(right.dtypes)["id"]).alias("nearest"), F.lit(None).cast("double").alias("d1"), F.lit(None).cast("double").alias("d2"))
    span = max(max(box["x1"], other["x1"]) - min(box["x0"], other["x0"]), max(box["y1"], other["y1"]) - min(box["y0"], other["y0"]), 1e-6)
    # of rows at one place no more are needed than are asked for
    right = checkpointed(_least(right, ["x", "y"], ["id"], 3).drop("place"))
    size, rest, out = max(((box["x1"] - box["x0"]) * (box["y1"] - box["y0"]) / box["n"]) ** 0.5, span * 1e-6), left, None
    while True:
        near = cells.pairs_within(rest, right, float(size))
        two = _least((near.where("l_id <> r_id") if same else near).select("l_id", "r_id", "distance"), ["l_id"], ["distance", "r_id"], 2)
        at = lambda k, c: F.max(F.when(F.col("place") == k, F.col(c)))
        found = two.groupBy(F.col("l_id").alias("id")).agg(at(1, "r_id").alias("nearest"), at(1, "distance").alias("d1"), at(2, "distance").alias("d2"))
        if size >= 1.5 * span:
            last = rest.select("id").join(found, "id", "left")
            return last if out is None else out.unionByName(last)
        done = checkpointed(found.where("d2 IS NOT NULL"))
        out = done if out is None else out.unionByName(done)
        rest = checkpointed(rest.join(done, "id", "left_anti"))
        if rest.isEmpty():
            return out
        size *= widen


def nearest_across(left: DataFrame, right: DataFrame) -> DataFrame:
    """``nearest_two`` with ``mutual``: whether the row is also the nearest of its nearest."""
    two = checkpointed(nearest_two(left, right))
    asked = right.join(two.select(F.col("nearest").alias("id")).distinct(), "id", "left_semi")
    back = nearest_two(asked, left).select(F.col("id").alias("nearest"), F.col("nearest").alias("back"))
    return two.join(back, "nearest", "left").select("id", "nearest", "d1", "d2", F.coalesce(F.col("back") == F.col("id"), F.lit(False)).alias("mutual"))


def spacing(df: DataFrame, at: Sequence[float]) -> DataFrame:
    """One row: exact percentiles of the distance to the nearest other row of the table, ``p10`` and so on."""
    near = nearest_two(df, df, same=True)
    return near.agg(*[F.percentile("d1", F.lit(p)).alias(f"p{round(100 * p)}") for p in at])


def grid_flags(rows: DataFrame, anchors: DataFrame, sizes: Sequence[float]) -> DataFrame:
    """``id`` and ``size`` of the rows that share a cell of one of the four staggered grids with an anchor, for each size."""

    def placed(df: DataFrame, *more: str) -> DataFrame:
        x, y = F.col("x"), F.col("y")
        each = [F.struct(F.lit(float(s)).alias("size"), F.lit(k).alias("grid"), F.floor(x / s + dx).alias("cx"), F.floor(y / s + dy).alias("cy")) for s in sizes for k, (dx, dy) in enumerate(cells.STAGGERED)]
        return df.where(x.isNotNull() & y.isNotNull()).select(*more, F.inline(F.array(*each)))

    held = placed(anchors).distinct()
    return placed(rows, "id").join(held, ["size", "grid", "cx", "cy"], "left_semi").select("id", "size").distinct()


def grid_calibration(rows: DataFrame, anchors: DataFrame, sizes: Sequence[float]) -> DataFrame:
    """What each cell size flags of ``rows`` (``id``, ``x``, ``y``) beside ``anchors``: rows ``flagged``, true duplicates among them (mutual nearest)
    and false ones, the recall of all true ones, rows ``missed`` within half a cell, rows flagged ``beyond`` the diagonal, and what the
    step from the next smaller size adds: ``more_true``, ``more_false`` and their ratio ``marginal`` (null where no false one is added)."""
    pairs = nearest_across(rows, anchors)
    each = pairs.withColumn("size", F.explode(F.array(*[F.lit(float(s)) for s in sizes])))
    flagged = grid_flags(rows, anchors, sizes).withColumn("flag", F.lit(True))
    told = each.join(flagged, ["id", "size"], "left").withColumn("flag", F.coalesce("flag", F.lit(False)))
    n = told.groupBy("size").agg(
        F.count("*").alias("points"), F.count_if("flag").alias("flagged"), F.count_if(F.col("flag") & F.col("mutual")).alias("true_duplicates"), F.count_if("mutual").alias("all_true"),
        F.count_if((F.col("d1") <= F.col("size") / 2) & ~F.col("flag")).alias("missed"), F.count_if((F.col("d1") > F.col("size") * F.sqrt(F.lit(2.0))) & F.col("flag")).alias("beyond"),
    )
    n = n.withColumn("false_duplicates", F.col("flagged") - F.col("true_duplicates"))
    steps = Window.orderBy("size")  # a row a size
    gained = lambda c: F.col(c) - F.lag(c).over(steps)
    n = n.withColumn("more_true", gained("true_duplicates")).withColumn("more_false", gained("false_duplicates"))
    recall = F.col("true_duplicates") / F.greatest("all_true", F.lit(1))
    return n.select("size", "points", "flagged", "true_duplicates", "false_duplicates", recall.alias("recall"), "missed", "beyond", "more_true", "more_false", F.when(F.col("more_false") != 0, F.col("more_true") / F.col("more_false")).alias("marginal"))
