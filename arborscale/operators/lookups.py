"""Joins and lookups: dimensions, cells, radius, boxes, names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborscale.functions import nearby
from arborscale.operators import cells


def best_link(register: DataFrame, trees: DataFrame, reach: float, tolerance: float, reviewed: DataFrame | None = None) -> DataFrame:
    """One-to-one links of register rows (``id``, ``x``, ``y``, ``genus``, ``dbh``) to trees of the same genus within
    ``reach`` whose diameter differs by ``tolerance`` at most: the nearest tree for each row, then for a contested tree
    the closest row. Reviewed links (``id``, ``tree_id``) stand before all others, without a distance."""
    if reviewed is not None:
        register = register.join(reviewed.select("id"), "id", "left_anti")
        trees = trees.join(reviewed.select(F.col("tree_id").alias("id")), "id", "left_anti")
    near = cells.pairs_within(register, trees, reach, keys=("genus",)).where(F.abs(F.col("l_dbh") - F.col("r_dbh")) <= tolerance)
    first = near.groupBy("l_id").agg(F.min(F.struct("distance", "r_id")).alias("m")).select(F.col("l_id").alias("id"), F.col("m.r_id").alias("tree_id"), F.col("m.distance").alias("distance"))
    links = first.groupBy("tree_id").agg(F.min(F.struct("distance", "id")).alias("m")).select("m.id", "tree_id", "m.distance")
    return links if reviewed is None else links.unionByName(reviewed.select("id", "tree_id", F.lit(None).cast("double").alias("distance")))


def two_nearest(df: DataFrame, reach: float) -> DataFrame:
    """For rows (``id``, ``x``, ``y``) with a neighbour within ``reach``: the nearest, its distance, the distance of the
    second, and whether the nearest is mutual."""
    # two rows of each come from the search of its tile, however crowded its surroundings are
    near = nearby.nearest_pairs(df, df, reach, 2, distinct=True)
    two = near.withColumn("place", F.row_number().over(Window.partitionBy("l_id").orderBy("distance", "r_id"))).where("place <= 2")
    at = lambda k, c: F.max(F.when(F.col("place") == k, F.col(c)))
    one = two.groupBy(F.col("l_id").alias("id")).agg(at(1, "r_id").alias("nearest"), at(1, "distance").alias("d1"), at(2, "distance").alias("d2"))
    back = one.select(F.col("id").alias("nearest"), F.col("nearest").alias("back_"))
    return one.join(back, "nearest", "left").select("id", "nearest", "d1", "d2", F.coalesce(F.col("back_") == F.col("id"), F.lit(False)).alias("mutual"))


def distance_bands(two: DataFrame, edges: Sequence[float]) -> DataFrame:
    """``two_nearest`` by bands of ``d1`` (above ``low``, up to ``high``): rows, rows whose nearest is mutual, and the median
    of ``d1 / d2`` where there is a second. Distances outside the edges are in no band."""
    bands = list(zip(edges, edges[1:], strict=False))
    band = F.coalesce(*[F.when((F.col("d1") > low) & (F.col("d1") <= high), F.struct(F.lit(float(low)).alias("low"), F.lit(float(high)).alias("high"))) for low, high in bands])
    banded = two.withColumn("band", band).where("band is not null").groupBy("band")
    return banded.agg(F.count("*").alias("rows"), F.count_if("mutual").alias("mutual"), F.median(F.when(F.col("d2").isNotNull(), F.col("d1") / F.greatest("d2", F.lit(1e-9)))).alias("median_ratio")).select("band.*", "rows", "mutual", "median_ratio")


def deletions(name: Column, most: int = 2) -> Column:
    """The name with up to two letters deleted: two names within two edits share one of these."""
    once = lambda c: F.transform(F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1))), lambda i: F.concat(F.substring(c, F.lit(1), i - 1), F.substring(c, i + 1, F.length(c))))
    keys = F.array(name)
    out = keys
    for _ in range(most):
        keys = F.array_distinct(F.flatten(F.transform(keys, once)))
        out = F.array_union(out, keys)
    return out


def similar_names(names: DataFrame, column: str = "name", least: int = 8, edits: int = 2) -> DataFrame:
    """Pairs of different names within some edits, by an equi-join on deletion keys and then the true distance."""
    keyed = names.select(column).distinct().where(F.length(column) >= least).select(F.col(column).alias("n"), F.explode(deletions(F.col(column), edits)).alias("k"))
    pairs = keyed.select(F.col("n").alias("a"), "k").join(keyed.select(F.col("n").alias("b"), "k"), "k").where("a < b").select("a", "b").distinct()
    return pairs.withColumn("edits", F.levenshtein("a", "b")).where(F.col("edits") <= edits)


def resolve_names(names: DataFrame, records: DataFrame) -> DataFrame:
    """Names against a checklist (``id``, ``taxon``, ``status``, ``accepted_id``): accepted, synonym, unplaced, ambiguous
    or not_found, with the accepted name. Misapplied records are passed over; more than one distinct reading is
    ambiguous."""
    used = records.where("status <> 'misapplied'")
    of = used.select(F.col("id").alias("accepted_id"), F.col("taxon").alias("accepted_name"))
    reading = used.join(of, "accepted_id", "left").select(F.col("taxon").alias("name"), F.when(F.col("accepted_id").isNull(), "unplaced").when(F.col("accepted_id") == F.col("id"), "accepted").otherwise("synonym").alias("verdict"), "accepted_name")
    by_name = reading.groupBy("name").agg(F.count_distinct(F.struct("verdict", "accepted_name")).alias("n"), F.min("verdict").alias("verdict"), F.min("accepted_name").alias("accepted_name"))
    found = names.select("name").distinct().join(by_name, "name", "left")
    verdict = F.when(F.col("n").isNull(), "not_found").when(F.col("n") > 1, "ambiguous").otherwise(F.col("verdict"))
    return found.select("name", verdict.alias("verdict"), F.when(F.col("n") == 1, F.col("accepted_name")).alias("accepted_name"))


def pair_verdicts(pairs: DataFrame, resolved: DataFrame) -> DataFrame:
    """What a pair of like names (``a``, ``b``) is: SYNONYM, REFUSED, UNRESOLVED, HYBRID_MARK or MISSPELLING."""
    side = lambda k: resolved.select(F.col("name").alias(k), F.col("verdict").alias(f"v{k}"), F.col("accepted_name").alias(f"t{k}"))
    p = pairs.join(side("a"), "a").join(side("b"), "b")
    firm = (F.col("va") != "ambiguous") & (F.col("vb") != "ambiguous")
    real = lambda k: F.col(f"v{k}").isin("accepted", "synonym")
    wrong = F.when(F.col("va") == "not_found", F.col("a")).otherwise(F.col("b"))
    target = F.when(F.col("va") == "not_found", F.col("tb")).otherwise(F.col("ta"))
    p = p.withColumn("wrong", wrong).withColumn("target", target)
    targets = p.where((F.col("va") == "not_found") != (F.col("vb") == "not_found")).groupBy("wrong").agg(F.count_distinct("target").alias("targets"))
    p = p.join(targets, "wrong", "left")
    words = F.zip_with(F.split("a", " "), F.split("b", " "), lambda x, y: F.coalesce((F.levenshtein(x, y) >= 2) & (F.least(F.length(x), F.length(y)) <= 5), F.lit(False)))
    hybrid = F.regexp_replace("a", " x ", " ") == F.regexp_replace("b", " x ", " ")
    one_real = ((F.col("va") == "not_found") & real("b")) | ((F.col("vb") == "not_found") & real("a"))
    verdict = (
        F.when(firm & ((F.col("ta") == F.col("b")) | (F.col("tb") == F.col("a"))), "SYNONYM")
        .when((real("a") & real("b")) | (F.col("targets") > 1) | F.exists(words, lambda w: w), "REFUSED")
        .when(~one_real | F.col("target").isNull(), "UNRESOLVED").when(hybrid, "HYBRID_MARK").otherwise("MISSPELLING")
    )
    return p.select("a", "b", verdict.alias("verdict"))


def token_scores(texts: DataFrame, references: DataFrame, least: int, top: int) -> DataFrame:
    """Texts (``id``, ``tokens``) against references (``ref_id``, ``ref_tokens``): shared tokens by an equi-join on the
    token, the best ``top`` of those with ``least`` or more."""
    t = texts.select("id", F.explode(F.array_distinct("tokens")).alias("token"))
    r = references.select("ref_id", F.explode(F.array_distinct("ref_tokens")).alias("token"))
    score = t.join(r, "token").groupBy("id", "ref_id").agg(F.count("*").alias("score")).where(F.col("score") >= least)
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "ref_id"))
    return score.withColumn("rank_", rank).where(F.col("rank_") <= top).drop("rank_")


def with_aliases(rows: DataFrame, key: str, aliases: str) -> DataFrame:
    """A copy of each row under every alias; keys that exist already win, and of equal aliases the row of the least
    key."""
    copies = rows.select("*", F.explode(aliases).alias("alias_"))
    first = copies.groupBy("alias_").agg(F.min(key).alias(key))
    fresh = copies.join(first, ["alias_", key]).join(rows.select(F.col(key).alias("alias_")), "alias_", "left_anti").drop_duplicates(["alias_"])
    return rows.unionByName(fresh.withColumn(key, F.col("alias_")).drop("alias_"))


def consolidated(rows: DataFrame, key: str, folds: DataFrame) -> DataFrame:
    """``rows`` with those keyed by a synonym brought to the accepted name of ``folds`` (``synonym``, ``accepted``, ``place``):
    dropped where the accepted name has a row, or else re-keyed, the one of the least place for each accepted name.
    A null key is no synonym."""
    renamed = rows.join(folds.withColumnRenamed("synonym", key), key)
    best = renamed.groupBy("accepted").agg(F.min(F.struct("place", key)).alias("m")).select("accepted", F.col(f"m.{key}").alias(key))
    new = best.join(rows.select(F.col(key).alias("accepted")), "accepted", "left_anti")
    others = rows.join(folds.select(F.col("synonym").alias(key)), key, "left_anti")
    return others.unionByName(rows.join(new, key).withColumn(key, F.col("accepted")).drop("accepted"))


def rebased(base: DataFrame, checkpoint: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """The newer base with its empty fields filled from a checkpoint, and the number of fields gained."""
    old = checkpoint.select(key, *[F.col(c).alias(f"old_{c}") for c in fields])
    out = base.join(old, key, "left")
    gained = sum((F.when(F.col(c).isNull() & F.col(f"old_{c}").isNotNull(), 1).otherwise(0) for c in fields), F.lit(0))
    return out.withColumn("gained", gained).withColumns({c: F.coalesce(c, f"old_{c}") for c in fields}).drop(*[f"old_{c}" for c in fields])


def differences(old: DataFrame, new: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Missing, added and changed values between two versions: ``key``, ``field``, ``before``, ``after``."""
    side = lambda df, p: df.select(F.col(key).alias(f"{p}key"), *[F.col(c).cast("string").alias(f"{p}{c}") for c in fields])
    both = side(old, "o_").join(side(new, "n_"), F.col("o_key") == F.col("n_key"), "full")
    row = F.when(F.col("n_key").isNull(), "(missing)").when(F.col("o_key").isNull(), "(added)")
    kinds = F.array(F.struct(row.alias("field"), F.lit(None).cast("string").alias("before"), F.lit(None).cast("string").alias("after")), *[F.struct(F.when(row.isNull() & ~F.col(f"o_{c}").eqNullSafe(F.col(f"n_{c}")), c).alias("field"), F.col(f"o_{c}").alias("before"), F.col(f"n_{c}").alias("after")) for c in fields])
    return both.select(F.coalesce("o_key", "n_key").alias(key), F.inline(kinds)).where("field is not null")


def upsert(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    return table.join(changes, key, "left_anti").unionByName(changes)


def upsert_report(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """One row of what an upsert does: rows ``before``, ``replaced`` and ``inserted``, rows ``after``, and ``ok`` if these
    are as many as before and inserted."""
    new = changes.select(key, F.lit(1).alias("c_"))
    both = table.select(key, F.lit(1).alias("t_")).join(new, key, "full")
    n = both.agg(F.count("t_").alias("before"), F.count(F.col("t_") + F.col("c_")).alias("replaced"), F.count_if(F.col("t_").isNull()).alias("inserted"))
    after = upsert(table, changes, key).agg(F.count("*").alias("after"))
    return n.crossJoin(F.broadcast(after)).withColumn("ok", F.col("after") == F.col("before") + F.col("inserted"))


def box_overlap(blocks: DataFrame, area: tuple[float, float, float, float]) -> DataFrame:
    """Share of each box (``x0``, ``y0``, ``x1``, ``y1``) inside an area box, with its weighted count and the margin of
    error in quadrature."""
    x0, y0, x1, y1 = area
    wide = F.greatest(F.least("x1", F.lit(x1)) - F.greatest("x0", F.lit(x0)), F.lit(0.0))
    high = F.greatest(F.least("y1", F.lit(y1)) - F.greatest("y0", F.lit(y0)), F.lit(0.0))
    share = wide * high / ((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")))
    return blocks.withColumn("share", share).agg(F.sum(F.col("share") * F.col("count")).alias("count"), F.sqrt(F.sum((F.col("share") * F.col("moe")) ** 2)).alias("moe"))


def dilated(tiles: DataFrame, rings: int) -> DataFrame:
    """Tiles (``x``, ``y``) with their neighbours within some rings."""
    return cells.neighbours(tiles, "x", "y", rings).select(F.col("nx").alias("x"), F.col("ny").alias("y")).distinct()


def nearest_n(left: DataFrame, right: DataFrame, reach: float, n: int) -> DataFrame:
    """The ``n`` nearest right rows of each left row within ``reach``."""
    near = nearby.nearest_pairs(left, right, reach, n)
    rank = F.row_number().over(Window.partitionBy("l_id").orderBy("distance", "r_id"))
    return near.withColumn("place", rank).where(F.col("place") <= n).select(F.col("l_id").alias("id"), F.col("r_id").alias("other"), "place")


def owning_region(points: DataFrame, boxes: Sequence[tuple[int, str, float, float, float, float]]) -> DataFrame:
    """The region of each point (``id``, ``x``, ``y``): of the boxes (level, code, x0, x1, y0, y1) that hold it the one
    of the least level and code. The boxes are a fixed list, so they are one expression."""
    fits = [F.when((F.col("x") >= x0) & (F.col("x") < x1) & (F.col("y") >= y0) & (F.col("y") < y1), F.lit(code)) for _, code, x0, x1, y0, y1 in sorted(boxes)]
    return points.select("id", F.coalesce(*fits).alias("region"))


def nearest_centre(points: DataFrame, centres: Sequence[tuple[str, float, float]], cap: float) -> DataFrame:
    """The closest of a fixed list of centres (name, x, y), null past the cap."""
    away = F.array(*[F.struct(F.sqrt((F.col("x") - x) ** 2 + (F.col("y") - y) ** 2).alias("d"), F.lit(name).alias("name")) for name, x, y in centres])
    best = F.array_min(away)
    return points.select("id", F.when(best["d"] <= cap, best["name"]).alias("centre"))
