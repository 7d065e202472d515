"""Row dedup, entity resolution on staggered grids, and the precedence merge."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborscale.functions import nearby, ordered
from arborscale.functions.groups import join_back
from arborscale.functions.lineage import checkpointed
from arborscale.operators import cells
from arborscale.operators.clean import source_kind


def coordinate_id(prefix: Column, lat: Column, lon: Column) -> Column:
    return F.concat(prefix, F.lit("-"), F.format_string("%.7f_%.7f", lon, lat))


def _counted(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Row counts of the keys joined back."""
    return join_back(df, df.groupBy(*keys).agg(F.count("*").alias(name)), keys)


def disambiguated(df: DataFrame, key: str, second: str) -> DataFrame:
    """Ids that repeat get a second key appended on each of their rows; rows without an id stay as they are."""
    return _counted(df, [key], "n_").withColumn(key, F.when((F.col("n_") > 1) & F.col(key).isNotNull(), F.concat_ws("-", key, second)).otherwise(F.col(key))).drop("n_")


def drop_stacked(df: DataFrame, key: str, agree: Sequence[str], order: str) -> DataFrame:
    """Rows whose id repeats go, unless all rows of the id agree on the columns; then the first stays. Rows without an id are no
    stack and stay."""
    kinds = df.groupBy(key).agg(F.min(F.struct(*agree)).alias("lo"), F.max(F.struct(*agree)).alias("hi"), F.min(order).alias("first_")).where(F.col("lo") == F.col("hi"))
    single = df.where(F.col(key).isNotNull()).join(kinds.select(key, "first_"), key).where(F.col(order) == F.col("first_")).drop("first_")
    return single.unionByName(df.where(F.col(key).isNull()))


def most_complete(df: DataFrame, key: str, fields: Sequence[str], order: str) -> DataFrame:
    """For each id the row with the most fields filled, the first of equal ones; rows without an id go."""
    filled = sum((F.coalesce(F.nullif(F.trim(F.col(c).cast("string")), F.lit("")).isNotNull().cast("int"), F.lit(0)) for c in fields), F.lit(0))
    best = df.where(F.col(key).isNotNull()).withColumn("score_", filled)
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score_"), order))
    return best.withColumn("rank_", rank).where("rank_ = 1").drop("rank_", "score_")


def first_of(df: DataFrame, keys: Sequence[str], order: Sequence[str], keep_null: Sequence[str] = ()) -> DataFrame:
    """The first row of each key by the order; rows with a null in ``keep_null`` all stay."""
    ranked = df.withColumn("rank_", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    kept = F.col("rank_") == 1
    for c in keep_null:
        kept = kept | F.col(c).isNull()
    return ranked.where(kept).drop("rank_")


def sized(obs: DataFrame, sizes: DataFrame) -> DataFrame:
    """Rows with the cell size of their city (``city``, ``lat_deg``, ``lon_deg``) as ``lat_deg_`` and ``lon_deg_``, null where it has none."""
    named = sizes.select(F.col("city").alias("of_city_"), F.col("lat_deg").alias("lat_deg_"), F.col("lon_deg").alias("lon_deg_"))
    return obs.join(named, F.col("city") == F.col("of_city_"), "left").drop("of_city_")


def _measured(obs: DataFrame, size: tuple[float, float] | DataFrame) -> DataFrame:
    return sized(obs, size) if isinstance(size, DataFrame) else obs.withColumn("lat_deg_", F.lit(size[0])).withColumn("lon_deg_", F.lit(size[1]))


def _stacked(rows: DataFrame, *columns: str) -> DataFrame:
    """A row for each of the four cells of a row; rows without a position or a cell size have none."""
    return cells.staggered(rows, F.col("lat_deg_"), F.col("lon_deg_")).where("cell IS NOT NULL").select(*columns, "city", "grid", "cell")


def _least_of_cells(stacked: DataFrame, key: str) -> DataFrame:
    """The least key of each kind in each cell. Detections and notable entries anchor nothing but join what is there."""
    least = lambda cond: F.min(F.when(cond, F.col(key)))
    kind = F.col("kind")
    return stacked.groupBy("city", "grid", "cell").agg(least(kind == "municipal").alias("municipal"), least(kind == "community").alias("person"), least(~kind.isin("osm", "predicted", "notable")).alias("any"), least(kind == "osm").alias("osm"))


#: Cells along a side of a block that is looked at as one.
BLOCK = 16


def anchors(obs: DataFrame, size: tuple[float, float] | DataFrame) -> DataFrame:
    """For each row and grid the least id of municipal, person, OSM and all rows of its cell; ``size`` is one cell size in degrees or a
    table of them by city. Rows go to a block of cells, and those at its edge to the blocks beside it, so that what a row finds in its
    four cells is told in one place and never joined back."""
    measured = _measured(obs, size).withColumn("kind", source_kind(F.col("data_source")))
    lat, lon, lat_deg, lon_deg = (F.col(c) for c in ("latitude", "longitude", "lat_deg_", "lon_deg_"))
    four = [cells.packed(lat, lon, lat_deg, lon_deg, dx, dy).alias(f"cell{g}_") for g, (dx, dy) in enumerate(cells.STAGGERED)]
    slim = measured.select("tree_id", "city", "kind", F.floor(lon / lon_deg).alias("cx_"), F.floor(lat / lat_deg).alias("cy_"), *four)
    block = lambda c, by=0: F.floor((F.col(c) + by) / BLOCK)
    around = F.array_distinct(F.array(*[F.struct(block("cx_", i).alias("bx_"), block("cy_", j).alias("by_")) for i in (-1, 1) for j in (-1, 1)]))
    known = F.col("city").isNotNull() & F.col("tree_id").isNotNull() & F.col("cell0_").isNotNull()
    spread = slim.where(known).select("*", F.inline(around)).withColumn("home_", (F.col("bx_") == block("cx_")) & (F.col("by_") == block("cy_")))
    k = F.col("kind")
    kinds = {"municipal": k == "municipal", "person": k == "community", "any": ~k.isin("osm", "predicted", "notable"), "osm": k == "osm"}
    return nearby.cell_anchors(spread, ["city", "bx_", "by_"], [f"cell{g}_" for g in range(4)], {c: F.coalesce(v, F.lit(False)) for c, v in kinds.items()})


#: Bits of a key; the choice of a cell stands above them.
_KEY_BITS = 48


def with_clusters(obs: DataFrame, size: tuple[float, float] | DataFrame, link: Column | None = None) -> DataFrame:
    """Rows with ``cluster_id``: a notable row's link, else itself if municipal, else a municipal tree of one of its cells, else itself if
    a person put it in, else such a row near by, else itself unless OSM, predicted or notable, else any such row near by, else for
    predictions an OSM row, else itself.

    Ids become longs in their order, once; so anchors are least longs, which combine in hash tables, and what a row finds in its
    cells is the least of (tier, grid, anchor) in one long. Only rows that aren't decided by themselves look into cells."""
    rows = ordered.positions(_measured(obs, size).withColumn("kind_", source_kind(F.col("data_source"))), "key_", "tree_id", "data_source")
    rows = checkpointed(rows.withColumn("link_", F.when(F.col("kind_") == "notable", link) if link is not None else F.lit(None).cast("string")))
    slim = rows.select("key_", F.col("kind_").alias("kind"), "city", "latitude", "longitude", "lat_deg_", "lon_deg_")
    held = _least_of_cells(_stacked(slim.where("kind NOT IN ('predicted', 'notable')"), "key_", "kind"), "key_")
    asking = _stacked(slim.where("kind NOT IN ('municipal')"), "key_", "kind")
    kind, grid = F.col("kind"), F.col("grid").cast("long")
    choice = lambda tier, c: F.when(F.col(c).isNotNull(), F.shiftleft(grid + 10 * tier, _KEY_BITS) + F.col(c))
    own = lambda tier: F.shiftleft(F.lit(10 * tier - 1).cast("long"), _KEY_BITS) + F.col("key_")
    # itself stands before the tier of other rows that could only come after it
    itself = F.when(kind == "community", own(2)).when(~kind.isin("osm", "predicted", "notable"), own(3))
    best = F.least(choice(1, "municipal"), itself, choice(2, "person"), choice(3, "any"), F.when(kind == "predicted", choice(4, "osm")))
    told = asking.join(held, ["city", "grid", "cell"]).groupBy("key_").agg(F.min(best).alias("best_"))
    found = rows.join(told, "key_", "left").withColumn("cluster_key_", F.coalesce(F.col("best_").bitwiseAND(F.lit((1 << _KEY_BITS) - 1)), F.col("key_")))
    names = rows.select(F.col("key_").alias("cluster_key_"), F.col("tree_id").alias("cluster_id_"))
    cluster = F.coalesce("link_", F.when(F.col("kind_") == "municipal", F.col("tree_id")), "cluster_id_")
    return found.join(names, "cluster_key_").select(*obs.columns, cluster.alias("cluster_id"))


def assign_clusters(obs: DataFrame, size: tuple[float, float] | DataFrame, link: Column | None = None) -> DataFrame:
    """``tree_id`` and ``cluster_id`` of ``with_clusters``."""
    slim = obs.select("tree_id", "city", "latitude", "longitude", "data_source", *([link.alias("link_to_")] if link is not None else []))
    return with_clusters(slim, size, None if link is None else F.col("link_to_")).select("tree_id", "cluster_id")


RANKED = ("community", "municipal", "satellite", "osm")


def merge_values(rows: DataFrame, value: str) -> DataFrame:
    """Per cluster the greatest value of the first kind that has one: community, municipal, satellite, OSM; predicted
    and notable rows count only in clusters without those."""
    kind = source_kind(F.col("data_source"))
    by = [F.max(F.when(kind == k, F.col(value))) for k in RANKED]
    alone = F.when(F.max(kind.isin(*RANKED).cast("int")) == 0, F.max(F.when(kind.isin("predicted", "notable"), F.col(value))))
    return rows.groupBy("cluster_id").agg(F.coalesce(*by, alone).alias(value))


def merge_names(rows: DataFrame, species: str) -> DataFrame:
    """Per cluster the species that says most: two words before one, then by kind, then by name; predictions count only
    alone."""
    kind = source_kind(F.col("data_source"))
    rank = F.when(kind == "community", 4).when(kind == "municipal", 3).when(kind == "satellite", 2).when(kind == "osm", 1).otherwise(0)
    key = F.struct((F.size(F.split(F.col(species), " ")) > 1).cast("int").alias("words"), rank.alias("rank"), F.col(species).alias("name"))
    firm = F.max(F.when((rank > 0) & F.col(species).isNotNull(), key))
    return rows.groupBy("cluster_id").agg(F.coalesce(firm, F.max(F.when(F.col(species).isNotNull(), key)))["name"].alias(species))


def merged_lists(rows: DataFrame) -> DataFrame:
    """Per cluster the sorted sources, and the sorted ids that it absorbed (null if none)."""
    others = F.collect_set(F.when(F.col("tree_id") != F.col("cluster_id"), F.col("tree_id")))
    return rows.groupBy("cluster_id").agg(F.array_join(F.array_sort(F.collect_set("data_source")), ",").alias("merged_sources"), F.nullif(F.array_join(F.array_sort(others), ","), F.lit("")).alias("merged_tree_ids"))


def corrected(trees: DataFrame, reports: DataFrame) -> DataFrame:
    """Approved reports over merged values: a report's value wins, ``dbh_unknown`` clears the diameter, an empty text
    clears the name."""
    r = reports.select("tree_id", F.col("dbh").alias("r_dbh"), F.col("dbh_unknown"), F.col("tree_name").alias("r_name"))
    out = trees.join(r, "tree_id", "left")
    dbh = F.when(F.coalesce(F.col("dbh_unknown"), F.lit(False)), F.lit(None).cast("double")).otherwise(F.coalesce("r_dbh", "dbh"))
    return out.withColumn("dbh", dbh).withColumn("tree_name", F.nullif(F.coalesce("r_name", "tree_name"), F.lit(""))).drop("r_dbh", "dbh_unknown", "r_name")


def impute_mean(df: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    """Missing values as the mean of their group."""
    mean = df.groupBy(*keys).agg(F.avg(value).alias("mean_"))
    return join_back(df, mean, keys).withColumn(value, F.coalesce(value, "mean_")).drop("mean_")


def border_duplicates(df: DataFrame, lat_deg: float, lon_deg: float, rank: Column) -> DataFrame:
    """``tree_id`` and ``is_duplicate``: a row of the same genus with a lower source rank lies in one of its four
    cells. Rows without a genus never match."""
    stacked = cells.staggered(df.select("tree_id", "genus", "latitude", "longitude", rank.alias("rank")).where("genus is not null"), lat_deg, lon_deg)
    least = stacked.groupBy("genus", "grid", "cell").agg(F.min("rank").alias("least"))
    found = stacked.join(least, ["genus", "grid", "cell"]).groupBy("tree_id").agg(F.max((F.col("rank") > F.col("least")).cast("int")).alias("d"))
    return df.select("tree_id").join(found, "tree_id", "left").select("tree_id", (F.coalesce("d", F.lit(0)) == 1).alias("is_duplicate"))


def greedy_suppress(rows: DataFrame, conflicts: DataFrame, stop: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Greedy suppression in order: a row goes if a kept row before it conflicts with it.

    ``rows`` has ``id``; ``conflicts`` the pairs ``first``, ``second`` with the first ahead in
    order. Rounds of joins instead of one sequential task: a row with no undecided row ahead of it is kept, and what it
    conflicts with is dropped; each round decides the head of every chain. ``stop`` cuts lineage (a checkpoint)."""
    state = stop(rows.select("id", F.lit(None).cast("boolean").alias("kept")))
    while True:
        ahead = conflicts.join(state.select(F.col("id").alias("first"), F.col("kept").alias("k")), "first").groupBy(F.col("second").alias("id")).agg(
            F.coalesce(F.bool_or("k"), F.lit(False)).alias("hit"), F.bool_or(F.col("k").isNull()).alias("open"))
        decided = F.when(F.col("kept").isNotNull(), F.col("kept")).when(F.coalesce("hit", F.lit(False)), False).when(~F.coalesce("open", F.lit(False)), True)
        state = stop(state.join(ahead, "id", "left").select("id", decided.alias("kept")))
        if state.where("kept is null").isEmpty():
            return rows.join(state, "id")


def seam_conflicts(rows: DataFrame, radius: float) -> DataFrame:
    """Pairs of different tiles within a radius, the higher score first, ties by id."""
    near = cells.pairs_within(rows, rows, radius).where("l_tile <> r_tile")
    first = (F.col("l_score") > F.col("r_score")) | ((F.col("l_score") == F.col("r_score")) & (F.col("l_id") < F.col("r_id")))
    return near.where(first).select(F.col("l_id").alias("first"), F.col("r_id").alias("second"))


def absorbed(predictions: DataFrame, published: DataFrame, lat_deg: float, lon_deg: float) -> DataFrame:
    """``tree_id`` and whether a published tree shares one of the four cells."""
    p = cells.staggered(predictions.select("tree_id", "latitude", "longitude"), lat_deg, lon_deg)
    q = cells.staggered(published.select("latitude", "longitude"), lat_deg, lon_deg).select("grid", "cell").distinct()
    hit = p.join(q, ["grid", "cell"], "left_semi").select("tree_id").distinct().withColumn("absorbed", F.lit(True))
    return predictions.select("tree_id").join(hit, "tree_id", "left").select("tree_id", F.coalesce("absorbed", F.lit(False)).alias("absorbed"))


def patch_replace(old: DataFrame, new: DataFrame, covered: DataFrame, radius: float, stop: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Old rows (``id``, ``score``, ``x``, ``y``, ``tile``, ``tx``, ``ty``) of covered tiles (``tx``, ``ty``) give way to the
    new rows there. The old rows of the ring of tiles around the patch are deduplicated with the new rows, the higher score
    stays; all others stay as they are."""
    at = ["tx", "ty"]
    wide = cells.neighbours(covered.select(*at), *at, 1).select(F.col("nx").alias("tx"), F.col("ny").alias("ty")).distinct()
    outside = old.join(covered, at, "left_anti")
    edge, rest = outside.join(wide, at, "left_semi"), outside.join(wide, at, "left_anti")
    fresh = new.join(covered, at, "left_semi")
    # rows of the base never contest each other
    contest = stop(fresh.unionByName(edge.withColumn("tile", F.lit("base"))))
    kept = greedy_suppress(contest, stop(seam_conflicts(contest, radius)), stop).where("kept").select("id")
    return rest.unionByName(edge.join(kept, "id", "left_semi")).unionByName(fresh.join(kept, "id", "left_semi"))


def content_id(*parts: Column | str) -> Column:
    """A digest of values, each behind its length, so that other values with the same signs have another; a null is told from
    any text."""
    text = [(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts]
    return F.sha1(F.concat_ws("|", *[F.coalesce(F.concat(F.length(t), F.lit("="), t), F.lit("null")) for t in text]))
