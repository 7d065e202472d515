"""Queries of the dedup, identity and cell operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborscale.functions.lineage import checkpointed
from arborscale.operators import cells, dedup
from arborscale.plans.registry import Views, query

LAT, LON = 1e-4, 1.3e-4
CELLS = [f"(floor(longitude / 1.3e-4 + {dx}) * 10000000 + floor(latitude / 1e-4 + {dy}))::BIGINT" for dx, dy in cells.STAGGERED]
KIND = "CASE line WHEN 1 THEN 'community' WHEN 2 THEN 'osm' WHEN 3 THEN 'satellite' WHEN 4 THEN 'predicted' WHEN 5 THEN 'notable' ELSE 'municipal' END"
OVER = {"municipal": "kind = 'municipal'", "person": "kind = 'community'", "anyone": "kind NOT IN ('osm', 'predicted', 'notable')", "osm": "kind = 'osm'"}
ANCHORED = f"""{{OBS}}, kinds AS (SELECT *, {KIND} AS kind, {', '.join(f'{c} AS cell{i}' for i, c in enumerate(CELLS))} FROM obs),
anchored AS (SELECT *, {', '.join(f"min(CASE WHEN {cond} THEN tree_id END) OVER (PARTITION BY city, cell{g}) AS {c}_{g}" for c, cond in OVER.items() for g in range(4))} FROM kinds)"""
FOUR = {c: ", ".join(f"{c}_{g}" for g in range(4)) for c in OVER}
CLUSTERED = f"""{ANCHORED}, clustered AS (SELECT *, coalesce(CASE WHEN kind = 'municipal' THEN tree_id END, {FOUR['municipal']}, CASE WHEN kind = 'community' THEN tree_id END, {FOUR['person']},
CASE WHEN kind NOT IN ('osm', 'predicted', 'notable') THEN tree_id END, {FOUR['anyone']}, {', '.join(f"CASE WHEN kind = 'predicted' THEN osm_{g} END" for g in range(4))}, tree_id) AS cluster_id FROM anchored)"""


def clustered(v: Views) -> DataFrame:
    return dedup.with_clusters(v.obs, (LAT, LON))


@query("d0_coordinate_id", "WITH {OBS} SELECT tree_id, printf('%s-%.7f_%.7f', city, longitude, latitude) AS coordinate_id FROM obs")
def _(v: Views) -> DataFrame:
    return v.obs.select("tree_id", dedup.coordinate_id(F.col("city"), F.col("latitude"), F.col("longitude")).alias("coordinate_id"))


@query("d0b_disambiguate_ids", "SELECT CASE WHEN count(*) OVER (PARTITION BY l_orderkey, l_linenumber) > 1 THEN concat(l_orderkey, '-', l_linenumber, '-', l_partkey) ELSE concat(l_orderkey, '-', l_linenumber) END AS id FROM lineitem")
def _(v: Views) -> DataFrame:
    rows = v.table("lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), F.col("l_partkey").alias("part"))
    return dedup.disambiguated(rows, "id", "part").select("id")


@query("d1_drop_stacked", """WITH {OBS}, g AS (SELECT order_key, min(genus) AS lo, max(genus) AS hi, min(tree_id) AS keep FROM obs GROUP BY order_key) SELECT tree_id FROM g JOIN obs ON tree_id = keep WHERE lo = hi""")
def _(v: Views) -> DataFrame:
    return dedup.drop_stacked(v.obs, "order_key", ["genus"], "tree_id").select("tree_id")


@query("d2_most_complete", """WITH {OBS} SELECT tree_id FROM obs QUALIFY row_number() OVER (PARTITION BY order_key ORDER BY (dbh IS NOT NULL)::INT + (crown_width_m IS NOT NULL)::INT DESC, tree_id) = 1""")
def _(v: Views) -> DataFrame:
    return dedup.most_complete(v.obs, "order_key", ["dbh", "crown_width_m"], "tree_id").select("tree_id")


@query("d2b_exact_repeats", "WITH {OBS} SELECT tree_id FROM obs QUALIFY row_number() OVER (PARTITION BY order_key, species, dbh ORDER BY tree_id) = 1 OR crown_width_m IS NULL")
def _(v: Views) -> DataFrame:
    return dedup.first_of(v.obs, ["order_key", "species", "dbh"], ["tree_id"], keep_null=["crown_width_m"]).select("tree_id")


@query("d2c_world_ids", "WITH {OBS} SELECT order_key, min(city) AS city FROM obs GROUP BY order_key")
def _(v: Views) -> DataFrame:
    return dedup.first_of(v.obs, ["order_key"], ["city", "latitude", "longitude", "tree_id"]).select("order_key", "city")


@query("d3_staggered_cells", f"WITH {{OBS}} SELECT tree_id, g::INT AS grid, CASE g WHEN 0 THEN {CELLS[0]} WHEN 1 THEN {CELLS[1]} WHEN 2 THEN {CELLS[2]} ELSE {CELLS[3]} END AS cell FROM obs, range(4) t(g)")
def _(v: Views) -> DataFrame:
    return cells.staggered(v.obs, LAT, LON).select("tree_id", "grid", "cell")


@query("d4_conditional_anchors", f"WITH {ANCHORED} SELECT tree_id, {', '.join(f'{c}_{g}' for c in ('municipal', 'person', 'osm') for g in range(4))} FROM anchored")
def _(v: Views) -> DataFrame:
    return dedup.anchors(v.obs, (LAT, LON)).select("tree_id", *[f"{c}_{g}" for c in ("municipal", "person", "osm") for g in range(4)])


@query("d5_cluster_assignment", f"WITH {CLUSTERED} SELECT tree_id, cluster_id FROM clustered")
def _(v: Views) -> DataFrame:
    return dedup.assign_clusters(v.obs, (LAT, LON))


def city_sizes(v: Views) -> DataFrame:
    """Cell sizes by city: two of them, and none for one city."""
    k = F.col("n_nationkey")
    even = k % 2 == 0
    return v.table("nation").where(k != 7).select(F.concat(F.lit("c"), k).alias("city"), F.when(even, LAT).otherwise(2 * LAT).alias("lat_deg"), F.when(even, LON).otherwise(2 * LON).alias("lon_deg"))


CITY_CELLS = [f"CASE WHEN city <> 'c7' THEN (floor(longitude / (CASE WHEN substr(city, 2)::INT % 2 = 0 THEN 1.3e-4 ELSE 2.6e-4 END) + {dx}) * 10000000 + floor(latitude / (CASE WHEN substr(city, 2)::INT % 2 = 0 THEN 1e-4 ELSE 2e-4 END) + {dy}))::BIGINT END" for dx, dy in cells.STAGGERED]
LINKED = CLUSTERED
for _one, _by_city in zip(CELLS, CITY_CELLS, strict=True):
    LINKED = LINKED.replace(_one, _by_city)
LINKED = LINKED.replace("PARTITION BY city, cell", "PARTITION BY city, CASE WHEN city = 'c7' THEN tree_id END, cell").replace("AS (SELECT *, coalesce(CASE WHEN kind = 'municipal'", "AS (SELECT *, coalesce(CASE WHEN kind = 'notable' AND order_key % 3 = 0 THEN concat('linked-', part_key) END, CASE WHEN kind = 'municipal'")


@query("d3_city_cells", f"WITH {{OBS}} SELECT tree_id, g::INT AS grid, CASE g WHEN 0 THEN {CITY_CELLS[0]} WHEN 1 THEN {CITY_CELLS[1]} WHEN 2 THEN {CITY_CELLS[2]} ELSE {CITY_CELLS[3]} END AS cell FROM obs, range(4) t(g)")
def _(v: Views) -> DataFrame:
    return cells.staggered(dedup.sized(v.obs, city_sizes(v)), F.col("lat_deg_"), F.col("lon_deg_")).select("tree_id", "grid", "cell")


@query("d5_linked_clusters", f"WITH {LINKED} SELECT tree_id, cluster_id FROM clustered")
def _(v: Views) -> DataFrame:
    """Cells sized by city, and notable rows with a reviewed link."""
    link = F.when(F.col("order_key") % 3 == 0, F.concat(F.lit("linked-"), F.col("part_key")))
    return dedup.assign_clusters(v.obs, city_sizes(v), link)


@query("d6_survivors", f"WITH {CLUSTERED} SELECT tree_id FROM clustered WHERE tree_id = cluster_id AND order_key % 50 <> 0")
def _(v: Views) -> DataFrame:
    missing = F.col("order_key") % 50 == 0
    return clustered(v).where((F.col("tree_id") == F.col("cluster_id")) & ~missing).select("tree_id")


@query("d7_precedence_merge", f"""WITH {CLUSTERED} SELECT cluster_id, coalesce(max(dbh) FILTER (WHERE kind = 'community'), max(dbh) FILTER (WHERE kind = 'municipal'), max(dbh) FILTER (WHERE kind = 'satellite'), max(dbh) FILTER (WHERE kind = 'osm'),
CASE WHEN count(*) FILTER (WHERE kind NOT IN ('predicted', 'notable')) = 0 THEN max(dbh) END) AS dbh FROM clustered GROUP BY cluster_id""")
def _(v: Views) -> DataFrame:
    return dedup.merge_values(clustered(v), "dbh")


@query("d8_specific_names", f"""WITH {CLUSTERED}, r AS (SELECT cluster_id, species AS s, 2 - (CASE WHEN part_key % 3 = 0 THEN 1 ELSE 0 END) AS words, CASE kind WHEN 'community' THEN 4 WHEN 'municipal' THEN 3 WHEN 'satellite' THEN 2 WHEN 'osm' THEN 1 ELSE 0 END AS rank,
CASE WHEN part_key % 3 = 0 THEN genus ELSE species END AS name FROM clustered)
SELECT cluster_id, substr(coalesce(max(concat(words, rank, '|', name)) FILTER (WHERE rank > 0), max(concat(words, rank, '|', name))), 4) AS name FROM r GROUP BY cluster_id""")
def _(v: Views) -> DataFrame:
    rows = clustered(v).withColumn("name", F.when(F.col("part_key") % 3 == 0, F.col("genus")).otherwise(F.col("species")))
    return dedup.merge_names(rows, "name")


@query("d9_merged_lists", f"""WITH {CLUSTERED} SELECT cluster_id, string_agg(DISTINCT data_source, ',' ORDER BY data_source) AS merged_sources, string_agg(DISTINCT tree_id, ',' ORDER BY tree_id) FILTER (WHERE tree_id <> cluster_id) AS merged_tree_ids FROM clustered GROUP BY cluster_id""")
def _(v: Views) -> DataFrame:
    return dedup.merged_lists(clustered(v))


@query("d10_corrections", "WITH {OBS} SELECT tree_id, CASE WHEN order_key % 7 = 0 THEN NULL WHEN order_key % 5 = 0 THEN 99.0 ELSE dbh END AS dbh, CASE WHEN order_key % 5 = 0 OR order_key % 7 = 0 THEN NULL ELSE cultivar END AS tree_name FROM obs")
def _(v: Views) -> DataFrame:
    k = F.col("order_key")
    reports = v.obs.where((k % 5 == 0) | (k % 7 == 0)).select("tree_id", F.when(k % 5 == 0, 99.0).alias("dbh"), (k % 7 == 0).alias("dbh_unknown"), F.lit("").alias("tree_name"))
    return dedup.corrected(v.obs.withColumn("tree_name", F.col("cultivar")), reports).select("tree_id", "dbh", "tree_name")


@query("d11_grouped_mean", "WITH {OBS} SELECT tree_id, round(coalesce(dbh, avg(dbh) OVER (PARTITION BY city, species)), 6) AS dbh FROM obs")
def _(v: Views) -> DataFrame:
    return dedup.impute_mean(v.obs, "dbh", ["city", "species"]).select("tree_id", F.round("dbh", 6).alias("dbh"))


@query("d12_border_duplicates", f"""WITH {{OBS}}, c AS (SELECT *, supp_key % 3 AS rank, {', '.join(f'{c} AS cell{i}' for i, c in enumerate(CELLS))} FROM obs)
SELECT tree_id, rank > least({', '.join(f'min(rank) OVER (PARTITION BY genus, cell{g})' for g in range(4))}) AS is_duplicate FROM c""")
def _(v: Views) -> DataFrame:
    return dedup.border_duplicates(v.obs, LAT, LON, F.col("supp_key") % 3)


def detections(v: Views) -> DataFrame:
    """Scored points in metres on tiles, from the observations of detectors."""
    x, y = cells.metric_xy(F.col("latitude"), F.col("longitude"), 40.0, -71.0)
    rows = v.obs.where("line in (3, 4)").select(F.col("tree_id").alias("id"), F.col("dbh").alias("score"), x.alias("x"), y.alias("y"), "line")
    return rows.where("score is not null").withColumn("tile", F.concat_ws("_", F.floor(F.col("x") / 100), F.floor(F.col("y") / 100)))


DET = "{OBS}, det AS (SELECT *, concat_ws('_', floor(x / 100)::BIGINT, floor(y / 100)::BIGINT) AS tile FROM (SELECT tree_id AS id, dbh AS score, (longitude + 71) * (111320.0 * cos(radians(40.0))) AS x, (latitude - 40) * 111320.0 AS y, line FROM obs WHERE line IN (3, 4) AND dbh IS NOT NULL))"
#: Twin of the greedy suppression: a walk over the rows that have conflicts, with the list of rows gone so far.
GREEDY = """o AS MATERIALIZED (SELECT second AS id, list(first) AS ahead, row_number() OVER (ORDER BY any_value(s) DESC, second) AS i FROM conflicts GROUP BY second),
w(i, gone) AS (SELECT 0::BIGINT, []::VARCHAR[] UNION ALL SELECT o.i, CASE WHEN len(list_filter(o.ahead, lambda a: NOT list_contains(w.gone, a))) > 0 THEN list_append(w.gone, o.id) ELSE w.gone END FROM w JOIN o ON o.i = w.i + 1), gone AS MATERIALIZED (SELECT unnest(arg_max(gone, i)) AS id FROM w)"""


@query("d13_seam_dedup", f"""WITH RECURSIVE {DET}, conflicts AS MATERIALIZED (SELECT a.id AS first, b.id AS second, b.score AS s FROM det a JOIN det b ON floor(a.x / 8) BETWEEN floor(b.x / 8) - 1 AND floor(b.x / 8) + 1 AND a.tile <> b.tile AND (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 64 AND (a.score > b.score OR (a.score = b.score AND a.id < b.id))), {GREEDY}
SELECT id, id NOT IN (FROM gone) AS kept FROM det""")
def _(v: Views) -> DataFrame:
    rows = checkpointed(detections(v))
    return dedup.greedy_suppress(rows, checkpointed(dedup.seam_conflicts(rows, 8.0)), checkpointed).select("id", "kept")


@query("d14_absorbed_flags", f"""WITH {{OBS}}, c AS (SELECT *, {', '.join(f'{c} AS cell{i}' for i, c in enumerate(CELLS))} FROM obs)
SELECT tree_id, {' OR '.join(f'cell{g} IN (SELECT cell{g} FROM c WHERE line > 5)' for g in range(4))} AS absorbed FROM c WHERE line = 4""")
def _(v: Views) -> DataFrame:
    return dedup.absorbed(v.obs.where("line = 4"), v.obs.where("line > 5"), LAT, LON)


PATCH = "tx % 7 = 0 AND ty % 5 = 0"


@query("d15_patch_replace", f"""WITH RECURSIVE {DET}, t AS (SELECT *, floor(x / 100)::BIGINT AS tx, floor(y / 100)::BIGINT AS ty FROM det), cov AS (SELECT DISTINCT tx, ty FROM t WHERE {PATCH}), ring AS (SELECT DISTINCT tx + i AS tx, ty + j AS ty FROM cov, range(-1, 2) a(i), range(-1, 2) b(j) EXCEPT FROM cov),
fresh AS (SELECT id, score, x, y, tile FROM t WHERE line = 4 AND (tx, ty) IN (SELECT (tx, ty) FROM cov)), edge AS (SELECT id, score, x, y, 'base' AS tile FROM t WHERE line = 3 AND (tx, ty) IN (SELECT (tx, ty) FROM ring)), bt AS (FROM fresh UNION ALL FROM edge),
conflicts AS MATERIALIZED (SELECT a.id AS first, b.id AS second, b.score AS s FROM bt a JOIN bt b ON floor(a.x / 8) BETWEEN floor(b.x / 8) - 1 AND floor(b.x / 8) + 1 AND a.tile <> b.tile AND (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 64 AND (a.score > b.score OR (a.score = b.score AND a.id < b.id))), {GREEDY}
SELECT id FROM t WHERE line = 3 AND (tx, ty) NOT IN (SELECT (tx, ty) FROM ring) AND (tx, ty) NOT IN (SELECT (tx, ty) FROM cov) UNION ALL SELECT id FROM bt WHERE id NOT IN (FROM gone)""")
def _(v: Views) -> DataFrame:
    t = detections(v).withColumns({"tx": F.floor(F.col("x") / 100), "ty": F.floor(F.col("y") / 100)})
    return dedup.patch_replace(t.where("line = 3"), t.where("line = 4"), t.where(PATCH).select("tx", "ty").distinct(), 8.0, checkpointed).select("id")


@query("d16_content_ids", "WITH {OBS} SELECT tree_id, sha1(concat('3=run|1=1|', length(city), '=', city, '|', length(tree_id), '=', tree_id)) AS content_id FROM obs")
def _(v: Views) -> DataFrame:
    return v.obs.select("tree_id", dedup.content_id(F.lit("run"), F.lit("1"), "city", "tree_id").alias("content_id"))


@query("d17_peak_ties", f"""WITH RECURSIVE {DET}, conflicts AS MATERIALIZED (SELECT a.id AS first, b.id AS second, b.score AS s FROM det a JOIN det b ON a.score = b.score AND a.tile = b.tile AND a.id < b.id AND abs(floor(a.x) - floor(b.x)) <= 2 AND abs(floor(a.y) - floor(b.y)) <= 2), {GREEDY}
SELECT id, id NOT IN (FROM gone) AS kept FROM det""")
def _(v: Views) -> DataFrame:
    rows = checkpointed(detections(v).select("id", "score", "tile", F.floor("x").alias("x"), F.floor("y").alias("y")))
    near = cells.pairs_within(rows.where("score is not null"), rows, 4.0, keys=("tile", "score"))
    close = (F.abs(F.col("l_x") - F.col("r_x")) <= 2) & (F.abs(F.col("l_y") - F.col("r_y")) <= 2)
    ties = near.where(close & (F.col("l_id") < F.col("r_id"))).select(F.col("l_id").alias("first"), F.col("r_id").alias("second"))
    return dedup.greedy_suppress(rows, checkpointed(ties), checkpointed).select("id", "kept")


@query("d18_first_source", "WITH {OBS} SELECT order_key, min(data_source) AS data_source FROM obs GROUP BY order_key")
def _(v: Views) -> DataFrame:
    return dedup.first_of(v.obs, ["order_key"], ["data_source", "tree_id"]).select("order_key", "data_source")


@query("g1_position_cell", "WITH {OBS} SELECT tree_id, (floor(longitude / 3e-5) * 100000000 + floor(latitude / 2e-5))::BIGINT AS cell, round((floor(latitude / 2e-5) + 0.5) * 2e-5, 6) AS centre_lat FROM obs")
def _(v: Views) -> DataFrame:
    cell = cells.position_cell(F.col("latitude"), F.col("longitude"))
    return v.obs.select("tree_id", cell.alias("cell"), F.round(cells.position_centre(cell)[0], 6).alias("centre_lat"))


TILE = "least(greatest(floor((longitude + 180) / 360 * {n}), 0), {n} - 1)::BIGINT AS x, least(greatest(floor((1 - ln(tan(radians(latitude)) + 1 / cos(radians(latitude))) / pi()) / 2 * {n}), 0), {n} - 1)::BIGINT AS y"


@query("g4_mercator_tile", f"WITH {{OBS}} SELECT tree_id, {TILE.format(n=1 << 18)} FROM obs")
def _(v: Views) -> DataFrame:
    x, y = cells.mercator_tile(F.col("latitude"), F.col("longitude"), 18)
    return v.obs.select("tree_id", x.alias("x"), y.alias("y"))


@query("g5_morton_key", "SELECT l_orderkey, l_partkey, sum((((l_orderkey >> b) & 1) << (2 * b)) | (((l_partkey >> b) & 1) << (2 * b + 1)))::BIGINT AS morton FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem), range(16) t(b) GROUP BY ALL")
def _(v: Views) -> DataFrame:
    return v.table("lineitem").select("l_orderkey", "l_partkey").distinct().select("*", cells.morton(F.col("l_orderkey"), F.col("l_partkey"), 16).alias("morton"))


def hilbert_sql(bits: int) -> str:
    """Twin of the Hilbert key: one nested table a level, with the quadrant's place and the turn of the next level."""
    sql = "SELECT tree_id, floor((longitude + 72) * 5e4)::BIGINT AS x, floor((latitude - 39) * 5e4)::BIGINT AS y, 0::BIGINT AS d, 0 AS s FROM obs"
    for b in range(bits - 1, -1, -1):
        at = f"s * 4 + ((x >> {b}) & 1) * 2 + ((y >> {b}) & 1) + 1"
        sql = f"SELECT tree_id, x, y, d * 4 + [0, 1, 3, 2, 0, 3, 1, 2, 2, 1, 3, 0, 2, 3, 1, 0][{at}] AS d, [1, 0, 2, 0, 0, 3, 1, 1, 2, 2, 0, 3, 3, 1, 3, 2][{at}] AS s FROM ({sql})"
    return f"WITH {{OBS}} SELECT tree_id, d AS hilbert FROM ({sql})"


@query("g6_hilbert_order", hilbert_sql(17))
def _(v: Views) -> DataFrame:
    return v.obs.select("tree_id", cells.hilbert(F.floor((F.col("longitude") + 72) * 5e4), F.floor((F.col("latitude") - 39) * 5e4), 17).alias("hilbert")).orderBy("hilbert")


@query("g7_overview_tiles", f"WITH {{OBS}}, t AS (SELECT {TILE.format(n=1 << 14).replace(' AS x,', ' AS tx,').replace(' AS y', ' AS ty')}, (floor(6378137.0 * radians(longitude) / 200) + 0.5) * 200 AS cx, (floor(6378137.0 * ln(tan(radians(latitude)) + 1 / cos(radians(latitude))) / 200) + 0.5) * 200 AS cy, genus, dbh FROM obs) SELECT tx, ty, cx, cy, genus, count(*) AS trees, round(avg(dbh), 6) AS mean_dbh FROM t GROUP BY ALL")
def _(v: Views) -> DataFrame:
    return cells.overview(v.obs, 14, 200.0, "genus", "dbh").withColumn("mean_dbh", F.round("mean_dbh", 6))


@query("g8_local_metres", "WITH {OBS} SELECT tree_id, round((longitude + 71) * (111320.0 * cos(radians(40))), 4) AS x, round((latitude - 40) * 111320.0, 4) AS y, round(2 * 6371008.8 * asin(sqrt(sin(radians(latitude - 40) / 2) ** 2 + cos(radians(40)) * cos(radians(latitude)) * sin(radians(longitude + 71) / 2) ** 2)), 4) AS d FROM obs")
def _(v: Views) -> DataFrame:
    x, y = cells.metric_xy(F.col("latitude"), F.col("longitude"), 40.0, -71.0)
    d = cells.haversine_m(F.lit(40.0), F.lit(-71.0), F.col("latitude"), F.col("longitude"))
    return v.obs.select("tree_id", F.round(x, 4).alias("x"), F.round(y, 4).alias("y"), F.round(d, 4).alias("d"))
