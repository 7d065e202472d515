"""Queries of the aggregation, window and ranking operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arborscale.functions.lineage import scratch
from arborscale.operators import cells, clean, grids, rank, rollups, stored
from arborscale.plans.registry import Views, query, tree_rollups

DBH = "CASE WHEN dbh < 6 THEN '<6' WHEN dbh < 12 THEN '6-12' WHEN dbh < 24 THEN '12-24' WHEN dbh < 36 THEN '24-36' WHEN dbh IS NOT NULL THEN '36+' END"
CROWN = "CASE WHEN width < 3 THEN '<3' WHEN width < 5 THEN '3-5' WHEN width < 8 THEN '5-8' WHEN width < 12 THEN '8-12' WHEN width IS NOT NULL THEN '12+' END"
KIND = "CASE line WHEN 1 THEN 'community' WHEN 2 THEN 'osm' WHEN 3 THEN 'satellite' WHEN 4 THEN 'predicted' ELSE 'municipal' END"


@query("a1_city_species", "WITH {OBS} SELECT city, species, count(*) AS trees FROM obs GROUP BY ALL")
def _(v: Views) -> DataFrame:
    return rollups.count_by(v.obs, "city", "species")


@query("a2_plant_year", "WITH {OBS} SELECT city, species, year(plant_date)::INT AS plant_year, count(*) AS trees FROM obs GROUP BY ALL")
def _(v: Views) -> DataFrame:
    return rollups.count_by(v.obs, "city", "species", F.year("plant_date").alias("plant_year"))


@query("a3_dbh_class", f"WITH {{OBS}} SELECT city, species, {DBH} AS dbh_class, count(*) AS trees FROM obs GROUP BY ALL")
def _(v: Views) -> DataFrame:
    return rollups.count_by(v.obs, "city", "species", rollups.dbh_class(F.col("dbh")).alias("dbh_class"))


@query("a4_map_cells", "WITH {OBS} SELECT city, 3 AS digits, floor(latitude * 1000 + 0.5) / 1000 AS lat, floor(longitude * 1000 + 0.5) / 1000 AS lon, count(*) AS trees FROM obs GROUP BY ALL UNION ALL SELECT city, 2, floor(latitude * 100 + 0.5) / 100, floor(longitude * 100 + 0.5) / 100, count(*) FROM obs GROUP BY ALL")
def _(v: Views) -> DataFrame:
    cell = lambda c, k: (F.floor(F.col(c) * k + 0.5) / k)
    fine = v.obs.select("city", F.explode(F.array(*[F.struct(F.lit(d).alias("digits"), cell("latitude", 10**d).alias("lat"), cell("longitude", 10**d).alias("lon")) for d in (3, 2)])).alias("c"))
    return rollups.count_by(fine.select("city", "c.*"), "city", "digits", "lat", "lon")


@query("a5_source_kind", f"WITH {{OBS}} SELECT city, {KIND} AS kind, count(*) AS trees FROM obs GROUP BY ALL")
def _(v: Views) -> DataFrame:
    return rollups.count_by(v.obs, "city", clean.source_kind(F.col("data_source"), notable=False).alias("kind"))


@query("a6_crown_canopy", f"WITH {{OBS}}, w AS (SELECT *, coalesce(crown_width_m, dbh / 5) AS width FROM obs) SELECT city, species, {CROWN} AS crown_class, count(*) AS trees, round(sum(pi() * (width / 2) ** 2), 4) AS canopy_m2 FROM w GROUP BY ALL")
def _(v: Views) -> DataFrame:
    return rollups.canopy_rollup(v.obs, "crown_width_m", F.col("dbh") / 5).withColumn("canopy_m2", F.round("canopy_m2", 4))


@query("a7_city_centroid", "WITH {OBS} SELECT city, round(avg(latitude), 6) AS lat, round(avg(longitude), 6) AS lon FROM obs GROUP BY city")
def _(v: Views) -> DataFrame:
    return v.obs.groupBy("city").agg(F.round(F.avg("latitude"), 6).alias("lat"), F.round(F.avg("longitude"), 6).alias("lon"))


@query("a8_sorted_lists", "WITH {OBS} SELECT species, string_agg(DISTINCT city, ',' ORDER BY city) AS cities FROM obs GROUP BY species")
def _(v: Views) -> DataFrame:
    return v.obs.groupBy("species").agg(F.array_join(F.array_sort(F.collect_set("city")), ",").alias("cities"))


@query("a9_re_aggregation", "WITH {OBS} SELECT species, count(*) AS trees FROM obs GROUP BY species")
def _(v: Views) -> DataFrame:
    return v.rollups.answer({"species": F.col("species")}, ["species"], ["trees"])


@query("a9_stored_rollups", f"""WITH {{OBS}}, w AS (SELECT *, crown_width_m AS width FROM obs), r AS (SELECT 'species' AS name, 'city,species' AS grain, count(*) AS rows FROM (SELECT DISTINCT city, species FROM w) UNION ALL SELECT 'year', 'city,species,plant_year', count(*) FROM (SELECT DISTINCT city, species, year(plant_date) FROM w)
UNION ALL SELECT 'dbh', 'city,species,dbh_class', count(*) FROM (SELECT DISTINCT city, species, {DBH} FROM w) UNION ALL SELECT 'crown', 'city,species,crown_class', count(*) FROM (SELECT DISTINCT city, species, {CROWN} FROM w) UNION ALL SELECT 'origin', 'city,species,kind', count(*) FROM (SELECT DISTINCT city, species, {KIND} FROM w)
UNION ALL SELECT 'traits', 'city,species,form,growth,wildlife,fire', count(*) FROM (SELECT DISTINCT city, species, size_class % 3, CASE part_key % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 END, part_key % 5 = 0, part_key % 11 < 4 FROM w) UNION ALL SELECT 'cell', 'city,species,cell_y,cell_x', count(*) FROM (SELECT DISTINCT city, species, floor(latitude * 1000), floor(longitude * 1000) FROM w)) FROM r""")
def _(v: Views) -> DataFrame:
    return v.rollups.catalogue().select("name", F.array_join("grain", ",").alias("grain"), "rows")


@query("a9_stored_coarse_cells", "WITH {OBS} SELECT floor(floor(latitude * 1000) / 10)::BIGINT AS cy, floor(floor(longitude * 1000) / 10)::BIGINT AS cx, count(*) AS trees FROM obs WHERE city <> 'c3' GROUP BY ALL")
def _(v: Views) -> DataFrame:
    return v.rollups.answer({"cy": F.floor(F.col("cell_y") / 10), "cx": F.floor(F.col("cell_x") / 10)}, ["city", "cell_y", "cell_x"], ["trees"], F.col("city") != "c3")


@query("a9_stored_least_squares", """WITH {OBS}, p AS (SELECT genus, ln(dbh) AS x, ln(crown_width_m) AS y FROM obs WHERE dbh > 0 AND crown_width_m > 0)
SELECT genus, count(*) AS n, round(regr_slope(y, x), 6) AS b, round(regr_intercept(y, x), 6) AS a, round(sqrt(greatest(regr_syy(y, x) - regr_slope(y, x) * regr_sxy(y, x), 0) / (count(*) - 2)), 6) AS sigma, round(regr_r2(y, x), 6) AS r2, round(max(x), 6) AS x_max FROM p GROUP BY genus""")
def _(v: Views) -> DataFrame:
    m = v.rollups.answer({"genus": F.split_part("species", F.lit(" "), F.lit(1))}, ["species"], ["log_crown"])
    fit = stored.line(m, ["genus"], "log_crown")
    return fit.select("genus", "n", *[F.round(c, 6).alias(c) for c in ("b", "a", "sigma", "r2", "x_max")])


@query("a9_merged_rollup", "WITH {OBS} SELECT city, species, count(*) AS trees, max(dbh) AS largest FROM obs GROUP BY ALL")
def _(v: Views) -> DataFrame:
    """A store of most rows, into which the rest is merged."""
    species = tree_rollups()[:1]
    store = stored.Store(v.spark, scratch(v.spark, "merged-rollups"))
    store.build(v.obs.where("line < 5"), species)
    store.add(v.obs.where("line >= 5"), species)
    return store.answer({"city": F.col("city"), "species": F.col("species")}, ["city", "species"], ["trees", "largest"])


@query("a10_least_squares", """WITH {OBS}, p AS (SELECT genus, ln(dbh) AS x, ln(crown_width_m) AS y FROM obs WHERE dbh > 0 AND crown_width_m > 0)
SELECT genus, count(*) AS n, round(regr_slope(y, x), 6) AS b, round(regr_intercept(y, x), 6) AS a, round(sqrt(greatest(regr_syy(y, x) - regr_slope(y, x) * regr_sxy(y, x), 0) / (count(*) - 2)), 6) AS sigma, round(regr_r2(y, x), 6) AS r2, round(max(x), 6) AS x_max FROM p GROUP BY genus""")
def _(v: Views) -> DataFrame:
    fits = rollups.ols(v.obs.where("dbh > 0 and crown_width_m > 0"), ["genus"], F.log("dbh"), F.log("crown_width_m"))
    return fits.select("genus", "n", *[F.round(c, 6).alias(c) for c in ("b", "a", "sigma", "r2", "x_max")])


@query("a11_conditional_counts", "WITH {OBS} SELECT city, count_if(dbh >= 30) AS large, count_if(crown_width_m IS NULL) AS no_crown FROM obs GROUP BY city")
def _(v: Views) -> DataFrame:
    return v.obs.groupBy("city").agg(F.count_if(F.col("dbh") >= 30).alias("large"), F.count_if(F.col("crown_width_m").isNull()).alias("no_crown"))


@query("a12_distinct_share", "WITH {OBS} SELECT city, round(count(DISTINCT CASE WHEN dbh > 20 THEN order_key END) / count(DISTINCT order_key), 6) AS share FROM obs GROUP BY city")
def _(v: Views) -> DataFrame:
    return v.obs.groupBy("city").agg(F.round(F.countDistinct(F.when(F.col("dbh") > 20, F.col("order_key"))) / F.countDistinct("order_key"), 6).alias("share"))


@query("a13_groups_with_rows", "WITH {OBS} SELECT city, count(*) AS kinds FROM (SELECT city, species FROM obs WHERE dbh > 40 GROUP BY ALL) GROUP BY city")
def _(v: Views) -> DataFrame:
    return rollups.count_by(v.obs.where("dbh > 40"), "city", "species").where("trees > 0").groupBy("city").agg(F.count("*").alias("kinds"))


@query("a14_exact_quantiles", "WITH {OBS} SELECT species, quantile_cont(dbh, 0.5) AS median, quantile_cont(dbh, 0.1) AS p10, quantile_cont(dbh, 0.9) AS p90, count(*) AS n FROM obs WHERE dbh BETWEEN 3 AND 48 GROUP BY species")
def _(v: Views) -> DataFrame:
    return rollups.quantiles(v.obs, ["species"], F.col("dbh"), {"median": 0.5, "p10": 0.1, "p90": 0.9}, F.col("dbh").between(3, 48))


@query("a15_arg_extremes", "WITH {OBS} SELECT city, arg_max(tree_id, (dbh, tree_id)) AS largest, arg_min(tree_id, (dbh, tree_id)) AS smallest FROM obs WHERE dbh IS NOT NULL GROUP BY city")
def _(v: Views) -> DataFrame:
    key = F.struct("dbh", "tree_id")
    return v.obs.where("dbh is not null").groupBy("city").agg(F.max_by("tree_id", key).alias("largest"), F.min_by("tree_id", key).alias("smallest"))


@query("a16_local_density", """WITH {OBS}, r AS (SELECT *, floor(latitude * 2226.4)::BIGINT AS cy FROM obs), t AS (SELECT *, radians((cy + 0.5) / 2226.4) * radians((cy + 0.5) / 2226.4) AS t FROM r), c AS (SELECT *, floor(longitude * 2226.4 * (1 - t / 2 + t * t / 24 - t * t * t / 720))::BIGINT AS cx FROM t)
SELECT tree_id, count(*) FILTER (WHERE line NOT IN (3, 4)) OVER (PARTITION BY cx, cy) AS density FROM c""")
def _(v: Views) -> DataFrame:
    cx, cy = cells.quarter_hectare(F.col("latitude"), F.col("longitude"))
    return rank.with_group_counts(v.obs.withColumns({"cx": cx, "cy": cy}), ["cx", "cy"], {"density": ~F.col("line").isin(3, 4)}).select("tree_id", "density")


@query("a17_hierarchical_share", """WITH {OBS}, m AS (SELECT city, genus, species, dbh > 25 AS m FROM obs WHERE dbh IS NOT NULL), k AS (SELECT DISTINCT species, city, genus FROM m),
s AS (SELECT species, avg(m::INT) AS s FROM m GROUP BY 1 HAVING count(*) >= 980), c AS (SELECT city, avg(m::INT) AS s FROM m GROUP BY 1 HAVING count(*) >= 2380), g AS (SELECT genus, avg(m::INT) AS s FROM m GROUP BY 1 HAVING count(*) >= 700)
SELECT species, city, genus, round(coalesce(s.s, c.s, g.s), 6) AS share, CASE WHEN s.s IS NOT NULL THEN 'species' WHEN c.s IS NOT NULL THEN 'city' WHEN g.s IS NOT NULL THEN 'genus' END AS level FROM k LEFT JOIN s USING (species) LEFT JOIN c USING (city) LEFT JOIN g USING (genus)""")
def _(v: Views) -> DataFrame:
    rows = v.obs.where("dbh is not null").withColumn("m", F.col("dbh") > 25)
    return rank.share_with_fallback(rows, {"species": 980, "city": 2380, "genus": 700}, F.col("m")).withColumn("share", F.round("share", 6))


@query("a17_foliage_shares", """WITH {OBS}, t AS (SELECT genus, floor((latitude - 40) * 500) AS fy, floor((longitude + 71) * 500) AS fx, floor((latitude - 40) * 100) AS gy, floor((longitude + 71) * 100) AS gx, part_key % 4 = 0 AND ((latitude - 40) * 500 < 5 OR order_key % 2000 = 0) AS known, size_class > 20 AS d FROM obs),
c AS (SELECT genus, (fy::BIGINT + 90) * 360 + fx::BIGINT + 180 AS cell, (gy::BIGINT + 18) * 72 + gx::BIGINT + 36 AS region, count_if(known) AS n, count_if(known AND d) AS k, count_if(NOT known) AS open_trees FROM t GROUP BY ALL), s AS (SELECT *, sum(n) OVER (PARTITION BY genus, region) AS nr, sum(k) OVER (PARTITION BY genus, region) AS kr, sum(n) OVER (PARTITION BY genus) AS ng, sum(k) OVER (PARTITION BY genus) AS kg FROM c)
SELECT cell, genus, round(CASE WHEN n >= 20 THEN k / n WHEN nr >= 20 THEN kr / nr WHEN ng >= 20 THEN kg / ng END, 6) AS deciduous_share, CASE WHEN n >= 20 THEN 'cell' WHEN nr >= 20 THEN 'region' WHEN ng >= 20 THEN 'genus' END AS level, open_trees FROM s""")
def _(v: Views) -> DataFrame:
    lat, lon = (F.col("latitude") - 40) * 500, (F.col("longitude") + 71) * 500
    known = (F.col("part_key") % 4 == 0) & ((lat < 5) | (F.col("order_key") % 2000 == 0))
    trees = v.obs.select("genus", lat.alias("latitude"), lon.alias("longitude"), known.alias("identified"), (F.col("size_class") > 20).alias("deciduous"))
    return rank.foliage_shares(trees).withColumn("deciduous_share", F.round("deciduous_share", 6))


@query("a18_contributor_feed", """SELECT CASE WHEN user_id % 3 = 0 THEN concat('u', user_id) ELSE '(others)' END AS who, count(DISTINCT props) AS trees, count(*) AS n FROM events GROUP BY 1""")
def _(v: Views) -> DataFrame:
    who = F.when(F.col("user_id") % 3 == 0, F.concat(F.lit("u"), F.col("user_id"))).otherwise("(others)")
    # distinct first: the others' combined row is counted from a deduplicated table, whatever its share of the rows
    return v.table("events").groupBy(who.alias("who"), "props").agg(F.count("*").alias("n")).groupBy("who").agg(F.count("*").alias("trees"), F.sum("n").alias("n"))


@query("a19_table_profile", "SELECT 'l_quantity' AS column_name, count(l_quantity) AS present, count_if(l_quantity IS NULL) AS nulls, min(l_quantity)::VARCHAR AS least, max(l_quantity)::VARCHAR AS greatest, count(DISTINCT l_quantity) AS kinds, median(l_quantity)::DOUBLE AS median FROM lineitem UNION ALL SELECT 'l_partkey', count(l_partkey), count_if(l_partkey IS NULL), min(l_partkey)::VARCHAR, max(l_partkey)::VARCHAR, count(DISTINCT l_partkey), median(l_partkey)::DOUBLE FROM lineitem")
def _(v: Views) -> DataFrame:
    return rollups.profile(v.table("lineitem"), ["l_quantity", "l_partkey"])


@query("a20_vocabulary_coverage", "WITH {OBS}, k AS (SELECT unnest(['genus', 'species']) AS key, unnest([genus, species]) AS value, unnest([genus IN ('Red', 'Blue', 'Hot'), genus = 'Red']) AS known FROM obs) SELECT key, count_if(known) AS covered, count(*) AS total, count(DISTINCT value) FILTER (WHERE NOT known) AS unsupported, round(avg(known::INT), 6) AS ratio FROM k GROUP BY key")
def _(v: Views) -> DataFrame:
    o = v.obs
    one = lambda key, vocabulary: rollups.vocabulary_coverage(o, key, vocabulary).select(F.lit(key).alias("key"), "*", F.round(F.col("covered") / F.col("total"), 6).alias("ratio"))
    return one("genus", o.where(F.col("genus").isin("Red", "Blue", "Hot"))).unionByName(one("species", o.where("genus = 'Red'")))


@query("a20_unsupported_values", "WITH {OBS} SELECT species, count(*) AS rows FROM obs WHERE genus <> 'Red' GROUP BY species")
def _(v: Views) -> DataFrame:
    return rollups.unsupported(v.obs, "species", v.obs.where("genus = 'Red'"))


@query("a21_support_table", "WITH {OBS} SELECT species, count(*) AS trees, count(DISTINCT order_key) AS chips, count(DISTINCT supp_key) AS blocks, count_if(city = 'c0') AS c0, count_if(city = 'c1') AS c1, count_if(city = 'c2') AS c2, count_if(city = 'c3') AS c3, count_if(city = 'c4') AS c4, count_if(city = 'c5') AS c5, count_if(city = 'c6') AS c6, count_if(city = 'c7') AS c7, count_if(city = 'c8') AS c8, count_if(city = 'c9') AS c9, count_if(city = 'c10') AS c10, count_if(city = 'c11') AS c11, count_if(city = 'c12') AS c12, count_if(city = 'c13') AS c13, count_if(city = 'c14') AS c14, count_if(city = 'c15') AS c15, count_if(city = 'c16') AS c16, count_if(city = 'c17') AS c17, count_if(city = 'c18') AS c18, count_if(city = 'c19') AS c19, count_if(city = 'c20') AS c20, count_if(city = 'c21') AS c21, count_if(city = 'c22') AS c22, count_if(city = 'c23') AS c23, count_if(city = 'c24') AS c24 FROM obs GROUP BY species")
def _(v: Views) -> DataFrame:
    return rollups.support_table(v.obs.select("species", "city", F.col("order_key").alias("chip"), F.col("supp_key").alias("block")), [f"c{k}" for k in range(25)])


@query("a22_stack_sizes", "WITH {OBS}, s AS (SELECT latitude, longitude, count(*) AS n FROM obs GROUP BY ALL HAVING count(*) > 1) SELECT count(*) AS stacks, coalesce(sum(n), 0)::BIGINT AS trees, max(n) AS largest FROM s")
def _(v: Views) -> DataFrame:
    return v.obs.groupBy("latitude", "longitude").agg(F.count("*").alias("n")).where("n > 1").agg(F.count("*").alias("stacks"), F.coalesce(F.sum("n"), F.lit(0)).alias("trees"), F.max("n").alias("largest"))


@query("a23_cell_collisions", "WITH {OBS} SELECT order_key % 1000 AS chip, line AS cell, count(*) AS labels FROM obs GROUP BY ALL HAVING count(*) > 1")
def _(v: Views) -> DataFrame:
    return v.obs.groupBy((F.col("order_key") % 1000).alias("chip"), F.col("line").alias("cell")).agg(F.count("*").alias("labels")).where("labels > 1")


@query("a24_vocabulary_listing", "WITH {OBS} SELECT 'city' AS kind, city AS value FROM obs UNION SELECT 'genus', genus FROM obs UNION SELECT 'cultivar', cultivar FROM obs")
def _(v: Views) -> DataFrame:
    return rollups.unpivoted_values(v.obs, ["city", "genus", "cultivar"])


@query("a24_vocabulary_counts", "WITH {OBS} SELECT city, data_source, species, cultivar, lower(cultivar) AS name, count(*) AS trees FROM obs GROUP BY ALL")
def _(v: Views) -> DataFrame:
    return rollups.count_by(v.obs, "city", "data_source", "species", "cultivar", F.lower("cultivar").alias("name"))


@query("a25_observed_interval", "WITH d AS (SELECT DISTINCT o_custkey AS k, o_orderdate::DATE AS d FROM orders), g AS (SELECT k, d - lag(d) OVER (PARTITION BY k ORDER BY d) AS gap FROM d) SELECT k, median(gap) AS gap, CASE WHEN median(gap) > 2 * 90 THEN 'slower' WHEN median(gap) < 90 / 2 THEN 'faster' ELSE 'as planned' END AS verdict FROM g WHERE gap IS NOT NULL GROUP BY k")
def _(v: Views) -> DataFrame:
    stamps = v.table("orders").select(F.col("o_custkey").alias("k"), F.to_date("o_orderdate").alias("d")).distinct()
    return rank.observed_interval(stamps, ["k"], "d", planned=90)


@query("a26_raster_cells", "SELECT floor(value / 10)::BIGINT AS cx, hour(ts)::BIGINT AS cy, round(avg(value) FILTER (WHERE event_type <> 'error'), 6) AS mean, count_if(event_type <> 'error') AS valid, count(*) AS pixels FROM events GROUP BY ALL")
def _(v: Views) -> DataFrame:
    valid = F.col("event_type") != "error"
    return v.table("events").groupBy(F.floor(F.col("value") / 10).alias("cx"), F.hour("ts").cast("long").alias("cy")).agg(F.round(F.avg(F.when(valid, F.col("value"))), 6).alias("mean"), F.count_if(valid).alias("valid"), F.count("*").alias("pixels"))


@query("a26_daily_cells", """WITH p AS (SELECT floor(value / 10)::BIGINT AS cx, hour(ts)::BIGINT AS cy, ts::DATE AS day, value, event_type <> 'error' AS valid, event_type = 'signup' AS wet FROM events),
d AS (SELECT cx, cy, day, avg(value) AS mean FROM p WHERE valid GROUP BY ALL), c AS (SELECT cx, cy, count(*) AS pixels, count_if(NOT wet) AS land, count_if(valid) AS valid, avg(value) FILTER (WHERE valid) AS mean FROM p GROUP BY ALL)
SELECT c.cx, c.cy, pixels, land, valid, round(c.mean, 6) AS mean, land >= 0.5 * pixels AND valid >= 0.75 * land AND valid >= 30 AS eligible, day, round(d.mean, 6) AS day_mean FROM c JOIN d ON c.cx = d.cx AND c.cy = d.cy""")
def _(v: Views) -> DataFrame:
    kind = F.col("event_type")
    pixels = v.table("events").select(F.floor(F.col("value") / 10).alias("cx"), F.hour("ts").cast("long").alias("cy"), F.to_date("ts").alias("day"), "value", (kind != "error").alias("valid"), (kind == "signup").alias("wet"))
    found = grids.raster_cells(pixels, 0.5, 0.75, 30).withColumn("d", F.explode("days"))
    return found.select("cx", "cy", "pixels", "land", "valid", F.round("mean", 6).alias("mean"), "eligible", "d.day", F.round("d.mean", 6).alias("day_mean"))


@query("a27_daily_mosaic", "SELECT user_id AS pixel, ts::DATE AS day, round(avg(value), 6) AS mean, count(value) AS scenes FROM events GROUP BY ALL")
def _(v: Views) -> DataFrame:
    return v.table("events").groupBy(F.col("user_id").alias("pixel"), F.to_date("ts").alias("day")).agg(F.round(F.avg("value"), 6).alias("mean"), F.count("value").alias("scenes"))


@query("a28_density_grid", "WITH {OBS}, c AS (SELECT tree_id, floor(longitude * 1000)::BIGINT AS cx, floor(latitude * 1000)::BIGINT AS cy FROM obs), h AS (SELECT cx, cy, count(*) AS n FROM c GROUP BY ALL), k AS (SELECT h.cx + i AS cx, h.cy + j AS cy, sum(n * (1 / (1.0 + i * i + j * j))) AS density FROM h, range(-1, 2) a(i), range(-1, 2) b(j) GROUP BY ALL) SELECT tree_id, round(density, 6) AS density FROM c JOIN k USING (cx, cy)")
def _(v: Views) -> DataFrame:
    return rank.smoothed_density(v.obs.select("tree_id", F.floor(F.col("longitude") * 1000).alias("cx"), F.floor(F.col("latitude") * 1000).alias("cy"))).select("tree_id", F.round("density", 6).alias("density"))


@query("r1_partition_totals", "WITH {OBS} SELECT tree_id, count(dbh) OVER (PARTITION BY city) AS measured, count(*) OVER (PARTITION BY city, species) AS of_species FROM obs")
def _(v: Views) -> DataFrame:
    out = rank.with_group_counts(v.obs, ["city"], {"measured": F.col("dbh").isNotNull()})
    return rank.with_group_counts(out, ["city", "species"], {"of_species": F.lit(True)}).select("tree_id", "measured", "of_species")


@query("r2_rarity", "WITH {OBS}, n AS (SELECT city, species, count(*) AS n FROM obs GROUP BY ALL) SELECT city, species, CASE WHEN species IS NOT NULL THEN round(n / t, 6) END AS share, CASE WHEN species IS NULL THEN NULL WHEN n * 100 <= t THEN 'rare' WHEN n * 20 <= t THEN 'unusual' ELSE 'common' END AS tier FROM (SELECT *, sum(n) FILTER (species IS NOT NULL) OVER (PARTITION BY city) AS t FROM n)")
def _(v: Views) -> DataFrame:
    return rank.rarity(rollups.count_by(v.obs, "city", "species")).select("city", "species", F.round("share", 6).alias("share"), "tier")


@query("r3_size_rank", "WITH {OBS} SELECT tree_id, CASE WHEN dbh > 0 AND isfinite(dbh) THEN rank() OVER (PARTITION BY city ORDER BY CASE WHEN isfinite(dbh) THEN dbh END DESC NULLS LAST) END::INT AS size_rank FROM obs")
def _(v: Views) -> DataFrame:
    return rank.size_rank(v.obs, "city", "dbh").select("tree_id", "size_rank")


@query("r4_dominance_rank", "WITH {OBS}, n AS (SELECT species, count(*) AS trees FROM obs GROUP BY ALL) SELECT species, trees, rank() OVER (ORDER BY trees DESC, species)::INT AS rank FROM n")
def _(v: Views) -> DataFrame:
    return rank.ranked(rollups.count_by(v.obs, "species"), [F.desc("trees"), F.asc("species")], "rank")


@query("r5_cumulative_share", "WITH {OBS}, n AS (SELECT species, count(*) AS trees FROM obs GROUP BY ALL) SELECT species, round(sum(trees) OVER (ORDER BY trees DESC, species ROWS UNBOUNDED PRECEDING) / sum(trees) OVER (), 6) AS share FROM n")
def _(v: Views) -> DataFrame:
    return rank.cumulative(rollups.count_by(v.obs, "species"), "species").select("species", F.round(F.col("upto") / F.col("total"), 6).alias("share"))


@query("r6_covering_prefix", "WITH {OBS}, n AS (SELECT species, count(*) AS trees FROM obs GROUP BY ALL), c AS (SELECT *, sum(trees) OVER (ORDER BY trees DESC, species ROWS UNBOUNDED PRECEDING) - trees AS before, sum(trees) OVER () AS total FROM n) SELECT species, trees FROM c WHERE before < 0.6 * total")
def _(v: Views) -> DataFrame:
    return rank.cumulative(rollups.count_by(v.obs, "species"), "species").where("upto - trees < 0.6 * total").select("species", "trees")


@query("r7_genus_rank", "WITH {OBS}, n AS (SELECT genus, count(*) AS trees FROM obs GROUP BY ALL) SELECT genus, trees, rank() OVER (ORDER BY trees DESC)::INT AS rank FROM n")
def _(v: Views) -> DataFrame:
    return rank.ranked(rollups.count_by(v.obs, "genus"), [F.desc("trees")], "rank")


@query("r8_top_per_group", "WITH {OBS}, n AS (SELECT city, genus, count(*) AS trees FROM obs GROUP BY ALL) SELECT city, genus, trees FROM n QUALIFY row_number() OVER (PARTITION BY city ORDER BY trees DESC, genus) = 1")
def _(v: Views) -> DataFrame:
    return rank.top_each(rollups.count_by(v.obs, "city", "genus"), ["city"], [F.desc("trees"), F.asc("genus")], 1)


@query("r9_nested_top", "WITH {OBS}, g AS (SELECT genus FROM obs GROUP BY genus ORDER BY count(*) DESC, genus LIMIT 3), n AS (SELECT genus, species, count(*) AS trees FROM obs WHERE genus IN (FROM g) GROUP BY ALL) SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY genus ORDER BY trees DESC, species) <= 2")
def _(v: Views) -> DataFrame:
    return rank.nested_top(rollups.count_by(v.obs, "genus", "species"), "genus", "species", 3, 2)


@query("r10_top_k", "WITH {OBS} SELECT species, count(*) AS trees FROM obs GROUP BY species ORDER BY trees DESC, species LIMIT 10")
def _(v: Views) -> DataFrame:
    return rollups.count_by(v.obs, "species").orderBy(F.desc("trees"), "species").limit(10)


@query("r11_nearest_n", "WITH {OBS}, p AS (SELECT tree_id, (longitude + 71.01) ** 2 + (latitude - 40.01) ** 2 + (coalesce(dbh, 0) / 1e6) ** 2 AS d FROM obs WHERE latitude BETWEEN 40.005 AND 40.015 AND longitude BETWEEN -71.015 AND -71.005) SELECT tree_id FROM p ORDER BY d, tree_id LIMIT 25")
def _(v: Views) -> DataFrame:
    near = v.obs.where("latitude between 40.005 and 40.015 and longitude between -71.015 and -71.005")
    d = (F.col("longitude") + 71.01) ** 2 + (F.col("latitude") - 40.01) ** 2 + (F.coalesce("dbh", F.lit(0)) / 1e6) ** 2
    return near.select("tree_id", d.alias("d")).orderBy("d", "tree_id").limit(25).select("tree_id")


@query("r12_outlier_flag", "WITH {OBS} SELECT tree_id, coalesce(dbh >= 30 AND dbh > 1.9 * avg(dbh) OVER (PARTITION BY species) AND count(dbh) OVER (PARTITION BY species) >= 30 AND line NOT IN (3, 4), false) AS outlier FROM obs")
def _(v: Views) -> DataFrame:
    return rank.outliers(v.obs, "species", "dbh", least=30, factor=1.9, few=30, exempt=F.col("line").isin(3, 4)).select("tree_id", "outlier")


@query("r13_priority_queue", """WITH {OBS}, a AS (SELECT tree_id, 1 AS stratum FROM obs WHERE dbh IS NOT NULL ORDER BY dbh DESC, tree_id LIMIT 50), b AS (SELECT tree_id, 2 AS stratum FROM obs WHERE tree_id NOT IN (SELECT tree_id FROM a) ORDER BY plant_date, tree_id LIMIT 40),
c AS (SELECT tree_id, 3 AS stratum FROM obs WHERE tree_id NOT IN (SELECT tree_id FROM a) AND tree_id NOT IN (SELECT tree_id FROM b) ORDER BY md5(tree_id) LIMIT 30) FROM a UNION ALL FROM b UNION ALL FROM c""")
def _(v: Views) -> DataFrame:
    return rank.queue(v.obs.select("tree_id", "dbh", "plant_date"), "tree_id", [(F.col("dbh").isNotNull(), [F.desc("dbh"), F.asc("tree_id")], 50), (F.lit(True), [F.asc("plant_date"), F.asc("tree_id")], 40), (F.lit(True), [F.asc(F.md5("tree_id"))], 30)])


@query("r14_diverse_order", """WITH {OBS}, q AS (SELECT tree_id AS id, supp_key % 3 AS split, dbh AS value, species, city AS block, md5(tree_id) AS h FROM obs WHERE dbh IS NOT NULL), c AS (SELECT split, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.5) AS b, quantile_cont(value, 0.75) AS c FROM q GROUP BY split),
k AS (SELECT q.*, 1 + (value > a)::INT + (value > b)::INT + (value > c)::INT AS quarter FROM q JOIN c USING (split)), s AS (SELECT *, h = min(h) OVER (PARTITION BY split, quarter, species) AS one FROM k), t AS (SELECT *, CASE WHEN one THEN 0 WHEN h = min(CASE WHEN NOT one THEN h END) OVER (PARTITION BY split, quarter, block) THEN 1 ELSE 2 END AS stage FROM s)
SELECT id, split, quarter, stage, row_number() OVER (PARTITION BY split, quarter ORDER BY stage, h, id) AS place FROM t""")
def _(v: Views) -> DataFrame:
    rows = v.obs.where("dbh is not null").select(F.col("tree_id").alias("id"), (F.col("supp_key") % 3).alias("split"), F.col("dbh").alias("value"), "species", F.col("city").alias("block"))
    return rank.diverse_order(rows).select("id", "split", "quarter", "stage", "place")


CHIPS = "chips AS (SELECT concat('k', order_key % 400) AS chip, city, CASE WHEN count(*) <= 5 THEN 'sparse' WHEN count(*) <= 10 THEN 'medium' ELSE 'dense' END AS density, any_value((order_key % 400) % 3 = 0) AS reviewed, count_if(crown_width_m IS NULL) AS priority FROM obs GROUP BY city, order_key % 400)"


@query("r15_stratified_sample", f"""WITH {{OBS}}, {CHIPS}, h AS (SELECT *, md5(concat(city, '|', chip)) AS h FROM chips), n AS (SELECT city, density, least(6 + (row_number() OVER (PARTITION BY city ORDER BY density) <= 2)::INT, c) AS quota FROM (SELECT city, density, count(*) AS c FROM h GROUP BY ALL)),
d AS (SELECT h.* FROM h JOIN n USING (city, density) QUALIFY row_number() OVER (PARTITION BY city, density ORDER BY h, chip) <= quota), sh AS (SELECT city, 20 - sum(quota) AS short FROM n GROUP BY city),
m AS (SELECT h.* FROM h JOIN sh USING (city) WHERE (city, chip) NOT IN (SELECT (city, chip) FROM d) QUALIFY row_number() OVER (PARTITION BY city ORDER BY h, chip) <= short), au AS (FROM d UNION ALL FROM m), c AS (SELECT city, 40 - count(*) AS many FROM au GROUP BY city),
g AS (SELECT h.* FROM h JOIN c USING (city) WHERE (city, chip) NOT IN (SELECT (city, chip) FROM au) QUALIFY row_number() OVER (PARTITION BY city ORDER BY reviewed, priority DESC, chip) <= many) SELECT city, chip, 'audit' AS queue FROM au UNION ALL SELECT city, chip, 'diagnostic' FROM g""")
def _(v: Views) -> DataFrame:
    k = F.col("order_key") % 400
    n = F.count("*")
    chips = v.obs.groupBy("city", k.alias("k")).agg(F.when(n <= 5, "sparse").when(n <= 10, "medium").otherwise("dense").alias("density"), F.count_if(F.col("crown_width_m").isNull()).alias("priority"))
    return rank.audit_sample(chips.select("city", F.concat(F.lit("k"), "k").alias("chip"), "density", (F.col("k") % 3 == 0).alias("reviewed"), "priority"), 40).select("city", "chip", "queue")


@query("r16_worst_first", "WITH {OBS}, c AS (SELECT order_key % 500 AS chip, count_if(crown_width_m IS NULL) AS missed, count(*) AS trees FROM obs GROUP BY 1) SELECT chip, missed, trees, row_number() OVER (ORDER BY missed DESC, trees DESC, chip)::INT AS place FROM c")
def _(v: Views) -> DataFrame:
    chips = v.obs.groupBy((F.col("order_key") % 500).alias("chip")).agg(F.count_if(F.col("crown_width_m").isNull()).alias("missed"), F.count("*").alias("trees"))
    return rank.numbered(chips, [F.desc("missed"), F.desc("trees"), F.asc("chip")], "place")
