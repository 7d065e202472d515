"""Queries of the quality guards, dashboards and world blocks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arborscale.functions.lineage import scratch
from arborscale.operators import blocks, clean, publish, quality, rank, reports, rollups
from arborscale.plans.q_dedup import TILE
from arborscale.plans.q_rollups import CROWN, DBH, KIND
from arborscale.plans.registry import Views, query


@query("q1_grain_check", "SELECT l_orderkey, l_linenumber, count(*) AS rows FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def _(v: Views) -> DataFrame:
    return quality.grain_violations(v.table("lineitem"), ["l_orderkey", "l_linenumber"])


@query("q2_kept_guard", "SELECT count(*) AS before, count_if(l_quantity > 20) AS now, count_if(l_quantity > 20) >= 0.75 * count(*) AS ok FROM lineitem")
def _(v: Views) -> DataFrame:
    return quality.kept(v.table("lineitem").where("l_quantity > 20"), v.table("lineitem"))


@query("q3_kept_by_dimension", "WITH {OBS} SELECT city, count(*) AS before, count_if(dbh > 14 AND city <> 'c7') AS now, count_if(dbh > 14 AND city <> 'c7') >= 0.75 * count(*) AS ok FROM obs GROUP BY city")
def _(v: Views) -> DataFrame:
    return quality.kept(v.obs.where("dbh > 14 and city <> 'c7'"), v.obs, ["city"])


@query("q4_source_kept", "WITH {OBS} SELECT count(*) AS before, count_if(dbh > 10) AS now, count_if(dbh > 10) >= 0.75 * count(*) AS ok FROM obs WHERE data_source = 'MUNI_1'")
def _(v: Views) -> DataFrame:
    one = v.obs.where("data_source = 'MUNI_1'")
    return quality.kept(one.where("dbh > 10"), one)


BOX = (40.0, 40.015, -71.015, -71.0)


@query("q5_bounds_validation", "WITH {OBS} SELECT count(*) AS rows, count_if(dbh IS NULL) AS nulls, count_if(dbh IS NOT NULL AND latitude > 40.015) AS latitude_out, count_if(longitude < -71.015) AS longitude_out, count_if(dbh IS NULL) <= 0.1 * count(*) AS ok FROM obs")
def _(v: Views) -> DataFrame:
    return quality.bounds_report(v.obs, F.when(F.col("dbh").isNotNull(), F.col("latitude")), F.col("longitude"), BOX)


@query("q5_rows_in_bounds", "WITH {OBS} SELECT tree_id FROM obs WHERE dbh IS NOT NULL AND latitude <= 40.015 AND longitude >= -71.015")
def _(v: Views) -> DataFrame:
    return quality.within_bounds(v.obs, F.when(F.col("dbh").isNotNull(), F.col("latitude")), F.col("longitude"), BOX).select("tree_id")


@query("q6_disjoint_union", "WITH {OBS} SELECT data_source, 2::BIGINT AS parts FROM obs WHERE data_source = 'MUNI_0' GROUP BY 1")
def _(v: Views) -> DataFrame:
    parts = {"town": v.obs.where("data_source in ('MUNI_0', 'MUNI_1')"), "county": v.obs.where("data_source in ('MUNI_0', 'MUNI_2')").drop("cultivar")}
    return quality.disjoint_union(parts, "data_source")[1]


@query("q7_freshness", "SELECT max(o_orderdate) AS newest, max(o_orderdate) > TIMESTAMP '2030-06-03' AS newer, true AS week_turned, true AS rebuild FROM orders")
def _(v: Views) -> DataFrame:
    stamp = lambda text: F.lit(text).cast("timestamp")
    return quality.freshness(v.table("orders").select(F.col("o_orderdate").alias("stamp")), stamp("2030-06-03"), stamp("2030-06-10"))


@query("q8_reconciliation", "WITH {OBS} SELECT city, count_if(dbh IS NOT NULL) AS in_blocks, count(*) AS rows, count_if(dbh IS NULL) = 0 AS ok FROM obs GROUP BY city")
def _(v: Views) -> DataFrame:
    b = v.obs.where("dbh is not null").groupBy(F.floor(F.col("latitude") * 500).alias("block"), "city").agg(F.count("*").alias("n"))
    return quality.reconciled(b, v.obs)


@query("q8_manifest_report", "WITH {OBS}, r AS (SELECT * FROM obs WHERE city <> 'c3') SELECT (SELECT count(*) FROM r) AS in_blocks, (SELECT count(*) FROM r) AS rows, (SELECT count(*) FROM (SELECT tree_id FROM r GROUP BY 1 HAVING count(*) > 1)) AS repeated_keys, (SELECT count(DISTINCT city) FROM obs WHERE city = 'c3') AS lost_cities, round((SELECT count(*) FROM r) / count(*), 6) AS kept, false AS ok FROM obs")
def _(v: Views) -> DataFrame:
    r = v.obs.where("city <> 'c3'")
    b = rollups.count_by(r, F.floor(F.col("latitude") * 500).alias("block"), "city").withColumnRenamed("trees", "n")
    return quality.manifest_report(b, r, rollups.count_by(v.obs, "city").withColumnRenamed("trees", "rows"), "tree_id").withColumn("kept", F.round("kept", 6))


@query("q9_asset_validation", "SELECT count(*) AS rows, count(DISTINCT user_id) AS keys, count_if(value NOT BETWEEN 0 AND 100) AS out_value FROM events")
def _(v: Views) -> DataFrame:
    return quality.asset_report(v.table("events"), "user_id", {"value": (0, 100)})


@query("q9_seasonal_asset", "WITH c AS (SELECT count(*) AS rows, count(DISTINCT o_orderkey) AS keys, count_if(NOT coalesce(o_totalprice BETWEEN 1000 AND 300000, false)) AS out_of_range, count_if(NOT coalesce(year(o_orderdate) = 1995 AND month(o_orderdate) BETWEEN 6 AND 8, false)) AS out_of_season FROM orders) SELECT *, rows > 0 AND rows = keys AND out_of_range = 0 AND out_of_season = 0 AS valid FROM c")
def _(v: Views) -> DataFrame:
    return quality.seasonal_report(v.table("orders"), "o_orderkey", {"o_totalprice": (1000, 300000)}, "o_orderdate", 1995, (6, 8))


@query("q10_latest_values", "SELECT user_id, arg_max(value, event_id) FILTER (WHERE event_type <> 'error') AS value, arg_max(event_type, event_id) AS event_type, coalesce(arg_max(event_type = 'view', event_id) FILTER (WHERE event_type IN ('view', 'click')), false) AS missing FROM events GROUP BY user_id")
def _(v: Views) -> DataFrame:
    e = v.table("events").withColumn("value", F.when(F.col("event_type") != "error", F.col("value")))
    flag = F.when(F.col("event_type").isin("view", "click"), F.col("event_type") == "view")
    return quality.latest_values(e, "user_id", ["ts", "event_id"], ["value", "event_type"], flag)


def tree_reports(v: Views) -> DataFrame:
    """Reports as an export has them, from the events: updates of single fields, clearings, missing trees, values out of bounds, blank
    ids, and many reports of equal stamps."""
    n, kind = F.col("event_id"), F.col("event_type")
    only = lambda name, value: F.when(kind == name, value).cast("string")
    fields = F.when(n % 9 == 0, F.array(F.lit("dbhInches"))).when(n % 11 == 0, F.array(F.lit("treeName"), F.lit("significance")))
    return v.table("events").select(
        F.when(n % 50 == 0, "  ").otherwise(F.concat(F.lit(" t"), "user_id", F.lit(" "))).alias("treeId"), F.when(kind == "error", "missing").otherwise("update").alias("kind"), F.date_format("ts", "yyyy-MM-dd").alias("publishedAt"),
        only("view", F.get(F.array(F.lit("acer RUBRUM"), F.lit("Quercus  alba (L.)"), F.lit("123 stump"), F.lit(" ")), (n % 4).cast("int"))).alias("species"), only("signup", F.col("value")).alias("dbhInches"),
        only("purchase", F.col("value") - 30).alias("latitude"), only("purchase", F.when(n % 5 > 0, F.col("value"))).alias("longitude"), fields.alias("clearFields"),
        F.when(n % 6 == 0, F.concat(F.lit("  Tree  no "), n % 13, F.lit(" "))).alias("treeName"), F.when(n % 10 == 0, F.concat(F.lit("Planted in "), 1850 + n % 100)).alias("significance"),
        F.when(n % 17 == 0, F.repeat(F.lit("x"), 310)).alias("significanceSource"), n.alias("place"),
    )


REPORTS = """e AS (SELECT concat('t', user_id) AS tree_id, row_number() OVER (PARTITION BY user_id ORDER BY ts::DATE, event_id) AS n, event_type = 'error' AS gone, CASE WHEN event_type = 'view' THEN CASE event_id % 4 WHEN 0 THEN 'Acer rubrum' WHEN 1 THEN 'Quercus alba' END END AS species,
CASE WHEN event_type = 'signup' AND value > 0 AND value <= 200 THEN value END AS dbh, event_id % 9 = 0 AS no_dbh, CASE WHEN event_type = 'purchase' AND event_id % 5 > 0 AND abs(value - 30) <= 90 AND value <= 180 THEN value END AS place,
event_id % 9 > 0 AND event_id % 11 = 0 AS no_name, CASE WHEN event_id % 6 = 0 THEN concat('Tree no ', event_id % 13) END AS name, CASE WHEN event_id % 10 = 0 THEN concat('Planted in ', 1850 + event_id % 100) END AS why, CASE WHEN event_id % 17 = 0 THEN repeat('x', 300) END AS source FROM events WHERE event_id % 50 > 0),
f AS (SELECT DISTINCT tree_id, 0::BIGINT AS n, NULL::VARCHAR AS species, NULL::DOUBLE AS dbh, false AS unknown, NULL::DOUBLE AS place, false AS gone, NULL::VARCHAR AS name, NULL::VARCHAR AS why, NULL::VARCHAR AS source FROM e
UNION ALL SELECT f.tree_id, e.n, CASE WHEN e.gone THEN f.species ELSE coalesce(e.species, f.species) END, CASE WHEN e.gone THEN f.dbh WHEN e.no_dbh THEN NULL ELSE coalesce(e.dbh, f.dbh) END, CASE WHEN e.gone THEN f.unknown WHEN e.no_dbh THEN true WHEN e.dbh IS NOT NULL THEN false ELSE f.unknown END,
CASE WHEN e.gone THEN f.place ELSE coalesce(e.place, f.place) END, e.gone, CASE WHEN e.gone THEN f.name WHEN e.no_name THEN '' ELSE coalesce(e.name, f.name) END, CASE WHEN e.gone THEN f.why WHEN e.no_name THEN '' ELSE coalesce(e.why, f.why) END, CASE WHEN e.gone THEN f.source ELSE coalesce(e.source, f.source) END FROM f JOIN e ON e.tree_id = f.tree_id AND e.n = f.n + 1)
SELECT tree_id, species, dbh AS diameter_at_breast_height, unknown AS dbh_unknown, place - 30 AS latitude, place AS longitude, gone AS missing, name AS tree_name, why AS significance, source AS significance_source FROM f QUALIFY n = max(n) OVER (PARTITION BY tree_id)"""


@query("q10_corrections", f"WITH RECURSIVE {REPORTS}")
def _(v: Views) -> DataFrame:
    return reports.corrections(reports.folded(tree_reports(v)))


@query("q10_merged_corrections", f"WITH RECURSIVE {REPORTS}")
def _(v: Views) -> DataFrame:
    """The same from two folded halves, the newer merged into the older."""
    every = tree_reports(v)
    late = F.col("publishedAt") >= "2024-01-15"
    return reports.corrections(reports.merged(reports.folded(every.where(late)), reports.folded(every.where(~late)), "tree_id"))


@query("q11_purge_unreachable", "SELECT p_partkey FROM part WHERE p_partkey % 4 = 0 OR p_partkey % 4 = 1 OR concat('k', p_partkey) IN (SELECT concat('k', l_partkey) FROM lineitem WHERE l_quantity > 45) OR p_partkey < 100")
def _(v: Views) -> DataFrame:
    part = v.table("part").withColumn("name", F.concat(F.lit("k"), "p_partkey"))
    k = F.col("p_partkey") % 4
    cleaned = F.when(k == 0, F.col("name")).when(k == 1, None).otherwise("other")
    return quality.purge(part, "name", cleaned, part.where("p_partkey < 100").select("name"), v.table("lineitem").where("l_quantity > 45").select(F.concat(F.lit("k"), "l_partkey").alias("name"))).select("p_partkey")


@query("q12_weighted_completeness", "WITH {OBS} SELECT 'dbh' AS column_name, round(sum(CASE WHEN dbh IS NOT NULL THEN size_class ELSE 0 END) / sum(size_class), 6) AS share FROM obs UNION ALL SELECT 'crown_width_m', round(sum(CASE WHEN crown_width_m IS NOT NULL THEN size_class ELSE 0 END) / sum(size_class), 6) FROM obs")
def _(v: Views) -> DataFrame:
    return quality.weighted_completeness(v.obs, "size_class", ["dbh", "crown_width_m"]).withColumn("share", F.round("share", 6))


@query("q12_top_coverage", "WITH {OBS}, n AS (SELECT species, count(*) AS trees FROM obs GROUP BY species ORDER BY trees DESC, species LIMIT 20), p AS (SELECT DISTINCT concat(upper(p_name[1]), substr(p_name, 2)) AS species FROM part WHERE p_retailprice > 1900) SELECT count(*) AS species, count(*) FILTER (WHERE species IN (FROM p)) AS profiled, round(coalesce(sum(trees) FILTER (WHERE species IN (FROM p)), 0) / sum(trees), 6) AS share FROM n")
def _(v: Views) -> DataFrame:
    profiles = v.table("part").where("p_retailprice > 1900").select(F.expr("concat(upper(left(p_name, 1)), substr(p_name, 2))").alias("species"))
    return quality.top_coverage(rollups.count_by(v.obs, "species"), profiles, 20).withColumn("share", F.round("share", 6))


FAMILY = "concat('Family ', length(genus))"


@query("b1_headline", f"WITH {{OBS}}, g AS (SELECT genus FROM obs GROUP BY genus ORDER BY count(*) DESC, genus LIMIT 1), f AS (SELECT {FAMILY} FROM obs GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) SELECT count(*) AS trees, count(species) AS identified, count(DISTINCT species) AS species, round(avg((part_key % 7 = 1)::INT), 6) AS biome_fit, round(sum(pi() * (crown_width_m / 2) ** 2), 2) AS canopy_m2, (FROM g) AS top_genus, (FROM f) AS top_family FROM obs")
def _(v: Views) -> DataFrame:
    r = v.rollups.answer({"genus": F.split_part("species", F.lit(" "), F.lit(1)), "species": F.col("species")}, ["species"], ["trees", "fit", "canopy"]).withColumnRenamed("trees", "n")
    by_genus = r.groupBy(F.expr(FAMILY).alias("family"), "genus").agg(F.sum("n").alias("n"), F.count("species").alias("kinds"), F.sum("fit").alias("fit"), F.sum("canopy").alias("canopy"), F.sum(F.when(F.col("species").isNotNull(), F.col("n"))).alias("named"))
    figures = ("n", "kinds", "fit", "canopy", "named")
    by_family = by_genus.groupBy("family").agg(*[F.sum(c).alias(c) for c in figures], F.min(F.struct((-F.col("n")).alias("n"), "genus")).alias("top"))
    return by_family.agg(F.sum("n").alias("trees"), F.sum("named").alias("identified"), F.sum("kinds").alias("species"), F.round(F.sum("fit") / F.sum("n"), 6).alias("biome_fit"), F.round(F.sum("canopy"), 2).alias("canopy_m2"), F.min("top")["genus"].alias("top_genus"), F.min_by("family", F.struct(-F.col("n"), "family")).alias("top_family"))


@query("b2_sources_breakdown", f"WITH {{OBS}} SELECT {KIND} AS kind, count(*) AS trees, count_if(dbh IS NULL) AS no_dbh FROM obs GROUP BY 1")
def _(v: Views) -> DataFrame:
    return v.rollups.answer({"kind": F.col("kind")}, ["kind"], ["trees", "no_dbh"])


@query("b3_species_profiles", "WITH {OBS}, n AS (SELECT species, count(*) AS trees, round(sum(pi() * (crown_width_m / 2) ** 2), 4) AS canopy_m2 FROM obs GROUP BY species), d AS (SELECT lower(p_name) AS k, max(p_retailprice) AS price FROM part GROUP BY 1) SELECT species, trees, canopy_m2, price FROM n LEFT JOIN d ON lower(species) = k ORDER BY trees DESC, species LIMIT 20")
def _(v: Views) -> DataFrame:
    n = v.obs.groupBy("species").agg(F.count("*").alias("trees"), F.round(F.sum(F.pi() * (F.col("crown_width_m") / 2) ** 2), 4).alias("canopy_m2"))
    d = v.table("part").groupBy(F.lower("p_name").alias("k")).agg(F.max("p_retailprice").alias("price"))
    return n.join(d, F.lower("species") == F.col("k"), "left").select("species", "trees", "canopy_m2", "price").orderBy(F.desc("trees"), "species").limit(20)


@query("b4_planting_years", "WITH {OBS} SELECT year(plant_date)::INT AS year, CASE WHEN year(plant_date) >= 2000 THEN 'young' WHEN year(plant_date) >= 1997 THEN 'growing' ELSE 'old' END AS age_window, count(*) AS trees FROM obs GROUP BY ALL")
def _(v: Views) -> DataFrame:
    y = F.col("plant_year")
    return v.rollups.answer({"year": y, "age_window": F.when(y >= 2000, "young").when(y >= 1997, "growing").otherwise("old")}, ["plant_year"], ["trees"])


@query("b5_recent_plantings", "WITH {OBS} SELECT species, count(*) AS trees FROM obs WHERE plant_date >= DATE '2001-01-01' GROUP BY species ORDER BY trees DESC, species LIMIT 8")
def _(v: Views) -> DataFrame:
    return rollups.count_by(v.obs.where("plant_date >= date '2001-01-01'"), "species").orderBy(F.desc("trees"), "species").limit(8)


@query("b6_bucket_counts", f"WITH {{OBS}}, w AS (SELECT *, crown_width_m AS width FROM obs) SELECT 'dbh' AS kind, {DBH} AS bucket, count(*) AS trees FROM w GROUP BY 2 UNION ALL SELECT 'crown', {CROWN}, count(*) FROM w GROUP BY 2 UNION ALL SELECT 'form', CASE size_class % 3 WHEN 0 THEN 'palm' WHEN 1 THEN 'conifer' ELSE 'broad' END, count(*) FROM w GROUP BY 2 UNION ALL SELECT 'growth', CASE part_key % 3 WHEN 0 THEN 'slow' WHEN 1 THEN 'medium' END, count(*) FROM w GROUP BY 2 UNION ALL SELECT 'wildlife', CASE WHEN part_key % 5 = 0 THEN 'high' ELSE 'low' END, count(*) FROM w GROUP BY 2 UNION ALL SELECT 'fire', CASE WHEN part_key % 11 < 4 THEN 'resistant' ELSE 'flammable' END, count(*) FROM w GROUP BY 2")
def _(v: Views) -> DataFrame:
    asked = {"dbh": "dbh_class", "crown": "crown_class", "form": "form", "growth": "growth", "wildlife": "wildlife", "fire": "fire"}
    each = [v.rollups.answer({"kind": F.lit(kind), "bucket": F.col(c)}, [c], ["trees"]) for kind, c in asked.items()]
    return reduce(DataFrame.unionByName, each)


@query("b7_nativeness", "SELECT CASE WHEN 3 IN (p_partkey % 7, p_partkey % 11) THEN 'ecoregion' WHEN 5 IN (p_partkey % 7, p_partkey % 11) THEN 'biome' WHEN 6 IN (p_partkey % 7, p_partkey % 11) THEN 'realm' ELSE 'introduced' END AS nativeness, count(*) AS species FROM part GROUP BY 1")
def _(v: Views) -> DataFrame:
    native = F.array(F.col("p_partkey") % 7, F.col("p_partkey") % 11)
    b = F.when(F.array_contains(native, 3), "ecoregion").when(F.array_contains(native, 5), "biome").when(F.array_contains(native, 6), "realm").otherwise("introduced")
    return v.table("part").groupBy(b.alias("nativeness")).agg(F.count("*").alias("species"))


@query("b8_trait_buckets", "SELECT CASE WHEN p_size < 10 THEN 'short' WHEN p_size < 30 THEN 'medium' ELSE 'long' END AS lifespan, list_contains([p_partkey % 3, p_partkey % 5], 2) AS full_sun, CASE WHEN p_size // 5 BETWEEN 3 AND 6 THEN 'fits' WHEN p_size // 5 < 3 THEN 'hardier' ELSE 'tender' END AS hardiness, CASE p_partkey % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' END AS water, count(*) AS species FROM part GROUP BY ALL")
def _(v: Views) -> DataFrame:
    k, zone = F.col("p_partkey"), F.floor(F.col("p_size") / 5)
    sun = F.exists(F.array(k % 3, k % 5), lambda x: x == 2)
    hardiness = F.when(zone.between(3, 6), "fits").when(zone < 3, "hardier").otherwise("tender")
    water = F.when(k % 4 == 0, "low").when(k % 4 == 1, "medium").when(k % 4 == 2, "high")
    lifespan = F.when(F.col("p_size") < 10, "short").when(F.col("p_size") < 30, "medium").otherwise("long")
    return rollups.count_by(v.table("part"), lifespan.alias("lifespan"), sun.alias("full_sun"), hardiness.alias("hardiness"), water.alias("water")).withColumnRenamed("trees", "species")


@query("b9_species_options", "WITH {OBS}, n AS (SELECT 'species' AS kind, species AS name, count(*) AS trees FROM obs GROUP BY 2 UNION ALL SELECT 'genus', genus, count(*) FROM obs GROUP BY 2) SELECT *, rank() OVER (PARTITION BY kind ORDER BY trees DESC)::INT AS rank FROM n")
def _(v: Views) -> DataFrame:
    kinds = F.inline(F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).alias("name")) for c in ("species", "genus")]))
    return rollups.count_by(v.obs.select(kinds), "kind", "name").withColumn("rank", F.rank().over(Window.partitionBy("kind").orderBy(F.desc("trees"))))


@query("b9_presence", "WITH {OBS} SELECT city, part_key % 7 = 3 AS native, count(*) AS trees, count(DISTINCT species) AS species FROM obs GROUP BY ALL")
def _(v: Views) -> DataFrame:
    return v.obs.groupBy("city", (F.col("part_key") % 7 == 3).alias("native")).agg(F.count("*").alias("trees"), F.countDistinct("species").alias("species"))


@query("b10_dot_map", "WITH {OBS} SELECT floor(latitude * 1000)::BIGINT AS cy, floor(longitude * 1000)::BIGINT AS cx, count(*) AS trees FROM obs GROUP BY ALL")
def _(v: Views) -> DataFrame:
    return rollups.count_by(v.obs, F.floor(F.col("latitude") * 1000).alias("cy"), F.floor(F.col("longitude") * 1000).alias("cx"))


@query("b11_city_diversity", "WITH {OBS}, n AS (SELECT coalesce(city, '(all)') AS city, species, count(*) AS trees FROM obs GROUP BY GROUPING SETS ((city, species), (species))) SELECT city, sum(trees)::BIGINT AS trees, count(*) AS species, arg_min(species, (-trees, species)) AS top_species FROM n GROUP BY city")
def _(v: Views) -> DataFrame:
    n = v.rollups.answer({"city": F.col("city"), "species": F.col("species")}, ["city", "species"], ["trees"])
    both = n.unionByName(rollups.re_aggregated(n, "species").withColumn("city", F.lit("(all)")))
    return both.groupBy("city").agg(F.sum("trees").alias("trees"), F.count("*").alias("species"), F.min_by("species", F.struct(-F.col("trees"), "species")).alias("top_species"))


@query("b12_species_catalogue", "WITH {OBS}, n AS (SELECT species, count(*) AS trees, median(dbh) AS dbh, CASE WHEN count(plant_date) >= 900 THEN median(year(plant_date)) END AS year FROM obs GROUP BY species) SELECT species, trees, rank() OVER (ORDER BY trees DESC)::INT AS rank, round(trees / sum(trees) OVER (), 6) AS share, dbh, year FROM n")
def _(v: Views) -> DataFrame:
    n = v.obs.groupBy("species").agg(F.count("*").alias("trees"), F.percentile("dbh", F.lit(0.5)).alias("dbh"), F.when(F.count("plant_date") >= 900, F.percentile(F.year("plant_date"), F.lit(0.5))).alias("year"))
    total = n.agg(F.sum("trees").alias("total"))
    ranked = rank.ranked(n, [F.desc("trees")], "rank").crossJoin(F.broadcast(total))
    return ranked.select("species", "trees", "rank", F.round(F.col("trees") / F.col("total"), 6).alias("share"), "dbh", "year")


def shown(v: Views) -> DataFrame:
    """Published trees with their cluster, missing flag and positions, some of which are not finite."""
    k, part = F.col("order_key"), F.col("part_key")
    odd = F.when(k % 101 == 0, float("inf")).when(k % 103 == 0, float("nan")).when(k % 107 == 0, None).otherwise(F.col("latitude"))
    return v.obs.select("tree_id", "data_source", odd.alias("latitude"), "longitude", F.when(part % 13 == 0, F.concat("tree_id", F.lit("x"))).when(part % 17 > 0, F.col("tree_id")).alias("cluster_id"), F.when(part % 3 > 0, k % 50 == 0).alias("missing"), (F.col("supp_key") % 9 == 2).alias("duplicate"))


@query("b13_visible_trees", f"WITH {{OBS}}, t AS (SELECT tree_id, {KIND} AS kind, unnest(['municipal', 'reviewed', 'all']) AS mode FROM obs WHERE order_key % 101 > 0 AND order_key % 103 > 0 AND order_key % 107 > 0 AND part_key % 13 > 0 AND NOT (part_key % 3 > 0 AND order_key % 50 = 0) AND supp_key % 9 <> 2), l AS (SELECT t.*, tree_id IN (SELECT tree_id FROM obs WHERE line = 5) AS notable FROM t) SELECT mode, tree_id FROM l WHERE mode = 'all' OR (mode = 'municipal' AND kind = 'municipal' AND NOT notable) OR (mode = 'reviewed' AND kind NOT IN ('satellite', 'predicted'))")
def _(v: Views) -> DataFrame:
    kinds = {"municipal": ["municipal"], "reviewed": ["municipal", "community", "osm", "notable"], "all": None}
    each = [quality.visible(shown(v), allowed).select(F.lit(mode).alias("mode"), "tree_id") for mode, allowed in kinds.items()]
    return reduce(DataFrame.unionByName, each)


@query("b12_city_catalogue", "WITH {OBS}, n AS (SELECT city, species, count(*) AS trees, max(dbh) AS largest FROM obs GROUP BY ALL) SELECT city, species, trees, largest, round(trees / sum(trees) OVER (PARTITION BY city), 6) AS share_of_city, round(trees / sum(trees) OVER (PARTITION BY species), 6) AS share_of_species, rank() OVER (PARTITION BY city ORDER BY trees DESC)::INT AS rank FROM n")
def _(v: Views) -> DataFrame:
    """Each species in each city, from the stored rollup: its share of the city's trees and the city's share of the species."""
    n = v.rollups.answer({"city": F.col("city"), "species": F.col("species")}, ["city", "species"], ["trees", "largest"])
    of = lambda key, name: (F.col("trees") / F.sum("trees").over(Window.partitionBy(key))).alias(name)
    place = F.rank().over(Window.partitionBy("city").orderBy(F.desc("trees"))).alias("rank")
    return n.select("city", "species", "trees", "largest", F.round(of("city", "s"), 6).alias("share_of_city"), F.round(of("species", "s"), 6).alias("share_of_species"), place)


BLOCKS = f"{{OBS}}, tl AS (SELECT *, {TILE.format(n=1 << 20)} FROM obs), bl AS (SELECT *, ((x >> 4) << 24) | (y >> 4) AS block FROM tl)"


@query("w1_block_keys", f"WITH {BLOCKS} SELECT tree_id, block, (((x & 1) | ((y & 1) << 1)) | (((x & 2) << 1) | ((y & 2) << 2)) | (((x & 4) << 2) | ((y & 4) << 3)) | (((x & 8) << 3) | ((y & 8) << 4))) AS morton FROM bl")
def _(v: Views) -> DataFrame:
    return blocks.with_block(v.obs, 20, 4).select("tree_id", "block", "morton")


@query("w2_block_files", f"WITH {BLOCKS} SELECT tree_id, ((x >> 12) << 24) | (y >> 12) AS block FROM bl")
def _(v: Views) -> DataFrame:
    path = scratch(v.spark, "blocks")
    blocks.write_blocks(blocks.with_block(v.obs, 20, 12).select("tree_id", "block", "morton"), path)
    return v.spark.read.parquet(path).select("tree_id", F.col("block").cast("long").alias("block"))


@query("s9_published_blocks", f"WITH {BLOCKS} SELECT ((x >> 12) << 24) | (y >> 12) AS block, city, count(*) AS rows, sum(('0x' || substr(md5(concat_ws('|', coalesce(length(tree_id) || '=' || tree_id, 'null'), coalesce(length(species) || '=' || species, 'null'))), 1, 12))::BIGINT)::BIGINT AS content FROM bl GROUP BY ALL")
def _(v: Views) -> DataFrame:
    path = scratch(v.spark, "published")
    blocks.write_blocks(blocks.with_block(v.obs, 20, 12).select("tree_id", "city", "species", "block", "morton"), path)
    return blocks.manifest(v.spark.read.parquet(path).withColumn("block", F.col("block").cast("long")), ["tree_id", "species"])


@query("s9_vocabulary", "WITH {OBS} SELECT DISTINCT kind, value FROM (UNPIVOT (SELECT city, species, cultivar, data_source FROM obs) ON city, species, cultivar, data_source INTO NAME kind VALUE value)")
def _(v: Views) -> DataFrame:
    path = scratch(v.spark, "vocabulary")
    blocks.write_vocabulary(v.obs, ["city", "species", "cultivar", "data_source"], path)
    return v.spark.read.parquet(path)


@query("w3_block_manifest", f"WITH {BLOCKS} SELECT block, city, count(*) AS rows, sum(('0x' || substr(md5(concat_ws('|', coalesce(length(tree_id) || '=' || tree_id, 'null'), coalesce(length(species) || '=' || species, 'null'))), 1, 12))::BIGINT)::BIGINT AS content FROM bl GROUP BY ALL")
def _(v: Views) -> DataFrame:
    return blocks.manifest(blocks.with_block(v.obs, 20, 4), ["tree_id", "species"])


@query("w4_manifest_comparison", f"WITH {BLOCKS}, o AS (SELECT block, city, count(*) AS n FROM bl WHERE city <> 'c1' GROUP BY ALL), n AS (SELECT block, city, count(*) AS n FROM bl WHERE city <> 'c2' AND order_key % 100 <> 0 GROUP BY ALL) SELECT coalesce(o.block, n.block) AS block, coalesce(o.city, n.city) AS city, CASE WHEN o.n IS NULL THEN 'added' WHEN n.n IS NULL THEN 'removed' ELSE 'changed' END AS change FROM o FULL JOIN n ON o.block = n.block AND o.city = n.city WHERE o.n IS NULL OR n.n IS NULL OR o.n <> n.n")
def _(v: Views) -> DataFrame:
    b = blocks.with_block(v.obs, 20, 4)
    m = lambda df: blocks.manifest(df, ["tree_id", "species"])
    return blocks.compare_manifests(m(b.where("city <> 'c1'")), m(b.where("city <> 'c2' and order_key % 100 <> 0")))


@query("w4_incremental_publish", f"""WITH {BLOCKS}, o AS (SELECT block, count(*) AS n FROM bl WHERE order_key % 97 <> 0 OR block % 3 > 0 GROUP BY block), n AS (SELECT block, count(*) AS n, count(DISTINCT city) AS cities FROM bl GROUP BY block)
SELECT n.block, n.n AS rows, n.cities, CASE WHEN o.n IS NULL OR o.n <> n.n THEN 2 ELSE 1 END AS generation FROM n LEFT JOIN o USING (block)""")
def _(v: Views) -> DataFrame:
    """Two generations, the second with some rows more: what readers see, and which generation holds each block."""
    rows = blocks.with_block(v.obs, 20, 4).select("tree_id", "city", "species", "block", "morton", "order_key")
    out = publish.Publication(v.spark, scratch(v.spark, "publication"), ["tree_id", "species"])
    out.publish(rows.where("order_key % 97 <> 0 or block % 3 > 0"))
    out.publish(rows)
    seen = out.read().groupBy("block").agg(F.count("*").alias("rows"), F.countDistinct("city").alias("cities"))
    return seen.join(out.manifest().select("block", "generation").distinct(), "block").select("block", "rows", "cities", "generation")


@query("w4_stale_objects", "SELECT concat('o', o_orderkey) AS name FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 30)")
def _(v: Views) -> DataFrame:
    name = lambda c: F.concat(F.lit("o"), F.col(c)).alias("name")
    named = v.table("lineitem").where("l_quantity > 30").select(name("l_orderkey"))
    return blocks.stale_objects(v.table("orders").select(name("o_orderkey"), F.col("o_orderdate").alias("stamp")), named, F.lit("1996-01-01").cast("timestamp")).select("name")
