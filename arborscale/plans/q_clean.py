"""Queries of the scan and cleaning operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborscale.functions.lineage import scratch
from arborscale.operators import clean
from arborscale.plans.registry import Views, query
from arborscale.sources import scans


@query("entry_city_dbh_classes", """WITH {OBS} SELECT city, CASE WHEN dbh < 6 THEN '<6' WHEN dbh < 12 THEN '6-12' WHEN dbh < 24 THEN '12-24' WHEN dbh < 36 THEN '24-36' WHEN dbh IS NOT NULL THEN '36+' END AS dbh_class,
count(*) AS trees FROM obs GROUP BY ALL""")
def _(v: Views) -> DataFrame:
    from arborscale.operators import rollups

    return rollups.count_by(v.obs.withColumn("dbh_class", rollups.dbh_class(F.col("dbh"))), "city", "dbh_class")


@query("s1_multi_file_scan", "SELECT 'orders' AS kind, count(*) AS n, min(o_orderkey) AS least FROM orders UNION ALL SELECT 'customer', count(*), min(c_custkey) FROM customer")
def _(v: Views) -> DataFrame:
    one = scans.read_files(v.spark, [f"{v.sf_dir}/orders.parquet", f"{v.sf_dir}/customer.parquet"])
    kind = F.when(F.col("o_orderkey").isNotNull(), "orders").otherwise("customer")
    return one.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.min(F.coalesce("o_orderkey", "c_custkey")).alias("least"))


@query("s2_optional_columns", "SELECT s_suppkey, s_name, NULL::DOUBLE AS height_m FROM supplier")
def _(v: Views) -> DataFrame:
    return scans.with_columns(v.table("supplier"), required=["s_suppkey", "s_name"], optional={"height_m": "double"})


@query("s3_csv_null_token", "SELECT p_partkey, CASE WHEN p_partkey % 3 > 0 THEN p_brand END AS brand FROM part")
def _(v: Views) -> DataFrame:
    path = scratch(v.spark, "csv")
    v.table("part").select("p_partkey", F.when(F.col("p_partkey") % 3 > 0, F.col("p_brand")).alias("brand")).write.csv(path, header=True, nullValue="NA")
    return scans.read_csv(v.spark, path, "p_partkey long, brand string")


@query("s8_sorted_sink", "SELECT o_custkey, o_orderkey, o_totalprice FROM orders")
def _(v: Views) -> DataFrame:
    path = scratch(v.spark, "sorted")
    scans.write_sorted(v.table("orders").select("o_custkey", "o_orderkey", "o_totalprice"), path, ["o_custkey", "o_orderkey"], 8)
    return v.spark.read.parquet(path)


@query("s4_ndjson_records", "SELECT event_id, (props::JSON ->> 'k')::BIGINT AS k, NULL::VARCHAR AS missing FROM events")
def _(v: Views) -> DataFrame:
    return scans.json_records(v.table("events"), "props", "k long, missing string").select("event_id", "k", "missing")


@query("s5_tag_records", "SELECT concat('osm-', p_partkey) AS tree_id, coalesce(CASE WHEN p_partkey % 3 = 0 THEN p_name END, p_type) AS species, CASE WHEN p_partkey % 2 = 0 THEN p_brand END AS cultivar FROM part")
def _(v: Views) -> DataFrame:
    tags = F.to_json(F.create_map(F.lit("genus"), F.col("p_type"), F.lit("species"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")), F.lit("taxon:cultivar"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand"))))
    return scans.tag_records(v.table("part").select(F.col("p_partkey").cast("string").alias("id"), tags.alias("tags")), "osm-").select("tree_id", "species", "cultivar")


@query("s6_partition_pruned_read", "WITH {OBS} SELECT tree_id, species FROM obs WHERE city = 'c3'")
def _(v: Views) -> DataFrame:
    path = scratch(v.spark, "by-city")
    scans.write_by_city(v.obs.select("tree_id", "species", "city"), path)
    return scans.read_city(v.spark, path, "c3").select("tree_id", "species")


@query("s7_territory_filter", "WITH {OBS} SELECT tree_id FROM obs WHERE (latitude >= 40.002 AND latitude < 40.006 AND longitude >= -71.01 AND longitude < -71.002) OR (latitude >= 40.015 AND latitude < 40.02 AND longitude >= -71.02 AND longitude < -71.015)")
def _(v: Views) -> DataFrame:
    return v.obs.where(scans.in_boxes(F.col("latitude"), F.col("longitude"), [(40.002, 40.006, -71.01, -71.002), (40.015, 40.02, -71.02, -71.015)])).select("tree_id")


@query("s11_wkt_centroid", """WITH g AS (SELECT p_partkey, p_partkey % 50 AS x, p_size % 7 AS y, p_size * 2.0 AS a, CASE WHEN p_partkey % 3 < 2 THEN 0.25 ELSE 0 END AS h, CASE WHEN p_partkey % 3 = 0 THEN 4.0 ELSE 0 END AS b, p_size, p_partkey % 15 = 2 AS other FROM part)
SELECT p_partkey, CASE WHEN NOT other THEN round((a * (x + p_size / 2.0) - h * (x + 0.5) + b * (x + 101)) / (a - h + b), 6) END AS x, CASE WHEN NOT other THEN round((a * (y + 1) - h * (y + 0.75) + b * (y + 1)) / (a - h + b), 6) END AS y FROM g""")
def _(v: Views) -> DataFrame:
    x0, y0, kind = F.col("p_partkey") % 50, F.col("p_size") % 7, F.col("p_partkey") % 3

    def box(x, y, width, height):
        corner = lambda a, b: F.concat_ws(" ", a, b)
        return F.concat(F.lit("("), F.concat_ws(", ", corner(x, y), corner(x + width, y), corner(x + width, y + height), corner(x, y + height), corner(x, y)), F.lit(")"))

    outer, hole, far = box(x0, y0, F.col("p_size"), 2), box(x0 + 0.25, y0 + 0.5, 0.5, 0.5), box(x0 + 100, y0, 2, 2)
    holed = F.concat(F.lit("("), outer, F.lit(", "), hole, F.lit(")"))
    wkt = F.when(kind == 0, F.concat(F.lit("MULTIPOLYGON ("), holed, F.lit(", ("), far, F.lit("))"))).when(kind == 1, F.concat(F.lit("POLYGON "), holed))
    wkt = F.when(F.col("p_partkey") % 15 == 2, "POINT (1 2)").otherwise(F.coalesce(wkt, F.concat(F.lit("POLYGON ("), outer, F.lit(")"))))
    c = scans.wkt_centroid(wkt)
    return v.table("part").select("p_partkey", F.round(c["x"], 6).alias("x"), F.round(c["y"], 6).alias("y"))


@query("c1_enforce_schema", "SELECT count_if(o_orderpriority IS NOT NULL AND try_cast(o_orderpriority AS BIGINT) IS NULL) AS lossy_o_orderpriority, 0::BIGINT AS lossy_o_orderkey, count_if(o_orderkey IS NULL) AS null_o_orderkey FROM orders")
def _(v: Views) -> DataFrame:
    return clean.enforce_schema(v.table("orders"), {"o_orderkey": "bigint", "o_orderpriority": "bigint", "note": "string"}, ["o_orderkey"])[1]


@query("c2_species_text", r"SELECT p_partkey, concat(upper(substr(p_name, 1, 1)), lower(substr(p_name, 2))) AS species FROM part")
def _(v: Views) -> DataFrame:
    messy = F.concat(F.upper("p_name"), F.when(F.col("p_partkey") % 2 == 0, ":: old").otherwise(" - planted"))
    return v.table("part").select("p_partkey", clean.species_text(messy).alias("species"))


@query("c3_binomial", "SELECT p_partkey, CASE WHEN p_partkey % 5 > 0 THEN concat(p_type, CASE WHEN p_partkey % 3 > 0 THEN concat(' ', p_brand) ELSE '' END) END AS species FROM part")
def _(v: Views) -> DataFrame:
    return v.table("part").select("p_partkey", clean.binomial(F.when(F.col("p_partkey") % 5 > 0, F.col("p_type")).otherwise("  "), F.when(F.col("p_partkey") % 3 > 0, F.col("p_brand"))).alias("species"))


@query("c4_drop_non_trees", "SELECT p_partkey FROM part WHERE p_name NOT IN ('red bolt', 'old bolt') AND NOT starts_with(p_name, 'small')")
def _(v: Views) -> DataFrame:
    odd = F.concat(F.initcap("p_name"), F.when(F.col("p_partkey") % 2 == 0, "(s)").otherwise(""))
    return v.table("part").where(~clean.is_non_tree(odd, ["red bolt", "old bolt"], ["small"])).select("p_partkey")


@query("c5_accepted_shape", """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN concat(upper(p_name[1]), substr(p_name, 2)) WHEN 1 THEN concat(upper(p_name[1]), split_part(substr(p_name, 2), ' ', 1))
WHEN 2 THEN concat(upper(p_name[1]), split_part(substr(p_name, 2), ' ', 1), ' x ', split_part(p_name, ' ', 2)) END AS species FROM part""")
def _(v: Views) -> DataFrame:
    name, first, second = F.initcap(F.split_part("p_name", F.lit(" "), F.lit(1))), F.initcap(F.split_part("p_name", F.lit(" "), F.lit(1))), F.split_part("p_name", F.lit(" "), F.lit(2))
    k = F.col("p_partkey") % 4
    text = F.when(k == 0, F.concat(first, F.lit(" (Mill.) "), second, F.lit(" var. alba"))).when(k == 1, F.concat(first, F.lit(" spp."))).when(k == 2, F.concat(first, F.lit(" × "), second)).otherwise("123 stump")
    return v.table("part").select("p_partkey", clean.accepted_shape(text).alias("species"))


@query("c6_fold_synonyms", "WITH {OBS} SELECT tree_id, CASE species WHEN 'Red bolt' THEN 'Old bolt' WHEN 'Hot gear' THEN 'Blue gear' ELSE species END AS species FROM obs")
def _(v: Views) -> DataFrame:
    return clean.mapped(v.obs, "species", {"Red bolt": "Old bolt", "Hot gear": "Blue gear"}).select("tree_id", "species")


@query("c7_growth_form_fallback", "SELECT p_partkey, CASE p_type WHEN 'SMALL' THEN 'Shrub' WHEN 'PROMO' THEN 'Palm' ELSE 'Unknown' END AS form FROM part")
def _(v: Views) -> DataFrame:
    return clean.mapped(v.table("part"), "p_type", {"SMALL": "Shrub", "PROMO": "Palm"}, "form", F.lit("Unknown")).select("p_partkey", "form")


@query("c8_quoted_cultivar", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'Given' WHEN p_partkey % 3 = 1 THEN p_brand END AS cultivar FROM part")
def _(v: Views) -> DataFrame:
    k = F.col("p_partkey") % 3
    name = F.when(k < 2, F.concat(F.lit("Acer ‘"), F.col("p_brand"), F.when(F.col("p_partkey") % 2 == 0, "’").otherwise(""))).otherwise("Acer plain")
    return v.table("part").select("p_partkey", clean.quoted_cultivar(name, F.when(k == 0, "Given").otherwise(" ")).alias("cultivar"))


@query("c9_implausible_numbers", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_quantity > 5 AND l_quantity <= 40 THEN l_quantity END AS dbh FROM lineitem")
def _(v: Views) -> DataFrame:
    return v.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", clean.within(F.col("l_quantity"), 5, 40).alias("dbh"))


@query("c9_nulled_counts", "SELECT count_if(l_quantity <= 5 OR l_quantity > 40) AS nulled_l_quantity, count_if(l_discount <= 0 OR l_discount > 0.05) AS nulled_l_discount FROM lineitem")
def _(v: Views) -> DataFrame:
    return clean.null_implausible(v.table("lineitem"), {"l_quantity": (5, 40), "l_discount": (0, 0.05)})[1]


@query("c10_implausible_dates", "SELECT o_orderkey, CASE WHEN o_orderdate::DATE <= DATE '1998-06-30' THEN o_orderdate::DATE END AS planted FROM orders")
def _(v: Views) -> DataFrame:
    return v.table("orders").select("o_orderkey", clean.plausible_date(F.to_date("o_orderdate"), F.lit("1998-06-30").cast("date")).alias("planted"))


@query("c11_null_repeated_names", "SELECT c_custkey, CASE WHEN count(*) OVER (PARTITION BY name) <= 3 THEN name END AS name FROM (SELECT *, concat('n', c_custkey % 400) AS name FROM customer)")
def _(v: Views) -> DataFrame:
    return clean.null_repeated(v.table("customer").withColumn("name", F.concat(F.lit("n"), F.col("c_custkey") % 400)), "name").select("c_custkey", "name")


@query("c12_units", "SELECT p_partkey, CASE WHEN p_size % 3 > 0 THEN make_date(1900 + p_size, 1, 1) END AS planted, round(p_retailprice / pi() / 2.54, 6) AS from_circumference, round(nullif(p_size, 0) / 2.54, 6) AS from_cm FROM part")
def _(v: Views) -> DataFrame:
    return v.table("part").select("p_partkey", clean.year_date(F.when(F.col("p_size") % 3 > 0, 1900 + F.col("p_size")).otherwise(0)).alias("planted"), F.round(clean.circumference_cm_to_inches(F.col("p_retailprice")), 6).alias("from_circumference"), F.round(clean.cm_to_inches(F.col("p_size").cast("double")), 6).alias("from_cm"))


@query("c13_measurements", "SELECT p_partkey, round(CASE p_partkey % 4 WHEN 0 THEN p_size + 0.5 WHEN 1 THEN p_size / 100 WHEN 2 THEN CASE WHEN p_size > 10 THEN p_size / 100 ELSE p_size END WHEN 3 THEN p_size * 0.3048 END, 6) AS metres FROM part")
def _(v: Views) -> DataFrame:
    k, n = F.col("p_partkey") % 4, F.col("p_size")
    text = F.when(k == 0, F.concat(n, F.lit(",5 m"))).when(k == 1, F.concat(n, F.lit("cm"))).when(k == 2, n.cast("string")).otherwise(F.concat(n, F.lit(" FT")))
    return v.table("part").select("p_partkey", F.round(clean.measurement_m(text, 10), 6).alias("metres"))


@query("c13_leading_year", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 3 THEN year(o_orderdate)::INT END AS planted FROM orders")
def _(v: Views) -> DataFrame:
    k, day = F.col("o_orderkey") % 4, F.date_format("o_orderdate", "yyyy")
    text = F.when(k == 0, day).when(k == 1, F.concat(F.lit(" "), day, F.lit("-05?"))).when(k == 2, F.concat(day, F.lit(" or so"))).otherwise(F.concat(day, F.lit("12")))
    return v.table("orders").select("o_orderkey", clean.leading_year(text).alias("planted"))


@query("c14_unknown_labels", "SELECT o_orderpriority, count(*) AS rows FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '5-LOW') GROUP BY 1")
def _(v: Views) -> DataFrame:
    return clean.unknown_labels(v.table("orders"), "o_orderpriority", ["1-URGENT", "2-HIGH", "5-LOW"])


@query("c14_bucket_midpoint", "SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 3.0 WHEN '2-HIGH' THEN 9.0 WHEN '5-LOW' THEN 18.0 END AS midpoint FROM orders")
def _(v: Views) -> DataFrame:
    return clean.mapped(v.table("orders"), "o_orderpriority", {"1-URGENT": "3.0", "2-HIGH": "9.0", "5-LOW": "18.0"}, "midpoint", F.lit(None).cast("string")).select("o_orderkey", F.col("midpoint").cast("double").alias("midpoint"))


@query("c15_free_text", r"SELECT doc_id, nullif(rtrim(left(trim(regexp_replace(text, '\s+', ' ', 'g')), 80)), '') AS note FROM documents")
def _(v: Views) -> DataFrame:
    return v.table("documents").select("doc_id", clean.free_text(F.col("text"), 80).alias("note"))


@query("c16_gated_label", "WITH {OBS} SELECT tree_id, CASE WHEN dbh >= 40 THEN species WHEN crown_width_m >= 8 THEN genus WHEN line % 2 = 0 THEN 'Unknown deciduous' END AS label FROM obs")
def _(v: Views) -> DataFrame:
    o = v.obs
    return o.select("tree_id", clean.gated_label(F.col("species"), F.col("dbh") / 50, F.col("genus"), F.col("crown_width_m") / 10, F.when(F.col("line") % 2 == 0, "deciduous")).alias("label"))


@query("c17_source_kind", "WITH {OBS} SELECT tree_id, CASE line WHEN 1 THEN 'community' WHEN 2 THEN 'osm' WHEN 3 THEN 'satellite' WHEN 4 THEN 'predicted' WHEN 5 THEN 'notable' ELSE 'municipal' END AS kind FROM obs")
def _(v: Views) -> DataFrame:
    return v.obs.select("tree_id", clean.source_kind(F.col("data_source")).alias("kind"))


@query("c18_common_names", "SELECT p_partkey, concat(upper(p_name[1]), substr(p_name, 2), '|', upper(p_type[1]), lower(substr(p_type, 2)), ' ''Autumn BLAZE''|Rocky Mountain ', p_name, '|''Red Sunset'' Douglas-fir|St. John''s wort') AS names FROM part")
def _(v: Views) -> DataFrame:
    raw = F.array(F.regexp_replace("p_name", " ", "   "), F.lit("  "), F.upper("p_name"), F.concat("p_type", F.lit(" 'Autumn BLAZE'")), F.concat(F.lit("ROCKY mountain "), F.upper("p_name")), F.lit("'RED SUNSET' douglas-FIR"), F.lit("ST. JOHN'S WORT"))
    return v.table("part").select("p_partkey", F.array_join(clean.common_names(raw, ["Douglas", "John"], ["Rocky Mountain", "St. John"]), "|").alias("names"))


#: A slug that another name owns: its number is passed over.
@query("c19_slugs", """WITH n AS (SELECT p_partkey, concat(replace(lower(p_name), ' ', '-'), CASE WHEN p_partkey % 97 = 0 THEN '-3' ELSE '' END) AS s FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY p_partkey) AS r FROM n),
f AS (SELECT DISTINCT s AS three FROM n WHERE s LIKE '%-3') SELECT p_partkey, CASE WHEN r = 1 THEN s WHEN concat(s, '-3') IN (FROM f) AND r >= 3 THEN concat(s, '-', r + 1) ELSE concat(s, '-', r) END AS slug FROM r""")
def _(v: Views) -> DataFrame:
    name = F.concat("p_name", F.when(F.col("p_partkey") % 97 == 0, " (3)").otherwise(""))
    return clean.slugs(v.table("part").withColumn("name", name), "name", ["p_partkey"]).select("p_partkey", "slug")


@query("c20_filter_alternatives", "WITH {OBS} SELECT tree_id FROM obs WHERE genus IN ('Red', 'Blue') AND city IN ('c1', 'c2', 'c3')")
def _(v: Views) -> DataFrame:
    return clean.any_of_each(v.obs, {"genus": ["Red", "Blue"], "city": ["c1", "c2", "c3"], "species": []}).select("tree_id")


@query("c21_rule_colours", "WITH {OBS} SELECT tree_id, min(cultivar) AS colour FROM obs WHERE dbh > 45 AND city <> 'c5' GROUP BY tree_id")
def _(v: Views) -> DataFrame:
    return clean.rule_colours(v.obs, F.col("dbh") > 45, F.col("cultivar"), v.obs.where(F.col("city") == "c5"))


BARE = "CASE WHEN away < 24 THEN [] WHEN away < 28 THEN [1] WHEN away < 34 THEN [12, 1, 2] WHEN away < 55 THEN [12, 1, 2, 3] ELSE [11, 12, 1, 2, 3, 4] END"
AUTUMN = "CASE WHEN away < 24 THEN [] WHEN away < 28 THEN [11, 12] WHEN away < 34 THEN [10, 11] WHEN away < 55 THEN [9, 10, 11] ELSE [9, 10] END"


@query("c22_foliage_phase", f"""WITH d AS (SELECT c_custkey, (c_custkey * 7 % 181 - 90)::BIGINT AS degree, (c_nationkey % 12 + 1)::BIGINT AS m FROM customer), n AS (SELECT *, CASE WHEN degree >= 0 THEN degree ELSE -degree - 1 END AS away, CASE WHEN degree < 0 THEN (m + 5) % 12 + 1 ELSE m END AS n FROM d)
SELECT c_custkey, CASE WHEN list_contains({BARE}, n) THEN 'bare' WHEN list_contains({AUTUMN}, n) THEN 'autumn' ELSE 'growing' END AS phase, (SELECT coalesce(sum(1 << (CASE WHEN degree < 0 THEN (b + 5) % 12 + 1 ELSE b END - 1)), 0)::BIGINT FROM unnest({BARE}) t(b)) AS leaf_off FROM n""")
def _(v: Views) -> DataFrame:
    latitude = F.col("c_custkey") * 7 % 181 - 90 + F.lit(0.5)
    return v.table("customer").select("c_custkey", clean.foliage_phase(latitude, F.col("c_nationkey") % 12 + 1).alias("phase"), clean.leaf_off_months(latitude).cast("long").alias("leaf_off"))


@query("c23_badge_statistics", """SELECT user_id, count(DISTINCT props) AS trees, count_if(event_type = 'view') AS photos, count_if(hour(ts) < 6) AS at_night, count(DISTINCT props) FILTER (WHERE event_id % 7 = 0) AS rare, max(value) AS largest, count(DISTINCT props) FILTER (WHERE value >= 48) AS giants, count(DISTINCT props) FILTER (WHERE event_id % 150 >= 100) AS veterans, count(DISTINCT ts::DATE) AS days FROM events GROUP BY user_id""")
def _(v: Views) -> DataFrame:
    from arborscale.operators import rollups

    e = v.table("events").select("user_id", F.col("props").alias("tree_id"), "ts", (F.col("event_type") == "view").alias("photo"), (F.col("event_id") % 7 == 0).alias("rare"), F.col("value").alias("dbh"), (F.col("event_id") % 150).alias("age"))
    return rollups.badge_statistics(e)


@query("c24_city_missions", """SELECT user_id, mission, least(target, count(DISTINCT props)) AS progress, count(DISTINCT props) >= target AS earned FROM events JOIN (VALUES (0, 'north', 3::BIGINT), (1, 'south', 8)) m(k, mission, target) ON event_id % 3 = k GROUP BY user_id, mission, target""")
def _(v: Views) -> DataFrame:
    from arborscale.operators import rollups

    k = F.col("event_id") % 3
    e = v.table("events").select("user_id", F.col("props").alias("tree_id"), F.when(k == 0, "north").when(k == 1, "south").otherwise("elsewhere").alias("city"))
    return rollups.mission_progress(e, {"north": 3, "south": 8})


@query("c24_badge_progress", """SELECT user_id, badge, least(target, n) AS progress, n >= target AS earned FROM (SELECT user_id, count(*) AS n FROM events GROUP BY user_id), (VALUES ('ten', 10::BIGINT), ('sixty', 60), ('hundred', 100)) b(badge, target)""")
def _(v: Views) -> DataFrame:
    from arborscale.operators import rollups

    return rollups.badge_progress(v.table("events").groupBy("user_id").agg(F.count("*").alias("n")), "n", {"ten": 10, "sixty": 60, "hundred": 100})


@query("c25_coded_values", "SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'Open' WHEN 'F' THEN 'Final' END AS o_orderstatus_name, o_orderstatus NOT IN ('O', 'F') AS undecoded FROM orders")
def _(v: Views) -> DataFrame:
    return clean.decoded(v.table("orders"), "o_orderstatus", {"O": "Open", "F": "Final"}).select("o_orderkey", "o_orderstatus_name", "undecoded")


@query("c26_label_overrides", "WITH {OBS} SELECT tree_id, CASE WHEN p_size > 35 THEN 'New name' ELSE species END AS species, CASE WHEN p_size > 35 THEN 'New' ELSE genus END AS genus FROM obs JOIN part ON part_key = p_partkey")
def _(v: Views) -> DataFrame:
    new = v.table("part").where("p_size > 30").select(F.col("p_partkey").alias("part_key"), F.when(F.col("p_size") > 35, "New name").otherwise("No such tree").alias("species"))
    return clean.overridden(v.obs, new, "part_key", new.where("species = 'New name'").select("species")).select("tree_id", "species", "genus")


@query("c27_shades", "SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'trunk' WHEN p_size % 4 = 1 AND p_partkey % 2 = 0 THEN 'red|gold' ELSE 'green' END AS shades FROM part")
def _(v: Views) -> DataFrame:
    k = F.col("p_size") % 4
    shades = clean.shades(F.col("p_partkey") % 2 == 0, F.when(k == 0, "bare").when(k == 1, "autumn").otherwise("summer"), F.array(F.lit("red"), F.lit("gold")), F.array(F.lit("green")), F.lit("trunk"))
    return v.table("part").select("p_partkey", F.array_join(shades, "|").alias("shades"))
