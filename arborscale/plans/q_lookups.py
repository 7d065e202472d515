"""Queries of the join and lookup operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborscale.functions import geometry
from arborscale.operators import cells, lookups
from arborscale.operators import polygons as areas
from arborscale.plans.registry import Views, query
from arborscale.sources import scans

#: Points in tenths of a micro-degree and in metres, exact in both engines: x and y from the same modular mapping.
PTS = """pts AS (SELECT tree_id AS id, genus, dbh, line, city, species, order_key, part_key, ((order_key * 15485863 + part_key * 97 + supp_key * 13 + line * 4391) % 20000) / 8.0 AS x, ((order_key * 7919 + part_key * 31 + supp_key * 104729 + line * 611) % 20000) / 8.0 AS y FROM obs)"""


def points(v: Views) -> DataFrame:
    x = F.expr("((order_key * 15485863 + part_key * 97 + supp_key * 13 + line * 4391) % 20000) / 8.0D")
    y = F.expr("((order_key * 7919 + part_key * 31 + supp_key * 104729 + line * 611) % 20000) / 8.0D")
    return v.obs.select(F.col("tree_id").alias("id"), "genus", "dbh", "line", "city", "species", "order_key", "part_key", x.alias("x"), y.alias("y"))


@query("j1_dimension_join", "WITH {OBS} SELECT tree_id, p_retailprice AS price FROM obs LEFT JOIN (SELECT p_name, max(p_retailprice) AS p_retailprice FROM part GROUP BY 1) ON lower(species) = p_name")
def _(v: Views) -> DataFrame:
    dim = v.table("part").groupBy("p_name").agg(F.max("p_retailprice").alias("price"))
    return v.obs.join(dim, F.lower("species") == F.col("p_name"), "left").select("tree_id", "price")


@query("j2_optional_join", "SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY ALL")
def _(v: Views) -> DataFrame:
    n = v.table("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders"))
    return v.table("customer").join(n, "c_custkey", "left").select("c_custkey", F.coalesce("orders", F.lit(0)).alias("orders"))


@query("j3_anti_semi", "SELECT p_partkey, p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49) AS survived FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity < 2)")
def _(v: Views) -> DataFrame:
    l = v.table("lineitem")  # noqa: E741
    fresh = v.table("part").join(l.where("l_quantity < 2"), F.col("p_partkey") == F.col("l_partkey"), "left_anti")
    hit = l.where("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey")).distinct().withColumn("survived", F.lit(True))
    return fresh.join(hit, "p_partkey", "left").select("p_partkey", F.coalesce("survived", F.lit(False)).alias("survived"))


@query("j4_cell_lookup", f"WITH {{OBS}}, {PTS}, c AS (SELECT floor(x / 25)::BIGINT * 1000 + floor(y / 25)::BIGINT AS cell, min(id) AS snap FROM pts WHERE line > 5 GROUP BY 1) SELECT id, snap FROM pts LEFT JOIN c ON floor(x / 25)::BIGINT * 1000 + floor(y / 25)::BIGINT = cell")
def _(v: Views) -> DataFrame:
    p = points(v).withColumn("cell", F.floor(F.col("x") / 25) * 1000 + F.floor(F.col("y") / 25))
    return p.join(p.where("line > 5").groupBy("cell").agg(F.min("id").alias("snap")), "cell", "left").select("id", "snap")


@query("j5_radius_pairs", f"WITH {{OBS}}, {PTS} SELECT a.line AS one, b.line AS other, count(*) AS pairs FROM pts a JOIN pts b ON floor(a.x / 4) BETWEEN floor(b.x / 4) - 1 AND floor(b.x / 4) + 1 AND a.line < b.line AND a.city = b.city AND (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 16 GROUP BY ALL")
def _(v: Views) -> DataFrame:
    p = points(v)
    near = cells.pairs_within(p, p, 4.0, keys=("city",)).where("l_line < r_line")
    return near.groupBy(F.col("l_line").alias("one"), F.col("r_line").alias("other")).agg(F.count("*").alias("pairs"))


@query("j6_point_in_boxes", f"WITH {{OBS}}, {PTS} SELECT id, (x >= 100 AND x < 900 AND y >= 200 AND y < 800) OR (x >= 2000 AND x < 2300 AND y >= 1000 AND y < 1100) AS inside FROM pts")
def _(v: Views) -> DataFrame:
    return points(v).select("id", scans.in_boxes(F.col("y"), F.col("x"), [(200, 800, 100, 900), (1000, 1100, 2000, 2300)]).alias("inside"))


@query("j7_nearest_links", f"""WITH {{OBS}}, {PTS}, rv AS (SELECT min(id) AS id, tree_id FROM (SELECT r.id, min(t.id) AS tree_id FROM pts r JOIN pts t ON r.part_key = t.part_key AND r.line = 5 AND t.line > 5 AND r.part_key % 50 = 0 GROUP BY r.id) GROUP BY tree_id), c AS (SELECT r.id, t.id AS tree_id, sqrt((r.x - t.x) ** 2 + (r.y - t.y) ** 2) AS d FROM pts r JOIN pts t ON r.genus = t.genus AND floor(r.x / 20) BETWEEN floor(t.x / 20) - 1 AND floor(t.x / 20) + 1 AND abs(r.y - t.y) <= 20
WHERE r.line = 5 AND t.line > 5 AND abs(r.dbh - t.dbh) <= 10 AND sqrt((r.x - t.x) ** 2 + (r.y - t.y) ** 2) <= 20 AND r.id NOT IN (SELECT id FROM rv) AND t.id NOT IN (SELECT tree_id FROM rv)), f AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, tree_id) = 1) (SELECT id, tree_id FROM f QUALIFY row_number() OVER (PARTITION BY tree_id ORDER BY d, id) = 1) UNION ALL SELECT id, tree_id FROM rv""")
def _(v: Views) -> DataFrame:
    p = points(v).select("id", "x", "y", "genus", "dbh", "line", "part_key")
    one, other = p.where("line = 5"), p.where("line > 5")
    same = one.where("part_key % 50 = 0").select("id", "part_key").join(other.groupBy("part_key").agg(F.min("id").alias("tree_id")), "part_key")
    return lookups.best_link(one, other, 20.0, 10.0, same.groupBy("tree_id").agg(F.min("id").alias("id"))).select("id", "tree_id")


@query("j8_two_nearest", f"""WITH {{OBS}}, {PTS}, q AS (SELECT * FROM pts WHERE line = 1), c AS (SELECT a.id, b.id AS o, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d FROM q a JOIN q b ON a.id <> b.id AND floor(a.x / 25) BETWEEN floor(b.x / 25) - 1 AND floor(b.x / 25) + 1 AND abs(a.y - b.y) <= 25 WHERE sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 25),
n AS (SELECT id, arg_min(o, (d, o)) AS nearest, count(*) AS k FROM c GROUP BY id) SELECT n.id, n.nearest, coalesce(m.nearest = n.id, false) AS mutual FROM n LEFT JOIN n m ON n.nearest = m.id""")
def _(v: Views) -> DataFrame:
    return lookups.two_nearest(points(v).where("line = 1").select("id", "x", "y"), 25.0).select("id", "nearest", "mutual")


@query("j8_distance_bands", f"""WITH {{OBS}}, {PTS}, q AS (SELECT * FROM pts WHERE line = 1), c AS (SELECT a.id, b.id AS o, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d FROM q a JOIN q b ON a.id <> b.id AND floor(a.x / 25) BETWEEN floor(b.x / 25) - 1 AND floor(b.x / 25) + 1 AND abs(a.y - b.y) <= 25 WHERE sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 25),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, o) AS k FROM c), n AS (SELECT a.id, a.o AS nearest, a.d AS d1, b.d AS d2 FROM r a LEFT JOIN r b ON a.id = b.id AND b.k = 2 WHERE a.k = 1), f AS (SELECT n.*, coalesce(m.nearest = n.id, false) AS mutual FROM n LEFT JOIN n m ON n.nearest = m.id),
e(low, high) AS (VALUES (0::DOUBLE, 2::DOUBLE), (2, 5), (5, 10), (10, 20), (20, 25))
SELECT low, high, count(*) AS rows, count_if(mutual) AS mutual, round(median(d1 / greatest(d2, 1e-9)) FILTER (WHERE d2 IS NOT NULL), 6) AS median_ratio FROM f JOIN e ON d1 > low AND d1 <= high GROUP BY low, high""")
def _(v: Views) -> DataFrame:
    two = lookups.two_nearest(points(v).where("line = 1").select("id", "x", "y"), 25.0)
    return lookups.distance_bands(two, (0, 2, 5, 10, 20, 25)).withColumn("median_ratio", F.round("median_ratio", 6))


@query("j9_similar_names", "WITH n AS (SELECT DISTINCT concat(p_type, '-', p_name) AS name FROM part UNION SELECT DISTINCT p_name FROM part) SELECT a.name AS a, b.name AS b, levenshtein(a.name, b.name)::INT AS edits FROM n a JOIN n b ON a.name < b.name AND length(a.name) >= 8 AND length(b.name) >= 8 AND levenshtein(a.name, b.name) <= 2")
def _(v: Views) -> DataFrame:
    part = v.table("part")
    names = part.select(F.concat_ws("-", "p_type", "p_name").alias("name")).union(part.select("p_name"))
    return lookups.similar_names(names)


def polygons(v: Views) -> DataFrame:
    """A multipolygon for each supplier, from its text: a square with a corner cut off and a square hole, and a small square beside."""
    x, y = (F.col("s_suppkey") * 37 % 100) * 25.0, (F.col("s_suppkey") * 61 % 100) * 25.0

    def ring(*corners):
        return F.concat(F.lit("("), F.concat_ws(", ", *[F.concat_ws(" ", x + dx, y + dy) for dx, dy in (*corners, corners[0])]), F.lit(")"))

    main, hole, beside = ring((0, 0), (60, 0), (60, 30), (30, 60), (0, 60)), ring((10, 10), (20, 10), (20, 20), (10, 20)), ring((70, 0), (85, 0), (85, 15), (70, 15))
    wkt = F.concat(F.lit("MULTIPOLYGON (("), main, F.lit(", "), hole, F.lit("), ("), beside, F.lit("))"))
    return v.table("supplier").select(F.col("s_suppkey").alias("poly_id"), geometry.rings_of_wkt(wkt).alias("rings"))


POLY = "poly AS (SELECT s_suppkey AS poly_id, (s_suppkey * 37 % 100) * 25.0 AS px, (s_suppkey * 61 % 100) * 25.0 AS py FROM supplier)"
HOLE = "(x >= px + 10 AND x < px + 20 AND y >= py + 10 AND y < py + 20)"
INSIDE = f"((x >= px AND x < px + 60 AND y >= py AND y < py + 60 AND (x - px) + (y - py) < 90 AND NOT {HOLE}) OR (x >= px + 70 AND x < px + 85 AND y >= py AND y < py + 15))"


@query("j10_point_in_polygon", f"""WITH {{OBS}}, {PTS}, {POLY}, e(x0, y0, x1, y1) AS (VALUES (0, 0, 60, 0), (60, 0, 60, 30), (60, 30, 30, 60), (30, 60, 0, 60), (0, 60, 0, 0), (10, 10, 20, 10), (20, 10, 20, 20), (20, 20, 10, 20), (10, 20, 10, 10), (70, 0, 85, 0), (85, 0, 85, 15), (85, 15, 70, 15), (70, 15, 70, 0)),
i AS (SELECT id, min(poly_id) AS poly_id FROM pts, poly WHERE {INSIDE} GROUP BY id),
k AS (SELECT id, poly_id, x - px AS x, y - py AS y FROM pts, poly WHERE x BETWEEN px - 50 AND px + 135 AND y BETWEEN py - 50 AND py + 110 AND id NOT IN (SELECT id FROM i)), q AS (SELECT *, greatest(least(((x - x0) * (x1 - x0) + (y - y0) * (y1 - y0)) / ((x1 - x0) ** 2 + (y1 - y0) ** 2), 1), 0) AS t FROM k, e),
d AS (SELECT id, poly_id, min(sqrt((x - x0 - t * (x1 - x0)) ** 2 + (y - y0 - t * (y1 - y0)) ** 2)) AS d FROM q GROUP BY ALL)
SELECT id, poly_id, 'inside' AS how, 0.0::DOUBLE AS distance FROM i UNION ALL SELECT id, arg_min(poly_id, (d, poly_id)), 'nearby', round(min(d), 6) FROM d WHERE d <= 50 GROUP BY id""")
def _(v: Views) -> DataFrame:
    return areas.containing_or_near(points(v).select("id", "x", "y"), polygons(v), 50.0).withColumn("distance", F.round("distance", 6))


@query("j11_layered_precedence", f"""WITH {{OBS}}, {PTS}, sq AS (SELECT s_suppkey AS poly_id, (s_suppkey * 37 % 100) * 25.0 AS px, (s_suppkey * 61 % 100) * 25.0 AS py, 60 + s_suppkey % 5 * 20 AS w, s_suppkey % 4 AS layer FROM supplier), h AS (SELECT id, poly_id, w, layer FROM pts, sq WHERE x >= px AND x < px + w AND y >= py AND y < py + w AND NOT (poly_id % 3 = 0 AND {HOLE}))
SELECT id, CASE WHEN bool_or(layer = 0) THEN 'park' WHEN bool_or(layer = 1) THEN 'street' WHEN bool_or(layer > 1 AND poly_id % 3 > 0) AND NOT bool_or(layer > 1 AND poly_id % 7 = 0) THEN 'private' ELSE 'unknown' END AS setting, arg_min(poly_id, (w * w - CASE WHEN poly_id % 3 = 0 THEN 100 ELSE 0 END, poly_id)) FILTER (WHERE layer = 0) AS park_id FROM h GROUP BY id""")
def _(v: Views) -> DataFrame:
    k = F.col("s_suppkey")
    x, y, w = (k * 37 % 100) * 25.0, (k * 61 % 100) * 25.0, 60.0 + k % 5 * 20

    def square(offset, width, hole):
        corner = lambda dx, dy: F.struct((x + offset + dx).alias("x"), (y + offset + dy).alias("y"))
        zero = F.lit(0.0)
        return F.struct(F.lit(hole).alias("hole"), F.array(corner(zero, zero), corner(width, zero), corner(width, width), corner(zero, width), corner(zero, zero)).alias("ring"))

    rings = F.when(k % 3 == 0, F.array(square(0.0, w, False), square(10.0, F.lit(10.0), True))).otherwise(F.array(square(0.0, w, False)))
    layer = F.when(k % 4 == 0, "park").when(k % 4 == 1, "street").otherwise("parcel")
    return areas.settings(points(v), v.table("supplier").select(k.alias("poly_id"), rings.alias("rings"), layer.alias("layer"), (k % 3 > 0).alias("taxed"), (k % 7 == 0).alias("public")))


CHECK = "rec AS (SELECT p_partkey AS id, concat(p_name, ' ', p_size) AS taxon, CASE WHEN p_partkey % 11 = 0 THEN 'misapplied' ELSE 'ok' END AS status, CASE WHEN p_partkey % 7 = 0 THEN NULL WHEN p_partkey % 3 = 0 THEN p_partkey ELSE p_partkey // 6 * 6 END AS accepted_id FROM part WHERE p_partkey % 2 = 0)"
RESOLVED = f"""{CHECK}, u AS (SELECT * FROM rec WHERE status <> 'misapplied'), rd AS (SELECT u.taxon AS name, CASE WHEN u.accepted_id IS NULL THEN 'unplaced' WHEN u.accepted_id = u.id THEN 'accepted' ELSE 'synonym' END AS verdict, o.taxon AS accepted_name FROM u LEFT JOIN u o ON u.accepted_id = o.id),
bn AS (SELECT name, count(DISTINCT concat(verdict, '|', coalesce(accepted_name, '~'))) AS n, min(verdict) AS verdict, min(accepted_name) AS accepted_name FROM rd GROUP BY name), nm AS (SELECT DISTINCT concat(p_name, ' ', p_size) AS name FROM part),
res AS (SELECT nm.name, CASE WHEN n IS NULL THEN 'not_found' WHEN n > 1 THEN 'ambiguous' ELSE verdict END AS verdict, CASE WHEN n = 1 THEN accepted_name END AS accepted_name FROM nm LEFT JOIN bn USING (name))"""


def resolved(v: Views) -> DataFrame:
    k = F.col("p_partkey")
    part = v.table("part").withColumn("taxon", F.concat_ws(" ", "p_name", "p_size"))
    status = F.when(k % 11 == 0, "misapplied").otherwise("ok")
    accepted = F.when(k % 7 == 0, None).when(k % 3 == 0, k).otherwise(F.floor(k / 6) * 6)
    return lookups.resolve_names(part.select(F.col("taxon").alias("name")), part.where(k % 2 == 0).select(k.alias("id"), "taxon", status.alias("status"), accepted.alias("accepted_id")))


@query("j12_checklist_resolution", f"WITH {RESOLVED} FROM res")
def _(v: Views) -> DataFrame:
    return resolved(v)


@query("j13_pair_verdicts", f"""WITH {RESOLVED}, p AS (SELECT a.name AS a, b.name AS b, levenshtein(a.name, b.name) AS e FROM nm a JOIN nm b ON a.name < b.name AND length(a.name) >= 8 AND length(b.name) >= 8 AND levenshtein(a.name, b.name) <= 1),
q AS (SELECT a, b, ra.verdict AS va, rb.verdict AS vb, ra.accepted_name AS ta, rb.accepted_name AS tb, CASE WHEN ra.verdict = 'not_found' THEN a ELSE b END AS wrong, CASE WHEN ra.verdict = 'not_found' THEN rb.accepted_name ELSE ra.accepted_name END AS target FROM p JOIN res ra ON a = ra.name JOIN res rb ON b = rb.name),
t AS (SELECT wrong, count(DISTINCT target) AS targets FROM q WHERE (va = 'not_found') <> (vb = 'not_found') GROUP BY wrong)
SELECT a, b, CASE WHEN va <> 'ambiguous' AND vb <> 'ambiguous' AND (coalesce(ta = b, false) OR coalesce(tb = a, false)) THEN 'SYNONYM' WHEN (va IN ('accepted', 'synonym') AND vb IN ('accepted', 'synonym')) OR coalesce(targets > 1, false) THEN 'REFUSED'
WHEN NOT ((va = 'not_found' AND vb IN ('accepted', 'synonym')) OR (vb = 'not_found' AND va IN ('accepted', 'synonym'))) OR target IS NULL THEN 'UNRESOLVED' ELSE 'MISSPELLING' END AS verdict FROM q LEFT JOIN t USING (wrong)""")
def _(v: Views) -> DataFrame:
    r = resolved(v)
    return lookups.pair_verdicts(lookups.similar_names(r.select("name"), edits=1).select("a", "b"), r)


#: Names with hybrid marks and misspellings of one and two letters, and a checklist of some of them.
HYBRIDS = """w AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS g, split_part(p_name, ' ', 2) AS e FROM part), nm AS (SELECT DISTINCT unnest([concat(g, 'ella ', e), concat(g, 'ella x ', e), concat(g, 'ella ', left(e, length(e) - 2), 'zz'), concat(g, 'elta ', e), concat(g, 'ella ', e, 'us')]) AS name FROM w),
rec AS (SELECT concat(g, 'ella ', e) AS name, CASE WHEN g = 'hot' THEN NULL WHEN g = 'old' THEN concat('newella ', e) WHEN e = 'ring' THEN concat(g, 'ella ringus') ELSE concat(g, 'ella ', e) END AS target FROM w UNION ALL SELECT concat(g, 'ella ', e, 'us'), concat(g, 'ella ', e, 'us') FROM w WHERE e = 'ring'),
res AS (SELECT nm.name, CASE WHEN r.name IS NULL THEN 'not_found' WHEN r.target IS NULL THEN 'unplaced' WHEN r.target = r.name THEN 'accepted' ELSE 'synonym' END AS verdict, o.name AS accepted_name FROM nm LEFT JOIN rec r USING (name) LEFT JOIN rec o ON r.target = o.name)"""


@query("j13_hybrid_marks", f"""WITH {HYBRIDS}, p AS (SELECT a.name AS a, b.name AS b FROM nm a JOIN nm b ON a.name < b.name AND length(a.name) >= 8 AND length(b.name) >= 8 AND levenshtein(a.name, b.name) <= 2),
q AS (SELECT a, b, ra.verdict AS va, rb.verdict AS vb, ra.accepted_name AS ta, rb.accepted_name AS tb, CASE WHEN ra.verdict = 'not_found' THEN a ELSE b END AS wrong, CASE WHEN ra.verdict = 'not_found' THEN rb.accepted_name ELSE ra.accepted_name END AS target,
list_bool_or(list_transform(list_zip(string_split(a, ' '), string_split(b, ' ')), lambda t: coalesce(levenshtein(t[1], t[2]) >= 2 AND least(length(t[1]), length(t[2])) <= 5, false))) AS two FROM p JOIN res ra ON a = ra.name JOIN res rb ON b = rb.name),
t AS (SELECT wrong, count(DISTINCT target) AS targets FROM q WHERE (va = 'not_found') <> (vb = 'not_found') GROUP BY wrong)
SELECT a, b, CASE WHEN coalesce(ta = b, false) OR coalesce(tb = a, false) THEN 'SYNONYM' WHEN (va IN ('accepted', 'synonym') AND vb IN ('accepted', 'synonym')) OR coalesce(targets > 1, false) OR two THEN 'REFUSED' WHEN NOT ((va = 'not_found' AND vb IN ('accepted', 'synonym')) OR (vb = 'not_found' AND va IN ('accepted', 'synonym'))) OR target IS NULL THEN 'UNRESOLVED'
WHEN replace(a, ' x ', ' ') = replace(b, ' x ', ' ') THEN 'HYBRID_MARK' ELSE 'MISSPELLING' END AS verdict FROM q LEFT JOIN t USING (wrong)""")
def _(v: Views) -> DataFrame:
    word = lambda k: F.split_part("p_name", F.lit(" "), F.lit(k))
    w = v.table("part").select(word(1).alias("g"), word(2).alias("e")).distinct()
    g, e = F.col("g"), F.col("e")
    name = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    names = w.select(F.explode(F.array(name(g, "ella ", e), name(g, "ella x ", e), name(g, "ella ", F.left(e, F.length(e) - 2), "zz"), name(g, "elta ", e), name(g, "ella ", e, "us"))).alias("name"))
    target = F.when(g == "hot", None).when(g == "old", name("newella ", e)).when(e == "ring", name(g, "ella ringus")).otherwise(name(g, "ella ", e))
    record = lambda taxon, accepted: [taxon.alias("id"), taxon.alias("taxon"), F.lit("ok").alias("status"), accepted.alias("accepted_id")]
    records = w.select(*record(name(g, "ella ", e), target)).unionByName(w.where(e == "ring").select(*record(name(g, "ella ", e, "us"), name(g, "ella ", e, "us"))))
    return lookups.pair_verdicts(lookups.similar_names(names).select("a", "b"), lookups.resolve_names(names, records))


@query("j14_token_scores", "WITH t AS (SELECT DISTINCT doc_id AS id, unnest(string_split(text, ' ')) AS token FROM documents), r AS (SELECT DISTINCT item_id AS ref_id, unnest(string_split(text, ' ')) AS token FROM benchmark), s AS (SELECT id, ref_id, count(*) AS score FROM t JOIN r USING (token) GROUP BY ALL HAVING count(*) >= 4) SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, ref_id) <= 40")
def _(v: Views) -> DataFrame:
    texts = v.table("documents").select(F.col("doc_id").alias("id"), F.split("text", " ").alias("tokens"))
    return lookups.token_scores(texts, v.table("benchmark").select(F.col("item_id").alias("ref_id"), F.split("text", " ").alias("ref_tokens")), 4, 40)


@query("j15_unnest_join", "SELECT p_partkey, n_name FROM (SELECT p_partkey, unnest([p_partkey % 7, p_partkey % 11]) AS k FROM part) JOIN nation ON k = n_nationkey")
def _(v: Views) -> DataFrame:
    lists = v.table("part").select("p_partkey", F.explode(F.array(F.col("p_partkey") % 7, F.col("p_partkey") % 11)).alias("k"))
    return lists.join(v.table("nation"), F.col("k") == F.col("n_nationkey")).select("p_partkey", "n_name")


@query("j16_alias_rows", "WITH r AS (SELECT s_name AS name, s_suppkey AS k FROM supplier), a AS (SELECT concat('alias', k % 40) AS name, min_by(k, name) AS k FROM r GROUP BY 1) FROM r UNION ALL SELECT name, k FROM a")
def _(v: Views) -> DataFrame:
    rows = v.table("supplier").select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("k"), F.array(F.concat(F.lit("alias"), F.col("s_suppkey") % 40), F.col("s_name")).alias("aliases"))
    return lookups.with_aliases(rows, "name", "aliases").select("name", "k")


@query("j16_consolidated", """WITH r AS (SELECT concat('n', s_suppkey) AS name, s_suppkey AS k FROM supplier), f AS (SELECT name AS synonym, concat('n', k - k % 20 + CASE WHEN k % 40 < 20 THEN 1 ELSE 1000000 END) AS accepted, k AS place FROM r WHERE k % 5 = 0),
n AS (SELECT accepted, arg_min(synonym, place) AS name FROM f WHERE accepted NOT IN (SELECT name FROM r) GROUP BY 1) SELECT name, k FROM r WHERE name NOT IN (SELECT synonym FROM f) UNION ALL SELECT n.accepted, k FROM n JOIN r USING (name)""")
def _(v: Views) -> DataFrame:
    k = F.col("s_suppkey")
    rows = v.table("supplier").select(F.concat(F.lit("n"), k).alias("name"), k.alias("k"))
    accepted = F.concat(F.lit("n"), F.col("k") - F.col("k") % 20 + F.when(F.col("k") % 40 < 20, 1).otherwise(1_000_000))
    return lookups.consolidated(rows, "name", rows.where("k % 5 = 0").select(F.col("name").alias("synonym"), accepted.alias("accepted"), F.col("k").alias("place")))


@query("j17_rebase", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 OR p_partkey % 3 = 0 THEN p_brand END AS brand, CASE WHEN p_partkey % 2 > 0 AND p_partkey % 3 = 0 THEN 1 ELSE 0 END AS gained FROM part")
def _(v: Views) -> DataFrame:
    k = F.col("p_partkey")
    base, old = v.table("part").select(k, F.when(k % 2 == 0, F.col("p_brand")).alias("brand")), v.table("part").where(k % 3 == 0).select(k, F.col("p_brand").alias("brand"))
    return lookups.rebased(base, old, "p_partkey", ["brand"])


@query("j18_differences", "SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN '(missing)' ELSE 'p_size' END AS field, CASE WHEN p_partkey % 10 > 0 THEN p_size::VARCHAR END AS before, CASE WHEN p_partkey % 10 > 0 THEN (p_size + 1)::VARCHAR END AS after FROM part WHERE p_partkey % 10 IN (0, 1)")
def _(v: Views) -> DataFrame:
    k, part = F.col("p_partkey"), v.table("part")
    new = part.where(k % 10 != 0).withColumn("p_size", F.when(k % 10 == 1, F.col("p_size") + 1).otherwise(F.col("p_size")))
    return lookups.differences(part, new, "p_partkey", ["p_size", "p_brand"])


@query("j19_upsert", "SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'new' ELSE p_brand END AS brand FROM part")
def _(v: Views) -> DataFrame:
    part = v.table("part").select("p_partkey", F.col("p_brand").alias("brand"))
    return lookups.upsert(part, part.where("p_partkey % 5 = 0").withColumn("brand", F.lit("new")), "p_partkey")


@query("j19_upsert_report", "SELECT count(*) FILTER (WHERE p_partkey % 3 > 0) AS before, count(*) FILTER (WHERE p_partkey % 5 = 0 AND p_partkey % 3 > 0) AS replaced, count(*) FILTER (WHERE p_partkey % 5 = 0 AND p_partkey % 3 = 0) AS inserted, count(*) FILTER (WHERE p_partkey % 3 > 0 OR p_partkey % 5 = 0) AS after, true AS ok FROM part")
def _(v: Views) -> DataFrame:
    part = v.table("part").select("p_partkey", "p_brand")
    return lookups.upsert_report(part.where("p_partkey % 3 > 0"), part.where("p_partkey % 5 = 0"), "p_partkey")


@query("j20_area_weights", "WITH b AS (SELECT (p_partkey % 50) * 10.0 AS x0, (p_partkey // 50) * 10.0 AS y0, p_size AS n, p_size / 10.0 AS moe FROM part), s AS (SELECT *, greatest(least(x0 + 10, 255.0) - greatest(x0, 100.0), 0) * greatest(least(y0 + 10, 303.0) - greatest(y0, 55.0), 0) / 100 AS share FROM b) SELECT round(sum(share * n), 6) AS count, round(sqrt(sum((share * moe) ** 2)), 6) AS moe FROM s")
def _(v: Views) -> DataFrame:
    k = F.col("p_partkey")
    x0, y0 = (k % 50) * 10.0, F.floor(k / 50) * 10.0
    blocks = v.table("part").select(x0.alias("x0"), y0.alias("y0"), (x0 + 10).alias("x1"), (y0 + 10).alias("y1"), F.col("p_size").alias("count"), (F.col("p_size") / 10.0).alias("moe"))
    return lookups.box_overlap(blocks, (100.0, 55.0, 255.0, 303.0)).select(F.round("count", 6).alias("count"), F.round("moe", 6).alias("moe"))


#: A triangle with a triangular hole, and the area of a box below a falling diagonal, for its twin.
TRIANGLE = "POLYGON ((100 55, 400 55, 100 355), (150 105, 250 105, 150 205))"


def _triangle(a: float, b: float, c: float) -> str:
    x, y = f"greatest(x0, {a})", f"greatest(y0, {b})"
    below = " ".join(f"{sign} greatest({c} - {p} - {q}, 0) ** 2" for sign, p, q in (("", x, y), ("-", f"greatest(x1, {a})", y), ("-", x, f"greatest(y1, {b})"), ("+", f"greatest(x1, {a})", f"greatest(y1, {b})")))
    return f"({below}) / 2"


@query("j20_polygon_weights", f"""WITH b AS (SELECT p_partkey % 3 AS area_id, (p_partkey % 50) * 10.0 AS x0, (p_partkey % 2000 // 50) * 10.0 AS y0, (p_partkey % 50) * 10.0 + 10 AS x1, (p_partkey % 2000 // 50) * 10.0 + 10 AS y1, p_size AS n, p_size / 10.0 AS moe FROM part), s AS (SELECT *, ({_triangle(100, 55, 455)} - {_triangle(150, 105, 355)}) / 100 AS share FROM b)
SELECT area_id, round(sum(share * n), 6) AS count, round(sqrt(sum((share * moe) ** 2)), 6) AS moe FROM s GROUP BY area_id""")
def _(v: Views) -> DataFrame:
    k = F.col("p_partkey")
    x0, y0 = (k % 50) * 10.0, F.floor(k % 2000 / 50) * 10.0
    blocks = v.table("part").select((k % 3).alias("area"), x0.alias("x0"), y0.alias("y0"), (x0 + 10).alias("x1"), (y0 + 10).alias("y1"), F.col("p_size").alias("count"), (F.col("p_size") / 10.0).alias("moe"))
    found = areas.weighted_shares(blocks, geometry.rings_of_wkt(F.lit(TRIANGLE)), F.col("area"))
    return found.select("area_id", F.round("count", 6).alias("count"), F.round("moe", 6).alias("moe"))


@query("j21_ring_dilation", f"WITH {{OBS}}, {PTS}, t AS (SELECT DISTINCT floor(x / 200)::BIGINT AS x, floor(y / 200)::BIGINT AS y FROM pts) SELECT DISTINCT x + i AS x, y + j AS y FROM t, range(-2, 3) a(i), range(-2, 3) b(j)")
def _(v: Views) -> DataFrame:
    tiles = points(v).select(F.floor(F.col("x") / 200).alias("x"), F.floor(F.col("y") / 200).alias("y")).distinct()
    return lookups.dilated(tiles, 2)


@query("j22_nearest_n", f"WITH {{OBS}}, {PTS}, c AS (SELECT a.id, b.id AS other, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d FROM pts a JOIN pts b ON floor(a.x / 12) BETWEEN floor(b.x / 12) - 1 AND floor(b.x / 12) + 1 AND abs(a.y - b.y) <= 12 WHERE a.line = 3 AND b.line > 5) SELECT id, other, row_number() OVER (PARTITION BY id ORDER BY d, other)::INT AS place FROM c WHERE d <= 12 QUALIFY place <= 3")
def _(v: Views) -> DataFrame:
    p = points(v).select("id", "x", "y", "line")
    return lookups.nearest_n(p.where("line = 3"), p.where("line > 5"), 12.0, 3)


@query("j23_owning_region", f"WITH {{OBS}}, {PTS} SELECT id, CASE WHEN x >= 500 AND x < 900 AND y >= 500 AND y < 900 THEN 'carved' WHEN x < 1500 AND y < 2500 THEN 'east' WHEN x >= 1000 THEN 'west' END AS region FROM pts")
def _(v: Views) -> DataFrame:
    return lookups.owning_region(points(v), [(0, "carved", 500, 900, 500, 900), (1, "west", 1000, 3000, 0, 3000), (1, "east", 0, 1500, 0, 2500)])


@query("j24_nearest_centre", f"WITH {{OBS}}, {PTS}, c(name, cx, cy) AS (VALUES ('a', 300.0, 400.0), ('b', 2000.0, 600.0), ('c', 1300.0, 2100.0)), d AS (SELECT id, name, sqrt((x - cx) ** 2 + (y - cy) ** 2) AS d FROM pts, c) SELECT id, CASE WHEN min(d) <= 700 THEN arg_min(name, (d, name)) END AS centre FROM d GROUP BY id")
def _(v: Views) -> DataFrame:
    return lookups.nearest_centre(points(v), [("a", 300.0, 400.0), ("b", 2000.0, 600.0), ("c", 1300.0, 2100.0)], 700.0)


@query("j25_edge_neighbours", f"WITH {{OBS}}, {PTS}, t AS (SELECT DISTINCT floor(x / 50)::BIGINT AS tx, floor(y / 50)::BIGINT AS ty FROM pts WHERE line = 3) SELECT p.id, tx, ty FROM t JOIN pts p ON p.line > 5 AND abs(p.x - (tx * 50 + 25)) <= 30 AND floor(p.x / 50) BETWEEN tx - 1 AND tx + 1 AND sqrt((p.x - (tx * 50 + 25)) ** 2 + (p.y - (ty * 50 + 25)) ** 2) <= 30 WHERE NOT (floor(p.x / 50) = tx AND floor(p.y / 50) = ty)")
def _(v: Views) -> DataFrame:
    p = points(v)
    tile = lambda c: F.floor(F.col(c) / 50)
    tiles = p.where("line = 3").select(tile("x").alias("tx"), tile("y").alias("ty")).distinct().withColumn("x", F.col("tx") * 50.0 + 25).withColumn("y", F.col("ty") * 50.0 + 25)
    near = cells.pairs_within(tiles, p.where("line > 5").select("id", "x", "y"), 30.0)
    return near.where(~((tile("r_x") == F.col("l_tx")) & (tile("r_y") == F.col("l_ty")))).select(F.col("r_id").alias("id"), F.col("l_tx").alias("tx"), F.col("l_ty").alias("ty"))
