"""Queries of the fitted models, statistics and raster operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborscale.functions.lineage import checkpointed
from arborscale.operators import calibration, cells, fits, grids, registration
from arborscale.plans.q_lookups import PTS, points
from arborscale.plans.registry import Views, query

AGE = "CASE WHEN date_diff('day', DATE '1994-01-01', plant_date) > 0 THEN date_diff('day', DATE '1994-01-01', plant_date) / 365.25 END"
GROWN = f"{{OBS}}, grown AS (SELECT *, {AGE} AS age, CASE size_class % 3 WHEN 0 THEN 'palm' WHEN 1 THEN 'conifer' ELSE 'broad' END AS form FROM obs)"
LOGS = "lg AS (SELECT genus, form, log10(age) AS x, log10(dbh) AS y FROM grown WHERE age > 0 AND dbh > 0)"
COLS = "count(*) AS n, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, CASE WHEN count(*) > 2 THEN sqrt(greatest(regr_syy(y, x) - regr_slope(y, x) * regr_sxy(y, x), 0) / (count(*) - 2)) END AS sigma, regr_r2(y, x) AS r2, max(x) AS x_max"
FITS = f"{GROWN}, {LOGS}, ft AS (SELECT 'genus' AS level, genus AS taxon, {COLS} FROM lg GROUP BY genus UNION ALL SELECT 'form', form, {COLS} FROM lg GROUP BY form UNION ALL SELECT 'all', '*', {COLS} FROM lg)"
LEVELS = (("genus", "genus"), ("form", "form"), ("all",))
GATE = "(n >= 7200 AND b BETWEEN -0.05 AND 1 AND level <> 'none')"


def grown(v: Views) -> DataFrame:
    days = F.datediff("plant_date", F.lit("1994-01-01").cast("date"))
    k = F.col("size_class") % 3
    return v.obs.withColumn("age", F.when(days > 0, days / 365.25)).withColumn("form", F.when(k == 0, "palm").when(k == 1, "conifer").otherwise("broad"))


def fitted(v: Views) -> DataFrame:
    return fits.log_log_fits(grown(v), LEVELS, F.col("age"), F.col("dbh"), (F.col("n") >= 7200) & F.col("b").between(-0.05, 1))


@query("m1_fallback_class", f"WITH {GROWN} SELECT tree_id, CASE WHEN form = 'palm' THEN 'none' WHEN form = 'conifer' THEN 'Gymnosperm' ELSE 'Angiosperm' END AS fallback FROM grown")
def _(v: Views) -> DataFrame:
    return grown(v).select("tree_id", fits.fallback_class(F.col("species"), F.col("form")).alias("fallback"))


@query("m2_gated_fits", f"WITH {FITS} SELECT level, taxon, n, round(b, 6) AS b, round(a, 6) AS a, round(sigma, 6) AS sigma, round(x_max, 6) AS x_max, {GATE} AS ok FROM ft")
def _(v: Views) -> DataFrame:
    return fitted(v).select("level", "taxon", "n", *[F.round(c, 6).alias(c) for c in ("b", "a", "sigma", "x_max")], "ok")


def trimmed_sql(rounds: int, sigmas: float) -> str:
    """Twin of the trimmed fits: for each round the kept points, their fits, and the points near their chosen fit."""
    sql = f"WITH {GROWN}, k0 AS (SELECT genus, form, log10(age) AS x, log10(dbh) AS y FROM grown WHERE age > 0 AND dbh > 0)"
    for i in range(rounds + 1):
        sql += f", f{i} AS (SELECT 'genus' AS level, genus AS taxon, {COLS} FROM k{i} GROUP BY genus UNION ALL SELECT 'form', form, {COLS} FROM k{i} GROUP BY form UNION ALL SELECT 'all', '*', {COLS} FROM k{i}), g{i} AS (SELECT * FROM f{i} WHERE n >= 100)"
        if i < rounds:
            sql += f""", p{i} AS (SELECT k.*, coalesce(x1.a, x2.a, x3.a) AS a, coalesce(x1.b, x2.b, x3.b) AS b, coalesce(x1.sigma, x2.sigma, x3.sigma) AS sigma FROM k{i} k LEFT JOIN g{i} x1 ON x1.level = 'genus' AND x1.taxon = k.genus LEFT JOIN g{i} x2 ON x2.level = 'form' AND x2.taxon = k.form LEFT JOIN g{i} x3 ON x3.level = 'all'),
k{i + 1} AS (SELECT genus, form, x, y FROM p{i} WHERE a IS NULL OR abs(y - a - b * x) <= {sigmas} * sigma)"""
    return f"{sql} SELECT level, taxon, n, round(b, 6) AS b, round(a, 6) AS a, round(sigma, 6) AS sigma FROM f{rounds}"


@query("m3_trimmed_fits", trimmed_sql(2, 2.0))
def _(v: Views) -> DataFrame:
    t = fits.trimmed_fits(grown(v), LEVELS, F.col("age"), F.col("dbh"), F.col("n") >= 100, checkpointed, sigmas=2.0)
    return t.select("level", "taxon", "n", *[F.round(c, 6).alias(c) for c in ("b", "a", "sigma")])


PICKED = f"{FITS}, ok AS (SELECT * FROM ft WHERE {GATE}), pk AS (SELECT g.*, CASE WHEN form <> 'palm' THEN coalesce(x.level, y.level, z.level) END AS fit_level, CASE WHEN form <> 'palm' THEN coalesce(x.a, y.a, z.a) END AS a, CASE WHEN form <> 'palm' THEN coalesce(x.b, y.b, z.b) END AS b, CASE WHEN form <> 'palm' THEN coalesce(x.sigma, y.sigma, z.sigma) END AS sigma, CASE WHEN form <> 'palm' THEN coalesce(x.x_max, y.x_max, z.x_max) END AS x_max FROM grown g LEFT JOIN ok x ON x.level = 'genus' AND x.taxon = g.genus LEFT JOIN ok y ON y.level = 'form' AND y.taxon = g.form LEFT JOIN ok z ON z.level = 'all')"


def picked(v: Views) -> DataFrame:
    return fits.pick_fit(grown(v), fitted(v), LEVELS, F.col("form") == "palm")


@query("m4_fit_by_level", f"WITH {PICKED} SELECT tree_id, fit_level, round(b, 6) AS b FROM pk")
def _(v: Views) -> DataFrame:
    return picked(v).select("tree_id", "fit_level", F.round("b", 6).alias("b"))


@query("m5_corrected_scale", f"WITH {FITS} SELECT level, taxon, round(pow(10, a + sigma * sigma * ln(10) / 2), 5) AS scale FROM ft")
def _(v: Views) -> DataFrame:
    return fitted(v).select("level", "taxon", F.round(fits.scale(F.col("a"), F.col("sigma")), 5).alias("scale"))


@query("m6_diameter_from_age", f"WITH {PICKED} SELECT tree_id, round(pow(10, a + sigma * sigma * ln(10) / 2) * pow(greatest(1.0, least(age, pow(10, x_max))), b), 4) AS predicted_dbh, CASE WHEN dbh IS NOT NULL THEN 'observed' WHEN a IS NOT NULL AND age IS NOT NULL THEN concat('fit:', fit_level) END AS dbh_source FROM pk WHERE age IS NOT NULL")
def _(v: Views) -> DataFrame:
    return fits.diameter_from_age(picked(v).where("age is not null"), F.col("age")).select("tree_id", F.round("predicted_dbh", 4).alias("predicted_dbh"), "dbh_source")


@query("m7_crown_width", "WITH {OBS} SELECT tree_id, round(1.2 * pow(least(dbh, 30.0), 0.6) * pow(greatest(dbh / 30.0, 1.0), 0.2), 6) AS crown FROM obs")
def _(v: Views) -> DataFrame:
    return v.obs.select("tree_id", F.round(fits.two_segment(F.lit(1.2), F.lit(0.6), F.col("dbh"), F.lit(30.0), F.lit(0.2)), 6).alias("crown"))


@query("m8_height_gate", "WITH {OBS} SELECT tree_id, CASE WHEN crown_width_m IS NULL THEN NULL WHEN dbh IS NULL THEN 'unchecked' WHEN crown_width_m < dbh / 4 * 0.5 AND size_class / 10.0 > 0.8 * crown_width_m THEN 'shaded' WHEN crown_width_m < dbh / 4 * 0.5 OR crown_width_m > dbh / 4 * 2 THEN 'out_of_band' ELSE 'accepted' END AS verdict FROM obs")
def _(v: Views) -> DataFrame:
    return v.obs.select("tree_id", fits.height_verdict(F.col("crown_width_m"), F.col("dbh") / 4, F.col("size_class") / 10.0, 0.5, 2.0, 0.8).alias("verdict"))


HEIGHTS = PICKED.replace("log10(age) AS x, log10(dbh) AS y FROM grown WHERE age > 0 AND dbh > 0", "log10(dbh) AS x, log10(crown_width_m) AS y FROM grown WHERE dbh > 0 AND crown_width_m > 0")


@query("m8_height_prediction", f"""WITH {HEIGHTS}, h AS (SELECT *, pow(10, a + sigma * sigma * ln(10) / 2) * pow(greatest(least(dbh, pow(10, x_max)), 1.0), b) AS p FROM pk), c AS (SELECT *, CASE WHEN dbh IS NOT NULL THEN p END AS predicted FROM h)
SELECT tree_id, round(predicted, 4) AS predicted_height, CASE WHEN crown_width_m IS NULL THEN NULL WHEN dbh IS NULL OR predicted IS NULL THEN 'unchecked' WHEN size_class > 8 * crown_width_m THEN 'shaded' WHEN crown_width_m > predicted * pow(10, 1.5 * sigma - sigma * sigma * ln(10) / 2) OR crown_width_m < predicted * pow(10, -1.5 * sigma - sigma * sigma * ln(10) / 2) THEN 'out_of_band' ELSE 'accepted' END AS verdict FROM c""")
def _(v: Views) -> DataFrame:
    height = F.col("crown_width_m")
    f = fits.log_log_fits(grown(v), LEVELS, F.col("dbh"), height, (F.col("n") >= 7200) & F.col("b").between(-0.05, 1))
    p = fits.pick_fit(grown(v), f, LEVELS, F.col("form") == "palm")
    p = p.withColumn("predicted", fits.predicted_height(F.col("dbh"), F.col("a"), F.col("b"), F.col("sigma"), F.col("x_max")))
    check = fits.height_check(height, F.col("predicted"), F.col("sigma"), F.col("size_class") > 8 * height, F.col("dbh").isNotNull(), 1.5)
    return p.select("tree_id", F.round("predicted", 4).alias("predicted_height"), check.alias("verdict"))


@query("m9_coefficients", f"WITH {FITS}, ok AS (SELECT * FROM ft WHERE {GATE}), t AS (SELECT DISTINCT genus, form FROM grown) SELECT t.genus, t.form, coalesce(x.level, y.level, z.level) AS fit_level, round(coalesce(x.b, y.b, z.b), 6) AS b, round(d.b, 6) AS tail_b FROM t LEFT JOIN ok x ON x.level = 'genus' AND x.taxon = t.genus LEFT JOIN ok y ON y.level = 'form' AND y.taxon = t.form LEFT JOIN ok z ON z.level = 'all' LEFT JOIN ft d ON d.level = 'form' AND d.taxon = t.form")
def _(v: Views) -> DataFrame:
    c = fits.coefficients(grown(v).select("genus", "form").distinct(), fitted(v), LEVELS, "form")
    return c.select("genus", "form", "fit_level", F.round("b", 6).alias("b"), F.round("tail_b", 6).alias("tail_b"))


def taxa(v: Views) -> DataFrame:
    """Observations with a family and a division of their genus; one family of three has few trees."""
    size = F.length("genus")
    family = F.when(F.col("genus") == "Red", "Solo").otherwise(F.concat(F.lit("F"), size % 2))
    return v.obs.withColumn("family", family).withColumn("division", F.when(F.col("genus").isin("Red", "Old"), "Minor").otherwise("Major"))


TAXA = """tx AS (SELECT *, CASE WHEN genus = 'Red' THEN 'Solo' ELSE concat('F', length(genus) % 2) END AS family, CASE WHEN genus IN ('Red', 'Old') THEN 'Minor' ELSE 'Major' END AS division FROM obs), pt AS (SELECT *, ln(dbh) AS lx, ln(crown_width_m) AS ly FROM tx WHERE dbh > 0 AND crown_width_m > 0),
f4 AS (SELECT CASE WHEN g = 0 THEN 'genus' WHEN fa = 0 THEN 'family' WHEN di = 0 THEN 'division' ELSE 'global' END AS lv, CASE WHEN g = 0 THEN genus WHEN fa = 0 THEN family WHEN di = 0 THEN division ELSE 'all' END AS tn, * FROM (SELECT genus, family, division, grouping(genus) AS g, grouping(family) AS fa, grouping(division) AS di, count(*) AS n, regr_slope(ly, lx) AS b, regr_intercept(ly, lx) AS a, sqrt(greatest(regr_syy(ly, lx) - regr_slope(ly, lx) * regr_sxy(ly, lx), 0) / (count(*) - 2)) AS sigma, exp(max(lx)) AS dbh_max FROM pt GROUP BY GROUPING SETS ((genus), (family), (division), ()))),
fx AS (SELECT lv, tn, n, b, exp(a + sigma * sigma / 2) AS scale, dbh_max, lv = 'global' OR (n > (SELECT avg(n) FROM f4 WHERE lv = 'genus')) AS ok FROM f4),
rw AS (SELECT DISTINCT 'genus' AS level, genus AS taxon, genus, family, division FROM tx UNION ALL SELECT DISTINCT 'family', family, NULL, family, min(division) OVER (PARTITION BY family) FROM tx UNION ALL SELECT DISTINCT 'division', division, NULL, NULL, division FROM tx UNION ALL SELECT 'global', 'all', NULL, NULL, NULL),
ow AS (SELECT rw.*, o.lv AS fit_level, o.tn AS fit_taxon, o.n, o.b, o.scale, o.dbh_max FROM rw JOIN fx o ON o.ok AND ((o.lv = 'genus' AND o.tn = rw.genus) OR (o.lv = 'family' AND o.tn = rw.family) OR (o.lv = 'division' AND o.tn = rw.division) OR o.lv = 'global') QUALIFY row_number() OVER (PARTITION BY level, taxon ORDER BY CASE o.lv WHEN 'genus' THEN 0 WHEN 'family' THEN 1 WHEN 'division' THEN 2 ELSE 3 END) = 1),
co AS (SELECT level, taxon, fit_level, fit_taxon, ow.n, ow.b, ow.scale, ow.dbh_max, CASE WHEN fit_level IN ('genus', 'family') THEN coalesce(d.tn, 'all') ELSE fit_taxon END AS tail_taxon, CASE WHEN fit_level IN ('genus', 'family') THEN coalesce(d.b, g.b) ELSE ow.b END AS tail_b, CASE WHEN fit_level IN ('genus', 'family') THEN greatest(coalesce(d.dbh_max, g.dbh_max), ow.dbh_max) ELSE ow.dbh_max END AS tail_dbh_max FROM ow LEFT JOIN fx d ON d.lv = 'division' AND d.ok AND d.tn = ow.division CROSS JOIN (FROM fx WHERE lv = 'global') g WHERE level = 'genus' OR level = fit_level)"""


def reference(v: Views) -> DataFrame:
    known = taxa(v).where("dbh > 0 AND crown_width_m > 0")
    mean = known.groupBy("genus").count().agg(F.avg("count")).head()[0] or 0.0  # a row a genus
    return fits.reference_coefficients(taxa(v), F.col("dbh"), F.col("crown_width_m"), F.col("n") > mean)


@query("m9_reference_coefficients", f"WITH {{OBS}}, {TAXA} SELECT level, taxon, fit_level, fit_taxon, n, round(b, 6) AS b, round(scale, 6) AS scale, round(dbh_max, 6) AS dbh_max, tail_taxon, round(tail_b, 6) AS tail_b, round(tail_dbh_max, 6) AS tail_dbh_max FROM co")
def _(v: Views) -> DataFrame:
    return reference(v).select("level", "taxon", "fit_level", "fit_taxon", "n", "tail_taxon", *[F.round(c, 6).alias(c) for c in ("b", "scale", "dbh_max", "tail_b", "tail_dbh_max")])


@query("m7_crown_from_table", f"""WITH {{OBS}}, {TAXA}, z AS (SELECT tree_id, greatest(dbh * 1.5, 1.0) AS d, dbh, coalesce(g.scale, v.scale, w.scale) AS scale, coalesce(g.b, v.b, w.b) AS b, coalesce(g.dbh_max, v.dbh_max, w.dbh_max) AS m, coalesce(g.tail_b, v.tail_b, w.tail_b) AS tb, coalesce(g.tail_dbh_max, v.tail_dbh_max, w.tail_dbh_max) AS tm, coalesce(g.fit_level, v.fit_level, w.fit_level) AS crown_level
FROM tx LEFT JOIN co g ON g.level = 'genus' AND g.taxon = tx.genus AND order_key % 3 > 0 LEFT JOIN co v ON v.level = 'division' AND v.taxon = tx.division CROSS JOIN (FROM co WHERE level = 'global') w)
SELECT tree_id, CASE WHEN dbh IS NOT NULL THEN round(2 * scale * pow(least(least(d, tm), m), b) * pow(greatest(least(d, tm) / m, 1.0), tb), 6) END AS crown_width, CASE WHEN dbh IS NOT NULL THEN crown_level END AS crown_level FROM z""")
def _(v: Views) -> DataFrame:
    """Widths from the fitted table; a third of the trees have a genus that it lacks, and some stems lie past every fit."""
    trees = taxa(v).select("tree_id", "dbh", F.when(F.col("order_key") % 3 > 0, F.col("genus")).otherwise("Lacking").alias("genus"), "division")
    return fits.crown_widths(trees, reference(v), F.col("dbh") * 1.5).select("tree_id", F.round("crown_width", 6).alias("crown_width"), "crown_level")


RANKS = "rk AS (SELECT *, rank() OVER (PARTITION BY city ORDER BY dbh) + (count(*) OVER (PARTITION BY city, dbh) - 1) / 2 AS rx, rank() OVER (PARTITION BY city ORDER BY crown_width_m) + (count(*) OVER (PARTITION BY city, crown_width_m) - 1) / 2 AS ry FROM obs WHERE dbh IS NOT NULL AND crown_width_m IS NOT NULL)"


@query("m10_correlations", f"WITH {{OBS}}, {RANKS} SELECT city, count(*) AS n, round(corr(dbh, crown_width_m), 6) AS pearson, round(corr(rx, ry), 6) AS spearman FROM rk GROUP BY city")
def _(v: Views) -> DataFrame:
    return fits.correlations(v.obs, "dbh", "crown_width_m", ["city"]).select("city", "n", F.round("pearson", 6).alias("pearson"), F.round("spearman", 6).alias("spearman"))


def spearman_sql(name: str, x: str, y: str) -> str:
    rank = lambda c: f"rank() OVER (PARTITION BY replicate ORDER BY {c}) + (count(*) OVER (PARTITION BY replicate, {c}) - 1) / 2.0"
    return f"{name} AS (SELECT replicate, corr(rx, ry) AS r FROM (SELECT replicate, {rank(x)} AS rx, {rank(y)} AS ry FROM sample) GROUP BY replicate)"


@query("m11_block_bootstrap", f"""WITH {{OBS}}, tiles AS (SELECT city, row_number() OVER (ORDER BY city) - 1 AS nth, count(*) OVER () AS n FROM (SELECT DISTINCT city FROM obs WHERE dbh IS NOT NULL AND crown_width_m IS NOT NULL)), d AS (SELECT i // n AS replicate, i, n FROM (SELECT max(n) AS n FROM tiles), unnest(range(40 * n)) t(i)),
draws AS (SELECT replicate, floor(('0x' || substr(md5(concat('draw|', replicate, '|', i)), 1, 8))::BIGINT / 4294967296.0 * n)::BIGINT AS nth FROM d), sample AS (SELECT replicate, dbh, crown_width_m, size_class FROM draws JOIN tiles USING (nth) JOIN obs USING (city) WHERE dbh IS NOT NULL AND crown_width_m IS NOT NULL),
{spearman_sql('one', 'dbh', 'crown_width_m')}, {spearman_sql('two', 'dbh', 'size_class')} SELECT count(*) AS replicates, round(quantile_cont(one.r - two.r, 0.025), 6) AS low, round(quantile_cont(one.r - two.r, 0.975), 6) AS high FROM one JOIN two USING (replicate)""")
def _(v: Views) -> DataFrame:
    rows = v.obs.where("dbh is not null and crown_width_m is not null").select("city", "dbh", "crown_width_m", F.col("size_class").cast("double").alias("size"))
    out = fits.block_bootstrap(rows, "city", 40, [("dbh", "crown_width_m"), ("dbh", "size")])
    return out.withColumns({c: F.round(c, 6) for c in ("low", "high")})


@query("m12_matched_comparison", f"WITH {{OBS}}, {RANKS}, c AS (SELECT city, corr(dbh, crown_width_m) AS p, corr(rx, ry) AS s FROM rk GROUP BY city) SELECT city, round(least(abs(p), abs(s)), 6) AS weaker FROM c ORDER BY weaker DESC, city LIMIT 4")
def _(v: Views) -> DataFrame:
    c = fits.correlations(v.obs, "dbh", "crown_width_m", ["city"])
    return c.select("city", F.round(F.least(F.abs("pearson"), F.abs("spearman")), 6).alias("weaker")).orderBy(F.desc("weaker"), "city").limit(4)


@query("m13_offset_modes", "WITH d AS (SELECT l_linenumber AS g, l_quantity / 4 AS dx, l_tax * 50 AS dy FROM lineitem), b AS (SELECT g, floor(dx + 0.5)::BIGINT AS bx, floor(dy + 0.5)::BIGINT AS \"by\", count(*) AS n, round(median(dx), 6) AS mx, round(median(dy), 6) AS my FROM d GROUP BY ALL) SELECT g AS \"group\", bx, \"by\", n, mx, my FROM b QUALIFY row_number() OVER (PARTITION BY g ORDER BY n DESC, bx, \"by\") <= 12")
def _(v: Views) -> DataFrame:
    d = v.table("lineitem").select(F.col("l_linenumber").alias("group"), (F.col("l_quantity") / 4).alias("dx"), (F.col("l_tax") * 50).alias("dy"))
    return fits.offset_modes(d, 12).select("group", "bx", "by", "n", F.round("mx", 6).alias("mx"), F.round("my", 6).alias("my"))


@query("m13_registration")
def _(v: Views) -> DataFrame:
    """Trees of tiles, and detections of four in five of them that lie off by an offset of their tile."""
    p = points(v).where("line > 5").withColumn("group", F.concat_ws("_", F.floor(F.col("x") / 500), F.floor(F.col("y") / 500)))
    moved = p.where("part_key % 5 > 0").select("group", "id", (F.col("x") + 3 + F.floor(F.col("x") / 500) % 3).alias("x"), (F.col("y") - 2 + (F.col("order_key") % 7 - 3) / 10).alias("y"))
    found = registration.offsets(p.select("group", "id", "x", "y"), moved)
    return found.withColumns({c: F.round(c, 3) for c in ("dx", "dy", "residual", "alternative_fraction")})


@query("g2_disk_raster", f"""WITH {{OBS}}, {PTS}, k AS (SELECT id, x, y, greatest(2.0, least(coalesce(dbh, 0) / 5, 6.0)) AS r, coalesce(dbh, 0) AS height FROM pts WHERE line = 1), c AS (SELECT id, height, cx, cy, sqrt(((cx + 0.5) * 2 - x) ** 2 + ((cy + 0.5) * 2 - y) ** 2) / r AS ratio FROM (SELECT *, unnest(range(floor((x - r) / 2)::BIGINT, floor((x + r) / 2)::BIGINT + 1)) AS cx FROM k), unnest(range(floor((y - r) / 2)::BIGINT, floor((y + r) / 2)::BIGINT + 1)) t(cy))
SELECT cx, cy, id FROM c WHERE ratio <= 1 QUALIFY row_number() OVER (PARTITION BY cx, cy ORDER BY ratio, height DESC, id) = 1""")
def _(v: Views) -> DataFrame:
    k = points(v).where("line = 1").select("id", "x", "y", (F.coalesce("dbh", F.lit(0.0)) / 5).alias("r"), F.coalesce("dbh", F.lit(0.0)).alias("height"))
    return grids.disk_cells(k, 2.0, 2.0, 6.0).select("cx", "cy", "id")


@query("g3_nearest_open_cell", f"""WITH {{OBS}}, {PTS}, b AS (SELECT DISTINCT floor(x / 20)::BIGINT AS cx, floor(y / 20)::BIGINT AS cy FROM pts), f AS (SELECT DISTINCT cx + i AS ox, cy + j AS oy FROM b, range(-1, 2) p(i), range(-1, 2) q(j) WHERE (cx + i, cy + j) NOT IN (SELECT (cx, cy) FROM b)), d AS (SELECT cx, cy, ox, oy, sqrt((cx - ox) ** 2 + (cy - oy) ** 2) AS d FROM b, f WHERE abs(cx - ox) <= 16 AND abs(cy - oy) <= 16)
SELECT cx, cy, arg_min(ox, (d, ox, oy)) AS ox, arg_min(oy, (d, ox, oy)) AS oy, min(d) AS distance FROM d WHERE d <= 16 GROUP BY cx, cy""")
def _(v: Views) -> DataFrame:
    blocked = points(v).select(F.floor(F.col("x") / 20).alias("cx"), F.floor(F.col("y") / 20).alias("cy")).distinct()
    return grids.nearest_open(checkpointed(blocked), 16, checkpointed)


#: The nearest two anchors of each row and the nearest row of each anchor, without a limit, by trying all.
ACROSS = """q AS (SELECT id, x, y FROM pts WHERE line = 2), a AS (SELECT id, x, y FROM pts WHERE line > 6), w AS (SELECT q.id AS q, a.id AS a, sqrt((q.x - a.x) ** 2 + (q.y - a.y) ** 2) AS d FROM q, a),
t AS (SELECT q AS id, min(struct_pack(d := d, a := a)).a AS nearest, list_sort(min(d, 2)) AS ds FROM w GROUP BY q), bk AS (SELECT a, min(struct_pack(d := d, q := q)).q AS back FROM w GROUP BY a), nn AS (SELECT id, nearest, ds[1] AS d1, ds[2] AS d2, back = id AS mutual FROM t JOIN bk ON nearest = bk.a)"""


@query("j8_across_tables", f"WITH {{OBS}}, {PTS}, {ACROSS} SELECT id, nearest, round(d1, 6) AS d1, round(d2, 6) AS d2, mutual FROM nn")
def _(v: Views) -> DataFrame:
    p = points(v)
    near = calibration.nearest_across(p.where("line = 2"), p.where("line > 6"))
    return near.select("id", "nearest", F.round("d1", 6).alias("d1"), F.round("d2", 6).alias("d2"), "mutual")


@query("j8_spacing", f"WITH {{OBS}}, {PTS}, a AS (SELECT id, x, y FROM pts WHERE line > 6), d AS (SELECT one.id, min(sqrt((one.x - o.x) ** 2 + (one.y - o.y) ** 2)) AS d FROM a one, a o WHERE one.id <> o.id GROUP BY 1) SELECT round(quantile_cont(d, 0.1), 6) AS p10, round(quantile_cont(d, 0.5), 6) AS p50, round(quantile_cont(d, 0.9), 6) AS p90 FROM d")
def _(v: Views) -> DataFrame:
    return calibration.spacing(points(v).where("line > 6"), (0.1, 0.5, 0.9)).select(*[F.round(c, 6).alias(c) for c in ("p10", "p50", "p90")])


@query("g9_grid_calibration", f"""WITH {{OBS}}, {PTS}, {ACROSS}, s AS (SELECT unnest([4.0, 8.0, 16.0, 32.0])::DOUBLE AS size), g(dx, dy) AS (VALUES (0, 0), (0.5, 0), (0, 0.5), (0.5, 0.5)), c AS (SELECT DISTINCT size, dx, dy, floor(x / size + dx) AS cx, floor(y / size + dy) AS cy FROM a, s, g),
f AS (SELECT DISTINCT q.id, s.size FROM q, s, g JOIN c ON c.size = s.size AND c.dx = g.dx AND c.dy = g.dy AND c.cx = floor(q.x / s.size + g.dx) AND c.cy = floor(q.y / s.size + g.dy)), e AS (SELECT nn.*, s.size, f.id IS NOT NULL AS flag FROM nn CROSS JOIN s LEFT JOIN f ON f.id = nn.id AND f.size = s.size),
n AS (SELECT size, count(*) AS points, count_if(flag) AS flagged, count_if(flag AND mutual) AS true_duplicates, count_if(flag AND NOT mutual) AS false_duplicates, count_if(mutual) AS m, count_if(d1 <= size / 2 AND NOT flag) AS missed, count_if(d1 > size * sqrt(2) AND flag) AS beyond FROM e GROUP BY size),
o AS (SELECT *, true_duplicates - lag(true_duplicates) OVER (ORDER BY size) AS more_true, false_duplicates - lag(false_duplicates) OVER (ORDER BY size) AS more_false FROM n)
SELECT size, points, flagged, true_duplicates, false_duplicates, round(true_duplicates / greatest(m, 1), 6) AS recall, missed, beyond, more_true, more_false, CASE WHEN more_false <> 0 THEN round(more_true / more_false, 6) END AS marginal FROM o""")
def _(v: Views) -> DataFrame:
    p = points(v)
    found = calibration.grid_calibration(p.where("line = 2"), p.where("line > 6"), (4.0, 8.0, 16.0, 32.0))
    return found.withColumns({c: F.round(c, 6) for c in ("recall", "marginal")})


@query("g10_pixel_mask", "SELECT event_id, (event_id & 12) = 0 AND value BETWEEN 1 AND 90 AS ok FROM events")
def _(v: Views) -> DataFrame:
    return v.table("events").select("event_id", grids.pixel_ok(F.col("event_id"), 12, F.col("value"), 1, 90).alias("ok"))


HEAT = "ht AS (SELECT user_id % 30 AS cx, hour(ts)::BIGINT AS cy, avg(value) AS value, count(*) AS n FROM events GROUP BY ALL HAVING count(*) >= 5), vw AS (SELECT n_nationkey AS view, n_nationkey % 5 * 5 AS x0, n_nationkey // 5 * 4 AS y0 FROM nation), dl AS (SELECT view, cx, cy, value - avg(value) OVER (PARTITION BY view) AS delta, count(*) OVER (PARTITION BY view) AS cells FROM ht JOIN vw ON cx BETWEEN x0 AND x0 + 5 AND cy BETWEEN y0 AND y0 + 5)"


def deltas(v: Views) -> DataFrame:
    heat = v.table("events").groupBy((F.col("user_id") % 30).alias("cx"), F.hour("ts").cast("long").alias("cy")).agg(F.avg("value").alias("value"), F.count("*").alias("n")).where("n >= 5").drop("n")
    k = F.col("n_nationkey").cast("long")
    return grids.view_deltas(heat, v.table("nation").select(k.alias("view"), (k % 5 * 5).alias("x0"), (F.floor(k / 5) * 4).alias("y0"), F.lit(6).alias("n")))


@query("g11_view_deltas", f"WITH {HEAT} SELECT view::BIGINT AS view, cx, cy, round(delta, 6) AS delta, cells FROM dl")
def _(v: Views) -> DataFrame:
    return deltas(v).withColumn("delta", F.round("delta", 6))


@query("g12_crown_cover", f"""WITH {{OBS}}, {PTS}, k AS (SELECT x, y, least(dbh / 10, 1e9) AS r FROM pts WHERE dbh IS NOT NULL), a AS (SELECT *, unnest(range(floor((x - r) / 2)::BIGINT, floor((x + r) / 2)::BIGINT + 1)) AS cx FROM k), c AS (SELECT *, unnest(range(floor((y - r) / 2)::BIGINT, floor((y + r) / 2)::BIGINT + 1)) AS cy FROM a),
d AS (SELECT DISTINCT cx, cy FROM c WHERE sqrt(((cx + 0.5) * 2 - x) ** 2 + ((cy + 0.5) * 2 - y) ** 2) / r <= 1) SELECT floor(cx / 50)::BIGINT AS bx, floor(cy / 50)::BIGINT AS by, count(*) / 2500 AS share FROM d GROUP BY 1, 2""")
def _(v: Views) -> DataFrame:
    k = points(v).where("dbh is not null").select("id", "x", "y", (F.col("dbh") / 10).alias("r"), F.col("dbh").alias("height"))
    return grids.covered_share(k, 2.0, 50)


@query("g13_extremes", f"WITH {HEAT} SELECT view::BIGINT AS view, arg_max(concat(cx, '_', cy), (round(delta, 6), concat(cx, '_', cy))) AS hottest, arg_min(concat(cx, '_', cy), (round(delta, 6), concat(cx, '_', cy))) AS coolest FROM dl GROUP BY view")
def _(v: Views) -> DataFrame:
    d = deltas(v).withColumn("delta", F.round("delta", 6)).withColumn("cell", F.concat_ws("_", "cx", "cy"))
    return grids.extremes(d, "view", "delta", "cell")


@query("g14_cell_owner", f"WITH {HEAT} SELECT concat(cx, '_', cy) AS cell, arg_min(view, (abs(cx - (x0 + 2.5)) + abs(cy - (y0 + 2.5)), view))::BIGINT AS view FROM dl JOIN vw USING (view) GROUP BY 1")
def _(v: Views) -> DataFrame:
    k = F.col("view")
    away = F.abs(F.col("cx") - (k % 5 * 5 + 2.5)) + F.abs(F.col("cy") - (F.floor(k / 5) * 4 + 2.5))
    return grids.cell_owner(deltas(v).select(F.concat_ws("_", "cx", "cy").alias("cell"), "view", away.alias("distance"))).select("cell", "view")


@query("g15_water_exclusion", f"WITH {{OBS}}, {RANKS} SELECT 'all' AS which, count(*) AS n, round(corr(dbh, crown_width_m), 6) AS pearson FROM rk UNION ALL SELECT 'land', count(*), round(corr(dbh, crown_width_m), 6) FROM rk WHERE size_class / 50.0 >= 0.5")
def _(v: Views) -> DataFrame:
    c = lambda df, name: fits.correlations(df, "dbh", "crown_width_m").select(F.lit(name).alias("which"), "n", F.round("pearson", 6).alias("pearson"))
    return c(v.obs, "all").union(c(v.obs.where(F.col("size_class") / 50.0 >= 0.5), "land"))
