"""Queries of the evaluation operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborscale.functions.lineage import checkpointed
from arborscale.operators import evalmatch as ev
from arborscale.operators import rank
from arborscale.plans.q_lookups import PTS, points
from arborscale.plans.registry import Views, query

CHIP = "concat_ws('_', floor(x / 100)::BIGINT, floor(y / 100)::BIGINT)"
EV = f"{{OBS}}, {PTS}, pred AS (SELECT id, {CHIP} AS chip, x, y, dbh / 50 AS score, genus, part_key FROM pts WHERE line = 3 AND dbh IS NOT NULL), truth AS (SELECT id, {CHIP} AS chip, x, y, dbh, genus, part_key FROM pts WHERE line > 5)"
#: Every prediction with the genus of a truth as what it says: labels for the classification metrics.
LAB = "{OBS}, lab AS (SELECT tree_id AS id, city, genus AS truth, CASE WHEN order_key % 4 = 0 THEN 'Red' WHEN order_key % 4 = 1 THEN 'Blue' ELSE genus END AS predicted, dbh, crown_width_m, order_key, part_key, line FROM obs)"
F_ = "round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1"


def tables(v: Views) -> tuple[DataFrame, DataFrame]:
    chip = F.concat_ws("_", F.floor(F.col("x") / 100), F.floor(F.col("y") / 100))
    p = points(v).withColumn("chip", chip)
    return p.where("line = 3 and dbh is not null").withColumn("score", F.col("dbh") / 50), p.where("line > 5")


def labelled(v: Views) -> DataFrame:
    k = F.col("order_key") % 4
    return v.obs.select(F.col("tree_id").alias("id"), "city", F.col("genus").alias("truth"), F.when(k == 0, "Red").when(k == 1, "Blue").otherwise(F.col("genus")).alias("predicted"), "dbh", "crown_width_m", "order_key", "part_key", "line")


def matched(v: Views, radius: float = 12.0, nearest_first: bool = False) -> DataFrame:
    return ev.matched(*tables(v), radius, nearest_first)


def greedy_sql(radius: str = "12", pred: str = "pred", k: str = "") -> str:
    """Twin of the greedy match: a walk over the predictions of each chip with the list of truths taken so far. The last
    table is ``m`` (``p_id``, ``t_id``, ``distance``); ``k`` sets the tables of one match apart from another's."""
    d = "sqrt((p.x - t.x) ** 2 + (p.y - t.y) ** 2)"
    return f"""c{k} AS MATERIALIZED (SELECT p.chip, p.id AS p_id, t.id AS t_id, p.score, {d} AS d FROM {pred} p JOIN truth t USING (chip) WHERE {d} <= {radius}),
o{k} AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY chip ORDER BY score DESC, p_id) AS i FROM (SELECT chip, p_id, score, list(t_id ORDER BY d, t_id) AS ts FROM c{k} GROUP BY ALL)),
w{k}(chip, i, taken, p_id, t_id) AS (SELECT DISTINCT chip, 0::BIGINT, []::VARCHAR[], NULL::VARCHAR, NULL::VARCHAR FROM o{k} UNION ALL SELECT chip, i, CASE WHEN f IS NULL THEN taken ELSE list_append(taken, f) END, p_id, f FROM (SELECT w.chip, w.taken, o.i, o.p_id, list_filter(o.ts, lambda t: NOT list_contains(w.taken, t))[1] AS f FROM w{k} w JOIN o{k} o ON w.chip = o.chip AND o.i = w.i + 1)),
m{k} AS MATERIALIZED (SELECT p_id, t_id, d AS distance FROM w{k} JOIN c{k} USING (p_id, t_id))"""


@query("e1_greedy_match", f"WITH RECURSIVE {EV}, {greedy_sql()} FROM m")
def _(v: Views) -> DataFrame:
    return matched(v)


@query("e2_variable_radius_match", f"WITH RECURSIVE {EV}, {greedy_sql('coalesce(greatest(least(t.dbh / 4, 12), 6), 6)')} FROM m")
def _(v: Views) -> DataFrame:
    p, t = tables(v)
    radius = F.coalesce(F.greatest(F.least(F.col("dbh") / 4, F.lit(12.0)), F.lit(6.0)), F.lit(6.0))
    return ev.matched(p, t.withColumn("radius", radius), "radius")


@query("e3_nearest_first_match", f"""WITH RECURSIVE {EV}, c AS (SELECT p.chip, p.id AS p_id, t.id AS t_id, sqrt((p.x - t.x) ** 2 + (p.y - t.y) ** 2) AS d FROM pred p JOIN truth t USING (chip) WHERE sqrt((p.x - t.x) ** 2 + (p.y - t.y) ** 2) <= 12), o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY chip ORDER BY d, p_id, t_id) AS i FROM c),
w(chip, i, taken, p_id, t_id, distance) AS (SELECT DISTINCT chip, 0::BIGINT, []::VARCHAR[], NULL::VARCHAR, NULL::VARCHAR, NULL::DOUBLE FROM o UNION ALL SELECT o.chip, o.i, CASE WHEN list_has_any(w.taken, [o.p_id, o.t_id]) THEN w.taken ELSE list_concat(w.taken, [o.p_id, o.t_id]) END, CASE WHEN NOT list_has_any(w.taken, [o.p_id, o.t_id]) THEN o.p_id END, o.t_id, o.d FROM w JOIN o ON w.chip = o.chip AND o.i = w.i + 1)
SELECT p_id, t_id, distance FROM w WHERE p_id IS NOT NULL""")
def _(v: Views) -> DataFrame:
    return matched(v, nearest_first=True)


@query("e4_mask_aware_counts", f"""WITH RECURSIVE {EV}, {greedy_sql()}, n AS (SELECT count(*) FILTER (WHERE p.id IN (SELECT p_id FROM m)) AS tp, count(*) FILTER (WHERE p.id NOT IN (SELECT p_id FROM m) AND p.part_key % 5 <> 0) AS fp, count(*) FILTER (WHERE p.id NOT IN (SELECT p_id FROM m) AND p.part_key % 5 = 0) AS ignored FROM pred p),
k AS (SELECT *, (SELECT count(*) FROM truth) - tp AS fn FROM n) SELECT tp, fp, fn, ignored, {F_}, round(CASE WHEN 5 * tp + 4 * fn + fp > 0 THEN 5 * tp / (5 * tp + 4 * fn + fp) ELSE 0 END, 6) AS f2 FROM k""")
def _(v: Views) -> DataFrame:
    p, t = tables(v)
    n = ev.match_counts(p.withColumn("mask", F.col("part_key") % 5), t, matched(v), "mask")
    return n.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1", "f2")})


#: The second model sees two thirds of the predictions, with lower scores.
NEWER = f"{EV}, newer AS (SELECT * REPLACE (score * 0.75 AS score) FROM pred WHERE part_key % 3 <> 0)"


@query("r16_review_rank", f"""WITH RECURSIVE {EV}, {greedy_sql()}, s AS (SELECT p.chip, count(*) AS predictions, count(m.t_id) AS matched, count(*) FILTER (WHERE m.t_id IS NULL AND p.part_key % 5 = 0) AS ignored, count(*) FILTER (WHERE p.genus <> t.genus) AS label_errors FROM pred p LEFT JOIN m ON m.p_id = p.id LEFT JOIN truth t ON t.id = m.t_id GROUP BY 1),
t AS (SELECT chip, count(*) AS truths FROM truth GROUP BY 1), b AS (SELECT coalesce(s.chip, t.chip) AS chip, coalesce(predictions, 0) AS predictions, coalesce(matched, 0) AS matched, coalesce(ignored, 0) AS ignored, coalesce(label_errors, 0) AS label_errors, coalesce(truths, 0) AS truths FROM s FULL JOIN t ON s.chip = t.chip),
k AS (SELECT *, truths - matched AS missed, predictions - matched - ignored AS false_positive, truths - matched + predictions - matched - ignored + label_errors AS error_score FROM b)
SELECT *, round(CASE WHEN 2 * matched + false_positive + missed > 0 THEN 2 * matched / (2 * matched + false_positive + missed) ELSE 1 END, 6) AS f1, row_number() OVER (ORDER BY error_score DESC, chip)::INT AS place FROM k""")
def _(v: Views) -> DataFrame:
    p, t = tables(v)
    return ev.review_rank(p.withColumn("mask", F.col("part_key") % 5), t, matched(v), "genus", "mask").withColumn("f1", F.round("f1", 6))


@query("e5_model_diff", f"""WITH RECURSIVE {NEWER}, {greedy_sql('8', 'pred', '1')}, {greedy_sql('8', 'newer', '2')}, {greedy_sql('16', 'newer', '3')},
s AS (SELECT id, score FROM newer), r AS (SELECT id, score FROM pred), old AS (SELECT t_id FROM m1 JOIN r ON p_id = r.id WHERE score >= 0.35), n AS (SELECT t_id, score FROM m2 JOIN s ON p_id = s.id), wide AS (SELECT t_id FROM m3 JOIN s ON p_id = s.id WHERE score >= 0.35)
SELECT id, CASE WHEN x AND y THEN 'both hit' WHEN x THEN 'regression' WHEN y THEN 'improvement' ELSE 'both miss' END AS change, CASE WHEN x AND NOT y THEN CASE WHEN id IN (SELECT t_id FROM n WHERE score >= 0.2) THEN 'score 0.20' WHEN id IN (SELECT t_id FROM n WHERE score >= 0.1) THEN 'score 0.10' WHEN id IN (FROM wide) THEN 'radius' ELSE 'not recovered' END END AS diagnosis
FROM (SELECT id, id IN (FROM old) AS x, id IN (SELECT t_id FROM n WHERE score >= 0.35) AS y FROM truth)""")
def _(v: Views) -> DataFrame:
    p, t = tables(v)
    newer = p.where("part_key % 3 <> 0").withColumn("score", F.col("score") * 0.75)
    run = lambda pred, radius: checkpointed(ev.matched(pred, t, radius))
    near, wide = run(newer, 8.0), run(newer, 16.0)
    looser = {"score 0.20": ev.above(near, newer, 0.2), "score 0.10": ev.above(near, newer, 0.1), "radius": ev.above(wide, newer, 0.35)}
    return ev.model_diff(t, ev.above(run(p, 8.0), p, 0.35), ev.above(near, newer, 0.35), looser)


@query("e6_coverage_check", f"WITH {EV}, done AS (SELECT chip, count(*) AS runs, sum(n) AS predictions FROM (SELECT chip, line, CASE WHEN count(*) > 3 THEN 0 ELSE 1 END AS n FROM (SELECT {CHIP} AS chip, line FROM pts WHERE line IN (1, 2)) GROUP BY ALL) GROUP BY chip), asked AS (SELECT DISTINCT chip FROM truth) SELECT coalesce(a.chip, d.chip) AS chip, CASE WHEN d.chip IS NULL THEN 'missing' WHEN a.chip IS NULL THEN 'unrequested' WHEN runs > 1 THEN 'repeated' ELSE 'empty' END AS problem FROM asked a FULL JOIN done d ON a.chip = d.chip WHERE d.chip IS NULL OR a.chip IS NULL OR runs > 1 OR predictions = 0")
def _(v: Views) -> DataFrame:
    chip = F.concat_ws("_", F.floor(F.col("x") / 100), F.floor(F.col("y") / 100))
    done = points(v).where("line in (1, 2)").groupBy(chip.alias("chip"), "line").agg(F.when(F.count("*") > 3, 0).otherwise(1).alias("predictions"))
    return ev.coverage_check(tables(v)[1].select("chip").distinct(), done)


@query("e7_label_eligibility", "WITH {OBS} SELECT tree_id, CASE WHEN dbh IS NULL OR dbh < 4 OR dbh > 45 THEN 'dbh' WHEN species IN ('Red bolt', 'Hot gear') THEN 'species' WHEN plant_date > DATE '2000-01-01' THEN 'planted late' ELSE 'ok' END AS eligible FROM obs")
def _(v: Views) -> DataFrame:
    return v.obs.select("tree_id", ev.eligible(F.col("dbh"), F.col("species"), F.col("plant_date"), ["Red bolt", "Hot gear"], 4, 45, F.lit("2000-01-01").cast("date")).alias("eligible"))


@query("e8_taxonomy", "WITH {OBS}, t AS (SELECT species, row_number() OVER (ORDER BY count(*) DESC, species) - 1 AS k FROM obs GROUP BY species HAVING count(*) >= 900 ORDER BY k LIMIT 20) SELECT tree_id, coalesce(k, -1)::INT AS species_id FROM obs LEFT JOIN t USING (species)")
def _(v: Views) -> DataFrame:
    return ev.encoded(v.obs, ev.taxonomy(v.obs, 900, 20)).select("tree_id", "species_id")


@query("e8_genus_ids", "WITH {OBS}, t AS (SELECT species FROM obs GROUP BY species HAVING count(*) >= 900 ORDER BY count(*) DESC, species LIMIT 20) SELECT genus, (row_number() OVER (ORDER BY genus) - 1)::INT AS genus_id FROM (SELECT DISTINCT split_part(species, ' ', 1) AS genus FROM t)")
def _(v: Views) -> DataFrame:
    return ev.genus_taxonomy(ev.taxonomy(v.obs, 900, 20))


HASH = "('0x' || substr(md5(concat('seed|', floor(x / 250)::BIGINT + {i}, '|', floor(y / 250)::BIGINT + {j})), 1, 8))::BIGINT / 4294967296.0"
SPLIT = lambda i, j: f"CASE WHEN {HASH.format(i=i, j=j)} < 0.7 THEN 'train' WHEN {HASH.format(i=i, j=j)} < 0.85 THEN 'val' ELSE 'test' END"
SPLITS = f"{{OBS}}, {PTS}, sp AS (SELECT *, {SPLIT(0, 0)} AS split, {SPLIT(-1, 0)} AS w, {SPLIT(1, 0)} AS e, {SPLIT(0, -1)} AS s, {SPLIT(0, 1)} AS n, x - floor(x / 250) * 250 AS fx, y - floor(y / 250) * 250 AS fy FROM pts), sg AS (SELECT *, (fx < 20 AND w <> split) OR (fx > 230 AND e <> split) OR (fy < 20 AND s <> split) OR (fy > 230 AND n <> split) AS guarded FROM sp)"


@query("e9_spatial_split", f"WITH {SPLITS} SELECT id, split, guarded FROM sg")
def _(v: Views) -> DataFrame:
    return ev.spatial_split(points(v), 250.0, 20.0, "seed").select("id", "split", "guarded")


@query("e10_inventory_summary", f"WITH {SPLITS} SELECT split, count(*) AS trees, count_if(dbh IS NOT NULL) AS with_dbh, count_if(guarded) AS guarded FROM sg GROUP BY split")
def _(v: Views) -> DataFrame:
    return ev.spatial_split(points(v), 250.0, 20.0, "seed").groupBy("split").agg(F.count("*").alias("trees"), F.count_if(F.col("dbh").isNotNull()).alias("with_dbh"), F.count_if("guarded").alias("guarded"))


@query("j25_open_edge_neighbours", f"WITH {SPLITS}, d AS (SELECT sg.*, plant_date FROM sg JOIN obs ON tree_id = id), t AS (SELECT DISTINCT floor(x / 50)::BIGINT AS tx, floor(y / 50)::BIGINT AS ty FROM pts WHERE line = 3) SELECT d.id, tx, ty FROM t JOIN d ON d.line > 5 AND d.split <> 'test' AND NOT d.guarded AND coalesce(d.plant_date <= DATE '1996-06-30', true) AND floor(d.x / 50) BETWEEN tx - 1 AND tx + 1 AND floor(d.y / 50) BETWEEN ty - 1 AND ty + 1 AND sqrt((d.x - (tx * 50 + 25)) ** 2 + (d.y - (ty * 50 + 25)) ** 2) <= 30 WHERE NOT (floor(d.x / 50) = tx AND floor(d.y / 50) = ty)")
def _(v: Views) -> DataFrame:
    p = points(v).join(v.obs.select(F.col("tree_id").alias("id"), "plant_date"), "id")
    records = ev.spatial_split(p.where("line > 5"), 250.0, 20.0, "seed")
    tile = lambda c: F.floor(F.col(c) / 50)
    tiles = points(v).where("line = 3").select(tile("x").alias("tx"), tile("y").alias("ty")).distinct()
    return ev.edge_neighbours(tiles, records, 50.0, 30.0, F.lit("1996-06-30").cast("date"))


@query("e11_crown_labels", "WITH {OBS} SELECT tree_id, coalesce(crown_width_m / 2, CASE WHEN genus <> 'Hot' THEN dbh / 8 END) AS radius, CASE WHEN crown_width_m IS NOT NULL THEN 1.0 WHEN genus <> 'Hot' AND dbh IS NOT NULL THEN 0.2 END::DOUBLE AS weight FROM obs")
def _(v: Views) -> DataFrame:
    rows = v.obs.select("tree_id", (F.col("crown_width_m") / 2).alias("human"), (F.col("dbh") / 8).alias("allometric"), (F.col("genus") == "Hot").alias("palm"))
    return ev.crown_labels(rows).select("tree_id", "radius", "weight")


@query("e12_snapshot_gain", "WITH {OBS} SELECT city, round(avg(dbh) - avg(dbh) FILTER (WHERE line < 4), 6) AS mean, count(*) - count(*) FILTER (WHERE line < 4) AS n FROM obs GROUP BY city")
def _(v: Views) -> DataFrame:
    metrics = lambda df: df.groupBy("city").agg(F.avg("dbh").alias("mean"), F.count("*").alias("n"))
    return ev.snapshot_gain(metrics(v.obs.where("line < 4")), metrics(v.obs), "city", ["mean", "n"]).withColumn("mean", F.round("mean", 6))


@query("e12_curation_gain", """WITH {OBS}, c AS (SELECT city, concat('p', part_key % 2) AS policy, line, count_if(size_class > 20) AS tp, count_if(size_class <= 20 AND size_class > 10) AS fp, count_if(size_class <= 10) AS fn, count_if(size_class > 18) AS tp2, count_if(size_class <= 18 AND size_class > 10) AS fp2 FROM obs WHERE line = 3 GROUP BY ALL), n AS (SELECT city, count_if(line = 4) AS trees FROM obs GROUP BY city),
j AS (SELECT city, policy, tp, fp, fn, tp2, fp2, trees FROM c JOIN n USING (city)), e AS (SELECT * FROM j UNION ALL SELECT '(total)', policy, sum(tp), sum(fp), sum(fn), sum(tp2), sum(fp2), sum(trees) FROM j GROUP BY policy),
m AS (SELECT city, policy, trees, unnest(['precision', 'recall', 'f1', 'f2']) AS metric, unnest([tp / (tp + fp), tp / (tp + fn), 2 * tp / (2 * tp + fp + fn), 5 * tp / (5 * tp + 4 * fn + fp)]) AS b, unnest([tp2 / (tp2 + fp2), tp2 / (tp2 + fn), 2 * tp2 / (2 * tp2 + fp2 + fn), 5 * tp2 / (5 * tp2 + 4 * fn + fp2)]) AS a FROM e)
SELECT city, policy, metric, round(coalesce(b, 0), 6) AS before, round(coalesce(a, 0), 6) AS after, round((a - b) * 100, 6) AS delta_pp, CASE WHEN trees > 0 THEN round((a - b) * 10000 / trees, 6) END AS pp_per_100 FROM m""")
def _(v: Views) -> DataFrame:
    """Scores at a fixed threshold before and after labels changed, from counts at several thresholds."""
    size = F.col("size_class")

    def counts(hit: int) -> DataFrame:
        n = v.obs.groupBy("city", F.concat(F.lit("p"), F.col("part_key") % 2).alias("policy"), (F.col("line") / 10).alias("threshold"))
        return n.agg(F.count_if(size > hit).alias("tp"), F.count_if((size <= hit) & (size > 10)).alias("fp"), F.count_if(size <= 10).alias("fn"))

    found = ev.curation_gain(counts(20), counts(18), v.obs.groupBy("city").agg(F.count_if(F.col("line") == 4).alias("n")), 0.3, (v.obs.select("tree_id", "dbh"), v.obs.repartition("dbh").select("dbh", "tree_id")))
    return found.withColumns({c: F.round(c, 6) for c in ("before", "after", "delta_pp", "pp_per_100")})


@query("e13_rebuild_labels", f"WITH {EV}, m AS (SELECT id, part_key, floor(x / 250) % 2 AS split, CASE WHEN dbh >= 10 THEN dbh END AS dbh, x + CASE WHEN part_key % 4 = 0 THEN 3.5 ELSE 1.25 END AS x, y + CASE WHEN part_key % 4 = 0 THEN -2.0 ELSE 0.5 END AS y FROM truth WHERE part_key % 10 <> 0), k AS (SELECT *, {CHIP} AS chip FROM m), b AS (SELECT chip FROM k GROUP BY chip HAVING count(DISTINCT split) > 1) SELECT id, x, y, chip, dbh FROM k WHERE chip NOT IN (FROM b) QUALIFY count(*) OVER (PARTITION BY floor(x), floor(y)) = 1")
def _(v: Views) -> DataFrame:
    t = tables(v)[1].select("id", "x", "y", "part_key", "dbh", (F.col("dbh") >= 10).alias("dbh_eligible"), (F.floor(F.col("x") / 250) % 2).alias("split"))
    moved = t.where("part_key % 4 = 0").select("id", F.lit(3.5).alias("dx"), F.lit(-2.0).alias("dy"))
    return ev.rebuild_labels(t, t.where("part_key % 10 = 0"), moved, (1.25, 0.5), 100.0, {"dbh": "dbh_eligible"}, "drop").select("id", "x", "y", "chip", "dbh")


@query("e14_change_categories", "SELECT p_partkey, CASE WHEN p_partkey % 6 = 0 THEN 'new' WHEN p_partkey % 6 = 1 THEN 'removed' ELSE 'revised' END AS change FROM part WHERE p_partkey % 6 < 3")
def _(v: Views) -> DataFrame:
    k, part = F.col("p_partkey"), v.table("part")
    new = part.where(k % 6 != 1).withColumn("p_size", F.when(k % 6 == 2, -F.col("p_size")).otherwise(F.col("p_size")))
    return ev.change_categories(part.where(k % 6 != 0), new, "p_partkey", ["p_size", "p_name"])


@query("e14_field_counts", "SELECT 'p_size' AS field, count(*) AS rows FROM part WHERE p_partkey % 6 = 2 AND p_size <> 0 UNION ALL SELECT 'p_name', count(*) FROM part WHERE p_partkey % 6 = 3")
def _(v: Views) -> DataFrame:
    k, part = F.col("p_partkey"), v.table("part")
    new = part.withColumn("p_size", F.when(k % 6 == 2, -F.col("p_size")).otherwise(F.col("p_size"))).withColumn("p_name", F.when(k % 6 == 3, "new").otherwise(F.col("p_name")))
    return ev.field_changes(part, new.where(k % 6 != 1), "p_partkey", ["p_size", "p_name", "p_brand"])


@query("e15_window_reasons", f"""WITH {SPLITS}, t AS (SELECT floor(x / 250)::BIGINT AS tx, floor(y / 250)::BIGINT AS ty, min(split) AS split, count(*) AS trees, avg((dbh IS NOT NULL)::INT) AS valid, count_if(guarded) > 0.11 * count(*) AS guarded FROM sg GROUP BY 1, 2)
SELECT CASE WHEN split = 'test' THEN 'test' WHEN guarded THEN 'guarded' WHEN NOT tx < 8 THEN 'outside' WHEN valid < 0.5 THEN 'invalid' ELSE 'used' END AS reason, count(*) AS tiles, sum(trees)::BIGINT AS trees FROM t GROUP BY 1""")
def _(v: Views) -> DataFrame:
    s = ev.spatial_split(points(v), 250.0, 20.0, "seed")
    tiles = s.groupBy(F.floor(F.col("x") / 250).alias("tx"), F.floor(F.col("y") / 250).alias("ty")).agg(F.min("split").alias("split"), F.count("*").alias("trees"), F.avg(F.col("dbh").isNotNull().cast("int")).alias("valid"), (F.count_if("guarded") > 0.11 * F.count("*")).alias("guarded"))
    return ev.window_reasons(tiles.withColumn("inside", F.col("tx") < 8))


@query("a29_class_metrics", f"WITH {LAB}, c AS (SELECT g AS class, count_if(truth = g AND predicted = g) AS tp, count_if(truth <> g AND predicted = g) AS fp, count_if(truth = g AND predicted <> g) AS fn FROM lab, (SELECT DISTINCT genus AS g FROM obs) GROUP BY g) SELECT class, tp, fp, fn, {F_} FROM c")
def _(v: Views) -> DataFrame:
    m = ev.class_metrics(ev.confusion(labelled(v)))
    return m.select("class", "tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("a29_overall_metrics", f"""WITH {LAB}, c AS (SELECT g AS class, count_if(truth = g AND predicted = g) AS tp, count_if(truth <> g AND predicted = g) AS fp, count_if(truth = g AND predicted <> g) AS fn FROM lab, (SELECT DISTINCT genus AS g FROM obs) GROUP BY g), f AS (SELECT {F_} FROM c),
k AS (SELECT round(avg((truth = predicted)::INT), 6) AS accuracy, round(avg((truth = predicted)::INT), 6) AS top_1, round(avg((truth IN (predicted, 'Hot'))::INT), 6) AS top_2 FROM lab) SELECT accuracy, top_1, top_2, round(avg(precision), 5) AS macro_precision, round(avg(recall), 5) AS macro_recall, round(avg(f1), 5) AS macro_f1 FROM k, f GROUP BY ALL""")
def _(v: Views) -> DataFrame:
    rows = labelled(v)
    top = ev.top_k_accuracy(rows.select("truth", F.array(F.col("predicted"), F.lit("Hot")).alias("candidates")), [1, 2])
    m = ev.overall_metrics(ev.confusion(rows)).crossJoin(F.broadcast(top))
    return m.select(*[F.round(c, 6).alias(c) for c in ("accuracy", "top_1", "top_2")], *[F.round(f"macro_{c}", 5).alias(f"macro_{c}") for c in ("precision", "recall", "f1")])


@query("a30_joint_accuracy", f"WITH {LAB} SELECT count(*) AS rows, round(avg(coalesce(truth = predicted AND abs(crown_width_m * 5 - dbh) <= 5, false)::INT), 6) AS joint_accuracy FROM lab WHERE dbh IS NOT NULL")
def _(v: Views) -> DataFrame:
    rows = labelled(v).select("truth", "predicted", (F.col("crown_width_m") * 5).alias("size"), F.col("dbh").alias("true_size"))
    return ev.joint_accuracy(rows, 5.0).withColumn("joint_accuracy", F.round("joint_accuracy", 6))


@query("a31_top_confusions", f"WITH {LAB} SELECT truth, predicted, count(*) AS n, row_number() OVER (PARTITION BY truth ORDER BY count(*) DESC, predicted)::INT AS place FROM lab WHERE truth <> predicted GROUP BY truth, predicted QUALIFY place <= 5")
def _(v: Views) -> DataFrame:
    return ev.top_confusions(ev.confusion(labelled(v)))


@query("a30_error_metrics", "WITH {OBS} SELECT genus, round(avg(abs(crown_width_m * 5 - dbh)), 6) AS mae, round(sqrt(avg((crown_width_m * 5 - dbh) ** 2)), 6) AS rmse, round(avg(crown_width_m * 5 - dbh), 6) AS bias FROM obs GROUP BY genus")
def _(v: Views) -> DataFrame:
    e = ev.error_metrics(v.obs.select("genus", (F.col("crown_width_m") * 5).alias("predicted"), F.col("dbh").alias("truth")), ["genus"])
    return e.select("genus", *[F.round(c, 6).alias(c) for c in ("mae", "rmse", "bias")])


@query("a31_tagged_report", f"WITH {LAB}, t AS (SELECT city, truth = predicted AS hit, unnest(CASE WHEN part_key % 3 = 0 THEN ['shade', 'road'] WHEN part_key % 3 = 1 THEN ['road'] ELSE ['(untagged)'] END) AS tag FROM lab UNION ALL SELECT city, truth = predicted, '(all)' FROM lab) SELECT city, tag, count(*) AS n, count_if(hit) AS hits FROM t GROUP BY ALL")
def _(v: Views) -> DataFrame:
    k = F.col("part_key") % 3
    tags = F.when(k == 0, F.array(F.lit("shade"), F.lit("road"))).when(k == 1, F.array(F.lit("road"))).otherwise(F.array().cast("array<string>"))
    return ev.tagged_report(labelled(v).select("city", (F.col("truth") == F.col("predicted")).alias("hit"), tags.alias("tags")))


@query("a32_weighted_majority", "WITH c AS (SELECT l_orderkey AS id, l_quantity AS p, CASE l_linenumber % 3 WHEN 0 THEN 'conifer' WHEN 1 THEN 'deciduous' ELSE 'evergreen' END AS habit FROM lineitem), s AS (SELECT id, sum(p) AS t, coalesce(sum(p) FILTER (WHERE habit = 'conifer'), 0) AS a, coalesce(sum(p) FILTER (WHERE habit = 'deciduous'), 0) AS b FROM c GROUP BY id) SELECT id, CASE WHEN a >= 0.7 * t THEN 'conifer' WHEN b >= 0.7 * t THEN 'deciduous' WHEN t - b >= 0.7 * t THEN 'evergreen' END AS habit FROM s")
def _(v: Views) -> DataFrame:
    k = F.col("l_linenumber") % 3
    c = v.table("lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_quantity").alias("p"), F.when(k == 0, "conifer").when(k == 1, "deciduous").otherwise("evergreen").alias("habit"))
    return ev.weighted_majority(c, 0.7, {"conifer": ["conifer"], "deciduous": ["deciduous"], "evergreen": ["evergreen", "conifer"]})


@query("a33_unanimous_label", "SELECT l_orderkey, CASE WHEN min(l_returnflag) = max(l_returnflag) THEN min(l_returnflag) END AS l_returnflag FROM lineitem GROUP BY l_orderkey")
def _(v: Views) -> DataFrame:
    return ev.unanimous(v.table("lineitem"), "l_orderkey", "l_returnflag")


@query("a34_mapped_lists", "SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: CASE w WHEN 'red' THEN 'crimson' ELSE w END), ' ') AS name FROM part")
def _(v: Views) -> DataFrame:
    words = F.transform(F.split("p_name", " "), lambda w: F.coalesce(F.get(F.array(F.when(w == "red", F.lit("crimson"))), F.lit(0)), w))
    return v.table("part").select("p_partkey", F.array_join(words, " ").alias("name"))


@query("a35_robust_offset", "WITH d AS (SELECT l_quantity - 25 AS dx, l_discount * 100 - 5 AS dy FROM lineitem), m AS (SELECT median(dx) AS mx, median(dy) AS my FROM d) SELECT mx, round(my, 6) AS my, round(median(sqrt((dx - mx) ** 2 + (dy - my) ** 2)), 6) AS spread FROM d, m GROUP BY ALL")
def _(v: Views) -> DataFrame:
    d = v.table("lineitem").select((F.col("l_quantity") - 25).alias("dx"), (F.col("l_discount") * 100 - 5).alias("dy"))
    return ev.robust_offset(d).select("mx", F.round("my", 6).alias("my"), F.round("spread", 6).alias("spread"))


@query("a36_group_occupancy", "WITH h AS (SELECT c_custkey AS g, count(o_orderkey) AS n FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 350000) ON c_custkey = o_custkey GROUP BY 1), a AS (SELECT count_if(n > 0) AS covered, count_if(n = 0) AS missed, count_if(n > 1) AS duplicated, sum(greatest(n - 1, 0))::BIGINT AS excess FROM h) SELECT *, round(covered / (covered + excess), 6) AS precision, round(covered / (covered + missed), 6) AS recall FROM a")
def _(v: Views) -> DataFrame:
    o = ev.occupancy(v.table("customer").select(F.col("c_custkey").alias("group")), v.table("orders").where("o_totalprice > 350000").select(F.col("o_custkey").alias("group")))
    return o.withColumn("precision", F.round("precision", 6)).withColumn("recall", F.round("recall", 6))


@query("a37_view_coverage", "WITH w AS (SELECT user_id, count(*) / 80.0 AS c FROM events GROUP BY 1) SELECT round(avg(c), 6) AS mean, min(c)::DOUBLE AS least, count_if(c < 0.9) AS low, sum(c * 80)::BIGINT AS used, count(*) * 80 AS possible, (SELECT count(DISTINCT floor(value)) FROM events) AS cells FROM w")
def _(v: Views) -> DataFrame:
    e = v.table("events")
    w = e.groupBy("user_id").agg((F.count("*") / 80.0).alias("c")).agg(F.round(F.avg("c"), 6).alias("mean"), F.min("c").alias("least"), F.count_if(F.col("c") < 0.9).alias("low"), F.round(F.sum(F.col("c") * 80)).cast("long").alias("used"), (F.count("*") * 80).alias("possible"))
    return w.crossJoin(F.broadcast(e.agg(F.countDistinct(F.floor("value")).alias("cells"))))


#: True objects are all events of four kinds; those of two kinds are found.
SCORED = "sc AS (SELECT value / 500 AS score, event_type IN ('view', 'click') AS hit FROM events), tr AS (SELECT count(*) AS truth FROM events WHERE event_type <> 'purchase')"


def scored(v: Views) -> DataFrame:
    return v.table("events").select((F.col("value") / 500).alias("score"), F.col("event_type").isin("view", "click").alias("hit"))


def truth(v: Views) -> DataFrame:
    return v.table("events").where("event_type <> 'purchase'").agg(F.count("*").alias("truth"))


@query("r17_threshold_sweep", f"WITH {SCORED} SELECT t / 100.0::DOUBLE AS threshold, count_if(hit AND score >= t / 100.0::DOUBLE) AS tp, count_if(NOT hit AND score >= t / 100.0::DOUBLE) AS fp, (SELECT truth FROM tr) - count_if(hit AND score >= t / 100.0::DOUBLE) AS fn FROM sc, range(1, 96) r(t) GROUP BY t")
def _(v: Views) -> DataFrame:
    return ev.threshold_sweep(scored(v), truth(v), [t / 100 for t in range(1, 96)])


@query("r18_average_precision", f"WITH {SCORED}, s AS (SELECT score, count_if(hit) AS t, count(*) AS n FROM sc GROUP BY score), c AS (SELECT score, t, sum(t) OVER (ORDER BY score DESC) / sum(n) OVER (ORDER BY score DESC) AS p FROM s), e AS (SELECT t, max(p) OVER (ORDER BY score) AS p FROM c) SELECT round(sum(t * p) / (SELECT truth FROM tr), 6) AS average_precision FROM e")
def _(v: Views) -> DataFrame:
    return ev.average_precision(scored(v), truth(v)).select(F.round("average_precision", 6).alias("average_precision"))


@query("r19_mutual_offsets", f"""WITH {EV}, c AS (SELECT p.chip, p.id AS p_id, t.id AS t_id, sqrt((p.x - t.x) ** 2 + (p.y - t.y) ** 2) AS d FROM pred p JOIN truth t USING (chip) WHERE t.dbh >= 16 AND sqrt((p.x - t.x) ** 2 + (p.y - t.y) ** 2) <= 12), a AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY p_id ORDER BY d, t_id) = 1), b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY t_id ORDER BY d, p_id) = 1)
, g AS (SELECT a.chip, count(*) AS trees, round(median(a.d), 6) AS median FROM a JOIN b ON a.p_id = b.p_id AND a.t_id = b.t_id WHERE a.d BETWEEN 3 AND 12 GROUP BY a.chip) SELECT *, row_number() OVER (ORDER BY trees DESC, median DESC, chip)::INT AS place FROM g""")
def _(v: Views) -> DataFrame:
    p, t = tables(v)
    chips = ev.mutual_offsets(p, t.where("dbh >= 16"), 12.0, 3.0, 12.0).withColumn("median", F.round("median", 6))
    return rank.numbered(chips, [F.desc("trees"), F.desc("median"), F.asc("chip")], "place")
