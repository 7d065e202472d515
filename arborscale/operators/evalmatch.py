"""Matching of detections to truth, and the metrics on top of it."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborscale.functions import nearby, ordered
from arborscale.operators import cells, lookups, rank


def candidate_pairs(predictions: DataFrame, truth: DataFrame, radius: Column | float) -> DataFrame:
    """Pairs of one chip within a radius, which may be a column of the truth (``radius``)."""
    p = predictions.select("chip", F.col("id").alias("p_id"), "score", F.col("x").alias("px"), F.col("y").alias("py"))
    t = truth.select("chip", F.col("id").alias("t_id"), F.col("x").alias("tx"), F.col("y").alias("ty"), *([F.col("radius")] if "radius" in truth.columns else []))
    d = F.sqrt((F.col("px") - F.col("tx")) ** 2 + (F.col("py") - F.col("ty")) ** 2)
    return p.join(t, "chip").withColumn("distance", d).where(F.col("distance") <= radius).select("chip", "p_id", "score", "t_id", "distance")


def greedy_match(pairs: DataFrame, stop: Callable[[DataFrame], DataFrame], nearest_first: bool = False) -> DataFrame:
    """One-to-one matches ``p_id``, ``t_id``: by score the highest prediction first, which takes its nearest free truth;
    or with ``nearest_first`` the closest pair first.

    In rounds of joins: a pair is settled when it is the best open one of both its prediction and, by prediction order,
    of its truth; that gives the sequential result, as an open pair ahead of it touches neither side."""
    order = ["distance", "p_id", "t_id"] if nearest_first else ["minus_score", "p_id", "distance", "t_id"]
    key = F.struct(*order)
    rest = stop(pairs.withColumn("minus_score", -F.col("score")).select("p_id", "t_id", *[c for c in order if c not in ("p_id", "t_id")]))
    done = None
    while not rest.isEmpty():
        of_p = rest.groupBy("p_id").agg(F.min(key).alias("best_p"))
        of_t = rest.groupBy("t_id").agg(F.min(key).alias("best_t"))
        won = stop(rest.withColumn("key_", key).join(of_p, "p_id").join(of_t, "t_id").where((F.col("key_") == F.col("best_p")) & (F.col("key_") == F.col("best_t"))).select("p_id", "t_id", "distance"))
        done = won if done is None else stop(done.union(won))
        rest = stop(rest.join(won.select("p_id"), "p_id", "left_anti").join(won.select("t_id"), "t_id", "left_anti"))
    return done if done is not None else rest.select("p_id", "t_id", "distance")


def matched(predictions: DataFrame, truth: DataFrame, radius: float | str, nearest_first: bool = False) -> DataFrame:
    """The greedy match of ``greedy_match`` for the candidate pairs within a radius (a number, or a column of the truth), which are never all
    listed: each chip is searched in grids by one task, whose memory grows with the rows of its largest chip."""
    return nearby.greedy_pairs(predictions, truth, radius, nearest_first)


def f_scores(tp: Column, fp: Column, fn: Column) -> list[Column]:
    """Precision, recall, F1 and F2; 0 where there is nothing."""
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    return [ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), ratio(5 * tp, 5 * tp + 4 * fn + fp).alias("f2")]


def match_counts(predictions: DataFrame, truth: DataFrame, matches: DataFrame, masked: str | None = None) -> DataFrame:
    """True and false positives and misses; with a mask column, unmatched predictions on a zero mask don't count."""
    p = predictions.join(matches.select(F.col("p_id").alias("id"), F.lit(1).alias("hit")), "id", "left")
    ignored = F.lit(False) if masked is None else F.col("hit").isNull() & (F.col(masked) == 0)
    a = p.agg(F.count("hit").alias("tp"), F.count_if(F.col("hit").isNull() & ~ignored).alias("fp"), F.count_if(ignored).alias("ignored"))
    n = truth.agg(F.count("*").alias("truth"))
    return a.crossJoin(F.broadcast(n)).select("tp", "fp", (F.col("truth") - F.col("tp")).alias("fn"), "ignored", *f_scores(F.col("tp"), F.col("fp"), F.col("truth") - F.col("tp")))


def above(matches: DataFrame, predictions: DataFrame, threshold: float) -> DataFrame:
    """Matches whose prediction scores the threshold or more. As the higher score matches first, these are the matches
    of the predictions over the threshold alone."""
    return matches.join(predictions.where(F.col("score") >= threshold).select(F.col("id").alias("p_id")), "p_id", "left_semi")


def model_diff(truth: DataFrame, one: DataFrame, other: DataFrame, looser: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """Each truth by which of two models matched it (``change``). A regression also gets a ``diagnosis``: the first of the
    looser settings of the second model whose matches hold it, else ``not recovered``."""
    hit = lambda m, c: m.select(F.col("t_id").alias("id"), F.lit(True).alias(c))
    both = truth.select("id").join(hit(one, "a"), "id", "left").join(hit(other, "b"), "id", "left")
    found = []
    for i, (label, matches) in enumerate((looser or {}).items()):
        both = both.join(hit(matches, f"l{i}"), "id", "left")
        found.append(F.when(F.col(f"l{i}").isNotNull(), label))
    a, b = F.col("a").isNotNull(), F.col("b").isNotNull()
    diagnosis = F.when(a & ~b, F.coalesce(*found, F.lit("not recovered")))
    return both.select("id", F.when(a & b, "both hit").when(a, "regression").when(b, "improvement").otherwise("both miss").alias("change"), diagnosis.alias("diagnosis"))


def coverage_check(requested: DataFrame, processed: DataFrame) -> DataFrame:
    """Chips that were not processed exactly once, or not asked for, or that gave nothing: ``chip``, ``problem``."""
    n = processed.groupBy("chip").agg(F.count("*").alias("runs"), F.sum("predictions").alias("predictions"))
    both = requested.select("chip", F.lit(1).alias("asked")).join(n, "chip", "full")
    problem = F.when(F.col("runs").isNull(), "missing").when(F.col("asked").isNull(), "unrequested").when(F.col("runs") > 1, "repeated").when(F.col("predictions") == 0, "empty")
    return both.select("chip", problem.alias("problem")).where("problem is not null")


def eligible(dbh: Column, species: Column, planted: Column, excluded: Sequence[str], low: float, high: float, cutoff: Column) -> Column:
    """Whether a label can be trained on: the reason why not, or ``ok``."""
    return F.when(dbh.isNull() | F.isnan(dbh) | (dbh < low) | (dbh > high), "dbh").when(species.isNull() | (F.trim(species) == "") | species.isin(*excluded), "species").when(planted > cutoff, "planted late").otherwise("ok")


def taxonomy(rows: DataFrame, least: int, cap: int) -> DataFrame:
    """Species with rows enough, numbered by count (largest first) and name from 0."""
    n = rows.where("species is not null").groupBy("species").agg(F.count("*").alias("rows")).where(F.col("rows") >= least)
    return n.orderBy(F.desc("rows"), "species").limit(cap).withColumn("species_id", F.row_number().over(Window.orderBy(F.desc("rows"), "species")) - 1)


def genus_taxonomy(table: DataFrame) -> DataFrame:
    """The genera of a taxonomy's species, numbered by name from 0: ``genus``, ``genus_id``."""
    genera = table.select(F.split_part("species", F.lit(" "), F.lit(1)).alias("genus")).distinct()
    return genera.withColumn("genus_id", F.row_number().over(Window.orderBy("genus")) - 1)


def encoded(rows: DataFrame, table: DataFrame) -> DataFrame:
    """Rows with their species number, -1 for others."""
    return rows.join(table.select("species", "species_id"), "species", "left").withColumn("species_id", F.coalesce("species_id", F.lit(-1)))


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from a hash that any engine can compute."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("double") / 4294967296.0


def split_of(u: Column, train: float = 0.7, val: float = 0.15) -> Column:
    return F.when(u < train, "train").when(u < train + val, "val").otherwise("test")


def edge_neighbours(tiles: DataFrame, records: DataFrame, side: float, reach: float, planted_by: Column) -> DataFrame:
    """``id``, ``tx``, ``ty``: records (with the columns of ``spatial_split`` and ``plant_date``) within ``reach`` of the
    centre of a tile that doesn't hold them. Records of the test split, guarded ones and later plantings stay out; an
    unknown planting date is no later one."""
    centre = lambda c: (F.col(c) + 0.5) * side
    open_ = records.where((F.col("split") != "test") & ~F.col("guarded") & F.coalesce(F.col("plant_date") <= planted_by, F.lit(True)))
    near = cells.pairs_within(tiles.withColumns({"x": centre("tx"), "y": centre("ty")}), open_.select("id", "x", "y"), reach)
    owned = (F.floor(F.col("r_x") / side) == F.col("l_tx")) & (F.floor(F.col("r_y") / side) == F.col("l_ty"))
    return near.where(~owned).select(F.col("r_id").alias("id"), F.col("l_tx").alias("tx"), F.col("l_ty").alias("ty"))


def review_rank(predictions: DataFrame, truths: DataFrame, matches: DataFrame, label: str, mask: str) -> DataFrame:
    """Counts by ``chip`` and its ``place`` for review, most errors first: ``error_score`` is truths missed, plus false
    predictions, plus matches whose labels differ. A prediction without a match where ``mask`` is 0 or less is ignored; a
    missing label is no error."""
    p = predictions.select("chip", F.col("id").alias("p_id"), F.col(label).alias("says"), F.col(mask).alias("mask_")).join(matches.select("p_id", "t_id"), "p_id", "left")
    p = p.join(truths.select(F.col("id").alias("t_id"), F.col(label).alias("is_")), "t_id", "left")
    said = p.groupBy("chip").agg(F.count("*").alias("predictions"), F.count("t_id").alias("matched"), F.count_if(F.col("t_id").isNull() & (F.col("mask_") <= 0)).alias("ignored"), F.count_if(F.col("says") != F.col("is_")).alias("label_errors"))
    both = said.join(truths.groupBy("chip").agg(F.count("*").alias("truths")), "chip", "full").na.fill(0, ["predictions", "matched", "ignored", "label_errors", "truths"])
    counts = both.withColumn("missed", F.expr("truths - matched")).withColumn("false_positive", F.expr("predictions - matched - ignored")).withColumn("error_score", F.expr("missed + false_positive + label_errors"))
    scored = counts.withColumn("f1", F.expr("case when 2 * matched + false_positive + missed > 0 then 2 * matched / (2 * matched + false_positive + missed) else 1.0D end"))
    return rank.numbered(scored, [F.desc("error_score"), F.asc("chip")], "place")


def spatial_split(rows: DataFrame, block: float, guard: float, seed: str) -> DataFrame:
    """Rows (``x``, ``y``) with the split of their block, and whether they are ``guarded``: within the guard distance of
    a block of another split."""
    bx, by = F.floor(F.col("x") / block), F.floor(F.col("y") / block)
    split = lambda i, j: split_of(uniform(F.lit(seed), bx + i, by + j))
    fx, fy = F.col("x") - bx * block, F.col("y") - by * block
    near = [(fx < guard, -1, 0), (fx > block - guard, 1, 0), (fy < guard, 0, -1), (fy > block - guard, 0, 1)]
    own = split(0, 0)
    guarded = F.lit(False)
    for close, i, j in near:
        guarded = guarded | (close & (split(i, j) != own))
    return rows.withColumn("split", own).withColumn("guarded", guarded)


def crown_labels(rows: DataFrame) -> DataFrame:
    """The crown radius of a label: a human one weighs 1, else an allometric one 0.2, which palms don't get."""
    by_rule = F.when(~F.col("palm"), F.col("allometric"))
    return rows.withColumn("radius", F.coalesce("human", by_rule)).withColumn("weight", F.when(F.col("human").isNotNull(), 1.0).when(by_rule.isNotNull(), 0.2))


def snapshot_gain(before: DataFrame, after: DataFrame, key: str, metrics: Sequence[str]) -> DataFrame:
    """Deltas of metrics between two snapshots."""
    b = before.select(key, *[F.col(m).alias(f"b_{m}") for m in metrics])
    return after.join(b, key).select(key, *[(F.col(m) - F.col(f"b_{m}")).alias(m) for m in metrics])


def content_digest(df: DataFrame, columns: Sequence[str]) -> tuple[int, int, int]:
    """Rows of a table and two sums of their hashes: equal for the same rows in any order, repeated ones included."""
    one = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).alias("a"), F.sum(F.xxhash64(F.lit("second"), *columns).cast("decimal(38,0)")).alias("b")).head()
    return one["n"], int(one["a"] or 0), int(one["b"] or 0)


def curation_gain(before: DataFrame, after: DataFrame, reviewed: DataFrame, threshold: float, predictions: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """What edits of labels did to the scores: for each ``city``, and pooled over all as ``(total)``, each ``policy`` and ``metric`` (precision, recall,
    f1, f2) at a threshold the values ``before`` and ``after``, ``delta_pp`` in percentage points and ``pp_per_100``, that for a hundred reviewed trees.

    Counts come as (``city``, ``policy``, ``threshold``, ``tp``, ``fp``, ``fn``), reviewed trees as (``city``, ``n``); a city must be in both snapshots. Totals
    are metrics of summed counts. Only labels may differ: two snapshots of ``predictions`` with other rows are refused."""
    if predictions is not None:
        columns = sorted(predictions[0].columns)
        if columns != sorted(predictions[1].columns) or content_digest(predictions[0], columns) != content_digest(predictions[1], columns):
            raise ValueError("the predictions of the snapshots differ")

    def side(df: DataFrame, name: str) -> DataFrame:
        at = df.where(F.col("threshold") == threshold).select("city", "policy", "tp", "fp", "fn")
        return at.select("city", "policy", *[F.col(c).alias(f"{name}_{c}") for c in ("tp", "fp", "fn")])

    both = side(before, "b").join(side(after, "a"), ["city", "policy"]).join(reviewed.select("city", F.col("n").alias("trees")), "city", "left")
    counts = [f"{s}_{c}" for s in "ba" for c in ("tp", "fp", "fn")]
    pooled = both.groupBy("policy").agg(*[F.sum(c).alias(c) for c in counts], F.sum("trees").alias("trees")).withColumn("city", F.lit("(total)"))
    every = both.unionByName(pooled)
    scores = lambda name: f_scores(*[F.col(f"{name}_{c}") for c in ("tp", "fp", "fn")])
    metrics = ("precision", "recall", "f1", "f2")
    rows = every.withColumn("was", F.struct(*scores("b"))).withColumn("now", F.struct(*scores("a")))
    each = rows.select("city", "policy", "trees", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"was.{m}").alias("before"), F.col(f"now.{m}").alias("after")) for m in metrics])).alias("m")).select("city", "policy", "trees", "m.*")
    delta = (F.col("after") - F.col("before")) * 100
    return each.select("city", "policy", "metric", "before", "after", delta.alias("delta_pp"), F.when(F.col("trees") > 0, delta * 100 / F.col("trees")).alias("pp_per_100"))


def rebuild_labels(labels: DataFrame, excluded: DataFrame, corrections: DataFrame, offset: tuple[float, float], chip: float, targets: Mapping[str, str] | None = None, mixed: str = "raise") -> DataFrame:
    """Labels from feedback: excluded trees go; a correction (``dx``, ``dy``), else the global offset, moves the rest;
    chip and cell follow; cells that hold two trees go; a target is null where its eligibility column isn't true.

    A chip whose trees come from more than one ``split`` is refused: the job fails, or with ``mixed="drop"`` the chip
    goes."""
    if mixed not in ("raise", "drop"):
        raise ValueError(f"mixed is raise or drop, not {mixed}")
    c = corrections.select("id", "dx", "dy")
    moved = labels.join(excluded.select("id"), "id", "left_anti").join(c, "id", "left")
    moved = moved.withColumn("x", F.col("x") + F.coalesce("dx", F.lit(offset[0]))).withColumn("y", F.col("y") + F.coalesce("dy", F.lit(offset[1])))
    placed = moved.withColumn("chip", F.concat_ws("_", F.floor(F.col("x") / chip), F.floor(F.col("y") / chip))).withColumn("cell", F.concat_ws("_", F.floor("x"), F.floor("y")))
    torn = placed.groupBy("chip").agg(F.count_distinct("split").alias("n_")).where("n_ > 1").select("chip", F.lit(True).alias("torn_"))
    if mixed == "drop":
        whole = placed.join(torn, "chip", "left_anti")
    else:
        refuse = F.raise_error(F.concat(F.lit("trees of several splits in chip "), F.col("chip"))).cast("boolean")
        whole = placed.join(torn, "chip", "left").where(F.when(F.col("torn_").isNull(), True).otherwise(refuse)).drop("torn_")
    single = whole.groupBy("cell").agg(F.count("*").alias("n_")).where("n_ = 1").select("cell")
    kept = whole.join(single, "cell", "left_semi").drop("dx", "dy")
    return kept.withColumns({t: F.when(F.col(flag), F.col(t)) for t, flag in (targets or {}).items()})


def change_categories(old: DataFrame, new: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Rows that are new, revised or removed between snapshots, comparing the fields only."""
    side = lambda df, p: df.select(F.col(key).alias(f"{p}k"), F.struct(*fields).alias(f"{p}v"))
    both = side(old, "o").join(side(new, "n"), F.col("ok") == F.col("nk"), "full")
    change = F.when(F.col("ok").isNull(), "new").when(F.col("nk").isNull(), "removed").when(F.col("ov") != F.col("nv"), "revised")
    return both.select(F.coalesce("ok", "nk").alias(key), change.alias("change")).where("change is not null")


def field_changes(old: DataFrame, new: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """How many rows of both snapshots differ in each field: ``field``, ``rows``."""
    return lookups.differences(old, new, key, fields).where(F.col("field").isin(*fields)).groupBy("field").agg(F.count("*").alias("rows"))


def window_reasons(tiles: DataFrame) -> DataFrame:
    """How many tiles (``split``, ``guarded``, ``inside``, ``valid``) are used or refused, by reason."""
    reason = F.when(F.col("split") == "test", "test").when(F.col("guarded"), "guarded").when(~F.col("inside"), "outside").when(F.col("valid") < 0.5, "invalid").otherwise("used")
    return tiles.groupBy(reason.alias("reason")).agg(F.count("*").alias("tiles"), F.sum("trees").alias("trees"))


def confusion(rows: DataFrame) -> DataFrame:
    """Counts of (``truth``, ``predicted``)."""
    return rows.groupBy("truth", "predicted").agg(F.count("*").alias("n"))


def class_metrics(table: DataFrame) -> DataFrame:
    """True positives, false positives, misses and scores of each class, from a confusion table."""
    as_class = table.select(F.explode(F.array(F.struct(F.col("truth").alias("c"), F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0).alias("tp"), F.lit(0).cast("long").alias("fp"), F.when(F.col("truth") != F.col("predicted"), F.col("n")).otherwise(0).alias("fn")), F.struct(F.col("predicted").alias("c"), F.lit(0).cast("long").alias("tp"), F.when(F.col("truth") != F.col("predicted"), F.col("n")).otherwise(0).alias("fp"), F.lit(0).cast("long").alias("fn")))).alias("s"))
    sums = as_class.groupBy(F.col("s.c").alias("class")).agg(F.sum("s.tp").alias("tp"), F.sum("s.fp").alias("fp"), F.sum("s.fn").alias("fn"))
    return sums.select("class", "tp", "fp", "fn", *f_scores(F.col("tp"), F.col("fp"), F.col("fn"))[:3])


def overall_metrics(table: DataFrame) -> DataFrame:
    """One row: accuracy, and macro precision, recall and F1 over the classes that occur as truth, from a confusion
    table."""
    right = F.sum(F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0)) / F.sum("n")
    macro = class_metrics(table).where(F.col("tp") + F.col("fn") > 0).agg(*[F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")])
    return table.agg(right.alias("accuracy")).crossJoin(F.broadcast(macro))


def top_k_accuracy(rows: DataFrame, ks: Sequence[int]) -> DataFrame:
    """One row: the share of rows whose ``truth`` is among the first k of ``candidates``, for each k."""
    return rows.agg(*[F.avg(F.coalesce(F.array_contains(F.slice("candidates", 1, k), F.col("truth")), F.lit(False)).cast("int")).alias(f"top_{k}") for k in ks])


def top_confusions(table: DataFrame, k: int = 5) -> DataFrame:
    """The commonest wrong predictions of each true class, from a confusion table: ``truth``, ``predicted``, ``n``,
    ``place``."""
    place = F.row_number().over(Window.partitionBy("truth").orderBy(F.desc("n"), "predicted"))
    return table.where("truth <> predicted").withColumn("place", place).where(F.col("place") <= k)


def joint_accuracy(rows: DataFrame, tolerance: float) -> DataFrame:
    """One row: rows with both truths, and the share whose class is right and whose size is within the tolerance."""
    known = rows.where("truth is not null and true_size is not null")
    right = (F.col("truth") == F.col("predicted")) & (F.abs(F.col("size") - F.col("true_size")) <= tolerance)
    return known.agg(F.count("*").alias("rows"), F.avg(F.coalesce(right, F.lit(False)).cast("int")).alias("joint_accuracy"))


def error_metrics(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean absolute, root mean square and mean error of ``predicted`` against ``truth``."""
    e = F.col("predicted") - F.col("truth")
    return rows.groupBy(*keys).agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias"))


def tagged_report(rows: DataFrame) -> DataFrame:
    """Hits by city and tag, with ``(all)`` and ``(untagged)`` groups."""
    tags = F.when(F.size("tags") > 0, F.array_append("tags", F.lit("(all)"))).otherwise(F.array(F.lit("(untagged)"), F.lit("(all)")))
    return rows.select("city", "hit", F.explode(tags).alias("tag")).groupBy("city", "tag").agg(F.count("*").alias("n"), F.count_if("hit").alias("hits"))


def weighted_majority(candidates: DataFrame, floor: float, arms: Mapping[str, Sequence[str]]) -> DataFrame:
    """For each row (``id``, ``habit``, ``p``) the first arm in order whose habits together hold the floor of the
    total."""
    s = candidates.groupBy("id").agg(F.sum("p").alias("all"), *[F.sum(F.when(F.col("habit").isin(*habits), F.col("p")).otherwise(0.0)).alias(f"s{i}") for i, habits in enumerate(arms.values())])
    return s.select("id", F.coalesce(*[F.when(F.col(f"s{i}") >= floor * F.col("all"), F.lit(h)) for i, h in enumerate(arms)]).alias("habit"))


def unanimous(rows: DataFrame, key: str, label: str) -> DataFrame:
    """The label of a group whose rows all agree, else null."""
    return rows.groupBy(key).agg(F.when(F.min(label).eqNullSafe(F.max(label)), F.min(label)).alias(label))


def robust_offset(rows: DataFrame) -> DataFrame:
    """One row: component medians of displacements (``dx``, ``dy``) and the median distance from them; nulls of no displacement."""
    (mx,), (my,) = (ordered.quantiles(rows, F.col(c), [0.5]) for c in ("dx", "dy"))
    spread = None
    if mx is not None and my is not None:
        (spread,) = ordered.quantiles(rows, F.sqrt((F.col("dx") - mx) ** 2 + (F.col("dy") - my) ** 2), [0.5])
    return rows.sparkSession.createDataFrame([(mx, my, spread)], "mx double, my double, spread double")


def occupancy(groups: DataFrame, hits: DataFrame) -> DataFrame:
    """Groups covered, missed and duplicated, surplus hits, and the precision and recall of occupancy."""
    n = groups.select("group").distinct().join(hits.groupBy("group").agg(F.count("*").alias("n")), "group", "left")
    c = F.coalesce("n", F.lit(0))
    a = n.agg(F.count_if(c > 0).alias("covered"), F.count_if(c == 0).alias("missed"), F.count_if(c > 1).alias("duplicated"), F.sum(F.greatest(c - 1, F.lit(0))).alias("excess"))
    return a.withColumn("precision", F.col("covered") / (F.col("covered") + F.col("excess"))).withColumn("recall", F.col("covered") / (F.col("covered") + F.col("missed")))


def threshold_sweep(scored: DataFrame, truth: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """tp, fp and fn at each threshold from rows (``score``, ``hit``); ``truth`` has one row with the number of true objects as ``truth``.

    Each row counts in the highest threshold that it reaches, and cumulative sums over the few thresholds give the
    rest: one aggregate, no sort of the rows."""
    bounds = F.array(*[F.lit(float(t)) for t in sorted(thresholds)])
    at = F.element_at(F.filter(bounds, lambda b: b <= F.col("score")), -1)
    n = scored.where(F.col("score") >= min(thresholds)).groupBy(at.alias("threshold")).agg(F.count_if("hit").alias("t"), F.count_if(~F.col("hit")).alias("f"))
    every = scored.sparkSession.createDataFrame([(float(t),) for t in thresholds], "threshold double").join(n, "threshold", "left").na.fill(0)
    w = Window.orderBy(F.desc("threshold")).rowsBetween(Window.unboundedPreceding, 0)
    tp = F.sum("t").over(w)
    return every.crossJoin(truth).select("threshold", tp.alias("tp"), F.sum("f").over(w).alias("fp"), (F.col("truth") - tp).alias("fn"))


def average_precision(scored: DataFrame, truth: DataFrame) -> DataFrame:
    """Area under the monotone envelope of precision over recall, from rows (``score``, ``hit``); ``truth`` has one row
    with the number of true objects as ``truth``.

    Rows of one score are counted together first; precision and envelope are scans over ranges of scores, down and up."""
    steps = scored.groupBy("score").agg(F.count_if("hit").alias("t"), F.count("*").alias("n"))
    curve = ordered.scanned(steps, [F.desc("score")], sums={"hits": "t", "rows": "n"}).withColumn("precision", F.col("hits") / F.col("rows"))
    envelope = ordered.scanned(curve.select("score", "t", "precision"), ["score"], maxima={"envelope": "precision"})
    return envelope.agg(F.sum(F.col("envelope") * F.col("t")).alias("area")).crossJoin(truth).select((F.col("area") / F.col("truth")).alias("average_precision"))


def mutual_offsets(predictions: DataFrame, truth: DataFrame, radius: float, low: float, high: float) -> DataFrame:
    """Per chip the mutual nearest pairs within a radius whose distance lies in a band: their number and median distance."""
    both = nearby.mutual_pairs(predictions, truth, radius).where((F.col("distance") >= low) & (F.col("distance") <= high))
    return both.groupBy("chip").agg(F.count("*").alias("trees"), F.percentile("distance", F.lit(0.5)).alias("median"))
