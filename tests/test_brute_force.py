"""Operators that SQL can't express, against brute force on small inputs."""

import math
import random
from itertools import product

import pytest

from arborscale.functions.lineage import checkpointed
from arborscale.operators import blocks, cells, dedup, evalmatch, fits, grids, lookups
from arborscale.sources import scans
from pyspark.sql import functions as F


def brute_suppress(rows, conflict):
    kept = []
    for r in sorted(rows, key=lambda r: (-r[1], r[0])):
        if not any(conflict(k, r) for k in kept):
            kept.append(r)
    return {r[0] for r in kept}


def test_seam_dedup_is_greedy(spark):
    rng = random.Random(1)
    rows = [(f"p{i:03}", round(rng.random(), 1), rng.random() * 40, rng.random() * 40, f"t{rng.randrange(3)}") for i in range(200)]
    df = checkpointed(spark.createDataFrame(rows, "id string, score double, x double, y double, tile string"))
    got = dedup.greedy_suppress(df, checkpointed(dedup.seam_conflicts(df, 4.0)), checkpointed)
    want = brute_suppress(rows, lambda a, b: a[4] != b[4] and math.dist(a[2:4], b[2:4]) <= 4)
    assert {r["id"] for r in got.where("kept").collect()} == want


@pytest.mark.parametrize("nearest_first", [False, True])
def test_greedy_match(spark, nearest_first):
    rng = random.Random(2)
    p = [(i, f"c{rng.randrange(2)}", round(rng.random(), 1), rng.random() * 20, rng.random() * 20) for i in range(80)]
    t = [(i, f"c{rng.randrange(2)}", rng.random() * 20, rng.random() * 20) for i in range(60)]
    pairs = [(math.dist(a[3:], b[2:]), a[2], a[0], b[0]) for a, b in product(p, t) if a[1] == b[1] and math.dist(a[3:], b[2:]) <= 3]
    used_p, used_t, want = set(), set(), set()
    for d, s, i, j in sorted(pairs, key=lambda q: (q[0], q[2], q[3]) if nearest_first else (-q[1], q[2], q[0], q[3])):
        if i not in used_p and j not in used_t:
            used_p.add(i), used_t.add(j), want.add((i, j))
    pd_ = spark.createDataFrame(p, "id long, chip string, score double, x double, y double")
    td = spark.createDataFrame(t, "id long, chip string, x double, y double")
    got = evalmatch.greedy_match(evalmatch.candidate_pairs(pd_, td, 3.0), checkpointed, nearest_first)
    assert {(r["p_id"], r["t_id"]) for r in got.collect()} == want


def test_mask_aware_counts(spark):
    p = spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "id long, mask int")
    t = spark.createDataFrame([(10,), (11,)], "id long")
    r = evalmatch.match_counts(p, t, spark.createDataFrame([(1, 10)], "p_id long, t_id long"), "mask").head()
    assert (r["tp"], r["fp"], r["fn"], r["ignored"]) == (1, 1, 1, 1)


def test_model_diff(spark):
    t = spark.createDataFrame([(1,), (2,), (3,), (4,)], "id long")
    m = lambda *ids: spark.createDataFrame([(0, i) for i in ids], "p_id long, t_id long")
    got = {r["id"]: r["change"] for r in evalmatch.model_diff(t, m(1, 2), m(1, 3)).collect()}
    assert got == {1: "both hit", 2: "regression", 3: "improvement", 4: "both miss"}


def test_nearest_open_cell(spark):
    rng = random.Random(3)
    blocked = {(rng.randrange(14), rng.randrange(14)) for _ in range(170)}
    df = checkpointed(spark.createDataFrame(sorted(blocked), "cx long, cy long"))
    got = {(r["cx"], r["cy"]): r["distance"] for r in grids.nearest_open(df, 16, checkpointed).collect()}
    for c in blocked:
        want = min(math.dist(c, o) for o in product(range(-2, 17), range(-2, 17)) if o not in blocked)
        assert got[c] == pytest.approx(want)


def test_hilbert_visits_neighbours(spark):
    df = spark.range(256).select((F.col("id") % 16).alias("x"), F.floor(F.col("id") / 16).alias("y"))
    path = [(r["x"], r["y"]) for r in df.withColumn("h", cells.hilbert(F.col("x"), F.col("y"), 4)).orderBy("h").collect()]
    assert len(set(path)) == 256 and all(abs(a[0] - b[0]) + abs(a[1] - b[1]) == 1 for a, b in zip(path, path[1:]))


def test_trimming_drops_outliers(spark):
    rng = random.Random(4)
    rows = [(x, 2 * x**0.7 * math.exp(rng.gauss(0, 0.05)), "g") for x in range(1, 300)] + [(50, 9000.0, "g"), (60, 0.001, "g")]
    df = spark.createDataFrame([(float(a), b, g) for a, b, g in rows], "x double, y double, g string")
    fit = fits.trimmed_fits(df, [("g", "g")], F.col("x"), F.col("y"), F.col("n") > 5, checkpointed).head()
    assert fit["n"] < len(rows) and fit["b"] == pytest.approx(0.7, abs=0.02) and fit["sigma"] < 0.05


def test_bootstrap_brackets_the_difference(spark):
    rng = random.Random(5)
    rows = [(f"t{i % 12}", x := rng.random(), x + rng.gauss(0, 0.2), rng.random()) for i in range(600)]
    r = fits.block_bootstrap(spark.createDataFrame(rows, "tile string, a double, b double, c double"), "tile", 30, [("a", "b"), ("a", "c")]).head()
    assert r["replicates"] == 30 and 0.3 < r["low"] < r["high"] < 1.3


def test_crown_cover(spark):
    df = spark.createDataFrame([(1, 10.0, 10.0, 5.0, 1.0), (2, 12.0, 10.0, 5.0, 2.0)], "id long, x double, y double, r double, height double")
    got = {(r["bx"], r["by"]): r["share"] for r in grids.covered_share(df, 1.0, 20).collect()}
    want = sum(min(math.dist((i + 0.5, j + 0.5), c) for c in ((10, 10), (12, 10))) <= 5 for i in range(20) for j in range(20)) / 400
    assert got == {(0, 0): pytest.approx(want)}


def test_similar_names_match_brute_force(spark):
    rng = random.Random(6)
    names = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(7, 11))) for _ in range(60)})
    got = {(r["a"], r["b"]) for r in lookups.similar_names(spark.createDataFrame([(n,) for n in names], "name string")).collect()}

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = _next(row, i, x, b)
        return row[-1]

    def _next(row, i, x, b):
        out = [i]
        for j, y in enumerate(b, 1):
            out.append(min(row[j] + 1, out[-1] + 1, row[j - 1] + (x != y)))
        return out

    assert got == {(a, b) for a in names for b in names if a < b and min(len(a), len(b)) >= 8 and edits(a, b) <= 2}


def test_block_files_keep_rows(spark, tmp_path):
    df = spark.createDataFrame([(f"t{i}", 40 + i / 1e4, -71 - i / 1e4) for i in range(50)], "tree_id string, latitude double, longitude double")
    blocks.write_blocks(blocks.with_block(df), str(tmp_path / "b"))
    assert spark.read.parquet(str(tmp_path / "b")).count() == 50


def test_missing_required_column_fails(spark):
    with pytest.raises(ValueError, match="missing"):
        scans.with_columns(spark.range(1), ["nothing"], {})


def test_curation_gain_refuses_other_predictions(spark):
    counts = spark.createDataFrame([("x", "p", 0.5, 8, 2, 2), ("y", "p", 0.5, 0, 0, 0)], "city string, policy string, threshold double, tp long, fp long, fn long")
    better = counts.withColumn("tp", F.col("tp") + 2)
    reviewed = spark.createDataFrame([("x", 50), ("y", 0)], "city string, n long")
    one = spark.createDataFrame([(1, 0.5), (2, None), (2, None)], "id int, score double")
    got = {(r.city, r.metric): (r.before, r.after, r.delta_pp, r.pp_per_100) for r in evalmatch.curation_gain(counts, better, reviewed, 0.5, (one, one.orderBy("id", ascending=False))).collect()}
    assert got["x", "precision"] == pytest.approx((0.8, 10 / 12, (10 / 12 - 0.8) * 100, (10 / 12 - 0.8) * 200))
    assert got["y", "recall"] == (0.0, 1.0, 100.0, None)
    assert got["(total)", "f2"] == pytest.approx((40 / 50, 60 / 70, (6 / 7 - 0.8) * 100, (6 / 7 - 0.8) * 200))
    for other in (one.limit(2), one.withColumn("score", F.lit(1.0)), one.withColumnRenamed("score", "s")):
        with pytest.raises(ValueError, match="differ"):
            evalmatch.curation_gain(counts, better, reviewed, 0.5, (one, other))
