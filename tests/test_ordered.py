"""Scans over ranges against plain loops, and null groups of ranks and samples."""

import random
from itertools import accumulate

import numpy as np
import pytest
from arborscale.functions import ordered
from arborscale.operators import dedup, evalmatch, fits, rank
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def numbers():
    rng = random.Random(3)
    return [(i, rng.choice([rng.gauss(0, 100), float(rng.randint(-5, 5)), 7.0])) for i in range(9000)]


@pytest.fixture(scope="module")
def table(spark, numbers):
    return spark.createDataFrame([*numbers, (-1, None), (-2, float("nan"))], "i int, v double").repartition(5)


def test_positions_follow_the_order_without_gaps(table, numbers):
    got = {r.i: r.at for r in ordered.positions(table.where("i >= 0"), "at", F.desc("v"), "i").collect()}
    assert got == {i: k for k, (i, _) in enumerate(sorted(numbers, key=lambda r: (-r[1], r[0])))}


def test_running_sums_and_maxima(table, numbers):
    rows = ordered.scanned(table.where("i >= 0").withColumn("one", F.lit(1)), ["i"], sums={"n": "one", "s": "v"}, maxima={"m": "v"}).orderBy("i").collect()
    values = [v for _, v in sorted(numbers)]
    assert [r.n for r in rows] == list(range(1, len(values) + 1)) and [r.m for r in rows] == list(accumulate(values, max))
    assert np.allclose([r.s for r in rows], np.cumsum(values))


def test_exact_quantiles_by_narrowing(table, numbers, monkeypatch):
    monkeypatch.setattr(ordered, "FEW", 50)
    monkeypatch.setattr(ordered, "BUCKETS", 8)
    at = [0, 0.1, 0.25, 0.5, 0.9, 0.999, 1]
    assert ordered.quantiles(table, F.col("v"), at) == pytest.approx(np.quantile([v for _, v in numbers], at).tolist(), abs=1e-9)
    assert ordered.quantiles(table.where("false"), F.col("v"), at) == [None] * len(at)
    assert ordered.order_statistics(table, F.col("v"), [-1, 9000, 0]) == {0: min(v for _, v in numbers)}


def test_users_of_scans(spark, table, numbers):
    scored = table.where("i >= 0").select(F.round("v", 1).alias("score"), (F.col("i") % 3 == 0).alias("hit"))
    got = evalmatch.average_precision(scored, spark.createDataFrame([(4000,)], "truth long")).head()[0]
    by_score = {}
    for i, v in numbers:
        t, n = by_score.get(np.round(v, 1), (0, 0))
        by_score[np.round(v, 1)] = t + (i % 3 == 0), n + 1
    t, n = (np.cumsum([by_score[s][k] for s in sorted(by_score, reverse=True)]) for k in (0, 1))
    envelope = np.maximum.accumulate((t / n)[::-1])[::-1]
    assert got == pytest.approx(float((envelope * np.diff(np.concatenate([[0], t]))).sum() / 4000), abs=2e-4)
    assert tuple(evalmatch.robust_offset(spark.createDataFrame([], "dx double, dy double")).head()) == (None, None, None)
    ranks = {r.v: r.k for r in fits.average_ranks(spark.createDataFrame([(3.0,), (1.0,), (3.0,), (2.0,)], "v double"), "v", "k").collect()}
    assert ranks == {1.0: 1, 2.0: 2, 3.0: 3.5}
    assert [r.p for r in rank.numbered(spark.createDataFrame([(3,), (1,), (2,)], "v int"), [F.desc("v")], "p").orderBy("v").collect()] == [3, 2, 1]


def test_null_groups_keep_their_rows(spark):
    trees = spark.createDataFrame([("a", 5.0), ("a", 9.0), (None, 4.0), (None, 8.0), (None, None), ("b", float("inf"))], "city string, dbh double")
    got = {(r.city, r.dbh): r.size_rank for r in rank.size_rank(trees, "city", "dbh").collect()}
    assert got == {("a", 9.0): 1, ("a", 5.0): 2, (None, 8.0): 1, (None, 4.0): 2, (None, None): None, ("b", float("inf")): None}
    chips = spark.createDataFrame([(i, [None, "x"][i % 2], [None, 1, 2][i % 3], i % 5 == 0, float(i)) for i in range(40)], "chip int, city string, density int, reviewed boolean, priority double")
    drawn = rank.audit_sample(chips, 10).collect()
    assert {(c, q): sum(r.city == c and r.queue == q for r in drawn) for c in (None, "x") for q in ("audit", "diagnostic")} == {(None, "audit"): 5, (None, "diagnostic"): 5, ("x", "audit"): 5, ("x", "diagnostic"): 5}
    stacked = spark.createDataFrame([("a", 1, 1), ("a", 1, 2), ("b", 1, 3), ("b", 2, 4), (None, 1, 5), (None, 2, 6)], "id string, kind int, row int")
    assert sorted(r.row for r in dedup.drop_stacked(stacked, "id", ["kind"], "row").collect()) == [1, 5, 6]
