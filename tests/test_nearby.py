"""Searches and matches in groups of points, held against all pairs."""

import math
import random
from itertools import product

import numpy as np
import pytest

from arborscale import plans
from arborscale.functions import nearby
from arborscale.operators import evalmatch
from arborscale.plans import registry

plans.load()


def brute(p, t, limit, nearest_first):
    pairs = [(float(np.sqrt((a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2)), i, j) for (i, a), (j, b) in product(enumerate(p), enumerate(t))]
    used_p, used_t, out = set(), set(), {}
    for d, i, j in sorted(pairs, key=lambda q: q if nearest_first else (q[1], q[0], q[2])):
        if d <= limit[j] and i not in used_p and j not in used_t:
            used_p.add(i), used_t.add(j)
            out[j] = (i, d)
    return out


@pytest.mark.parametrize("nearest_first", [False, True])
@pytest.mark.parametrize("shape", ["even", "lattice", "pile", "far", "none", "crowded"])
def test_matched(monkeypatch, shape, nearest_first):
    if shape == "crowded":
        monkeypatch.setattr(nearby, "MANY", 5)
        monkeypatch.setattr(nearby, "PAIRS", 50)
    for seed in range(8):
        rng = np.random.default_rng(seed)
        n, m = (0, 3) if shape == "none" else (rng.integers(20, 120), rng.integers(20, 120))
        p, t = rng.uniform(0, 40, (n, 2)), rng.uniform(0, 40, (m, 2))
        if shape == "lattice":
            p, t = np.floor(p / 4), np.floor(t / 4)
        elif shape == "pile":
            p[: n // 2], t[: m // 2] = 7.0, 7.0
        elif shape == "far":
            p[0], t[0] = (1e12, 5e12), (-3e12, 1.0)
        limit = rng.uniform(-1, 9, m) if seed % 2 else np.full(m, rng.choice([0.0, 2.0, 6.0, 100.0]))
        holder, held = nearby.matched(p[:, 0], p[:, 1], t[:, 0], t[:, 1], limit if seed % 2 else float(limit[0]), nearest_first)
        got = {j: (int(holder[j]), float(held[j])) for j in range(m) if holder[j] >= 0}
        assert got == brute(p, t, limit, nearest_first)


@pytest.mark.parametrize("nearest_first", [False, True])
def test_dense_chips_are_matched_without_a_list_of_pairs(spark, monkeypatch, nearest_first):
    """Pairs of a chip were listed in a join; now it is refused here. Missing scores come last, as in SQL; rows without a place or id match nothing."""
    monkeypatch.setattr(evalmatch, "candidate_pairs", None)
    rng = random.Random(5)
    p = [(f"p{i}", "a", rng.choice([None, 0.1, 0.5, 0.9]), rng.randrange(60) / 8, rng.randrange(60) / 8) for i in range(300)]
    t = [(f"t{i}", "a", rng.randrange(60) / 8, rng.randrange(60) / 8) for i in range(250)]
    odd_p = [("q0", None, 1.0, 1.0, 1.0), ("q1", "a", 1.0, None, 1.0), ("q2", "b", 1.0, float("nan"), 1.0), (None, "a", 1.0, 1.0, 1.0)]
    pf = spark.createDataFrame(p + odd_p, "id string, chip string, score double, x double, y double")
    tf = spark.createDataFrame(t, "id string, chip string, x double, y double").repartition(3)
    first = sorted(p, key=lambda r: r[0]) if nearest_first else sorted(p, key=lambda r: (-(r[2] if r[2] is not None else -1), r[0]))
    others = sorted(t)
    want = brute([r[3:] for r in first], [r[2:] for r in others], [12.0] * len(t), nearest_first)
    got = {(r["p_id"], r["t_id"], r["distance"]) for r in evalmatch.matched(pf, tf, 12.0, nearest_first).collect()}
    assert got == {(first[i][0], others[j][0], d) for j, (i, d) in want.items()}


def refused(*_, **__):
    raise AssertionError("all pairs are listed")


@pytest.mark.parametrize("name", ["e1_greedy_match", "e4_mask_aware_counts", "r16_review_rank", "e5_model_diff", "e2_variable_radius_match"])
def test_queries_list_no_pairs(spark, monkeypatch, name):
    monkeypatch.setattr(evalmatch, "candidate_pairs", refused)
    assert registry.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0


def test_nearest_in_pieces(monkeypatch):
    monkeypatch.setattr(nearby, "PAIRS", 40)
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 30, (150, 2)) / 2.0, np.concatenate([rng.integers(0, 30, (100, 2)) / 2.0, [[900.0, 0.0]]])
    for radius, k in ((1.0, 2), (4.0, 3), (50.0, 5), (float("inf"), 1)):
        d = np.sqrt(((a[:, None] - b[None]) ** 2).sum(axis=2))
        want = sorted((i, int(j), d[i, j]) for i in range(len(a)) for j in np.lexsort((np.arange(len(b)), d[i]))[:k] if d[i, j] <= radius)
        assert sorted(zip(*(c.tolist() for c in nearby.nearest(a[:, 0], a[:, 1], b[:, 0], b[:, 1], radius, k)), strict=True)) == want


def test_nearest_pairs(spark):
    """Rows near the edges of tiles, piles of equal places, repeated ids and rows without a place."""
    rng = random.Random(4)
    rows = [(f"i{i % 190}", rng.choice([8.0, 16.0, rng.randrange(-60, 200) / 4]), rng.choice([0.0, rng.randrange(-60, 200) / 4])) for i in range(200)]
    df = spark.createDataFrame([*rows, ("n1", None, 1.0), ("n2", float("nan"), 1.0), ("n3", float("inf"), 1.0)], "id string, x double, y double")
    for distinct in (False, True):
        want = []
        for a in rows:
            near = sorted((math.sqrt((a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2), b[0]) for b in rows if not (distinct and a[0] == b[0]))
            want += [(a[0], b, d) for d, b in near[:3] if d <= 2.0]
        got = nearby.nearest_pairs(df, df, 2.0, 3, distinct).collect()
        assert sorted(tuple(r) for r in got) == sorted(want)


def test_mutual_pairs(spark):
    rng = random.Random(9)
    p = [(f"p{i:02}", f"c{i % 2}", rng.randrange(40) / 4, rng.randrange(40) / 4) for i in range(80)]
    t = [(f"t{i:02}", f"c{i % 2}", rng.randrange(40) / 4, rng.randrange(40) / 4) for i in range(60)]
    near = lambda a, others: min(((math.sqrt((a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2), b[0]) for b in others if a[1] == b[1]), default=(99, None))
    back = {b[0]: near(b, p)[1] for b in t}
    want = sorted((a[1], near(a, t)[0]) for a in p if near(a, t)[0] <= 2 and back[near(a, t)[1]] == a[0])
    schema = "id string, chip string, x double, y double"
    got = nearby.mutual_pairs(spark.createDataFrame(p, schema), spark.createDataFrame(t, schema), 2.0).collect()
    assert sorted(tuple(r) for r in got) == want
