"""Nearest rows across tables and grid calibration by trying all pairs."""

import math
import random

import pytest
from arborscale.operators import calibration

SCHEMA = "id string, x double, y double"


def tables(spark):
    rng = random.Random(2)
    left = [(f"q{i}", rng.uniform(0, 100), rng.uniform(0, 100)) for i in range(120)] + [("far", 90_000.0, -4_000.0), ("stack", 5.0, 5.0)]
    right = [(f"a{i}", rng.uniform(0, 100), rng.uniform(0, 100)) for i in range(60)] + [(f"s{i}", 5.0, 5.0) for i in range(40)] + [("lone", 4_000.0, 50.0), ("gone", None, 1.0), ("odd", float("nan"), 1.0)]
    return left, right, spark.createDataFrame([*left, ("null", None, None)], SCHEMA), spark.createDataFrame(right, SCHEMA)


def plain(rows, others, same=False):
    out = {}
    for i, x, y in rows:
        found = sorted((math.hypot(x - u, y - v), k) for k, u, v in others if u is not None and u == u and not (same and k == i))
        out[i] = (found[0][1], found[0][0], found[1][0]) if len(found) > 1 else (*found[0][::-1], None) if found else (None, None, None)
    return out


def test_nearest_two_of_another_table_at_any_distance(spark):
    left, right, q, a = tables(spark)
    got = {r.id: (r.nearest, r.d1, r.d2) for r in calibration.nearest_two(q, a).collect()}
    want = plain(left, right)
    assert set(got) == set(want)
    for i, (k, d1, d2) in want.items():
        assert got[i][0] == k and got[i][1:] == (pytest.approx(d1), pytest.approx(d2))


def test_mutual_rows_and_rows_of_one_table(spark):
    left, right, q, a = tables(spark)
    there, back = plain(left, right), plain([r for r in right if r[1] is not None and r[1] == r[1]], left)
    got = {r.id: r.mutual for r in calibration.nearest_across(q, a).collect()}
    assert got == {i: back[k][0] == i for i, (k, _, _) in there.items()} and sum(got.values()) > 10
    own = {r.id: (r.nearest, r.d1) for r in calibration.nearest_two(q, q, same=True).collect()}
    assert own == {i: (k, pytest.approx(d)) for i, (k, d, _) in plain(left, left, True).items()}


@pytest.mark.parametrize("others", [[], [("a", 1.0, 1.0)], [("a", None, 1.0)]])
def test_few_or_no_rows_to_be_near(spark, others):
    q = spark.createDataFrame([("q", 0.0, 0.0)], SCHEMA)
    r = calibration.nearest_two(q, spark.createDataFrame(others, SCHEMA)).head()
    assert (r.nearest, r.d2) == (("a", None) if others and others[0][1] else (None, None))
    assert calibration.nearest_two(q.limit(0), q).count() == 0


def test_calibration_counts_one_by_one(spark):
    left, right, q, a = tables(spark)
    right = [r for r in right if r[1] is not None and r[1] == r[1]]
    there, back = plain(left, right), plain(right, left)
    before = None
    for r in sorted(calibration.grid_calibration(q, a.where("x > -1e9 and not isnan(x)"), (1.0, 5.0, 20.0)).collect()):
        s = r.size
        held = {(k, math.floor(x / s + dx), math.floor(y / s + dy)) for k, (dx, dy) in enumerate(((0, 0), (0.5, 0), (0, 0.5), (0.5, 0.5))) for _, x, y in right}
        flag = {i for i, x, y in left if any((k, math.floor(x / s + dx), math.floor(y / s + dy)) in held for k, (dx, dy) in enumerate(((0, 0), (0.5, 0), (0, 0.5), (0.5, 0.5))))}
        mutual = {i for i, (k, _, _) in there.items() if back[k][0] == i}
        true, false = len(flag & mutual), len(flag - mutual)
        assert (r.points, r.flagged, r.true_duplicates, r.false_duplicates, r.recall) == (len(left), len(flag), true, false, true / len(mutual))
        assert r.missed == sum(d <= s / 2 and i not in flag for i, (_, d, _) in there.items()) == 0
        assert r.beyond == sum(d > s * 2**0.5 and i in flag for i, (_, d, _) in there.items()) == 0
        if before:
            assert (r.more_true, r.more_false) == (true - before[0], false - before[1]) and (r.marginal == pytest.approx(r.more_true / r.more_false) if r.more_false else r.marginal is None)
        before = true, false
