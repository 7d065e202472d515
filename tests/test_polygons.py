"""Polygons with parts and holes against plain ray casting and plain distances."""

import math
import random

import pytest
from arborscale.functions import geometry
from arborscale.operators import polygons
from pyspark.sql import functions as F

SCHEMA = "poly_id int, rings array<struct<hole:boolean,ring:array<struct<x:double,y:double>>>>"


def star(rng, cx, cy, radius, n):
    ring = [(cx + r * math.cos(t), cy + r * math.sin(t)) for t, r in sorted((rng.uniform(0, 2 * math.pi), radius * rng.uniform(0.4, 1)) for _ in range(n))]
    return [*ring, ring[0]]


def inside(x, y, rings):
    odd = 0
    for _, ring in rings:
        for (x0, y0), (x1, y1) in zip(ring, ring[1:], strict=False):
            odd ^= (y0 > y) != (y1 > y) and x < (x1 - x0) * (y - y0) / (y1 - y0) + x0
    return bool(odd)


def away(x, y, rings):
    best = math.inf
    for _, ring in rings:
        for (x0, y0), (x1, y1) in zip(ring, ring[1:], strict=False):
            dx, dy = x1 - x0, y1 - y0
            t = max(min(((x - x0) * dx + (y - y0) * dy) / (dx * dx + dy * dy), 1), 0) if dx or dy else 0
            best = min(best, math.hypot(x - x0 - t * dx, y - y0 - t * dy))
    return best


@pytest.fixture(scope="module")
def shapes():
    rng = random.Random(4)
    out = []
    for i in range(25):
        cx, cy, radius = rng.uniform(-300, 300), rng.uniform(-300, 300), rng.choice([2, 15, 60, 200])
        rings = [(False, star(rng, cx, cy, radius, rng.choice([3, 8, 40, 400])))]
        if i % 2:
            rings.append((True, star(rng, cx, cy, radius * 0.3, 7)))
        if i % 3 == 0:
            rings.append((False, star(rng, cx + 3 * radius, cy, radius / 2, 12)))
        out.append((i, rings))
    # corners on cell edges, and a staircase along them
    out.append((25, [(False, [(0, 0), (64, 0), (64, 64), (32, 64), (32, 32), (0, 32), (0, 0)])]))
    steps = [(k // 2 + k % 2, k // 2) for k in range(65)]
    out.append((26, [(False, [*map(lambda p: (float(p[0] - 100), float(p[1])), steps), (-100.0, 32.0), (-100.0, 0.0)])]))
    return out


@pytest.fixture(scope="module")
def points():
    rng = random.Random(9)
    grid = [(float(x), float(y)) for x in range(-104, 72, 8) for y in range(-8, 72, 8)] + [(-100 + k / 2, k / 2) for k in range(64)]
    return [(i, *p) for i, p in enumerate([(rng.uniform(-500, 500), rng.uniform(-500, 500)) for _ in range(1500)] + grid)]


def frames(spark, shapes, points):
    rows = [(i, [{"hole": h, "ring": [{"x": float(x), "y": float(y)} for x, y in r]} for h, r in rings]) for i, rings in shapes] + [(99, None), (98, [])]
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([*points, (-1, None, 1.0), (-2, 1.0, None)], "id int, x double, y double")


@pytest.mark.parametrize("most_edges, least, splits", [(8, 2, 3), (1000, 0, 0)])
def test_hits_are_those_of_ray_casting(spark, shapes, points, most_edges, least, splits):
    areas, p = frames(spark, shapes, points)
    got = {(r.id, r.poly_id) for r in polygons.hits(p, polygons.outlines(areas), most_edges=most_edges, least=least, splits=splits).collect()}
    assert got == {(i, k) for i, x, y in points for k, rings in shapes if inside(x, y, rings)}


def test_cells_are_bounded_and_hold_few_edges(spark, shapes, points):
    areas, _ = frames(spark, shapes, points)
    cells = polygons.covering(polygons.outlines(areas))
    per = cells.groupBy("poly_id").agg(F.count("*").alias("n")).collect()
    assert len(per) == len(shapes) and max(r.n for r in per) <= 9 * 16**polygons.SPLITS
    big = next(i for i, rings in shapes if len(rings[0][1]) == 401)
    mean = cells.where(F.col("poly_id") == big).agg(F.avg(F.size("edges")).alias("m")).head().m
    assert mean < 20  # of 400 edges


def test_nearest_outline_by_plain_distance(spark, shapes, points):
    areas, p = frames(spark, shapes, points)
    got = {r.id: (r.how, r.poly_id, r.distance) for r in polygons.containing_or_near(p, areas, 40.0).collect()}
    for i, x, y in points:
        held = [k for k, rings in shapes if inside(x, y, rings)]
        if held:
            assert got.pop(i) == ("inside", min(held), 0.0)
            continue
        d, k = min((away(x, y, rings), k) for k, rings in shapes)
        if d <= 40:
            how, poly, distance = got.pop(i)
            assert how == "nearby" and poly == k and distance == pytest.approx(d, abs=1e-9)
    assert not got


def test_text_forms_areas_and_centroids(spark):
    wkt = [
        "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0))", "POLYGON((0 0,0 4,4 4,4 0,0 0),(1 1,2 1,2 2,1 2,1 1))", "MULTIPOLYGON (((0 0, 2 0, 2 2, 0 2, 0 0)), ((10 0, 12 0, 12 2, 10 2, 10 0)))",
        "SRID=4326;MULTIPOLYGON(((0 0 5, 4 0 5, 4 4 5, 0 4 5, 0 0 5),(1 1 5, 3 1 5, 3 3 5, 1 3 5, 1 1 5)),((10 10 5,11 10 5,11 11 5,10 10 5)))", "POLYGON ((0 0, 4 0, 4 4, 0 4))",
        "POLYGON EMPTY", "POINT (1 2)", "", None, "POLYGON ((0 0, 1 0))", "POLYGON ((0 0, 2 0, 4 0, 0 0))", "POLYGON ((a b, c d, 1 1))",
    ]
    rings = geometry.rings_of_wkt(F.col("w"))
    rows = spark.createDataFrame([(i, w) for i, w in enumerate(wkt)], "i int, w string").select("i", geometry.area(rings).alias("a"), geometry.centroid(rings).alias("c")).orderBy("i").collect()
    got = [(r.a, r.c and (r.c.x, r.c.y)) for r in rows]
    assert got[:3] == [(16.0, (2.0, 2.0)), (15.0, pytest.approx((30.5 / 15, 30.5 / 15))), (8.0, (6.0, 1.0))]
    assert got[3] == (12.5, pytest.approx(((12 * 2 + 0.5 * (32 / 3)) / 12.5, (12 * 2 + 0.5 * (31 / 3)) / 12.5)))
    assert got[4] == (16.0, (2.0, 2.0)) and got[10] == (0.0, (2.0, 0.0))
    assert [g for k, g in enumerate(got) if k in (5, 6, 7, 8, 9, 11)] == [(None, None)] * 6


def test_geojson_is_the_same_geometry(spark):
    text = ['{"type": "Polygon", "coordinates": [[[0,0],[4,0],[4,4],[0,4],[0,0]], [[1,1],[2,1],[2,2],[1,2],[1,1]]]}', '{"type": "MultiPolygon", "coordinates": [[[[0,0],[2,0],[2,2],[0,2],[0,0]]], [[[10,0],[12,0],[12,2],[10,2],[10,0]]]]}', '{"type": "Point", "coordinates": [1,2]}', None, "junk"]
    rings = geometry.rings_of_geojson(F.col("t"))
    got = [(r.a, r.n) for r in spark.createDataFrame([(i, t) for i, t in enumerate(text)], "i int, t string").select("i", geometry.area(rings).alias("a"), F.size(rings).alias("n")).orderBy("i").collect()]
    assert got[:2] == [(15.0, 2), (8.0, 2)] and all(a is None for a, _ in got[2:])


def test_box_shares_add_up_to_the_area(spark, shapes, points):
    areas, _ = frames(spark, shapes[:12], points)
    cut = areas.where("poly_id < 12").select("poly_id", geometry.area(F.col("rings")).alias("whole"), "rings").withColumn("i", F.expr("explode(sequence(-40, 40))")).withColumn("j", F.expr("explode(sequence(-40, 40))"))
    parts = cut.withColumn("a", geometry.box_area(F.col("rings"), F.col("i") * 25.0, F.col("j") * 25.0, F.col("i") * 25.0 + 25, F.col("j") * 25.0 + 25))
    for r in parts.groupBy("poly_id").agg(F.first("whole").alias("whole"), F.sum("a").alias("a")).collect():
        assert r.a == pytest.approx(r.whole, rel=1e-9)


def test_stacked_polygons_are_tried_once(spark, monkeypatch):
    """Many polygons with the same edges: the least id answers, and one of them is covered with cells."""
    ring = [(0.0, 0.0), (8.0, 0.0), (8.0, 8.0), (0.0, 8.0), (0.0, 0.0)]
    shape = lambda dx: [(False, [(x + dx, y) for x, y in ring])]
    areas = [(i, shape(100.0 * (i % 2)), "park" if i % 5 == 0 else "street" if i in (8, 10) else "parcel", i % 3 == 0, i == 9) for i in range(4, 400)]
    df = spark.createDataFrame(areas, "poly_id long, rings array<struct<hole: boolean, ring: array<struct<x: double, y: double>>>>, layer string, taxed boolean, public boolean")
    points = spark.createDataFrame([(1, 4.0, 4.0), (2, 104.0, 4.0), (3, 11.0, 4.0), (4, 60.0, 4.0)], "id int, x double, y double")
    covered, cover = [], polygons.covering
    monkeypatch.setattr(polygons, "covering", lambda outline, **how: covered.append(outline.count()) or cover(outline, **how))
    got = {r.id: (r.how, r.poly_id, r.distance) for r in polygons.containing_or_near(points, df, 20.0).collect()}
    assert got == {1: ("inside", 4, 0.0), 2: ("inside", 5, 0.0), 3: ("nearby", 4, 3.0)}
    assert {r.id: (r.setting, r.park_id) for r in polygons.settings(points, df).collect()} == {1: ("park", 10), 2: ("park", 5)}
    assert {r.id: (r.setting, r.park_id) for r in polygons.settings(points, df.where("layer <> 'park' and poly_id > 10")).collect()} == {1: ("private", None), 2: ("private", None)}
    assert covered == [2, 2, 2]
