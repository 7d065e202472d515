"""Polygons with several parts and holes, as arrays of rings, in column expressions.

A geometry is ``array<struct<hole, ring>>`` with every ring closed, an array of ``x``, ``y``. Containment is even-odd over all
rings, so neither the direction of a ring nor the order of parts matters; areas and centroids count holes as negative."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A ring of polygon text; the first ring of a part follows the parenthesis that opens the part.
_RING = r"(\(\s*)?\(([^()]*)\)"


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, however often ``f`` names it."""
    return F.transform(F.array(value), f)[0]


def _closed(ring: Column) -> Column:
    """The ring without null points, with its first point at its end."""
    firm = F.filter(ring, lambda p: p["x"].isNotNull() & p["y"].isNotNull())
    return bound(firm, lambda r: F.when((F.size(r) > 0) & (F.try_element_at(r, F.lit(-1)) != F.try_element_at(r, F.lit(1))), F.concat(r, F.slice(r, 1, 1))).otherwise(r))


def _geometry(rings: Column) -> Column:
    """Rings of three different points at least; null where there is none."""
    closed = F.transform(rings, lambda r: F.struct(r["hole"].alias("hole"), _closed(r["ring"]).alias("ring")))
    return bound(F.filter(closed, lambda r: F.size(r["ring"]) > 3), lambda kept: F.when(F.size(kept) > 0, kept))


def rings_of_wkt(wkt: Column) -> Column:
    """The rings of a POLYGON or MULTIPOLYGON text; null for others, for EMPTY and for null. Heights are passed over."""
    number = lambda p, k: F.try_element_at(F.split(F.trim(p), r"\s+"), F.lit(k)).try_cast("double")
    points = lambda text: F.transform(F.split(text, ","), lambda p: F.struct(number(p, 1).alias("x"), number(p, 2).alias("y")))
    pairs = F.arrays_zip(F.regexp_extract_all(wkt, F.lit(_RING), F.lit(1)).alias("opens"), F.regexp_extract_all(wkt, F.lit(_RING), F.lit(2)).alias("text"))
    rings = F.transform(pairs, lambda r: F.struct((r["opens"] == "").alias("hole"), points(r["text"]).alias("ring")))
    return F.when(F.upper(wkt).rlike(r"^\s*(SRID\s*=\s*\d+\s*;\s*)?(MULTI)?POLYGON"), _geometry(rings))


def rings_of_geojson(text: Column) -> Column:
    """The rings of a GeoJSON Polygon or MultiPolygon; null for others and for null."""
    kind = F.get_json_object(text, "$.type")
    ring = "array<array<double>>"
    one, many = (F.from_json(text, f"coordinates {depth}")["coordinates"] for depth in (f"array<{ring}>", f"array<array<{ring}>>"))
    parts = F.when(kind == "Polygon", F.array(one)).when(kind == "MultiPolygon", many)
    point = lambda p: F.struct(F.get(p, 0).alias("x"), F.get(p, 1).alias("y"))
    return _geometry(F.flatten(F.transform(parts, lambda part: F.transform(part, lambda r, i: F.struct((i > 0).alias("hole"), F.transform(r, point).alias("ring"))))))


def _steps(ring: Column) -> Column:
    """The edges of a closed ring."""
    edge = lambda a, b: F.struct(a["x"].alias("x0"), a["y"].alias("y0"), b["x"].alias("x1"), b["y"].alias("y1"))
    return bound(ring, lambda r: F.zip_with(F.slice(r, F.lit(1), F.greatest(F.size(r) - 1, F.lit(0))), F.slice(r, F.lit(2), F.greatest(F.size(r) - 1, F.lit(0))), edge))


def edges(rings: Column) -> Column:
    """All edges of a geometry."""
    return F.flatten(F.transform(rings, lambda r: _steps(r["ring"])))


def _moments(rings: Column) -> Column:
    """Twice the area and six times the first moments, holes negative. Each ring is moved to its first point before it is summed,
    so that far coordinates don't swallow small areas."""

    def of(r: Column) -> Column:
        x, y = r["ring"][0]["x"], r["ring"][0]["y"]

        def add(s: Column, e: Column) -> Column:
            x0, y0, x1, y1 = e["x0"] - x, e["y0"] - y, e["x1"] - x, e["y1"] - y
            c = x0 * y1 - x1 * y0
            return F.struct((s["a"] + c).alias("a"), (s["x"] + (x0 + x1) * c).alias("x"), (s["y"] + (y0 + y1) * c).alias("y"))

        zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))

        def signed(s: Column) -> Column:
            sign = F.when(s["a"] < 0, -1.0).otherwise(1.0) * F.when(r["hole"], -1.0).otherwise(1.0)
            return F.struct((s["a"] * sign).alias("a"), ((s["x"] + 3 * x * s["a"]) * sign).alias("x"), ((s["y"] + 3 * y * s["a"]) * sign).alias("y"))

        return bound(F.aggregate(_steps(r["ring"]), zero, add), signed)

    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    return F.aggregate(F.transform(rings, of), zero, lambda t, s: F.struct((t["a"] + s["a"]).alias("a"), (t["x"] + s["x"]).alias("x"), (t["y"] + s["y"]).alias("y")))


def area(rings: Column) -> Column:
    """The area of all parts without their holes."""
    return _moments(rings)["a"] / 2


def centroid(rings: Column) -> Column:
    """The centre of gravity ``x``, ``y``; a geometry without area gives the mean of its points."""

    def of(g: Column) -> Column:
        points = F.flatten(F.transform(g, lambda r: F.slice(r["ring"], F.lit(1), F.size(r["ring"]) - 1)))
        mean = lambda k: F.aggregate(points, F.lit(0.0), lambda t, p: t + p[k]) / F.size(points)
        at = lambda m, k: F.when(m["a"] != 0, m[k] / (3 * m["a"])).otherwise(mean(k)).alias(k)
        return F.when(g.isNotNull(), bound(_moments(g), lambda m: F.struct(at(m, "x"), at(m, "y"))))

    return bound(rings, of)


def crosses(x: Column, y: Column, edge: Column) -> Column:
    """Whether the ray from a point to the right meets an edge; half-open, so a shared end counts once."""
    return ((edge["y0"] > y) != (edge["y1"] > y)) & (x < (edge["x1"] - edge["x0"]) * (y - edge["y0"]) / (edge["y1"] - edge["y0"]) + edge["x0"])


def contains(x: Column, y: Column, rings: Column) -> Column:
    """Whether a point lies in a geometry, by all its edges."""
    return F.size(F.filter(edges(rings), lambda e: crosses(x, y, e))) % 2 == 1


def edge_distance(x: Column, y: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Distance of a point to an edge."""
    dx, dy = x1 - x0, y1 - y0
    length = dx * dx + dy * dy
    t = F.when(length > 0, F.greatest(F.least(((x - x0) * dx + (y - y0) * dy) / length, F.lit(1.0)), F.lit(0.0))).otherwise(0.0)
    return F.sqrt((x - x0 - t * dx) ** 2 + (y - y0 - t * dy) ** 2)


def clipped(ring: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """A closed ring cut to a box, one half-plane after the other. Of a ring that the box cuts in several pieces the result
    runs along the box between them, which leaves its area right."""

    def cut(ring: Column, axis: str, other: str, edge: Column, below: bool) -> Column:
        inside = (lambda v: v <= edge) if below else (lambda v: v >= edge)
        place = lambda p, q: F.struct((p if axis == "x" else q).cast("double").alias("x"), (q if axis == "x" else p).cast("double").alias("y"))

        def kept(e: Column) -> Column:
            a, b, c, d = e[f"{axis}0"], e[f"{axis}1"], e[f"{other}0"], e[f"{other}1"]
            crossing, end = place(edge, c + (d - c) * (edge - a) / (b - a)), place(b, d)
            return F.when(inside(a) & inside(b), F.array(end)).when(inside(a), F.array(crossing)).when(inside(b), F.array(crossing, end)).otherwise(F.array().cast("array<struct<x:double,y:double>>"))

        points = F.flatten(F.transform(_steps(ring), kept))
        return bound(points, lambda p: F.when(F.size(p) > 0, F.concat(F.slice(p, F.size(p), F.lit(1)), p)).otherwise(p))

    for axis, other, edge, below in (("x", "y", x0, False), ("x", "y", x1, True), ("y", "x", y0, False), ("y", "x", y1, True)):
        ring = cut(ring, axis, other, edge, below)
    return ring


def _signed(ring: Column) -> Column:
    """Twice the area of a closed ring, negative if it turns clockwise; 0 of no points."""
    x, y = F.get(ring, 0)["x"], F.get(ring, 0)["y"]
    return F.aggregate(_steps(ring), F.lit(0.0), lambda s, e: s + (e["x0"] - x) * (e["y1"] - y) - (e["x1"] - x) * (e["y0"] - y))


def box_area(rings: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """The area of a geometry inside a box: each ring's, as it turns, so that what the cuts of all boxes of a grid hold adds up."""

    def of(r: Column) -> Column:
        sign = F.when(_signed(r["ring"]) < 0, -0.5).otherwise(0.5) * F.when(r["hole"], -1.0).otherwise(1.0)
        return sign * bound(clipped(r["ring"], x0, y0, x1, y1), _signed)

    return F.coalesce(F.aggregate(F.transform(rings, of), F.lit(0.0), lambda s, a: s + a), F.lit(0.0))
