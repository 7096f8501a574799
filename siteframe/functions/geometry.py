"""Column expressions on points, rings and rectangles.

A ring is an array of ``struct<x,y>`` whose last point equals the first one.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def point(x, y) -> Column:
    return F.struct(_c(x).cast("double").alias("x"), _c(y).cast("double").alias("y"))


def rectangle(x0, y0, x1, y1) -> Column:
    """Closed ring of an axis-parallel rectangle."""
    return F.array(point(x1, y0), point(x0, y0), point(x0, y1), point(x1, y1), point(x1, y0))


def rectangle_touches_border(x0, y0, x1, y1, height, width) -> Column:
    """Whether a box reaches the outermost pixels of its site."""
    return ((_c(x0) <= 0) | (_c(y0) <= 0) | (_c(x1) >= _c(width) - 1) | (_c(y1) >= _c(height) - 1))


def _edges(ring: Column) -> Column:
    """Consecutive point pairs of a ring."""
    return F.zip_with(F.slice(ring, F.lit(1), F.size(ring) - 1), F.slice(ring, F.lit(2), F.size(ring) - 1),
                      lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def point_in_ring(ring, x, y) -> Column:
    """Even-odd rule: an odd number of edges lies to the right of the point."""
    ring, x, y = _c(ring), _c(x), _c(y)

    def crosses(edge):
        a, b = edge["a"], edge["b"]
        spans = (a["y"] > y) != (b["y"] > y)
        # try_divide keeps level edges, which never span, out of the division.
        at = a["x"] + F.try_divide((y - a["y"]) * (b["x"] - a["x"]), b["y"] - a["y"])
        return F.when(spans & (x < at), 1).otherwise(0)

    return F.aggregate(_edges(ring), F.lit(0), lambda n, e: n + crosses(e)) % 2 == 1


def ring_box(ring) -> Column:
    ring = _c(ring)
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"),
                    F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def _side(p, q, r) -> Column:
    """Sign of the turn from pq towards r."""
    return F.signum((q["x"] - p["x"]) * (r["y"] - p["y"]) - (q["y"] - p["y"]) * (r["x"] - p["x"]))


def _within(p, q, r) -> Column:
    """r, known to be on the line pq, lies between p and q."""
    return (r["x"].between(F.least(p["x"], q["x"]), F.greatest(p["x"], q["x"]))
            & r["y"].between(F.least(p["y"], q["y"]), F.greatest(p["y"], q["y"])))


def segments_intersect(a, b, c, d) -> Column:
    """Whether two closed segments share a point."""
    s1, s2, s3, s4 = _side(a, b, c), _side(a, b, d), _side(c, d, a), _side(c, d, b)
    return (((s1 != s2) & (s3 != s4)) | ((s1 == 0) & _within(a, b, c)) | ((s2 == 0) & _within(a, b, d))
            | ((s3 == 0) & _within(c, d, a)) | ((s4 == 0) & _within(c, d, b)))


def ring_intersects_box(ring, x0, y0, x1, y1) -> Column:
    """Whether the area of a ring and a box share a point."""
    ring = _c(ring)
    x0, y0, x1, y1 = (_c(v).cast("double") for v in (x0, y0, x1, y1))
    inside = F.exists(ring, lambda p: p["x"].between(x0, x1) & p["y"].between(y0, y1))
    box = rectangle(x0, y0, x1, y1)
    crossing = F.exists(_edges(ring), lambda e: F.exists(
        _edges(box), lambda f: segments_intersect(e["a"], e["b"], f["a"], f["b"])))
    return inside | crossing | point_in_ring(ring, x0, y0)


def ring_is_valid(ring) -> Column:
    """Closed, at least four points, and no two edges meet except neighbours at
    their common point."""
    ring = _c(ring)
    closed = (F.element_at(ring, 1) == F.element_at(ring, -1)) & (F.size(ring) >= 4)
    edges = _edges(ring)
    n = F.size(edges)
    indexed = F.transform(edges, lambda e, i: F.struct(e["a"].alias("a"), e["b"].alias("b"), i.alias("i")))
    clash = F.exists(indexed, lambda e: F.exists(
        indexed, lambda f: (f["i"] > e["i"] + 1) & ~((e["i"] == 0) & (f["i"] == n - 1))
        & segments_intersect(e["a"], e["b"], f["a"], f["b"])))
    return closed & ~clash


def ring_area(ring) -> Column:
    """Unsigned area by the shoelace sum."""
    total = F.aggregate(_edges(_c(ring)), F.lit(0.0), lambda s, e: s + (
        e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]))
    return F.abs(total) / 2


def ring_centroid(ring) -> Column:
    """Area centroid of a ring."""
    edges = _edges(_c(ring))

    def cross(e):
        return e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]

    area6 = F.aggregate(edges, F.lit(0.0), lambda s, e: s + cross(e)) * 3
    sx = F.aggregate(edges, F.lit(0.0), lambda s, e: s + (e["a"]["x"] + e["b"]["x"]) * cross(e))
    sy = F.aggregate(edges, F.lit(0.0), lambda s, e: s + (e["a"]["y"] + e["b"]["y"]) * cross(e))
    return F.struct((sx / area6).alias("x"), (sy / area6).alias("y"))


def ring_geojson(ring) -> Column:
    """GeoJSON polygon with whole-number coordinates."""
    pairs = F.transform(_c(ring), lambda p: F.array(p["x"].cast("int"), p["y"].cast("int")))
    return F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(pairs).alias("coordinates")))


def point_geojson(x, y) -> Column:
    return F.to_json(F.struct(F.lit("Point").alias("type"),
                              F.array(_c(x).cast("int"), _c(y).cast("int")).alias("coordinates")))


def tile_box(z, y, x, maxzoom) -> Column:
    """Map rectangle of a tile; y grows upwards on the map."""
    size = F.lit(256) * F.pow(F.lit(2), _c(maxzoom) - _c(z))
    return F.struct((_c(x) * size).alias("x0"), (-_c(y) * size - size).alias("y0"),
                    (_c(x) * size + size).alias("x1"), (-_c(y) * size).alias("y1"))


def zoom_thresholds(ref_type, maxzoom, is_static, as_polygons) -> Column:
    """Zoom levels from which objects are drawn as outlines and as points."""
    maxzoom = _c(maxzoom)
    static_polygon = (F.when(_c(ref_type) == "Well", maxzoom - 11)
                      .when(_c(ref_type) == "Site", maxzoom - 8).otherwise(F.lit(0)))
    drawn = F.when(_c(as_polygons), maxzoom - 4).otherwise(maxzoom + 1)
    polygon = F.when(_c(is_static), static_polygon).otherwise(drawn)
    centroid = F.when(_c(is_static), F.lit(0)).otherwise(drawn - 2)
    return F.struct(F.greatest(polygon, F.lit(0)).alias("polygon_thresh"),
                    F.greatest(centroid, F.lit(0)).alias("centroid_thresh"))
