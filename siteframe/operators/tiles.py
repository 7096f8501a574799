"""Map tiles: base level, pyramid, and vector data of objects."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteframe.config import ExperimentConfig
from siteframe.core import cut_lineage, image_keys, salted_join
from siteframe.functions import geometry as G
from siteframe.functions.scalars import scale_to_byte
from siteframe.operators import pixels as P
from siteframe.operators.segment import _components, _dilate, _erode, SQUARE, trace_contour

TILE = 256
#: Polygons that one task fills.
POLYGONS_A_TASK = 8192


def build_base_tiles(px: DataFrame, sites: DataFrame, lower: int | None = None, upper: int | None = None,
                     stats: DataFrame | None = None, shifts: DataFrame | None = None,
                     residues: DataFrame | None = None, skip_correction: tuple[int, ...] = (),
                     bounds: DataFrame | None = None) -> DataFrame:
    """Pixels of the base level of each layer at their place on the map, in 8 bit.
    `bounds` has the display bounds of each layer (see `pixels.layer_bounds`); `lower`
    and `upper` are bounds for all of them.

    Images are corrected, aligned without cropping and scaled before they are
    placed. Where images overlap, the lower or right one lies on top. Image lines are dealt out
    to the lines of the map as a row each and fall into pixels there.
    """
    if stats is not None:
        px = P.correct_selected(px, stats, skip_correction) if skip_correction else P.correct_illumination(px, stats)
    if shifts is not None:
        px = P.align(px, shifts, residues, crop=False)
    if bounds is not None:
        on = [c for c in ("channel_id", "cycle_id") if c in bounds.columns and c in px.columns]
        # Layers are few; pixels would else be dealt out by layer.
        px = px.join(F.broadcast(bounds), on or None).withColumn("value", scale_to_byte(
            F.greatest(F.least("value", "max_intensity"), "min_intensity"), F.col("min_intensity"), F.col("max_intensity"))).drop("min_intensity", "max_intensity")
    elif lower is not None and upper is not None:
        px = P.clip(px, lower, upper).withColumn("value", scale_to_byte("value", F.lit(lower), F.lit(upper)))
    layer = [k for k in image_keys(px) if k != "site_id"]
    kind = px.schema["value"].dataType
    if bounds is not None or (lower is not None and upper is not None):
        px = px.withColumn("value", F.col("value").cast("smallint"))  # 0 to 255 on their way
    lines = _packed_lines(px).join(sites.select("site_id", "offset_y", "offset_x", "site_y", "site_x"), "site_id")
    moved = lines.withColumns({"y": F.col("offset_y") + F.col("y"), "_x": F.col("offset_x") + F.col("_x")}).drop("site_id", "offset_y", "offset_x")
    # A line falls into far more rows than a shuffle counts on.
    tasks = 4 * int(px.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = _unpacked_lines(moved.repartition(tasks, *layer, "y")).select(*layer, "y", "x", F.struct("site_y", "site_x", F.col("value").cast(kind).alias("value")).alias("_top"))
    return placed.groupBy(*layer, "y", "x").agg(F.max("_top").alias("_top")).select(
        *layer, "y", "x", F.col("_top.value").alias("value"))


def _packed_lines(px: DataFrame) -> DataFrame:
    """A row for each image line: its first place `_x`, its values in order, and their distances from `_x` where places are missing or repeated."""
    keys = image_keys(px)
    lines = px.groupBy(*keys, "y").agg(F.sort_array(F.collect_list(F.struct("x", "value"))).alias("_p"))
    first = F.get("_p", F.lit(0))["x"]
    steps = F.transform("_p", lambda p: p["x"] - first)
    return lines.select(*keys, "y", first.alias("_x"), F.when(steps != F.sequence(F.lit(0), F.size("_p") - 1), steps).alias("_s"),
                        F.transform("_p", lambda p: p["value"]).alias("_v"))


def _unpacked_lines(lines: DataFrame) -> DataFrame:
    rows = lines.select("*", F.posexplode("_v").alias("_i", "value"))
    return rows.withColumn("x", F.col("_x") + F.coalesce(F.get("_s", F.col("_i")), F.col("_i"))).drop("_x", "_s", "_v", "_i")


def pack_tiles(px: DataFrame) -> DataFrame:
    """Arrays of pixels per tile: places inside the tile and their values; places
    that are not listed are black. A tile has a fixed largest size."""
    layer = [c for c in px.columns if c not in ("y", "x", "value")]
    inside = F.expr(f"CAST((y % {TILE}) * {TILE} + x % {TILE} AS INT)")
    return (px.groupBy(*layer, F.expr(f"y DIV {TILE}").alias("tile_y"), F.expr(f"x DIV {TILE}").alias("tile_x"))
            .agg(F.sort_array(F.collect_list(F.struct(inside.alias("place"), F.col("value")))).alias("pixels")))


def requested_pixels(px: DataFrame, requested: DataFrame) -> DataFrame:
    """Pixels of the requested tiles only, so that no other tile is packed."""
    numbered = px.withColumns({"tile_y": F.expr(f"y DIV {TILE}"), "tile_x": F.expr(f"x DIV {TILE}")})
    return numbered.join(requested.select("tile_y", "tile_x").distinct(), ["tile_y", "tile_x"], "left_semi").drop("tile_y", "tile_x")


def get_tile(tiles: DataFrame, requested: DataFrame, keys: tuple[str, ...] = ("tile_y", "tile_x")) -> DataFrame:
    """Full pixel array of the requested tiles; a missing tile is black."""
    wanted = requested.select(*keys).distinct()
    listed = tiles.join(wanted, list(keys), "left_semi").groupBy(*keys).agg(F.flatten(F.collect_list("pixels")).alias("_p"))
    # A tile is filled up inside its row; a row for each place would be made by the few tasks that hold the requests.
    imaged = F.sort_array(F.transform(F.filter("_p", lambda p: p["place"].between(0, TILE * TILE - 1)), lambda p: F.struct(
        p["place"].alias("place"), F.coalesce(p["value"], F.lit(0)).alias("value"))))
    full = wanted.join(listed, list(keys), "left").select(*keys, imaged.alias("_f"))

    def place(i) -> Column:
        return F.coalesce(F.get("_f", i)["place"], F.lit(-1)).cast("int")

    def black(n: Column) -> Column:
        return F.array_repeat(F.lit(0), n)

    runs = F.flatten(F.transform("_f", lambda p, i: F.concat(black(p["place"].cast("int") - place(i - 1) - 1), F.array(p["value"]))))
    rest = black(TILE * TILE - 1 - place(F.size("_f") - 1))
    return full.select(*keys, F.when(F.size("_f") > 0, F.concat(runs, rest)).otherwise(black(F.lit(TILE * TILE))).alias("pixels"))


def levels_to_one_tile(base: DataFrame, cfg: ExperimentConfig = ExperimentConfig()) -> int:
    """Number of coarser levels until a layer fits one tile."""
    top = base.agg(F.max(F.greatest("y", "x"))).first()[0] or 0
    n = 0
    while top // cfg.zoom_factor ** n >= TILE:
        n += 1
    return n


def build_pyramid(base: DataFrame, n_levels: int | None = None, cfg: ExperimentConfig = ExperimentConfig()) -> DataFrame:
    """Pixels of the base and all coarser levels down to one tile, or `n_levels` of
    them, level 0 being the base.

    Each level averages blocks of the level before it, black where nothing was
    imaged. A level is stored before the next one is built, so the pixels of the
    base are read once and each level holds a fraction of the level before.
    """
    f = cfg.zoom_factor
    layer = [c for c in base.columns if c not in ("y", "x", "value")]
    level = cut_lineage(base).withColumn("shrinks", F.lit(0))
    out = level
    for k in range(1, (levels_to_one_tile(level, cfg) if n_levels is None else n_levels) + 1):
        block = level.groupBy(*layer, F.expr(f"y DIV {f}").alias("y"), F.expr(f"x DIV {f}").alias("x")).agg(
            F.floor(F.sum("value") / (f * f) + 0.5).cast("int").alias("value"))
        level = cut_lineage(block).withColumn("shrinks", F.lit(k))
        out = out.unionByName(level)
    return out


# --- outlines ---------------------------------------------------------------------------

def _hole_rings(mask: np.ndarray) -> list[np.ndarray]:
    """Contours around the background regions enclosed by an object."""
    background = _components(~mask)
    outer = background[0, 0]
    return [trace_contour(_dilate(background == k) & mask) for k in range(1, background.max() + 1) if k != outer]


def _ring_area(ring: np.ndarray) -> float:
    nxt = np.roll(ring, -1, axis=0)
    return abs(float(np.sum(ring[:, 1] * nxt[:, 0] - nxt[:, 1] * ring[:, 0]))) / 2


def object_outline(y: np.ndarray, x: np.ndarray, height: int, width: int):
    """Outer ring and hole rings of the pixels of one object in (y, x) pixels.

    Pixels in the outermost image lines are left out, spurs are removed by an
    opening, the largest part is kept and too small objects become a square.
    """
    box = (y.min(), x.min())
    mask = np.zeros((np.ptp(y) + 3, np.ptp(x) + 3), bool)
    inner = (y > 0) & (y < height - 1) & (x > 0) & (x < width - 1)
    mask[y[inner] - box[0] + 1, x[inner] - box[1] + 1] = True
    if mask.sum() > 1:
        mask = _dilate(_erode(mask))
    parts = _components(mask, SQUARE)
    rings = [trace_contour(parts == k) for k in range(1, parts.max() + 1)]
    rings = [r for r in rings if len(r) >= 3]
    shift = np.array([box[0] - 1, box[1] - 1])
    if not rings:
        cy, cx = int(y.mean()), int(x.mean())
        return np.array([[cy - 1, cx - 1], [cy - 1, cx + 1], [cy + 1, cx + 1], [cy + 1, cx - 1]]), []
    best = max(range(len(rings)), key=lambda i: (_ring_area(rings[i]), -i))
    keep = parts == parts[tuple(rings[best][0])]
    holes = [h + shift for h in _hole_rings(keep) if len(h) >= 3]
    return rings[best] + shift, holes


def labels_to_polygons(labels: DataFrame, offsets: DataFrame) -> DataFrame:
    """Closed outline of each object on the map, y upwards, with holes. `offsets` has
    the place, height and width of each site. Python sees a range of labels of one
    image at a time."""
    keys = image_keys(labels)
    types = {f.name: f.dataType.simpleString() for f in labels.schema.fields}
    ring_type = "array<struct<x:double,y:double>>"
    schema = ", ".join([f"{k} {types[k]}" for k in keys] + [f"label {types['label']}", f"polygon {ring_type}",
                                                             f"holes array<{ring_type}>"])

    def outlines(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for label, part in pdf.groupby("label", sort=False):
            oy, ox = int(part["offset_y"].iloc[0]), int(part["offset_x"].iloc[0])
            ring, holes = object_outline(part["y"].to_numpy(), part["x"].to_numpy(), int(part["height"].iloc[0]), int(part["width"].iloc[0]))

            def closed(r):
                pts = [{"x": float(p[1] + ox), "y": float(-(p[0] + oy))} for p in r]
                return pts + pts[:1]

            rows.append([*key[:-1], label, closed(ring), [closed(h) for h in holes]])
        return pd.DataFrame(rows, columns=[*keys, "label", "polygon", "holes"])

    joined = labels.join(offsets.select("site_id", "offset_y", "offset_x", "height", "width"), "site_id")
    return joined.groupBy(*keys, F.expr("label DIV 64")).applyInPandas(outlines, schema)


def polygons_to_labels(segments: DataFrame, offsets: DataFrame, height: int, width: int, order: str = "label") -> DataFrame:
    """Label image of polygons, filled line by line between edge crossings by the
    even-odd rule, outline pixels included; the polygon that comes last wins where
    two overlap."""
    keys = image_keys(segments)
    # Outlines are dealt out by site before they are filled: a pixel takes as much room as a corner.
    dealt = segments.repartition(max(-(-segments.count() // POLYGONS_A_TASK), 1), "site_id")
    joined = dealt.join(offsets.select("site_id", "offset_y", "offset_x"), "site_id")
    local = F.transform("polygon", lambda p: F.struct((p["x"] - F.col("offset_x")).alias("x"),
                                                      (-p["y"] - F.col("offset_y")).alias("y")))
    ring = joined.select(*keys, "label", F.col(order).alias("_o"), local.alias("_ring")).withColumn("_box", G.ring_box("_ring"))
    low = F.greatest(F.ceil("_box.y0"), F.lit(0)).cast("int")
    high = F.least(F.floor("_box.y1"), F.lit(height - 1)).cast("int")
    row = ring.withColumn("y", F.explode(F.when(high >= low, F.sequence(low, high)))).withColumn("_e", G._edges(F.col("_ring")))
    y = F.col("y")

    def at(e):
        a, b = e["a"], e["b"]
        return a["x"] + F.try_divide((y - a["y"]) * (b["x"] - a["x"]), b["y"] - a["y"])

    def ends(lo, hi):
        return F.struct(lo.alias("lo"), hi.alias("hi"))

    sloped = F.filter("_e", lambda e: e["a"]["y"] != e["b"]["y"])
    lower = lambda e: F.least(e["a"]["y"], e["b"]["y"])
    upper = lambda e: F.greatest(e["a"]["y"], e["b"]["y"])
    row = row.withColumns({
        "_x": F.array_sort(F.transform(F.filter(sloped, lambda e: (lower(e) <= y) & (y < upper(e))), at)),
        "_on": F.transform(F.filter(sloped, lambda e: y.between(lower(e), upper(e))), lambda e: ends(at(e), at(e))),
        "_flat": F.transform(F.filter("_e", lambda e: (e["a"]["y"] == y) & (e["b"]["y"] == y)), lambda e: ends(
            F.least(e["a"]["x"], e["b"]["x"]), F.greatest(e["a"]["x"], e["b"]["x"])))})
    pairs = F.transform(F.filter(F.sequence(F.lit(0), F.size("_x")), lambda i: (i % 2 == 0) & (i + 1 < F.size("_x"))),
                        lambda i: ends(F.get("_x", i), F.get("_x", i + 1)))
    spans = row.select(*keys, "label", "_o", "y", F.explode(F.concat(pairs, "_on", "_flat")).alias("_s"))
    left = F.greatest(F.ceil(F.col("_s.lo") - 1e-9), F.lit(0)).cast("int")
    right = F.least(F.floor(F.col("_s.hi") + 1e-9), F.lit(width - 1)).cast("int")
    cells = spans.withColumn("x", F.explode(F.when(right >= left, F.sequence(left, right))))
    return cells.groupBy(*keys, "y", "x").agg(F.max(F.struct(F.col("_o"), F.col("label"))).alias("_l")).select(
        *keys, "y", "x", F.col("_l.label").alias("label"))


def simplify_ring(points: np.ndarray, tolerance: float) -> np.ndarray:
    """Douglas-Peucker on a closed ring; at least four points remain."""
    keep = np.zeros(len(points), bool)
    far = int(np.argmax(((points - points[0]) ** 2).sum(1)))
    keep[[0, far, len(points) - 1]] = True
    todo = [(0, far), (far, len(points) - 1)]
    rest = []
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        p, q = points[a], points[b]
        length = np.hypot(*(q - p))
        between = points[a + 1:b]
        gap = (np.hypot(*(between - p).T) if length == 0 else
               np.abs((q[0] - p[0]) * (between[:, 1] - p[1]) - (q[1] - p[1]) * (between[:, 0] - p[0])) / length)
        k = int(np.argmax(gap))
        rest.append((gap[k], a + 1 + k))
        if gap[k] > tolerance:
            keep[a + 1 + k] = True
            todo += [(a, a + 1 + k), (a + 1 + k, b)]
    for _, i in sorted(rest, reverse=True):
        if keep.sum() >= 4:
            break
        keep[i] = True
    return points[keep]


def simplify(segments: DataFrame, tolerance: float, column: str = "polygon") -> DataFrame:
    """Outlines with fewer points, none moved by more than the tolerance."""
    def run(batches):
        for pdf in batches:
            pdf[column] = [[{"x": float(p[0]), "y": float(p[1])} for p in simplify_ring(
                np.array([[q["x"], q["y"]] for q in ring]), tolerance)] for ring in pdf[column]]
            yield pdf
    return segments.mapInPandas(run, segments.schema)


def zoom_tolerance(maxzoom: int, z: int) -> int:
    return (maxzoom - z) ** 2 + 1


# --- objects on tiles ----------------------------------------------------------------------

def map_outlines(segmentations: DataFrame, offsets: DataFrame) -> DataFrame:
    """Rectangles of segmented objects on the map with their box and centre."""
    joined = segmentations.join(offsets.select(F.col("site_id").alias("partition_key"), "offset_y", "offset_x"), "partition_key")
    left, right = F.col("offset_x") + F.col("x0"), F.col("offset_x") + F.col("x1")
    upper, lower = -(F.col("offset_y") + F.col("y0")), -(F.col("offset_y") + F.col("y1"))
    return joined.select("partition_key", "mapobject_id", "segmentation_layer_id", "label",
                         left.alias("box_x0"), lower.alias("box_y0"), right.alias("box_x1"), upper.alias("box_y1"),
                         G.rectangle(left, lower, right, upper).alias("polygon"))


def objects_in_tile(outlines: DataFrame, z: int, y: int, x: int, maxzoom: int) -> DataFrame:
    """Objects that touch one tile. The box filter comes first and can be pushed to
    the scan; the exact test sees only its survivors."""
    size = TILE * 2 ** (maxzoom - z)
    x0, x1, y1, y0 = x * size, (x + 1) * size, -y * size, -(y + 1) * size
    near = outlines.filter((F.col("box_x0") <= x1) & (F.col("box_x1") >= x0) & (F.col("box_y0") <= y1) & (F.col("box_y1") >= y0))
    return near.filter(G.ring_intersects_box("polygon", *[F.lit(v) for v in (x0, y0, x1, y1)]))


def objects_on_tiles(outlines: DataFrame, z: int, maxzoom: int) -> DataFrame:
    """All pairs of objects and tiles of one level that touch: each object names
    the tiles its box reaches, then the exact test decides."""
    size = TILE * 2 ** (maxzoom - z)
    rows = outlines.withColumn("tile_y", F.explode(F.expr(f"sequence(greatest(CAST(ceil(-box_y1 / {size}) AS BIGINT) - 1, 0), CAST(floor(-box_y0 / {size}) AS BIGINT))")))
    cells = rows.withColumn("tile_x", F.explode(F.expr(f"sequence(greatest(CAST(ceil(box_x0 / {size}) AS BIGINT) - 1, 0), CAST(floor(box_x1 / {size}) AS BIGINT))")))
    x0, y1 = F.col("tile_x") * size, -F.col("tile_y") * size
    return cells.filter(G.ring_intersects_box("polygon", x0, y1 - size, x0 + size, y1))


def vector_tiles(outlines: DataFrame, z: int, maxzoom: int, polygon_thresh: int, centroid_thresh: int,
                 exact: bool = False) -> DataFrame:
    """GeoJSON of the objects of each tile of a level: nothing below the lower
    threshold, centres below the upper one, otherwise (simplified) outlines."""
    if z < centroid_thresh:
        return objects_on_tiles(outlines.limit(0), z, maxzoom).select(
            "tile_y", "tile_x", "mapobject_id", F.lit("").alias("geometry"))
    if z < polygon_thresh:
        size = TILE * 2 ** (maxzoom - z)
        centre = outlines.withColumn("_c", G.ring_centroid("polygon"))
        # A centre on the line between two tiles belongs to both.
        names = lambda v: F.expr(f"sequence(greatest(CAST(ceil({v} / {size}) AS BIGINT) - 1, 0), CAST(floor({v} / {size}) AS BIGINT))")
        both = centre.withColumns({"_py": -F.col("_c.y"), "_px": F.col("_c.x")}).withColumn("tile_y", F.explode(names("_py")))
        return both.withColumn("tile_x", F.explode(names("_px"))).select(
            "tile_y", "tile_x", "mapobject_id", G.point_geojson("_c.x", "_c.y").alias("geometry"))
    hits = objects_on_tiles(outlines, z, maxzoom)
    if not exact:
        hits = simplify(hits, zoom_tolerance(maxzoom, z))
    return hits.select("tile_y", "tile_x", "mapobject_id", G.ring_geojson("polygon").alias("geometry"))


def feature_collections(tiles: DataFrame, chunk: int = 100_000) -> DataFrame:
    """One GeoJSON document per tile and id range with the geometries as features."""
    feature = F.concat(F.lit('{"type":"Feature","geometry":'), F.col("geometry"), F.lit(',"properties":{"id":'),
                       F.col("mapobject_id").cast("string"), F.lit("}}"))
    return (tiles.withColumn("part", F.expr(f"mapobject_id DIV {chunk}")).groupBy("tile_y", "tile_x", "part")
            .agg(F.array_sort(F.collect_list(F.struct("mapobject_id", feature.alias("f")))).alias("_f"))
            .select("tile_y", "tile_x", "part", F.concat(
                F.lit('{"type":"FeatureCollection","features":['),
                F.array_join(F.transform("_f", lambda e: e["f"]), ","), F.lit("]}")).alias("document")))


def label_tiles(objects: DataFrame, labels: DataFrame, result_id: int) -> DataFrame:
    """Objects of tiles with the label a result gave them."""
    named = labels.select("partition_key", "mapobject_id", F.col("values")[str(result_id)].alias("object_label"))
    return objects.join(named, ["partition_key", "mapobject_id"], "left")


def border_objects(outlines: DataFrame, sites: DataFrame) -> DataFrame:
    """Whether the outline of each object meets the outline of its site."""
    placed = sites.select(F.col("site_id").alias("partition_key"), F.col("polygon").alias("_site"))
    joined = outlines.join(placed, "partition_key")
    meets = F.exists(G._edges(F.col("_site")), lambda e: F.exists(
        G._edges(F.col("polygon")), lambda f: G.segments_intersect(e["a"], e["b"], f["a"], f["b"])))
    return joined.withColumn("is_border", meets).drop("_site")


def points_in_polygons(points: DataFrame, polygons: DataFrame, cell: int = 64) -> DataFrame:
    """Points with the polygons they lie in. Polygons name the grid cells of their
    box, points their own; crowded cells are spread over several tasks."""
    named = polygons.withColumn("_b", G.ring_box("polygon"))
    for axis in "yx":
        named = named.withColumn(f"_c{axis}", F.explode(F.expr(
            f"sequence(CAST(floor(_b.{axis}0 / {cell}) AS BIGINT), CAST(floor(_b.{axis}1 / {cell}) AS BIGINT))")))
    located = points.withColumns({f"_c{a}": F.floor(F.col(a) / cell) for a in "yx"})
    met = salted_join(located, named.drop("_b"), ["_cy", "_cx"])
    return met.filter(G.point_in_ring("polygon", "x", "y")).drop("_cy", "_cx", "polygon")


def aggregate_within(points: DataFrame, polygons: DataFrame, value: str) -> DataFrame:
    """Count and mean of a value over the points inside each polygon."""
    inside = points_in_polygons(points, polygons).groupBy("parent_id").agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))
    return polygons.select("parent_id").join(inside, "parent_id", "left").select(
        "parent_id", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("mean", F.lit(float("nan"))).alias("mean"))

