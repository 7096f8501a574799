"""Segmentation: growing, splitting and spot detection.

Flooding is sequential inside an image, so it runs in numpy with one group per
image plane, whose size the camera bounds. All steps around it are joins,
windows and aggregations.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteframe.core import cut_lineage, discard, image_keys, range_index
from siteframe.operators import labels as LB
from siteframe.operators import pixels as P
from siteframe.operators import stencil as ST
from siteframe.operators import tree as TR
from siteframe.operators.distance import nearest_marked
from siteframe.operators.measure import convex_hulls, hull_points, measure_morphology

CROSS = ((-1, 0), (0, -1), (0, 1), (1, 0))
SQUARE = CROSS + ((-1, -1), (-1, 1), (1, -1), (1, 1))


def flood(cost: np.ndarray, seeds: np.ndarray, steps=CROSS) -> np.ndarray:
    """Spread seed labels over all pixels, cheapest pixels first."""
    out = seeds.copy()
    queue = [(cost[y, x], i, y, x) for i, (y, x) in enumerate(zip(*np.nonzero(seeds)))]
    heapq.heapify(queue)
    count = len(queue)
    while queue:
        _, _, y, x = heapq.heappop(queue)
        for dy, dx in steps:
            a, b = y + dy, x + dx
            if 0 <= a < out.shape[0] and 0 <= b < out.shape[1] and out[a, b] == 0:
                out[a, b] = out[y, x]
                heapq.heappush(queue, (cost[a, b], count, a, b))
                count += 1
    return out


def grow_regions(seeds: DataFrame, background: DataFrame, px: DataFrame) -> DataFrame:
    """Grow seeds over bright pixels against background seeds; every pixel of the
    image gets a label, background zero."""
    keys = image_keys(px)
    joined = (px.join(seeds.select(*keys, "y", "x", "label"), [*keys, "y", "x"], "left")
              .join(background.select(*keys, "y", "x", F.col("mask").alias("bg")), [*keys, "y", "x"], "left")
              .select(*keys, "y", "x", "value", F.when(F.coalesce("bg", F.lit(False)), -1).otherwise(
                  F.coalesce("label", F.lit(0))).alias("seed")))
    types = {f.name: f.dataType.simpleString() for f in px.schema.fields}
    schema = ", ".join([f"{k} {types[k]}" for k in keys] + ["y int", "x int", "label int"])

    def grow(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        y, x = pdf["y"].to_numpy(), pdf["x"].to_numpy()
        shape = (y.max() + 1, x.max() + 1)
        cost, seed = np.zeros(shape), np.zeros(shape, np.int64)
        cost[y, x], seed[y, x] = -pdf["value"].to_numpy(float), pdf["seed"]
        out = pd.DataFrame({"y": y, "x": x, "label": np.maximum(flood(cost, seed), 0)[y, x].astype(np.int32)})
        for name, value in zip(keys, key):
            out[name] = value
        return out[[*keys, "y", "x", "label"]]

    return joined.groupBy(*keys).applyInPandas(grow, schema)


def segment_secondary(seeds: DataFrame, px: DataFrame, contrast: float, lower: float | None = None,
                      upper: float | None = None, radius: int = 5) -> DataFrame:
    """Cells around nuclei: seeds grow until they meet each other or background.

    Region borders are cut, holes closed, regions not larger than the smallest
    seed dropped, and the rest named after the seed they mostly cover. Seeds stay.
    """
    keys = image_keys(px)
    pixel = [*keys, "y", "x"]
    mask = P.threshold_bernsen(px, radius, contrast)
    flag = F.col("mask")
    if lower is not None:
        flag = F.when(F.col("value") < lower, True).otherwise(flag)
    if upper is not None:
        flag = F.when(F.col("value") > upper, False).otherwise(flag)
    regions = cut_lineage(grow_regions(seeds, mask.withColumn("mask", flag), px))
    cut = LB.object_perimeter(regions, 4, edge=False).select(*pixel).withColumn("_cut", F.lit(True))
    regions = regions.join(cut, pixel, "left").withColumn(
        "label", F.when(F.col("_cut"), 0).otherwise(F.col("label"))).drop("_cut")
    # Holes, grown by one pixel, take the largest label they touch.
    solid = cut_lineage(regions).withColumn("mask", F.col("label") > 0)
    filled = LB.fill_holes(solid.select(*pixel, "mask")).withColumnRenamed("mask", "_full")
    holes = ST.dilate(filled.join(solid, pixel).select(*pixel, (F.col("_full") & ~F.col("mask")).alias("mask")), 1, cross=True)
    parts = LB.connected_components(holes, 4).withColumnRenamed("label", "_hole")
    value = parts.join(solid, pixel).groupBy(*keys, "_hole").agg(F.max("label").alias("_fill"))
    paint = parts.join(value, [*keys, "_hole"]).select(*pixel, "_fill")
    regions = (solid.join(paint, pixel, "left").select(*pixel, F.coalesce("_fill", "label").alias("label")).filter("label > 0"))
    smallest = (seeds.groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("_n")).groupBy(*keys).agg(F.min("_n").alias("_min")))
    sized = (regions.groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("_n")).join(smallest, keys).filter("_n > _min"))
    overlap = (regions.join(sized.select(*keys, "label"), [*keys, "label"], "left_semi")
               .join(seeds.withColumnRenamed("label", "_seed"), pixel)
               .groupBy(*keys, "label", "_seed").agg(F.count(F.lit(1)).alias("_n"))
               .groupBy(*keys, "label").agg(F.min_by("_seed", F.struct(-F.col("_n"), F.col("_seed"))).alias("_seed")))
    named = regions.join(overlap, [*keys, "label"]).select(*pixel, F.col("_seed").alias("label"))
    return (named.unionByName(seeds.select(*pixel, "label")).groupBy(*pixel).agg(F.max("label").alias("label")))


# --- clumps ---------------------------------------------------------------------------

def _components(mask: np.ndarray, steps=CROSS) -> np.ndarray:
    out, n = np.zeros(mask.shape, np.int64), 0
    for start in zip(*np.nonzero(mask)):
        if out[start]:
            continue
        n += 1
        out[start], stack = n, [start]
        while stack:
            y, x = stack.pop()
            for dy, dx in steps:
                a, b = y + dy, x + dx
                if 0 <= a < mask.shape[0] and 0 <= b < mask.shape[1] and mask[a, b] and not out[a, b]:
                    out[a, b] = n
                    stack.append((a, b))
    return out


def _shifted(mask: np.ndarray, dy: int, dx: int) -> np.ndarray:
    return np.roll(mask, (dy, dx), (0, 1))


def _erode(mask, steps=CROSS):
    return np.logical_and.reduce([mask] + [_shifted(mask, dy, dx) for dy, dx in steps])


def _dilate(mask, steps=CROSS):
    return np.logical_or.reduce([mask] + [_shifted(mask, dy, dx) for dy, dx in steps])


def _depths(px: DataFrame) -> DataFrame:
    """Squared distance of each pixel of an object to the nearest place outside; objects are told apart by `level`.

    Objects do not touch, so that the nearest place outside one is outside all of them, and one line around each object is enough.
    """
    image = [k for k in image_keys(px) if k != "level"]
    box = px.groupBy(*image_keys(px)).agg(F.min("y").alias("_y0"), F.max("y").alias("_y1"), F.min("x").alias("_x0"), F.max("x").alias("_x1"))
    places = (box.withColumn("y", F.explode(F.sequence(F.col("_y0") - 1, F.col("_y1") + 1)))
              .withColumn("x", F.explode(F.sequence(F.col("_x0") - 1, F.col("_x1") + 1))).select(*image, "y", "x").distinct())
    marked = places.join(px, [*image, "y", "x"], "left").withColumns({"_out": F.col("level").isNull(), "_p": F.lit(0)})
    far = nearest_marked(marked.drop("level"), "_out", "_p").select(*image, "y", "x", F.col("distance2").cast("long").alias("height"))
    return px.join(far, [*image, "y", "x"]).select(*image_keys(px), "y", "x", "height")


SIDES = 1 << 24  # twice as many as an object has splits


def _splits(px: DataFrame, min_core: int) -> tuple[DataFrame, DataFrame]:
    """All splits that the depths of objects offer, down to single cores.

    Returns the pixels (level, y, x, nodes, sides, upto) with the splits above each pixel and the number of them that it lives
    through, and the pixels on the line of a split (level, y, x, node). The line is what of the second side touches the first one.
    """
    keys = image_keys(px)
    deep = cut_lineage(_depths(px).withColumns({"weight": F.lit(1), "least": F.lit(min_core)}))
    pairs = cut_lineage(TR.neighbouring(deep, keys, 8))
    whole, saddles = TR.cores(deep, keys, pairs, min_core)
    order = cut_lineage(TR.split_order(saddles, keys))
    placed = cut_lineage(whole.join(order, [*keys, "core"]))
    end = lambda name: placed.select(*keys, TR.pixel_id().alias(name), F.col("core").alias(f"c{name}"), F.col("nodes").alias(f"n{name}"), F.col("sides").alias(f"s{name}"))
    across = pairs.select(*keys, "a", "b").join(end("a"), [*keys, "a"]).join(end("b"), [*keys, "b"]).filter("ca <> cb")
    first = F.array_position(F.zip_with("sa", "sb", lambda s, t: F.coalesce(s != t, F.lit(True))), F.lit(True)).cast("int")
    line = across.withColumn("_i", first - 1).select(
        *keys, F.when(F.get("sa", F.col("_i")) == 1, F.col("a")).otherwise(F.col("b")).alias("id"), F.get("na", F.col("_i")).alias("node"), "_i").distinct()
    line = cut_lineage(line)
    lives = line.groupBy(*keys, "id").agg(F.min("_i").alias("upto"))
    pixels = placed.withColumn("id", TR.pixel_id()).join(lives, [*keys, "id"], "left")
    pixels = pixels.select(*keys, "y", "x", "nodes", "sides", F.coalesce("upto", F.size("nodes")).alias("upto"))
    return cut_lineage(pixels), line.select(*keys, F.expr(f"CAST(id DIV {TR.STRIDE} AS INT)").alias("y"), (F.col("id") % TR.STRIDE).cast("int").alias("x"), "node")


def _cuts(px: DataFrame, min_cut_area: int, min_area: float, max_area: float, max_circularity: float, max_convexity: float,
          trim: bool, trim_size: int = 10, min_core: int = 3) -> tuple[DataFrame, DataFrame]:
    """Pixels to take out of clumps, and the clumps of which pieces remain that no split looked at.

    The sides of all splits of all clumps are judged together: each is an image of its own, whose largest component is measured.
    A split is made if what it splits is a clump, if its parts are large enough and if all splits above it are made.
    """
    keys = image_keys(px)
    clump = [k for k in keys if k != "level"]
    pixels, line = _splits(px, min_core)
    at = pixels.select(*keys, "y", "x", F.posexplode(F.slice("nodes", 1, F.col("upto"))).alias("_i", "node"), "sides", "nodes")
    side = (F.col("level").cast("long") * SIDES + F.col("node") * 2 + F.get("sides", F.col("_i")))
    single = at.select(*clump, side.alias("level"), "y", "x", F.lit(True).alias("mask"))
    parts = cut_lineage(LB.connected_components(single, 8))
    sizes = cut_lineage(parts.groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("n")))
    crumbs = sizes.filter(F.lit(trim) & (F.col("n") < trim_size)).select(*keys, "label")
    left = sizes.join(crumbs, [*keys, "label"], "left_anti").withColumns(
        {"_clump": F.expr(f"level DIV {SIDES}"), "node": F.expr(f"CAST(level % {SIDES} DIV 2 AS INT)")})
    good = left.groupBy(*clump, "_clump", "node").agg(F.min("n").alias("least"), F.count(F.lit(1)).alias("parts")).filter(
        (F.col("least") > min_cut_area) & (F.col("parts") > 1))
    main = left.groupBy(*keys).agg(F.min_by("label", F.struct(-F.col("n"), F.col("label"))).alias("label"), F.max("n").alias("n"))
    # The side of a split is what the next split below it splits.
    nested = pixels.select(*keys, F.explode(F.zip_with(
        F.arrays_zip("nodes", "sides"), F.concat(F.slice("nodes", 2, F.greatest(F.size("nodes") - 1, F.lit(0))), F.array(F.lit(None).cast("int"))),
        lambda o, below: F.struct(o["nodes"].alias("node"), o["sides"].alias("side"), below.alias("below")))).alias("_s"), "nodes").filter("_s.below is not null")
    nested = nested.select(*clump, F.col("level").alias("_clump"), F.col("_s.below").alias("node"), (F.col("level").cast("long") * SIDES + F.col("_s.node") * 2 + F.col("_s.side")).alias("level"),
                           F.slice("nodes", F.lit(1), F.array_position("nodes", F.col("_s.below")).cast("int")).alias("path")).distinct()
    # Only what may be a clump and splits well is measured.
    worth = nested.join(good.select(*clump, "_clump", "node"), [*clump, "_clump", "node"], "left_semi").select(*keys)
    measured = main.filter((F.col("n") > min_area) & (F.col("n") <= max_area)).join(worth, keys, "left_semi")
    inner = cut_lineage(parts.join(measured, [*keys, "label"], "left_semi"))
    shape = measure_morphology(inner).join(convex_hulls(inner), [*keys, "label"]).withColumn("convexity", F.col("area") / F.col("hull_area"))
    clumps = LB.select_clumps(shape, min_area, max_area, max_circularity, max_convexity).select(*keys)
    roots = pixels.select(*clump, F.col("level").alias("_clump"), F.get("nodes", F.lit(0)).alias("node"), F.slice("nodes", 1, 1).alias("path")).distinct()
    able = roots.unionByName(nested.join(clumps, keys, "left_semi").select(*clump, "_clump", "node", "path")).join(
        good.select(*clump, "_clump", "node", "parts"), [*clump, "_clump", "node"])
    able = cut_lineage(able)
    above = able.select(*clump, "_clump", "node", "parts", F.size("path").alias("_d"), F.explode("path").alias("_a")).join(
        able.select(*clump, "_clump", F.col("node").alias("_a")), [*clump, "_clump", "_a"])
    made = above.groupBy(*clump, "_clump", "node", "parts", "_d").agg(F.count(F.lit(1)).alias("_n")).filter("_n = _d")
    made = cut_lineage(made.select(*clump, F.col("_clump").alias("level"), "node", "parts"))
    lost = parts.join(crumbs, [*keys, "label"], "left_semi").select(
        *clump, F.expr(f"CAST(level DIV {SIDES} AS INT)").alias("level"), F.expr(f"CAST(level % {SIDES} DIV 2 AS INT)").alias("node"), "y", "x")
    gone = line.unionByName(lost.select(*line.columns)).join(made, [*keys, "node"], "left_semi").select(*keys, "y", "x").distinct()
    return gone, made.filter("parts > 2").select(*keys).distinct()


def separate_clumps(mask: DataFrame, min_cut_area: int, min_area: float, max_area: float, max_circularity: float,
                    max_convexity: float, trim: bool = True) -> DataFrame:
    """Cut objects that look like several objects in one.

    Objects are measured, the clumps are picked, and the tree of the parts of each clump by distance from its border tells in
    which order it splits. All splits of all clumps are judged at once. A clump that fell into more pieces than
    two at a split is looked at again; a cut takes pixels away, so that this ends.
    """
    keys = image_keys(mask)
    if "level" in keys:
        raise ValueError("images of several levels cannot be separated at once")
    pixel = [*keys, "y", "x"]
    solid = cut_lineage(mask.filter("mask").select(*pixel))
    open_px = solid
    while True:
        labels = cut_lineage(LB.connected_components(open_px.withColumn("mask", F.lit(True)), 8))
        shape = measure_morphology(labels).join(convex_hulls(labels), [*keys, "label"]).withColumn(
            "convexity", F.col("area") / F.col("hull_area"))
        clumps = LB.select_clumps(shape, min_area, max_area, max_circularity, max_convexity).select(*keys, "label")
        clump_px = cut_lineage(labels.join(clumps, [*keys, "label"], "left_semi").select(*keys, F.col("label").alias("level"), "y", "x"))
        if clump_px.isEmpty():
            break
        gone, again = _cuts(clump_px, min_cut_area, min_area, max_area, max_circularity, max_convexity, trim)
        gone = cut_lineage(gone)
        solid = cut_lineage(solid.join(gone, pixel, "left_anti"))
        open_px = cut_lineage(clump_px.join(again, [*keys, "level"], "left_semi").join(gone, pixel, "left_anti").select(*pixel))
        if open_px.isEmpty():
            break
    return LB.connected_components(solid.withColumn("mask", F.lit(True)), 8)


def trace_contour(mask: np.ndarray) -> np.ndarray:
    """Outer contour of the first object of a padded mask as (y, x) points in order."""
    ring = [(0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1)]
    ys, xs = np.nonzero(mask)
    start = (int(ys[0]), int(xs[0]))
    out, here, turn = [start], start, 5
    first = None
    while True:
        for k in range(8):
            d = (turn + 1 + k) % 8
            nxt = (here[0] + ring[d][0], here[1] + ring[d][1])
            if 0 <= nxt[0] < mask.shape[0] and 0 <= nxt[1] < mask.shape[1] and mask[nxt]:
                break
        else:
            return np.array(out)
        if here == start:
            if first is None:
                first = d
            elif d == first:
                return np.array(out[:-1])
        out.append(nxt)
        here, turn = nxt, (d + 4) % 8


def concave_points(labels: DataFrame, max_dist: float) -> DataFrame:
    """Contour points of each object that lie deeper than `max_dist` inside its
    convex hull, the deepest one per hull edge."""
    keys = image_keys(labels)
    types = {f.name: f.dataType.simpleString() for f in labels.schema.fields}
    schema = ", ".join([f"{k} {types[k]}" for k in keys] + [f"label {types['label']}", "y int", "x int", "depth double"])

    def defects(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for label, part in pdf.groupby("label", sort=False):
            y, x = part["y"].to_numpy(), part["x"].to_numpy()
            obj = np.zeros((np.ptp(y) + 3, np.ptp(x) + 3), bool)
            obj[y - y.min() + 1, x - x.min() + 1] = True
            contour = trace_contour(obj)
            if len(contour) < 4:
                continue
            corners = {tuple(map(int, p)) for p in hull_points(contour.astype(float))}
            at = [i for i, p in enumerate(map(tuple, contour)) if p in corners]
            for i, j in zip(at, at[1:] + [at[0] + len(contour)]):
                a, b = contour[i], contour[j % len(contour)]
                between = contour[np.arange(i + 1, j) % len(contour)]
                length = np.hypot(*(b - a))
                if len(between) == 0 or length == 0:
                    continue
                depth = np.abs((b[0] - a[0]) * (between[:, 1] - a[1]) - (b[1] - a[1]) * (between[:, 0] - a[0])) / length
                k = int(np.argmax(depth))
                if depth[k] > max_dist:
                    rows.append([*key[:-1], label, between[k][0] + y.min() - 1, between[k][1] + x.min() - 1, depth[k]])
        return pd.DataFrame(rows, columns=[*keys, "label", "y", "x", "depth"])

    return labels.groupBy(*keys, F.expr("label DIV 64")).applyInPandas(defects, schema)


# --- spots ------------------------------------------------------------------------------

def enhance_spots(px: DataFrame, mean_area: int, clip_percentile: float = 99.999) -> DataFrame:
    """Clipped and LoG-filtered image, negative responses at zero."""
    top = P.image_range(px, None, clip_percentile)
    clipped = px.join(top, image_keys(px)).withColumn("value", F.least(F.col("value").cast("double"), F.col("_high"))).drop("_low", "_high")
    kernel = [[-v for v in line] for line in ST.log_kernel(mean_area, (mean_area - 1) / 3)]
    out = ST.convolve(clipped, kernel)
    return out.select(*image_keys(px), "y", "x", F.greatest("filtered", F.lit(0.0)).alias("value"))


def detect_blobs(px: DataFrame, region: DataFrame, threshold: float = 1, min_area: int = 3, mean_area: int = 5,
                 max_area: int = 1000, clip_percentile: float = 99.999, deblend_levels: int = 500,
                 deblend_contrast: float | None = None) -> DataFrame:
    """Bright spots inside a region: components of the filtered image above the
    threshold, not larger than `max_area`, numbered in reading order.

    With `deblend_contrast`, touching spots are told apart: a branch of the brightness that has `min_area` pixels and this share
    of the flux of its blob above its highest saddle is a spot of its own. Brightness is looked at in `deblend_levels` steps of
    equal ratio between the threshold and the peak of the blob.
    """
    keys = image_keys(px)
    pixel = [*keys, "y", "x"]
    found = cut_lineage(enhance_spots(px, mean_area, clip_percentile).withColumn("mask", F.col("value") > threshold))
    first = LB.connected_components(found, 4)
    small = (first.groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("_n"))
             .filter(F.col("_n") < max_area).select(*keys, "label"))
    kept = first.join(small, [*keys, "label"], "left_semi").select(*pixel)
    kept = cut_lineage(kept.join(region.filter("mask").select(*pixel), pixel, "left_semi"))
    blobs = LB.remove_small(LB.connected_components(kept.withColumn("mask", F.lit(True)), 8), min_area)
    bright = found.filter("mask").select(*pixel, "value")
    if deblend_contrast is None:
        return LB.relabel(blobs).join(bright, pixel)
    bright = cut_lineage(blobs.join(bright, pixel))
    return split_blobs(bright, threshold, deblend_levels, deblend_contrast, min_area)


def split_blobs(blobs: DataFrame, threshold: float, levels: int, contrast: float, min_area: int = 1) -> DataFrame:
    """Blobs cut into the branches of their brightness that count; pixels stay with the peak that they rise to.

    A branch counts if its pixels above its highest saddle number `min_area` and hold the share `contrast` of the blob's
    flux. Spots are numbered in reading order of their first pixel.
    """
    keys = image_keys(blobs)
    pixel, own = [*keys, "y", "x"], [*keys, "label"]
    total = blobs.groupBy(*own).agg(F.max("value").alias("_peak"), F.sum("value").alias("_flux"))
    steps = F.floor(F.lit(float(levels)) * F.ln(F.col("value") / float(threshold)) / F.ln(F.greatest(F.col("_peak") / float(threshold), F.lit(1 + 1e-9))))
    heights = cut_lineage(blobs.join(total, own).select(
        *own, "y", "x", "value", steps.cast("long").alias("height"), F.col("value").alias("weight"), (F.col("_flux") * float(contrast)).alias("least")))
    spots, _ = TR.cores(heights, own, cut_lineage(TR.neighbouring(heights, own, 8)), min_area)
    spots = cut_lineage(spots)
    firsts = spots.groupBy(*own, "core").agg(F.min(TR.pixel_id()).alias("_first"))
    named = spots.join(firsts, [*own, "core"]).select(*pixel, F.col("_first").alias("label"))
    return LB.relabel(named).join(heights.select(*pixel, "value"), pixel)


def flux_centroids(blobs: DataFrame) -> DataFrame:
    """Intensity-weighted centre of each blob, cut to whole pixels.

    A hair is added because the sums may come out just below a whole number, in one order of the pixels and not in another."""
    keys = [*image_keys(blobs), "label"]
    v, hair = F.col("value"), F.lit(1e-9)
    return blobs.groupBy(*keys).agg(F.floor(F.sum(v * F.col("y")) / F.sum(v) + hair).cast("int").alias("y"),
                                    F.floor(F.sum(v * F.col("x")) / F.sum(v) + hair).cast("int").alias("x"), F.sum(v).alias("flux"))


def deblend(blobs: DataFrame, threshold: float, n_levels: int = 8, contrast: float = 0.2) -> DataFrame:
    """Split blobs that fall into several parts at higher thresholds.

    All levels are labelled in one pass as extra images. A part counts when it
    holds a share of the blob's flux and has a sibling that does too; the topmost
    such parts become objects and the other pixels go to the nearest of them. Tables that
    several later steps read are written once; without that each reader plans and runs all steps before it.
    """
    keys = image_keys(blobs)
    pixel = [*keys, "y", "x"]
    total = blobs.groupBy(*keys, "label").agg(F.max("value").alias("_peak"), F.sum("value").alias("_flux"))
    base = cut_lineage(blobs.join(total, [*keys, "label"]).withColumnRenamed("label", "blob"))
    ratio = F.greatest(F.col("_peak") / F.lit(float(threshold)), F.lit(1.0))
    levels = base.withColumn("level", F.explode(F.sequence(F.lit(1), F.lit(n_levels - 1)))).filter(
        F.col("value") > F.lit(float(threshold)) * F.pow(ratio, F.col("level") / n_levels))
    parts = cut_lineage(LB.connected_components(levels.select(*pixel, "level", F.lit(True).alias("mask")), 8)
                        .join(base.select(*pixel, "blob", "value", "_flux"), pixel))
    lower = parts.select(*pixel, (F.col("level") + 1).alias("level"), F.col("label").alias("parent"))
    comp = cut_lineage(parts.join(lower, [*pixel, "level"], "left").groupBy(*keys, "level", "label", "blob", "_flux")
                       .agg(F.sum("value").alias("flux"), F.max(F.coalesce("parent", F.lit(0))).alias("parent"))
                       .filter(F.col("flux") >= contrast * F.col("_flux")))
    split = comp.groupBy(*keys, "level", "blob", "parent").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    branch = comp.join(split, [*keys, "level", "blob", "parent"], "left_semi").select(*keys, "level", "label")
    inside = cut_lineage(parts.join(branch, [*keys, "level", "label"], "left_semi"), parts)
    discard(comp)
    top = inside.groupBy(*pixel).agg(F.max("level").alias("_top"))
    leaf = (inside.join(top, pixel).groupBy(*keys, "level", "label").agg(F.max("_top").alias("_top"))
            .filter("_top = level").drop("_top"))
    numbers = range_index(leaf, [*keys, "level", "label"], "part")
    cores = cut_lineage(inside.join(numbers, [*keys, "level", "label"]).select(*pixel, "blob", "part"), inside)
    whole = base.select(*pixel, "blob", "value")
    # Distances need every place of the box around a blob, also those that are not part of it.
    split_blobs = cores.select(*keys, "blob").distinct()
    boxes = (whole.join(split_blobs, [*keys, "blob"], "left_semi").groupBy(*keys, "blob")
             .agg(F.min("y").alias("_y0"), F.max("y").alias("_y1"), F.min("x").alias("_x0"), F.max("x").alias("_x1"))
             .withColumn("y", F.explode(F.sequence("_y0", "_y1"))).withColumn("x", F.explode(F.sequence("_x0", "_x1"))))
    marked = boxes.select(*pixel, F.col("blob").cast("int").alias("blob")).join(
        cores.withColumn("blob", F.col("blob").cast("int")), [*pixel, "blob"], "left").withColumn("_m", F.col("part").isNotNull())
    nearest = nearest_marked(marked, "_m", "part", ("blob",)).select(*pixel, "blob", F.col("nearest").cast("long").alias("part"))
    named = cut_lineage(whole.select(*pixel, F.col("blob").cast("int").alias("blob")).join(nearest, [*pixel, "blob"], "left"), cores)
    # Blobs come in order, their parts by level and label.
    objects = named.select(*keys, "blob", "part").distinct()
    ranked = range_index(objects, [*keys, F.col("blob"), F.coalesce("part", F.lit(-1))], "_rank")
    same = [named[k] == ranked[k] for k in (*keys, "blob")] + [named["part"].eqNullSafe(ranked["part"])]
    condition = same[0]
    for c in same[1:]:
        condition = condition & c
    joined = cut_lineage(named.join(ranked, condition).select(*[named[c] for c in pixel], (F.col("_rank") + 1).alias("label")), named)
    return LB.relabel(joined).join(whole.select(*pixel, "value"), pixel)


def log_kernel_3d(size: int, sigma: float) -> list[list[list[float]]]:
    """Laplacian-of-Gaussian volume that sums to zero."""
    r = np.array(list(ST.kernel_offsets(size)))
    z, y, x = np.meshgrid(r, r, r, indexing="ij")
    d2 = z * z + y * y + x * x
    g = np.exp(-d2 / (2 * sigma ** 2))
    k = g / g.sum() * (d2 - 3 * sigma ** 2) / sigma ** 4
    return (k - k.mean()).tolist()


def detect_blobs_3d(stack: DataFrame, threshold: float, size: int = 3, sigma: float = 1.0) -> DataFrame:
    """Bright spots of image stacks: each plane is filtered with the slices of a
    volume kernel, slices are added up across planes, and voxels above the
    threshold are joined over 26 neighbours. One row per spot with its centre."""
    keys = [k for k in image_keys(stack) if k != "zplane"]
    kernel = log_kernel_3d(size, sigma)
    half = size // 2
    hood = ST.neighbourhood(stack, half, F.col("value").cast("double"), "reflect")
    slices = []
    for dz in range(-half, half + 1):
        total = F.lit(0.0)
        for i, dy in enumerate(range(-half, half + 1)):
            for j, dx in enumerate(range(-half, half + 1)):
                total = total - ST.cell("hood", half, dy, dx) * F.lit(kernel[dz + half][i][j])
        slices.append(F.struct((F.col("zplane") - dz).alias("z"), total.alias("v")))
    planes = stack.select(*keys, "zplane").distinct()
    filtered = (hood.select(*keys, "y", "x", F.explode(F.array(*slices)).alias("_s"))
                .groupBy(*keys, "y", "x", F.col("_s.z").alias("zplane")).agg(F.sum("_s.v").alias("value"))
                .join(planes, [*keys, "zplane"], "left_semi"))
    voxels = cut_lineage(filtered.filter(F.col("value") > threshold))
    number = (F.col("zplane").cast("long") * LB.STRIDE + F.col("y")) * LB.STRIDE + F.col("x")
    nodes = voxels.withColumn("run", number)
    # Half of the 26 neighbours is enough: every pair is met once.
    ahead = [(dz, dy, dx) for dz in (0, 1) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (dz, dy, dx) > (0, 0, 0)]
    offers = F.array(*[F.struct(F.lit(a).alias("z"), F.lit(b).alias("y"), F.lit(c).alias("x")) for a, b, c in ahead])
    offered = nodes.withColumn("_o", F.explode(offers)).select(
        *keys, (F.col("zplane") + F.col("_o.z")).alias("zplane"), (F.col("y") + F.col("_o.y")).alias("y"),
        (F.col("x") + F.col("_o.x")).alias("x"), F.col("run").alias("b"))
    edges = nodes.select(*keys, "zplane", "y", "x", F.col("run").alias("a")).join(offered, [*keys, "zplane", "y", "x"])
    roots = LB.propagate_labels(nodes.select(*keys, "run"), edges, keys)
    v = F.col("value")
    return (nodes.join(roots.withColumnRenamed("node", "run"), [*keys, "run"]).groupBy(*keys, F.col("label").alias("spot"))
            .agg(F.count(F.lit(1)).alias("n_voxels"), *[(F.sum(v * F.col(c)) / F.sum(v)).alias(c) for c in ("zplane", "y", "x")]))


def generate_volume(stack: DataFrame, cells: DataFrame, threshold: float, mean_area: int = 5,
                    min_area: int = 3, max_area: int = 200) -> DataFrame:
    """Height of the cell layer above the substrate at each pixel.

    Beads are spots of the maximum projection, their height is the brightest plane
    at their centre. A plane through the beads outside cells is the substrate; the
    heights above it are spread to the nearest pixels and kept inside cells.
    """
    keys = [k for k in image_keys(stack) if k != "zplane"]
    pixel = [*keys, "y", "x"]
    flat = cut_lineage(P.project(stack, "max"))
    everywhere = flat.select(*pixel, F.lit(True).alias("mask"))
    beads = flux_centroids(detect_blobs(flat, everywhere, threshold, min_area, mean_area, max_area))
    located = cut_lineage(beads.join(P.height_map(stack), pixel).join(cells, pixel, "left")
                          .withColumn("in_cell", F.coalesce("mask", F.lit(False)))
                          .select(*pixel, F.col("height").cast("double").alias("z"), "in_cell"))
    substrate = P.fit_plane(located.filter("NOT in_cell"), keys)
    heights = P.height_above_plane(located, substrate, keys).withColumn("height", F.greatest("height", F.lit(0.0)))
    image = P.interpolate_nearest(flat, heights)
    return (image.join(cells, pixel, "left").select(
        *pixel, F.when(F.coalesce("mask", F.lit(False)), F.col("height")).otherwise(0.0).alias("height")))


def height_image(stack: DataFrame, cells: DataFrame, threshold: float, bead_size: int = 2, bin_size: int = 4, close_radius: int | None = None,
                 above_substrate: bool = False, mean_area: int = 5, max_area: int = 1000) -> DataFrame:
    """Surface of the cell layer, as a whole number of planes at each pixel of the cells.

    Beads on cells are spots of the maximum projection inside the mask. The height of a bead is the brightest plane of the
    superpixel around its centre (`above_substrate`: over the plane through the background heights, cut to whole planes); beads at
    height zero do not count. Heights are spread to the nearest pixels, and with `close_radius` the surface is closed with a
    disk. Pixels outside cells are zero, as are images without beads.
    """
    keys = [k for k in image_keys(stack) if k != "zplane"]
    pixel = [*keys, "y", "x"]
    flat = cut_lineage(P.project(stack, "max"))
    beads = flux_centroids(detect_blobs(flat, cells, threshold, bead_size, mean_area, max_area))
    placed = beads.select(*pixel, *[F.floor(F.col(c) / bin_size).cast("int").alias(f"bin_{c}") for c in ("y", "x")])
    located = placed.join(P.binned_heights(stack, bin_size), [*keys, "bin_y", "bin_x"]).drop("bin_y", "bin_x")
    if above_substrate:
        ground = P.background_heights(stack, cells).filter("height > 0").withColumn("z", F.col("height").cast("double"))
        level = F.coalesce(F.col("a") * F.col("x") + F.col("b") * F.col("y") + F.col("c"), F.lit(0.0))
        located = (located.join(P.fit_plane(ground, keys), keys, "left")
                   .withColumn("height", (F.col("height") - level).cast("int")).drop("a", "b", "c"))
    surface = P.interpolate_nearest(flat, cut_lineage(located.filter("height > 0")))
    surface = surface.withColumn("height", F.coalesce("height", F.lit(0)).cast("int"))
    if close_radius:
        wide = ST.disk_extremes(surface.withColumnRenamed("height", "value"), close_radius).select(*pixel, F.col("disk_max").alias("value"))
        surface = ST.disk_extremes(wide, close_radius).select(*pixel, F.col("disk_min").alias("height"))
    inside = F.coalesce(F.col("mask"), F.lit(False))
    return surface.join(cells.select(*pixel, "mask"), pixel, "left").select(
        *pixel, F.when(inside, F.col("height")).otherwise(F.lit(0)).cast("int").alias("height"))
