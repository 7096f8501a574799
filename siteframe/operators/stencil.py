"""Neighbourhood operators on pixel rows.

A pixel table has one row per pixel: image keys, ``y``, ``x`` and a value. Local
filters do not multiply the rows by the size of the kernel. Weighted sums run on
strips of lines (see :mod:`siteframe.operators.strips`); minima, maxima and lookups
of neighbours stay in the JVM: one window over image
rows gathers the values left and right of a pixel, a second window over image
columns gathers those arrays above and below it, so each pixel meets its
neighbourhood after two shuffles. Windows end at an image row or column, which
keeps every group as short as an image side.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteframe.core import image_keys
from siteframe.operators.strips import separable, strip_filter, weighted


def _row(keys, r):
    return Window.partitionBy(*keys, "y").orderBy("x").rangeBetween(-r, r)


def _column(keys, r):
    return Window.partitionBy(*keys, "x").orderBy("y").rangeBetween(-r, r)


def image_extent(px: DataFrame) -> DataFrame:
    """Height and width of each image (coordinates start at zero)."""
    return px.groupBy(*image_keys(px)).agg((F.max("y") + 1).alias("_h"), (F.max("x") + 1).alias("_w"))


def reflect_pad(px: DataFrame, radius: int) -> DataFrame:
    """Add a border of mirrored pixels (the edge pixel itself is repeated)."""
    keys = image_keys(px)
    out = px.join(image_extent(px), keys)
    for axis, size in (("y", "_h"), ("x", "_w")):
        low, high = -F.col(axis) - 1, 2 * F.col(size) - 1 - F.col(axis)
        places = F.array(F.struct(F.col(axis).alias("p"), F.lit(True).alias("own")),
                         F.struct(low.alias("p"), (F.col(axis) < radius).alias("own")),
                         F.struct(high.alias("p"), (F.col(axis) >= F.col(size) - radius).alias("own")))
        kept = F.transform(F.filter(places, lambda e: e["own"]), lambda e: e["p"])
        out = out.withColumn(axis, F.explode(kept))
    return out


def crop_padding(px: DataFrame) -> DataFrame:
    return px.filter("y >= 0 AND x >= 0 AND y < _h AND x < _w").drop("_h", "_w")


def separable_filter(px: DataFrame, weights: list[float], value: str = "value", name: str = "filtered") -> DataFrame:
    """Weighted sum with a kernel that is the product of two equal 1-D kernels."""
    w = np.array(weights)
    return strip_filter(px, len(weights) // 2, lambda wide: {name: separable(wide, w)}, f"{name} double", value)


def crop_x(px: DataFrame) -> DataFrame:
    """Padding columns are of no use once the rows are filtered."""
    return px.filter("x >= 0 AND x < _w")


def neighbourhood(px: DataFrame, radius: int, value: str | Column = "value", border: str = "zero",
                  name: str = "hood", sparse: bool = False) -> DataFrame:
    """Attach the ``(2r+1) x (2r+1)`` values around each pixel as an array of rows.

    With ``zero`` border, places outside the image are null. Images normally have
    a row for every pixel. With `sparse`, pixels may be missing (object pixels
    only): each pixel then offers itself to the places beside it in its line, so
    that lines are complete where the centre of the line is missing.
    """
    keys = image_keys(px)
    v = F.col(value) if isinstance(value, str) else value
    base = reflect_pad(px, radius) if border == "reflect" else px
    span = range(-radius, radius + 1)
    if sparse:
        others = [c for c in px.columns if c not in (*keys, "y", "x")]
        offers = F.explode(F.array(*[F.lit(d) for d in span]))
        # The generator is a step of its own: names given inside structs would be lost beside it.
        spread = base.withColumns({"_v": v, "_all": F.struct(*others) if others else F.struct(F.lit(1).alias("one"))})
        spread = spread.withColumn("_d", offers).withColumn("x", F.col("x") - F.col("_d"))
        out = spread.groupBy(*keys, "y", "x").agg(
            F.array(*[F.max(F.when(F.col("_d") == d, F.col("_v"))) for d in span]).alias("_row"),
            F.max(F.when(F.col("_d") == 0, F.col("_all"))).alias("_all"))
    else:
        row = Window.partitionBy(*keys, "y").orderBy("x")
        out = base.withColumn("_v", v)
        beside = [F.col("_v") if d == 0 else F.when(F.lag("x", -d).over(row) == F.col("x") + d, F.lag("_v", -d).over(row))
                  for d in span]
        out = out.withColumn("_row", F.array(*beside))
        if border == "reflect":
            out = crop_x(out)
    col = Window.partitionBy(*keys, "x").orderBy("y")
    if sparse:
        # Lines may be missing, so neighbours are taken by coordinate and not by position.
        lines = [F.col("_row") if d == 0 else F.first("_row").over(col.rangeBetween(d, d)) for d in span]
        out = out.withColumn(name, F.array(*lines)).filter("_all IS NOT NULL")
        return out.select(*keys, "y", "x", *[F.col(f"_all.{c}").alias(c) for c in others], name)
    lines = [F.col("_row") if d == 0 else F.when(F.lag("y", -d).over(col) == F.col("y") + d, F.lag("_row", -d).over(col))
             for d in span]
    out = out.withColumn(name, F.array(*lines)).drop("_row", "_v")
    return crop_padding(out) if border == "reflect" else out


def cell(hood: str, radius: int, dy: int, dx: int) -> Column:
    """Value at an offset inside a neighbourhood column."""
    return F.get(F.get(hood, F.lit(dy + radius)), F.lit(dx + radius))


def convolve(px: DataFrame, kernel: list[list[float]], value: str = "value", name: str = "filtered") -> DataFrame:
    """Weighted sum of the neighbourhood with any odd-sized kernel, mirrored borders."""
    k = np.array(kernel)
    return strip_filter(px, len(kernel) // 2, lambda wide: {name: weighted(wide, k)}, f"{name} double", value)


# --- kernels --------------------------------------------------------------------

def gaussian_weights(sigma: float, truncate: float = 4.0) -> list[float]:
    radius = int(truncate * sigma + 0.5)
    raw = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(-radius, radius + 1)]
    return [w / sum(raw) for w in raw]


def kernel_offsets(size: int) -> range:
    return range(-(size // 2), size - size // 2)


def gaussian_kernel(size: int, sigma: float) -> list[list[float]]:
    """Square Gaussian kernel that sums to one."""
    g = [[math.exp(-(y * y + x * x) / (2 * sigma ** 2)) for x in kernel_offsets(size)] for y in kernel_offsets(size)]
    total = sum(map(sum, g))
    return [[v / total for v in line] for line in g]


def log_kernel(size: int, sigma: float) -> list[list[float]]:
    """Laplacian-of-Gaussian kernel that sums to zero."""
    offsets = list(kernel_offsets(size))
    g = gaussian_kernel(size, sigma)
    k = [[g[i][j] * (y * y + x * x - 2 * sigma ** 2) / sigma ** 4 for j, x in enumerate(offsets)]
         for i, y in enumerate(offsets)]
    mean = sum(map(sum, k)) / size ** 2
    return [[v - mean for v in line] for line in k]


# --- morphology -------------------------------------------------------------------

def dilate(mask: DataFrame, radius: int = 1, cross: bool = False) -> DataFrame:
    """Set pixels that have a set pixel in their neighbourhood (square or 4-neighbours)."""
    return _morph(mask, radius, cross, F.max, "mask")


def erode(mask: DataFrame, radius: int = 1, cross: bool = False) -> DataFrame:
    """Keep pixels whose whole neighbourhood inside the image is set."""
    return _morph(mask, radius, cross, F.min, "mask")


def _morph(mask, radius, cross, agg, name):
    keys = image_keys(mask)
    row, col = _row(keys, radius), _column(keys, radius)
    if cross:
        both = mask.withColumns({"_a": agg(name).over(row), "_b": agg(name).over(col)})
        pick = F.col("_a") | F.col("_b") if agg is F.max else F.col("_a") & F.col("_b")
        return both.withColumn(name, pick).drop("_a", "_b")
    return mask.withColumn(name, agg(name).over(row)).withColumn(name, agg(name).over(col))


def opening(mask: DataFrame, radius: int = 1, cross: bool = False) -> DataFrame:
    return dilate(erode(mask, radius, cross), radius, cross)


def closing(mask: DataFrame, radius: int = 1, cross: bool = False) -> DataFrame:
    return erode(dilate(mask, radius, cross), radius, cross)


def perimeter(mask: DataFrame) -> DataFrame:
    """Set pixels with an unset 4-neighbour; the image border does not count."""
    keys = image_keys(mask)
    inner = F.min("mask").over(_row(keys, 1)) & F.min("mask").over(_column(keys, 1))
    return mask.withColumn("_inner", inner).withColumn("mask", F.col("mask") & ~F.col("_inner")).drop("_inner")


def disk_extremes(px: DataFrame, radius: int, value: str = "value") -> DataFrame:
    """Minimum and maximum inside a disk. A disk is a stack of row spans, so the row
    pass takes one span per distance and the column pass combines them."""
    keys = image_keys(px)
    half = [int(math.isqrt(radius * radius - d * d)) for d in range(radius + 1)]
    out = px.select("*", *[f(value).over(_row(keys, w)).alias(f"_{n}{w}")
                           for w in sorted(set(half)) for n, f in (("lo", F.min), ("hi", F.max))])
    col = Window.partitionBy(*keys, "x").orderBy("y")

    def over_span(name, fn, agg):
        parts = []
        for dy in range(-radius, radius + 1):
            window = col.rangeBetween(dy, dy)
            parts.append(agg(f"_{name}{half[abs(dy)]}").over(window))
        return fn(*parts)

    return out.select(*px.columns, over_span("lo", F.least, F.min).alias("disk_min"),
                      over_span("hi", F.greatest, F.max).alias("disk_max"))
