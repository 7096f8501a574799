"""Measurements of objects from label and intensity pixels."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteframe.core import image_keys
from siteframe.operators import stencil as ST
from siteframe.operators.distance import distance_transform, nearest_marked
from siteframe.operators.labels import object_perimeter

NAN = float("nan")
GREYS = 1 << 20  # more than there are grey levels


def measure_intensity(labels: DataFrame, px: DataFrame) -> DataFrame:
    """Maximum, mean, minimum, sum and population standard deviation per object."""
    keys = image_keys(labels)
    v = F.col("value").cast("double")
    return (labels.join(px, [*keys, "y", "x"]).groupBy(*keys, "label").agg(
        F.max(v).alias("max"), F.avg(v).alias("mean"), F.min(v).alias("min"), F.sum(v).alias("sum"),
        F.stddev_pop(v).alias("std")))


def bounding_boxes(labels: DataFrame) -> DataFrame:
    """Half-open box of each object."""
    return labels.groupBy(*image_keys(labels), "label").agg(
        F.min("y").alias("y0"), (F.max("y") + 1).alias("y1"), F.min("x").alias("x0"), (F.max("x") + 1).alias("x1"))


def centroids(labels: DataFrame) -> DataFrame:
    """Centre of each object cut to whole pixels, y upwards."""
    return labels.groupBy(*image_keys(labels), "label").agg(
        (-F.floor(F.avg("y"))).cast("int").alias("y"), F.floor(F.avg("x")).cast("int").alias("x"))


def perimeter_length(labels: DataFrame) -> DataFrame:
    """Contour length from the pattern of rim pixels around each rim pixel."""
    keys = image_keys(labels)
    hood = ST.neighbourhood(object_perimeter(labels), 1, F.col("label"), sparse=True)

    def hits(offsets):
        total = F.lit(0)
        for dy, dx in offsets:
            total = total + F.coalesce((ST.cell("hood", 1, dy, dx) == F.col("label")).cast("int"), F.lit(0))
        return total

    code = 1 + 2 * hits([(-1, 0), (1, 0), (0, -1), (0, 1)]) + 10 * hits([(-1, -1), (-1, 1), (1, -1), (1, 1)])
    # Contribution of each pattern code to the contour length.
    straight, diagonal, corner = [5, 7, 15, 17, 25, 27], [21, 33], [13, 23]
    counts = hood.select(*keys, "label", code.alias("_code")).groupBy(*keys, "label").agg(
        F.count(F.when(F.col("_code").isin(straight), 1)).alias("_s"),
        F.count(F.when(F.col("_code").isin(diagonal), 1)).alias("_d"),
        F.count(F.when(F.col("_code").isin(corner), 1)).alias("_c"))
    return counts.select(*keys, "label", (F.col("_s") + math.sqrt(2) * F.col("_d")
                                          + (1 + math.sqrt(2)) / 2 * F.col("_c")).alias("perimeter"))


def measure_morphology(labels: DataFrame) -> DataFrame:
    """Size and shape from pixel moments: centre relative to the box, area,
    perimeter, ellipse axes and the ratios built from them."""
    keys = image_keys(labels)
    y, x = F.col("y").cast("double"), F.col("x").cast("double")
    m = labels.groupBy(*keys, "label").agg(
        F.count(F.lit(1)).cast("double").alias("area"), F.avg(y).alias("_my"), F.avg(x).alias("_mx"),
        F.min("y").alias("_y0"), F.max("y").alias("_y1"), F.min("x").alias("_x0"), F.max("x").alias("_x1"),
        F.var_pop(y).alias("_yy"), F.var_pop(x).alias("_xx"), F.covar_pop(y, x).alias("_xy"))
    m = m.join(perimeter_length(labels), [*keys, "label"], "left").withColumn("perimeter", F.coalesce("perimeter", F.lit(0.0)))
    half, diff = (F.col("_yy") + F.col("_xx")) / 2, (F.col("_yy") - F.col("_xx")) / 2
    root = F.sqrt(diff * diff + F.col("_xy") * F.col("_xy"))
    m = m.withColumns({"_l1": half + root, "_l2": F.greatest(half - root, F.lit(0.0))})
    major, minor = 4 * F.sqrt("_l1"), 4 * F.sqrt("_l2")
    area, per = F.col("area"), F.col("perimeter")
    box = (F.col("_y1") - F.col("_y0") + 1) * (F.col("_x1") - F.col("_x0") + 1)
    return m.select(
        *keys, "label", (F.col("_mx") - F.col("_x0")).alias("local_centroid_x"),
        (F.col("_my") - F.col("_y0")).alias("local_centroid_y"), area, per,
        F.coalesce(F.sqrt(F.greatest(1 - F.try_divide(F.col("_l2"), F.col("_l1")), F.lit(0.0))), F.lit(0.0)).alias("eccentricity"),
        (area / box).alias("extent"),
        F.coalesce(F.try_divide(4 * math.pi * area, per * per), F.lit(NAN)).alias("circularity"),
        F.coalesce(F.try_divide(major - minor, major), F.lit(NAN)).alias("elongation"),
        F.sqrt(4 * area / math.pi).alias("equivalent_diameter"),
        major.alias("major_axis_length"), minor.alias("minor_axis_length"))


def convex_hulls(labels: DataFrame) -> DataFrame:
    """Area of the convex hull around the pixel squares of each object. Only the
    outermost pixels of each object line reach Python, one row for each object."""
    keys = image_keys(labels)
    ends = labels.groupBy(*keys, "label", "y").agg(F.min("x").alias("x0"), (F.max("x") + 1).alias("x1"))
    lines = ends.groupBy(*keys, "label").agg(F.collect_list(F.struct("y", "x0", "x1")).alias("_l"))

    @F.pandas_udf("double")
    def area(y: pd.Series, x0: pd.Series, x1: pd.Series) -> pd.Series:
        out = []
        for lines, first, last in zip(y, x0, x1):
            pts = np.concatenate([np.stack([x, lines + d], 1) for x in (first, last) for d in (0, 1)]).astype(float)
            ring = hull_points(pts)
            nxt = np.roll(ring, -1, axis=0)
            out.append(abs(np.sum(ring[:, 0] * nxt[:, 1] - nxt[:, 0] * ring[:, 1])) / 2)
        return pd.Series(out, dtype=float)

    return lines.select(*keys, "label", area("_l.y", "_l.x0", "_l.x1").alias("hull_area"))


def hull_points(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull in order, without points on its edges."""
    pts = points[np.lexsort((points[:, 1], points[:, 0]))].tolist()

    def chain(seq):
        out: list = []
        for p in seq:
            while len(out) > 1 and ((out[-1][0] - out[-2][0]) * (p[1] - out[-2][1])
                                    - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0])) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(chain(pts) + chain(pts[::-1]))


def measure_shape(labels: DataFrame, mask: DataFrame) -> DataFrame:
    """Convexity, roundness and largest and mean distance to background. Distances
    are those of the whole foreground: touching objects are not kept apart."""
    keys = image_keys(labels)
    radius = (labels.join(distance_transform(mask), [*keys, "y", "x"]).groupBy(*keys, "label")
              .agg(F.max("distance").alias("maximum_radius"), F.avg("distance").alias("mean_radius"),
                   F.count(F.lit(1)).alias("_area")))
    out = (radius.join(convex_hulls(labels), [*keys, "label"]).join(perimeter_length(labels), [*keys, "label"], "left"))
    return out.select(*keys, "label", (F.col("_area") / F.col("hull_area")).alias("convexity"),
                      (F.col("perimeter") * F.col("perimeter") / (4 * math.pi * F.col("_area"))).alias("roundness"),
                      "maximum_radius", "mean_radius")


# --- moments ---------------------------------------------------------------------

def measure_zernike(labels: DataFrame, degree: int = 12) -> DataFrame:
    """Magnitudes of the Zernike moments of each object in the ellipse its padded
    box spans; no resampling, the coordinates are scaled instead."""
    keys = image_keys(labels)
    box = labels.groupBy(*keys, "label").agg(
        F.avg("y").alias("_cy"), F.avg("x").alias("_cx"), ((F.max("y") - F.min("y") + 3) / 2).alias("_ry"),
        ((F.max("x") - F.min("x") + 3) / 2).alias("_rx"), F.count(F.lit(1)).alias("_n"))
    px = labels.join(box, [*keys, "label"]).withColumns({
        "_v": (F.col("y") - F.col("_cy")) / F.col("_ry"), "_u": (F.col("x") - F.col("_cx")) / F.col("_rx")})
    px = px.withColumns({"_r": F.sqrt(F.col("_u") * F.col("_u") + F.col("_v") * F.col("_v")),
                         "_t": F.atan2("_v", "_u")}).filter("_r <= 1")
    orders = [(n, m) for n in range(degree + 1) for m in range(n + 1) if (n - m) % 2 == 0]

    def radial(n, m):
        total = F.lit(0.0)
        for k in range((n - m) // 2 + 1):
            c = (-1) ** k * math.factorial(n - k) / (
                math.factorial(k) * math.factorial((n + m) // 2 - k) * math.factorial((n - m) // 2 - k))
            total = total + F.lit(float(c)) * F.pow("_r", F.lit(n - 2 * k))
        return total

    sums = [s for n, m in orders for s in (
        F.sum(radial(n, m) * F.cos(F.col("_t") * m)).alias(f"_c{n}_{m}"),
        F.sum(radial(n, m) * F.sin(F.col("_t") * m)).alias(f"_s{n}_{m}"))]
    agg = px.groupBy(*keys, "label", "_n").agg(*sums)
    return agg.select(*keys, "label", *[
        (F.sqrt(F.pow(f"_c{n}_{m}", F.lit(2)) + F.pow(f"_s{n}_{m}", F.lit(2))) * ((n + 1) / math.pi) / F.col("_n")).alias(
            f"zernike_{n}_{m}") for n, m in orders])


def measure_hu(labels: DataFrame, px: DataFrame) -> DataFrame:
    """Seven rotation-invariant moments of the intensities of each object."""
    keys = image_keys(labels)
    v = F.col("value").cast("double")
    joined = labels.join(px, [*keys, "y", "x"])
    centre = joined.groupBy(*keys, "label").agg(
        F.sum(v).alias("_m"), F.try_divide(F.sum(v * F.col("y")), F.sum(v)).alias("_cy"),
        F.try_divide(F.sum(v * F.col("x")), F.sum(v)).alias("_cx"))
    dy, dx = F.col("y") - F.col("_cy"), F.col("x") - F.col("_cx")
    orders = [(i, j) for i in range(4) for j in range(4) if 2 <= i + j <= 3]
    sums = []
    for i, j in orders:
        term = v
        for _ in range(i):
            term = term * dy
        for _ in range(j):
            term = term * dx
        sums.append(F.sum(term).alias(f"_mu{i}{j}"))
    mu = joined.join(centre, [*keys, "label"]).groupBy(*keys, "label", "_m").agg(*sums)
    nu = {(i, j): F.try_divide(F.col(f"_mu{i}{j}"), F.pow("_m", F.lit((i + j) / 2 + 1))) for i, j in orders}
    a, b = nu[3, 0] + nu[1, 2], nu[2, 1] + nu[0, 3]
    p, q = nu[3, 0] - 3 * nu[1, 2], 3 * nu[2, 1] - nu[0, 3]
    d = nu[2, 0] - nu[0, 2]
    hu = [nu[2, 0] + nu[0, 2], d * d + 4 * nu[1, 1] * nu[1, 1], p * p + q * q, a * a + b * b,
          p * a * (a * a - 3 * b * b) + q * b * (3 * a * a - b * b),
          d * (a * a - b * b) + 4 * nu[1, 1] * a * b,
          q * a * (a * a - 3 * b * b) - p * b * (3 * a * a - b * b)]
    return mu.select(*keys, "label", *[h.alias(f"hu_{i}") for i, h in enumerate(hu)])


# --- texture -----------------------------------------------------------------------

def _object_pixels(labels: DataFrame, px: DataFrame, clip_percentile: float | None = None) -> DataFrame:
    """Pixels of objects, limited to a percentile of their image."""
    joined = labels.join(px, [*image_keys(labels), "y", "x"])
    if clip_percentile is None:
        return joined
    top = px.groupBy(*image_keys(px)).agg(F.percentile("value", F.lit(clip_percentile / 100)).alias("_clip"))
    return joined.join(top, image_keys(px)).withColumn("value", F.least(F.col("value").cast("double"), F.col("_clip"))).drop("_clip")


def measure_haralick(labels: DataFrame, px: DataFrame, distance: int = 1, clip_percentile: float | None = 99.999) -> DataFrame:
    """Thirteen co-occurrence features per object, averaged over four directions.

    Values are limited to a percentile of the image, so that single bright pixels do
    not set the scale of an object. They are stretched to 8 bit per object. Pairs of neighbouring object pixels
    are counted in one aggregation; the features are sums over these counts and
    their marginals. Zero grey levels are ignored; an object without pairs in some
    direction gets NaN.
    """
    keys = [*image_keys(labels), "label"]
    obj = _object_pixels(labels, px, clip_percentile)
    top = obj.groupBy(*keys).agg(F.max("value").alias("_top"))
    grey = obj.join(top, keys).withColumn("_g", F.coalesce(
        F.floor(F.try_divide(F.col("value") * F.lit(255), F.col("_top"))), F.lit(0)).cast("int"))
    grey = grey.filter("_g > 0").select(*keys, "y", "x", "_g")
    steps = F.array(*[F.struct(F.lit(d).alias("d"), F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for d, (dy, dx) in enumerate(
        [(0, distance), (distance, distance), (distance, 0), (distance, -distance)])])
    # Every pixel offers its level at the four places ahead of it.
    offered = grey.withColumn("_s", F.explode(steps)).select(
        *keys, F.col("_s.d").alias("d"), (F.col("y") + F.col("_s.dy")).alias("y"),
        (F.col("x") + F.col("_s.dx")).alias("x"), F.col("_g").alias("_h"))
    per = [*keys, "d"]
    # Matrices are symmetric, so unordered pairs carry all there is to count.
    glcm = offered.join(grey, [*keys, "y", "x"]).groupBy(
        *per, F.least("_g", "_h").cast("long").alias("i"), F.greatest("_g", "_h").cast("long").alias("j")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    i, j, n = F.col("i"), F.col("j"), F.col("n")
    # The counts and their marginals are kinds of one table, so that pixels are paired once and nothing is joined.
    kinds = {"t": ((i * GREYS + j, n),), "x": ((i, n / 2), (j, n / 2)), "p": ((i + j, n),), "m": ((j - i, n),)}
    entries = F.array(*[F.struct(F.lit(kind).alias("kind"), k.alias("k"), m.alias("n")) for kind, rows in kinds.items() for k, m in rows])
    counts = glcm.select(*per, F.explode(entries).alias("_e")).groupBy(*per, F.col("_e.kind").alias("kind"), F.col("_e.k").alias("k")).agg(
        F.sum("_e.n").alias("n")).withColumns({"i": F.expr(f"k DIV {GREYS}"), "j": F.col("k") % GREYS})
    cells = F.when(i == j, 1.0).otherwise(2.0)  # an unordered pair of two levels fills two cells

    def entropy(total, parts):
        """Entropy in bits from counts: log of the total less the mean log of the counts."""
        return F.log2(total) - parts / total

    def total_of(kind, value):
        return F.sum(F.when(F.col("kind") == kind, value))

    joint = {"_t": n, "_n2": n * n / cells, "_d2": (i - j) * (i - j) * n, "_ij": i * j * n, "_k": (i + j) * n, "_i2": (i * i + j * j) * n / 2,
             "_k2": (i + j) * (i + j) * n, "_idm": n / (1 + (i - j) * (i - j)), "_nl": n * F.log2(n / cells)}
    every = counts.groupBy(*per).agg(
        *[total_of("t", v).alias(name) for name, v in joint.items()],
        *[total_of(kind, v).alias(f"_{name}{kind}") for kind in "xpm" for name, v in (("l", n * F.log2(n)), ("q", n * n))])
    t = F.col("_t")
    mu = F.col("_k") / t / 2
    var = F.col("_i2") / t - mu * mu
    hx, joint_entropy = entropy(t, F.col("_lx")), entropy(t, F.col("_nl"))
    gain = joint_entropy - 2 * hx
    features = every.select(
        *per, (F.col("_n2") / (t * t)).alias("angular_second_moment"), (F.col("_d2") / t).alias("contrast"),
        F.coalesce(F.try_divide(F.col("_ij") / t - mu * mu, F.when(var > 1e-12, var)), F.lit(1.0)).alias("correlation"),
        var.alias("sum_of_squares"), (F.col("_idm") / t).alias("inverse_diff_moment"), (F.col("_k") / t).alias("sum_avg"),
        (F.col("_k2") / t - F.pow(F.col("_k") / t, F.lit(2))).alias("sum_var"), entropy(t, F.col("_lp")).alias("sum_entropy"),
        joint_entropy.alias("entropy"), (F.col("_qm") / (t * t) / 256 - 1 / 256 ** 2).alias("diff_var"),
        entropy(t, F.col("_lm")).alias("diff_entropy"),
        F.coalesce(F.try_divide(gain, F.when(hx > 1e-12, hx)), gain).alias("info_measure_corr_1"),
        F.sqrt(F.greatest(1 - F.exp(2 * gain), F.lit(0.0))).alias("info_measure_corr_2"))
    names = [c for c in features.columns if c not in per]
    mean = features.groupBy(*keys).agg(F.count(F.lit(1)).alias("_d"), *[F.avg(c).alias(c) for c in names])
    objects = labels.select(*keys).distinct()
    return objects.join(mean, keys, "left").select(*keys, *[
        F.when(F.col("_d") == 4, F.col(c)).otherwise(F.lit(NAN)).alias(c) for c in names])


def _bilinear(radius: int, dy: float, dx: float) -> Column:
    """Value between four neighbours; missing ones count as zero."""
    y0, x0 = math.floor(round(dy, 9)), math.floor(round(dx, 9))
    fy, fx = round(dy - y0, 9), round(dx - x0, 9)
    total = F.lit(0.0)
    for yy, wy in ((y0, 1 - fy), (y0 + 1, fy)):
        for xx, wx in ((x0, 1 - fx), (x0 + 1, fx)):
            if wy * wx > 0:
                total = total + F.coalesce(ST.cell("hood", radius, yy, xx), F.lit(0.0)) * F.lit(wy * wx)
    return total


def lbp_codes() -> list[int]:
    """The smallest rotations of all eight-bit patterns, in order."""
    return sorted({min(((c >> r) | (c << (8 - r))) & 255 for r in range(8)) for c in range(256)})


def measure_lbp(labels: DataFrame, px: DataFrame, radius: int = 1) -> DataFrame:
    """Counts of the 36 rotation-invariant binary patterns of eight points around
    each object pixel; pixels outside the object are black."""
    keys = [*image_keys(labels), "label"]
    obj = _object_pixels(labels, px)
    same = ST.neighbourhood(obj.select(*keys, "y", "x", F.col("value").cast("double").alias("value")), radius,
                            F.struct(F.col("label").alias("l"), F.col("value").alias("v")), sparse=True)
    own = F.transform("hood", lambda line: F.transform(line, lambda c: F.when(c["l"] == F.col("label"), c["v"])))
    hood = same.withColumn("hood", own)
    code = F.lit(0)
    for k in range(8):
        angle = 2 * math.pi * k / 8
        point = _bilinear(radius, radius * math.sin(angle), radius * math.cos(angle))
        code = code + F.when(point >= F.col("value"), 1 << k).otherwise(0)
    least = F.array_min(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda r: F.expr("0") + (
        F.call_function("shiftright", F.col("_code"), r).bitwiseOR(
            F.call_function("shiftleft", F.col("_code"), F.lit(8) - r))).bitwiseAND(F.lit(255))))
    counted = hood.select(*keys, code.alias("_code")).select(*keys, least.alias("_code"))
    return counted.groupBy(*keys).agg(*[F.count(F.when(F.col("_code") == c, 1)).alias(f"lbp_{i}")
                                        for i, c in enumerate(lbp_codes())])


TAS_NAMES = ("center", "n_center", "mu_margin", "n_mu_margin", "mu", "n_mu")


def measure_tas(labels: DataFrame, px: DataFrame, threshold: float) -> DataFrame:
    """Share of pixels with 0..8 set neighbours under six thresholdings around the
    mean of the pixels above `threshold`."""
    keys = [*image_keys(labels), "label"]
    obj = _object_pixels(labels, px).withColumn("value", F.col("value").cast("double"))
    bright = F.when(F.col("value") > threshold, F.col("value"))
    level = obj.groupBy(*keys).agg(F.coalesce(F.avg(bright), F.lit(0.0)).alias("_mu"),
                                   F.coalesce(F.stddev_pop(bright), F.lit(0.0)).alias("_sd"))
    hood = ST.neighbourhood(obj, 1, F.struct(F.col("label").alias("l"), F.col("value").alias("v")), sparse=True).join(level, keys)
    mu, sd = F.col("_mu"), F.col("_sd")

    def masks(v):
        centre, upper, mean = (v > mu - sd) & (v < mu + sd), v > mu - sd, v > mu
        return [centre, ~centre, upper, ~upper, mean, ~mean]

    around = []
    for dy in (-1, 0, 1):
        for dx in (-1, 0, 1):
            if dy or dx:
                c = ST.cell("hood", 1, dy, dx)
                around.append(masks(F.coalesce(F.when(c["l"] == F.col("label"), c["v"]), F.lit(0.0))))
    rows = []
    for k, own in enumerate(masks(F.col("value"))):
        count = sum((m[k].cast("int") for m in around), F.lit(0))
        rows.append(F.struct(F.lit(TAS_NAMES[k]).alias("name"), F.when(own, count).alias("bin")))
    binned = hood.select(*keys, F.explode(F.array(*rows)).alias("_e")).filter("_e.bin IS NOT NULL")
    counts = binned.groupBy(*keys, F.col("_e.name").alias("name")).agg(
        F.count(F.lit(1)).alias("_n"), *[F.count(F.when(F.col("_e.bin") == b, 1)).alias(f"_b{b}") for b in range(9)])
    return counts.select(*keys, "name", *[(F.col(f"_b{b}") / F.col("_n")).alias(f"tas_{b}") for b in range(9)])


def measure_gabor(labels: DataFrame, px: DataFrame, frequencies: Sequence[int], angles: int = 4) -> DataFrame:
    """Largest response over all angles of a Gabor function centred on each object
    and as wide as a third of its radius."""
    keys = [*image_keys(labels), "label"]
    obj = _object_pixels(labels, px)
    shape = obj.groupBy(*keys).agg(F.avg("y").alias("_cy"), F.avg("x").alias("_cx"),
                                   F.count(F.lit(1)).alias("_n"), F.sum(F.col("value").cast("double")).alias("_v"))
    px2 = obj.join(shape, keys)
    sigma = F.sqrt(F.col("_n") / math.pi) / 3
    dy, dx = F.col("y") - F.col("_cy"), F.col("x") - F.col("_cx")
    px2 = px2.withColumns({"_e": 1000 / (2 * math.pi * sigma * sigma) * F.exp(-(dy * dy + dx * dx) / (2 * sigma * sigma)),
                           "_dy": dy, "_dx": dx})
    sums, tags = [], []
    for f in frequencies:
        for a in range(angles):
            theta = math.pi * a / angles
            phase = 2 * math.pi / f * (F.col("_dy") * math.cos(theta) + F.col("_dx") * math.sin(theta))
            for n, g in (("c", F.cos(phase)), ("s", F.sin(phase))):
                wave = F.col("_e") * g
                sums += [F.sum(wave * F.col("value")).alias(f"_v{n}{f}_{a}"), F.sum(wave).alias(f"_w{n}{f}_{a}")]
            tags.append((f, a))
    agg = px2.groupBy(*keys, "_n", "_v").agg(*sums)

    def part(n, f, a):
        return F.col(f"_v{n}{f}_{a}") - F.col(f"_w{n}{f}_{a}") / F.col("_n") * F.col("_v")

    def score(f, a):
        c, s = part("c", f, a), part("s", f, a)
        return F.sqrt(c * c + s * s)

    return agg.select(*keys, *[F.greatest(F.lit(0.0), *[score(f, a) for a in range(angles)]).alias(f"gabor_{f}")
                               for f in frequencies])


def measure_texture(labels: DataFrame, px: DataFrame, frequencies: Sequence[int] = (1, 5, 10),
                    radii: Sequence[int] = (1,), scales: Sequence[int] = (1,), threshold: float | None = None) -> DataFrame:
    """All texture features side by side; the parts that are switched off are left out."""
    if any(r < 1 for r in radii) or any(s < 1 for s in scales) or any(f < 1 for f in frequencies):
        raise ValueError("frequencies, radii and scales must be positive")
    keys = [*image_keys(labels), "label"]
    parts = [measure_gabor(labels, px, frequencies), measure_hu(labels, px)]
    for r in radii:
        lbp = measure_lbp(labels, px, r)
        parts.append(lbp.select(*keys, *[F.col(c).alias(f"{c}_radius_{r}") for c in lbp.columns if c not in keys]))
    for s in scales:
        h = measure_haralick(labels, px, s)
        parts.append(h.select(*keys, *[F.col(c).alias(f"haralick_{c}_{s}") for c in h.columns if c not in keys]))
    if threshold is not None:
        tas = measure_tas(labels, px, threshold)
        parts.append(tas.groupBy(*keys).agg(*[
            F.max(F.when(F.col("name") == n, F.col(f"tas_{b}"))).alias(f"tas_{n}_{b}") for b in range(9) for n in TAS_NAMES]))
    out = parts[0]
    for part in parts[1:]:
        out = out.join(part, keys, "left")
    return out


# --- points -----------------------------------------------------------------------------

#: Lines of a band.
BAND = 64


def _banded(points: DataFrame, keys: Sequence[str], reach: int | None, fn: Callable[..., list], count: int) -> DataFrame:
    """Values of every point from the other points of its parent, `count` of them: (keys, point_id, y, x, _v0, ...).

    Points are whole pixels, and those at one place have the same values: places with their number of points are looked at, in
    bands of lines. A band gets the places of its parent within `reach` lines, or all of them, with their
    numbers. `fn` has the coordinates of the places of the band, the coordinates and numbers of those around it and the number of all points of the
    parent, and returns arrays.
    """
    keys = list(keys)
    band = F.floor(F.col("y") / BAND).cast("int")
    places = points.groupBy(*keys, "y", "x").agg(F.count(F.lit(1)).alias("n")).withColumn("_b", band)
    ends = places.groupBy(*keys).agg(F.sum("n").alias("_all"), F.min("_b").alias("_b0"), F.max("_b").alias("_b1"))
    sized = places.join(ends, keys)
    first, last = F.col("_b0"), F.col("_b1")
    if reach is not None:
        first = F.greatest(first, F.floor((F.col("y") - reach) / BAND).cast("int"))
        last = F.least(last, F.floor((F.col("y") + reach) / BAND).cast("int"))
    handed = sized.withColumn("_t", F.explode(F.sequence(first, last)))
    # Bands are few rows with much work each: they are dealt out before small partitions are merged.
    tasks = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = handed.repartition(tasks, *keys, "_t").groupBy(*keys, F.col("_t").alias("_b"), "_all").agg(
        F.collect_list(F.when(F.col("_b") == F.col("_t"), F.struct("y", "x"))).alias("_own"), F.collect_list(F.struct("y", "x", "n")).alias("_near"))

    @F.pandas_udf("array<array<double>>")
    def values(oy: pd.Series, ox: pd.Series, ny: pd.Series, nx: pd.Series, nn: pd.Series, total: pd.Series) -> pd.Series:
        return pd.Series([[list(map(float, v)) for v in fn(*(np.asarray(c, np.int64) for c in row[:5]), int(row[5]))] if len(row[0]) else []
                          for row in zip(oy, ox, ny, nx, nn, total)])

    found = rows.filter(F.size("_own") > 0).select(*keys, "_own", values("_own.y", "_own.x", "_near.y", "_near.x", "_near.n", "_all").alias("_v"))
    flat = found.select(*keys, "_v", F.posexplode("_own").alias("_i", "_o")).select(
        *keys, F.col("_o.y").alias("y"), F.col("_o.x").alias("x"), *[F.get(F.get("_v", F.lit(i)), F.col("_i")).alias(f"_v{i}") for i in range(count)])
    return points.select(*keys, "point_id", "y", "x").join(flat, [*keys, "y", "x"])


def _distance_sums(oy, ox, ny, nx, nn, total) -> list:
    """Nearest, mean and spread of the distances to the other points, a few places at once."""
    out = [np.full(len(oy), NAN) for _ in range(3)]
    if total < 2:
        return out
    oy, ox, ny, nx, nn = (c.astype(float) for c in (oy, ox, ny, nx, nn))
    single = bool((nn == 1).all())
    squares = total * (oy * oy + ox * ox) - 2 * (oy * (nn @ ny) + ox * (nn @ nx)) + nn @ (ny * ny + nx * nx)
    step = max(1, 200_000 // len(ny))  # what fits the cache
    for a in range(0, len(oy), step):
        part = slice(a, a + step)
        d = oy[part, None] - ny
        d *= d
        dx = ox[part, None] - nx
        dx *= dx
        d += dx
        np.sqrt(d, out=d)
        out[1][part] = (d.sum(1) if single else d @ nn) / (total - 1)
        d[d == 0] = np.inf
        out[0][part] = d.min(1)
    out[2] = np.sqrt(np.maximum(squares / (total - 1) - out[1] ** 2, 0.0))
    if not single:
        crowded = dict(zip(zip(ny.tolist(), nx.tolist()), (nn > 1).tolist()))
        out[0][[crowded[p] for p in zip(oy.tolist(), ox.tolist())]] = 0.0
    return out


class _Counts:
    """Numbers of points within squared distances of places: from running counts along each line, or one by one where there are few."""

    def __init__(self, ny, nx, nn) -> None:
        self.y0, self.x0 = ny.min(), nx.min()
        self.shape = (ny.max() - self.y0 + 1, nx.max() - self.x0 + 1)
        self.points = (ny, nx, nn) if len(ny) <= 2 * self.shape[0] else None
        if self.points is None:
            self.table = np.zeros((self.shape[0], self.shape[1] + 1), np.int64)
            self.table[ny - self.y0, nx - self.x0 + 1] = nn
            self.table = self.table.cumsum(1)

    def within(self, oy, ox, limit) -> np.ndarray:
        """Points with squared distance up to `limit`, a number for each place; those at the place itself count."""
        if self.points is not None:
            ny, nx, nn = self.points
            return (((oy[:, None] - ny) ** 2 + (ox[:, None] - nx) ** 2) <= limit[:, None]) @ nn
        out = np.zeros(len(oy), np.int64)
        reach = int(np.sqrt(max(limit.max(), 0))) + 1
        for line in range(max(0, oy.min() - self.y0 - reach), min(self.shape[0], oy.max() - self.y0 + reach + 1)):
            rest = limit - (oy - self.y0 - line) ** 2
            ok = np.nonzero(rest >= 0)[0]
            if len(ok):
                half = np.sqrt(rest[ok]).astype(np.int64)
                half -= half * half > rest[ok]
                half += (half + 1) ** 2 <= rest[ok]
                x = ox[ok] - self.x0
                out[ok] += (self.table[line, np.clip(x + half + 1, 0, self.shape[1])] - self.table[line, np.clip(x - half, 0, self.shape[1])])
        return out


def point_distances(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Nearest, mean and standard deviation of the distances from each point to the
    other points of its parent; NaN for a lone point.

    The mean needs every distance; it is added up for bands of lines against places with their numbers of points.
    """
    found = _banded(points, keys, None, _distance_sums, 3)
    names = ("nearest", "mean_distance", "std_distance")
    return found.select(*keys, "point_id", "y", "x", *[F.coalesce(F.col(f"_v{i}"), F.lit(NAN)).alias(n) for i, n in enumerate(names)])


def inner_distance(labels: DataFrame) -> DataFrame:
    """Squared distance of each object pixel to the nearest pixel outside its object.
    The pixels just outside an object are the only candidates."""
    keys = image_keys(labels)
    sides = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in ((0, 1), (0, -1), (1, 0), (-1, 0))])
    near = (object_perimeter(labels).withColumn("_o", F.explode(sides))
            .select(*keys, "label", (F.col("y") + F.col("_o.dy")).alias("y"), (F.col("x") + F.col("_o.dx")).alias("x")).distinct())
    outside = near.join(labels, [*keys, "label", "y", "x"], "left_anti")
    both = (labels.select(*keys, "label", "y", "x", F.lit(False).alias("_m"))
            .unionByName(outside.select(*keys, "label", "y", "x", F.lit(True).alias("_m"))).withColumn("_p", F.lit(0)))
    found = nearest_marked(both, "_m", "_p", ("label",))
    return found.filter("distance2 > 0").select(*keys, "label", "y", "x", F.col("distance2").alias("distance2"))


def measure_point_pattern(points: DataFrame, parents: DataFrame) -> DataFrame:
    """Distance to the border of the parent and to its other points, absolute and
    relative to the parent's area. A point outside any parent gets NaN, a lone
    point NaN for its neighbours. Border distances are squared, as measured."""
    keys = image_keys(parents)
    inside = points.join(inner_distance(parents).withColumnRenamed("label", "parent"), [*keys, "y", "x"])
    area = parents.groupBy(*keys, F.col("label").alias("parent")).agg(F.count(F.lit(1)).alias("_area"))
    dist = point_distances(inside.select(*keys, "parent", "point_id", "y", "x"), [*keys, "parent"])
    joined = (inside.select(*keys, "parent", "point_id", "distance2").join(area, [*keys, "parent"])
              .join(dist.drop("y", "x"), [*keys, "parent", "point_id"]))
    parts = {"distance_to_border": "distance2", "distance_to_nearest_neighbor": "nearest",
             "mean_distance_to_neighbors": "mean_distance", "std_distance_to_neighbors": "std_distance"}
    out = joined.select(*keys, "point_id", *[c for n, s in parts.items() for c in (
        F.col(s).alias(f"absolute_{n}"), (F.col(s) / F.col("_area")).alias(f"relative_{n}"))])
    rest = [c for c in out.columns if c not in (*keys, "point_id")]
    return points.select(*keys, "point_id").join(out, [*keys, "point_id"], "left").select(
        *keys, "point_id", *[F.coalesce(c, F.lit(NAN)).alias(c) for c in rest])


def neighbour_fractions(points: DataFrame, keys: Sequence[str], radii: Sequence[float]) -> DataFrame:
    """Share of the other points of the parent nearer than each radius; only lines within the largest radius are looked at."""
    limits = [math.ceil(r * r) - 1 for r in radii]

    def shares(oy, ox, ny, nx, nn, total) -> list:
        counts = _Counts(ny, nx, nn)
        return [(counts.within(oy, ox, np.full(len(oy), limit)) - 1) / (total - 1) if total > 1 and limit >= 0 else
                np.full(len(oy), 0.0 if total > 1 else NAN) for limit in limits]

    found = _banded(points, keys, math.ceil(max(radii)), shares, len(limits))
    return found.select(*keys, "point_id", *[F.coalesce(F.col(f"_v{i}"), F.lit(NAN)).alias(f"fraction_{i}") for i in range(len(limits))])


def kth_nearest(points: DataFrame, keys: Sequence[str], shares: Sequence[float]) -> DataFrame:
    """Distance within which a share of the other points of the parent lies: that of
    the ``ceil((n - 1) * share)``-th nearest point. Lone points have no row.

    Squared distances of pixels are whole numbers, so the distance is found by bisection on numbers of points within
    a trial distance, which running counts along the lines give.
    """
    def distances(oy, ox, ny, nx, nn, total) -> list:
        counts, out = _Counts(ny, nx, nn), []
        far = int(np.ptp(np.append(ny, oy)) ** 2 + np.ptp(np.append(nx, ox)) ** 2)
        for share in shares:
            want = max(math.ceil((total - 1) * share), 1) + 1  # the point itself is counted
            low, high = np.zeros(len(oy), np.int64), np.full(len(oy), far, np.int64)
            while (low < high).any():
                trial = (low + high) // 2
                enough = counts.within(oy, ox, trial) >= want
                low, high = np.where(enough, low, trial + 1), np.where(enough, trial, high)
            out.append(np.sqrt(low))
        return out

    crowd = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(*keys)
    found = _banded(points.join(crowd, list(keys), "left_semi"), keys, None, distances, len(shares))
    return found.select(*keys, "point_id", *[F.col(f"_v{i}").alias(f"distance_{i}") for i in range(len(shares))])


def spot_localisation(points: DataFrame, parents: DataFrame) -> DataFrame:
    """Distance of each spot to the centre and to the outline of its parent."""
    keys = image_keys(parents)
    centre = parents.groupBy(*keys, F.col("label").alias("parent")).agg(F.avg("y").alias("_cy"), F.avg("x").alias("_cx"))
    rim = object_perimeter(parents).select(*keys, "y", "x", "label", F.lit(True).alias("_m"))
    marked = parents.join(rim, [*keys, "y", "x", "label"], "left").withColumns(
        {"_m": F.coalesce("_m", F.lit(False)), "_p": F.lit(0)})
    outline = nearest_marked(marked, "_m", "_p", ("label",)).select(
        *keys, F.col("label").alias("parent"), "y", "x", F.sqrt("distance2").alias("distance_to_outline"))
    joined = points.join(outline, [*keys, "y", "x"]).join(centre, [*keys, "parent"])
    dy, dx = F.col("y") - F.col("_cy"), F.col("x") - F.col("_cx")
    return joined.select(*keys, "point_id", "parent", F.sqrt(dy * dy + dx * dx).alias("distance_to_centroid"), "distance_to_outline")


# --- volume and contours ----------------------------------------------------------------

def measure_volume(labels: DataFrame, heights: DataFrame, pixel_size: float = 0.1625, z_step: float = 0.25) -> DataFrame:
    """Height, volume and surface of each object; the upper surface is made of two
    triangles per square of four object pixels."""
    keys = image_keys(labels)
    obj = labels.join(heights, [*keys, "y", "x"])
    hood = ST.neighbourhood(obj, 1, F.struct(F.col("label").alias("l"), (F.col("height") * F.lit(z_step)).alias("z")))

    def z(dy, dx):
        c = ST.cell("hood", 1, dy, dx)
        return F.when(c["l"] == F.col("label"), c["z"])

    z0, s = F.col("height") * z_step, F.lit(pixel_size)
    down, right, both = z(1, 0) - z0, z(0, 1) - z0, z(1, 1) - z0
    # Cross products of the edges to the diagonal corner: (s, 0, a) x (s, s, c) and (0, s, b) x (s, s, c).
    first = F.sqrt(down * down * s * s + (s * both - down * s) * (s * both - down * s) + F.pow(s, F.lit(4)))
    second = F.sqrt((s * both - right * s) * (s * both - right * s) + right * right * s * s + F.pow(s, F.lit(4)))
    h = F.col("height").cast("double")
    agg = hood.groupBy(*keys, "label").agg(
        (F.max(h) * z_step).alias("max_height"), (F.avg(h) * z_step).alias("mean_height"),
        (F.sum(h) * (pixel_size * pixel_size * z_step / 1000)).alias("volume_pl"),
        (F.count(F.lit(1)) * (pixel_size * pixel_size)).alias("lower_surface_area"),
        F.coalesce(F.sum((first + second) / 2), F.lit(0.0)).alias("upper_surface_area"))
    return agg.withColumn("total_surface_area", F.col("lower_surface_area") + F.col("upper_surface_area"))


def order_contour(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Position of each contour point counter-clockwise around the mean point."""
    mean = points.groupBy(*keys).agg(F.avg("y").alias("_cy"), F.avg("x").alias("_cx"))
    angle = F.atan2(F.col("y") - F.col("_cy"), F.col("x") - F.col("_cx"))
    turned = points.join(mean, list(keys)).withColumn("_a", F.when(angle < 0, angle + 2 * math.pi).otherwise(angle))
    order = Window.partitionBy(*keys).orderBy("_a", "y", "x")
    return turned.withColumn("position", F.row_number().over(order) - 1).drop("_a", "_cy", "_cx")


def contour_curvature(contour: DataFrame, keys: Sequence[str], width: int) -> DataFrame:
    """Turning angle at each contour point between the points `width` steps before
    and after it; the contour is closed."""
    order = Window.partitionBy(*keys).orderBy("position")
    whole = Window.partitionBy(*keys)
    n = F.max("position").over(whole) + 1
    looped = contour.withColumn("_n", n)
    copies = F.array(F.struct(F.col("position").alias("p"), F.lit(True).alias("own")),
                     F.struct((F.col("position") - F.col("_n")).alias("p"), F.lit(False).alias("own")),
                     F.struct((F.col("position") + F.col("_n")).alias("p"), F.lit(False).alias("own")))
    near = (looped.withColumn("_e", F.explode(copies)).filter(F.col("_e.p").between(-width, F.col("_n") - 1 + width))
            .withColumns({"position": F.col("_e.p"), "_own": F.col("_e.own")}))
    ay, ax = F.col("y") - F.lag("y", width).over(order), F.col("x") - F.lag("x", width).over(order)
    by, bx = F.lead("y", width).over(order) - F.col("y"), F.lead("x", width).over(order) - F.col("x")
    angle = F.atan2(ax * by - ay * bx, ax * bx + ay * by)
    return near.withColumn("curvature", angle).filter("_own").select(*keys, "position", "y", "x", "curvature")
