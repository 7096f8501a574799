"""Image operators on pixel rows."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteframe.core import cut_lineage, image_keys
from siteframe.functions.scalars import scale_to_byte
from siteframe.operators import stencil as ST
from siteframe.operators import strips as SF
from siteframe.operators.distance import nearest_marked

PIXEL = ("y", "x")


# --- reading planes ------------------------------------------------------------

def extract_planes(images: DataFrame, planes: DataFrame) -> DataFrame:
    """Pixels of each image; the planes listed for one image are projected by maximum."""
    listed = images.select("image_id", F.explode("file_map").alias("_m")).select(
        "image_id", F.col("_m.file").alias("file"), F.col("_m.plane").alias("plane"))
    return (planes.join(listed, ["file", "plane"])
            .groupBy("image_id", "y", "x").agg(F.max("value").alias("value")))


def load_channel_image(px: DataFrame, sites: DataFrame, stats: DataFrame | None = None,
                       shifts: DataFrame | None = None, residues: DataFrame | None = None,
                       crop: bool = True, **where) -> DataFrame:
    """Pixels at a position, optionally corrected and aligned. Filters on image keys
    reach the scan; `sites` is already filtered by plate, well and position."""
    for column, value in where.items():
        px = px.filter(F.col(column) == value)
    return _prepared(px.join(sites.select("site_id"), "site_id", "left_semi"), stats, shifts, residues, crop)


def _prepared(px: DataFrame, stats: DataFrame | None, shifts: DataFrame | None, residues: DataFrame | None, crop: bool) -> DataFrame:
    if stats is not None:
        px = correct_illumination(px, stats)
    return px if shifts is None else align(px, shifts, residues, crop)


def load_pipeline_input(px: DataFrame, channels: Sequence[int], stats: DataFrame | None = None,
                        shifts: DataFrame | None = None, residues: DataFrame | None = None) -> DataFrame:
    """All planes of the given channels of every site, corrected and cropped to the
    area shared by all cycles."""
    return _prepared(px.filter(F.col("channel_id").isin(list(channels))), stats, shifts, residues, True)


def crop(px: DataFrame, y0: int, height: int, x0: int, width: int) -> DataFrame:
    inside = F.col("y").between(y0, y0 + height - 1) & F.col("x").between(x0, x0 + width - 1)
    return px.filter(inside).withColumns({"y": F.col("y") - y0, "x": F.col("x") - x0})


def pad(px: DataFrame, n: int, side: str) -> DataFrame:
    """Add `n` lines of zeros at one side of each image."""
    if side not in ("top", "bottom", "left", "right"):
        raise ValueError(f"unknown side: {side}")
    axis, other = ("y", "x") if side in ("top", "bottom") else ("x", "y")
    keys = image_keys(px)
    moved = px.withColumn(axis, F.col(axis) + n) if side in ("top", "left") else px
    # One edge line of the image stands for the positions of the new lines.
    size = px.groupBy(*keys).agg((F.max(axis) + 1).cast("int").alias("_size"))
    edge = px.filter(F.col(axis) == 0).join(size, keys)
    start = F.lit(0) if side in ("top", "left") else F.col("_size")
    lines = edge.withColumn(axis, F.explode(F.sequence(start, start + n - 1)))
    lines = lines.select(*keys, *PIXEL, F.lit(0).alias("value"))
    return moved.select(*keys, *PIXEL, "value").unionByName(lines)


# --- statistics and correction -----------------------------------------------------

def log_intensity(value: str | Column = "value") -> Column:
    """log10 with zeros kept at zero, as the statistics are taken."""
    v = F.col(value) if isinstance(value, str) else value
    return F.when(v > 0, F.log10(v.cast("double"))).otherwise(F.lit(0.0))


def illumination_stats(px: DataFrame, log: bool = True) -> DataFrame:
    """Mean and sample standard deviation of each pixel position over all images
    of a channel; merges map-side, so no image cap is needed."""
    v = log_intensity() if log else F.col("value").cast("double")
    keys = [k for k in ("channel_id",) if k in px.columns]
    return px.groupBy(*keys, *PIXEL).agg(F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"))


def smooth_stats(stats: DataFrame, sigma: float = 5.0) -> DataFrame:
    """Gaussian-smoothed statistics images."""
    weights = ST.gaussian_weights(sigma)
    if "channel_id" not in stats.columns:
        return smooth_stats(stats.withColumn("channel_id", F.lit(0)), sigma).drop("channel_id")
    keys = image_keys(stats)
    mean = ST.separable_filter(stats.drop("std"), weights, value="mean", name="_m").drop("mean")
    std = ST.separable_filter(stats.drop("mean"), weights, value="std", name="_s").drop("std")
    return mean.join(std, [*keys, *PIXEL]).withColumnsRenamed({"_m": "mean", "_s": "std"})


def illumination_percentiles(px: DataFrame, quantiles: Sequence[float] | None = None, decimals: int = 3) -> DataFrame:
    """Mean over all images of each image percentile, cut to whole numbers; nulls do not count.

    Without `quantiles` there are ``10 ** (decimals + 2)`` of them, evenly spaced from 0 to 100 and named by their place
    rounded to `decimals`.

    The percentiles of an image are a line through its ordered values. The lines of all images of one size add up to one line: between
    two positions it rises by the sum of what the images rise there. Rises are added up over the images, and only the sums,
    at most one for each position in an image, meet the quantiles.
    """
    spark = px.sparkSession
    if quantiles is None:
        last = 10 ** (decimals + 2) - 1
        places = spark.range(last + 1).select(F.round(F.col("id") * F.lit(100.0) / last, decimals).alias("q"), (F.col("id") / last).alias("share"))
    else:
        listed = [F.struct(F.lit(float(q)).alias("q"), F.lit(float(q) / 100).alias("share")) for q in quantiles]
        places = spark.range(1).select(F.explode(F.array(*listed)).alias("_e")).select("_e.q", "_e.share")
    keys = image_keys(px)
    channel = [k for k in ("channel_id",) if k in px.columns]
    order = Window.partitionBy(*keys).orderBy("value")
    upto = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0))
    steps = image_histogram(px.filter("value IS NOT NULL")).select(
        *channel, F.sum("n").over(Window.partitionBy(*keys)).alias("size"), (upto - F.col("n") - 1).alias("at"),
        (F.col("value") - F.coalesce(F.lag("value").over(order), F.lit(0))).alias("rise"))
    rises = cut_lineage(steps.groupBy(*channel, "size", "at").agg(F.sum("rise").alias("rise"), F.count(F.lit(1)).alias("images")))
    place = F.col("share") * (F.col("size") - 1)
    wanted = rises.filter("at = -1").drop("at", "rise").crossJoin(F.broadcast(places)).select(
        *channel, "size", F.floor(place).alias("at"), F.lit(None).cast("double").alias("rise"), "images", "q", (place - F.floor(place)).alias("f"))
    none = F.lit(None).cast("double")
    marks = rises.withColumns({"rise": F.col("rise").cast("double"), "q": none, "f": none}).unionByName(wanted)
    line = Window.partitionBy(*channel, "size").orderBy("at")
    below, here = F.sum("rise").over(line.rangeBetween(Window.unboundedPreceding, -1)), F.sum("rise").over(line.rangeBetween(0, 0))
    found = marks.select(*channel, "q", "images", (below + F.coalesce(here, F.lit(0.0)) * F.col("f")).alias("_v")).filter("q IS NOT NULL")
    # A hair is added because the mean may fall just below a whole number.
    return found.groupBy(*channel, "q").agg(F.floor(F.sum("_v") / F.sum("images") + F.lit(1e-9)).cast("int").alias("value"))


def correct_illumination(px: DataFrame, stats: DataFrame, bit_depth: int = 16) -> DataFrame:
    """Standardise each pixel position and rescale to the mean statistics of the
    channel. Zeros count as 1e-10 here, unlike in the statistics. The result is
    truncated and kept inside the range of the type; a position without spread
    takes the mean level.

    The mean of a channel is filed with the statistics of its positions, which are written: pixels meet one table
    of known size, and no task gets all pixels of a channel."""
    channel = [k for k in ("channel_id",) if k in stats.columns and k in px.columns]
    once = cut_lineage(stats)
    level = F.broadcast(once.groupBy(*channel).agg(F.avg("mean").alias("_mean"), F.avg("std").alias("_std")))
    levels = cut_lineage(once.join(level, channel) if channel else once.join(level), once)
    joined = px.join(levels, [*channel, *PIXEL])
    v = F.when(F.col("value") == 0, F.lit(-10.0)).otherwise(F.log10(F.greatest(F.col("value"), F.lit(1)).cast("double")))
    z = F.coalesce(F.try_divide(v - F.col("mean"), F.when(F.col("std") > 0, F.col("std"))), F.lit(0.0))
    out = F.pow(F.lit(10.0), F.least(z * F.col("_std") + F.col("_mean"), F.lit(12.0)))
    top = F.lit(float(2 ** bit_depth - 1))
    return joined.withColumn("value", F.floor(F.least(out, top)).cast("int")).select(px.columns)


def correct_selected(px: DataFrame, stats: DataFrame, skip_channels: Sequence[int]) -> DataFrame:
    """Correct all channels but the given ones."""
    skip = F.col("channel_id").isin(list(skip_channels))
    return correct_illumination(px.filter(~skip), stats).unionByName(px.filter(skip))


def layer_bounds(percentiles: DataFrame, clip_percent: float = 99.9, bit_depth: int = 16,
                 clip_value: int | None = None, clip: bool = True) -> DataFrame:
    """Lower and upper display bound of each channel, at least 255 levels apart: the
    given percentile, or a fixed value, or without clipping the range of the type."""
    channel = [k for k in ("channel_id",) if k in percentiles.columns]
    if not clip:
        return percentiles.select(*channel).distinct().withColumns({"min_intensity": F.lit(0), "max_intensity": F.lit(2 ** bit_depth - 1)})

    def closest(q):
        return F.min_by("value", F.struct(F.abs(F.col("q") - q), F.col("q")))

    out = percentiles.groupBy(*channel).agg(closest(0.001).alias("min_intensity"), (closest(clip_percent) if clip_value is None else F.lit(clip_value)).alias("_max"))
    floor_ = F.lit(255) if bit_depth == 8 else F.col("min_intensity") + 255
    return out.withColumn("max_intensity", F.greatest("_max", floor_)).drop("_max")


# --- registration ---------------------------------------------------------------------

def register(target: DataFrame, reference: DataFrame, max_shift: int) -> DataFrame:
    """Whole-pixel shift that brings each target image onto the reference image of
    its site: the least mean squared difference over the shared area, searched
    over all shifts up to `max_shift`. The candidates are columns of one
    aggregation, so the pixels are joined once."""
    hood = ST.neighbourhood(target, max_shift, F.col("value").cast("double"))
    joined = hood.join(reference.select("site_id", *PIXEL, F.col("value").cast("double").alias("_ref")),
                       ["site_id", *PIXEL])
    keys = image_keys(target)
    sums, shifts = [], []
    for dy in range(-max_shift, max_shift + 1):
        for dx in range(-max_shift, max_shift + 1):
            other = ST.cell("hood", max_shift, -dy, -dx)
            sums.append(F.avg((other - F.col("_ref")) * (other - F.col("_ref"))).alias(f"_e{len(shifts)}"))
            shifts.append((dy, dx))
    errors = joined.groupBy(*keys).agg(*sums)
    options = F.array(*[F.struct(F.col(f"_e{i}").alias("e"), F.lit(abs(dy) + abs(dx)).alias("_n"),
                                 F.lit(dy).alias("y"), F.lit(dx).alias("x")) for i, (dy, dx) in enumerate(shifts)])
    best = F.array_min(options)
    return errors.select(*keys, best["y"].alias("y"), best["x"].alias("x"), best["e"].alias("error"))


def _image_lines(px: DataFrame, keys: Sequence[str], block: int, name: str) -> DataFrame:
    """Lines of the images of block means: one row per image and line, with the places and means of its blocks."""
    y, x = (F.floor(F.col(c) / block).cast("int") for c in PIXEL)
    means = px.groupBy(*keys, y.alias("y"), x.alias("x")).agg(F.avg(F.col("value").cast("double")).alias("v"))
    return means.groupBy(*keys, "y").agg(F.collect_list(F.struct("x", "v")).alias(name))


def _shift_errors(target: DataFrame, reference: DataFrame, candidates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean squared difference over the shared area for each candidate shift: (keys, dy, dxs) in, (keys, dy, dx, e) out.

    A line of the target meets one line of the reference for each dy; all dx are tried on this pair of lines.
    """
    pairs = (target.join(candidates, list(keys)).withColumn("_at", F.col("y") + F.col("dy")).drop("y")
             .join(reference.withColumnRenamed("y", "_at"), ["site_id", "_at"]).select(*keys, "dy", "dxs", "_t", "_r"))
    types = {f.name: f.dataType.simpleString() for f in target.schema.fields}
    schema = ", ".join([f"{k} {types[k]}" for k in keys] + ["dy int", "dx int", "s double", "n long"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = {c: batch.column(c) for c in ("dxs", "_t", "_r")}
            ends = {c: v.offsets.to_numpy() for c, v in lists.items()}
            tx, tv = (lists["_t"].values.field(f).to_numpy() for f in ("x", "v"))
            rx, rv = (lists["_r"].values.field(f).to_numpy() for f in ("x", "v"))
            shifts = lists["dxs"].values.to_numpy()
            sums, counts = [], []
            for i in range(batch.num_rows):
                (t, r, c) = (slice(*ends[k][i:i + 2]) for k in ("_t", "_r", "dxs"))
                at = tx[t] + shifts[c, None]
                low = min(int(at.min()), int(rx[r].min()))
                wide = np.full(max(int(at.max()), int(rx[r].max())) - low + 1, np.nan)
                wide[rx[r] - low] = rv[r]
                d = wide[at - low]
                d -= tv[t]
                met = ~np.isnan(d)
                d[~met] = 0
                sums.append(np.einsum("ij,ij->i", d, d))
                counts.append(met.sum(axis=1))
            rows = np.repeat(np.arange(batch.num_rows), np.diff(ends["dxs"]))
            kept = batch.select([*keys, "dy"]).take(pa.array(rows, pa.int64()))
            first, last = ends["dxs"][0], ends["dxs"][-1]
            yield pa.RecordBatch.from_arrays(
                [*kept.columns, pa.array(shifts[first:last], pa.int32()), pa.array(np.concatenate(sums) if sums else [], pa.float64()),
                 pa.array(np.concatenate(counts) if counts else [], pa.int64())], names=[*keys, "dy", "dx", "s", "n"])

    found = pairs.mapInArrow(run, schema)
    return found.filter("n > 0").groupBy(*keys, "dy", "dx").agg((F.sum("s") / F.sum("n")).alias("e"))


def register_coarse_to_fine(target: DataFrame, reference: DataFrame, max_shift: int, keep: int = 8, reach: int = 8) -> DataFrame:
    """The shift of `register` for large `max_shift`, searched from coarse to fine.

    Both images are reduced to block means, with blocks so large that `max_shift` is at most `reach` of them. There all shifts
    are tried; the `keep` best ones and the shifts next to them go on to blocks of half the size, down to pixels, where the
    error is exact. A row of the joins is a line of an image, and no task holds a pair of images. Images without structure
    above the size of the largest blocks (white noise) need a smaller `reach` of blocks, or `register`.
    Ties go to the smaller shift. Target images that share no pixel with the reference give no row.
    """
    keys = image_keys(target)
    block = 1
    while -(-max_shift // block) > reach:
        block *= 2
    least = -(-max_shift // block)
    every = F.sequence(F.lit(-least), F.lit(least))
    candidates = target.select(*keys).distinct().select(*keys, F.explode(every).alias("dy"), every.alias("dxs"))
    order = F.struct("e", (F.abs("dy") + F.abs("dx")).alias("_n"), "dy", "dx")
    while True:
        errors = _shift_errors(_image_lines(target, keys, block, "_t"), _image_lines(reference, ["site_id"], block, "_r"), candidates, keys)
        if block == 1:
            best = errors.groupBy(*keys).agg(F.min(order).alias("_b"))
            return best.select(*keys, F.col("_b.dy").alias("y"), F.col("_b.dx").alias("x"), F.col("_b.e").alias("error"))
        block //= 2
        # At most (2 reach + 1)^2 errors of a pair are sorted here.
        top = errors.groupBy(*keys).agg(F.slice(F.sort_array(F.collect_list(order)), 1, keep).alias("_b"))
        near = [F.struct((2 * F.col("_c.dy") + a).alias("dy"), (2 * F.col("_c.dx") + b).alias("dx")) for a in (-1, 0, 1) for b in (-1, 0, 1)]
        limit = -(-max_shift // block)
        candidates = (top.select(*keys, F.explode("_b").alias("_c")).select(*keys, F.explode(F.array(*near)).alias("_s"))
                      .filter((F.abs("_s.dy") <= limit) & (F.abs("_s.dx") <= limit))
                      .groupBy(*keys, F.col("_s.dy").alias("dy")).agg(F.collect_set("_s.dx").alias("dxs")))


def register_far(target: DataFrame, reference: DataFrame) -> DataFrame:
    """Shift of any size by phase correlation; one group is one pair of images."""
    keys = image_keys(target)
    pairs = target.join(reference.select("site_id", *PIXEL, F.col("value").alias("ref")), ["site_id", *PIXEL])
    types = {f.name: f.dataType.simpleString() for f in target.schema.fields}
    schema = ", ".join([f"{k} {types[k]}" for k in keys] + ["y int", "x int"])

    def correlate(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        shape = (pdf["y"].max() + 1, pdf["x"].max() + 1)
        a, b = np.zeros(shape), np.zeros(shape)
        a[pdf["y"], pdf["x"]] = pdf["value"] - pdf["value"].mean()
        b[pdf["y"], pdf["x"]] = pdf["ref"] - pdf["ref"].mean()
        cross = np.fft.fft2(b) * np.conj(np.fft.fft2(a))
        peak = np.fft.ifft2(cross).real
        y, x = np.unravel_index(int(np.argmax(peak)), shape)
        y, x = (v - s if v > s // 2 else v for v, s in ((y, shape[0]), (x, shape[1])))
        return pd.DataFrame([[*key, int(y), int(x)]], columns=[*keys, "y", "x"])

    return pairs.groupBy(*keys).applyInPandas(correlate, schema)


def clip_for_registration(px: DataFrame, percentiles: DataFrame, q: float = 99.9) -> DataFrame:
    """Limit bright artefacts before registration at a channel percentile."""
    channel = [k for k in ("channel_id",) if k in percentiles.columns]
    bound = percentiles.groupBy(*channel).agg(F.min_by("value", F.abs(F.col("q") - q)).alias("_top"))
    joined = px.join(bound, channel) if channel else px.join(F.broadcast(bound))
    return joined.withColumn("value", F.least("value", "_top")).drop("_top")


def overlap(shifts: DataFrame) -> DataFrame:
    """Lines lost at each side of a site when all its cycles are aligned."""
    zero = F.lit(0)
    return shifts.groupBy("site_id").agg(
        F.greatest(zero, F.max("y")).alias("top_residue"), F.greatest(zero, -F.min("y")).alias("bottom_residue"),
        F.greatest(zero, F.max("x")).alias("left_residue"), F.greatest(zero, -F.min("x")).alias("right_residue"))


def align(px: DataFrame, shifts: DataFrame, residues: DataFrame, crop: bool = True,
          sizes: DataFrame | None = None) -> DataFrame:
    """Move each image by its shift and cut it to, or blacken it outside, the area
    shared by all cycles of the site. `sizes` has the height and width of each site;
    without it they are those of the pixels of the site."""
    on = [k for k in ("site_id", "cycle_id") if k in shifts.columns and k in px.columns]
    if sizes is None:
        sizes = px.groupBy("site_id").agg((F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width"))
    area = residues.join(sizes.select("site_id", F.col("height").alias("_height"), F.col("width").alias("_width")), "site_id")
    moved = (px.join(shifts.withColumnsRenamed({"y": "_sy", "x": "_sx"}), on).join(area, "site_id"))
    height, width = F.col("_height"), F.col("_width")
    y, x = F.col("y") + F.col("_sy"), F.col("x") + F.col("_sx")

    def inside(y, x):
        return ((y >= F.col("top_residue")) & (y < height - F.col("bottom_residue"))
                & (x >= F.col("left_residue")) & (x < width - F.col("right_residue")))

    dy, dx = (F.col("top_residue"), F.col("left_residue")) if crop else (F.lit(0), F.lit(0))
    kept = moved.filter(inside(y, x)).withColumns({"y": (y - dy).cast("int"), "x": (x - dx).cast("int")})
    if crop:
        return kept.select(px.columns)
    # Every image covers its whole grid, so the black border takes its positions.
    border = moved.filter(~inside(F.col("y"), F.col("x"))).withColumn("value", F.lit(0))
    return kept.select(px.columns).unionByName(border.select(px.columns))


# --- point operators ---------------------------------------------------------------

def clip(px: DataFrame, lower, upper) -> DataFrame:
    return px.withColumn("value", F.greatest(F.least("value", F.lit(upper)), F.lit(lower)))


def scale8(px: DataFrame, lower: int, upper: int) -> DataFrame:
    return px.withColumn("value", scale_to_byte("value", F.lit(lower), F.lit(upper)))


def image_range(px: DataFrame, lower: float | None = None, upper: float | None = None) -> DataFrame:
    """Smallest and largest value of each image, or the given percentiles of it."""
    low = F.min("value") if lower is None else F.percentile("value", F.lit(lower / 100))
    high = F.max("value") if upper is None else F.percentile("value", F.lit(upper / 100))
    return px.groupBy(*image_keys(px)).agg(low.cast("double").alias("_low"), high.cast("double").alias("_high"))


def rescale_to_8bit(px: DataFrame, upper: float = 100.0) -> DataFrame:
    """Map minimum..percentile of each image to 0..255."""
    bounds = image_range(px, None, upper)
    return (px.join(bounds, image_keys(px)).withColumn("value", scale_to_byte(
        "value", F.floor("_low").cast("int"), F.floor("_high").cast("int"))).drop("_low", "_high"))


def downsample_levels(px: DataFrame, bins: int) -> DataFrame:
    """Reduce each image to `bins` grey levels between its minimum and maximum."""
    joined = px.join(image_range(px), image_keys(px))
    step = F.try_divide((F.col("value") - F.col("_low")) * (bins - 1), F.col("_high") - F.col("_low"))
    return joined.withColumn("value", F.coalesce(F.floor(step), F.lit(0)).cast("int")).drop("_low", "_high")


def invert(px: DataFrame, max_value: int = 255) -> DataFrame:
    return px.withColumn("value", F.lit(max_value) - F.col("value"))


def rescale(px: DataFrame, lower: int | None, upper: int | None, type_max: int = 255) -> DataFrame:
    v = F.col("value")
    if lower is not None:
        v = F.greatest(v - lower, F.lit(0))
    if upper is not None:
        v = F.least(F.floor(v / F.lit(float(upper)) * type_max), F.lit(type_max))
    return px.withColumn("value", v.cast("int"))


def combine_channels(a: DataFrame, b: DataFrame, weight_a: int, weight_b: int, type_max: int = 255) -> DataFrame:
    """Weighted sum of two channels, each stretched to 0..1, stretched to the type."""
    if weight_a < 1 or weight_b < 1:
        raise ValueError("weights must be positive whole numbers")
    keys = image_keys(a)

    def stretched(px, name):
        j = px.join(image_range(px), keys)
        return j.select(*keys, *PIXEL, F.coalesce(F.try_divide(
            F.col("value") - F.col("_low"), F.col("_high") - F.col("_low")), F.lit(0.0)).alias(name))

    both = stretched(a, "_a").join(stretched(b, "_b"), [*keys, *PIXEL])
    mixed = both.select(*keys, *PIXEL, (F.col("_a") * weight_a + F.col("_b") * weight_b).alias("value"))
    joined = mixed.join(image_range(mixed), keys)
    out = F.try_divide((F.col("value") - F.col("_low")) * type_max, F.col("_high") - F.col("_low"))
    # A hair is added because the quotient may fall just below a whole number.
    return joined.select(*keys, *PIXEL, F.coalesce(F.floor(out + F.lit(1e-9)), F.lit(0)).cast("int").alias("value"))


def combine_masks(a: DataFrame, b: DataFrame, operation: str) -> DataFrame:
    keys = [*image_keys(a), *PIXEL]
    left, right = F.coalesce("mask", F.lit(False)), F.coalesce("_other", F.lit(False))
    result = {"AND": left & right, "OR": left | right, "EXCLUSIVE_OR": left != right}
    if operation not in result:
        raise ValueError(f"unknown operation: {operation}")
    return (a.join(b.withColumnRenamed("mask", "_other"), keys, "full_outer")
            .withColumn("mask", result[operation]).drop("_other"))


def apply_mask(px: DataFrame, mask: DataFrame, inside: bool = True) -> DataFrame:
    """Zero all pixels outside the mask, or inside it."""
    keep = F.coalesce("mask", F.lit(False)) if inside else ~F.coalesce("mask", F.lit(False))
    return (px.join(mask, [*image_keys(px), *PIXEL], "left")
            .withColumn("value", F.when(keep, F.col("value")).otherwise(0)).drop("mask"))


def rescale_quantile(px: DataFrame, low_q: float, high_q: float, low_limits=(None, None),
                     high_limits=(None, None)) -> DataFrame:
    """Stretch each image between two of its quantiles to 0..1; the bounds found
    are kept inside the given limits."""
    bounds = px.groupBy(*image_keys(px)).agg(F.percentile("value", F.lit(low_q)).alias("_lo"),
                                             F.percentile("value", F.lit(high_q)).alias("_hi"))

    def limited(column, limits):
        c = F.col(column)
        if limits[0] is not None:
            c = F.greatest(c, F.lit(float(limits[0])))
        return c if limits[1] is None else F.least(c, F.lit(float(limits[1])))

    lo, hi = limited("_lo", low_limits), limited("_hi", high_limits)
    v = F.least(F.greatest(F.col("value").cast("double"), lo), hi)
    return (px.join(bounds, image_keys(px))
            .withColumn("value", F.coalesce(F.try_divide(v - lo, hi - lo), F.lit(0.0))).drop("_lo", "_hi"))


# --- thresholds ----------------------------------------------------------------------

def threshold_manual(px: DataFrame, level: float) -> DataFrame:
    return px.withColumn("mask", F.col("value") > level)


def image_histogram(px: DataFrame) -> DataFrame:
    return px.groupBy(*image_keys(px), "value").agg(F.count(F.lit(1)).alias("n"))


def otsu_levels(px: DataFrame) -> DataFrame:
    """Level with the largest variance between the pixels up to it and above it,
    from the histogram of each image; the lowest one among equals."""
    keys = image_keys(px)
    upto = Window.partitionBy(*keys).orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    v = F.col("value").cast("double")
    h = image_histogram(px).select(
        *keys, "value", F.sum("n").over(upto).alias("nb"), F.sum(v * F.col("n")).over(upto).alias("sb"),
        F.sum("n").over(whole).alias("nt"), F.sum(v * F.col("n")).over(whole).alias("st"))
    no = F.col("nt") - F.col("nb")
    gap = F.col("sb") / F.col("nb") - F.try_divide(F.col("st") - F.col("sb"), no.cast("double"))
    between = F.coalesce(F.col("nb") * no * gap * gap, F.lit(0.0))
    return h.groupBy(*keys).agg(F.min_by("value", F.struct((-between).alias("b"), F.col("value"))).alias("level"))


def threshold_otsu(px: DataFrame, correction: float = 1.0, lower: float | None = None,
                   upper: float | None = None) -> DataFrame:
    """Mask of pixels above the corrected Otsu level, kept inside the bounds."""
    keys = image_keys(px)
    levels = otsu_levels(px).join(image_range(px), keys)
    low = F.col("_low") if lower is None else F.lit(float(lower))
    high = F.col("_high") if upper is None else F.lit(float(upper))
    level = F.greatest(F.least(F.col("level") * correction, high), low)
    return (px.join(levels.select(*keys, level.alias("_level")), keys)
            .withColumn("mask", F.col("value") > F.col("_level")).drop("_level"))


def _tuned(mask: Column, lower, upper) -> Column:
    """Force pixels below the lower bound off and above the upper bound on."""
    if lower is not None:
        mask = F.when(F.col("_raw") < lower, False).otherwise(mask)
    if upper is not None:
        mask = F.when(F.col("_raw") > upper, True).otherwise(mask)
    return mask


def threshold_adaptive(px: DataFrame, method: str, kernel_size: int, constant: float = 0,
                       lower: float | None = None, upper: float | None = None) -> DataFrame:
    """Local threshold: Gaussian-weighted mean minus a constant (``crosscorr``) or
    mean plus a multiple of the standard deviation (``niblack``)."""
    if kernel_size % 2 == 0:
        raise ValueError("kernel size must be odd")
    radius = kernel_size // 2
    low8 = rescale_to_8bit(px.withColumn("_raw", F.col("value")), 99.99)
    if method == "niblack":
        def fn(wide):
            n = kernel_size ** 2
            mean = SF.box_sums(wide, radius) / n
            # Sums of whole numbers are exact; the variance is kept from falling below zero.
            spread = np.sqrt(np.maximum(SF.box_sums(wide * wide, radius) / n - mean * mean, 0))
            return {"_level": mean + constant * spread}
    elif method == "crosscorr":
        line = np.array(ST.gaussian_kernel(kernel_size, 0.3 * ((kernel_size - 1) * 0.5 - 1) + 0.8)[radius])

        def fn(wide):
            return {"_level": np.round(SF.separable(wide, line / line.sum())) - int(constant)}
    else:
        raise ValueError('method must be "crosscorr" or "niblack"')
    stats = SF.strip_filter(low8, radius, fn, "_level double")
    return stats.withColumn("mask", _tuned(F.col("value") > F.col("_level"), lower, upper)).select(
        *image_keys(px), *PIXEL, F.col("_raw").alias("value"), "mask")


def threshold_bernsen(px: DataFrame, radius: int, contrast: float, global_level: float = 128) -> DataFrame:
    """Background mask: where the local contrast is low, pixels below the local
    middle; elsewhere, pixels whose local middle is below the global level."""
    out = ST.disk_extremes(px, radius)
    middle = F.col("disk_max") / 2 + F.col("disk_min") / 2
    mask = F.when(F.col("disk_max") - F.col("disk_min") < contrast, middle > F.col("value")).otherwise(
        middle < global_level)
    return out.withColumn("mask", mask).drop("disk_min", "disk_max")


def threshold_surface(px: DataFrame, method: str, least_block: int = 50) -> DataFrame:
    """Pixels with the `level` of a surface: levels of blocks, interpolated between the centres of the blocks.

    Blocks are a tenth of the image, `least_block` at least, and of the size within a tenth of that which overhangs least. The
    overhang is dealt to both sides and filled with the outermost pixels. Levels stay between 0.7 and 1.5 times the level of the image.
    """
    keys = image_keys(px)
    if "level" in keys:
        raise ValueError("images with levels have no surface")
    side = f"greatest({least_block}, least(round(_h / 10), round(_w / 10)))"
    over = lambda n: f"ceil({n} / b) * b - {n}"
    best = f"-array_min(transform(sequence(CAST(floor(1.1 * _s) AS INT), CAST(ceil(0.9 * _s) AS INT), -1), b -> struct({over('_h')} + {over('_w')} AS o, -b AS b))).b"
    size = px.groupBy(*keys).agg((F.max("y") + 1).alias("_h"), (F.max("x") + 1).alias("_w")).withColumn("_s", F.expr(side)).withColumn("_b", F.expr(best))
    size = size.withColumns({f"_{n}": F.expr(f"CAST(ceil(_{m} / _b) AS INT)") for n, m in (("ny", "h"), ("nx", "w"))}).withColumns(
        {"_py": F.expr("CAST(round((_ny * _b - _h) / 2) AS INT)"), "_px": F.expr("CAST(round((_nx * _b - _w) / 2) AS INT)")})
    sized = px.join(size, keys)

    def copies(c: str, pad: str, n: str, full: str) -> Column:
        return F.expr(f"""explode(sequence(IF({c} = 0, 0, {c} + {pad}), IF({c} = {n} - 1, {full} * _b - 1, {c} + {pad})))""")

    wide = sized.select(*keys, "value", "_b", "_nx", "x", "_px", "_w", copies("y", "_py", "_h", "_ny").alias("_y")).select(
        *keys, "value", "_b", "_nx", "_y", copies("x", "_px", "_w", "_nx").alias("_x"))
    blocks = wide.select(*keys, "value", F.expr("CAST(_y DIV _b * _nx + _x DIV _b AS INT)").alias("level"), F.col("_y").alias("y"), F.col("_x").alias("x"))
    levels = threshold_global(blocks, method, "t").select(*keys, F.col("level").alias("block"), "t")
    table = levels.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("block", "t"))).alias("_t"))
    whole = threshold_global(px, method).select(*keys, F.col("level").alias("_g"))
    at = sized.join(table, keys).join(whole, keys)
    for c, pad, n in (("y", "_py", "_ny"), ("x", "_px", "_nx")):
        at = at.withColumn(f"_u{c}", F.expr(f"({c} + {pad} + 0.5D) / _b - 0.5D")).withColumns(
            {f"_{c}0": F.expr(f"CAST(greatest(floor(_u{c}), 0) AS INT)"), f"_{c}1": F.expr(f"CAST(least(floor(_u{c}) + 1, {n} - 1) AS INT)"),
             f"_f{c}": F.expr(f"_u{c} - floor(_u{c})")})
    cell = lambda a, b: F.element_at("_t", F.col(a) * F.col("_nx") + F.col(b))
    upper = cell("_y0", "_x0") * (1 - F.col("_fx")) + cell("_y0", "_x1") * F.col("_fx")
    lower = cell("_y1", "_x0") * (1 - F.col("_fx")) + cell("_y1", "_x1") * F.col("_fx")
    level = upper * (1 - F.col("_fy")) + lower * F.col("_fy")
    return at.select(*px.columns, F.least(F.greatest(level, 0.7 * F.col("_g")), 1.5 * F.col("_g")).alias("level"))


def threshold_objects(px: DataFrame, labels: DataFrame, method: str) -> DataFrame:
    """Pixels with the `level` of the object that they belong to, between 0.7 and 1.5 times the level of the image; outside of
    objects the level is one within the same bounds."""
    keys = image_keys(px)
    inside = px.join(labels.select(*keys, *PIXEL, F.col("label").alias("level")), [*keys, *PIXEL])
    own = threshold_global(inside, method, "t").select(*keys, F.col("level").alias("label"), "t")
    whole = threshold_global(px, method).select(*keys, F.col("level").alias("_g"))
    at = px.join(labels.select(*keys, *PIXEL, "label"), [*keys, *PIXEL], "left").join(own, [*keys, "label"], "left").join(whole, keys)
    return at.select(*px.columns, F.least(F.greatest(F.coalesce("t", F.lit(1.0)), 0.7 * F.col("_g")), 1.5 * F.col("_g")).alias("level"))


def threshold_level(px: DataFrame, method: str, mode: str = "Global", labels: DataFrame | None = None, correction: float = 1.0,
                    lower: float = 0.0, upper: float = float("inf"), least_block: int = 50) -> DataFrame:
    """Pixels with their threshold `level`, corrected and kept within bounds, and the mask above it.

    The level is that of the image (``Global``), of a surface over blocks (``Adaptive``) or of the objects in `labels` (``PerObject``).
    """
    if mode == "Global":
        out = px.join(threshold_global(px, method), image_keys(px))
    elif mode == "Adaptive":
        out = threshold_surface(px, method, least_block)
    elif mode == "PerObject":
        if labels is None:
            raise ValueError("levels per object need labels")
        out = threshold_objects(px, labels, method)
    else:
        raise ValueError('mode must be "Global", "Adaptive" or "PerObject"')
    level = F.least(F.greatest(F.col("level") * correction, F.lit(float(lower))), F.lit(float(upper)))
    return out.withColumn("level", level).withColumn("mask", F.col("value") > F.col("level"))


def threshold_global(px: DataFrame, method: str, name: str = "level") -> DataFrame:
    """Threshold level of each image by the method named, in the column `name`; all but mixture work on
    image histograms."""
    keys = image_keys(px)
    if name != "level":
        # The images may be told apart by a column of that name.
        inner = px.withColumnRenamed("level", "zplane") if "level" in keys and "zplane" not in keys else None
        if inner is None:
            raise ValueError("parts of images are told apart by level, and images not by plane")
        return threshold_global(inner, method).withColumnRenamed("level", name).withColumnRenamed("zplane", "level")
    if method == "Background":
        # Twice the most frequent level.
        mode = image_histogram(px).groupBy(*keys).agg(
            F.min_by("value", F.struct((-F.col("n")).alias("n"), F.col("value"))).alias("_m"))
        return mode.select(*keys, (F.col("_m") * 2).cast("double").alias("level"))
    if method == "RobustBackground":
        # Mean plus two standard deviations without the outer twentieths.
        bounds = px.groupBy(*keys).agg(F.percentile("value", F.array(F.lit(0.05), F.lit(0.95))).alias("_p"))
        kept = px.join(bounds, keys).filter(F.col("value").between(F.get("_p", F.lit(0)), F.get("_p", F.lit(1))))
        return kept.groupBy(*keys).agg((F.avg("value") + 2 * F.stddev_pop("value")).alias("level"))
    if method == "Otsu":
        return otsu_levels(px).select(*keys, F.col("level").cast("double").alias("level"))
    if method == "RidlerCalvard":
        return _fixed_point_levels(px)
    if method == "MoG":
        return _mixture_levels(px)
    raise ValueError(f"unknown method: {method}")


def _fixed_point_levels(px: DataFrame) -> DataFrame:
    """Middle between the means of both classes, repeated until it stands on every image.

    The level moves in one direction only and each move changes the class of a grey level, so that rounds end."""
    keys = image_keys(px)
    hist = cut_lineage(image_histogram(px))
    v, n = F.col("value").cast("double"), F.col("n")
    state = cut_lineage(hist.groupBy(*keys).agg((F.sum(v * n) / F.sum(n)).alias("level")))
    while True:
        low, high = v <= F.col("level"), v > F.col("level")
        sums = hist.join(state, keys).groupBy(*keys, "level").agg(
            *[F.try_divide(F.sum(F.when(side, v * n)), F.sum(F.when(side, n))).alias(name) for side, name in ((low, "_a"), (high, "_b"))])
        moved = F.coalesce((F.col("_a") + F.col("_b")) / 2, F.col("level"))
        new = cut_lineage(sums.select(*keys, moved.alias("level"), (moved != F.col("level")).alias("_moved")), state)
        if new.filter("_moved").isEmpty():
            return new.drop("_moved")
        state = new.drop("_moved")
        state._siteframe_path = new._siteframe_path


def _mixture_levels(px: DataFrame) -> DataFrame:
    """Mixture of three Gaussians fitted to each image histogram; the level lies
    where background and object classes are equally likely."""
    keys = image_keys(px)
    types = {f.name: f.dataType.simpleString() for f in px.schema.fields}
    schema = ", ".join([f"{k} {types[k]}" for k in keys] + ["level double"])

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        v, n = pdf["value"].to_numpy(float), pdf["n"].to_numpy(float)
        order = np.argsort(v)
        share = np.cumsum(n[order]) / n.sum()
        means = np.interp([0.1, 0.5, 0.9], share, v[order])
        std, prior = np.full(3, max(v.std() / 3, 1e-3)), np.full(3, 1 / 3)
        step = np.inf
        while step > 1e-4 * max(v.std(), 1e-3):
            before = means
            dens = prior * np.exp(-0.5 * ((v[:, None] - means) / std) ** 2) / std + 1e-300
            post = dens / dens.sum(1, keepdims=True) * n[:, None]
            weight = post.sum(0) + 1e-12
            means = (post * v[:, None]).sum(0) / weight
            std = np.sqrt((post * (v[:, None] - means) ** 2).sum(0) / weight) + 1e-3
            prior = weight / weight.sum()
            step = np.abs(means - before).max()
        order = np.argsort(means)
        # The middle class goes with the class that is nearer.
        n_back = 2 if means[order[1]] - means[order[0]] <= means[order[2]] - means[order[1]] else 1
        low, high = means[order[n_back - 1]], means[order[n_back]]
        while high - low > 1e-9 * max(abs(high), 1):
            middle = (low + high) / 2
            dens = prior * np.exp(-0.5 * ((middle - means) / std) ** 2) / std
            low, high = (middle, high) if dens[order[:n_back]].sum() > dens[order[n_back:]].sum() else (low, middle)
        return pd.DataFrame([[*key, float(high)]], columns=[*keys, "level"])

    return image_histogram(px).groupBy(*keys).applyInPandas(fit, schema)


# --- filters ------------------------------------------------------------------------

def smooth(px: DataFrame, name: str, size: int) -> DataFrame:
    """Average, Gaussian, median or bilateral filter, cut to whole numbers."""
    reach = size // 2
    if name == "average":
        def fn(wide):
            return np.floor(SF.box_sums(wide, reach) / (2 * reach + 1) ** 2)
    elif name == "gaussian":
        weights = np.array(ST.gaussian_weights(float(size)))
        reach = len(weights) // 2

        def fn(wide):
            return np.floor(SF.separable(wide, weights) + 1e-9)
    elif name == "median":
        def fn(wide):
            return np.median(SF.windows(wide, reach), axis=(2, 3))
    elif name == "bilateral":
        reach = max(int(round(size * 1.5)), 1)

        def fn(wide):
            return _bilateral(wide, reach, float(size))
    else:
        raise ValueError('filter must be "average", "gaussian", "median" or "bilateral"')
    out = SF.strip_filter(px, reach, lambda wide: {"_new": fn(wide)}, "_new double")
    return out.withColumn("value", F.col("_new").cast("int")).select(px.columns)


def _bilateral(wide: np.ndarray, reach: int, sigma: float) -> np.ndarray:
    """Weights fall with distance and with difference in intensity."""
    h, w = wide.shape[0] - 2 * reach, wide.shape[1] - 2 * reach
    centre = wide[reach:reach + h, reach:reach + w]
    total, norm = np.zeros((h, w)), np.zeros((h, w))
    for dy in range(-reach, reach + 1):
        for dx in range(-reach, reach + 1):
            if dy * dy + dx * dx <= reach * reach:
                v = wide[reach + dy:reach + dy + h, reach + dx:reach + dx + w]
                weight = np.exp(-(dy * dy + dx * dx) / (2 * sigma ** 2) - (v - centre) ** 2 / (2 * sigma ** 2))
                total, norm = total + weight * v, norm + weight
    return np.floor(total / norm + 1e-9)


def project(px: DataFrame, method: str, type_max: int = 65535) -> DataFrame:
    """Projection over z; a sum beyond the type keeps its largest value."""
    if method not in ("max", "sum"):
        raise ValueError('method must be "max" or "sum"')
    agg = F.max("value") if method == "max" else F.least(F.sum("value"), F.lit(type_max)).cast("int")
    keys = [k for k in image_keys(px) if k != "zplane"]
    return px.groupBy(*keys, *PIXEL).agg(agg.alias("value"))


# --- composition ------------------------------------------------------------------------

def place(base: DataFrame, inset: DataFrame, y0: int, x0: int) -> DataFrame:
    """Insert an image into another one; its pixels win."""
    keys = [*image_keys(base), *PIXEL]
    moved = inset.withColumns({"y": F.col("y") + y0, "x": F.col("x") + x0})
    return (base.join(moved.withColumnRenamed("value", "_new"), keys, "left")
            .withColumn("value", F.coalesce("_new", "value")).drop("_new"))


def merge_at(a: DataFrame, b: DataFrame, axis: str, offset: int) -> DataFrame:
    """Take pixels from `offset` on along the axis from the second image."""
    if axis not in PIXEL:
        raise ValueError(f"unknown axis: {axis}")
    return a.filter(F.col(axis) < offset).unionByName(b.filter(F.col(axis) >= offset))


def concat(a: DataFrame, b: DataFrame, axis: str) -> DataFrame:
    """Second image below (y) or right of (x) the first one."""
    if axis not in PIXEL:
        raise ValueError(f"unknown axis: {axis}")
    keys = image_keys(a)
    size = a.groupBy(*keys).agg((F.max(axis) + 1).cast("int").alias("_size"))
    moved = b.join(size, keys).withColumn(axis, F.col(axis) + F.col("_size")).drop("_size")
    return a.unionByName(moved)


def feature_image(labels: DataFrame, values: DataFrame, column: str) -> DataFrame:
    """Paint the value of each object into its pixels."""
    keys = image_keys(labels)
    return labels.join(values.select(*keys, "label", column), [*keys, "label"]).select(
        *keys, *PIXEL, F.col(column).cast("double").alias("value"))


# --- heights --------------------------------------------------------------------------

def height_map(px: DataFrame) -> DataFrame:
    """z plane with the largest value at each pixel, the lowest one among equals."""
    keys = [k for k in image_keys(px) if k != "zplane"]
    return px.groupBy(*keys, *PIXEL).agg(F.max_by("zplane", F.struct(
        F.col("value"), (-F.col("zplane")).alias("z"))).alias("height"))


def background_heights(px: DataFrame, cells: DataFrame, cut: float = 20.0) -> DataFrame:
    """Height map of the substrate: zero inside cells and at heights above the percentile `cut` of the image's background.

    Heights are plane numbers, so that a percentile is taken over as many counts as there are planes. An image without
    background has zeros only.
    """
    keys = [k for k in image_keys(px) if k != "zplane"]
    outside = ~F.coalesce(F.col("mask"), F.lit(False))
    heights = height_map(px).join(cells.select(*keys, *PIXEL, "mask"), [*keys, *PIXEL], "left").withColumn("_out", outside).drop("mask")
    level = heights.filter("_out").groupBy(*keys).agg(F.percentile("height", F.lit(cut / 100)).alias("_top"))
    return heights.join(level, keys, "left").select(
        *keys, *PIXEL, F.when(F.col("_out") & (F.col("height") <= F.col("_top")), F.col("height")).otherwise(F.lit(0)).alias("height"))


def binned_heights(px: DataFrame, bin_size: int) -> DataFrame:
    """Brightest plane of each superpixel: values are averaged over squares of `bin_size` pixels and cut to whole numbers, the
    lowest plane counts among equals. Columns `bin_y` and `bin_x` are the pixel place divided by `bin_size`."""
    keys = [k for k in image_keys(px) if k != "zplane"]
    bins = [F.floor(F.col(c) / bin_size).cast("int").alias(f"bin_{c}") for c in PIXEL]
    means = px.groupBy(*keys, *bins, "zplane").agg(F.floor(F.avg("value")).alias("_v"))
    return means.groupBy(*keys, "bin_y", "bin_x").agg(F.max_by("zplane", F.struct("_v", (-F.col("zplane")).alias("z"))).alias("height"))


def fit_plane(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Least-squares plane ``z = a x + b y + c`` per group from moment sums."""
    def cov(u, v):
        return F.covar_pop(u, v)

    out = points.groupBy(*keys).agg(
        cov("x", "x").alias("_xx"), cov("x", "y").alias("_xy"), cov("y", "y").alias("_yy"),
        cov("x", "z").alias("_xz"), cov("y", "z").alias("_yz"),
        F.avg("x").alias("_x"), F.avg("y").alias("_y"), F.avg("z").alias("_z"))
    det = F.col("_xx") * F.col("_yy") - F.col("_xy") * F.col("_xy")
    out = out.withColumns({
        "a": F.try_divide(F.col("_xz") * F.col("_yy") - F.col("_yz") * F.col("_xy"), det),
        "b": F.try_divide(F.col("_yz") * F.col("_xx") - F.col("_xz") * F.col("_xy"), det)})
    return out.select(*keys, "a", "b", (F.col("_z") - F.col("a") * F.col("_x") - F.col("b") * F.col("_y")).alias("c"))


def height_above_plane(points: DataFrame, planes: DataFrame, keys: Sequence[str]) -> DataFrame:
    return points.join(planes, list(keys)).withColumn(
        "height", F.col("z") - (F.col("a") * F.col("x") + F.col("b") * F.col("y") + F.col("c"))).drop("a", "b", "c")


def interpolate_nearest(grid: DataFrame, points: DataFrame) -> DataFrame:
    """Height of the nearest point at every pixel of the grid."""
    keys = image_keys(grid)
    marks = points.groupBy(*keys, *PIXEL).agg(F.min("height").alias("_h"))
    joined = grid.select(*keys, *PIXEL).join(marks, [*keys, *PIXEL], "left").withColumn("_m", F.col("_h").isNotNull())
    return nearest_marked(joined, "_m", "_h").select(*keys, *PIXEL, F.col("nearest").alias("height"))
