"""Local filters on strips of image lines.

Filters that need every value of a neighbourhood (medians, weighted sums with
mirrored borders) run in numpy on strips: each image is cut into strips of lines,
the lines within reach of a strip are handed to it as well, and Spark groups by
image and strip. A group is a few dozen lines of one image and never a whole one
when images are large; all pixels are shuffled once.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteframe.core import image_keys

LINES = 64


def strip_filter(px: DataFrame, reach: int, fn: Callable[[np.ndarray], Mapping[str, np.ndarray]],
                 columns: str, value: str = "value", border: str = "symmetric") -> DataFrame:
    """Apply `fn` to every strip, enlarged by `reach` pixels on all sides.

    `fn` gets the enlarged strip and returns arrays of the size of the strip for
    the new `columns`. Places outside the image are mirrored, or NaN with
    ``border="nan"``. Images have a row for every pixel.
    """
    keys = image_keys(px)
    types = {f.name: f.dataType.simpleString() for f in px.schema.fields}
    kept = [c for c in px.columns if c not in (*keys, "y", "x")]
    names = [c.strip().split(" ")[0] for c in columns.split(",")]
    schema = ", ".join([f"{c} {types[c]}" for c in (*keys, "y", "x", *kept)] + [columns])

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        y, x = pdf["y"].to_numpy(), pdf["x"].to_numpy()
        if y.max() < int(key[-1]) * LINES:  # beyond the image, borrowed lines only
            return pd.DataFrame({c: [] for c in (*keys, "y", "x", *kept, *names)})
        y0, x0 = int(y.min()), int(x.min())
        image = np.full((int(y.max()) - y0 + 1, int(x.max()) - x0 + 1), np.nan)
        image[y - y0, x - x0] = pdf[value].to_numpy(float)
        first, last = int(key[-1]) * LINES, min(int(key[-1]) * LINES + LINES - 1, int(y.max()))
        # Lines are missing beyond a strip only where the image ends.
        above, below = reach - max(first - y0, 0), reach - max(int(y.max()) - last, 0)
        pads = ((max(above, 0), max(below, 0)), (reach, reach))
        wide = np.pad(image, pads, "symmetric") if border == "symmetric" else np.pad(
            image, pads, "constant", constant_values=np.nan)
        found = fn(wide)
        own = (y >= first) & (y <= last)
        out = pdf.loc[own, ["y", "x", *kept]].copy()
        for name, k in zip(keys, key):
            out[name] = k
        for name in names:
            out[name] = found[name][y[own] - first, x[own] - x0]
        return out[[*keys, "y", "x", *kept, *names]]

    strips = F.explode(F.sequence(F.expr(f"greatest(y - {reach}, 0) DIV {LINES}"), F.expr(f"(y + {reach}) DIV {LINES}")))
    return px.withColumn("_strip", strips).groupBy(*keys, "_strip").applyInPandas(run, schema)


def windows(wide: np.ndarray, reach: int) -> np.ndarray:
    """View of the square neighbourhood of each pixel of the strip."""
    return np.lib.stride_tricks.sliding_window_view(wide, (2 * reach + 1, 2 * reach + 1))


def weighted(wide: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """Weighted sum of each neighbourhood, summed in reading order of the kernel."""
    k = kernel.shape[0]
    h, w = wide.shape[0] - k + 1, wide.shape[1] - k + 1
    total = np.zeros((h, w))
    for i in range(k):
        for j in range(k):
            if kernel[i, j]:
                total += kernel[i, j] * wide[i:i + h, j:j + w]
    return total


def separable(wide: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Weighted sums along lines, then along columns."""
    n = len(weights)
    w, h = wide.shape[1] - n + 1, wide.shape[0] - n + 1
    rows = sum(weights[j] * wide[:, j:j + w] for j in range(n))
    return sum(weights[i] * rows[i:i + h] for i in range(n))


def box_sums(wide: np.ndarray, reach: int) -> np.ndarray:
    """Sum of each square neighbourhood from a table of running sums."""
    n = 2 * reach + 1
    table = np.zeros((wide.shape[0] + 1, wide.shape[1] + 1))
    table[1:, 1:] = wide.cumsum(0).cumsum(1)
    return table[n:, n:] - table[:-n, n:] - table[n:, :-n] + table[:-n, :-n]
