"""Exact Euclidean distance to, and identity of, the nearest marked pixel."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siteframe.core import image_keys

STRIP = 32


def nearest_marked(px: DataFrame, marked: str, payload: str, within: tuple[str, ...] = ()) -> DataFrame:
    """Squared distance to the nearest marked pixel of the image and its payload.

    `px` has a row for every pixel. The column pass looks for the nearest mark
    above and below with windows that end at an image column. The row pass then
    needs single image rows only; strips of rows are the groups that numpy sees,
    never whole images. Among equally near marks the smallest payload wins.
    With `within`, only marks that share these columns are looked at.
    """
    keys = [*image_keys(px), *within]
    col = Window.partitionBy(*keys, "x").orderBy("y")
    mark = F.when(F.col(marked), F.struct(F.col("y").alias("y"), F.col(payload).cast("double").alias("p")))
    above = F.last(mark, ignorenulls=True).over(col.rowsBetween(Window.unboundedPreceding, 0))
    # Looking down is looking up in reverse order; a frame that grows is cheap, one that shrinks is not.
    upward = Window.partitionBy(*keys, "x").orderBy(F.desc("y")).rowsBetween(Window.unboundedPreceding, 0)
    below = F.last(mark, ignorenulls=True).over(upward)
    found = px.withColumns({"_a": above, "_b": below})
    da, db = F.col("y") - F.col("_a.y"), F.col("_b.y") - F.col("y")
    best = F.least(F.struct((da * da).alias("d"), F.col("_a.p").alias("p")),
                   F.struct((db * db).alias("d"), F.col("_b.p").alias("p")))
    pick = F.when(F.col("_a").isNull(), F.struct((db * db).alias("d"), F.col("_b.p").alias("p"))).when(
        F.col("_b").isNull(), F.struct((da * da).alias("d"), F.col("_a.p").alias("p"))).otherwise(best)
    columns = (found.withColumn("_g", pick).withColumn("strip", F.expr(f"y DIV {STRIP}"))
               .select(*keys, "strip", "y", "x", F.col("_g.d").cast("double").alias("g"),
                       F.col("_g.p").alias("p")))
    types = {f.name: f.dataType.simpleString() for f in px.schema.fields}
    image = image_keys(px)
    schema = ", ".join([f"{k} {types[k]}" for k in keys] + ["y int", "x int", "distance2 double", "nearest double"])

    def rows(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        done = []
        for name, part in pdf.groupby(list(within), sort=False) if within else [((), pdf)]:
            d2, payloads, ys, xs = _row_pass(part)
            out = pd.DataFrame({"y": ys, "x": xs, "distance2": d2, "nearest": payloads})
            for column, value in zip(keys, (*key[:-1], *name)):
                out[column] = value
            done.append(out)
        return pd.concat(done)[[*keys, "y", "x", "distance2", "nearest"]]

    return columns.groupBy(*image, "strip").applyInPandas(rows, schema)


def _row_pass(pdf: pd.DataFrame):
    """Smallest column distance plus squared horizontal offset for every pixel of
    a few image rows; stops once no larger offset can improve any pixel."""
    y0, x0 = pdf["y"].min(), pdf["x"].min()
    y, x = (pdf["y"] - y0).to_numpy(), (pdf["x"] - x0).to_numpy()
    g = np.full((y.max() + 1, x.max() + 1), np.inf)
    p = np.full(g.shape, np.inf)
    g[y, x] = pdf["g"].fillna(np.inf)
    p[y, x] = pdf["p"].fillna(np.inf)
    best, owner = g.copy(), p.copy()
    for k in range(1, g.shape[1]):
        if k * k > best.max():
            break
        for there, here in ((np.s_[:, k:], np.s_[:, :-k]), (np.s_[:, :-k], np.s_[:, k:])):
            trial, name = g[there] + k * k, p[there]
            better = (trial < best[here]) | ((trial == best[here]) & (name < owner[here]))
            best[here] = np.where(better, trial, best[here])
            owner[here] = np.where(better, name, owner[here])
    found = np.isfinite(best[y, x])
    return (np.where(found, best[y, x], np.nan), np.where(found, owner[y, x], np.nan),
            pdf["y"].to_numpy(), pdf["x"].to_numpy())


def distance_transform(mask: DataFrame) -> DataFrame:
    """Distance of every set pixel to the nearest unset one; zero on unset pixels
    and null where an image has no unset pixel."""
    marked = mask.withColumns({"_bg": ~F.col("mask"), "_p": F.lit(0)})
    return nearest_marked(marked, "_bg", "_p").select(
        *image_keys(mask), "y", "x", F.sqrt(F.nullif(F.col("distance2"), F.lit(float("nan")))).alias("distance"))
