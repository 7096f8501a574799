"""Conversions between numpy images and pixel rows."""

import numpy as np


def to_rows(spark, image, name="value", site=0, keep=None, **keys):
    rows = []
    for (y, x), v in np.ndenumerate(image):
        if keep is None or keep(v):
            rows.append((site, *keys.values(), int(y), int(x), v.item()))
    kind = {"b": "boolean", "i": "int", "f": "double", "u": "int"}[image.dtype.kind]
    schema = ", ".join(["site_id bigint", *[f"{k} int" for k in keys], "y int", "x int", f"{name} {kind}"])
    return spark.createDataFrame(rows, schema)


def to_image(df, shape, name="value", dtype=float):
    out = np.zeros(shape, dtype)
    for r in df.select("y", "x", name).collect():
        out[r.y, r.x] = r[name]
    return out


def disk(shape, cy, cx, r):
    y, x = np.mgrid[:shape[0], :shape[1]]
    return (y - cy) ** 2 + (x - cx) ** 2 <= r * r


def noise(shape, seed=0, top=200):
    return np.random.default_rng(seed).integers(0, top, shape).astype(np.int32)
