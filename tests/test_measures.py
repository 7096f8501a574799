import math

import numpy as np
import pandas as pd
import pytest
from helpers import disk, noise, to_rows
from pyspark.sql import functions as F

from siteframe.operators import measure as ME


def sample(spark, seed=3):
    mask = disk((24, 24), 11, 12, 8)
    values = noise((24, 24), seed, 250) + 1
    labels = to_rows(spark, mask.astype(np.int32), "label", keep=lambda v: v > 0)
    return mask, values, labels, to_rows(spark, values)


def test_haralick_equals_full_matrices(spark):
    mask, values, labels, px = sample(spark)
    got = ME.measure_haralick(labels, px).first().asDict()
    img = np.where(mask, values, 0)
    grey = np.floor(img * 255 / img.max()).astype(int)
    feats = []
    for dy, dx in ((0, 1), (1, 1), (1, 0), (1, -1)):
        c = np.zeros((256, 256))
        for y, x in zip(*np.nonzero(grey)):
            b, a = y + dy, x + dx
            if 0 <= b < 24 and 0 <= a < 24 and grey[b, a]:
                c[grey[y, x], grey[b, a]] += 1
                c[grey[b, a], grey[y, x]] += 1
        p = c / c.sum()
        i, j = np.mgrid[:256, :256]
        px_ = p.sum(0)
        plus, minus = np.bincount((i + j).ravel(), p.ravel()), np.bincount(np.abs(i - j).ravel(), p.ravel(), 256)
        ent = lambda v: -(v[v > 0] * np.log2(v[v > 0])).sum()
        mu = (px_ * np.arange(256)).sum()
        var = ((np.arange(256) - mu) ** 2 * px_).sum()
        k = np.arange(511)
        hxy, hx = ent(p), ent(px_)
        feats.append([(p ** 2).sum(), ((i - j) ** 2 * p).sum(), ((i * j * p).sum() - mu * mu) / var, var, (p / (1 + (i - j) ** 2)).sum(),
                      (k * plus).sum(), (k * k * plus).sum() - (k * plus).sum() ** 2, ent(plus), hxy, minus.var(), ent(minus),
                      (hxy - 2 * hx) / hx, math.sqrt(max(0, 1 - math.exp(-2 * (2 * hx - hxy))))])
    names = ["angular_second_moment", "contrast", "correlation", "sum_of_squares", "inverse_diff_moment", "sum_avg", "sum_var",
             "sum_entropy", "entropy", "diff_var", "diff_entropy", "info_measure_corr_1", "info_measure_corr_2"]
    for name, want in zip(names, np.mean(feats, axis=0)):
        assert got[name] == pytest.approx(want, rel=1e-8), name


def test_haralick_of_one_pixel_is_nan(spark):
    labels = spark.createDataFrame([(0, 1, 1, 1)], "site_id bigint, y int, x int, label int")
    px = spark.createDataFrame([(0, 1, 1, 9)], "site_id bigint, y int, x int, value int")
    assert math.isnan(ME.measure_haralick(labels, px).first().contrast)


def test_lbp_equals_brute_force(spark):
    mask, values, labels, px = sample(spark)
    got = ME.measure_lbp(labels, px, 1).first().asDict()
    img = np.where(mask, values, 0).astype(float)
    counts, s = {}, math.sqrt(0.5)

    def bilinear(y, x):
        a, b = math.floor(y), math.floor(x)
        fy, fx = y - a, x - b
        return sum(w * img[yy, xx] for yy, wy in ((a, 1 - fy), (a + 1, fy)) for xx, wx in ((b, 1 - fx), (b + 1, fx)) if (w := wy * wx) > 1e-12)

    steps = [(0, 1), (s, s), (1, 0), (s, -s), (0, -1), (-s, -s), (-1, 0), (-s, s)]
    for y, x in zip(*np.nonzero(mask)):
        code = sum(1 << k for k, (dy, dx) in enumerate(steps) if bilinear(y + dy, x + dx) >= img[y, x] - 1e-9)
        code = min(((code >> r) | (code << (8 - r))) & 255 for r in range(8))
        counts[code] = counts.get(code, 0) + 1
    assert len(ME.lbp_codes()) == 36
    assert [got[f"lbp_{i}"] for i in range(36)] == [counts.get(c, 0) for c in ME.lbp_codes()]


def test_full_zernike_equals_direct_sum(spark):
    mask, _, labels, _ = sample(spark)
    got = ME.measure_zernike(labels, 12).first().asDict()
    assert len([c for c in got if c.startswith("zernike")]) == 49
    y, x = np.nonzero(mask)
    v, u = (y - y.mean()) / ((np.ptp(y) + 3) / 2), (x - x.mean()) / ((np.ptp(x) + 3) / 2)
    r, t = np.hypot(u, v), np.arctan2(v, u)
    t, r = t[r <= 1], r[r <= 1]
    for n, m in ((4, 2), (7, 3), (12, 0), (12, 12)):
        radial = sum((-1) ** k * math.factorial(n - k) / (math.factorial(k) * math.factorial((n + m) // 2 - k) * math.factorial((n - m) // 2 - k)) * r ** (n - 2 * k)
                     for k in range((n - m) // 2 + 1))
        assert got[f"zernike_{n}_{m}"] == pytest.approx(abs((radial * np.exp(-1j * m * t)).sum()) * (n + 1) / math.pi / len(y), abs=1e-9)


def test_shape_of_a_square(spark):
    mask = np.zeros((12, 12), bool)
    mask[3:9, 3:9] = True
    labels = to_rows(spark, mask.astype(np.int32), "label", keep=lambda v: v > 0)
    shape = ME.measure_shape(labels, to_rows(spark, mask, "mask")).first()
    assert shape.convexity == pytest.approx(1.0) and shape.maximum_radius == 3.0
    m = ME.measure_morphology(labels).first()
    assert m.area == 36 and m.perimeter == pytest.approx(20.0) and m.extent == 1.0 and m.eccentricity == pytest.approx(0.0, abs=1e-6)


def test_single_pixel_morphology(spark):
    labels = spark.createDataFrame([(0, 4, 4, 1)], "site_id bigint, y int, x int, label int")
    m = ME.measure_morphology(labels).first()
    assert math.isnan(m.circularity) and math.isnan(m.elongation) and m.perimeter == 0


@pytest.mark.parametrize("side, n, copies", [(60, 70, 0), (150, 900, 40), (9, 200, 0)])
def test_points_against_all_pairs(spark, side, n, copies):
    """Few points, several bands of lines, and many points at the same places; negative coordinates as well."""
    rng = np.random.default_rng(1)
    pts = rng.integers(-5, side, (n, 2))
    pts[n - copies:] = pts[0]
    df = spark.createDataFrame([(0, 1, i, int(y), int(x)) for i, (y, x) in enumerate(pts)] + [(0, 2, -1, 3, 3)], "site_id bigint, parent int, point_id bigint, y int, x int")
    d = np.hypot(*(pts[:, None] - pts[None]).transpose(2, 0, 1))
    np.fill_diagonal(d, np.nan)
    got = {r.point_id: r for r in ME.point_distances(df, ["site_id", "parent"]).collect()}
    assert len(got) == n + 1 and math.isnan(got[-1].nearest) and math.isnan(got[-1].mean_distance)
    kth = {r.point_id: r for r in ME.kth_nearest(df, ["site_id", "parent"], [0.1, 1.0]).collect()}
    share = {r.point_id: r for r in ME.neighbour_fractions(df, ["site_id", "parent"], [4.5, 30]).collect()}
    assert -1 not in kth and math.isnan(share[-1].fraction_0)
    for i in range(n):
        assert got[i].nearest == pytest.approx(np.nanmin(d[i])) and got[i].mean_distance == pytest.approx(np.nanmean(d[i]))
        assert got[i].std_distance == pytest.approx(np.nanstd(d[i]), abs=1e-6)
        s = np.sort(d[i])[:n - 1]
        assert kth[i].distance_0 == pytest.approx(s[math.ceil((n - 1) * 0.1) - 1]) and kth[i].distance_1 == pytest.approx(s[-1])
        assert share[i].fraction_0 == pytest.approx((s < 4.5).mean()) and share[i].fraction_1 == pytest.approx((s < 30).mean())


def test_a_crowded_parent(spark):
    """A hundred thousand points in one parent; spot checks against numpy."""
    rng = np.random.default_rng(2)
    pts = rng.integers(0, 1000, (100_000, 2)).astype(np.int64)
    frame = pd.DataFrame({"site_id": 0, "parent": 1, "point_id": np.arange(len(pts)), "y": pts[:, 0].astype(np.int32), "x": pts[:, 1].astype(np.int32)})
    df = spark.createDataFrame(frame)
    keys, few = ["site_id", "parent"], F.col("point_id") % 20_000 == 7
    got = {r.point_id: r for r in ME.point_distances(df, keys).filter(few).collect()}
    kth = {r.point_id: r for r in ME.kth_nearest(df, keys, [0.001, 0.5]).filter(few).collect()}
    share = {r.point_id: r for r in ME.neighbour_fractions(df, keys, [20.0]).filter(few).collect()}
    assert len(got) == len(kth) == len(share) == 5
    for i, r in got.items():
        d = np.delete(np.hypot(*(pts - pts[i]).T), i)
        s = np.sort(d)
        assert r.nearest == pytest.approx(s[0]) and r.mean_distance == pytest.approx(d.mean()) and r.std_distance == pytest.approx(d.std())
        assert kth[i].distance_0 == pytest.approx(s[99]) and kth[i].distance_1 == pytest.approx(s[49_999])
        assert share[i].fraction_0 == pytest.approx((d < 20).mean())


def test_lone_and_outside_points(spark):
    mask = disk((20, 20), 9, 9, 5)
    parents = to_rows(spark, mask.astype(np.int32), "label", keep=lambda v: v > 0)
    pts = spark.createDataFrame([(0, 1, 9, 9), (0, 2, 0, 0)], "site_id bigint, point_id bigint, y int, x int")
    got = {r.point_id: r for r in ME.measure_point_pattern(pts, parents).collect()}
    by, bx = np.nonzero(~mask)
    assert got[1].absolute_distance_to_border == ((by - 9) ** 2 + (bx - 9) ** 2).min()
    assert math.isnan(got[1].absolute_distance_to_nearest_neighbor) and math.isnan(got[2].absolute_distance_to_border)


def test_texture_driver_checks_arguments(spark):
    _, _, labels, px = sample(spark)
    with pytest.raises(ValueError):
        ME.measure_texture(labels, px, frequencies=(0,))
    out = ME.measure_texture(labels, px, (5,), (1,), (1,), 20.0)
    assert out.count() == 1 and "tas_center_0" in out.columns and "haralick_entropy_1" in out.columns


def test_one_hot_pixel_does_not_set_the_scale_of_textures(spark):
    label = np.zeros((320, 320), np.int32)
    label[10:40, 10:40] = 1
    values = noise((320, 320), 4, 200) + 1
    hot = values.copy()
    hot[20, 20] = 2_000
    labels = to_rows(spark, label, "label", keep=lambda v: v > 0)
    plain, clipped, raw = (ME.measure_haralick(labels, to_rows(spark, v), 1, c).first().contrast
                           for v, c in ((values, 99.999), (hot, 99.999), (hot, None)))
    assert abs(clipped - plain) < 0.1 * plain and raw < 0.1 * plain
