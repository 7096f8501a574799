import re
from functools import reduce

import numpy as np
import pytest
from helpers import disk, noise, to_image, to_rows
from pyspark.sql import functions as F

from siteframe.catalog.images import moved_pixels, stack
from siteframe.domain import Domain
from siteframe.operators import distance as D
from siteframe.operators import labels as LB
from siteframe.operators import measure as ME
from siteframe.operators import pixels as P
from siteframe.operators import stencil as ST


def windows(image, r):
    wide = np.pad(image.astype(float), r, "symmetric")
    return np.lib.stride_tricks.sliding_window_view(wide, (2 * r + 1, 2 * r + 1))


@pytest.mark.parametrize("name, fn", [("average", lambda w: np.floor(w.mean(axis=(2, 3)) + 1e-12)),
                                      ("median", lambda w: np.median(w, axis=(2, 3)))])
def test_filters_on_images_taller_than_a_strip(spark, name, fn):
    image = noise((150, 9))
    got = to_image(P.smooth(to_rows(spark, image), name, 5), image.shape)
    assert np.array_equal(got, fn(windows(image, 2)))


def test_gaussian_and_convolution_equal_brute_force(spark):
    image = noise((70, 12), 3)
    w = np.array(ST.gaussian_weights(1.0))
    want = np.floor((windows(image, 4) * np.outer(w, w)).sum(axis=(2, 3)) + 1e-9)
    assert np.abs(to_image(P.smooth(to_rows(spark, image), "gaussian", 1), image.shape) - want).max() <= 1
    kernel = np.array(ST.log_kernel(5, 1.3))
    assert abs(kernel.sum()) < 1e-12
    got = to_image(ST.convolve(to_rows(spark, image), kernel.tolist()), image.shape, "filtered")
    assert np.allclose(got, (windows(image, 2) * kernel).sum(axis=(2, 3)))


def test_bilateral_keeps_edges(spark):
    image = np.where(np.arange(20) < 10, 0, 200) * np.ones((20, 1), int)
    got = to_image(P.smooth(to_rows(spark, image.astype(np.int32)), "bilateral", 2), image.shape)
    assert np.array_equal(got, image)


def test_crosscorr_threshold(spark):
    image = noise((20, 20), 1)
    out = P.threshold_adaptive(to_rows(spark, image), "crosscorr", 5, 2, lower=20, upper=190)
    mask = to_image(out, image.shape, "mask", bool)
    assert not mask[image < 20].any() and mask[image > 190].all()
    with pytest.raises(ValueError):
        P.threshold_adaptive(to_rows(spark, image), "crosscorr", 4)


def test_distance_transform_equals_brute_force(spark):
    mask = disk((75, 40), 40, 20, 17) & ~disk((75, 40), 35, 18, 3)
    got = to_image(D.distance_transform(to_rows(spark, mask, "mask")), mask.shape, "distance")
    by, bx = np.nonzero(~mask)
    want = np.zeros(mask.shape)
    for y, x in zip(*np.nonzero(mask)):
        want[y, x] = np.sqrt(((by - y) ** 2 + (bx - x) ** 2).min())
    assert np.allclose(got, want)


def test_sparse_neighbourhood_sees_past_missing_pixels(spark):
    df = spark.createDataFrame([(0, 0, 0, 1), (0, 1, 1, 2), (0, 3, 1, 3)], "site_id bigint, y int, x int, value int")
    hood = ST.neighbourhood(df, 2, F.col("value"), sparse=True)
    got = {(r.y, r.x): r.hood for r in hood.collect()}
    assert got[1, 1][1][1] == 1 and got[1, 1][4][2] == 3 and got[3, 1][0][2] == 2 and got[0, 0][3][3] == 2


def test_illumination_zeros(spark):
    px = spark.createDataFrame([(0, 0, 0, 0), (0, 0, 1, 100), (1, 0, 0, 100), (1, 0, 1, 100)], "site_id bigint, y int, x int, value int")
    stats = {r.x: r for r in P.illumination_stats(px).collect()}
    assert stats[0].mean == pytest.approx(1.0) and stats[0]["std"] == pytest.approx(np.sqrt(2)) and stats[1]["std"] == 0.0
    got = {(r.site_id, r.x): r.value for r in P.correct_illumination(px, P.illumination_stats(px)).collect()}
    z = (2 - 1) / np.sqrt(2)
    assert got[1, 0] == int(10 ** (z * np.sqrt(2) / 2 + 1.5))
    assert got[1, 1] == int(10 ** 1.5) and got[0, 0] == 0


def test_correction_does_not_deal_pixels_by_channel(spark):
    """All pixels of a channel would meet in one task; each channel keeps its own mean level."""
    rows = [(s, c, 0, x, 10 + 7 * s * (c + 1) + 31 * x) for s in range(4) for c in range(2) for x in range(3)]
    px = spark.createDataFrame(rows, "site_id bigint, channel_id int, y int, x int, value int")
    out = P.correct_illumination(px, P.illumination_stats(px))
    assert not re.search(r"hashpartitioning\(channel_id#\d+, \d+\)", out._jdf.queryExecution().executedPlan().toString())
    got = {(r.site_id, r.channel_id, r.x): r.value for r in out.collect()}
    for c in range(2):
        one = px.filter(F.col("channel_id") == c).drop("channel_id")
        alone = P.correct_illumination(one, P.illumination_stats(one)).collect()
        assert len(alone) == 12 and all(got[r.site_id, c, r.x] == r.value for r in alone)


def test_illumination_percentiles_at_all_places(spark):
    """Images of two sizes, with nulls and a second channel, against numpy at 10^5 places."""
    rng = np.random.default_rng(3)
    images = {(s, c): rng.integers(0, 40 * (c + 1), (5 + s % 2, 7)) for s in range(5) for c in range(2)}
    rows = [(s, c, y, x, int(v)) for (s, c), image in images.items() for (y, x), v in np.ndenumerate(image)] + [(0, 0, 9, 9, None), (9, 1, 0, 0, None)]
    px = spark.createDataFrame(rows, "site_id bigint, channel_id int, y int, x int, value int")
    got = P.illumination_percentiles(px).toPandas()
    assert len(got) == 2 * 10 ** 5 and len(set(zip(got["channel_id"], got["q"]))) == len(got)
    q = np.linspace(0, 100, 10 ** 5)
    for c in range(2):
        want = np.floor(np.mean([np.percentile(images[s, c], q) for s in range(5)], axis=0) + 1e-9)
        one = got[got["channel_id"] == c].sort_values("q")
        assert np.allclose(one["q"], np.round(q, 3)) and np.array_equal(one["value"], want)
    few = {(r.channel_id, r.q): r.value for r in P.illumination_percentiles(px, [0, 33.3, 100]).collect()}
    assert len(few) == 6 and few[1, 33.3] == int(np.mean([np.percentile(images[s, 1], 33.3) for s in range(5)]))


def test_shift_residues_and_crop(spark):
    shifts = spark.createDataFrame([(0, 0, 3, -1), (0, 1, -2, 4), (0, 2, 0, 0)], "site_id bigint, cycle_id int, y int, x int")
    r = P.overlap(shifts).first()
    assert (r.top_residue, r.bottom_residue, r.left_residue, r.right_residue) == (3, 2, 4, 1)
    image = np.arange(100).reshape(10, 10).astype(np.int32)
    out = P.align(to_rows(spark, image, cycle_id=1), shifts, P.overlap(shifts), True)
    want = image[5:10, 0:5]
    assert np.array_equal(to_image(out, (5, 5)), want)


def test_register_far_finds_large_shifts(spark):
    base = noise((40, 40), 5)
    ref = to_rows(spark, base)
    target = to_rows(spark, np.roll(base, (9, -12), (0, 1)))
    r = P.register_far(target, ref).first()
    assert (r.y, r.x) == (-9, 12)


def blurred(shape, seed):
    image = noise(shape, seed, 4000).astype(float)
    for axis in (0, 1):
        image = sum(np.roll(image, k, axis) * np.exp(-k * k / 32) for k in range(-12, 13))
    return (255 * (image - image.min()) / np.ptp(image)).astype(np.int32)


def moved(base, shape, dy, dx, seed):
    """Cuts of one scene: the second one is brought onto the first one by (dy, dx)."""
    m = (base.shape[0] - shape[0]) // 2
    ref, target = (base[m + a:m + a + shape[0], m + b:m + b + shape[1]] for a, b in ((0, 0), (dy, dx)))
    return ref, target + noise(shape, seed, 9)


def test_register_coarse_to_fine_finds_what_the_full_search_finds(spark):
    shape, top, refs, targets, want = (80, 72), 20, [], [], {}
    for site, (dy, dx) in enumerate([(0, 0), (17, -20), (-3, 11), (-20, 20), (1, -2)]):
        ref, target = moved(blurred((140, 140), site), shape, dy, dx, site)
        refs.append(to_rows(spark, ref, site=site))
        targets.append(to_rows(spark, target, site=site, cycle_id=1, keep=lambda v: v % 50 != 7))  # with holes
        errors = []
        for a in range(-top, top + 1):
            for b in range(-top, top + 1):
                r = ref[max(0, a):shape[0] + min(0, a), max(0, b):shape[1] + min(0, b)]
                t = target[max(0, -a):shape[0] + min(0, -a), max(0, -b):shape[1] + min(0, -b)]
                there = t % 50 != 7
                errors.append((float(((r - t)[there] ** 2).mean()), abs(a) + abs(b), a, b))
        want[site] = min(errors)
        assert want[site][2:] == (dy, dx)
    one = [reduce(lambda a, b: a.unionByName(b), x) for x in (targets, refs)]
    got = {r.site_id: r for r in P.register_coarse_to_fine(*one, top).collect()}
    assert {k: (r.y, r.x) for k, r in got.items()} == {k: w[2:] for k, w in want.items()}
    assert all(r.error == pytest.approx(want[k][0]) for k, r in got.items())


def test_register_coarse_to_fine_over_a_hundred_pixels(spark):
    ref, target = moved(blurred((460, 460), 9), (240, 240), -100, 93, 1)
    r = P.register_coarse_to_fine(to_rows(spark, target, cycle_id=1), to_rows(spark, ref), 100).collect()
    assert [(x.y, x.x) for x in r] == [(-100, 93)]
    assert P.register_coarse_to_fine(to_rows(spark, target, cycle_id=1).filter("false"), to_rows(spark, ref[:4, :4]), 100).isEmpty()


def test_mixture_level_lies_between_the_classes(spark):
    image = np.where(disk((40, 40), 20, 20, 12), 150, 20).astype(np.int32) + noise((40, 40), 2, 10)
    assert 25 < P.threshold_global(to_rows(spark, image), "MoG").first().level < 155


def test_place_pad_and_concat(spark):
    a = np.ones((3, 4), np.int32)
    assert to_image(P.place(to_rows(spark, a), to_rows(spark, a[:1, :2] * 7), 1, 1), a.shape)[1].tolist() == [1, 7, 7, 1]
    padded = P.pad(to_rows(spark, a), 2, "bottom")
    assert padded.count() == 20 and padded.filter("y > 2").agg(F.sum("value")).first()[0] == 0
    assert to_image(P.concat(to_rows(spark, a), to_rows(spark, a * 2), "x"), (3, 8)).sum() == 36
    with pytest.raises(ValueError):
        P.pad(to_rows(spark, a), 1, "middle")


def test_plane_fit_is_exact(spark):
    y, x = np.mgrid[:5, :6]
    df = to_rows(spark, (0.5 * x - 2 * y + 3).astype(float), "z")
    r = P.fit_plane(df, ["site_id"]).first()
    assert (r.a, r.b, r.c) == pytest.approx((0.5, -2, 3))


def test_alignment_keeps_images_of_any_size(spark):
    image = noise((70, 100))
    shifts = spark.createDataFrame([(0, 1, 0, 0)], "site_id bigint, cycle_id int, y int, x int")
    out = P.align(to_rows(spark, image, cycle_id=1), shifts, P.overlap(shifts), True)
    assert np.array_equal(to_image(out, image.shape), image)


def exchanges(df):
    """Columns by which a plan deals rows out."""
    return re.findall(r"hashpartitioning\(([^)]*)\)", df._jdf.queryExecution().executedPlan().toString())


@pytest.fixture(scope="module")
def many_sites(spark, tmp_path_factory):
    """Enough sites for several tasks."""
    folder = str(tmp_path_factory.mktemp("sites"))
    spark.range(1, 301).selectExpr("id AS s_suppkey").write.parquet(f"{folder}/supplier.parquet")
    return Domain(spark, folder)


def test_channels_are_combined_in_place(spark, many_sites):
    d = many_sites
    assert d.spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "false"
    assert all(re.fullmatch(r"s_suppkey#\d+L, \d+", e) for e in exchanges(P.combine_channels(d.pixels(), d.pixels2(), 2, 1)))


def by_pixel(df):
    """Exchanges that deal out pixel by pixel."""
    return [e for e in exchanges(df) if re.search(r"\by#", e) and re.search(r"\bx#", e)]


IN_PLACE = {
    "background_heights": lambda d: P.background_heights(stack(d), d.pixels().select("site_id", "y", "x", F.expr("x < 20").alias("mask"))),
    "threshold_per_object": lambda d: P.threshold_level(d.pixels2(), "Background", "PerObject", d.labels(), lower=20),
    "shrink_objects": lambda d: LB.shrink_objects(d.labels(), 1, d.pixels()),
    "register_cycles": lambda d: P.register(moved_pixels(d), d.pixels(), 2),
    "register_cycles_far": lambda d: P.register_coarse_to_fine(moved_pixels(d), d.pixels(), 20),
    "measure_haralick": lambda d: ME.measure_haralick(d.labels(), d.pixels2()),
    "measure_lbp": lambda d: ME.measure_lbp(d.labels(), d.pixels2()),
    "measure_tas": lambda d: ME.measure_tas(d.labels(), d.pixels2(), 50),
    "measure_texture": lambda d: ME.measure_texture(d.labels(), d.pixels2(), (1,), threshold=50),
}


@pytest.mark.parametrize("name", IN_PLACE)
def test_pixels_of_an_image_meet_where_they_are(many_sites, name):
    assert not by_pixel(IN_PLACE[name](many_sites))
