import re

import numpy as np
import pytest
from helpers import disk, noise, to_image, to_rows
from pyspark.sql import functions as F

from siteframe.core import cut_lineage
from siteframe.operators import labels as LB
from siteframe.operators import pixels as P
from siteframe.operators import segment as SG
from siteframe.operators import tiles as T
from siteframe.operators import tree as TR


def brute_components(mask, steps):
    out, n = np.zeros(mask.shape, int), 0
    for start in zip(*np.nonzero(mask)):
        if out[start]:
            continue
        n += 1
        out[start], stack = n, [start]
        while stack:
            y, x = stack.pop()
            for dy, dx in steps:
                p = (y + dy, x + dx)
                if 0 <= p[0] < mask.shape[0] and 0 <= p[1] < mask.shape[1] and mask[p] and not out[p]:
                    out[p] = n
                    stack.append(p)
    return out


@pytest.mark.parametrize("n, steps", [(4, SG.CROSS), (8, SG.SQUARE)])
def test_components_of_noise(spark, n, steps):
    mask = noise((40, 37), 11) > 95
    got = to_image(LB.connected_components(to_rows(spark, mask, "mask"), n), mask.shape, "label", int)
    assert np.array_equal(got, brute_components(mask, steps))


def test_components_of_a_spiral(spark):
    mask = np.zeros((21, 21), bool)
    y = x = 0
    dy, dx, mask[0, 0] = 0, 1, True
    for length in [20, 20, 20, 18, 18, 16, 16, 14, 14, 12, 12]:
        for _ in range(length):
            y, x = y + dy, x + dx
            mask[y, x] = True
        dy, dx = dx, -dy
    got = LB.connected_components(to_rows(spark, mask, "mask"), 4)
    assert got.select("label").distinct().count() == 1 and got.count() == mask.sum()


def test_empty_mask_has_no_components(spark):
    assert LB.connected_components(to_rows(spark, np.zeros((4, 4), bool), "mask"), 8).count() == 0
    with pytest.raises(ValueError):
        LB.connected_components(to_rows(spark, np.ones((2, 2), bool), "mask"), 6)


def test_secondary_objects_keep_their_seeds(spark):
    bright = disk((40, 60), 20, 15, 10) | disk((40, 60), 20, 42, 10)
    image = np.where(bright, 180, 5).astype(np.int32)
    seeds = np.where(disk((40, 60), 20, 15, 3), 1, 0) + np.where(disk((40, 60), 20, 42, 3), 2, 0)
    out = SG.segment_secondary(to_rows(spark, seeds.astype(np.int32), "label", keep=lambda v: v > 0), to_rows(spark, image), 50, lower=60, upper=100)
    got = to_image(out, image.shape, "label", int)
    assert set(np.unique(got)) == {0, 1, 2}
    assert (got[seeds == 1] == 1).all() and (got[seeds == 2] == 2).all()
    for k in (1, 2):
        assert (got == k).sum() > 4 * (seeds == k).sum()
    assert not got[~bright].any()


def test_two_overlapping_disks_are_separated(spark):
    mask = disk((40, 60), 20, 20, 12) | disk((40, 60), 20, 38, 12)
    out = SG.separate_clumps(to_rows(spark, mask, "mask"), 50, 100, 5000, 1.0, 0.95)
    assert out.select("label").distinct().count() == 2
    three = disk((40, 80), 20, 20, 12) | disk((40, 80), 20, 38, 12) | disk((40, 80), 20, 56, 12)
    out = SG.separate_clumps(to_rows(spark, three, "mask"), 50, 100, 5000, 1.0, 0.95)
    assert out.select("label").distinct().count() == 3
    single = SG.separate_clumps(to_rows(spark, disk((40, 60), 20, 20, 12), "mask"), 50, 100, 5000, 1.0, 0.9)
    assert single.select("label").distinct().count() == 1


def test_concave_points_lie_at_the_waist(spark):
    mask = disk((40, 60), 20, 20, 12) | disk((40, 60), 20, 38, 12)
    pts = SG.concave_points(to_rows(spark, mask.astype(np.int32), "label", keep=lambda v: v > 0), 2.0).collect()
    assert len(pts) == 2 and all(abs(p.x - 29) <= 2 for p in pts)


def test_blobs_are_found_at_their_centres(spark):
    y, x = np.mgrid[:40, :40]
    image = sum(200 * np.exp(-((y - a) ** 2 + (x - b) ** 2) / 4) for a, b in ((10, 10), (25, 30))).astype(np.int32)
    everywhere = to_rows(spark, np.ones((40, 40), bool), "mask")
    got = SG.flux_centroids(SG.detect_blobs(to_rows(spark, image), everywhere, 5)).collect()
    assert sorted((r.y, r.x) for r in got) == [(10, 10), (25, 30)]


def test_touching_spots_are_told_apart(spark):
    """Two spots that touch, a single one and one whose second bump is too faint."""
    y, x = np.mgrid[:44, :60]
    spot = lambda a, b, v: v * np.exp(-((y - a) ** 2 + (x - b) ** 2) / 6)
    image = (spot(10, 10, 200) + spot(10, 15, 180) + spot(10, 40, 200) + spot(30, 20, 220) + spot(30, 24, 33)).astype(np.int32)
    everywhere = to_rows(spark, np.ones(image.shape, bool), "mask")
    blobs = SG.detect_blobs(to_rows(spark, image), everywhere, 1, mean_area=5, deblend_contrast=0.1)
    got = sorted((r.y, r.x) for r in SG.flux_centroids(blobs).collect())
    assert len(got) == 4 and all(abs(a - c) + abs(b - d) <= 1 for (a, b), (c, d) in zip(got, [(10, 10), (10, 15), (10, 40), (30, 20)]))
    assert SG.detect_blobs(to_rows(spark, image), everywhere, 1, mean_area=5).select("label").distinct().count() == 3
    assert blobs.groupBy("y", "x").count().filter("count > 1").isEmpty()


def test_tree_of_splits():
    """The lowest saddle that nothing goes around comes first; a ring of three joins over its two highest saddles."""
    from siteframe.operators.tree import split_tree
    rows = {r["core"]: (r["nodes"], r["sides"]) for r in split_tree([(1, 2, 9), (2, 3, 5), (1, 3, 4), (3, 4, 7)])}
    assert rows[1][0][0] == rows[4][0][0] and rows[1][1][0] == rows[2][1][0] == 0 and rows[3][1][0] == rows[4][1][0] == 1
    assert rows[1][0][1] == rows[2][0][1] != rows[3][0][1] and [rows[c][1][1] for c in (1, 2, 3, 4)] == [0, 1, 0, 1]


def test_joined_objects_fall_into_their_parts(spark):
    """A chain of four disks, a comb and a lone disk: brute force counts of the parts, and no pixel but of the cuts is lost."""
    mask = np.zeros((70, 120), bool)
    for k in range(4):
        mask |= disk(mask.shape, 15, 15 + 18 * k, 11)
    mask |= disk(mask.shape, 50, 20, 12) | disk(mask.shape, 50, 95, 12)
    mask[46:54, 20:95] = True
    out = SG.separate_clumps(to_rows(spark, mask, "mask"), 50, 100, 5000, 1.0, 0.95)
    got = to_image(out, mask.shape, "label", int)
    assert len(set(np.unique(got[:30])) - {0}) == 4 and not (got > 0)[~mask].any()
    assert mask.sum() - (got > 0).sum() < 0.06 * mask.sum()


def test_deblend_of_a_bent_blob_makes_no_false_objects(spark):
    y, x = np.mgrid[:30, :40]
    peaks = sum(150 * np.exp(-((y - 24) ** 2 + (x - b) ** 2) / 8) for b in (8, 20)) + 20
    bent = ((y >= 20) & (y < 29) & (x >= 2) & (x < 28)) | ((x >= 2) & (x < 6) & (y >= 2) & (y < 29))
    label = np.where(bent, 1, 0).astype(np.int32)
    image = np.where(bent, peaks, 0)
    base = to_rows(spark, label, "label", keep=lambda v: v > 0).join(to_rows(spark, image, "value"), ["site_id", "y", "x"])
    assert SG.deblend(base, 20.0, 8, 0.1).select("label").distinct().count() == 2


def test_deblend_splits_two_bumps_and_keeps_one(spark):
    y, x = np.mgrid[:20, :60]
    bumps = lambda *c: sum(150 * np.exp(-((y - 10) ** 2 + (x - b) ** 2) / 8) for b in c) + 20
    image = np.where((x < 35), bumps(10, 20), bumps(48))
    label = np.where((x >= 4) & (x < 27), 1, np.where((x >= 40) & (x < 56), 2, 0))
    base = to_rows(spark, label.astype(np.int32), "label", keep=lambda v: v > 0).join(to_rows(spark, image.astype(float)), ["site_id", "y", "x"])
    got = to_image(SG.deblend(base, 20.0, 8, 0.1), label.shape, "label", int)
    assert len(set(np.unique(got[label == 1]))) == 2 and len(set(np.unique(got[label == 2]))) == 1
    assert ((got > 0) == (label > 0)).all() and got[10, 10] != got[10, 20]


def test_deblend_plans_from_written_tables(spark):
    """What several steps read is written once; the plan of the result does not repeat the steps before."""
    image = np.full((12, 24), 60.0)
    image[6, 6] = image[6, 12] = 200.0
    base = to_rows(spark, np.ones(image.shape, np.int32), "label").join(to_rows(spark, image), ["site_id", "y", "x"])
    plan = SG.deblend(base, 20.0, 8, 0.1)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") <= 4


def test_spots_in_a_volume(spark):
    z, y, x = np.mgrid[:7, :20, :20]
    vol = (200 * np.exp(-((z - 3) ** 2 + (y - 8) ** 2 + (x - 12) ** 2) / 3)).astype(np.int32)
    rows = [(0, int(a), int(b), int(c), int(v)) for (a, b, c), v in np.ndenumerate(vol)]
    df = spark.createDataFrame(rows, "site_id bigint, zplane int, y int, x int, value int")
    spots = SG.detect_blobs_3d(df, 10.0).collect()
    assert len(spots) == 1 and (round(spots[0].zplane), round(spots[0].y), round(spots[0].x)) == (3, 8, 12)


def test_volume_image_rises_above_the_substrate(spark):
    y, x = np.mgrid[:30, :30]
    beads = [(5, 5, 1), (5, 24, 1), (24, 5, 1), (24, 24, 1), (14, 14, 4)]
    rows = []
    for z in range(6):
        plane = sum(200 * np.exp(-((y - a) ** 2 + (x - b) ** 2) / 3) * np.exp(-(z - h) ** 2) for a, b, h in beads)
        rows += [(0, z, int(i), int(j), int(v)) for (i, j), v in np.ndenumerate(plane)]
    stack = spark.createDataFrame(rows, "site_id bigint, zplane int, y int, x int, value int")
    cells = to_rows(spark, disk((30, 30), 14, 14, 6), "mask")
    got = to_image(SG.generate_volume(stack, cells, 5.0), (30, 30), "height")
    assert got[14, 14] == pytest.approx(3.0) and got[0, 0] == 0


def test_height_image_takes_the_brightest_plane_of_a_superpixel(spark):
    y, x = np.mgrid[:36, :36]
    beads = [(9, 9, 2), (9, 25, 5), (26, 17, 4), (26, 33, 6)]  # the last one lies outside the cells
    rows = []
    for z in range(7):
        plane = 10 + sum(200 * np.exp(-((y - a) ** 2 + (x - b) ** 2) / 3) * np.exp(-(z - h) ** 2) for a, b, h in beads)
        plane += np.where((x >= 30) & (z == 1), 3, 0)  # a substrate
        rows += [(0, z, int(i), int(j), int(v)) for (i, j), v in np.ndenumerate(plane)]
    stack = spark.createDataFrame(rows, "site_id bigint, zplane int, y int, x int, value int")
    inside = x < 30
    cells = to_rows(spark, inside, "mask")
    distance = np.array([np.hypot(y - a, x - b) for a, b, _ in beads[:3]])
    near = np.sort(distance, axis=0)
    clear = inside & (near[1] - near[0] > 2)
    want = np.array([h for *_, h in beads[:3]])[distance.argmin(axis=0)]
    got = to_image(SG.height_image(stack, cells, 5.0), (36, 36), "height")
    assert (got[clear] == want[clear]).all() and (got[~inside] == 0).all()
    ground = to_image(P.background_heights(stack, cells), (36, 36), "height")
    assert (ground[inside] == 0).all() and (ground[:12, 30:] == 1).all() and ground.max() == 1
    over = to_image(SG.height_image(stack, cells, 5.0, above_substrate=True), (36, 36), "height")
    assert (over[clear] == want[clear] - 1).all()
    closed = to_image(SG.height_image(stack, cells, 5.0, close_radius=3), (36, 36), "height")
    assert (closed >= got).all() and (closed > got).any()
    empty = to_image(SG.height_image(stack, cells.withColumn("mask", F.lit(False)), 5.0), (36, 36), "height")
    assert (empty == 0).all()


def test_outlines_and_back(spark):
    label = np.where(disk((30, 30), 14, 15, 9), 1, 0) - np.where(disk((30, 30), 14, 15, 3), 1, 0)
    rows = to_rows(spark, label.astype(np.int32), "label", keep=lambda v: v > 0)
    offsets = spark.createDataFrame([(0, 100, 200)], "site_id bigint, offset_y int, offset_x int")
    out = T.labels_to_polygons(rows, offsets.withColumns({"height": F.lit(30), "width": F.lit(30)}))
    r = out.first()
    assert r.polygon[0] == r.polygon[-1] and len(r.holes) == 1 and all(p.y < 0 and p.x > 200 for p in r.polygon)
    back = to_image(T.polygons_to_labels(out.select("site_id", "label", "polygon"), offsets, 30, 30), (30, 30), "label", int)
    filled = disk((30, 30), 14, 15, 9)
    assert np.abs(back - filled).sum() <= 8 and (back[label == 1] == 1).mean() > 0.96


def test_tiny_objects_become_squares(spark):
    rows = spark.createDataFrame([(0, 5, 5, 1)], "site_id bigint, y int, x int, label int")
    offsets = spark.createDataFrame([(0, 0, 0)], "site_id bigint, offset_y int, offset_x int")
    r = T.labels_to_polygons(rows, offsets.withColumns({"height": F.lit(30), "width": F.lit(30)})).first()
    assert {(p.x, p.y) for p in r.polygon} == {(4.0, -4.0), (6.0, -4.0), (6.0, -6.0), (4.0, -6.0)}


def test_simplify_stays_within_tolerance():
    t = np.linspace(0, 2 * np.pi, 100)
    ring = np.column_stack([30 * np.cos(t), 30 * np.sin(t)])
    ring[-1] = ring[0]
    small = T.simplify_ring(ring, 1.0)
    assert 4 <= len(small) < 40 and (small[0] == small[-1]).all()
    assert len(T.simplify_ring(ring, 1000.0)) >= 4
    assert T.zoom_tolerance(5, 3) == 5


def test_pyramid_keeps_the_mean_of_full_blocks(spark):
    image = noise((8, 8), 4)
    base = to_rows(spark, image).drop("site_id")
    level = T.build_pyramid(base, 2).filter("shrinks = 1")
    want = np.floor(image.reshape(4, 2, 4, 2).sum(axis=(1, 3)) / 4 + 0.5)
    assert np.array_equal(to_image(level, (4, 4)), want)


def test_overlapping_images_lower_right_wins(spark):
    px = to_rows(spark, np.full((4, 4), 1, np.int32)).unionByName(to_rows(spark, np.full((4, 4), 2, np.int32), site=1))
    sites = spark.createDataFrame([(0, 0, 0, 0, 0), (1, 0, 2, 0, 1)], "site_id bigint, offset_y bigint, offset_x bigint, site_y int, site_x int")
    got = to_image(T.build_base_tiles(px, sites), (4, 6))
    assert got[0].tolist() == [1, 1, 2, 2, 2, 2]


def test_expand_and_shrink(spark):
    label = np.where(disk((20, 20), 9, 9, 3), 1, 0).astype(np.int32)
    rows = to_rows(spark, label, "label", keep=lambda v: v > 0)
    grid = to_rows(spark, label)
    big = to_image(LB.expand_or_shrink(rows, 3, grid, 20, 20), label.shape, "label", int)
    py, px = np.nonzero(label)
    want = np.array([[((py - y) ** 2 + (px - x) ** 2).min() < 9 for x in range(20)] for y in range(20)])
    assert np.array_equal(big > 0, want)
    small = LB.expand_or_shrink(rows, -2, grid, 20, 20)
    assert 0 < small.count() < rows.count()
    assert LB.expand_or_shrink(rows, 0, grid, 20, 20) is rows


def test_outlines_of_objects_far_inside_large_images(spark):
    label = np.zeros((120, 90), np.int32)
    label[70:90, 40:60] = 1
    place = spark.createDataFrame([(0, 0, 0, 120, 90)], "site_id bigint, offset_y int, offset_x int, height int, width int")
    ring = T.labels_to_polygons(to_rows(spark, label, "label", keep=lambda v: v > 0), place).first().polygon
    assert {p.x for p in ring} >= {40.0, 59.0} and {p.y for p in ring} >= {-70.0, -89.0}


def test_neighbours_are_those_within_the_distance(spark):
    rng = np.random.default_rng(5)
    label = np.zeros((40, 90), np.int32)
    for k in range(1, 25):
        y, x = rng.integers(0, 36), rng.integers(0, 86)
        label[y:y + 3, x:x + 4] = k
    for distance in (1, 4, 9):
        got = {(r.label, r.neighbour) for r in LB.neighbour_pairs(to_rows(spark, label, "label", keep=lambda v: v > 0), distance).collect()}
        points = {k: np.argwhere(label == k) for k in np.unique(label) if k}
        want = {(a, b) for a in points for b in points if a != b
                and ((points[a][:, None] - points[b][None]) ** 2).sum(2).min() <= distance ** 2}
        assert got == want


def test_requested_tiles_are_filled_up_without_a_row_for_each_place(spark):
    tiles = T.pack_tiles(spark.createDataFrame([(0, 0, 5), (0, 3, 7), (1, 0, None), (255, 255, 9), (300, 1, 4)], "y long, x long, value int"))
    requested = spark.createDataFrame([(0, 0), (0, 0), (2, 0), (None, 1)], "tile_y long, tile_x long")
    out = T.get_tile(tiles, requested)
    got = {(r.tile_y, r.tile_x): r.pixels for r in out.collect()}
    assert set(got) == {(0, 0), (2, 0), (None, 1)} and all(len(v) == T.TILE ** 2 for v in got.values())
    assert {i: v for i, v in enumerate(got[0, 0]) if v} == {0: 5, 3: 7, T.TILE ** 2 - 1: 9} and not any(got[2, 0]) and not any(got[None, 1])
    assert "Generate" not in out._jdf.queryExecution().executedPlan().toString()


def dealt_by(df):
    return re.findall(r"hashpartitioning\(([^)]*)\)", df._jdf.queryExecution().executedPlan().toString())


def test_polygons_are_dealt_out_before_they_are_filled(spark):
    """The later polygon of a site wins, and no pixel is shuffled."""
    square = lambda x0, y0, x1, y1: [(float(x), float(-y)) for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0))]
    rows = [(s, k, square(k, s % 3, k + 3, s % 3 + 2)) for s in range(5) for k in (1, 2)]
    segments = spark.createDataFrame(rows, "site_id bigint, label int, polygon array<struct<x:double,y:double>>")
    offsets = spark.createDataFrame([(s, 0, 0) for s in range(5)], "site_id bigint, offset_y int, offset_x int")
    out = T.polygons_to_labels(segments, offsets, 20, 20)
    assert all(re.fullmatch(r"site_id#\d+L, \d+", e) for e in dealt_by(out))
    got = {(r.site_id, r.y, r.x): r.label for r in out.collect()}
    assert got == {(s, y, x): max(k for k in (1, 2) if k <= x <= k + 3) for s in range(5) for y in range(s % 3, s % 3 + 3) for x in range(1, 6)}


def test_map_pixels_come_as_lines(spark):
    """Image lines are shuffled whole; missing and repeated places and nulls keep their values."""
    rows = [(0, 0, 0, 1), (0, 0, 1, 2), (0, 0, 3, 4), (0, 1, 2, 5), (0, 1, 2, 6), (1, 0, 0, 7), (1, 0, 1, 8), (1, 0, 2, None), (2, 0, 5, 9)]
    px = spark.createDataFrame(rows, "site_id bigint, y int, x int, value int")
    sites = spark.createDataFrame([(0, 0, 0, 0, 0), (1, 0, 2, 0, 1)], "site_id bigint, offset_y int, offset_x int, site_y int, site_x int")
    out = T.build_base_tiles(px, sites)
    assert not any(re.search(r"\bx#", e) for e in dealt_by(out))
    assert {(r.y, r.x): r.value for r in out.collect()} == {(0, 0): 1, (0, 1): 2, (0, 2): 7, (0, 3): 8, (0, 4): None, (1, 2): 6}


def test_pixels_are_not_dealt_out_by_layer(spark):
    """Bounds of layers come to the pixels; a layer without bounds has no tiles."""
    px = spark.createDataFrame([(0, c, 0, x, 10 + x) for c in range(3) for x in range(4)], "site_id bigint, channel_id int, y int, x int, value int")
    sites = spark.createDataFrame([(0, 0, 0, 0, 0)], "site_id bigint, offset_y int, offset_x int, site_y int, site_x int")
    bounds = px.filter("channel_id < 2").groupBy("channel_id").agg((F.min("channel_id") * 10).alias("min_intensity"), (F.max("channel_id") * 10 + 256).alias("max_intensity"))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = T.build_base_tiles(px, sites, bounds=bounds)
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert "BroadcastHashJoin [channel_id" in plan
    assert {(r.channel_id, r.y, r.x): r.value for r in out.collect()} == {(c, 0, x): 10 + x - 10 * c for c in range(2) for x in range(4)}


def test_tables_between_steps_are_dealt_out_by_site(spark):
    """Steps that follow a written table join its pixels where they are."""
    px = to_rows(spark, noise((6, 6), 2), "height").unionByName(to_rows(spark, noise((5, 7), 4), "height", site=1))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        written = TR.neighbouring(cut_lineage(px), ["site_id"])
        found = dealt_by(written)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert found and all(re.fullmatch(r"site_id#\d+L, \d+", e) for e in found)
    assert sorted(written.collect()) == sorted(TR.neighbouring(px, ["site_id"]).collect())
