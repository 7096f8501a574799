import math

import pytest
from pyspark.sql import functions as F

from siteframe.config import ExperimentConfig
from siteframe.functions import geometry as G
from siteframe.functions import scalars as S
from siteframe.operators import aggregates as A
from siteframe.operators import layout as L
from siteframe.operators import mutate as M
from siteframe.operators import relational as R
from siteframe.sources import files as SF


def one(df):
    return df.first()[0]


def test_unknown_position_is_an_error(domain):
    with pytest.raises(ValueError, match="unknown plate_name"):
        R.filter_sites(domain.sites(), domain.wells(), domain.plates(), "plate99")
    with pytest.raises(ValueError, match="plate cannot"):
        R.filter_sites(domain.sites(), domain.wells(), domain.plates(), well_name="A01", ref_type="Plate")
    with pytest.raises(ValueError, match="well cannot"):
        R.filter_sites(domain.sites(), domain.wells(), domain.plates(), well_pos_y=0, ref_type="Well")


def test_unknown_feature_is_an_error(domain):
    with pytest.raises(ValueError, match="unknown features"):
        R.resolve_features(domain.features(), domain.types(), "Cells", ["nope"])


def test_align_measurements_first_missing_and_unknown(spark):
    labels = spark.createDataFrame([(1,), (2,), (3,)], "label int")
    measured = spark.createDataFrame([(1, 0, 10.0), (1, 1, 11.0), (3, 2, 30.0), (9, 3, 90.0)], "label int, pos int, v double")
    got = {r.label: r.v for r in R.align_measurements(labels, measured, ["label"], "pos").collect()}
    assert got[1] == 10.0 and math.isnan(got[2]) and got[3] == 30.0 and len(got) == 3


def test_missing_elements_across_buckets(spark):
    df = spark.createDataFrame([(0,), (3,), (70000,), (70001,)], "n bigint")
    found = R.missing_elements(df, [], "n")
    assert found.count() == 69998 and found.filter("n IN (0, 3, 70000, 70001)").count() == 0


def test_natural_order(spark):
    names = spark.createDataFrame([("a10",), ("a2",), ("b1",)], "name string")
    assert [r.name for r in names.orderBy(R.natural_key("name")).collect()] == ["a2", "a10", "b1"]
    long = spark.createDataFrame([("a12345678901234567899",), ("a12345678901234567891",), ("a0007",), ("a12",)], "name string")
    assert [r.name for r in long.orderBy(R.natural_key("name")).collect()] == ["a0007", "a12", "a12345678901234567891", "a12345678901234567899"]


def test_pair_cycles_needs_images_in_every_cycle(spark):
    images = spark.createDataFrame([(1, 0, 0, "dapi"), (2, 0, 1, "gfp")], "image_id int, site_id int, cycle_id int, wavelength string")
    with pytest.raises(ValueError, match="no images"):
        R.pair_cycles(images, 0, "dapi")


def test_upsert_map_new_wins(spark):
    old = spark.createDataFrame([(1, {"a": 1.0, "b": 2.0})], "id int, values map<string,double>")
    new = spark.createDataFrame([(1, {"b": 5.0, "c": 6.0}), (2, {"a": 9.0})], "id int, values map<string,double>")
    got = {r.id: r["values"] for r in M.upsert_map(old, new, ["id"], "values").collect()}
    assert got == {1: {"a": 1.0, "b": 5.0, "c": 6.0}, 2: {"a": 9.0}}


def test_upload_of_unknown_label_is_an_error(spark):
    segs = spark.createDataFrame([(1, 100, 0, 1)], "partition_key bigint, mapobject_id bigint, tpoint int, label int")
    up = spark.createDataFrame([(1, 2, 0.5)], "site_id bigint, label int, f double")
    with pytest.raises(ValueError, match="no object"):
        M.ingest_feature_values(up, segs, 0, {"f": "1"})


def test_write_table_round_trip(spark, domain, tmp_path):
    M.write_table(domain.cells(), str(tmp_path / "cells"), buckets=4)
    back = spark.read.parquet(str(tmp_path / "cells"))
    assert back.count() == domain.cells().count() and back.select("bucket").distinct().count() == 4


def test_reset_outputs_keeps_schema(domain):
    out = M.reset_outputs({"a": domain.cells(), "b": domain.plates()}, ["a"])
    assert out["a"].count() == 0 and out["a"].schema == domain.cells().schema and out["b"].count() > 0


def test_aggregate_of_no_children_is_nan(spark):
    parents = spark.createDataFrame([(0, 1), (0, 2)], "site_id bigint, parent int")
    assignment = spark.createDataFrame([(0, 5, 1), (0, 6, 1)], "site_id bigint, child int, parent int")
    children = spark.createDataFrame([(0, 5, 1.0), (0, 6, float("nan"))], "site_id bigint, child int, f double")
    got = {r.parent: r for r in A.extract_aggregate(parents, assignment, children, ["site_id"], ["f"]).collect()}
    assert got[1].Count == 2 and got[1].Mean_f == 1.0 and got[1].Sum_f == 1.0
    assert got[2].Count == 0 and math.isnan(got[2].Sum_f) and math.isnan(got[2].Mean_f)


# Known results for mosaic sizes.
@pytest.mark.parametrize("n, axis, rows, cols", [(1, "vertical", 1, 1), (2, "vertical", 2, 1), (2, "horizontal", 1, 2),
                                                 (3, "vertical", 3, 1), (3, "horizontal", 1, 3), (4, "vertical", 2, 2),
                                                 (4, "horizontal", 2, 2)])
def test_guess_grid(spark, n, axis, rows, cols):
    g = one(spark.createDataFrame([(n,)], "n int").select(L.guess_grid("n", axis)))
    assert (g.n_rows, g.n_cols) == (rows, cols)


def test_guess_grid_matches_search(spark):
    rows = spark.range(1, 80).select(F.col("id").cast("int").alias("n")).select("n", L.guess_grid("n").alias("g")).collect()
    for r in rows:
        limit = 4 if r.n < 4 else 2 * int(math.sqrt(r.n))
        best = min((a * b, a != b, a, b) for a in range(1, limit + 1) for b in range(a, limit + 1) if a * b >= r.n)
        assert (r.g.n_rows, r.g.n_cols) == (best[3], best[2]), r.n


def test_layout_names_are_checked():
    with pytest.raises(ValueError):
        L.layout_coordinate("i", "r", "c", "spiral")


def test_positions_with_jitter(spark):
    p = spark.createDataFrame([("A01", 0.0, 0.4), ("A01", 0.6, 1000.0), ("A01", 1000.2, 0.0), ("A01", 999.9, 1000.7)],
                              "well_name string, stage_y double, stage_x double")
    got = sorted((r.grid_y, r.grid_x) for r in L.grid_from_positions(p, tolerance=2.0).collect())
    assert got == [(0, 0), (0, 1), (1, 0), (1, 1)]


def test_pyramid_has_at_least_two_levels(spark):
    layer = spark.createDataFrame([(100, 90)], "height bigint, width bigint")
    levels = L.pyramid_levels(layer, ExperimentConfig()).orderBy("z").collect()
    assert [(r.level_height, r.level_width) for r in levels] == [(50, 45), (100, 90)]


def test_file_name_fields(spark):
    names = spark.createDataFrame([("p_A02_T0003F004L01A01Z05C06.png",)], "name string")
    r = SF.parse_file_names(names, S.IMAGE_PATTERNS["cellvoyager"]).first()
    assert (r.well_name, r.tpoint, r.site, r.zplane, r.channel) == ("A02", 3, 4, 5, "C06")
    meta = SF.parse_file_names(spark.createDataFrame([("x_B03_s7.tif",)], "name string"), S.IMAGE_PATTERNS["metamorph"]).first()
    assert (meta.well_name, meta.site, meta.channel, meta.zplane) == ("B03", 7, "1", 0)
    with pytest.raises(ValueError, match="does not match"):
        SF.parse_file_names(spark.createDataFrame([("junk",)], "name string"), S.IMAGE_PATTERNS["cellvoyager"])
    with pytest.raises(ValueError, match="unknown fields"):
        S.group_numbers("(?P<q>a)")


def test_list_files_reads_names_only(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(b"x")
    assert [r.name for r in SF.list_files(spark, str(tmp_path)).collect()] == ["a.png"]


def test_feature_names():
    assert S.stored_name("Intensity", "mean", "DNA") == "Intensity_mean_DNA"
    with pytest.raises(ValueError):
        S.stored_name("a b", "c")


def ring(*points):
    return F.array(*[G.point(F.lit(x), F.lit(y)) for x, y in points])


SQUARE = ((4, 0), (0, 0), (0, 4), (4, 4), (4, 0))
ELL = ((0, 0), (6, 0), (6, 2), (2, 2), (2, 6), (0, 6), (0, 0))
BOW = ((0, 0), (4, 4), (4, 0), (0, 4), (0, 0))


def test_polygon_predicates(spark):
    row = spark.range(1).select(
        G.ring_is_valid(ring(*SQUARE)).alias("square"), G.ring_is_valid(ring(*ELL)).alias("ell"),
        G.ring_is_valid(ring(*BOW)).alias("bow"), G.ring_is_valid(ring(*SQUARE[:-1])).alias("open"),
        G.point_in_ring(ring(*ELL), F.lit(1.0), F.lit(5.0)).alias("in_arm"), G.point_in_ring(ring(*ELL), F.lit(4.0), F.lit(4.0)).alias("in_notch"),
        G.ring_area(ring(*ELL)).alias("area"),
        G.ring_intersects_box(ring(*ELL), F.lit(3), F.lit(3), F.lit(5), F.lit(5)).alias("box_in_notch"),
        G.ring_intersects_box(ring(*ELL), F.lit(1), F.lit(1), F.lit(2), F.lit(2)).alias("box_inside"),
        G.ring_intersects_box(ring(*SQUARE), F.lit(-5), F.lit(1), F.lit(9), F.lit(2)).alias("box_across")).first()
    assert row.square and row.ell and not row.bow and not row.open
    assert row.in_arm and not row.in_notch and row.area == 20.0
    assert not row.box_in_notch and row.box_inside and row.box_across


def test_ids_of_objects_with_large_keys_are_dense(spark):
    rows = [(10**9 + s, t, z, label) for s in range(3) for t in range(2) for z in range(2) for label in (1, 2)]
    labels = spark.createDataFrame(rows * 2, "site_id bigint, tpoint int, zplane int, label int")
    existing = spark.createDataFrame([(10**9, 0, 0, 1, 40)], "site_id bigint, tpoint int, zplane int, label int, mapobject_id bigint")
    got = M.assign_object_ids(labels, existing, ["site_id", "tpoint", "zplane"]).collect()
    assert sorted(r.mapobject_id for r in got) == list(range(40, 40 + len(rows)))


def test_layouts_of_oblong_grids(spark):
    for rows, cols in ((2, 4), (4, 2), (3, 3), (1, 4), (4, 1)):
        for layout in ("horizontal", "zigzag_horizontal", "vertical", "zigzag_vertical"):
            base = spark.createDataFrame([("A", i, rows, cols) for i in range(rows * cols)], "well_name string, site_index int, r int, c int")
            y, x = L.layout_coordinate("site_index", "r", "c", layout)
            found = L.detect_layout(base.withColumns({"stage_y": y * 10.0, "stage_x": x * 10.0})).first()
            assert (found.n_rows, found.n_cols) == (rows, cols)
            if min(rows, cols) > 1:
                assert found.layout == layout
    lost = spark.createDataFrame([("A", 0, 0.0, 0.0), ("A", 1, 10.0, 10.0), ("A", 2, 0.0, 10.0), ("A", 3, 10.0, 0.0)],
                                 "well_name string, site_index int, stage_y double, stage_x double")
    with pytest.raises(Exception, match="layout"):
        L.detect_layout(lost).collect()
