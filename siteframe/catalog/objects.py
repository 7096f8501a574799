"""Queries over objects, features and positions."""

from pyspark.sql import functions as F

from siteframe.catalog import query
from siteframe.operators import aggregates as A
from siteframe.operators import mutate as M
from siteframe.operators import relational as R

CELL = {"1": "f1", "2": "f2"}
SPOT = {"3": "f3", "4": "f4", "5": "f5", "6": "f6"}
NAN = "CAST('NaN' AS DOUBLE)"


# --- projections and filters --------------------------------------------------

@query("select_features", "SELECT mapobject_id, tpoint, f3, f6 FROM d_spot_values")
def _(d):
    v = R.select_features(d.spot_values(), [3, 6])
    return v.select("mapobject_id", "tpoint", F.col("values")["3"].alias("f3"), F.col("values")["6"].alias("f6"))


@query("drop_feature", """SELECT mapobject_id, CAST(NULL AS DOUBLE) AS f1, f2, 1 AS n_left
    FROM d_cell_values""")
def _(d):
    v = R.drop_feature(d.cell_values(), 1)
    return v.select("mapobject_id", F.col("values")["1"].alias("f1"), F.col("values")["2"].alias("f2"),
                    F.size("values").alias("n_left"))


@query("rename_features", """SELECT mapobject_id, f1 AS intensity, f2 AS area,
    'Intensity_mean_DNA,Morphology_Area' AS names FROM d_cell_values""")
def _(d):
    v = R.rename_features(d.cell_values(), d.features())
    return v.select("mapobject_id", F.col("values")["Intensity_mean_DNA"].alias("intensity"),
                    F.col("values")["Morphology_Area"].alias("area"),
                    F.array_join(F.array_sort(F.map_keys("values")), ",").alias("names"))


@query("filter_sites", """SELECT site_id, plate_name, well_name, site_y, site_x
    FROM d_sites JOIN d_wells USING (well_id) JOIN d_plates USING (plate_id)
    WHERE plate_name = 'plate01' AND well_name = 'A02' AND site_y = 1""")
def _(d):
    plate = d.wells().filter("well_name = 'A02'").join(d.plates(), "plate_id").select("plate_name")
    assert not plate.isEmpty()
    return R.filter_sites(d.sites(), d.wells(), d.plates(), "plate01", "A02", 1).select(
        "site_id", "plate_name", "well_name", "site_y", "site_x")


@query("filter_wells", """SELECT well_id, plate_name, well_name FROM d_wells
    JOIN d_plates USING (plate_id) WHERE plate_name = 'plate02'""")
def _(d):
    return R.filter_wells(d.wells(), d.plates(), "plate02").select("well_id", "plate_name", "well_name")


@query("filter_plates", "SELECT * FROM d_plates WHERE plate_name = 'plate03'")
def _(d):
    return R.filter_plates(d.plates(), "plate03")


@query("filter_layers", """SELECT segmentation_layer_id, count(*) AS n FROM d_segmentations
    WHERE tpoint = 1 AND zplane = 0 GROUP BY 1""")
def _(d):
    layers = R.filter_layers(d.layers().join(d.types(), "mapobject_type_id"), 1, 0, "Cells")
    return (d.segmentations().join(layers.select("segmentation_layer_id"), "segmentation_layer_id")
            .groupBy("segmentation_layer_id").agg(F.count(F.lit(1)).alias("n")))


@query("list_channels", "SELECT DISTINCT event_type AS channel_name FROM events")
def _(d):
    names = d.table("events").select(F.col("event_type").alias("channel_name")).distinct()
    return R.list_dimension(names, "channel_name")


@query("filter_ids", """SELECT mapobject_id, f1 FROM d_cell_values WHERE mapobject_id IN
    (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)""")
def _(d):
    ids = d.table("lineitem").filter("l_quantity > 45").select(F.col("l_orderkey").alias("mapobject_id"))
    return R.feature_matrix(R.filter_ids(d.cell_values(), ids), CELL).select("mapobject_id", "f1")


@query("finite_values", "SELECT mapobject_id, f6 FROM d_spot_values WHERE NOT isnan(f6)")
def _(d):
    return R.feature_matrix(d.spot_values(), SPOT).filter(R.finite("f6")).select("mapobject_id", "f6")


@query("drop_omitted_sites", "SELECT site_id, well_id FROM d_sites WHERE NOT omitted")
def _(d):
    return R.drop_omitted(d.sites()).select("site_id", "well_id")


# --- joins ---------------------------------------------------------------------

@query("site_hierarchy", """SELECT site_id, site_y, site_x, well_name, plate_name
    FROM d_sites JOIN d_wells USING (well_id) JOIN d_plates USING (plate_id)""")
def _(d):
    return R.site_hierarchy(d.sites(), d.wells(), d.plates()).select(
        "site_id", "site_y", "site_x", "well_name", "plate_name")


@query("site_jobs", """SELECT site_id, site_y, site_x, well_name, plate_name FROM d_sites
    JOIN d_wells USING (well_id) JOIN d_plates USING (plate_id) WHERE NOT omitted
    ORDER BY plate_name, well_name, site_y, site_x""")
def _(d):
    sites = R.site_hierarchy(R.drop_omitted(d.sites()), d.wells(), d.plates())
    return R.ordered(sites.select("site_id", "site_y", "site_x", "well_name", "plate_name"),
                     ["plate_name", "well_name", "site_y", "site_x"])


@query("resolve_features", """SELECT feature_id, feature_name, count(*) AS n_values
    FROM d_features JOIN d_types USING (mapobject_type_id), d_spot_values WHERE type_name = 'Spots' GROUP BY ALL""")
def _(d):
    wanted = R.resolve_features(d.features(), d.types(), "Spots")
    found = d.spot_values().select(F.explode(F.map_keys("values")).alias("key")).groupBy("key").agg(
        F.count(F.lit(1)).alias("n_values"))
    return wanted.join(found, wanted.feature_id.cast("string") == found.key).select(
        "feature_id", "feature_name", "n_values")


@query("load_feature_values", """SELECT partition_key, id AS mapobject_id, tpoint, f3, f4, f5, f6
    FROM d_spots JOIN d_spot_values USING (partition_key) WHERE id = mapobject_id""")
def _(d):
    v = R.load_feature_values(d.spots(), d.spot_values())
    return R.feature_matrix(v, SPOT).select("partition_key", "mapobject_id", "tpoint", *SPOT.values())


@query("objects_at_position", """SELECT id AS mapobject_id, site_id, label, s.tpoint FROM d_cells c
    JOIN d_segmentations s ON c.partition_key = s.partition_key AND c.id = s.mapobject_id
    JOIN d_sites ON site_id = c.partition_key JOIN d_wells USING (well_id) JOIN d_plates USING (plate_id)
    WHERE plate_name = 'plate01' AND segmentation_layer_id IN (10, 11)""")
def _(d):
    sites = R.filter_sites(d.sites(), d.wells(), d.plates(), "plate01")
    return R.objects_at_position(d.objects(), d.segmentations(), sites, 1, [10, 11]).select(
        "mapobject_id", F.col("partition_key").alias("site_id"), "label", "tpoint").orderBy("mapobject_id")


@query("feature_values_per_site", """SELECT partition_key, mapobject_id, tpoint, f1, f2 FROM d_cell_values""")
def _(d):
    v = R.feature_values_per_site(d.objects(), d.feature_values(), 1)
    return R.feature_matrix(v, CELL).select("partition_key", "mapobject_id", "tpoint", "f1", "f2")


_LABEL_VALUES = """SELECT partition_key, mapobject_id, tpoint, CAST(mapobject_id % 4 AS DOUBLE) AS label_value
    FROM d_cell_values"""


def label_values(d):
    """Labels that a classification result 7 stored for cells."""
    return d.cell_values().select("partition_key", "mapobject_id", "tpoint", F.create_map(
        F.lit("7"), (F.col("mapobject_id") % 4).cast("double")).alias("values"))


@query("label_values_per_site", _LABEL_VALUES)
def _(d):
    v = R.feature_values_per_site(d.objects(), label_values(d), 1)
    return v.select("partition_key", "mapobject_id", "tpoint", F.col("values")["7"].alias("label_value"))


@query("segmentation_polygons_per_site", """SELECT partition_key, mapobject_id, tpoint,
    concat_ws(',', x0||' '||y0, x1||' '||y0, x1||' '||y1, x0||' '||y1, x0||' '||y0) AS outline
    FROM d_segmentations""")
def _(d):
    return R.segmentations_per_site(d.objects(), d.segmentations(), 1).select(
        "partition_key", "mapobject_id", "tpoint", "outline")


@query("segmentation_points_per_site", """SELECT partition_key, mapobject_id, tpoint,
    ((x0 + x1) // 2)||' '||((y0 + y1) // 2) AS outline FROM d_segmentations""")
def _(d):
    return R.segmentations_per_site(d.objects(), d.segmentations(), 1, False).select(
        "partition_key", "mapobject_id", "tpoint", "outline")


@query("object_info", """SELECT c.id AS mapobject_id, type_name, site_id, site_y, site_x, well_name, plate_name,
      segmentation_layer_id, label FROM d_cells c JOIN d_types USING (mapobject_type_id)
    LEFT JOIN d_sites ON site_id = c.partition_key LEFT JOIN d_wells USING (well_id)
    LEFT JOIN d_plates USING (plate_id)
    LEFT JOIN d_segmentations s ON s.partition_key = c.partition_key AND s.mapobject_id = c.id
    WHERE c.id IN (SELECT l_orderkey FROM lineitem WHERE l_discount = 0.05)""")
def _(d):
    ids = (d.table("lineitem").filter("l_discount = 0.05")
           .select(F.col("l_orderkey").alias("mapobject_id")).distinct())
    return R.object_info(ids, d.objects(), d.types(), d.sites(), d.wells(), d.plates(),
                         d.segmentations()).select(
        "mapobject_id", "type_name", F.col("partition_key").alias("site_id"), "site_y", "site_x",
        "well_name", "plate_name", "segmentation_layer_id", "label")


@query("objects_missing_segmentation", """SELECT partition_key, id FROM d_cells
    WHERE id NOT IN (SELECT mapobject_id FROM d_segmentations)""")
def _(d):
    return R.objects_missing_segmentation(d.cells(), d.segmentations()).select("partition_key", "id")


@query("objects_missing_features", """SELECT partition_key, id FROM d_objects
    WHERE mapobject_type_id = 1 AND id NOT IN (SELECT mapobject_id FROM d_cell_values)""")
def _(d):
    # Values of spots are held back: a type without any values is not checked.
    return R.objects_missing_features(d.objects(), d.cell_values()).select("partition_key", "id")


@query("linked_objects", """SELECT s.id, s.ref_id, c.partition_key AS ref_partition_key, 1 AS ref_type_id
    FROM d_spots s JOIN d_cells c ON s.ref_id = c.id""")
def _(d):
    return R.linked_objects(d.objects()).select("id", "ref_id", "ref_partition_key", "ref_type_id")


@query("site_neighbours", """SELECT s.site_id, u.site_id AS upper_id, l.site_id AS left_id,
      ul.site_id AS upper_left_id, lo.site_id IS NOT NULL AS has_lower, r.site_id IS NOT NULL AS has_right
    FROM d_sites s
    LEFT JOIN d_sites u ON u.well_id = s.well_id AND u.site_y = s.site_y - 1 AND u.site_x = s.site_x AND NOT u.omitted
    LEFT JOIN d_sites l ON l.well_id = s.well_id AND l.site_y = s.site_y AND l.site_x = s.site_x - 1 AND NOT l.omitted
    LEFT JOIN d_sites ul ON ul.well_id = s.well_id AND ul.site_y = s.site_y - 1 AND ul.site_x = s.site_x - 1
      AND NOT ul.omitted
    LEFT JOIN d_sites lo ON lo.well_id = s.well_id AND lo.site_y = s.site_y + 1 AND lo.site_x = s.site_x
    LEFT JOIN d_sites r ON r.well_id = s.well_id AND r.site_y = s.site_y AND r.site_x = s.site_x + 1""")
def _(d):
    return R.site_neighbours(d.sites()).select("site_id", "upper_id", "left_id", "upper_left_id",
                                               "has_lower", "has_right")


def images(d):
    """Image files: two channels in two cycles per supplier site."""
    return (d.table("supplier").select(F.col("s_suppkey").alias("site_id"))
            .withColumn("channel_id", F.explode(F.sequence(F.lit(0), F.lit(1))))
            .withColumn("cycle_id", F.explode(F.sequence(F.lit(0), F.lit(1))))
            .selectExpr("site_id * 4 + channel_id * 2 + cycle_id AS image_id", "site_id", "channel_id",
                        "cycle_id", "if(channel_id = 0, 'dapi', 'gfp') AS wavelength",
                        "CAST(site_id % 10 AS INT) AS tpoint", "0 AS zplane", "16 AS bit_depth"))


IMAGES = """SELECT s_suppkey * 4 + ch * 2 + cy AS image_id, s_suppkey AS site_id, ch AS channel_id,
      cy AS cycle_id, CASE WHEN ch = 0 THEN 'dapi' ELSE 'gfp' END AS wavelength,
      CAST(s_suppkey % 10 AS INTEGER) AS tpoint, 0 AS zplane
    FROM supplier, (SELECT unnest([0, 1]) AS ch), (SELECT unnest([0, 1]) AS cy)"""


@query("pair_cycles", f"""WITH i AS ({IMAGES})
    SELECT t.site_id, t.cycle_id, t.image_id AS target_image_id, r.image_id AS reference_image_id
    FROM i t JOIN i r ON t.site_id = r.site_id AND t.wavelength = 'dapi' AND r.wavelength = 'dapi'
    AND r.cycle_id = 0""")
def _(d):
    return R.pair_cycles(images(d), 0, "dapi").select("site_id", "cycle_id", "target_image_id",
                                                      "reference_image_id")


@query("align_measurements", f"""WITH m AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS v,
      row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_extendedprice) AS r
      FROM lineitem WHERE l_quantity > 30)
    SELECT o_orderkey AS label, coalesce(v, {NAN}) AS v FROM orders
    LEFT JOIN m ON l_orderkey = o_orderkey AND r = 1""")
def _(d):
    labels = d.table("orders").select(F.col("o_orderkey").alias("label"))
    measured = d.table("lineitem").filter("l_quantity > 30").selectExpr(
        "l_orderkey AS label", "struct(l_linenumber, l_extendedprice) AS place", "l_extendedprice AS v")
    return R.align_measurements(labels, measured, ["label"], "place")


# --- aggregations --------------------------------------------------------------

@query("feature_extrema", """SELECT '3' AS feature_id, min(f3) AS minimum, max(f3) AS maximum FROM d_spot_values
    UNION ALL SELECT '6', min(f6), max(f6) FROM d_spot_values WHERE NOT isnan(f6)""")
def _(d):
    return A.feature_extrema(d.spot_values(), [3, 6])


@query("null_counts", """SELECT 'f3' AS feature, count(*) FILTER (isnan(f3)) AS n_null FROM d_spot_values
    UNION ALL SELECT 'f6', count(*) FILTER (isnan(f6)) FROM d_spot_values""")
def _(d):
    return A.null_counts(R.feature_matrix(d.spot_values(), SPOT), ["f3", "f6"])


@query("ids_by_partition", """SELECT partition_key, id // 10000 AS part, count(*) AS n, min(id) AS first_id,
    max(id) AS last_id FROM d_cells GROUP BY ALL""")
def _(d):
    return A.ids_by_partition(d.cells()).select(
        "partition_key", "part", F.size("ids").cast("long").alias("n"), F.get("ids", F.lit(0)).alias("first_id"),
        F.array_max("ids").alias("last_id"))


@query("count_by_type", """SELECT 1 AS mapobject_type_id, count(*) AS n_objects FROM d_cell_values
    UNION ALL SELECT 2, count(*) FROM d_spot_values""")
def _(d):
    return A.count_by_type(d.objects(), d.feature_values())


@query("extract_aggregate", f"""WITH v AS (SELECT s.ref_id AS parent, v.f4, v.f6 FROM d_spots s
      JOIN d_spot_values v ON s.id = v.mapobject_id AND s.partition_key = v.partition_key WHERE v.f3 > 60)
    SELECT c.partition_key AS site_id, c.id AS parent, count(v.parent) AS "Count",
      CASE WHEN count(v.parent) = 0 THEN {NAN} ELSE round(avg(f4), 4) END AS "Mean_f4",
      CASE WHEN count(v.parent) = 0 THEN {NAN} ELSE round(stddev_pop(f4), 4) END AS "Std_f4",
      CASE WHEN count(v.parent) = 0 THEN {NAN} ELSE round(sum(f4), 4) END AS "Sum_f4",
      coalesce(round(avg(f6) FILTER (NOT isnan(f6)), 6), {NAN}) AS "Mean_f6",
      CASE WHEN count(v.parent) = 0 THEN {NAN} ELSE coalesce(round(sum(f6) FILTER (NOT isnan(f6)), 6), 0) END AS "Sum_f6",
      coalesce(round(stddev_pop(f6) FILTER (NOT isnan(f6)) + 3e-7, 4), {NAN}) AS "Std_f6"
    FROM d_cells c LEFT JOIN v ON v.parent = c.id GROUP BY c.partition_key, c.id""")
def _(d):
    children = (R.feature_matrix(d.spot_values(), SPOT).filter("f3 > 60")
                .selectExpr("partition_key AS site_id", "mapobject_id AS child", "f4", "f6"))
    assignment = d.spots().selectExpr("partition_key AS site_id", "id AS child", "ref_id AS parent")
    parents = d.cells().selectExpr("partition_key AS site_id", "id AS parent")
    out = A.extract_aggregate(parents, assignment.join(children, ["site_id", "child"], "left_semi"),
                              children, ["site_id"], ["f4", "f6"])
    return out.select("site_id", "parent", "Count", *[F.round(c, 4).alias(c) for c in ("Mean_f4", "Std_f4", "Sum_f4")],
                      F.round("Mean_f6", 6).alias("Mean_f6"), F.round("Sum_f6", 6).alias("Sum_f6"), F.round(F.col("Std_f6") + 3e-7, 4).alias("Std_f6"))


@query("labels_without_features", """SELECT s.partition_key AS site_id, s.id AS child, s.ref_id AS parent
    FROM d_spots s LEFT JOIN d_spot_values v ON s.id = v.mapobject_id AND v.f3 > 10 WHERE v.mapobject_id IS NULL""")
def _(d):
    children = (R.feature_matrix(d.spot_values(), SPOT).filter("f3 > 10")
                .selectExpr("partition_key AS site_id", "mapobject_id AS child"))
    assignment = d.spots().selectExpr("partition_key AS site_id", "id AS child", "ref_id AS parent")
    return A.labels_without_features(assignment, children, ["site_id"])


@query("images_per_site_check", f"""WITH i AS ({IMAGES}) SELECT n, count(*) AS n_groups
    FROM (SELECT site_id, count(*) AS n FROM i GROUP BY 1) GROUP BY 1""")
def _(d):
    return A.group_size_variants(images(d), "site_id")


@query("wells_per_plate_check", """SELECT n, count(*) AS n_groups
    FROM (SELECT plate_id, count(*) AS n FROM d_wells GROUP BY 1) GROUP BY 1""")
def _(d):
    A.check_equal_sizes(d.wells(), "plate_id", "plates must have the same number of wells")
    return A.group_size_variants(d.wells(), "plate_id")


@query("distinct_plane_values", """SELECT string_agg(DISTINCT CAST(tpoint AS VARCHAR), ',' ORDER BY CAST(tpoint AS VARCHAR)) AS tpoint,
    string_agg(DISTINCT CAST(zplane AS VARCHAR), ',' ORDER BY CAST(zplane AS VARCHAR)) AS zplane,
    string_agg(DISTINCT CAST(bit_depth AS VARCHAR), ',') AS bit_depth FROM d_planes""")
def _(d):
    A.check_single_bit_depth(d.planes())
    return A.distinct_values(d.planes(), ["tpoint", "zplane", "bit_depth"])


@query("sites_per_well_check", """SELECT n_sites, count(*) AS n_groups FROM (
    SELECT well_name, channel_name, zplane, tpoint, count(DISTINCT (stage_y, stage_x)) AS n_sites
    FROM d_planes GROUP BY ALL) GROUP BY 1""")
def _(d):
    return A.sites_per_well(d.planes())


@query("feature_matrix", """SELECT mapobject_id, tpoint, f3 AS "Intensity_max_RNA", f6 AS "Morphology_Elongation"
    FROM d_spot_values""")
def _(d):
    return R.feature_matrix(d.spot_values(), {"3": "Intensity_max_RNA", "6": "Morphology_Elongation"}
                            ).drop("partition_key")


@query("feature_histogram", """SELECT tpoint, CAST(least(floor((f1 - 0) / (500000.0 / 50)), 49) AS INTEGER) AS bin,
    count(*) AS n FROM d_cell_values WHERE f1 BETWEEN 0 AND 500000 GROUP BY ALL""")
def _(d):
    return A.histogram(R.feature_matrix(d.cell_values(), CELL), "f1", 0, 500000, 50, ["tpoint"])


@query("intensity_histogram", """SELECT CAST(least(floor(value / (256.0 / 64)), 63) AS INTEGER) AS bin, count(*) AS n
    FROM d_pixels WHERE value BETWEEN 0 AND 256 GROUP BY ALL""")
def _(d):
    return A.histogram(d.pixels(), "value", 0, 256, 64)


@query("occupancy_image", "SELECT site_id, y, x, count(*) AS n FROM d_points GROUP BY ALL")
def _(d):
    return A.occupancy(d.points(), ["site_id"])


# --- ordering, sampling, sets -----------------------------------------------------

@query("ordered_objects", "SELECT partition_key, id FROM d_cells ORDER BY id")
def _(d):
    return R.ordered(d.cells().select("partition_key", "id"), ["id"])


@query("sample_objects", """SELECT id, mapobject_type_id FROM d_objects ORDER BY md5('3:' || id), id LIMIT 1000""")
def _(d):
    return R.sample_objects(d.objects(), 1000, seed=3).select("id", "mapobject_type_id")


@query("natural_sort_key", r"""WITH p AS (SELECT DISTINCT name FROM d_files)
    SELECT name, array_to_string(list_transform(regexp_extract_all(name, '(\d+|\D+)'), lambda p: CASE WHEN regexp_matches(p, '^\d')
      THEN lpad(length(regexp_replace(p, '^0+(.)', '\1'))::VARCHAR, 10, '0') || regexp_replace(p, '^0+(.)', '\1') ELSE p END), '') AS sort_key FROM p""")
def _(d):
    return d.files().select("name").distinct().select("name", R.natural_key("name").alias("sort_key"))


@query("top_labels_per_group", """SELECT site_id, label, area FROM (SELECT *, row_number() OVER (
    PARTITION BY site_id ORDER BY area DESC, label) AS r FROM (
      SELECT site_id, label, count(*) AS area FROM d_labels GROUP BY ALL)) WHERE r <= 2""")
def _(d):
    areas = d.labels().groupBy("site_id", "label").agg(F.count(F.lit(1)).alias("area"))
    return R.top_k_per_group(areas, ["site_id"], "area", "label", 2)


@query("linspace_sample", """WITH r AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS pos, count(*) OVER () AS n
    FROM d_cells) SELECT id FROM r JOIN (SELECT unnest(generate_series(0, 99)) AS i) ON pos = i * n // 100""")
def _(d):
    return R.linspace_sample(d.cells().select("id"), 100, "id")


@query("latest_results", """SELECT event_type AS name, max(event_id) AS submission_id,
    arg_max(user_id, event_id) AS user_id FROM events GROUP BY 1""")
def _(d):
    results = d.table("events").selectExpr("event_type AS name", "event_id AS submission_id", "user_id")
    return R.latest_results(results)


@query("missing_elements", """WITH r AS (SELECT o_custkey, min(o_orderkey) AS a, max(o_orderkey) AS b FROM orders
      GROUP BY 1), g AS (SELECT o_custkey, unnest(generate_series(a, b)) AS o_orderkey FROM r)
    SELECT o_custkey % 50 AS bucket, count(*) AS n_missing, CAST(sum(g.o_orderkey) AS BIGINT) AS total FROM g
    LEFT JOIN orders o USING (o_custkey, o_orderkey) WHERE o.o_totalprice IS NULL
    GROUP BY 1""")
def _(d):
    present = d.table("orders").select("o_custkey", "o_orderkey")
    return (R.missing_elements(present, ["o_custkey"], "o_orderkey")
            .groupBy((F.col("o_custkey") % 50).alias("bucket"))
            .agg(F.count(F.lit(1)).alias("n_missing"), F.sum("o_orderkey").alias("total")))


@query("invalid_objects", """SELECT id FROM d_cells WHERE id NOT IN (SELECT mapobject_id FROM d_segmentations)
    OR id NOT IN (SELECT mapobject_id FROM d_cell_values)""")
def _(d):
    return R.invalid_objects(R.objects_missing_segmentation(d.cells(), d.segmentations()).select("id"),
                             R.objects_missing_features(d.cells(), d.cell_values()).select("id"))


@query("concat_measurements", """SELECT partition_key, mapobject_id, f1, f2, area FROM d_cell_values
    FULL JOIN (SELECT partition_key, mapobject_id, (x1 - x0) * (y1 - y0) AS area FROM d_segmentations)
    USING (partition_key, mapobject_id)""")
def _(d):
    a = R.feature_matrix(d.cell_values(), CELL).drop("tpoint")
    b = d.segmentations().selectExpr("partition_key", "mapobject_id", "(x1 - x0) * (y1 - y0) AS area")
    return R.concat_measurements([a, b], ["partition_key", "mapobject_id"])


# --- exports ---------------------------------------------------------------------

@query("export_feature_values", f"""SELECT s.mapobject_id, plate_name, well_name, site_y, site_x, s.tpoint, s.label,
      coalesce(f1, {NAN}) AS "Intensity_mean_DNA", coalesce(f2, {NAN}) AS "Morphology_Area"
    FROM d_segmentations s JOIN d_sites ON site_id = s.partition_key JOIN d_wells USING (well_id)
    JOIN d_plates USING (plate_id) LEFT JOIN d_cell_values v ON v.partition_key = s.partition_key
      AND v.mapobject_id = s.mapobject_id AND v.tpoint = s.tpoint""")
def _(d):
    return M.export_feature_values(
        d.cells(), d.segmentations(), d.cell_values(), R.site_hierarchy(d.sites(), d.wells(), d.plates()),
        {"1": "Intensity_mean_DNA", "2": "Morphology_Area"}).select(
        "mapobject_id", "plate_name", "well_name", "site_y", "site_x", "tpoint", "label",
        "Intensity_mean_DNA", "Morphology_Area")


@query("export_object_metadata", """SELECT s.mapobject_id, plate_name, well_name, site_y AS well_pos_y, site_x AS well_pos_x,
      s.tpoint, zplane, label, CAST(x0 = 0 OR y0 = 0 OR x1 = 63 OR y1 = 63 AS INTEGER) AS is_border,
      CAST(CAST(CASE WHEN v.mapobject_id IS NULL THEN NULL ELSE s.mapobject_id % 4 END AS DOUBLE) AS VARCHAR) AS "Classification"
    FROM d_segmentations s JOIN d_sites ON site_id = s.partition_key JOIN d_wells USING (well_id)
    JOIN d_plates USING (plate_id) LEFT JOIN d_cell_values v ON v.partition_key = s.partition_key
      AND v.mapobject_id = s.mapobject_id AND v.tpoint = s.tpoint""")
def _(d):
    return M.export_object_metadata(
        d.segmentations(), R.site_hierarchy(d.sites(), d.wells(), d.plates()), label_values(d),
        {"7": "Classification"})


# --- upserts and deletions ---------------------------------------------------------

@query("upsert_map", """SELECT coalesce(a.mapobject_id, b.k) AS mapobject_id, a.f1 AS v1, coalesce(b.v, a.f2) AS v2, b.w AS v9
    FROM d_cell_values a FULL JOIN (SELECT l_orderkey AS k, sum(l_quantity) AS v, CAST(count(*) AS DOUBLE) AS w
      FROM lineitem WHERE l_quantity > 40 GROUP BY 1) b ON a.mapobject_id = b.k""")
def _(d):
    updates = (d.table("lineitem").filter("l_quantity > 40").groupBy(F.col("l_orderkey").alias("mapobject_id"))
               .agg(F.create_map(F.lit("2"), F.sum("l_quantity"), F.lit("9"),
                                 F.count(F.lit(1)).cast("double")).alias("values")))
    out = M.upsert_map(d.cell_values().select("mapobject_id", "values"), updates, ["mapobject_id"], "values")
    return out.select("mapobject_id", *[F.col("values")[k].alias(f"v{k}") for k in "129"])


@query("upsert_replace", """SELECT partition_key, mapobject_id, x0, y0 FROM d_segmentations
      WHERE mapobject_id % 7 <> 0
    UNION ALL SELECT o_custkey, o_orderkey, -1, -1 FROM orders WHERE o_orderkey % 7 = 0""")
def _(d):
    updates = d.table("orders").filter("o_orderkey % 7 = 0").selectExpr(
        "o_custkey AS partition_key", "o_orderkey AS mapobject_id", "-1 AS x0", "-1 AS y0")
    return M.upsert_replace(d.segmentations().select("partition_key", "mapobject_id", "x0", "y0"),
                            updates, ["partition_key", "mapobject_id"])


@query("get_or_create", """WITH old AS (SELECT p_partkey AS id, p_brand || '_' || p_partkey AS name FROM part WHERE p_partkey % 3 = 0),
      new AS (SELECT p_brand || '_' || p_partkey AS name FROM part),
      fresh AS (SELECT name FROM new WHERE name NOT IN (SELECT name FROM old))
    SELECT * FROM old UNION ALL
    SELECT (SELECT max(id) FROM old) + row_number() OVER (ORDER BY name) AS id, name FROM fresh""")
def _(d):
    named = d.table("part").selectExpr("p_partkey AS id", "concat(p_brand, '_', p_partkey) AS name")
    return M.get_or_create(named.filter("id % 3 = 0"), named.select("name"), "id", "name")


@query("ingest_feature_values", """SELECT s.partition_key, s.mapobject_id, s.tpoint, CAST(s.label * 0.5 AS DOUBLE) AS f8
    FROM d_segmentations s WHERE tpoint = 1""")
def _(d):
    upload = d.segmentations().filter("tpoint = 1").selectExpr(
        "partition_key AS site_id", "label", "CAST(label * 0.5 AS DOUBLE) AS f8")
    out = M.ingest_feature_values(upload, d.segmentations(), 1, {"f8": "8"})
    return out.select("partition_key", "mapobject_id", "tpoint", F.col("values")["8"].alias("f8"))


@query("delete_objects", """SELECT 'objects' AS part, count(*) AS n FROM d_cells WHERE id % 5 <> 0
    UNION ALL SELECT 'segmentations', count(*) FROM d_segmentations WHERE mapobject_id % 5 <> 0
    UNION ALL SELECT 'values', count(*) FROM d_cell_values WHERE mapobject_id % 5 <> 0""")
def _(d):
    gone = d.cells().filter("id % 5 = 0").select("id")
    tables = M.delete_objects(gone, {"objects": d.cells(), "segmentations": d.segmentations(),
                                     "values": d.cell_values()})
    counts = [t.select(F.lit(n).alias("part")).groupBy("part").agg(F.count(F.lit(1)).alias("n"))
              for n, t in tables.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query("delete_incomplete", """SELECT id FROM d_cells WHERE id IN (SELECT mapobject_id FROM d_segmentations)
    AND id IN (SELECT mapobject_id FROM d_cell_values)""")
def _(d):
    return M.delete_incomplete(d.cells(), d.segmentations(), d.cell_values()).select("id")


@query("update_rows", """SELECT well_id, CASE WHEN well_id = 3 THEN 'Z99' ELSE well_name END AS well_name FROM d_wells""")
def _(d):
    return M.update_rows(d.wells(), "well_id", 3, {"well_name": "Z99"}).select("well_id", "well_name")


@query("delete_cascade", """SELECT 'wells' AS part, count(*) AS n FROM d_wells WHERE plate_id <> 2
    UNION ALL SELECT 'sites', count(*) FROM d_sites JOIN d_wells USING (well_id) WHERE plate_id <> 2""")
def _(d):
    plates = d.plates().filter("plate_id = 2").select("plate_id")
    wells = M.delete_children(d.wells(), plates, "plate_id")
    sites = M.keep_children(d.sites(), wells, "well_id")
    return (wells.select(F.lit("wells").alias("part")).unionByName(sites.select(F.lit("sites").alias("part")))
            .groupBy("part").agg(F.count(F.lit(1)).alias("n")))
