"""Queries over map tiles and object outlines."""

from pyspark.sql import functions as F

from siteframe.catalog import query
from siteframe.catalog.images import lines, two_channels
from siteframe.catalog.layout import LAYOUT, offsets
from siteframe.catalog.objects import label_values
from siteframe.functions import geometry as G
from siteframe.operators import layout as L
from siteframe.operators import mutate as M
from siteframe.operators import tiles as T

_OUT = f"""{LAYOUT}, seg AS (SELECT s.partition_key, mapobject_id, segmentation_layer_id, label, offset_x + x0 AS bx0, -(offset_y + y1) AS by0,
    offset_x + x1 AS bx1, -(offset_y + y0) AS by1 FROM d_segmentations s JOIN so ON so.site_id = s.partition_key)"""


def outlines(d):
    return T.map_outlines(d.segmentations(), offsets(d))


_BASE = f"""{LAYOUT}, base AS (SELECT CAST(y + offset_y AS BIGINT) AS y, CAST(x + offset_x AS BIGINT) AS x,
    CAST(CASE WHEN v < 10 THEN 0 WHEN v >= 150 THEN 255 ELSE floor((v - 10) * 255 / 139) END AS INTEGER) AS value
    FROM (SELECT site_id, y, x, greatest(least(value, 150), 10) AS v FROM d_pixels) p JOIN so USING (site_id))"""


def base_pixels(d):
    return T.build_base_tiles(d.pixels(), offsets(d), 10, 150)


@query("build_base_tiles", f"WITH {_BASE} SELECT y // 256 AS tile_y, x // 256 AS tile_x, count(*) AS n, CAST(sum(value) AS BIGINT) AS total, CAST(sum(value * (x % 256)) AS BIGINT) AS weighted FROM base GROUP BY 1, 2")
def _(d):
    return base_pixels(d).groupBy(F.expr("y DIV 256").alias("tile_y"), F.expr("x DIV 256").alias("tile_x")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.sum(F.col("value") * (F.col("x") % 256)).alias("weighted"))


@query("build_base_tiles_bounds", f"""WITH {LAYOUT}, px AS (SELECT 0 AS channel_id, * FROM d_pixels UNION ALL SELECT 1, * FROM d_pixels2),
    b AS (SELECT channel_id, min(value) AS lo, greatest(max(value) // 2, min(value) + 255) AS hi FROM px GROUP BY 1),
    base AS (SELECT channel_id, y + offset_y AS y, CASE WHEN v >= hi THEN 255 ELSE floor((v - lo) * 255 / greatest(hi - lo - 1, 1)) END AS value
      FROM (SELECT px.*, lo, hi, greatest(least(value, hi), lo) AS v FROM px JOIN b USING (channel_id)) JOIN so USING (site_id))
    SELECT channel_id, CAST(y AS BIGINT) AS y, count(*) AS n, CAST(sum(value) AS BIGINT) AS total FROM base GROUP BY 1, 2""")
def _(d):
    px = two_channels(d)
    bounds = px.groupBy("channel_id").agg(F.min("value").alias("min_intensity"), F.greatest(F.expr("max(value) DIV 2"), F.min("value") + 255).cast("int").alias("max_intensity"))
    base = T.build_base_tiles(px, offsets(d), bounds=bounds)
    return base.groupBy("channel_id", F.col("y").cast("long").alias("y")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


@query("pack_tiles", f"WITH {_BASE} SELECT y // 256 AS tile_y, x // 256 AS tile_x, CAST(count(*) AS INTEGER) AS n, CAST(min((y % 256) * 256 + x % 256) AS INTEGER) AS first_place, CAST(sum(value) AS BIGINT) AS total FROM base GROUP BY 1, 2")
def _(d):
    return T.pack_tiles(base_pixels(d)).select(
        "tile_y", "tile_x", F.size("pixels").alias("n"), F.expr("pixels[0].place").alias("first_place"),
        F.expr("aggregate(pixels, 0L, (s, p) -> s + p.value)").alias("total"))


@query("get_tile", f"""WITH {_BASE}, r AS (SELECT DISTINCT offset_y // 256 AS tile_y, offset_x // 256 AS tile_x FROM so WHERE site_id % 40 < 2)
    SELECT tile_y, tile_x, CAST(65536 AS INTEGER) AS n, CAST(coalesce(sum(value), 0) AS BIGINT) AS total FROM r LEFT JOIN base ON base.y // 256 = tile_y AND base.x // 256 = tile_x GROUP BY 1, 2""")
def _(d):
    requested = offsets(d).filter("site_id % 40 < 2").selectExpr("offset_y DIV 256 AS tile_y", "offset_x DIV 256 AS tile_x").distinct()
    return T.get_tile(T.pack_tiles(T.requested_pixels(base_pixels(d), requested)), requested).select(
        "tile_y", "tile_x", F.size("pixels").alias("n"), F.expr("aggregate(pixels, 0L, (s, v) -> s + v)").alias("total"))


_MOST = 13
_SHRINK = ", ".join([_BASE, "l0 AS (SELECT * FROM base)"] + [
    f"l{k} AS (SELECT y // 2 AS y, x // 2 AS x, CAST(floor(sum(value) / 4 + 0.5) AS INTEGER) AS value FROM l{k - 1} GROUP BY 1, 2)" for k in range(1, _MOST)] + [
    f"depth AS (SELECT min(n) AS depth FROM range(0, {_MOST}) t(n) WHERE (SELECT max(greatest(y, x)) FROM base) // (1 << n)::BIGINT < 256)"])


@query("build_pyramid", f"WITH {_SHRINK} " + " UNION ALL ".join(
    f"SELECT {k} AS shrinks, y, count(*) AS n, CAST(sum(value) AS BIGINT) AS total, CAST(sum(value * (x % 1000)) AS BIGINT) AS weighted FROM l{k}, depth WHERE depth >= {k} GROUP BY y" for k in range(_MOST)))
def _(d):
    return T.build_pyramid(base_pixels(d)).groupBy("shrinks", "y").agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.sum(F.col("value") * (F.col("x") % 1000)).alias("weighted"))


@query("objects_in_tile", f"WITH {_OUT} SELECT mapobject_id, label FROM seg WHERE bx0 <= 2048 AND bx1 >= 1024 AND by0 <= 0 AND by1 >= -1024")
def _(d):
    return T.objects_in_tile(outlines(d), 2, 0, 1, 4).select("mapobject_id", "label")


_TILED = f"""{_OUT}, ty AS (SELECT *, unnest(generate_series(greatest(CAST(ceil(-by1 / 1024) AS BIGINT) - 1, 0), CAST(floor(-by0 / 1024) AS BIGINT))) AS tile_y FROM seg),
    tiled AS (SELECT *, unnest(generate_series(greatest(CAST(ceil(bx0 / 1024) AS BIGINT) - 1, 0), CAST(floor(bx1 / 1024) AS BIGINT))) AS tile_x FROM ty)"""


@query("objects_on_tiles", f"WITH {_TILED} SELECT tile_y, tile_x, mapobject_id FROM tiled")
def _(d):
    return T.objects_on_tiles(outlines(d), 2, 4).select("tile_y", "tile_x", "mapobject_id")


@query("vector_tiles_points", f"""WITH {_OUT}, c AS (SELECT mapobject_id, (bx0 + bx1) / 2 AS cx, (by0 + by1) / 2 AS cy FROM seg),
    t AS (SELECT *, unnest(generate_series(greatest(CAST(ceil(-cy / 1024) AS BIGINT) - 1, 0), CAST(floor(-cy / 1024) AS BIGINT))) AS tile_y FROM c)
    SELECT tile_y, unnest(generate_series(greatest(CAST(ceil(cx / 1024) AS BIGINT) - 1, 0), CAST(floor(cx / 1024) AS BIGINT))) AS tile_x, mapobject_id,
      '{{"type":"Point","coordinates":[' || CAST(trunc(cx) AS BIGINT) || ',' || CAST(trunc(cy) AS BIGINT) || ']}}' AS geometry FROM t""")
def _(d):
    # Centres of rectangles lie on halves; the area formula is kept from drifting off them.
    exact = outlines(d)
    out = T.vector_tiles(exact, 2, 4, 3, 1)
    return out


@query("vector_tiles_polygons", f"""WITH {_TILED} SELECT tile_y, tile_x, mapobject_id, '{{"type":"Polygon","coordinates":[[[' || concat_ws('],[', bx1 || ',' || by0, bx0 || ',' || by0,
    bx0 || ',' || by1, bx1 || ',' || by1, bx1 || ',' || by0) || ']]]}}' AS geometry FROM tiled""")
def _(d):
    return T.vector_tiles(outlines(d), 2, 4, 0, 0, exact=True)


@query("vector_tiles_simplified")
def _(d):
    return T.vector_tiles(outlines(d), 2, 4, 0, 0)


@query("feature_collections", f"""WITH {_TILED} SELECT tile_y, tile_x, mapobject_id // 100000 AS part, '{{"type":"FeatureCollection","features":[' || string_agg(
    '{{"type":"Feature","geometry":{{"type":"Polygon","coordinates":[[[' || concat_ws('],[', bx1 || ',' || by0, bx0 || ',' || by0, bx0 || ',' || by1, bx1 || ',' || by1, bx1 || ',' || by0)
    || ']]]}},"properties":{{"id":' || mapobject_id || '}}}}', ',' ORDER BY mapobject_id) || ']}}' AS document FROM tiled GROUP BY 1, 2, 3""")
def _(d):
    return T.feature_collections(T.vector_tiles(outlines(d), 2, 4, 0, 0, exact=True))


@query("label_tiles", f"""WITH {_TILED} SELECT tile_y, tile_x, t.mapobject_id, CASE WHEN v.mapobject_id IS NULL THEN NULL ELSE CAST(t.mapobject_id % 4 AS DOUBLE) END AS object_label
    FROM tiled t LEFT JOIN d_cell_values v ON v.partition_key = t.partition_key AND v.mapobject_id = t.mapobject_id""")
def _(d):
    return T.label_tiles(T.objects_on_tiles(outlines(d), 2, 4), label_values(d), 7).select(
        "tile_y", "tile_x", "mapobject_id", "object_label")


@query("border_objects", f"""WITH {_OUT}, st AS (SELECT site_id, offset_x + 1 AS sx0, offset_x + 62 AS sx1, -(offset_y + 1) - 61 AS sy0, -(offset_y + 1) AS sy1 FROM so)
    SELECT mapobject_id, (bx0 <= sx0 OR bx1 >= sx1 OR by0 <= sy0 OR by1 >= sy1) AND NOT (bx0 > sx1 OR bx1 < sx0 OR by0 > sy1 OR by1 < sy0) AS is_border
    FROM seg JOIN st ON st.site_id = seg.partition_key""")
def _(d):
    sites = L.static_objects(offsets(d), "site_id", "offset_y", "offset_x", "height", "width")
    return T.border_objects(outlines(d), sites).select("mapobject_id", "is_border")


@query("points_in_polygons", """WITH q AS (SELECT n_nationkey AS parent_id, n_nationkey * 50 AS x0, n_nationkey * 50 + 60 AS x1, n_nationkey * 30 AS y0, n_nationkey * 30 + 200 AS y1 FROM nation),
    p AS (SELECT o_orderkey AS point_id, (o_orderkey * 37) % 1300 + 0.5::DOUBLE AS x, (o_orderkey * 53) % 1000 + 0.5::DOUBLE AS y FROM orders)
    SELECT point_id, parent_id FROM p JOIN q ON x > x0 AND x < x1 AND y > y0 AND y < y1""")
def _(d):
    return T.points_in_polygons(grid_points(d), boxes(d)).select("point_id", "parent_id")


def boxes(d):
    return d.table("nation").selectExpr("n_nationkey AS parent_id", "n_nationkey * 50 AS x0", "n_nationkey * 30 AS y0").select(
        "parent_id", G.rectangle(F.col("x0"), F.col("y0"), F.col("x0") + 60, F.col("y0") + 200).alias("polygon"))


def grid_points(d):
    return d.table("orders").selectExpr("o_orderkey AS point_id", "(o_orderkey * 37) % 1300 + 0.5D AS x",
                                        "(o_orderkey * 53) % 1000 + 0.5D AS y", "o_totalprice")


@query("aggregate_within", """WITH q AS (SELECT n_nationkey AS parent_id, n_nationkey * 50 AS x0, n_nationkey * 50 + 60 AS x1, n_nationkey * 30 AS y0, n_nationkey * 30 + 200 AS y1 FROM nation),
    p AS (SELECT (o_orderkey * 37) % 1300 + 0.5::DOUBLE AS x, (o_orderkey * 53) % 1000 + 0.5::DOUBLE AS y, o_totalprice FROM orders)
    SELECT parent_id, count(x) AS n, coalesce(round(avg(o_totalprice), 4), CAST('NaN' AS DOUBLE)) AS mean FROM q LEFT JOIN p ON x > x0 AND x < x1 AND y > y0 AND y < y1 GROUP BY 1""")
def _(d):
    return T.aggregate_within(grid_points(d), boxes(d), "o_totalprice").withColumn("mean", F.round("mean", 4))


@query("polygon_checks", """SELECT mapobject_id, true AS is_valid, CAST((x1 - x0) * (y1 - y0) AS DOUBLE) AS area, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy FROM d_segmentations""")
def _(d):
    ring = G.rectangle("x0", "y0", "x1", "y1")
    s = d.segmentations().withColumn("r", ring).withColumn("c", G.ring_centroid("r"))
    return s.select("mapobject_id", G.ring_is_valid("r").alias("is_valid"), G.ring_area("r").alias("area"),
                    F.round("c.x", 6).alias("cx"), F.round("c.y", 6).alias("cy"))


@query("delete_invalid_objects", "SELECT mapobject_id FROM d_segmentations WHERE mapobject_id % 9 <> 0")
def _(d):
    # Every ninth outline has two corners exchanged, which makes it cross itself.
    good, bad = G.rectangle("x0", "y0", "x1", "y1"), F.array(G.point("x1", "y0"), G.point("x0", "y1"), G.point("x0", "y0"), G.point("x1", "y1"), G.point("x1", "y0"))
    s = d.segmentations().withColumn("polygon", F.when(F.col("mapobject_id") % 9 == 0, bad).otherwise(good))
    return M.delete_invalid(s.withColumnRenamed("mapobject_id", "id"), s).select(F.col("id").alias("mapobject_id"))


def site_zero(d):
    """Offsets that leave site coordinates as they are."""
    return d.table("supplier").selectExpr("s_suppkey AS site_id", "0 AS offset_y", "0 AS offset_x", "64 AS height", "64 AS width")


@query("polygons_to_labels", """WITH c AS (SELECT partition_key AS site_id, label, unnest(generate_series(y0, y1)) AS y, x0, x1 FROM d_segmentations),
    p AS (SELECT site_id, label, CAST(y AS INTEGER) AS y, CAST(unnest(generate_series(x0, x1)) AS INTEGER) AS x FROM c),
    m AS (SELECT site_id, y, x, max(label) AS label FROM p GROUP BY 1, 2, 3)
    SELECT site_id, y, count(*) AS n, CAST(sum(label) AS BIGINT) AS total, CAST(sum(label * x) AS BIGINT) AS weighted FROM m GROUP BY 1, 2""")
def _(d):
    segs = d.segmentations().select(F.col("partition_key").alias("site_id"), "label", G.rectangle("x0", -F.col("y0"), "x1", -F.col("y1")).alias("polygon"))
    zero = d.sites().selectExpr("site_id", "0 AS offset_y", "0 AS offset_x", "64 AS height", "64 AS width")
    return lines(T.polygons_to_labels(segs, zero, 64, 64), "label")


@query("labels_to_polygons")
def _(d):
    out = T.labels_to_polygons(d.labels(), site_zero(d))
    return out.select("site_id", "label", F.size("polygon").alias("n_points"), F.size("holes").alias("n_holes"),
                      G.ring_is_valid("polygon").alias("is_valid"), G.ring_area("polygon").alias("area"))


@query("ingest_segmentation", """SELECT site_id, CAST(label AS INTEGER) AS label, CASE WHEN label <= 8 THEN site_id * 100 + label ELSE
      (SELECT max(s_suppkey) * 100 + 8 FROM supplier) + row_number() OVER (PARTITION BY label <= 8 ORDER BY site_id, label) END AS mapobject_id
    FROM (SELECT DISTINCT site_id, label FROM d_labels)""")
def _(d):
    existing = d.labels().filter("label <= 8").select("site_id", "label").distinct().withColumn(
        "mapobject_id", F.col("site_id") * 100 + F.col("label"))
    return M.assign_object_ids(d.labels(), existing, ["site_id"])
