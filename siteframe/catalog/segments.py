"""Queries over label images and segmentation."""

from pyspark.sql import functions as F

from siteframe.catalog import query
from siteframe.catalog.images import lines, mask60, sql_lines, stack
from siteframe.operators import distance as D
from siteframe.operators import labels as LB
from siteframe.operators import measure as ME
from siteframe.operators import pixels as P
from siteframe.operators import segment as SG

_GRID_LABELS = "(y // 16) * 4 + x // 16 + 1"


@query("connected_components", f"""WITH c AS (SELECT site_id, y, x, {_GRID_LABELS} AS cell FROM d_pixels WHERE value >= 120),
    f AS (SELECT site_id, cell, min(y * 64 + x) AS f FROM c GROUP BY 1, 2),
    n AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY f) AS label FROM f)
    SELECT site_id, y, x, CAST(label AS INTEGER) AS label FROM c JOIN n USING (site_id, cell)""")
def _(d):
    return LB.connected_components(P.threshold_manual(d.pixels(), 100), 8)


@query("connected_components_four", f"""WITH RECURSIVE m AS (SELECT site_id, y, x, y * 64 + x AS id FROM d_pixels2 WHERE value > 180 AND site_id < 1e9),
    e AS (SELECT a.site_id, a.id AS a, b.id AS b FROM m a JOIN m b ON a.site_id = b.site_id AND abs(a.y - b.y) + abs(a.x - b.x) = 1),
    r AS (SELECT site_id, id, id AS root FROM m UNION SELECT r.site_id, e.b AS id, r.root FROM r JOIN e ON e.site_id = r.site_id AND e.a = r.id AND r.root < e.b),
    l AS (SELECT site_id, id, min(root) AS root FROM r GROUP BY 1, 2)
    SELECT site_id, CAST(dense_rank() OVER (PARTITION BY site_id ORDER BY root) AS INTEGER) AS label, count(*) AS area, min(id) AS first_pixel
    FROM l GROUP BY site_id, root""")
def _(d):
    out = LB.connected_components(P.threshold_manual(d.pixels2(), 180), 4)
    return out.groupBy("site_id", "label").agg(F.count(F.lit(1)).alias("area"), F.min(F.col("y") * 64 + F.col("x")).alias("first_pixel"))


def sparse_labels(d):
    return d.labels().filter("label % 3 <> 0")


@query("relabel", """SELECT site_id, y, x, CAST(dense_rank() OVER (PARTITION BY site_id ORDER BY label) AS INTEGER) AS label FROM d_labels WHERE label % 3 <> 0""")
def _(d):
    return LB.relabel(sparse_labels(d))


@query("register_objects", "SELECT site_id, count(DISTINCT label) AS n FROM d_labels GROUP BY 1")
def _(d):
    out = LB.register_objects(P.threshold_manual(d.pixels(), 100))
    return out.groupBy("site_id").agg(F.countDistinct("label").alias("n"))


@query("label_gaps", "SELECT site_id, count(DISTINCT label) AS n, CAST(max(label) AS INTEGER) AS last FROM d_labels WHERE label % 3 <> 0 GROUP BY 1")
def _(d):
    return LB.label_gaps(sparse_labels(d))


def quadrants(d):
    """Larger reference objects: the four quarters of each site without a margin."""
    return d.pixels().filter("y % 32 >= 6 AND x % 32 >= 6").selectExpr("site_id", "y", "x", "CAST((y DIV 32) * 2 + x DIV 32 + 1 AS INT) AS label")


@query("check_assignment", """SELECT DISTINCT site_id, CAST(label AS INTEGER) AS label FROM d_labels WHERE y % 32 < 6 OR x % 32 < 6""")
def _(d):
    return LB.check_assignment(d.labels(), quadrants(d), aggregate=True)


@query("assign_children", """SELECT DISTINCT site_id, CAST(label AS INTEGER) AS child, CAST((y // 32) * 2 + x // 32 + 1 AS INTEGER) AS parent FROM d_labels
    WHERE y % 32 >= 6 AND x % 32 >= 6""")
def _(d):
    from siteframe.operators.relational import assign_children
    return assign_children(d.labels(), quadrants(d), ["site_id"])


_AREA = "a AS (SELECT site_id, label, count(*) AS area FROM d_labels GROUP BY 1, 2)"


@query("filter_objects", f"""WITH {_AREA} SELECT l.site_id, y, x, CAST(dense_rank() OVER (PARTITION BY l.site_id ORDER BY l.label) AS INTEGER) AS label
    FROM d_labels l JOIN a ON a.site_id = l.site_id AND a.label = l.label WHERE area BETWEEN 40 AND 90""")
def _(d):
    areas = d.labels().groupBy("site_id", "label").agg(F.count(F.lit(1)).alias("area"))
    return LB.filter_objects(d.labels(), areas, "area", 40, 90)


@query("remove_small_objects", f"WITH {_AREA} SELECT l.site_id, l.y, l.x, CAST(l.label AS INTEGER) AS label FROM d_labels l JOIN a ON a.site_id = l.site_id AND a.label = l.label WHERE area >= 60")
def _(d):
    return LB.remove_small(d.labels(), 60)


@query("border_labels", "SELECT DISTINCT site_id, CAST(label AS INTEGER) AS label FROM d_labels WHERE y IN (2, 62) OR x IN (2, 62)")
def _(d):
    shifted = d.labels().selectExpr("site_id", "y - 2 AS y", "x - 2 AS x", "label")
    return LB.border_labels(shifted, 61, 61)


@query("label_border_flags", "SELECT site_id, CAST(label AS INTEGER) AS label, bool_or(y IN (2, 62) OR x IN (2, 62)) AS is_border FROM d_labels GROUP BY 1, 2")
def _(d):
    shifted = d.labels().selectExpr("site_id", "y - 2 AS y", "x - 2 AS x", "label")
    return LB.label_border_flags(shifted, 61, 61)


@query("object_perimeter", """SELECT a.site_id, CAST(a.label AS INTEGER) AS label, count(*) AS n, CAST(sum(a.y * 64 + a.x) AS BIGINT) AS total FROM d_labels a
    WHERE (SELECT count(*) FROM d_labels b WHERE b.site_id = a.site_id AND b.label = a.label AND abs(b.y - a.y) + abs(b.x - a.x) = 1) < 4 GROUP BY 1, 2""")
def _(d):
    out = LB.object_perimeter(d.labels())
    return out.groupBy("site_id", "label").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("y") * 64 + F.col("x")).alias("total"))


@query("expand_objects", """WITH c AS (SELECT g.site_id, g.y, g.x, l.label, (g.y - l.y) ** 2 + (g.x - l.x) ** 2 AS d2 FROM d_pixels g JOIN d_labels l
      ON l.site_id = g.site_id AND l.y BETWEEN g.y - 3 AND g.y + 3 AND l.x BETWEEN g.x - 3 AND g.x + 3),
    r AS (SELECT site_id, y, x, arg_min(label, (d2, label)) AS value FROM c WHERE d2 < 9 GROUP BY 1, 2, 3) """ + sql_lines("r"))
def _(d):
    return lines(LB.expand_or_shrink(d.labels(), 3, d.pixels(), 64, 64), "label")


@query("shrink_objects", """WITH c AS (SELECT l.site_id, l.y, l.x, l.label AS value FROM d_labels l WHERE NOT EXISTS (SELECT 1 FROM d_pixels b
      WHERE b.site_id = l.site_id AND b.value < 120 AND b.y BETWEEN l.y - 2 AND l.y + 2 AND b.x BETWEEN l.x - 2 AND l.x + 2 AND (b.y - l.y) ** 2 + (b.x - l.x) ** 2 <= 4)) """ + sql_lines("c"))
def _(d):
    return lines(LB.expand_or_shrink(d.labels(), -2, d.pixels(), 64, 64), "label")


@query("fill_holes", sql_lines(f"""(SELECT site_id, y, x, value >= 120 OR ((y % 16 - 8) ** 2 + (x % 16 - 8) ** 2 <= 2) AS value FROM d_pixels)"""))
def _(d):
    # The disks with a hole punched into each of them.
    mask = d.pixels().select("site_id", "y", "x", F.expr("value >= 120 AND (y % 16 - 8) * (y % 16 - 8) + (x % 16 - 8) * (x % 16 - 8) > 2").alias("mask"))
    return lines(LB.fill_holes(mask), "mask")


_PAIRS = """pr AS (SELECT DISTINCT a.site_id, a.label, b.label AS neighbour FROM d_labels a JOIN d_labels b ON a.site_id = b.site_id AND a.label <> b.label
      AND b.y BETWEEN a.y - 5 AND a.y + 5 AND b.x BETWEEN a.x - 5 AND a.x + 5 WHERE (a.y - b.y) ** 2 + (a.x - b.x) ** 2 <= 25)"""


@query("neighbour_pairs", f"WITH {_PAIRS} SELECT site_id, CAST(label AS INTEGER) AS label, CAST(neighbour AS INTEGER) AS neighbour FROM pr")
def _(d):
    return LB.neighbour_pairs(d.labels(), 5)


@query("measure_neighbours", f"""WITH {_PAIRS}, rim AS (SELECT a.* FROM d_labels a WHERE (SELECT count(*) FROM d_labels b WHERE b.site_id = a.site_id AND b.label = a.label
      AND abs(b.y - a.y) + abs(b.x - a.x) = 1) < 4),
    grown AS (SELECT DISTINCT pr.site_id, pr.label, n.y + o.dy AS y, n.x + o.dx AS x FROM pr JOIN d_labels n ON n.site_id = pr.site_id AND n.label = pr.neighbour,
      (VALUES (0, 0), (0, 1), (0, -1), (1, 0), (-1, 0)) o(dy, dx)),
    near AS (SELECT r.site_id, r.label, r.y, r.x, min((r.y - g.y) ** 2 + (r.x - g.x) ** 2) AS d2 FROM rim r JOIN grown g ON g.site_id = r.site_id AND g.label = r.label
      AND g.y BETWEEN r.y - 3 AND r.y + 3 AND g.x BETWEEN r.x - 3 AND r.x + 3 GROUP BY 1, 2, 3, 4),
    t AS (SELECT site_id, label, count(*) FILTER (d2 > 0 AND d2 <= 9) AS t FROM near GROUP BY 1, 2),
    n AS (SELECT site_id, label, count(*) AS n FROM rim GROUP BY 1, 2),
    li AS (SELECT site_id, label, count(*) AS c, string_agg(neighbour, '.' ORDER BY neighbour) AS s FROM pr GROUP BY 1, 2)
    SELECT n.site_id, CAST(n.label AS INTEGER) AS label, coalesce(c, 0) AS "count", coalesce(s, '.') AS neighbours, round(coalesce(t, 0) / n, 9) AS fraction_touching
    FROM n LEFT JOIN li ON li.site_id = n.site_id AND li.label = n.label LEFT JOIN t ON t.site_id = n.site_id AND t.label = n.label""")
def _(d):
    out = LB.measure_neighbours(d.labels(), 5, 3)
    return out.withColumn("fraction_touching", F.round("fraction_touching", 9))


@query("distance_transform", """WITH bg AS (SELECT site_id, y, x FROM d_pixels WHERE value < 120),
    c AS (SELECT l.site_id, l.y, l.x, sqrt(min((b.y - l.y) ** 2 + (b.x - l.x) ** 2)) AS value FROM d_labels l JOIN bg b ON b.site_id = l.site_id
      AND b.y BETWEEN l.y - 8 AND l.y + 8 AND b.x BETWEEN l.x - 8 AND l.x + 8 GROUP BY 1, 2, 3),
    a AS (SELECT p.site_id, p.y, p.x, coalesce(c.value, 0) AS value FROM d_pixels p LEFT JOIN c USING (site_id, y, x)) """ + sql_lines("a", digits=6))
def _(d):
    mask = P.threshold_manual(d.pixels(), 100).drop("value")
    return lines(D.distance_transform(mask), "distance", 6)


# --- clump selection ----------------------------------------------------------------

def shapes(d):
    return ME.measure_morphology(d.labels()).join(ME.convex_hulls(d.labels()), ["site_id", "label"]).withColumn(
        "convexity", F.col("area") / F.col("hull_area"))


@query("select_clumps")
def _(d):
    return LB.select_clumps(shapes(d), 30, 100, 1.2, 0.99).select("site_id", "label", "area")


@query("clump_classes", """WITH s AS (SELECT o_orderkey, length(o_orderpriority) * 40.0 AS area, o_orderkey % 60 + 10.0 AS perimeter, (o_orderkey % 100) / 100 AS convexity FROM orders),
    f AS (SELECT *, greatest(-ln(4 * pi() * area / (perimeter + 1) ** 2), 0) AS form FROM s)
    SELECT o_orderkey, round(form, 8) AS log_form_factor, CASE WHEN area > 210 AND area < 500 AND convexity < 0.9 AND form > 0.1 THEN 'clump'
      WHEN convexity > 0.9 AND form < 0.1 THEN 'object' ELSE 'rest' END AS clump_class FROM f""")
def _(d):
    s = d.table("orders").selectExpr("o_orderkey", "length(o_orderpriority) * 40.0D AS area", "o_orderkey % 60 + 10.0D AS perimeter",
                                     "(o_orderkey % 100) / 100.0D AS convexity")
    return LB.clump_classes(s, 210, 500, 0.9, 0.1).select("o_orderkey", F.round("log_form_factor", 8).alias("log_form_factor"), "clump_class")


# --- segmentation -----------------------------------------------------------------------

@query("segment_secondary")
def _(d):
    seeds = d.labels().filter("(y % 16 - 8) * (y % 16 - 8) + (x % 16 - 8) * (x % 16 - 8) <= 4")
    return lines(SG.segment_secondary(seeds, d.pixels(), 60, lower=55), "label")


@query("separate_clumps")
def _(d):
    # Disks grown until neighbours touch.
    mask = LB.expand_objects(d.labels(), 4, 64, 64).select("site_id", "y", "x", F.lit(True).alias("mask"))
    return lines(SG.separate_clumps(mask, 20, 30, 4000, 0.9, 0.98), "label")


# Blocks of seven lines in a row of places, two or three to a cell, and bridges of one pixel between them.
_BLOCKS = """y % 16 BETWEEN 4 AND 10 AND CASE WHEN (y // 16 + x // 16) % 2 = 0 THEN x % 16 IN (1, 2, 3, 4, 5, 10, 11, 12, 13, 14) ELSE x % 16 IN (0, 1, 2, 3, 6, 7, 8, 9, 12, 13, 14) END"""
_BRIDGE = "y % 16 = 7 AND x % 16 < 14 AND x % 16 > 0"


@query("separate_joined", f"""WITH m AS (SELECT site_id, y, x FROM d_pixels WHERE ({_BLOCKS}) OR ({_BRIDGE})),
    c AS (SELECT site_id, y, x, (y // 16 + x // 16) % 2 AS odd, x % 16 AS b FROM m),
    cut AS (SELECT site_id, y, x, y // 16 AS cy, x // 16 AS cx, CASE WHEN odd = 0 THEN CASE WHEN b < 9 THEN 0 ELSE 1 END ELSE CASE WHEN b < 5 THEN 0 WHEN b < 11 THEN 1 ELSE 2 END END AS part
      FROM c WHERE NOT (y % 16 = 7 AND ((odd = 0 AND b = 9) OR (odd = 1 AND b IN (5, 11))))),
    f AS (SELECT site_id, cy, cx, part, min(y * 64 + x) AS f FROM cut GROUP BY ALL),
    n AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY f) AS value FROM f),
    r AS (SELECT cut.site_id, y, x, value FROM cut JOIN n USING (site_id, cy, cx, part)) """ + sql_lines("r"))
def _(d):
    blocks = _BLOCKS.replace("//", "DIV")
    mask = d.pixels().filter(f"({blocks}) OR ({_BRIDGE})").select("site_id", "y", "x", F.lit(True).alias("mask"))
    return lines(SG.separate_clumps(mask, 20, 50, 4000, 2.0, 0.92), "label")


# The blocks with 100, 80 and 60, every other site with a second block that is hardly brighter than the bridge.
_PART = "CASE WHEN odd = 0 THEN CASE WHEN b < 9 THEN 0 ELSE 1 END ELSE CASE WHEN b < 5 THEN 0 WHEN b < 11 THEN 1 ELSE 2 END END"


@query("split_blobs", f"""WITH m AS (SELECT site_id, y, x, (y // 16 + x // 16) % 2 AS odd, x % 16 AS b FROM d_pixels WHERE ({_BLOCKS}) OR ({_BRIDGE})),
    c AS (SELECT site_id, y, x, y // 16 AS cy, x // 16 AS cx, CASE WHEN site_id % 2 = 1 AND (odd = 0 OR {_PART} = 1) THEN 0 ELSE {_PART} END AS part FROM m),
    f AS (SELECT site_id, cy, cx, part, min(y * 64 + x) AS f FROM c GROUP BY ALL),
    n AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY f) AS value FROM f),
    r AS (SELECT c.site_id, y, x, value FROM c JOIN n USING (site_id, cy, cx, part)) """ + sql_lines("r"))
def _(d):
    px = d.pixels().filter(f"({_BLOCKS.replace('//', 'DIV')}) OR ({_BRIDGE})").selectExpr(
        "site_id", "y", "x", "(y DIV 16 + x DIV 16) % 2 AS odd", "x % 16 AS b", "CAST((y DIV 16) * 4 + x DIV 16 AS INT) AS label")
    bridge = "(odd = 0 AND b BETWEEN 6 AND 9 OR odd = 1 AND b IN (4, 5, 10, 11))"
    bright = f"""CAST(CASE WHEN y % 16 = 7 AND {bridge} THEN 20 WHEN {_PART} = 0 THEN 100
        WHEN {_PART} = 1 THEN IF(site_id % 2 = 0, 80, 21) ELSE 60 END AS DOUBLE) AS value"""
    return lines(SG.split_blobs(px.selectExpr("site_id", "y", "x", "label", bright), 10, 500, 0.18), "label")


@query("concave_points")
def _(d):
    mask = LB.expand_objects(d.labels(), 4, 64, 64).select("site_id", "y", "x", F.lit(True).alias("mask"))
    return SG.concave_points(LB.connected_components(mask, 8), 2.0).withColumn("depth", F.round("depth", 6))


@query("detect_blobs")
def _(d):
    region = d.pixels().select("site_id", "y", "x", F.lit(True).alias("mask"))
    blobs = SG.detect_blobs(d.pixels(), region, threshold=4, min_area=3, mean_area=5, max_area=200)
    return SG.flux_centroids(blobs).withColumn("flux", F.round("flux", 4))


@query("deblend_blobs")
def _(d):
    # Two bumps per disk: brightness falls off from two centres.
    px = d.labels().withColumn("value", F.expr("""60.0D + 140.0D * greatest(
        exp(-(pow(y % 16 - 8, 2) + pow(x % 16 - 5, 2)) / 4.0D), exp(-(pow(y % 16 - 8, 2) + pow(x % 16 - 11, 2)) / 4.0D))"""))
    return lines(SG.deblend(px, 60.0, 8, 0.1), "label")


@query("detect_blobs_3d")
def _(d):
    volume = d.pixels().withColumn("zplane", F.explode(F.sequence(F.lit(0), F.lit(2)))).withColumn(
        "value", F.expr("CAST(value * (2 - abs(zplane - 1)) AS INT)"))
    spots = SG.detect_blobs_3d(volume, 40.0)
    from siteframe.operators.aggregates import occupancy
    return occupancy(spots, ["site_id"])


@query("generate_volume")
def _(d):
    cells = d.pixels().select("site_id", "y", "x", F.expr("y >= 16 AND y < 48").alias("mask"))
    return lines(SG.generate_volume(stack(d), cells, 10.0, 5, 3, 400), "height", 4)


@query("height_image", """WITH c AS (SELECT site_id, y, x, CASE WHEN x < 45 AND y >= 2 AND y < 60 THEN
      1 + (site_id + least((y + 15) // 15 - 1, 3) * 4 + least((x + 15) // 15 - 1, 2)) % 5 ELSE 0 END AS value FROM d_pixels) """ + sql_lines("c"))
def _(d):
    # Beads of 2 x 2 pixels every 15 pixels, each in one of five planes; the last column of beads is beside the cells.
    planes = d.pixels().withColumn("zplane", F.explode(F.sequence(F.lit(0), F.lit(5))))
    bead = "y % 15 IN (7, 8) AND x % 15 IN (7, 8) AND y < 60 AND x < 60 AND zplane = 1 + (site_id + y DIV 15 * 4 + x DIV 15) % 5"
    beads = planes.withColumn("value", F.expr(f"IF({bead}, 200, 3)"))
    cells = d.pixels().select("site_id", "y", "x", F.expr("x < 45 AND y >= 2 AND y < 60").alias("mask"))
    return lines(SG.height_image(beads, cells, 5.0), "height")
