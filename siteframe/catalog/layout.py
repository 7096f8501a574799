"""Queries over plate, well and site layout and tile geometry."""

from pyspark.sql import functions as F

from siteframe.catalog import query
from siteframe.config import ExperimentConfig
from siteframe.functions.geometry import zoom_thresholds
from siteframe.operators import aggregates as A
from siteframe.operators import layout as L

CFG = ExperimentConfig()

# Layout of plates and sites in SQL: sizes of wells and plates, then offsets.
LAYOUT = """ws AS (SELECT well_id, (max(site_y) + 1) * 64 AS wh, (max(site_x) + 1) * 64 AS ww FROM d_sites GROUP BY 1),
  pz AS (SELECT plate_id, max(wh) AS well_height, max(ww) AS well_width, count(DISTINCT well_y) AS n_rows,
    count(DISTINCT well_x) AS n_cols FROM d_wells JOIN ws USING (well_id) GROUP BY 1),
  pg AS (SELECT *, n_rows * well_height + 500 * (n_rows - 1) AS plate_height, n_cols * well_width + 500 * (n_cols - 1) AS plate_width,
    (row_number() OVER (ORDER BY plate_id) - 1) % 3 AS gy, (row_number() OVER (ORDER BY plate_id) - 1) // 3 AS gx FROM pz),
  pl AS (SELECT *, gy * (plate_height + 1000) AS poy, gx * (plate_width + 1000) AS pox FROM pg),
  wo AS (SELECT well_id, (dense_rank() OVER (PARTITION BY plate_id ORDER BY well_y) - 1) * (well_height + 500) + poy AS woy,
    (dense_rank() OVER (PARTITION BY plate_id ORDER BY well_x) - 1) * (well_width + 500) + pox AS wox,
    well_height, well_width FROM d_wells JOIN pl USING (plate_id)),
  so AS (SELECT s.*, CAST(site_y * 64 + woy AS BIGINT) AS offset_y, CAST(site_x * 64 + wox AS BIGINT) AS offset_x
    FROM d_sites s JOIN wo USING (well_id))"""


@query("update_indices", """SELECT *, CAST(dense_rank() OVER (ORDER BY channel_name) - 1 AS INTEGER) AS channel_name_index,
    CAST(dense_rank() OVER (ORDER BY tpoint) - 1 AS INTEGER) AS tpoint_index, CAST(dense_rank() OVER (ORDER BY zplane) - 1 AS INTEGER) AS zplane_index
    FROM d_planes""")
def _(d):
    return L.update_indices(d.planes())


@query("assign_site_indices", """WITH f AS (SELECT well_name, stage_y AS grid_y, stage_x AS grid_x, min(tpoint * 100 + zplane * 1000 + stage_x - stage_y) AS o
      FROM d_planes GROUP BY ALL), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY well_name ORDER BY o, grid_y) - 1 AS INTEGER) AS site_index FROM f)
    SELECT well_name, count(DISTINCT site_index) AS n, max(site_index) AS last_index FROM r GROUP BY 1""")
def _(d):
    p = d.planes().withColumnsRenamed({"stage_y": "grid_y", "stage_x": "grid_x"}).withColumn(
        "o", F.expr("tpoint * 100 + zplane * 1000 + grid_x - grid_y"))
    return L.assign_site_indices(p, "o").groupBy("well_name").agg(
        F.countDistinct("site_index").alias("n"), F.max("site_index").alias("last_index"))


@query("nonempty_ranks", """SELECT well_id, CAST(dense_rank() OVER (PARTITION BY plate_id ORDER BY well_y) - 1 AS INTEGER) AS row_rank,
    CAST(dense_rank() OVER (PARTITION BY plate_id ORDER BY well_x) - 1 AS INTEGER) AS col_rank FROM d_wells""")
def _(d):
    return L.nonempty_ranks(d.wells()).select("well_id", "row_rank", "col_rank")


@query("nonempty_rows_cols", """SELECT plate_id, count(DISTINCT well_y) AS n_rows, count(DISTINCT well_x) AS n_cols FROM d_wells GROUP BY 1""")
def _(d):
    return L.nonempty_rows_cols(d.wells())


@query("grid_from_layout", """WITH p AS (SELECT p_partkey, CAST(p_partkey % 12 AS INTEGER) AS i FROM part)
    SELECT p_partkey, CAST(i // 4 AS INTEGER) AS grid_y, CAST(CASE WHEN (i // 4) % 2 = 1 THEN 3 - i % 4 ELSE i % 4 END AS INTEGER) AS grid_x,
      CAST(CASE WHEN (i // 3) % 2 = 1 THEN 2 - i % 3 ELSE i % 3 END AS INTEGER) AS v_y, CAST(i // 3 AS INTEGER) AS v_x FROM p""")
def _(d):
    p = d.table("part").selectExpr("p_partkey", "CAST(p_partkey % 12 AS INT) AS i", "3 AS r", "4 AS c")
    out = L.grid_from_layout(p, "i", "r", "c", "zigzag_horizontal")
    y, x = L.layout_coordinate("i", "r", "c", "zigzag_vertical")
    return out.select("p_partkey", "grid_y", "grid_x", y.alias("v_y"), x.alias("v_x"))


@query("grid_from_positions", """SELECT *, CAST(dense_rank() OVER (PARTITION BY well_name ORDER BY stage_y DESC) - 1 AS INTEGER) AS grid_y,
    CAST(dense_rank() OVER (PARTITION BY well_name ORDER BY stage_x) - 1 AS INTEGER) AS grid_x FROM d_planes""")
def _(d):
    return L.grid_from_positions(d.planes(), tolerance=10, reverse_rows=True)


@query("guess_grid", """WITH n AS (SELECT l_suppkey, count(DISTINCT l_partkey) % 60 + 1 AS n FROM lineitem GROUP BY 1),
    m AS (SELECT *, CASE WHEN n < 4 THEN 4 ELSE 2 * CAST(floor(sqrt(n)) AS BIGINT) END AS lim FROM n),
    a AS (SELECT *, unnest(generate_series(1, lim)) AS a FROM m),
    b AS (SELECT *, greatest(a, CAST(ceil(n / a) AS BIGINT)) AS b FROM a),
    r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY a * b, (a <> b)::INTEGER, a) AS r FROM b WHERE b <= lim)
    SELECT l_suppkey, CAST(greatest(a, b) AS INTEGER) AS n_rows, CAST(least(a, b) AS INTEGER) AS n_cols FROM r WHERE r = 1""")
def _(d):
    n = d.table("lineitem").groupBy("l_suppkey").agg((F.countDistinct("l_partkey") % 60 + 1).cast("int").alias("n"))
    return n.withColumn("g", L.guess_grid("n")).select("l_suppkey", "g.n_rows", "g.n_cols")


@query("detect_layout", """SELECT DISTINCT c_nationkey, CAST(2 + c_nationkey % 3 AS BIGINT) AS n_rows, CAST(2 + c_nationkey % 5 AS BIGINT) AS n_cols,
    CASE c_nationkey % 4 WHEN 0 THEN 'horizontal' WHEN 1 THEN 'zigzag_horizontal' WHEN 2 THEN 'vertical' ELSE 'zigzag_vertical' END AS layout
    FROM customer""")
def _(d):
    grids = d.table("customer").select("c_nationkey").distinct().withColumns(
        {"r": F.expr("CAST(2 + c_nationkey % 3 AS INT)"), "c": F.expr("CAST(2 + c_nationkey % 5 AS INT)")})
    base = grids.withColumn("site_index", F.explode(F.sequence(F.lit(0), F.col("r") * F.col("c") - 1)))
    ys, xs = [], []
    for name in ("horizontal", "zigzag_horizontal", "vertical", "zigzag_vertical"):
        y, x = L.layout_coordinate("site_index", "r", "c", name)
        ys.append(y)
        xs.append(x)
    pick = lambda cs: F.get(F.array(*cs), F.col("c_nationkey") % 4) * 1000.0
    return L.detect_layout(base.withColumns({"stage_y": pick(ys), "stage_x": pick(xs)}), "c_nationkey")


@query("stitch_dimensions", """SELECT well_name, count(DISTINCT stage_y) AS n_rows, count(DISTINCT stage_x) AS n_cols FROM d_planes GROUP BY 1""")
def _(d):
    return d.planes().groupBy("well_name").agg(F.countDistinct("stage_y").alias("n_rows"),
                                               F.countDistinct("stage_x").alias("n_cols"))


_ACQ = """a AS (SELECT s_suppkey AS acquisition_id, s_nationkey % 5 AS plate_id, s_suppkey * 37 % 101 AS created_at FROM supplier),
    i AS (SELECT DISTINCT l_suppkey AS acquisition_id, year(l_shipdate) AS tpoint FROM lineitem),
    r AS (SELECT plate_id, acquisition_id, tpoint, CAST(row_number() OVER (PARTITION BY plate_id ORDER BY created_at, acquisition_id, tpoint) - 1 AS INTEGER) AS k
      FROM i JOIN a USING (acquisition_id))"""


def _acquisitions(d):
    a = d.table("supplier").selectExpr("s_suppkey AS acquisition_id", "s_nationkey % 5 AS plate_id",
                                       "s_suppkey * 37 % 101 AS created_at")
    i = d.table("lineitem").selectExpr("l_suppkey AS acquisition_id", "year(l_shipdate) AS tpoint", "'dapi' AS wavelength").distinct()
    return i, a


@query("reindex_cycles_multiplexing", f"""WITH {_ACQ} SELECT plate_id, acquisition_id, 0 AS new_tpoint, k AS cycle, k || '_dapi' AS channel FROM r""")
def _(d):
    return L.reindex_cycles(*_acquisitions(d), "multiplexing").select("plate_id", "acquisition_id", "new_tpoint", "cycle", "channel")


@query("reindex_cycles_basic", f"""WITH {_ACQ} SELECT plate_id, acquisition_id, k AS new_tpoint, 0 AS cycle, 'dapi' AS channel FROM r""")
def _(d):
    return L.reindex_cycles(*_acquisitions(d), "basic").select("plate_id", "acquisition_id", "new_tpoint", "cycle", "channel")


@query("plate_layout", f"""WITH {LAYOUT} SELECT plate_id, well_height, well_width, plate_height, plate_width, CAST(gy AS INTEGER) AS plate_grid_y,
    CAST(gx AS INTEGER) AS plate_grid_x, poy AS plate_offset_y, pox AS plate_offset_x FROM pl""")
def _(d):
    return L.plate_layout(d.sites(), d.wells(), d.plates(), CFG).select(
        "plate_id", "well_height", "well_width", "plate_height", "plate_width", "plate_grid_y", "plate_grid_x",
        "plate_offset_y", "plate_offset_x")


@query("pyramid_size", f"""WITH {LAYOUT} SELECT max(plate_height) * 3 + 2 * 1000 AS height, max(plate_width) * 2 + 1000 AS width FROM pl""")
def _(d):
    return L.pyramid_size(L.plate_layout(d.sites(), d.wells(), d.plates(), CFG), CFG)


@query("well_dimensions", """SELECT well_id, max(site_y) + 1 AS n_rows, max(site_x) + 1 AS n_cols FROM d_sites GROUP BY 1""")
def _(d):
    return A.well_dimensions(d.sites())


@query("well_offsets", f"""WITH {LAYOUT} SELECT well_id, woy AS well_offset_y, wox AS well_offset_x FROM wo""")
def _(d):
    return L.well_offsets(d.wells(), L.plate_layout(d.sites(), d.wells(), d.plates(), CFG), CFG).select(
        "well_id", "well_offset_y", "well_offset_x")


def offsets(d):
    return L.site_offsets(d.sites(), d.wells(), d.plates(), CFG)


@query("site_offsets", f"""WITH {LAYOUT} SELECT site_id, offset_y, offset_x, offset_y + top_residue AS aligned_offset_y,
    offset_x + left_residue AS aligned_offset_x, 64 - top_residue - bottom_residue AS aligned_height,
    64 - left_residue - right_residue AS aligned_width FROM so""")
def _(d):
    return offsets(d).select("site_id", "offset_y", "offset_x", "aligned_offset_y", "aligned_offset_x",
                             "aligned_height", "aligned_width")


@query("static_site_objects", f"""WITH {LAYOUT} SELECT site_id, offset_x + left_residue + 1 AS x0,
    offset_x + left_residue + 1 + (64 - left_residue - right_residue) - 3 AS x1, -(offset_y + top_residue + 1) AS y1,
    -(offset_y + top_residue + 1) - (64 - top_residue - bottom_residue - 3) AS y0, CAST(5 AS INTEGER) AS n_points FROM so""")
def _(d):
    out = L.static_objects(offsets(d), "site_id", "aligned_offset_y", "aligned_offset_x", "aligned_height", "aligned_width")
    return out.select("site_id", "x0", "x1", "y0", "y1", F.size("polygon").alias("n_points"))


@query("static_well_objects", f"""WITH {LAYOUT} SELECT well_id, wox + 1 AS x0, wox + 1 + well_width - 3 AS x1, -(woy + 1) AS y1,
    -(woy + 1) - (well_height - 3) AS y0 FROM wo""")
def _(d):
    w = L.well_offsets(d.wells(), L.plate_layout(d.sites(), d.wells(), d.plates(), CFG), CFG)
    return L.static_objects(w, "well_id", "well_offset_y", "well_offset_x", "well_height", "well_width").drop("polygon")


# --- tiles --------------------------------------------------------------------------

def level_table(d):
    """Zoom levels of the map over all plates."""
    return L.pyramid_levels(L.pyramid_size(L.plate_layout(d.sites(), d.wells(), d.plates(), CFG), CFG), CFG)


_LEVELS = f"""{LAYOUT}, sz AS (SELECT max(plate_height) * 3 + 2000 AS height, max(plate_width) * 2 + 1000 AS width FROM pl),
  dep AS (SELECT *, (SELECT min(k) FROM (SELECT unnest(generate_series(1, 30)) AS k) WHERE ceil(height / 2.0 ** k) <= 256 AND ceil(width / 2.0 ** k) <= 256) AS k FROM sz),
  lv AS (SELECT *, CAST(unnest(generate_series(0, k)) AS INTEGER) AS z FROM dep),
  levels AS (SELECT z, CAST(ceil(height / 2.0 ** (k - z)) AS BIGINT) AS level_height, CAST(ceil(width / 2.0 ** (k - z)) AS BIGINT) AS level_width,
    CAST(ceil(ceil(height / 2.0 ** (k - z)) / 256) AS BIGINT) AS n_rows, CAST(ceil(ceil(width / 2.0 ** (k - z)) / 256) AS BIGINT) AS n_cols,
    CAST(k + 1 AS INTEGER) AS n_levels FROM lv)"""


@query("pyramid_levels", f"WITH {_LEVELS} SELECT * FROM levels")
def _(d):
    return level_table(d).drop("height", "width")


_TILES = f"""{_LEVELS}, cov AS (SELECT site_id, offset_y, offset_x,
    unnest(generate_series(offset_y // 256, CAST(ceil((offset_y + 64) / 256) AS BIGINT) - 1)) AS tile_y FROM so),
  tiles AS (SELECT site_id, offset_y, offset_x, tile_y, unnest(generate_series(offset_x // 256, CAST(ceil((offset_x + 64) / 256) AS BIGINT) - 1)) AS tile_x FROM cov)"""


@query("map_sites_to_tiles", f"""WITH {_TILES} SELECT site_id, tile_y, tile_x, tile_y * 256 - offset_y AS in_site_y, tile_x * 256 - offset_x AS in_site_x FROM tiles""")
def _(d):
    return L.map_sites_to_tiles(offsets(d), CFG).select("site_id", "tile_y", "tile_x", "in_site_y", "in_site_x")


@query("empty_tiles", f"""WITH {_TILES}, b AS (SELECT n_rows, n_cols FROM levels ORDER BY z DESC LIMIT 1),
    g AS (SELECT ty AS tile_y, unnest(generate_series(0, n_cols - 1)) AS tile_x FROM (SELECT *, unnest(generate_series(0, n_rows - 1)) AS ty FROM b))
    SELECT tile_y, tile_x FROM g EXCEPT SELECT tile_y, tile_x FROM tiles""")
def _(d):
    base = level_table(d).filter(F.col("z") == F.col("n_levels") - 1)
    return L.empty_tiles(base, L.map_sites_to_tiles(offsets(d), CFG))


def all_tiles(d):
    rows = level_table(d).withColumn("y", F.explode(F.expr("sequence(0, n_rows - 1)")))
    return rows.withColumn("x", F.explode(F.expr("sequence(0, n_cols - 1)"))).select("z", "y", "x", "n_levels")


@query("child_tiles", f"""WITH {_LEVELS}, t AS (SELECT z, y, unnest(generate_series(0, n_cols - 1)) AS x FROM (
      SELECT *, unnest(generate_series(0, n_rows - 1)) AS y FROM levels)),
    e AS (SELECT z, y, x, y * 2 + dy AS child_y, x * 2 + dx AS child_x FROM t, (SELECT unnest([0, 1]) AS dy), (SELECT unnest([0, 1]) AS dx))
    SELECT e.z, y, x, child_y, child_x FROM e JOIN levels l ON l.z = e.z + 1 WHERE child_y < l.n_rows AND child_x < l.n_cols""")
def _(d):
    return L.child_tiles(all_tiles(d).drop("n_levels"), level_table(d))


@query("tile_bounding_boxes", f"""WITH {_LEVELS}, t AS (SELECT z, y, unnest(generate_series(0, n_cols - 1)) AS x, n_levels FROM (
      SELECT *, unnest(generate_series(0, n_rows - 1)) AS y FROM levels))
    SELECT z, y, x, x * 256 * 2.0::DOUBLE ** (n_levels - 1 - z) AS x0, -(y + 1) * 256 * 2.0::DOUBLE ** (n_levels - 1 - z) AS y0,
      (x + 1) * 256 * 2.0::DOUBLE ** (n_levels - 1 - z) AS x1, -y * 256 * 2.0::DOUBLE ** (n_levels - 1 - z) AS y1 FROM t""")
def _(d):
    t = all_tiles(d).withColumn("maxzoom", F.col("n_levels") - 1)
    return L.tile_bounding_boxes(t, "maxzoom").select("z", "y", "x", "x0", "y0", "x1", "y1")


@query("zoom_thresholds", """WITH t AS (SELECT n_nationkey, n_nationkey % 12 AS maxzoom, ['Plate', 'Well', 'Site'][n_nationkey % 3 + 1] AS ref_type,
      n_nationkey % 2 = 0 AS st, n_nationkey % 5 <> 0 AS poly FROM nation)
    SELECT n_nationkey, greatest(CASE WHEN st THEN CASE ref_type WHEN 'Well' THEN maxzoom - 11 WHEN 'Site' THEN maxzoom - 8 ELSE 0 END
        WHEN poly THEN maxzoom - 4 ELSE maxzoom + 1 END, 0) AS polygon_thresh,
      greatest(CASE WHEN st THEN 0 WHEN poly THEN maxzoom - 6 ELSE maxzoom - 1 END, 0) AS centroid_thresh FROM t""")
def _(d):
    t = d.table("nation").selectExpr("n_nationkey", "n_nationkey % 12 AS maxzoom",
                                     "array('Plate', 'Well', 'Site')[n_nationkey % 3] AS ref_type",
                                     "n_nationkey % 2 = 0 AS st", "n_nationkey % 5 <> 0 AS poly")
    return t.withColumn("r", zoom_thresholds("ref_type", "maxzoom", "st", "poly")).select("n_nationkey", "r.*")
