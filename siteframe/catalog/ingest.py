"""Queries over files and microscope metadata."""

from pyspark.sql import functions as F

from siteframe.catalog import query
from siteframe.core import cut_lineage
from siteframe.functions import scalars as S
from siteframe.operators import aggregates as A
from siteframe.operators import layout as L
from siteframe.plans import configure as C
from siteframe.sources import files as SF
from siteframe.sources import metadata as SM

IMAGE, META = S.IMAGE_PATTERNS["cellvoyager"], S.METADATA_PATTERNS["cellvoyager"]
IMG = "'[^_]+_([A-Z]\\d{2})_T(\\d+)F(\\d+)L\\d+A\\d+Z(\\d+)([C]\\d{2})\\.'"
MET = "'.*\\.(mlf|mrf)$'"


@query("register_files", f"""SELECT DISTINCT name, CASE WHEN regexp_matches(name, {IMG}) THEN 'image' ELSE 'metadata' END AS kind
    FROM d_files WHERE (regexp_matches(name, {IMG}) OR regexp_matches(name, {MET}))
      AND name NOT IN (SELECT name FROM d_files WHERE l_orderkey % 10 = 3)""")
def _(d):
    files = d.files()
    return SF.register_files(files, IMAGE, META, files.filter("l_orderkey % 10 = 3"))


@query("check_file_validity", f"""SELECT name, regexp_matches(name, {IMG}) OR regexp_matches(name, {MET}) AS is_valid,
    count(*) AS n FROM d_files GROUP BY ALL""")
def _(d):
    return (SF.check_file_validity(d.files().groupBy("name").agg(F.count(F.lit(1)).alias("n")), IMAGE, META)
            .select("name", "is_valid", "n"))


@query("file_status_rollup", """SELECT acquisition_id, CASE WHEN bool_or(status = 'UPLOADING') THEN 'UPLOADING'
      WHEN bool_and(status = 'COMPLETE') THEN 'COMPLETE' ELSE 'WAITING' END AS status,
    count(*) AS n_files, count(*) FILTER (status = 'COMPLETE') AS n_complete FROM d_files GROUP BY 1""")
def _(d):
    return A.file_status_rollup(d.files(), "acquisition_id")


def ome_documents(d):
    """One OME document per part with as many planes as its size allows."""
    plane = F.expr("""concat('<Plane TheC="', i % 2, '" TheZ="', i DIV 2, '" TheT="0" PositionX="', i * 10,
        '.5" PositionY="', p_partkey, '.25" PositionZ="0.0"/>')""")
    return (d.table("part").withColumn("i", F.explode(F.expr("sequence(0, p_size % 4)")))
            .groupBy("p_partkey", "p_size", "p_brand").agg(F.array_join(F.array_sort(F.collect_list(plane)), "").alias("pl"))
            .selectExpr("p_partkey", """concat('<?xml version="1.0"?><OME xmlns="http://www.openmicroscopy.org/Schemas/OME/2013-06">',
              '<Image ID="a" Name="img_', p_partkey, '"><AcquisitionDate>2015-08-20</AcquisitionDate>',
              '<Pixels SizeC="2" SizeZ="', p_size % 3 + 1, '" SizeT="', p_size % 2 + 1, '" SizeX="64" SizeY="64" ',
              'DimensionOrder="', if(p_size % 2 = 0, 'XYCZT', 'XYTZC'), '" Type="uint16"><Channel Name="', p_brand,
              '"/>', pl, '</Pixels></Image></OME>') AS xml"""))


@query("read_omexml", """SELECT p_partkey, 'img_' || p_partkey AS name, p_brand AS channel,
    2 AS size_c, CAST(p_size % 3 + 1 AS INTEGER) AS size_z, 16 AS bit_depth, i % 2 AS c, i // 2 AS z,
    i * 10 + 0.5::DOUBLE AS stage_x, p_partkey + 0.25::DOUBLE AS stage_y
    FROM (SELECT *, CAST(unnest(generate_series(0, p_size % 4)) AS INTEGER) AS i FROM part)""")
def _(d):
    images = SM.read_omexml(ome_documents(d))
    return images.withColumn("p", F.explode("planes")).select(
        "p_partkey", "name", F.get("channels", F.lit(0)).alias("channel"), "size_c", "size_z",
        S.bit_depth("pixel_type").alias("bit_depth"), "p.c", "p.z", "p.stage_x", "p.stage_y")


@query("create_planes", """WITH b AS (SELECT p_partkey, p_size, 2 AS nc, p_size % 3 + 1 AS nz, p_size % 2 + 1 AS nt FROM part),
    e AS (SELECT *, CAST(unnest(generate_series(0, nc * nz * nt - 1)) AS INTEGER) AS plane FROM b)
    SELECT p_partkey, plane, CAST(CASE WHEN p_size % 2 = 0 THEN plane // (nz * nt) ELSE plane % nc END AS INTEGER) AS c,
      CAST(CASE WHEN p_size % 2 = 0 THEN (plane // nt) % nz ELSE (plane // nc) % nz END AS INTEGER) AS z,
      CAST(CASE WHEN p_size % 2 = 0 THEN plane % nt ELSE plane // (nc * nz) END AS INTEGER) AS t FROM e""")
def _(d):
    return SM.create_planes(SM.read_omexml(ome_documents(d))).select("p_partkey", "plane", "c", "z", "t")


@query("combine_metadata", """SELECT 'img_' || p_partkey AS name, CAST(p_size % 3 + 1 AS INTEGER) AS size_z,
    CASE WHEN p_partkey % 2 = 0 THEN 7.5 ELSE p_partkey + 0.25 END::DOUBLE AS stage_y, CAST(p_size % 2 AS INTEGER) AS z FROM part""")
def _(d):
    per_file = SM.read_omexml(ome_documents(d)).selectExpr("name", "size_z", "planes[0].stage_y AS stage_y")
    extra = d.table("part").selectExpr("concat('img_', p_partkey) AS name", "99 AS size_z",
                                       "CAST(if(p_partkey % 2 = 0, 7.5, NULL) AS DOUBLE) AS stage_y",
                                       "CAST(p_size % 2 AS INT) AS z")
    return SM.combine_metadata(per_file, extra)


@query("read_measurement_log", """SELECT l_orderkey, 'p_' || l_partkey || '.png' AS name,
    chr(CAST(64 + l_suppkey % 8 + 1 AS INTEGER)) || lpad(CAST(l_suppkey % 12 + 1 AS VARCHAR), 2, '0') AS well_name,
    CAST(l_linenumber AS VARCHAR) AS channel_name, CAST(l_quantity AS DOUBLE) AS stage_x, CAST(l_linenumber * 2 AS INTEGER) AS zplane
    FROM lineitem WHERE l_returnflag <> 'R'""")
def _(d):
    record = F.expr("""concat('<bts:MeasurementRecord bts:Time="2016-01-01T00:00:00" bts:Column="', l_suppkey % 12 + 1,
      '" bts:Row="', l_suppkey % 8 + 1, '" bts:FieldIndex="1" bts:TimelineIndex="1" bts:ZIndex="', l_linenumber * 2,
      '" bts:Ch="', l_linenumber, '" bts:X="', l_quantity, '" bts:Y="1.5" bts:Z="0.0" bts:Type="',
      if(l_returnflag = 'R', 'ERR', 'IMG'), '">p_', l_partkey, '.tif</bts:MeasurementRecord>')""")
    logs = (d.table("lineitem").groupBy("l_orderkey").agg(F.array_join(F.collect_list(record), "").alias("r"))
            .selectExpr("l_orderkey", """concat('<bts:MeasurementData xmlns:bts="http://www.yokogawa.co.jp/BTS/BTSSchema/1.0">',
              r, '</bts:MeasurementData>') AS xml"""))
    return SM.read_measurement_log(logs).select("l_orderkey", "name", "well_name", "channel_name", "stage_x", "zplane")


@query("read_keyvalue_metadata", """SELECT c_custkey, key, b AS bool_value, t AS text_value, i AS int_value, f AS double_value,
      r AS stage_row, c AS stage_column, s AS stage_site FROM (
    SELECT c_custkey, 'DoStage' AS key, c_custkey % 2 = 0 AS b, NULL AS t, NULL::BIGINT AS i, NULL::DOUBLE AS f, NULL AS r, NULL::INTEGER AS c, NULL::INTEGER AS s FROM customer
    UNION ALL SELECT c_custkey, 'Description', NULL, c_name, NULL, NULL, NULL, NULL, NULL FROM customer
    UNION ALL SELECT c_custkey, 'NStagePositions', NULL, NULL, c_custkey, NULL, NULL, NULL, NULL FROM customer
    UNION ALL SELECT c_custkey, 'ZStepSize', NULL, NULL, NULL, c_nationkey + 0.5, NULL, NULL, NULL FROM customer
    UNION ALL SELECT c_custkey, 'Stage1', NULL, 'row:A,column:' || c_nationkey || ',site:' || c_custkey, NULL, NULL, 'A', c_nationkey, CAST(c_custkey AS INTEGER) FROM customer)""")
def _(d):
    lines = d.table("customer").selectExpr("c_custkey", r"""explode(array('"NDInfoFile", Version 1.0\r',
      concat('"DoStage", ', if(c_custkey % 2 = 0, 'TRUE', 'FALSE'), '\r'), concat('"Description", "', c_name, '"\r'),
      concat('"NStagePositions", ', c_custkey, '\r'), concat('"ZStepSize", ', c_nationkey, ',5\r'),
      concat('"Stage1", "row:A,column:', c_nationkey, ',site:', c_custkey, '"\r'), '"EndFile"\r')) AS value""")
    return SM.read_keyvalue_metadata(lines)


@query("parse_file_names", f"""SELECT DISTINCT name, regexp_extract(name, {IMG}, 1) AS well_name, regexp_extract(name, {IMG}, 5) AS channel,
    CAST(regexp_extract(name, {IMG}, 4) AS INTEGER) AS zplane, CAST(regexp_extract(name, {IMG}, 2) AS INTEGER) AS tpoint,
    CAST(regexp_extract(name, {IMG}, 3) AS INTEGER) AS site FROM d_files WHERE name LIKE 'p\\_%' ESCAPE '\\'""")
def _(d):
    names = d.files().select("name").distinct().filter(F.col("name").startswith("p_"))
    return SF.parse_file_names(names, IMAGE)


@query("action_channels", """SELECT DISTINCT name, 'A01_' || right(replace(name, '.png', ''), 3) AS channel
    FROM d_files WHERE name LIKE 'p\\_%' ESCAPE '\\'""")
def _(d):
    names = d.files().select("name").distinct().filter(F.col("name").startswith("p_"))
    return SF.parse_file_names(names, IMAGE).select("name", S.action_channel("name", "channel").alias("channel"))


@query("well_coordinates", """SELECT well_id, well_y AS row_index, well_x AS col_index, well_name AS rebuilt, true AS is_valid FROM d_wells""")
def _(d):
    return d.wells().select("well_id", S.well_row("well_name").alias("row_index"), S.well_column("well_name").alias("col_index"),
                            S.well_name("well_y", "well_x").alias("rebuilt"), S.is_well_name("well_name").alias("is_valid"))


@query("missing_metadata", """SELECT 'well' AS attribute, bool_or(length(regexp_extract(name, '_([A-Z]\\d{2})_', 1)) < 3) AS is_missing FROM d_files
    UNION ALL SELECT 'channel', bool_or(regexp_extract(name, 'C\\d{2}\\.') = '') FROM d_files
    UNION ALL SELECT 'zplane', bool_or(regexp_extract(name, 'Z(\\d{2})C', 1) = '') FROM d_files
    UNION ALL SELECT 'tpoint', bool_or(regexp_extract(name, '_T(\\d{4})F', 1) = '') FROM d_files WHERE name LIKE 'p!_%' ESCAPE '!'""")
def _(d):
    number = lambda pattern: F.nullif(F.regexp_extract("name", pattern, 1), F.lit("")).cast("int")
    # Files that are no images have no plane; their time point is taken as the first one.
    time = F.when(F.col("name").startswith("p_"), number(r"_T(\d{4})F")).otherwise(0)
    planes = d.files().select(F.regexp_extract("name", r"_([A-Z]\d{2})_", 1).alias("well_name"),
                              F.nullif(F.regexp_extract("name", r"C\d{2}\.", 0), F.lit("")).alias("channel_name"),
                              number(r"Z(\d{2})C").alias("zplane"), time.alias("tpoint"))
    return SM.missing_metadata(planes)


@query("round_stored_values", """SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice,
    CASE WHEN CAST(floor(l_quantity / 2) AS BIGINT) % 2 = 0 AND l_quantity / 2 - floor(l_quantity / 2) = 0.5
      THEN floor(l_quantity / 2) ELSE round(l_quantity / 2) END AS half_even,
    'NaN' = CASE WHEN l_discount = 0 THEN 'NaN' ELSE 'x' END AS is_nan FROM lineitem""")
def _(d):
    return d.table("lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", S.round_stored("l_extendedprice").alias("l_extendedprice"),
        S.round_stored(F.col("l_quantity") / 2, 0).alias("half_even"),
        F.isnan(S.to_float(F.when(F.col("l_discount") == 0, "nan").otherwise("1"))).alias("is_nan"))


@query("result_attributes", """SELECT event_id, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k,
    json_extract_string(props, '$.missing') AS missing FROM events""")
def _(d):
    return d.table("events").select("event_id", F.get_json_object("props", "$.k").alias("k"),
                                    F.get_json_object("props", "$.missing").alias("missing"))


@query("number_tests", """SELECT doc_id, try_cast(source AS DOUBLE) IS NOT NULL AS source_is_number,
    try_cast(CAST(n_chars AS VARCHAR) AS DOUBLE) IS NOT NULL AS chars_is_number FROM documents""")
def _(d):
    return d.table("documents").select("doc_id", S.is_number("source").alias("source_is_number"),
                                       S.is_number(F.col("n_chars").cast("string")).alias("chars_is_number"))


@query("positions_in_list", """WITH t AS (SELECT doc_id, unnest(string_split(text, ' ')) AS w,
      generate_subscripts(string_split(text, ' '), 1) - 1 AS i FROM documents)
    SELECT doc_id, count(*) AS n, CAST(min(i) AS INTEGER) AS first_at, CAST(max(i) AS INTEGER) AS last_at
    FROM t WHERE w = 'the' GROUP BY doc_id""")
def _(d):
    found = d.table("documents").select("doc_id", S.positions_of(F.split("text", " "), F.lit("the")).alias("p"))
    return found.filter(F.size("p") > 0).select(
        "doc_id", F.size("p").cast("long").alias("n"), F.get("p", F.lit(0)).alias("first_at"),
        F.element_at("p", -1).alias("last_at"))


@query("feature_names", """SELECT DISTINCT 'Mean_' || event_type || '_Intensity_max_' || user_id % 3 AS name, true AS is_valid FROM events""")
def _(d):
    name = S.feature_name("Intensity", "max", F.col("user_id") % 3)
    full = F.concat_ws("_", F.lit("Mean"), "event_type", name)
    return d.table("events").select(full.alias("name"), S.is_feature_name(full).alias("is_valid")).distinct()


@query("configure_metadata_layout", """WITH f AS (SELECT DISTINCT name FROM d_files WHERE name LIKE 'p\\_%' ESCAPE '\\'),
    p AS (SELECT name, substr(name, 3, 3) AS well_name, CAST(regexp_extract(name, 'F(\\d+)L', 1) AS INTEGER) AS site,
      CAST(regexp_extract(name, '_T(\\d+)F', 1) AS INTEGER) AS tpoint, regexp_extract(name, '(C\\d{2})\\.', 1) AS channel,
      CAST(regexp_extract(name, 'Z(\\d+)C', 1) AS INTEGER) AS zplane FROM f),
    g AS (SELECT *, site - min(site) OVER (PARTITION BY well_name) AS i FROM p)
    SELECT name, well_name, CAST(i // 3 AS INTEGER) AS grid_y, CAST(CASE WHEN (i // 3) % 2 = 1 THEN 2 - i % 3 ELSE i % 3 END AS INTEGER) AS grid_x,
      CAST(dense_rank() OVER (ORDER BY tpoint) - 1 AS INTEGER) AS tpoint_index, CAST(dense_rank() OVER (ORDER BY channel) - 1 AS INTEGER) AS channel_index,
      CAST(dense_rank() OVER (ORDER BY zplane) - 1 AS INTEGER) AS zplane_index FROM g""")
def _(d):
    names = d.files().filter(F.col("name").startswith("p_"))
    return C.configure_metadata(names, IMAGE, n_rows=3, n_cols=3, layout="zigzag_horizontal").select(
        "name", "well_name", "grid_y", "grid_x", "tpoint_index", "channel_index", "zplane_index")


@query("configure_metadata_positions", """WITH f AS (SELECT DISTINCT name FROM d_files WHERE name LIKE 'p\\_%' ESCAPE '\\'),
    p AS (SELECT name, substr(name, 3, 3) AS well_name, CAST(regexp_extract(name, 'F(\\d+)L', 1) AS INTEGER) - 1 AS s FROM f)
    SELECT name, well_name, CAST(dense_rank() OVER (PARTITION BY well_name ORDER BY s // 3) - 1 AS INTEGER) AS grid_y,
      CAST(dense_rank() OVER (PARTITION BY well_name ORDER BY s % 3) - 1 AS INTEGER) AS grid_x FROM p""")
def _(d):
    names = cut_lineage(d.files().select("name").filter(F.col("name").startswith("p_")).distinct())
    site = SF.parse_file_names(names, IMAGE).withColumn("s", F.col("site") - 1)
    positions = site.selectExpr("name", "well_name", "s DIV 3 * 1000.0D AS stage_y", "s % 3 * 1000.0D AS stage_x")
    return C.configure_metadata(names, IMAGE, positions=positions).select("name", "well_name", "grid_y", "grid_x")


@query("configure_metadata_ome", """WITH f AS (SELECT DISTINCT name FROM d_files WHERE name LIKE 'p\\_%' ESCAPE '\\'),
    p AS (SELECT name, substr(name, 3, 3) AS well_name, CAST(regexp_extract(name, 'F(\\d+)L', 1) AS INTEGER) AS site FROM f),
    g AS (SELECT *, site - min(site) OVER (PARTITION BY well_name) AS i, CASE WHEN site % 3 = 0 THEN 'DAPI' ELSE regexp_extract(name, '(C\\d{2})\\.', 1) END AS channel FROM p)
    SELECT name, well_name, channel, CAST(i // 3 AS INTEGER) AS grid_y, CAST(i % 3 AS INTEGER) AS grid_x FROM g""")
def _(d):
    # Files of every third site tell their channel; no position is known for the last ones, so that the layout counts.
    names = cut_lineage(d.files().select("name").filter(F.col("name").startswith("p_")).distinct())
    site = SF.parse_file_names(names, IMAGE)
    ome = site.filter("site % 3 = 0").select("name", F.lit(None).cast("string").alias("well_name"), F.lit("DAPI").alias("channel"),
                                             F.lit(None).cast("int").alias("zplane"), F.lit(None).cast("int").alias("tpoint"), "site")
    positions = site.filter("site < 9").selectExpr("name", "well_name", "0.0D AS stage_y", "0.0D AS stage_x")
    return C.configure_metadata(names, IMAGE, positions=positions, n_rows=3, n_cols=3, ome=ome).select("name", "well_name", "channel", "grid_y", "grid_x")


@query("group_stacks", """WITH f AS (SELECT DISTINCT name, substr(name, 3, 3) AS well_name, regexp_extract(name, 'F(\\d+)L', 1) AS site,
      CAST(regexp_extract(name, '_T(\\d+)F', 1) AS INTEGER) AS tpoint, regexp_extract(name, '(C\\d{2})\\.', 1) AS channel
      FROM d_files WHERE name LIKE 'p\\_%' ESCAPE '\\')
    SELECT well_name, CAST(site AS INTEGER) AS site, channel, tpoint, string_agg(name, ',' ORDER BY name) AS files FROM f GROUP BY ALL""")
def _(d):
    names = d.files().select("name").filter(F.col("name").startswith("p_")).distinct()
    stacks = C.group_stacks(SF.parse_file_names(names, IMAGE), ("well_name", "site"))
    return stacks.select("well_name", "site", "channel", "tpoint",
                         F.array_join(F.transform("file_map", lambda f: f["file"]), ",").alias("files"))


@query("file_maps", """SELECT DISTINCT name, name || ':0:0' AS location FROM d_files WHERE name LIKE 'p\\_%' ESCAPE '\\'""")
def _(d):
    names = d.files().select("name").filter(F.col("name").startswith("p_")).distinct()
    m = C.file_maps(names.withColumn("k", F.col("name")), ("k",))
    return m.select(F.col("k").alias("name"), F.expr("concat_ws(':', file_map[0].file, file_map[0].series, file_map[0].plane)").alias("location"))
