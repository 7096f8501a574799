"""Readers of microscope metadata held as text in a column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_PLANE = "STRUCT<_TheC: INT, _TheZ: INT, _TheT: INT, _PositionX: DOUBLE, _PositionY: DOUBLE, _PositionZ: DOUBLE>"
_OME = f"""Image ARRAY<STRUCT<_Name: STRING, AcquisitionDate: STRING, Pixels: STRUCT<
  _SizeC: INT, _SizeZ: INT, _SizeT: INT, _SizeX: INT, _SizeY: INT, _DimensionOrder: STRING, _Type: STRING,
  Channel: ARRAY<STRUCT<_Name: STRING>>, Plane: ARRAY<{_PLANE}>>>>"""

_LOG = """MeasurementRecord ARRAY<STRUCT<_VALUE: STRING, _Time: STRING, _Column: INT, _Row: INT, _FieldIndex: INT,
  _TimelineIndex: INT, _ZIndex: INT, _Ch: STRING, _X: DOUBLE, _Y: DOUBLE, _Z: DOUBLE, _Type: STRING>>"""


def read_omexml(df: DataFrame, column: str = "xml") -> DataFrame:
    """One row per image of each OME document, planes and channels as arrays."""
    keep = [c for c in df.columns if c != column]
    parsed = df.select(*keep, F.from_xml(column, _OME, {"ignoreNamespace": "true"}).alias("_ome"))
    image = parsed.select(*keep, F.posexplode("_ome.Image").alias("image_index", "_i"))
    return image.select(
        *keep, "image_index", F.col("_i._Name").alias("name"),
        F.col("_i.Pixels._SizeC").alias("size_c"), F.col("_i.Pixels._SizeZ").alias("size_z"),
        F.col("_i.Pixels._SizeT").alias("size_t"), F.col("_i.Pixels._SizeX").alias("size_x"),
        F.col("_i.Pixels._SizeY").alias("size_y"),
        F.col("_i.Pixels._DimensionOrder").alias("dimension_order"),
        F.col("_i.Pixels._Type").alias("pixel_type"),
        F.transform("_i.Pixels.Channel", lambda c: c["_Name"]).alias("channels"),
        F.transform("_i.Pixels.Plane", lambda p: F.struct(
            p["_TheC"].alias("c"), p["_TheZ"].alias("z"), p["_TheT"].alias("t"),
            p["_PositionX"].alias("stage_x"), p["_PositionY"].alias("stage_y"),
            p["_PositionZ"].alias("stage_z"))).alias("planes"))


def read_measurement_log(df: DataFrame, column: str = "xml", extension: str = ".png") -> DataFrame:
    """One row per recorded image; failed acquisitions are left out and the names
    of converted images get the given extension."""
    keep = [c for c in df.columns if c != column]
    parsed = df.select(*keep, F.from_xml(column, _LOG, {"ignoreNamespace": "true"}).alias("_log"))
    record = parsed.select(*keep, F.explode("_log.MeasurementRecord").alias("_r")).filter("_r._Type <> 'ERR'")
    return record.select(
        *keep, F.regexp_replace("_r._VALUE", r"\.tif", extension).alias("name"),
        F.format_string("%s%02d", F.chr(F.col("_r._Row") + 64), F.col("_r._Column")).alias("well_name"),
        F.col("_r._Ch").alias("channel_name"), F.col("_r._X").alias("stage_x"), F.col("_r._Y").alias("stage_y"),
        F.col("_r._Z").alias("stage_z"), F.col("_r._ZIndex").alias("zplane"),
        F.col("_r._TimelineIndex").alias("tpoint"), F.col("_r._Time").alias("acquired_at"))


def read_keyvalue_metadata(lines: DataFrame, column: str = "value") -> DataFrame:
    """Typed values of ``"key", value`` lines: booleans, quoted text, integers,
    decimals with a comma, and stage positions with row, column and site."""
    keep = [c for c in lines.columns if c != column]
    line = F.regexp_replace(F.col(column), r"\r$", "")
    pattern = r'^"(.*)", (.+)$'
    raw = F.regexp_extract(line, pattern, 2)
    text = F.regexp_extract(raw, r'"(.+)"', 1)
    number = F.regexp_replace(raw, r"^(\d+),(\d+)$", "$1.$2")

    def stage(part, regex, cast):
        found = F.regexp_extract(raw, regex, 1)
        complete = (F.col("key").startswith("Stage") & raw.rlike(r"row:\w+,") & raw.rlike(r"column:\d+,")
                    & raw.rlike(r"site:\d+"))
        return F.when(complete, found).cast(cast).alias(part)

    keyed = (lines.filter(~F.col(column).contains("NDInfoFile") & ~F.col(column).contains("EndFile"))
             .withColumn("key", F.regexp_extract(line, pattern, 1)))
    return keyed.select(
        *keep, "key",
        F.when(raw == "TRUE", True).when(raw == "FALSE", False).alias("bool_value"),
        F.when(text != "", text).alias("text_value"),
        F.when(raw.rlike(r"^\d+$"), raw).cast("long").alias("int_value"),
        F.when(number.rlike(r"^\d+\.\d+$"), number).cast("double").alias("double_value"),
        stage("stage_row", r"row:(\w+),", "string"), stage("stage_column", r"column:(\d+),", "int"),
        stage("stage_site", r"site:(\d+)", "int"))


def create_planes(images: DataFrame) -> DataFrame:
    """Planes of images that only declare their sizes, counted in the dimension order.

    Time points come from the time size; the fastest dimension is the last of the order
    of the three positions, as the plane counter is built from the outermost one.
    """
    order = F.array_sort(F.array(*[F.struct(
        F.instr("dimension_order", d).alias("pos"), F.lit(d).alias("dim"), F.col(f"size_{d.lower()}").alias("n"))
        for d in "CZT"]))
    base = images.withColumn("_o", order).withColumn("_count", F.expr("size_c * size_z * size_t"))
    counted = base.withColumn("plane", F.explode(F.sequence(F.lit(0), F.col("_count") - 1)))
    inner = F.expr("plane % _o[2].n")
    middle = F.expr("(plane DIV _o[2].n) % _o[1].n")
    outer = F.expr("plane DIV (_o[2].n * _o[1].n)")

    def index(d):
        return (F.when(F.expr("_o[0].dim") == d, outer).when(F.expr("_o[1].dim") == d, middle)
                .otherwise(inner).cast("int"))

    return counted.select(*[c for c in images.columns if c != "planes"], "plane",
                          index("C").alias("c"), index("Z").alias("z"), index("T").alias("t"))


def combine_metadata(per_file: DataFrame, extra: DataFrame, key: str = "name") -> DataFrame:
    """Join metadata of image files with a separate document: image attributes come
    from the file when present, plane attributes from the document when present."""
    plane_columns = {"stage_x", "stage_y", "stage_z", "c", "z", "t"}
    a, b = per_file.alias("a"), extra.alias("b")
    joined = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    out = [F.coalesce(F.col(f"a.{key}"), F.col(f"b.{key}")).alias(key)]
    names = [c for c in per_file.columns if c != key]
    names += [c for c in extra.columns if c != key and c not in names]
    for c in names:
        sides = [f"{s}.{c}" for s, cols in (("a", per_file.columns), ("b", extra.columns)) if c in cols]
        if c in plane_columns:
            sides.reverse()
        out.append(F.coalesce(*[F.col(s) for s in sides]).alias(c))
    return joined.select(*out)


def check_image_counts(per_file: DataFrame, extra: DataFrame) -> None:
    if per_file.count() != extra.count():
        raise ValueError("number of images differs between files and metadata")


def missing_metadata(planes: DataFrame) -> DataFrame:
    """Names of the attributes that are missing somewhere."""
    checks = {"well": F.length(F.coalesce("well_name", F.lit(""))) < 3, "channel": F.col("channel_name").isNull(),
              "zplane": F.col("zplane").isNull(), "tpoint": F.col("tpoint").isNull()}
    flagged = planes.agg(*[F.coalesce(F.max(check), F.lit(False)).alias(n) for n, check in checks.items()])
    return flagged.select(F.explode(F.array(*[F.struct(
        F.lit(n).alias("attribute"), F.col(n).alias("is_missing")) for n in checks])).alias("r")).select("r.*")
