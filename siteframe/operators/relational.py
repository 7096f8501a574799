"""Projections, filters, joins, ordering and set operators over screening tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteframe.core import require_empty, range_index


# --- projections and filters -------------------------------------------------

def select_features(values: DataFrame, ids: Sequence[int | str]) -> DataFrame:
    """Keep only the given feature ids in the map of values."""
    wanted = [str(i) for i in ids]
    return values.withColumn("values", F.map_filter("values", lambda k, v: k.isin(wanted)))


def drop_feature(values: DataFrame, feature_id: int | str) -> DataFrame:
    """Delete one feature from the map of every object."""
    return values.withColumn("values", F.map_filter("values", lambda k, v: k != str(feature_id)))


def rename_features(values: DataFrame, features: DataFrame) -> DataFrame:
    """Replace feature ids by names. `features` is the feature list of a few
    object types, carried along as one single-row map."""
    lookup = features.agg(F.map_from_entries(F.collect_list(F.struct(
        F.col("feature_id").cast("string"), "feature_name"))).alias("_names"))
    return (values.join(F.broadcast(lookup))
            .withColumn("values", F.expr(
                "transform_keys(values, (k, v) -> coalesce(_names[k], k))"))
            .drop("_names"))


def finite(column: str | Column) -> Column:
    """Neither missing nor NaN."""
    column = F.col(column) if isinstance(column, str) else column
    return column.isNotNull() & ~F.isnan(column)


def _check_known(df: DataFrame, column: str, value) -> None:
    if value is not None and df.filter(F.col(column) == F.lit(value)).isEmpty():
        raise ValueError(f"unknown {column}: {value}")


def filter_plates(plates: DataFrame, plate_name: str | None = None) -> DataFrame:
    _check_known(plates, "plate_name", plate_name)
    return plates if plate_name is None else plates.filter(F.col("plate_name") == plate_name)


def filter_wells(wells: DataFrame, plates: DataFrame, plate_name: str | None = None,
                 well_name: str | None = None) -> DataFrame:
    found = wells.join(filter_plates(plates, plate_name), "plate_id")
    if well_name is None:
        return found
    _check_known(found, "well_name", well_name)
    return found.filter(F.col("well_name") == well_name)


def filter_sites(sites: DataFrame, wells: DataFrame, plates: DataFrame,
                 plate_name: str | None = None, well_name: str | None = None,
                 well_pos_y: int | None = None, well_pos_x: int | None = None,
                 ref_type: str = "Site") -> DataFrame:
    """Sites by position; an unknown value is an error and not an empty result."""
    if ref_type == "Plate" and (well_name is not None or well_pos_y is not None
                                or well_pos_x is not None):
        raise ValueError("objects of a plate cannot be filtered by well or site")
    if ref_type == "Well" and (well_pos_y is not None or well_pos_x is not None):
        raise ValueError("objects of a well cannot be filtered by site")
    found = sites.join(filter_wells(wells, plates, plate_name, well_name), "well_id")
    for column, value in (("site_y", well_pos_y), ("site_x", well_pos_x)):
        if value is not None:
            _check_known(found, column, value)
            found = found.filter(F.col(column) == value)
    return found


def filter_layers(layers: DataFrame, tpoint: int | None = None, zplane: int | None = None,
                  name: str | None = None, name_column: str = "type_name") -> DataFrame:
    for column, value in (("tpoint", tpoint), ("zplane", zplane), (name_column, name)):
        if value is not None:
            layers = layers.filter(F.col(column) == value)
    return layers


def list_dimension(dim: DataFrame, name_column: str, name: str | None = None) -> DataFrame:
    found = dim if name is None else dim.filter(F.col(name_column) == name)
    return found.orderBy(name_column)


def filter_ids(df: DataFrame, ids: DataFrame, column: str = "mapobject_id") -> DataFrame:
    return df.join(ids.select(column).distinct(), column, "left_semi")


def drop_omitted(sites: DataFrame) -> DataFrame:
    return sites.filter(~F.col("omitted"))


# --- joins ------------------------------------------------------------------

def site_hierarchy(sites: DataFrame, wells: DataFrame, plates: DataFrame) -> DataFrame:
    return sites.join(wells, "well_id").join(plates, "plate_id")


def resolve_features(features: DataFrame, types: DataFrame, type_name: str,
                     names: Sequence[str] | None = None) -> DataFrame:
    """Features of one object type; asking for an unknown name is an error."""
    found = features.join(types.filter(F.col("type_name") == type_name), "mapobject_type_id")
    if names is None:
        return found
    known = {r.feature_name for r in found.filter(F.col("feature_name").isin(list(names)))
             .select("feature_name").collect()}
    missing = [n for n in names if n not in known]
    if missing:
        raise ValueError(f"unknown features of {type_name}: {missing}")
    return found.filter(F.col("feature_name").isin(list(names)))


def load_feature_values(objects: DataFrame, values: DataFrame, ids: DataFrame | None = None
                        ) -> DataFrame:
    """Objects with their feature values, co-located on the partition key."""
    if ids is not None:
        values = filter_ids(values, ids)
    keyed = objects.withColumnRenamed("id", "mapobject_id")
    return keyed.join(values, ["partition_key", "mapobject_id"])


def feature_matrix(values: DataFrame, names: dict[str, str]) -> DataFrame:
    """Map of values to one column per feature; `names` maps ids to column names."""
    keep = [c for c in values.columns if c != "values"]
    return values.select(*keep, *[
        F.coalesce(F.col("values")[str(i)], F.lit(float("nan"))).alias(n)
        for i, n in names.items()])


def objects_at_position(objects: DataFrame, segmentations: DataFrame, sites: DataFrame,
                        type_id: int, layer_ids: Sequence[int] | None = None) -> DataFrame:
    """Objects of one type that are segmented in the given sites."""
    segs = segmentations if layer_ids is None else segmentations.filter(
        F.col("segmentation_layer_id").isin(list(layer_ids)))
    keyed = (objects.filter(F.col("mapobject_type_id") == type_id)
             .withColumnRenamed("id", "mapobject_id"))
    return (keyed.join(segs, ["partition_key", "mapobject_id"])
            .join(sites.withColumnRenamed("site_id", "partition_key"), "partition_key"))


def feature_values_per_site(objects: DataFrame, values: DataFrame, type_id: int,
                            site_id: int | None = None) -> DataFrame:
    """Values of all segmented objects; not repeated once per segmentation layer."""
    keyed = objects.filter(F.col("mapobject_type_id") == type_id)
    if site_id is not None:
        keyed = keyed.filter(F.col("partition_key") == site_id)
        values = values.filter(F.col("partition_key") == site_id)
    return load_feature_values(keyed, values)


def segmentations_per_site(objects: DataFrame, segmentations: DataFrame, type_id: int,
                           as_polygons: bool = True) -> DataFrame:
    """Outline of each object as polygon text or as its centre point."""
    keyed = (objects.filter(F.col("mapobject_type_id") == type_id)
             .select("partition_key", F.col("id").alias("mapobject_id")))
    joined = keyed.join(segmentations, ["partition_key", "mapobject_id"])
    ring = ("concat_ws(',', concat(x0,' ',y0), concat(x1,' ',y0), concat(x1,' ',y1),"
            " concat(x0,' ',y1), concat(x0,' ',y0))")
    point = "concat(CAST((x0 + x1) DIV 2 AS STRING), ' ', CAST((y0 + y1) DIV 2 AS STRING))"
    return joined.withColumn("outline", F.expr(ring if as_polygons else point))


def object_info(ids: DataFrame, objects: DataFrame, types: DataFrame, sites: DataFrame,
                wells: DataFrame, plates: DataFrame, segmentations: DataFrame) -> DataFrame:
    """Type, position and layer of each requested object."""
    return (ids.join(objects.withColumnRenamed("id", "mapobject_id"), "mapobject_id")
            .join(types, "mapobject_type_id", "left")
            .join(sites.withColumnRenamed("site_id", "partition_key"), "partition_key", "left")
            .join(wells, "well_id", "left").join(plates, "plate_id", "left")
            .join(segmentations, ["partition_key", "mapobject_id"], "left"))


def objects_missing_segmentation(objects: DataFrame, segmentations: DataFrame) -> DataFrame:
    return objects.join(
        segmentations.select("partition_key", F.col("mapobject_id").alias("id")),
        ["partition_key", "id"], "left_anti")


def objects_missing_features(objects: DataFrame, values: DataFrame) -> DataFrame:
    """Objects without values, for those types that have any values at all."""
    keys = values.select("partition_key", F.col("mapobject_id").alias("id")).distinct()
    typed = (objects.join(keys, ["partition_key", "id"], "left_semi")
             .select("mapobject_type_id").distinct())
    return (objects.join(typed, "mapobject_type_id", "left_semi")
            .join(keys, ["partition_key", "id"], "left_anti"))


def linked_objects(objects: DataFrame) -> DataFrame:
    """Objects with the object they point at (parents, tracks)."""
    target = objects.select(F.col("id").alias("ref_id"),
                            F.col("mapobject_type_id").alias("ref_type_id"),
                            F.col("partition_key").alias("ref_partition_key"))
    return objects.filter(F.col("ref_id").isNotNull()).join(target, "ref_id")


def site_neighbours(sites: DataFrame) -> DataFrame:
    """For each site the ids of its upper, left and upper-left neighbours in the
    well and whether lower and right neighbours exist."""
    here = sites.select("site_id", "well_id", "site_y", "site_x", "omitted")
    targets = here.select(
        "well_id", F.col("site_id").alias("n_id"), F.col("omitted").alias("n_omitted"),
        F.explode(F.array(*[
            F.struct((F.col("site_y") + dy).alias("site_y"), (F.col("site_x") + dx).alias("site_x"),
                     F.lit(side).alias("side"))
            for side, dy, dx in (("upper", 1, 0), ("left", 0, 1), ("upper_left", 1, 1),
                                 ("lower", -1, 0), ("right", 0, -1))])).alias("t")
    ).select("well_id", "n_id", "n_omitted", "t.*")
    joined = here.join(targets, ["well_id", "site_y", "site_x"], "left")

    def kept(side):
        return F.max(F.when((F.col("side") == side) & ~F.col("n_omitted"), F.col("n_id")))

    def exists(side):
        return F.coalesce(F.max(F.col("side") == side), F.lit(False))

    return joined.groupBy("site_id", "well_id", "site_y", "site_x").agg(
        kept("upper").alias("upper_id"), kept("left").alias("left_id"),
        kept("upper_left").alias("upper_left_id"),
        exists("lower").alias("has_lower"), exists("right").alias("has_right"))


def pair_cycles(images: DataFrame, reference_cycle: int, wavelength: str) -> DataFrame:
    """Images of the registration wavelength next to the reference cycle's image
    of the same site; a cycle without such images is an error."""
    used = images.filter(F.col("wavelength") == wavelength)
    cycles = images.select("cycle_id").distinct()
    require_empty(cycles.join(used, "cycle_id", "left_anti"), "no images of the wavelength in cycle")
    reference = used.filter(F.col("cycle_id") == reference_cycle).select(
        "site_id", F.col("image_id").alias("reference_image_id"))
    return used.withColumnRenamed("image_id", "target_image_id").join(reference, "site_id")


def align_measurements(labels: DataFrame, measured: DataFrame, keys: Sequence[str],
                       order_by: str) -> DataFrame:
    """One row per label: first measurement of a repeated label, NaN for a missing
    one; measurements of unknown labels are dropped."""
    columns = [c for c in measured.columns if c not in (*keys, order_by)]
    first = measured.groupBy(*keys).agg(
        F.min_by(F.struct(*columns), F.col(order_by)).alias("_first"))
    return labels.join(first, list(keys), "left").select(*keys, *[
        F.coalesce(F.col(f"_first.{c}"), F.lit(float("nan"))).alias(c) for c in columns])


def assign_children(children: DataFrame, parents: DataFrame, image: Sequence[str]) -> DataFrame:
    """Pairs of child and parent labels that share a pixel."""
    return (children.withColumnRenamed("label", "child")
            .join(parents.withColumnRenamed("label", "parent"), [*image, "y", "x"])
            .select(*image, "child", "parent").distinct())


# --- ordering, top-k, sampling ------------------------------------------------

def ordered(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.orderBy(*keys)


def sample_objects(objects: DataFrame, n: int, seed: int = 0, key: str = "id") -> DataFrame:
    """Random subset of `n` objects, repeatable for the same seed."""
    return objects.orderBy(F.md5(F.concat_ws(":", F.lit(seed), F.col(key))), key).limit(n)


def natural_key(name: str | Column) -> Column:
    """Sort key in which runs of digits of any length compare as numbers: the digits
    without leading zeros, behind how many they are."""
    column = F.col(name) if isinstance(name, str) else name
    parts = F.regexp_extract_all(column, F.lit(r"(\d+|\D+)"), F.lit(1))
    digits = lambda p: F.regexp_replace(p, "^0+(?=.)", "")
    return F.array_join(F.transform(parts, lambda p: F.when(
        p.rlike(r"^\d"), F.concat(F.lpad(F.length(digits(p)).cast("string"), 10, "0"), digits(p))).otherwise(p)), "")


def top_k_per_group(df: DataFrame, group: Sequence[str], order: str, tie: str, k: int) -> DataFrame:
    """The `k` rows of each group with the largest value. A first cut inside hash
    parts keeps the final ranking small however large a group is."""
    part = df.withColumn("_part", F.pmod(F.xxhash64(F.col(tie)), F.lit(64)))
    by = [F.desc(order), F.col(tie)]
    return (part.withColumn("_r", F.row_number().over(Window.partitionBy(*group, "_part").orderBy(*by)))
            .filter(F.col("_r") <= k)
            .withColumn("_r", F.row_number().over(Window.partitionBy(*group).orderBy(*by)))
            .filter(F.col("_r") <= k).drop("_r", "_part"))


def linspace_sample(df: DataFrame, n: int, key: str) -> DataFrame:
    """`n` rows at evenly spaced positions ``i * N // n`` of the key order."""
    total = df.agg(F.count(F.lit(1)).alias("_total"))
    ranked = range_index(df, [key], "_pos").join(F.broadcast(total))
    step = F.expr(f"(_pos * {n} + _total - 1) DIV _total")
    kept = ranked.withColumn("_i", step).filter(
        (F.col("_i") < n) & (F.expr(f"_i * _total DIV {n}") == F.col("_pos")))
    return kept.drop("_pos", "_total", "_i")


def latest_results(results: DataFrame, group: str = "name", order: str = "submission_id") -> DataFrame:
    """Last result of each group."""
    rest = [c for c in results.columns if c != group]
    return (results.groupBy(group).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_last"))
            .select(group, *[F.col(f"_last.{c}").alias(c) for c in rest]))


# --- set operators ------------------------------------------------------------

def missing_elements(df: DataFrame, group: Sequence[str], column: str) -> DataFrame:
    """Members of an integer sequence between minimum and maximum that do not occur."""
    present = df.select(*group, column).distinct()
    follow = Window.partitionBy(*group, "_half").orderBy(column)
    # Gaps are looked for inside buckets; each bucket also sees the first value
    # of the next one, so no group is ordered as a whole.
    width = 65536
    halves = present.withColumn("_half", F.floor(F.col(column) / width))
    bounds = halves.groupBy(*group, "_half").agg(F.min(column).alias("_low"), F.max(column).alias("_high"))
    between = Window.partitionBy(*group).orderBy("_half")
    inner = (halves.withColumn("_next", F.lead(column).over(follow))
             .select(*group, F.col(column).alias("_from"), "_next"))
    outer = (bounds.withColumn("_next", F.lead("_low").over(between))
             .select(*group, F.col("_high").alias("_from"), "_next"))
    return (inner.unionByName(outer).filter(F.col("_next") > F.col("_from") + 1)
            .select(*group, F.explode(F.sequence(F.col("_from") + 1, F.col("_next") - 1)).alias(column)))


def invalid_objects(*checks: DataFrame) -> DataFrame:
    """Union of the ids that any check rejects."""
    found = checks[0]
    for other in checks[1:]:
        found = found.unionByName(other)
    return found.distinct()


def concat_measurements(frames: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Measurements of the same objects side by side."""
    joined = frames[0]
    for frame in frames[1:]:
        joined = joined.join(frame, list(keys), "full_outer")
    return joined
