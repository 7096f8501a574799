"""Upserts, exports, uploads and deletions. Tables are immutable files, so every
change is a join that yields the new table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteframe.core import range_index, require_empty
from siteframe.functions.geometry import rectangle_touches_border
from siteframe.operators.relational import (feature_matrix, objects_missing_features,
                                            objects_missing_segmentation)


def upsert_map(target: DataFrame, updates: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """Merge maps of values by key; an updated entry replaces the old one."""
    new = updates.withColumnRenamed(column, "_new")
    joined = target.join(new, list(keys), "full_outer")
    merged = F.expr(f"""CASE WHEN _new IS NULL THEN {column} WHEN {column} IS NULL THEN _new
        ELSE map_concat(map_filter({column}, (k, v) -> NOT map_contains_key(_new, k)), _new) END""")
    return joined.withColumn(column, merged).drop("_new")


def upsert_replace(target: DataFrame, updates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of `updates` take the place of target rows with the same key."""
    return target.join(updates.select(*keys), list(keys), "left_anti").unionByName(updates)


def get_or_create(dim: DataFrame, new_rows: DataFrame, id_column: str, name_column: str) -> DataFrame:
    """Add the natural keys that are absent, numbered after the largest id in key order."""
    fresh = new_rows.select(name_column).distinct().join(dim.select(name_column), name_column, "left_anti")
    start = dim.agg(F.coalesce(F.max(id_column), F.lit(0)).alias("_start"))
    return dim.select(id_column, name_column).unionByName(
        range_index(fresh, [name_column], "_pos").join(F.broadcast(start))
        .select((F.col("_start") + F.col("_pos") + 1).alias(id_column), name_column))


def export_feature_values(objects: DataFrame, segmentations: DataFrame, values: DataFrame,
                          sites: DataFrame, features: Mapping[str, str]) -> DataFrame:
    """Feature matrix of all segmented objects with their position. Values belong to
    the time point of the layer; an object without values gets NaN in each column."""
    wide = feature_matrix(values, dict(features))
    segs = segmentations.join(objects.select("partition_key", F.col("id").alias("mapobject_id")),
                              ["partition_key", "mapobject_id"], "left_semi")
    joined = segs.join(wide, ["partition_key", "mapobject_id", "tpoint"], "left")
    joined = joined.join(sites.withColumnRenamed("site_id", "partition_key"), "partition_key")
    nan = F.lit(float("nan"))
    return joined.select("mapobject_id", "plate_name", "well_name", "site_y", "site_x", "tpoint", "zplane",
                         "label", *[F.coalesce(n, nan).alias(n) for n in features.values()])


def export_object_metadata(segmentations: DataFrame, sites: DataFrame, labels: DataFrame,
                           results: Mapping[str, str]) -> DataFrame:
    """Position, time, label and border flag of objects with one column per result."""
    joined = (segmentations.join(labels, ["partition_key", "mapobject_id", "tpoint"], "left")
              .join(sites.withColumnRenamed("site_id", "partition_key"), "partition_key"))
    return joined.select(
        "mapobject_id", "plate_name", "well_name", F.col("site_y").alias("well_pos_y"),
        F.col("site_x").alias("well_pos_x"), "tpoint", "zplane", "label",
        rectangle_touches_border("x0", "y0", "x1", "y1", "height", "width").cast("int").alias("is_border"),
        *[F.col("values")[str(i)].cast("string").alias(n) for i, n in results.items()])


def ingest_feature_values(upload: DataFrame, segmentations: DataFrame, tpoint: int,
                          features: Mapping[str, str]) -> DataFrame:
    """Uploaded values keyed by site and label become maps keyed by object and
    feature id; a label without an object is an error."""
    known = segmentations.filter(F.col("tpoint") == tpoint).select(
        F.col("partition_key").alias("site_id"), "label", "mapobject_id")
    require_empty(upload.join(known, ["site_id", "label"], "left_anti"), "no object with the label")
    entries = [e for name, i in features.items() for e in (F.lit(str(i)), F.col(name))]
    return upload.join(known, ["site_id", "label"]).select(
        F.col("site_id").alias("partition_key"), "mapobject_id", F.lit(tpoint).alias("tpoint"),
        F.create_map(*entries).alias("values"))


def assign_object_ids(labels: DataFrame, existing: DataFrame, image: Sequence[str]) -> DataFrame:
    """Object id per label: the id already stored for the label, or a new one."""
    found = labels.select(*image, "label").distinct().join(
        existing.select(*image, "label", "mapobject_id"), [*image, "label"], "left")
    start = existing.agg(F.coalesce(F.max("mapobject_id"), F.lit(0)).alias("_start"))
    fresh = found.filter("mapobject_id IS NULL").drop("mapobject_id")
    numbered = range_index(fresh, [*image, "label"], "_pos")
    return found.filter("mapobject_id IS NOT NULL").unionByName(
        numbered.join(F.broadcast(start)).select(
            *image, "label", (F.col("_start") + F.col("_pos") + 1).alias("mapobject_id")))


def write_table(df: DataFrame, path: str, buckets: int = 64, mode: str = "append") -> None:
    """Store rows by a hash of the partition key, so that later joins read only
    the files of their objects and one large site does not make one large file."""
    bucket = F.pmod(F.xxhash64("partition_key", *[c for c in ("mapobject_id", "id") if c in df.columns]),
                    F.lit(buckets)).cast("int")
    (df.withColumn("bucket", bucket).repartition(buckets, "bucket")
     .write.mode(mode).partitionBy("bucket").parquet(path))


def delete_objects(ids: DataFrame, tables: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Remove objects from the object table and every table that refers to them."""
    out = {}
    for name, table in tables.items():
        column = "id" if "id" in table.columns else "mapobject_id"
        out[name] = table.join(ids.select(F.col("id").alias(column)).distinct(), column, "left_anti")
    return out


def delete_incomplete(objects: DataFrame, segmentations: DataFrame, values: DataFrame) -> DataFrame:
    """Drop objects that lack a segmentation or feature values."""
    gone = (objects_missing_segmentation(objects, segmentations).select("partition_key", "id")
            .unionByName(objects_missing_features(objects, values).select("partition_key", "id")).distinct())
    return objects.join(gone, ["partition_key", "id"], "left_anti")


def update_rows(df: DataFrame, key: str, value, changes: Mapping[str, object]) -> DataFrame:
    return df.withColumns({c: F.when(F.col(key) == value, F.lit(v)).otherwise(F.col(c))
                           for c, v in changes.items()})


def delete_children(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    return children.join(parents.select(key), key, "left_anti")


def keep_children(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    return children.join(parents.select(key), key, "left_semi")


def reset_outputs(tables: Mapping[str, DataFrame], drop: Sequence[str]) -> dict[str, DataFrame]:
    """Empty the outputs of a step while keeping their schema."""
    return {n: t.limit(0) if n in drop else t for n, t in tables.items()}


def delete_invalid(objects: DataFrame, segmentations: DataFrame) -> DataFrame:
    """Drop objects whose outline crosses itself or is not closed."""
    from siteframe.functions.geometry import ring_is_valid
    wrong = segmentations.filter(~ring_is_valid("polygon")).select("partition_key", F.col("mapobject_id").alias("id"))
    return objects.join(wrong, ["partition_key", "id"], "left_anti")
