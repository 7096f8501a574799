"""Aggregations and integrity checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteframe.core import require_empty
from siteframe.operators.relational import finite


def feature_extrema(values: DataFrame, feature_ids: Sequence[int | str]) -> DataFrame:
    """Minimum and maximum per feature over all objects, NaN left out."""
    wide = values.select(*[F.col("values")[str(i)].alias(f"v{i}") for i in feature_ids])
    return wide.agg(*[f(F.when(finite(f"v{i}"), F.col(f"v{i}"))).alias(f"{n}_{i}")
                      for i in feature_ids for n, f in (("min", F.min), ("max", F.max))]
                    ).select(F.explode(F.array(*[F.struct(
                        F.lit(str(i)).alias("feature_id"), F.col(f"min_{i}").alias("minimum"),
                        F.col(f"max_{i}").alias("maximum")) for i in feature_ids])).alias("r")
                    ).select("r.*")


def null_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Number of missing or NaN values per column, one row per column."""
    counted = df.agg(*[F.sum(F.when(finite(c), 0).otherwise(1)).alias(c) for c in columns])
    return counted.select(F.explode(F.array(*[F.struct(
        F.lit(c).alias("feature"), F.coalesce(F.col(c), F.lit(0)).alias("n_null"))
        for c in columns])).alias("r")).select("r.*")


def ids_by_partition(objects: DataFrame, chunk: int = 10000) -> DataFrame:
    """Object ids listed per partition key, in lists of bounded length.

    A partition with more objects than `chunk` id values gets several lists.
    """
    return (objects.withColumn("part", F.expr(f"id DIV {chunk}"))
            .groupBy("partition_key", "part")
            .agg(F.array_sort(F.collect_list("id")).alias("ids")))


def count_by_type(objects: DataFrame, values: DataFrame) -> DataFrame:
    keys = values.select("partition_key", F.col("mapobject_id").alias("id")).distinct()
    return (objects.join(keys, ["partition_key", "id"], "left_semi")
            .groupBy("mapobject_type_id").agg(F.count(F.lit(1)).alias("n_objects")))


def extract_aggregate(parents: DataFrame, assignment: DataFrame, children: DataFrame,
                      image: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Count, mean, population standard deviation and sum of child features per
    parent, skipping NaN; a parent without children gets count zero and NaN."""
    joined = (assignment.join(children, [*image, "child"])
              .groupBy(*image, "parent")
              .agg(F.count(F.lit(1)).alias("Count"), *[
                  f(F.when(finite(c), F.col(c))).alias(f"{name}_{c}")
                  for c in features for name, f in (
                      ("Mean", F.avg), ("Std", F.stddev_pop), ("Sum", F.sum))]))
    nan = F.lit(float("nan"))
    return parents.join(joined, [*image, "parent"], "left").select(
        *image, "parent", F.coalesce("Count", F.lit(0)).alias("Count"),
        *[F.coalesce(F.col(f"{n}_{c}"), nan).alias(f"{n}_{c}")
          for c in features for n in ("Mean", "Std")],
        # The sum over children that are all NaN is zero, without children it is NaN.
        *[F.coalesce(F.col(f"Sum_{c}"), F.when(F.col("Count") > 0, F.lit(0.0)).otherwise(nan))
          .alias(f"Sum_{c}") for c in features])


def labels_without_features(assignment: DataFrame, children: DataFrame,
                            image: Sequence[str]) -> DataFrame:
    return assignment.join(children, [*image, "child"], "left_anti")


def group_size_variants(df: DataFrame, group: str) -> DataFrame:
    """Distinct group sizes; an intact table has one row."""
    return (df.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
            .groupBy("n").agg(F.count(F.lit(1)).alias("n_groups")))


def check_equal_sizes(df: DataFrame, group: str, message: str) -> None:
    if group_size_variants(df, group).limit(2).count() > 1:
        raise ValueError(message)


def distinct_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Sorted distinct values of dimension columns (time points, z planes, bit depths)."""
    return df.agg(*[F.array_join(F.array_sort(F.collect_set(c)), ",").alias(c) for c in columns])


def check_single_bit_depth(images: DataFrame) -> None:
    if images.select("bit_depth").distinct().limit(2).count() > 1:
        raise ValueError("images must have the same bit depth")


def check_sites_per_well(planes: DataFrame, expected: int) -> None:
    wrong = (planes.groupBy("well_name", "channel_name", "zplane", "tpoint")
             .agg(F.countDistinct("stage_y", "stage_x").alias("n"))
             .filter(F.col("n") != expected))
    require_empty(wrong, "number of sites does not fit the layout")


def sites_per_well(planes: DataFrame) -> DataFrame:
    """How often each number of sites per well, channel, z and t occurs."""
    return (planes.groupBy("well_name", "channel_name", "zplane", "tpoint")
            .agg(F.countDistinct("stage_y", "stage_x").alias("n_sites"))
            .groupBy("n_sites").agg(F.count(F.lit(1)).alias("n_groups")))


def histogram(df: DataFrame, column: str, lower: float, upper: float, bins: int,
              group: Sequence[str] = ()) -> DataFrame:
    """Counts in `bins` equal intervals; the upper bound falls into the last one."""
    value = F.col(column).cast("double")
    index = F.least(F.floor((value - lower) / ((upper - lower) / bins)), F.lit(bins - 1))
    return (df.filter(finite(value) & value.between(lower, upper))
            .groupBy(*group, index.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n")))


def occupancy(points: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Number of points at each rounded coordinate."""
    return (points.groupBy(*group, F.round("y").cast("int").alias("y"), F.round("x").cast("int").alias("x"))
            .agg(F.count(F.lit(1)).alias("n")))


def file_status_rollup(files: DataFrame, key: str) -> DataFrame:
    """Status of an acquisition from its files: any upload running, all complete, or waiting."""
    uploading = F.max(F.col("status") == "UPLOADING")
    complete = F.min(F.col("status") == "COMPLETE")
    return files.groupBy(key).agg(
        F.when(uploading, "UPLOADING").when(complete, "COMPLETE").otherwise("WAITING").alias("status"),
        F.count(F.lit(1)).alias("n_files"),
        F.count(F.when(F.col("status") == "COMPLETE", 1)).alias("n_complete"))


def well_dimensions(sites: DataFrame) -> DataFrame:
    return sites.groupBy("well_id").agg((F.max("site_y") + 1).alias("n_rows"),
                                        (F.max("site_x") + 1).alias("n_cols"))


def closest_percentile(table: DataFrame, q: float, group: Sequence[str] = ()) -> DataFrame:
    """Value stored for the percentile key closest to `q`."""
    return table.groupBy(*group).agg(F.min_by("value", F.struct(
        F.abs(F.col("q") - q), F.col("q"))).alias("value"))
