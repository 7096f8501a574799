"""Registration of microscope files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteframe.core import require_empty
from siteframe.functions.scalars import filename_fields, plain_pattern


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """Names of all files below a folder; file contents are not read."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
            .select(F.element_at(F.split("path", "/"), -1).alias("name")))


def check_file_validity(files: DataFrame, image_pattern: str, meta_pattern: str) -> DataFrame:
    image, meta = plain_pattern(image_pattern), plain_pattern(meta_pattern)
    return files.withColumn("is_valid", F.col("name").rlike(image) | F.col("name").rlike(meta))


def register_files(files: DataFrame, image_pattern: str, meta_pattern: str, known: DataFrame) -> DataFrame:
    """New visible files that match a pattern, with their kind."""
    image, meta = plain_pattern(image_pattern), plain_pattern(meta_pattern)
    kind = F.when(F.col("name").rlike(image), "image").when(F.col("name").rlike(meta), "metadata")
    return (files.filter(~F.col("name").startswith(".")).select("name").distinct()
            .withColumn("kind", kind).filter("kind IS NOT NULL")
            .join(known.select("name").distinct(), "name", "left_anti"))


def parse_file_names(files: DataFrame, pattern: str) -> DataFrame:
    """Well, channel, z plane, time point and site of each name; a name that does
    not match the pattern is an error."""
    require_empty(files.filter(~F.col("name").rlike(plain_pattern(pattern))), "file name does not match the pattern")
    return files.withColumn("_f", filename_fields("name", pattern)).select(
        *files.columns, F.get("_f", F.lit(0)).alias("well_name"), F.get("_f", F.lit(1)).alias("channel"),
        F.get("_f", F.lit(2)).cast("int").alias("zplane"), F.get("_f", F.lit(3)).cast("int").alias("tpoint"),
        F.get("_f", F.lit(4)).cast("int").alias("site"))
