"""Incremental statistics and file registration with Structured Streaming."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siteframe.operators.pixels import illumination_stats
from siteframe.sources.files import register_files


def read_pixel_stream(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    """Pixels of images as they arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def illumination_stats_stream(pixels: DataFrame, target: str, checkpoint: str, merge_every: int = 8) -> StreamingQuery:
    """Mean and standard deviation per pixel position over all images seen so far.

    The state holds number, mean and squared deviations of each channel and pixel position; a batch merges its own
    into them and writes only the positions that it changed, as ``batch=<number>``. After `merge_every` of these they are merged
    with the last whole version into a new one, ``upto=<number>``. Once that stands, what it replaces is deleted. A
    batch that is repeated after a failure writes the same rows to the same place, and counts only where no whole version has it.
    """
    def store(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")
        whole, changed = _versions(spark, target)
        if len(changed) >= merge_every:
            latest_stats(spark, target).write.mode("overwrite").parquet(f"{target}/upto={number}")
            whole = number
        if whole is not None:
            _forget(spark, target, whole)

    return (illumination_stats(pixels).writeStream.outputMode("update").foreachBatch(store)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def _folders(spark: SparkSession, target: str) -> list[tuple[str, int, Any]]:
    """(kind, number, path) of the versions that were written to their end."""
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path
    files = path(target).getFileSystem(sc._jsc.hadoopConfiguration())
    listed = [f.getPath() for f in files.listStatus(path(target))]
    named = [(*p.getName().split("="), p) for p in listed if p.getName().count("=") == 1]
    return [(kind, int(number), p) for kind, number, p in named if files.exists(path(p, "_SUCCESS"))]


def _versions(spark: SparkSession, target: str) -> tuple[int | None, list[int]]:
    """Number of the last whole version, and of the batches after it."""
    found = _folders(spark, target)
    whole = max((n for kind, n, _ in found if kind == "upto"), default=None)
    return whole, sorted(n for kind, n, _ in found if kind == "batch" and (whole is None or n > whole))


def _forget(spark: SparkSession, target: str, whole: int) -> None:
    """Delete what the whole version `whole` replaces."""
    files = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for kind, number, path in _folders(spark, target):
        if number < whole or (kind == "batch" and number == whole):
            files.delete(path, True)


def latest_stats(spark: SparkSession, target: str) -> DataFrame:
    """For each position the statistics that the last batch with this position has written."""
    whole, changed = _versions(spark, target)
    paths = [(f"{target}/upto={whole}", whole)] * (whole is not None) + [(f"{target}/batch={n}", n) for n in changed]
    rows = reduce(DataFrame.unionByName, [spark.read.parquet(p).withColumn("_batch", F.lit(n)) for p, n in paths])
    keys = [c for c in rows.columns if c not in ("mean", "std", "_batch")]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct("mean", "std"), "_batch").alias("_last"))
    return last.select(*keys, "_last.mean", "_last.std")


def register_file_stream(names: DataFrame, target: str, image_pattern: str, meta_pattern: str,
                         checkpoint: str) -> StreamingQuery:
    """Append new files to the registry. Names that came before are kept in the
    state of the stream, so that no batch reads the registry; a batch that is
    repeated after a failure replaces what it had written."""
    def append(batch: DataFrame, number: int) -> None:
        none = batch.sparkSession.createDataFrame([], "name string")
        fresh = register_files(batch, image_pattern, meta_pattern, none)
        fresh.withColumn("status", F.lit("COMPLETE")).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return (names.dropDuplicates(["name"]).writeStream.outputMode("append").foreachBatch(append)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
