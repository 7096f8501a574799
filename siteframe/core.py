"""Session settings, lineage cuts, distributed ranks and skew-aware joins."""

from __future__ import annotations

import re
import uuid
import zipfile
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A written table of more rows than this in at most so many bytes of files counts as packed if its rows, at
#: eight bytes a field, take over so many times the files.
PACKED_ROWS, PACKED_BYTES, PACKED_TIMES = 400_000, 64 << 20, 4

IMAGE_KEYS = ("site_id", "channel_id", "cycle_id", "tpoint", "zplane", "level")

SESSION_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  driver_memory: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName("siteframe")
    if master:
        builder = builder.master(master)
    for key, value in SESSION_CONF.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if driver_memory:
        builder = builder.config("spark.driver.memory", driver_memory)
    for key, value in extra.items():
        builder = builder.config(key, value)
    return ship(builder.getOrCreate())


def ship(spark: SparkSession) -> SparkSession:
    """Give the workers of a session this package, once; they need not find it on their machine."""
    sc = spark.sparkContext
    if not getattr(sc, "_siteframe_shipped", False):
        root = Path(__file__).parent
        archive = f"{sc._temp_dir}/siteframe.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for source in sorted(root.rglob("*.py")):
                z.write(source, f"{root.name}/{source.relative_to(root)}")
        sc.addPyFile(archive)
        sc._siteframe_shipped = True
    return spark


def meet_by_image(spark: SparkSession) -> SparkSession:
    """Let tables that are dealt out by image be joined by pixel where they are.

    Rows that agree in all columns of a join agree in some of them, so that tables dealt out by the same few of them need
    not move. Spark asks for all columns unless it is told not to, and deals both tables out again by pixel.
    """
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", SESSION_CONF["spark.sql.requireAllClusterKeysForCoPartition"])
    return spark


def image_keys(df: DataFrame) -> list[str]:
    """Columns of `df` that together identify one two-dimensional image."""
    return [c for c in IMAGE_KEYS if c in df.columns]


def shared_folder(spark: SparkSession) -> str:
    """Folder for intermediate tables that the driver and all executors reach.

    It is `spark.checkpoint.dir` where that is set, else one below the home folder of the
    default file system. Only in local mode, where there is one machine, may it be temporary.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and re.match(r"local(\[|$)", sc.master):
            folder = f"{sc._temp_dir}/checkpoints"
        if folder is None:
            home = sc._jvm.org.apache.hadoop.fs.FileSystem.get(sc._jsc.hadoopConfiguration()).getHomeDirectory().toString()
            if home.startswith("file:"):
                raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
            folder = f"{home}/siteframe-checkpoints"
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """Write `df` to the shared checkpoint folder of the cluster and read it back.

    The table survives the loss of executors. Unlike a checkpointed plan, whose
    size estimate is the product of all joins before it and grows with every round
    of a loop, a table carries its real size into the planning of the next round.
    `before` is the table of the round before; it is deleted once the new one stands.
    Spark plans with the size of the files. Rows of images pack well, so that millions of them look
    small enough to broadcast; such tables say that they are to be shuffled (`packed`). Tables of images are dealt out by
    site as they are read, once for all joins and aggregations that follow.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/siteframe-{uuid.uuid4().hex}"
    df.write.parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    big = packed(written, path)
    if "site_id" in written.columns:
        written = written.repartition("site_id")
    if big:
        written = written.hint("merge")
    written._siteframe_path = path
    if before is not None:
        discard(before)
    return written


def packed(table: DataFrame, path: str) -> bool:
    """Whether a written table has many rows in far smaller files; only footers of small files are read for it."""
    sc = table.sparkSession.sparkContext
    folder = sc._jvm.org.apache.hadoop.fs.Path(path)
    size = folder.getFileSystem(sc._jsc.hadoopConfiguration()).getContentSummary(folder).getLength()
    if size > PACKED_BYTES:
        return False
    rows = table.count()
    return rows > PACKED_ROWS and rows * 8 * (1 + len(table.columns)) > PACKED_TIMES * size


def discard(table: DataFrame) -> None:
    """Delete a table that `cut_lineage` wrote and that nothing reads any more."""
    path = getattr(table, "_siteframe_path", None)
    if path is not None:
        sc = table.sparkSession.sparkContext
        target = sc._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)


def range_index(df: DataFrame, order: Sequence[str | Column], name: str) -> DataFrame:
    """Zero-based position of each row in the order of `order`, for keys of any kind.

    Rows are dealt out by ranges of the key and numbered inside each range; the counts
    of the ranges, as many as there are partitions, give the offsets. Rows that tie are
    numbered in any order. The ranged rows are written once, so that both steps see the same ranges.
    """
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    ranged = cut_lineage(df.withColumn("_part", F.lit(0)).repartitionByRange(*keys)
                         .withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
               .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")))
    local = F.row_number().over(Window.partitionBy("_part").orderBy(*keys)) - 1
    return (ranged.withColumn("_local", local).join(F.broadcast(offsets), "_part")
            .withColumn(name, (F.col("_offset") + F.col("_local")).cast("long"))
            .drop("_part", "_local", "_offset"))


def exact_quantiles(df: DataFrame, column: str, shares: Sequence[float]) -> DataFrame:
    """One row with an array of the exact quantiles of a column, interpolated between neighbours; nulls do not count.

    Equal values are counted first; counts are added up over ranges of values, so that
    no task holds all values.
    """
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    ranged = cut_lineage(counts.withColumn("_part", F.lit(0)).repartitionByRange("_v").withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = ranged.groupBy("_part").agg(F.sum("_n").alias("_s"))
    offsets = parts.select("_part", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_offset"))
    total = parts.agg(F.sum("_s").alias("_total"))
    upto = F.sum("_n").over(Window.partitionBy("_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    placed = (ranged.withColumn("_upto", upto).join(F.broadcast(offsets), "_part").join(F.broadcast(total))
              .withColumn("_end", F.col("_offset") + F.col("_upto")))

    def at(place: Column) -> Column:
        return F.max(F.when((place < F.col("_end")) & (place >= F.col("_end") - F.col("_n")), F.col("_v").cast("double")))

    found = []
    for i, q in enumerate(shares):
        place = F.lit(float(q)) * (F.col("_total") - 1)
        found += [at(F.floor(place)).alias(f"_a{i}"), at(F.ceil(place)).alias(f"_b{i}"), F.max(place - F.floor(place)).alias(f"_w{i}")]
    one = placed.agg(*found)
    return one.select(F.array(*[F.col(f"_a{i}") + (F.col(f"_b{i}") - F.col(f"_a{i}")) * F.col(f"_w{i}") for i in range(len(shares))]).alias(column))


def running_index(df: DataFrame, group: Sequence[str], key: str, name: str,
                  width: int = 65536) -> DataFrame:
    """Zero-based position of each row of a group in the order of an integer key
    that is unique in the group.

    A plain ``row_number`` sorts a whole group in one task. Here the key range is
    cut into buckets of `width` values, rows are counted per bucket, the counts
    are summed up in front of each bucket, and only a bucket is ever sorted.
    """
    bucket = F.floor(F.col(key) / F.lit(width)).cast("long")
    part = df.withColumn("_bucket", bucket).repartition(*group, "_bucket")
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = (part.groupBy(*group, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
               .withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))
               .drop("_n"))
    inside = Window.partitionBy(*group, "_bucket").orderBy(key)
    local = part.withColumn("_local", F.row_number().over(inside) - 1)
    return (local.join(offsets, [*group, "_bucket"])
            .withColumn(name, (F.col("_offset") + F.col("_local")).cast("long"))
            .drop("_bucket", "_local", "_offset"))


def dense_index(df: DataFrame, group: Sequence[str], key: str, name: str,
                width: int = 65536) -> DataFrame:
    """Zero-based dense rank of an integer key inside each group."""
    values = df.select(*group, key).distinct()
    return df.join(running_index(values, group, key, name, width), [*group, key])


def small_dense_values(df: DataFrame, group: Sequence[str], key: str, name: str) -> DataFrame:
    """Dense rank of the distinct values of a dimension column (channels, time
    points, plate rows). Only distinct values pass through the ordering."""
    window = Window.partitionBy(*group).orderBy(key) if group else Window.orderBy(key)
    return df.select(*group, key).distinct().withColumn(name, F.row_number().over(window) - 1)


def salted_join(left: DataFrame, right: DataFrame, on: Sequence[str],
                hot_rows: int = 1_000_000) -> DataFrame:
    """Inner join of two many-sided inputs where one key may hold much of `left`.

    Keys with more than `hot_rows` left rows are spread over several salts and
    the matching right rows are repeated once per salt. There can be at most
    ``rows / hot_rows`` such keys, which bounds the table of hot keys.
    """
    hot = (left.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))
           .filter(F.col("_n") > hot_rows)
           .select(*on, F.ceil(F.col("_n") / hot_rows).cast("int").alias("_fan")))
    row_hash = F.xxhash64(*[F.col(c) for c in left.columns])
    salted_left = (left.join(hot, list(on), "left")
                   .withColumn("_salt", F.when(F.col("_fan").isNull(), F.lit(0)).otherwise(
                       F.pmod(row_hash, F.col("_fan").cast("long")).cast("int")))
                   .drop("_fan"))
    salted_right = (right.join(hot, list(on), "left")
                    .withColumn("_salt", F.explode(F.sequence(
                        F.lit(0), F.coalesce(F.col("_fan"), F.lit(1)) - 1)))
                    .drop("_fan"))
    return salted_left.join(salted_right, [*on, "_salt"]).drop("_salt")


def require_empty(df: DataFrame, message: str) -> None:
    """Raise ``ValueError`` with `message` and an example row when `df` has rows."""
    rows = df.take(1)
    if rows:
        raise ValueError(f"{message}: {rows[0].asDict()}")
