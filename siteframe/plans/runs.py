"""Results of pipeline runs: objects, segmentations and feature values that change together.

A store is a folder. Each save writes the buckets of sites that it touches, all three tables, into a version of its own, and
then a manifest that tells for every bucket which version holds it. Readers follow the newest manifest; until it stands, they see
the earlier run as it was.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siteframe.core import cut_lineage, range_index
from siteframe.operators import measure as ME
from siteframe.operators.tiles import labels_to_polygons

#: Buckets of sites; a save rewrites those of its sites.
BUCKETS = 64
SCHEMAS = {
    "objects": "partition_key long, id long, mapobject_type_id int, ref_id long",
    "segmentations": "partition_key long, mapobject_id long, mapobject_type_id int, tpoint int, zplane int, label int, y int, x int, polygon array<struct<x: int, y: int>>",
    "feature_values": "partition_key long, mapobject_id long, mapobject_type_id int, tpoint int, values map<string, double>",
}


def _bucket(key: str) -> Column:
    return F.pmod(F.xxhash64(F.col(key).cast("long")), F.lit(BUCKETS)).cast("int")


def _files(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def manifest(spark: SparkSession, folder: str) -> dict:
    """The newest manifest of a store: its number and the version of each bucket."""
    path, fs = _files(spark, folder)
    numbers = []
    if fs.exists(path):
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        numbers = [int(n[len("manifest-"):-len(".json")]) for n in names if n.startswith("manifest-") and n.endswith(".json")]
    if not numbers:
        return {"number": 0, "buckets": {}}
    return json.loads("".join(r.value for r in spark.read.text(f"{folder}/manifest-{max(numbers):09d}.json").collect()))


def _publish(spark: SparkSession, folder: str, content: dict) -> None:
    """Write a manifest under another name and rename it, which other readers see at once; fails if the number is taken."""
    path, fs = _files(spark, folder)
    target = spark._jvm.org.apache.hadoop.fs.Path(path, f"manifest-{content['number']:09d}.json")
    draft = spark._jvm.org.apache.hadoop.fs.Path(path, f".draft-{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps(content).encode()))
    out.close()
    if fs.exists(target) or not fs.rename(draft, target):
        fs.delete(draft, False)
        raise RuntimeError("another run was saved in between")


def read_run(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The three tables as the newest manifest tells."""
    held = manifest(spark, folder)["buckets"]
    out = {}
    for name, schema in SCHEMAS.items():
        paths = [f"{folder}/{version}/{name}/bucket={b}" for b, version in held.items()]
        _, fs = _files(spark, folder)
        paths = [p for p in paths if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p))]
        out[name] = spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
    return out


def save_run(folder: str, labels: DataFrame, measurements: DataFrame, features: Mapping[str, str], type_id: int,
             offsets: DataFrame | None = None, as_input: bool = False) -> None:
    """Save the objects of a run: label pixels (site_id, tpoint, zplane, label, y, x) and measurements (site_id, tpoint, label, features).

    A label of a site is one object at all times and planes. Its segmentation is its centre, and its outline if the
    `offsets` of the sites are given; values are rounded to six digits, and keyed by the id of the feature. Earlier objects of the type at
    these sites are replaced, unless the run had them as input (`as_input`): then labels keep their ids, and objects stay.
    """
    spark = labels.sparkSession
    before = manifest(spark, folder)
    old = read_run(spark, folder)
    sites = cut_lineage(labels.select(F.col("site_id").cast("long").alias("partition_key")).distinct().withColumn("bucket", _bucket("partition_key")))
    touched = sorted(r["bucket"] for r in sites.select("bucket").distinct().collect())  # BUCKETS at most

    known = old["segmentations"].filter(F.col("mapobject_type_id") == type_id).select(
        F.col("partition_key").alias("site_id"), "label", "mapobject_id").distinct()
    if not as_input:
        known = known.limit(0)
    found = labels.select(F.col("site_id").cast("long").alias("site_id"), "label").distinct().join(known, ["site_id", "label"], "left")
    start = old["objects"].agg(F.coalesce(F.max("id"), F.lit(0)).alias("_start"))
    fresh = range_index(found.filter("mapobject_id IS NULL").drop("mapobject_id"), ["site_id", "label"], "_pos")
    ids = cut_lineage(found.filter("mapobject_id IS NOT NULL").withColumn("isnew", F.lit(False)).unionByName(
        fresh.join(F.broadcast(start)).select("site_id", "label", (F.col("_start") + F.col("_pos") + 1).alias("mapobject_id"), F.lit(True).alias("isnew"))))

    where = ["site_id", "tpoint", "zplane", "label"]
    shown = ME.centroids(labels.select(*where, "y", "x"))
    outline = F.lit(None).cast("array<struct<x: int, y: int>>")
    if offsets is not None:
        rings = labels_to_polygons(labels.select(*where, "y", "x"), offsets).select(*where, F.transform(
            "polygon", lambda p: F.struct(p["x"].cast("int").alias("x"), p["y"].cast("int").alias("y"))).alias("polygon"))
        shown, outline = shown.join(rings, where, "left"), F.col("polygon")
    entries = [e for name, i in features.items() for e in (F.lit(str(i)), F.bround(F.col(name).cast("double"), 6))]
    kind = F.lit(type_id).cast("int").alias("mapobject_type_id")
    site = F.col("site_id").cast("long").alias("partition_key")
    new = {
        "objects": ids.filter("isnew").select(site, F.col("mapobject_id").alias("id"), kind, F.lit(None).cast("long").alias("ref_id")),
        "segmentations": shown.join(ids, ["site_id", "label"]).select(
            site, "mapobject_id", kind, F.col("tpoint").cast("int").alias("tpoint"), F.col("zplane").cast("int").alias("zplane"), F.col("label").cast("int").alias("label"),
            "y", "x", outline.alias("polygon")),
        "feature_values": measurements.join(ids, ["site_id", "label"]).select(
            site, "mapobject_id", kind, F.col("tpoint").cast("int").alias("tpoint"), F.create_map(*entries).alias("values")),
    }
    version = f"run-{before['number'] + 1:09d}-{uuid.uuid4().hex}"
    for name, schema in SCHEMAS.items():
        there = old[name].withColumn("bucket", _bucket("partition_key")).filter(F.col("bucket").isin(touched))
        mine = (F.col("mapobject_type_id") == type_id)
        replaced = there.filter(mine).join(sites.select("partition_key"), "partition_key", "left_semi")
        kept = there.filter(~mine).unionByName(there.filter(mine).join(sites.select("partition_key"), "partition_key", "left_anti"))
        if as_input and name == "objects":
            kept = kept.unionByName(replaced)
        elif as_input:
            # Places and times that the run did not see stay.
            keys = ["partition_key", "mapobject_id", "tpoint"] + (["zplane"] if name == "segmentations" else [])
            kept = kept.unionByName(replaced.join(new[name].select(*keys), keys, "left_anti"))
        columns = [c.split()[0] for c in ("partition_key", *[f.name for f in there.schema.fields if f.name not in ("partition_key", "bucket")])]
        whole = kept.select(*columns, "bucket").unionByName(new[name].withColumn("bucket", _bucket("partition_key")).select(*columns, "bucket"))
        whole.repartition("bucket", F.pmod(F.xxhash64("partition_key"), F.lit(8))).write.partitionBy("bucket").parquet(f"{folder}/{version}/{name}")
    _publish(spark, folder, {"number": before["number"] + 1, "buckets": before["buckets"] | {str(b): version for b in touched}})
