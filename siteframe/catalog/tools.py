"""Queries for analysis tools, saved results and module composition."""

import uuid

from pyspark.sql import functions as F

from siteframe.catalog import query
from siteframe.catalog.objects import label_values
from siteframe.core import shared_folder
from siteframe.functions.scalars import IMAGE_PATTERNS, METADATA_PATTERNS
from siteframe.operators import analysis as AN
from siteframe.operators import mutate as MU
from siteframe.operators import relational as R
from siteframe.plans import modules as MO
from siteframe.plans import runs as RU
from siteframe.streaming import incremental as INC


@query("heatmap", """SELECT 'heat' AS name, min(f6) AS min, max(f6) AS max, '6' AS feature_id FROM d_spot_values WHERE NOT isnan(f6)""")
def _(d):
    out = AN.heatmap(d.spot_values(), 6, "heat")
    a = F.from_json("attributes", "feature_id string, min double, max double")
    return out.select("name", a["min"].alias("min"), a["max"].alias("max"), a["feature_id"].alias("feature_id"))


@query("run_tool", """SELECT 'spots' AS name, min(f3) AS min, max(f3) AS max FROM d_spot_values WHERE NOT isnan(f3)""")
def _(d):
    out = MO.run_tool("Heatmap", d.spot_values(), feature_id=3, result_name="spots")
    a = F.from_json("attributes", "feature_id string, min double, max double")
    return out.select("name", a["min"].alias("min"), a["max"].alias("max"))


@query("write_table", "SELECT partition_key, mapobject_id, f1 FROM d_cell_values")
def _(d):
    target = f"{shared_folder(d.spark)}/table-{uuid.uuid4().hex}"
    values = d.cell_values().select("partition_key", "mapobject_id", F.col("values")["1"].alias("f1"))
    MU.write_table(values.filter("mapobject_id % 2 = 0"), target, buckets=8)
    MU.write_table(values.filter("mapobject_id % 2 = 1"), target, buckets=8)
    return d.spark.read.parquet(target).select("partition_key", "mapobject_id", "f1")


@query("reset_outputs", "SELECT 'cells' AS name, count(*) AS n FROM d_cells UNION ALL SELECT 'values', 0")
def _(d):
    tables = MU.reset_outputs({"cells": d.cells(), "values": d.cell_values()}, ["values"])
    counts = [t.agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("name"), "n") for n, t in tables.items()]
    return counts[0].unionByName(counts[1])


@query("robust_scale", """WITH b AS (SELECT quantile_cont(f3, [0.01, 0.5, 0.99]) AS q3, quantile_cont(f4, [0.01, 0.5, 0.99]) AS q4 FROM d_spot_values)
    SELECT mapobject_id, round((f3 - q3[2]) / (q3[3] - q3[1]), 8) AS f3, round((f4 - q4[2]) / (q4[3] - q4[1]), 8) AS f4 FROM d_spot_values, b""")
def _(d):
    m = R.feature_matrix(d.spot_values(), {"3": "f3", "4": "f4"}).select("mapobject_id", "f3", "f4")
    out = AN.robust_scale(m, AN.scale_bounds(m, ["f3", "f4"]), ["f3", "f4"])
    return out.select("mapobject_id", F.round("f3", 8).alias("f3"), F.round("f4", 8).alias("f4"))


@query("cluster_objects")
def _(d):
    return AN.cluster(d.embeddings(), "embedding", 5)


def training(d):
    return d.embeddings().filter("mapobject_id % 2 = 0").select("mapobject_id", F.col("label").cast("double").alias("target"))


@query("classify_forest")
def _(d):
    return AN.classify(d.embeddings().drop("label"), "embedding", training(d), "randomforest", 3, {"numTrees": [6, 24], "maxDepth": [6]})


@query("classify_svm")
def _(d):
    return AN.classify(d.embeddings().drop("label"), "embedding", training(d), "svm", 2, {"regParam": [0.01, 0.1]})


@query("classify_logistic")
def _(d):
    return AN.classify(d.embeddings().drop("label"), "embedding", training(d), "logisticregression", 2, {"regParam": [0.01, 0.1]})


def stored_results(d):
    return d.table("part").selectExpr(
        "p_partkey AS id", "p_brand AS name", "'Heatmap' AS kind", "concat('{\"size\":', p_size, '}') AS attributes", "p_size AS submission_id")


@query("register_result", """WITH r AS (SELECT p_partkey AS id, p_brand AS name, 'Heatmap' AS kind, '{"size":' || p_size || '}' AS attributes FROM part)
    SELECT * FROM r UNION ALL SELECT (SELECT max(id) FROM r) + 1, 'Clustering', 'SupervisedClassifier', '{"unique_labels":[0.0,1.0,2.0,3.0],"label_map":{"0.0":{"name":"round","color":"red"}}}'""")
def _(d):
    labels = label_values(d).select(F.col("values")["7"].alias("label"))
    return AN.register_result(stored_results(d), "Clustering", "SupervisedClassifier", labels, {0.0: {"name": "round", "color": "red"}})


@query("save_labels", """SELECT mapobject_id, CAST(mapobject_id % 4 AS DOUBLE) AS v7, round(f1 / 1000, 6) AS v8 FROM d_cell_values""")
def _(d):
    predicted = d.cell_values().select("partition_key", "mapobject_id", "tpoint", (F.col("values")["1"] / 1000).alias("label"))
    out = AN.save_labels(label_values(d), predicted, 8, ["partition_key", "mapobject_id", "tpoint"])
    return out.select("mapobject_id", F.col("values")["7"].alias("v7"), F.col("values")["8"].alias("v8"))


@query("feature_pairs", "SELECT mapobject_id, f3 AS x, f6 AS y FROM d_spot_values WHERE NOT isnan(f6)")
def _(d):
    return AN.feature_pairs(d.spot_values(), 3, 6)


@query("selection_histogram", """SELECT o_orderpriority AS selection, CAST(least(floor(f1 / 20000), 19) AS INTEGER) AS bin, count(*) AS n FROM d_cell_values
    JOIN orders ON o_orderkey = mapobject_id WHERE f1 BETWEEN 0 AND 400000 GROUP BY 1, 2""")
def _(d):
    selection = d.table("orders").selectExpr("o_orderkey AS mapobject_id", "o_orderpriority AS selection")
    return AN.selection_histogram(d.cell_values(), selection, 1, 0, 400000, 20)


@query("list_results", "SELECT p_partkey AS id, p_brand AS name, p_size AS submission_id FROM part WHERE p_brand = (SELECT min(p_brand) FROM part)")
def _(d):
    return AN.list_results(stored_results(d), name=stored_results(d).agg(F.min("name")).first()[0]).select("id", "name", "submission_id")


@query("rename_result", "SELECT p_partkey AS id, CASE WHEN p_partkey = 100 THEN 'renamed' ELSE p_brand END AS name FROM part")
def _(d):
    return AN.rename_result(stored_results(d), 100, "renamed").select("id", "name")


@query("delete_result", "SELECT mapobject_id, CAST(NULL AS DOUBLE) AS v7 FROM d_cell_values")
def _(d):
    return AN.delete_result(stored_results(d), label_values(d), 7)[1].select("mapobject_id", F.col("values")["7"].alias("v7"))


# --- modules ---------------------------------------------------------------------------

@query("run_modules", """WITH cell AS (SELECT p.site_id, (p.y // 16) * 4 + p.x // 16 AS c, p.y, p.x, q.value FROM d_pixels p JOIN d_pixels2 q ON q.site_id = p.site_id AND q.y = p.y AND q.x = p.x WHERE p.value > 100),
    g AS (SELECT site_id, c, min(y * 64 + x) AS f, round(avg(value), 6) AS mean, count(*) AS n FROM cell GROUP BY 1, 2)
    SELECT site_id, CAST(row_number() OVER (PARTITION BY site_id ORDER BY f) AS INTEGER) AS label, mean FROM g""")
def _(d):
    steps = [MO.Step("threshold_manual", {"px": "dapi"}, "mask", {"level": 100}, {"px": "IntensityImage"}),
             MO.Step("invert", {"px": "dapi"}, "unused", active=False),
             MO.Step("label", {"mask": "mask"}, "cells", {"neighbours": 8}, {"mask": "MaskImage"}),
             MO.Step("measure_intensity", {"labels": "cells", "px": "gfp"}, "intensity", {}, {"labels": "LabelImage"})]
    out = MO.run_steps(steps, {"dapi": d.pixels(), "gfp": d.pixels2()})
    return out["intensity"].select("site_id", "label", F.round("mean", 6).alias("mean"))


@MO.extractor("spread")
def spread(pixels):
    import pandas as pd
    return pd.DataFrame({"spread": [float(pixels["value"].max() - pixels["value"].min())], "n": [len(pixels)]})


@query("extract_features", """SELECT l.site_id, CAST(l.label AS INTEGER) AS label, CAST(max(value) - min(value) AS DOUBLE) AS spread, count(*) AS n
    FROM d_labels l JOIN d_pixels2 p ON p.site_id = l.site_id AND p.y = l.y AND p.x = l.x GROUP BY 1, 2""")
def _(d):
    return MO.extract_features(d.labels(), d.pixels2(), "spread", "spread double, n bigint")


@query("save_objects", """WITH m AS (SELECT l.site_id, l.label, round(avg(value), 6) AS v FROM d_labels l JOIN d_pixels2 p ON p.site_id = l.site_id AND p.y = l.y AND p.x = l.x GROUP BY 1, 2)
    SELECT site_id AS partition_key, (SELECT max(o_orderkey) FROM orders) + row_number() OVER (ORDER BY site_id, label) AS mapobject_id, v FROM m""")
def _(d):
    measured = MO.MODULES["measure_intensity"](d.labels(), d.pixels2())
    existing = d.segmentations().select(F.col("partition_key").alias("site_id"), "label", "mapobject_id").unionByName(
        d.table("orders").selectExpr("o_custkey AS site_id", "0 AS label", "o_orderkey AS mapobject_id"))
    out = MO.save_objects(d.labels(), measured, {"mean": "1"}, 3, existing)
    return out["feature_values"].select("partition_key", "mapobject_id", F.col("values")["1"].alias("v"))


# Three runs: type 3 everywhere, type 4 everywhere, then type 3 again at every other site, at two time points.
_RUNS = """l AS (SELECT site_id, label, CAST(-floor(avg(y)) AS INTEGER) AS y, CAST(floor(avg(x)) AS INTEGER) AS x, count(*) AS n FROM d_labels GROUP BY 1, 2),
    one AS (SELECT *, row_number() OVER (ORDER BY site_id, label) AS id FROM l WHERE label <= 4),
    two AS (SELECT *, (SELECT max(id) FROM one) + row_number() OVER (ORDER BY site_id, label) AS id FROM l WHERE label BETWEEN 5 AND 6),
    three AS (SELECT *, (SELECT max(id) FROM two) + row_number() OVER (ORDER BY site_id, label) AS id FROM l WHERE site_id % 2 = 0),
    t AS (SELECT unnest([0, 1]) AS tpoint),
    o AS (SELECT one.*, 3 AS type, 0 AS tpoint FROM one WHERE site_id % 2 = 1 UNION ALL SELECT two.*, 4, 0 FROM two
      UNION ALL SELECT three.*, 3, tpoint FROM three, t WHERE tpoint = 0 OR label % 2 = 0)"""


def _saved(d):
    """The tables of a store after three runs."""
    folder = f"{shared_folder(d.spark)}/store-{uuid.uuid4().hex}"
    labels = d.labels().withColumn("zplane", F.lit(0)).withColumn("tpoint", F.explode(F.expr("IF(label % 2 = 0, array(0, 1), array(0))")))

    def run(part, type_id):
        measured = part.groupBy("site_id", "tpoint", "label").agg((F.count(F.lit(1)) + F.col("tpoint") / 3).alias("size"))
        RU.save_run(folder, part, measured, {"size": "7"}, type_id)

    run(labels.filter("tpoint = 0 AND label <= 4"), 3)
    run(labels.filter("tpoint = 0 AND label BETWEEN 5 AND 6"), 4)
    run(labels.filter("site_id % 2 = 0"), 3)
    return RU.read_run(d.spark, folder)


@query("save_run_objects", f"WITH {_RUNS} SELECT DISTINCT site_id AS partition_key, id, CAST(type AS INTEGER) AS mapobject_type_id FROM o")
def _(d):
    return _saved(d)["objects"].select("partition_key", "id", "mapobject_type_id")


@query("save_run_segmentations", f"WITH {_RUNS} SELECT site_id AS partition_key, id AS mapobject_id, CAST(type AS INTEGER) AS mapobject_type_id, CAST(tpoint AS INTEGER) AS tpoint, 0 AS zplane, CAST(label AS INTEGER) AS label, y, x FROM o")
def _(d):
    return _saved(d)["segmentations"].drop("polygon")


@query("save_run_values", f"WITH {_RUNS} SELECT site_id AS partition_key, id AS mapobject_id, CAST(type AS INTEGER) AS mapobject_type_id, CAST(tpoint AS INTEGER) AS tpoint, round(n + tpoint / 3, 6) AS size FROM o")
def _(d):
    return _saved(d)["feature_values"].select("partition_key", "mapobject_id", "mapobject_type_id", "tpoint", F.col("values")["7"].alias("size"))


# --- streaming ---------------------------------------------------------------------------

@query("illumination_stats_stream", """SELECT 0 AS y, CAST(date_diff('hour', TIMESTAMP '2024-01-01', date_trunc('hour', ts)) % 24 AS INTEGER) AS x, round(avg(CASE WHEN value > 0 THEN log10(value) ELSE 0 END), 8) AS mean,
    round(stddev_samp(CASE WHEN value > 0 THEN log10(value) ELSE 0 END), 8) AS std FROM events GROUP BY 2""")
def _(d):
    # Values of events stand for pixels of a one-line camera with one place per hour.
    spark = d.spark
    stream = (spark.readStream.schema(d.table("events").schema).option("pathGlobFilter", "events.parquet").parquet(d.folder)
              .selectExpr("0 AS y", "CAST(hour(ts) AS INT) AS x", "value"))
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    INC.illumination_stats_stream(stream, f"{folder}/stats", f"{folder}/state").awaitTermination()
    return INC.latest_stats(spark, f"{folder}/stats").select("y", "x", F.round("mean", 8).alias("mean"), F.round("std", 8).alias("std"))


@query("register_file_stream", """SELECT 'p_' || chr(CAST(65 + user_id % 8 AS INTEGER)) || '01_T0001F001L01A01Z01C01.png' AS name, 'image' AS kind, 'COMPLETE' AS status FROM events GROUP BY 1""")
def _(d):
    spark = d.spark
    names = (spark.readStream.schema(d.table("events").schema).option("pathGlobFilter", "events.parquet").parquet(d.folder)
             .selectExpr("concat('p_', chr(65 + user_id % 8), '01_T0001F001L01A01Z01C01.png') AS name"))
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    INC.register_file_stream(names, f"{folder}/registry", IMAGE_PATTERNS["cellvoyager"], METADATA_PATTERNS["cellvoyager"],
                             f"{folder}/state").awaitTermination()
    return spark.read.parquet(f"{folder}/registry").drop("batch")
