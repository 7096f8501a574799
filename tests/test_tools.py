import numpy as np
import pytest
from helpers import noise, to_rows
from pyspark.sql import functions as F

from siteframe.functions.scalars import IMAGE_PATTERNS, METADATA_PATTERNS
from siteframe.operators import analysis as AN
from siteframe.plans import modules as MO
from siteframe.streaming import incremental as INC


def blobs(spark, n=120):
    rng = np.random.default_rng(0)
    rows = [(i, [float(v) for v in rng.normal(0, 1, 4) + 8 * np.eye(4)[i % 3]], float(i % 3)) for i in range(n)]
    return spark.createDataFrame(rows, "mapobject_id bigint, features array<double>, target double").repartition(2)


def test_clusters_follow_the_groups(spark):
    data = blobs(spark)
    got = AN.cluster(data, "features", 3).join(data, "mapobject_id")
    assert got.select("label", "target").distinct().count() == 3


@pytest.mark.parametrize("method, grid", [("randomforest", {"numTrees": [3, 6]}), ("svm", {"regParam": [0.01]}),
                                          ("logisticregression", {"regParam": [0.01]})])
def test_classifiers_learn_the_groups(spark, method, grid):
    data = blobs(spark)
    known = data.filter("mapobject_id < 60").select("mapobject_id", "target")
    got = AN.classify(data.drop("target"), "features", known, method, 2, grid)
    assert AN.accuracy(got, data.select("mapobject_id", "target")) > 0.9


def test_unknown_method_and_empty_heatmap(spark):
    with pytest.raises(ValueError):
        AN.classify(blobs(spark), "features", blobs(spark).select("mapobject_id", "target"), "tree", 2)
    values = spark.createDataFrame([(1, {"1": float("nan")})], "id int, values map<string,double>")
    with pytest.raises(ValueError, match="no values"):
        AN.heatmap(values, 1, "h")


def test_label_index():
    assert AN.label_index([{"name": "a", "color": "red"}]) == {0.0: {"name": "a", "color": "red"}}


def test_steps_check_their_inputs(spark):
    px = to_rows(spark, noise((6, 6)))
    with pytest.raises(KeyError, match="no earlier step"):
        MO.run_steps([MO.Step("label", {"mask": "nothing"}, "out")], {"px": px})
    with pytest.raises(TypeError, match="MaskImage"):
        MO.run_steps([MO.Step("label", {"mask": "px"}, "out", kinds={"mask": "MaskImage"})], {"px": px})
    with pytest.raises(KeyError, match="unknown module"):
        MO.run_steps([MO.Step("nope", {}, "out")], {})
    out = MO.run_steps([MO.Step("invert", {"px": "px"}, "out", {"max_value": 255}), MO.Step("nope", {}, "x", active=False)], {"px": px})
    assert out["out"].count() == 36


def test_own_modules_can_be_registered(spark):
    @MO.module("double")
    def double(px):
        return px.withColumn("value", F.col("value") * 2)

    out = MO.run_steps([MO.Step("double", {"px": "a"}, "b")], {"a": to_rows(spark, np.ones((2, 2), np.int32))})
    assert out["b"].agg(F.sum("value")).first()[0] == 8


def test_statistics_stream_equals_batch(spark, tmp_path):
    from siteframe.operators.pixels import illumination_stats
    folder = str(tmp_path / "px")
    px = to_rows(spark, noise((4, 4), 1)).unionByName(to_rows(spark, noise((4, 4), 2), site=1)).unionByName(to_rows(spark, noise((4, 4), 3), site=2))
    for site in range(3):
        px.filter(f"site_id = {site}").coalesce(1).write.mode("append").parquet(folder)
    stream = INC.read_pixel_stream(spark, folder, "site_id bigint, y int, x int, value int", 1)
    INC.illumination_stats_stream(stream, str(tmp_path / "stats"), str(tmp_path / "c")).awaitTermination()
    got = {(r.y, r.x): (r.mean, r["std"]) for r in INC.latest_stats(spark, str(tmp_path / "stats")).collect()}
    for r in illumination_stats(px).collect():
        assert got[r.y, r.x] == pytest.approx((r.mean, r["std"]))


@pytest.mark.parametrize("merge_every", [8, 2])
def test_statistics_stream_writes_what_it_changed(spark, tmp_path, merge_every):
    from siteframe.operators.pixels import illumination_stats
    folder, stats = str(tmp_path / "px"), str(tmp_path / "stats")
    schema = "site_id bigint, channel_id int, y int, x int, value int"

    def run(site, channel):
        new = to_rows(spark, noise((4, 4), 10 * site + channel), site=site).selectExpr("site_id", f"{channel} AS channel_id", "y", "x", "int(value) AS value")
        new.coalesce(1).write.mode("append").parquet(folder)
        INC.illumination_stats_stream(INC.read_pixel_stream(spark, folder, schema, 1), stats, str(tmp_path / "c"), merge_every).awaitTermination()

    run(0, 1)
    run(1, 2)
    run(2, 1)
    got = {(r.channel_id, r.y, r.x): (r.mean, r["std"]) for r in INC.latest_stats(spark, stats).collect()}
    want = illumination_stats(spark.read.parquet(folder)).collect()
    assert len(got) == len(want) == 32
    for r in want:
        assert got[r.channel_id, r.y, r.x] == (pytest.approx((r.mean, r["std"])) if r["std"] is not None else (pytest.approx(r.mean), None))
    whole, changed = INC._versions(spark, stats)
    assert (whole, changed) == ((None, [0, 1, 2]) if merge_every == 8 else (1, [2]))
    kept = {(kind, n) for kind, n, _ in INC._folders(spark, stats)}
    assert kept == ({("batch", 0), ("batch", 1), ("batch", 2)} if merge_every == 8 else {("upto", 1), ("batch", 2)})
    last = spark.read.parquet(f"{stats}/batch=2")
    assert last.select("channel_id").distinct().collect() == [(1,)]
    # A batch that a failure repeats after it was merged does not count again.
    last.write.parquet(f"{stats}/batch=0", mode="overwrite")
    if whole is not None:
        again = {(r.channel_id, r.y, r.x): (r.mean, r["std"]) for r in INC.latest_stats(spark, stats).collect()}
        assert again == got


def test_file_stream_registers_each_name_once(spark, tmp_path):
    names = [("p_A01_T0001F001L01A01Z01C01.png",), (".hidden.png",), ("notes.txt",), ("x.mlf",)]
    source = str(tmp_path / "names")
    for _ in range(2):
        spark.createDataFrame(names, "name string").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema("name string").option("maxFilesPerTrigger", 1).parquet(source)
    target = str(tmp_path / "registry")
    INC.register_file_stream(stream, target, IMAGE_PATTERNS["cellvoyager"], METADATA_PATTERNS["cellvoyager"], str(tmp_path / "c")).awaitTermination()
    assert sorted((r.name, r.kind) for r in spark.read.parquet(target).collect()) == [
        ("p_A01_T0001F001L01A01Z01C01.png", "image"), ("x.mlf", "metadata")]


def test_registered_queries_and_twins_agree_on_names():
    import __spark_entry__ as entry
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 190 and len(oracles) > 170


def test_flagship_runs(spark):
    import __spark_entry__ as entry
    df = entry.entry(spark)
    assert df.count() > 0 and "Intensity_mean_DNA" in df.columns


def test_handles_are_checked(spark):
    image = to_rows(spark, np.ones((2, 2), np.int32))
    MO.check_handle("IntensityImage", image, "a")
    for kind, value in (("MaskImage", image), ("LabelImage", image), ("Boolean", 1), ("Numeric", True), ("Character", 3), ("Sequence", "a"), ("Set", [1])):
        with pytest.raises(TypeError):
            MO.check_handle(kind, value, "a")
    for kind, value in (("Boolean", True), ("Numeric", 0.5), ("Character", "a"), ("Sequence", (1, 2)), ("Set", {1})):
        MO.check_handle(kind, value, "a")
    with pytest.raises(ValueError):
        MO.run_tool("none")
