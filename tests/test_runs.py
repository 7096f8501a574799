import numpy as np
import pytest
from helpers import disk, to_image, to_rows
from pyspark.sql import functions as F

from siteframe.operators import pixels as P
from siteframe.plans import runs as RU


def some_labels(spark, rows):
    return spark.createDataFrame(rows, "site_id bigint, tpoint int, zplane int, label int, y int, x int")


def measured(labels, value):
    return labels.select("site_id", "tpoint", "label").distinct().withColumn("f", F.lit(value))


def told(spark, folder):
    return {n: sorted(map(str, t.collect())) for n, t in RU.read_run(spark, folder).items()}


def test_a_failed_save_leaves_the_earlier_run(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "store")
    first = some_labels(spark, [(1, 0, 0, 1, 2, 3), (2, 0, 0, 1, 4, 5), (2, 1, 0, 1, 4, 6)])
    RU.save_run(folder, first, measured(first, 1.23456789), {"f": "9"}, 3)
    before = told(spark, folder)
    assert len(before["objects"]) == 2 and len(before["segmentations"]) == 3 and "1.234568" in before["feature_values"][0]
    second = some_labels(spark, [(1, 0, 0, 1, 7, 7), (1, 0, 0, 2, 8, 8)])
    with pytest.raises(Exception, match="nothing"):
        RU.save_run(folder, second, measured(second, 2.0).withColumn("f", F.raise_error(F.lit("nothing"))), {"f": "9"}, 3)
    assert told(spark, folder) == before
    with monkeypatch.context() as m:
        # Another run is saved between the reading and the writing of the manifest.
        m.setattr(RU, "manifest", lambda *a: {"number": 0, "buckets": {}})
        with pytest.raises(RuntimeError, match="in between"):
            RU.save_run(folder, second, measured(second, 2.0), {"f": "9"}, 3)
    assert told(spark, folder) == before
    RU.save_run(folder, second, measured(second, 2.0), {"f": "9"}, 3)
    after = RU.read_run(spark, folder)
    assert sorted((r.partition_key, r.id) for r in after["objects"].collect()) == [(1, 3), (1, 4), (2, 2)]
    assert after["segmentations"].filter("partition_key = 2").count() == 2


def test_inputs_keep_their_objects(spark, tmp_path):
    folder = str(tmp_path / "store")
    first = some_labels(spark, [(1, 0, 0, 1, 2, 3), (1, 0, 0, 2, 9, 9)])
    RU.save_run(folder, first, measured(first, 1.0), {"f": "9"}, 3)
    again = some_labels(spark, [(1, 0, 0, 1, 4, 4), (1, 0, 0, 3, 5, 5)])
    RU.save_run(folder, again, measured(again, 2.0), {"f": "9"}, 3, as_input=True)
    tables = RU.read_run(spark, folder)
    assert sorted(r.id for r in tables["objects"].collect()) == [1, 2, 3]
    assert sorted((r.mapobject_id, r.label, r.y, r.x) for r in tables["segmentations"].collect()) == [(1, 1, -4, 4), (2, 2, -9, 9), (3, 3, -5, 5)]
    assert sorted((r.mapobject_id, r["values"]["9"]) for r in tables["feature_values"].collect()) == [(1, 2.0), (2, 1.0), (3, 2.0)]


def test_empty_store(spark, tmp_path):
    assert all(t.isEmpty() for t in RU.read_run(spark, str(tmp_path / "none")).values())


def test_surface_of_an_image_that_blocks_overhang(spark):
    """70 x 90 pixels and blocks of about 20: a plain numpy version with padded blocks and linear interpolation."""
    rng = np.random.default_rng(0)
    image = (rng.integers(10, 14, (70, 90)) + np.arange(90) // 9 + 60 * disk((70, 90), 30, 40, 15)).astype(np.int32)
    got = to_image(P.threshold_level(to_rows(spark, image), "Background", "Adaptive", least_block=20), image.shape, "level")

    def mode2(a):
        values, counts = np.unique(a, return_counts=True)
        return 2.0 * values[counts == counts.max()].min()

    h, w = image.shape
    b = min(range(22, 17, -1), key=lambda k: -(-h // k) * k - h + -(-w // k) * k - w)
    ny, nx = -(-h // b), -(-w // b)
    py, px = round((ny * b - h) / 2 + 1e-9), round((nx * b - w) / 2 + 1e-9)
    wide = np.pad(image, ((py, ny * b - h - py), (px, nx * b - w - px)), "edge")
    t = np.array([[mode2(wide[i * b:(i + 1) * b, j * b:(j + 1) * b]) for j in range(nx)] for i in range(ny)])
    u, v = (np.arange(h) + py + 0.5) / b - 0.5, (np.arange(w) + px + 0.5) / b - 0.5
    rows = np.array([np.interp(v, range(nx), line) for line in t])
    want = np.array([np.interp(u, range(ny), rows[:, j]) for j in range(w)]).T
    whole = mode2(image)
    assert np.allclose(got, np.clip(want, 0.7 * whole, 1.5 * whole))


def test_levels_per_object_and_bounds(spark):
    image = np.full((20, 30), 100, np.int32)
    label = np.zeros((20, 30), np.int32)
    label[2:6, 2:6], label[2:6, 12:16], label[10:14, 2:6] = 1, 2, 3
    image[label == 1], image[label == 2], image[label == 3] = 90, 10, 255
    rows = to_rows(spark, label, "label", keep=lambda v: v > 0)
    out = P.threshold_level(to_rows(spark, image), "Background", "PerObject", rows, upper=290)
    got = to_image(out, image.shape, "level")
    assert set(got[label == 1]) == {180.0} and set(got[label == 2]) == {140.0} and set(got[label == 3]) == {290.0} and set(got[label == 0]) == {140.0}
    with pytest.raises(ValueError):
        P.threshold_level(to_rows(spark, image), "Background", "PerObject")
    with pytest.raises(ValueError):
        P.threshold_level(to_rows(spark, image), "Background", "Local")


def test_metadata_step_reads_the_files_once(spark):
    """The names are made by one scan, whatever number of steps reads them; names may repeat."""
    from siteframe.functions.scalars import IMAGE_PATTERNS
    from siteframe.plans import configure
    files = spark.range(24).selectExpr("format_string('p_A01_T0001F%03dL01A01Z01C%02d.png', id % 6 + 1, id DIV 6 % 2 + 1) AS name")
    out = configure.configure_metadata(files, IMAGE_PATTERNS["cellvoyager"], n_rows=2, n_cols=3)
    assert "Range" not in out._jdf.queryExecution().executedPlan().toString()
    assert {(r.grid_y, r.grid_x, r.channel_index) for r in out.collect()} == {(y, x, c) for y in range(2) for x in range(3) for c in range(2)}
    assert out.count() == 12
