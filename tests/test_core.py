import pytest
from pyspark.sql import functions as F

from siteframe import core
from siteframe.domain import expand


def test_running_index_equals_row_number_across_buckets(spark):
    df = spark.range(500).select((F.col("id") * 7 % 1000).alias("k"), (F.col("id") % 3).alias("g"))
    got = {(r.g, r.k): r.i for r in core.running_index(df, ["g"], "k", "i", width=10).collect()}
    for g in range(3):
        keys = sorted(k for (gg, k) in got if gg == g)
        assert [got[g, k] for k in keys] == list(range(len(keys)))


def test_dense_index_gives_equal_ranks_to_equal_keys(spark):
    df = spark.createDataFrame([(5,), (5,), (9,), (100,)], "k int")
    assert sorted((r.k, r.i) for r in core.dense_index(df, [], "k", "i", width=4).collect()) == [(5, 0), (5, 0), (9, 1), (100, 2)]


def test_salted_join_spreads_hot_keys_and_keeps_all_rows(spark):
    left = spark.range(1000).select(F.lit(1).alias("k"), "id")
    left = left.unionByName(spark.range(5).select(F.lit(2).alias("k"), "id"))
    right = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string")
    assert core.salted_join(left, right, ["k"], hot_rows=100).count() == 2005


def test_require_empty_raises_with_example(spark):
    core.require_empty(spark.range(0), "none")
    with pytest.raises(ValueError, match="bad"):
        core.require_empty(spark.range(1), "bad")


def test_cut_lineage_uses_the_folder_of_the_session(spark):
    df = core.cut_lineage(spark.range(3))
    assert spark.sparkContext.getCheckpointDir() is not None
    assert df.count() == 3


def test_expand_adds_only_needed_tables():
    sql = expand("SELECT * FROM d_spots")
    assert sql.startswith("WITH d_spots AS") and "d_cells" not in sql
    assert expand("WITH RECURSIVE a AS (SELECT 1) SELECT * FROM a, d_wells").startswith("WITH RECURSIVE d_wells")


def test_exact_quantiles_equal_percentile(spark):
    from pyspark.sql import functions as F

    from siteframe.core import exact_quantiles
    df = spark.range(5000).selectExpr("if(id % 7 = 0, null, cast(pmod(id * 7919, 997) as double)) as v")
    shares = [0.0, 0.013, 0.5, 0.77, 1.0]
    want = df.agg(F.percentile("v", F.array(*[F.lit(s) for s in shares]))).first()[0]
    assert exact_quantiles(df, "v", shares).first()[0] == pytest.approx(want)


def test_positions_over_ranges(spark):
    from siteframe.core import range_index
    rows = [(f"k{i * 37 % 1000:04d}", i % 3) for i in range(1000)] + [(None, 5)]
    got = range_index(spark.createDataFrame(rows, "key string, n int").repartition(7), ["key"], "pos").collect()
    assert [r.pos for r in sorted(got, key=lambda r: (r.key is not None, r.key or ""))] == list(range(1001))


def test_many_rows_in_small_files_are_not_broadcast(spark):
    """Half a million rows of few different values are some kilobytes of files, and some 16 MB of rows in a broadcast."""
    rows = spark.range(500_000, numPartitions=1).selectExpr("id DIV 4096 AS site_id", "id DIV 64 % 64 AS y", "id % 64 AS x")
    large = core.cut_lineage(rows)
    joined = spark.range(3_000_000).selectExpr("id % 200 AS site_id", "id AS other").join(large.groupBy("site_id", "y").agg(F.max("x").alias("x")), "site_id")
    assert "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString()
    few = core.cut_lineage(rows.filter("site_id < 3"))
    assert "BroadcastHashJoin" in spark.range(3_000_000).selectExpr("id AS site_id").join(few, "site_id")._jdf.queryExecution().executedPlan().toString()
    assert large.join(few, ["site_id", "y", "x"]).count() == 3 * 4096
