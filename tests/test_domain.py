from pyspark.sql import functions as F

from siteframe.domain import SITES_A_TASK, Domain


def images(spark, folder, n):
    spark.range(n).select(F.col("id").alias("s_suppkey")).coalesce(1).write.parquet(f"{folder}/supplier.parquet")
    return Domain(spark, str(folder))


def test_pixels_are_not_taken_for_a_small_table(spark, tmp_path, capsys):
    d = images(spark, tmp_path, 2000)
    d.pixels().join(d.labels(), ["site_id", "y", "x"]).explain()
    assert "BroadcastHashJoin" not in capsys.readouterr().out


def test_pixels_are_made_by_many_tasks(spark, tmp_path):
    n = 3 * SITES_A_TASK
    px = images(spark, tmp_path, n).pixels()
    assert px.rdd.getNumPartitions() == 3
    got = px.groupBy("site_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("y", "x").alias("places"),
                                    F.sum(F.col("y") * 64 + F.col("x")).alias("at"))
    assert got.filter("n = 4096 AND places = 4096 AND at = 8386560").count() == n
    v = px.filter("site_id = 700 AND y = 8 AND x BETWEEN 8 AND 15").orderBy("x").select("value").collect()
    assert [r["value"] for r in v] == [(700 * 7919 + 8 * 31 + x * 17) % 50 + (120 if (x - 8) ** 2 <= 9 else 0) for x in range(8, 16)]
