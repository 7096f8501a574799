"""Maps the given star-schema tables onto the screening tables.

``Domain`` builds the screening tables with Spark; ``CTES`` states the same
mapping in plain SQL for the result checks.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteframe.core import meet_by_image

SPOT_BASE = 1_000_000_000_000
#: Images of 4 096 pixels that one task makes.
SITES_A_TASK = 256

CTES = {
    "d_plates": """SELECT r_regionkey AS plate_id, printf('plate%02d', r_regionkey) AS plate_name
        FROM region""",
    "d_wells": """SELECT n_nationkey AS well_id, n_regionkey AS plate_id,
          chr(65 + n_nationkey // 5) || lpad(CAST(n_nationkey % 5 + 1 AS VARCHAR), 2, '0') AS well_name,
          n_nationkey // 5 AS well_y, n_nationkey % 5 AS well_x
        FROM nation""",
    "d_sites": """SELECT c_custkey AS site_id, c_nationkey AS well_id,
          CAST(c_custkey // 40 AS INTEGER) AS site_y, CAST(c_custkey % 40 AS INTEGER) AS site_x,
          64 AS height, 64 AS width, c_acctbal < 0 AS omitted,
          CAST(c_custkey % 3 AS INTEGER) AS top_residue, CAST(c_custkey % 2 AS INTEGER) AS bottom_residue,
          CAST(c_custkey % 4 AS INTEGER) AS left_residue, CAST(c_custkey % 5 AS INTEGER) AS right_residue
        FROM customer""",
    "d_types": """SELECT * FROM (VALUES (1, 'Cells', 'Site'), (2, 'Spots', 'Site'))
        t(mapobject_type_id, type_name, ref_type)""",
    "d_features": """SELECT * FROM (VALUES (1, 'Intensity_mean_DNA', 1), (2, 'Morphology_Area', 1),
          (3, 'Intensity_max_RNA', 2), (4, 'Intensity_sum_RNA', 2),
          (5, 'Morphology_Extent', 2), (6, 'Morphology_Elongation', 2))
        t(feature_id, feature_name, mapobject_type_id)""",
    "d_cells": """SELECT o_custkey AS partition_key, o_orderkey AS id, 1 AS mapobject_type_id,
          CAST(NULL AS BIGINT) AS ref_id FROM orders""",
    "d_spots": """SELECT o.o_custkey AS partition_key,
          1000000000000 + l.l_orderkey * 8 + l.l_linenumber AS id, 2 AS mapobject_type_id,
          l.l_orderkey AS ref_id
        FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) l
        JOIN orders o ON l.l_orderkey = o.o_orderkey""",
    "d_objects": "SELECT * FROM d_cells UNION ALL SELECT * FROM d_spots",
    "d_segmentations": """SELECT o_custkey AS partition_key, o_orderkey AS mapobject_id,
          10 + CAST(year(o_orderdate) % 3 AS INTEGER) AS segmentation_layer_id,
          CAST(year(o_orderdate) % 3 AS INTEGER) AS tpoint, 0 AS zplane,
          CAST(o_orderkey AS INTEGER) AS label,
          CAST(greatest((o_orderkey * 37) % 56 + 4 - (2 + o_orderkey % 5), 0) AS INTEGER) AS x0,
          CAST(least((o_orderkey * 37) % 56 + 4 + (2 + o_orderkey % 5), 63) AS INTEGER) AS x1,
          CAST(greatest((o_orderkey * 53) % 56 + 4 - (2 + o_orderkey % 5), 0) AS INTEGER) AS y0,
          CAST(least((o_orderkey * 53) % 56 + 4 + (2 + o_orderkey % 5), 63) AS INTEGER) AS y1
        FROM orders WHERE o_orderkey % 101 <> 0""",
    "d_cell_values": """SELECT o_custkey AS partition_key, o_orderkey AS mapobject_id,
          CAST(year(o_orderdate) % 3 AS INTEGER) AS tpoint, o_totalprice AS f1,
          CAST(length(o_orderpriority) AS DOUBLE) AS f2
        FROM orders WHERE o_orderkey % 97 <> 0""",
    "d_spot_values": """SELECT o.o_custkey AS partition_key,
          1000000000000 + l.l_orderkey * 8 + l.l_linenumber AS mapobject_id,
          CAST(any_value(year(o.o_orderdate)) % 3 AS INTEGER) AS tpoint,
          sum(l_quantity) AS f3, max(l_extendedprice) AS f4, max(l_tax) AS f5,
          CASE WHEN min(l_discount) = 0 THEN CAST('NaN' AS DOUBLE) ELSE min(l_discount) END AS f6
        FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
        GROUP BY o.o_custkey, l.l_orderkey, l.l_linenumber""",
    "d_files": """SELECT l_orderkey, l_linenumber, l_partkey,
          CASE WHEN l_orderkey % 100 = 0 THEN 'thumbs_' || l_partkey || '.db'
            WHEN l_orderkey % 100 = 1 THEN 'Measurement' || l_partkey || '.mlf'
            ELSE printf('p_%s%02d_T%04dF%03dL01A01Z%02dC%02d.png', chr(CAST(65 + l_suppkey % 8 AS INTEGER)),
              l_suppkey % 12 + 1, year(l_shipdate) - 1990, l_partkey % 9 + 1,
              CAST(l_quantity AS INTEGER) % 3 + 1, l_linenumber % 4 + 1) END AS name,
          CAST(l_suppkey % 10 AS INTEGER) AS acquisition_id,
          CASE WHEN l_suppkey % 10 < 3 THEN 'COMPLETE' WHEN l_suppkey % 10 < 6 THEN 'WAITING'
            WHEN l_linestatus = 'O' THEN 'UPLOADING' ELSE 'COMPLETE' END AS status
        FROM lineitem""",
    "d_planes": """SELECT DISTINCT CAST(l_suppkey % 12 AS INTEGER) AS well_id,
          chr(CAST(65 + l_suppkey % 3 AS INTEGER)) || lpad(CAST(l_suppkey % 4 + 1 AS VARCHAR), 2, '0') AS well_name,
          'C' || (l_linenumber % 4 + 1) AS channel_name, CAST(year(l_shipdate) AS INTEGER) AS tpoint,
          CAST(l_quantity AS INTEGER) % 3 AS zplane,
          CAST((l_partkey % 9) // 3 * 1000 + 500 AS DOUBLE) AS stage_y,
          CAST((l_partkey % 9) % 3 * 1000 + 250 AS DOUBLE) AS stage_x, 16 AS bit_depth
        FROM lineitem""",
    "d_pixels": """SELECT s_suppkey AS site_id, CAST(gy.y AS INTEGER) AS y, CAST(gx.x AS INTEGER) AS x,
          CAST(((s_suppkey*7919 + gy.y*31 + gx.x*17) % 50)
           + CASE WHEN (gy.y%16-8)*(gy.y%16-8) + (gx.x%16-8)*(gx.x%16-8)
             <= (3+(s_suppkey+gy.y//16*4+gx.x//16)%4)*(3+(s_suppkey+gy.y//16*4+gx.x//16)%4)
             THEN 120 ELSE 0 END AS INTEGER) AS value
        FROM supplier, (SELECT unnest(generate_series(0, 63)) AS y) gy,
          (SELECT unnest(generate_series(0, 63)) AS x) gx""",
    "d_pixels2": """SELECT site_id, y, x, CAST((value * 3 + x + 2 * y) % 251 AS INTEGER) AS value
        FROM d_pixels""",
    "d_labels": """SELECT site_id, y, x, (y // 16) * 4 + x // 16 + 1 AS label
        FROM d_pixels WHERE value >= 120""",
    "d_shifts": """SELECT s_suppkey AS site_id, c.cycle_id,
          CAST(CASE WHEN c.cycle_id = 0 THEN 0 ELSE s_suppkey % 5 - 2 END AS INTEGER) AS y,
          CAST(CASE WHEN c.cycle_id = 0 THEN 0 ELSE s_suppkey % 3 - 1 END AS INTEGER) AS x
        FROM supplier, (SELECT unnest([0, 1]) AS cycle_id) c""",
    "d_points": """SELECT o_custkey AS site_id, o_orderkey AS point_id, o_orderkey % 4 AS parent,
          CAST((o_orderkey * 37) % 64 AS INTEGER) AS x, CAST((o_orderkey * 53) % 64 AS INTEGER) AS y
        FROM orders""",
}


def expand(sql: str) -> str:
    """Prefix `sql` with the CTEs of the screening tables it names."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in re.findall(r"\bd_[a-z_0-9]+\b", text):
            if name in CTES and name not in needed:
                visit(CTES[name])
                if name not in needed:
                    needed.append(name)

    visit(sql)
    if not needed:
        return sql
    head = ",\n".join(f"{n} AS ({CTES[n]})" for n in needed)
    body = sql.strip()
    match = re.match(r"(?is)^with(\s+recursive)?\s", body)
    if match:
        recursive = " RECURSIVE" if match.group(1) else ""
        return f"WITH{recursive} {head},\n{body[match.end():]}"
    return f"WITH {head}\n{body}"


class Domain:
    """Screening tables over one folder of the given tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = meet_by_image(spark)
        self.folder = folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def plates(self) -> DataFrame:
        return self.table("region").select(
            F.col("r_regionkey").alias("plate_id"),
            F.format_string("plate%02d", "r_regionkey").alias("plate_name"))

    def wells(self) -> DataFrame:
        key = F.col("n_nationkey")
        row, col = F.expr("CAST(n_nationkey DIV 5 AS INT)"), key % 5
        return self.table("nation").select(
            key.alias("well_id"), F.col("n_regionkey").alias("plate_id"),
            F.format_string("%s%02d", F.chr(row + 65), col + 1).alias("well_name"),
            row.alias("well_y"), col.alias("well_x"))

    def sites(self) -> DataFrame:
        return self.table("customer").selectExpr(
            "c_custkey AS site_id", "c_nationkey AS well_id",
            "CAST(c_custkey DIV 40 AS INT) AS site_y", "CAST(c_custkey % 40 AS INT) AS site_x",
            "64 AS height", "64 AS width", "c_acctbal < 0 AS omitted",
            "CAST(c_custkey % 3 AS INT) AS top_residue",
            "CAST(c_custkey % 2 AS INT) AS bottom_residue",
            "CAST(c_custkey % 4 AS INT) AS left_residue",
            "CAST(c_custkey % 5 AS INT) AS right_residue")

    def types(self) -> DataFrame:
        return self.spark.sql("""SELECT * FROM VALUES (1, 'Cells', 'Site'), (2, 'Spots', 'Site')
            AS t(mapobject_type_id, type_name, ref_type)""")

    def features(self) -> DataFrame:
        return self.spark.sql("""SELECT * FROM VALUES (1, 'Intensity_mean_DNA', 1),
              (2, 'Morphology_Area', 1), (3, 'Intensity_max_RNA', 2), (4, 'Intensity_sum_RNA', 2),
              (5, 'Morphology_Extent', 2), (6, 'Morphology_Elongation', 2)
            AS t(feature_id, feature_name, mapobject_type_id)""")

    def layers(self) -> DataFrame:
        return self.spark.sql("""SELECT * FROM VALUES (10, 1, 0, 0), (11, 1, 1, 0), (12, 1, 2, 0)
            AS t(segmentation_layer_id, mapobject_type_id, tpoint, zplane)""")

    def cells(self) -> DataFrame:
        return self.table("orders").selectExpr(
            "o_custkey AS partition_key", "o_orderkey AS id", "1 AS mapobject_type_id",
            "CAST(NULL AS BIGINT) AS ref_id")

    def spots(self) -> DataFrame:
        orders = self.table("orders").selectExpr("o_orderkey AS l_orderkey",
                                                 "o_custkey AS partition_key")
        return (self.table("lineitem").select("l_orderkey", "l_linenumber").distinct()
                .join(orders, "l_orderkey")
                .selectExpr("partition_key", f"{SPOT_BASE} + l_orderkey * 8 + l_linenumber AS id",
                            "2 AS mapobject_type_id", "l_orderkey AS ref_id"))

    def objects(self) -> DataFrame:
        return self.cells().unionByName(self.spots())

    def segmentations(self) -> DataFrame:
        cx, cy, r = "(o_orderkey * 37) % 56 + 4", "(o_orderkey * 53) % 56 + 4", "(2 + o_orderkey % 5)"
        return self.table("orders").filter("o_orderkey % 101 <> 0").selectExpr(
            "o_custkey AS partition_key", "o_orderkey AS mapobject_id",
            "CAST(10 + year(o_orderdate) % 3 AS INT) AS segmentation_layer_id",
            "CAST(year(o_orderdate) % 3 AS INT) AS tpoint", "0 AS zplane",
            "CAST(o_orderkey AS INT) AS label",
            f"CAST(greatest({cx} - {r}, 0) AS INT) AS x0",
            f"CAST(least({cx} + {r}, 63) AS INT) AS x1",
            f"CAST(greatest({cy} - {r}, 0) AS INT) AS y0",
            f"CAST(least({cy} + {r}, 63) AS INT) AS y1")

    def cell_values(self) -> DataFrame:
        """Feature values of cells as a map keyed by feature id."""
        return self.table("orders").filter("o_orderkey % 97 <> 0").selectExpr(
            "o_custkey AS partition_key", "o_orderkey AS mapobject_id",
            "CAST(year(o_orderdate) % 3 AS INT) AS tpoint",
            "map('1', o_totalprice, '2', CAST(length(o_orderpriority) AS DOUBLE)) AS values")

    def spot_values(self) -> DataFrame:
        orders = self.table("orders").selectExpr(
            "o_orderkey AS l_orderkey", "o_custkey AS partition_key",
            "CAST(year(o_orderdate) % 3 AS INT) AS tpoint")
        spots = self.table("lineitem").groupBy("l_orderkey", "l_linenumber").agg(
            F.sum("l_quantity").alias("f3"), F.max("l_extendedprice").alias("f4"),
            F.max("l_tax").alias("f5"), F.min("l_discount").alias("f6"))
        return spots.join(orders, "l_orderkey").selectExpr(
            "partition_key", f"{SPOT_BASE} + l_orderkey * 8 + l_linenumber AS mapobject_id", "tpoint",
            "map('3', f3, '4', f4, '5', f5, '6', if(f6 = 0, double('NaN'), f6)) AS values")

    def feature_values(self) -> DataFrame:
        return self.cell_values().unionByName(self.spot_values())

    def files(self) -> DataFrame:
        return self.table("lineitem").selectExpr(
            "l_orderkey", "l_linenumber", "l_partkey",
            """CASE WHEN l_orderkey % 100 = 0 THEN concat('thumbs_', l_partkey, '.db')
                WHEN l_orderkey % 100 = 1 THEN concat('Measurement', l_partkey, '.mlf')
                ELSE format_string('p_%s%02d_T%04dF%03dL01A01Z%02dC%02d.png', chr(65 + l_suppkey % 8),
                  l_suppkey % 12 + 1, year(l_shipdate) - 1990, l_partkey % 9 + 1,
                  CAST(l_quantity AS INT) % 3 + 1, l_linenumber % 4 + 1) END AS name""",
            "CAST(l_suppkey % 10 AS INT) AS acquisition_id",
            """CASE WHEN l_suppkey % 10 < 3 THEN 'COMPLETE' WHEN l_suppkey % 10 < 6 THEN 'WAITING'
                WHEN l_linestatus = 'O' THEN 'UPLOADING' ELSE 'COMPLETE' END AS status""")

    def planes(self) -> DataFrame:
        """One row per image plane with stage positions, as metadata readers deliver."""
        return self.table("lineitem").selectExpr(
            "CAST(l_suppkey % 12 AS INT) AS well_id",
            "format_string('%s%02d', chr(65 + l_suppkey % 3), l_suppkey % 4 + 1) AS well_name",
            "concat('C', l_linenumber % 4 + 1) AS channel_name",
            "CAST(year(l_shipdate) AS INT) AS tpoint",
            "CAST(l_quantity AS INT) % 3 AS zplane",
            "CAST((l_partkey % 9) DIV 3 * 1000 + 500 AS DOUBLE) AS stage_y",
            "CAST((l_partkey % 9) % 3 * 1000 + 250 AS DOUBLE) AS stage_x",
            "16 AS bit_depth").distinct()

    def pixels(self) -> DataFrame:
        """One 64 x 64 image of sixteen disks on a noisy background per supplier.

        Positions come by a join, whose size Spark estimates as the product of both sides; it takes an exploded
        table for one as small as its source and would broadcast the pixels. A task makes about a million pixels.
        """
        radius = "(3 + (s_suppkey + y DIV 16 * 4 + x DIV 16) % 4)"
        grid = self.spark.range(64 * 64).selectExpr("CAST(id DIV 64 AS INT) AS y", "CAST(id % 64 AS INT) AS x")
        sites = self.table("supplier").select("s_suppkey")
        parts = -(-sites.count() // SITES_A_TASK)
        if parts > 1:
            sites = sites.repartition(parts, "s_suppkey")
        return (sites.crossJoin(F.broadcast(grid))
                .selectExpr("s_suppkey AS site_id", "y", "x",
                            f"""CAST((s_suppkey * 7919 + y * 31 + x * 17) % 50
                              + IF((y % 16 - 8) * (y % 16 - 8) + (x % 16 - 8) * (x % 16 - 8)
                                <= {radius} * {radius}, 120, 0) AS INT) AS value"""))

    def pixels2(self) -> DataFrame:
        """A second channel of the same sites."""
        return self.pixels().withColumn("value", F.expr("CAST((value * 3 + x + 2 * y) % 251 AS INT)"))

    def labels(self) -> DataFrame:
        """Label image of the sixteen disks of each site."""
        return self.pixels().filter("value >= 120").selectExpr(
            "site_id", "y", "x", "CAST((y DIV 16) * 4 + x DIV 16 + 1 AS INT) AS label")

    def shifts(self) -> DataFrame:
        return self.table("supplier").withColumn("cycle_id", F.explode(F.sequence(F.lit(0), F.lit(1)))
                                                 ).selectExpr(
            "s_suppkey AS site_id", "cycle_id",
            "CAST(IF(cycle_id = 0, 0, s_suppkey % 5 - 2) AS INT) AS y",
            "CAST(IF(cycle_id = 0, 0, s_suppkey % 3 - 1) AS INT) AS x")

    def points(self) -> DataFrame:
        return self.table("orders").selectExpr(
            "o_custkey AS site_id", "o_orderkey AS point_id", "o_orderkey % 4 AS parent",
            "CAST((o_orderkey * 37) % 64 AS INT) AS x", "CAST((o_orderkey * 53) % 64 AS INT) AS y")

    def embeddings(self) -> DataFrame:
        return self.table("embeddings").selectExpr("vec_id AS mapobject_id", "embedding", "label")
