"""The whole metadata step: from file names and optional reader output to images."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteframe.core import cut_lineage
from siteframe.operators import layout as L
from siteframe.sources.files import parse_file_names


def group_stacks(planes: DataFrame, site: tuple[str, ...] = ("well_name", "grid_y", "grid_x")) -> DataFrame:
    """One mapping per image with the files of all its z planes in z order."""
    return planes.groupBy(*site, "channel", "tpoint").agg(F.array_sort(F.collect_list(F.struct(
        "zplane", F.col("name").alias("file"), F.lit(0).alias("plane")))).alias("file_map"))


def file_maps(planes: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Mapping of each image plane to its file, series and plane in the file."""
    return planes.select(*keys, F.array(F.struct(
        F.col("name").alias("file"), F.lit(0).alias("series"), F.lit(0).alias("plane"))).alias("file_map"))


FIELDS = ("well_name", "channel", "zplane", "tpoint", "site")


def plane_fields(files: DataFrame, pattern: str, ome: DataFrame | None = None) -> DataFrame:
    """Well, channel, z plane, time point and site of each file: as embedded in the
    file (`ome`, null where it tells nothing), else from its name. A name is only
    parsed where something is missing; what both lack is an error. The different names
    are written once, since every later step reads them again."""
    names = cut_lineage(files.select("name").distinct())
    if ome is None:
        return parse_file_names(names, pattern)
    known = names.join(ome.select("name", *FIELDS).dropDuplicates(["name"]), "name", "left")
    complete = F.lit(True)
    for c in FIELDS:
        complete = complete & F.col(c).isNotNull()
    partial = known.filter(~complete)
    parsed = parse_file_names(partial.select("name"), pattern).select("name", *[F.col(c).alias(f"_{c}") for c in FIELDS])
    filled = partial.join(parsed, "name").select("name", *[F.coalesce(c, f"_{c}").alias(c) for c in FIELDS])
    return known.filter(complete).select("name", *FIELDS).unionByName(filled)


def configure_metadata(files: DataFrame, pattern: str, positions: DataFrame | None = None,
                       n_rows: int | None = None, n_cols: int | None = None,
                       layout: str = "horizontal", tolerance: float = 1.0,
                       stack: bool = False, ome: DataFrame | None = None) -> DataFrame:
    """Fields come from embedded metadata and file names; grid coordinates from stage
    positions when a metadata reader delivered them for all files, otherwise from the
    stated acquisition layout."""
    fields = plane_fields(files, pattern, ome)
    if positions is not None and n_rows is not None:
        placed = positions.filter(F.col("stage_y").isNotNull() & F.col("stage_x").isNotNull())
        if not fields.join(placed, "name", "left_anti").isEmpty():
            positions = None
    if positions is not None:
        grid = L.grid_from_positions(positions.select("name", "well_name", "stage_y", "stage_x"), tolerance)
        planes = fields.drop("well_name").join(grid.drop("stage_y", "stage_x"), "name")
    elif n_rows is not None and n_cols is not None:
        sites = fields.select("well_name", "site").distinct()
        first = sites.groupBy("well_name").agg(F.min("site").alias("_first"))
        indexed = sites.join(first, "well_name").select(
            "well_name", "site", (F.col("site") - F.col("_first")).alias("_i"),
            F.lit(n_rows).alias("_rows"), F.lit(n_cols).alias("_cols"))
        grid = L.grid_from_layout(indexed, "_i", "_rows", "_cols", layout).select(
            "well_name", "site", "grid_y", "grid_x")
        planes = fields.join(grid, ["well_name", "site"])
    else:
        raise ValueError("neither stage positions nor an acquisition layout is given")
    planes = L.update_indices(planes, ["tpoint", "channel", "zplane"])
    return group_stacks(planes) if stack else planes
