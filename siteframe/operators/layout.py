"""Plate, well and site layout, index assignment and pyramid geometry."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteframe.config import ExperimentConfig
from siteframe.core import small_dense_values
from siteframe.functions.geometry import rectangle, tile_box


# --- indices --------------------------------------------------------------------

def update_indices(planes: DataFrame, columns: Sequence[str] = ("channel_name", "tpoint", "zplane")) -> DataFrame:
    """Zero-based dense index of channel, time point and z plane."""
    out = planes
    for c in columns:
        out = out.join(small_dense_values(planes, [], c, f"{c}_index"), c)
    return out


def assign_site_indices(planes: DataFrame, order: str) -> DataFrame:
    """Index of each acquisition site in the order of its first row."""
    first = planes.groupBy("well_name", "grid_y", "grid_x").agg(F.min(order).alias("_first"))
    # One row per site of a plate remains to be ordered.
    ranked = first.withColumn("site_index", F.row_number().over(Window.partitionBy("well_name").orderBy("_first")) - 1)
    return planes.join(ranked.drop("_first"), ["well_name", "grid_y", "grid_x"])


def nonempty_ranks(wells: DataFrame) -> DataFrame:
    """Position of each well among the rows and columns in use on its plate."""
    return (wells.join(small_dense_values(wells, ["plate_id"], "well_y", "row_rank"), ["plate_id", "well_y"])
            .join(small_dense_values(wells, ["plate_id"], "well_x", "col_rank"), ["plate_id", "well_x"]))


def nonempty_rows_cols(wells: DataFrame) -> DataFrame:
    return wells.groupBy("plate_id").agg(F.countDistinct("well_y").alias("n_rows"),
                                         F.countDistinct("well_x").alias("n_cols"))


def layout_coordinate(index, n_rows, n_cols, layout: str) -> tuple[Column, Column]:
    """Grid row and column of the site acquired at `index`."""
    if layout not in ("horizontal", "zigzag_horizontal", "vertical", "zigzag_vertical"):
        raise ValueError(f"unknown layout: {layout}")
    i, rows, cols = F.col(index), F.col(n_rows), F.col(n_cols)
    if "horizontal" in layout:
        major, minor, size = F.floor(i / cols).cast("int"), F.pmod(i, cols).cast("int"), cols
    else:
        major, minor, size = F.floor(i / rows).cast("int"), F.pmod(i, rows).cast("int"), rows
    if "zigzag" in layout:
        minor = F.when(major % 2 == 1, size - 1 - minor).otherwise(minor).cast("int")
    return (major, minor) if "horizontal" in layout else (minor, major)


def grid_from_layout(sites: DataFrame, index: str, n_rows: str, n_cols: str, layout: str) -> DataFrame:
    y, x = layout_coordinate(index, n_rows, n_cols, layout)
    return sites.withColumns({"grid_y": y, "grid_x": x})


def guess_grid(n, axis: str = "vertical") -> Column:
    """Rows and columns of a mosaic that fits `n` sites with the least empty
    places, square if possible, the longer side along `axis`."""
    if axis not in ("vertical", "horizontal"):
        raise ValueError('axis must be "vertical" or "horizontal"')
    n = F.col(n) if isinstance(n, str) else n
    limit = F.when(n < 4, 4).otherwise(2 * F.floor(F.sqrt(n.cast("double"))).cast("int"))
    pairs = F.transform(F.sequence(F.lit(1), limit), lambda a: F.struct(
        a.alias("a"), F.greatest(a, F.ceil(n / a).cast("int")).alias("b")))
    fitting = F.filter(pairs, lambda p: p["b"] <= limit)
    best = F.array_min(F.transform(fitting, lambda p: F.struct(
        (p["a"] * p["b"]).alias("area"), (p["a"] != p["b"]).alias("oblong"),
        p["a"].alias("short"), p["b"].alias("long"))))
    first, second = ("long", "short") if axis == "vertical" else ("short", "long")
    return F.struct(best[first].alias("n_rows"), best[second].alias("n_cols"))


def grid_from_positions(planes: DataFrame, tolerance: float = 1.0, reverse_rows: bool = False,
                        reverse_columns: bool = False, group: str = "well_name") -> DataFrame:
    """Grid coordinates from stage positions. Positions of a well that lie within
    `tolerance` of their neighbour in order share a row or column."""
    out = planes
    for axis, name, reverse in (("stage_y", "grid_y", reverse_rows), ("stage_x", "grid_x", reverse_columns)):
        order = Window.partitionBy(group).orderBy(F.desc(axis) if reverse else F.asc(axis))
        distinct = planes.select(group, axis).distinct()
        step = F.abs(F.col(axis) - F.lag(axis).over(order)) > tolerance
        index = (distinct.withColumn("_step", F.coalesce(step.cast("int"), F.lit(0)))
                 .withColumn(name, F.sum("_step").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
                 .drop("_step"))
        out = out.join(index, [group, axis])
    return out


def detect_layout(sites: DataFrame, group: str = "well_name", index: str = "site_index") -> DataFrame:
    """Grid size and acquisition order of each well from stage positions."""
    dims = sites.groupBy(group).agg(F.countDistinct("stage_y").alias("n_rows"),
                                    F.countDistinct("stage_x").alias("n_cols"))
    joined = sites.join(dims, group)

    def at(axis, position):
        return F.max(F.when(F.col(index) == position, F.col(axis)))

    rows, cols = F.col("n_rows"), F.col("n_cols")
    # Horizontal acquisition fills a row before it steps on, vertical acquisition a column.
    picked = joined.groupBy(group, "n_rows", "n_cols").agg(
        at("stage_y", F.lit(0)).alias("y0"), at("stage_x", F.lit(0)).alias("x0"),
        at("stage_y", F.lit(1)).alias("y1"), at("stage_x", F.lit(1)).alias("x1"),
        at("stage_x", cols - 1).alias("row_end"), at("stage_x", cols).alias("next_row"),
        at("stage_y", rows - 1).alias("column_end"), at("stage_y", rows).alias("next_column"))
    along_row = (F.col("y0") == F.col("y1")) & (cols > 1)
    along_column = (F.col("x0") == F.col("x1")) & (rows > 1)
    # The next line begins where the last one began, or where it ended.
    layout = (F.when(along_row & ((rows == 1) | (F.col("next_row") == F.col("x0"))), "horizontal")
              .when(along_row & (F.col("next_row") == F.col("row_end")), "zigzag_horizontal")
              .when(along_column & ((cols == 1) | (F.col("next_column") == F.col("y0"))), "vertical")
              .when(along_column & (F.col("next_column") == F.col("column_end")), "zigzag_vertical")
              .when((rows == 1) & (cols == 1), "horizontal"))
    out = picked.select(group, "n_rows", "n_cols", layout.alias("layout"))
    checked = F.when(F.col("layout").isNull(), F.raise_error(F.lit("the layout of a well cannot be told from its positions"))).otherwise(F.col("layout"))
    return out.withColumn("layout", checked)


def reindex_cycles(images: DataFrame, acquisitions: DataFrame, mode: str) -> DataFrame:
    """Count the time points of all acquisitions of a plate in creation order:
    as time points (``basic``) or as cycles (``multiplexing``)."""
    if mode not in ("basic", "multiplexing"):
        raise ValueError(f"unknown mode: {mode}")
    joined = images.join(acquisitions, "acquisition_id")
    order = Window.partitionBy("plate_id").orderBy("created_at", "acquisition_id", "tpoint")
    ranks = (joined.select("plate_id", "created_at", "acquisition_id", "tpoint").distinct()
             .withColumn("_rank", F.row_number().over(order) - 1).drop("created_at"))
    ranked = joined.join(ranks, ["plate_id", "acquisition_id", "tpoint"])
    if mode == "basic":
        return ranked.withColumns({"new_tpoint": F.col("_rank"), "cycle": F.lit(0),
                                   "channel": F.col("wavelength")}).drop("_rank")
    return ranked.withColumns({"new_tpoint": F.lit(0), "cycle": F.col("_rank"), "channel": F.concat_ws(
        "_", F.col("_rank").cast("string"), "wavelength")}).drop("_rank")


# --- sizes and offsets -------------------------------------------------------------

def plate_grid(plates: DataFrame) -> DataFrame:
    """Place of each plate on the map; plates fill the grid column by column."""
    total = plates.agg(F.count(F.lit(1)).cast("int").alias("_n")).withColumn("_g", guess_grid("_n"))
    ranked = plates.withColumn("_i", F.row_number().over(Window.orderBy("plate_id")) - 1)
    return (ranked.join(F.broadcast(total)).withColumns({
        "plate_grid_y": F.expr("CAST(_i % _g.n_rows AS INT)"),
        "plate_grid_x": F.expr("CAST(_i DIV _g.n_rows AS INT)"),
        "grid_rows": F.col("_g.n_rows"), "grid_cols": F.col("_g.n_cols")}).drop("_i", "_n", "_g"))


def plate_layout(sites: DataFrame, wells: DataFrame, plates: DataFrame, cfg: ExperimentConfig) -> DataFrame:
    """Size of wells and plate and offset of the plate, one row per plate. All wells
    of a plate take the size of its largest well."""
    v, h, s = cfg.vertical_site_displacement, cfg.horizontal_site_displacement, cfg.well_spacer_size
    well_size = (sites.groupBy("well_id").agg(
        (F.max("site_y") + 1).alias("_r"), (F.max("site_x") + 1).alias("_c"),
        F.max("height").alias("_h"), F.max("width").alias("_w"))
        .select("well_id", (F.col("_r") * F.col("_h") + v * (F.col("_r") - 1)).alias("_wh"),
                (F.col("_c") * F.col("_w") + h * (F.col("_c") - 1)).alias("_ww")))
    sizes = (wells.join(well_size, "well_id").groupBy("plate_id")
             .agg(F.max("_wh").alias("well_height"), F.max("_ww").alias("well_width")))
    out = plate_grid(plates).join(nonempty_rows_cols(wells), "plate_id").join(sizes, "plate_id")
    out = out.withColumns({
        "plate_height": F.expr(f"n_rows * well_height + {s} * (n_rows - 1)"),
        "plate_width": F.expr(f"n_cols * well_width + {s} * (n_cols - 1)")})
    gap = cfg.plate_spacer_size
    return out.withColumns({
        "plate_offset_y": F.expr(f"plate_grid_y * (plate_height + {gap})"),
        "plate_offset_x": F.expr(f"plate_grid_x * (plate_width + {gap})")})


def pyramid_size(layout: DataFrame, cfg: ExperimentConfig) -> DataFrame:
    """Pixels of the whole map at full resolution."""
    gap = cfg.plate_spacer_size
    return layout.agg(
        F.expr(f"max(plate_height) * max(grid_rows) + (max(grid_rows) - 1) * {gap}").alias("height"),
        F.expr(f"max(plate_width) * max(grid_cols) + (max(grid_cols) - 1) * {gap}").alias("width"))


def well_offsets(wells: DataFrame, layout: DataFrame, cfg: ExperimentConfig) -> DataFrame:
    s = cfg.well_spacer_size
    return (nonempty_ranks(wells).join(layout, "plate_id").withColumns({
        "well_offset_y": F.expr(f"row_rank * (well_height + {s}) + plate_offset_y"),
        "well_offset_x": F.expr(f"col_rank * (well_width + {s}) + plate_offset_x")}))


def site_offsets(sites: DataFrame, wells: DataFrame, plates: DataFrame, cfg: ExperimentConfig) -> DataFrame:
    """Map position of each site before and after alignment between cycles."""
    v, h = cfg.vertical_site_displacement, cfg.horizontal_site_displacement
    placed = sites.join(well_offsets(wells, plate_layout(sites, wells, plates, cfg), cfg), "well_id")
    placed = placed.withColumns({
        "offset_y": F.expr(f"site_y * (height + {v}) + well_offset_y").cast("long"),
        "offset_x": F.expr(f"site_x * (width + {h}) + well_offset_x").cast("long")})
    return placed.withColumns({
        "aligned_offset_y": F.col("offset_y") + F.col("top_residue"),
        "aligned_offset_x": F.col("offset_x") + F.col("left_residue"),
        "aligned_height": F.expr("height - (top_residue + bottom_residue)"),
        "aligned_width": F.expr("width - (right_residue + left_residue)")})


def static_objects(df: DataFrame, key: str, offset_y: str, offset_x: str, height: str, width: str) -> DataFrame:
    """Outline of plates, wells or sites one pixel inside their extent, y upwards."""
    y0, x0 = -(F.col(offset_y) + 1), F.col(offset_x) + 1
    y1, x1 = y0 - (F.col(height) - 3), x0 + (F.col(width) - 3)
    return df.select(F.col(key), rectangle(x0, y0, x1, y1).alias("polygon"),
                     *[c.cast("long").alias(n) for n, c in (("x0", x0), ("y0", y1), ("x1", x1), ("y1", y0))])


# --- tiles --------------------------------------------------------------------------

def pyramid_levels(layers: DataFrame, cfg: ExperimentConfig) -> DataFrame:
    """Zoom levels of each layer, level 0 being the coarsest; there are at least two."""
    f, t = cfg.zoom_factor, cfg.tile_size
    shrinks = F.expr(f"""element_at(filter(sequence(1, 40), k -> ceil(height / power({f}, k)) <= {t}
        AND ceil(width / power({f}, k)) <= {t}), 1)""")
    out = layers.withColumn("_k", shrinks).withColumn("z", F.explode(F.sequence(F.lit(0), F.col("_k"))))
    out = out.withColumns({"level_height": F.expr(f"CAST(ceil(height / power({f}, _k - z)) AS BIGINT)"),
                           "level_width": F.expr(f"CAST(ceil(width / power({f}, _k - z)) AS BIGINT)")})
    return out.withColumns({"n_rows": F.expr(f"CAST(ceil(level_height / {t}) AS BIGINT)"),
                            "n_cols": F.expr(f"CAST(ceil(level_width / {t}) AS BIGINT)"),
                            "n_levels": F.col("_k") + 1}).drop("_k")


def map_sites_to_tiles(sites: DataFrame, cfg: ExperimentConfig) -> DataFrame:
    """Base tiles each site reaches, with the tile's offset inside the site."""
    t = cfg.tile_size

    def span(offset, size, gap):
        return F.expr(f"sequence({offset} DIV {t}, CAST(ceil(({offset} + {size} - {gap}) / {t}) AS BIGINT) - 1)")

    out = sites.withColumn("tile_y", F.explode(span("offset_y", "height", cfg.vertical_site_displacement)))
    out = out.withColumn("tile_x", F.explode(span("offset_x", "width", cfg.horizontal_site_displacement)))
    return out.withColumns({"in_site_y": F.expr(f"tile_y * {t} - offset_y"),
                            "in_site_x": F.expr(f"tile_x * {t} - offset_x")})


def empty_tiles(base_level: DataFrame, covered: DataFrame) -> DataFrame:
    """Tiles of the base grid that no site reaches."""
    rows = base_level.withColumn("tile_y", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_rows") - 1)))
    grid = rows.withColumn("tile_x", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_cols") - 1)))
    return grid.select("tile_y", "tile_x").join(covered.select("tile_y", "tile_x").distinct(),
                                                ["tile_y", "tile_x"], "left_anti")


def child_tiles(tiles: DataFrame, levels: DataFrame, factor: int = 2) -> DataFrame:
    """Tiles of the next finer level that make up each tile."""
    finer = levels.select((F.col("z") - 1).cast("int").alias("z"), F.col("n_rows").alias("_rows"),
                          F.col("n_cols").alias("_cols"))
    out = tiles.join(F.broadcast(finer), "z")
    for c in "yx":
        out = out.withColumn(f"child_{c}", F.explode(F.expr(f"sequence({c} * {factor}, {c} * {factor} + {factor - 1})")))
    return out.filter("child_y < _rows AND child_x < _cols").drop("_rows", "_cols")


def tile_bounding_boxes(tiles: DataFrame, maxzoom: str) -> DataFrame:
    return tiles.withColumn("_b", tile_box("z", "y", "x", maxzoom)).select("*", "_b.*").drop("_b")
