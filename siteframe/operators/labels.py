"""Connected components, relabelling and label-image operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siteframe.core import cut_lineage, dense_index, discard, image_keys, running_index
from siteframe.operators import stencil as ST
from siteframe.operators import tree as TR
from siteframe.operators.distance import nearest_marked

STRIDE = 1 << 20  # larger than any image side


def _runs(mask: DataFrame) -> DataFrame:
    """Horizontal runs of set pixels. A run is numbered by its first pixel, so
    numbers follow the reading order of the image."""
    keys = image_keys(mask)
    line = Window.partitionBy(*keys, "y").orderBy("x")
    gap = F.coalesce(F.col("x") - F.lag("x").over(line) > 1, F.lit(True))
    start = F.last(F.when(gap, F.col("x")), ignorenulls=True).over(
        line.rowsBetween(Window.unboundedPreceding, 0))
    return (mask.filter("mask").select(*keys, "y", "x").withColumn("x0", start)
            .groupBy(*keys, "y", "x0").agg(F.max("x").alias("x1"))
            .withColumn("run", F.col("y").cast("long") * STRIDE + F.col("x0")))


def _touching(runs: DataFrame, neighbours: int) -> DataFrame:
    """Pairs of touching runs in adjacent lines.

    The runs of a line and of the line above it are swept in the order of their
    first pixel. Runs of one line do not touch, so of two touching runs the later
    one always finds the other as the last run of the other line: one window over
    runs gives all pairs, no run is compared with more than one other.
    """
    keys = image_keys(runs)
    if neighbours not in (4, 8):
        raise ValueError("neighbours must be 4 or 8")
    slack = 1 if neighbours == 8 else 0
    both = runs.withColumn("_upper", F.explode(F.array(F.lit(False), F.lit(True)))).withColumn(
        "y", F.when(F.col("_upper"), F.col("y") + 1).otherwise(F.col("y")))
    sweep = Window.partitionBy(*keys, "y").orderBy("x0", "_upper").rowsBetween(Window.unboundedPreceding, 0)
    last = {side: F.last(F.when(F.col("_upper") == side, F.struct("run", "x1")), ignorenulls=True).over(sweep)
            for side in (True, False)}
    other = F.when(F.col("_upper"), last[False]).otherwise(last[True])
    return (both.withColumn("_o", other).filter(F.col("_o.x1") + slack >= F.col("x0"))
            .select(*keys, F.col("run").alias("a"), F.col("_o.run").alias("b")))


def propagate_labels(nodes: DataFrame, edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Smallest node number of each connected component of a graph.

    In a round every node points at its smallest neighbour, if that is smaller, and chains of pointers are followed to
    their ends. Nodes with the same end are merged, and only edges between different ones go on, once each. What hangs
    together from top to bottom is one node after the first round; the graph shrinks fast.
    """
    keys = list(keys)
    found = nodes.select(*keys, F.col("run").alias("node"), F.col("run").alias("label"))
    rest = cut_lineage(edges.select(*keys, "a", "b"))
    moves = []
    while not rest.isEmpty():
        ends = rest.unionByName(rest.select(*keys, F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = ends.groupBy(*keys, F.col("a").alias("node")).agg(F.min("b").alias("_m")).select(*keys, "node", F.least("node", "_m").alias("to"))
        roots = TR.follow(cut_lineage(lowest), keys)
        moves.append(roots)
        at = lambda name: roots.select(*keys, F.col("node").alias(name), F.col("root").alias(f"_{name}"))  # noqa: E731, B023
        moved = rest.join(at("a"), [*keys, "a"]).join(at("b"), [*keys, "b"]).filter("_a <> _b")
        rest = cut_lineage(moved.select(*keys, F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct(), rest)
    discard(rest)
    for roots in moves:
        found = found.join(roots.withColumnRenamed("node", "label"), [*keys, "label"], "left").select(*keys, "node", F.coalesce("root", "label").alias("label"))
    return cut_lineage(found)


def connected_components(mask: DataFrame, neighbours: int = 8) -> DataFrame:
    """Label image with labels 1.. in reading order of the first pixel.

    Pixels are reduced to runs, runs to a graph; only the graph is iterated over.
    """
    keys = image_keys(mask)
    runs = cut_lineage(_runs(mask))
    roots = propagate_labels(runs.select(*keys, "run"), _touching(runs, neighbours), keys)
    # A component is numbered by its smallest run: order in the image = label order.
    firsts = roots.select(*keys, F.col("label").alias("root")).distinct()
    numbered = running_index(firsts, keys, "root", "_i", width=STRIDE * 64)
    named = roots.join(numbered.select(*keys, F.col("root").alias("label"), "_i"), [*keys, "label"])
    return (runs.join(named.select(*keys, F.col("node").alias("run"), "_i"), [*keys, "run"])
            .select(*keys, "y", F.explode(F.sequence("x0", "x1")).alias("x"), (F.col("_i") + 1).cast("int").alias("label")))


def relabel(labels: DataFrame) -> DataFrame:
    """Number the labels of each image from one without gaps, keeping their order."""
    keys = image_keys(labels)
    fg = labels.filter("label > 0")
    return (dense_index(fg, keys, "label", "_i")
            .withColumn("label", (F.col("_i") + 1).cast("int")).drop("_i").select(*labels.columns))


def register_objects(image: DataFrame, neighbours: int = 8) -> DataFrame:
    """Objects from a mask (its components) or from a label image as it is."""
    return connected_components(image, neighbours) if "mask" in image.columns else image.filter("label > 0")


def label_gaps(labels: DataFrame) -> DataFrame:
    """Images whose labels are not 1..n."""
    return (labels.groupBy(*image_keys(labels)).agg(F.countDistinct("label").alias("n"), F.max("label").alias("last"))
            .filter("n <> last"))


def check_assignment(labels: DataFrame, reference: DataFrame, aggregate: bool) -> DataFrame:
    """Objects that cannot be assigned: partly outside any reference object, or,
    without aggregation, overlapping an object of another label."""
    keys = image_keys(labels)
    joined = labels.join(reference.withColumnRenamed("label", "_ref"), [*keys, "y", "x"], "left")
    wrong = F.col("_ref").isNull() if aggregate else F.coalesce(F.col("_ref") != F.col("label"), F.lit(True))
    return joined.filter(wrong).select(*keys, "label").distinct()


def filter_objects(labels: DataFrame, values: DataFrame, feature: str, lower=None, upper=None) -> DataFrame:
    """Keep objects whose feature lies within inclusive bounds and relabel."""
    kept = values
    if lower is not None:
        kept = kept.filter(F.col(feature) >= lower)
    if upper is not None:
        kept = kept.filter(F.col(feature) <= upper)
    return relabel(labels.join(kept.select(*image_keys(labels), "label"), [*image_keys(labels), "label"], "left_semi"))


def select_clumps(values: DataFrame, min_area: float, max_area: float, max_circularity: float,
                  max_convexity: float) -> DataFrame:
    return values.filter((F.col("area") > min_area) & (F.col("area") <= max_area)
                         & (F.col("convexity") <= max_convexity) & (F.col("circularity") <= max_circularity))


def clump_classes(values: DataFrame, min_area: float, max_area: float, max_convexity: float,
                  max_form: float) -> DataFrame:
    """Objects sorted into single objects, clumps to separate and the rest by area,
    convexity and the logarithm of the form factor."""
    factor = 4 * F.lit(3.141592653589793) * F.col("area") / ((F.col("perimeter") + 1) * (F.col("perimeter") + 1))
    form = F.greatest(-F.ln(factor), F.lit(0.0))
    solid = F.col("convexity")
    selected = (F.col("area") > min_area) & (F.col("area") < max_area) & (solid < max_convexity) & (form > max_form)
    single = (solid > max_convexity) & (form < max_form)
    return values.withColumns({"log_form_factor": form, "clump_class": F.when(selected, "clump").when(
        single, "object").otherwise("rest")})


def remove_small(labels: DataFrame, area: int) -> DataFrame:
    """Drop objects with fewer pixels than `area`."""
    keys = [*image_keys(labels), "label"]
    kept = labels.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= area)
    return labels.join(kept.drop("_n"), keys, "left_semi")


def border_labels(labels: DataFrame, height: int, width: int) -> DataFrame:
    """Labels that occur in the outermost pixels of their image."""
    edge = (F.col("y").isin(0, height - 1)) | (F.col("x").isin(0, width - 1))
    return labels.filter(edge).select(*image_keys(labels), "label").distinct()


def label_border_flags(labels: DataFrame, height: int, width: int) -> DataFrame:
    edge = (F.col("y").isin(0, height - 1)) | (F.col("x").isin(0, width - 1))
    return labels.groupBy(*image_keys(labels), "label").agg(F.max(edge).alias("is_border"))


def object_perimeter(labels: DataFrame, neighbours: int = 4, edge: bool = True) -> DataFrame:
    """Pixels of each object next to another label, to background or, with `edge`,
    to a place without a row; only the lines around a pixel are compared."""
    keys = image_keys(labels)
    hood = ST.neighbourhood(labels, 1, F.col("label"), sparse=neighbours == 8)
    offsets = [(-1, 0), (1, 0), (0, -1), (0, 1)]
    if neighbours == 8:
        offsets += [(-1, -1), (-1, 1), (1, -1), (1, 1)]
    same = F.lit(True)
    for dy, dx in offsets:
        same = same & F.coalesce(ST.cell("hood", 1, dy, dx) == F.col("label"), F.lit(not edge))
    return hood.filter(~same).select(*keys, "y", "x", "label")


def expand_objects(labels: DataFrame, n: int, height: int, width: int) -> DataFrame:
    """Grow objects over background nearer than `n` pixels; the nearest object
    wins, the smaller label among equally near ones.

    Rim pixels offer their column distance to the places above and below them, and the best offer of a place goes on along its
    line: two short passes in place of all pixels of a disk, and only places near objects are looked at.
    """
    keys = image_keys(labels)
    pixel = [*keys, "y", "x"]
    steps = F.sequence(F.lit(1 - n), F.lit(n - 1))
    nearest = lambda t: t.groupBy(*pixel).agg(F.min(F.struct("d", "label")).alias("_o")).select(*pixel, "_o.d", "_o.label")
    rim = object_perimeter(labels).withColumn("_s", F.explode(steps)).select(
        *keys, (F.col("y") + F.col("_s")).alias("y"), "x", (F.col("_s") * F.col("_s")).alias("d"), "label")
    columns = nearest(rim.filter(F.col("y").between(0, height - 1))).withColumn("_s", F.explode(steps)).select(
        *keys, "y", (F.col("x") + F.col("_s")).alias("x"), (F.col("d") + F.col("_s") * F.col("_s")).alias("d"), "label")
    grown = nearest(columns.filter((F.col("d") < n * n) & F.col("x").between(0, width - 1)))
    own = labels.select(*pixel, "label")
    return own.unionByName(grown.select(*pixel, "label").join(own.select(*pixel), pixel, "left_anti"))


def shrink_objects(labels: DataFrame, n: int, grid: DataFrame) -> DataFrame:
    """Keep object pixels farther than `n` from background; `grid` has every pixel."""
    keys = image_keys(labels)
    full = grid.select(*keys, "y", "x").join(labels, [*keys, "y", "x"], "left")
    marked = full.withColumns({"_bg": F.col("label").isNull(), "_p": F.lit(0)})
    far = nearest_marked(marked, "_bg", "_p").filter(F.coalesce(
        F.nullif(F.col("distance2"), F.lit(float("nan"))), F.lit(1e18)) > n * n)
    return labels.join(far.select(*keys, "y", "x"), [*keys, "y", "x"], "left_semi")


def expand_or_shrink(labels: DataFrame, n: int, grid: DataFrame, height: int, width: int) -> DataFrame:
    if n == 0:
        return labels
    return expand_objects(labels, n, height, width) if n > 0 else shrink_objects(labels, -n, grid)


def fill_holes(mask: DataFrame) -> DataFrame:
    """Set background regions that do not reach the image border."""
    keys = image_keys(mask)
    size = ST.image_extent(mask)
    holes = connected_components(mask.withColumn("mask", ~F.col("mask")), 4)
    sized = holes.join(size, keys)
    outer = sized.filter("y = 0 OR x = 0 OR y = _h - 1 OR x = _w - 1").select(*keys, "label").distinct()
    inner = holes.join(outer, [*keys, "label"], "left_anti").select(*keys, "y", "x", F.lit(True).alias("_hole"))
    return (mask.join(inner, [*keys, "y", "x"], "left")
            .withColumn("mask", F.col("mask") | F.coalesce("_hole", F.lit(False))).drop("_hole"))


#: Pixels of a line that are looked at together.
STRETCH = 32


def neighbour_pairs(labels: DataFrame, distance: int) -> DataFrame:
    """Pairs of objects with pixels not farther apart than `distance`.

    A rim pixel reaches one interval of each line around it. Intervals of an object that
    overlap on a line are merged; what is left meets the rim pixels of other objects on the same
    stretch of the line, so that rows grow with the distance and not with its square.
    """
    keys = image_keys(labels)
    rim = object_perimeter(labels)
    around = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(int((distance * distance - dy * dy) ** 0.5)).alias("r"))
                       for dy in range(-distance, distance + 1)])
    line = [*keys, "label", "y"]
    reach = rim.withColumn("_o", F.explode(around)).select(
        *keys, "label", (F.col("y") + F.col("_o.dy")).alias("y"), (F.col("x") - F.col("_o.r")).alias("x0"), (F.col("x") + F.col("_o.r")).alias("x1"))
    ordered = Window.partitionBy(*line).orderBy("x0", "x1")
    so_far = F.max("x1").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    opened = reach.withColumn("_new", F.coalesce((F.col("x0") > so_far + 1).cast("int"), F.lit(1)))
    merged = (opened.withColumn("_i", F.sum("_new").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
              .groupBy(*line, "_i").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1")))
    stretch = merged.select(*keys, F.col("label").alias("source"), "y", "x0", "x1", F.explode(F.sequence(
        F.floor(F.col("x0") / STRETCH).cast("int"), F.floor(F.col("x1") / STRETCH).cast("int"))).alias("_s"))
    placed = rim.withColumn("_s", F.floor(F.col("x") / STRETCH).cast("int"))
    return (stretch.join(placed, [*keys, "y", "_s"]).filter((F.col("source") != F.col("label")) & F.col("x").between(F.col("x0"), F.col("x1")))
            .select(*keys, F.col("source").alias("label"), F.col("label").alias("neighbour")).distinct())


def measure_neighbours(labels: DataFrame, distance: int, touching: int) -> DataFrame:
    """Number and list of neighbours, and the share of perimeter pixels that lie
    within `touching` of a neighbour grown by one pixel."""
    keys = image_keys(labels)
    pairs = cut_lineage(neighbour_pairs(labels, distance))
    listed = pairs.groupBy(*keys, "label").agg(
        F.count(F.lit(1)).alias("count"), F.array_join(F.transform(F.array_sort(F.collect_list("neighbour")),
                                                                   lambda v: v.cast("string")), ".").alias("list"))
    # Grown neighbours are the four places next to their pixels.
    arms = [(0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)]
    reach = sorted({(dy + ay, dx + ax) for ay, ax in arms for dy in range(-touching, touching + 1)
                    for dx in range(-touching, touching + 1) if dy * dy + dx * dx <= touching * touching})
    zero = set(arms)
    offers = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"), F.lit((dy, dx) in zero).alias("on"))
                       for dy, dx in reach])
    rim = cut_lineage(object_perimeter(labels))
    offered = (rim.withColumn("_o", F.explode(offers))
               .select(*keys, (F.col("y") + F.col("_o.dy")).alias("y"), (F.col("x") + F.col("_o.dx")).alias("x"),
                       F.col("label").alias("neighbour"), F.col("_o.on").alias("on"))
               .groupBy(*keys, "y", "x", "neighbour").agg(F.max("on").alias("on")))
    near = (rim.join(offered, [*keys, "y", "x"]).join(pairs, [*keys, "label", "neighbour"])
            .groupBy(*keys, "label", "y", "x").agg(F.max("on").alias("on")))
    # A perimeter pixel on a grown neighbour has distance zero and is not counted.
    touched = near.groupBy(*keys, "label").agg(F.count(F.when(~F.col("on"), 1)).alias("_t"))
    total = rim.groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("_n"))
    return (total.join(listed, [*keys, "label"], "left").join(touched, [*keys, "label"], "left")
            .select(*keys, "label", F.coalesce("count", F.lit(0)).alias("count"),
                    F.coalesce("list", F.lit(".")).alias("neighbours"),
                    (F.coalesce("_t", F.lit(0)) / F.col("_n")).alias("fraction_touching")))
