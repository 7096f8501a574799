"""Queries over pixel tables.

Most results are given per image line (sum and position-weighted sum of the
pixels of each line), which fixes every pixel and keeps results short.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteframe.catalog import query
from siteframe.functions.scalars import scale_to_byte
from siteframe.operators import aggregates as A
from siteframe.operators import pixels as P
from siteframe.operators import stencil as ST


def lines(px: DataFrame, value: str = "value", digits: int | None = None) -> DataFrame:
    v = F.col(value).cast("int") if digits is None else F.col(value)
    total, weighted = F.sum(v), F.sum(v * F.col("x"))
    if digits is not None:
        total, weighted = F.round(total, digits), F.round(weighted, digits)
    return px.groupBy("site_id", "y").agg(F.count(F.lit(1)).alias("n"), total.alias("total"),
                                          weighted.alias("weighted"))


def sql_lines(source: str, value: str = "value", digits: int | None = None) -> str:
    if digits is None:
        total, weighted = f"CAST(sum(CAST({value} AS INTEGER)) AS BIGINT)", f"CAST(sum(CAST({value} AS INTEGER) * x) AS BIGINT)"
    else:
        total, weighted = f"round(sum({value}), {digits})", f"round(sum({value} * x), {digits})"
    return f"SELECT site_id, CAST(y AS INTEGER) AS y, count(*) AS n, {total} AS total, {weighted} AS weighted FROM {source} GROUP BY 1, 2"


# SQL twin of a square neighbourhood with mirrored borders: every offset is one row.
def mirrored(radius: int, source: str = "d_pixels") -> str:
    def index(axis, d):
        return (f"CASE WHEN a.{axis} + {d} < 0 THEN -(a.{axis} + {d}) - 1 WHEN a.{axis} + {d} > 63 "
                f"THEN 127 - (a.{axis} + {d}) ELSE a.{axis} + {d} END")
    return f"""nb AS (SELECT a.site_id, a.y, a.x, dy, dx, b.value FROM {source} a,
      (SELECT unnest(generate_series({-radius}, {radius})) AS dy), (SELECT unnest(generate_series({-radius}, {radius})) AS dx)
      JOIN {source} b ON b.site_id = a.site_id AND b.y = {index('y', 'dy')} AND b.x = {index('x', 'dx')})"""


# --- reading ----------------------------------------------------------------------

@query("extract_planes", """WITH f AS (SELECT site_id, y, x, value FROM d_pixels UNION ALL SELECT site_id, y, x, value FROM d_pixels2)
    """ + sql_lines("(SELECT site_id, y, x, max(value) AS value FROM f GROUP BY ALL)"))
def _(d):
    planes = d.pixels().selectExpr("concat('f', site_id) AS file", "0 AS plane", "y", "x", "value").unionByName(
        d.pixels2().selectExpr("concat('f', site_id) AS file", "1 AS plane", "y", "x", "value"))
    images = d.table("supplier").selectExpr("s_suppkey AS image_id", """transform(sequence(0, 1), p -> named_struct(
        'file', concat('f', s_suppkey), 'series', 0, 'plane', p)) AS file_map""")
    return lines(P.extract_planes(images, planes).withColumnRenamed("image_id", "site_id"))


def two_channels(d):
    return d.pixels().withColumn("channel_id", F.lit(0)).unionByName(d.pixels2().withColumn("channel_id", F.lit(1)))


_STATS = """st AS (SELECT y, x, avg(CASE WHEN value > 0 THEN log10(value) ELSE 0 END) AS m,
      stddev_samp(CASE WHEN value > 0 THEN log10(value) ELSE 0 END) AS s FROM d_pixels GROUP BY 1, 2),
    lv AS (SELECT avg(m) AS am, avg(s) AS sd FROM st),
    cor AS (SELECT site_id, p.y, p.x, CAST(floor(least(power(10.0, least(CASE WHEN s > 0 THEN
      ((CASE WHEN value = 0 THEN -10 ELSE log10(value) END) - m) / s ELSE 0 END * sd + am, 12)), 65535)) AS INTEGER) AS value
      FROM d_pixels p JOIN st ON p.y = st.y AND p.x = st.x, lv)"""

_RES = """r AS (SELECT site_id, greatest(0, max(y)) AS t, greatest(0, -min(y)) AS b, greatest(0, max(x)) AS l, greatest(0, -min(x)) AS r
      FROM d_shifts GROUP BY 1)"""


@query("load_channel_image", f"""WITH {_STATS}, {_RES},
    al AS (SELECT c.site_id, c.y + s.y - r.t AS y, c.x + s.x - r.l AS x, c.value FROM cor c JOIN d_shifts s ON c.site_id = s.site_id AND s.cycle_id = 1
      JOIN r ON r.site_id = c.site_id WHERE c.y + s.y >= t AND c.y + s.y < 64 - b AND c.x + s.x >= l AND c.x + s.x < 64 - r.r
      AND c.site_id IN (SELECT site_id FROM d_sites WHERE NOT omitted)) {sql_lines('al')}""")
def _(d):
    px = two_channels(d).withColumn("cycle_id", F.lit(1))
    stats = P.illumination_stats(px)
    out = P.load_channel_image(px, d.sites().filter("NOT omitted"), stats, d.shifts(), P.overlap(d.shifts()), True, channel_id=0)
    return lines(out)


@query("load_pipeline_input", f"""WITH {_RES}, bc AS (SELECT 0 AS channel_id, * FROM d_pixels UNION ALL SELECT 1, * FROM d_pixels2),
    al AS (SELECT c.site_id, c.y + s.y - r.t AS y, c.x + s.x - r.l AS x, c.value * 2 + channel_id AS value FROM bc c
      JOIN d_shifts s ON c.site_id = s.site_id AND s.cycle_id = 1
      JOIN r ON r.site_id = c.site_id WHERE c.y + s.y >= t AND c.y + s.y < 64 - b AND c.x + s.x >= l AND c.x + s.x < 64 - r.r)
    {sql_lines('al')}""")
def _(d):
    px = two_channels(d).withColumn("cycle_id", F.lit(1))
    out = P.load_pipeline_input(px, [0, 1], None, d.shifts(), P.overlap(d.shifts()))
    return lines(out.withColumn("value", F.col("value") * 2 + F.col("channel_id")))


@query("crop_images", sql_lines("(SELECT site_id, y - 10 AS y, x - 5 AS x, value FROM d_pixels WHERE y BETWEEN 10 AND 39 AND x BETWEEN 5 AND 54)"))
def _(d):
    return lines(P.crop(d.pixels(), 10, 30, 5, 50))


@query("pad_images", sql_lines("""(SELECT site_id, y + 2 AS y, x, value FROM d_pixels UNION ALL
    SELECT site_id, y - 62, x, 0 FROM d_pixels WHERE y >= 62 AND site_id % 2 >= 0
    UNION ALL SELECT site_id, y + 2, x + 3, 0 FROM d_pixels WHERE x >= 61
    UNION ALL SELECT site_id, y - 62, x + 3, 0 FROM d_pixels WHERE y >= 62 AND x >= 61)"""))
def _(d):
    return lines(P.pad(P.pad(d.pixels(), 2, "top"), 3, "right"))


# --- statistics ---------------------------------------------------------------------

@query("illumination_stats", """SELECT y, x, round(avg(CASE WHEN value > 0 THEN log10(value) ELSE 0 END), 9) AS mean,
    round(stddev_samp(CASE WHEN value > 0 THEN log10(value) ELSE 0 END), 9) AS std FROM d_pixels GROUP BY ALL""")
def _(d):
    return P.illumination_stats(d.pixels()).select("y", "x", F.round("mean", 9).alias("mean"), F.round("std", 9).alias("std"))


QS = [0.0, 0.001, 1.0, 25.0, 50.0, 75.0, 90.0, 99.0, 99.9, 100.0]


@query("illumination_percentiles", """WITH s AS (SELECT site_id, value, row_number() OVER w - 1 AS r, lead(value, 1, value) OVER w AS up,
      count(*) OVER (PARTITION BY site_id) - 1 AS last FROM d_pixels WINDOW w AS (PARTITION BY site_id ORDER BY value)),
    i AS (SELECT DISTINCT site_id, last FROM s), k AS (SELECT unnest(generate_series(0, 99999)) AS k),
    e AS (SELECT site_id, k, last * k // 99999 AS r, (last * k % 99999) / 99999::DOUBLE AS f FROM i, k)
    SELECT round(100 * k / 99999::DOUBLE, 3) AS q, CAST(floor(avg(value + (up - value) * f) + 1e-9) AS INTEGER) AS value FROM e JOIN s USING (site_id, r) GROUP BY k""")
def _(d):
    return P.illumination_percentiles(d.pixels())


@query("closest_percentile", """WITH p AS (SELECT s_suppkey % 10 AS channel_id, CAST(l_quantity * 2 AS DOUBLE) AS q, CAST(max(l_extendedprice) AS INTEGER) AS value
      FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2)
    SELECT channel_id, arg_min(value, (abs(q - 33.3), q)) AS value FROM p GROUP BY 1""")
def _(d):
    t = d.table("lineitem").groupBy((F.col("l_suppkey") % 10).alias("channel_id"), (F.col("l_quantity") * 2).alias("q")).agg(
        F.round(F.max("l_extendedprice")).cast("int").alias("value"))
    return A.closest_percentile(t, 33.3, ["channel_id"])


@query("correct_illumination", f"WITH {_STATS} {sql_lines('cor')}")
def _(d):
    px = d.pixels()
    return lines(P.correct_illumination(px, P.illumination_stats(px)))


@query("correct_selected_channels", f"WITH {_STATS}, b AS (SELECT * FROM cor UNION ALL SELECT * FROM d_pixels2) {sql_lines('b')}")
def _(d):
    px = two_channels(d)
    return lines(P.correct_selected(px, P.illumination_stats(px), [1]))


@query("smooth_illumination_stats", """WITH g AS (SELECT k, exp(-0.5 * k * k) / (SELECT sum(exp(-0.5 * k * k)) FROM (SELECT unnest(generate_series(-4, 4)) AS k)) AS w
      FROM (SELECT unnest(generate_series(-4, 4)) AS k)),
    st AS (SELECT y, x, avg(CASE WHEN value > 0 THEN log10(value) ELSE 0 END) AS m FROM d_pixels GROUP BY 1, 2),
    h AS (SELECT a.y, a.x, sum(b.m * w) AS m FROM st a, g JOIN st b ON b.y = a.y AND b.x = CASE WHEN a.x + k < 0 THEN -(a.x + k) - 1 WHEN a.x + k > 63 THEN 127 - a.x - k ELSE a.x + k END GROUP BY 1, 2),
    v AS (SELECT a.y, a.x, sum(b.m * w) AS m FROM st a, g JOIN h b ON b.x = a.x AND b.y = CASE WHEN a.y + k < 0 THEN -(a.y + k) - 1 WHEN a.y + k > 63 THEN 127 - a.y - k ELSE a.y + k END GROUP BY 1, 2)
    SELECT y, x, round(m, 8) AS mean FROM v""")
def _(d):
    stats = P.illumination_stats(d.pixels())
    return P.smooth_stats(stats, 1.0).select("y", "x", F.round("mean", 8).alias("mean"))


@query("layer_bounds", """WITH i AS (SELECT site_id, quantile_cont(value, [0.00001, 0.999]) AS p FROM d_pixels GROUP BY 1),
    b AS (SELECT CAST(floor(avg(p[1])) AS INTEGER) AS lo, CAST(floor(avg(p[2])) AS INTEGER) AS hi FROM i)
    SELECT lo AS min_intensity, greatest(hi, lo + 255) AS max_intensity FROM b""")
def _(d):
    return P.layer_bounds(P.illumination_percentiles(d.pixels(), QS), 99.9)


# --- registration ---------------------------------------------------------------------

def moved_pixels(d):
    """Second cycle: the first one moved by a known shift."""
    s = d.shifts().filter("cycle_id = 1").select("site_id", F.col("y").alias("sy"), F.col("x").alias("sx"))
    return d.pixels().join(s, "site_id").selectExpr(
        "site_id", "1 AS cycle_id", "y + sy AS y", "x + sx AS x", "value").filter("y BETWEEN 0 AND 63 AND x BETWEEN 0 AND 63")


@query("register_cycles", """SELECT s_suppkey AS site_id, CAST(2 - s_suppkey % 5 AS INTEGER) AS y, CAST(1 - s_suppkey % 3 AS INTEGER) AS x, 0.0::DOUBLE AS error FROM supplier""")
def _(d):
    return P.register(moved_pixels(d), d.pixels(), 2).drop("cycle_id")


@query("register_cycles_far", """SELECT s_suppkey AS site_id, CAST(2 - s_suppkey % 5 AS INTEGER) AS y, CAST(1 - s_suppkey % 3 AS INTEGER) AS x FROM supplier""")
def _(d):
    return P.register_coarse_to_fine(moved_pixels(d), d.pixels(), 20).select("site_id", "y", "x")


@query("clip_for_registration", f"""WITH b AS (SELECT CAST(floor(avg(p)) AS INTEGER) AS top FROM (SELECT site_id, quantile_cont(value, 0.9) AS p FROM d_pixels GROUP BY 1)),
    c AS (SELECT site_id, y, x, least(value, top) AS value FROM d_pixels, b) {sql_lines('c')}""")
def _(d):
    return lines(P.clip_for_registration(d.pixels(), P.illumination_percentiles(d.pixels(), QS), 90.0))


@query("overlap_residues", f"WITH {_RES} SELECT site_id, t AS top_residue, b AS bottom_residue, l AS left_residue, r AS right_residue FROM r")
def _(d):
    return P.overlap(d.shifts())


@query("align_crop", f"""WITH {_RES}, al AS (SELECT c.site_id, c.y + s.y - r.t AS y, c.x + s.x - r.l AS x, c.value FROM d_pixels c
      JOIN d_shifts s ON c.site_id = s.site_id AND s.cycle_id = 1 JOIN r ON r.site_id = c.site_id
      WHERE c.y + s.y >= t AND c.y + s.y < 64 - b AND c.x + s.x >= l AND c.x + s.x < 64 - r.r) {sql_lines('al')}""")
def _(d):
    return lines(P.align(d.pixels().withColumn("cycle_id", F.lit(1)), d.shifts(), P.overlap(d.shifts())))


@query("align_fill", f"""WITH {_RES}, al AS (SELECT g.site_id, g.y, g.x, CASE WHEN g.y >= t AND g.y < 64 - b AND g.x >= l AND g.x < 64 - r.r THEN c.value ELSE 0 END AS value
      FROM d_pixels g JOIN d_shifts s ON g.site_id = s.site_id AND s.cycle_id = 1 JOIN r ON r.site_id = g.site_id
      LEFT JOIN d_pixels c ON c.site_id = g.site_id AND c.y = g.y - s.y AND c.x = g.x - s.x) {sql_lines('al')}""")
def _(d):
    return lines(P.align(d.pixels().withColumn("cycle_id", F.lit(1)), d.shifts(), P.overlap(d.shifts()), crop=False))


# --- point operators ----------------------------------------------------------------

@query("clip_intensities", sql_lines("(SELECT site_id, y, x, greatest(least(value, 130), 20) AS value FROM d_pixels)"))
def _(d):
    return lines(P.clip(d.pixels(), 20, 130))


_S8 = "CASE WHEN value < 10 THEN 0 WHEN value >= 150 THEN 255 ELSE floor((value - 10) * 255 / 139) END"


@query("scale_to_8bit", sql_lines(f"(SELECT site_id, y, x, CAST({_S8} AS INTEGER) AS value FROM d_pixels)"))
def _(d):
    return lines(P.scale8(d.pixels(), 10, 150))


@query("rescale_to_8bit", """WITH b AS (SELECT site_id, CAST(floor(min(value)) AS INTEGER) AS lo, CAST(floor(quantile_cont(value, 0.99)) AS INTEGER) AS hi FROM d_pixels GROUP BY 1),
    c AS (SELECT site_id, y, x, CAST(CASE WHEN value < lo THEN 0 WHEN value >= hi THEN 255 ELSE floor((value - lo) * 255 / greatest(hi - lo - 1, 1)) END AS INTEGER) AS value
      FROM d_pixels JOIN b USING (site_id)) """ + sql_lines("c"))
def _(d):
    return lines(P.rescale_to_8bit(d.pixels(), 99.0))


@query("downsample_levels", """WITH b AS (SELECT site_id, min(value) AS lo, max(value) AS hi FROM d_pixels GROUP BY 1),
    c AS (SELECT site_id, y, x, floor((value - lo) * 15 / (hi - lo)) AS value FROM d_pixels JOIN b USING (site_id)) """ + sql_lines("c"))
def _(d):
    return lines(P.downsample_levels(d.pixels(), 16))


@query("invert_images", sql_lines("(SELECT site_id, y, x, 255 - value AS value FROM d_pixels)"))
def _(d):
    return lines(P.invert(d.pixels()))


@query("rescale_images", sql_lines("(SELECT site_id, y, x, least(floor(greatest(value - 30, 0) / 100.0::DOUBLE * 255), 255) AS value FROM d_pixels)"))
def _(d):
    return lines(P.rescale(d.pixels(), 30, 100))


@query("combine_channels", """WITH a AS (SELECT site_id, y, x, (value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w)::DOUBLE AS v FROM d_pixels WINDOW w AS (PARTITION BY site_id)),
    b AS (SELECT site_id, y, x, (value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w)::DOUBLE AS v FROM d_pixels2 WINDOW w AS (PARTITION BY site_id)),
    m AS (SELECT site_id, y, x, a.v * 2 + b.v * 1 AS v FROM a JOIN b USING (site_id, y, x)),
    c AS (SELECT site_id, y, x, floor((v - min(v) OVER w) * 255 / (max(v) OVER w - min(v) OVER w) + 1e-9) AS value FROM m WINDOW w AS (PARTITION BY site_id)) """ + sql_lines("c"))
def _(d):
    return lines(P.combine_channels(d.pixels(), d.pixels2(), 2, 1))


def two_masks(d):
    a = P.threshold_manual(d.pixels(), 60).drop("value")
    return a, P.threshold_manual(d.pixels2(), 100).drop("value")


for _op, _sql in (("AND", "a AND b"), ("OR", "a OR b"), ("EXCLUSIVE_OR", "a <> b")):
    def _masks(d, _op=_op):
        return lines(P.combine_masks(*two_masks(d), _op), "mask")
    query(f"combine_masks_{_op.lower()}", f"""WITH c AS (SELECT p.site_id, p.y, p.x, p.value > 60 AS a, q.value > 100 AS b FROM d_pixels p
        JOIN d_pixels2 q ON p.site_id = q.site_id AND p.y = q.y AND p.x = q.x),
        m AS (SELECT site_id, y, x, {_sql} AS value FROM c) {sql_lines('m')}""")(_masks)


@query("apply_mask", """WITH c AS (SELECT p.site_id, p.y, p.x, CASE WHEN q.value > 100 THEN p.value ELSE 0 END AS value FROM d_pixels p
    JOIN d_pixels2 q ON p.site_id = q.site_id AND p.y = q.y AND p.x = q.x) """ + sql_lines("c"))
def _(d):
    return lines(P.apply_mask(d.pixels(), two_masks(d)[1]))


@query("clip_mask", """WITH c AS (SELECT p.site_id, p.y, p.x, CASE WHEN q.value > 100 THEN 0 ELSE p.value END AS value FROM d_pixels p
    JOIN d_pixels2 q ON p.site_id = q.site_id AND p.y = q.y AND p.x = q.x) """ + sql_lines("c"))
def _(d):
    return lines(P.apply_mask(d.pixels(), two_masks(d)[1], inside=False))


@query("rescale_quantile", """WITH b AS (SELECT site_id, greatest(quantile_cont(value, 0.1), 8) AS lo, quantile_cont(value, 0.9) AS hi FROM d_pixels GROUP BY 1),
    c AS (SELECT site_id, y, x, (least(greatest(value, lo), hi) - lo) / (hi - lo) AS value FROM d_pixels JOIN b USING (site_id)) """ + sql_lines("c", digits=6))
def _(d):
    return lines(P.rescale_quantile(d.pixels(), 0.1, 0.9, (8, None)), digits=6)


# --- thresholds -----------------------------------------------------------------------

@query("threshold_manual", sql_lines("(SELECT site_id, y, x, value > 60 AS value FROM d_pixels)"))
def _(d):
    return lines(P.threshold_manual(d.pixels(), 60), "mask")


_OTSU = """h AS (SELECT site_id, value, count(*) AS n FROM d_pixels GROUP BY 1, 2),
    c AS (SELECT *, sum(n) OVER w AS nb, sum(value * n) OVER w AS sb, sum(n) OVER p AS nt, sum(value * n) OVER p AS st FROM h
      WINDOW w AS (PARTITION BY site_id ORDER BY value ROWS UNBOUNDED PRECEDING), p AS (PARTITION BY site_id)),
    lev AS (SELECT site_id, arg_min(value, (-coalesce(nb * (nt - nb) * (sb / nb - (st - sb) / nullif(nt - nb, 0)) ** 2, 0), value)) AS level FROM c GROUP BY 1)"""


@query("otsu_levels", f"WITH {_OTSU} SELECT * FROM lev")
def _(d):
    return P.otsu_levels(d.pixels())


@query("threshold_otsu", f"""WITH {_OTSU}, m AS (SELECT site_id, y, x, value > greatest(least(level * 1.2::DOUBLE, 200), 40) AS value FROM d_pixels JOIN lev USING (site_id)) {sql_lines('m')}""")
def _(d):
    return lines(P.threshold_otsu(d.pixels(), 1.2, 40, 200), "mask")


_8BIT = """b8 AS (SELECT site_id, CAST(floor(min(value)) AS INTEGER) AS lo, CAST(floor(quantile_cont(value, 0.9999)) AS INTEGER) AS hi FROM d_pixels GROUP BY 1),
    p8 AS (SELECT site_id, y, x, CAST(CASE WHEN value < lo THEN 0 WHEN value >= hi THEN 255 ELSE floor((value - lo) * 255 / greatest(hi - lo - 1, 1)) END AS INTEGER) AS value
      FROM d_pixels JOIN b8 USING (site_id))"""


@query("threshold_adaptive_niblack", f"""WITH {_8BIT}, {mirrored(2, 'p8')},
    s AS (SELECT site_id, y, x, sum(value) / count(*) AS m, sqrt(greatest(sum(value * value) / count(*) - (sum(value) / count(*)) ** 2, 0)) AS sd FROM nb GROUP BY 1, 2, 3),
    m AS (SELECT s.site_id, s.y, s.x, CASE WHEN p.value < 30 THEN false ELSE p8.value > m + 0.2::DOUBLE * sd END AS value
      FROM s JOIN p8 USING (site_id, y, x) JOIN d_pixels p USING (site_id, y, x)) {sql_lines('m')}""")
def _(d):
    return lines(P.threshold_adaptive(d.pixels(), "niblack", 5, 0.2, lower=30), "mask")


@query("threshold_adaptive_crosscorr", f"""WITH {_8BIT}, {mirrored(2, 'p8')}, g AS (SELECT k, exp(-k * k / (2 * 1.1::DOUBLE ** 2)) AS w FROM (SELECT unnest(generate_series(-2, 2)) AS k)),
    s AS (SELECT site_id, y, x, sum(value * gy.w * gx.w) / (SELECT sum(w) ** 2 FROM g) AS m FROM nb JOIN g gy ON gy.k = dy JOIN g gx ON gx.k = dx GROUP BY 1, 2, 3),
    m AS (SELECT site_id, y, x, p8.value > round(m) - 2 AS value FROM s JOIN p8 USING (site_id, y, x)) {sql_lines('m')}""")
def _(d):
    return lines(P.threshold_adaptive(d.pixels(), "crosscorr", 5, 2), "mask")


@query("threshold_bernsen", """WITH nb AS (SELECT a.site_id, a.y, a.x, a.value, b.value AS v FROM d_pixels a, (SELECT unnest(generate_series(-3, 3)) AS dy), (SELECT unnest(generate_series(-3, 3)) AS dx)
      JOIN d_pixels b ON b.site_id = a.site_id AND b.y = a.y + dy AND b.x = a.x + dx WHERE dy * dy + dx * dx <= 9),
    s AS (SELECT site_id, y, x, any_value(value) AS value, min(v) AS lo, max(v) AS hi FROM nb GROUP BY 1, 2, 3),
    m AS (SELECT site_id, y, x, CASE WHEN hi - lo < 60 THEN hi / 2.0 + lo / 2.0 > value ELSE hi / 2.0 + lo / 2.0 < 100 END AS value FROM s) """ + sql_lines("m"))
def _(d):
    return lines(P.threshold_bernsen(d.pixels(), 3, 60, 100), "mask")


@query("threshold_background", """SELECT site_id, CAST(arg_min(value, (-n, value)) * 2 AS DOUBLE) AS level FROM (SELECT site_id, value, count(*) AS n FROM d_pixels GROUP BY 1, 2) GROUP BY 1""")
def _(d):
    return P.threshold_global(d.pixels(), "Background")


@query("threshold_robust_background", """WITH b AS (SELECT site_id, quantile_cont(value, 0.05) AS lo, quantile_cont(value, 0.95) AS hi FROM d_pixels GROUP BY 1)
    SELECT site_id, round(avg(value) + 2 * stddev_pop(value), 6) AS level FROM d_pixels JOIN b USING (site_id) WHERE value BETWEEN lo AND hi GROUP BY 1""")
def _(d):
    return P.threshold_global(d.pixels(), "RobustBackground").withColumn("level", F.round("level", 6))


_RC = ["t0 AS (SELECT site_id, avg(value) AS t FROM d_pixels GROUP BY 1)"] + [
    f"""t{i} AS (SELECT site_id, coalesce((avg(value) FILTER (value <= t) + avg(value) FILTER (value > t)) / 2, any_value(t)) AS t
      FROM d_pixels JOIN t{i - 1} USING (site_id) GROUP BY 1)""" for i in range(1, 9)]


@query("threshold_ridler_calvard", f"WITH {', '.join(_RC)} SELECT site_id, round(t, 6) AS level FROM t8")
def _(d):
    return P.threshold_global(d.pixels(), "RidlerCalvard").withColumn("level", F.round("level", 6))


_MODE2 = "CAST(arg_min(value, (-n, value)) * 2 AS DOUBLE)"
_BLOCKLEVEL = f"""h AS (SELECT site_id, value, count(*) AS n FROM d_pixels GROUP BY 1, 2), g AS (SELECT site_id, {_MODE2} AS g FROM h GROUP BY 1)"""


@query("threshold_surface", f"""WITH {_BLOCKLEVEL}, hb AS (SELECT site_id, y // 16 AS cy, x // 16 AS cx, value, count(*) AS n FROM d_pixels GROUP BY ALL),
    b AS (SELECT site_id, cy, cx, {_MODE2} AS t FROM hb GROUP BY 1, 2, 3),
    u AS (SELECT site_id, y, x, (y + 0.5::DOUBLE) / 16 - 0.5::DOUBLE AS uy, (x + 0.5::DOUBLE) / 16 - 0.5::DOUBLE AS ux FROM d_pixels),
    w AS (SELECT *, greatest(floor(uy), 0) AS y0, least(floor(uy) + 1, 3) AS y1, uy - floor(uy) AS fy, greatest(floor(ux), 0) AS x0, least(floor(ux) + 1, 3) AS x1, ux - floor(ux) AS fx FROM u),
    s AS (SELECT w.site_id, y, x, (a.t * (1 - fx) + c.t * fx) * (1 - fy) + (d.t * (1 - fx) + e.t * fx) * fy AS t FROM w
      JOIN b a ON a.site_id = w.site_id AND a.cy = y0 AND a.cx = x0 JOIN b c ON c.site_id = w.site_id AND c.cy = y0 AND c.cx = x1
      JOIN b d ON d.site_id = w.site_id AND d.cy = y1 AND d.cx = x0 JOIN b e ON e.site_id = w.site_id AND e.cy = y1 AND e.cx = x1),
    r AS (SELECT site_id, y, x, least(greatest(t, 0.7::DOUBLE * g), 1.5::DOUBLE * g) AS value FROM s JOIN g USING (site_id)) """ + sql_lines("r", digits=9))
def _(d):
    return lines(P.threshold_level(d.pixels(), "Background", "Adaptive", least_block=16), "level", 9)


@query("threshold_per_object", f"""WITH {_BLOCKLEVEL}, hl AS (SELECT l.site_id, label, value, count(*) AS n FROM d_labels l JOIN d_pixels2 p USING (site_id, y, x) GROUP BY ALL),
    b AS (SELECT site_id, label, {_MODE2} AS t FROM hl GROUP BY 1, 2),
    h2 AS (SELECT site_id, value, count(*) AS n FROM d_pixels2 GROUP BY 1, 2), g2 AS (SELECT site_id, {_MODE2} AS g FROM h2 GROUP BY 1),
    s AS (SELECT p.site_id, p.y, p.x, coalesce(t, 1) AS t FROM d_pixels2 p LEFT JOIN d_labels l ON l.site_id = p.site_id AND l.y = p.y AND l.x = p.x LEFT JOIN b ON b.site_id = l.site_id AND b.label = l.label),
    r AS (SELECT site_id, y, x, greatest(least(greatest(t, 0.7::DOUBLE * g), 1.5::DOUBLE * g), 20) AS value FROM s JOIN g2 USING (site_id)) """ + sql_lines("r", digits=4))
def _(d):
    return lines(P.threshold_level(d.pixels2(), "Background", "PerObject", d.labels(), lower=20), "level", 4)


@query("threshold_mixture")
def _(d):
    return P.threshold_global(d.pixels(), "MoG").withColumn("level", F.round("level", 4))


# --- filters ----------------------------------------------------------------------------

@query("smooth_average", f"WITH {mirrored(1)}, c AS (SELECT site_id, y, x, floor(sum(value) / count(*)) AS value FROM nb GROUP BY 1, 2, 3) {sql_lines('c')}")
def _(d):
    return lines(P.smooth(d.pixels(), "average", 3))


@query("smooth_median", f"WITH {mirrored(1)}, c AS (SELECT site_id, y, x, median(value) AS value FROM nb GROUP BY 1, 2, 3) {sql_lines('c')}")
def _(d):
    return lines(P.smooth(d.pixels(), "median", 3))


@query("smooth_gaussian", """WITH g AS (SELECT k, exp(-0.5 * k * k) / (SELECT sum(exp(-0.5 * k * k)) FROM (SELECT unnest(generate_series(-4, 4)) AS k)) AS w
      FROM (SELECT unnest(generate_series(-4, 4)) AS k)),
    h AS (SELECT a.site_id, a.y, a.x, sum(b.value * w) AS m FROM d_pixels a, g JOIN d_pixels b ON b.site_id = a.site_id AND b.y = a.y AND b.x = CASE WHEN a.x + k < 0 THEN -(a.x + k) - 1 WHEN a.x + k > 63 THEN 127 - a.x - k ELSE a.x + k END GROUP BY 1, 2, 3),
    v AS (SELECT a.site_id, a.y, a.x, sum(b.m * w) AS m FROM d_pixels a, g JOIN h b ON b.site_id = a.site_id AND b.x = a.x AND b.y = CASE WHEN a.y + k < 0 THEN -(a.y + k) - 1 WHEN a.y + k > 63 THEN 127 - a.y - k ELSE a.y + k END GROUP BY 1, 2, 3),
    c AS (SELECT site_id, y, x, floor(m + 1e-9) AS value FROM v) """ + sql_lines("c"))
def _(d):
    return lines(P.smooth(d.pixels(), "gaussian", 1))


@query("smooth_bilateral", f"""WITH {mirrored(3)}, w AS (SELECT nb.site_id, nb.y, nb.x, nb.value, exp(-(dy * dy + dx * dx) / 8::DOUBLE - (nb.value - p.value) ** 2 / 8::DOUBLE) AS w
      FROM nb JOIN d_pixels p ON p.site_id = nb.site_id AND p.y = nb.y AND p.x = nb.x WHERE dy * dy + dx * dx <= 9),
    c AS (SELECT site_id, y, x, floor(sum(w * value) / sum(w) + 1e-9) AS value FROM w GROUP BY 1, 2, 3) {sql_lines('c')}""")
def _(d):
    return lines(P.smooth(d.pixels(), "bilateral", 2))


@query("convolve_log", f"""WITH o AS (SELECT unnest(generate_series(-2, 2)) AS k), g AS (SELECT a.k AS dy, b.k AS dx, exp(-(a.k * a.k + b.k * b.k) / (2 * (4 / 3) ** 2)) AS g FROM o a, o b),
    l AS (SELECT dy, dx, g / (SELECT sum(g) FROM g) * (dy * dy + dx * dx - 2 * (4 / 3) ** 2) / (4 / 3) ** 4 AS k FROM g),
    w AS (SELECT dy, dx, k - (SELECT avg(k) FROM l) AS w FROM l), {mirrored(2)},
    c AS (SELECT site_id, y, x, sum(value * w) AS value FROM nb JOIN w USING (dy, dx) GROUP BY 1, 2, 3) {sql_lines('c', digits=5)}""")
def _(d):
    return lines(ST.convolve(d.pixels(), ST.log_kernel(5, 4 / 3)), "filtered", 5)


def _morph_sql(agg, cond):
    return f"""WITH m AS (SELECT site_id, y, x, value > 60 AS m FROM d_pixels),
    c AS (SELECT a.site_id, a.y, a.x, {agg}(b.m) AS value FROM m a, (SELECT unnest([-1, 0, 1]) AS dy), (SELECT unnest([-1, 0, 1]) AS dx)
      JOIN m b ON b.site_id = a.site_id AND b.y = a.y + dy AND b.x = a.x + dx WHERE {cond} GROUP BY 1, 2, 3) """ + sql_lines("c")


def mask60(d):
    return P.threshold_manual(d.pixels(), 60).drop("value")


@query("dilate_mask", _morph_sql("bool_or", "true"))
def _(d):
    return lines(ST.dilate(mask60(d)), "mask")


@query("erode_mask", _morph_sql("bool_and", "dy = 0 OR dx = 0"))
def _(d):
    return lines(ST.erode(mask60(d), 1, cross=True), "mask")


def _twice(first, second):
    step = lambda n, src, agg: f"""{n} AS (SELECT a.site_id, a.y, a.x, {agg}(b.m) AS m FROM {src} a, (SELECT unnest([-1, 0, 1]) AS dy), (SELECT unnest([-1, 0, 1]) AS dx)
      JOIN {src} b ON b.site_id = a.site_id AND b.y = a.y + dy AND b.x = a.x + dx GROUP BY 1, 2, 3)"""  # noqa: E731
    return f"WITH m0 AS (SELECT site_id, y, x, value > 60 AS m FROM d_pixels), {step('m1', 'm0', first)}, {step('m2', 'm1', second)} " + sql_lines("m2", "m")


@query("open_mask", _twice("bool_and", "bool_or"))
def _(d):
    return lines(ST.opening(mask60(d)), "mask")


@query("close_mask", _twice("bool_or", "bool_and"))
def _(d):
    return lines(ST.closing(mask60(d)), "mask")


@query("mask_perimeter", """WITH m AS (SELECT site_id, y, x, value > 60 AS m FROM d_pixels),
    c AS (SELECT a.site_id, a.y, a.x, any_value(a.m) AND bool_or(NOT b.m) AS value FROM m a, (SELECT unnest([-1, 0, 1]) AS dy), (SELECT unnest([-1, 0, 1]) AS dx)
      JOIN m b ON b.site_id = a.site_id AND b.y = a.y + dy AND b.x = a.x + dx WHERE dy = 0 OR dx = 0 GROUP BY 1, 2, 3) """ + sql_lines("c"))
def _(d):
    return lines(ST.perimeter(mask60(d)), "mask")


# --- projections, composition, heights -------------------------------------------------

def stack(d):
    """Three z planes per site."""
    return d.pixels().withColumn("zplane", F.explode(F.sequence(F.lit(0), F.lit(2)))).withColumn(
        "value", F.expr("CAST((value * (zplane + 2) + x * zplane) % 97 AS INT)"))


_STACK = """z AS (SELECT site_id, y, x, zplane, CAST((value * (zplane + 2) + x * zplane) % 97 AS INTEGER) AS value FROM d_pixels, (SELECT unnest([0, 1, 2]) AS zplane))"""


@query("project_max", f"WITH {_STACK}, c AS (SELECT site_id, y, x, max(value) AS value FROM z GROUP BY 1, 2, 3) {sql_lines('c')}")
def _(d):
    return lines(P.project(stack(d), "max"))


@query("project_sum", f"WITH {_STACK}, c AS (SELECT site_id, y, x, least(sum(value), 255) AS value FROM z GROUP BY 1, 2, 3) {sql_lines('c')}")
def _(d):
    return lines(P.project(stack(d), "sum", 255))


@query("height_map", f"WITH {_STACK}, c AS (SELECT site_id, y, x, arg_max(zplane, (value, -zplane)) AS value FROM z GROUP BY 1, 2, 3) {sql_lines('c')}")
def _(d):
    return lines(P.height_map(stack(d)), "height")


@query("background_heights", f"""WITH {_STACK}, h AS (SELECT site_id, y, x, arg_max(zplane, (value, -zplane)) AS h FROM z GROUP BY 1, 2, 3),
    q AS (SELECT site_id, quantile_cont(h, 0.2) AS top FROM h WHERE NOT (x + y) % 64 < 20 GROUP BY 1),
    c AS (SELECT site_id, y, x, CASE WHEN (x + y) % 64 >= 20 AND h <= top THEN h ELSE 0 END AS value FROM h JOIN q USING (site_id)) {sql_lines('c')}""")
def _(d):
    cells = d.pixels().select("site_id", "y", "x", F.expr("(x + y) % 64 < 20").alias("mask"))
    return lines(P.background_heights(stack(d), cells), "height")


@query("binned_heights", f"""WITH {_STACK}, b AS (SELECT site_id, CAST(y // 4 AS INTEGER) AS bin_y, CAST(x // 4 AS INTEGER) AS bin_x, zplane, floor(avg(value)) AS v FROM z GROUP BY 1, 2, 3, 4)
    SELECT site_id, bin_y, bin_x, arg_max(zplane, (v, -zplane)) AS height FROM b GROUP BY 1, 2, 3""")
def _(d):
    return P.binned_heights(stack(d), 4)


@query("place_images", """WITH c AS (SELECT a.site_id, a.y, a.x, coalesce(b.value, a.value) AS value FROM d_pixels a LEFT JOIN d_pixels2 b
    ON b.site_id = a.site_id AND b.y = a.y - 40 AND b.x = a.x - 30) """ + sql_lines("c"))
def _(d):
    return lines(P.place(d.pixels(), P.crop(d.pixels2(), 0, 24, 0, 34), 40, 30))


@query("merge_images", """WITH c AS (SELECT * FROM d_pixels WHERE x < 20 UNION ALL SELECT * FROM d_pixels2 WHERE x >= 20) """ + sql_lines("c"))
def _(d):
    return lines(P.merge_at(d.pixels(), d.pixels2(), "x", 20))


@query("concat_images", """WITH c AS (SELECT * FROM d_pixels UNION ALL SELECT site_id, y + 64, x, value FROM d_pixels2) """ + sql_lines("c"))
def _(d):
    return lines(P.concat(d.pixels(), d.pixels2(), "y"))


@query("feature_image", """WITH c AS (SELECT l.site_id, l.y, l.x, label * 1.5::DOUBLE AS value FROM d_labels l) """ + sql_lines("c", digits=3))
def _(d):
    values = d.labels().select("site_id", "label").distinct().withColumn("v", F.col("label") * 1.5)
    return lines(P.feature_image(d.labels(), values, "v"), digits=3)


@query("fit_plane", """SELECT site_id, round(regr_a, 6) AS a, round(regr_b, 6) AS b, round(zm - regr_a * xm - regr_b * ym, 6) AS c FROM (
    SELECT site_id, avg(x) AS xm, avg(y) AS ym, avg(value) AS zm,
      (covar_pop(x, value) * var_pop(y) - covar_pop(y, value) * covar_pop(x, y)) / (var_pop(x) * var_pop(y) - covar_pop(x, y) ** 2) AS regr_a,
      (covar_pop(y, value) * var_pop(x) - covar_pop(x, value) * covar_pop(x, y)) / (var_pop(x) * var_pop(y) - covar_pop(x, y) ** 2) AS regr_b
    FROM d_pixels GROUP BY 1)""")
def _(d):
    planes = P.fit_plane(d.pixels().withColumnRenamed("value", "z"), ["site_id"])
    return planes.select("site_id", *[F.round(c, 6).alias(c) for c in "abc"])


@query("height_above_plane", """WITH p AS (SELECT site_id, avg(x) AS xm, avg(y) AS ym, avg(value) AS zm,
      covar_pop(x, value) / var_pop(x) AS a, covar_pop(y, value) / var_pop(y) AS b FROM d_pixels GROUP BY 1)
    SELECT site_id, y, round(sum(abs(value - (zm + a * (x - xm) + b * (y - ym)))), 6) AS height FROM d_pixels JOIN p USING (site_id) GROUP BY 1, 2""")
def _(d):
    points = d.pixels().withColumnRenamed("value", "z")
    return (P.height_above_plane(points, P.fit_plane(points, ["site_id"]), ["site_id"])
            .groupBy("site_id", "y").agg(F.round(F.sum(F.abs("height")), 6).alias("height")))


@query("interpolate_nearest", """WITH b AS (SELECT site_id, y, x, CAST(value AS DOUBLE) AS h FROM d_pixels WHERE (y * 64 + x + site_id) % 509 = 0),
    r AS (SELECT g.site_id, g.y, g.x, arg_min(b.h, ((g.y - b.y) ** 2 + (g.x - b.x) ** 2, b.h)) AS value FROM d_pixels g JOIN b ON b.site_id = g.site_id GROUP BY 1, 2, 3) """ + sql_lines("r"))
def _(d):
    beads = d.pixels().filter("(y * 64 + x + site_id) % 509 = 0").withColumn("height", F.col("value").cast("double"))
    return lines(P.interpolate_nearest(d.pixels(), beads), "height")


@query("channel_lut", """SELECT l_suppkey, l_linenumber, sum(CASE WHEN l_quantity < 5 THEN 0 WHEN l_quantity >= 45 THEN 255 ELSE CAST(floor((l_quantity - 5) * 255 / 39) AS BIGINT) END)::BIGINT AS total
    FROM lineitem GROUP BY 1, 2""")
def _(d):
    v = scale_to_byte("l_quantity", F.lit(5), F.lit(45))
    return d.table("lineitem").groupBy("l_suppkey", "l_linenumber").agg(F.sum(v).alias("total"))
