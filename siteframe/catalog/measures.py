"""Queries over measurements of objects."""

import math

from pyspark.sql import functions as F

from siteframe.catalog import query
from siteframe.operators import measure as ME
from siteframe.operators import relational as R

NAN = "CAST('NaN' AS DOUBLE)"


def rounded(df, digits=6, skip=("site_id", "label", "point_id", "parent", "name")):
    return df.select(*[F.round(c, digits).alias(c) if c not in skip else F.col(c) for c in df.columns])


_OBJ = "o AS (SELECT l.site_id, CAST(l.label AS INTEGER) AS label, l.y, l.x, p.value FROM d_labels l JOIN d_pixels2 p ON p.site_id = l.site_id AND p.y = l.y AND p.x = l.x)"


@query("measure_intensity", f"""WITH {_OBJ} SELECT site_id, label, max(value)::DOUBLE AS max, round(avg(value), 6) AS mean, min(value)::DOUBLE AS min,
    sum(value)::DOUBLE AS sum, round(stddev_pop(value), 6) AS std FROM o GROUP BY 1, 2""")
def _(d):
    return rounded(ME.measure_intensity(d.labels(), d.pixels2()))


@query("bounding_boxes", "SELECT site_id, CAST(label AS INTEGER) AS label, min(y) AS y0, max(y) + 1 AS y1, min(x) AS x0, max(x) + 1 AS x1 FROM d_labels GROUP BY 1, 2")
def _(d):
    return ME.bounding_boxes(d.labels())


@query("centroids", "SELECT site_id, CAST(label AS INTEGER) AS label, CAST(-floor(avg(y)) AS INTEGER) AS y, CAST(floor(avg(x)) AS INTEGER) AS x FROM d_labels GROUP BY 1, 2")
def _(d):
    return ME.centroids(d.labels())


_PERIM = """rim AS (SELECT a.site_id, a.label, a.y, a.x FROM d_labels a LEFT JOIN d_labels b ON b.site_id = a.site_id AND b.label = a.label
      AND b.y BETWEEN a.y - 1 AND a.y + 1 AND b.x BETWEEN a.x - 1 AND a.x + 1 AND abs(b.y - a.y) + abs(b.x - a.x) = 1 GROUP BY 1, 2, 3, 4 HAVING count(b.x) < 4),
    code AS (SELECT a.site_id, a.label, a.y, a.x, 1 + coalesce(sum(CASE WHEN abs(b.y - a.y) + abs(b.x - a.x) = 1 THEN 2 WHEN b.y <> a.y AND b.x <> a.x THEN 10 ELSE 0 END), 0) AS c
      FROM rim a LEFT JOIN rim b ON b.site_id = a.site_id AND b.label = a.label AND b.y BETWEEN a.y - 1 AND a.y + 1 AND b.x BETWEEN a.x - 1 AND a.x + 1 GROUP BY 1, 2, 3, 4),
    per AS (SELECT site_id, label, sum(CASE WHEN c IN (5, 7, 15, 17, 25, 27) THEN 1 WHEN c IN (21, 33) THEN sqrt(2) WHEN c IN (13, 23) THEN (1 + sqrt(2)) / 2 ELSE 0 END) AS perimeter FROM code GROUP BY 1, 2)"""


@query("measure_morphology", f"""WITH {_PERIM}, m AS (SELECT site_id, label, count(*)::DOUBLE AS area, avg(y) AS my, avg(x) AS mx, min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1,
      var_pop(y) AS yy, var_pop(x) AS xx, covar_pop(y, x) AS xy FROM d_labels GROUP BY 1, 2),
    e AS (SELECT *, (yy + xx) / 2 + sqrt(((yy - xx) / 2) ** 2 + xy ** 2) AS l1, greatest((yy + xx) / 2 - sqrt(((yy - xx) / 2) ** 2 + xy ** 2), 0) AS l2 FROM m JOIN per USING (site_id, label))
    SELECT site_id, CAST(label AS INTEGER) AS label, round(mx - x0, 6) AS local_centroid_x, round(my - y0, 6) AS local_centroid_y, area, round(perimeter, 6) AS perimeter,
      round(sqrt(greatest(1 - l2 / l1, 0)), 5) AS eccentricity, round(area / ((y1 - y0 + 1) * (x1 - x0 + 1)), 6) AS extent, round(4 * pi() * area / perimeter ** 2, 6) AS circularity,
      round((sqrt(l1) - sqrt(l2)) / sqrt(l1), 5) AS elongation, round(sqrt(4 * area / pi()), 6) AS equivalent_diameter, round(4 * sqrt(l1), 5) AS major_axis_length, round(4 * sqrt(l2), 5) AS minor_axis_length FROM e""")
def _(d):
    out = ME.measure_morphology(d.labels())
    five = ["eccentricity", "elongation", "major_axis_length", "minor_axis_length"]
    return rounded(out.withColumns({c: F.round(c, 5) for c in five}), 6, ("site_id", "label", *five))


@query("measure_shape")
def _(d):
    mask = d.pixels().select("site_id", "y", "x", (F.col("value") >= 120).alias("mask"))
    return rounded(ME.measure_shape(d.labels(), mask))


@query("measure_zernike", """WITH b AS (SELECT site_id, label, avg(y) AS cy, avg(x) AS cx, (max(y) - min(y) + 3) / 2 AS ry, (max(x) - min(x) + 3) / 2 AS rx, count(*) AS n FROM d_labels GROUP BY 1, 2),
    p AS (SELECT site_id, label, n, (y - cy) / ry AS v, (x - cx) / rx AS u FROM d_labels JOIN b USING (site_id, label)),
    q AS (SELECT *, sqrt(u * u + v * v) AS r, atan2(v, u) AS t FROM p WHERE sqrt(u * u + v * v) <= 1)
    SELECT site_id, CAST(label AS INTEGER) AS label, round(1 / pi() * count(*) / any_value(n), 6) AS zernike_0_0,
      round(2 / pi() / any_value(n) * sqrt(sum(r * cos(t)) ** 2 + sum(r * sin(t)) ** 2), 6) AS zernike_1_1,
      round(3 / pi() / any_value(n) * abs(sum(2 * r * r - 1)), 6) AS zernike_2_0,
      round(3 / pi() / any_value(n) * sqrt(sum(r * r * cos(2 * t)) ** 2 + sum(r * r * sin(2 * t)) ** 2), 6) AS zernike_2_2 FROM q GROUP BY 1, 2""")
def _(d):
    return rounded(ME.measure_zernike(d.labels(), 2))


def _radial_sql(n, m):
    terms = [((-1) ** k * math.factorial(n - k) // (math.factorial(k) * math.factorial((n + m) // 2 - k) * math.factorial((n - m) // 2 - k)), n - 2 * k)
             for k in range((n - m) // 2 + 1)]
    return "(" + " + ".join(f"({c}) * r ** {p}" for c, p in terms) + ")"


_ORDERS = [(n, m) for n in range(13) for m in range(n % 2, n + 1, 2)]


@query("measure_zernike_full", """WITH b AS (SELECT site_id, label, avg(y) AS cy, avg(x) AS cx, (max(y) - min(y) + 3) / 2 AS ry, (max(x) - min(x) + 3) / 2 AS rx, count(*) AS n FROM d_labels GROUP BY 1, 2),
    p AS (SELECT site_id, label, n, (y - cy) / ry AS v, (x - cx) / rx AS u FROM d_labels JOIN b USING (site_id, label)),
    q AS (SELECT *, sqrt(u * u + v * v) AS r, atan2(v, u) AS t FROM p WHERE sqrt(u * u + v * v) <= 1)
    SELECT site_id, CAST(label AS INTEGER) AS label, """ + ", ".join(
    f"round({n + 1} / pi() / any_value(n) * sqrt(sum({_radial_sql(n, m)} * cos({m} * t)) ** 2 + sum({_radial_sql(n, m)} * sin({m} * t)) ** 2) + 3e-8, 6) AS zernike_{n}_{m}"
    for n, m in _ORDERS) + " FROM q GROUP BY 1, 2")
def _(d):
    full = ME.measure_zernike(d.labels(), 12)
    return full.select("site_id", "label", *[F.round(F.col(f"zernike_{n}_{m}") + 3e-8, 6).alias(f"zernike_{n}_{m}") for n, m in _ORDERS])


def _signed(expression):
    """Values of many magnitudes on a scale that keeps their sign."""
    return f"round(sign({expression}) * ln(1 + abs({expression}) * 1e18) + 3e-7, 4) + 0"


@query("measure_hu", f"""WITH {_OBJ}, c AS (SELECT site_id, label, sum(value)::DOUBLE AS m, sum(value * y) / sum(value) AS cy, sum(value * x) / sum(value) AS cx FROM o GROUP BY 1, 2),
    mu AS (SELECT site_id, label, sum(value * (y - cy) ** 2) / any_value(m) ** 2 AS n20, sum(value * (x - cx) ** 2) / any_value(m) ** 2 AS n02,
      sum(value * (y - cy) * (x - cx)) / any_value(m) ** 2 AS n11, sum(value * (y - cy) ** 3) / any_value(m) ** 2.5 AS n30, sum(value * (x - cx) ** 3) / any_value(m) ** 2.5 AS n03,
      sum(value * (y - cy) ** 2 * (x - cx)) / any_value(m) ** 2.5 AS n21, sum(value * (y - cy) * (x - cx) ** 2) / any_value(m) ** 2.5 AS n12 FROM o JOIN c USING (site_id, label) GROUP BY 1, 2)
    SELECT site_id, label, round((n20 + n02) * 1e4, 5) AS hu_0, round(((n20 - n02) ** 2 + 4 * n11 ** 2) * 1e8, 4) AS hu_1,
      round(((n30 - 3 * n12) ** 2 + (3 * n21 - n03) ** 2) * 1e11, 3) AS hu_2, round(((n30 + n12) ** 2 + (n21 + n03) ** 2) * 1e11, 3) AS hu_3,
      {_signed('p * a * (a * a - 3 * b * b) + q * b * (3 * a * a - b * b)')} AS hu_4, {_signed('(n20 - n02) * (a * a - b * b) + 4 * n11 * a * b')} AS hu_5,
      {_signed('q * a * (a * a - 3 * b * b) - p * b * (3 * a * a - b * b)')} AS hu_6
    FROM (SELECT *, n30 + n12 AS a, n21 + n03 AS b, n30 - 3 * n12 AS p, 3 * n21 - n03 AS q FROM mu)""")
def _(d):
    hu = ME.measure_hu(d.labels(), d.pixels2())
    scale = ((0, 1e4, 5), (1, 1e8, 4), (2, 1e11, 3), (3, 1e11, 3))
    signed = [F.round(F.signum(f"hu_{i}") * F.log(1 + F.abs(f"hu_{i}") * 1e18) + 3e-7, 4).alias(f"hu_{i}") for i in (4, 5, 6)]
    return hu.select("site_id", "label", *[F.round(F.col(f"hu_{i}") * s, n).alias(f"hu_{i}") for i, s, n in scale], *signed)


_HARALICK = ("angular_second_moment", "contrast", "correlation", "sum_of_squares", "inverse_diff_moment", "sum_avg", "sum_var", "sum_entropy", "entropy",
             "diff_var", "diff_entropy", "info_measure_corr_1", "info_measure_corr_2")


@query("measure_haralick", f"""WITH {_OBJ}, top AS (SELECT site_id, quantile_cont(value, 0.99999) AS top FROM d_pixels2 GROUP BY 1),
    oc AS (SELECT o.site_id, o.label, o.y, o.x, least(o.value::DOUBLE, top) AS value FROM o JOIN top USING (site_id)),
    g AS (SELECT site_id, label, y, x, CAST(floor(value * 255 / max(value) OVER (PARTITION BY site_id, label)) AS INTEGER) AS g FROM oc),
    pr AS (SELECT a.site_id, a.label, s.d, a.g AS i, b.g AS j FROM g a, (VALUES (0, 0, 1), (1, 1, 1), (2, 1, 0), (3, 1, -1)) s(d, dy, dx)
      JOIN g b ON b.site_id = a.site_id AND b.label = a.label AND b.y = a.y + s.dy AND b.x = a.x + s.dx WHERE a.g > 0 AND b.g > 0),
    sy AS (SELECT site_id, label, d, i, j FROM pr UNION ALL SELECT site_id, label, d, j, i FROM pr),
    c AS (SELECT site_id, label, d, i, j, count(*) AS n FROM sy GROUP BY ALL),
    p AS (SELECT *, n / sum(n) OVER (PARTITION BY site_id, label, d) AS p FROM c),
    px AS (SELECT site_id, label, d, -sum(q * log2(q)) AS hx FROM (SELECT site_id, label, d, i, sum(p) AS q FROM p GROUP BY ALL) GROUP BY ALL),
    pp AS (SELECT site_id, label, d, -sum(q * log2(q)) AS sum_entropy FROM (SELECT site_id, label, d, i + j AS k, sum(p) AS q FROM p GROUP BY ALL) GROUP BY ALL),
    pm AS (SELECT site_id, label, d, -sum(q * log2(q)) AS diff_entropy, sum(q * q) / 256 - 1 / 256 ** 2 AS diff_var FROM (SELECT site_id, label, d, abs(i - j) AS k, sum(p) AS q FROM p GROUP BY ALL) GROUP BY ALL),
    f AS (SELECT site_id, label, d, sum(p * p) AS angular_second_moment, sum((i - j) ** 2 * p) AS contrast, sum(p / (1 + (i - j) ** 2)) AS inverse_diff_moment, sum((i + j) * p) AS sum_avg,
      sum((i + j) ** 2 * p) - sum((i + j) * p) ** 2 AS sum_var, -sum(p * log2(p)) AS entropy, sum(i * i * p) - sum(i * p) ** 2 AS sum_of_squares, sum(i * j * p) - sum(i * p) ** 2 AS cov FROM p GROUP BY 1, 2, 3),
    e AS (SELECT *, CASE WHEN sum_of_squares > 1e-12 THEN cov / sum_of_squares ELSE 1 END AS correlation, CASE WHEN hx > 1e-12 THEN (entropy - 2 * hx) / hx ELSE entropy - 2 * hx END AS info_measure_corr_1,
      sqrt(greatest(1 - exp(2 * (entropy - 2 * hx)), 0)) AS info_measure_corr_2 FROM f JOIN px USING (site_id, label, d) JOIN pp USING (site_id, label, d) JOIN pm USING (site_id, label, d))
    SELECT site_id, label, {', '.join(f'round(avg({n}) + 3e-8, 5) AS {n}' for n in _HARALICK)} FROM e GROUP BY 1, 2""")
def _(d):
    return ME.measure_haralick(d.labels(), d.pixels2(), 1).select("site_id", "label", *[F.round(F.col(n) + 3e-8, 5).alias(n) for n in _HARALICK])


_AROUND = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx]
_HOOD = f"""{_OBJ}, h AS (SELECT a.site_id, a.label, a.y, a.x, a.value::DOUBLE AS value, {', '.join(
    f'coalesce(max(b.value) FILTER (b.y = a.y + ({dy}) AND b.x = a.x + ({dx})), 0)::DOUBLE AS v{i}' for i, (dy, dx) in enumerate(_AROUND))}
    FROM o a JOIN o b ON b.site_id = a.site_id AND b.label = a.label AND b.y BETWEEN a.y - 1 AND a.y + 1 AND b.x BETWEEN a.x - 1 AND a.x + 1 GROUP BY 1, 2, 3, 4, 5)"""


def _point_sql(k):
    """Value at the k-th of eight points on the unit circle, between the pixels around it."""
    dy, dx = math.sin(math.pi * k / 4), math.cos(math.pi * k / 4)
    y0, x0 = math.floor(round(dy, 9)), math.floor(round(dx, 9))
    fy, fx = round(dy - y0, 9), round(dx - x0, 9)
    parts = []
    for yy, wy in ((y0, 1 - fy), (y0 + 1, fy)):
        for xx, wx in ((x0, 1 - fx), (x0 + 1, fx)):
            if wy * wx > 0:
                parts.append(f"{'value' if (yy, xx) == (0, 0) else f'v{_AROUND.index((yy, xx))}'} * {wy * wx!r}::DOUBLE")
    return " + ".join(parts)


@query("measure_lbp", f"""WITH {_HOOD}, c AS (SELECT site_id, label, {' + '.join(f'CASE WHEN {_point_sql(k)} >= value THEN {1 << k} ELSE 0 END' for k in range(8))} AS c FROM h),
    r AS (SELECT site_id, label, least({', '.join(f'((c >> {r}) | (c << {8 - r})) & 255' for r in range(8))}) AS c FROM c)
    SELECT site_id, label, {', '.join(f'count(*) FILTER (c = {c}) AS lbp_{i}' for i, c in enumerate(ME.lbp_codes()))} FROM r GROUP BY 1, 2""")
def _(d):
    return ME.measure_lbp(d.labels(), d.pixels2(), 1)


_MASKS = {"center": "({0} > mu - sd AND {0} < mu + sd)", "n_center": "NOT ({0} > mu - sd AND {0} < mu + sd)", "mu_margin": "({0} > mu - sd)",
          "n_mu_margin": "NOT ({0} > mu - sd)", "mu": "({0} > mu)", "n_mu": "NOT ({0} > mu)"}


@query("measure_tas", f"""WITH {_HOOD}, lv AS (SELECT site_id, label, coalesce(avg(value) FILTER (value > 50), 0) AS mu, coalesce(stddev_pop(value) FILTER (value > 50), 0) AS sd FROM h GROUP BY 1, 2),
    m AS (SELECT h.*, mu, sd FROM h JOIN lv USING (site_id, label)),
    n AS ({' UNION ALL '.join(f"SELECT site_id, label, '{name}' AS name, " + ' + '.join('(' + mask.format(f'v{i}') + ')::INT' for i in range(8)) + f" AS k FROM m WHERE {mask.format('value')}"
                             for name, mask in _MASKS.items())})
    SELECT site_id, label, name, {', '.join(f'round(count(*) FILTER (k = {b}) / count(*), 8) AS tas_{b}' for b in range(9))} FROM n GROUP BY 1, 2, 3""")
def _(d):
    return rounded(ME.measure_tas(d.labels(), d.pixels2(), 50), 8)


@query("measure_gabor", f"""WITH {_OBJ}, s AS (SELECT site_id, label, avg(y) AS cy, avg(x) AS cx, count(*) AS n, sum(value) AS v, sqrt(count(*) / pi()) / 3 AS sg FROM o GROUP BY 1, 2),
    w AS (SELECT o.site_id, o.label, o.value, n, v, a, 1000 / (2 * pi() * sg * sg) * exp(-((y - cy) ** 2 + (x - cx) ** 2) / (2 * sg * sg)) AS e,
      2 * pi() / 5 * ((y - cy) * cos(pi() * a / 4) + (x - cx) * sin(pi() * a / 4)) AS ph FROM o JOIN s USING (site_id, label), (SELECT unnest([0, 1, 2, 3]) AS a)),
    r AS (SELECT site_id, label, a, sum(value * e * cos(ph)) - sum(e * cos(ph)) / any_value(n) * any_value(v) AS c, sum(value * e * sin(ph)) - sum(e * sin(ph)) / any_value(n) * any_value(v) AS s FROM w GROUP BY 1, 2, 3)
    SELECT site_id, label, round(max(sqrt(c * c + s * s)), 4) AS gabor_5 FROM r GROUP BY 1, 2""")
def _(d):
    return rounded(ME.measure_gabor(d.labels(), d.pixels2(), [5]), 4)


@query("measure_texture")
def _(d):
    out = ME.measure_texture(d.labels(), d.pixels2(), (5,), (1,), (1,), 50)
    return out.groupBy("site_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("gabor_5"), 4).alias("gabor_5"),
                                      F.round(F.avg("haralick_contrast_1"), 4).alias("contrast"), F.sum("lbp_0_radius_1").alias("lbp_0"))


# --- points ----------------------------------------------------------------------------

_PAIRS = """d AS (SELECT a.site_id, a.parent, a.point_id, sqrt((a.y - b.y) ** 2 + (a.x - b.x) ** 2) AS d FROM d_points a LEFT JOIN d_points b
    ON b.site_id = a.site_id AND b.parent = a.parent AND b.point_id <> a.point_id)"""


@query("point_distances", f"""WITH {_PAIRS} SELECT site_id, parent, point_id, coalesce(round(min(d), 6), {NAN}) AS nearest, coalesce(round(avg(d), 6), {NAN}) AS mean_distance,
    CASE WHEN count(d) = 0 THEN {NAN} ELSE round(sqrt(greatest(avg(d * d) - avg(d) ** 2, 0)), 4) END AS std_distance FROM d GROUP BY 1, 2, 3""")
def _(d):
    out = ME.point_distances(d.points(), ["site_id", "parent"])
    return rounded(out.drop("y", "x").withColumn("std_distance", F.round("std_distance", 4)), 6,
                   ("site_id", "parent", "point_id", "std_distance"))


def disk_points(d):
    """Points inside the disks of the image fixture."""
    return d.labels().filter("(y * 5 + x * 3 + site_id) % 11 = 0").selectExpr("site_id", "y * 64 + x AS point_id", "y", "x", "label AS parent")


@query("measure_point_pattern", f"""WITH pt AS (SELECT site_id, label, y, x, y * 64 + x AS point_id FROM d_labels WHERE (y * 5 + x * 3 + site_id) % 11 = 0),
    ar AS (SELECT site_id, label, count(*) AS area FROM d_labels GROUP BY 1, 2),
    bg AS (SELECT site_id, y, x FROM d_pixels WHERE value < 120),
    bd AS (SELECT pt.site_id, point_id, min((pt.y - bg.y) ** 2 + (pt.x - bg.x) ** 2) AS b FROM pt JOIN bg ON bg.site_id = pt.site_id AND bg.y BETWEEN pt.y - 8 AND pt.y + 8 AND bg.x BETWEEN pt.x - 8 AND pt.x + 8 GROUP BY 1, 2),
    nn AS (SELECT a.site_id, a.point_id, a.label, min(sqrt((a.y - b.y) ** 2 + (a.x - b.x) ** 2)) AS n, avg(sqrt((a.y - b.y) ** 2 + (a.x - b.x) ** 2)) AS m, stddev_pop(sqrt((a.y - b.y) ** 2 + (a.x - b.x) ** 2)) AS sd FROM pt a LEFT JOIN pt b
      ON b.site_id = a.site_id AND b.label = a.label AND b.point_id <> a.point_id GROUP BY 1, 2, 3)
    SELECT nn.site_id, nn.point_id, b::DOUBLE AS absolute_distance_to_border, round(b / area, 6) AS relative_distance_to_border,
      coalesce(round(n, 6), {NAN}) AS absolute_distance_to_nearest_neighbor, coalesce(round(n / area, 6), {NAN}) AS relative_distance_to_nearest_neighbor,
      coalesce(round(m, 6), {NAN}) AS absolute_mean_distance_to_neighbors, coalesce(round(m / area, 6), {NAN}) AS relative_mean_distance_to_neighbors,
      coalesce(round(sd + 3e-7, 4), {NAN}) AS absolute_std_distance_to_neighbors, coalesce(round(sd / area + 3e-7, 4), {NAN}) AS relative_std_distance_to_neighbors
    FROM nn JOIN bd USING (site_id, point_id) JOIN ar ON ar.site_id = nn.site_id AND ar.label = nn.label""")
def _(d):
    out = ME.measure_point_pattern(disk_points(d).drop("parent"), d.labels())
    std = ("absolute_std_distance_to_neighbors", "relative_std_distance_to_neighbors")
    return rounded(out.withColumns({c: F.round(F.col(c) + 3e-7, 4) for c in std}), 6, ("site_id", "point_id", "label", *std))


@query("neighbour_fractions", f"""WITH {_PAIRS} SELECT site_id, parent, point_id, coalesce(round(count(*) FILTER (d < 10) / nullif(count(d), 0), 8), {NAN}) AS fraction_0,
    coalesce(round(count(*) FILTER (d < 25) / nullif(count(d), 0), 8), {NAN}) AS fraction_1 FROM d GROUP BY 1, 2, 3""")
def _(d):
    return rounded(ME.neighbour_fractions(d.points(), ["site_id", "parent"], [10, 25]), 8)


@query("kth_nearest", f"""WITH {_PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY site_id, parent, point_id ORDER BY d) AS r, count(*) OVER (PARTITION BY site_id, parent, point_id) AS n FROM d WHERE d IS NOT NULL)
    SELECT site_id, parent, point_id, round(max(d) FILTER (r = greatest(ceil(n * 0.25::DOUBLE), 1)), 6) AS distance_0, round(max(d) FILTER (r = greatest(ceil(n * 0.5::DOUBLE), 1)), 6) AS distance_1 FROM r GROUP BY 1, 2, 3""")
def _(d):
    return rounded(ME.kth_nearest(d.points(), ["site_id", "parent"], [0.25, 0.5]))


@query("spot_localisation", """WITH pt AS (SELECT site_id, label, y, x, y * 64 + x AS point_id FROM d_labels WHERE (y * 5 + x * 3 + site_id) % 11 = 0),
    c AS (SELECT site_id, label, avg(y) AS cy, avg(x) AS cx FROM d_labels GROUP BY 1, 2),
    rim AS (SELECT a.site_id, a.label, a.y, a.x FROM d_labels a LEFT JOIN d_labels b ON b.site_id = a.site_id AND b.label = a.label
      AND b.y BETWEEN a.y - 1 AND a.y + 1 AND b.x BETWEEN a.x - 1 AND a.x + 1 AND abs(b.y - a.y) + abs(b.x - a.x) = 1 GROUP BY 1, 2, 3, 4 HAVING count(b.x) < 4)
    SELECT pt.site_id, pt.point_id, CAST(pt.label AS INTEGER) AS parent, round(any_value(sqrt((pt.y - cy) ** 2 + (pt.x - cx) ** 2)), 6) AS distance_to_centroid,
      round(sqrt(min((pt.y - rim.y) ** 2 + (pt.x - rim.x) ** 2)), 6) AS distance_to_outline FROM pt JOIN c ON c.site_id = pt.site_id AND c.label = pt.label
      JOIN rim ON rim.site_id = pt.site_id AND rim.label = pt.label GROUP BY 1, 2, 3""")
def _(d):
    return rounded(ME.spot_localisation(disk_points(d).drop("parent"), d.labels()).withColumn("point_id", F.col("point_id")))


# --- volumes and contours -----------------------------------------------------------------

@query("measure_volume", f"""WITH {_OBJ}, h AS (SELECT *, value * 0.25 AS z FROM o),
    s AS (SELECT a.site_id, a.label, sum((sqrt((0.1625 * (d.z - a.z) - (b.z - a.z) * 0.1625) ** 2 + ((b.z - a.z) * 0.1625) ** 2 + 0.1625 ** 4)
      + sqrt((0.1625 * (d.z - a.z) - (c.z - a.z) * 0.1625) ** 2 + ((c.z - a.z) * 0.1625) ** 2 + 0.1625 ** 4)) / 2) AS up FROM h a
      JOIN h b ON b.site_id = a.site_id AND b.label = a.label AND b.y = a.y + 1 AND b.x = a.x JOIN h c ON c.site_id = a.site_id AND c.label = a.label AND c.y = a.y AND c.x = a.x + 1
      JOIN h d ON d.site_id = a.site_id AND d.label = a.label AND d.y = a.y + 1 AND d.x = a.x + 1 GROUP BY 1, 2)
    SELECT site_id, label, round(max(value) * 0.25::DOUBLE, 6) AS max_height, round(avg(value) * 0.25::DOUBLE, 6) AS mean_height, round(sum(value) * (0.1625 * 0.1625 * 0.25 / 1000)::DOUBLE, 11) AS volume_pl,
      round(count(*) * 0.02640625::DOUBLE, 6) AS lower_surface_area, round(any_value(up)::DOUBLE, 4) AS upper_surface_area, round(any_value(up)::DOUBLE + count(*) * 0.02640625::DOUBLE + 3e-7, 4) AS total_surface_area FROM h JOIN s USING (site_id, label) GROUP BY 1, 2""")
def _(d):
    out = ME.measure_volume(d.labels(), d.pixels2().withColumnRenamed("value", "height"))
    return rounded(out.withColumns({"upper_surface_area": F.round("upper_surface_area", 4), "total_surface_area": F.round(F.col("total_surface_area") + 3e-7, 4),
                   "volume_pl": F.round("volume_pl", 11)}), 6, ("site_id", "label", "upper_surface_area", "total_surface_area", "volume_pl"))


@query("order_contour", """WITH c AS (SELECT site_id, label, avg(y) AS cy, avg(x) AS cx FROM d_labels GROUP BY 1, 2),
    a AS (SELECT l.site_id, l.label, l.y, l.x, atan2(l.y - cy, l.x - cx) AS a FROM d_labels l JOIN c ON c.site_id = l.site_id AND c.label = l.label)
    SELECT site_id, CAST(label AS INTEGER) AS label, y, x, CAST(row_number() OVER (PARTITION BY site_id, label ORDER BY CASE WHEN a < 0 THEN a + 2 * pi() ELSE a END, y, x) - 1 AS INTEGER) AS position FROM a""")
def _(d):
    return ME.order_contour(d.labels(), ["site_id", "label"])


@query("contour_curvature", """WITH n AS (SELECT c_custkey, c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS i, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer),
    t AS (SELECT c_nationkey, i, n, c_custkey * 7 % 50 AS y, c_custkey * 11 % 50 AS x FROM n)
    SELECT a.c_nationkey, CAST(a.i AS INTEGER) AS position, round(atan2((a.x - p.x) * (q.y - a.y) - (a.y - p.y) * (q.x - a.x), (a.x - p.x) * (q.x - a.x) + (a.y - p.y) * (q.y - a.y)), 8) AS curvature
    FROM t a JOIN t p ON p.c_nationkey = a.c_nationkey AND p.i = (a.i - 3 + a.n) % a.n JOIN t q ON q.c_nationkey = a.c_nationkey AND q.i = (a.i + 3) % a.n""")
def _(d):
    from siteframe.core import running_index
    c = running_index(d.table("customer"), ["c_nationkey"], "c_custkey", "position").select(
        "c_nationkey", F.col("position").cast("int").alias("position"), (F.col("c_custkey") * 7 % 50).alias("y"), (F.col("c_custkey") * 11 % 50).alias("x"))
    return ME.contour_curvature(c, ["c_nationkey"], 3).select("c_nationkey", "position", F.round("curvature", 8).alias("curvature"))
