"""Raster queries on the 8 x 8 frames: colour, filters, components, subjects."""

from pyspark.sql import functions as F

from rasterlab.functions import colour as C
from rasterlab.operators import components as K, measure as H, packed as PK, pixel_features as V, raster as R, subject as S
from rasterlab.plans import fixtures as X
from rasterlab.plans.registry import query, rnd, table
from rasterlab.session import cut_lineage

P = f"({X.SCALAR_SQL})"
RGB = f"({X.RGB_SQL})"
N = X.SIDE
PIX = ["image_id", "y", "x"]


def rgb():
    return [F.col(c) for c in "rgb"]


def lin(c):
    return f"(CASE WHEN {c} / 255.0 <= 0.04045 THEN {c} / 255.0 / 12.92 ELSE pow(({c} / 255.0 + 0.055) / 1.055, 2.4) END)"


# Linear channels, brightness, NDFI and masks of every pixel.
PREP = f"""(SELECT *, (lr + lg + lb) / 3 AS bright, (lg - (lr + lb) / 2) / (lg + (lr + lb) / 2 + 1e-6) AS ndfi,
    r * 0.2126 + g * 0.7152 + b * 0.0722 AS lum, roi AND greatest(r, g, b) < 250 AS valid FROM (
  SELECT *, {lin('r')} AS lr, {lin('g')} AS lg, {lin('b')} AS lb,
    sqrt((x - 4.0) * (x - 4.0) + (y - 4.0) * (y - 4.0)) <= 8 * 0.45 AS roi FROM {RGB}))"""


def _round(df, *cols, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in cols})


# --- colour -------------------------------------------------------------------

@query("linear_light", f"""
  SELECT image_id, y, x, {rnd('lr', 9)} AS lin_R, {rnd('lg', 9)} AS lin_G, {rnd('lb', 9)} AS lin_B, {rnd('bright', 9)} AS bright FROM {PREP}""")
def linear_light(spark, d):
    px = V.prepared(X.rgb_pixels(spark, d))
    return _round(px.select(*PIX, "lin_R", "lin_G", "lin_B", "bright"), "lin_R", "lin_G", "lin_B", "bright", digits=9)


@query("luminance_gray", f"""
  SELECT image_id, y, x, {rnd('(r * 0.2126 + g * 0.7152 + b * 0.0722)::double')} AS lum, {rnd('(r * 0.299 + g * 0.587 + b * 0.114)::double')} AS gray FROM {RGB}""")
def luminance_gray(spark, d):
    return X.rgb_pixels(spark, d).select(*PIX, F.round(C.luminance(*rgb()), 6).alias("lum"),
                                         F.round(C.gray(*rgb()), 6).alias("gray"))


@query("ndfi", f"SELECT image_id, y, x, {rnd('ndfi', 9)} AS ndfi FROM {PREP}")
def ndfi(spark, d):
    return _round(V.prepared(X.rgb_pixels(spark, d)).select(*PIX, "ndfi"), "ndfi", digits=9)


@query("roi_valid", f"SELECT image_id, y, x, roi, valid, greatest(r, g, b) >= 250 AS saturated FROM {PREP}")
def roi_valid(spark, d):
    px = V.prepared(X.rgb_pixels(spark, d))
    return px.select(*PIX, "roi", "valid", C.saturated(*rgb()).alias("saturated"))


HUE = f"""(SELECT *, CASE WHEN diff = 0 THEN 0 WHEN h0 < 0 THEN h0 + 180 ELSE h0 END AS hue,
    CASE WHEN v = 0 THEN 0 ELSE floor(diff * 255.0 / v + 0.5)::int END AS sat FROM (
  SELECT *, floor(30.0 * (CASE WHEN v = r THEN g - b WHEN v = g THEN b - r + 2 * diff ELSE r - g + 4 * diff END)
      / nullif(diff, 0) + 0.5)::int AS h0
  FROM (SELECT *, greatest(r, g, b) AS v, greatest(r, g, b) - least(r, g, b) AS diff FROM {RGB})))"""


@query("hue_mask", f"""
  SELECT image_id, y, x, hue, sat, hue >= 10 AND hue < 40 AND sat >= 40 AS discoloured FROM {HUE}""")
def hue_mask(spark, d):
    return X.rgb_pixels(spark, d).select(*PIX, C.hue(*rgb()).alias("hue"), C.saturation(*rgb()).alias("sat"),
                                         C.discoloured(*rgb()).alias("discoloured"))


def fcurve(t):
    return f"(CASE WHEN {t} > 0.008856 THEN cbrt({t}) ELSE {t} * 7.787 + 16.0 / 116.0 END)"


LAB = f"""(SELECT *, round_even(({fcurve('((lr * 0.412453 + lg * 0.357580 + lb * 0.180423) / 0.950456)')}
    - {fcurve('(lr * 0.212671 + lg * 0.715160 + lb * 0.072169)')}) * 500.0 + 128.0, 0) AS a FROM {PREP})"""


@query("lab_a", f"SELECT image_id, y, x, a FROM {LAB}")
def lab_a(spark, d):
    return X.rgb_pixels(spark, d).select(*PIX, C.lab_a(*rgb()).alias("a"))


@query("orientation", f"""
  SELECT image_id, CASE class % 9 WHEN 2 THEN 7 - x WHEN 3 THEN 7 - x WHEN 5 THEN y WHEN 8 THEN y WHEN 6 THEN 7 - y
      WHEN 7 THEN 7 - y ELSE x END AS x,
    CASE class % 9 WHEN 3 THEN 7 - y WHEN 4 THEN 7 - y WHEN 5 THEN x WHEN 6 THEN x WHEN 7 THEN 7 - x WHEN 8 THEN 7 - x
      ELSE y END AS y, r FROM {RGB}""")
def orientation(spark, d):
    px = R.upright(X.rgb_pixels(spark, d), F.col("class") % 9)
    return px.select("image_id", "x", "y", "r")


# --- per-image statistics -----------------------------------------------------

STATS = ["mean_R", "mean_G", "mean_B", "sd_R", "sd_G", "sd_B", "brightness_mean", "brightness_sd", "texture",
         "A_high", "A_low", "F_p95", "F_p05", "NDFI_mean", "NDFI_p95", "NDFI_p05"]

LAP = """(SELECT *, coalesce(lag({v}) OVER wx, {v}) + coalesce(lead({v}) OVER wx, {v}) + coalesce(lag({v}) OVER wy, {v})
    + coalesce(lead({v}) OVER wy, {v}) - 4 * {v} AS lap FROM {t}
  WINDOW wx AS (PARTITION BY image_id, y ORDER BY x), wy AS (PARTITION BY image_id, x ORDER BY y))"""


COLOUR_SQL = f"""
  WITH p AS {LAP.format(v='bright', t=PREP)}, m AS (SELECT image_id, coalesce(median(bright) FILTER (valid), 0) AS med FROM p GROUP BY 1),
  s AS (SELECT p.image_id, coalesce(median(abs(bright - med)) FILTER (valid), 0) * 1.4826 * 3 AS spread, any_value(med) AS med
        FROM p JOIN m USING (image_id) GROUP BY 1)
  SELECT image_id, {rnd('coalesce(avg(lr) FILTER (valid), 0)')} AS "mean_R", {rnd('coalesce(avg(lg) FILTER (valid), 0)')} AS "mean_G",
    {rnd('coalesce(avg(lb) FILTER (valid), 0)')} AS "mean_B", {rnd('coalesce(stddev_pop(lr) FILTER (valid), 0)')} AS "sd_R",
    {rnd('coalesce(stddev_pop(lg) FILTER (valid), 0)')} AS "sd_G", {rnd('coalesce(stddev_pop(lb) FILTER (valid), 0)')} AS "sd_B",
    {rnd('coalesce(avg(bright) FILTER (valid), 0)')} AS brightness_mean, {rnd('coalesce(stddev_pop(bright) FILTER (valid), 0)')} AS brightness_sd,
    {rnd('coalesce(stddev_pop(lap) FILTER (valid), 0)')} AS texture,
    {rnd('avg((bright > med + spread)::int) FILTER (roi)')} AS "A_high", {rnd('avg((bright < med - spread)::int) FILTER (roi)')} AS "A_low",
    {rnd('quantile_cont(bright, 0.95) FILTER (roi)')} AS "F_p95", {rnd('quantile_cont(bright, 0.05) FILTER (roi)')} AS "F_p05",
    {rnd('avg(ndfi) FILTER (roi)')} AS "NDFI_mean", {rnd('quantile_cont(ndfi, 0.95) FILTER (roi)')} AS "NDFI_p95",
    {rnd('quantile_cont(ndfi, 0.05) FILTER (roi)')} AS "NDFI_p05"
  FROM p JOIN s USING (image_id) GROUP BY 1"""


@query("colour_stats", COLOUR_SQL)
def colour_stats(spark, d):
    return _round(V.colour_stats(V.prepared(X.rgb_pixels(spark, d))), *STATS)


@query("laplacian", f"SELECT image_id, y, x, {rnd('lap', 9)} AS lap FROM {LAP.format(v='v', t=P)}")
def laplacian(spark, d):
    return _round(R.laplacian(X.scalar_pixels(spark, d), "v").select(*PIX, "lap"), "lap", digits=9)


@query("background_level", f"""
  SELECT image_id, median(round_even(round((r * 0.299 + g * 0.587 + b * 0.114)::double, 6), 0)) AS bg_level FROM {RGB} WHERE NOT r > 100 GROUP BY 1""")
def background_level(spark, d):
    return S.background_level(X.rgb_pixels(spark, d).withColumn("mask", F.col("r") > 100))


# --- filters ------------------------------------------------------------------

ROI = "sqrt((x - 4.0) * (x - 4.0) + (y - 4.0) * (y - 4.0)) <= 8 * 0.45"


def box_sql(k, edge):
    rad = k // 2
    if edge == "reflect":
        at = "(CASE WHEN {0} < 0 THEN -1 - ({0}) WHEN {0} > 7 THEN 15 - ({0}) ELSE {0} END)"
        on = f"q.y = {at.format('p.y + dy')} AND q.x = {at.format('p.x + dx')}"
    else:
        on = "q.y = p.y + dy AND q.x = p.x + dx"
    return f"""(SELECT p.image_id, p.y, p.x, sum(q.v * q.m) / greatest(sum(q.m), 1e-6 * {k * k}) AS mean
      FROM p, (SELECT unnest(range({-rad}, {rad + 1})) AS dy) o1, (SELECT unnest(range({-rad}, {rad + 1})) AS dx) o2, p q
      WHERE q.image_id = p.image_id AND {on} GROUP BY 1, 2, 3)"""


def masked_px(spark, d):
    return X.scalar_pixels(spark, d).withColumn("roi", C.in_roi(F.col("x"), F.col("y"), N))


PM = f"p AS (SELECT *, ({ROI})::int AS m FROM {P})"


@query("box_mean", f"""
  WITH {PM}, a AS {box_sql(3, 'reflect')}, b AS {box_sql(5, 'reflect')}
  SELECT a.image_id, a.y, a.x, {rnd('a.mean', 9)} AS fine, {rnd('b.mean', 9)} AS coarse FROM a JOIN b USING (image_id, y, x)""")
def box_mean(spark, d):
    px = R.box_means(masked_px(spark, d), "v", "roi", {"fine": 3, "coarse": 5})
    return _round(px.select(*PIX, "fine", "coarse"), "fine", "coarse", digits=9)


@query("box_mean_zero_edge", f"""
  WITH {PM}, a AS {box_sql(3, 'zero')} SELECT image_id, y, x, {rnd('mean', 9)} AS fine FROM a""")
def box_mean_zero_edge(spark, d):
    px = R.box_means(masked_px(spark, d), "v", "roi", {"fine": 3}, edge="zero")
    return _round(px.select(*PIX, "fine"), "fine", digits=9)


@query("residual_threshold", f"""
  WITH {PM}, a AS {box_sql(5, 'reflect')},
  e AS (SELECT a.image_id, a.y, a.x, p.m, p.v - a.mean AS res FROM a JOIN p USING (image_id, y, x)),
  s AS (SELECT image_id, greatest(1.2 * stddev_pop(res), 0.15) AS cut FROM e WHERE m = 1 GROUP BY 1)
  SELECT e.image_id, y, x FROM e JOIN s USING (image_id) WHERE m = 1 AND res > cut""")
def residual_threshold(spark, d):
    px = R.box_means(masked_px(spark, d), "v", "roi", {"base": 5})
    return R.residual_mask(px, "v", "base", "roi", 1.2, 0.15, "hot").where("hot").select(*PIX)


MASK = f"(SELECT image_id, y, x, v > 0.08 AS m FROM {P})"


def mask_px(spark, d, level=0.08):
    return X.scalar_pixels(spark, d).withColumn("mask", F.col("v") > level)


@query("dilate", f"""
  WITH m AS {MASK} SELECT DISTINCT a.image_id, a.y, a.x FROM m a JOIN m b
    ON a.image_id = b.image_id AND abs(a.y - b.y) + abs(a.x - b.x) <= 2 WHERE b.m""")
def dilate(spark, d):
    return R.dilated_cross(mask_px(spark, d), "mask", 2, "near").where("near").select(*PIX)


def morph_sql(src, fn, rad):
    return f"""(SELECT image_id, y, x, {fn}(m) OVER (PARTITION BY image_id, x ORDER BY y ROWS BETWEEN {rad} PRECEDING AND {rad} FOLLOWING) AS m
      FROM (SELECT image_id, y, x, {fn}(m) OVER (PARTITION BY image_id, y ORDER BY x ROWS BETWEEN {rad} PRECEDING AND {rad} FOLLOWING) AS m FROM {src}))"""


CLOSED = morph_sql(morph_sql("m0", "max", 1), "min", 1)


@query("close_open", f"""
  WITH m0 AS (SELECT image_id, y, x, m::int AS m FROM {MASK}), c AS {CLOSED}, o AS {morph_sql(morph_sql('c', 'min', 1), 'max', 1)}
  SELECT c.image_id, c.y, c.x, c.m = 1 AS closed, o.m = 1 AS opened FROM c JOIN o USING (image_id, y, x)""")
def close_open(spark, d):
    c = R.closed(mask_px(spark, d), "mask", 3)
    return R.opened(c.withColumn("closed", F.col("mask")), "mask", 3).select(
        *PIX, "closed", F.col("mask").alias("opened"))


# --- components ---------------------------------------------------------------

def label_sql(mask, adjacent):
    """Labelled pixels ``l(image_id, y, x, label)`` by recursion over a mask."""
    near = {4: "abs(m.y - r.y) + abs(m.x - r.x) = 1", 8: "greatest(abs(m.y - r.y), abs(m.x - r.x)) = 1"}[adjacent]
    return f"""m AS (SELECT image_id, y, x FROM {mask}),
  r(image_id, y, x, l) AS (SELECT image_id, y, x, y * 8 + x FROM m UNION
    SELECT m.image_id, m.y, m.x, r.l FROM r JOIN m ON m.image_id = r.image_id AND {near}),
  l AS (SELECT image_id, y, x, min(l) AS label FROM r GROUP BY 1, 2, 3)"""


HOT = f"(SELECT * FROM {MASK} WHERE m)"


def _labels(spark, d, connectivity):
    return K.label_runs(K.mask_runs(mask_px(spark, d).where("mask")), connectivity, N)


def _label_pixels(runs):
    return K.run_pixels(runs).select(*PIX, (F.col("ly") * N + F.col("lx")).alias("label"))


@query("components4", f"WITH RECURSIVE {label_sql(HOT, 4)} SELECT image_id, y, x, label FROM l")
def components4(spark, d):
    return _label_pixels(_labels(spark, d, 4))


@query("components8", f"WITH RECURSIVE {label_sql(HOT, 8)} SELECT image_id, y, x, label FROM l")
def components8(spark, d):
    return _label_pixels(_labels(spark, d, 8))


@query("components_banded", f"WITH RECURSIVE {label_sql(HOT, 8)} SELECT image_id, y, x, label FROM l")
def components_banded(spark, d):
    """The same labels from bands of three rows merged over their seams."""
    return _label_pixels(K.label_runs(K.mask_runs(mask_px(spark, d).where("mask")), 8, N, band_rows=3))


BLOBS = """b AS (SELECT image_id, label, count(*) AS area, avg(x) AS cx, avg(y) AS cy, min(x) AS "left", max(x) AS "right",
    min(y) AS top, max(y) AS bottom FROM l GROUP BY 1, 2)"""


@query("blob_table", f"""
  WITH RECURSIVE {label_sql(HOT, 4)}, {BLOBS}
  SELECT image_id, label, area, {rnd('cx')} AS cx, {rnd('cy')} AS cy, {rnd('sqrt(area / pi())')} AS radius,
         "left", "right", top, bottom FROM b WHERE area BETWEEN 2 AND 9""")
def blob_table(spark, d):
    t = K.area_filtered(K.blob_table(_labels(spark, d, 4)), 2, 9)
    t = t.withColumn("label", F.col("ly") * N + F.col("lx")).drop("ly", "lx")
    return _round(t, "cx", "cy", "radius")


@query("nn_density", f"""
  WITH RECURSIVE {label_sql(HOT, 4)}, {BLOBS},
  n AS (SELECT a.image_id, a.label, min(sqrt((a.cx - o.cx) * (a.cx - o.cx) + (a.cy - o.cy) * (a.cy - o.cy))) AS d
        FROM b a LEFT JOIN b o ON a.image_id = o.image_id AND a.label <> o.label GROUP BY 1, 2)
  SELECT image_id, {rnd('CASE WHEN count(*) < 2 THEN 0 ELSE 1 / (avg(d) + 1e-6) END')} AS cluster_density FROM n GROUP BY 1""")
def nn_density(spark, d):
    return _round(V.nearest_density(K.blob_table(_labels(spark, d, 4)), max_rows=N * N), "cluster_density")


@query("nn_density_crowded", f"""
  WITH b AS (SELECT l_suppkey % 40 AS image_id, row_number() OVER () AS label, (l_partkey * 131 % 6400) / 10.0 AS cx, (l_orderkey * 37 % 6400) / 10.0 AS cy
    FROM lineitem),
  n AS (SELECT a.image_id, a.label, min(pow(a.cx - o.cx, 2) + pow(a.cy - o.cy, 2)) AS d FROM b a JOIN b o ON a.image_id = o.image_id AND a.label <> o.label GROUP BY 1, 2)
  SELECT image_id, {rnd('1 / (avg(sqrt(d)) + 1e-6)')} AS cluster_density FROM n GROUP BY 1""")
def nn_density_crowded(spark, d):
    """Frames of well over a thousand dots."""
    t = table(spark, d, "lineitem")
    dots = t.select((F.col("l_suppkey") % 40).alias("image_id"), ((F.col("l_partkey") * 131 % 6400) / 10.0).alias("cx"),
                    ((F.col("l_orderkey") * 37 % 6400) / 10.0).alias("cy"))
    return _round(V.nearest_density(dots), "cluster_density")


@query("blob_summary", f"""
  WITH RECURSIVE {label_sql(HOT, 4)}, {BLOBS}, s AS (SELECT image_id, count(*) FILTER (area <= 4) AS ns, count(*) FILTER (area > 4) AS nl,
    avg(2 * sqrt(area / pi())) FILTER (area <= 4) AS ds, avg(2 * sqrt(area / pi())) FILTER (area > 4) AS dl, max(area) AS mx FROM b GROUP BY 1)
  SELECT vec_id AS image_id, coalesce(ns, 0)::double AS n_small_sharp_blobs, coalesce(nl, 0)::double AS n_large_blotches,
    {rnd('coalesce(ds, 0)')} AS avg_small_blob_diam_px, {rnd('coalesce(dl, 0)')} AS avg_large_blotch_diam_px,
    coalesce(mx, 0)::double AS blob_max, {rnd('coalesce(ns, 0) / (coalesce(ns, 0) + coalesce(nl, 0) + 1e-6)')} AS ratio_small_to_large
  FROM embeddings e LEFT JOIN s ON e.vec_id = s.image_id""")
def blob_summary(spark, d):
    t = K.blob_table(_labels(spark, d, 4))
    images = X.frames(spark, d).select("image_id")
    out = V.blob_summary(images, K.area_filtered(t, 1, 4), K.area_filtered(t, 5)).drop("cluster_density")
    return _round(out, "avg_small_blob_diam_px", "avg_large_blotch_diam_px", "ratio_small_to_large")


@query("exclude_near_large", f"""
  WITH RECURSIVE {label_sql(HOT, 4)}, big AS (SELECT image_id, y, x FROM l WHERE (image_id, label) IN
    (SELECT (image_id, label) FROM l GROUP BY image_id, label HAVING count(*) >= 6))
  SELECT p.image_id, p.y, p.x FROM {P} p WHERE v > 0.15 AND NOT EXISTS (SELECT 1 FROM big
    WHERE big.image_id = p.image_id AND abs(big.y - p.y) + abs(big.x - p.x) <= 1)""")
def exclude_near_large(spark, d):
    px = mask_px(spark, d)
    runs = K.label_runs(K.mask_runs(px.where("mask")), 4, N)
    large = runs.join(K.area_filtered(K.blob_table(runs), 6).select(*K.LABEL), K.LABEL, "left_semi")
    near = R.dilated_cross(K.marked(px, large, "large"), "large", 1, "near")
    return near.where((F.col("v") > 0.15) & ~F.col("near")).select(*PIX)


# --- subject ------------------------------------------------------------------

# Border strips of one pixel on each side; corners count twice.
STRIPS = """(SELECT image_id, {v} AS v FROM {t} WHERE y = 0 UNION ALL SELECT image_id, {v} FROM {t} WHERE y = 7
  UNION ALL SELECT image_id, {v} FROM {t} WHERE x = 0 UNION ALL SELECT image_id, {v} FROM {t} WHERE x = 7)"""


@query("border_stats", f"""
  SELECT image_id, {rnd('avg(v)')} AS g_mean, {rnd('stddev_pop(v)')} AS g_sd FROM {STRIPS.format(v='g', t=RGB)} GROUP BY 1""")
def border_stats(spark, d):
    return _round(R.border_stats(X.rgb_pixels(spark, d), ["g"]), "g_mean", "g_sd")


def uv_sql(k):
    return f"""(SELECT c.image_id, c.y, c.x, c.r, c.g, c.b FROM {RGB} c
      JOIN (SELECT image_id, avg(v) AS mr, stddev_pop(v) AS sr FROM {STRIPS.format(v='r', t=RGB)} GROUP BY 1) s USING (image_id)
      JOIN (SELECT image_id, avg(v) AS mg, stddev_pop(v) AS sg FROM {STRIPS.format(v='g', t=RGB)} GROUP BY 1) u USING (image_id)
      WHERE r > mr + {k} * greatest(sr, 1) OR g > mg + {k} * greatest(sg, 1))"""


@query("subject_mask", f"SELECT image_id, y, x FROM {uv_sql(1.5)}")
def subject_mask(spark, d):
    return S.uv_mask(X.rgb_pixels(spark, d), 1.5).where("mask").select(*PIX)


@query("visible_mask", f"""
  SELECT l.image_id, y, x FROM {LAB} l JOIN (SELECT image_id, avg(v) + greatest(1.2 * stddev_pop(v), 6) AS cut
    FROM {STRIPS.format(v='a', t=LAB)} GROUP BY 1) s USING (image_id) WHERE a > cut""")
def visible_mask(spark, d):
    return S.visible_mask(X.rgb_pixels(spark, d), 1.2).where("mask").select(*PIX)


@query("largest_subject", f"""
  WITH RECURSIVE {label_sql(uv_sql(1.2), 8)}, {BLOBS},
  t AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY area DESC, label) AS rn FROM b),
  f AS (SELECT e.vec_id AS image_id, t.*, greatest("right" - "left" + 1, bottom - top + 1) / 2.0 AS rad
        FROM embeddings e LEFT JOIN t ON e.vec_id = t.image_id AND rn = 1),
  w AS (SELECT *, CASE WHEN area IS NULL THEN 'not_found' WHEN area < 0.03 * 64 THEN 'too_small' WHEN rad / 4.0 < 0.4 THEN 'radius_small'
    WHEN rad / 4.0 > 0.95 THEN 'radius_large' END AS reason FROM f)
  SELECT image_id, reason IS NULL AS ok, reason, area, area / 64.0 AS area_frac,
    CASE WHEN area >= 0.03 * 64 THEN rad / 4.0 END AS radius_frac_of_frame,
    CASE WHEN area >= 0.03 * 64 THEN concat_ws(',', CASE WHEN "left" <= 1 THEN 'left' END, CASE WHEN top <= 1 THEN 'top' END,
      CASE WHEN "right" + 1 >= 7 THEN 'right' END, CASE WHEN bottom + 1 >= 7 THEN 'bottom' END) ELSE '' END AS touches,
    CASE WHEN reason IS NULL THEN ("left" + "right" + 1) / 2.0 ELSE 4.0 END AS cx,
    CASE WHEN reason IS NULL THEN (top + bottom + 1) / 2.0 ELSE 4.0 END AS cy,
    CASE WHEN reason IS NULL THEN rad ELSE 3.2 END::double AS radius FROM w""".replace("f.image_id, t.*", "t.*").replace(
    "SELECT e.vec_id AS image_id, t.*, greatest", "SELECT e.vec_id AS image_id, t.area, t.label, t.\"left\", t.\"right\", t.top, t.bottom, greatest"))
def largest_subject(spark, d):
    px = S.uv_mask(X.rgb_pixels(spark, d), 1.2)
    out = S.detection(px, N, N, min_area=0.03, min_radius=0.4)
    return out.select("image_id", "ok", "reason", "area", "area_frac", "radius_frac_of_frame",
                      F.concat_ws(",", "touches_edge").alias("touches"), "cx", "cy", "radius")


@query("subject_cleaned", f"""
  WITH m0 AS (SELECT c.image_id, c.y, c.x, (u.image_id IS NOT NULL)::int AS m FROM {RGB} c LEFT JOIN {uv_sql(2.0)} u
      ON c.image_id = u.image_id AND c.y = u.y AND c.x = u.x),
  c AS {morph_sql(morph_sql('m0', 'max', 3), 'min', 3)}, o AS {morph_sql(morph_sql('c', 'min', 1), 'max', 1)}
  SELECT image_id, y, x FROM o WHERE m = 1""")
def subject_cleaned(spark, d):
    return S.cleaned(S.uv_mask(X.rgb_pixels(spark, d), 2.0), N, N).where("mask").select(*PIX)


@query("normalise", f"""
  WITH c AS (SELECT vec_id AS image_id, label % 3 - 1 AS x0, label % 2 - 1 AS y0, 6 + label % 4 AS side FROM embeddings),
  t AS (SELECT c.*, ty, tx, side / 7.0 AS s FROM c, (SELECT unnest(range(0, 7))::int AS ty), (SELECT unnest(range(0, 7))::int AS tx)),
  q AS (SELECT t.*, p.y - y0 AS sy, p.x - x0 AS sx, p.v FROM t JOIN {P} p ON p.image_id = t.image_id
        WHERE p.y - y0 BETWEEN 0 AND side - 1 AND p.x - x0 BETWEEN 0 AND side - 1),
  w AS (SELECT *, CASE WHEN side > 7 THEN greatest(least(sy + 1, (ty + 1) * s) - greatest(sy, ty * s), 0) / s
      ELSE greatest(1 - abs(least(greatest((ty + 0.5) * s - 0.5, 0), side - 1) - sy), 0) END AS wy,
    CASE WHEN side > 7 THEN greatest(least(sx + 1, (tx + 1) * s) - greatest(sx, tx * s), 0) / s
      ELSE greatest(1 - abs(least(greatest((tx + 0.5) * s - 0.5, 0), side - 1) - sx), 0) END AS wx FROM q)
  SELECT t.image_id, t.ty AS y, t.tx AS x, {rnd('coalesce(sum(w.v * wy * wx), 0)')} AS v FROM t LEFT JOIN w
    ON t.image_id = w.image_id AND t.ty = w.ty AND t.tx = w.tx GROUP BY 1, 2, 3""")
def normalise(spark, d):
    f = X.frames(spark, d)
    crops = f.select("image_id", (F.col("class") % 3 - 1).alias("x0"), (F.col("class") % 2 - 1).alias("y0"),
                     (F.col("class") % 4 + 6).alias("side"))
    return _round(R.framed(X.scalar_pixels(spark, d), crops, ["v"], 7).select(*PIX, "v"), "v")


@query("padding_black", f"""
  SELECT image_id, {rnd('avg((greatest(r, g, b) = 0)::int)')} AS black_share, {rnd('avg((greatest(r, g, b) < 40)::int)')} AS dim_share
  FROM {RGB} GROUP BY 1""")
def padding_black(spark, d):
    px = X.rgb_pixels(spark, d)
    return px.groupBy("image_id").agg(F.round(R.black_share(px), 6).alias("black_share"),
                                      F.round(F.avg((F.greatest("r", "g", "b") < 40).cast("double")), 6).alias("dim_share"))


# Otsu over the g channel: between-class variance at every occupied level.
def otsu_sql(src, col, least):
    return f"""(SELECT image_id, CASE WHEN n >= {least} THEN v END::double AS threshold FROM (
      SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY
          round(coalesce(n1 * (n - n1) * pow(s1 / n1::double - (s - s1) / nullif(n - n1, 0)::double, 2), 0), 6) DESC, v) AS rn FROM (
        SELECT image_id, v, n0, sum(n0) OVER w AS n1, sum(n0) OVER (PARTITION BY image_id) AS n,
               sum(n0 * v) OVER w AS s1, sum(n0 * v) OVER (PARTITION BY image_id) AS s
        FROM (SELECT image_id, {col} AS v, count(*) AS n0 FROM {src} GROUP BY 1, 2)
        WINDOW w AS (PARTITION BY image_id ORDER BY v))) WHERE rn = 1)"""


@query("otsu", f"SELECT image_id, threshold FROM {otsu_sql(RGB, 'g', 16)}")
def otsu(spark, d):
    return R.otsu(X.rgb_pixels(spark, d), "g", 16)


@query("hysteresis", f"""
  WITH RECURSIVE {label_sql(f'(SELECT image_id, y, x FROM {RGB} WHERE g > 90)', 8)}
  SELECT image_id, y, x FROM l WHERE (image_id, label) IN (SELECT (l.image_id, l.label) FROM l JOIN {RGB} c
    ON l.image_id = c.image_id AND l.y = c.y AND l.x = c.x WHERE c.g > 200)""")
def hysteresis(spark, d):
    px = X.rgb_pixels(spark, d).withColumns({"soft": F.col("g") > 90, "seed": F.col("g") > 200})
    return S.grown(px, "soft", "seed", N).where("mask").select(*PIX)


@query("garlic_uv_mask", f"""
  WITH RECURSIVE lit AS (SELECT c.image_id, c.y, c.x, g FROM {RGB} c JOIN (SELECT image_id, avg(v) + 0.2 * greatest(stddev_pop(v), 1) AS cut
      FROM {STRIPS.format(v='g', t=RGB)} GROUP BY 1) s USING (image_id) WHERE g > cut),
  t AS {otsu_sql('lit', 'g', 10)}, s AS (SELECT lit.*, g > threshold AS seed FROM lit JOIN t USING (image_id) WHERE g > threshold * 0.6),
  {label_sql('s', 8)}
  SELECT image_id, y, x FROM l WHERE (image_id, label) IN (SELECT (l.image_id, l.label) FROM l JOIN s USING (image_id, y, x) WHERE seed)""")
def garlic_uv_mask(spark, d):
    return S.garlic_uv_mask(X.rgb_pixels(spark, d), 0.2, min_values=10, height=N).where("mask").select(*PIX)


@query("garlic_visible_mask", f"""
  WITH RECURSIVE q AS (SELECT image_id, y, x, lum - min(lum) OVER (PARTITION BY image_id) AS lum FROM (
      SELECT image_id, y, x, round_even(round(r * 0.299 + g * 0.587 + b * 0.114, 6), 0) AS lum FROM {RGB}
      WHERE y BETWEEN 0 AND 7 AND x BETWEEN 0 AND 7)),
  t AS {otsu_sql('q', 'lum::int', 16)}, hot AS (SELECT image_id, y, x FROM q JOIN t USING (image_id) WHERE lum > threshold),
  {label_sql('hot', 8)}, per AS (SELECT image_id, label, bool_or(y IN (0, 7) OR x IN (0, 7)) AS rim, count(*) AS n FROM l GROUP BY 1, 2),
  ok AS (SELECT *, bool_or(NOT rim AND n >= 0.03 * 64) OVER (PARTITION BY image_id) AS anyok FROM per)
  SELECT image_id, y, x FROM l JOIN ok USING (image_id, label) WHERE (NOT rim AND n >= 0.03 * 64) OR NOT anyok""")
def garlic_visible_mask(spark, d):
    px = X.rgb_pixels(spark, d)
    return S.garlic_visible_mask(px, 1.0, 0.03, 16, N).where("mask").select(*PIX)


@query("subject_dispatch", f"""
  SELECT image_id, y, x FROM {uv_sql(1.5)} WHERE image_id IN (SELECT vec_id FROM embeddings WHERE label < 5)
  UNION ALL SELECT l.image_id, y, x FROM {LAB} l JOIN (SELECT image_id, avg(v) + greatest(4 * stddev_pop(v), 6) AS cut
    FROM {STRIPS.format(v='a', t=LAB)} GROUP BY 1) s USING (image_id) WHERE a > cut AND class >= 5""")
def subject_dispatch(spark, d):
    px = X.rgb_pixels(spark, d).withColumns({"crop": F.lit("onion"), "kind": F.when(F.col("class") < 5, "uv").otherwise("visible")})
    masks = {("onion", "uv"): lambda p: S.uv_mask(p, 1.5), ("onion", "visible"): S.visible_mask}
    return S.subject_masks(px, masks).where("mask").select(*PIX)


FOUR_RULES = [("onion", "uv"), ("onion", "visible"), ("garlic", "uv"), ("garlic", "visible")]
_OF = "image_id IN (SELECT vec_id FROM embeddings WHERE label % 4 = {})"


# All four mask rules on packed frames, the centre window of 6 x 6 pixels applied.
@query("packed_masks", f"""
  SELECT image_id, y, x FROM {uv_sql(1.5)} WHERE {_OF.format(0)}
  UNION ALL SELECT l.image_id, y, x FROM {LAB} l JOIN (SELECT image_id, avg(v) + greatest(4 * stddev_pop(v), 6) AS cut
    FROM {STRIPS.format(v='a', t=LAB)} GROUP BY 1) s USING (image_id) WHERE a > cut AND {_OF.format(1)}
  UNION ALL SELECT * FROM (WITH RECURSIVE lit AS (SELECT c.image_id, c.y, c.x, g FROM {RGB} c JOIN (SELECT image_id, avg(v) + 0.2 * greatest(stddev_pop(v), 1) AS cut
      FROM {STRIPS.format(v='g', t=RGB)} GROUP BY 1) s USING (image_id) WHERE g > cut AND {_OF.format(2)}),
    t AS {otsu_sql('lit', 'g', 10)}, s AS (SELECT lit.*, g > threshold AS seed FROM lit JOIN t USING (image_id) WHERE g > threshold * 0.6),
    {label_sql('s', 8)}
    SELECT image_id, y, x FROM l WHERE (image_id, label) IN (SELECT (l.image_id, l.label) FROM l JOIN s USING (image_id, y, x) WHERE seed))
  UNION ALL SELECT * FROM (WITH RECURSIVE q AS (SELECT image_id, y, x, lum - min(lum) OVER (PARTITION BY image_id) AS lum FROM (
      SELECT image_id, y, x, round_even(round(r * 0.299 + g * 0.587 + b * 0.114, 6), 0) AS lum FROM {RGB}
      WHERE y BETWEEN 1 AND 6 AND x BETWEEN 1 AND 6 AND {_OF.format(3)})),
    t AS {otsu_sql('q', 'lum::int', 16)}, hot AS (SELECT image_id, y, x FROM q JOIN t USING (image_id) WHERE lum > threshold),
    {label_sql('hot', 8)}, per AS (SELECT image_id, label, bool_or(y IN (1, 6) OR x IN (1, 6)) AS rim, count(*) AS n FROM l GROUP BY 1, 2),
    ok AS (SELECT *, bool_or(NOT rim AND n >= 0.03 * 64) OVER (PARTITION BY image_id) AS anyok FROM per)
    SELECT image_id, y, x FROM l JOIN ok USING (image_id, label) WHERE (NOT rim AND n >= 0.03 * 64) OR NOT anyok)""")
def packed_masks(spark, d):
    f = X.packed_frames(spark, d)
    at = F.col("class") % 4
    f = f.withColumns({"crop": F.get(F.array(*[F.lit(c) for c, _ in FOUR_RULES]), at), "kind": F.get(F.array(*[F.lit(k) for _, k in FOUR_RULES]), at)})
    rules = {FOUR_RULES[0]: lambda r, g, b: PK.uv(r, g, b, 1.5), FOUR_RULES[1]: PK.visible,
             FOUR_RULES[2]: lambda r, g, b: PK.garlic_uv(r, g, b, 0.2, min_values=10),
             FOUR_RULES[3]: lambda r, g, b: PK.garlic_visible(r, g, b, 0.75, 0.03, 16)}
    return PK.mask_runs(f, rules).select("image_id", "y", F.explode(F.sequence("x0", "x1")).alias("x"))


# Blobs of the scalar raster against the discoloured pixels of the colour raster.
@query("blob_on_mask", f"""
  WITH RECURSIVE {label_sql(HOT, 4)}, {BLOBS}, h AS (SELECT image_id, y, x, hue >= 10 AND hue < 40 AND sat >= 40 AS d FROM {HUE})
  SELECT e.vec_id AS image_id, CASE WHEN e.label = 0 THEN -1.0 ELSE {rnd('coalesce(1 - f, 0)')} END::double AS uv_exclusive_dot_frac
  FROM embeddings e LEFT JOIN (SELECT b.image_id, avg(h.d::int) AS f FROM b JOIN h ON b.image_id = h.image_id
      AND h.y = round_even(b.cy, 0) AND h.x = round_even(b.cx, 0) GROUP BY 1) q ON e.vec_id = q.image_id""")
def blob_on_mask(spark, d):
    views = X.frames(spark, d).select("image_id", (F.col("class") != 0).alias("has_companion"))
    spots = X.rgb_pixels(spark, d).where(C.discoloured(*rgb())).select(*PIX)
    small = K.blob_table(_labels(spark, d, 4))
    return _round(V.exclusive_fraction(views, small, spots, N), "uv_exclusive_dot_frac")


def _labelled(mask, tag):
    near = "abs(m.y - r.y) + abs(m.x - r.x) = 1"
    return f"""m{tag} AS (SELECT image_id, y, x FROM {mask}),
  r{tag}(image_id, y, x, l) AS (SELECT image_id, y, x, y * 8 + x FROM m{tag} UNION
    SELECT m.image_id, m.y, m.x, r.l FROM r{tag} r JOIN m{tag} m ON m.image_id = r.image_id AND {near}),
  l{tag} AS (SELECT image_id, y, x, min(l) AS label FROM r{tag} GROUP BY 1, 2, 3)"""


# The whole chain from colour bytes to the 23 features of a frame.
VIEW_SQL = f"""
  WITH RECURSIVE p AS (SELECT image_id, y, x, lum AS v, roi::int AS m FROM {PREP}),
  c3 AS {box_sql(3, 'reflect')}, c5 AS {box_sql(5, 'reflect')},
  res AS (SELECT p.image_id, p.y, p.x, p.m, p.v - c3.mean AS f, p.v - c5.mean AS c FROM p JOIN c3 USING (image_id, y, x)
          JOIN c5 USING (image_id, y, x)),
  cut AS (SELECT image_id, greatest(stddev_pop(f) * 1.0, 10) AS tf, greatest(stddev_pop(c) * 0.6, 4) AS tc FROM res WHERE m = 1 GROUP BY 1),
  hot AS (SELECT image_id, y, x, f > tf AS fine, c > tc AS coarse FROM res JOIN cut USING (image_id) WHERE m = 1),
  {_labelled('hot WHERE coarse', 'c')},
  bc AS (SELECT image_id, label, count(*) AS area FROM lc GROUP BY 1, 2 HAVING count(*) >= 5),
  big AS (SELECT image_id, y, x FROM lc JOIN bc USING (image_id, label)),
  fine AS (SELECT image_id, y, x FROM hot WHERE hot.fine AND NOT EXISTS (SELECT 1 FROM big WHERE big.image_id = hot.image_id
    AND abs(big.y - hot.y) + abs(big.x - hot.x) <= 1)),
  {_labelled('fine', 's')},
  bs AS (SELECT image_id, label, count(*) AS area, avg(x) AS cx, avg(y) AS cy FROM ls GROUP BY 1, 2 HAVING count(*) BETWEEN 1 AND 4),
  nn AS (SELECT a.image_id, a.label, min(sqrt((a.cx - o.cx) * (a.cx - o.cx) + (a.cy - o.cy) * (a.cy - o.cy))) AS d
         FROM bs a JOIN bs o ON a.image_id = o.image_id AND a.label <> o.label GROUP BY 1, 2),
  den AS (SELECT image_id, 1 / (avg(d) + 1e-6) AS cd FROM nn GROUP BY 1),
  sm AS (SELECT image_id, count(*) AS n, avg(2 * sqrt(area / pi())) AS d, max(area) AS mx FROM bs GROUP BY 1),
  lg AS (SELECT image_id, count(*) AS n, avg(2 * sqrt(area / pi())) AS d, max(area) AS mx FROM bc GROUP BY 1)
  SELECT k.*, greatest(coalesce(sm.mx, 0), coalesce(lg.mx, 0))::double AS blob_max, coalesce(sm.n, 0)::double AS n_small_sharp_blobs,
    coalesce(lg.n, 0)::double AS n_large_blotches, {rnd('coalesce(sm.d, 0)')} AS avg_small_blob_diam_px,
    {rnd('coalesce(lg.d, 0)')} AS avg_large_blotch_diam_px, {rnd('coalesce(cd, 0)')} AS cluster_density,
    {rnd('coalesce(sm.n, 0) / (coalesce(sm.n, 0) + coalesce(lg.n, 0) + 1e-6)')} AS ratio_small_to_large
  FROM ({COLOUR_SQL}) k LEFT JOIN sm USING (image_id) LEFT JOIN lg USING (image_id) LEFT JOIN den USING (image_id)"""


@query("feature_by_one_entry", f"""
  WITH p AS (SELECT image_id, lum, roi, greatest(r, g, b) < 250 AS fine, g >= greatest(r, b) AS green FROM {PREP})
  SELECT k.image_id, k."brightness_mean", k."F_p95", {rnd('coalesce(q.s, 0)')} AS green_share FROM ({COLOUR_SQL}) k
  LEFT JOIN (SELECT image_id, avg(green::int) AS s FROM p WHERE roi GROUP BY 1) q USING (image_id)""")
def feature_by_one_entry(spark, d):
    """A feature more in the list: share of the region whose green channel is the largest."""
    more = [*V.COLOUR_LIST, V.Feature("green_share", lambda: F.avg(F.when(F.col("roi"), (F.col("g") >= F.greatest("r", "b")).cast("int"))))]
    out = V.colour_stats(V.prepared(X.rgb_pixels(spark, d)), more)
    return _round(out, *out.columns[1:]).select("image_id", "brightness_mean", "F_p95", "green_share")


@query("view_features", VIEW_SQL)
def view_features(spark, d):
    """All 23 features of every frame, with windows that fit an 8 x 8 frame."""
    p = V.BlobParams(fine_window=3, coarse_window=5, fine_k=1.0, coarse_k=0.6, dilate=1, small_min=1, small_max=4,
                     large_min=5, height=N)
    feats, _ = V.view_features(X.rgb_pixels(spark, d), p)
    return _round(feats, *feats.columns[1:])


@query("view_features_by_windows", VIEW_SQL)
def view_features_by_windows(spark, d):
    """The same features with every filter as a window over the pixel table."""
    p = V.BlobParams(fine_window=3, coarse_window=5, fine_k=1.0, coarse_k=0.6, dilate=1, small_min=1, small_max=4,
                     large_min=5, height=N)
    feats, _ = V.view_features(X.rgb_pixels(spark, d), p, whole_frames=False)
    return _round(feats, *feats.columns[1:])


@query("measured_heads")
def measured_heads(spark, d):
    """Photos to scan-ready heads: each pair of frames is a head's UV and
    visible photo."""
    px = X.rgb_pixels(spark, d)
    uv = F.col("image_id") % 2 == 0
    px = px.withColumns({"code": F.expr("image_id div 2").cast("string"), "kind": F.when(uv, "uv").otherwise("visible"),
                         "view": F.when(uv, "V1").otherwise("VISIBLE"), "crop": F.lit("onion")})
    masks = {("onion", "uv"): lambda r, g, b: PK.uv(r, g, b, 1.5), ("onion", "visible"): lambda r, g, b: PK.visible(r, g, b, 1.2)}
    frames = X.packed_frames(spark, d).withColumns({"crop": F.lit("onion"), "kind": F.when(uv, "uv").otherwise("visible")})
    photos = frames.select("image_id", F.expr("image_id div 2").cast("string").alias("code"),
                           F.when(uv, "V1").otherwise("VISIBLE").alias("view"), "crop", "kind")
    found = cut_lineage(photos.join(PK.found(frames, masks), "image_id"))
    p = V.BlobParams(fine_window=3, coarse_window=5, fine_k=1.0, coarse_k=0.6, dilate=1, small_min=1, small_max=4,
                     large_min=5, height=N)
    return H.head_features(px, found, 1, p, N).join(H.capture_checks(found).drop("failed"), "code")
