"""Finding the subject in a frame: masks, detection record, framing."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from rasterlab import params as P
from rasterlab.functions import colour as C
from rasterlab.operators import components as K, raster as R


def gray_byte() -> Column:
    return F.rint(F.round(C.gray(F.col("r"), F.col("g"), F.col("b")), 6))


def uv_mask(px: DataFrame, k: float = P.DETECT_K) -> DataFrame:
    """Red or green clearly above the border of the frame."""
    px = R.with_border_stats(px, ["r", "g"])

    def above(c):
        return F.col(c) > F.col(f"{c}_mean") + F.greatest(F.col(f"{c}_sd"), F.lit(1.0)) * k
    return px.withColumn("mask", above("r") | above("g")).drop("r_mean", "r_sd", "g_mean", "g_sd")


def visible_mask(px: DataFrame, k: float = P.DETECT_K, floor: float = P.VISIBLE_MIN_ABS_A) -> DataFrame:
    """Redder than the border, on the lightness-free a* axis."""
    px = R.with_border_stats(px.withColumn("_a", C.lab_a(F.col("r"), F.col("g"), F.col("b"))), ["_a"])
    cut = F.col("_a_mean") + F.greatest(F.col("_a_sd") * k, F.lit(float(floor)))
    return px.withColumn("mask", F.col("_a") > cut).drop("_a", "_a_mean", "_a_sd")


def grown(px: DataFrame, soft: str, seed: str, height: int | None = None) -> DataFrame:
    """``mask``: pixels of the soft components (8-connected) that hold a seed."""
    runs = K.mask_runs(px.where(F.col(soft)), [seed])
    return K.marked(px, K.holding(K.label_runs(runs, 8, height), seed), "mask")


def garlic_uv_mask(px: DataFrame, k: float = P.DETECT_K, grow: float = P.GARLIC_GROW,
                   min_values: int = P.OTSU_MIN_VALUES, height: int | None = None) -> DataFrame:
    """Green core by the image's own histogram cut, grown into its dim rim."""
    lit = R.with_border_stats(px, ["g"]).withColumn(
        "_lit", F.col("g") > F.col("g_mean") + F.greatest(F.col("g_sd"), F.lit(1.0)) * k).drop("g_mean", "g_sd")
    cut = R.otsu(lit.where("_lit"), "g", min_values)
    both = lit.join(cut, "image_id", "left").withColumns({
        "_seed": F.coalesce(F.col("_lit") & (F.col("g") > F.col("threshold")), F.lit(False)),
        "_soft": F.coalesce(F.col("_lit") & (F.col("g") > F.col("threshold") * grow), F.lit(False))})
    return grown(both, "_soft", "_seed", height).drop("_lit", "_seed", "_soft", "threshold")


def garlic_visible_mask(px: DataFrame, window: float = P.GARLIC_WINDOW_FRAC,
                        min_area: float = P.GARLIC_VISIBLE_MIN_AREA_FRAC,
                        min_values: int = P.OTSU_MIN_VALUES, height: int | None = None) -> DataFrame:
    """Brighter than its surroundings inside the centre window.

    Components that reach the window's border came from outside and go, as do
    specks; if nothing would remain, everything stays.
    """
    def edge(size, sign):
        return F.floor(F.col(size) * (0.5 + sign * window / 2)).cast("int")
    px = px.withColumns({"_y0": edge("h", -1), "_y1": edge("h", 1), "_x0": edge("w", -1), "_x1": edge("w", 1)})
    x, y = F.col("x"), F.col("y")
    inside = (y >= F.col("_y0")) & (y < F.col("_y1")) & (x >= F.col("_x0")) & (x < F.col("_x1"))
    px = px.withColumns({"_in": inside, "_lum": gray_byte()})
    low = F.min(F.when(F.col("_in"), F.col("_lum"))).over(Window.partitionBy("image_id"))
    px = px.withColumn("_floor", low).withColumn("_lum", F.col("_lum") - F.col("_floor"))
    cut = R.otsu(px.where("_in"), "_lum", min_values)
    px = px.join(cut, "image_id", "left")
    bright = F.coalesce(F.col("_in") & (F.col("_lum") > F.col("threshold")), F.lit(False))
    rim = (y == F.col("_y0")) | (y == F.col("_y1") - 1) | (x == F.col("_x0")) | (x == F.col("_x1") - 1)
    px = px.withColumns({"_bright": bright, "_rim": rim})
    runs = K.label_runs(K.mask_runs(px.where("_bright"), ["_rim"]), 8, height)
    dims = px.groupBy("image_id").agg((F.max("h") * F.max("w")).alias("_area"))
    per = runs.groupBy(*K.LABEL).agg(F.bool_or("_rim").alias("_touch"),
                                     F.sum(F.col("x1") - F.col("x0") + 1).alias("_n")).join(dims, "image_id")
    per = per.withColumn("_good", ~F.col("_touch") & (F.col("_n") >= F.col("_area") * min_area))
    some = per.groupBy("image_id").agg(F.bool_or("_good").alias("_some"))
    keep = per.join(some, "image_id").where(F.col("_good") | ~F.col("_some")).select(*K.LABEL)
    kept = runs.join(keep, K.LABEL, "left_semi")
    return K.marked(px, kept, "mask").drop("_y0", "_y1", "_x0", "_x1", "_in", "_lum", "_floor", "_bright", "_rim",
                                           "threshold")


def cleaned(px: DataFrame, h: int, w: int) -> DataFrame:
    """Mask closed and opened with kernels that follow the frame size."""
    k = R.kernel_scale(h, w)
    return R.opened(R.closed(px, "mask", 2 * k + 1), "mask", k)


def largest(runs: DataFrame, h: int) -> tuple[DataFrame, DataFrame]:
    """(labelled runs, the largest component of each image) of mask runs."""
    runs = K.label_runs(runs, 8, h)
    blobs = K.blob_table(runs)
    best = F.max(F.struct(F.col("area"), (-F.col("ly")).alias("a"), (-F.col("lx")).alias("b"),
                          F.struct("ly", "lx", "left", "right", "top", "bottom").alias("box"))).alias("_b")
    return runs, blobs.groupBy("image_id").agg(best).select("image_id", F.col("_b.area").alias("area"), "_b.box.*")


def detection(px: DataFrame, h: int, w: int, min_area: float = P.MIN_AREA_FRAC,
              min_radius: float | None = P.MIN_RADIUS_FRAC, max_radius: float | None = P.MAX_RADIUS_FRAC,
              runs: DataFrame | None = None, images: DataFrame | None = None) -> DataFrame:
    """One record per image: where the subject is, or why it was not found.

    A failed record carries the centred fallback circle instead. ``runs`` are
    the runs of ``mask`` and ``images`` the list of images, where the caller
    has them already.
    """
    _, big = largest(K.mask_runs(px.where("mask")) if runs is None else runs, h)
    images = px.select("image_id").distinct() if images is None else images
    d = images.join(big, "image_id", "left")
    bw, bh = F.col("right") - F.col("left") + 1, F.col("bottom") - F.col("top") + 1
    radius = F.greatest(bw, bh) / 2.0
    frac = radius / (min(h, w) / 2.0)
    big_enough = F.col("area") >= min_area * h * w
    reason = F.when(F.col("area").isNull(), "not_found").when(~big_enough, "too_small")
    if min_radius is not None:
        reason = reason.when(frac < min_radius, "radius_small")
    if max_radius is not None:
        reason = reason.when(frac > max_radius, "radius_large")
    ok = F.col("reason").isNull()
    touches = F.array_compact(F.array(
        F.when(F.col("left") <= 1, "left"), F.when(F.col("top") <= 1, "top"),
        F.when(F.col("left") + bw >= w - 1, "right"), F.when(F.col("top") + bh >= h - 1, "bottom")))
    d = d.withColumn("reason", reason)
    return d.select(
        "image_id", ok.alias("ok"), "reason", "area", (F.col("area") / (h * w * 1.0)).alias("area_frac"),
        F.when(big_enough, F.struct(F.col("left").alias("x"), F.col("top").alias("y"), bw.alias("w"),
                                    bh.alias("h"))).alias("bbox"),
        F.when(big_enough, touches).otherwise(F.array().cast("array<string>")).alias("touches_edge"),
        F.when(big_enough, frac).alias("radius_frac_of_frame"),
        F.when(ok, F.col("left") + bw / 2.0).otherwise(w / 2.0).alias("cx"),
        F.when(ok, F.col("top") + bh / 2.0).otherwise(h / 2.0).alias("cy"),
        F.when(ok, radius).otherwise(min(h, w) * P.FALLBACK_RADIUS_FRAC).alias("radius"))


def crop_squares(detected: DataFrame, radius_frac: float = P.SUBJECT_RADIUS_FRAC) -> DataFrame:
    """(image_id, x0, y0, side) that puts the subject at its fixed scale."""
    half = F.col("radius") / (2.0 * radius_frac)
    return detected.select("image_id", F.rint(F.col("cx") - half).cast("int").alias("x0"),
                           F.rint(F.col("cy") - half).cast("int").alias("y0"),
                           F.rint(half * 2).cast("int").alias("side"))


def normalised(px: DataFrame, detected: DataFrame, size: int = P.SIZE_PX,
               radius_frac: float = P.SUBJECT_RADIUS_FRAC) -> DataFrame:
    """Every subject centred at the same scale in a ``size`` frame."""
    rgb = ["r", "g", "b"]
    return R.as_bytes(R.framed(px, crop_squares(detected, radius_frac), rgb, size), rgb)


def padding(px: DataFrame, detected: DataFrame, h: int, w: int, radius_frac: float = P.SUBJECT_RADIUS_FRAC) -> DataFrame:
    """(image_id, padded, black_share) of normalised frames ``px``."""
    c = crop_squares(detected, radius_frac)
    out = ((F.col("x0") < 0) | (F.col("y0") < 0) | (F.col("x0") + F.col("side") > w) | (F.col("y0") + F.col("side") > h))
    share = px.groupBy("image_id").agg(R.black_share(px).alias("black_share"))
    return share.join(c.select("image_id", out.alias("padded")), "image_id")


def object_mask(px: DataFrame, h: int, w: int, runs: DataFrame | None = None) -> DataFrame:
    """``mask`` narrowed to the largest component, closed once more; with the
    ``runs`` of the mask the pixels need no mask of their own."""
    runs, big = largest(K.mask_runs(px.where("mask")) if runs is None else runs, h)
    kept = runs.join(big.select(*K.LABEL), K.LABEL, "left_semi")
    return R.closed(K.marked(px.drop("mask"), kept, "mask"), "mask", 3 * R.kernel_scale(h, w))


def background_level(px: DataFrame, mask: str = "mask") -> DataFrame:
    """(image_id, bg_level): median gray outside the mask."""
    return px.where(~F.col(mask)).groupBy("image_id").agg(F.percentile(gray_byte(), 0.5).alias("bg_level"))


MASKS = {("onion", "uv"): uv_mask, ("onion", "visible"): visible_mask,
         ("garlic", "uv"): garlic_uv_mask, ("garlic", "visible"): garlic_visible_mask}


def subject_masks(px: DataFrame, masks=None) -> DataFrame:
    """``mask`` by each image's (crop, kind)."""
    parts = [fn(px.where((F.col("crop") == crop) & (F.col("kind") == kind)))
             for (crop, kind), fn in (masks or MASKS).items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def by_frame_size(px: DataFrame, fn, photos: DataFrame | None = None) -> DataFrame:
    """Apply ``fn(pixels, h, w)`` to the images of each frame size.

    Frame sizes are sensor formats, so there are few of them. ``photos``, one
    row per image with its ``h`` and ``w``, spares a pass over the pixels.
    """
    sizes = (px if photos is None else photos).select("h", "w").distinct().collect()
    out = None
    for s in sizes:
        part = fn(px.where((F.col("h") == s["h"]) & (F.col("w") == s["w"])), s["h"], s["w"])
        out = part if out is None else out.unionByName(part)
    return out
