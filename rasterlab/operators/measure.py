"""From photos to head features and from head features to scan rows.

Photos come as pixels with ``image_id, code, view, crop, kind`` beside the
frame columns; ``kind`` is ``uv`` or ``visible``.
"""

from pyspark.sql import DataFrame, functions as F

from rasterlab import params as P
from rasterlab.functions import rules as R
from rasterlab.operators import components as K, pixel_features as V, quality as Q, raster, scans as T, subject as S
from rasterlab.session import cut_lineage

PHOTO = ["image_id", "code", "view", "crop", "kind"]
MIN_AREA = {("garlic", "visible"): P.GARLIC_VISIBLE_MIN_AREA_FRAC}


def found_subjects(px: DataFrame, masks=None, photos: DataFrame | None = None) -> DataFrame:
    """One record per photo: its detection and background level.

    Each (crop, kind) has its own mask rule, each frame size its own kernels.
    The cleaned masks are materialised as runs - a few per frame row - and the
    records as rows, so the pixels are gone over once for the mask and once
    for the background. ``photos`` is one row per photo with the columns above
    and ``h``, ``w``; without it they are taken from the pixels.
    """
    masks = masks or S.MASKS
    photos = cut_lineage((px if photos is None else photos).select(*PHOTO, "h", "w").distinct())

    def one_size(part: DataFrame, h: int, w: int) -> DataFrame:
        out = None
        for (crop, kind), rule in masks.items():
            def mine(df):
                return df.where((F.col("crop") == crop) & (F.col("kind") == kind) & (F.col("h") == h) & (F.col("w") == w))
            mine_px = mine(part)
            runs = cut_lineage(K.mask_runs(S.cleaned(rule(mine_px), h, w).where("mask")))
            det = S.detection(mine_px, h, w, MIN_AREA.get((crop, kind), P.MIN_AREA_FRAC), runs=runs,
                              images=mine(photos).select("image_id"))
            level = S.background_level(S.object_mask(mine_px, h, w, runs))
            rec = det.join(level, "image_id", "left").withColumns({"frame_h": F.lit(h), "frame_w": F.lit(w)})
            out = rec if out is None else out.unionByName(rec)
        return out
    records = S.by_frame_size(px, one_size, photos)
    return cut_lineage(photos.select(*PHOTO).join(records, "image_id"))


def head_features(px: DataFrame, found: DataFrame, n_views: int = 1, blobs: V.BlobParams = V.BlobParams(),
                  size: int = P.SIZE_PX) -> DataFrame:
    """(code, features): view features over the UV photos of a head, and the
    cross-check of its last view's dots against the visible photo."""
    framed = S.normalised(px, found, size)
    kinds = found.select("image_id", "code", "view", "kind", "ok")
    uv = framed.join(kinds.where(F.col("kind") == "uv").select("image_id"), "image_id", "left_semi")
    per_view, small = V.view_features(uv, blobs)
    views = kinds.where(F.col("kind") == "uv").join(per_view, "image_id")
    heads = Q.single_or_pair(views, "code", P.VIEW_FEATURES, n_views)
    last = views.groupBy("code").agg(F.max_by("image_id", "view").alias("image_id"))
    dots = small.join(last, "image_id").select(F.col("code").alias("image_id"), "cx", "cy")
    companions = kinds.where((F.col("kind") == "visible") & F.col("ok")).select("image_id", "code")
    spots = V.discoloured_pixels(framed).join(companions, "image_id").select(
        F.col("code").alias("image_id"), "y", "x")
    paired = Q.with_companion(last.select("code"), companions.withColumn("ok", F.lit(True)), "code")
    cross = V.exclusive_fraction(paired.withColumnRenamed("code", "image_id"), dots, spots, size)
    return heads.join(cross.withColumnRenamed("image_id", "code"), "code")


def capture_checks(found: DataFrame, settings: DataFrame | None = None) -> DataFrame:
    """(code, scale, background, exif, failed): consistency over UV views.

    ``settings`` is (code, settings) with one tag map per photo; without it
    the camera check is unknown.
    """
    uv = found.where(F.col("kind") == "uv")
    radius = uv.select("code", F.col("radius_frac_of_frame").alias("radius_frac"))
    scale = Q.scale_consistency(radius, "code").select("code", F.col("status").alias("scale"))
    back = Q.background_consistency(uv, "code").select("code", F.col("status").alias("background"))
    # a head has as many views as the protocol has steps
    failed = uv.groupBy("code").agg(F.sort_array(F.collect_list(
        F.when(~F.col("ok"), F.col("view")))).alias("failed"))
    out = scale.join(back, "code").join(failed, "code")
    if settings is None:
        return out.withColumn("exif", F.lit("unknown"))
    exif = Q.setting_consistency(settings, "code").select("code", F.col("status").alias("exif"))
    return out.join(exif, "code", "left").withColumn("exif", F.coalesce("exif", F.lit("unknown")))


def scan_rows(heads: DataFrame, photos: DataFrame, checks: DataFrame, score, config: dict,
              dataset: str = "research") -> DataFrame:
    """Scan rows of finished heads: all features, quality notes, and - for a
    crop with a model - label, confidence, range status and advice.

    ``score`` maps feature rows with ``id`` to (id, proba_positive).
    """
    names = [c for c in heads.columns if c != "code"]
    crops = photos.groupBy("code").agg(F.max("crop").alias("crop"), F.min(
        F.when(F.col("kind") == "uv", F.col("image_id"))).alias("image_path"))
    rows = heads.join(crops, "code").join(checks, "code")
    proba = score(heads.withColumnRenamed("code", "id")).select(
        F.col("id").alias("code"), F.col("proba_positive").alias("pred_proba"))
    ranges = {n: (r["min"], r["max"]) for n, r in config["training_feature_ranges"].items()}
    has_model = F.col("crop").isin(P.CROPS_WITH_MODEL)
    report = Q.range_report({n: F.col(n) for n in ranges}, ranges)
    rows = rows.join(proba, "code", "left").withColumn("ood_status", F.when(has_model, report["status"]))
    rows = T.scored_scan(rows, F.lit(config["decision_threshold"]))
    framing_ok = F.size("failed") == 0
    reason = R.unreliable_reason(F.col("ood_status"), framing_ok, F.col("scale"), F.col("background"))
    advice = F.when(has_model, R.advice_level(F.col("pred_label"), F.col("borderline"), reason))
    features = F.create_map(*[x for n in names for x in (F.lit(n), F.col(n))])
    notes = T.quality_notes(F.col("scale"), F.col("background"), F.col("exif"), F.col("failed"), F.col("ood_status"))
    return rows.select(
        F.col("code").alias("sample_code"), "crop", F.lit(dataset).alias("dataset"), "image_path", "pred_label",
        "pred_conf", "pred_proba", "decision_threshold", features.alias("features"), "ood_status", "borderline",
        framing_ok.alias("framing_ok"), notes.alias("quality_notes"), advice.alias("advice"))


def warnings(px: DataFrame, found: DataFrame, size: int = P.SIZE_PX) -> DataFrame:
    """(image_id, warnings) about framing, per photo."""
    framed = S.normalised(px, found, size)
    share = framed.groupBy("image_id").agg(raster.black_share(framed).alias("black"))
    crop = S.crop_squares(found)
    out = found.join(crop, "image_id").join(share, "image_id")
    padded = ((F.col("x0") < 0) | (F.col("y0") < 0) | (F.col("x0") + F.col("side") > F.col("frame_w"))
              | (F.col("y0") + F.col("side") > F.col("frame_h")))
    return out.select("image_id", R.framing_warnings(F.col("ok"), F.col("touches_edge"), padded, F.col("black")).alias(
        "warnings"))


