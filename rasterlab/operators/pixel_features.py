"""From normalised pixels to one feature row per view and per head."""

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType

from rasterlab import params as P
from rasterlab.functions import colour as C, scalar as S
from rasterlab.operators import components as K, raster as R
from rasterlab.operators.ordered import with_buckets
from rasterlab.session import BROADCAST_ROWS_MAX, cut_lineage

STRIP_ROWS = 50_000  # centroids of a frame that a task takes


@dataclass(frozen=True)
class BlobParams:
    """Scales, limits and areas of the two-scale blob search."""

    fine_window: int = P.FINE_WINDOW_PX
    coarse_window: int = P.COARSE_WINDOW_PX
    fine_k: float = P.FINE_K
    coarse_k: float = P.COARSE_K
    fine_floor: float = P.FINE_FLOOR
    coarse_floor: float = P.COARSE_FLOOR
    dilate: int = P.EXCLUSION_DILATE_PX
    small_min: int = P.SMALL_AREA_MIN_PX
    small_max: int = P.SMALL_AREA_MAX_PX
    large_min: int = P.LARGE_AREA_MIN_PX
    edge: str = "reflect"
    height: int | None = P.SIZE_PX


def prepared(px: DataFrame) -> DataFrame:
    """Channel columns in linear light, brightness, NDFI and the masks."""
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    px = px.select(
        "*", C.linear(r).alias("lin_R"), C.linear(g).alias("lin_G"), C.linear(b).alias("lin_B"),
        C.luminance(r, g, b).alias("lum"), C.in_roi(F.col("x"), F.col("y"), F.col("h")).alias("roi"))
    R_, G_, B_ = F.col("lin_R"), F.col("lin_G"), F.col("lin_B")
    return px.select("*", C.brightness(R_, G_, B_).alias("bright"), C.ndfi(R_, G_, B_).alias("ndfi"),
                     (F.col("roi") & ~C.saturated(r, g, b)).alias("valid"))


def detect_blobs(px: DataFrame, p: BlobParams = BlobParams()) -> tuple[DataFrame, DataFrame]:
    """(small sharp blobs, large blotches) as blob tables, by windows.

    ``px`` needs ``lum`` and ``roi``. Pixels near a large blotch are no small
    blobs.
    """
    base = px.select("image_id", "h", "w", "y", "x", "lum", "roi")
    base = R.box_means(base, "lum", "roi", {"_fine": p.fine_window, "_coarse": p.coarse_window}, p.edge)
    base = R.residual_mask(base, "lum", "_coarse", "roi", p.coarse_k, p.coarse_floor, "_c")
    base = R.residual_mask(base, "lum", "_fine", "roi", p.fine_k, p.fine_floor, "_f")
    # the filters over all pixels run once; what they find is sparse
    found = cut_lineage(base.where(F.col("_c") | F.col("_f")).select("image_id", "y", "x", "_c", "_f"))
    return _blobs(found.repartition("image_id"), p)


def _blobs(found: DataFrame, p: BlobParams) -> tuple[DataFrame, DataFrame]:
    """Blob tables from the pixels above the coarse (``_c``) and the fine
    (``_f``) baseline."""
    coarse = K.label_runs(K.mask_runs(found.where("_c")), 4, p.height)
    large = K.area_filtered(K.blob_table(coarse), p.large_min)
    kept = coarse.join(large.select(*K.LABEL), K.LABEL, "left_semi")
    fine = K.outside(found.where("_f"), K.grown_runs(kept, p.dilate))
    small = K.area_filtered(K.blob_table(K.label_runs(K.mask_runs(fine), 4, p.height)), p.small_min, p.small_max)
    return small, large


def _line_sum(a: np.ndarray, k: int, mode: str) -> np.ndarray:
    """Sums over k neighbours along the first axis."""
    pad = [(k // 2, k // 2), (0, 0)]
    c = np.cumsum(np.pad(np.pad(a, pad, mode=mode), [(1, 0), (0, 0)]), axis=0)
    return c[k:] - c[:-k]


def _above_baseline(lum, roi, k, sds, floor, mode):
    """Pixels of the region above their k x k masked mean."""
    box = lambda a: _line_sum(_line_sum(a, k, mode).T, k, mode).T
    res = lum - box(lum * roi) / np.maximum(box(roi.astype(float)), 1e-6 * k * k)
    return roi & (res > max(sds * res[roi].std(), floor)) if roi.any() else roi


def _dense_udf(p: BlobParams):
    """Filters that look at every pixel's surroundings, on whole frames.

    A frame arrives as one array of ``position << 24 | rgb``; its texture and
    the few pixels above the baselines go back.
    """
    byte = np.arange(256) / 255.0
    light = np.where(byte <= 0.04045, byte / 12.92, ((byte + 0.055) / 1.055) ** 2.4)
    mode = "symmetric" if p.edge == "reflect" else "constant"

    @F.pandas_udf("texture double, hits array<bigint>")
    def scan(cells: pd.Series, hs: pd.Series, ws: pd.Series) -> pd.DataFrame:
        texture, hits = [], []
        for cell, h, w in zip(cells, hs, ws):
            rgb = np.zeros(h * w, np.int64)
            rgb[cell >> 24] = cell & 0xFFFFFF
            r, g, b = (((rgb >> s) & 255).reshape(h, w) for s in (16, 8, 0))
            y, x = np.mgrid[0:h, 0:w]
            roi = np.sqrt((x - h * P.ROI_CENTER[0]) ** 2 + (y - h * P.ROI_CENTER[1]) ** 2) <= h * P.ROI_RADIUS
            valid = roi & (np.maximum(np.maximum(r, g), b) < P.SATURATION)
            bright = np.pad((light[r] + light[g] + light[b]) / 3.0, 1, mode="symmetric")
            lap = bright[:-2, 1:-1] + bright[2:, 1:-1] + bright[1:-1, :-2] + bright[1:-1, 2:] - 4 * bright[1:-1, 1:-1]
            texture.append(float(lap[valid].std()) if valid.any() else 0.0)
            lum = r * 0.2126 + g * 0.7152 + b * 0.0722
            coarse = _above_baseline(lum, roi, p.coarse_window, p.coarse_k, p.coarse_floor, mode)
            fine = _above_baseline(lum, roi, p.fine_window, p.fine_k, p.fine_floor, mode)
            at = np.flatnonzero(coarse | fine)
            hits.append(at * 4 + coarse.ravel()[at] * 2 + fine.ravel()[at])
        return pd.DataFrame({"texture": texture, "hits": hits})
    return scan


def nearest_distances(pts: np.ndarray, dense: int = 32, block: int = 1 << 20) -> np.ndarray:
    """Distance of each point to its nearest other one, inf for a single point.

    Points are looked up in grids: the first is fine enough that a cell holds ``dense`` different points at most; a point that
    finds none in the cells around its own as near as a cell is wide goes on to a grid of twice the width. Those
    that go on are that far from each other, so few of them meet the many points of a crowded place.
    """
    n = len(pts)
    if n < 2:
        return np.full(n, np.inf)
    u, place, count = np.unique(pts, axis=0, return_inverse=True, return_counts=True)
    best = np.where(count > 1, 0.0, np.inf)  # squared; equal points are nearest to each other
    low, span = u.min(axis=0), float(np.ptp(u, axis=0).max())
    if len(u) > 1:
        width = span / np.sqrt(len(u))
        while span / width < 2 ** 28:
            _, held = np.unique(np.floor((u - low) / width).astype(np.int64) @ np.array([1 << 31, 1]), return_counts=True)
            if held.max() <= dense:
                break
            width /= 2
        left = np.flatnonzero(best > 0)
        while len(left):
            cell = np.floor((u - low) / width).astype(np.int64)
            key = (cell + 1) @ np.array([1 << 31, 1])
            order = np.argsort(key, kind="stable")
            ordered = key[order]
            for dx in (-1, 0, 1):
                for dy in (-1, 0, 1):
                    near = key[left] + dx * (1 << 31) + dy
                    lo, hi = np.searchsorted(ordered, near), np.searchsorted(ordered, near, side="right")
                    size = hi - lo
                    ends = np.cumsum(size)
                    at = 0
                    while at < len(left):  # bounded blocks of pairs
                        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + block, side="right")))
                        m = size[at:to]
                        i = np.repeat(left[at:to], m)
                        j = order[np.repeat(lo[at:to], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)]
                        d = ((u[i] - u[j]) ** 2).sum(axis=1)
                        d[i == j] = np.inf
                        np.minimum.at(best, i, d)
                        at = to
            left = left[best[left] > width * width]
            width *= 2
    return np.sqrt(best)[place.ravel()]


def _summed_nearest(t: pa.Table) -> pa.Table:
    """Of one strip: the dots whose nearest other dot may lie beyond it (bound squared), and a row of the sum and number of the others."""
    xy = np.column_stack([t.column(c).to_numpy() for c in ("cx", "cy")]).astype(float)
    d = nearest_distances(xy)
    lo, hi = (t.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("lo", "hi"))  # NaN: no strip on that side
    far = (xy[:, 0] - d <= lo) | (xy[:, 0] + d >= hi) if len(xy) else np.zeros(0, bool)
    key, strip, n = t.column("image_id").slice(0, 1), t.column("strip").slice(0, 1), int(far.sum())
    at = np.flatnonzero(far)
    none = pa.nulls(1, pa.float64())
    return pa.table({
        "image_id": pa.chunked_array([*t.column("image_id").take(at).chunks, *key.chunks]), "strip": pa.chunked_array([*t.column("strip").take(at).chunks, *strip.chunks]),
        "cx": pa.chunked_array([pa.array(xy[at, 0]), none]), "cy": pa.chunked_array([pa.array(xy[at, 1]), none]), "d": pa.chunked_array([pa.array(d[at]), none]),
        "s": pa.array(np.r_[np.full(n, np.nan), d[~far].sum()], from_pandas=True), "n": pa.array(np.r_[np.zeros(n, np.int64), (~far).sum()])})


def _nearer(left: pa.Table, right: pa.Table) -> pa.Table:
    """The searching dots (left) with the distance to the nearest dot of another strip (right), if that is smaller than theirs."""
    d = left.column("d").to_numpy().astype(float)
    if left.num_rows and right.num_rows:
        a, b = (np.column_stack([t.column(c).to_numpy() for c in ("cx", "cy")]).astype(float) for t in (left, right))
        d = np.minimum(d, nearest_of(a, b, d))
    return pa.table({"image_id": left.column("image_id"), "seeker": left.column("seeker"), "d": pa.array(d)})


def nearest_of(a: np.ndarray, b: np.ndarray, bound: np.ndarray, block: int = 1 << 20) -> np.ndarray:
    """Distance of each point of ``a`` to the nearest of ``b`` within its bound, else inf: along x, outwards from its own."""
    b = b[np.argsort(b[:, 0], kind="stable")]
    best, at = bound.astype(float) ** 2, np.searchsorted(b[:, 0], a[:, 0])
    out = np.full(len(a), np.inf)
    for sign, pos in ((1, at), (-1, at - 1)):
        live, pos = np.arange(len(a)), pos.copy()
        width = 1
        while len(live):
            step = pos[:, None] + sign * np.arange(width)
            there = (step >= 0) & (step < len(b))
            y = b[np.clip(step, 0, len(b) - 1)]
            d = np.where(there, ((y - a[live][:, None]) ** 2).sum(axis=2), np.inf).min(axis=1)
            out[live] = np.minimum(out[live], d)
            best[live] = np.minimum(best[live], d)
            last = step[:, -1]
            gap = (b[np.clip(last, 0, len(b) - 1), 0] - a[live, 0]) ** 2
            go = there[:, -1] & (gap <= best[live])
            live, pos = live[go], last[go] + sign
            width = int(np.clip(block // max(1, len(live)) // 4, 1, 2 * width))
    return np.sqrt(out)


def nearest_density(blobs: DataFrame, strip_rows: int = STRIP_ROWS, max_rows: int | None = None) -> DataFrame:
    """(image_id, cluster_density): inverse mean nearest-neighbour distance.

    Frames of more than ``strip_rows`` centroids are cut along x into strips of about as many. A task finds the nearest
    inside its strip; a centroid that is as near to a border of its strip looks into the strips that its distance reaches, and no others. So neither
    rows nor pairs of a whole frame meet in a task. (Equal x stay in one strip.) A caller that knows no frame to have more than ``max_rows`` saves the look.
    """
    dots = blobs.select("image_id", F.col("cx").cast("double").alias("cx"), F.col("cy").cast("double").alias("cy"))
    kind = dots.schema["image_id"].dataType.simpleString()
    cut, strips = with_buckets(dots, ["image_id"], "cx", strip_rows, max_rows)
    if not strips:
        pts = dots.groupBy("image_id").agg(F.collect_list(F.struct("cx", "cy")).alias("_p"))
        near = _mean_nearest(F.col("_p.cx"), F.col("_p.cy"))
        return pts.withColumn("_n", near).select("image_id", F.coalesce(1.0 / (F.col("_n") + 1e-6), F.lit(0.0)).alias("cluster_density"))
    cut = cut.withColumnRenamed("_bucket", "strip")
    ends = cut.groupBy("image_id", "strip").agg(F.min("cx").alias("x0"), F.max("cx").alias("x1"))
    order = Window.partitionBy("image_id").orderBy("strip")  # a row per strip
    ends = cut_lineage(ends.select("image_id", "strip", "x0", "x1", F.lag("x1").over(order).alias("lo"), F.lead("x0").over(order).alias("hi")))
    small = F.broadcast(ends) if strips <= BROADCAST_ROWS_MAX else ends
    held = cut.join(small.select("image_id", "strip", "lo", "hi"), ["image_id", "strip"])
    first = cut_lineage(held.groupBy("image_id", "strip").applyInArrow(
        _summed_nearest, f"image_id {kind}, strip int, cx double, cy double, d double, s double, n long"))
    seekers = first.where(F.col("d").isNotNull()).select("image_id", "strip", "cx", "cy", "d", F.monotonically_increasing_id().alias("seeker"))
    other = small.select(F.col("image_id").alias("_i"), F.col("strip").alias("to"), "x0", "x1")
    reach = (F.col("image_id") == F.col("_i")) & (F.col("strip") != F.col("to")) & (F.col("x0") <= F.col("cx") + F.col("d")) & (F.col("x1") >= F.col("cx") - F.col("d"))
    sent = seekers.join(other, reach).select("image_id", F.col("to").alias("strip"), "seeker", "cx", "cy", "d")
    on = ["image_id", "strip"]
    found = sent.groupBy(*on).cogroup(cut.select(*on, "cx", "cy").groupBy(*on)).applyInArrow(_nearer, f"image_id {kind}, seeker long, d double")
    every = found.unionByName(seekers.select("image_id", "seeker", "d")).groupBy("image_id", "seeker").agg(F.min("d").alias("s"))
    parts = first.where(F.col("d").isNull()).select("image_id", "s", "n").unionByName(every.select("image_id", "s", F.lit(1).cast("long").alias("n")))
    mean = F.sum("s") / F.sum("n")
    return parts.groupBy("image_id").agg(F.when(mean < float("inf"), 1.0 / (mean + 1e-6)).otherwise(0.0).alias("cluster_density"))


@F.pandas_udf(DoubleType())
def _mean_nearest(xs: pd.Series, ys: pd.Series) -> pd.Series:
    """Mean distance to the nearest other point of the same array."""
    out = []
    for x, y in zip(xs, ys):
        d = nearest_distances(np.column_stack([x, y]).astype(float))
        out.append(float(d.mean()) if len(d) > 1 else None)
    return pd.Series(out)


def blob_summary(images: DataFrame, small: DataFrame, large: DataFrame) -> DataFrame:
    """Counts, mean diameters, largest area and clustering per image; an image
    without blobs gets zeros."""
    s = small.groupBy("image_id").agg(F.count(F.lit(1)).alias("n_small_sharp_blobs"),
                                      F.avg(F.col("radius") * 2).alias("avg_small_blob_diam_px"),
                                      F.max("area").alias("_s_max"))
    g = large.groupBy("image_id").agg(F.count(F.lit(1)).alias("n_large_blotches"),
                                      F.avg(F.col("radius") * 2).alias("avg_large_blotch_diam_px"),
                                      F.max("area").alias("_l_max"))
    out = images.join(s, "image_id", "left").join(g, "image_id", "left").join(
        nearest_density(small, max_rows=STRIP_ROWS), "image_id", "left")  # the blobs of a frame that one task has labelled
    cols = ["n_small_sharp_blobs", "n_large_blotches", "avg_small_blob_diam_px", "avg_large_blotch_diam_px",
            "cluster_density"]
    out = out.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cols})
    blob_max = F.greatest(F.coalesce("_s_max", F.lit(0)), F.coalesce("_l_max", F.lit(0))).cast("double")
    return out.select("image_id", *cols, blob_max.alias("blob_max"),
                      S.small_share(F.col("n_small_sharp_blobs"), F.col("n_large_blotches")).alias("ratio_small_to_large"))


def _only(cond, value):
    return F.when(F.col(cond), F.col(value))


def _quantile(values: str, p: float):
    """Interpolated quantile of a sorted array column."""
    rank = (F.size(values) - 1) * F.lit(float(p))
    lo, hi = F.get(values, F.floor(rank).cast("int")), F.get(values, F.ceil(rank).cast("int"))
    return lo + (hi - lo) * (rank - F.floor(rank))


def _share(values: str, beyond):
    return F.try_divide(F.size(F.filter(values, beyond)), F.size(values))


@dataclass(frozen=True)
class Feature:
    """A feature of a frame: its name and what builds it. ``order`` 0: an aggregate over prepared pixels;
    1: an expression over the sorted arrays ``_valid``, ``_roi``, ``_ndfi``, the median ``_med`` and ``_spread``."""
    name: str
    builder: Callable[[], Column]
    order: int = 0


def _mean_of(c: str, cond: str = "valid"):
    return lambda: F.avg(_only(cond, c))


def _sd_of(c: str, cond: str = "valid"):
    return lambda: F.stddev_pop(_only(cond, c))


#: every colour feature once: the aggregates, the output columns and the check of both follow from this list
COLOUR_LIST = [
    *[Feature(f"mean_{c}", _mean_of(f"lin_{c}")) for c in "RGB"], *[Feature(f"sd_{c}", _sd_of(f"lin_{c}")) for c in "RGB"],
    Feature("brightness_mean", _mean_of("bright")), Feature("brightness_sd", _sd_of("bright")),
    Feature("NDFI_mean", _mean_of("ndfi", "roi")),
    Feature("A_high", lambda: _share("_roi", lambda v: v > F.col("_med") + F.col("_spread")), 1),
    Feature("A_low", lambda: _share("_roi", lambda v: v < F.col("_med") - F.col("_spread")), 1),
    Feature("F_p95", lambda: _quantile("_roi", 0.95), 1), Feature("F_p05", lambda: _quantile("_roi", 0.05), 1),
    Feature("NDFI_p95", lambda: _quantile("_ndfi", 0.95), 1), Feature("NDFI_p05", lambda: _quantile("_ndfi", 0.05), 1)]


def checked(features: list[Feature]) -> list[Feature]:
    names = [f.name for f in features]
    if twice := sorted({n for n in names if names.count(n) > 1}):
        raise ValueError(f"features listed twice: {twice}")
    if bad := [n for n in names if n.startswith("_") or n == "image_id"]:
        raise ValueError(f"names that features cannot have: {bad}")
    return features


def _colour_aggs(features: list[Feature] = COLOUR_LIST):
    """One aggregate plan over prepared pixels; what needs an order gathers a frame's worth of numbers."""
    return [f.builder().alias(f.name) for f in checked(features) if f.order == 0] + [
        F.sort_array(F.collect_list(_only("valid", "bright"))).alias("_valid"),
        F.sort_array(F.collect_list(_only("roi", "bright"))).alias("_roi"),
        F.sort_array(F.collect_list(_only("roi", "ndfi"))).alias("_ndfi")]


def _ordered_features(out: DataFrame, keep=(), features: list[Feature] = COLOUR_LIST) -> DataFrame:
    """What the sorted arrays give; an image without pixels in a mask gets zeros."""
    out = out.withColumn("_med", F.coalesce(_quantile("_valid", 0.5), F.lit(0.0)))
    out = out.withColumn("_dev", F.sort_array(F.transform("_valid", lambda v: F.abs(v - F.col("_med")))))
    out = out.withColumn("_spread", F.coalesce(_quantile("_dev", 0.5), F.lit(0.0)) * P.MAD_SCALE * P.ANOMALY_K)
    out = out.withColumns({f.name: f.builder() for f in features if f.order == 1})
    return out.select("image_id", *keep, *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in out.columns
                                           if c not in ("image_id", *keep) and not c.startswith("_")])


def colour_stats(px: DataFrame, features: list[Feature] = COLOUR_LIST) -> DataFrame:
    """The listed features and the texture (by windows) per image. One pass over the pixels."""
    return _ordered_features(R.laplacian(px, "bright").groupBy("image_id").agg(
        *_colour_aggs(features), F.stddev_pop(_only("valid", "lap")).alias("texture")), features=features)


def frame_stats(px: DataFrame, p: BlobParams = BlobParams()) -> tuple[DataFrame, DataFrame]:
    """(the same features, pixels above the blob baselines) with each frame as
    one value.

    One aggregation by image is all that touches the pixels: no sort and no
    window. The rows it leaves are small and are materialised.
    """
    rgb = F.shiftleft("r", 16) + F.shiftleft("g", 8) + F.col("b")
    cell = F.shiftleft((F.col("y") * F.col("w") + F.col("x")).cast("bigint"), 24) + rgb
    out = px.groupBy("image_id").agg(*_colour_aggs(), F.collect_list(cell).alias("_cells"), F.max("h").alias("_h"),
                                     F.max("w").alias("_w"))
    out = out.withColumn("_d", _dense_udf(p)("_cells", "_h", "_w")).withColumn("texture", F.col("_d.texture"))
    out = out.withColumns({"width": F.col("_w"), "hits": F.col("_d.hits")})
    out = cut_lineage(_ordered_features(out, ["width", "hits"]))
    at = F.shiftright("_hit", 2)
    found = out.repartition("image_id").select("image_id", "width", F.explode("hits").alias("_hit")).select(
        "image_id", F.floor(at / F.col("width")).cast("int").alias("y"), F.pmod(at, F.col("width")).cast("int").alias("x"),
        (F.col("_hit").bitwiseAND(F.lit(2)) != 0).alias("_c"), (F.col("_hit").bitwiseAND(F.lit(1)) != 0).alias("_f"))
    return out.drop("width", "hits"), found


def view_features(px: DataFrame, p: BlobParams = BlobParams(), whole_frames: bool = True) -> tuple[DataFrame, DataFrame]:
    """(one row of the 23 view features per image, its small blobs).

    ``whole_frames`` runs the neighbourhood filters on each frame as one value,
    which is much faster; without it they run as windows over the pixel table,
    which has no limit on the size of a frame.
    """
    px = prepared(px)
    if whole_frames:
        colours, found = frame_stats(px, p)
        small, large = _blobs(found, p)
    else:
        small, large = detect_blobs(px, p)
        colours = colour_stats(px)
    out = colours.join(blob_summary(colours.select("image_id"), small, large), "image_id")
    return out.select("image_id", *P.VIEW_FEATURES), small


def exclusive_fraction(views: DataFrame, small: DataFrame, companion: DataFrame, size: int = P.SIZE_PX) -> DataFrame:
    """(image_id, uv_exclusive_dot_frac): share of small blobs whose centre is
    not discoloured in the companion frame.

    ``views`` is (image_id, has_companion); ``companion`` holds the discoloured
    pixels (image_id, y, x). Without a companion the value is -1, without
    blobs it is 0.
    """
    def at(c):
        return F.least(F.greatest(F.rint(c), F.lit(0)), F.lit(size - 1)).cast("int")
    spots = companion.select("image_id", "y", "x", F.lit(1).alias("_on")).distinct()
    hits = small.select("image_id", at("cy").alias("y"), at("cx").alias("x")).join(spots, ["image_id", "y", "x"], "left")
    frac = hits.groupBy("image_id").agg((1 - F.avg(F.coalesce("_on", F.lit(0)))).alias("_f"))
    return views.join(frac, "image_id", "left").select(
        "image_id", F.when(~F.col("has_companion"), F.lit(P.NO_VISIBLE)).otherwise(
            F.coalesce("_f", F.lit(0.0))).alias("uv_exclusive_dot_frac"))


def discoloured_pixels(px: DataFrame) -> DataFrame:
    """Discoloured pixels inside the region of interest."""
    roi = C.in_roi(F.col("x"), F.col("y"), F.col("h"))
    return px.where(roi & C.discoloured(F.col("r"), F.col("g"), F.col("b"))).select("image_id", "y", "x")
