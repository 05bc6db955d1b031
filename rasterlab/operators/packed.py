"""Subject search on packed frames: one frame is one array in one row, whatever its size.

A frame row is (image_id, crop, kind, h, w, rgb): ``rgb`` holds 0xRRGGBB row by row. Frames stay where they
were read and go through a task one at a time; height, width and the kernels that follow from them are values of
the row, so one pass finds the subjects of all sizes, crops and kinds. Line sums, closing and opening are
differences of running totals, components are joined runs. A row leaves per frame, or the runs of its mask.

Frames with no rule for their (crop, kind), without pixels, or whose array does not fit ``h`` x ``w``
have no row in the result of ``mask_runs`` and a ``not_found`` record in that of ``found``.
"""

import functools
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rasterlab import params as P
from rasterlab.operators.components import _roots
from rasterlab.operators.raster import kernel_scale

Rule = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]

_BYTE = np.arange(256) / 255.0
_LINEAR = np.where(_BYTE <= 0.04045, _BYTE / 12.92, ((_BYTE + 0.055) / 1.055) ** 2.4)


def frame_rows(photos: DataFrame) -> DataFrame:
    """Packed upright frames of decoded photos (..., h, w, channels, data[, orientation])."""
    from rasterlab.sources.images import packed_rgb

    return photos.withColumn("rgb", packed_rgb(photos)).drop("data", "channels", "orientation")


def border(v: np.ndarray, frac: float = P.BORDER_FRAC) -> tuple[float, float]:
    """Mean and population SD of the four border strips; corners count twice."""
    bh, bw = max(1, int(v.shape[0] * frac)), max(1, int(v.shape[1] * frac))
    strips = np.concatenate([s.ravel() for s in (v[:bh], v[-bh:], v[:, :bw], v[:, -bw:])])
    return float(strips.mean()), float(strips.std())


def gray_byte(r, g, b) -> np.ndarray:
    return np.rint(np.round(r * 0.299 + g * 0.587 + b * 0.114, 6))


def lab_a(r, g, b) -> np.ndarray:
    """CIELAB a* as a byte with offset 128."""
    lr, lg, lb = _LINEAR[r], _LINEAR[g], _LINEAR[b]

    def curve(t):
        return np.where(t > 0.008856, np.cbrt(t), t * 7.787 + 16.0 / 116.0)
    fx = curve((lr * 0.412453 + lg * 0.357580 + lb * 0.180423) / 0.950456)
    return np.rint((fx - curve(lr * 0.212671 + lg * 0.715160 + lb * 0.072169)) * 500.0 + 128.0)


def otsu(values: np.ndarray, min_values: int = P.OTSU_MIN_VALUES) -> float | None:
    """The cut with the largest between-class variance, the lowest on ties; None for too few values."""
    if len(values) < min_values:
        return None
    n = np.bincount(np.clip(values, 0, 255).astype(np.int64), minlength=256)
    level = np.flatnonzero(n)
    n1, s1 = np.cumsum(n[level]), np.cumsum(n[level] * level)
    n2 = n1[-1] - n1
    gap = s1 / n1 - (s1[-1] - s1) / np.maximum(n2, 1)
    return float(level[np.argmax(np.round(np.where(n2 > 0, n1 * n2 * gap * gap, 0.0), 6))])


def _line_sums(v: np.ndarray, r: int, axis: int) -> np.ndarray:
    """Sums over [-r, r] along an axis; outside the frame nothing counts."""
    n = v.shape[axis]
    run = np.concatenate([np.zeros_like(v, np.int64).take([0], axis), np.cumsum(v, axis=axis, dtype=np.int64)], axis)
    at = np.arange(n)
    return run.take(np.minimum(at + r + 1, n), axis) - run.take(np.maximum(at - r, 0), axis)


def _square(mask: np.ndarray, r: int, grow: bool) -> np.ndarray:
    for axis in (1, 0):
        s = _line_sums(mask, r, axis)
        if grow:
            mask = s > 0
        else:
            at = np.arange(mask.shape[axis])
            inside = np.minimum(at + r, mask.shape[axis] - 1) - np.maximum(at - r, 0) + 1
            mask = s == (inside if axis else inside[:, None])
    return mask


def closed(mask: np.ndarray, k: int) -> np.ndarray:
    return _square(_square(mask, k // 2, True), k // 2, False)


def opened(mask: np.ndarray, k: int) -> np.ndarray:
    return _square(_square(mask, k // 2, False), k // 2, True)


def cleaned(mask: np.ndarray) -> np.ndarray:
    k = kernel_scale(*mask.shape)
    return opened(closed(mask, 2 * k + 1), k)


def runs_of(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(y, x0, x1) of the masked runs of every line."""
    edge = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    y, x0 = np.nonzero(edge == 1)
    return y, x0, np.nonzero(edge == -1)[1] - 1


def labelled(mask: np.ndarray, neighbours: int = 8):
    """(y, x0, x1, label) of the runs; a component's label is its first run."""
    y, x0, x1 = runs_of(mask)
    reach, span = int(neighbours == 8), mask.shape[1] + 4
    lo = np.searchsorted(y * span + x1, (y + 1) * span + x0 - reach)
    hi = np.searchsorted(y * span + x0, (y + 1) * span + x1 + reach, side="right")
    count = np.maximum(hi - lo, 0)
    a = np.repeat(np.arange(len(y)), count)
    b = np.repeat(lo, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return y, x0, x1, _roots(len(y), a, b)


def painted(shape, y, x0, x1) -> np.ndarray:
    edge = np.zeros((shape[0], shape[1] + 1), np.int32)
    np.add.at(edge, (y, x0), 1)
    np.add.at(edge, (y, x1 + 1), -1)
    return np.cumsum(edge, axis=1)[:, :-1] > 0


def _any_of(mask: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """The 8-connected components of a mask that hold a seed."""
    y, x0, x1, label = labelled(mask)
    total = np.pad(np.cumsum(seed, axis=1), ((0, 0), (1, 0)))
    hit = total[y, x1 + 1] > total[y, x0]
    keep = np.isin(label, label[hit])
    return painted(mask.shape, y[keep], x0[keep], x1[keep])


def uv(r, g, b, k: float = P.DETECT_K) -> np.ndarray:
    """Red or green clearly above the border of the frame."""
    out = np.zeros(r.shape, bool)
    for v in (r, g):
        mean, sd = border(v)
        out |= v > mean + max(sd, 1.0) * k
    return out


def visible(r, g, b, k: float = P.DETECT_K, floor: float = P.VISIBLE_MIN_ABS_A) -> np.ndarray:
    """Redder than the border, on the lightness-free a* axis."""
    a = lab_a(r, g, b)
    mean, sd = border(a)
    return a > mean + max(sd * k, float(floor))


def garlic_uv(r, g, b, k: float = P.DETECT_K, grow: float = P.GARLIC_GROW, min_values: int = P.OTSU_MIN_VALUES) -> np.ndarray:
    """Green core by the image's own histogram cut, grown into its dim rim."""
    mean, sd = border(g)
    lit = g > mean + max(sd, 1.0) * k
    cut = otsu(g[lit], min_values)
    return np.zeros(g.shape, bool) if cut is None else _any_of(lit & (g > cut * grow), lit & (g > cut))


def garlic_visible(r, g, b, window: float = P.GARLIC_WINDOW_FRAC, min_area: float = P.GARLIC_VISIBLE_MIN_AREA_FRAC,
                   min_values: int = P.OTSU_MIN_VALUES) -> np.ndarray:
    """Brighter than its surroundings inside the centre window, less what reaches the window's border and specks,
    unless nothing would remain."""
    (h, w), out = r.shape, np.zeros(r.shape, bool)
    y0, y1, x0, x1 = (int(np.floor(n * (0.5 + s * window / 2))) for n in (h, w) for s in (-1, 1))
    lum = gray_byte(r, g, b)[y0:y1, x0:x1]
    if not lum.size:
        return out
    lum = lum - lum.min()
    cut = otsu(lum.ravel(), min_values)
    if cut is None:
        return out
    y, a, e, label = labelled(lum > cut)
    if not len(y):
        return out
    rim = (y == 0) | (y == y1 - y0 - 1) | (a == 0) | (e == x1 - x0 - 1)
    n = np.bincount(label, weights=e - a + 1, minlength=len(y))
    touch = np.bincount(label, weights=rim, minlength=len(y)) > 0
    good = (~touch & (n >= h * w * min_area))[label]
    if good.any():
        y, a, e = y[good], a[good], e[good]
    out[y0:y1, x0:x1] = painted(lum.shape, y, a, e)
    return out


RULES: dict[tuple[str, str], Rule] = {("onion", "uv"): uv, ("onion", "visible"): visible,
                                      ("garlic", "uv"): garlic_uv, ("garlic", "visible"): garlic_visible}
MIN_AREA = {("garlic", "visible"): P.GARLIC_VISIBLE_MIN_AREA_FRAC}


def _frames(batches, rules):
    """(row values but rgb, rule, (r, g, b)) of each frame of Arrow batches (image_id, crop, kind, h, w, rgb)."""
    for batch in batches:
        for i in range(batch.num_rows):
            image, crop, kind, h, w = (batch.column(c)[i].as_py() for c in range(5))
            rgb = batch.column(5)[i].values
            rgb = np.zeros(0, np.int32) if rgb is None else rgb.to_numpy(zero_copy_only=False)
            rule = rules.get((crop, kind))
            if rule is None or not len(rgb) or None in (h, w) or len(rgb) != h * w:
                yield image, crop, kind, h, w, None, None
            else:
                yield image, crop, kind, h, w, rule, [((rgb >> s) & 255).reshape(h, w) for s in (16, 8, 0)]


def _columns(frames: DataFrame) -> DataFrame:
    return frames.select("image_id", "crop", "kind", F.col("h").cast("int"), F.col("w").cast("int"), F.col("rgb").cast("array<int>"))


def mask_runs(frames: DataFrame, rules: dict | None = None, clean: bool = False) -> DataFrame:
    """(image_id, y, x0, x1): the runs of each frame's mask by the rule of its (crop, kind)."""
    rules = RULES if rules is None else rules
    kind = frames.schema["image_id"].dataType.simpleString()

    def run(batches):
        for image, _, _, _, _, rule, planes in _frames(batches, rules):
            if rule is None:
                continue
            mask = rule(*planes)
            y, x0, x1 = runs_of(cleaned(mask) if clean else mask)
            yield pa.RecordBatch.from_pydict({"image_id": pa.array([image] * len(y), _ID[kind]), "y": pa.array(y, pa.int32()),
                                              "x0": pa.array(x0, pa.int32()), "x1": pa.array(x1, pa.int32())})
    return _columns(frames).mapInArrow(run, f"image_id {kind}, y int, x0 int, x1 int")


_ID = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}


def _record(mask: np.ndarray, gray: np.ndarray, min_area: float, min_radius, max_radius) -> dict:
    h, w = mask.shape
    y, x0, x1, label = labelled(mask)
    out = {"ok": False, "reason": "not_found", "area": None, "area_frac": None, "bbox": None, "touches_edge": [],
           "radius_frac_of_frame": None, "cx": w / 2.0, "cy": h / 2.0, "radius": min(h, w) * P.FALLBACK_RADIUS_FRAC}
    obj = mask
    if len(y):
        area = np.bincount(label, weights=x1 - x0 + 1, minlength=len(y))
        best = int(area.argmax())  # the first component of the largest
        out |= {"area": int(area[best]), "area_frac": area[best] / (h * w), "reason": "too_small"}
        if area[best] >= min_area * h * w:
            mine = label == best
            left, right, top, bottom = (int(v) for v in (x0[mine].min(), x1[mine].max(), y[mine].min(), y[mine].max()))
            bw, bh = right - left + 1, bottom - top + 1
            radius = max(bw, bh) / 2.0
            frac = radius / (min(h, w) / 2.0)
            reason = "radius_small" if min_radius is not None and frac < min_radius else (
                "radius_large" if max_radius is not None and frac > max_radius else None)
            touches = [n for n, c in (("left", left <= 1), ("top", top <= 1), ("right", left + bw >= w - 1), ("bottom", top + bh >= h - 1)) if c]
            out |= {"ok": reason is None, "reason": reason, "bbox": {"x": left, "y": top, "w": bw, "h": bh}, "touches_edge": touches,
                    "radius_frac_of_frame": frac}
            if reason is None:
                out |= {"cx": left + bw / 2.0, "cy": top + bh / 2.0, "radius": radius}
            obj = closed(painted(mask.shape, y[mine], x0[mine], x1[mine]), 3 * kernel_scale(h, w))
    outside = gray[~obj]  # of the whole mask where the subject is too small
    return out | {"bg_level": float(np.median(outside)) if outside.size else None}


FOUND_DDL = ("ok boolean, reason string, area bigint, area_frac double, bbox struct<x: int, y: int, w: int, h: int>, "
             "touches_edge array<string>, radius_frac_of_frame double, cx double, cy double, radius double, bg_level double")
_BOX = pa.struct([(n, pa.int32()) for n in "xywh"])
_FOUND = {"ok": pa.bool_(), "reason": pa.string(), "area": pa.int64(), "area_frac": pa.float64(), "bbox": _BOX,
          "touches_edge": pa.list_(pa.string()), "radius_frac_of_frame": pa.float64(), "cx": pa.float64(), "cy": pa.float64(),
          "radius": pa.float64(), "bg_level": pa.float64()}


def found(frames: DataFrame, rules: dict | None = None, min_area: float = P.MIN_AREA_FRAC, min_radius: float | None = P.MIN_RADIUS_FRAC,
          max_radius: float | None = P.MAX_RADIUS_FRAC) -> DataFrame:
    """One record per frame: where its subject is or why it was not found, and the background level outside it."""
    rules = RULES if rules is None else rules
    kind = frames.schema["image_id"].dataType.simpleString()
    _find = functools.partial(_record, min_radius=min_radius, max_radius=max_radius)

    def run(batches):
        for image, crop, light, h, w, rule, planes in _frames(batches, rules):
            if rule is None:
                size = (h or 0, w or 0)
                got = {n: None for n in _FOUND} | {"ok": False, "reason": "not_found", "touches_edge": [], "cx": size[1] / 2.0, "cy": size[0] / 2.0,
                                                   "radius": min(size) * P.FALLBACK_RADIUS_FRAC}
            else:
                got = _find(cleaned(rule(*planes)), gray_byte(*planes), MIN_AREA.get((crop, light), min_area))
            row = {"image_id": pa.array([image], _ID[kind])} | {n: pa.array([got[n]], t) for n, t in _FOUND.items()}
            row |= {"frame_h": pa.array([h], pa.int32()), "frame_w": pa.array([w], pa.int32())}
            yield pa.RecordBatch.from_pydict(row)
    return _columns(frames).mapInArrow(run, f"image_id {kind}, {FOUND_DDL}, frame_h int, frame_w int")
