"""Raster algebra on a pixel table.

A raster is one row per pixel: ``image_id, h, w, y, x`` and value columns,
dense over the frame. A frame is at most one sensor readout, so a window over
one row, one column or one image is bounded; the number of images is not, and
every operator is keyed by ``image_id`` alone. Lay the encoded frames out by
image before exploding them (``clustered``) and no operator here moves pixels
again.

Sums over a k-wide window come from running totals, so their cost does not
depend on k.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from rasterlab import params as P
from rasterlab.functions import colour as C

PIXEL = ["image_id", "y", "x"]


def clustered(frames: DataFrame, partitions: int | None = None) -> DataFrame:
    """Hash the compact frames by image; an explode keeps the layout."""
    return frames.repartition(partitions, "image_id") if partitions else frames.repartition("image_id")


def _line(axis: str):
    across, along = ("y", "x") if axis == "x" else ("x", "y")
    return Window.partitionBy("image_id", across).orderBy(along)


def line_sums(df: DataFrame, sums: dict[str, tuple[str, int]], axis: str) -> DataFrame:
    """Add, for each ``name: (column, r)``, the sum over [-r, r] along the axis.

    Pixels outside the frame do not count.
    """
    w = _line(axis)
    cols = sorted({c for c, _ in sums.values()})
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    df = df.select("*", *[F.sum(c).over(run).alias(f"_run_{c}") for c in cols],
                   *[F.sum(c).over(whole).alias(f"_all_{c}") for c in cols])
    out = {}
    for name, (c, r) in sums.items():
        hi = F.coalesce(F.lead(f"_run_{c}", r).over(w), F.col(f"_all_{c}"))
        lo = F.coalesce(F.lag(f"_run_{c}", r + 1).over(w), F.lit(0))
        out[name] = hi - lo
    return df.withColumns(out).drop(*[f"_{k}_{c}" for c in cols for k in ("run", "all")])


def reflected(df: DataFrame, r: int, axis: str) -> DataFrame:
    """Frame extended by ``r`` mirrored pixels on both ends of the axis; the
    edge pixel is repeated."""
    size = "w" if axis == "x" else "h"
    a, n = F.col(axis), F.col(size)
    turns = F.floor(F.lit(r) / (n * 2)).cast("int") + 1
    once = F.array_compact(F.array(a, F.when(a < r, -1 - a), F.when(a >= n - r, 2 * n - 1 - a)))
    many = F.flatten(F.transform(F.sequence(-turns, turns), lambda t: F.array(a + 2 * n * t, -1 - a + 2 * n * t)))
    keep = [c for c in df.columns if c != axis]
    at = F.when(n >= r, once).otherwise(many)  # a frame narrower than the window is mirrored repeatedly
    return df.select(*keep, F.explode(at).alias(axis)).where((F.col(axis) >= -r) & (F.col(axis) < n + r))


def box_means(df: DataFrame, value: str, mask: str, windows: dict[str, int], edge: str = "reflect") -> DataFrame:
    """Mean of ``value`` over k x k windows, counting masked pixels only.

    ``windows`` maps an output name to its odd k. ``edge="reflect"`` mirrors
    the frame at its border; ``edge="zero"`` lets nothing beyond it count.
    """
    radius = {n: k // 2 for n, k in windows.items()}
    top = max(radius.values())
    df = df.withColumns({"_m": F.col(mask).cast("double"), "_v": F.col(value) * F.col(mask).cast("double")})
    for axis, src, dst in (("x", lambda n: ("_v", "_m"), "_a"), ("y", lambda n: (f"_a_v_{n}", f"_a_m_{n}"), "_b")):
        size = "w" if axis == "x" else "h"
        if edge == "reflect":
            df = reflected(df, top, axis)
        sums = {}
        for n, r in radius.items():
            v, m = src(n)
            sums[f"{dst}_v_{n}"], sums[f"{dst}_m_{n}"] = (v, r), (m, r)
        df = line_sums(df, sums, axis)
        if edge == "reflect":
            df = df.where((F.col(axis) >= 0) & (F.col(axis) < F.col(size)))
    for n, k in windows.items():
        df = df.withColumn(n, F.col(f"_b_v_{n}") / F.greatest(F.col(f"_b_m_{n}"), F.lit(1e-6 * k * k)))
    return df.drop("_m", "_v", *[f"_{s}_{c}_{n}" for s in "ab" for c in "vm" for n in windows])


def residual_mask(df: DataFrame, value: str, baseline: str, mask: str, k: float, floor: float, out: str) -> DataFrame:
    """Pixels of the mask above their baseline by ``max(k * sd, floor)``, the
    population SD taken over the image's masked residuals."""
    res = F.col(value) - F.col(baseline)
    sd = F.stddev_pop(F.when(F.col(mask), res)).over(Window.partitionBy("image_id"))
    limit = F.greatest(F.coalesce(sd * k, F.lit(0.0)), F.lit(float(floor)))
    return df.withColumn("_sd", limit).withColumn(out, F.col(mask) & (res > F.col("_sd"))).drop("_sd")


def laplacian(df: DataFrame, value: str, out: str = "lap") -> DataFrame:
    """Five-point Laplacian; a missing neighbour is the pixel itself."""
    v = F.col(value)

    def pair(axis):
        w = _line(axis)
        return F.coalesce(F.lag(v).over(w), v) + F.coalesce(F.lead(v).over(w), v) - 2 * v
    return df.withColumn("_lx", pair("x")).withColumn(out, F.col("_lx") + pair("y")).drop("_lx")


def _square(df: DataFrame, mask: str, r: int, axes: str, grow: bool) -> DataFrame:
    """Dilate or erode a mask by a (2r+1) square; outside never counts."""
    for axis in axes:
        n, pos = ("w", "x") if axis == "x" else ("h", "y")
        df = df.withColumn("_i", F.col(mask).cast("int"))
        df = line_sums(df, {"_s": ("_i", r)}, axis)
        if grow:
            hit = F.col("_s") > 0
        else:
            inside = F.least(F.col(pos) + r, F.col(n) - 1) - F.greatest(F.col(pos) - r, F.lit(0)) + 1
            hit = F.col("_s") == inside
        df = df.withColumn(mask, hit).drop("_i", "_s")
    return df


def closed(df: DataFrame, mask: str, k: int) -> DataFrame:
    """Closing by a k x k square, k odd."""
    return _square(_square(df, mask, k // 2, "xy", True), mask, k // 2, "yx", False)


def opened(df: DataFrame, mask: str, k: int) -> DataFrame:
    """Opening by a k x k square, k odd."""
    return _square(_square(df, mask, k // 2, "xy", False), mask, k // 2, "yx", True)


# The share of the shorter side that a kernel spans, and the smallest kernel.
KERNEL_SHARE, KERNEL_MIN = 0.012, 3


def kernel_scale(h: int, w: int) -> int:
    """Kernel size that follows the frame, always odd."""
    return max(KERNEL_MIN, int(round(min(h, w) * KERNEL_SHARE)) | 1)


def dilated_cross(df: DataFrame, mask: str, n: int, out: str) -> DataFrame:
    """Pixels within city-block distance ``n`` of the mask.

    The distance along a row is known from the nearest masked pixel on either
    side; its minimum over the 2n+1 rows around completes it.
    """
    w = _line("x")
    at = F.when(F.col(mask), F.col("x"))
    left = F.last(at, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    right = F.first(at, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    df = df.withColumn("_d", F.least(F.col("x") - left, right - F.col("x")))
    v = _line("y")
    up = F.min(F.col("_d") - F.col("y")).over(v.rowsBetween(-n, 0)) + F.col("y")
    down = F.min(F.col("_d") + F.col("y")).over(v.rowsBetween(0, n)) - F.col("y")
    return df.withColumn(out, F.coalesce(F.least(up, down) <= n, F.lit(False))).drop("_d")


def _border_times(frac: float) -> Column:
    """In how many of the four border strips a pixel lies."""
    bh = F.greatest(F.lit(1), F.floor(F.col("h") * frac).cast("int"))
    bw = F.greatest(F.lit(1), F.floor(F.col("w") * frac).cast("int"))
    strips = [F.col("y") < bh, F.col("y") >= F.col("h") - bh, F.col("x") < bw, F.col("x") >= F.col("w") - bw]
    return sum((c.cast("int") for c in strips[1:]), strips[0].cast("int"))


def border_stats(df: DataFrame, values: list[str], frac: float = P.BORDER_FRAC) -> DataFrame:
    """Mean and population SD of the frame's four border strips, per image.

    The strips overlap in the corners, so a corner pixel counts twice.
    """
    strips = df.select("image_id", *values, F.explode(F.array_repeat(F.lit(1), _border_times(frac))).alias("_one"))
    return strips.groupBy("image_id").agg(*[a for v in values for a in (
        F.avg(v).alias(f"{v}_mean"), F.stddev_pop(v).alias(f"{v}_sd"))])


def with_border_stats(df: DataFrame, values: list[str], frac: float = P.BORDER_FRAC) -> DataFrame:
    """The same statistics beside every pixel, by windows over the image: no
    join, and the pixels are computed once."""
    w = Window.partitionBy("image_id")
    df = df.withColumn("_times", _border_times(frac))
    t = F.col("_times")
    df = df.withColumns({f"{v}_mean": F.sum(F.col(v) * t).over(w) / F.sum(t).over(w) for v in values})
    dev = {v: (F.col(v) - F.col(f"{v}_mean")) for v in values}
    df = df.withColumns({f"{v}_sd": F.sqrt(F.sum(d * d * t).over(w) / F.sum(t).over(w)) for v, d in dev.items()})
    return df.drop("_times")


def otsu(df: DataFrame, value: str, min_values: int = P.OTSU_MIN_VALUES) -> DataFrame:
    """(image_id, threshold): the cut of each image's 0-255 histogram with the
    largest between-class variance, the lowest on ties. NULL for images with
    fewer than ``min_values`` pixels."""
    v = F.floor(F.least(F.greatest(F.col(value), F.lit(0)), F.lit(255))).cast("int")
    hist = df.groupBy("image_id", v.alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy("image_id").orderBy("_v")  # at most 256 rows
    run, whole = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing)
    s = F.col("_v") * F.col("_n")
    c = hist.select("image_id", "_v", F.sum("_n").over(run).alias("n1"), F.sum("_n").over(whole).alias("n"),
                    F.sum(s).over(run).alias("s1"), F.sum(s).over(whole).alias("s"))
    n2 = F.col("n") - F.col("n1")
    gap = F.col("s1") / F.col("n1") - F.try_divide(F.col("s") - F.col("s1"), n2)
    between = F.coalesce(F.col("n1") * n2 * gap * gap, F.lit(0.0))
    return c.groupBy("image_id").agg(
        F.max(F.struct(F.round(between, 6).alias("b"), (-F.col("_v")).alias("v"))).alias("_best"),
        F.max("n").alias("_n")).select(
        "image_id", F.when(F.col("_n") >= min_values, -F.col("_best.v")).cast("double").alias("threshold"))


def framed(df: DataFrame, crops: DataFrame, values: list[str], size: int = P.SIZE_PX) -> DataFrame:
    """Cut a square per image and resample it to ``size`` x ``size``.

    ``crops`` is (image_id, x0, y0, side); the square may leave the frame, and
    what lies outside is black. Shrinking averages by area, enlarging is
    bilinear. Each source pixel is sent to the target cells it contributes to
    with its weight, so no target grid is joined; an all-zero grid is added
    only for squares that leave the frame.
    """
    src = df.select("image_id", "h", "w", "y", "x", *values).join(crops, "image_id")
    for axis, start in (("x", "x0"), ("y", "y0")):
        src = _spread(src.withColumn("_p", F.col(axis) - F.col(start)), size, f"_t{axis}", f"_w{axis}")
    wt = F.col("_wx") * F.col("_wy")
    outside = ((F.col("x0") < 0) | (F.col("y0") < 0) | (F.col("x0") + F.col("side") > F.col("w"))
               | (F.col("y0") + F.col("side") > F.col("h")))
    dims = df.groupBy("image_id").agg(F.max("h").alias("h"), F.max("w").alias("w")).join(crops, "image_id")
    grid = (dims.where(outside)
            .select("image_id", F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("_ty"))
            .select("image_id", "_ty", F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("_tx"),
                    *[F.lit(0.0).alias(v) for v in values]))
    parts = src.select("image_id", "_ty", "_tx", *[(F.col(v) * wt).alias(v) for v in values]).unionByName(grid)
    out = parts.groupBy("image_id", "_ty", "_tx").agg(*[F.sum(v).alias(v) for v in values])
    return out.select("image_id", F.lit(size).alias("h"), F.lit(size).alias("w"),
                      F.col("_ty").cast("int").alias("y"), F.col("_tx").cast("int").alias("x"), *values)


def _spread(df: DataFrame, size: int, target: str, weight: str) -> DataFrame:
    """Target cells along one axis of the source position ``_p`` in a crop of
    ``side`` pixels, with weights that sum to 1 over the source."""
    p, side = F.col("_p"), F.col("side")
    step = side / F.lit(float(size))  # source pixels per target cell
    inside = df.where((p >= 0) & (p < side))
    shrink = side > size
    # a source pixel [p, p+1) overlaps cells floor(p/step) .. ceil((p+1)/step)-1;
    # when enlarging it is one of the two neighbours of every cell centre within 1
    lo = F.when(shrink, F.floor(p / step)).otherwise(F.ceil((p - 0.5) / step - 0.5))
    hi = F.when(shrink, F.ceil((p + 1) / step) - 1).otherwise(F.floor((p + 1.5) / step - 0.5))
    lo = F.when(~shrink & (p == 0), F.lit(0)).otherwise(F.greatest(lo, F.lit(0)))
    hi = F.when(~shrink & (p == side - 1), F.lit(size - 1)).otherwise(F.least(hi, F.lit(size - 1)))
    out = inside.withColumns({"_lo": lo.cast("int"), "_hi": hi.cast("int")}).where(F.col("_lo") <= F.col("_hi"))
    out = out.withColumn(target, F.explode(F.sequence("_lo", "_hi")))
    t = F.col(target)
    overlap = F.least(p + 1, (t + 1) * step) - F.greatest(p.cast("double"), t * step)
    centre = F.least(F.greatest((t + 0.5) * step - 0.5, F.lit(0.0)), side - 1.0)
    linear = F.lit(1.0) - F.abs(centre - p)
    return out.withColumn(weight, F.when(shrink, overlap / step).otherwise(linear)).where(
        F.col(weight) > 0).drop("_lo", "_hi", "_p")


def as_bytes(df: DataFrame, values: list[str]) -> DataFrame:
    """Resampled channels back to bytes, rounded half to even."""
    return df.withColumns({v: F.least(F.greatest(F.rint(F.round(v, 9)), F.lit(0)), F.lit(255)).cast("int")
                           for v in values})


def black_share(df: DataFrame) -> Column:
    """Share of pixels with no light at all, as an aggregate."""
    return F.avg((F.greatest("r", "g", "b") == 0).cast("double"))


def upright(df: DataFrame, orientation: Column) -> DataFrame:
    """Apply the camera orientation to coordinates and frame size."""
    x, y = C.oriented(F.col("x"), F.col("y"), F.col("w"), F.col("h"), orientation)
    turned = orientation.isin(5, 6, 7, 8)
    return df.withColumns({"x": x, "y": y, "w": F.when(turned, F.col("h")).otherwise(F.col("w")),
                           "h": F.when(turned, F.col("w")).otherwise(F.col("h"))})
