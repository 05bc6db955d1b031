"""Connected components of masks, by runs.

A mask row is first cut into horizontal runs with a window. The runs of one
band of rows are then merged inside tasks, and bands of the same image are
merged over the runs that meet at their seams, two blocks of bands at a time.
A band holds at most ``BAND_ROWS`` sensor rows and a seam at most one row of
runs, so the work of one group is bounded however tall the frame is.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType

from rasterlab.session import cut_lineage

BAND_ROWS = 1024


def mask_runs(mask: DataFrame, flags=()) -> DataFrame:
    """(image_id, y, x0, x1, flags) of the rows given, which are the masked
    pixels; a run has a flag when one of its pixels has."""
    w = Window.partitionBy("image_id", "y").orderBy("x")
    gap = F.col("x") - F.row_number().over(w)
    return (mask.select("image_id", "y", "x", *flags, gap.alias("_g")).groupBy("image_id", "y", "_g")
            .agg(F.min("x").alias("x0"), F.max("x").alias("x1"), *[F.bool_or(f).alias(f) for f in flags]).drop("_g"))


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member of each element's component under the edges a-b."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while True:
            jumped = label[label]
            if (jumped == label).all():
                break
            label = jumped
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    return label


def _touching(key, x0, x1, reach: int):
    """Pairs of runs on neighbouring lines that touch; sorted by (key, x0)."""
    span = int(x1.max()) + 3 if len(x1) else 3
    starts, ends = key * span + x0 + 1, key * span + x1 + 1
    lo = np.searchsorted(ends, (key - 1) * span + x0 + 1 - reach, "left")
    hi = np.searchsorted(starts, (key - 1) * span + x1 + 1 + reach, "right")
    n = np.maximum(hi - lo, 0)
    me = np.repeat(np.arange(len(key)), n)
    other = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return me, other


def _label_udf(reach: int):
    @F.pandas_udf(ArrayType(IntegerType()))
    def label(ys: pd.Series, x0s: pd.Series, x1s: pd.Series) -> pd.Series:
        sizes = np.array([len(v) for v in ys], dtype=np.int64)
        if not sizes.sum():
            return pd.Series([np.array([], dtype=np.int32) for _ in sizes])
        y, x0, x1 = (np.concatenate(s.to_numpy()).astype(np.int64) for s in (ys, x0s, x1s))
        group = np.repeat(np.arange(len(sizes)), sizes)
        y = y - y.min()
        key = group * (y.max() + 3) + y + 1  # a free line between groups
        root = _roots(len(y), *_touching(key, x0, x1, reach))
        first = np.cumsum(sizes) - sizes
        return pd.Series(np.split((root - np.repeat(first, sizes)).astype(np.int32), np.cumsum(sizes)[:-1]))
    return label


def _merged(groups: DataFrame, keys: list[str], reach: int) -> DataFrame:
    """Runs with the first run (ly, lx) of their component within the keys."""
    extra = [c for c in groups.columns if c not in (*keys, "y", "x0", "x1")]
    run = F.struct("y", "x0", "x1", *extra)
    arr = groups.groupBy(*keys).agg(F.sort_array(F.collect_list(run)).alias("_r"))
    lab = arr.withColumn("_l", _label_udf(reach)(F.col("_r.y"), F.col("_r.x0"), F.col("_r.x1")))
    rows = F.transform("_r", lambda r, i: F.struct(
        *[r[c].alias(c) for c in ("y", "x0", "x1", *extra)],
        F.col("_r")[F.col("_l")[i]]["y"].alias("ly"), F.col("_r")[F.col("_l")[i]]["x0"].alias("lx")))
    return lab.select(*keys, F.inline(rows))


def label_runs(runs: DataFrame, connectivity: int = 4, height: int | None = None,
               band_rows: int | None = None) -> DataFrame:
    """Runs with (ly, lx): the label of a run is the first pixel, in reading
    order, of its component.

    ``height`` is the frame height where it is known; without it the largest
    row number is looked up.
    """
    reach = {4: 0, 8: 1}[connectivity]
    band_rows = band_rows or BAND_ROWS
    if height is None:
        height = (runs.agg(F.max("y")).first()[0] or 0) + 1
    if height <= band_rows:  # one band, no seam
        return _merged(runs, ["image_id"], reach)
    banded = runs.withColumn("_band", F.floor(F.col("y") / band_rows).cast("int"))
    part = _merged(banded, ["image_id", "_band"], reach).drop("_band")
    code = F.shiftleft(F.col("ly").cast("bigint"), 31) + F.col("lx")  # orders labels as they are read
    last = part.where(F.col("y") % band_rows == band_rows - 1).select(
        "image_id", (F.col("y") + 1).alias("y"), F.col("x0").alias("a0"), F.col("x1").alias("a1"), code.alias("a"))
    first = part.where((F.col("y") % band_rows == 0) & (F.col("y") > 0)).select("image_id", "y", "x0", "x1", code.alias("b"))
    seams = first.join(last, ["image_id", "y"]).where(
        (F.col("x0") <= F.col("a1") + reach) & (F.col("a0") <= F.col("x1") + reach)).select(
        "image_id", F.expr(f"int(y div {band_rows})").alias("seam"), "a", "b").distinct()
    roots = _seam_roots(cut_lineage(seams), -(-height // band_rows)).select(
        "image_id", F.shiftright("node", 31).cast("int").alias("ly"), F.expr("int(node & 2147483647)").alias("lx"), "root")
    joined = part.join(roots, ["image_id", "ly", "lx"], "left")
    return joined.withColumns({"ly": F.coalesce(F.shiftright("root", 31).cast("int"), F.col("ly")),
                               "lx": F.coalesce(F.expr("int(root & 2147483647)"), F.col("lx"))}).drop("root")


def _seam_roots(seams: DataFrame, bands: int) -> DataFrame:
    """(image_id, node, root) of the labels that meet at a seam; ``seams`` holds an edge (a, b) a row.

    Bands are joined in rounds, like a tournament: round r closes every seam whose number is an odd multiple of
    2**r, and so joins two blocks of 2**r bands. A group is one seam of one image, at most a frame's width of edges
    whatever the number of bands, and the blocks of a round share no label, so all its seams are closed side by
    side. The number of rounds follows from the height alone.
    """
    ends = F.explode(F.array("a", "b")).alias("node")
    nodes = cut_lineage(seams.select("image_id", ends).distinct().withColumn("root", F.col("node")))
    step = 1
    while step < bands:
        a, b = (nodes.select("image_id", F.col("node").alias(n), F.col("root").alias(f"_{n}")) for n in "ab")
        now = seams.where((F.col("seam") % step == 0) & (F.expr(f"seam div {step}") % 2 == 1))
        edges = now.join(a, ["image_id", "a"]).join(b, ["image_id", "b"]).groupBy("image_id", "seam").agg(
            F.collect_list("_a").alias("_a"), F.collect_list("_b").alias("_b"))
        moved = edges.select("image_id", F.explode(F.arrays_zip("_a", "_b", _edge_roots("_a", "_b").alias("to"))).alias("e")).select(
            "image_id", F.explode(F.array("e._a", "e._b")).alias("root"), F.col("e.to").alias("to")).distinct()
        nodes = cut_lineage(nodes.join(moved, ["image_id", "root"], "left").select(
            "image_id", "node", F.coalesce("to", "root").alias("root")))
        step *= 2
    return nodes


@F.pandas_udf(ArrayType(LongType()))
def _edge_roots(a: pd.Series, b: pd.Series) -> pd.Series:
    """Smallest label of the component that each edge is part of."""
    out = []
    for x, y in zip(a, b):
        nodes, at = np.unique(np.concatenate([x, y]), return_inverse=True)
        out.append(nodes[_roots(len(nodes), at[:len(x)], at[len(x):])[at[:len(x)]]])
    return pd.Series(out)


LABEL = ["image_id", "ly", "lx"]


def blob_table(labelled: DataFrame) -> DataFrame:
    """One row per component: area, centroid, radius and bounding box."""
    n = (F.col("x1") - F.col("x0") + 1).cast("bigint")
    area = F.sum(n)
    return labelled.groupBy(*LABEL).agg(
        area.alias("area"),
        (F.sum((F.col("x0") + F.col("x1")) / 2.0 * n) / area).alias("cx"),
        (F.sum(F.col("y") * n) / area).alias("cy"),
        F.sqrt(area / F.lit(np.pi)).alias("radius"),
        F.min("x0").alias("left"), F.max("x1").alias("right"), F.min("y").alias("top"), F.max("y").alias("bottom"))


def area_filtered(blobs: DataFrame, lo: int, hi: int | None = None) -> DataFrame:
    out = blobs.where(F.col("area") >= lo)
    return out if hi is None else out.where(F.col("area") <= hi)


def run_pixels(runs: DataFrame) -> DataFrame:
    """Runs back to pixels; other columns are kept."""
    keep = [c for c in runs.columns if c not in ("x0", "x1")]
    return runs.select(*keep, F.explode(F.sequence("x0", "x1")).alias("x"))


def marked(pixels: DataFrame, runs: DataFrame, out: str) -> DataFrame:
    """Dense pixels with a flag for those inside the given runs.

    The masked pixels are the side that is hashed; the dense side is not
    sorted.
    """
    hit = run_pixels(runs.select("image_id", "y", "x0", "x1")).withColumn(out, F.lit(True))
    return pixels.join(hit.hint("shuffle_hash"), ["image_id", "y", "x"], "left").withColumn(out, F.coalesce(out, F.lit(False)))


def grown_runs(runs: DataFrame, n: int) -> DataFrame:
    """Runs of every pixel within city-block distance ``n`` of the given ones;
    they may overlap and reach beyond the frame."""
    dy = F.explode(F.sequence(F.lit(-n), F.lit(n))).alias("_dy")
    reach = F.lit(n) - F.abs("_dy")
    return runs.select("image_id", "y", "x0", "x1", dy).select(
        "image_id", (F.col("y") + F.col("_dy")).alias("y"), (F.col("x0") - reach).alias("x0"),
        (F.col("x1") + reach).alias("x1"))


def outside(pixels: DataFrame, runs: DataFrame) -> DataFrame:
    """Pixels that no run covers.

    Along a row, a pixel is covered when some run that starts at or before it
    reaches it, so one sweep over both in order of x decides; pixels and runs
    are never paired.
    """
    a = pixels.select("image_id", "y", F.col("x").alias("_at"), F.lit(1).alias("_px"), F.lit(None).cast("int").alias("_to"))
    b = runs.select("image_id", "y", F.col("x0").alias("_at"), F.lit(0).alias("_px"), F.col("x1").alias("_to"))
    w = (Window.partitionBy("image_id", "y").orderBy("_at", "_px").rowsBetween(Window.unboundedPreceding, 0))
    swept = a.unionByName(b).withColumn("_reach", F.max("_to").over(w))
    free = (F.col("_px") == 1) & ~F.coalesce(F.col("_reach") >= F.col("_at"), F.lit(False))
    return swept.where(free).select("image_id", "y", F.col("_at").alias("x"))


def holding(labelled: DataFrame, flag: str) -> DataFrame:
    """Runs of the components in which some run has the flag."""
    good = labelled.groupBy(*LABEL).agg(F.bool_or(flag).alias("_any")).where("_any").drop("_any")
    return labelled.join(good, LABEL, "left_semi")
