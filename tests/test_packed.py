"""Packed frames against the pixel-table operators, frame by frame and as jobs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterlab.operators import measure as H, packed as PK, subject as S
from rasterlab.operators.components import label_runs, mask_runs

FRAME = "image_id long, crop string, kind string, h int, w int, rgb array<int>"
RULES = [("onion", "uv"), ("onion", "visible"), ("garlic", "uv"), ("garlic", "visible")]


def frame(seed, h, w, disc):
    r = np.random.default_rng(seed)
    y, x = np.mgrid[0:h, 0:w]
    v = r.integers(5, 30, size=(3, h, w))
    for cy, cx, rad in disc:
        at = (y - cy) ** 2 + (x - cx) ** 2 <= rad ** 2
        v[0][at] += 150
        v[1][at] += 120 + r.integers(0, 60, size=at.sum())
    return [int(p) for p in (v[0] << 16 | v[1] << 8 | v[2]).ravel()]


@pytest.fixture(scope="module")
def frames(spark):
    rows = []
    for i in range(24):
        h, w = [(40, 40), (30, 48), (25, 33)][i % 3]
        disc = [[(h / 2, w / 2, 9)], [(h / 2, w / 2, 2)], [], [(3, 5, 8), (h - 6, w - 6, 4)]][(i // 4) % 4]
        rows.append((i, *RULES[i % 4], h, w, frame(i, h, w, disc)))
    return spark.createDataFrame(rows, FRAME)


def pixels(frames):
    px = frames.select("image_id", "crop", "kind", "h", "w", F.posexplode("rgb").alias("pos", "v"))
    return px.select("image_id", "crop", "kind", "h", "w", F.expr("pos div w").cast("int").alias("y"), (F.col("pos") % F.col("w")).alias("x"),
                     *[F.shiftright("v", s).bitwiseAND(255).alias(c) for c, s in zip("rgb", (16, 8, 0))])


def cells(df):
    return {(r.image_id, r.y, r.x) for r in df.select("image_id", "y", "x").collect()}


def test_masks_equal_those_of_the_pixel_table(spark, frames):
    got = PK.mask_runs(frames).select("image_id", "y", F.explode(F.sequence("x0", "x1")).alias("x"))
    want = S.subject_masks(pixels(frames)).where("mask")
    assert cells(got) == cells(want) and got.count() > 100


def test_records_equal_those_of_the_pixel_table(spark, frames):
    names = ["ok", "reason", "area", "touches_edge", "bbox", "cx", "cy", "radius", "frame_h", "frame_w"]
    photos = pixels(frames).withColumns({"code": F.lit("c"), "view": F.lit("v")})
    want = {r.image_id: r for r in H.found_subjects(photos).collect()}
    got = {r.image_id: r for r in PK.found(frames).collect()}
    assert got.keys() == want.keys()
    assert {r.reason for r in got.values()} >= {None, "not_found"}
    for i, g in got.items():
        assert [g[n] for n in names] == [want[i][n] for n in names], i
        if g.reason != "too_small":  # there the pixel table leaves out the largest component only
            assert g.bg_level == want[i].bg_level
    assert all(abs(g.area_frac - want[i].area_frac) < 1e-12 for i, g in got.items() if g.area)


def test_background_of_a_too_small_subject_is_outside_the_whole_mask():
    mask, gray = np.zeros((40, 40), bool), np.full((40, 40), 10.0)
    mask[5:8, 5:8] = mask[20:22, 20:22] = True
    gray[mask] = 200
    gray[~mask] = np.arange((~mask).sum()) % 50
    got = PK._record(mask, gray, 0.5, 0.1, 0.9)
    assert got["reason"] == "too_small" and got["area"] == 9
    assert got["bg_level"] == np.median(gray[~mask])


def test_jobs_do_not_grow_with_frame_sizes(spark, frames):
    one = PK.found(frames.where("h = 40"))
    for df in (one, PK.found(frames)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and plan.count("MapInArrow") == 1


def test_odd_frames(spark):
    rows = [(1, "onion", "uv", 2, 2, None), (2, "onion", "uv", 2, 2, [1, 2, 3]), (3, "leek", "uv", 1, 1, [5]), (4, "onion", "uv", None, 2, [1, 2]),
            (5, "onion", "uv", 1, 1, [0xFFFFFF]), (6, "garlic", "visible", 1, 3, [1, 2, 3]), (None, "garlic", "uv", 2, 1, [0, 0]), (7, None, None, 0, 0, [])]
    d = spark.createDataFrame(rows, FRAME)
    got = {r.image_id: r for r in PK.found(d).collect()}
    assert set(got) == {1, 2, 3, 4, 5, 6, 7, None} and all(not r.ok for r in got.values())
    assert PK.mask_runs(d).count() == 0
    assert PK.found(d.limit(0)).count() == 0
    assert PK.mask_runs(d.withColumn("y", F.lit(1)).withColumn("x0", F.lit("a"))).count() == 0


@pytest.mark.parametrize("neighbours", [4, 8])
def test_components_equal_those_of_the_run_table(spark, neighbours):
    m = np.random.default_rng(3).random((30, 35)) < 0.45
    y, x0, x1, label = PK.labelled(m, neighbours)
    px = spark.createDataFrame([(0, int(a), int(b)) for a, b in zip(*np.nonzero(m))], "image_id long, y int, x int")
    want = {}
    for r in label_runs(mask_runs(px), neighbours, 30).collect():
        want[r.y, r.x0, r.x1] = (r.ly, r.lx)
    assert {(a, b, c): (int(y[k]), int(x0[k])) for a, b, c, k in zip(y.tolist(), x0.tolist(), x1.tolist(), label)} == want
    assert (PK.painted(m.shape, y, x0, x1) == m).all()
