"""Raster operators against numpy, and photos end to end."""

import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import write_png
from rasterlab import params as P
from rasterlab.functions import colour as C
from rasterlab.operators import components as K, packed, pixel_features as V, quality as Q, raster as R, scans as T, subject as S
from rasterlab.sources import images as I


def frame(spark, arrays, **cols):
    """Pixel table of same-sized 2-D arrays; extra columns from ``cols``."""
    parts = []
    for i, a in enumerate(arrays):
        h, w = a.shape
        y, x = np.mgrid[0:h, 0:w]
        parts.append(pd.DataFrame({"image_id": i, "h": h, "w": w, "y": y.ravel(), "x": x.ravel(), "v": a.ravel().astype(float),
                                   **{k: f[i].ravel() for k, f in cols.items()}}))
    return spark.createDataFrame(pd.concat(parts)).repartition("image_id")


def grid(df, col, n, shape):
    out = np.full((n, *shape), np.nan)
    for r in df.select("image_id", "y", "x", col).collect():
        out[r[0], r[1], r[2]] = r[3]
    return out


RNG = np.random.default_rng(11)
A = [np.round(RNG.random((14, 17)) * 100, 3) for _ in range(3)]


@pytest.mark.parametrize("k", [3, 9, 41])
@pytest.mark.parametrize("edge", ["reflect", "zero"])
def test_box_means(spark, k, edge):
    mask = [RNG.random(a.shape) < 0.7 for a in A]
    got = grid(R.box_means(frame(spark, A, m=mask), "v", "m", {"b": k}, edge), "b", 3, A[0].shape)
    for i, a in enumerate(A):
        m = mask[i].astype(float)
        mode = {"mode": "symmetric"} if edge == "reflect" else {"mode": "constant"}
        vp, mp = (np.pad(z, k // 2, **mode) for z in (a * m, m))
        win = lambda z: np.lib.stride_tricks.sliding_window_view(z, (k, k)).sum((2, 3))
        assert np.allclose(got[i], win(vp) / np.maximum(win(mp), 1e-6 * k * k))


def test_laplacian_and_dilation(spark):
    px = frame(spark, A)
    lap = grid(R.laplacian(px, "v"), "lap", 3, A[0].shape)
    near = grid(R.dilated_cross(px.withColumn("m", F.col("v") > 95), "m", 3, "n").withColumn("n", F.col("n").cast("int")),
                "n", 3, A[0].shape)
    for i, a in enumerate(A):
        p = np.pad(a, 1, mode="symmetric")
        assert np.allclose(lap[i], p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * a)
        want = np.zeros_like(a)
        yy, xx = np.mgrid[0:a.shape[0], 0:a.shape[1]]
        for y, x in zip(*np.where(a > 95)):
            want[(abs(yy - y) + abs(xx - x)) <= 3] = 1
        assert (near[i] == want).all()


def flood(mask, eight):
    """Label of each masked pixel: the first pixel of its component."""
    lab, n = np.full(mask.shape, -1), mask.shape[1]
    step = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (dy or dx) and (eight or not (dy and dx))]
    for y, x in zip(*np.where(mask)):
        if lab[y, x] < 0:
            todo, lab[y, x] = [(y, x)], y * n + x
            while todo:
                a, b = todo.pop()
                for dy, dx in step:
                    p, q = a + dy, b + dx
                    if 0 <= p < mask.shape[0] and 0 <= q < n and mask[p, q] and lab[p, q] < 0:
                        lab[p, q] = y * n + x
                        todo.append((p, q))
    return lab


@pytest.mark.parametrize("band", [None, 2, 5])
@pytest.mark.parametrize("connectivity", [4, 8])
def test_components(spark, connectivity, band):
    spiral = np.zeros((14, 17))
    spiral[1, 1:16] = spiral[1:13, 15] = spiral[12, 1:16] = spiral[3:13, 1] = spiral[3, 1:13] = spiral[3:10, 12] = 100
    arrays = [*A, spiral]
    px = frame(spark, arrays).where(F.col("v") > 45)
    runs = K.label_runs(K.mask_runs(px), connectivity, 14, band)
    got = grid(K.run_pixels(runs).withColumn("l", F.col("ly") * 17 + F.col("lx")), "l", 4, A[0].shape)
    for i, a in enumerate(arrays):
        assert (np.nan_to_num(got[i], nan=-1) == flood(a > 45, connectivity == 8)).all()
    blobs = K.blob_table(runs).where("image_id = 3").collect()
    assert len(blobs) == 1 and blobs[0]["area"] == int((spiral > 45).sum())


@pytest.mark.parametrize("connectivity", [4, 8])
def test_seams_of_bands_of_one_row(spark, connectivity):
    """A checkerboard in bands of one row: no run touches another by its sides, all do by their corners."""
    board = (np.indices((37, 24)).sum(0) % 2) * 100.0
    comb = np.zeros((37, 24))
    comb[:, ::4] = comb[36, :] = comb[18, 8:] = 100
    px = frame(spark, [board, comb, np.zeros((37, 24))]).where(F.col("v") > 45)
    runs = K.label_runs(K.mask_runs(px), connectivity, 37, 1)
    got = grid(K.run_pixels(runs).withColumn("l", F.col("ly") * 24 + F.col("lx")), "l", 3, board.shape)
    for i, a in enumerate([board, comb]):
        assert (np.nan_to_num(got[i], nan=-1) == flood(a > 45, connectivity == 8)).all()
    assert runs.where("image_id = 0").select("ly", "lx").distinct().count() == (1 if connectivity == 8 else board.astype(bool).sum())


def resized(a, size):
    h = a.shape[0]
    s = h / size
    w = np.zeros((size, h))
    for t in range(size):
        for p in range(h):
            if h > size:
                w[t, p] = max(0, min(p + 1, (t + 1) * s) - max(p, t * s)) / s
            else:
                w[t, p] = max(0, 1 - abs(min(max((t + .5) * s - .5, 0), h - 1) - p))
    return w @ a @ w.T


@pytest.mark.parametrize("square", [(2, 3, 10), (-3, -2, 14), (5, 4, 20), (1, 1, 5)])
def test_framed(spark, square):
    x0, y0, side = square
    crops = spark.createDataFrame([(i, x0, y0, side) for i in range(3)], "image_id bigint, x0 int, y0 int, side int")
    got = grid(R.framed(frame(spark, A), crops, ["v"], 9), "v", 3, (9, 9))
    for i, a in enumerate(A):
        big = np.pad(a, 30)[30 + y0:30 + y0 + side, 30 + x0:30 + x0 + side]
        assert np.allclose(got[i], resized(big, 9))


def scene(size=96, centre=(52, 44), radius=24, dots=((44, 40), (58, 50), (50, 58))):
    """A lit disc on a blue background with bright dots of 5 x 5 pixels."""
    img = np.zeros((size, size, 3), np.uint8)
    img[:] = (7, 6, 51)
    yy, xx = np.mgrid[0:size, 0:size]
    img[(yy - centre[1]) ** 2 + (xx - centre[0]) ** 2 <= radius ** 2] = (70, 50, 90)
    for x, y in dots:
        img[y - 2:y + 3, x - 2:x + 3] = (190, 200, 210)
    return img


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("photos")
    write_png(root / "S001/UV/a.png", scene())
    write_png(root / "S001/UV/b.png", scene(dots=()))
    write_png(root / "S001/visible_light/v.png", scene())
    write_png(root / "S002/UV/a.png", scene(dots=()))
    write_png(root / "S003/visible_light/v.png", scene())
    (root / "S002/UV/notes.txt").write_text("no photo")
    return str(root)


def test_photo_listing(spark, folder):
    files = I.photo_files(spark, folder)
    got = {(r["code"], r["light"]): (r["name"], r["candidates"]) for r in I.chosen_photos(files).collect()}
    assert got[("S001", "UV")] == ("a.png", 2) and got[("S002", "UV")] == ("a.png", 1)
    assert [r[0] for r in I.codes_without_uv(files).collect()] == ["S003"]


def test_decoded_pixels(spark, folder):
    px = I.pixels(I.read_photos(spark, folder)).where("image_id = 'S001/UV'")
    img = scene()
    rows = px.toPandas().sort_values(["y", "x"])
    assert len(rows) == 96 * 96
    assert (rows[["r", "g", "b"]].to_numpy() == img.reshape(-1, 3)).all()


@pytest.mark.parametrize("order", ["little", "big"])
def test_photos_from_a_turned_camera(spark, tmp_path, order):
    """PNG files with an orientation tag are read upright, broken files are reported, others stay as they are."""
    rng = np.random.default_rng(3)
    a = rng.integers(0, 256, (5, 7, 3)).astype(np.uint8)
    for o in range(0, 9):
        path = tmp_path / f"S{o:03d}/UV/a.png"
        write_png(path, a)
        if o:
            head = b"II*\0" if order == "little" else b"MM\0*"
            tiff = head + b"".join(n.to_bytes(s, order) for n, s in [
                (8, 4), (2, 2), (0x0100, 2), (4, 2), (1, 4), (7, 4), (0x0112, 2), (3, 2), (1, 4), (o, 2), (0, 2), (0, 4)])
            chunk = len(tiff).to_bytes(4, "big") + b"eXIf" + tiff + zlib.crc32(b"eXIf" + tiff).to_bytes(4, "big")
            raw = path.read_bytes()
            path.write_bytes(raw[:33] + chunk + raw[33:])
    (tmp_path / "S009/UV").mkdir(parents=True)
    (tmp_path / "S009/UV/a.png").write_bytes(b"no picture")
    photos = I.read_photos(spark, str(tmp_path)).cache()
    assert {r["code"]: r["orientation"] for r in photos.collect()} == {f"S{o:03d}": o or 1 for o in range(9)}
    turned = {1: a, 2: a[:, ::-1], 3: a[::-1, ::-1], 4: a[::-1], 5: a.transpose(1, 0, 2), 6: np.rot90(a, -1),
              7: a[::-1, ::-1].transpose(1, 0, 2), 8: np.rot90(a)}
    got = {k: v.sort_values(["y", "x"]) for k, v in I.pixels(photos).toPandas().groupby("image_id")}
    for o in range(9):
        px, want = got[f"S{o:03d}/UV"], turned[o or 1]
        assert (px["h"].iloc[0], px["w"].iloc[0]) == want.shape[:2] and (px[["r", "g", "b"]].to_numpy() == want.reshape(-1, 3)).all()
    rows = {r["code"]: r["rgb"] for r in packed.frame_rows(photos).collect()}
    assert rows["S006"][1] == int.from_bytes(bytes(turned[6].reshape(-1, 3)[1]), "big")
    report = T.ingest_report(I.photo_outcomes(spark, str(tmp_path))).collect()
    assert {(r["outcome"], r["n"], r["saved"]) for r in report} == {("ok", 9, 9), ("unreadable", 1, 0)}


def test_photo_to_features(spark, folder):
    """Find the subject, normalise it, and find its dots again."""
    photos = I.read_photos(spark, folder).where("light = 'UV'")
    px = I.pixels(photos)
    mask = S.cleaned(S.uv_mask(px), 96, 96)
    det = S.detection(mask, 96, 96)
    d = {r["image_id"]: r for r in det.collect()}
    assert d["S001/UV"]["ok"] and d["S001/UV"]["cx"] == pytest.approx(52.5, abs=1)
    assert d["S001/UV"]["cy"] == pytest.approx(44.5, abs=1) and d["S001/UV"]["radius"] == pytest.approx(24.5, abs=1)
    assert list(d["S001/UV"]["touches_edge"]) == []
    framed = S.normalised(px, det, size=120)
    assert framed.groupBy("image_id").count().where("count <> 14400").count() == 0
    p = V.BlobParams(fine_window=21, coarse_window=61, small_min=12, small_max=500, large_min=1200, height=120)
    feats, small = V.view_features(framed, p)
    f = {r["image_id"]: r for r in feats.collect()}
    assert f["S001/UV"]["n_small_sharp_blobs"] == 3 and f["S002/UV"]["n_small_sharp_blobs"] == 0
    assert f["S001/UV"]["cluster_density"] > 0 and f["S002/UV"]["cluster_density"] == 0
    assert f["S001/UV"]["mean_R"] > f["S002/UV"]["mean_R"]
    assert sorted(feats.columns[1:]) == sorted(P.VIEW_FEATURES)
    views = feats.select("image_id", F.lit(True).alias("has_companion"))
    none = spark.createDataFrame([], "image_id string, y int, x int")
    assert {r[1] for r in V.exclusive_fraction(views, small, none, 120).collect()} == {0.0, 1.0}
    heads = Q.single_or_pair(feats.withColumn("code", F.split("image_id", "/")[0]), "code", P.VIEW_FEATURES, 1)
    assert heads.count() == 2
    pad = S.padding(framed, det, 96, 96).collect()
    assert all(not r["padded"] for r in pad)
    bg = {r[0]: r[1] for r in S.background_level(S.object_mask(mask, 96, 96)).collect()}
    assert bg["S001/UV"] == 11.0  # gray of (7, 6, 51)


def brute_features(img):
    """Colour and NDFI features of one square frame, in numpy."""
    size = img.shape[0]
    yy, xx = np.mgrid[0:size, 0:size]
    roi = np.sqrt((xx - size / 2) ** 2 + (yy - size / 2) ** 2) <= 0.45 * size
    s = img / 255.0
    lin = np.where(s <= 0.04045, s / 12.92, ((s + 0.055) / 1.055) ** 2.4)
    bright, valid = lin.mean(-1), roi & (img.max(-1) < 250)
    b = bright[valid]
    med = np.median(b)
    spread = 3 * 1.4826 * np.median(abs(b - med))
    p = np.pad(bright, 1, mode="symmetric")
    lap = p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * bright
    nd = (lin[..., 1] - (lin[..., 0] + lin[..., 2]) / 2) / (lin[..., 1] + (lin[..., 0] + lin[..., 2]) / 2 + 1e-6)
    return {"mean_G": lin[..., 1][valid].mean(), "sd_B": lin[..., 2][valid].std(), "texture": lap[valid].std(),
            "A_high": (bright[roi] > med + spread).mean(), "A_low": (bright[roi] < med - spread).mean(),
            "F_p95": np.percentile(bright[roi], 95), "NDFI_p05": np.percentile(nd[roi], 5), "NDFI_mean": nd[roi].mean()}


def test_colour_features(spark):
    imgs = [RNG.integers(0, 256, (24, 24, 3)), np.full((24, 24, 3), 255)]
    px = frame(spark, [i[..., 0] for i in imgs], r=[i[..., 0] for i in imgs], g=[i[..., 1] for i in imgs], b=[i[..., 2] for i in imgs])
    got = {r["image_id"]: r for r in V.colour_stats(V.prepared(px)).collect()}
    for k, v in brute_features(imgs[0]).items():
        assert got[0][k] == pytest.approx(v, rel=1e-9, abs=1e-12)
    assert got[1]["mean_R"] == 0.0 and got[1]["texture"] == 0.0  # no valid pixel


@pytest.mark.parametrize("edge", ["reflect", "zero"])
def test_whole_frames_and_windows_agree(spark, edge):
    imgs = [scene(60, (30, 31), 20, ((25, 25), (36, 30), (30, 38))), RNG.integers(0, 256, (60, 60, 3)),
            np.full((60, 60, 3), 255)]
    px = frame(spark, [i[..., 0] for i in imgs], **{c: [i[..., j].astype(int) for i in imgs] for j, c in enumerate("rgb")})
    p = V.BlobParams(fine_window=11, coarse_window=31, dilate=2, small_min=3, small_max=60, large_min=61, height=60, edge=edge)
    a, sa = V.view_features(px, p, True)
    b, sb = V.view_features(px, p, False)
    a, b = (f.toPandas().sort_values("image_id").set_index("image_id") for f in (a, b))
    assert np.allclose(a.to_numpy(), b.to_numpy(), rtol=1e-9, atol=1e-12) and len(a) == 3
    assert sa.count() == sb.count() > 0


def test_hue_bytes(spark):
    rgb = [(200, 150, 40), (10, 10, 10), (0, 0, 0), (40, 60, 200), (255, 0, 10)]
    df = spark.createDataFrame(rgb, "r int, g int, b int")
    got = [(r[0], r[1]) for r in df.select(C.hue(*map(F.col, "rgb")), C.saturation(*map(F.col, "rgb"))).collect()]
    assert got == [(21, 204), (0, 0), (0, 0), (116, 204), (179, 255)]


@pytest.mark.parametrize("o", range(1, 9))
def test_orientation_keeps_pixels(spark, o):
    a = np.arange(6.).reshape(2, 3)
    out = R.upright(frame(spark, [a]), F.lit(o))
    h, w = (3, 2) if o >= 5 else (2, 3)
    got = grid(out, "v", 1, (h, w))[0]
    want = {1: a, 2: a[:, ::-1], 3: a[::-1, ::-1], 4: a[::-1], 5: a.T, 6: np.rot90(a, -1), 7: a[::-1, ::-1].T, 8: np.rot90(a)}[o]
    assert (got == want).all()


def test_garlic_masks_and_dispatch(spark):
    rng = np.random.default_rng(5)
    uv, vis = np.zeros((40, 40, 3), int), np.zeros((40, 40, 3), int)
    uv[:] = (7, 6, 51)
    uv[5:35, 5:35, 1] = 40 + rng.integers(0, 3, (30, 30))
    uv[13:27, 13:27, 1] = 90  # dim rim of the clove, above the dish's glow
    uv[14:26, 14:26, 1] = 150 + rng.integers(0, 9, (12, 12))
    vis[:] = 200
    vis[9:31, 9:31] = 10
    vis[16:24, 15:25] = 120
    imgs = [uv, vis]
    px = frame(spark, [i[..., 0] for i in imgs], r=[i[..., 0] for i in imgs], g=[i[..., 1] for i in imgs], b=[i[..., 2] for i in imgs])
    px = px.withColumns({"crop": F.lit("garlic"), "kind": F.when(F.col("image_id") == 0, "uv").otherwise("visible")})
    out = S.subject_masks(px).where("mask").groupBy("image_id").agg(
        F.count("*"), F.min("y"), F.max("y"), F.min("x"), F.max("x")).collect()
    got = {r[0]: tuple(r)[1:] for r in out}
    assert got[0] == (196, 13, 26, 13, 26)
    assert got[1] == (80, 16, 23, 15, 24)


def test_frame_sizes_run_separately(spark):
    a = frame(spark, [np.ones((4, 5))])
    b = frame(spark, [np.ones((6, 3))]).withColumn("image_id", F.lit(9))
    out = S.by_frame_size(a.unionByName(b), lambda p, h, w: p.groupBy("image_id").agg(F.lit(h * w).alias("n")))
    assert {tuple(r) for r in out.collect()} == {(0, 20), (9, 18)}


def test_pixel_windows_do_not_shuffle_again(spark):
    """Frames laid out by image need no exchange for windows or aggregates."""
    frames = spark.createDataFrame([(i, [float(j) for j in range(64)]) for i in range(4)], "image_id bigint, v array<double>")
    px = R.clustered(frames, 4).select("image_id", F.posexplode("v").alias("pos", "v")).select(
        "image_id", F.lit(8).alias("h"), F.lit(8).alias("w"), F.expr("pos div 8").cast("int").alias("y"),
        (F.col("pos") % 8).alias("x"), "v", F.lit(True).alias("m"))
    out = R.laplacian(R.box_means(px, "v", "m", {"b": 3}), "b").groupBy("image_id").agg(F.stddev_pop("lap"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
