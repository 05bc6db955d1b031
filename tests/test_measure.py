"""Photos of heads, measured and stored as scans."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import write_png
from rasterlab import params as P
from rasterlab.operators import measure as H, pixel_features as V
from rasterlab.sources import images as I


def scene(size, centre, radius, dots, skin=(70, 50, 90)):
    img = np.zeros((size, size, 3), np.uint8)
    img[:] = (7, 6, 51)
    yy, xx = np.mgrid[0:size, 0:size]
    img[(yy - centre[1]) ** 2 + (xx - centre[0]) ** 2 <= radius ** 2] = skin
    for x, y in dots:
        img[y - 2:y + 3, x - 2:x + 3] = (190, 200, 210)
    return img


@pytest.fixture(scope="module")
def photos(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("heads")
    dots = [(40, 40), (56, 50), (46, 58)]
    write_png(root / "S001/UV/a.png", scene(96, (48, 48), 26, dots))
    visible = np.zeros((96, 96, 3), np.uint8)
    visible[:] = (90, 90, 90)
    yy, xx = np.mgrid[0:96, 0:96]
    visible[(yy - 48) ** 2 + (xx - 48) ** 2 <= 26 ** 2] = (170, 60, 90)
    visible[36:45, 36:45] = (200, 150, 40)  # a dry patch under the first dot
    write_png(root / "S001/visible_light/v.png", visible)
    write_png(root / "S002/UV/a.png", scene(80, (40, 40), 20, []))
    blank = np.zeros((96, 96, 3), np.uint8)
    blank[:] = (7, 6, 51)
    write_png(root / "S003/UV/a.png", blank)
    px = I.pixels(I.read_photos(spark, str(root)), ["image_id", "code", "light"])
    kind = F.when(F.col("light") == "UV", "uv").otherwise("visible")
    px = px.withColumns({"kind": kind, "view": kind, "crop": F.when(F.col("code") == "S002", "garlic").otherwise("onion")})
    masks = {("onion", "uv"): H.S.uv_mask, ("onion", "visible"): H.S.visible_mask, ("garlic", "uv"): H.S.uv_mask}
    return px, H.found_subjects(px, masks)


def test_records(photos):
    d = {r["image_id"]: r for r in photos[1].collect()}
    assert len(d) == 4
    assert d["S001/UV"]["ok"] and d["S001/visible_light"]["ok"] and d["S002/UV"]["ok"]
    assert not d["S003/UV"]["ok"] and d["S003/UV"]["reason"] == "not_found" and d["S003/UV"]["radius"] == pytest.approx(38.4)
    assert d["S002/UV"]["frame_h"] == 80 and d["S001/UV"]["bg_level"] == 11.0


def test_heads_to_scans(spark, photos):
    px, found = photos
    blobs = V.BlobParams(fine_window=21, coarse_window=61, small_min=12, large_min=1200, height=120)
    heads = H.head_features(px, found, 1, blobs, 120).cache()
    f = {r["code"]: r for r in heads.collect()}
    assert set(f) == {"S001", "S002", "S003"}
    assert set(heads.columns) == {"code", *P.VIEW_FEATURES, *P.HEAD_FEATURES}
    assert f["S001"]["n_small_sharp_blobs"] == 3
    assert f["S001"]["uv_exclusive_dot_frac"] == pytest.approx(2 / 3)
    assert f["S002"]["uv_exclusive_dot_frac"] == P.NO_VISIBLE
    checks = H.capture_checks(found)
    config = {"decision_threshold": 0.6746, "training_feature_ranges": {"n_small_sharp_blobs": {"min": 0.0, "max": 2.0}}}

    def score(df):
        return df.select("id", F.when(F.col("n_small_sharp_blobs") > 0, 0.9).otherwise(0.55).alias("proba_positive"))
    rows = {r["sample_code"]: r for r in H.scan_rows(heads, found, checks, score, config).collect()}
    assert rows["S001"]["pred_label"] == 1 and rows["S001"]["ood_status"] == "out_of_range"
    assert rows["S001"]["advice"] == "unreliable" and rows["S001"]["image_path"] == "S001/UV"
    assert rows["S002"]["pred_label"] is None and rows["S002"]["advice"] is None and len(rows["S002"]["features"]) == 24
    assert rows["S003"]["framing_ok"] is False and rows["S003"]["borderline"] is True
    notes = json.loads(rows["S003"]["quality_notes"])
    assert notes["framing_failed_views"] == ["uv"] and notes["scale"] == "not_applicable"


def test_warnings(photos):
    px, found = photos
    got = {r["image_id"]: list(r["warnings"]) for r in H.warnings(px, found, 60).collect()}
    assert got["S001/UV"] == [] and got["S003/UV"] == ["not_found"]


def test_one_row_per_head_with_several_photos(spark):
    views = spark.createDataFrame([("S1", 1.0, 4), ("S1", 3.0, 6), ("S2", 5.0, None)], "code string, a double, b int")
    rows = {r["code"]: (r["a"], r["b"]) for r in H.Q.single_or_pair(views, "code", ["a", "b"], 1).collect()}
    assert rows == {"S1": (2.0, 5.0), "S2": (5.0, None)}
