"""Mean nearest distances at the number of blobs that real frames have."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterlab.operators.pixel_features import nearest_density


@pytest.mark.parametrize("n", [2, 256, 257, 1000, 5000])
def test_many_blobs_in_a_frame(spark, n):
    xy = np.random.default_rng(n).uniform(0, 640, (n, 2))
    best = np.array([np.sort(((p - xy) ** 2).sum(axis=1))[1] for p in xy])
    d = spark.createDataFrame([(1, float(x), float(y)) for x, y in xy], "image_id long, cx double, cy double")
    got = nearest_density(d).select(F.col("cluster_density")).first()[0]
    assert got == pytest.approx(1 / (np.sqrt(best).mean() + 1e-6), rel=1e-9)


@pytest.mark.parametrize("kind", ["even", "crowded", "equal"])
def test_a_frame_cut_in_strips(spark, kind):
    r = np.random.default_rng(8)
    xy = r.uniform(0, 640, (1500, 2))
    if kind == "crowded":  # far ones look across many narrow strips
        xy = np.r_[r.normal(300, 0.5, (1400, 2)), r.uniform(0, 640, (100, 2))]
    elif kind == "equal":
        xy = np.round(xy / 40)
    frames = {1: xy, 2: xy[:40], 3: xy[:1]}
    rows = [(i, float(x), float(y)) for i, f in frames.items() for x, y in f]
    d = spark.createDataFrame(rows, "image_id long, cx double, cy double").repartition(3)
    got = {x.image_id: x.cluster_density for x in nearest_density(d, strip_rows=100).collect()}
    for i, f in frames.items():
        best = np.sqrt(np.array([np.partition(((p - f) ** 2).sum(axis=1), min(1, len(f) - 1))[min(1, len(f) - 1)] for p in f]))
        assert got[i] == pytest.approx(1 / (best.mean() + 1e-6) if len(f) > 1 else 0.0, rel=1e-9)
