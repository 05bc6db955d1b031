"""Nearest dots by grids, the feature list, reports joined by name."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterlab.operators import paired as C, pixel_features as V


def plain(p):
    d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    return d.min(axis=1)


@pytest.mark.parametrize("kind", ["even", "clusters", "line", "repeated", "far", "two"])
def test_nearest_equals_brute_force(kind):
    r = np.random.default_rng(1)
    p = {"even": r.random((900, 2)) * 640,
         "clusters": np.concatenate([r.normal(c, 1e-4, size=(200, 2)) for c in (0, 300, 301, 640)] + [[[100.0, 5.0]]]),
         "line": np.column_stack([np.full(500, 3.0), r.random(500)]),
         "repeated": np.repeat(r.random((60, 2)), r.integers(1, 9, 60), axis=0),
         "far": np.concatenate([r.random((300, 2)), [[1e6, 1e6], [1e6 + 3, 1e6]]]),
         "two": np.array([[1.0, 2.0], [4.0, 6.0]])}[kind]
    assert np.allclose(V.nearest_distances(p), plain(p))
    assert np.allclose(V.nearest_distances(p, dense=1, block=7), plain(p))


def test_few_points_and_many():
    assert np.isinf(V.nearest_distances(np.zeros((1, 2)))).all() and len(V.nearest_distances(np.zeros((0, 2)))) == 0
    assert (V.nearest_distances(np.zeros((5, 2))) == 0).all()
    p = np.random.default_rng(2).random((20_000, 2)) * 640
    t = time.perf_counter()
    got = V.nearest_distances(p)
    assert time.perf_counter() - t < 1
    some = np.arange(0, 20_000, 97)
    d = np.sqrt(((p[some, None] - p[None]) ** 2).sum(-1))
    d[np.arange(len(some)), some] = np.inf
    assert np.allclose(got[some], d.min(axis=1))


def test_a_feature_list_is_checked():
    with pytest.raises(ValueError, match="twice"):
        V.checked([*V.COLOUR_LIST, V.COLOUR_LIST[0]])
    with pytest.raises(ValueError, match="cannot have"):
        V.checked([V.Feature("_valid", lambda: F.lit(1))])
    names = {f.name for f in V.COLOUR_LIST} | {"texture"}
    assert names <= set(V.P.VIEW_FEATURES)


def test_reports_joined_by_name(spark):
    t = spark.createDataFrame([("a", 1.0), ("b", 2.0), (None, 3.0)], "name string, kappa double")
    p = spark.createDataFrame([("a", 0.5)], "name string, d double")
    r = spark.createDataFrame([("b", 9.0), ("c", 8.0)], "name string, kappa double")
    out = C.named_report(t, p, r)
    assert out.columns == ["name", "kappa", "d", "kappa_3"]
    assert {tuple(x) for x in out.collect()} == {("a", 1.0, 0.5, None), ("b", 2.0, None, 9.0), (None, 3.0, None, None)}
    assert C.named_report(t.limit(0), p).count() == 0
    with pytest.raises(ValueError, match="repeats"):
        C.named_report(t, p.union(p))
