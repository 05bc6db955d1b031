"""Fits from moments and Newton steps of all folds against plain numpy."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from rasterlab.operators import fold_fits as FF
from rasterlab.operators.ml import with_folds


@pytest.fixture(scope="module")
def data(spark):
    r = np.random.default_rng(7)
    x = r.normal(size=(160, 5)) * [1, 2, 5, 0.1, 1] + [0, 100, -3, 0, 1e6]
    y = (x[:, 0] + 0.3 * x[:, 2] + r.normal(size=160) > -0.8).astype(int)
    rows = [(i, int(y[i]), [*map(float, x[i]), 3.0]) for i in range(160)]  # the last column is constant
    df = spark.createDataFrame(rows, "id long, y int, x array<double>").select("id", "y", array_to_vector("x").alias("features")).repartition(4)
    folds = {r.id: r.folds for r in with_folds(df, 42, 4, 2, "id").select("id", "folds").collect()}
    return df, np.column_stack([x, np.full(160, 3.0)]), y, folds


def part(data, r, f):
    _, x, y, folds = data
    mine = np.array([folds[i][r] != f for i in range(len(y))])
    return x[mine], y[mine], x[~mine], np.flatnonzero(~mine)


def scores(out):
    got = {}
    for r in out.collect():
        got.setdefault((r.name, r.repeat, r.fold), {})[r.id] = r.score
    return got


def scaled(x, z):
    mean, sd = x.mean(axis=0), x.std(axis=0, ddof=1)
    keep = sd > 1e-9
    return ((x - mean)[:, keep] / sd[keep], (z - mean)[:, keep] / sd[keep])


def test_gaussian_classes(data):
    got = scores(FF.evaluate(data[0], [("nb", FF.Bayes())], 2, 4))
    for (_, r, f), s in got.items():
        x, y, z, ids = part(data, r, f)
        eps = 1e-9 * x.var(axis=0).max()
        log = []
        for c in (0, 1):
            m, v = x[y == c].mean(axis=0), x[y == c].var(axis=0) + eps
            log.append(np.log((y == c).mean()) - 0.5 * (np.log(2 * np.pi * v) + (z - m) ** 2 / v).sum(axis=1))
        want = 1 / (1 + np.exp(log[0] - log[1]))
        assert np.allclose([s[i] for i in ids], want, atol=1e-6)
    assert len(got) == 8


@pytest.mark.parametrize("spec", [FF.Logistic(), FF.Logistic(0.3, weights="balanced"), FF.Logistic(2.0, weights=0.5), FF.Logistic(0.2, l1=True),
                                  FF.Logistic(components=3), FF.Logistic(components=3, drop_first=True)])
def test_logistic_is_at_its_minimum(data, spec):
    got = scores(FF.evaluate(data[0], [("m", spec)], 2, 4))
    for (_, r, f), s in got.items():
        x, y, z, ids = part(data, r, f)
        a, b = scaled(x, z)
        if spec.components:
            _, _, axes = np.linalg.svd(a, full_matrices=False)
            axes = axes[int(spec.drop_first):spec.components]
            a, b = a @ axes.T, b @ axes.T
        n = np.bincount(y)
        w = {None: np.ones(2), "balanced": len(y) / (2 * n)}.get(spec.weights, np.array([1.0, spec.weights or 0]) if not isinstance(spec.weights, str) else None)
        # the coefficients behind the scores
        logit = np.log([s[i] / (1 - s[i]) for i in ids])
        coef = np.linalg.lstsq(np.column_stack([b, np.ones(len(b))]), logit, rcond=None)[0]
        p = 1 / (1 + np.exp(-(a @ coef[:-1] + coef[-1])))
        g = (w[y] * (p - y)) @ a
        assert abs((w[y] * (p - y)).sum()) < 1e-4
        if spec.l1:
            zero = np.abs(coef[:-1]) < 1e-7
            assert np.allclose(g[~zero], -np.sign(coef[:-1][~zero]) / spec.c, atol=1e-4)
            assert (np.abs(g[zero]) <= 1 / spec.c + 1e-4).all()
        else:
            assert np.allclose(g, -coef[:-1] / spec.c, atol=1e-4)


def test_several_methods_share_the_passes_and_rows_come_once(data):
    out = FF.evaluate(data[0], [("a", FF.Bayes()), ("b", FF.Logistic()), ("c", FF.Logistic(0.1))], 3, 4)
    assert out.count() == 3 * 3 * 160
    assert out.groupBy("name", "repeat", "id").count().where("count > 1").isEmpty()


def test_a_fold_with_one_class_and_repeated_ids(spark):
    rows = [(i % 9, 0, [float(i), 1.0]) for i in range(20)]
    df = spark.createDataFrame(rows, "id long, y int, x array<double>").select("id", "y", array_to_vector("x").alias("features"), F.lit(1).alias("score"))
    out = FF.evaluate(df, [("nb", FF.Bayes()), ("l", FF.Logistic())], 1, 3)
    assert {r.score for r in out.where("name = 'nb'").collect()} == {0.0} and out.where("name = 'nb'").count() == 20


def test_axes_are_those_of_a_decomposition(data):
    a, _ = scaled(data[1][:, :5], data[1][:, :5])
    cov = a.T @ a / (len(a) - 1)
    _, sing, axes = np.linalg.svd(a, full_matrices=False)
    got = FF.principal_axes(cov, 3)
    assert np.allclose(np.abs(got.T @ axes[:3].T), np.eye(3), atol=1e-8)
    assert np.allclose(FF.explained_shares(cov), sing ** 2 / (sing ** 2).sum())
