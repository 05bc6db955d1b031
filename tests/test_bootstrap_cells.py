"""Bootstrap counts drawn as multinomial cells."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterlab.operators import resample as B


@pytest.mark.parametrize("n, p", [(1, 0.5), (7, 0.3), (40, 0.02), (300, 0.97), (0, 0.4)])
def test_binomial_quantiles(n, p):
    cdf = np.cumsum([math.comb(n, k) * p ** k * (1 - p) ** (n - k) for k in range(n + 1)])
    u = np.random.default_rng(1).random(500)
    want = [int(np.flatnonzero(cdf >= v - 1e-15)[0]) for v in u]
    assert B.binomial_quantile(u, np.full(500, n), p).tolist() == want


def test_binomial_at_the_ends():
    n = np.array([0, 5, 9])
    assert B.binomial_quantile(np.full(3, 0.5), n, 0.0).tolist() == [0, 0, 0]
    assert B.binomial_quantile(np.full(3, 0.5), n, 1.0).tolist() == [0, 5, 9]


def test_a_billion_rows():
    """Mean and spread are those of the law, and no row is drawn."""
    u = (np.arange(400) + 0.5) / 400
    k = B.binomial_quantile(u, np.full(400, 10 ** 9), 0.3)
    assert abs(k.mean() - 3e8) < 50 and k.std() == pytest.approx(math.sqrt(1e9 * 0.21), rel=0.02)


def test_cells_of_a_table(spark):
    rows = [(0, 0)] * 50 + [(0, 1)] * 10 + [(1, 1)] * 40
    df = spark.createDataFrame(rows, "y int, p int")
    out = B.bootstrap_cells(df, F.col("y"), F.col("p"), 3000).toPandas()
    assert (out[B.CELLS].sum(axis=1) == 100).all() and (out["fn"] == 0).all() and out["replicate"].nunique() == 3000
    assert out["tn"].mean() == pytest.approx(50, abs=0.4) and out["tn"].var() == pytest.approx(25, rel=0.1)
    assert out["fp"].var() == pytest.approx(9, rel=0.1)
    assert np.cov(out["tn"], out["fp"])[0, 1] == pytest.approx(-5, abs=1)
    again = B.bootstrap_cells(df.repartition(7), F.col("y"), F.col("p"), 3000).toPandas()
    assert out.sort_values("replicate").reset_index(drop=True).equals(again.sort_values("replicate").reset_index(drop=True))


def test_empty_table(spark):
    df = spark.createDataFrame([], "y int, p int")
    assert B.bootstrap_cells(df, F.col("y"), F.col("p"), 10).count() == 0
