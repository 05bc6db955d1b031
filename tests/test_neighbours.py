"""Nearest rows by cells against all pairs."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector

from rasterlab.operators import neighbours as N


def frame(spark, x, first=0):
    rows = [(first + i, int(i % 3 == 0), [float(v) for v in r]) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "id long, y int, x array<double>").select("id", "y", array_to_vector("x").alias("features")).repartition(3)


def brute(train, test, k):
    d = np.round(((test[:, None] - train[None]) ** 2).sum(-1), 9)
    return {i: sorted(zip(d[i].tolist(), range(len(train))))[:k] for i in range(len(test))}


def found(rows):
    got = {}
    for r in rows.collect():
        got.setdefault(r.id - 10_000, []).append((r.d2, r.tid))
    return {i: sorted(v) for i, v in got.items()}


@pytest.mark.parametrize("kind", ["clusters", "grid", "copies"])
def test_equal_to_all_pairs_with_fewer_of_them(spark, kind):
    r = np.random.default_rng(5)
    if kind == "clusters":
        centre = r.normal(0, 50, (40, 4))
        train, test = (centre[r.integers(0, 40, n)] + r.normal(size=(n, 4)) for n in (3000, 300))
    elif kind == "grid":
        train, test = (r.integers(0, 8, (n, 2)).astype(float) for n in (600, 60))  # ties and repeated rows
    else:
        train, test = np.repeat(np.eye(3), [400, 5, 2], axis=0), np.eye(3)
    pairs = spark.sparkContext.accumulator(0)
    got = found(N.nearest_rows(frame(spark, train), frame(spark, test, 10_000), 5, block_rows=150, pairs=pairs))
    want = brute(train, test, 5)
    assert got.keys() == want.keys()
    for i in want:
        assert [t for _, t in got[i]] == [t for _, t in want[i]]
        assert np.allclose([d for d, _ in got[i]], [d for d, _ in want[i]], atol=1e-6)
    if kind == "clusters":
        assert pairs.value < len(train) * len(test) / 10


def test_few_or_no_rows(spark):
    x = np.arange(6.0).reshape(3, 2)
    assert {i: len(v) for i, v in found(N.nearest_rows(frame(spark, x), frame(spark, x, 10_000), 5)).items()} == {0: 3, 1: 3, 2: 3}
    assert N.nearest_rows(frame(spark, x).where("id < 0"), frame(spark, x), 5).count() == 0
    assert N.nearest_rows(frame(spark, x), frame(spark, x).where("id < 0"), 5).count() == 0


def test_rows_are_sent_to_areas_not_to_cells_and_blocks(spark):
    """Where nothing can be ruled out, a searching row is sent no more often however small the blocks."""
    r = np.random.default_rng(6)
    train, test = r.normal(size=(2000, 32)), r.normal(size=(200, 32))
    sent = spark.sparkContext.accumulator(0)
    got = found(N.nearest_rows(frame(spark, train), frame(spark, test, 10_000), 5, block_rows=20, sent=sent))
    want = brute(train, test, 5)
    assert all([t for _, t in got[i]] == [t for _, t in want[i]] for i in want)
    assert 0 < sent.value <= 2 * 3 * len(test)  # two rounds; three areas of this many pairs
