"""The bucketed path of the ordered operators against the plain one."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rasterlab.functions.hashing import hash32
from rasterlab.operators import metrics as M, ordered as O, resample as B
from rasterlab.session import broadcast_if_small


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    n = 4000
    # a third of the rows share one value, and one key holds most of them
    v = np.where(rng.random(n) < 0.33, 7.5, np.round(rng.exponential(100, n), 2))
    pdf = pd.DataFrame({"key": np.where(rng.random(n) < 0.8, "hot", "cold"), "value": v,
                        "y": (rng.random(n) < 0.4).astype(int)})
    return spark.createDataFrame(pdf).cache(), pdf


@pytest.mark.parametrize("rows", [None, 100])
def test_quantiles(data, rows):
    df, pdf = data
    got = O.quantiles(df, ["key"], "value", {"a": .05, "b": .5, "c": .975}, rows_per_bucket=rows).collect()
    assert len(got) == 2
    for r in got:
        want = np.percentile(pdf[pdf.key == r["key"]].value, [5, 50, 97.5])
        assert [r["a"], r["b"], r["c"]] == pytest.approx(list(want), rel=1e-12)


@pytest.mark.parametrize("keys", [[], ["key"]])
@pytest.mark.parametrize("descending", [False, True])
def test_running_totals(data, keys, descending):
    df, pdf = data
    sums = {"n": F.count(F.lit(1)), "pos": F.sum("y")}
    got = O.running(df, keys, "value", sums, descending, rows_per_bucket=100).toPandas()
    plain = O.running(df, keys, "value", sums, descending).toPandas()
    cols = [*keys, "value"]
    a, b = (x.sort_values(cols).reset_index(drop=True)[sorted(x.columns)] for x in (got, plain))
    pd.testing.assert_frame_equal(a, b, check_dtype=False)
    assert a.cum_n.max() == a.all_n.max()


def test_buckets_split_the_hot_key(data):
    df, _ = data
    assert O.with_buckets(df, ["key"], "value", 100)[0].select("key", "_bucket").distinct().count() > 20


@pytest.mark.parametrize("rows", [None, 50])
def test_auc_and_youden(data, rows):
    df, pdf = data
    pos, neg = pdf[pdf.y == 1].value.to_numpy(), pdf[pdf.y == 0].value.to_numpy()
    u = (pos[:, None] > neg[None, :]).sum() + .5 * (pos[:, None] == neg[None, :]).sum()
    assert M.auc(df, "value", "y", rows_per_bucket=rows).first()[0] == pytest.approx(u / len(pos) / len(neg))
    got = M.youden(df, "value", "y", rows_per_bucket=rows).first()
    s = -pdf.value if got["flipped"] else pdf.value
    cuts = np.unique(s)[::-1]
    j = [(s[pdf.y == 1] >= t).mean() - (s[pdf.y == 0] >= t).mean() for t in cuts]
    assert got["sensitivity"] + got["specificity"] - 1 == pytest.approx(max(j))


@pytest.mark.parametrize("objective", ["youden", "kappa"])
def test_midpoint_threshold(data, objective):
    df, pdf = data
    got = M.threshold_by_midpoints(df, "value", "y", objective, rows_per_bucket=60).first()["threshold"]
    u = np.unique(pdf.value)
    y = pdf.y.to_numpy()
    best = []
    for t in (u[:-1] + u[1:]) / 2:
        p = (pdf.value >= t).to_numpy().astype(int)
        if objective == "youden":
            s = p[y == 1].mean() - p[y == 0].mean()
        else:
            po, pe = (p == y).mean(), p.mean() * y.mean() + (1 - p.mean()) * (1 - y.mean())
            s = (po - pe) / (1 - pe)
        best.append((round(s, 12), t))
    top = max(b[0] for b in best)
    assert got == pytest.approx(np.median([t for s, t in best if s == top]))


def test_single_score_threshold(spark):
    df = spark.createDataFrame([(0.3, 1), (0.3, 0)], "s double, y int")
    assert M.threshold_by_midpoints(df, "s", "y").first()["threshold"] == 0.5


def test_hash_rank_is_a_ranking(spark):
    df = spark.range(3000).withColumn("k", F.col("id") % 2).withColumn("h", hash32(F.lit("a"), F.col("id")))
    got = O.hash_rank(df, ["k"], "h", ["id"], buckets=16).toPandas()
    for _, g in got.groupby("k"):
        g = g.sort_values(["h", "id"])
        assert list(g.rank0) == list(range(len(g)))


def test_group_folds_are_balanced_and_whole(spark):
    df = spark.range(2000).select(F.col("id"), (F.col("id") % 200).alias("g"), (F.col("id") % 200 < 80).cast("int").alias("y"))
    folds = B.group_folds(df, "g", "y", 42, 5, repeats=2).toPandas()
    assert len(folds) == 400
    per = folds.groupby(["repeat", "fold", "label"]).size().unstack()
    assert (per[1] == 16).all() and (per[0] == 24).all()
    a, b = (folds[folds["repeat"] == r].sort_values("g").fold.tolist() for r in (0, 1))
    assert a != b


def test_bootstrap_against_the_multinomial_law(spark):
    df = spark.range(300).select((F.col("id") % 10 < 6).cast("int").alias("y"), (F.col("id") % 10 < 7).cast("int").alias("p"))
    got = B.bootstrap_counts(df, F.col("y"), F.col("p"), 2000).toPandas()
    assert len(got) == 2000 and (got[["tn", "fp", "fn", "tp"]].sum(axis=1) == 300).all()
    for cell, share in (("tn", 0.3), ("fp", 0.1), ("fn", 0.0), ("tp", 0.6)):
        assert got[cell].mean() == pytest.approx(300 * share, abs=0.6)
        assert got[cell].var() == pytest.approx(300 * share * (1 - share), rel=0.12)
    assert B.bootstrap_counts(df.limit(0), F.col("y"), F.col("p"), 20).count() == 0



def test_broadcast_only_within_bound(spark):
    small = spark.range(10)
    plan = lambda d: d._jdf.queryExecution().logical().toString()
    assert "broadcast" in plan(broadcast_if_small(small, 10))
    assert "broadcast" not in plan(broadcast_if_small(small, 9))
