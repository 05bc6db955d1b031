"""Results on the published 60-row tables."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from rasterlab import params as P
from rasterlab.operators import audit as A, metrics as M, paired as C, quality as Q, scans as T
from rasterlab.sources import tables as S

FEATURES = P.VIEW_FEATURES + P.HEAD_FEATURES


@pytest.fixture(scope="module")
def feats(spark, golden):
    path = golden("sample_code", "sd_G", "compactdry")
    cols = Path(path).read_text().splitlines()[0].split(",")
    return S.read_features(spark, path, S.feature_schema(cols[1:-1])).cache()


@pytest.fixture(scope="module")
def names(feats):
    return [c for c in feats.columns if c not in ("sample_code", "compactdry")]


@pytest.fixture(scope="module")
def oof(spark, golden):
    return S.read_or_empty(spark, golden("y_proba", "fold"), S.OOF_SCHEMA).cache()


def test_feature_names(names):
    assert sorted(names) == sorted(FEATURES)


def test_classes_and_constants(feats, names):
    counts = {r["compactdry"]: r["n"] for r in A.class_counts(feats, "compactdry").collect()}
    assert counts == {1: 35, 0: 25}
    assert feats.agg(A.null_cells(feats)).first()[0] == 0
    const = [r[0] for r in A.constant_features(A.long_form(feats, [], names)).collect()]
    assert const == ["A_low"]
    assert A.duplicate_count(feats, ["sample_code"]).first()[0] == 0


def test_auc_per_feature(feats, names):
    got = {r["feature"]: r["auc_raw"] for r in
           M.auc_ranking(A.long_form(feats, ["compactdry"], names), "compactdry").collect()}
    want = {"sd_G": .838857, "mean_G": .731429, "avg_small_blob_diam_px": .728, "n_small_sharp_blobs": .674286,
            "uv_exclusive_dot_frac": .317714, "A_high": .459429, "A_low": .5}
    for k, v in want.items():
        assert got[k] == pytest.approx(v, abs=1e-6)


def test_redundancy(feats, names, golden):
    kept, dropped = A.prune_redundant(feats, names)
    stored = json.loads(Path(golden("dropped_correlated")).read_text())["dropped_correlated"]
    assert len(kept) == 20
    assert [(a, b) for a, b, _ in dropped] == [(d["feature"], d["duplicate_of"]) for d in stored]
    for (_, _, c), d in zip(dropped, stored):
        assert c == pytest.approx(d["corr"], abs=1e-4)


def test_confusion_and_auc(oof):
    c = M.confusion(oof, F.col("y_true"), F.col("y_pred")).first()
    assert (c["tn"], c["fp"], c["fn"], c["tp"]) == (17, 8, 5, 30)
    assert M.auc(oof, "y_proba", "y_true").first()[0] == pytest.approx(.882286, abs=1e-6)
    err = M.errors(oof, "y_true", "y_pred").groupBy("kind").count().collect()
    assert {r["kind"]: r["count"] for r in err} == {"false_negative": 5, "false_positive": 8}


def test_row_audit(spark, feats, names, golden):
    got = A.robust_z(feats, "sample_code", names).collect()
    want = spark.read.csv(golden("max_robust_z"), header=True,
                          inferSchema=True).collect()
    got = {r["sample_code"]: r for r in got}
    assert len(want) == 60
    for w in want:
        g = got[w["sample_code"]]
        assert g["max_robust_z"] == pytest.approx(w["max_robust_z"], rel=1e-12)
        assert g["worst_feature"] == w["worst_feature"]
        assert g["n_feat_z_gt5"] == w["n_feat_z_gt5"]


def test_robust_distance_ranks_outliers(spark, feats, names, golden):
    got = [r[0] for r in A.robust_distance(feats, "sample_code", names).orderBy(F.desc("distance")).limit(12).collect()]
    want = (spark.read.csv(golden("max_robust_z"), header=True,
                           inferSchema=True).orderBy(F.desc("mcd_dist")).limit(6))
    assert len({r["sample_code"] for r in want.collect()} & set(got)) >= 5


def test_stored_ranges(spark, feats, golden):
    config = S.read_model_config(spark, golden("training_feature_ranges"))
    stored = {r["feature"]: r for r in S.model_ranges(config).collect()}
    got = {r["feature"]: r for r in A.feature_ranges(A.long_form(feats, [], list(stored))).collect()}
    assert len(stored) == 10
    for k, s in stored.items():
        for c in ("min", "max", "p05", "p95"):
            assert got[k][c] == pytest.approx(s[c], rel=1e-12)
    summary = S.model_summary(config).first()
    assert (summary["n_features"], summary["trained_on_n_samples"]) == (10, 60)
    assert summary["decision_threshold"] == pytest.approx(P.DEPLOYED_THRESHOLD)


def test_training_rows_are_in_range(spark, feats, golden):
    ranges = S.model_ranges(S.read_model_config(spark, golden("training_feature_ranges")))
    long = A.long_form(feats, ["sample_code"], FEATURES)
    assert Q.range_check(long, ranges, "sample_code").where("status = 'out_of_range'").count() == 0
    lits = {r["feature"]: (r["min"], r["max"]) for r in ranges.collect()}
    far = {n: F.col(n) * (9 if n == "sd_G" else 1) for n in lits}
    rep = feats.select("sample_code", Q.range_report(far, lits).alias("r")).select("sample_code", "r.*")
    out = rep.where("status = 'out_of_range'").collect()
    assert out and all(r["n_outliers"] == 1 and r["detail"].startswith("sd_G=") for r in out)


def test_fold_metrics_summary(spark, golden):
    f = spark.read.csv(golden("inner_cv_accuracy"), header=True, inferSchema=True)
    m = ["accuracy", "recall", "specificity", "kappa"]
    f = f.withColumn("name", F.lit("x"))
    s, p = M.fold_summary(f, ["name"], m).first(), M.fold_summary(f, ["name"], m, sample=False).first()
    want = {"accuracy": (.783333, .074536, .066667), "recall": (.857143, .142857, .127775),
            "specificity": (.68, .228035, .203961), "kappa": (.544194, .160298, .143375)}
    for k, (mean, samp, pop) in want.items():
        assert s[k] == pytest.approx(mean, abs=1e-6)
        assert s[f"{k}_sd"] == pytest.approx(samp, abs=1e-6)
        assert p[f"{k}_sd"] == pytest.approx(pop, abs=1e-6)


def test_fold_metrics_from_predictions(spark, oof, golden):
    per = M.confusion(oof, F.col("y_true"), F.col("y_pred"), ["fold"])
    r = M.rates(zero_division=0)
    got = {x["fold"]: x for x in per.select("fold", *[r[m].alias(m) for m in ("accuracy", "kappa", "f1")]).collect()}
    want = spark.read.csv(golden("inner_cv_accuracy"), header=True, inferSchema=True).collect()
    for w in want:
        for m in ("accuracy", "kappa", "f1"):
            assert got[w["fold"]][m] == pytest.approx(w[m], abs=1e-9)


def test_leakage_gap(spark, golden):
    g = spark.read.csv(golden("kappa_gap", "acc_gap"), header=True, inferSchema=True)
    gap = C.leakage_gap(g.select("k", F.col("kappa_infold").alias("kappa"), F.col("acc_infold").alias("accuracy")),
                        g.select("k", F.col("kappa_leaky").alias("kappa"), F.col("acc_leaky").alias("accuracy")))
    m = gap.agg(F.avg("kappa_gap"), F.avg("accuracy_gap"), F.count("*")).first()
    assert m[0] == pytest.approx(.037881, abs=1e-6) and m[1] == pytest.approx(.018636, abs=1e-6) and m[2] == 22


def test_stress_delta(spark, golden):
    f = spark.read.csv(golden("condition", "folds_better"), header=True, inferSchema=True)
    d = C.stress_delta(f.where("condition = 'as-measured'"), f.where("condition like 'exposure%'"))
    rows = d.collect()
    assert len(rows) == 30
    assert sum(r["delta"] for r in rows) / 30 == pytest.approx(.004142, abs=1e-6)
    worst = min(rows, key=lambda r: r["delta"])
    assert worst["name"] == "4a quantile(in-fold) RF sel10" and worst["delta"] == pytest.approx(-.019458, abs=1e-6)


def test_t_pvalues(spark, golden):
    f = spark.read.csv(golden("d_kappa_t"), header=True, inferSchema=True)
    rows = f.where("d_kappa_t is not null").select("d_kappa_t", "d_kappa_p").collect()
    assert len(rows) > 20
    for r in rows:
        assert C.t_two_sided(r["d_kappa_t"], 24) == pytest.approx(r["d_kappa_p"], rel=1e-9)


def test_comparison_passes(spark, golden):
    f = spark.read.csv(golden("wins", "losses", "sem"), header=True, inferSchema=True)
    got = {r["name"]: r["passes"] for r in M.ranked(f.drop("passes")).collect()}
    want = {r["name"]: r["passes"].replace("✓", "+").replace("✗", "-") for r in f.collect()}
    assert got == want


def test_importance_tables(spark, golden):
    f = spark.read.csv(golden("feature", "mean_importance"), header=True, inferSchema=True)
    top = A.mean_importance(f.withColumnRenamed("mean_importance", "importance"), 3).collect()
    assert [r["feature"] for r in top] == [r["feature"] for r in f.limit(3).collect()]
    assert A.watch_list(f).first()["watched_max"] is None
    assert A.any_in_top(f, ["sd_G"]).first()[0] is True


def test_samples_with_predictions(feats, oof):
    joined = T.latest_prediction(feats.select("sample_code", "compactdry"), oof.withColumn("row_id", F.col("fold")))
    agree = joined.where(F.col("compactdry") == F.col("pred_label")).count()
    assert joined.count() == 60 and agree == 47


def test_missing_file_is_empty(spark, tmp_path):
    assert S.read_or_empty(spark, str(tmp_path / "none.csv"), S.OOF_SCHEMA).count() == 0
