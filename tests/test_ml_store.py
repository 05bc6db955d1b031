"""Methods, the harness, sinks and the registered queries."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from conftest import SF
from rasterlab import params as P
from rasterlab.functions import rules as R, scalar as S
from rasterlab.operators import audit as A, metrics as M, ml as L, scans as T
from rasterlab.plans import ORACLES, QUERIES
from rasterlab.sources import sinks as W, tables as Tb


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(0)
    n = 160
    y = (np.arange(n) % 8 < 5).astype(int)
    x = rng.normal(size=(n, 5))
    x[:, 2] += 2.0 * y
    x[:, 4] = 0.0
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(n), "y": y, "x": x.tolist()}), "id bigint, y int, x array<double>")
    return df.select("id", "y", array_to_vector("x").alias("features")).cache(), x, y


def scores(df, fit, seed=1):
    scorer, thr = fit(df.where("id < 120"), seed)
    rows = scorer(df.where("id >= 120")).select("id", "y", "score").orderBy("id").toPandas()
    return rows, thr


@pytest.mark.parametrize("name,fit", [
    ("boost", L.boosting(2, 5)), ("forest", L.forest(20, weights="balanced")), ("l2", L.logistic()),
    ("l1", L.logistic(0.5, True, 0.5)), ("nb", L.gaussian_nb()), ("knn", L.nearest(5, block_rows=50)),
    ("vote", L.vote(L.logistic(), L.gaussian_nb())), ("pca", L.pca(L.logistic(), 3)),
    ("quantile", L.quantile_normal(L.logistic(), 20)), ("topk", L.selected_topk(L.logistic(), 2, 20)),
    ("isotonic", L.calibrated(L.logistic(), "isotonic")), ("bagged", L.undersampled(L.logistic(), 2)),
    ("inner", L.tuned_threshold(L.logistic(), "youden", k=3)), ("grid", L.tuned_threshold(L.logistic(), grid=True, k=3)),
    ("config", L.from_config("random_forest", {"n_estimators": 15, "max_depth": 4, "min_samples_leaf": 2}))])
def test_methods_learn(data, name, fit):
    rows, thr = scores(data[0], fit)
    assert len(rows) == 40 and rows.score.between(-1e-9, 1 + 1e-9).all() and 0 <= thr <= 1
    pos, neg = rows[rows.y == 1].score.to_numpy(), rows[rows.y == 0].score.to_numpy()
    auc = ((pos[:, None] > neg).sum() + .5 * (pos[:, None] == neg).sum()) / len(pos) / len(neg)
    assert auc > (0.7 if name == "knn" else 0.8)  # neighbours see the noise columns at full weight


def test_nearest_is_exact(data):
    df, x, y = data
    rows = L.nearest_scores(df.where("id < 120"), df.where("id >= 120"), 5, block_rows=30).orderBy("id").toPandas()
    d = np.linalg.norm(x[120:, None] - x[None, :120], axis=2)
    want = y[:120][np.argsort(d, axis=1)[:, :5]].mean(axis=1)
    assert np.allclose(rows.score, want)


def test_quantile_transform_is_normal():
    assert np.allclose(L._inverse_normal(np.array([.5, .975, .025, .999])), [0, 1.959963985, -1.959963985, 3.090232306])


def test_robust_distance_against_numpy(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 3)) @ np.array([[2, 0, 0], [1, 1, 0], [0, .5, 3]])
    x[:12] += 25
    df = spark.createDataFrame(pd.DataFrame(x, columns=list("abc")).assign(id=range(200), flat=1.0))
    got = A.robust_distance(df, "id", ["a", "b", "c", "flat"]).orderBy("id").toPandas().distance.to_numpy()
    best = None
    for i in range(200):  # every start to its end
        keep = np.isin(np.arange(200), rng.choice(200, 4, replace=False))
        last = None
        while True:
            mean, cov = x[keep].mean(0), np.cov(x[keep].T, bias=True)
            d2 = np.einsum("ij,jk,ik->i", x - mean, np.linalg.pinv(cov), x - mean)
            det = np.linalg.slogdet(cov)[1]
            if last is not None and det >= last - 1e-9:
                break
            last = det if keep.sum() > 4 else None
            keep = d2 <= np.quantile(d2, 0.9)
        if best is None or det < best[0] - 1e-9:
            best = det, d2
    raw = best[1] * 2.3659738843753377 / np.median(best[1])  # the median of the chi-square law of 3
    keep = raw < 9.348403604496148                          # its .975 quantile
    mean, cov = x[keep].mean(0), np.cov(x[keep].T, bias=True)
    want = np.sqrt(np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean))
    assert np.allclose(got, want, rtol=1e-3) and set(np.argsort(-got)[:12]) == set(range(12))


def test_a_cluster_of_a_fifth_of_the_rows_is_found(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 4)) * [1, 3, 1, 2]
    x[:60] = [9, -20, 9, 14] + 0.2 * rng.normal(size=(60, 4))
    df = spark.createDataFrame(pd.DataFrame(x, columns=list("abcd")).assign(id=range(300))).repartition(3)
    got = A.robust_distance(df, "id", list("abcd"), support=0.7).orderBy("id").toPandas().distance.to_numpy()
    assert set(np.argsort(-got)[:60]) == set(range(60)) and got[:60].min() > 3 * np.quantile(got[60:], 0.9)
    plain = x - x.mean(0)
    assert not set(np.argsort(-np.einsum("ij,jk,ik->i", plain, np.linalg.inv(np.cov(x.T)), plain))[:60]) == set(range(60))
    odd = df.withColumn("a", F.when(F.col("id") == 5, F.lit(None)).otherwise(F.col("a")))
    assert A.robust_distance(odd, "id", list("abcd")).count() == 299
    assert A.robust_distance(df.limit(0), "id", list("abcd")).count() == 0


def test_chi_square_quantiles():
    assert np.allclose([A.chi2_quantile(0.5, 3), A.chi2_quantile(0.975, 3), A.chi2_quantile(0.975, 64)],
                       [2.3659738843753377, 9.348403604496148, 88.00405], rtol=1e-6)


def test_robust_distance_goes_on_until_it_converges(spark):
    x = np.random.default_rng(2).normal(size=(200, 3)) + np.repeat([[25.0], [0.0]], [12, 188], axis=0)
    df = spark.createDataFrame(pd.DataFrame(x, columns=list("abc")).assign(id=range(200)))
    with pytest.raises(RuntimeError, match="converge"):
        A.robust_distance(df, "id", list("abc"), steps=1)
    got = A.robust_distance(df, "id", list("abc")).orderBy("id").toPandas().distance.to_numpy()
    assert set(np.argsort(-got)[:12]) == set(range(12))


def test_importances_come_from_trees_as_deep_as_the_library_allows(spark):
    rng = np.random.default_rng(6)
    rows = [(float(y), v.tolist()) for y, v in zip(rng.integers(0, 2, 1500), rng.normal(size=(1500, 3)))]
    df = spark.createDataFrame(rows, "y double, v array<double>").select("y", array_to_vector("v").alias("features"))
    got = L.importances(df, 3, 3)
    assert np.allclose(got, L.importances(df, 3, 3, depth=30)) and not np.allclose(got, L.importances(df, 3, 3, depth=10))


def test_final_model_reads_all_columns(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(L, "final_fit", lambda df, cols, *a, **k: (seen.extend(cols), None))
    monkeypatch.setattr(L, "score_rows", lambda df, *a: df)
    QUERIES["final_model_scores"](spark, SF)
    assert len(seen) == 64


def test_selection(data):
    df, _, _ = data
    record = []
    L.selected_topk(L.logistic(), 1, 20, record)(df, 3)
    L.selected_l1(L.logistic(), 0.05, record)(df, 3)
    assert record[0] == [2] and 2 in record[1]
    assert L.top_indices(np.array([.2, .5, .5, .1]), 2) == [2, 1]


def test_harness_is_repeatable_and_appends(spark, data, tmp_path):
    df = data[0]
    m = [L.Method("a", L.logistic()), L.Method("b", L.logistic(0.001))]
    first = L.evaluate(df, m, 2, 3, sink=str(tmp_path / "partial"))
    again = L.evaluate(df, m, 2, 3)
    a, b = (t.orderBy("name", "repeat", "id").toPandas() for t in (first, again))
    assert len(a) == 2 * 2 * 160
    assert np.allclose(a.score, b.score) and (a.fold == b.fold).all()
    table = L.compared(again).toPandas()
    assert list(table.name)[0] in ("a", "b") and table.kappa.is_monotonic_decreasing


def test_nested_report(data):
    report, oof = L.nested_cv(data[0], [("1", L.logistic()), ("tiny", L.logistic(1e-6))], 3, 2)
    r = report.toPandas()
    assert set(r.fold) == {1, 2, 3} and (r.n_train + r.n_test == 160).all() and oof.count() == 160


def test_final_model_and_scoring(spark, data):
    df, x, y = data
    wide = spark.createDataFrame(pd.DataFrame({"id": range(160), "y": y, **{f"c{i}": x[:, i] for i in range(4)}}))
    scorer, config = L.final_fit(wide, ["c2", "c0"], [("1", L.logistic()), ("2", L.logistic(0.1))], 2, k=3)
    assert config["feature_names"] == ["c2", "c0"] and set(config["training_feature_ranges"]) == {"c2", "c0"}
    out = L.score_rows(wide, scorer, config).toPandas()
    assert (out.label == (out.proba_positive >= config["decision_threshold"])).all()
    assert np.allclose(out.confidence, np.where(out.label == 1, out.proba_positive, 1 - out.proba_positive))
    with pytest.raises(ValueError, match="missing"):
        L.score_rows(wide.drop("c0"), scorer, config)


def test_unknown_names_are_errors(spark, data):
    with pytest.raises(ValueError):
        L.from_config("svm", {})
    with pytest.raises(ValueError):
        L.resolve_features(data[0], ["nope"])


def test_scan_store(spark, tmp_path):
    rows = spark.createDataFrame(
        [(1, "S1", "onion", "research", 0.7), (2, "S2", None, "research", 0.5), (3, "G1", "garlic", "research", 0.9),
         (4, "P1", "onion", "public", 0.2)], "id bigint, sample_code string, crop string, dataset string, pred_proba double")
    scored = T.scored_scan(rows.withColumn("ood_status", F.lit("in_range")), F.lit(0.6746))
    W.append_scans(scored, str(tmp_path))
    W.append_scans(scored.where("id = 1").withColumn("id", F.lit(9).cast("bigint")), str(tmp_path))
    ddl = T.SCANS_DDL.replace("pred_conf float, pred_proba float, decision_threshold float",
                              "pred_conf double, pred_proba double, decision_threshold double").replace("pred_label smallint", "pred_label int")
    stored = Tb.read_store(spark, f"{tmp_path}/scans", ddl)
    assert T.count(stored) == 4 and T.count(stored, {"crop": "onion"}) == 3
    g = stored.where("sample_code = 'G1'").first()
    assert g["pred_label"] is None and g["borderline"] is None and g["synced_at"] is not None
    b = stored.where("id = 2").first()
    assert b["pred_label"] == 0 and b["borderline"] is True and b["compactdry_truth"] is None
    public = spark.read.parquet(f"{tmp_path}/public_scans")
    assert "crop" not in public.columns and "scan_code" in public.columns and public.count() == 1
    newest = T.select(stored, ["id"], newest_by="synced_at", limit=1).first()
    assert newest["id"] == 9
    with pytest.raises(ValueError):
        T.delete_matching(stored, {})
    assert T.delete_matching(stored, {"id": 9}).count() == 3


def test_truth_patches(spark):
    scans = spark.createDataFrame([(1, 1, None), (2, None, None)], "id bigint, compactdry_truth int, truth_recorded_at timestamp")
    p = spark.sql("select 1L id, cast(null as int) compactdry_truth, timestamp'2024-01-02' patched_at union all "
                  "select 1L, 0, timestamp'2024-01-01' union all select 2L, 1, timestamp'2024-01-01'")
    got = {r["id"]: (r["compactdry_truth"], r["truth_recorded_at"] is None) for r in T.record_truth(scans, p).collect()}
    assert got == {1: (None, True), 2: (1, False)}


def test_reports_and_documents(spark, tmp_path):
    t = spark.createDataFrame([("a", 0.5), ("b", None)], "name string, kappa double")
    W.write_report(t, str(tmp_path / "r"))
    assert spark.read.csv(str(tmp_path / "r"), header=True).count() == 2
    W.append_partial(t.where("name = 'a'"), str(tmp_path / "p"))
    W.append_partial(t.where("name = 'b'"), str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2
    doc = W.selection_document(spark, ["x"], [("y", "x", 0.97)], "kappa", {"n_splits": 5, "repeats": 5, "kappa_mean": .5, "accuracy_mean": .7})
    W.write_json(doc, str(tmp_path / "j"))
    back = spark.read.json(str(tmp_path / "j")).first()
    assert back["k"] == 1 and back["dropped_correlated"][0]["duplicate_of"] == "x"


def test_rejects(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0, 0.5, 0.5, "onion"), (5, None, 1.5, 0.5, "leek")],
                                 "pred_label int, compactdry_truth int, pred_conf double, pred_proba double, crop string")
    assert W.split_by_domain(rows, str(tmp_path / "bad")).count() == 1
    assert spark.read.parquet(str(tmp_path / "bad")).first()["problem"] == "pred_label,pred_conf,crop"


def test_blob_debug_groups(spark, golden):
    df = spark.read.csv(golden("severity", "hard_negative"), header=True, inferSchema=True)
    g = df.withColumn("group", S.severity_group(F.col("compactdry"), F.col("severity"), F.col("hard_negative")))
    assert {r[0] for r in g.select("group").distinct().collect()} <= {
        "positive_mild", "positive_severe", "negative_hard", "negative_clean", "positive_moderate"}
    views = df.select("sample_code", F.col("n_small_sharp_blobs_mean").alias("n_small_sharp_blobs"))
    out = W.blob_debug_table(views, df.select("sample_code", "compactdry"), ["n_small_sharp_blobs"])
    assert out.count() == 60 and "n_small_sharp_blobs_max" in out.columns


def test_small_rules(spark):
    one = spark.range(1)
    assert one.select(S.setting_text(F.lit("1/4"))).first()[0] == "0.25"
    assert one.select(S.setting_text(F.lit("100"))).first()[0] == "100"
    assert one.select(S.setting_text(F.lit("1/0"))).first()[0] == "1/0"
    assert one.select(S.base_feature(F.lit("texture_viewmax"))).first()[0] == "texture"
    assert one.select(R.advice_level(F.lit(0), F.lit(True), F.lit(None))).first()[0] == "caution"
    assert one.select(S.span_text(F.lit(0.12664), F.lit(0.0034))).first()[0] == "0.1266"
    assert [R.clamped_limit(v) for v in ("7", 900, None, "x")] == [7, 500, 200, 200]


def test_grid_threshold_prefers_the_middle(spark):
    df = spark.createDataFrame([(0.1, 0), (0.9, 1)], "s double, y int")
    assert M.threshold_by_grid(df, "s", "y").first()["threshold"] == pytest.approx(0.5)


def test_histogram_of_a_constant(spark):
    long = spark.createDataFrame([("f", 1.0, 0), ("f", 1.0, 1)], "feature string, value double, y int")
    assert {r["bin"] for r in A.class_histogram(long, "y").collect()} == {5}


def test_checkpoint_folder_is_the_sessions(spark):
    from rasterlab.session import checkpoint_root, cut_lineage
    assert cut_lineage(spark.range(5)).count() == 5
    assert checkpoint_root(spark) == (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir())


def test_queries_have_rows(spark):
    """A few of the registered queries at the smallest size; tools/check.py
    runs them all against SQL."""
    assert set(ORACLES) <= set(QUERIES)
    for name in ("head_label_join", "youden", "components8", "normalise", "knn"):
        df = QUERIES[name](spark, SF)
        assert df.limit(1).count() == 1, name


def test_bar():
    assert P.PASS_BAR == {"accuracy": 0.80, "recall": 0.80, "kappa": 0.61}


def test_finalists_are_the_best_of_a_comparison(spark):
    from rasterlab.operators import variants as N
    methods = N.crossed(["forest", "svm"], N.WEIGHTS, cuts=N.CUTS)
    assert len(methods) == (len(N.WEIGHTS) + 1) * len(N.CUTS)  # no weights for the margin
    compared = spark.createDataFrame([("forest", .5), ("svm", .7), ("forest | balanced", .7), ("unknown", .9), ("svm | cut 0.6", None)],
                                     "name string, kappa double")
    assert [m.name for m in N.finalists(methods, compared, 4)] == ["forest | balanced", "svm", "forest"]
    fit = N.fixed_cut(0.6)(lambda train, seed: ("scorer", 0.5))
    assert fit(None, 0) == ("scorer", 0.6)


def test_variant_registries(spark, golden):
    from rasterlab.operators import variants as N
    for methods in (N.classifiers(), N.imbalance(), N.boosting_settings(), N.selections(24)):
        names = [m.name for m in methods]
        assert len(names) == len(set(names)) and all(callable(m.fit) for m in methods)
    path = golden("sample_code", "sd_G", "compactdry")
    cols = open(path).readline().strip().split(",")
    df = Tb.read_features(spark, path, Tb.feature_schema(cols[1:-1])).withColumnsRenamed({"sample_code": "id", "compactdry": "y"})
    tables = N.feature_tables(df, ["sd_G", "A_high", "blob_max"], cols[1:-1])
    width = {n: len(t.columns) - 2 for n, t in tables.items()}
    assert width["selected"] == 3 and width["all"] == 24
    assert width["all | ratio"] == 23 and width["selected | ratio + reference"] == 4  # the reference itself goes, or is kept
    assert width["intensity free"] == 13 and width["intensity only"] == 11 and width["intensity free | contrast"] == 17
    assert "mean_G/brightness_mean" in tables["all | ratio"].columns and tables["selected | ratio + reference"].columns[-1] == "brightness_mean"
    assert tables["intensity free | contrast"].count() == 60
    moved = N.stressed(df, "id", 1).join(df.select("id", F.col("sd_G").alias("g"), F.col("A_high").alias("a")), "id")
    r = moved.agg(F.min(F.col("sd_G") / F.col("g")), F.max(F.col("sd_G") / F.col("g")), F.max(F.abs(F.col("A_high") - F.col("a")))).first()
    assert 0.85 <= r[0] < r[1] <= 1.15 and r[2] == 0


def test_boosting_on_the_published_table(spark, golden):
    """One shuffle of the 60 rows; the published kappa over 20 is .62 +- .2 per fold."""
    import json
    path = golden("sample_code", "sd_G", "compactdry")
    cols = open(path).readline().strip().split(",")
    chosen = json.loads(open(golden("dropped_correlated")).read())["features"]
    df = Tb.read_features(spark, path, Tb.feature_schema(cols[1:-1])).withColumnsRenamed({"sample_code": "id", "compactdry": "y"})
    scored = L.evaluate(L.assembled(df, chosen), [L.Method("boost", L.boosting(2, 20, 0.2))], 1, 5)
    s = L.compared(scored).first()
    assert s["auc"] > 0.75 and s["accuracy"] > 0.65 and s["kappa"] > 0.3


def test_k_sweep_grows_one_forest_per_fold(spark, monkeypatch):
    from pyspark.ml.functions import array_to_vector
    from pyspark.sql import functions as F

    from rasterlab.operators import ml as L
    d = spark.range(120).select("id", (F.col("id") % 3 == 0).cast("int").alias("y"), array_to_vector(F.array(*[
        (F.pmod(F.xxhash64("id", F.lit(j)), F.lit(1000)) / 1000.0 + F.when(F.lit(j == 2) & (F.col("id") % 3 == 0), 1.0).otherwise(0.0)) for j in range(5)])).alias("features"))
    alone = {n: L.M.fold_metrics(L.evaluate(d, [L.Method(str(n), L.selected_topk(L.logistic(), n, 5))], 1, 2), ["name", "repeat", "fold"]).orderBy("fold").collect()
             for n in (1, 3)}
    grown, plain = [], L.importances
    monkeypatch.setattr(L, "importances", lambda *a, **k: grown.append(1) or plain(*a, **k))
    got = L.k_sweep(d, L.logistic(), [1, 3], 1, 2, 5).orderBy("k", "fold").collect()
    assert len(grown) == 2
    assert [(r.k, r.fold, round(r.kappa, 9)) for r in got] == [(n, r.fold, round(r.kappa, 9)) for n in (1, 3) for r in alone[n]]
