"""Methods fitted and compared on the embedding table."""

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from rasterlab import params as P
from rasterlab.operators import fold_fits as FF, fold_trees as FT, metrics as M, ml as L, paired as C, variants as V
from rasterlab.plans import fixtures as X
from rasterlab.plans.registry import query, rnd, table
from rasterlab.session import cut_lineage


def _data(spark, d):
    return table(spark, d, "embeddings").select(
        F.col("vec_id").alias("id"), (F.col("label") < 5).cast("int").alias("y"),
        array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))


def _table(spark, d, *methods, k=2):
    return L.compared(L.evaluate(_data(spark, d), [L.Method(n, f) for n, f in methods], repeats=1, k=k))


SMALL_BOOST = L.boosting(2, 3, 0.1)
SMALL_FOREST = L.forest(10, depth=4)


@query("boosting_cv")
def boosting_cv(spark, d):
    return _table(spark, d, ("boost d2", SMALL_BOOST), ("stumps", L.boosting(1, 3, 0.1, subsample=0.8)))


@query("forest_cv")
def forest_cv(spark, d):
    return _table(spark, d, ("forest", SMALL_FOREST), ("forest leaf2 balanced", L.forest(10, 2, "balanced", depth=4)),
                  ("forest half", L.forest(10, 1, 0.5, depth=4)))


@query("linear_cv")
def linear_cv(spark, d):
    """Five repeats of five folds."""
    return L.compared(cut_lineage(FF.evaluate(_data(spark, d), [
        ("logistic L2", FF.Logistic()), ("logistic L1 balanced", FF.Logistic(0.5, True, "balanced")), ("naive bayes", FF.Bayes())])))


# The deal of the folds, and the training rows of each as a table: 64 values a row, y and the fold they are kept from.
FOLDS = f"""(SELECT vec_id AS id, (label < 5)::int AS y, embedding::double[] AS v, repeat, ((row_number() OVER (PARTITION BY repeat, (label < 5)::int
    ORDER BY ('0x' || substr(md5(({P.SEED} + repeat) || ':' || vec_id), 1, 8))::bigint, vec_id) - 1) % 5)::int AS own
  FROM embeddings, (SELECT unnest(range(0, {{repeats}}))::int AS repeat))"""
TRAINED = "(SELECT f.id, f.y, f.v, f.repeat, k.fold FROM folds f, (SELECT unnest(range(0, 5))::int AS fold) k WHERE f.own <> k.fold)"


@query("bayes_cv_scores", f"""
  WITH folds AS {FOLDS.format(repeats=5)}, t AS {TRAINED},
  u AS (SELECT repeat, fold, y, unnest(v) AS e, generate_subscripts(v, 1) AS pos FROM t),
  g AS (SELECT repeat, fold, y, pos, count(*) AS n, avg(e) AS mean, var_pop(e) AS var FROM u GROUP BY ALL),
  w AS (SELECT repeat, fold, max(var) AS top FROM (SELECT repeat, fold, pos, var_pop(e) AS var FROM u GROUP BY ALL) GROUP BY ALL),
  m AS (SELECT g.repeat, g.fold, y, pos, n, mean, var + 1e-9 * top AS var FROM g JOIN w USING (repeat, fold)),
  x AS (SELECT id, y AS own_y, repeat, own AS fold, unnest(v) AS e, generate_subscripts(v, 1) AS pos FROM folds),
  s AS (SELECT x.id, x.own_y, x.repeat, x.fold, m.y, ln(any_value(m.n)) - 0.5 * sum(ln(2 * pi() * m.var) + (e - m.mean) * (e - m.mean) / m.var) AS l
        FROM x JOIN m ON x.repeat = m.repeat AND x.fold = m.fold AND x.pos = m.pos GROUP BY ALL)
  SELECT repeat, fold, id, own_y AS y, {rnd('1 / (1 + exp(least(700, sum(CASE WHEN y = 0 THEN l ELSE -l END))))')} AS score FROM s GROUP BY repeat, fold, id, own_y""")
def bayes_cv_scores(spark, d):
    scored = FF.evaluate(_data(spark, d), [("naive bayes", FF.Bayes())])
    return scored.select("repeat", "fold", "id", "y", F.round("score", 6).alias("score"))


@query("fold_correlations", f"""
  WITH folds AS {FOLDS.format(repeats=2)}, t AS {TRAINED},
  u AS (SELECT id, repeat, fold, unnest(v) AS e, generate_subscripts(v, 1)::int - 1 AS pos FROM t)
  SELECT a.repeat, a.fold, a.pos AS i, b.pos AS j, {rnd('corr(a.e, b.e)')} AS corr FROM u a JOIN u b
    ON a.id = b.id AND a.repeat = b.repeat AND a.fold = b.fold AND a.pos <= b.pos GROUP BY 1, 2, 3, 4""")
def fold_correlations(spark, d):
    """What principal axes and scaling of every fold follow from."""
    return FF.fold_correlations(_data(spark, d), 2).withColumn("corr", F.round("corr", 6))


@query("stump_cv_scores", f"""
  WITH folds AS {FOLDS.format(repeats=5)}, t AS {TRAINED},
  q AS (SELECT pos, unnest(quantile_cont(e, [i / {FT.BINS}.0 FOR i IN range(1, {FT.BINS})])) AS cut, unnest(range(1, {FT.BINS})) AS c
        FROM (SELECT unnest(embedding::double[]) AS e, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY pos),
  u AS (SELECT repeat, fold, y::double AS y, unnest(v) AS e, generate_subscripts(v, 1) AS pos FROM t),
  a AS (SELECT repeat, fold, count(*)::double AS n, sum(y::double) AS s FROM t GROUP BY ALL),
  l AS (SELECT repeat, fold, u.pos, c, cut, count(*)::double AS nl, sum(y) AS sl FROM u JOIN q ON u.pos = q.pos AND u.e <= q.cut GROUP BY ALL),
  g AS (SELECT l.*, n, s, round((sl * sl / nl + (s - sl) * (s - sl) / (n - nl) - s * s / n) / n, 10) AS gain FROM l JOIN a USING (repeat, fold) WHERE nl < n),
  b AS (SELECT * FROM g WHERE gain > 0 QUALIFY row_number() OVER (PARTITION BY repeat, fold ORDER BY gain DESC, pos, c) = 1)
  SELECT f.repeat, f.own AS fold, f.id, f.y, {rnd('CASE WHEN b.cut IS NULL THEN a.s / a.n WHEN f.v[b.pos] <= b.cut THEN b.sl / b.nl ELSE (b.s - b.sl) / (b.n - b.nl) END')} AS score
  FROM folds f JOIN a ON a.repeat = f.repeat AND a.fold = f.own LEFT JOIN b ON b.repeat = f.repeat AND b.fold = f.own""")
def stump_cv_scores(spark, d):
    """Trees of one cut in five repeats of five folds."""
    scored = FT.evaluate(_data(spark, d), [("stump", FT.Forest(1, depth=1, features=0, bootstrap=False))])
    return scored.select("repeat", "fold", "id", "y", F.round("score", 6).alias("score"))


@query("forest_folds")
def forest_folds(spark, d):
    """Five repeats of five folds, forests of 400 full trees."""
    return L.compared(cut_lineage(FT.evaluate(_data(spark, d), [("forest", FT.Forest())])))


@query("boosting_folds")
def boosting_folds(spark, d):
    """Five repeats of five folds, 100 rounds."""
    return L.compared(cut_lineage(FT.evaluate(_data(spark, d), [("boost d2", FT.Boosting())])))


@query("svm_cv")
def svm_cv(spark, d):
    return _table(spark, d, ("svm", L.linear_svm(k=2)))


@query("vote_cv")
def vote_cv(spark, d):
    return _table(spark, d, ("vote", L.vote(L.logistic(), SMALL_FOREST)))


@query("undersample_cv")
def undersample_cv(spark, d):
    return _table(spark, d, ("bagged", L.undersampled(L.logistic(), 3)))


@query("calibration")
def calibration(spark, d):
    return _table(spark, d, ("sigmoid", L.calibrated(SMALL_FOREST, k=2)),
                  ("isotonic", L.calibrated(SMALL_FOREST, "isotonic", k=2)))


@query("tuned_threshold_cv")
def tuned_threshold_cv(spark, d):
    return _table(spark, d, ("midpoints", L.tuned_threshold(L.logistic(), "youden", k=2)),
                  ("grid", L.tuned_threshold(L.logistic(), M.kappa, grid=True, k=2)),
                  ("in sample", L.insample_threshold(L.logistic())))


@query("pca_cv")
def pca_cv(spark, d):
    """Five repeats of five folds."""
    return L.compared(cut_lineage(FF.evaluate(_data(spark, d), [
        ("pca", FF.Logistic(components=8)), ("pca without first", FF.Logistic(components=8, drop_first=True))])))


@query("quantile_cv")
def quantile_cv(spark, d):
    return _table(spark, d, ("quantile", L.quantile_normal(L.logistic(), 20)))


@query("selection_cv")
def selection_cv(spark, d):
    return _table(spark, d, ("top 10", L.selected_topk(L.logistic(), 10, 10)), ("l1", L.selected_l1(L.logistic(), 0.5)))


@query("rfe_cv")
def rfe_cv(spark, d):
    return _table(spark, d, ("rfe", L.selected_rfe(L.logistic(), 40, 5, 12)))


@query("k_sweep")
def k_sweep(spark, d):
    inside = L.k_sweep(_data(spark, d), L.logistic(), [3, 10], 1, 2, 10)
    leaky = L.k_sweep(_data(spark, d), L.logistic(), [3, 10], 1, 2, 10, leaky=True)

    def mean(f):
        return f.groupBy("k").agg(F.avg("kappa").alias("kappa"), F.avg("accuracy").alias("accuracy"))
    return C.leakage_gap(mean(inside), mean(leaky))


@query("nested_cv")
def nested_cv(spark, d):
    report, _ = L.nested_cv(_data(spark, d), [("C=1", L.logistic(1.0)), ("C=0.01", L.logistic(0.01))], 2, 2)
    return report


@query("grid_search_cv")
def grid_search_cv(spark, d):
    return _table(spark, d, ("tuned C", L.grid_search([("1", L.logistic(1.0)), ("0.01", L.logistic(0.01))], "auc", 2)))


@query("finalists_fresh_seeds")
def finalists_fresh_seeds(spark, d):
    scored = L.evaluate(_data(spark, d), [L.Method("base", L.logistic(1.0)), L.Method("strong", L.logistic(0.01))],
                        repeats=2, k=2, seed=P.SEED + P.HOLDOUT_SEED_OFFSET)
    return C.paired_delta(M.fold_metrics(scored, ["name", "repeat", "fold"], with_auc=False), "base")


@query("final_model_scores")
def final_model_scores(spark, d):
    wide, cols = X.wide_features(spark, d)
    scorer, config = L.final_fit(wide, cols, [("C=1", L.logistic(1.0))], repeats=2, k=2)
    return L.score_rows(wide, scorer, config)


KNN_FOLD = """(row_number() OVER (PARTITION BY y ORDER BY ('0x' || substr(md5('7:' || id), 1, 8))::bigint, id) - 1) % 4"""


@query("knn", f"""
  WITH e AS (SELECT vec_id AS id, (label < 5)::int AS y, embedding::double[] AS v FROM embeddings),
  f AS (SELECT *, {KNN_FOLD} AS fold FROM e),
  p AS (SELECT a.id, b.y, row_number() OVER (PARTITION BY a.id ORDER BY round(pow(list_distance(a.v, b.v), 2), 9), b.id) AS rn
        FROM f a JOIN f b ON a.fold = 0 AND b.fold > 0)
  SELECT id, {rnd('avg(y)')} AS score FROM p WHERE rn <= 5 GROUP BY 1""")
def knn(spark, d):
    from rasterlab.operators.resample import inner_folds
    f = inner_folds(_data(spark, d), "id", "y", 7)
    out = L.nearest_scores(f.where(F.col("fold") > 0), f.where(F.col("fold") == 0), 5, block_rows=200)
    return out.withColumn("score", F.round("score", 6))


@query("knn_cv")
def knn_cv(spark, d):
    return _table(spark, d, ("5 nearest", L.nearest()), ("7 by distance", L.nearest(7, True)))


@query("knn_cv_scores", f"""
  WITH folds AS {FOLDS.format(repeats=1)}, t AS {TRAINED},
  s AS (SELECT fold, list(sd ORDER BY pos) AS sd FROM (SELECT fold, pos, stddev_samp(e) AS sd FROM (
        SELECT fold, unnest(v) AS e, generate_subscripts(v, 1) AS pos FROM t) GROUP BY 1, 2) GROUP BY 1),
  a AS (SELECT f.id, f.y, f.own AS fold, list_transform(list_zip(f.v, s.sd), lambda z: z[1] / z[2]) AS v FROM folds f JOIN s ON s.fold = f.own),
  b AS (SELECT t.id, t.y, t.fold, list_transform(list_zip(t.v, s.sd), lambda z: z[1] / z[2]) AS v FROM t JOIN s ON s.fold = t.fold),
  p AS (SELECT a.id, a.fold, a.y AS own_y, b.y, row_number() OVER (PARTITION BY a.id ORDER BY round(pow(list_distance(a.v, b.v), 2), 9), b.id) AS rn
        FROM a JOIN b ON a.fold = b.fold)
  SELECT 0 AS repeat, fold, id, own_y AS y, {rnd('avg(y)')} AS score FROM p WHERE rn <= 5 GROUP BY fold, id, own_y""")
def knn_cv_scores(spark, d):
    """Nearest neighbours through the harness: columns scaled inside each of five folds."""
    scored = L.evaluate(_data(spark, d), [L.Method("5 nearest", L.nearest())], repeats=1)
    return scored.select("repeat", "fold", "id", "y", F.round("score", 6).alias("score"))


@query("variant_finalists")
def variant_finalists(spark, d):
    """Variants of two estimators by weight and cut in one repeat of five folds; the three best again on unused seeds, beside the plain one."""
    methods = V.crossed(["logistic", "naive bayes"], ["", "balanced"], cuts=["", "cut 0.6"])
    rows = _data(spark, d)
    best = V.finalists(methods, L.compared(cut_lineage(L.evaluate(rows, methods, repeats=1))), 3)
    again = [methods[0], *[m for m in best if m.name != methods[0].name]]
    scored = L.evaluate(rows, again, repeats=1, seed=P.SEED + P.HOLDOUT_SEED_OFFSET)
    return C.paired_delta(M.fold_metrics(scored, ["name", "repeat", "fold"], with_auc=False), methods[0].name)
