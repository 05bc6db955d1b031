"""Evaluation queries: ROC, thresholds, folds, bootstrap, paired comparison, audit."""

import numpy as np
from pyspark.sql import functions as F

from rasterlab import params as P
from rasterlab.functions import scalar as S
from rasterlab.functions.hashing import hash32
from rasterlab.operators import audit as A, metrics as M, ml as L, paired as C, resample as B
from rasterlab.plans import fixtures as X
from rasterlab.plans.registry import query, rnd, table

SCO = f"({X.SCORED_SQL})"
LONG = f"({X.LONG_SQL})"


def _round(df, *cols, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in cols})


def h32(key):
    return f"('0x' || substr(md5({key}), 1, 8))::bigint"


def kappa_sql(tn="tn", fp="fp", fn="fn", tp="tp"):
    n = f"({tn} + {fp} + {fn} + {tp})"
    e = f"(({tp} + {fp})::double * ({tp} + {fn}) + ({tn} + {fn})::double * ({tn} + {fp}))"
    return f"((({tp} + {tn})::double * {n} - {e}) / nullif({n}::double * {n} - {e}, 0))"


CELLS = """count(*) FILTER ({y} = 0 AND {p} = 0) AS tn, count(*) FILTER ({y} = 0 AND {p} = 1) AS fp,
  count(*) FILTER ({y} = 1 AND {p} = 0) AS fn, count(*) FILTER ({y} = 1 AND {p} = 1) AS tp"""


# --- data audit ---------------------------------------------------------------

@query("quality_counts", """
  SELECT y, n, null_cells, round(n / all_n, 6) + 0.0 AS share FROM (
    SELECT l.quality AS y, count(*) AS n FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1),
    (SELECT count(*)::double AS all_n, count(*) FILTER (l.quality IS NULL) + count(*) FILTER (l.toxic IS NULL) AS null_cells
     FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)""")
def quality_counts(spark, d):
    joined = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels"), "doc_id", "left")
    nulls = joined.agg(A.null_cells(joined).alias("null_cells"), F.lit(1).alias("_one"))
    counts = A.class_counts(joined.withColumnRenamed("quality", "y"), "y")
    return _round(counts.withColumn("_one", F.lit(1)).join(F.broadcast(nulls), "_one").drop("_one"), "share")


@query("duplicates", """
  SELECT (SELECT count(*) - count(DISTINCT user_id) FROM events) AS duplicate_codes,
         (SELECT count(*) - count(DISTINCT (l_orderkey, l_linenumber)) FROM lineitem) AS duplicate_views""")
def duplicates(spark, d):
    one = F.lit(1).alias("_one")
    a = A.duplicate_count(table(spark, d, "events"), ["user_id"]).select(F.col("duplicates").alias("duplicate_codes"), one)
    b = A.duplicate_count(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"]).select(
        F.col("duplicates").alias("duplicate_views"), one)
    return a.join(b, "_one").drop("_one")


@query("constant_columns", f"""
  SELECT feature FROM (SELECT feature, value FROM {LONG} UNION ALL SELECT 'flat', 0.13 FROM embeddings)
  GROUP BY 1 HAVING min(value) = max(value)""")
def constant_columns(spark, d):
    flat = table(spark, d, "embeddings").select(F.lit("flat").alias("feature"), F.lit(0.13).alias("value"))
    return A.constant_features(X.long_features(spark, d).select("feature", "value").unionByName(flat))


@query("robust_z_audit", f"""
  WITH l AS {LONG}, m AS (SELECT feature, median(value) AS med FROM l GROUP BY 1),
  s AS (SELECT feature, any_value(med) AS med, median(abs(value - med)) * 1.4826 AS rs FROM l JOIN m USING (feature) GROUP BY 1),
  z AS (SELECT id, idx, feature, CASE WHEN rs > 0 THEN abs(value - med) / rs END AS z FROM l JOIN s USING (feature))
  SELECT id, {rnd('max(z)')} AS max_robust_z, first(feature ORDER BY coalesce(z, 0) DESC, idx) AS worst_feature,
         count(*) FILTER (z > 2.5) AS "n_feat_z_gt2.5" FROM z GROUP BY id""")
def robust_z_audit(spark, d):
    wide, cols = X.wide_features(spark, d)
    return _round(A.robust_z(wide, "id", cols, limit=2.5), "max_robust_z")


@query("robust_distance")
def robust_distance(spark, d):
    wide, cols = X.wide_features(spark, d)
    return A.robust_distance(wide, "id", cols)


@query("concentration_step", f"""
  WITH e AS (SELECT label, embedding[1]::double AS a, embedding[2]::double AS b FROM embeddings),
  m AS (SELECT 0 AS start, avg(a) AS ma, avg(b) AS mb, var_pop(a) AS va, var_pop(b) AS vb, covar_pop(a, b) AS ab FROM e
    UNION ALL SELECT 1, avg(a), avg(b), var_pop(a), var_pop(b), covar_pop(a, b) FROM e WHERE label = 0),
  d AS (SELECT start, a, b, (vb * pow(a - ma, 2) - 2 * ab * (a - ma) * (b - mb) + va * pow(b - mb, 2)) / (va * vb - ab * ab) AS d2 FROM e, m),
  c AS (SELECT start, quantile_cont(d2, 0.75) AS cut FROM d GROUP BY 1)
  SELECT start, {rnd('avg(a)')} AS mean_a, {rnd('avg(b)')} AS mean_b, {rnd('var_pop(a)')} AS var_a, {rnd('covar_pop(a, b)')} AS cov_ab, {rnd('var_pop(b)')} AS var_b
  FROM d JOIN c USING (start) WHERE d2 <= cut GROUP BY 1""")
def concentration_step(spark, d):
    """Two starts, all rows and those of one label, through one step side by side."""
    wide, _ = X.wide_features(spark, d, 2)
    rows = wide.select("id", F.array("f00", "f01").alias("x"))
    zero = table(spark, d, "embeddings").where("label = 0").select(F.col("vec_id").alias("id"))
    models = {i: A._moments(part, np.zeros(2)) for i, part in enumerate((rows, rows.join(zero, "id", "left_semi")))}
    got = A.concentrated(rows, models, 0.75, rows.count())
    out = [(i, *(round(float(v), 6) + 0.0 for v in (*m, c[0, 0], c[0, 1], c[1, 1]))) for i, (m, c) in got.items()]
    return spark.createDataFrame(out, "start int, mean_a double, mean_b double, var_a double, cov_ab double, var_b double")


@query("corr_matrix", """
  SELECT a, b, round(corr, 6) + 0.0 AS corr FROM (
    SELECT 'quantity' AS a, 'extendedprice' AS b, abs(corr(q, e)) AS corr FROM o
    UNION ALL SELECT 'quantity', 'discount', abs(corr(q, d)) FROM o
    UNION ALL SELECT 'quantity', 'tax', abs(corr(q, t)) FROM o
    UNION ALL SELECT 'extendedprice', 'discount', abs(corr(e, d)) FROM o
    UNION ALL SELECT 'extendedprice', 'tax', abs(corr(e, t)) FROM o
    UNION ALL SELECT 'discount', 'tax', abs(corr(d, t)) FROM o)""".replace(
    "SELECT a, b, round", """WITH o AS (SELECT l_orderkey, sum(l_quantity) AS q, sum(l_extendedprice) AS e,
      sum(l_discount) AS d, sum(l_tax) AS t FROM lineitem GROUP BY 1) SELECT a, b, round""", 1))
def corr_matrix(spark, d):
    return _round(A.correlation_matrix(_order_features(spark, d), X.VIEW_FEATURES), "corr")


def _order_features(spark, d):
    return X.views(spark, d).groupBy("head").agg(*[F.sum(c).alias(c) for c in X.VIEW_FEATURES])


@query("redundancy_prune", """
  WITH o AS (SELECT l_orderkey, sum(l_quantity) AS q, sum(l_extendedprice) AS e, sum(l_discount) AS d, sum(l_tax) AS t
             FROM lineitem GROUP BY 1)
  SELECT * FROM (SELECT 'extendedprice' AS feature, 'quantity' AS duplicate_of, round(abs(corr(q, e)), 6) + 0.0 AS corr FROM o
    UNION ALL SELECT 'discount', 'quantity', round(abs(corr(q, d)), 6) + 0.0 FROM o
    UNION ALL SELECT 'tax', 'quantity', round(abs(corr(q, t)), 6) + 0.0 FROM o) WHERE corr >= 0.5""")
def redundancy_prune(spark, d):
    _, dropped = A.prune_redundant(_order_features(spark, d), X.VIEW_FEATURES, 0.5)
    out = spark.createDataFrame(dropped, "feature string, duplicate_of string, corr double")
    return _round(out, "corr")


@query("class_histogram", f"""
  WITH l AS {LONG}, r AS (SELECT feature, min(value) AS lo, max(value) AS hi FROM l GROUP BY 1)
  SELECT feature, y, least(floor((value - lo) / (hi - lo) * 11), 10)::int AS bin, count(*) AS n
  FROM l JOIN r USING (feature) GROUP BY 1, 2, 3""")
def class_histogram(spark, d):
    return A.class_histogram(X.long_features(spark, d), "y")


@query("group_means", f"""
  SELECT CASE WHEN l.quality = 1 THEN 'positive_' || d.lang WHEN l.toxic = 1 THEN 'negative_hard' ELSE 'negative_clean' END AS grp,
         {rnd('avg(n_chars)')} AS n_chars FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1""")
def group_means(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    j = docs.join(table(spark, d, "labels"), "doc_id")
    g = S.severity_group(F.col("quality"), F.col("lang"), F.col("toxic") == 1)
    return j.groupBy(g.alias("grp")).agg(F.round(F.avg("n_chars"), 6).alias("n_chars"))


@query("resolved_features", f"""
  SELECT feature, {rnd('avg(value)')} AS mean, feature IN ('f05', 'f01') AS chosen FROM {LONG} GROUP BY 1""")
def resolved_features(spark, d):
    """Means of all feature columns, and which of them a selected list resolves to."""
    wide, _ = X.wide_features(spark, d)
    cols, chosen = L.resolve_features(wide), L.resolve_features(wide, ["f05", "f01"])
    means = wide.agg(*[F.avg(c).alias(c) for c in cols]).unpivot([], cols, "feature", "mean")
    return _round(means.withColumn("chosen", F.col("feature").isin(chosen)), "mean")


@query("feature_ranges", f"""
  SELECT feature, min(value) AS min, max(value) AS max, {rnd('quantile_cont(value, 0.05)', 9)} AS p05,
         {rnd('quantile_cont(value, 0.95)', 9)} AS p95
  FROM (SELECT unnest([quantity, extendedprice, discount, tax]) AS value,
               unnest(['quantity', 'extendedprice', 'discount', 'tax']) AS feature FROM ({X.VIEWS_SQL})) GROUP BY 1""")
def feature_ranges(spark, d):
    long = A.long_form(X.views(spark, d), [], X.VIEW_FEATURES)
    return _round(A.feature_ranges(long), "p05", "p95", digits=9)


@query("class_balance", f"""
  SELECT count(*) FILTER (y = 1) AS n_positive, count(*) AS n_samples, {rnd('count(*) / 64.0')} AS samples_per_feature
  FROM (SELECT label < 5 AS b, CASE WHEN label < 5 THEN 1 ELSE 0 END AS y FROM embeddings)""")
def class_balance(spark, d):
    wide, cols = X.wide_features(spark, d)
    return _round(A.class_balance_per_feature(wide, "y", len(cols)), "samples_per_feature")


# --- ROC and thresholds -------------------------------------------------------

@query("roc_curve", f"""
  SELECT score AS threshold, tp, fp, {rnd('tp / p')} AS tpr, {rnd('fp / n')} AS fpr FROM (
    SELECT score, sum(pos) OVER (ORDER BY score DESC)::bigint AS tp, sum(neg) OVER (ORDER BY score DESC)::bigint AS fp,
           (sum(pos) OVER ())::double AS p, (sum(neg) OVER ())::double AS n
    FROM (SELECT score, sum(y) AS pos, sum(1 - y) AS neg FROM {SCO} GROUP BY 1))""")
def roc_curve(spark, d):
    return _round(M.roc_points(X.scored(spark, d), "score", "y"), "tpr", "fpr")


def auc_sql(frm, score, y, keys=""):
    k = f"{keys}, " if keys else ""
    part = f"PARTITION BY {keys} " if keys else ""
    grp = f"GROUP BY {keys}" if keys else ""
    return f"""SELECT {k}(sum(CASE WHEN {y} = 1 THEN r END) - sum({y}) * (sum({y}) + 1) / 2.0)
        / nullif(sum({y})::double * sum(1 - {y}), 0) AS auc FROM (
      SELECT {k}{y}, rank() OVER ({part}ORDER BY {score}) + (count(*) OVER (PARTITION BY {k}{score}) - 1) / 2.0 AS r
      FROM {frm}) {grp}"""


@query("auc", f"SELECT {rnd('auc')} AS auc FROM ({auc_sql(SCO, 'score', 'y')})")
def auc(spark, d):
    return _round(M.auc(X.scored(spark, d), "score", "y"), "auc")


@query("auc_by_group", f"SELECT y2, {rnd('auc')} AS auc FROM ({auc_sql(SCO, 'score', 'y', 'y2')})")
def auc_by_group(spark, d):
    return _round(M.auc(X.scored(spark, d), "score", "y", ["y2"]), "auc")


@query("auc_ranking", f"""
  SELECT feature, {rnd('auc')} AS auc_raw, {rnd('greatest(auc, 1 - auc)')} AS auc_effective,
         CASE WHEN auc >= 0.5 THEN 'higher' ELSE 'lower' END AS direction
  FROM ({auc_sql(LONG, 'value', 'y', 'feature')})""")
def auc_ranking(spark, d):
    return _round(M.auc_ranking(X.long_features(spark, d), "y"), "auc_raw", "auc_effective")


@query("mean_or_max", f"""
  WITH h AS (SELECT l_orderkey, avg(l_quantity) AS qm, max(l_quantity) AS qx, avg(l_tax) AS tm, max(l_tax) AS tx,
               CASE WHEN max(l_returnflag) = 'R' THEN 1 ELSE 0 END AS y FROM lineitem GROUP BY 1),
  l AS (SELECT y, unnest([qm, qx, tm, tx]) AS value,
          unnest(['quantity_viewmean', 'quantity_viewmax', 'tax_viewmean', 'tax_viewmax']) AS feature FROM h),
  a AS (SELECT feature, greatest(auc, 1 - auc) AS e FROM ({auc_sql('l', 'value', 'y', 'feature')}))
  SELECT replace(replace(feature, '_viewmean', ''), '_viewmax', '') AS base,
         first(feature ORDER BY e DESC, feature LIKE '%viewmean' DESC) AS chosen, {rnd('max(e)')} AS auc_effective
  FROM a GROUP BY 1""")
def mean_or_max(spark, d):
    heads = table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.avg("l_quantity").alias("quantity_viewmean"), F.max("l_quantity").alias("quantity_viewmax"),
        F.avg("l_tax").alias("tax_viewmean"), F.max("l_tax").alias("tax_viewmax"),
        F.max(F.col("l_returnflag") == "R").cast("int").alias("y"))
    long = A.long_form(heads, ["y"], ["quantity_viewmean", "quantity_viewmax", "tax_viewmean", "tax_viewmax"])
    return _round(A.choose_aggregation(M.auc_ranking(long, "y")), "auc_effective")


@query("youden", f"""
  WITH l AS {LONG}, a AS ({auc_sql('l', 'value', 'y', 'feature')}),
  s AS (SELECT l.feature, CASE WHEN auc < 0.5 THEN -value ELSE value END AS v, y, auc < 0.5 AS flipped,
          greatest(auc, 1 - auc) AS auc FROM l JOIN a USING (feature)),
  c AS (SELECT feature, v, any_value(flipped) AS flipped, any_value(auc) AS auc, sum(y) AS pos, sum(1 - y) AS neg
        FROM s GROUP BY 1, 2),
  r AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY feature) AS p,
          sum(neg) OVER (PARTITION BY feature) AS n FROM c WINDOW w AS (PARTITION BY feature ORDER BY v DESC)),
  b AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY tp::hugeint * n - fp::hugeint * p DESC, v DESC) AS rn FROM r)
  SELECT feature, {rnd('auc')} AS auc, flipped, CASE WHEN flipped THEN -v ELSE v END AS cutoff,
         {rnd('tp::double / p')} AS sensitivity, {rnd('1 - fp::double / n')} AS specificity FROM b WHERE rn = 1""")
def youden(spark, d):
    return _round(M.youden(X.long_features(spark, d), "value", "y", ["feature"]), "auc", "sensitivity", "specificity")


def midpoint_sql(objective):
    obj = {"youden": "tp::double / p - fp::double / n",
           "kappa": kappa_sql("(n - fp)", "fp", "(p - tp)", "tp")}[objective]
    return f"""
  WITH c AS (SELECT score, sum(y) AS pos, sum(1 - y) AS neg FROM {SCO} GROUP BY 1),
  r AS (SELECT score, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n,
          lead(score) OVER w AS lower FROM c WINDOW w AS (ORDER BY score DESC)),
  v AS (SELECT (score + lower) / 2 AS mid, round({obj}, 12) AS v FROM r WHERE lower IS NOT NULL)
  SELECT {rnd('median(mid)')} AS threshold, {rnd('max(v)')} AS value FROM v WHERE v = (SELECT max(v) FROM v)"""


@query("threshold_midpoint_youden", midpoint_sql("youden"))
def threshold_midpoint_youden(spark, d):
    return _round(M.threshold_by_midpoints(X.scored(spark, d), "score", "y", "youden"), "threshold", "value")


@query("threshold_midpoint_kappa", midpoint_sql("kappa"))
def threshold_midpoint_kappa(spark, d):
    return _round(M.threshold_by_midpoints(X.scored(spark, d), "score", "y", M.kappa), "threshold", "value")


@query("threshold_grid", f"""
  WITH g AS (SELECT 0.2 + 0.6 * i / 60 AS t FROM (SELECT unnest(range(0, 61))::double AS i)),
  c AS (SELECT t, {CELLS.format(y='y', p='(raw >= t)::int')} FROM {SCO}, g GROUP BY 1),
  v AS (SELECT round(t, 9) AS t, round({kappa_sql()}, 9) AS v FROM c)
  SELECT t + 0.0 AS threshold, {rnd('v')} AS value FROM v ORDER BY v.v DESC, round(abs(t - 0.5), 9), t LIMIT 1""")
def threshold_grid(spark, d):
    return _round(M.threshold_by_grid(X.scored(spark, d), "raw", "y"), "value")


# --- confusion and folds ------------------------------------------------------

FOLD5 = f"""
  SELECT s.*, g.fold FROM {SCO} s JOIN (
    SELECT id, ((row_number() OVER (PARTITION BY y ORDER BY {h32("'42:' || id")}, id) - 1) % 5)::int AS fold FROM {SCO}) g
  ON s.id = g.id"""


def _fold_scored(spark, d):
    s = X.scored(spark, d)
    return B.inner_folds(s, "id", "y", 42, 5)


@query("confusion", f"SELECT fold, {CELLS.format(y='y', p='(score >= 0.5)::int')} FROM ({FOLD5}) GROUP BY 1")
def confusion(spark, d):
    return M.confusion(_fold_scored(spark, d), F.col("y"), (F.col("score") >= 0.5).cast("int"), ["fold"])


RATES = f"""(tp + tn)::double / (tn + fp + fn + tp) AS accuracy, tp::double / nullif(tp + fp, 0) AS precision,
  tp::double / nullif(tp + fn, 0) AS recall, tn::double / nullif(tn + fp, 0) AS specificity,
  2.0 * tp / nullif(2 * tp + fp + fn, 0) AS f1, {kappa_sql()} AS kappa"""
METRIC_NAMES = ["accuracy", "precision", "recall", "specificity", "f1", "kappa"]


@query("fold_metrics", f"""
  WITH s AS ({FOLD5}), c AS (SELECT fold, {CELLS.format(y='y', p='(score >= 0.5)::int')} FROM s GROUP BY 1),
  m AS (SELECT fold, {RATES} FROM c), a AS ({auc_sql('s', 'score', 'y', 'fold')})
  SELECT m.fold, {', '.join(f'{rnd(c)} AS {c}' for c in METRIC_NAMES)}, {rnd('auc')} AS auc FROM m JOIN a ON m.fold = a.fold""")
def fold_metrics(spark, d):
    f = M.fold_metrics(_fold_scored(spark, d).withColumn("threshold", F.lit(0.5)), ["fold"])
    return _round(f.select("fold", *METRIC_NAMES, "auc"), *METRIC_NAMES, "auc")


@query("fold_summary", f"""
  WITH c AS (SELECT fold, {CELLS.format(y='y', p='(score >= 0.5)::int')} FROM ({FOLD5}) GROUP BY 1),
  m AS (SELECT fold, fn, fp, {RATES} FROM c)
  SELECT 'score' AS name, {', '.join(f'{rnd(f"avg({c})")} AS {c}, {rnd(f"stddev_samp({c})")} AS {c}_sd' for c in METRIC_NAMES)},
         0.5::double AS threshold_mean, sum(fn)::bigint AS fn_total, sum(fp)::bigint AS fp_total FROM m""")
def fold_summary(spark, d):
    f = M.fold_metrics(_fold_scored(spark, d).withColumn("threshold", F.lit(0.5)), ["fold"], with_auc=False)
    s = M.fold_summary(f.withColumn("name", F.lit("score")), ["name"], METRIC_NAMES)
    return _round(s, *METRIC_NAMES, *[f"{c}_sd" for c in METRIC_NAMES])


@query("fold_summary_dashboard", f"""
  WITH c AS (SELECT fold, {CELLS.format(y='y', p='(score >= 0.5)::int')} FROM ({FOLD5}) GROUP BY 1),
  m AS (SELECT fold, {RATES} FROM c)
  SELECT 1 AS one, {', '.join(f'{rnd(f"avg({c})")} AS {c}, {rnd(f"stddev_pop({c})")} AS {c}_sd' for c in METRIC_NAMES)} FROM m""")
def fold_summary_dashboard(spark, d):
    f = M.fold_metrics(_fold_scored(spark, d).withColumn("threshold", F.lit(0.5)), ["fold"], with_auc=False)
    s = M.fold_summary(f.select("fold", *METRIC_NAMES).withColumn("one", F.lit(1)), ["one"], METRIC_NAMES, sample=False)
    return _round(s, *METRIC_NAMES, *[f"{c}_sd" for c in METRIC_NAMES])


@query("zero_division", """
  WITH c AS (SELECT user_id, count(*) FILTER (event_type = 'error' AND value > 100) AS tp,
      count(*) FILTER (event_type <> 'error' AND value > 100) AS fp, count(*) FILTER (event_type = 'error' AND value <= 100) AS fn
      FROM events GROUP BY 1)
  SELECT user_id, round(coalesce(tp::double / nullif(tp + fp, 0), 0), 6) + 0.0 AS precision,
         round(coalesce(tp::double / nullif(tp + fn, 0), 0), 6) + 0.0 AS recall,
         round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) + 0.0 AS f1 FROM c""")
def zero_division(spark, d):
    e = table(spark, d, "events")
    c = M.confusion(e, (F.col("event_type") == "error").cast("int"), (F.col("value") > 100).cast("int"), ["user_id"])
    r = M.rates(zero_division=0)
    return c.select("user_id", *[F.round(r[m], 6).alias(m) for m in ("precision", "recall", "f1")])


@query("strat_group_folds", f"""
  SELECT repeat, source, label, ((row_number() OVER (PARTITION BY repeat, label
           ORDER BY {h32("(42 + repeat) || ':' || source")}, source) - 1) % 5)::int AS fold
  FROM (SELECT d.source, max(l.toxic) AS label FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1),
       (SELECT unnest(range(0, 3))::int AS repeat)""")
def strat_group_folds(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels"), "doc_id")
    return B.group_folds(docs, "source", "toxic", P.SEED, 5, repeats=3)


@query("inner_folds", f"""
  SELECT vec_id AS id, y, ((row_number() OVER (PARTITION BY y ORDER BY {h32("'7:' || vec_id")}, vec_id) - 1) % 4)::int AS fold
  FROM (SELECT vec_id, (label < 5)::int AS y FROM embeddings)""")
def inner_folds(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), (F.col("label") < 5).cast("int").alias("y"))
    return B.inner_folds(e, "id", "y", 7)


@query("undersample_members", f"""
  WITH s AS {SCO}, c AS (SELECT min(n) AS n FROM (SELECT y, count(*) AS n FROM s GROUP BY 1))
  SELECT member, y, id FROM (SELECT member, y, id, row_number() OVER (PARTITION BY member, y
      ORDER BY {h32("'5:' || member || ':' || id")}, id) AS rn FROM s, (SELECT unnest(range(0, 15))::int AS member)), c
  WHERE rn <= n""")
def undersample_members(spark, d):
    return B.undersample(X.scored(spark, d).select("id", "y"), "id", "y", 5, 15).select("member", "y", "id")


@query("oof_average", f"""
  SELECT id, y, {rnd('avg(p)')} AS score FROM (
    SELECT id, y, {h32("repeat || ':' || id")} / 4294967296.0 AS p FROM {SCO}, (SELECT unnest(range(0, 20)) AS repeat))
  GROUP BY 1, 2""")
def oof_average(spark, d):
    reps = X.scored(spark, d).withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(19))))
    p = hash32(F.col("repeat"), F.col("id")) / 4294967296.0
    return _round(B.oof_average(reps.withColumn("score", p), "id", "score", ["y"]), "score")


@query("error_analysis", f"""
  SELECT id, CASE WHEN y = 1 THEN 'false_negative' ELSE 'false_positive' END AS kind FROM {SCO} WHERE y <> (score >= 0.5)::int""")
def error_analysis(spark, d):
    s = X.scored(spark, d).withColumn("pred", (F.col("score") >= 0.5).cast("int"))
    return M.errors(s).select("id", "kind")


@query("bootstrap_counts", f"""
  WITH s AS (SELECT id, CASE WHEN y = 0 AND score < 0.5 THEN 0 WHEN y = 0 THEN 1 WHEN score < 0.5 THEN 2 ELSE 3 END AS cell
             FROM {SCO}),
  r AS (SELECT cell, row_number() OVER (ORDER BY cell, id) - 1 AS rn, count(*) OVER () AS n FROM s),
  d AS (SELECT rep, ({h32("rep || ':' || i.rn")}) % i.n AS pick FROM r i, (SELECT unnest(range(0, 200)) AS rep))
  SELECT rep AS replicate, count(*) FILTER (cell = 0) AS tn, count(*) FILTER (cell = 1) AS fp,
         count(*) FILTER (cell = 2) AS fn, count(*) FILTER (cell = 3) AS tp FROM d JOIN r ON d.pick = r.rn GROUP BY 1""")
def bootstrap_counts(spark, d):
    return B.bootstrap_counts(X.scored(spark, d), F.col("y"), (F.col("score") >= 0.5).cast("int"), 200)


@query("bootstrap_ci", f"""
  WITH s AS (SELECT id, CASE WHEN y = 0 AND score < 0.5 THEN 0 WHEN y = 0 THEN 1 WHEN score < 0.5 THEN 2 ELSE 3 END AS cell
             FROM {SCO}),
  r AS (SELECT cell, row_number() OVER (ORDER BY cell, id) - 1 AS rn, count(*) OVER () AS n FROM s),
  d AS (SELECT rep, ({h32("rep || ':' || i.rn")}) % i.n AS pick FROM r i, (SELECT unnest(range(0, 200)) AS rep)),
  c AS (SELECT rep, count(*) FILTER (cell = 0) AS tn, count(*) FILTER (cell = 1) AS fp,
         count(*) FILTER (cell = 2) AS fn, count(*) FILTER (cell = 3) AS tp FROM d JOIN r ON d.pick = r.rn GROUP BY 1),
  m AS (SELECT {RATES} FROM c WHERE tn + fp > 0 AND fn + tp > 0),
  l AS (SELECT unnest(['kappa', 'accuracy', 'specificity', 'recall']) AS metric,
          unnest([kappa, accuracy, specificity, recall]) AS v, unnest([0.61, 0.8, NULL, 0.8]) AS bar FROM m)
  SELECT metric, {rnd('avg(v)')} AS point, {rnd('quantile_cont(v, 0.025)')} AS ci_lo, {rnd('quantile_cont(v, 0.975)')} AS ci_hi,
         {rnd('avg(CASE WHEN bar IS NOT NULL THEN (v >= bar)::int END)')} AS p_above_bar FROM l GROUP BY 1""")
def bootstrap_ci(spark, d):
    c = B.bootstrap_counts(X.scored(spark, d), F.col("y"), (F.col("score") >= 0.5).cast("int"), 200)
    return _round(B.bootstrap_interval(c), "point", "ci_lo", "ci_hi", "p_above_bar")


def _binomial_step(i, cell, before, size, rest):
    """Counts of one cell for every replicate: the quantile of a binomial at the replicate's uniform number."""
    u = f"({h32(f"replicate || ':{cell}a'")} * 1048576 + {h32(f"replicate || ':{cell}b'")} // 4096 + 0.5) / 4503599627370496.0"
    keep = "".join(f", {c}" for c in ("tn", "fp", "fn")[:i])
    return f"""
  k{i} AS (SELECT n, p, unnest(range(0, n + 1)) AS k FROM (SELECT DISTINCT n, ({size})::double / nullif({rest}, 0) AS p FROM {before}, c)),
  q{i} AS (SELECT n, k, sum(CASE WHEN coalesce(p, 0) = 0 THEN (k = 0)::int WHEN p = 1 THEN (k = n)::int ELSE exp(
             lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln(p) + (n - k) * ln(1 - p)) END) OVER (PARTITION BY n ORDER BY k) AS cdf FROM k{i}),
  d{i} AS (SELECT replicate{keep}, n - {cell} AS n, {cell} FROM (
    SELECT b.replicate{keep}, b.n, min(q.k) AS {cell} FROM (SELECT *, {u} AS u FROM {before}) b JOIN q{i} q ON q.n = b.n AND q.cdf >= b.u GROUP BY ALL))"""


BOOT_CELLS = f"""WITH c AS (SELECT {CELLS.format(y='y', p='(score >= 0.5)::int')}, count(*) AS total FROM {SCO}),
  d AS (SELECT unnest(range(0, 4000)) AS replicate, total AS n FROM c), {_binomial_step(0, 'tn', 'd', 'c.tn', 'c.total')},
  {_binomial_step(1, 'fp', 'd0', 'c.fp', 'c.total - c.tn')}, {_binomial_step(2, 'fn', 'd1', 'c.fn', 'c.total - c.tn - c.fp')},
  r AS (SELECT replicate, tn, fp, fn, n AS tp FROM d2)"""


@query("bootstrap_cells", f"{BOOT_CELLS} SELECT replicate, tn, fp, fn, tp FROM r")
def bootstrap_cells(spark, d):
    """4,000 replicates."""
    return B.bootstrap_cells(X.scored(spark, d), F.col("y"), (F.col("score") >= 0.5).cast("int"), 4000)


@query("bootstrap_cells_ci", f"""{BOOT_CELLS},
  m AS (SELECT {RATES} FROM r WHERE tn + fp > 0 AND fn + tp > 0),
  l AS (SELECT unnest(['kappa', 'accuracy', 'specificity', 'recall']) AS metric,
          unnest([kappa, accuracy, specificity, recall]) AS v, unnest([0.61, 0.8, NULL, 0.8]) AS bar FROM m)
  SELECT metric, {rnd('avg(v)')} AS point, {rnd('quantile_cont(v, 0.025)')} AS ci_lo, {rnd('quantile_cont(v, 0.975)')} AS ci_hi,
         {rnd('avg(CASE WHEN bar IS NOT NULL THEN (v >= bar)::int END)')} AS p_above_bar FROM l GROUP BY 1""")
def bootstrap_cells_ci(spark, d):
    c = B.bootstrap_cells(X.scored(spark, d), F.col("y"), (F.col("score") >= 0.5).cast("int"), 4000)
    return _round(B.bootstrap_interval(c), "point", "ci_lo", "ci_hi", "p_above_bar")


# --- paired comparison --------------------------------------------------------

# Two methods over the same folds: the score, and an unrelated hash score.
METHODS = f"""
  SELECT id, y, repeat, ((row_number() OVER (PARTITION BY repeat, y ORDER BY {h32("(42 + repeat) || ':' || id")}, id) - 1) % 5)::int AS fold,
         name, CASE name WHEN 'base' THEN {h32("'b:' || id")} / 4294967296.0
           WHEN 'score' THEN score ELSE ({h32("'b:' || id")} / 4294967296.0 + score) / 2 END AS s
  FROM {SCO}, (SELECT unnest(range(0, 4))::int AS repeat), (SELECT unnest(['base', 'score', 'vote']) AS name)"""
METHODS = METHODS.replace("PARTITION BY repeat, y", "PARTITION BY name, repeat, y")
FOLDS_SQL = f"""
  SELECT name, repeat, fold, fn, fp, {RATES} FROM (SELECT name, repeat, fold, {CELLS.format(y='y', p='(s >= 0.5)::int')}
    FROM ({METHODS}) GROUP BY 1, 2, 3)"""


def _method_scores(spark, d):
    s = X.scored(spark, d)
    folds = B.group_folds(s, "id", "y", P.SEED, 5, repeats=4).drop("label")
    b = hash32(F.lit("b"), F.col("id")) / 4294967296.0
    arr = F.array(F.struct(F.lit("base").alias("name"), b.alias("s")),
                  F.struct(F.lit("score").alias("name"), F.col("score").alias("s")),
                  F.struct(F.lit("vote").alias("name"), ((b + F.col("score")) / 2).alias("s")))
    return s.select("id", "y", F.inline(arr)).join(folds, "id").select(
        "id", "y", "name", "repeat", "fold", F.col("s").alias("score"), F.lit(0.5).alias("threshold"))


def _method_folds(spark, d):
    return M.fold_metrics(_method_scores(spark, d), ["name", "repeat", "fold"], with_auc=False)


@query("soft_vote", f"SELECT id, repeat, {rnd('avg(s)')} AS score FROM ({METHODS}) WHERE name <> 'vote' GROUP BY 1, 2")
def soft_vote(spark, d):
    s = _method_scores(spark, d).where(F.col("name") != "vote")
    return _round(s.groupBy("id", "repeat").agg(F.avg("score").alias("score")), "score")


@query("paired_delta", f"""
  WITH f AS ({FOLDS_SQL}), p AS (SELECT a.name, a.kappa - b.kappa AS d FROM f a JOIN f b
      ON a.repeat = b.repeat AND a.fold = b.fold AND b.name = 'base' WHERE a.name <> 'base')
  SELECT name, count(d) AS folds, {rnd('avg(d)')} AS d_mean, {rnd('stddev_samp(d)')} AS d_sd,
         {rnd('stddev_samp(d) / sqrt(count(d))')} AS d_sem, {rnd('avg(d) / (stddev_samp(d) / sqrt(count(d)))')} AS t,
         {rnd('avg((d >= -1e-9)::int)')} AS not_worse, count(*) FILTER (d > 1e-9) AS wins,
         count(*) FILTER (d < -1e-9) AS losses, count(*) FILTER (abs(d) <= 1e-9) AS ties FROM p WHERE d IS NOT NULL GROUP BY 1""")
def paired_delta(spark, d):
    return _round(C.paired_delta(_method_folds(spark, d), "base"), "d_mean", "d_sd", "d_sem", "t", "not_worse")


# Student's t with 19 degrees of freedom (20 shared folds), as its finite sum.
T19 = "1 - 2 / pi() * (th + sin(th) * (cos(th) + " + " + ".join(
    f"{c} * pow(cos(th), {2 * i + 3})" for i, c in enumerate(
        ["2.0/3", "2.0/3*4/5", "2.0/3*4/5*6/7", "2.0/3*4/5*6/7*8/9", "2.0/3*4/5*6/7*8/9*10/11",
         "2.0/3*4/5*6/7*8/9*10/11*12/13", "2.0/3*4/5*6/7*8/9*10/11*12/13*14/15",
         "2.0/3*4/5*6/7*8/9*10/11*12/13*14/15*16/17"])) + "))"


@query("paired_pvalue", f"""
  WITH f AS ({FOLDS_SQL}), p AS (SELECT a.name, a.kappa - b.kappa AS d FROM f a JOIN f b
      ON a.repeat = b.repeat AND a.fold = b.fold AND b.name = 'base' WHERE a.name <> 'base'),
  t AS (SELECT name, avg(d) / (stddev_samp(d) / sqrt(count(d))) AS t FROM p GROUP BY 1)
  SELECT name, {rnd('t')} AS t, {rnd(T19)} AS p FROM (SELECT name, t, atan(abs(t) / sqrt(19.0)) AS th FROM t)""")
def paired_pvalue(spark, d):
    return _round(C.with_pvalue(C.paired_delta(_method_folds(spark, d), "base")).select("name", "t", "p"), "t", "p")


@query("comparison_table", f"""
  WITH s AS (SELECT name, avg(accuracy) AS accuracy, avg(recall) AS recall, avg(kappa) AS kappa, stddev_samp(kappa) AS kappa_sd,
               sum(fn)::bigint AS fn_total FROM ({FOLDS_SQL}) GROUP BY 1), b AS (SELECT * FROM s WHERE name = 'base')
  SELECT s.name, {rnd('s.accuracy')} AS accuracy, {rnd('s.recall')} AS recall, {rnd('s.kappa')} AS kappa,
         {rnd('(s.kappa - b.kappa) / b.kappa_sd')} AS delta_in_sd, s.fn_total,
         'accuracy' || CASE WHEN s.accuracy >= 0.8 THEN '+' ELSE '-' END || ' recall' || CASE WHEN s.recall >= 0.8 THEN '+' ELSE '-' END
           || ' kappa' || CASE WHEN s.kappa >= 0.61 THEN '+' ELSE '-' END AS passes FROM s, b""")
def comparison_table(spark, d):
    m = ["accuracy", "recall", "kappa"]
    s = M.ranked(C.delta_in_sd(M.fold_summary(_method_folds(spark, d), ["name"], m), "base"))
    return _round(s.select("name", *m, "delta_in_sd", "fn_total", "passes"), *m, "delta_in_sd")


@query("fresh_repeats", f"""
  SELECT name, {rnd('avg(kappa)')} AS kappa_fresh_repeats, {rnd('avg(accuracy)')} AS accuracy_fresh_repeats
  FROM ({FOLDS_SQL}) WHERE repeat >= 2 GROUP BY 1""")
def fresh_repeats(spark, d):
    return _round(C.fresh_repeats(_method_folds(spark, d), 2), "kappa_fresh_repeats", "accuracy_fresh_repeats")


@query("named_report", f"""
  WITH f AS ({FOLDS_SQL}), s AS (SELECT name, avg(accuracy) AS accuracy, avg(kappa) AS kappa FROM f GROUP BY 1),
  p AS (SELECT a.name, avg(a.kappa - b.kappa) AS d, count(a.kappa - b.kappa) AS n FROM f a JOIN f b ON a.repeat = b.repeat AND a.fold = b.fold AND b.name = 'base'
        WHERE a.name <> 'base' GROUP BY 1),
  r AS (SELECT name, avg(kappa) AS kappa, avg(accuracy) AS accuracy FROM f WHERE repeat >= 2 AND name <> 'vote' GROUP BY 1)
  SELECT s.name, {rnd('s.accuracy')} AS accuracy, {rnd('s.kappa')} AS kappa, p.n AS folds, {rnd('p.d')} AS d_mean,
         {rnd('r.kappa')} AS kappa_fresh_repeats, {rnd('r.accuracy')} AS accuracy_fresh_repeats
  FROM s LEFT JOIN p ON s.name = p.name LEFT JOIN r ON s.name = r.name""")
def named_report(spark, d):
    """Comparison, paired and robustness tables of the methods side by side."""
    f = _method_folds(spark, d)
    table_ = M.fold_summary(f, ["name"], ["accuracy", "kappa"]).select("name", "accuracy", "kappa")
    paired = C.paired_delta(f, "base").select("name", "folds", "d_mean")
    out = C.named_report(table_, paired, C.fresh_repeats(f.where(F.col("name") != "vote"), 2))
    return _round(out, "accuracy", "kappa", "d_mean", "kappa_fresh_repeats", "accuracy_fresh_repeats")


@query("leakage_gap", f"""
  WITH s AS (SELECT name, fold AS k, avg(kappa) AS kappa, avg(accuracy) AS accuracy FROM ({FOLDS_SQL}) GROUP BY 1, 2)
  SELECT a.k, {rnd('b.kappa - a.kappa')} AS kappa_gap, {rnd('b.accuracy - a.accuracy')} AS accuracy_gap
  FROM s a JOIN s b ON a.k = b.k WHERE a.name = 'base' AND b.name = 'score'""")
def leakage_gap(spark, d):
    s = _method_folds(spark, d).groupBy("name", F.col("fold").alias("k")).agg(
        F.avg("kappa").alias("kappa"), F.avg("accuracy").alias("accuracy"))
    gap = C.leakage_gap(s.where(F.col("name") == "base"), s.where(F.col("name") == "score"))
    return _round(gap.select("k", "kappa_gap", "accuracy_gap"), "kappa_gap", "accuracy_gap")


@query("stress_delta", f"""
  WITH s AS (SELECT name, repeat, avg(kappa) AS kappa FROM ({FOLDS_SQL}) GROUP BY 1, 2),
  m AS (SELECT name, kappa FROM s WHERE repeat = 0), t AS (SELECT name, avg(kappa) AS kappa FROM s WHERE repeat > 0 GROUP BY 1)
  SELECT m.name, {rnd('m.kappa')} AS measured, {rnd('t.kappa')} AS stressed, {rnd('t.kappa - m.kappa')} AS delta
  FROM m JOIN t ON m.name = t.name""")
def stress_delta(spark, d):
    s = _method_folds(spark, d).groupBy("name", "repeat").agg(F.avg("kappa").alias("kappa"))
    return _round(C.stress_delta(s.where(F.col("repeat") == 0), s.where(F.col("repeat") > 0)), "measured", "stressed", "delta")


@query("stacked_tables", f"""
  WITH f AS ({FOLDS_SQL}) SELECT 'as-measured' AS condition, name, {rnd('avg(kappa)')} AS kappa, NULL::double AS d_mean FROM f GROUP BY 2
  UNION ALL SELECT 'paired', a.name, NULL, {rnd('avg(a.kappa - b.kappa)')} FROM f a JOIN f b
    ON a.repeat = b.repeat AND a.fold = b.fold AND b.name = 'base' WHERE a.name <> 'base' GROUP BY 2""")
def stacked_tables(spark, d):
    f = _method_folds(spark, d)
    main = M.fold_summary(f, ["name"], ["kappa"]).select(F.lit("as-measured").alias("condition"), "name", "kappa")
    pair = C.paired_delta(f, "base").select(F.lit("paired").alias("condition"), "name", "d_mean")
    return _round(C.stacked(main, pair), "kappa", "d_mean")


@query("passes_bar", f"""
  WITH s AS (SELECT name, avg(accuracy) AS accuracy, avg(recall) AS recall, avg(kappa) AS kappa FROM ({FOLDS_SQL}) GROUP BY 1)
  SELECT name, 'accuracy' AS metric, accuracy >= 0.8 AS ok FROM s UNION ALL SELECT name, 'recall', recall >= 0.8 FROM s
  UNION ALL SELECT name, 'kappa', kappa >= 0.61 FROM s""")
def passes_bar(spark, d):
    s = M.fold_summary(_method_folds(spark, d), ["name"], ["accuracy", "recall", "kappa"])
    return C.passes_bar(s).select("name", "metric", "ok")


@query("best_k", f"""
  WITH s AS (SELECT fold AS k, avg(kappa) AS kappa FROM ({FOLDS_SQL}) GROUP BY 1)
  SELECT k, {rnd('kappa')} AS kappa FROM s ORDER BY s.kappa DESC, k LIMIT 1""")
def best_k(spark, d):
    s = _method_folds(spark, d).groupBy(F.col("fold").alias("k")).agg(F.avg("kappa").alias("kappa"))
    return _round(C.best_row(s, "kappa", "k"), "kappa")


# --- importances --------------------------------------------------------------

# Importance of each feature in each fold, derived from the feature values.
IMP_SQL = f"""
  SELECT repeat, fold, feature, idx, abs(avg(CASE WHEN y = 1 THEN value END) - avg(CASE WHEN y = 0 THEN value END)) AS importance
  FROM (SELECT l.*, repeat, floor({h32("repeat || ':' || id")} * 5 / 4294967296.0)::int AS fold FROM {LONG} l,
          (SELECT unnest(range(0, 2))::int AS repeat)) GROUP BY 1, 2, 3, 4"""


def _importances(spark, d):
    l = X.long_features(spark, d).withColumn("repeat", F.explode(F.array(F.lit(0), F.lit(1))))
    l = l.withColumn("fold", F.floor(hash32(F.col("repeat"), F.col("id")) * 5 / 4294967296.0).cast("int"))
    diff = F.avg(F.when(F.col("y") == 1, F.col("value"))) - F.avg(F.when(F.col("y") == 0, F.col("value")))
    return l.groupBy("repeat", "fold", "feature", "idx").agg(F.abs(diff).alias("importance"))


TOP10 = f"""SELECT repeat, fold, feature, idx, importance, row_number() OVER (PARTITION BY repeat, fold
    ORDER BY importance DESC, idx DESC)::int AS rank FROM ({IMP_SQL}) QUALIFY rank <= 10"""


@query("importance_topk", f"SELECT repeat, fold, rank, feature, {rnd('importance')} AS importance FROM ({TOP10})")
def importance_topk(spark, d):
    return _round(A.top_features(_importances(spark, d), 10), "importance")


@query("selection_frequency", f"SELECT feature, count(*) AS folds FROM ({TOP10}) GROUP BY 1")
def selection_frequency(spark, d):
    return A.selection_frequency(A.top_features(_importances(spark, d), 10))


@query("selection_sizes", f"""
  SELECT min(n) AS n_min, {rnd('avg(n)')} AS n_mean, max(n) AS n_max, count(*) AS folds
  FROM (SELECT repeat, fold, count(*) AS n FROM ({TOP10}) GROUP BY 1, 2)""")
def selection_sizes(spark, d):
    return _round(A.selection_sizes(A.top_features(_importances(spark, d), 10)), "n_mean")


@query("picked_never", f"""
  SELECT DISTINCT feature FROM {LONG} WHERE feature NOT IN (SELECT feature FROM ({TOP10}))""")
def picked_never(spark, d):
    listed = X.long_features(spark, d).select("feature").distinct()
    return A.picked_never(A.top_features(_importances(spark, d), 10), listed)


@query("picked_always", f"""
  SELECT feature FROM (SELECT repeat, fold, feature FROM ({IMP_SQL}) WHERE importance > 0.001) GROUP BY 1 HAVING count(*) = 10""")
def picked_always(spark, d):
    return A.picked_always(_importances(spark, d).where(F.col("importance") > 0.001))


@query("mean_importance", f"""
  SELECT feature, {rnd('m')} AS mean_importance FROM (SELECT feature, avg(importance) AS m FROM ({IMP_SQL}) GROUP BY 1
    ORDER BY m DESC, feature LIMIT 12)""")
def mean_importance(spark, d):
    return _round(A.mean_importance(_importances(spark, d), 12), "mean_importance")


@query("watch_list", f"""
  WITH m AS (SELECT feature, avg(importance) AS m FROM ({IMP_SQL}) GROUP BY 1)
  SELECT {rnd("(SELECT max(m) FROM m WHERE feature LIKE 'f1%')")} AS watched_max, {rnd('(SELECT median(m) FROM m)')} AS median_importance,
         (SELECT max(m) FROM m WHERE feature LIKE 'f1%') < (SELECT median(m) FROM m) AS below_median""")
def watch_list(spark, d):
    return _round(A.watch_list(A.mean_importance(_importances(spark, d)), ["f1"]), "watched_max", "median_importance")


@query("any_in_top", f"""
  SELECT bool_or(feature LIKE 'f0%' OR feature LIKE 'f2%') AS in_top FROM (
    SELECT feature, avg(importance) AS m FROM ({IMP_SQL}) GROUP BY 1 ORDER BY m DESC, feature LIMIT 5)""")
def any_in_top(spark, d):
    return A.any_in_top(A.mean_importance(_importances(spark, d)), ["f0", "f2"])


# --- row-wise transforms ------------------------------------------------------

def _intensity(spark, d):
    """Order lines under the names of the intensity features."""
    li = table(spark, d, "lineitem")
    q, e, t, c = "l_quantity", "l_extendedprice", "l_tax", "l_discount"
    src = {"mean_R": q, "mean_G": e, "mean_B": t, "sd_R": c, "sd_G": "l_linenumber", "sd_B": "l_suppkey",
           "brightness_mean": q, "texture": e, "blob_max": "l_partkey", "A_high": c}
    return li.select("l_orderkey", "l_linenumber", "l_partkey", *[F.col(v).cast("double").alias(k) for k, v in src.items()])


KEYS = "l_orderkey, l_linenumber, l_partkey"


@query("ratio_transform", f"""
  SELECT {KEYS}, {rnd('l_extendedprice / greatest(l_quantity, 1e-9)', 8)} AS "mean_G/brightness_mean", l_discount AS "A_high",
         l_quantity AS brightness_mean FROM lineitem""")
def ratio_transform(spark, d):
    cols = S.ratio_columns(["mean_G", "A_high"], "brightness_mean", keep_ref=True)
    out = _intensity(spark, d).select("l_orderkey", "l_linenumber", "l_partkey", *cols)
    return _round(out, "mean_G/brightness_mean", digits=8)


@query("log_transform", f"""
  SELECT {KEYS}, {rnd('ln(1 + l_partkey::double)')} AS "log1p(blob_max)", l_quantity AS "mean_R" FROM lineitem""")
def log_transform(spark, d):
    out = _intensity(spark, d).select("l_orderkey", "l_linenumber", "l_partkey", *S.log_columns(["blob_max", "mean_R"]))
    return _round(out, "log1p(blob_max)")


@query("row_zscore", f"""
  SELECT {KEYS}, {rnd('(l_quantity - m) / greatest(s, 1e-12)')} AS "z_mean_R", {rnd('(l_extendedprice - m) / greatest(s, 1e-12)')} AS "z_mean_G"
  FROM (SELECT *, list_avg(v) AS m, list_stddev_pop(v) AS s FROM (SELECT *,
    [l_quantity, l_extendedprice, l_tax, l_discount, l_linenumber::double, l_suppkey::double] AS v FROM lineitem))""")
def row_zscore(spark, d):
    out = _intensity(spark, d).select("l_orderkey", "l_linenumber", "l_partkey", *S.row_zscores(["mean_R", "mean_G"]))
    return _round(out, "z_mean_R", "z_mean_G")


@query("contrast_ratios", f"""
  SELECT {KEYS}, {rnd('l_suppkey / greatest(l_tax, 1e-9)', 3)} AS "sd_B/mean_B", {rnd('l_linenumber / greatest(l_extendedprice, 1e-9)', 8)} AS "sd_G/mean_G",
         {rnd('l_extendedprice / greatest(l_tax, 1e-9)', 3)} AS "mean_G/mean_B", {rnd('l_extendedprice / greatest(l_quantity, 1e-9)', 8)} AS "texture/brightness"
  FROM lineitem""")
def contrast_ratios(spark, d):
    out = _intensity(spark, d).select("l_orderkey", "l_linenumber", "l_partkey", *S.contrast_columns())
    return _round(_round(out, "sd_G/mean_G", "texture/brightness", digits=8), "sd_B/mean_B", "mean_G/mean_B", digits=3)


@query("exposure_stress", f"""
  SELECT {KEYS}, {rnd(f"l_quantity * ({h32('''1 || ':' || l_orderkey''')} / 4294967296.0 * 0.3 + 0.85)")} AS "mean_R", l_discount AS "A_high"
  FROM lineitem""")
def exposure_stress(spark, d):
    f = S.exposure_factor(F.col("l_orderkey"), 1)
    out = _intensity(spark, d).select("l_orderkey", "l_linenumber", "l_partkey", *S.perturbed(["mean_R", "A_high"], f))
    return _round(out, "mean_R")
