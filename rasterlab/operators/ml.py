"""Methods fitted inside folds, and the harness that compares them.

A method is ``fit(train, seed) -> (scorer, threshold)``: everything it learns
comes from the training frame it is handed. Frames carry ``id``, ``y`` and a
vector column ``features``; a scorer adds ``score``, the probability of the
positive class. Fits are MLlib jobs; the driver loops over variants and folds
only, whose number is fixed by the protocol.
"""

import json
import math
from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass
from itertools import product
from threading import Lock

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import (GBTClassifier, LinearSVC, LogisticRegression, NaiveBayes,
                                       RandomForestClassifier)
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler, VectorSlicer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType

from rasterlab import params as P
from rasterlab.functions import rules
from rasterlab.operators import audit as A, metrics as M, resample as B
from rasterlab.operators.neighbours import nearest_scores
from rasterlab.operators.ordered import quantiles
from rasterlab.session import cut_lineage

Scorer = Callable[[DataFrame], DataFrame]
Fit = Callable[[DataFrame, int], tuple[Scorer, float]]


@dataclass(frozen=True)
class Method:
    name: str
    fit: Fit


def assembled(df: DataFrame, cols: list[str], keep=("id", "y")) -> DataFrame:
    return VectorAssembler(inputCols=cols, outputCol="features").transform(df).select(*keep, "features")


def resolve_features(df: DataFrame, selected: list[str] | None = None, not_features=("id", "y")) -> list[str]:
    """The selected list if there is one, else every feature column; unknown
    names are an error."""
    available = [c for c in df.columns if c not in not_features]
    missing = [c for c in selected or [] if c not in available]
    if missing:
        raise ValueError(f"features not in the table: {missing}")
    return selected or available


def _positive(model) -> Scorer:
    def score(df: DataFrame) -> DataFrame:
        cols = df.columns
        return model.transform(df).select(*cols, vector_to_array("probability")[1].alias("score"))
    return score


# --- weights and estimators -------------------------------------------------

def weighted(train: DataFrame, weights) -> DataFrame:
    """Add ``w``: None, "balanced", or the weight of the positive class."""
    if weights is None:
        return train.withColumn("w", F.lit(1.0))
    if weights == "balanced":
        n = {r["y"]: r["count"] for r in train.groupBy("y").count().collect()}
        total = sum(n.values())
        return train.withColumn("w", F.when(F.col("y") == 1, total / (2.0 * n.get(1, 1)))
                                .otherwise(total / (2.0 * n.get(0, 1))))
    return train.withColumn("w", F.when(F.col("y") == 1, float(weights)).otherwise(1.0))


def _classifier(make, weights=None, threshold: float = 0.5) -> Fit:
    def fit(train, seed):
        data = weighted(train, weights)
        return _positive(make(data, seed).fit(data)), threshold
    return fit


def boosting(depth: int = 2, rounds: int = 100, rate: float = 0.1, subsample: float = 1.0,
             min_leaf: int = 1, weights=None, threshold: float = 0.5) -> Fit:
    return _classifier(lambda d, seed: GBTClassifier(
        labelCol="y", weightCol="w", maxDepth=depth, maxIter=rounds, stepSize=rate, subsamplingRate=subsample,
        minInstancesPerNode=min_leaf, seed=seed), weights, threshold)


def forest(trees: int = 400, min_leaf: int = 1, weights=None, threshold: float = 0.5, depth: int = 30) -> Fit:
    return _classifier(lambda d, seed: RandomForestClassifier(
        labelCol="y", weightCol="w", numTrees=trees, minInstancesPerNode=min_leaf, maxDepth=depth, seed=seed),
        weights, threshold)


def _scale():
    return StandardScaler(inputCol="features", outputCol="scaled", withMean=True)


def logistic(c: float = 1.0, l1: bool = False, weights=None, threshold: float = 0.5) -> Fit:
    """``c`` is the inverse penalty against the summed loss."""
    def make(d, seed):
        reg = 1.0 / (c * d.count())
        return Pipeline(stages=[_scale(), LogisticRegression(
            featuresCol="scaled", labelCol="y", weightCol="w", regParam=reg, elasticNetParam=float(l1),
            standardization=False, maxIter=200)])
    return _classifier(make, weights, threshold)


def gaussian_nb(threshold: float = 0.5) -> Fit:
    return _classifier(lambda d, seed: Pipeline(stages=[_scale(), NaiveBayes(
        featuresCol="scaled", labelCol="y", weightCol="w", modelType="gaussian")]), None, threshold)


def _margin(c: float) -> Fit:
    def fit(train, seed):
        reg = 1.0 / (c * train.count())
        model = Pipeline(stages=[_scale(), LinearSVC(featuresCol="scaled", labelCol="y", regParam=reg,
                                                     standardization=False, maxIter=50, tol=1e-3)]).fit(train)

        def score(df):
            return model.transform(df).select(*df.columns, vector_to_array("rawPrediction")[1].alias("score"))
        return score, 0.0
    return fit


def linear_svm(c: float = 1.0, threshold: float = 0.5, k: int = P.INNER_SPLITS) -> Fit:
    """Linear margin turned into a probability by a sigmoid fitted on
    out-of-fold margins."""
    return calibrated(_margin(c), "sigmoid", threshold, k)


MODEL_TYPES = {"gradient_boosting": boosting, "random_forest": forest}


def from_config(kind: str, params: dict) -> Fit:
    """Method by type name and its parameters as configuration files spell them."""
    if kind not in MODEL_TYPES:
        raise ValueError(f"unknown model type {kind}; known: {sorted(MODEL_TYPES)}")
    names = {"max_depth": "depth", "n_estimators": "rounds" if kind == "gradient_boosting" else "trees",
             "learning_rate": "rate", "min_samples_leaf": "min_leaf", "subsample": "subsample"}
    return MODEL_TYPES[kind](**{names[k]: v for k, v in params.items() if v is not None})


# --- out-of-fold scores, calibration, thresholds ----------------------------

def out_of_fold(train: DataFrame, base: Fit, seed: int, k: int = P.INNER_SPLITS, repeats: int = 1) -> DataFrame:
    """(id, y, score): scores of rows by fits that did not see them, averaged
    over repeats."""
    parts = []
    for r in range(repeats):
        folds = cut_lineage(B.inner_folds(train, "id", "y", seed + 1000 * r, k))
        for f in range(k):
            scorer, _ = base(folds.where(F.col("fold") != f).drop("fold"), seed + 1000 * r)
            parts.append(scorer(folds.where(F.col("fold") == f)).select("id", "y", "score"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return B.oof_average(out, "id", "score", ["y"])


def calibrated(base: Fit, how: str = "sigmoid", threshold: float = 0.5, k: int = P.INNER_SPLITS) -> Fit:
    """Scores mapped to probabilities by a curve fitted on out-of-fold scores."""
    def fit(train, seed):
        oof = cut_lineage(out_of_fold(train, base, seed, k))
        scorer, _ = base(train, seed)
        v = F.array("score")
        if how == "sigmoid":
            model = LogisticRegression(featuresCol="_s", labelCol="y").fit(oof.withColumn("_s", array_to_vector(v)))
            a, b = float(model.coefficients[0]), float(model.intercept)

            def score(df):
                return scorer(df).withColumn("score", 1 / (1 + F.exp(-(F.col("score") * a + b))))
        else:
            model = IsotonicRegression(featuresCol="score", labelCol="y").fit(oof)

            def score(df):
                return model.transform(scorer(df)).drop("score").withColumnRenamed("prediction", "score")
        return score, threshold
    return fit


def tuned_threshold(base: Fit, objective="kappa", grid: bool = False, repeats: int = 1, k: int = 5) -> Fit:
    """Cut chosen on inner out-of-fold scores of the training rows."""
    def fit(train, seed):
        oof = out_of_fold(train, base, seed, k, repeats)
        pick = M.threshold_by_grid if grid else M.threshold_by_midpoints
        cut = pick(oof, "score", "y", objective).first()["threshold"]
        return base(train, seed)[0], float(cut)
    return fit


def insample_threshold(base: Fit, objective="kappa") -> Fit:
    """Cut chosen on the training rows themselves; a control."""
    def fit(train, seed):
        scorer, _ = base(train, seed)
        return scorer, float(M.threshold_by_midpoints(scorer(train), "score", "y", objective).first()["threshold"])
    return fit


def vote(*bases: Fit, threshold: float = 0.5) -> Fit:
    """Mean probability of several methods."""
    def fit(train, seed):
        scorers = [b(train, seed)[0] for b in bases]

        def score(df):
            cols = df.columns
            for i, s in enumerate(scorers):
                df = s(df).withColumnRenamed("score", f"_s{i}")
            total = sum((F.col(f"_s{i}") for i in range(1, len(scorers))), F.col("_s0"))
            return df.select(*cols, (total / len(scorers)).alias("score"))
        return score, threshold
    return fit


def undersampled(base: Fit, members: int = 15, threshold: float = 0.5) -> Fit:
    """Mean of fits on balanced draws of the training rows."""
    def fit(train, seed):
        drawn = cut_lineage(B.undersample(train, "id", "y", seed, members))
        parts = [lambda t, s, m=m: base(drawn.where(F.col("member") == m).drop("member"), s + m)
                 for m in range(members)]
        return vote(*parts, threshold=threshold)(train, seed)
    return fit


# --- transforms fitted in the fold ------------------------------------------

def _on(stage_fit: Callable[[DataFrame], Scorer], base: Fit) -> Fit:
    def fit(train, seed):
        change = stage_fit(train)
        scorer, thr = base(change(train), seed)
        return (lambda df: scorer(change(df))), thr
    return fit


def pca(base: Fit, components: int, drop_first: bool = False) -> Fit:
    def stage(train):
        d = len(train.first()["features"])
        k = min(components, d, max(1, train.count() - 1))
        stages = [_scale(), PCA(k=k, inputCol="scaled", outputCol="pc")]
        if drop_first:
            stages.append(VectorSlicer(inputCol="pc", outputCol="cut", indices=list(range(1, k))))
        model = Pipeline(stages=stages).fit(train)
        out = "cut" if drop_first else "pc"
        return lambda df: model.transform(df).withColumn("features", F.col(out)).select(*df.columns)
    return _on(stage, base)


def _inverse_normal(p: np.ndarray) -> np.ndarray:
    """Rational approximation of the normal quantile (Acklam), |error| < 1.2e-9."""
    # Coefficients of the approximation.
    a = [-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02, 1.383577518672690e+02,
         -3.066479806614716e+01, 2.506628277459239e+00]
    b = [-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02, 6.680131188771972e+01,
         -1.328068155288572e+01]
    c = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00, -2.549732539343734e+00,
         4.374664141464968e+00, 2.938163982698783e+00]
    d = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00, 3.754408661907416e+00]
    p = np.clip(p, 1e-7, 1 - 1e-7)
    q = p - 0.5
    mid = np.polyval(a, q * q) * q / np.polyval(b + [1.0], q * q)
    t = np.sqrt(-2 * np.log(np.minimum(p, 1 - p)))
    tail = np.polyval(c, t) / np.polyval(d + [1.0], t)
    return np.where(np.abs(q) <= 0.47575, mid, np.where(q < 0, tail, -tail))


def quantile_normal(base: Fit, points: int = 100) -> Fit:
    """Each feature through its training quantiles to a normal scale."""
    def stage(train):
        d = len(train.first()["features"])
        n = max(10, min(points, train.count()))
        long = train.select(F.posexplode(vector_to_array("features")).alias("feature", "value"))
        probs = {f"q{i}": i / (n - 1) for i in range(n)}
        rows = {r["feature"]: [r[f"q{i}"] for i in range(n)] for r in quantiles(long, ["feature"], "value", probs).collect()}
        grid = [np.asarray(rows[j]) for j in range(d)]
        at = np.linspace(0, 1, n)

        @F.pandas_udf(ArrayType(DoubleType()))
        def change(x: pd.Series) -> pd.Series:
            m = np.stack(x.to_numpy())
            for j in range(m.shape[1]):
                # mean of the position from either side, so runs of equal
                # quantiles map to their middle
                up = np.interp(m[:, j], grid[j], at)
                down = 1 - np.interp(-m[:, j], -grid[j][::-1], at)
                m[:, j] = (up + down) / 2
            return pd.Series(list(_inverse_normal(m)))
        return lambda df: df.withColumn("features", array_to_vector(change(vector_to_array("features"))))
    return _on(stage, base)


def subset(base: Fit, idx: list[int]) -> Fit:
    """Fixed columns. Chosen on all rows this is the leaky control."""
    def stage(train):
        cut = VectorSlicer(inputCol="features", outputCol="_cut", indices=[int(i) for i in idx])
        return lambda df: cut.transform(df).withColumn("features", F.col("_cut")).drop("_cut")
    return _on(stage, base)


def importances(train: DataFrame, seed: int, trees: int = 400, depth: int = 30) -> np.ndarray:
    m = RandomForestClassifier(labelCol="y", numTrees=trees, seed=seed, maxDepth=depth).fit(train)
    return m.featureImportances.toArray()


def top_indices(imp: np.ndarray, k: int) -> list[int]:
    """Largest k; the later column wins ties."""
    return sorted(range(len(imp)), key=lambda i: (-imp[i], -i))[:k]


def shared_importances() -> Callable[[DataFrame, int, int], np.ndarray]:
    """``importances``, fitted once for equal training rows, seed and trees: methods that differ in what follows share the forest."""
    held: list[tuple[DataFrame, tuple, Future]] = []
    lock = Lock()

    def shared(train, seed, trees):
        with lock:
            got = next((f for t, key, f in held if key == (seed, trees) and t.sameSemantics(train)), None)
            own = None if got else Future()
            if own:
                held.append((train, (seed, trees), own))
        if own:
            try:
                own.set_result(importances(train, seed, trees))
            except BaseException as e:
                own.set_exception(e)
        return (got or own).result()
    return shared


def selected_topk(base: Fit, k: int, trees: int = 400, record: list | None = None, ranking=None) -> Fit:
    """Rank by forest importance inside the fold, keep k, refit. ``ranking``: what gives the importances, if methods share it."""
    def fit(train, seed):
        idx = top_indices((ranking or importances)(train, seed, trees), k)
        if record is not None:
            record.append(idx)
        return subset(base, idx)(train, seed)
    return fit


def selected_rfe(base: Fit, k: int, trees: int = 200, step: int = 1) -> Fit:
    """Drop the least important columns until k are left."""
    def fit(train, seed):
        left = list(range(len(train.first()["features"])))
        while len(left) > k:
            part = VectorSlicer(inputCol="features", outputCol="_cut", indices=left).transform(train).withColumn(
                "features", F.col("_cut")).drop("_cut")
            imp = importances(part, seed, trees)
            drop = min(step, len(left) - k)
            worst = sorted(range(len(left)), key=lambda i: (imp[i], i))[:drop]
            left = [c for i, c in enumerate(left) if i not in worst]
        return subset(base, left)(train, seed)
    return fit


def selected_l1(base: Fit, c: float = 0.5, record: list | None = None) -> Fit:
    """Columns with a non-zero L1 coefficient; all of them if none is."""
    def fit(train, seed):
        reg = 1.0 / (c * train.count())
        model = Pipeline(stages=[_scale(), LogisticRegression(
            featuresCol="scaled", labelCol="y", regParam=reg, elasticNetParam=1.0, standardization=False,
            maxIter=500)]).fit(train)
        coef = model.stages[-1].coefficients.toArray()
        idx = [i for i, v in enumerate(coef) if abs(v) > 1e-10] or list(range(len(coef)))
        if record is not None:
            record.append(idx)
        return subset(base, idx)(train, seed)
    return fit


# --- nearest neighbours -------------------------------------------------------

def nearest(k: int = 5, by_distance: bool = False, threshold: float = 0.5, block_rows: int = 100_000) -> Fit:
    def fit(train, seed):
        model = _scale().fit(train)

        def scaled(df):
            return model.transform(df).drop("features").withColumnRenamed("scaled", "features")
        return (lambda df: df.join(nearest_scores(scaled(train), scaled(df), k, by_distance, block_rows=block_rows), "id"),
                threshold)
    return fit


# --- search and harness -------------------------------------------------------

def grid_search(options: list[tuple[str, Fit]], metric: str = "accuracy", k: int = P.INNER_SPLITS) -> Fit:
    """The option with the best inner score; the first one wins ties."""
    def fit(train, seed):
        scores = inner_scores(train, options, seed, metric, k)
        best = max(range(len(options)), key=lambda i: (scores[i], -i))
        return options[best][1](train, seed)
    return fit


def inner_scores(train: DataFrame, options, seed: int, metric: str, k: int) -> list[float]:
    """Mean inner-fold metric of each option."""
    folds = cut_lineage(B.inner_folds(train, "id", "y", seed, k))
    parts = []
    for i, (_, base) in enumerate(options):
        for f in range(k):
            scorer, thr = base(folds.where(F.col("fold") != f).drop("fold"), seed)
            parts.append(scorer(folds.where(F.col("fold") == f)).select(
                "y", "score", F.lit(i).alias("option"), F.lit(f).alias("fold"), F.lit(thr).alias("threshold")))
    scored = parts[0]
    for p in parts[1:]:
        scored = scored.unionByName(p)
    per = M.fold_metrics(scored, ["option", "fold"], with_auc=metric == "auc")
    means = {r["option"]: r["m"] for r in per.groupBy("option").agg(F.avg(metric).alias("m")).collect()}
    return [round(means[i], 12) if means.get(i) is not None else -math.inf for i in range(len(options))]


def with_folds(df: DataFrame, seed: int = P.SEED, k: int = P.OUTER_SPLITS, repeats: int = 5,
               group: str = "id") -> DataFrame:
    """Rows with ``folds``, their fold in each repeat; every method shares
    these splits. A row is stored once, however many repeats there are."""
    each = B.group_folds(df, group, "y", seed, k, repeats)
    folds = each.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("repeat", "fold"))).alias("_f")).select(
        group, F.transform("_f", lambda f: f["fold"]).alias("folds"))
    return cut_lineage(df.join(folds, group))


def split(rows: DataFrame, repeat: int, fold: int) -> tuple[DataFrame, DataFrame]:
    """(training rows, held-out rows) of one fold."""
    at = F.col("folds")[repeat]
    return rows.where(at != fold).drop("folds"), rows.where(at == fold).drop("folds")


def evaluate(df: DataFrame, methods: list[Method], repeats: int = 5, k: int = P.OUTER_SPLITS, seed: int = P.SEED,
             group: str = "id", sink: str | None = None, parallelism: int = 4) -> DataFrame:
    """(name, repeat, fold, id, y, score, threshold) for every held-out row.

    With ``sink`` each finished fit leaves its rows in a folder of its own
    there, so an interrupted run keeps what it has and fits that run side by
    side do not share an output.
    """
    rows = with_folds(df, seed, k, repeats, group)

    def run(job):
        (i, m), r, f = job
        train, held = split(rows, r, f)
        scorer, thr = m.fit(train, seed + r)
        out = scorer(held).select(
            F.lit(m.name).alias("name"), F.lit(r).alias("repeat"), F.lit(f).alias("fold"), "id", "y", "score",
            F.lit(float(thr)).alias("threshold"))
        if sink:
            out.write.mode("overwrite").parquet(f"{sink}/method={i}/repeat={r}/fold={f}")
        return out
    jobs = list(product(enumerate(methods), range(repeats), range(k)))
    with ThreadPoolExecutor(parallelism) as pool:
        parts = list(pool.map(run, jobs))
    if sink:
        return df.sparkSession.read.schema(parts[0].schema).option("recursiveFileLookup", True).parquet(sink)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def compared(scored: DataFrame, by: str = "kappa") -> DataFrame:
    """Ranked comparison table of an evaluation."""
    return M.ranked(M.fold_summary(M.fold_metrics(scored, ["name", "repeat", "fold"])), by)


def nested_cv(df: DataFrame, options: list[tuple[str, Fit]], k: int = P.OUTER_SPLITS,
              inner: int = P.INNER_SPLITS, seed: int = P.SEED, group: str = "id") -> tuple[DataFrame, DataFrame]:
    """(fold report, out-of-fold rows): the option is chosen inside each fold."""
    folded = with_folds(df, seed, k, 1, group)
    rows, parts = [], []
    for f in range(k):
        train, test = split(folded, 0, f)
        scores = inner_scores(train, options, seed, "accuracy", inner)
        best = max(range(len(options)), key=lambda i: (scores[i], -i))
        scorer, thr = options[best][1](train, seed)
        parts.append(scorer(test).select(F.lit(f + 1).alias("fold"), "id", "y", "score", F.lit(thr).alias("threshold")))
        rows.append((f + 1, options[best][0], float(scores[best])))
    oof = parts[0]
    for p in parts[1:]:
        oof = oof.unionByName(p)
    chosen = df.sparkSession.createDataFrame(rows, "fold int, best_params string, inner_cv_accuracy double")
    n = oof.groupBy().count().first()[0]
    per = oof.groupBy("fold").agg(F.count(F.lit(1)).alias("n_test")).withColumn("n_train", F.lit(n) - F.col("n_test"))
    report = M.fold_metrics(oof, ["fold"], with_auc=False).join(per, "fold").join(F.broadcast(chosen), "fold")
    return report, oof.withColumn("y_pred", (F.col("score") >= F.col("threshold")).cast("int"))


def k_sweep(df: DataFrame, base: Fit, ks, repeats: int = 5, k_folds: int = P.OUTER_SPLITS, trees: int = 400,
            leaky: bool = False, seed: int = P.SEED) -> DataFrame:
    """Fold metrics for each feature-set size, chosen in the fold or, as the
    control, on all rows."""
    order = top_indices(importances(df, seed, trees), len(df.first()["features"])) if leaky else None
    ranking = shared_importances()  # a forest per fold, whatever the number of sizes
    methods = [Method(str(n), subset(base, order[:n]) if leaky else selected_topk(base, n, trees, ranking=ranking)) for n in ks]
    folds = M.fold_metrics(cut_lineage(evaluate(df, methods, repeats, k_folds, seed)), ["name", "repeat", "fold"])
    return folds.withColumn("k", F.col("name").cast("int"))


def final_fit(df: DataFrame, cols: list[str], options: list[tuple[str, Fit]], repeats: int = P.OOF_REPEATS,
              seed: int = P.SEED, k: int = P.OUTER_SPLITS) -> tuple[Scorer, dict]:
    """(scorer fitted on all rows, its configuration).

    The parameters come from inner folds, the threshold from out-of-fold
    scores averaged over repeats, and the ranges from the training rows.
    """
    data = assembled(df, cols)
    scores = inner_scores(data, options, seed, "accuracy", P.INNER_SPLITS)
    best = max(range(len(options)), key=lambda i: (scores[i], -i))
    name, base = options[best]
    scorer, _ = base(data, seed)
    scored = evaluate(data, [Method(name, base)], repeats, k, seed)
    cut = M.youden(B.oof_average(scored, "id", "score", ["y"]), "score", "y").first()
    ranges = {r["feature"]: {n: r[n] for n in ("min", "max", "p05", "p95")}
              for r in A.feature_ranges(A.long_form(df, [], cols)).collect()}
    return scorer, {"feature_names": cols, "training_feature_ranges": {c: ranges[c] for c in cols},
                    "decision_threshold": float(cut["cutoff"]), "best_params": name, "random_seed": seed,
                    "trained_on_n_samples": data.count()}


def score_rows(df: DataFrame, scorer: Scorer, config: dict, keep=("id",)) -> DataFrame:
    """Label, confidence and borderline of feature rows; a missing feature
    column is an error."""
    missing = [c for c in config["feature_names"] if c not in df.columns]
    if missing:
        raise ValueError(f"features the model needs are missing: {missing[:5]}")
    data = VectorAssembler(inputCols=config["feature_names"], outputCol="features").transform(df)
    p, t = F.col("score"), F.lit(config["decision_threshold"])
    return scorer(data).select(*keep, p.alias("proba_positive"), rules.predicted_label(p, t).alias("label"),
                               rules.confidence(p, t).alias("confidence"), rules.borderline(p, t).alias("borderline"))


def config_json(config: dict) -> str:
    return json.dumps(config, indent=2)
