"""Data audit: completeness, duplicates, robust distances, correlations."""

import math

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType

from rasterlab import params as P
from rasterlab.functions.hashing import hash32
from rasterlab.operators.ordered import quantiles
from rasterlab.session import broadcast_if_small, cut_lineage


def null_cells(df: DataFrame) -> Column:
    """Number of NULL cells, as an aggregate over all columns."""
    cols = [F.count_if(F.col(f"`{c}`").isNull()) for c in df.columns]
    return sum(cols[1:], cols[0])


def class_counts(df: DataFrame, y: str) -> DataFrame:
    """Rows and share per class."""
    every = Window.partitionBy(F.lit(1))  # one row per class by now
    return df.groupBy(y).agg(F.count(F.lit(1)).alias("n")).withColumn("share", F.col("n") / F.sum("n").over(every))


def duplicate_count(df: DataFrame, cols: list[str]) -> DataFrame:
    """Rows beyond the first of each distinct combination.

    Counted as rows minus combinations, so no group is ever gathered.
    """
    per = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n"))
    return per.groupBy().agg(F.coalesce(F.sum("_n") - F.count(F.lit(1)), F.lit(0)).alias("duplicates"))


def value_ranges(long: DataFrame, feature="feature", value="value") -> DataFrame:
    return long.groupBy(feature).agg(F.min(value).alias("lo"), F.max(value).alias("hi"),
                                     F.count(value).alias("n"))


def constant_features(long: DataFrame, feature="feature", value="value") -> DataFrame:
    return value_ranges(long, feature, value).where(F.col("lo") == F.col("hi")).select(feature)


def long_form(df: DataFrame, ids: list[str], cols: list[str]) -> DataFrame:
    """(ids, feature, value) from wide feature columns."""
    values = F.posexplode(F.array(*[F.col(f"`{c}`").cast("double") for c in cols])).alias("_i", "value")
    return df.select(*ids, values).select(*ids, F.get(F.lit(cols), F.col("_i")).alias("feature"), "value")


def robust_scale(long: DataFrame, keys=("feature",), value="value", **kw) -> DataFrame:
    """(keys, med, robust_sd): median and scaled MAD, two exact passes.

    A row per key is broadcast when the stored medians show that there are few.
    """
    keys = list(keys)
    med = cut_lineage(quantiles(long, keys, value, {"med": 0.5}, **kw))
    dev = long.join(broadcast_if_small(med), keys).withColumn("_dev", F.abs(F.col(value) - F.col("med")))
    mad = quantiles(dev, keys, "_dev", {"mad": 0.5}, **kw)
    return med.join(mad, keys).select(
        *keys, "med", (F.col("mad") * P.MAD_SCALE).alias("robust_sd"))


def robust_z(df: DataFrame, id_: str, cols: list[str], limit: float = 5.0, **kw) -> DataFrame:
    """Per row: largest robust z, the feature it came from (the first one on
    ties), how many exceed ``limit``.

    The scales are one pair per column; with them the rows are judged in
    place, without grouping.
    """
    rows = robust_scale(long_form(df, [], cols), ["feature"], max_rows=df.count(), **kw).collect()
    scale = {r["feature"]: r for r in rows}
    zs = []
    for c in cols:
        s = scale.get(c)
        live = s is not None and s["robust_sd"] > 0
        zs.append(F.abs(F.col(f"`{c}`") - s["med"]) / s["robust_sd"] if live else F.lit(None).cast("double"))
    each = F.array(*[F.struct(F.coalesce(z, F.lit(0.0)).alias("z"), F.lit(-i).alias("i"), F.lit(c).alias("f"))
                     for i, (c, z) in enumerate(zip(cols, zs))])
    return df.select(id_, F.array_max(F.array(*zs)).alias("max_robust_z"),
                     F.array_max(each)["f"].alias("worst_feature"),
                     F.size(F.filter(F.array(*zs), lambda z: z > limit)).cast("bigint").alias(f"n_feat_z_gt{limit:g}"))


def _sq_distance(mean: np.ndarray, inv: np.ndarray):
    """Squared Mahalanobis distance of an array column's rows."""
    @F.pandas_udf(DoubleType())
    def distance(x: pd.Series) -> pd.Series:
        d = np.stack(x.to_numpy()) - mean
        return pd.Series(np.einsum("ij,jk,ik->i", d, inv, d))
    return distance


def chi2_quantile(p: float, d: int) -> float:
    """Quantile of the chi-square law, by bisection of its distribution function (a power series)."""
    def below(x):
        if x <= 0:
            return 0.0
        term = total = 1.0 / (d / 2)
        k = 0
        while term > 1e-17 * total:
            k += 1
            term *= (x / 2) / (d / 2 + k)
            total += term
        return math.exp(d / 2 * math.log(x / 2) - x / 2 - math.lgamma(d / 2)) * total
    lo, hi = 0.0, d + 100.0 * math.sqrt(2 * d)
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if below(mid) < p else (lo, mid)
    return (lo + hi) / 2


def _fit(x: np.ndarray):
    mean = x.mean(axis=0)
    return mean, (x - mean).T @ (x - mean) / len(x)


def _squared(x: np.ndarray, mean: np.ndarray, cov: np.ndarray) -> np.ndarray:
    d = x - mean
    return ((d @ np.linalg.pinv(cov)) * d).sum(axis=1)


def starting_points(x: np.ndarray, support: float, starts: int, best: int, seed: int) -> list[np.ndarray]:
    """(mean, covariance) of the ``best`` of many random starts after two concentration steps each on a sample."""
    r, (n, d) = np.random.default_rng(seed), x.shape
    h = max(min(n, d + 1), math.ceil(support * n))
    found = []
    for i in range(starts):
        mean, cov = _fit(x if i == 0 else x[r.choice(n, min(n, d + 1), replace=False)])  # the first is all rows
        for _ in range(2):
            mean, cov = _fit(x[np.argsort(_squared(x, mean, cov), kind="stable")[:h]])
        sign, det = np.linalg.slogdet(cov)
        found.append((det if sign > 0 else -np.inf, i, mean, cov))
    found.sort(key=lambda f: f[:2])
    return [(m, c) for _, _, m, c in found[:best]]


def concentrated(rows: DataFrame, models: dict[int, tuple], support: float, n: int) -> dict[int, tuple]:
    """One concentration step of every model at once over rows with arrays ``x``: the closest ``support`` share of
    all rows, and their mean and covariance. The number of the model is a key; no row is kept more than once a pass."""
    numbers = sorted(models)

    @F.pandas_udf("array<double>")
    def far(x: pd.Series) -> pd.Series:
        v = np.stack(x.to_numpy())
        return pd.Series(list(np.stack([_squared(v, *models[k]) for k in numbers], axis=1)))
    dist = rows.withColumn("d2", far("x"))
    long = dist.select(F.posexplode("d2").alias("start", "d2"))
    cuts = {r["start"]: r["cut"] for r in quantiles(long, ["start"], "d2", {"cut": support}, max_rows=n * len(numbers)).collect()}
    center = {k: models[k][0] for k in numbers}

    def sums(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            x, d2 = np.stack(b["x"].to_numpy()), np.stack(b["d2"].to_numpy())
            for i, k in enumerate(numbers):
                z = x[d2[:, i] <= cuts[i]] - center[k]
                total[k] = total.get(k, 0) + np.concatenate([[len(z)], z.sum(0), (z.T @ z).ravel()])
        for k, v in total.items():
            yield pd.DataFrame({"start": np.int32(k), "cell": np.arange(len(v), dtype=np.int32), "v": v})
    cells = dist.select("x", "d2").mapInPandas(sums, "start int, cell int, v double").groupBy("start", "cell").agg(F.sum("v").alias("v")).collect()
    d, out = len(center[numbers[0]]), {}
    parts = {k: np.zeros(1 + d + d * d) for k in numbers}
    for r in cells:
        parts[r["start"]][r["cell"]] = r["v"]
    for k, v in parts.items():
        shift = v[1:1 + d] / v[0]
        out[k] = center[k] + shift, v[1 + d:].reshape(d, d) / v[0] - np.outer(shift, shift)
    return out


def _log_det(cov: np.ndarray) -> float:
    sign, det = np.linalg.slogdet(cov)
    return det if sign > 0 else -np.inf


START_ROWS = 1500  # rows, picked by hash, on which the starts are tried


def robust_distance(df: DataFrame, id_: str, cols: list[str], support: float = 0.9, steps: int = 1000, starts: int = 100, best: int = 10,
                    seed: int = P.SEED) -> DataFrame:
    """Mahalanobis distance under the minimum covariance determinant of the closest ``support`` share of rows.

    Many small starts take two concentration steps each on a bounded sample of rows. The ``best`` of them go over all rows side
    by side, two steps again; the one with the least determinant goes on until it stops falling (by 1e-4;
    it never rises, so ``steps`` is only a bound, and reaching it raises). The covariance is then made consistent with normal rows
    by the median distance, and fitted once more on the rows within its 97.5 % ellipsoid. Rows with a null component
    take no part; constant columns are left out; an outlying group beyond 1 - ``support`` cannot be told apart.
    """
    live = [c for c, (n, lo, hi) in zip(cols, _spans(df, cols)) if n and hi > lo]
    x = F.array(*[F.col(f"`{c}`").cast("double") for c in live])
    base = cut_lineage(df.select(id_, x.alias("x")).where(F.forall("x", lambda v: v.isNotNull())))
    n = base.count()
    if not live or not n:
        return base.select(id_, F.lit(0.0).alias("distance"))
    rank = hash32(F.lit(seed), F.to_json(F.struct(id_, "x")))
    sample = base.where(rank < int(min(1.0, START_ROWS / n) * 2 ** 32)).select("x").limit(2 * START_ROWS).collect()
    values = np.array(sorted(r["x"] for r in sample)) if sample else np.array([base.first()["x"]])
    models = dict(enumerate(starting_points(values, support, starts, best, seed)))
    for _ in range(2):
        models = concentrated(base, models, support, n)
    k = min(models, key=lambda i: (_log_det(models[i][1]), i))
    now, last = {k: models[k]}, None
    for _ in range(steps):
        det = _log_det(now[k][1])
        if last is not None and det >= last - 1e-4:
            break
        last = det
        now = concentrated(base, now, support, n)
    else:
        raise RuntimeError(f"concentration steps did not converge in {steps}")
    mean, cov = now[k]
    raw = base.withColumn("d2", _sq_distance(mean, np.linalg.pinv(cov))("x"))
    factor = quantiles(raw, [], "d2", {"half": 0.5}, max_rows=n).first()["half"] / chi2_quantile(0.5, len(live))
    if factor > 0:
        mean, cov = _moments(raw.where(F.col("d2") / factor < chi2_quantile(0.975, len(live))), mean)
    return base.select(id_, F.sqrt(_sq_distance(mean, np.linalg.pinv(cov))("x")).alias("distance"))


def _spans(df: DataFrame, cols):
    row = df.agg(*[a for c in cols for a in (F.count(c), F.min(c), F.max(c))]).first()
    return [row[i:i + 3] for i in range(0, len(row), 3)]


def _moments(rows: DataFrame, center: np.ndarray):
    """Mean and covariance of the arrays ``x``.

    Each task adds up its rows about ``center``; the d x d sums of the tasks
    are then added by Spark, cell by cell.
    """
    d = len(center)

    def sums(batches):
        total = np.zeros(1 + d + d * d)
        for b in batches:
            x = np.stack(b["x"].to_numpy()) - center
            total += np.concatenate([[len(x)], x.sum(0), (x.T @ x).ravel()])
        yield pd.DataFrame({"cell": np.arange(len(total), dtype=np.int32), "v": total})
    cells = rows.select("x").mapInPandas(sums, "cell int, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect()
    v = np.zeros(1 + d + d * d)
    for r in cells:
        v[r["cell"]] = r["v"]
    shift = v[1:1 + d] / v[0]
    return center + shift, v[1 + d:].reshape(d, d) / v[0] - np.outer(shift, shift)


def correlation_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    """(a, b, corr) for every pair a < b in column order, absolute values.

    One pass builds the d x d moments; d is the number of columns.
    """
    m = _abs_corr(df, cols)
    rows = [(cols[i], cols[j], float(m[i, j])) for i in range(len(cols)) for j in range(i + 1, len(cols))]
    return df.sparkSession.createDataFrame(rows, "a string, b string, corr double")


def _abs_corr(df: DataFrame, cols):
    v = VectorAssembler(inputCols=cols, outputCol="_v").transform(df).select("_v")
    return np.abs(Correlation.corr(v, "_v").first()[0].toArray())


def prune_redundant(df: DataFrame, cols: list[str], limit: float = P.REDUNDANT_CORR):
    """(kept, dropped): a column goes when an earlier kept one is its near
    copy. ``dropped`` holds (column, copy of, correlation)."""
    m = _abs_corr(df, cols)
    kept, dropped = [], []
    for j, c in enumerate(cols):
        twin = next((i for i in kept if m[i, j] >= limit), None)
        if twin is None:
            kept.append(j)
        else:
            dropped.append((c, cols[twin], float(m[twin, j])))
    return [cols[i] for i in kept], dropped


def class_histogram(long: DataFrame, y: str, feature="feature", value="value", bins: int = 11) -> DataFrame:
    """(feature, y, bin, n): equal bins over the feature's range; the last bin
    is closed, and a constant feature gets half a unit on each side."""
    r = value_ranges(long, feature, value)
    flat = F.col("lo") == F.col("hi")
    r = r.select(feature, F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
                 F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"))
    b = F.least(F.floor((F.col(value) - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))
    return (long.join(F.broadcast(r), feature).groupBy(feature, y, b.cast("int").alias("bin"))
            .agg(F.count(F.lit(1)).alias("n")))


def feature_ranges(long: DataFrame, feature="feature", value="value", **kw) -> DataFrame:
    """(feature, min, max, p05, p95) as stored with a trained model."""
    q = quantiles(long, [feature], value, {"min": 0.0, "max": 1.0, "p05": 0.05, "p95": 0.95}, **kw)
    return q


def mean_importance(imp: DataFrame, top: int | None = None) -> DataFrame:
    out = imp.groupBy("feature").agg(F.avg("importance").alias("mean_importance"))
    return out.orderBy(F.col("mean_importance").desc(), "feature").limit(top) if top else out


def top_features(imp: DataFrame, k: int, keys=("repeat", "fold")) -> DataFrame:
    """The k most important features per fold; the later column wins ties.

    One row per feature of the schema in each fold, so the array is small.
    """
    best = F.slice(F.sort_array(F.collect_list(F.struct("importance", "idx", "feature")), asc=False), 1, k)
    return imp.groupBy(*keys).agg(best.alias("_b")).select(*keys, F.posexplode("_b").alias("rank", "_f")).select(
        *keys, (F.col("rank") + 1).alias("rank"), "_f.feature", "_f.importance")


def selection_frequency(picks: DataFrame) -> DataFrame:
    return picks.groupBy("feature").agg(F.count(F.lit(1)).alias("folds"))


def selection_sizes(picks: DataFrame, keys=("repeat", "fold")) -> DataFrame:
    """Smallest, mean and largest selected set."""
    return picks.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).groupBy().agg(
        F.min("n").alias("n_min"), F.avg("n").alias("n_mean"), F.max("n").alias("n_max"),
        F.count(F.lit(1)).alias("folds"))


def picked_always(picks: DataFrame, keys=("repeat", "fold")) -> DataFrame:
    total = picks.select(*keys).distinct().groupBy().agg(F.count(F.lit(1)).alias("_t"), F.lit(1).alias("_one"))
    return (selection_frequency(picks).withColumn("_one", F.lit(1)).join(F.broadcast(total), "_one")
            .where(F.col("folds") == F.col("_t")).select("feature"))


def picked_never(picks: DataFrame, listed: DataFrame) -> DataFrame:
    return listed.join(picks.select("feature").distinct(), "feature", "left_anti")


def watch_list(imp: DataFrame, prefixes=tuple(P.WATCHED_PREFIXES)) -> DataFrame:
    """Largest importance among the watched names against the median."""
    watched = F.lit(False)
    for p in prefixes:
        watched = watched | F.col("feature").startswith(p)
    med = quantiles(imp, [], "mean_importance", {"median_importance": 0.5})
    top = imp.where(watched).groupBy().agg(F.max("mean_importance").alias("watched_max"))
    both = top.withColumn("_one", F.lit(1)).join(F.broadcast(med.withColumn("_one", F.lit(1))), "_one").drop("_one")
    return both.withColumn("below_median", F.col("watched_max") < F.col("median_importance"))


def any_in_top(imp: DataFrame, prefixes, k: int = 5) -> DataFrame:
    """Does a feature with one of the prefixes rank in the top k?"""
    hit = F.lit(False)
    for p in prefixes:
        hit = hit | F.col("feature").startswith(p)
    top = imp.orderBy(F.col("mean_importance").desc(), "feature").limit(k)
    return top.groupBy().agg(F.coalesce(F.bool_or(hit), F.lit(False)).alias("in_top"))


def choose_aggregation(ranking: DataFrame, feature="feature") -> DataFrame:
    """Mean or max over views for each base feature, by effective AUC; the
    mean wins ties."""
    from rasterlab.functions.scalar import base_feature
    is_mean = F.col(feature).endswith("_viewmean")
    return ranking.groupBy(base_feature(F.col(feature)).alias("base")).agg(
        F.max_by(F.col(feature), F.struct("auc_effective", is_mean)).alias("chosen"),
        F.max("auc_effective").alias("auc_effective"))


def class_balance_per_feature(df: DataFrame, y: str, n_features: int) -> DataFrame:
    """Positives, samples and samples per feature."""
    return df.groupBy().agg(F.count_if(F.col(y) == 1).alias("n_positive"), F.count(F.lit(1)).alias("n_samples"),
                            (F.count(F.lit(1)) / n_features).alias("samples_per_feature"))
