"""Folds, out-of-fold averages and the bootstrap, all from one hash."""

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from rasterlab import params as P
from rasterlab.functions.hashing import SPAN, hash32
from rasterlab.operators.metrics import rates
from rasterlab.operators.ordered import hash_rank, quantiles


def group_folds(df: DataFrame, group: str, y: str, seed, k: int = P.OUTER_SPLITS,
                repeats: int | None = None) -> DataFrame:
    """(group, label[, repeat], fold): stratified folds that keep groups whole.

    Groups are taken in hash order within their label and dealt to the folds in
    turn, so each fold gets the same share of each label. A group's label is
    the largest of its rows. With ``repeats`` the deal is done for the seeds
    ``seed``, ``seed+1``, ...
    """
    groups = df.groupBy(group).agg(F.max(y).alias("label"))
    keys = ["label"]
    seed_col = F.lit(seed)
    if repeats is not None:
        groups = groups.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
        keys, seed_col = ["repeat", "label"], F.lit(seed) + F.col("repeat")
    hashed = groups.withColumn("_h", hash32(seed_col, F.col(group)))
    out = hash_rank(hashed, keys, "_h", [group], out="_pos")
    return out.withColumn("fold", F.pmod(F.col("_pos"), F.lit(k)).cast("int")).drop("_h", "_pos")


def inner_folds(df: DataFrame, id_: str, y: str, seed, k: int = P.INNER_SPLITS) -> DataFrame:
    """Rows with an ungrouped stratified ``fold``."""
    hashed = df.withColumn("_h", hash32(F.lit(seed), F.col(id_)))
    out = hash_rank(hashed, [y], "_h", [id_], out="_pos")
    return out.withColumn("fold", F.pmod(F.col("_pos"), F.lit(k)).cast("int")).drop("_h", "_pos")


def undersample(df: DataFrame, id_: str, y: str, seed, members: int) -> DataFrame:
    """(row columns, member): each member is all of the smaller class and an
    equal number of rows of the larger one, drawn by hash without return."""
    n = min(r["count"] for r in df.groupBy(y).count().collect())
    drawn = df.withColumn("member", F.explode(F.sequence(F.lit(0), F.lit(members - 1))))
    drawn = drawn.withColumn("_h", hash32(F.lit(seed), F.col("member"), F.col(id_)))
    return hash_rank(drawn, ["member", y], "_h", [id_], out="_pos").where(F.col("_pos") < n).drop("_h", "_pos")


def oof_average(scored: DataFrame, id_: str, score: str = "score", keep=()) -> DataFrame:
    """Out-of-fold probability per sample over its repeats."""
    return scored.groupBy(id_, *keep).agg(F.avg(score).alias(score))


CELLS = ["tn", "fp", "fn", "tp"]


def _cell_sizes(df: DataFrame, y: Column, pred: Column) -> list[int]:
    c = df.groupBy().agg(*[F.count_if((y == a) & (pred == b)).alias(n) for n, (a, b) in zip(CELLS, [(0, 0), (0, 1), (1, 0), (1, 1)])])
    return list(c.first())


def bootstrap_counts(df: DataFrame, y: Column, pred: Column, replicates: int) -> DataFrame:
    """(replicate, tn, fp, fn, tp) of ``replicates`` resamples with return.

    Only the four counts matter, so rows are thought of as numbered cell by
    cell and a drawn number falls into a cell by comparison: draws never meet
    rows. Draw i of a replicate is a hash of both numbers, at every size; the
    draws are a range that tasks count before anything is shuffled. An empty
    table has no replicates.
    """
    sizes = _cell_sizes(df, y, pred)
    n = sum(sizes)
    draws = df.sparkSession.range(replicates * n).select(
        F.expr(f"id div {max(n, 1)}").alias("replicate"), (F.col("id") % max(n, 1)).alias("i"))
    idx = F.pmod(hash32(F.col("replicate"), F.col("i")), F.lit(max(n, 1)))
    aggs, lo = [], 0
    for name, size in zip(CELLS, sizes):
        aggs.append(F.count_if((F.col("idx") >= lo) & (F.col("idx") < lo + size)).alias(name))
        lo += size
    return draws.select("replicate", idx.alias("idx")).groupBy("replicate").agg(*aggs)


def bootstrap_cells(df: DataFrame, y: Column, pred: Column, replicates: int) -> DataFrame:
    """(replicate, tn, fp, fn, tp) of ``replicates`` resamples with return, without drawing rows.

    The four counts of a resample are multinomial, so they are drawn as such: each count is binomial given the ones
    before it, and is the quantile of that binomial at a uniform number hashed from (replicate, cell). The law is the
    same at every size; the work of a replicate grows with the square root of the rows. An empty table has no
    replicates.
    """
    sizes = _cell_sizes(df, y, pred)
    n = sum(sizes)
    uniforms = [((hash32(F.col("replicate"), F.lit(f"{c}a")) * 2 ** 20 + F.shiftright(hash32(F.col("replicate"), F.lit(f"{c}b")), 12)
                  + 0.5) / float(2 ** 52)).alias(c) for c in CELLS[:-1]]
    draws = df.sparkSession.range(replicates if n else 0).select(F.col("id").alias("replicate"), *uniforms)

    def cells(batches):
        for pdf in batches:
            left, rest = np.full(len(pdf), n, np.int64), n
            for name, size in zip(CELLS[:-1], sizes):
                drawn = binomial_quantile(pdf[name].to_numpy(), left, size / rest if rest else 0.0)
                pdf[name], left, rest = drawn, left - drawn, rest - size
            yield pdf.assign(tp=left)
    return draws.mapInPandas(cells, "replicate bigint, tn bigint, fp bigint, fn bigint, tp bigint")


def binomial_quantile(u: np.ndarray, n: np.ndarray, p: float) -> np.ndarray:
    """Smallest k with P(Binomial(n, p) <= k) >= u, elementwise over ``u`` and ``n``.

    Sums run over 12 standard deviations and 40 steps around the mean, beyond which less than 1e-30 lies.
    """
    if p <= 0 or p >= 1:
        return n * int(p >= 1)
    out = np.empty(len(n), np.int64)
    for m in np.unique(n):
        reach = 12 * np.sqrt(m * p * (1 - p)) + 40
        k = np.arange(max(0, int(m * p - reach)), min(m, int(m * p + reach)) + 1)
        log = np.concatenate([[0.0], np.cumsum(np.log((m - k[:-1]) / (k[:-1] + 1) * (p / (1 - p))))])
        below = np.cumsum(np.exp(log - log.max()))
        mine = n == m
        out[mine] = k[np.searchsorted(below / below[-1], u[mine], "left")]
    return out


def bootstrap_interval(counts: DataFrame, metrics=("kappa", "accuracy", "specificity", "recall"),
                       bar=P.PASS_BAR) -> DataFrame:
    """Mean, 95 % interval and share at or above the bar, per metric.

    Replicates with one class only are left out.
    """
    two = counts.where((F.col("tn") + F.col("fp") > 0) & (F.col("fn") + F.col("tp") > 0))
    r = rates()
    long = two.select("replicate", *[r[m].alias(m) for m in metrics]).unpivot(
        ["replicate"], list(metrics), "metric", "value")
    limit = F.col("value") >= F.create_map(*[F.lit(x) for kv in bar.items() for x in kv])[F.col("metric")]
    centre = long.groupBy("metric").agg(F.avg("value").alias("point"), F.avg(limit.cast("double")).alias("p_above_bar"))
    ci = quantiles(long, ["metric"], "value", {"ci_lo": 0.025, "ci_hi": 0.975})
    return centre.join(F.broadcast(ci), "metric")


def fold_hash(seed, *cols: Column, k: int) -> Column:
    """Unstratified fold by hash alone."""
    return F.floor(hash32(F.lit(seed), *cols) * F.lit(k) / F.lit(SPAN)).cast("int")
