"""ROC, thresholds and confusion metrics as aggregations."""

from pyspark.sql import Column, DataFrame, functions as F

from rasterlab import params as P
from rasterlab.operators.ordered import quantiles, running
from rasterlab.session import cut_lineage

METRICS = ["accuracy", "recall", "specificity", "precision", "kappa", "auc"]


def _class_sums(y: str) -> dict[str, Column]:
    return {"pos": F.sum(F.col(y).cast("bigint")), "neg": F.sum(1 - F.col(y).cast("bigint"))}


def roc_points(df: DataFrame, score: str, y: str, keys=(), **kw) -> DataFrame:
    """(threshold, tp, fp, tpr, fpr) at each distinct score, highest first.

    The curve's origin (threshold +inf, nothing positive) is implied.
    """
    keys = list(keys)
    run = running(df, keys, score, _class_sums(y), descending=True, **kw)
    return run.select(*keys, F.col(score).alias("threshold"),
                      F.col("cum_pos").alias("tp"), F.col("cum_neg").alias("fp"),
                      F.try_divide("cum_pos", "all_pos").alias("tpr"),
                      F.try_divide("cum_neg", "all_neg").alias("fpr"))


def auc(df: DataFrame, score: str, y: str, keys=(), **kw) -> DataFrame:
    """Area under the ROC; ties count half, one class only gives NULL."""
    keys = list(keys)
    run = running(df, keys, score, _class_sums(y), **kw)
    below = F.col("cum_neg") - F.col("neg") / 2.0
    return run.groupBy(*keys).agg(
        F.try_divide(F.sum(F.col("pos") * below), F.max("all_pos") * F.lit(1.0) * F.max("all_neg")).alias("auc"))


def auc_ranking(long: DataFrame, y: str, feature="feature", value="value", **kw) -> DataFrame:
    """Univariate AUC per feature with direction and strength."""
    a = F.col("auc_raw")
    return (auc(long, value, y, [feature], **kw).withColumnRenamed("auc", "auc_raw")
            .select(feature, "auc_raw", F.greatest(a, 1 - a).alias("auc_effective"),
                    F.when(a >= 0.5, "higher").otherwise("lower").alias("direction")))


def youden(df: DataFrame, score: str, y: str, keys=(), **kw) -> DataFrame:
    """Cut-off with the largest tpr - fpr; the highest threshold wins ties.

    A score that ranks the wrong way round (AUC < .5) is read reversed.
    """
    keys = list(keys)
    run = running(df, keys, score, _class_sums(y), **kw)
    below = F.col("cum_neg") - F.col("neg") / 2.0
    # J times all_pos * all_neg: whole numbers, so equal cut-offs stay equal
    up_tp = F.col("all_pos") - F.col("cum_pos") + F.col("pos")
    up_fp = F.col("all_neg") - F.col("cum_neg") + F.col("neg")

    def j(tp, fp):
        return tp.cast("double") * F.col("all_neg") - fp.cast("double") * F.col("all_pos")

    best = run.groupBy(*keys).agg(
        F.sum(F.col("pos") * below).alias("u"), F.max("all_pos").alias("np"), F.max("all_neg").alias("nn"),
        F.max(F.struct(j(up_tp, up_fp).alias("j"), F.col(score).alias("t"),
                       up_tp.alias("tp"), up_fp.alias("fp"))).alias("up"),
        F.max(F.struct(j(F.col("cum_pos"), F.col("cum_neg")).alias("j"), (-F.col(score)).alias("t"),
                       F.col("cum_pos").alias("tp"), F.col("cum_neg").alias("fp"))).alias("down"))
    a = F.try_divide("u", F.col("np") * F.lit(1.0) * F.col("nn"))
    flip = a < 0.5
    side = F.when(flip, F.col("down")).otherwise(F.col("up"))
    return best.select(*keys, F.greatest(a, 1 - a).alias("auc"), flip.alias("flipped"),
                       F.when(flip, -F.col("down.t")).otherwise(F.col("up.t")).alias("cutoff"),
                       F.try_divide(side["tp"], F.col("np")).alias("sensitivity"),
                       (1 - F.try_divide(side["fp"], F.col("nn"))).alias("specificity"))


def confusion_columns(y: Column, pred: Column) -> list[Column]:
    def n(a, b, name):
        return F.count_if((y == a) & (pred == b)).alias(name)
    return [n(0, 0, "tn"), n(0, 1, "fp"), n(1, 0, "fn"), n(1, 1, "tp")]


def kappa(tn: Column, fp: Column, fn: Column, tp: Column) -> Column:
    """Cohen's kappa; NULL when chance agreement is already complete."""
    tn, fp, fn, tp = (c.cast("double") for c in (tn, fp, fn, tp))
    n = tn + fp + fn + tp
    expected = (tp + fp) * (tp + fn) + (tn + fn) * (tn + fp)
    return F.try_divide((tp + tn) * n - expected, n * n - expected)


def rates(tn="tn", fp="fp", fn="fn", tp="tp", zero_division: float | None = None) -> dict[str, Column]:
    """Metrics from the four counts. An undefined ratio is NULL, or
    ``zero_division`` for precision, recall and F1."""
    tn, fp, fn, tp = (F.col(c) if isinstance(c, str) else c for c in (tn, fp, fn, tp))

    def ratio(a, b):
        r = F.try_divide(a, b)
        return r if zero_division is None else F.coalesce(r, F.lit(float(zero_division)))

    return {
        "accuracy": F.try_divide(tp + tn, tn + fp + fn + tp),
        "precision": ratio(tp, tp + fp),
        "recall": ratio(tp, tp + fn),
        "specificity": F.try_divide(tn, tn + fp),
        "f1": ratio(2 * tp, 2 * tp + fp + fn),
        "kappa": kappa(tn, fp, fn, tp),
    }


def confusion(df: DataFrame, y: Column, pred: Column, keys=()) -> DataFrame:
    return df.groupBy(*keys).agg(*confusion_columns(y, pred))


def fold_metrics(scored: DataFrame, keys, y="y", score="score", threshold="threshold",
                 with_auc: bool = True, **kw) -> DataFrame:
    """Counts and metrics per fold from one row per scored sample."""
    keys = list(keys)
    pred = (F.col(score) >= F.col(threshold)).cast("int")
    counts = scored.groupBy(*keys).agg(*confusion_columns(F.col(y), pred), F.avg(threshold).alias("threshold"))
    out = counts.select("*", *[c.alias(n) for n, c in rates().items()])
    return out.join(auc(scored, score, y, keys, **kw), keys, "left") if with_auc else out


def fold_summary(folds: DataFrame, keys=("name",), metrics=tuple(METRICS), sample: bool = True) -> DataFrame:
    """Mean and SD of each metric over folds; undefined folds are skipped."""
    sd = F.stddev_samp if sample else F.stddev_pop
    extra = []
    if {"fn", "fp", "threshold"} <= set(folds.columns):
        extra = [F.avg("threshold").alias("threshold_mean"), F.sum("fn").alias("fn_total"),
                 F.sum("fp").alias("fp_total")]
    return folds.groupBy(*keys).agg(*[F.avg(m).alias(m) for m in metrics],
                                    *[sd(m).alias(f"{m}_sd") for m in metrics], *extra)


# --- thresholds by search ---------------------------------------------------

def youden_objective(tn, fp, fn, tp) -> Column:
    return F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0)) - F.coalesce(F.try_divide(fp, fp + tn), F.lit(0.0))


OBJECTIVES = {"youden": youden_objective, "kappa": kappa}


def threshold_by_midpoints(df: DataFrame, score: str, y: str, objective="youden", keys=(), **kw) -> DataFrame:
    """Median of the midpoints between scores that maximise the objective.

    ``objective`` is a name or a function of the four counts. With fewer than
    two distinct scores the threshold is .5. The counts at a midpoint are the
    running totals at the score above it, so no rows meet candidates.
    """
    keys = list(keys) or ["_all"]
    if keys == ["_all"]:
        df = df.withColumn("_all", F.lit(0))
    fn_ = OBJECTIVES[objective] if isinstance(objective, str) else objective
    run = running(df, keys, score, _class_sums(y), descending=True, **kw)
    tp, fp = F.col("cum_pos"), F.col("cum_neg")
    value = F.round(fn_(F.col("all_neg") - fp, fp, F.col("all_pos") - tp, tp), 12)
    # one row per distinct score, read three times below
    at = cut_lineage(run.select(*keys, F.col(score).alias("_s"), (tp + fp).alias("_end"),
                    (tp + fp - F.col("pos") - F.col("neg")).alias("_start"),
                    F.when(tp + fp < F.col("all_pos") + F.col("all_neg"), value).alias("_v")))
    best = at.groupBy(*keys).agg(F.max("_v").alias("_best"))
    winners = at.join(best, keys).where(F.col("_v") == F.col("_best"))
    # the next lower score starts where the winner's count ends
    lower = at.select(*keys, F.col("_s").alias("_lower"), F.col("_start").alias("_end"))
    mids = winners.join(lower, [*keys, "_end"]).select(
        *keys, ((F.col("_s") + F.col("_lower")) / 2).alias("_mid"))
    med = quantiles(mids, keys, "_mid", {"threshold": 0.5}, **kw)
    out = best.join(med, keys, "left").select(
        *keys, F.coalesce("threshold", F.lit(0.5)).alias("threshold"), F.col("_best").alias("value"))
    return out.drop("_all")


def threshold_by_grid(df: DataFrame, score: str, y: str, objective="kappa", keys=(),
                      lo: float = 0.20, hi: float = 0.80, steps: int = 61) -> DataFrame:
    """Best of ``steps`` evenly spaced thresholds; ties go to the one nearest .5.

    Each score adds to the histogram cell of the highest threshold it passes;
    running totals over the cells give the counts at every threshold.
    """
    keys = list(keys)
    fn_ = OBJECTIVES[objective] if isinstance(objective, str) else objective
    grid = [lo + (hi - lo) * i / (steps - 1) for i in range(steps)]
    passed = sum((F.when(F.col(score) >= t, 1).otherwise(0) for t in grid[1:]),
                 F.when(F.col(score) >= grid[0], 1).otherwise(0))
    cells = df.groupBy(*keys, passed.alias("_cell")).agg(
        F.sum(F.col(y).cast("bigint")).alias("pos"), F.sum(1 - F.col(y).cast("bigint")).alias("neg"))
    per_key = cells.groupBy(*keys).agg(F.collect_list(F.struct("_cell", "pos", "neg")).alias("_c"))

    def total(field, cond):
        return F.aggregate("_c", F.lit(0).cast("bigint"),
                           lambda acc, c: acc + F.when(cond(c), c[field]).otherwise(0))
    each = per_key.select(*keys, "_c", F.posexplode(F.array(*[F.lit(t) for t in grid])).alias("_i", "threshold"))
    each = each.select(
        *keys, "threshold",
        total("pos", lambda c: c["_cell"] > F.col("_i")).alias("tp"),
        total("neg", lambda c: c["_cell"] > F.col("_i")).alias("fp"),
        total("pos", lambda c: c["_cell"] <= F.col("_i")).alias("fn"),
        total("neg", lambda c: c["_cell"] <= F.col("_i")).alias("tn"))
    value = F.round(fn_(F.col("tn"), F.col("fp"), F.col("fn"), F.col("tp")), 9)
    pick = F.max(F.struct(value.alias("v"), (-F.round(F.abs(F.col("threshold") - 0.5), 9)).alias("near"),
                          (-F.col("threshold")).alias("low")))
    return each.groupBy(*keys).agg(pick.alias("_p")).select(
        *keys, F.round(-F.col("_p.low"), 9).alias("threshold"), F.col("_p.v").alias("value"))


def errors(scored: DataFrame, y="y", pred="pred") -> DataFrame:
    """Misclassified rows with their kind."""
    return scored.where(F.col(y) != F.col(pred)).withColumn(
        "kind", F.when(F.col(y) == 1, "false_negative").otherwise("false_positive"))


def ranked(summary: DataFrame, by="kappa") -> DataFrame:
    """Comparison table, best first, with its pass marks."""
    from rasterlab.functions.scalar import pass_marks
    marks = pass_marks({k: F.col(k) for k in P.PASS_BAR})
    return summary.withColumn("passes", marks).orderBy(F.col(by).desc(), "name")
