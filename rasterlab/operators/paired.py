"""Comparisons of methods over shared folds."""

import math

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType

from rasterlab import params as P

FOLD = ["repeat", "fold"]


def paired_folds(folds: DataFrame, baseline: str, metric="kappa", name="name") -> DataFrame:
    """(name, repeat, fold, d): each method's difference to the baseline."""
    base = folds.where(F.col(name) == baseline).select(*FOLD, F.col(metric).alias("_base"))
    other = folds.where(F.col(name) != baseline)
    return other.join(base, FOLD).select(name, *FOLD, (F.col(metric) - F.col("_base")).alias("d"))


def paired_delta(folds: DataFrame, baseline: str, metric="kappa", name="name", tie: float = 1e-9) -> DataFrame:
    """Mean difference, its spread and t, and how the folds split."""
    d, n = F.col("d"), F.count("d")
    sd = F.stddev_samp("d")
    sem = sd / F.sqrt(n)
    return (paired_folds(folds, baseline, metric, name).where(d.isNotNull()).groupBy(name).agg(
        n.alias("folds"), F.avg("d").alias("d_mean"), sd.alias("d_sd"), sem.alias("d_sem"),
        F.try_divide(F.avg("d"), sem).alias("t"),
        F.avg((d >= -tie).cast("double")).alias("not_worse"),
        F.count_if(d > tie).alias("wins"), F.count_if(d < -tie).alias("losses"),
        F.count_if(F.abs(d) <= tie).alias("ties")))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                    -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def t_two_sided(t: float, df: float) -> float:
    """P(|T| >= |t|) with ``df`` degrees of freedom."""
    if t is None or math.isnan(t):
        return float("nan")
    x, a, b = df / (df + t * t), df / 2, 0.5
    if x in (0.0, 1.0):
        return x
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
                     + a * math.log(x) + b * math.log(1 - x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


@F.pandas_udf(DoubleType())
def t_pvalue(t: pd.Series, folds: pd.Series) -> pd.Series:
    return pd.Series([t_two_sided(a, n - 1) for a, n in zip(t, folds)])


def with_pvalue(delta: DataFrame) -> DataFrame:
    """Two-sided p of the paired t, on the summary rows."""
    return delta.withColumn("p", t_pvalue("t", "folds"))


def delta_in_sd(summary: DataFrame, baseline: str, metric="kappa", name="name") -> DataFrame:
    """Difference to the baseline in units of the baseline's fold SD."""
    base = summary.where(F.col(name) == baseline).select(
        F.col(metric).alias("_m"), F.col(f"{metric}_sd").alias("_s"), F.lit(1).alias("_one"))
    joined = summary.withColumn("_one", F.lit(1)).join(F.broadcast(base), "_one")
    d = F.col(metric) - F.col("_m")
    return joined.withColumn("delta", d).withColumn("delta_in_sd", F.try_divide(d, F.col("_s"))).drop(
        "_m", "_s", "_one")


def fresh_repeats(folds: DataFrame, first: int = 5, metrics=("kappa", "accuracy"), name="name") -> DataFrame:
    """Means over the repeats that played no part in choosing the method."""
    return folds.where(F.col("repeat") >= first).groupBy(name).agg(
        *[F.avg(m).alias(f"{m}_fresh_repeats") for m in metrics])


def leakage_gap(infold: DataFrame, leaky: DataFrame, key="k", metrics=("kappa", "accuracy")) -> DataFrame:
    """Whole-data selection against in-fold selection, per key."""
    a = infold.select(key, *[F.col(m).alias(f"{m}_infold") for m in metrics])
    b = leaky.select(key, *[F.col(m).alias(f"{m}_leaky") for m in metrics])
    return a.join(b, key).select(
        "*", *[(F.col(f"{m}_leaky") - F.col(f"{m}_infold")).alias(f"{m}_gap") for m in metrics])


def stress_delta(measured: DataFrame, draws: DataFrame, metric="kappa", name="name") -> DataFrame:
    """Mean over stressed draws minus the value as measured."""
    mean = draws.groupBy(name).agg(F.avg(metric).alias("stressed"))
    return measured.select(name, F.col(metric).alias("measured")).join(mean, name).withColumn(
        "delta", F.col("stressed") - F.col("measured"))


def stacked(*tables: DataFrame) -> DataFrame:
    """Result tables under one header; columns a table lacks are NULL."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def named_report(comparison: DataFrame, *others: DataFrame, name: str = "name") -> DataFrame:
    """Every row of the comparison with the paired, robustness and other tables of the same ``name`` beside it.

    Methods that a table lacks have NULLs. A column that the report has already gets the number of
    its table as suffix (``kappa_2``). A table that repeats a name is an error, it would repeat methods.
    """
    out = comparison
    for i, t in enumerate(others, 2):
        if not t.groupBy(name).count().where("count > 1").isEmpty():
            raise ValueError(f"table {i} of the report repeats a {name}")
        out = out.join(t.select(name, *[F.col(f"`{c}`").alias(f"{c}_{i}" if c in out.columns else c) for c in t.columns if c != name]), name, "left")
    return out


def best_row(df: DataFrame, by: str, tie: str, keys=()) -> DataFrame:
    """Row with the largest ``by``; the smallest ``tie`` wins ties."""
    cols = df.columns
    pick = F.max(F.struct(F.col(by).alias("_a"), (-F.col(tie)).alias("_b"), F.struct(*cols).alias("_row")))
    return df.where(F.col(by).isNotNull()).groupBy(*keys).agg(pick.alias("_p")).select("_p._row.*")


def passes_bar(summary: DataFrame, bar=P.PASS_BAR) -> DataFrame:
    """One row per method and metric with a bar."""
    return summary.unpivot(["name"], list(bar), "metric", "value").withColumn(
        "ok", F.col("value") >= F.create_map(*[F.lit(x) for kv in bar.items() for x in kv])[F.col("metric")])
