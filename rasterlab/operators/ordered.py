"""Ordered statistics that never put a whole key into one task.

A running total down a sorted column needs a global order. Small keys use one
window. Larger ones are cut at value bounds into (key, bucket) parts: each part
runs its own window and adds the totals of the parts before it. Bounds are
sketched once and materialised, so every use of the plan sees the same cuts.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from rasterlab.session import BROADCAST_ROWS_MAX, cut_lineage

ROWS_PER_BUCKET = 1_000_000
BUCKETS_MAX = 4096


def with_buckets(df: DataFrame, keys: list[str], value: str,
                 rows_per_bucket: int | None = None, max_rows: int | None = None) -> tuple[DataFrame, int]:
    """(rows with ``_bucket``, keys x buckets).

    ``_bucket`` is the number of value bounds strictly below ``value``. It is
    left out, with a count of 0, when no key has more than ``rows_per_bucket``
    rows. The count is the size of any per-bucket table, so callers know
    whether to broadcast one. A caller that knows no key to have more than
    ``max_rows`` rows saves the look.
    """
    rows_per_bucket = rows_per_bucket or ROWS_PER_BUCKET
    if max_rows is not None and max_rows <= rows_per_bucket:
        return df, 0
    size = df.groupBy(*keys).count().agg(F.max("count").alias("n"), F.count(F.lit(1)).alias("keys")).first()
    buckets = min(BUCKETS_MAX, -(-(size["n"] or 0) // rows_per_bucket))
    if buckets <= 1:
        return df, 0
    probs = [i / buckets for i in range(1, buckets)]
    cuts = cut_lineage(df.groupBy(*keys).agg(
        F.array_distinct(F.percentile_approx(F.col(value), probs, 20 * buckets)).alias("_cuts")))
    steps, s = [], 1
    while s < buckets:
        steps, s = [s] + steps, s * 2
    # binary search: each step is taken when the cut it lands on is still below
    pos = F.aggregate(
        F.array(*[F.lit(i) for i in steps]), F.lit(0),
        lambda at, step: F.when(F.coalesce(F.get(F.col("_cuts"), at + step - 1) < F.col(value), F.lit(False)),
                                at + step).otherwise(at))
    if keys:
        df = df.join(_small(cuts, size["keys"] * buckets // 100), keys)
    else:
        df = df.withColumn("_cuts", F.lit(cuts.first()["_cuts"]))
    return df.withColumn("_bucket", pos).drop("_cuts"), size["keys"] * buckets


def _small(df: DataFrame, rows: int) -> DataFrame:
    """Marked for broadcast when its known size allows it."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS_MAX else df


def running(df: DataFrame, keys: list[str], value: str, sums: dict[str, Column],
            descending: bool = False, rows_per_bucket: int | None = None) -> DataFrame:
    """One row per (keys, value) with totals and running totals.

    For each name in ``sums``: ``name`` is the total at that value,
    ``cum_name`` the running total up to and including it, ``all_name`` the
    total of the key.
    """
    df = df.where(_known(keys))
    parts, size = with_buckets(df, keys, value, rows_per_bucket)
    order = F.col(value).desc() if descending else F.col(value).asc()
    if not size:  # counted: every key fits one window
        at = parts.groupBy(*keys, value).agg(*[c.alias(n) for n, c in sums.items()])
        whole = Window.partitionBy(*keys)
        run = whole.orderBy(order)
        cum, everything = run.rowsBetween(Window.unboundedPreceding, 0), run.rowsBetween(
            Window.unboundedPreceding, Window.unboundedFollowing)
        return at.select("*", *[F.sum(n).over(cum).alias(f"cum_{n}") for n in sums],
                         *[F.sum(n).over(everything).alias(f"all_{n}") for n in sums])
    at = parts.groupBy(*keys, "_bucket", value).agg(*[c.alias(n) for n, c in sums.items()])
    inside = (Window.partitionBy(*keys, "_bucket").orderBy(order)
              .rowsBetween(Window.unboundedPreceding, 0))
    totals = at.groupBy(*keys, "_bucket").agg(*[F.sum(n).alias(n) for n in sums])
    b_order = F.col("_bucket").desc() if descending else F.col("_bucket").asc()
    key_w = Window.partitionBy(*keys)  # at most BUCKETS_MAX rows per key
    before = key_w.orderBy(b_order).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, "_bucket", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_off_{n}") for n in sums],
        *[F.sum(n).over(key_w).alias(f"all_{n}") for n in sums])
    local = at.select("*", *[F.sum(n).over(inside).alias(f"_run_{n}") for n in sums])
    out = local.join(_small(offsets, size), [*keys, "_bucket"])
    return out.select(*keys, value, *sums,
                      *[(F.col(f"_run_{n}") + F.col(f"_off_{n}")).alias(f"cum_{n}") for n in sums],
                      *[f"all_{n}" for n in sums])


def _known(keys: list[str]) -> Column:
    """Rows whose keys are all known; others belong to no group here."""
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).isNotNull()
    return cond


def quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float],
              rows_per_bucket: int | None = None, max_rows: int | None = None) -> DataFrame:
    """Exact linearly interpolated quantiles per key, one column per name.

    For large keys the bucket totals tell which buckets hold the wanted ranks,
    and only the rows of those buckets are sorted.
    """
    df = df.select(*keys, value).where(F.col(value).isNotNull() & _known(keys))
    parts, size = with_buckets(df, keys, value, rows_per_bucket, max_rows)
    if size:
        totals = parts.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
        key_w = Window.partitionBy(*keys)  # at most BUCKETS_MAX rows per key
        before = key_w.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
        totals = totals.select(*keys, "_bucket", "_n", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"),
                               F.sum("_n").over(key_w).alias("all_n"))
        wanted = F.lit(False)
        for p in probs.values():
            for rank in _ranks(p)[:2]:
                wanted = wanted | ((F.col("_off") <= rank) & (rank < F.col("_off") + F.col("_n")))
        hit = totals.where(wanted).select(*keys, "_bucket", "_off", "all_n")
        at = parts.join(_small(hit, size), [*keys, "_bucket"]).groupBy(*keys, "_bucket", value).agg(
            F.count(F.lit(1)).alias("n"), F.max("_off").alias("_off"), F.max("all_n").alias("all_n"))
        inside = (Window.partitionBy(*keys, "_bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
        run = at.withColumn("cum_n", F.sum("n").over(inside) + F.col("_off"))
    else:
        at = parts.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
        w = Window.partitionBy(*keys).orderBy(value)
        run = at.select("*", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("cum_n"),
                        F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("all_n"))
    first = F.col("cum_n") - F.col("n")
    out = []
    for name, p in probs.items():
        lo, hi, frac = _ranks(p)
        at_lo = F.max(F.when((first <= lo) & (lo < F.col("cum_n")), F.col(value)))
        at_hi = F.max(F.when((first <= hi) & (hi < F.col("cum_n")), F.col(value)))
        out.append((at_lo + (at_hi - at_lo) * F.max(frac)).alias(name))
    return run.groupBy(*keys).agg(*out)


def _ranks(p: float):
    """Zero-based ranks around quantile ``p`` of ``all_n`` rows, and the
    fraction between them."""
    rank = (F.col("all_n") - 1) * F.lit(float(p))
    return F.floor(rank), F.ceil(rank), rank - F.floor(rank)


def hash_rank(df: DataFrame, keys: list[str], hashed: str, tie: list[str],
              out: str = "rank0", buckets: int = 4096) -> DataFrame:
    """Zero-based position by (hash, tie) within the keys.

    The hash is uniform over [0, 2^32), so equal slices of its range are equal
    parts of the rows and need no sketch.
    """
    b = df.withColumn("_bucket", F.floor(F.col(hashed) * F.lit(buckets) / F.lit(2 ** 32)).cast("int"))
    totals = b.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = (Window.partitionBy(*keys).orderBy("_bucket")
              .rowsBetween(Window.unboundedPreceding, -1))
    offsets = totals.select(*keys, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    w = Window.partitionBy(*keys, "_bucket").orderBy(hashed, *tie)
    return (b.withColumn("_rn", F.row_number().over(w))
            .join(offsets, [*keys, "_bucket"])
            .withColumn(out, F.col("_rn") - 1 + F.col("_off"))
            .drop("_rn", "_off", "_bucket"))
