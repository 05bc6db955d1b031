"""Consistency checks over the captures of a session and against training ranges.

Every check is one grouped aggregation, so a session with very many captures
is combined map-side like any other group.
"""

from pyspark.sql import Column, DataFrame, functions as F

from rasterlab import params as P
from rasterlab.functions.scalar import span_text


def scale_consistency(captures: DataFrame, session="session_id", radius="radius_frac",
                      limit: float = P.RADIUS_SPREAD_MAX) -> DataFrame:
    """(session, status, spread): do the views agree on the subject's size?

    A radius of 0 counts as unknown.
    """
    known = F.when(F.col(radius) != 0, F.col(radius))
    agg = captures.groupBy(session).agg(F.count(F.lit(1)).alias("_n"), F.count(known).alias("_known"),
                                        F.min(known).alias("_lo"), F.max(known).alias("_hi"))
    spread = F.try_divide(F.col("_hi") - F.col("_lo"), F.col("_hi"))
    judged = (F.col("_n") >= 2) & (F.col("_known") >= 2)
    return agg.select(
        session,
        F.when(F.col("_n") < 2, "not_applicable").when(F.col("_known") < 2, "unknown")
        .when(spread > limit, "inconsistent").otherwise("consistent").alias("status"),
        F.when(judged, F.round(spread, 3)).alias("spread"))


def background_consistency(captures: DataFrame, session="session_id", level="bg_level",
                           limit: float = P.BACKGROUND_RATIO_MAX,
                           floor: float = P.BACKGROUND_MIN_LEVEL) -> DataFrame:
    """(session, status, ratio): did the exposure hold between views?"""
    agg = captures.groupBy(session).agg(F.count(F.lit(1)).alias("_n"), F.count(level).alias("_known"),
                                        F.min(level).alias("_lo"), F.max(level).alias("_hi"))
    ratio = F.try_divide("_hi", "_lo")
    judged = (F.col("_n") >= 2) & (F.col("_known") >= 2) & (F.col("_lo") >= floor)
    return agg.select(
        session,
        F.when(F.col("_n") < 2, "not_applicable").when((F.col("_known") < 2) | (F.col("_lo") < floor), "unknown")
        .when(ratio > limit, "inconsistent").otherwise("consistent").alias("status"),
        F.when(judged, F.round(ratio, 3)).alias("ratio"))


def setting_consistency(captures: DataFrame, session="session_id", settings="settings",
                        tags=tuple(P.SETTING_TAGS)) -> DataFrame:
    """(session, status, varying): do the compared camera tags agree?

    ``settings`` is a map of tag to text. A tag varies when its smallest and
    largest text differ, so no set of values is gathered.
    """
    bounds = [a for t in tags for a in (F.min(F.col(settings)[t]).alias(f"_lo_{t}"),
                                        F.max(F.col(settings)[t]).alias(f"_hi_{t}"))]
    agg = captures.groupBy(session).agg(*bounds)
    varying = F.array_compact(F.array(*[F.when(F.col(f"_lo_{t}") != F.col(f"_hi_{t}"), t) for t in tags]))
    seen = F.coalesce(*[F.col(f"_lo_{t}") for t in tags])
    return agg.select(session, F.when(seen.isNull(), "unknown").when(F.size(varying) > 0, "inconsistent")
                      .otherwise("consistent").alias("status"), varying.alias("varying"))


def range_excess(value: Column, lo: Column, hi: Column, tolerance: float = P.RANGE_TOLERANCE) -> Column:
    """How far a value lies outside the training range, in spans.

    NULL inside the tolerated range and for features that were constant in
    training.
    """
    span = hi - lo
    scale = F.greatest(F.abs(hi), F.abs(lo), F.lit(1e-9))
    flat = (span <= 1e-6) | (span / scale < 1e-3)
    return (F.when(flat | value.isNull(), F.lit(None).cast("double"))
            .when(value > hi + span * tolerance, (value - hi) / span)
            .when(value < lo - span * tolerance, (lo - value) / span))


def range_check(long: DataFrame, ranges: DataFrame, id_: str, top: int = 3,
                tolerance: float = P.RANGE_TOLERANCE) -> DataFrame:
    """(id, status, n_outliers, detail): features beyond the training ranges.

    ``detail`` lists the ``top`` worst with their ranges, worst first. A row has at most one
    value per feature, so the gathered list is as long as the schema is wide.
    """
    r = ranges.select("feature", F.col("min").alias("_lo"), F.col("max").alias("_hi"))
    out = long.join(F.broadcast(r), "feature").withColumn(
        "_ex", range_excess(F.col("value"), F.col("_lo"), F.col("_hi"), tolerance))
    span = F.col("_hi") - F.col("_lo")
    text = F.concat(F.col("feature"), F.lit("="), span_text(F.col("value"), span), F.lit(" ("),
                    span_text(F.col("_lo"), span), F.lit(" to "), span_text(F.col("_hi"), span), F.lit(")"))
    worst = F.sort_array(F.collect_list(F.when(F.col("_ex").isNotNull(), F.struct(
        (-F.col("_ex")).alias("ex"), F.col("feature").alias("f"), text.alias("t")))))
    return out.groupBy(id_).agg(F.count("_ex").alias("n_outliers"), worst.alias("_w")).select(
        id_, F.when(F.col("n_outliers") > 0, "out_of_range").otherwise("in_range").alias("status"),
        "n_outliers", F.concat_ws("; ", F.transform(F.slice("_w", 1, top), lambda s: s["t"])).alias("detail"))


def range_report(values: dict[str, Column], ranges: dict[str, tuple[float, float]], top: int = 3,
                 tolerance: float = P.RANGE_TOLERANCE) -> Column:
    """struct(status, n_outliers, detail) of one wide row.

    A model's ranges are as many as its features, so they go into the
    expression as literals: no join, no grouping.
    """
    if not ranges:
        return F.struct(F.lit("unknown").alias("status"), F.lit(0).alias("n_outliers"), F.lit("").alias("detail"))
    cells = []
    for n, (lo, hi) in ranges.items():
        v = values[n]
        ex = range_excess(v, F.lit(float(lo)), F.lit(float(hi)), tolerance)
        span = F.lit(abs(float(hi) - float(lo)))
        text = F.concat(F.lit(f"{n}="), span_text(v, span), F.lit(" ("), span_text(F.lit(float(lo)), span),
                        F.lit(" to "), span_text(F.lit(float(hi)), span), F.lit(")"))
        cells.append(F.when(ex.isNotNull(), F.struct((-ex).alias("ex"), F.lit(n).alias("f"), text.alias("t"))))
    worst = F.sort_array(F.array_compact(F.array(*cells)))
    return F.struct(F.when(F.size(worst) > 0, "out_of_range").otherwise("in_range").alias("status"),
                    F.size(worst).alias("n_outliers"),
                    F.concat_ws("; ", F.transform(F.slice(worst, 1, top), lambda s: s["t"])).alias("detail"))


def range_status(features: Column, ranges: dict[str, tuple[float, float]],
                 tolerance: float = P.RANGE_TOLERANCE) -> Column:
    """The status alone, of one row's feature map."""
    return range_report({n: features[n] for n in ranges}, ranges, tolerance=tolerance)["status"]


def view_aggregates(views: DataFrame, head: str, features: list[str], plain: bool = False) -> DataFrame:
    """Mean and max of each feature over the views of a head.

    ``plain`` adds the mean under the feature's own name, as scoring needs it.
    """
    aggs = []
    for f in features:
        if plain:
            aggs.append(F.avg(f).alias(f))
        aggs += [F.avg(f).alias(f"{f}_viewmean"), F.max(f).cast("double").alias(f"{f}_viewmax")]
    return views.groupBy(head).agg(*aggs)


def single_or_pair(views: DataFrame, head: str, features: list[str], n_views: int) -> DataFrame:
    """Training naming: plain names for one view, a mean/max pair for more. A head is one row either way; further
    photos of a head with one view are averaged, as scoring does."""
    if n_views == 1:
        return views.groupBy(head).agg(*[F.avg(F.col(f).cast("double")).alias(f) for f in features])
    return view_aggregates(views, head, features)


def best_view(views: DataFrame, head: str, view: str, score: str) -> DataFrame:
    """The view with the largest score; the first one on ties."""
    return views.groupBy(head).agg(
        F.max(F.struct(F.col(score), (-F.col(view)).alias("_v"))).alias("_b")).select(
        head, (-F.col("_b._v")).alias(view), F.col(f"_b.{score}").alias(score))




def with_companion(views: DataFrame, companions: DataFrame, on: str, ok: str = "ok") -> DataFrame:
    """Views with ``has_companion``; a companion whose detection failed does
    not count."""
    usable = companions.where(F.coalesce(F.col(ok), F.lit(True))).select(on).distinct().withColumn("_c", F.lit(True))
    return views.join(usable, on, "left").withColumn("has_companion", F.coalesce("_c", F.lit(False))).drop("_c")
