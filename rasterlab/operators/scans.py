"""Queries and snapshot changes on the scan tables."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from rasterlab import params as P
from rasterlab.functions import rules as R

SCANS_DDL = """id bigint, sample_code string, crop string, captured_at timestamp, image_path string,
image_original string, pred_label smallint, pred_conf float, pred_proba float, decision_threshold float,
features map<string,double>, ood_status string, borderline boolean, framing_ok boolean, quality_notes string,
compactdry_truth smallint, truth_recorded_at timestamp, note string, synced_at timestamp"""

PUBLIC_SCANS_DDL = """id bigint, scan_code string, captured_at timestamp, image_path string,
pred_label smallint, pred_conf float, pred_proba float, decision_threshold float, features map<string,double>,
ood_status string, borderline boolean, framing_ok boolean, quality_notes string, synced_at timestamp"""

PUBLIC_COLUMNS = ["id", "scan_code", "captured_at", "image_path", "pred_label", "pred_conf", "pred_proba",
                  "decision_threshold", "features", "ood_status", "borderline", "framing_ok",
                  "quality_notes", "synced_at"]


def select(table: DataFrame, columns=None, filters: dict | None = None, newest_by: str | None = None,
           limit: int = 0, tie: str = "id") -> DataFrame:
    """Projection, equality filters, newest first, limit; 0 means no limit."""
    out = table
    for c, v in (filters or {}).items():
        out = out.where(F.col(c).eqNullSafe(F.lit(v)))
    if newest_by:
        out = out.orderBy(F.col(newest_by).desc(), F.col(tie).desc())
    if limit > 0:
        out = out.limit(limit)
    return out.select(*columns) if columns else out


def count(table: DataFrame, filters: dict | None = None) -> int:
    return select(table, filters=filters).count()


def with_crop(scans: DataFrame) -> DataFrame:
    """Rows from before the crop column read as onion."""
    crop = F.col("crop") if "crop" in scans.columns else F.lit(None).cast("string")
    return scans.withColumn("crop", F.coalesce(crop, F.lit("onion")))


def record_truth(scans: DataFrame, patches: DataFrame, recorded_at: Column | None = None) -> DataFrame:
    """New snapshot with lab results set or cleared.

    ``patches`` is (id, compactdry_truth, patched_at): the last patch per id
    wins (of equal times the larger result), and an explicit NULL clears both the result and its time.
    """
    last = patches.groupBy("id").agg(
        F.max_by(F.struct(F.col("compactdry_truth").alias("t"), F.col("patched_at").alias("at")),
                 F.struct("patched_at", "compactdry_truth")).alias("_p"))  # equal times: the larger result
    hit = F.col("_p").isNotNull()
    stamp = recorded_at if recorded_at is not None else F.col("_p.at")
    truth = F.when(hit, F.col("_p.t")).otherwise(F.col("compactdry_truth"))
    when = (F.when(hit & F.col("_p.t").isNotNull(), stamp).when(hit, F.lit(None).cast("timestamp"))
            .otherwise(F.col("truth_recorded_at")))
    return (scans.join(last, "id", "left")
            .withColumns({"compactdry_truth": truth, "truth_recorded_at": when}).drop("_p"))


def delete_matching(table: DataFrame, match: dict) -> DataFrame:
    """Snapshot without the matching rows; an empty match is refused."""
    if not match:
        raise ValueError("delete needs at least one condition")
    cond = F.lit(True)
    for c, v in match.items():
        cond = cond & F.coalesce(F.col(c) == F.lit(v), F.lit(False))
    return table.where(~cond)


def delete_keys(table: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Snapshot without the rows whose key is listed."""
    if not on:
        raise ValueError("delete needs at least one condition")
    return table.join(keys, on, "left_anti")


def research_rows(scored: DataFrame) -> DataFrame:
    return scored.where(F.col("dataset") == "research").drop("dataset")


def public_rows(scored: DataFrame) -> DataFrame:
    """Public table: its own key name, and no truth, crop, note or original."""
    p = scored.where(F.col("dataset") == "public").withColumnRenamed("sample_code", "scan_code")
    return p.select(*[c for c in PUBLIC_COLUMNS if c in p.columns])


def scored_scan(df: DataFrame, threshold: Column) -> DataFrame:
    """Label, confidence and borderline from ``pred_proba``; rounded as stored.

    A crop without a model keeps every model column NULL.
    """
    has_model = F.coalesce(F.col("crop"), F.lit("onion")).isin(P.CROPS_WITH_MODEL)
    p = F.col("pred_proba")

    def only(c):
        return F.when(has_model, c)
    return df.withColumns({
        "pred_label": only(R.predicted_label(p, threshold)),
        "pred_conf": only(F.round(R.confidence(p, threshold), 4)),
        "borderline": only(R.borderline(p, threshold)),
        "decision_threshold": only(F.round(threshold, 4)),
        "ood_status": only(F.col("ood_status")),
    }).withColumn("pred_proba", only(F.round(p, 4)))


def quality_notes(scale: Column, background: Column, exif: Column, failed: Column, ood: Column) -> Column:
    return F.to_json(F.struct(scale.alias("scale"), background.alias("background"), exif.alias("exif"),
                              failed.alias("framing_failed_views"), ood.alias("ood")))


def dataset_stats(scans: DataFrame, image_path: str = "image_path") -> DataFrame:
    """Per crop: totals, classes, shares, balance and images.

    Images are counted over all crops, as the listing does.
    """
    truth = F.col("compactdry_truth")
    per = with_crop(scans).groupBy("crop").agg(
        F.count(F.lit(1)).alias("total_samples"), F.count_if(truth == 1).alias("n_positive"),
        F.count_if(truth == 0).alias("n_negative"), F.count_if(truth.isNull()).alias("n_unlabelled"),
        F.count(image_path).alias("_images"))
    all_crops = Window.partitionBy(F.lit(1))  # one row per crop by now
    per = per.withColumn("n_images", F.sum("_images").over(all_crops)).drop("_images")
    pos, neg = F.col("n_positive"), F.col("n_negative")
    return per.select(
        "*", F.coalesce(F.try_divide(pos * 100.0, pos + neg), F.lit(0.0)).alias("pct_positive"),
        F.coalesce(F.try_divide(neg * 100.0, pos + neg), F.lit(0.0)).alias("pct_negative"),
        F.coalesce(F.try_divide(F.least(pos, neg), F.greatest(pos, neg)), F.lit(0.0)).alias("balance_ratio"),
        F.floor(F.col("n_images") / F.col("total_samples")).alias("n_views_per_sample"))


def queue_counts(scans: DataFrame, keys=()) -> DataFrame:
    truth = F.col("compactdry_truth")
    return scans.groupBy(*keys).agg(
        F.count_if(~F.coalesce(truth.isin(0, 1), F.lit(False))).alias("pending"),
        F.count_if(truth == 1).alias("pos"), F.count_if(truth == 0).alias("neg"))


def training_rows(scans: DataFrame, required: list[str], crop="onion", exclude: DataFrame | None = None,
                  require_framing: bool = False) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped): one feature row per usable scan, and why others went."""
    rows = with_crop(scans).where(F.col("crop") == crop)
    excluded = F.lit(False)
    if exclude is not None:
        rows = rows.join(exclude.select("sample_code").distinct().withColumn("_ex", F.lit(True)), "sample_code", "left")
        excluded = F.coalesce(F.col("_ex"), F.lit(False))
    rows = rows.withColumn("reason", R.drop_reason(
        F.col("sample_code"), F.col("compactdry_truth"), F.col("framing_ok"), F.col("features"),
        required, excluded, require_framing))
    kept = rows.where(F.col("reason").isNull()).select(
        "sample_code", *[F.col("features")[f].alias(f) for f in required],
        F.col("compactdry_truth").cast("int").alias("compactdry"))
    return kept, rows.where(F.col("reason").isNotNull()).select("sample_code", "reason")


def latest_prediction(samples: DataFrame, predictions: DataFrame, key="sample_code", order="row_id") -> DataFrame:
    """Samples with their prediction; the last duplicate wins."""
    last = predictions.groupBy(key).agg(
        F.max_by(F.struct("y_pred", "y_proba"), F.struct(order, "y_proba", "y_pred")).alias("_p"))
    return samples.join(last, key, "left").select(
        *samples.columns, F.col("_p.y_pred").alias("pred_label"), F.col("_p.y_proba").alias("pred_proba"))


def not_yet_stored(incoming: DataFrame, stored: DataFrame, key="sample_code") -> DataFrame:
    return incoming.join(stored.select(key).distinct(), key, "left_anti")


def first_file(files: DataFrame, keys=("code", "light")) -> DataFrame:
    """First file by name per (code, light) and how many there were."""
    return files.groupBy(*keys).agg(F.min("path").alias("path"), F.count(F.lit(1)).alias("candidates"))


def ingest_report(outcomes: DataFrame) -> DataFrame:
    """Attempts by outcome, with how many reached the store."""
    return outcomes.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"),
                                           F.count_if(F.col("saved")).alias("saved"))


def split_valid(df: DataFrame, problem: Column) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with ``problem``); a NULL or empty problem passes."""
    marked = df.withColumn("problem", problem)
    return marked.where(F.col("problem").isNull()).drop("problem"), marked.where(F.col("problem").isNotNull())
