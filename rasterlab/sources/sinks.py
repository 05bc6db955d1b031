"""Writers: scan stores, reports, settings, exports."""

from pyspark.sql import DataFrame, functions as F

from rasterlab.functions import rules as R
from rasterlab.operators import scans as T


def append_scans(scored: DataFrame, root: str) -> None:
    """Append finished scans to their tables, one folder per dataset.

    The research table is laid out by crop; the public one has no crop, no
    truth and no original.
    """
    stamped = scored.withColumn("synced_at", F.current_timestamp())
    if "captured_at" not in stamped.columns:
        stamped = stamped.withColumn("captured_at", F.current_timestamp())
    T.with_crop(T.research_rows(stamped)).write.mode("append").partitionBy("crop").parquet(f"{root}/scans")
    T.public_rows(stamped).write.mode("append").parquet(f"{root}/public_scans")


def write_snapshot(df: DataFrame, path: str) -> DataFrame:
    """Write a changed table beside the one it was read from; read it back."""
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def split_by_domain(rows: DataFrame, rejects: str) -> DataFrame:
    """Rows with allowed values; the others go to a rejects folder with the
    names of the columns at fault."""
    bad = R.domain_problems(F.col("pred_label"), F.col("compactdry_truth"), F.col("pred_conf"),
                            F.col("pred_proba"), F.col("crop"))
    ok, rejected = T.split_valid(rows, F.when(F.size(bad) > 0, F.concat_ws(",", bad)))
    rejected.write.mode("append").parquet(rejects)
    return ok


def write_training_table(kept: DataFrame, path: str) -> None:
    kept.write.mode("overwrite").option("header", True).csv(path)


def write_report(table: DataFrame, path: str) -> None:
    """Report tables are one small file with a header."""
    table.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def append_partial(table: DataFrame, path: str) -> None:
    """Result rows of one finished variant, under its name."""
    table.write.mode("append").partitionBy("name").parquet(path)


def write_json(row: DataFrame, path: str) -> None:
    """A one-row frame as one JSON document."""
    row.select(F.to_json(F.struct("*")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def selection_document(spark, features: list[str], dropped, chosen_by: str, cv: dict) -> DataFrame:
    """Selected features with what was dropped as a near copy of what."""
    row = [(features, len(features), chosen_by, [tuple(d) for d in dropped],
            (int(cv["n_splits"]), int(cv["repeats"]), float(cv["kappa_mean"]), float(cv["accuracy_mean"])))]
    return spark.createDataFrame(
        row, "features array<string>, k int, chosen_by string, dropped_correlated array<struct<feature: string, "
             "duplicate_of: string, corr: double>>, cv struct<n_splits: int, repeats: int, kappa_mean: double, "
             "accuracy_mean: double>")


def blob_debug_table(views: DataFrame, labels: DataFrame, features: list[str], head: str = "sample_code") -> DataFrame:
    """Mean and max of the blob features per head, with its group columns."""
    agg = views.groupBy(head).agg(*[a for f in features for a in (
        F.avg(f).alias(f"{f}_mean"), F.max(f).cast("double").alias(f"{f}_max"))])
    return labels.join(agg, head)
