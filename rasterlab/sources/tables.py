"""Readers for feature tables, reports, settings and scan tables."""

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

from rasterlab import params as P

OOF_SCHEMA = "sample_code string, fold int, y_true int, y_pred int, y_proba double"


def feature_schema(names=None) -> StructType:
    names = names if names is not None else P.VIEW_FEATURES + P.HEAD_FEATURES
    return StructType([StructField("sample_code", StringType())]
                      + [StructField(n, DoubleType()) for n in names]
                      + [StructField("compactdry", IntegerType())])


def read_features(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """Feature table in CSV or parquet; the schema is given, not guessed."""
    if path.endswith(".csv"):
        return spark.read.schema(schema or feature_schema()).csv(path, header=True, enforceSchema=False)
    return spark.read.parquet(path)


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header, or no rows when there is no such file."""
    try:
        return spark.read.schema(schema).csv(path, header=True)
    except (AnalysisException, Py4JJavaError) as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], schema)
        raise


def read_json(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """One JSON document as one row."""
    r = spark.read.option("multiLine", True)
    return (r.schema(schema) if schema else r).json(path)


MODEL_CONFIG_SCHEMA = ("feature_names array<string>, training_feature_ranges map<string, struct<min: double, "
                       "max: double, p05: double, p95: double>>, decision_threshold double, model_type string, "
                       "random_seed int, best_params map<string, double>, oob_score double, "
                       "trained_on_n_samples int, trained_on_mock boolean, note string")


def read_model_config(spark: SparkSession, path: str) -> DataFrame:
    return read_json(spark, path, MODEL_CONFIG_SCHEMA)


def model_ranges(config: DataFrame) -> DataFrame:
    """(feature, min, max, p05, p95) of a model configuration."""
    return config.select(F.explode("training_feature_ranges").alias("feature", "_r")).select("feature", "_r.*")


def model_summary(config: DataFrame) -> DataFrame:
    return config.select("decision_threshold", F.size("feature_names").alias("n_features"), "best_params",
                         "model_type", "random_seed", "oob_score", "trained_on_n_samples")


def read_store(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """Scan table; columns added since a file was written read as NULL."""
    return spark.read.schema(ddl).option("mergeSchema", True).parquet(path)


def advice_texts(spark: SparkSession, path: str) -> DataFrame:
    """(level, headline, note) of a settings file's ``advice.messages``; the engine has no texts of its own."""
    schema = "advice struct<messages: map<string, struct<level: string, headline: string, note: string>>>"
    rows = read_json(spark, path, schema).select(F.explode("advice.messages").alias("_k", "_m"))
    return rows.select("_m.level", "_m.headline", "_m.note")
