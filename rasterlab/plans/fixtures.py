"""The given tables read as scans, views, feature tables and rasters."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from rasterlab.functions.hashing import hash32
from rasterlab.functions.scalar import feature_map
from rasterlab.plans.registry import table

THRESHOLD = 0.4

# The scan table: one row per event.
SCANS_SQL = """
  SELECT id, sample_code, crop, dataset, captured_at, k, pred_proba, ood_status, framing_ok,
         compactdry_truth, CASE WHEN k >= 15 THEN sample_code || '/V1.png' END AS image_path
  FROM (SELECT event_id AS id, 'S' || lpad(user_id::varchar, 8, '0') AS sample_code,
          CASE event_type WHEN 'signup' THEN 'garlic' WHEN 'error' THEN NULL ELSE 'onion' END AS crop,
          CASE WHEN event_type = 'view' THEN 'public' ELSE 'research' END AS dataset,
          ts AS captured_at, (props->>'$.k')::double AS k, value / 500 AS pred_proba,
          CASE WHEN (props->>'$.k')::double >= 90 THEN 'out_of_range'
               WHEN (props->>'$.k')::double < 5 THEN 'unknown' ELSE 'in_range' END AS ood_status,
          CASE WHEN event_type = 'error' THEN false WHEN (props->>'$.k')::double < 10 THEN NULL
               ELSE true END AS framing_ok,
          CASE WHEN (props->>'$.k')::double < 40 THEN NULL WHEN (props->>'$.k')::double < 70 THEN 0
               ELSE 1 END AS compactdry_truth
        FROM events)
"""


def scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("features", feature_map(F.col("props")))
    k, kind = F.col("features")["k"], F.col("event_type")
    code = F.concat(F.lit("S"), F.lpad(F.col("user_id").cast("string"), 8, "0"))
    return e.select(
        F.col("event_id").alias("id"), code.alias("sample_code"),
        F.when(kind == "signup", "garlic").when(kind == "error", F.lit(None)).otherwise("onion").alias("crop"),
        F.when(kind == "view", "public").otherwise("research").alias("dataset"),
        F.col("ts").alias("captured_at"), k.alias("k"), "features",
        (F.col("value") / 500).alias("pred_proba"),
        F.when(k >= 90, "out_of_range").when(k < 5, "unknown").otherwise("in_range").alias("ood_status"),
        F.when(kind == "error", F.lit(False)).when(k >= 10, F.lit(True)).alias("framing_ok"),
        F.when(k < 40, F.lit(None).cast("int")).when(k < 70, 0).otherwise(1).alias("compactdry_truth"),
        F.when(k >= 15, F.concat(code, F.lit("/V1.png"))).alias("image_path"))


# Views: the lines of an order are the views of a head.
VIEW_FEATURES = ["quantity", "extendedprice", "discount", "tax"]
VIEWS_SQL = """
  SELECT l_orderkey AS head, l_linenumber AS view, l_quantity AS quantity,
         l_extendedprice AS extendedprice, l_discount AS discount, l_tax AS tax, l_shipdate FROM lineitem
"""


def views(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("head"), F.col("l_linenumber").alias("view"),
        *[F.col(f"l_{f}").alias(f) for f in VIEW_FEATURES], "l_shipdate")


# Labelled samples with a score: documents that have a label.
SCORED_SQL = """
  SELECT d.doc_id AS id, d.source AS grp, l.quality AS y, l.toxic AS y2, d.n_chars,
         ('0x' || substr(md5('s:' || d.doc_id), 1, 8))::bigint / 4294967296.0 * 0.7 + l.quality * 0.3 AS raw,
         round(('0x' || substr(md5('s:' || d.doc_id), 1, 8))::bigint / 4294967296.0 * 0.7
               + l.quality * 0.3, 2) AS score
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id
"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels with a hash-derived score that leans towards the label."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    lab = table(spark, sf_dir, "labels")
    raw = hash32(F.lit("s"), F.col("doc_id")) / 4294967296.0 * 0.7 + F.col("quality") * 0.3
    return d.join(lab, "doc_id").select(
        F.col("doc_id").alias("id"), F.col("source").alias("grp"), F.col("quality").alias("y"),
        F.col("toxic").alias("y2"), "n_chars", raw.alias("raw"), F.round(raw, 2).alias("score"))


# A labelled feature table in long form: the 64 values of each embedding.
LONG_SQL = """
  SELECT vec_id AS id, CASE WHEN label < 5 THEN 1 ELSE 0 END AS y, 'f' || lpad(pos::varchar, 2, '0') AS feature,
         pos AS idx, embedding[pos + 1]::double AS value
  FROM embeddings, (SELECT unnest(range(0, 64))::int AS pos)
"""


def long_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (table(spark, sf_dir, "embeddings")
            .select(F.col("vec_id").alias("id"), (F.col("label") < 5).cast("int").alias("y"),
                    F.posexplode("embedding").alias("idx", "_v"))
            .select("id", "y", F.concat(F.lit("f"), F.lpad(F.col("idx").cast("string"), 2, "0")).alias("feature"),
                    "idx", F.col("_v").cast("double").alias("value")))


def wide_features(spark: SparkSession, sf_dir: str, n: int = 64) -> tuple[DataFrame, list[str]]:
    cols = [f"f{i:02d}" for i in range(n)]
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), (F.col("label") < 5).cast("int").alias("y"),
                    *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(cols)]), cols


# Rasters: each embedding is an 8 x 8 frame, scalar or with three byte channels.
SIDE = 8
SCALAR_SQL = """
  SELECT vec_id AS image_id, pos // 8 AS y, pos % 8 AS x, embedding[pos + 1]::double AS v
  FROM embeddings, (SELECT unnest(range(0, 64))::int AS pos)
"""
RGB_SQL = """
  SELECT vec_id AS image_id, label AS class, pos // 8 AS y, pos % 8 AS x,
         (floor(abs(embedding[pos + 1]::double * 1000))::int % 256) AS r,
         (floor(abs(embedding[(pos + 21) % 64 + 1]::double * 1000))::int % 256) AS g,
         (floor(abs(embedding[(pos + 42) % 64 + 1]::double * 1000))::int % 256) AS b
  FROM embeddings, (SELECT unnest(range(0, 64))::int AS pos)
"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One compact row per frame, laid out by image.

    The hash layout survives the later explode, so every operator keyed by
    image (windows, aggregates) runs without moving pixels again.
    """
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("image_id"), F.col("label").alias("class"), "embedding").repartition("image_id")


def scalar_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir).select("image_id", F.posexplode("embedding").alias("pos", "_v"))
    return f.select("image_id", F.lit(SIDE).alias("h"), F.lit(SIDE).alias("w"),
                    F.expr("pos div 8").cast("int").alias("y"), (F.col("pos") % 8).alias("x"),
                    F.col("_v").cast("double").alias("v"))


def rgb_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each exploded element carries its three channels, so the frame's array
    is not copied into its pixel rows."""
    cell = F.transform("embedding", lambda v, i: F.struct(
        v.alias("a"), F.col("embedding")[(i + 21) % 64].alias("b"), F.col("embedding")[(i + 42) % 64].alias("c")))
    f = frames(spark, sf_dir).select("image_id", "class", F.posexplode(cell).alias("pos", "_v"))

    def channel(name):
        return F.floor(F.abs(F.col(f"_v.{name}").cast("double") * 1000)).cast("int") % 256
    return f.select("image_id", "class", F.lit(SIDE).alias("h"), F.lit(SIDE).alias("w"),
                    F.expr("pos div 8").cast("int").alias("y"), (F.col("pos") % 8).alias("x"),
                    channel("a").alias("r"), channel("b").alias("g"), channel("c").alias("b"))


def packed_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The colour rasters as packed frames (image_id, class, h, w, rgb), never exploded."""
    def channel(i):
        return F.floor(F.abs(F.col("embedding")[i % 64].cast("double") * 1000)).cast("int") % 256
    rgb = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: channel(i) * 65536 + channel(i + 21) * 256 + channel(i + 42))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), F.col("label").alias("class"),
                                                     F.lit(SIDE).alias("h"), F.lit(SIDE).alias("w"), rgb.alias("rgb"))
