"""Round trips through the stores: what is written is what is read."""

from pyspark.sql import functions as F

from rasterlab.functions import rules as R
from rasterlab.functions.scalar import exif_orientation
from rasterlab.operators import audit as A, metrics as M, quality as Q, scans as T
from rasterlab.plans import fixtures as X
from rasterlab.plans.metric_queries import CELLS, FOLD5, RATES, _fold_scored
from rasterlab.plans.registry import query, rnd, table
from rasterlab.sources import images as I, sinks as W, tables as S
from rasterlab.streaming.jobs import work_folder

SC = f"({X.SCANS_SQL})"


@query("training_csv_roundtrip", f"""
  SELECT sample_code, k, compactdry_truth AS compactdry FROM {SC}
  WHERE coalesce(crop, 'onion') = 'onion' AND compactdry_truth IS NOT NULL""")
def training_csv_roundtrip(spark, d):
    path = work_folder(spark, "training") + "/features.csv"
    kept, _ = T.training_rows(X.scans(spark, d), ["k"])
    W.write_training_table(kept, path)
    return S.read_features(spark, path, S.feature_schema(["k"]))


@query("fold_report_csv", f"""
  WITH c AS (SELECT fold, {CELLS.format(y='y', p='(score >= 0.5)::int')} FROM ({FOLD5}) GROUP BY 1)
  SELECT fold, {rnd('accuracy')} AS accuracy, {rnd('kappa')} AS kappa FROM (SELECT fold, {RATES} FROM c)""")
def fold_report_csv(spark, d):
    path = work_folder(spark, "report")
    f = M.fold_metrics(_fold_scored(spark, d).withColumn("threshold", F.lit(0.5)), ["fold"], with_auc=False)
    W.write_report(f.select("fold", F.round("accuracy", 6).alias("accuracy"), F.round("kappa", 6).alias("kappa")), path)
    return S.read_or_empty(spark, path, "fold int, accuracy double, kappa double")


@query("model_config_roundtrip", f"""
  SELECT feature, min(value) AS min, max(value) AS max, {rnd('quantile_cont(value, 0.05)', 9)} AS p05,
         {rnd('quantile_cont(value, 0.95)', 9)} AS p95, 4 AS n_features
  FROM (SELECT unnest([quantity, extendedprice, discount, tax]) AS value,
               unnest(['quantity', 'extendedprice', 'discount', 'tax']) AS feature FROM ({X.VIEWS_SQL})) GROUP BY 1""")
def model_config_roundtrip(spark, d):
    """Ranges written as a model configuration and read back from it."""
    path = work_folder(spark, "config")
    ranges = A.feature_ranges(A.long_form(X.views(spark, d), [], X.VIEW_FEATURES))
    ranges = ranges.select("feature", *[F.round(c, 9).alias(c) for c in ("min", "max", "p05", "p95")])
    one = ranges.groupBy().agg(  # one row per feature of the schema
        F.sort_array(F.collect_list("feature")).alias("feature_names"),
        F.map_from_entries(F.collect_list(F.struct("feature", F.struct("min", "max", "p05", "p95")))).alias(
            "training_feature_ranges"), F.lit(X.THRESHOLD).alias("decision_threshold"))
    W.write_json(one, path)
    config = S.read_model_config(spark, path)
    n = F.broadcast(S.model_summary(config).select("decision_threshold", "n_features"))
    ranges = S.model_ranges(config)
    return ranges.withColumn("decision_threshold", F.lit(X.THRESHOLD)).join(n, "decision_threshold", "left").select(
        "feature", "min", "max", "p05", "p95", "n_features")


@query("partial_results", f"""
  SELECT name, fold, fp, fn FROM (SELECT 'low' AS name, fold, {CELLS.format(y='y', p='(score >= 0.3)::int')} FROM ({FOLD5}) GROUP BY 2)
  UNION ALL SELECT name, fold, fp, fn FROM (SELECT 'high' AS name, fold, {CELLS.format(y='y', p='(score >= 0.7)::int')} FROM ({FOLD5}) GROUP BY 2)""")
def partial_results(spark, d):
    path = work_folder(spark, "partial")
    for name, cut in (("low", 0.3), ("high", 0.7)):
        c = M.confusion(_fold_scored(spark, d), F.col("y"), (F.col("score") >= cut).cast("int"), ["fold"])
        W.append_partial(c.withColumn("name", F.lit(name)), path)
    return spark.read.schema("fold int, fp bigint, fn bigint, name string").parquet(path).select("name", "fold", "fp", "fn")


@query("scan_store_append", f"""
  SELECT 'scans' AS store, coalesce(crop, 'onion') AS crop, count(*) AS n,
         count(*) FILTER (coalesce(crop, 'onion') = 'onion' AND pred_proba >= {X.THRESHOLD}) AS positive
  FROM {SC} WHERE dataset = 'research' GROUP BY 2
  UNION ALL SELECT 'public_scans', NULL, count(*), count(*) FILTER (pred_proba >= {X.THRESHOLD}) FROM {SC} WHERE dataset = 'public'""")
def scan_store_append(spark, d):
    """Scored scans appended to their two tables, then counted there."""
    root = work_folder(spark, "store")
    W.append_scans(T.scored_scan(X.scans(spark, d), F.lit(X.THRESHOLD)), root)
    research = spark.read.schema("pred_label int, crop string").parquet(f"{root}/scans")
    public = spark.read.schema("pred_label int").parquet(f"{root}/public_scans")
    n, pos = F.count(F.lit(1)).alias("n"), F.count_if(F.col("pred_label") == 1).alias("positive")
    return (research.groupBy("crop").agg(n, pos).select(F.lit("scans").alias("store"), "crop", "n", "positive")
            .unionByName(public.agg(n, pos).select(F.lit("public_scans").alias("store"),
                                                   F.lit(None).cast("string").alias("crop"), "n", "positive")))


@query("rejected_rows", f"""
  SELECT problem, count(*) AS n FROM (SELECT CASE WHEN k > 95 THEN 'pred_conf' END AS problem FROM {SC}) WHERE problem IS NOT NULL GROUP BY 1""")
def rejected_rows(spark, d):
    rejects = work_folder(spark, "rejects")
    s = X.scans(spark, d).withColumns({"pred_label": F.lit(1), "pred_conf": F.col("k") / 95.0})
    W.split_by_domain(s.select("pred_label", "compactdry_truth", "pred_conf", "pred_proba", "crop"), rejects)
    return spark.read.schema("problem string").parquet(rejects).groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


@query("blob_debug", f"""
  SELECT o_orderkey AS sample_code, o_orderstatus AS severity, {rnd('avg(l_quantity)')} AS quantity_mean, max(l_quantity) AS quantity_max
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2""")
def blob_debug(spark, d):
    labels = table(spark, d, "orders").select(F.col("o_orderkey").alias("sample_code"), F.col("o_orderstatus").alias("severity"))
    views = X.views(spark, d).withColumnRenamed("head", "sample_code")
    out = W.blob_debug_table(views, labels, ["quantity"])
    return out.withColumn("quantity_mean", F.round("quantity_mean", 6))


@query("decoded_pixels", f"SELECT image_id, y, x, r, g, b FROM ({X.RGB_SQL})")
def decoded_pixels(spark, d):
    """Frames encoded as interleaved BGR bytes, decoded by the photo reader."""
    def byte(i, shift):
        v = F.col("embedding")[(i + shift) % 64].cast("double")
        return F.lpad(F.hex((F.floor(F.abs(v * 1000)) % 256).cast("bigint")), 2, "0")
    cells = F.transform("embedding", lambda v, i: F.concat(byte(i, 42), byte(i, 21), byte(i, 0)))
    photos = table(spark, d, "embeddings").select(
        F.col("vec_id").alias("image_id"), F.lit(X.SIDE).alias("h"), F.lit(X.SIDE).alias("w"), F.lit(3).alias("channels"),
        F.unhex(F.array_join(cells, "")).alias("data"))
    return I.pixels(photos).select("image_id", "y", "x", "r", "g", "b")


def turn_sql(o, x, y, w, h):
    """Upright (x, y) of a stored pixel."""
    return (f"CASE WHEN {o} IN (2, 3) THEN {w} - 1 - {x} WHEN {o} IN (5, 8) THEN {y} WHEN {o} IN (6, 7) THEN {h} - 1 - {y} ELSE {x} END AS x",
            f"CASE WHEN {o} IN (3, 4) THEN {h} - 1 - {y} WHEN {o} IN (5, 6) THEN {x} WHEN {o} IN (7, 8) THEN {w} - 1 - {x} ELSE {y} END AS y")


@query("upright_pixels", f"""
  SELECT vec_id AS image_id, CASE WHEN label % 9 >= 5 THEN 16 ELSE 4 END AS h, CASE WHEN label % 9 >= 5 THEN 4 ELSE 16 END AS w,
         {', '.join(turn_sql('label % 9', 'pos % 16', 'pos // 16', 16, 4))}, floor(abs(embedding[pos + 1]::double * 1000))::int % 256 AS r
  FROM embeddings, (SELECT unnest(range(0, 64))::int AS pos)""")
def upright_pixels(spark, d):
    """Frames of 16 x 4 whose files carry the camera's orientation (none, or in either byte order), read upright."""
    gray = F.transform("embedding", lambda v, i: F.lpad(F.hex((F.floor(F.abs(v.cast("double") * 1000)) % 256).cast("bigint")), 2, "0"))
    o = F.lpad((F.col("label") % 9).cast("string"), 2, "0")
    big = F.concat(F.lit("FFD8FFE100004578696600004D4D002A00000008000101120003"), F.lit("0000000100"), o, F.lit("0000"))
    little = F.concat(F.lit("FFD8FFE1000045786966000049492A00080000000100120103000100"), F.lit("0000"), o, F.lit("000000"))
    content = F.unhex(F.when(o == "00", "FFD8FFE000104A46494600").when(F.col("vec_id") % 2 == 0, big).otherwise(little))
    photos = table(spark, d, "embeddings").select(
        F.col("vec_id").alias("image_id"), F.lit(4).alias("h"), F.lit(16).alias("w"), F.lit(1).alias("channels"),
        F.unhex(F.array_join(gray, "")).alias("data"), exif_orientation(content).alias("orientation"))
    return I.pixels(I.upright_size(photos)).select("image_id", "h", "w", "x", "y", "r")


@query("photo_paths", """
  SELECT source AS code, lang AS light, min(name) AS name, count(*) AS candidates FROM (
    SELECT source, CASE WHEN lang = 'en' THEN 'UV' ELSE 'visible_light' END AS lang, lpad(doc_id::varchar, 9, '0') || '.png' AS name FROM documents)
  GROUP BY 1, 2""")
def photo_paths(spark, d):
    light = F.when(F.col("lang") == "en", "UV").otherwise("visible_light")
    path = F.concat(F.lit("/photos/"), "source", F.lit("/"), light, F.lit("/"),
                    F.lpad(F.col("doc_id").cast("string"), 9, "0"), F.lit(".png"))
    return I.chosen_photos(table(spark, d, "documents").select(*I.path_parts(path)))


# Orders stand for companion photos; an open order is a failed detection.
@query("companion_join", """
  SELECT l.l_orderkey AS head, l.l_partkey AS part, l.l_linenumber AS view, v.o_orderkey IS NOT NULL AS has_companion
  FROM lineitem l LEFT JOIN orders v ON l.l_orderkey = v.o_orderkey AND v.o_orderstatus <> 'P'""")
def companion_join(spark, d):
    uv = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("head"), F.col("l_partkey").alias("part"),
                                            F.col("l_linenumber").alias("view"))
    visible = table(spark, d, "orders").select(F.col("o_orderkey").alias("head"), (F.col("o_orderstatus") != "P").alias("ok"))
    return Q.with_companion(uv, visible, "head")


@query("advice_texts", f"""
  SELECT r_name AS headline, lower(r_name) AS note, count(*) AS n FROM {SC}
  JOIN region ON r_regionkey = CASE WHEN pred_proba >= {X.THRESHOLD} THEN 1 ELSE 3 END GROUP BY 1, 2""")
def advice_texts(spark, d):
    """Texts come from a settings file, written here with a region's words per level."""
    levels = F.array(*map(F.lit, ("unreliable", "positive", "caution", "negative")))
    words = table(spark, d, "region").where("r_regionkey < 4").select(
        F.get(levels, F.col("r_regionkey").cast("int")).alias("level"), F.col("r_name").alias("headline"),
        F.lower("r_name").alias("note"))
    settings = work_folder(spark, "advice")
    W.write_json(words.groupBy().agg(F.struct(F.map_from_entries(F.collect_list(  # four levels
        F.struct("level", F.struct("level", "headline", "note")))).alias("messages")).alias("advice")), settings)
    thr = F.lit(X.THRESHOLD)
    level = R.advice_level(R.predicted_label(F.col("pred_proba"), thr), R.borderline(F.col("pred_proba"), thr),
                           F.lit(None).cast("string"))
    s = X.scans(spark, d).select(level.alias("level"))
    return s.join(F.broadcast(S.advice_texts(spark, settings)), "level").groupBy("headline", "note").agg(F.count(F.lit(1)).alias("n"))


@query("feature_name_difference", """
  SELECT event_id, array_to_string(list_filter(['k', 'texture'], lambda f: NOT list_contains(json_keys(props), f)), ',') AS missing FROM events""")
def feature_name_difference(spark, d):
    from rasterlab.functions.scalar import feature_map
    need = F.array(F.lit("k"), F.lit("texture"))
    return table(spark, d, "events").select("event_id", F.concat_ws(",", F.array_except(
        need, F.map_keys(feature_map(F.col("props"))))).alias("missing"))
