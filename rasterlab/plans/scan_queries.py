"""Scan-table queries, quality rules and store changes."""

from pyspark.sql import functions as F

from rasterlab.functions import rules as R, scalar as S
from rasterlab.operators import quality as Q, scans as T
from rasterlab.plans import fixtures as X
from rasterlab.plans.registry import query, rnd, table

SC = f"({X.SCANS_SQL})"
VW = f"({X.VIEWS_SQL})"
THR = X.THRESHOLD


@query("view_mean_max", f"""
  SELECT head, {rnd('avg(quantity)')} AS quantity_viewmean, max(quantity) AS quantity_viewmax,
         {rnd('avg(extendedprice)')} AS extendedprice_viewmean, max(extendedprice) AS extendedprice_viewmax,
         {rnd('avg(discount)')} AS discount_viewmean, max(discount) AS discount_viewmax,
         {rnd('avg(tax)')} AS tax_viewmean, max(tax) AS tax_viewmax
  FROM {VW} GROUP BY head""")
def view_mean_max(spark, d):
    agg = Q.view_aggregates(X.views(spark, d), "head", X.VIEW_FEATURES)
    return agg.select("head", *[(F.round(c, 6) if c.endswith("mean") else F.col(c)).alias(c)
                                for c in agg.columns if c != "head"])


@query("head_label_join", f"""
  SELECT o.o_orderkey AS head, {rnd('v.price')} AS price_viewmean, o.o_orderstatus,
         CASE WHEN v.price >= 38000 THEN 1 ELSE 0 END AS pred_label,
         CASE WHEN o.o_orderstatus = 'F' THEN 1 WHEN o.o_orderstatus = 'O' THEN 0 END AS truth,
         CASE WHEN o.o_orderstatus = 'F' THEN 1 WHEN o.o_orderstatus = 'O' THEN 0 END
           = CASE WHEN v.price >= 38000 THEN 1 ELSE 0 END AS agree
  FROM (SELECT l_orderkey, avg(l_extendedprice) AS price FROM lineitem GROUP BY 1) v
  JOIN orders o ON v.l_orderkey = o.o_orderkey""")
def head_label_join(spark, d):
    heads = X.views(spark, d).groupBy("head").agg(F.avg("extendedprice").alias("price"))
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("head"), "o_orderstatus")
    truth = F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 0)
    label = R.predicted_label(F.col("price"), F.lit(38000))
    return orders.join(heads, "head").select(
        "head", F.round("price", 6).alias("price_viewmean"), "o_orderstatus", label.alias("pred_label"),
        truth.alias("truth"), R.agreement(truth, label).alias("agree"))


@query("best_view", f"""
  SELECT head, view, quantity FROM (
    SELECT head, view, quantity, row_number() OVER (PARTITION BY head ORDER BY quantity DESC, view) rn FROM {VW})
  WHERE rn = 1""")
def best_view(spark, d):
    return Q.best_view(X.views(spark, d), "head", "view", "quantity")


@query("view_naming", f"""
  SELECT head, count(*) AS n_views, count(*) < 4 AS partial_views, {rnd('avg(quantity)')} AS quantity,
         {rnd('avg(quantity)')} AS quantity_viewmean, max(quantity) AS quantity_viewmax
  FROM {VW} GROUP BY head""")
def view_naming(spark, d):
    v = X.views(spark, d)
    agg = Q.view_aggregates(v, "head", ["quantity"], plain=True)
    n = v.groupBy("head").agg(F.count(F.lit(1)).alias("n_views"))
    return agg.join(n, "head").select(
        "head", "n_views", (F.col("n_views") < 4).alias("partial_views"), F.round("quantity", 6).alias("quantity"),
        F.round("quantity_viewmean", 6).alias("quantity_viewmean"), "quantity_viewmax")


@query("label_left_join", """
  SELECT d.doc_id, d.source, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def label_left_join(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source")
    return docs.join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")


@query("scan_latest", f"""
  SELECT id, sample_code, coalesce(crop, 'onion') AS crop FROM {SC} WHERE dataset = 'public'
  ORDER BY captured_at DESC, id DESC LIMIT 200""")
def scan_latest(spark, d):
    rows = T.with_crop(X.scans(spark, d))
    return T.select(rows, ["id", "sample_code", "crop"], {"dataset": "public"}, "captured_at",
                    R.clamped_limit("not a number"))


@query("scan_select_unlimited", f"""
  SELECT id, sample_code FROM {SC} WHERE crop = 'garlic' AND ood_status = 'in_range'""")
def scan_select_unlimited(spark, d):
    return T.select(X.scans(spark, d), ["id", "sample_code"], {"crop": "garlic", "ood_status": "in_range"}, limit=0)


@query("scan_filter_counts", f"""
  SELECT coalesce(crop, 'onion') AS crop, count(*) FILTER (compactdry_truth IS NULL) AS pending,
         count(*) FILTER (compactdry_truth = 1) AS pos, count(*) FILTER (compactdry_truth = 0) AS neg
  FROM {SC} GROUP BY 1""")
def scan_filter_counts(spark, d):
    return T.queue_counts(T.with_crop(X.scans(spark, d)), ["crop"])


@query("scan_exact_counts", f"""
  SELECT 'all' AS name, count(*) AS n FROM {SC} UNION ALL SELECT 'public', count(*) FROM {SC} WHERE dataset = 'public' UNION ALL
  SELECT 'no crop', count(*) FROM {SC} WHERE crop IS NULL UNION ALL
  SELECT 'positive garlic', count(*) FROM {SC} WHERE crop = 'garlic' AND compactdry_truth = 1""")
def scan_exact_counts(spark, d):
    """Counts under filters; only the counts leave the cluster."""
    s = X.scans(spark, d)
    filters = {"all": {}, "public": {"dataset": "public"}, "no crop": {"crop": None},
               "positive garlic": {"crop": "garlic", "compactdry_truth": 1}}
    return spark.createDataFrame([(name, T.count(s, f)) for name, f in filters.items()], "name string, n bigint")


@query("label_queue", f"""
  SELECT id, sample_code FROM {SC}
  WHERE contains(lower(sample_code), 's0000001') AND coalesce(crop, 'onion') = 'onion' AND compactdry_truth IS NULL""")
def label_queue(spark, d):
    s = X.scans(spark, d)
    return s.where(R.queue_filter(F.col("sample_code"), F.col("crop"), F.col("compactdry_truth"),
                                  " S0000001", "onion", "pending")).select("id", "sample_code")


@query("history_search", f"""
  SELECT id, sample_code FROM {SC} WHERE dataset = 'public' AND contains(lower(sample_code), '7')
    AND pred_proba < {THR} AND (ood_status = 'out_of_range' OR pred_proba >= 0.5 AND pred_proba < {THR}
      OR framing_ok = false)""")
def history_search(spark, d):
    s = X.scans(spark, d).where(F.col("dataset") == "public")
    p = F.col("pred_proba")
    flags = R.trust_flags(F.col("ood_status"), R.borderline(p, F.lit(THR)), F.col("framing_ok"))
    return s.where(R.history_filter(F.col("sample_code"), R.predicted_label(p, F.lit(THR)), flags,
                                    "7", "0", "flagged")).select("id", "sample_code")


@query("sample_search", f"""
  SELECT id, sample_code FROM {SC} WHERE compactdry_truth = 1 AND pred_proba < {THR}""")
def sample_search(spark, d):
    s = X.scans(spark, d)
    truth = F.col("compactdry_truth")
    agree = R.agreement(truth, R.predicted_label(F.col("pred_proba"), F.lit(THR)))
    return s.where(R.sample_filter(F.col("sample_code"), truth, agree, "", "1", "no")).select("id", "sample_code")


@query("sample_search_unlabelled", f"""
  SELECT id FROM {SC} WHERE compactdry_truth IS NULL""")
def sample_search_unlabelled(spark, d):
    s = X.scans(spark, d)
    truth = F.col("compactdry_truth")
    agree = R.agreement(truth, R.predicted_label(F.col("pred_proba"), F.lit(THR)))
    return s.where(R.sample_filter(F.col("sample_code"), truth, agree, "", "na", "na")).select("id")


@query("existing_anti", """
  SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS
    (SELECT 1 FROM events e WHERE e.user_id = customer.c_custkey)""")
def existing_anti(spark, d):
    incoming = table(spark, d, "customer").select("c_custkey", "c_name")
    stored = table(spark, d, "events").select(F.col("user_id").alias("c_custkey"))
    return T.not_yet_stored(incoming, stored, "c_custkey")


@query("exclude_rows", """
  SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)""")
def exclude_rows(spark, d):
    bad = table(spark, d, "labels").where(F.col("toxic") == 1).select("doc_id")
    return table(spark, d, "documents").select("doc_id", "source").join(bad, "doc_id", "left_anti")


@query("required_keys_reasons", f"""
  SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM (
    SELECT CASE WHEN compactdry_truth IS NULL THEN 'no_lab_result' WHEN framing_ok = false THEN 'framing_failed'
                WHEN id IS NOT NULL THEN 'missing_1' END AS reason FROM {SC} WHERE coalesce(crop, 'onion') = 'onion')
  GROUP BY 1""")
def required_keys_reasons(spark, d):
    _, dropped = T.training_rows(X.scans(spark, d), ["k", "texture"], require_framing=True)
    return dropped.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("training_export", f"""
  SELECT sample_code, k, compactdry_truth AS compactdry FROM {SC}
  WHERE coalesce(crop, 'onion') = 'onion' AND compactdry_truth IS NOT NULL
    AND sample_code NOT IN (SELECT 'S' || lpad(s_suppkey::varchar, 8, '0') FROM supplier WHERE s_acctbal < 0)""")
def training_export(spark, d):
    ex = table(spark, d, "supplier").where(F.col("s_acctbal") < 0).select(
        F.concat(F.lit("S"), F.lpad(F.col("s_suppkey").cast("string"), 8, "0")).alias("sample_code"))
    kept, _ = T.training_rows(X.scans(spark, d), ["k"], exclude=ex)
    return kept


@query("domain_checks", f"""
  SELECT id, CASE WHEN k > 95 THEN 'pred_conf' ELSE '' END
    || CASE WHEN k > 95 AND crop = 'garlic' THEN ',' ELSE '' END
    || CASE WHEN crop = 'garlic' THEN 'crop' ELSE '' END AS problems
  FROM {SC} WHERE k > 95 OR crop = 'garlic'""")
def domain_checks(spark, d):
    s = X.scans(spark, d)
    crop = F.when(F.col("crop") == "garlic", "leek").otherwise(F.col("crop"))
    problems = R.domain_problems(F.lit(1), F.col("compactdry_truth"), F.col("k") / 95.0, F.col("pred_proba"), crop)
    return s.select("id", F.concat_ws(",", problems).alias("problems")).where(F.col("problems") != "")


@query("code_validation", """
  SELECT page_id, CASE WHEN NOT contains(url, '?') THEN 'code_required' WHEN length(url) > 32 THEN 'code_too_long' END AS problem
  FROM pages""")
def code_validation(spark, d):
    code = F.when(F.contains(F.col("url"), F.lit("?")), F.col("url")).otherwise("  ")
    return table(spark, d, "pages").select(
        "page_id", R.code_problem(code, F.lit(None).cast("string"), F.lit("research")).alias("problem"))


@query("generated_codes", """
  SELECT event_id, 'P' || strftime(ts, '%y%m%d') || '-' || substr(md5(event_id::varchar), 1, 6) AS code FROM events""")
def generated_codes(spark, d):
    return table(spark, d, "events").select("event_id", S.generated_code(F.col("ts"), F.col("event_id")).alias("code"))


@query("safe_cast", """
  SELECT page_id, coalesce(try_cast(regexp_extract(url, '/([0-9a-z]+)[?]', 1) AS double), 0.0) AS n FROM pages""")
def safe_cast(spark, d):
    return table(spark, d, "pages").select(
        "page_id", S.to_double(F.regexp_extract("url", "/([0-9a-z]+)[?]", 1)).alias("n"))


@query("extension_allow_list", """
  SELECT doc_id, path, regexp_matches(lower(path), '[.](jpg|jpeg|png|heic|heif|webp|dng)$') AS ok FROM (
    SELECT doc_id, source || '/UV/' || doc_id || CASE lang WHEN 'en' THEN '.JPG' WHEN 'fr' THEN '.png'
      WHEN 'de' THEN '.gif' ELSE '' END AS path FROM documents)""")
def extension_allow_list(spark, d):
    suffix = F.when(F.col("lang") == "en", ".JPG").when(F.col("lang") == "fr", ".png").when(
        F.col("lang") == "de", ".gif").otherwise("")
    path = F.concat("source", F.lit("/UV/"), F.col("doc_id").cast("string"), suffix)
    return table(spark, d, "documents").select("doc_id", path.alias("path"), S.uploadable(path).alias("ok"))


@query("first_file", """
  SELECT source AS code, lang AS light, min(lpad(doc_id::varchar, 12, '0') || '.png') AS path, count(*) AS candidates
  FROM documents GROUP BY 1, 2""")
def first_file(spark, d):
    files = table(spark, d, "documents").select(
        F.col("source").alias("code"), F.col("lang").alias("light"),
        F.concat(F.lpad(F.col("doc_id").cast("string"), 12, "0"), F.lit(".png")).alias("path"))
    return T.first_file(files)


@query("dataset_routing", f"""
  SELECT dataset, count(*) AS n, count(compactdry_truth) FILTER (dataset = 'research') AS with_truth
  FROM {SC} GROUP BY 1""")
def dataset_routing(spark, d):
    s = X.scans(spark, d)
    research, public = T.research_rows(s), T.public_rows(s)
    a = research.agg(F.lit("research").alias("dataset"), F.count(F.lit(1)).alias("n"),
                     F.count("compactdry_truth").alias("with_truth"))
    return a.unionByName(public.agg(F.lit("public").alias("dataset"), F.count(F.lit(1)).alias("n"),
                                    F.lit(0).cast("bigint").alias("with_truth")))


@query("public_projection", f"""
  SELECT id, sample_code AS scan_code, image_path, pred_proba, ood_status, framing_ok FROM {SC}
  WHERE dataset = 'public'""")
def public_projection(spark, d):
    return T.public_rows(X.scans(spark, d)).drop("features", "captured_at")


@query("scored_scans", f"""
  SELECT id, CASE WHEN m THEN (pred_proba >= {THR})::int END AS pred_label,
         CASE WHEN m THEN {rnd(f'CASE WHEN pred_proba >= {THR} THEN pred_proba ELSE 1 - pred_proba END', 4)} END AS pred_conf,
         CASE WHEN m THEN {rnd('pred_proba', 4)} END AS pred_proba,
         CASE WHEN m THEN pred_proba >= 0.5 AND pred_proba < {THR} END AS borderline,
         CASE WHEN m THEN {THR}::double END AS decision_threshold, CASE WHEN m THEN ood_status END AS ood_status
  FROM (SELECT *, coalesce(crop, 'onion') = 'onion' AS m FROM {SC})""")
def scored_scans(spark, d):
    s = T.scored_scan(X.scans(spark, d), F.lit(THR))
    return s.select("id", "pred_label", "pred_conf", "pred_proba", "borderline", "decision_threshold", "ood_status")


@query("truth_upsert", """
  SELECT d.doc_id AS id, coalesce(p.quality, CASE WHEN d.n_chars > 2000 THEN 1 END) AS compactdry_truth,
         p.quality IS NOT NULL AS patched
  FROM documents d LEFT JOIN labels p ON d.doc_id = p.doc_id""")
def truth_upsert(spark, d):
    return _patched(spark, d, F.col("quality"))


@query("truth_clear", """
  SELECT d.doc_id AS id, CASE WHEN p.doc_id IS NOT NULL THEN CASE WHEN p.toxic = 1 THEN NULL ELSE p.quality END
           WHEN d.n_chars > 2000 THEN 1 END AS compactdry_truth,
         p.doc_id IS NOT NULL AND p.toxic = 0 AS patched
  FROM documents d LEFT JOIN labels p ON d.doc_id = p.doc_id""")
def truth_clear(spark, d):
    return _patched(spark, d, F.when(F.col("toxic") == 0, F.col("quality")))


def _patched(spark, d, value):
    scans = table(spark, d, "documents").select(
        F.col("doc_id").alias("id"), F.when(F.col("n_chars") > 2000, 1).alias("compactdry_truth"),
        F.lit(None).cast("timestamp").alias("truth_recorded_at"))
    patches = table(spark, d, "labels").select(
        F.col("doc_id").alias("id"), value.alias("compactdry_truth"), F.timestamp_seconds("doc_id").alias("patched_at"))
    out = T.record_truth(scans, patches)
    return out.select("id", "compactdry_truth", F.col("truth_recorded_at").isNotNull().alias("patched"))


@query("guarded_delete", """
  SELECT doc_id, lang FROM documents WHERE NOT (lang = 'en' AND source = 'src0')""")
def guarded_delete(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "source")
    return T.delete_matching(docs, {"lang": "en", "source": "src0"}).drop("source")


@query("dataset_stats", f"""
  SELECT crop, total_samples, n_positive, n_negative, n_unlabelled, n_images,
         {rnd('coalesce(n_positive * 100.0 / nullif(n_positive + n_negative, 0), 0)')} AS pct_positive,
         {rnd('coalesce(n_negative * 100.0 / nullif(n_positive + n_negative, 0), 0)')} AS pct_negative,
         {rnd('coalesce(least(n_positive, n_negative)::double / nullif(greatest(n_positive, n_negative), 0), 0)')} AS balance_ratio,
         n_images // total_samples AS n_views_per_sample,
         CASE WHEN least(n_positive, n_negative)::double / greatest(n_positive, n_negative) >= 0.8 THEN 'good'
              WHEN least(n_positive, n_negative)::double / greatest(n_positive, n_negative) >= 0.5 THEN 'fair'
              ELSE 'poor' END AS balance
  FROM (SELECT coalesce(crop, 'onion') AS crop, count(*) AS total_samples,
          count(*) FILTER (compactdry_truth = 1) AS n_positive, count(*) FILTER (compactdry_truth = 0) AS n_negative,
          count(*) FILTER (compactdry_truth IS NULL) AS n_unlabelled FROM {SC} GROUP BY 1),
       (SELECT count(image_path) AS n_images FROM {SC})""")
def dataset_stats(spark, d):
    s = T.dataset_stats(X.scans(spark, d))
    return s.withColumn("balance", S.balance_band(F.col("balance_ratio"))).withColumns(
        {c: F.round(c, 6) for c in ("pct_positive", "pct_negative", "balance_ratio")})


@query("agreement_flags", f"""
  SELECT id, compactdry_truth = (pred_proba >= {THR})::int AS correct FROM {SC}""")
def agreement_flags(spark, d):
    return X.scans(spark, d).select("id", R.agreement(
        F.col("compactdry_truth"), R.predicted_label(F.col("pred_proba"), F.lit(THR))).alias("correct"))


@query("last_prediction_join", f"""
  SELECT c.c_custkey AS sample_code, p.y_pred AS pred_label, p.y_proba AS pred_proba
  FROM customer c LEFT JOIN (SELECT user_id, (value / 500 >= {THR})::int AS y_pred, value / 500 AS y_proba,
      row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) p
    ON c.c_custkey = p.user_id AND p.rn = 1""")
def last_prediction_join(spark, d):
    samples = table(spark, d, "customer").select(F.col("c_custkey").alias("sample_code"))
    p = F.col("value") / 500
    preds = table(spark, d, "events").select(
        F.col("user_id").alias("sample_code"), (p >= THR).cast("int").alias("y_pred"), p.alias("y_proba"),
        F.col("event_id").alias("row_id"))
    return T.latest_prediction(samples, preds)


REASON = """CASE WHEN ood_status = 'out_of_range' THEN 'out_of_range' WHEN framing_ok = false THEN 'framing'
  WHEN k BETWEEN 70 AND 79 THEN 'scale' WHEN k BETWEEN 80 AND 84 THEN 'background' END"""


@query("advice_level", f"""
  SELECT id, reason, CASE WHEN reason IS NOT NULL THEN 'unreliable' WHEN pred_proba >= 0.6 THEN 'positive'
         WHEN pred_proba >= 0.5 THEN 'caution' ELSE 'negative' END AS level,
         CASE WHEN reason IS NOT NULL THEN 'retake' WHEN pred_proba >= 0.6 THEN 'set aside'
         WHEN pred_proba >= 0.5 THEN 'keep apart' ELSE 'inspect' END AS action
  FROM (SELECT *, {REASON} AS reason FROM {SC})""")
def advice_level(spark, d):
    s = X.scans(spark, d)
    p, k, thr = F.col("pred_proba"), F.col("k"), F.lit(0.6)
    scale = F.when(k.between(70, 79), "inconsistent").otherwise("consistent")
    back = F.when(k.between(80, 84), "inconsistent").otherwise("consistent")
    reason = R.unreliable_reason(F.col("ood_status"), F.col("framing_ok"), scale, back)
    level = R.advice_level(R.predicted_label(p, thr), R.borderline(p, thr), F.col("reason"))
    texts = spark.createDataFrame([("unreliable", "retake"), ("positive", "set aside"), ("caution", "keep apart"),
                                   ("negative", "inspect")], "level string, action string")
    return s.withColumn("reason", reason).select("id", "reason", level.alias("level")).join(
        F.broadcast(texts), "level")


@query("trust_flags", f"""
  SELECT id, concat_ws(',', CASE WHEN ood_status = 'out_of_range' THEN 'out_of_range' END,
    CASE WHEN pred_proba >= 0.5 AND pred_proba < 0.6 THEN 'borderline' END,
    CASE WHEN framing_ok = false THEN 'framing' END) AS flags FROM {SC}""")
def trust_flags(spark, d):
    p = F.col("pred_proba")
    return X.scans(spark, d).select("id", F.concat_ws(",", R.trust_flags(
        F.col("ood_status"), R.borderline(p, F.lit(0.6)), F.col("framing_ok"))).alias("flags"))


@query("label_text_lookup", f"""
  SELECT coalesce(crop, 'onion') AS crop, CASE WHEN pred_proba >= {THR} THEN 'found' ELSE 'not found' END AS label_text,
         count(*) AS n FROM {SC} GROUP BY 1, 2""")
def label_text_lookup(spark, d):
    texts = spark.createDataFrame([(1, "found"), (0, "not found")], "label int, label_text string")
    s = T.with_crop(X.scans(spark, d)).withColumn("label", R.predicted_label(F.col("pred_proba"), F.lit(THR)))
    return s.join(F.broadcast(texts), "label").groupBy("crop", "label_text").agg(F.count(F.lit(1)).alias("n"))


@query("scale_check", """
  SELECT user_id, CASE WHEN n < 2 THEN 'not_applicable' WHEN known < 2 THEN 'unknown'
           WHEN (hi - lo) / hi > 0.25 THEN 'inconsistent' ELSE 'consistent' END AS status,
         CASE WHEN n >= 2 AND known >= 2 THEN round((hi - lo) / hi, 3) + 0.0 END AS spread
  FROM (SELECT user_id, count(*) AS n, count(r) AS known, min(r) AS lo, max(r) AS hi
        FROM (SELECT user_id, CASE WHEN event_type = 'purchase' AND value / 500 + 0.4 <> 0 THEN value / 500 + 0.4 END AS r
              FROM events) GROUP BY 1)""")
def scale_check(spark, d):
    caps = table(spark, d, "events").select(
        "user_id", F.when(F.col("event_type") == "purchase", F.col("value") / 500 + 0.4).alias("radius_frac"))
    return Q.scale_consistency(caps, "user_id")


@query("background_check", """
  SELECT user_id, CASE WHEN n < 2 THEN 'not_applicable' WHEN known < 2 OR lo < 4 THEN 'unknown'
           WHEN hi / lo > 1.25 THEN 'inconsistent' ELSE 'consistent' END AS status,
         CASE WHEN n >= 2 AND known >= 2 AND lo >= 4 THEN round(hi / lo, 3) + 0.0 END AS ratio
  FROM (SELECT user_id, count(*) AS n, count(v) AS known, min(v) AS lo, max(v) AS hi
        FROM (SELECT user_id, CASE WHEN event_type = 'error' THEN value + 3.9 END AS v FROM events) GROUP BY 1)""")
def background_check(spark, d):
    caps = table(spark, d, "events").select(
        "user_id", F.when(F.col("event_type") == "error", F.col("value") + 3.9).alias("bg_level"))
    return Q.background_consistency(caps, "user_id")


@query("settings_check", """
  SELECT sess, CASE WHEN a IS NULL AND c IS NULL THEN 'unknown' WHEN a <> b OR c <> e THEN 'inconsistent'
           ELSE 'consistent' END AS status,
         concat_ws(',', CASE WHEN a <> b THEN 'ISOSpeedRatings' END, CASE WHEN c <> e THEN 'ExposureTime' END) AS varying
  FROM (SELECT o_custkey AS sess, min(iso) AS a, max(iso) AS b, min(et) AS c, max(et) AS e FROM (
      SELECT o_custkey, CASE WHEN o_orderstatus <> 'P' THEN left(o_orderpriority, 1) END AS iso,
             CASE WHEN o_orderstatus = 'F' THEN 'x' || year(o_orderdate) END AS et FROM orders) GROUP BY 1)""")
def settings_check(spark, d):
    status = F.col("o_orderstatus")
    tags = F.map_from_arrays(
        F.array(F.lit("ISOSpeedRatings"), F.lit("ExposureTime")),
        F.array(F.when(status != "P", F.substring("o_orderpriority", 1, 1)),
                F.when(status == "F", F.concat(F.lit("x"), F.year("o_orderdate").cast("string")))))
    caps = table(spark, d, "orders").select(F.col("o_custkey").alias("sess"), tags.alias("settings"))
    return Q.setting_consistency(caps, "sess").withColumn("varying", F.concat_ws(",", "varying"))


@query("setting_text", """
  SELECT l_orderkey, l_linenumber, l_partkey, {0} AS setting FROM (
    SELECT *, l_linenumber::double / nullif(4, 0) AS q FROM lineitem)""".format(
        rnd("q", 6)))
def setting_text(spark, d):
    raw = F.concat(F.col("l_linenumber").cast("string"), F.lit("/4"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey",
                                              F.round(S.setting_text(raw).cast("double"), 6).alias("setting"))


@query("range_check", f"""
  WITH v AS (SELECT head, view, row_number() OVER (PARTITION BY head, view ORDER BY extendedprice, quantity) AS rep,
               l_shipdate, unnest([quantity, extendedprice, discount, tax]) AS value,
               unnest(['quantity', 'extendedprice', 'discount', 'tax']) AS feature FROM {VW}),
  r AS (SELECT feature, min(value) AS lo, max(value) AS hi FROM v WHERE l_shipdate < TIMESTAMP '1996-01-01'
        AND value < CASE feature WHEN 'quantity' THEN 30 WHEN 'extendedprice' THEN 50000 ELSE 0.05 END GROUP BY 1),
  x AS (SELECT head, v.feature, value,
          CASE WHEN value > hi + (hi - lo) * 0.25 THEN (value - hi) / (hi - lo)
               WHEN value < lo - (hi - lo) * 0.25 THEN (lo - value) / (hi - lo) END AS ex
        FROM v JOIN r USING (feature) WHERE l_shipdate >= TIMESTAMP '1996-01-01')
  SELECT head, CASE WHEN count(ex) > 0 THEN 'out_of_range' ELSE 'in_range' END AS status, count(ex) AS n_outliers,
         {rnd('max(ex)')} AS worst FROM x GROUP BY head""")
def range_check(spark, d):
    from rasterlab.operators.audit import long_form
    v = X.views(spark, d)
    cut = F.lit("1996-01-01").cast("timestamp")
    long = long_form(v.withColumn("old", F.col("l_shipdate") < cut), ["head", "old"], X.VIEW_FEATURES)
    cap = F.when(F.col("feature") == "quantity", 30).when(F.col("feature") == "extendedprice", 50000).otherwise(0.05)
    ranges = long.where(F.col("old") & (F.col("value") < cap)).groupBy("feature").agg(
        F.min("value").alias("min"), F.max("value").alias("max"))
    new = long.where(~F.col("old"))
    checked = Q.range_check(new, ranges, "head")
    ex = new.join(F.broadcast(ranges), "feature").groupBy("head").agg(
        F.round(F.max(Q.range_excess(F.col("value"), F.col("min"), F.col("max"))), 6).alias("worst"))
    return checked.join(ex, "head").select("head", "status", "n_outliers", "worst")


@query("range_detail", """
  WITH v AS (SELECT c_custkey AS id, c_acctbal AS value FROM customer),
  r AS (SELECT min(value) AS lo, max(value) AS hi FROM v WHERE value BETWEEN 1000 AND 4000)
  SELECT id, CASE WHEN o THEN 'out_of_range' ELSE 'in_range' END AS status, o::int::bigint AS n_outliers,
         CASE WHEN o THEN 'acctbal=' || printf('%.2f', value) || ' (' || printf('%.2f', lo) || ' to ' || printf('%.2f', hi) || ')' ELSE '' END AS detail
  FROM (SELECT id, value, lo, hi, value > hi + (hi - lo) * 0.25 OR value < lo - (hi - lo) * 0.25 AS o FROM v, r)""")
def range_detail(spark, d):
    long = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lit("acctbal").alias("feature"),
                                              F.col("c_acctbal").alias("value"))
    ranges = long.where(F.col("value").between(1000, 4000)).groupBy("feature").agg(
        F.min("value").alias("min"), F.max("value").alias("max"))
    return Q.range_check(long, ranges, "id")


@query("failed_views", f"""
  SELECT id, 1 AS views_used, true AS partial_views,
         concat_ws(',', CASE WHEN framing_ok = false THEN 'V1' END, CASE WHEN k >= 80 THEN 'VISIBLE' END) AS failed
  FROM {SC}""")
def failed_views(spark, d):
    caps = F.array_compact(F.array(
        F.struct(F.lit("V1").alias("step_id"), F.lit("uv").alias("kind"), F.col("framing_ok").alias("ok")),
        F.when(F.col("k") >= 50, F.struct(F.lit("VISIBLE").alias("step_id"), F.lit("visible").alias("kind"),
                                          (F.col("k") < 80).alias("ok")))))
    s = X.scans(spark, d).withColumn("captures", caps)
    used = R.views_used(F.col("captures"))
    return s.select("id", used.alias("views_used"), (used < 2).alias("partial_views"),
                    F.concat_ws(",", R.failed_views(F.col("captures"))).alias("failed"))


@query("collect_only_crops", f"""
  SELECT coalesce(crop, 'onion') AS crop, count(pred_label) AS classified, count(*) AS stored FROM (
    SELECT crop, CASE WHEN coalesce(crop, 'onion') = 'onion' THEN 1 END AS pred_label FROM {SC}) GROUP BY 1""")
def collect_only_crops(spark, d):
    s = T.with_crop(T.scored_scan(X.scans(spark, d), F.lit(THR)))
    return s.groupBy("crop").agg(F.count("pred_label").alias("classified"), F.count(F.lit(1)).alias("stored"))


@query("quality_notes_json", f"""
  SELECT id, '{{"scale":"' || CASE WHEN k >= 70 THEN 'inconsistent' ELSE 'consistent' END
    || '","background":"unknown","exif":"unknown","framing_failed_views":['
    || CASE WHEN framing_ok = false THEN '"V1"' ELSE '' END || '],"ood":"' || ood_status || '"}}' AS notes FROM {SC}""")
def quality_notes_json(spark, d):
    s = X.scans(spark, d)
    failed = F.array_compact(F.array(F.when(~F.col("framing_ok"), "V1")))
    return s.select("id", T.quality_notes(
        F.when(F.col("k") >= 70, "inconsistent").otherwise("consistent"), F.lit("unknown"), F.lit("unknown"),
        failed, F.col("ood_status")).alias("notes"))


@query("ingest_report", f"""
  SELECT outcome, count(*) AS n, count(*) FILTER (saved) AS saved FROM (
    SELECT CASE WHEN framing_ok = false THEN 'failed' WHEN compactdry_truth IS NOT NULL THEN 'skipped' ELSE 'ok' END AS outcome,
           framing_ok IS NOT NULL AND framing_ok AND compactdry_truth IS NULL AS saved FROM {SC}) GROUP BY 1""")
def ingest_report(spark, d):
    ok, truth = F.col("framing_ok"), F.col("compactdry_truth")
    outcomes = X.scans(spark, d).select(
        F.when(~ok, "failed").when(truth.isNotNull(), "skipped").otherwise("ok").alias("outcome"),
        (F.coalesce(ok, F.lit(False)) & truth.isNull()).alias("saved"))
    return T.ingest_report(outcomes)


@query("value_digits", """
  SELECT p_partkey, CASE WHEN s >= 0.05 THEN printf('%.2f', v) WHEN s >= 0.005 THEN printf('%.3f', v)
    ELSE printf('%.4f', v) END AS txt
  FROM (SELECT p_partkey, p_retailprice AS v, p_size / 1000.0 AS s FROM part)""")
def value_digits(spark, d):
    return table(spark, d, "part").select("p_partkey", S.span_text(
        F.col("p_retailprice"), F.col("p_size") / 1000.0).alias("txt"))


@query("schema_default", f"""
  SELECT coalesce(crop, 'onion') AS crop, count(*) FILTER (coalesce(crop, 'onion') NOT IN ('onion', 'garlic')) AS bad,
         count(*) AS n FROM {SC} GROUP BY 1""")
def schema_default(spark, d):
    s = T.with_crop(X.scans(spark, d))
    return s.groupBy("crop").agg(F.count_if(~F.col("crop").isin("onion", "garlic")).alias("bad"),
                                 F.count(F.lit(1)).alias("n"))


@query("framing_warnings", f"""
  SELECT id, concat_ws(';', CASE WHEN framing_ok = false THEN 'not_found' END,
    CASE WHEN k < 20 THEN 'touches:left' END, CASE WHEN k >= 50 AND pred_proba > 0.25 THEN 'padded' END) AS warnings
  FROM {SC}""")
def framing_warnings(spark, d):
    touches = F.array_compact(F.array(F.when(F.col("k") < 20, "left")))
    return X.scans(spark, d).select("id", F.concat_ws(";", R.framing_warnings(
        F.col("framing_ok"), touches, F.col("k") >= 50, F.col("pred_proba"))).alias("warnings"))


@query("range_report", f"""
  WITH h AS (SELECT head, avg(quantity) AS quantity, max(extendedprice) AS extendedprice FROM {VW} GROUP BY 1),
  x AS (SELECT head, CASE WHEN quantity > 42.5 THEN (quantity - 40) / 10 WHEN quantity < 27.5 THEN (30 - quantity) / 10 END AS a,
          CASE WHEN extendedprice > 55000 THEN (extendedprice - 50000) / 20000 WHEN extendedprice < 25000 THEN (30000 - extendedprice) / 20000 END AS b,
          'quantity=' || printf('%.2f', quantity) || ' (30.00 to 40.00)' AS ta,
          'extendedprice=' || printf('%.2f', extendedprice) || ' (30000.00 to 50000.00)' AS tb FROM h)
  SELECT head, CASE WHEN a IS NULL AND b IS NULL THEN 'in_range' ELSE 'out_of_range' END AS status,
         (a IS NOT NULL)::int + (b IS NOT NULL)::int AS n_outliers,
         CASE WHEN a IS NULL OR b > a OR (b = a) THEN concat_ws('; ', CASE WHEN b IS NOT NULL THEN tb END, CASE WHEN a IS NOT NULL THEN ta END)
              ELSE concat_ws('; ', ta, CASE WHEN b IS NOT NULL THEN tb END) END AS detail FROM x""")
def range_report(spark, d):
    heads = X.views(spark, d).groupBy("head").agg(F.avg("quantity").alias("quantity"),
                                                  F.max("extendedprice").alias("extendedprice"))
    cols = {c: F.col(c) for c in ("quantity", "extendedprice")}
    ranges = {"quantity": (30, 40), "extendedprice": (30000, 50000)}
    return heads.select("head", Q.range_report(cols, ranges).alias("r")).select("head", "r.*")
