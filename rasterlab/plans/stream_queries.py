"""Stream jobs over the given tables read as file streams."""

from pyspark.sql import functions as F

from rasterlab.functions import rules as R
from rasterlab.functions.scalar import feature_map
from rasterlab.plans import fixtures as X
from rasterlab.plans.registry import query, table
from rasterlab.streaming import jobs as J, sessions as Z


def _events(spark, d):
    return J.file_stream(spark, d, "events", table(spark, d, "events").schema)


def _as_capture(e):
    """Events as session events: each user is a session."""
    k, kind = feature_map(F.col("props"))["k"], F.col("event_type")
    file_ = F.concat(F.lit("IMG"), F.when(k < 5, ".gif").otherwise(".JPG"))
    return e.select(
        F.col("user_id").cast("string").alias("session_id"), "event_id", F.col("ts").cast("timestamp").alias("ts"),
        F.when(kind.isin("view", "signup"), "upload").when(kind == "click", "skip").when(kind == "error", "retake")
        .otherwise("predict").alias("action"),
        F.when(k > 95, "public").otherwise("research").alias("dataset"),
        F.when(k.between(93, 95), "garlic").otherwise("onion").alias("crop"),
        F.when(k == 50, "").otherwise(F.concat(F.lit("S"), F.col("user_id").cast("string"))).alias("sample_code"),
        F.when(kind == "signup", F.array(file_, file_)).otherwise(F.array(file_)).alias("files"))


# The same machine as a recursion over each user's events in order.
SESSION_SQL = """
  WITH RECURSIVE ev AS (
    SELECT user_id AS u, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn, event_id, ts, k < 5 AS bad,
      CASE WHEN event_type IN ('view', 'signup') THEN 'upload' WHEN event_type = 'click' THEN 'skip'
        WHEN event_type = 'error' THEN 'retake' ELSE 'predict' END AS action,
      CASE WHEN k > 95 THEN 'public' ELSE 'research' END AS ds, CASE WHEN k BETWEEN 93 AND 95 THEN 'garlic' ELSE 'onion' END AS cr,
      CASE WHEN k = 50 THEN '' ELSE 'S' || user_id END AS code, CASE WHEN event_type = 'signup' THEN 2 ELSE 1 END AS n
    FROM (SELECT *, (props->>'$.k')::double AS k FROM events)),
  live AS (SELECT u, rn, NULL::bigint AS event_id, NULL::varchar AS action, NULL::varchar AS outcome, NULL::timestamp AS created,
      NULL::varchar AS ds, NULL::varchar AS cr, NULL::varchar AS code, 0 AS step, ''::varchar AS cap,
      NULL::varchar AS sds, NULL::varchar AS scr, NULL::varchar AS scode, 0 AS sstep, ''::varchar AS scap
    FROM (SELECT DISTINCT u, 0::bigint AS rn FROM ev)
  UNION ALL
    SELECT u, rn, event_id, action, outcome,
      CASE WHEN outcome = 'finished' OR NOT has THEN NULL ELSE created END, ds, cr, code, step, cap,
      CASE WHEN has THEN ds ELSE eds END, CASE WHEN has THEN cr ELSE ecr END, CASE WHEN has THEN code ELSE ecode END,
      CASE WHEN has THEN step ELSE 0 END, CASE WHEN has THEN cap ELSE '' END
    FROM (SELECT *, CASE WHEN outcome = 'accepted' THEN least(step0 + n, 2) WHEN outcome = 'skipped' THEN step0 + 1 ELSE step0 END AS step,
        CASE WHEN outcome = 'accepted' THEN concat_ws(',', nullif(cap0, ''), CASE WHEN step0 = 0 THEN 'V1' ELSE 'VISIBLE' END,
          CASE WHEN n = 2 THEN 'VISIBLE' END) ELSE cap0 END AS cap
      FROM (SELECT *, CASE
          WHEN up AND ecode = '' THEN 'code_required'
          WHEN up AND ds <> eds THEN 'other_dataset' WHEN up AND cr <> ecr THEN 'other_crop'
          WHEN pop AND cap1 = '' THEN 'nothing_to_retake' WHEN up AND step0 >= 2 THEN 'complete'
          WHEN up AND n > 2 - step0 THEN 'too_many_files' WHEN up AND bad THEN 'bad_file' WHEN up THEN 'accepted'
          WHEN NOT has THEN 'no_session' WHEN action = 'skip' AND step0 >= 2 THEN 'complete'
          WHEN action = 'skip' AND step0 = 0 THEN 'step_required' WHEN action = 'skip' THEN 'skipped'
          WHEN ds <> eds THEN 'other_dataset' WHEN NOT contains(cap0, 'V1') THEN 'no_uv' ELSE 'finished' END AS outcome
        FROM (SELECT *, CASE WHEN pop AND ds = eds AND cr = ecr AND cap1 <> '' THEN
              CASE WHEN contains(cap1, ',') THEN regexp_replace(cap1, ',[^,]*$', '') ELSE '' END ELSE cap1 END AS cap0,
            CASE WHEN pop AND ds = eds AND cr = ecr AND cap1 <> '' THEN greatest(step1 - 1, 0) ELSE step1 END AS step0
          FROM (SELECT e.u, e.rn, e.event_id, e.action, e.bad, e.n, e.ds AS eds, CASE WHEN e.ds = 'public' THEN 'onion' ELSE e.cr END AS ecr,
              e.code AS ecode, e.action IN ('upload', 'retake') AS up, a.alive OR (e.action IN ('upload', 'retake') AND e.code <> '') AS has,
              a.alive AND e.action = 'retake' AND e.code <> '' AS pop,
              CASE WHEN a.alive THEN s.created ELSE e.ts END AS created, CASE WHEN a.alive THEN s.ds ELSE e.ds END AS ds,
              CASE WHEN a.alive THEN s.cr WHEN e.ds = 'public' THEN 'onion' ELSE e.cr END AS cr,
              CASE WHEN e.action IN ('upload', 'retake') AND e.code <> '' AND (NOT a.alive OR (s.ds = e.ds AND s.cr =
                CASE WHEN e.ds = 'public' THEN 'onion' ELSE e.cr END)) THEN e.code WHEN a.alive THEN s.code ELSE e.code END AS code,
              CASE WHEN a.alive THEN s.step ELSE 0 END AS step1, CASE WHEN a.alive THEN s.cap ELSE '' END AS cap1
            FROM live s JOIN ev e ON e.u = s.u AND e.rn = s.rn + 1,
              LATERAL (SELECT s.created IS NOT NULL AND e.ts <= s.created + INTERVAL 30 MINUTE AS alive) a)))))
  SELECT u::varchar AS session_id, event_id, action, outcome, sds AS dataset, scr AS crop, scode AS sample_code, scap AS captured,
         sstep AS step, sstep >= 2 AS all_captured FROM live WHERE rn > 0"""


@query("session_machine", SESSION_SQL)
def session_machine(spark, d):
    """Events in order of time, whatever micro-batch brings them; a closing event releases the last hour."""
    ends = J.work_folder(spark, "session-ends")
    Z.closing(spark).limit(0).write.parquet(ends)
    events = _as_capture(_events(spark, d))
    last = spark.readStream.schema(Z.closing(spark).schema).parquet(ends).select(*events.columns)
    out = Z.ordered_sessions(events.unionByName(last))
    done = J.run_until_closed(out, J.work_folder(spark, "sessions"), lambda: Z.closing(spark).write.mode("append").parquet(ends))
    done = done.where(F.col("event_id").isNotNull())
    return done.withColumn("captured", F.concat_ws(",", "captured")).drop("ts")


@query("session_expiry", SESSION_SQL.split("SELECT u::varchar AS session_id")[0] + """
  SELECT u::varchar AS session_id, 'expired' AS outcome, step FROM live
  WHERE (u, rn) IN (SELECT (u, max(rn)) FROM live GROUP BY u)
    AND created + INTERVAL 30 MINUTE < (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def session_expiry(spark, d):
    """Sessions that the timer ended."""
    out = Z.capture_sessions(_as_capture(_events(spark, d)))
    done = J.run_to_files(out, J.work_folder(spark, "expiry"))
    return done.where(F.col("outcome") == "expired").select("session_id", "outcome", "step")


@query("stream_append", f"""
  SELECT dataset, coalesce(crop, 'onion') AS crop, count(*) AS n FROM ({X.SCANS_SQL}) GROUP BY 1, 2""")
def stream_append(spark, d):
    k, kind = feature_map(F.col("props"))["k"], F.col("event_type")
    scans = _events(spark, d).select(
        F.col("event_id").alias("id"), F.col("ts").alias("captured_at"), k.alias("k"),
        F.when(kind == "signup", "garlic").when(kind == "error", F.lit(None)).otherwise("onion").alias("crop"),
        F.when(kind == "view", "public").otherwise("research").alias("dataset"))
    stored = J.append_scans(scans, J.work_folder(spark, "append"))
    return stored.groupBy("dataset", "crop").agg(F.count(F.lit(1)).alias("n"))


@query("stream_counts", f"""
  SELECT event_type AS crop, (value / 500 >= {X.THRESHOLD})::int AS pred_label, count(*) AS n FROM events GROUP BY 1, 2""")
def stream_counts(spark, d):
    s = _events(spark, d).select(F.col("event_type").alias("crop"), R.predicted_label(
        F.col("value") / 500, F.lit(X.THRESHOLD)).alias("pred_label"))
    return J.running_counts(s, J.work_folder(spark, "counts"))


@query("late_truth_upsert", """
  SELECT d.doc_id AS id, CASE WHEN l.doc_id IS NOT NULL THEN CASE WHEN l.toxic = 1 THEN NULL ELSE l.quality END
    WHEN d.n_chars > 2000 THEN 1 END AS compactdry_truth FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def late_truth_upsert(spark, d):
    first = table(spark, d, "documents").select(
        F.col("doc_id").alias("id"), F.when(F.col("n_chars") > 2000, 1).alias("compactdry_truth"),
        F.lit(None).cast("timestamp").alias("truth_recorded_at"))
    patches = J.file_stream(spark, d, "labels", table(spark, d, "labels").schema).select(
        F.col("doc_id").alias("id"), F.when(F.col("toxic") == 0, F.col("quality")).alias("compactdry_truth"),
        F.timestamp_seconds("doc_id").alias("patched_at"))
    out = J.upsert_truth(patches, first, J.work_folder(spark, "truth"))
    return out.select("id", "compactdry_truth")


@query("late_truth_join", """
  SELECT o_orderkey AS id, l_linenumber AS truth, l_partkey AS lot FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey
    AND l_shipdate >= o_orderdate AND l_shipdate <= o_orderdate + INTERVAL 60 DAY
  WHERE l_orderkey IS NOT NULL OR o_orderdate + INTERVAL 60 DAY < least((SELECT max(o_orderdate) FROM orders),
    (SELECT max(l_shipdate) FROM lineitem)) - INTERVAL 1 DAY""")
def late_truth_join(spark, d):
    scans = J.file_stream(spark, d, "orders", table(spark, d, "orders").schema).select(
        F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("timestamp").alias("captured_at"))
    truths = J.file_stream(spark, d, "lineitem", table(spark, d, "lineitem").schema).select(
        F.col("l_orderkey").alias("truth_id"), F.col("l_linenumber").alias("truth"), F.col("l_partkey").alias("lot"),
        F.col("l_shipdate").cast("timestamp").alias("recorded_at"))
    out = J.run_to_files(J.joined_truth(scans, truths, "60 DAYS", "1 day"), J.work_folder(spark, "join"))
    return out.select("id", "truth", "lot")  # scans whose time is up go out with a NULL result
