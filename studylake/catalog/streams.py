"""Streams run to the end of the available data; what they emit must equal the batch answer."""

from pyspark.sql import functions as F

from studylake.catalog import query
from studylake.catalog.mastery import C_CTE, COUNTS
from studylake.catalog.ops import guards_oracle
from studylake.catalog.progress import before_watermark, exam_oracle, greedy, practice_oracle
from studylake.operators import ops as O
from studylake.streaming import aggregates as A
from studylake.streaming import stateful as S
from studylake.streaming.runs import drain, ending, latest, scratch, view_stream
from studylake.sources.tables import oracle, view

_DUE = "CASE WHEN level < 0.3 THEN 1 WHEN level < 0.6 THEN 3 WHEN level < 0.8 THEN 7 WHEN level < 0.9 THEN 14 ELSE 30 END"


@query(
    "s01_stream_mastery",
    oracle(["answers"], f""", {C_CTE}, ld AS (SELECT learner_id, kp_id, max(day) AS d FROM answers GROUP BY 1, 2)
      SELECT m.*, CAST(d + ({_DUE}) AS VARCHAR) AS due FROM m JOIN ld USING (learner_id, kp_id)"""),
)
def _(spark, sf):
    store = A.sync_mastery(view_stream(spark, sf, "answers"), scratch(spark, "mastery"), scratch(spark, "mastery-checkpoint"), buckets=8)
    return store.read().withColumn("due", F.col("due").cast("string"))


@query("s02_stream_daily", oracle(["answers"], f"SELECT learner_id, CAST(day AS VARCHAR) AS day, {COUNTS} FROM answers GROUP BY learner_id, day"))
def _(spark, sf):
    emitted = drain(A.stream_daily(view_stream(spark, sf, "answers")), "daily", "update")
    return latest(emitted, ["learner_id", "day"]).withColumn("day", F.col("day").cast("string"))


@query(
    "s03_stream_sessions",
    oracle(["answers"], """, p AS (SELECT *, lag(ts) OVER (PARTITION BY learner_id ORDER BY ts, answer_id) AS pv FROM answers),
      s AS (SELECT *, sum(CASE WHEN pv IS NULL OR ts - pv >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY learner_id ORDER BY ts, answer_id) AS sid FROM p),
      g AS (SELECT learner_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS e, count(*) AS answers, sum(score) AS score FROM s GROUP BY learner_id, sid)
      SELECT learner_id, CAST(epoch_us(start) AS BIGINT) AS start_us, CAST(epoch_us(e) AS BIGINT) AS end_us, answers, score FROM g
      WHERE e <= (SELECT max(ts) FROM answers) - INTERVAL 10 MINUTE"""),
)
def _(spark, sf):
    emitted = drain(A.stream_sessions(view_stream(spark, sf, "answers")), "sessions", "append")
    return emitted.select("learner_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "answers", "score")


@query("s04_stream_dedup", oracle(["uploads"], "RECURSIVE, up AS (SELECT * FROM uploads WHERE at_s <= (SELECT max(at_s) FROM uploads) - 600), " + greedy("up", "learner_id, file_hash", "at_s", "upload_id", 1800)))
def _(spark, sf):
    return drain(S.stream_dedup(view_stream(spark, sf, "uploads")), "dedup", "append").drop("batch")


@query(
    "s05_quiz_sync_batches",
    oracle(["quiz_raw"], """SELECT answer_id, learner_id, CASE WHEN kp_id <> '' THEN kp_id ELSE concat(domain, CASE WHEN topic <> '' THEN concat('/', topic) ELSE '' END) END AS kp_id,
      CAST(coalesce(greatest(0, least(1, raw_score)), CASE WHEN is_correct THEN 1 ELSE 0 END) AS DOUBLE) AS score FROM quiz_raw WHERE kp_id <> '' OR domain <> ''"""),
)
def _(spark, sf):
    out = scratch(spark, "quiz")
    A.sync_quiz_batches(view_stream(spark, sf, "quiz_raw"), out, scratch(spark, "quiz-checkpoint"))
    return spark.read.parquet(out).drop("batch")


@query(
    "s05_quiz_sync_counters",
    oracle(["quiz_raw"], """SELECT count(DISTINCT answer_id) FILTER (kp_id <> '' OR domain <> '') AS synced, count(*) FILTER (kp_id = '' AND domain = '') AS errors
      FROM quiz_raw"""),
)
def _(spark, sf):
    runs = A.sync_quiz_batches(view_stream(spark, sf, "quiz_raw"), scratch(spark, "quiz"), scratch(spark, "quiz-checkpoint"))
    return spark.createDataFrame(runs, "batch long, synced long, errors long").agg(F.sum("synced").alias("synced"), F.sum("errors").alias("errors"))


@query(
    "s06_stream_orphans",
    oracle(["ingest_stages"], """, l AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY ts DESC, event_id DESC) AS rn FROM ingest_stages)
      SELECT trace_id, epoch_us(ts) // 1000 + 3600000 AS deadline_ms FROM l WHERE rn = 1 AND stage = 'processing'
        AND epoch_us(ts) // 1000 + 3600000 <= epoch_us((SELECT max(ts) FROM ingest_stages)) // 1000 - 600000"""),
)
def _(spark, sf):
    stream = S.stream_deadlines(view_stream(spark, sf, "ingest_stages"), "trace_id", ["processing"], 3600)
    return drain(stream, "orphans", "append").drop("batch")


@query(
    "s07_stream_expiry",
    oracle(["sessions"], """SELECT session_id, epoch_us(created_at) // 1000 + 400 * CAST(86400000 AS BIGINT) AS deadline_ms FROM sessions
      WHERE status IN ('pending', 'active') AND epoch_us(created_at) // 1000 + 400 * CAST(86400000 AS BIGINT)
        <= epoch_us((SELECT max(created_at) FROM sessions)) // 1000 - 600000"""),
)
def _(spark, sf):
    sessions = view_stream(spark, sf, "sessions", "orders").selectExpr(
        "session_id", "session_id AS event_id", "status AS stage", "created_at AS ts"
    )
    return drain(S.stream_deadlines(sessions, "session_id", ["pending", "active"], 400 * 86400), "expiry", "append").drop("batch")


@query(
    "s08_stream_outages",
    oracle(["backend_calls"], """, g AS (SELECT *, count(*) FILTER (ok) OVER (PARTITION BY backend ORDER BY at_s, call_id ROWS UNBOUNDED PRECEDING) AS run FROM backend_calls),
      p AS (SELECT *, row_number() OVER (PARTITION BY backend, run ORDER BY at_s, call_id) AS pos FROM g WHERE NOT ok),
      o AS (SELECT backend, run, at_s FROM p WHERE pos = 3)
      SELECT backend, 'opened' AS change, at_s FROM o UNION ALL
      SELECT g.backend, 'closed', g.at_s FROM g JOIN o ON o.backend = g.backend AND o.run = g.run - 1 WHERE g.ok"""),
)
def _(spark, sf):
    return drain(S.stream_outages(view_stream(spark, sf, "backend_calls")), "outages", "append").drop("batch")


@query(
    "s09_stream_alerts",
    oracle(["telemetry"], """SELECT event_id, device_id, 'warning' AS severity, 'temp_high' AS type, cpu AS value FROM telemetry WHERE cpu > 75
      UNION ALL SELECT event_id, device_id, 'critical', 'storage_full', used_percent FROM telemetry WHERE used_percent > 90
      UNION ALL SELECT event_id, device_id, 'warning', 'storage_high', used_percent FROM telemetry WHERE used_percent > 80 AND used_percent <= 90
      UNION ALL SELECT event_id, device_id, 'warning', 'ssd_life', CAST(ssd_life AS DOUBLE) FROM telemetry WHERE ssd_life < 20"""),
)
def _(spark, sf):
    return drain(A.stream_alerts(view_stream(spark, sf, "telemetry")), "alerts", "append").drop("batch", "ts")


@query(
    "s09_stream_alert_peaks",
    oracle(["telemetry"], """, w AS (SELECT device_id, epoch_us(ts) // 600000000 * 600000000 AS start_us, max(cpu) AS cpu, max(used_percent) AS used, min(ssd_life) AS ssd
        FROM telemetry GROUP BY 1, 2)
      SELECT device_id, start_us, 'warning' AS severity, 'temp_high' AS type, cpu AS value FROM w WHERE cpu > 75
      UNION ALL SELECT device_id, start_us, CASE WHEN used > 90 THEN 'critical' ELSE 'warning' END, CASE WHEN used > 90 THEN 'storage_full' ELSE 'storage_high' END, used FROM w WHERE used > 80
      UNION ALL SELECT device_id, start_us, 'warning', 'ssd_life', CAST(ssd AS DOUBLE) FROM w WHERE ssd < 20"""),
)
def _(spark, sf):
    # An update-mode stream gives a window's alerts anew in each batch; here all come in one.
    peaks = drain(O.alert_peaks(view_stream(spark, sf, "telemetry"), delay="10 minutes"), "peaks", "update").drop("batch")
    return peaks.select("device_id", F.unix_micros("start").alias("start_us"), "severity", "type", "value")


@query("s11_stream_practice", practice_oracle(before_watermark(3600)))
def _(spark, sf):
    fired = drain(S.stream_triggers(view_stream(spark, sf, "answers")), "triggers", "append")
    return fired.filter("trigger = 'practice'").select("learner_id", F.col("target").alias("kp_id"), "at_s", "answer_id")


@query("s11_stream_exam", exam_oracle())
def _(spark, sf):
    path, ends = ending(spark, "answers-end")
    end = view(spark, sf, "answers").agg(F.max(F.col("ts").cast("timestamp")).alias("end"))
    stream = S.stream_triggers(view_stream(spark, sf, "answers"), ends=ends)
    fired = drain(stream, "triggers", "append", last=lambda: end.write.mode("append").parquet(path))
    return fired.filter("trigger = 'exam'").select("learner_id", "at_s", "answer_id")


@query("s13_stream_guarded_sessions", guards_oracle("c.at_s <= (SELECT max(at_s) FROM create_attempts) - 600"))
def _(spark, sf):
    return drain(S.stream_guarded_sessions(view_stream(spark, sf, "create_attempts"), 2000), "guards", "append").drop("batch")
