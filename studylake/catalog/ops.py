"""Sessions, guards, outages, alerts, retention, counters."""

from pyspark.sql import functions as F

from studylake.catalog import query
from studylake.catalog.progress import greedy
from studylake.catalog.text import REJECT_SQL, first_sql
from studylake.functions import rules as R
from studylake.functions import text as T
from studylake.operators import ops as O
from studylake.operators import sessions as S
from studylake.operators.throttle import throttle
from studylake.sources.sinks import rewrite_partitions
from studylake.sources.tables import load, oracle, view
from studylake.streaming.runs import scratch

NOW = "1999-06-01"


def now(at: str = NOW):
    return F.lit(at).cast("timestamp_ntz")


_LIVE = f"status IN ('pending', 'active') AND TIMESTAMP '{NOW}' <= expires_at"


def guards_oracle(judged: str = "TRUE", bypass: str = "FALSE", left: str = "NULL") -> str:
    return oracle(["create_attempts"], f"""RECURSIVE, n AS (SELECT *, {bypass} AS bypass, least(at_s + 2000, coalesce({left} - 1, at_s + 2000)) AS until,
          row_number() OVER (PARTITION BY learner_id ORDER BY at_s, attempt_id) AS rn FROM create_attempts),
      f AS (SELECT DISTINCT learner_id, CAST(0 AS BIGINT) AS rn, CAST([] AS STRUCT(a BIGINT, t VARCHAR, s VARCHAR, u BIGINT)[]) AS acc,
          CAST(-1000000 AS BIGINT) AS last, FALSE AS ok, CAST(-1 AS BIGINT) AS attempt_id FROM create_attempts
        UNION ALL
        SELECT learner_id, rn, CASE WHEN ok THEN list_append(acc, {{'a': at_s, 't': title, 's': source, 'u': until}}) ELSE acc END AS acc,
          CASE WHEN ok THEN at_s ELSE last END AS last, ok, attempt_id FROM (
          SELECT n.learner_id, n.rn, n.at_s, n.title, n.source, n.until, n.attempt_id, f.last,
            list_filter(f.acc, lambda x: n.at_s <= x.u) AS acc,
            n.bypass OR n.at_s - f.last >= 30 AND len(list_filter(f.acc, lambda x: n.at_s <= x.u)) < 5
              AND len(list_filter(f.acc, lambda x: n.at_s <= x.u AND x.t = n.title AND x.s = n.source AND n.at_s - x.a < 300)) = 0 AS ok
          FROM f JOIN n ON n.learner_id = f.learner_id AND n.rn = f.rn + 1) z)
      SELECT c.attempt_id, c.learner_id, c.at_s, c.title, c.source FROM f JOIN create_attempts c USING (attempt_id) WHERE f.ok AND {judged}""")


_BYPASS, _LEFT = "attempt_id % 7 = 0", "CASE WHEN attempt_id % 3 = 0 THEN at_s + 400 END"


@query("w16_guarded_sessions_left", guards_oracle(bypass=_BYPASS, left=_LEFT))
def _(spark, sf):
    """Some attempts pass the guards by the learner's own wish, some sessions are taken up and free their place."""
    attempts = view(spark, sf, "create_attempts").withColumns({"bypass": F.expr(_BYPASS), "left_s": F.expr(_LEFT)})
    return S.guarded_sessions(attempts, ttl_s=2000).select("attempt_id", "learner_id", "at_s", "title", "source")


@query("w16_guarded_sessions", guards_oracle())
def _(spark, sf):
    return S.guarded_sessions(view(spark, sf, "create_attempts"), ttl_s=2000).select(
        "attempt_id", "learner_id", "at_s", "title", "source"
    )


@query(
    "s07_expire_sessions",
    oracle(["sessions"], f"""SELECT session_id, CASE WHEN status IN ('pending', 'active') AND TIMESTAMP '{NOW}' > expires_at
      THEN 'expired' ELSE status END AS status FROM sessions"""),
)
def _(spark, sf):
    return S.expire_sessions(view(spark, sf, "sessions"), now()).select("session_id", "status")


@query(
    "c04_sessions_for",
    oracle(["sessions"], f""", w AS (SELECT concat('chat', CAST(c_custkey AS VARCHAR)) AS chat_id FROM customer WHERE c_mktsegment = 'BUILDING'),
      r AS (SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY created_at DESC, session_id DESC) AS rn FROM sessions
        WHERE {_LIVE} AND chat_id IN (SELECT chat_id FROM w))
      SELECT chat_id, session_id, title, source, status, created_at FROM r WHERE rn = 1"""),
)
def _(spark, sf):
    wanted = load(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'").select(
        F.concat(F.lit("chat"), F.col("c_custkey").cast("string")).alias("chat_id")
    )
    return S.sessions_for(view(spark, sf, "sessions"), wanted, now())


_LABELS = "CASE source WHEN 'wechat' THEN '微信上传' WHEN 'web_upload' THEN '网页上传' WHEN 'auto_generated' THEN 'AI出题' ELSE source END"


@query(
    "t10_pending_tasks",
    oracle(["sessions"], f"""SELECT session_id, learner_id, coalesce(nullif(title, ''), nullif(source_file, ''),
        concat({_LABELS}, '-', coalesce(nullif(task_type, ''), 'task'))) AS title, status, created_at, rn FROM (
      SELECT *, row_number() OVER (PARTITION BY learner_id ORDER BY created_at DESC, session_id DESC) AS rn FROM sessions
      WHERE {_LIVE}) x WHERE rn <= 3"""),
)
def _(spark, sf):
    return S.pending_tasks(view(spark, sf, "sessions"), now(), limit=3)


@query(
    "u03_dedup_within",
    oracle(["uploads"], "RECURSIVE, " + greedy("uploads", "learner_id, file_hash", "at_s", "upload_id", 1800)),
)
def _(spark, sf):
    return throttle(view(spark, sf, "uploads"), ["learner_id", "file_hash"], "at_s", "upload_id", 1800)


@query(
    "s08_outage_windows",
    oracle(["backend_calls"], """, g AS (SELECT *, count(*) FILTER (ok) OVER (PARTITION BY backend ORDER BY at_s, call_id
          ROWS UNBOUNDED PRECEDING) AS run FROM backend_calls),
      p AS (SELECT *, row_number() OVER (PARTITION BY backend, run ORDER BY at_s, call_id) AS pos FROM g WHERE NOT ok),
      r AS (SELECT backend, run, count(*) AS failures, max(at_s) AS last_failure, min(at_s) FILTER (pos = 3) AS opened_at
            FROM p GROUP BY 1, 2 HAVING count(*) >= 3),
      h AS (SELECT backend, run - 1 AS run, at_s AS closed_at FROM g WHERE ok)
      SELECT r.*, opened_at + 60 AS retries_from, coalesce(closed_at, -1) AS closed_at FROM r LEFT JOIN h USING (backend, run)"""),
)
def _(spark, sf):
    return O.outage_windows(view(spark, sf, "backend_calls")).na.fill(-1, ["closed_at"])


@query(
    "s09_device_alerts",
    oracle(["telemetry"], """SELECT event_id, device_id, ts, 'warning' AS severity, 'temp_high' AS type, cpu AS value FROM telemetry WHERE cpu > 75
      UNION ALL SELECT event_id, device_id, ts, 'critical', 'storage_full', used_percent FROM telemetry WHERE used_percent > 90
      UNION ALL SELECT event_id, device_id, ts, 'warning', 'storage_high', used_percent FROM telemetry WHERE used_percent > 80 AND used_percent <= 90
      UNION ALL SELECT event_id, device_id, ts, 'warning', 'ssd_life', CAST(ssd_life AS DOUBLE) FROM telemetry WHERE ssd_life < 20"""),
)
def _(spark, sf):
    return O.device_alerts(view(spark, sf, "telemetry"))


@query(
    "s06_orphaned_ingests",
    oracle(["ingest_stages"], """, l AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY ts DESC, event_id DESC) AS rn FROM ingest_stages)
      SELECT trace_id, ts FROM l WHERE rn = 1 AND stage = 'processing' AND TIMESTAMP '2024-01-30 12:00:00' - ts > INTERVAL 1 HOUR"""),
)
def _(spark, sf):
    return O.orphaned_ingests(view(spark, sf, "ingest_stages"), F.lit("2024-01-30 12:00:00").cast("timestamp"))


_YOUNG = "epoch_us(TIMESTAMP '2024-01-30 00:00:00') - epoch_us(ts) <= {h} * 3600000000"


@query(
    "s12_retain_notifications",
    f"SELECT event_id, ts FROM events WHERE {_YOUNG.format(h=24)} ORDER BY ts DESC, event_id DESC LIMIT 1000",
)
def _(spark, sf):
    files = load(spark, sf, "events").select("event_id", "ts")
    return O.retain(files, F.lit("2024-01-30").cast("timestamp"), 24 * 3600, 1000)


@query("s12_retain_sources", f"SELECT event_id, ts FROM events WHERE {_YOUNG.format(h=72)}")
def _(spark, sf):
    return O.retain(load(spark, sf, "events").select("event_id", "ts"), F.lit("2024-01-30").cast("timestamp"), 72 * 3600)


@query("s12_retain_job", f"SELECT event_id, epoch_us(ts) AS us FROM events WHERE {_YOUNG.format(h=72)}")
def _(spark, sf):
    """The stored table after the job, partitioned by day: only the days that may hold old files are read."""
    path, as_of = scratch(spark, "retain"), F.lit("2024-01-30").cast("timestamp")
    files = load(spark, sf, "events").select("event_id", "ts", F.col("ts").cast("date").alias("day"))
    files.repartition("day").write.partitionBy("day").parquet(path)
    rewrite_partitions(spark, path, "day", lambda stored: O.retain(stored, as_of, 72 * 3600), scratch(spark, "staging"), F.col("day") <= "2024-01-27")
    return spark.read.parquet(path).select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))


@query(
    "g12_ingest_counters",
    oracle(["ingest_steps"], """SELECT run_id, count(DISTINCT file_id) AS files_in, count(*) FILTER (kind = 'page_done') AS pages_done,
      count(*) FILTER (kind = 'page_skipped') AS pages_skipped, count(*) FILTER (kind = 'page_failed') AS pages_failed,
      count(*) FILTER (kind = 'file_out') AS files_out, count(*) FILTER (kind = 'error') AS errors FROM ingest_steps GROUP BY 1"""),
)
def _(spark, sf):
    return O.ingest_counters(view(spark, sf, "ingest_steps"))


@query(
    "g13_collection_counts",
    oracle(["docs"], f"""SELECT kb_name, {first_sql('filename', R.FILENAME_SUBJECTS, '')} AS subject,
      CASE WHEN {REJECT_SQL} = '' THEN 'raw_ocr' ELSE 'rejected' END AS type, count(*) AS chunks FROM docs GROUP BY 1, 2, 3"""),
)
def _(spark, sf):
    rows = view(spark, sf, "docs").select(
        "kb_name", T.subject_from_filename(F.col("filename")).alias("subject"),
        F.when(T.admission_reject(F.col("filename"), F.col("size")) == "", "raw_ocr").otherwise("rejected").alias("type"),
    )
    return O.collection_counts(rows)


@query(
    "g14_turn_duration",
    """SELECT concat(CAST(user_id AS VARCHAR), '/', CAST(CAST(ts AS DATE) AS VARCHAR)) AS turn_id,
      epoch_us(max(ts)) - epoch_us(min(ts)) AS duration_us FROM events GROUP BY 1""",
)
def _(spark, sf):
    turn = F.concat(F.col("user_id").cast("string"), F.lit("/"), F.col("ts").cast("date").cast("string"))
    return O.turn_duration(load(spark, sf, "events").select(turn.alias("turn_id"), "ts"))


_STAGES = "['" + "','".join(O.BOOK_STAGES) + "']"


@query(
    "g15_book_progress",
    oracle(["book_events"], f"""RECURSIVE, v AS (SELECT *, list_position({_STAGES}, stage) - 1 AS r, row_number() OVER (PARTITION BY book_id ORDER BY pos) AS n
        FROM book_events WHERE kind <> 'other'),
      f AS (SELECT DISTINCT book_id, CAST(0 AS BIGINT) AS n, 'pppppp' AS s FROM book_events
        UNION ALL
        SELECT v.book_id, v.n, CASE WHEN kind = 'start' THEN concat(translate(substr(s, 1, r), 'pr', 'cc'), 'r', substr(s, r + 2))
          WHEN kind = 'complete' THEN concat(substr(s, 1, r), 'c', substr(s, r + 2))
          WHEN contains(s, 'r') THEN concat(substr(s, 1, strpos(s, 'r') - 1), 'e', substr(s, strpos(s, 'r') + 1)) ELSE s END
        FROM f JOIN v ON v.book_id = f.book_id AND v.n = f.n + 1),
      l AS (SELECT book_id, arg_max(s, n) AS s FROM f GROUP BY 1)
      SELECT book_id, unnest({_STAGES}) AS stage, unnest(list_transform([1, 2, 3, 4, 5, 6], lambda i: CASE substr(s, i, 1) WHEN 'p' THEN 'pending'
        WHEN 'r' THEN 'running' WHEN 'c' THEN 'completed' ELSE 'error' END)) AS state FROM l"""),
)
def _(spark, sf):
    return O.book_progress(view(spark, sf, "book_events"))


@query(
    "g15_book_counters",
    oracle(["book_kinds"], """SELECT book_id, count(*) FILTER (kind = 'page_planning') AS pages_planned,
      count(*) FILTER (kind IN ('page_compiled', 'page_ready')) AS pages_ready, count(*) FILTER (kind = 'block_ready') AS blocks_ready,
      count(*) FILTER (kind = 'block_error') AS blocks_error,
      coalesce(arg_max(chapter_count, pos) FILTER (kind IN ('spine_round', 'spine_ready')), 0) AS chapters FROM book_kinds GROUP BY 1"""),
)
def _(spark, sf):
    return O.book_counters(view(spark, sf, "book_kinds")).na.fill(0, ["chapters"])
