"""Report texts, scheduled notifications and the ingest job."""

from datetime import datetime, timezone

from studylake.catalog import query
from studylake.catalog.corpus import PACK, registered
from studylake.catalog.mastery import C_CTE, COUNTS, answers
from studylake.catalog.text import GRADE_BAND_SQL, REJECT_SQL, SUBJECT_SQL, docs, matches_sql
from studylake.functions import rules as R
from studylake.functions.rounding import ratio2_oracle
from studylake.plans import ingest as J
from studylake.plans import reports as RP
from studylake.sources.sinks import read_notifications, write_notifications
from studylake.sources.tables import AS_OF, oracle
from studylake.streaming.runs import scratch

_NL = "chr(10)"


def _rows_sql(days: int, as_of: str = AS_OF) -> str:
    inside = f"day BETWEEN DATE '{as_of}' - {days} AND DATE '{as_of}'"
    return f"""{C_CTE}, p AS (SELECT * FROM answers WHERE {inside}),
      t AS (SELECT learner_id, {COUNTS} FROM p GROUP BY 1),
      pc AS (SELECT *, CAST(round({ratio2_oracle('correct', 'total')} * 100) AS INT) AS percent FROM t),
      w5 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY learner_id ORDER BY ts DESC, answer_id DESC) AS k FROM p WHERE score < 1) y WHERE k <= 5),
      wr AS (SELECT learner_id, count(*) AS n, string_agg(concat('  ', CAST(k AS VARCHAR), '. ', question), {_NL} ORDER BY k) AS lines FROM w5 GROUP BY 1),
      dy AS (SELECT learner_id, day, count(*) AS t, round_even(count(*) FILTER (score >= 1) * 100 / count(*), 1) AS a FROM p GROUP BY 1, 2),
      wk AS (SELECT DISTINCT learner_id, kp_id FROM p WHERE score <= 0),
      wl AS (SELECT learner_id, kp_id, CAST(round(level * 100) AS INT) AS lv, total FROM wk JOIN m USING (learner_id, kp_id)),
      mc AS (SELECT learner_id, count(DISTINCT kp_id) AS kps FROM answers GROUP BY 1)"""


def _join(*parts: str) -> str:
    return "concat_ws(chr(10), " + ", ".join(parts) + ")"


def _week(as_of: str) -> str:
    return f"""{_rows_sql(7, as_of)},
  d AS (SELECT learner_id, string_agg(concat('  ', CASE WHEN a >= 80 THEN '✅' WHEN a >= 60 THEN '📖' ELSE '⚠️' END, ' ', strftime(day, '%m-%d'), ': ',
    CAST(t AS VARCHAR), '题 ', CAST(a AS VARCHAR), '%'), {_NL} ORDER BY day) AS lines FROM dy GROUP BY 1),
  k AS (SELECT learner_id, string_agg(concat('  • ', kp_id, ' (掌握度 ', CAST(lv AS VARCHAR), '%)'), {_NL} ORDER BY kp_id) AS lines FROM wl GROUP BY 1)
  SELECT pc.learner_id, {_join("concat('📊 本周学习报告 — ', CAST(pc.learner_id AS VARCHAR))", f"'{'=' * 20}'", "'📝 本周学习概况'",
    "concat('  答题: ', CAST(total AS VARCHAR), ' 题 (正确 ', CAST(correct AS VARCHAR), ' 题)')", "concat('  正确率: ', CAST(percent AS VARCHAR), '%')", "''",
    "'📅 每日详情:'", "d.lines", "''", "CASE WHEN k.lines IS NOT NULL THEN concat_ws(chr(10), '⚠️ 薄弱知识点:', k.lines, '') END",
    "CASE WHEN wr.n IS NOT NULL THEN concat_ws(chr(10), concat('❌ 最近错题 (', CAST(wr.n AS VARCHAR), ' 道):'), wr.lines, '') END",
    "CASE WHEN percent >= 80 THEN '⭐ 正确率优秀，继续保持！' WHEN percent >= 60 THEN '💪 进步空间很大，加油！' ELSE '🎯 需要加强基础练习，家长多鼓励孩子！' END")} AS content
  FROM pc JOIN d USING (learner_id) LEFT JOIN k USING (learner_id) LEFT JOIN wr USING (learner_id)"""


@query("h24_report_text_weekly", oracle(["answers"], ", " + _week(AS_OF)))
def _(spark, sf):
    return RP.report_text(answers(spark, sf), "weekly", AS_OF)


_MONTH = f"""{_rows_sql(30)},
  d AS (SELECT learner_id, count(*) AS days, string_agg(concat('  ', strftime(day, '%m-%d'), ': ', repeat('█', greatest(1, CAST(floor(a / 10) AS INT))), ' ',
    CAST(a AS VARCHAR), '% (', CAST(t AS VARCHAR), '题)'), {_NL} ORDER BY day) AS lines FROM dy GROUP BY 1),
  k AS (SELECT learner_id, string_agg(concat('  • ', kp_id, ': 掌握度 ', CAST(lv AS VARCHAR), '% (练习 ', CAST(total AS VARCHAR), ' 题)'), {_NL} ORDER BY kp_id) AS lines FROM wl GROUP BY 1)
  SELECT pc.learner_id, {_join(f"concat('📊 {AS_OF[:4]}年{AS_OF[5:7]}月学习报告 — ', CAST(pc.learner_id AS VARCHAR))", f"'{'=' * 25}'", "''", "'📝 本月学习概况'",
    "concat('  答题总数: ', CAST(total AS VARCHAR), ' 题')", "concat('  正确数量: ', CAST(correct AS VARCHAR), ' 题')", "concat('  正确率: ', CAST(percent AS VARCHAR), '%')",
    "concat('  学习天数: ', CAST(d.days AS VARCHAR), ' 天')", "''", "'📅 每日趋势:'", "d.lines", "''", "'📖 知识掌握'", "concat('  已覆盖知识点: ', CAST(kps AS VARCHAR), ' 个')",
    "CASE WHEN k.lines IS NOT NULL THEN concat_ws(chr(10), '', '⚠️ 薄弱知识点 (需重点关注):', k.lines) END",
    "CASE WHEN wr.n IS NOT NULL THEN concat_ws(chr(10), '', concat('❌ 本月错题 (', CAST(wr.n AS VARCHAR), ' 道):'), wr.lines) END", "''", "'🎯 下月建议'",
    "CASE WHEN k.lines IS NOT NULL THEN '  • 针对薄弱知识点加强练习' END",
    "CASE WHEN percent < 70 THEN '  • 建议回顾错题, 巩固基础' ELSE '  • 继续保持, 挑战更高难度' END", "'  • 坚持每日练习, 积少成多'")} AS content
  FROM pc JOIN d USING (learner_id) JOIN mc USING (learner_id) LEFT JOIN k USING (learner_id) LEFT JOIN wr USING (learner_id)"""


@query("h24_report_text_monthly", oracle(["answers"], ", " + _MONTH))
def _(spark, sf):
    return RP.report_text(answers(spark, sf), "monthly", AS_OF)


def _day(as_of: str) -> str:
    """As the parents' weekly text, of a day and the day before."""
    return f"""{_rows_sql(1, as_of)}, k AS (SELECT learner_id, count(*) AS n FROM wl GROUP BY 1)
  SELECT pc.learner_id, {_join(f"'📚 学习日报 ({as_of})'", f"'{'─' * 20}'", "concat('累计答题: ', CAST(total AS VARCHAR), ' 题')", "concat('正确率: ', CAST(percent AS VARCHAR), '%')",
    "concat('知识点覆盖: ', CAST(kps AS VARCHAR), ' 个')", "concat('薄弱点: ', CAST(coalesce(k.n, 0) AS VARCHAR), ' 个')",
    "CASE WHEN wrong > 0 THEN concat_ws(chr(10), concat('今日错题: ', CAST(wrong AS VARCHAR), ' 道'), '', '📝 今日错题:', wr.lines) END", "''", "'💪 继续加油！'")} AS content
  FROM pc JOIN mc USING (learner_id) LEFT JOIN k USING (learner_id) LEFT JOIN wr USING (learner_id)"""


@query("h24_report_text_daily", oracle(["answers"], ", " + _day(AS_OF)))
def _(spark, sf):
    return RP.report_text(answers(spark, sf), "daily", AS_OF)


# 21:00 in the report zone, a Monday.
_NOW = datetime(2024, 1, 29, 13, 0, tzinfo=timezone.utc)


def _due(kinds: str) -> str:
    """Notifications with their texts: each text is a query of its own with the names of the others."""
    one = lambda name, body: f"{name} AS (WITH {body})"
    ident = "sha256(concat_ws('/', CAST(learner_id AS VARCHAR), report_type, period, target))"
    return f""", {one("dtx", _day("2024-01-29"))}, {one("wtx", _week("2024-01-29"))},
      etx AS (WITH {C_CTE}, s AS (SELECT learner_id, split_part(kp_id, '/', 1) AS subject, count(*) AS n FROM m WHERE level < 0.6 GROUP BY 1, 2),
        r AS (SELECT *, sum(n) OVER (PARTITION BY learner_id) AS whole, row_number() OVER (PARTITION BY learner_id ORDER BY n DESC, subject) AS rn FROM s)
        SELECT learner_id, concat('📝 强化训练', chr(10), '{'─' * 20}', chr(10), '覆盖 ', CAST(n AS VARCHAR), ' 个薄弱知识点，共 10 道题') AS content FROM r WHERE rn = 1 AND whole >= 3),
      al AS (SELECT learner_id, 'daily' AS report_type, '2024-01-29' AS period, 'parent' AS target, content FROM dtx
        UNION ALL SELECT learner_id, 'weekly', '2024-W05', 'parent', content FROM wtx UNION ALL SELECT learner_id, 'exam', '2024-01-29', 'child', content FROM etx)
      SELECT {ident} AS notification_id, learner_id, report_type, period, target, content FROM al WHERE report_type IN ({kinds})"""


_SHOWN = ["notification_id", "learner_id", "report_type", "period", "target", "content"]


@query("a07_write_notifications", oracle(["answers"], _due("'daily', 'weekly', 'exam'")))
def _(spark, sf):
    """Written twice, as by a job that is run again."""
    due, path = RP.scheduled_reports(answers(spark, sf), _NOW), scratch(spark, "notifications")
    for _ in range(2):
        write_notifications(due, path)
    return read_notifications(spark, path).select(_SHOWN)


@query("s10_scheduled_reports", oracle(["answers"], _due("'weekly', 'exam'")))
def _(spark, sf):
    a = answers(spark, sf)
    sent = RP.scheduled_reports(a, _NOW).filter("report_type = 'daily'").select("notification_id")
    return RP.scheduled_reports(a, _NOW, sent).select(_SHOWN)


_KEPT_CHUNKS = PACK.replace("FROM documents", "FROM kept").replace("JOIN documents d", "JOIN kept d").replace(
    "sha256(d.text)", "sha256(concat(d.kb_name, chr(31), d.text))"
)


@query(
    "e02_ingest",
    oracle(["docs"], f"""RECURSIVE, t AS (SELECT *, trim(text, chr(10) || ' ') AS c FROM docs WHERE {REJECT_SQL} = '' AND NOT {matches_sql('lower(filename)', R.SIDECAR_NAME)} AND kb_name <> 'kb2'),
      k AS (SELECT min(doc_id) AS doc_id FROM t WHERE length(c) >= 10 GROUP BY kb_name, c),
      kept AS (SELECT *, {SUBJECT_SQL} AS subject, {GRADE_BAND_SQL} AS grade FROM (SELECT t.doc_id, filename, kb_name, c AS text FROM t JOIN k USING (doc_id)) x),
      {_KEPT_CHUNKS}
      SELECT doc_id, filename, kb_name, subject, grade, 'raw_ocr' AS type, chunk_id, chunk_index, ids.text FROM ids JOIN kept USING (doc_id)"""),
)
def _(spark, sf):
    return J.ingest(docs(spark, sf).select("doc_id", "filename", "size", "kb_name", "text"), registered(spark, sf), "\n", require_cjk=False)
