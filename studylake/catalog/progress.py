"""Order-dependent analytics over the answer log."""

from pyspark.sql import functions as F

from studylake.catalog import query
from studylake.catalog.mastery import C_CTE, COUNTS, answers
from studylake.functions.rounding import level_oracle, ratio2_oracle
from studylake.operators import mastery as M
from studylake.operators import progress as P
from studylake.sources.tables import AS_OF, load, oracle

_KP = "PARTITION BY learner_id, kp_id ORDER BY ts, answer_id ROWS UNBOUNDED PRECEDING"
RUNNING = f"""r0 AS (SELECT *, count(*) OVER ({_KP}) AS total,
    count(*) FILTER (score >= 1) OVER ({_KP}) AS correct,
    count(*) FILTER (score > 0 AND score < 1) OVER ({_KP}) AS partial FROM answers),
  r AS (SELECT *, {level_oracle()} AS level,
    CASE WHEN total > 1 THEN {level_oracle("(correct - CAST(score >= 1 AS BIGINT))",
                                           "(partial - CAST(score > 0 AND score < 1 AS BIGINT))", "(total - 1)")}
    END AS level_before FROM r0)"""

_RUNS = f"""b AS (SELECT *, count(*) FILTER (score < 1) OVER ({_KP}) AS g_bad,
    count(*) FILTER (score >= 1) OVER ({_KP}) AS g_good FROM r),
  k AS (SELECT *, count(*) FILTER (score >= 1) OVER (PARTITION BY learner_id, kp_id, g_bad ORDER BY ts, answer_id
            ROWS UNBOUNDED PRECEDING) AS consecutive_correct,
    count(*) FILTER (score < 1) OVER (PARTITION BY learner_id, kp_id, g_good ORDER BY ts, answer_id
            ROWS UNBOUNDED PRECEDING) AS consecutive_wrong FROM b)"""

_DAYS_OF = "CASE WHEN level < 0.3 THEN 1 WHEN level < 0.6 THEN 3 WHEN level < 0.8 THEN 7 WHEN level < 0.9 THEN 14 ELSE 30 END"


def greedy(candidates: str, keys: str, at: str, event_id: str, gap: int) -> str:
    """Recursive oracle of a throttle over the relation ``candidates``."""
    ks = [k.strip() for k in keys.split(",")]
    on = " AND ".join(f"c.{k} = p.{k}" for k in ks)
    return f"""cand AS (SELECT {keys}, {at}, min({event_id}) AS {event_id} FROM {candidates} GROUP BY {keys}, {at}),
  pick AS (SELECT {keys}, min({at}) AS {at} FROM cand GROUP BY {keys}
    UNION ALL
    SELECT {", ".join(f"p.{k}" for k in ks)},
      (SELECT min(c.{at}) FROM cand c WHERE {on} AND c.{at} >= p.{at} + {gap}) AS {at}
    FROM pick p WHERE p.{at} IS NOT NULL)
  SELECT c.* FROM cand c JOIN pick p ON {on} AND c.{at} = p.{at}"""


@query(
    "w01_answer_runs",
    oracle(["answers"], f""", {RUNNING}, {_RUNS} SELECT answer_id, learner_id, kp_id, score, consecutive_correct,
      consecutive_wrong FROM k"""),
)
def _(spark, sf):
    return P.answer_runs(answers(spark, sf)).select(
        "answer_id", "learner_id", "kp_id", "score", "consecutive_correct", "consecutive_wrong"
    )


@query(
    "w02_adaptive_action",
    oracle(["answers"], f""", {RUNNING}, {_RUNS} SELECT answer_id, learner_id, kp_id, coalesce(level_before, -1) AS level_before,
      consecutive_correct AS right_run, consecutive_wrong AS wrong_run,
      CASE WHEN consecutive_correct >= 3 AND level_before >= 0.7 THEN 'skip_if_mastered'
           WHEN consecutive_wrong >= 3 THEN 'full_explain' WHEN consecutive_wrong >= 2 THEN 'needs_review'
           WHEN level_before < 0.3 AND total - 1 >= 2 AND consecutive_wrong = 0 THEN 'more_hints'
           ELSE '' END AS action FROM k"""),
)
def _(spark, sf):
    return P.adaptive_action(answers(spark, sf)).na.fill(-1.0, ["level_before"])


@query(
    "w03_hint_level",
    oracle(["answers"], """, g AS (SELECT *, count(*) FILTER (score >= 1) OVER (PARTITION BY learner_id, question
        ORDER BY ts, answer_id ROWS UNBOUNDED PRECEDING) AS g FROM answers)
      SELECT answer_id, learner_id, question, score, least(3, count(*) FILTER (score < 0.5) OVER
        (PARTITION BY learner_id, question, g ORDER BY ts, answer_id ROWS UNBOUNDED PRECEDING)) AS hint_level FROM g"""),
)
def _(spark, sf):
    return P.hint_level(answers(spark, sf))


@query(
    "w04_streaks",
    oracle(["answers"], """, d AS (SELECT DISTINCT learner_id, day FROM answers),
      i AS (SELECT *, day - CAST(row_number() OVER (PARTITION BY learner_id ORDER BY day) AS INT) AS s FROM d),
      r AS (SELECT learner_id, s, count(*) AS n, max(day) AS last FROM i GROUP BY 1, 2)
      SELECT learner_id, arg_max(n, last) AS current, max(n) AS longest, CAST(max(last) AS VARCHAR) AS last_active FROM r GROUP BY 1"""),
)
def _(spark, sf):
    return P.streaks(answers(spark, sf)).withColumn("last_active", F.col("last_active").cast("string"))


_ACH = f"""{RUNNING},
  st AS (SELECT *, CAST(level >= 0.6 AND total >= 3 AS INT)
             - CAST(coalesce(level_before >= 0.6 AND total - 1 >= 3, FALSE) AS INT) AS dq,
             CAST(level >= 0.9 AS INT) - CAST(coalesce(level_before >= 0.9, FALSE) AS INT) AS dh FROM r),
  ev AS (SELECT *, count(*) OVER l AS n, sum(dq) OVER l AS nq, sum(dh) OVER l AS nh,
      count(*) OVER d AS dn, count(*) FILTER (score >= 1) OVER d AS dr FROM st
    WINDOW l AS (PARTITION BY learner_id ORDER BY ts, answer_id ROWS UNBOUNDED PRECEDING),
           d AS (PARTITION BY learner_id, day ORDER BY ts, answer_id ROWS UNBOUNDED PRECEDING)),
  ok AS (SELECT * FROM ev WHERE dn = 1 OR score >= 0.5),
  fd AS (SELECT learner_id, day, min(ts) AS ts FROM answers GROUP BY 1, 2),
  isl AS (SELECT *, day - CAST(row_number() OVER (PARTITION BY learner_id ORDER BY day) AS INT) AS s FROM fd),
  dd AS (SELECT *, row_number() OVER (PARTITION BY learner_id, s ORDER BY day) AS run,
      row_number() OVER (PARTITION BY learner_id, date_trunc('week', day) ORDER BY day) AS wd FROM isl),
  ach AS (
    SELECT learner_id, 'first_answer' AS achievement, min(ts) AS unlocked_at FROM ok GROUP BY 1
    UNION ALL SELECT learner_id, 'ten_answers', min(ts) FROM ok WHERE n >= 10 GROUP BY 1
    UNION ALL SELECT learner_id, 'fifty_answers', min(ts) FROM ok WHERE n >= 50 GROUP BY 1
    UNION ALL SELECT learner_id, 'weak_point_first', min(ts) FROM ok WHERE nq > 0 GROUP BY 1
    UNION ALL SELECT learner_id, 'mastery_90', min(ts) FROM ok WHERE nh > 0 GROUP BY 1
    UNION ALL SELECT learner_id, 'perfect_session', min(ts) FROM ok WHERE dn >= 3 AND dr = dn GROUP BY 1
    UNION ALL SELECT learner_id, 'streak_3', min(ts) FROM dd WHERE run >= 3 GROUP BY 1
    UNION ALL SELECT learner_id, 'streak_7', min(ts) FROM dd WHERE run >= 7 GROUP BY 1
    UNION ALL SELECT learner_id, 'five_days_week', min(ts) FROM dd WHERE wd >= 5 GROUP BY 1)"""


@query("w06_achievements", oracle(["answers"], f", {_ACH} SELECT * FROM ach"))
def _(spark, sf):
    return P.achievements(answers(spark, sf))


@query(
    "w05_points_and_level",
    oracle(["answers"], f""", {_ACH},
      e AS (SELECT learner_id, 5 * count(DISTINCT day) + 10 * count(*) FILTER (score >= 1)
              + 5 * count(*) FILTER (score >= 0.5 AND score < 1) AS earned FROM answers GROUP BY 1),
      bo AS (SELECT learner_id, count(*) AS achievement_count, sum(CASE achievement WHEN 'first_answer' THEN 10
          WHEN 'ten_answers' THEN 20 WHEN 'fifty_answers' THEN 50 WHEN 'streak_3' THEN 30 WHEN 'streak_7' THEN 50
          WHEN 'weak_point_first' THEN 40 WHEN 'perfect_session' THEN 30 WHEN 'mastery_90' THEN 50
          WHEN 'five_days_week' THEN 60 END) AS bonus FROM ach GROUP BY 1),
      p AS (SELECT e.learner_id, CAST(earned + coalesce(bonus, 0) AS BIGINT) AS points,
              coalesce(achievement_count, 0) AS achievement_count FROM e LEFT JOIN bo USING (learner_id)),
      v AS (SELECT *, least(100, CAST(floor(sqrt(points / 100)) AS BIGINT) + 1) AS level FROM p)
      SELECT learner_id, points, achievement_count, level, level * level * 100 - points AS xp_to_next FROM v"""),
)
def _(spark, sf):
    a = answers(spark, sf)
    return P.points_and_level(a, P.achievements(a))


_NEWEST = "row_number() OVER (PARTITION BY {keys} ORDER BY ts DESC, answer_id DESC)"
_BOOK = f"""bk AS (SELECT * FROM (SELECT answer_id, learner_id, kp_id, question, score, ts,
  {_NEWEST.format(keys="learner_id")} AS rn FROM answers WHERE score < 0.5) x WHERE rn <= 50)"""


def _show(df):
    return df.select("answer_id", "learner_id", "kp_id", "question", "score", "ts", F.col("rn").cast("long").alias("rn"))


@query("w07_wrong_book", oracle(["answers"], f", {_BOOK} SELECT * FROM bk"))
def _(spark, sf):
    return _show(P.wrong_book(answers(spark, sf)))


@query(
    "w07_answer_history",
    oracle(["answers"], f"""SELECT * FROM (SELECT answer_id, learner_id, kp_id, question, score, ts,
      {_NEWEST.format(keys="learner_id")} AS rn FROM answers) x WHERE rn <= 200"""),
)
def _(spark, sf):
    return _show(P.answer_history(answers(spark, sf)))


@query(
    "w08_recent_wrong",
    oracle(["answers"], f""", {_BOOK} SELECT * FROM (SELECT * EXCLUDE (rn), {_NEWEST.format(keys="learner_id, kp_id")} AS rn
      FROM bk) x WHERE rn <= 3"""),
)
def _(spark, sf):
    return _show(P.recent_of(P.wrong_book(answers(spark, sf)), 3, per_kp=True))


@query(
    "w08_recent_history",
    oracle(["answers"], f"""SELECT * FROM (SELECT answer_id, learner_id, kp_id, question, score, ts,
      {_NEWEST.format(keys="learner_id")} AS rn FROM answers) x WHERE rn <= 20"""),
)
def _(spark, sf):
    return _show(P.recent_of(P.answer_history(answers(spark, sf)), 20))


def before_watermark(delay_s: int) -> str:
    """What a stream of answers has judged when it is drained: the rows up to the last watermark."""
    return f"epoch_us(ts) // 1000 <= (SELECT epoch_us(max(ts)) // 1000 FROM answers) - {delay_s * 1000}"


def practice_oracle(judged: str = "TRUE") -> str:
    return oracle(["answers"], "RECURSIVE" + f""", ms AS (SELECT *, row_number() OVER (PARTITION BY learner_id ORDER BY ts, answer_id) AS no
    FROM answers WHERE score < 0.5),
  pv AS (SELECT *, lag(no) OVER (PARTITION BY learner_id, kp_id ORDER BY ts, answer_id) AS prev,
    CAST(floor(epoch(ts)) AS BIGINT) AS at_s FROM ms),
  rd AS (SELECT * FROM pv WHERE prev IS NOT NULL AND {judged}), """ + greedy("rd", "learner_id, kp_id", "at_s", "answer_id", 21600))


def exam_oracle(judged: str = "TRUE") -> str:
    return oracle(["answers"], "RECURSIVE" + f""", {RUNNING},
  ch AS (SELECT answer_id, learner_id, ts, split_part(kp_id, '/', 1) AS subject, CAST(level < 0.6 AS INT)
    - coalesce(CAST(level_before < 0.6 AS INT), 0) AS d FROM r),
  wk AS (SELECT *, sum(d) OVER (PARTITION BY learner_id, subject ORDER BY ts, answer_id ROWS UNBOUNDED PRECEDING) AS weak,
    CAST(floor(epoch(ts)) AS BIGINT) AS at_s FROM ch),
  rd AS (SELECT * FROM wk WHERE weak >= 3 AND {judged}), """ + greedy("rd", "learner_id", "at_s", "answer_id", 86400))


@query("w09_practice_trigger", practice_oracle())
def _(spark, sf):
    return P.practice_trigger(answers(spark, sf))


@query("w10_exam_trigger", exam_oracle())
def _(spark, sf):
    return P.exam_trigger(answers(spark, sf))


@query(
    "w11_review_schedule",
    oracle(["answers"], f""", {C_CTE}, ld AS (SELECT learner_id, kp_id, max(day) AS last_day FROM answers GROUP BY 1, 2)
      SELECT learner_id, kp_id, level, CAST(last_day + ({_DAYS_OF}) AS VARCHAR) AS due FROM m
      JOIN ld USING (learner_id, kp_id)"""),
)
def _(spark, sf):
    return M.review_schedule(answers(spark, sf)).withColumn("due", F.col("due").cast("string"))


@query(
    "w11_review_history",
    oracle(["answers"], f""", {RUNNING} SELECT answer_id, learner_id, kp_id, level, CAST(day + ({_DAYS_OF}) AS VARCHAR) AS scheduled FROM r"""),
)
def _(spark, sf):
    return P.review_history(answers(spark, sf)).withColumn("scheduled", F.col("scheduled").cast("string"))


@query(
    "t02_due_reviews",
    oracle(["answers"], f""", {C_CTE}, ld AS (SELECT learner_id, kp_id, max(day) AS last_day FROM answers GROUP BY 1, 2),
      s AS (SELECT learner_id, kp_id, level, last_day + ({_DAYS_OF}) AS due FROM m JOIN ld USING (learner_id, kp_id))
      SELECT * REPLACE (CAST(due AS VARCHAR) AS due) FROM s WHERE due <= DATE '{AS_OF}'"""),
)
def _(spark, sf):
    return M.due_reviews(M.review_schedule(answers(spark, sf)), AS_OF).withColumn("due", F.col("due").cast("string"))


@query(
    "w12_fatigue_flag",
    oracle(["answers"], """, p AS (SELECT *, epoch_us(ts) AS us, lag(epoch_us(ts)) OVER w AS pv FROM answers
        WINDOW w AS (PARTITION BY learner_id ORDER BY ts, answer_id)),
      s AS (SELECT *, sum(CASE WHEN pv IS NULL OR us - pv > 1800000000 THEN 1 ELSE 0 END) OVER
        (PARTITION BY learner_id ORDER BY ts, answer_id ROWS UNBOUNDED PRECEDING) AS sid FROM p),
      t AS (SELECT *, row_number() OVER (PARTITION BY learner_id, sid ORDER BY ts, answer_id) AS answered,
        min(us) OVER (PARTITION BY learner_id, sid) AS us0 FROM s)
      SELECT answer_id, learner_id, answered, CAST(floor((us - us0) / 60000000) AS BIGINT) AS minutes,
        ((us - us0) / 60000000 >= 25 OR answered >= 10) AS tired FROM t"""),
)
def _(spark, sf):
    return P.fatigue_flag(answers(spark, sf))


_REPORTS = """SELECT event_id AS report_id, user_id AS task_id, event_id AS at_s,
  CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS current_question,
  CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) * 3 % 41 AS correct_count,
  CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) * 7 % 23 AS wrong_count FROM events"""


@query(
    "w13_task_progress",
    f"""SELECT report_id, task_id, max(current_question) OVER w AS current_question,
      max(correct_count) OVER w AS correct_count, max(wrong_count) OVER w AS wrong_count FROM ({_REPORTS}) t
      WINDOW w AS (PARTITION BY task_id ORDER BY at_s, report_id ROWS UNBOUNDED PRECEDING)""",
)
def _(spark, sf):
    return P.task_progress(spark.sql(_REPORTS.replace("FROM events", "FROM {events}"), events=load(spark, sf, "events")))


@query(
    "c14_mastery_at",
    oracle(["answers"], f", {RUNNING} SELECT answer_id, learner_id, kp_id, coalesce(level_before, -1) AS level_before, total - 1 AS seen FROM r"),
)
def _(spark, sf):
    return P.running_levels(answers(spark, sf)).select(
        "answer_id", "learner_id", "kp_id", "level_before", (F.col("total") - 1).alias("seen")
    ).na.fill(-1.0, ["level_before"])


@query(
    "w15_week_over_week",
    oracle(["answers"], f""", w AS (SELECT learner_id, {COUNTS} FROM answers
        WHERE day BETWEEN DATE '{AS_OF}' - 7 AND DATE '{AS_OF}' GROUP BY 1),
      d AS (SELECT learner_id, {COUNTS} FROM answers WHERE day = DATE '{AS_OF}' - 7 GROUP BY 1)
      SELECT w.learner_id, w.total, {ratio2_oracle("w.correct", "w.total")} AS week_accuracy,
        coalesce({ratio2_oracle("d.correct", "d.total")}, 0) AS day_accuracy FROM w LEFT JOIN d USING (learner_id)"""),
)
def _(spark, sf):
    return P.week_over_week(answers(spark, sf), AS_OF)


@query(
    "w15_previous_week",
    oracle(["answers"], f""", w AS (SELECT learner_id, {COUNTS} FROM answers
        WHERE day BETWEEN DATE '{AS_OF}' - 7 AND DATE '{AS_OF}' GROUP BY 1),
      d AS (SELECT learner_id, {COUNTS} FROM answers WHERE day BETWEEN DATE '{AS_OF}' - 15 AND DATE '{AS_OF}' - 8 GROUP BY 1)
      SELECT w.learner_id, w.total, {ratio2_oracle("w.correct", "w.total")} AS week_accuracy,
        coalesce({ratio2_oracle("d.correct", "d.total")}, 0) AS day_accuracy FROM w LEFT JOIN d USING (learner_id)"""),
)
def _(spark, sf):
    return P.week_over_week(answers(spark, sf), AS_OF, whole_week=True)


@query(
    "g07_parent_report",
    oracle(["answers"], f""", p AS (SELECT * FROM answers WHERE day BETWEEN DATE '{AS_OF}' - 7 AND DATE '{AS_OF}'),
      t AS (SELECT learner_id, {COUNTS}, coalesce(string_agg(DISTINCT kp_id, ',' ORDER BY kp_id) FILTER (score <= 0), '')
              AS weak_points FROM p GROUP BY 1),
      w AS (SELECT *, {_NEWEST.format(keys="learner_id")} AS k FROM p WHERE score < 1),
      rw AS (SELECT learner_id, string_agg(question, ',' ORDER BY k) AS recent_wrong FROM w WHERE k <= 5 GROUP BY 1),
      mc AS (SELECT learner_id, count(DISTINCT kp_id) AS mastery_count FROM answers GROUP BY 1)
      SELECT t.learner_id, t.total AS total_questions, t.correct AS correct_count, t.wrong AS wrong_count,
        {ratio2_oracle("t.correct", "t.total")} AS accuracy, t.weak_points, coalesce(rw.recent_wrong, '') AS recent_wrong,
        mastery_count FROM t LEFT JOIN rw USING (learner_id) JOIN mc USING (learner_id)"""),
)
def _(spark, sf):
    return P.parent_report(answers(spark, sf), AS_OF, 7).withColumns(
        {"weak_points": F.array_join("weak_points", ","), "recent_wrong": F.array_join("recent_wrong", ",")}
    )
