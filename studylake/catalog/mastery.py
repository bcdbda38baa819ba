"""Aggregations over the answer log."""

from studylake.catalog import query
from studylake.functions.rounding import level_oracle, ratio2_oracle
from studylake.operators import mastery as M
from studylake.sources.tables import AS_OF, oracle, view
from pyspark.sql import functions as F

COUNTS = """count(*) AS total, count(*) FILTER (score >= 1) AS correct,
  count(*) FILTER (score > 0 AND score < 1) AS partial, count(*) FILTER (score <= 0) AS wrong"""

C_CTE = f"""c AS (SELECT learner_id, kp_id, {COUNTS} FROM answers GROUP BY 1, 2),
  m AS (SELECT *, {level_oracle()} AS level FROM c)"""

_PERIOD = f"day BETWEEN DATE '{AS_OF}' - {{days}} AND DATE '{AS_OF}'"


def answers(spark, sf):
    return view(spark, sf, "answers")


def levels(spark, sf):
    return M.mastery(answers(spark, sf))


@query("g01_mastery", oracle(["answers"], f", {C_CTE} SELECT * FROM m"))
def _(spark, sf):
    return levels(spark, sf)


@query(
    "g02_learner_summary",
    oracle(["answers"], f""", {C_CTE}
    SELECT learner_id, CAST(sum(total) AS BIGINT) AS total_questions,
      {ratio2_oracle("CAST(sum(correct) AS BIGINT)", "CAST(sum(total) AS BIGINT)")} AS accuracy,
      count(*) FILTER (level >= 0.6) AS mastered, count(*) AS total_kp FROM m GROUP BY 1"""),
)
def _(spark, sf):
    return M.learner_summary(levels(spark, sf))


@query(
    "g03_mastery_summary",
    oracle(["answers"], f""", {C_CTE} SELECT learner_id, kp_id, level, total, correct,
      {ratio2_oracle("correct", "total")} AS accuracy FROM m"""),
)
def _(spark, sf):
    return M.mastery_summary(levels(spark, sf))


@query(
    "g04_daily_stats",
    oracle(["answers"], f""" SELECT learner_id, CAST(day AS VARCHAR) AS day, {COUNTS},
      coalesce(string_agg(DISTINCT kp_id, ',' ORDER BY kp_id) FILTER (score <= 0), '') AS weak_points
      FROM answers GROUP BY 1, 2"""),
)
def _(spark, sf):
    return M.daily_stats(answers(spark, sf)).withColumns(
        {"weak_points": F.array_join("weak_points", ","), "day": F.col("day").cast("string")}
    )


@query(
    "g05_period_stats",
    oracle(["answers"], f""", c AS (SELECT learner_id, {COUNTS} FROM answers
      WHERE {_PERIOD.format(days=7)} GROUP BY 1)
      SELECT *, {ratio2_oracle("correct", "total")} AS accuracy FROM c"""),
)
def _(spark, sf):
    return M.period_stats(answers(spark, sf), AS_OF, 7)


@query(
    "g06_daily_report",
    oracle(["answers"], f""", {C_CTE},
      t AS (SELECT learner_id, count(*) AS total_questions, count(*) FILTER (score >= 1) AS correct,
              count(*) FILTER (score <= 0) AS wrong FROM answers WHERE day = DATE '{AS_OF}' GROUP BY 1),
      w AS (SELECT DISTINCT learner_id, kp_id FROM answers WHERE day = DATE '{AS_OF}' AND score <= 0)
      SELECT t.learner_id, total_questions, t.correct, t.wrong,
        {ratio2_oracle("t.correct", "total_questions")} AS accuracy, coalesce(w.kp_id, '') AS kp_id,
        coalesce(m.level, 0) AS level, coalesce(m.total, 0) AS kp_total
      FROM t LEFT JOIN w ON w.learner_id = t.learner_id
      LEFT JOIN m ON m.learner_id = w.learner_id AND m.kp_id = w.kp_id"""),
)
def _(spark, sf):
    a = answers(spark, sf)
    return M.daily_report(a, M.mastery(a), AS_OF).na.fill({"kp_id": "", "level": 0.0, "kp_total": 0})


@query(
    "g08_rank_learners",
    oracle([], """SELECT user_id AS learner_id, max(n) AS total_questions FROM
      (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2) d
      GROUP BY 1 HAVING max(n) > 0"""),
)
def _(spark, sf):
    per_record = answers(spark, sf).groupBy("learner_id", "day").agg(F.count(F.lit(1)).alias("total"))
    return M.rank_learners(per_record)


@query(
    "g09_dominant_weak_subject",
    oracle(["answers"], f""", {C_CTE},
      s AS (SELECT learner_id, split_part(kp_id, '/', 1) AS subject, count(*) AS n FROM m
            WHERE level < 0.6 GROUP BY 1, 2),
      r AS (SELECT *, CAST(sum(n) OVER (PARTITION BY learner_id) AS BIGINT) AS weak_total,
              row_number() OVER (PARTITION BY learner_id ORDER BY n DESC, subject) AS rn FROM s)
      SELECT learner_id, subject, n, weak_total FROM r WHERE rn = 1 AND weak_total >= 3"""),
)
def _(spark, sf):
    return M.dominant_weak_subject(M.weak_points(levels(spark, sf)))


@query(
    "g10_exam_blueprint",
    oracle(["answers"], f""", {C_CTE}
      SELECT learner_id, count(*) AS weak_count, CAST(10 AS BIGINT) AS questions,
        greatest(CAST(2 AS BIGINT), 10 // greatest(count(*), 1)) AS per_kp,
        CAST(4 AS BIGINT) AS n_choice, CAST(3 AS BIGINT) AS n_fill_blank, CAST(3 AS BIGINT) AS n_solution,
        CAST(5 AS BIGINT) AS n_basic, CAST(4 AS BIGINT) AS n_medium, CAST(1 AS BIGINT) AS n_hard
      FROM m WHERE level < 0.6 GROUP BY 1"""),
)
def _(spark, sf):
    return M.exam_blueprint(M.weak_points(levels(spark, sf)))


@query(
    "g01_mastery_rollup",
    oracle(["answers"], f""", p AS (SELECT split_part(kp_id, '/', 1) AS subject, split_part(kp_id, '/', 2) AS grade,
        split_part(kp_id, '/', 3) AS chapter, score FROM answers),
      c AS (SELECT subject, grade, chapter, {COUNTS} FROM p GROUP BY ROLLUP (subject, grade, chapter))
      SELECT *, {level_oracle()} AS level FROM c"""),
)
def _(spark, sf):
    return M.mastery_rollup(answers(spark, sf))


@query("t01_weak_points", oracle(["answers"], f", {C_CTE} SELECT learner_id, kp_id, level, total FROM m WHERE level < 0.6"))
def _(spark, sf):
    return M.weak_points(levels(spark, sf))


@query(
    "h15_review_bands",
    oracle(["answers"], f""", {C_CTE} SELECT learner_id, kp_id, level,
      CASE WHEN level < 0.3 THEN 1 WHEN level < 0.6 THEN 3 WHEN level < 0.8 THEN 7 WHEN level < 0.9 THEN 14 ELSE 30 END AS days,
      CASE WHEN level >= 0.9 THEN 'consolidated' WHEN level >= 0.8 THEN 'mastered' WHEN level >= 0.6 THEN 'progressing'
           WHEN level >= 0.4 THEN 'learning' ELSE 'weak' END AS band,
      CASE WHEN level < 0.3 AND total >= 2 THEN 'explain_basics' WHEN level < 0.5 THEN 'more_practice'
           WHEN level >= 0.8 AND total >= 3 THEN 'fewer_hints' ELSE '' END AS guidance FROM m"""),
)
def _(spark, sf):
    lvl = F.col("level")
    return levels(spark, sf).select(
        "learner_id", "kp_id", "level", M.review_interval(lvl).alias("days"), M.mastery_band(lvl).alias("band"),
        M.mastery_guidance(lvl, F.col("total")).alias("guidance"),
    )


@query(
    "u04_weak_union",
    oracle(["answers"], f"""SELECT learner_id, string_agg(DISTINCT kp_id, ',' ORDER BY kp_id) AS weak_points
      FROM answers WHERE score <= 0 AND {_PERIOD.format(days=7)} GROUP BY 1"""),
)
def _(spark, sf):
    return M.weak_union(answers(spark, sf), AS_OF, 7).withColumn("weak_points", F.array_join("weak_points", ","))
