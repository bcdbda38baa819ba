"""Usage and teaching metrics."""

from pyspark.sql import functions as F

from studylake.catalog import query
from studylake.catalog.mastery import answers
from studylake.functions.rounding import level_oracle, ratio2_oracle
from studylake.operators import cohort as C
from studylake.sources.tables import load, oracle


@query(
    "g17_daily_usage",
    oracle(["answers"], f""", d AS (SELECT day, count(DISTINCT learner_id) AS dau, count(*) AS answers FROM answers GROUP BY 1)
      SELECT CAST(day AS VARCHAR) AS day, dau, answers, {ratio2_oracle('answers', 'dau')} AS per_learner FROM d"""),
)
def _(spark, sf):
    return C.daily_usage(answers(spark, sf)).withColumn("day", F.col("day").cast("string"))


@query(
    "g17_active_day_share",
    oracle(["answers"], f""", d AS (SELECT learner_id, CAST(date_trunc('month', day) AS DATE) AS month, count(DISTINCT day) AS active_days
        FROM answers GROUP BY 1, 2), m AS (SELECT *, CAST(day(last_day(month)) AS BIGINT) AS month_days FROM d)
      SELECT learner_id, CAST(month AS VARCHAR) AS month, active_days, month_days, {ratio2_oracle('active_days', 'month_days')} AS share FROM m"""),
)
def _(spark, sf):
    return C.active_day_share(answers(spark, sf)).withColumn("month", F.col("month").cast("string"))


@query(
    "g18_retention",
    oracle(["answers"], f""", s AS (SELECT learner_id, min(day) AS c, max(day) AS l FROM answers GROUP BY 1),
      g AS (SELECT c, count(*) AS learners, count(*) FILTER (l - c >= 7) AS kept_7, count(*) FILTER (l - c >= 30) AS kept_30 FROM s GROUP BY 1)
      SELECT CAST(c AS VARCHAR) AS cohort, learners, kept_7, kept_30, {ratio2_oracle('kept_7', 'learners')} AS rate_7,
        {ratio2_oracle('kept_30', 'learners')} AS rate_30 FROM g"""),
)
def _(spark, sf):
    return C.retention(answers(spark, sf)).withColumn("cohort", F.col("cohort").cast("string"))


def _at(tag: str, date: str) -> str:
    u = f"day <= DATE '{date}'"
    return (
        f"count(*) FILTER ({u}) AS t_{tag}, count(*) FILTER ({u} AND score >= 1) AS c_{tag}, "
        f"count(*) FILTER ({u} AND score > 0 AND score < 1) AS p_{tag}"
    )


@query(
    "g19_weak_elimination",
    oracle(["answers"], f""", k AS (SELECT learner_id, kp_id, {_at('a', '2024-01-10')}, {_at('b', '2024-01-30')} FROM answers GROUP BY 1, 2),
      l AS (SELECT kp_id, {level_oracle('c_a', 'p_a', 't_a')} AS la, {level_oracle('c_b', 'p_b', 't_b')} AS lb FROM k WHERE t_a > 0),
      g AS (SELECT split_part(kp_id, '/', 1) AS subject, count(*) FILTER (la < 0.6) AS weak,
        count(*) FILTER (la < 0.6 AND lb >= 0.6) AS eliminated, CAST(sum(CAST(round((lb - la) * 100) AS BIGINT)) AS BIGINT) AS gain_points,
        count(*) AS points FROM l GROUP BY 1)
      SELECT *, {ratio2_oracle('eliminated', 'weak')} AS elimination_rate, gain_points / points / 100 AS mean_gain FROM g"""),
)
def _(spark, sf):
    return C.weak_elimination(answers(spark, sf), "2024-01-10", "2024-01-30")


@query(
    "g20_wrong_recurrence",
    oracle(["answers"], f""", k AS (SELECT learner_id, kp_id, count(*) AS n FROM answers WHERE score < 0.5 GROUP BY 1, 2),
      g AS (SELECT split_part(kp_id, '/', 1) AS subject, count(*) AS missed, count(*) FILTER (n > 1) AS again FROM k GROUP BY 1)
      SELECT *, {ratio2_oracle('again', 'missed')} AS rate FROM g"""),
)
def _(spark, sf):
    return C.wrong_recurrence(answers(spark, sf))


@query(
    "g21_coverage_growth",
    oracle(["answers"], """, k AS (SELECT learner_id, kp_id, min(day) AS d FROM answers GROUP BY 1, 2)
      SELECT learner_id, CAST(CAST(date_trunc('month', d) AS DATE) AS VARCHAR) AS month, count(*) AS new_kps FROM k GROUP BY 1, 2"""),
)
def _(spark, sf):
    return C.coverage_growth(answers(spark, sf)).withColumn("month", F.col("month").cast("string"))


@query(
    "g22_latency_slo",
    """SELECT operation, round(quantile_cont(s, 0.5), 6) AS p50, round(quantile_cont(s, 0.95), 6) AS p95, count(*) AS calls,
      CAST(60 AS DOUBLE) AS target_p95, quantile_cont(s, 0.95) <= 60 AS met
      FROM (SELECT event_type AS operation, value AS s FROM events) t GROUP BY 1""",
)
def _(spark, sf):
    calls = load(spark, sf, "events").select(F.col("event_type").alias("operation"), F.col("value").alias("seconds"))
    return C.latency_slo(calls, target=60.0).withColumns({"p50": F.round("p50", 6), "p95": F.round("p95", 6)})


# Sketches of each day, merged by month; an estimate within 5 % (three standard deviations) of the exact number is close.
@query(
    "g17_active_learners_sketch",
    oracle(["answers"], """SELECT CAST(CAST(date_trunc('month', day) AS DATE) AS VARCHAR) AS period, count(DISTINCT learner_id) AS exact, count(*) AS answers, TRUE AS close
      FROM answers GROUP BY 1"""),
)
def _(spark, sf):
    a, month = answers(spark, sf), F.date_trunc("month", "day").cast("date")
    about = C.active_learners(C.usage_sketches(a), month)
    exact = a.groupBy(month.alias("period")).agg(F.countDistinct("learner_id").alias("exact"))
    close = F.abs(F.col("learners") - F.col("exact")) <= F.greatest(F.lit(1.0), F.col("exact") * 0.05)
    return about.join(exact, "period").select(F.col("period").cast("string").alias("period"), "exact", "answers", close.alias("close"))


# Sketches of each day, merged over all; a percentile whose rank is within 4 % of its own (three standard deviations) is close.
@query(
    "g22_latency_sketch",
    """SELECT event_type AS operation, count(*) AS calls, TRUE AS p50_close, TRUE AS p95_close FROM events WHERE value IS NOT NULL GROUP BY 1""",
)
def _(spark, sf):
    calls = load(spark, sf, "events").select(F.col("event_type").alias("operation"), F.col("ts").cast("date").alias("day"), F.col("value").alias("seconds"))
    about = C.latency_from_sketches(C.latency_sketches(calls), target=60.0)
    # The rank of an estimate lies between the shares of calls below it and up to it.
    share = lambda q, p: [F.avg((F.col("seconds") < F.col(q)).cast("double")) <= p + 0.04, F.avg((F.col("seconds") <= F.col(q)).cast("double")) >= p - 0.04]
    joined = calls.join(about, "operation")
    low50, high50, low95, high95 = *share("p50", 0.5), *share("p95", 0.95)
    return joined.groupBy("operation").agg(F.first("calls").alias("calls"), (low50 & high50).alias("p50_close"), (low95 & high95).alias("p95_close"))
