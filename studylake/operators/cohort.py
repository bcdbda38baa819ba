"""Usage and teaching metrics over all learners, each one aggregation over the answer log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from studylake.functions.rounding import level, ratio2
from studylake.operators import mastery as M


def daily_usage(answers: DataFrame) -> DataFrame:
    """Active learners, answers, and answers per active learner of each day.

    (learner, day) is aggregated first, so a busy learner is one row before the distinct count.
    """
    per = answers.groupBy("day", "learner_id").agg(F.count(F.lit(1)).alias("n"))
    return (
        per.groupBy("day")
        .agg(F.count(F.lit(1)).alias("dau"), F.sum("n").alias("answers"))
        .withColumn("per_learner", ratio2("answers", "dau"))
    )


def active_day_share(answers: DataFrame) -> DataFrame:
    """Active days of each learner-month over the days of the month."""
    days = answers.select("learner_id", "day").distinct()
    month = F.date_trunc("month", "day").cast("date")
    return (
        days.groupBy("learner_id", month.alias("month"))
        .agg(F.count(F.lit(1)).alias("active_days"))
        .withColumn("month_days", F.dayofmonth(F.last_day("month")).cast("long"))
        .withColumn("share", ratio2("active_days", "month_days"))
    )


def retention(answers: DataFrame, marks: tuple[int, ...] = (7, 30)) -> DataFrame:
    """Per starting day: learners, and how many were still active ``n`` or more days later."""
    spans = answers.groupBy("learner_id").agg(F.min("day").alias("cohort"), F.max("day").alias("last"))
    stayed = [F.count_if(F.datediff("last", "cohort") >= n).alias(f"kept_{n}") for n in marks]
    out = spans.groupBy("cohort").agg(F.count(F.lit(1)).alias("learners"), *stayed)
    for n in marks:
        out = out.withColumn(f"rate_{n}", ratio2(f"kept_{n}", "learners"))
    return out


def _levels_at(answers: DataFrame, dates: dict[str, str]) -> DataFrame:
    """Levels at several dates from one pass: conditional counts instead of a join."""
    aggs = []
    for tag, date in dates.items():
        until = F.col("day") <= F.lit(date).cast("date")
        aggs += [
            F.count_if(until).alias(f"t_{tag}"),
            F.count_if(until & M.right()).alias(f"c_{tag}"),
            F.count_if(until & M.half()).alias(f"p_{tag}"),
        ]
    out = answers.groupBy("learner_id", "kp_id").agg(*aggs)
    for tag in dates:
        out = out.withColumn(f"level_{tag}", level(f"c_{tag}", f"p_{tag}", f"t_{tag}"))
    return out


def weak_elimination(answers: DataFrame, start: str, end: str) -> DataFrame:
    """Per subject: points weak at ``start``, how many no longer are at ``end``, and the mean
    level change (in hundredths) of all points known at ``start``."""
    both = _levels_at(answers, {"a": start, "b": end}).filter("t_a > 0")
    weak = F.col("level_a") < M.WEAK_BELOW
    gain = F.round((F.col("level_b") - F.col("level_a")) * 100).cast("long")
    return (
        both.groupBy(F.split("kp_id", "/")[0].alias("subject"))
        .agg(
            F.count_if(weak).alias("weak"),
            F.count_if(weak & (F.col("level_b") >= M.WEAK_BELOW)).alias("eliminated"),
            F.sum(gain).alias("gain_points"),
            F.count(F.lit(1)).alias("points"),
        )
        .withColumn("elimination_rate", ratio2("eliminated", "weak"))
        .withColumn("mean_gain", F.col("gain_points") / F.col("points") / 100)
    )


def wrong_recurrence(answers: DataFrame) -> DataFrame:
    """Per subject: points ever missed and points missed again."""
    missed = answers.groupBy("learner_id", "kp_id").agg(F.count_if(F.col("score") < 0.5).alias("n"))
    return (
        missed.filter("n > 0")
        .groupBy(F.split("kp_id", "/")[0].alias("subject"))
        .agg(F.count(F.lit(1)).alias("missed"), F.count_if(F.col("n") > 1).alias("again"))
        .withColumn("rate", ratio2("again", "missed"))
    )


def coverage_growth(answers: DataFrame) -> DataFrame:
    """Points each learner met for the first time in each month."""
    first = answers.groupBy("learner_id", "kp_id").agg(F.min("day").alias("day"))
    return first.groupBy("learner_id", F.date_trunc("month", "day").cast("date").alias("month")).agg(
        F.count(F.lit(1)).alias("new_kps")
    )


# Target seconds of an operation at the 95th percentile.
SLO_P95 = {"ocr": 10.0, "first_reply": 15.0, "judge": 8.0, "practice": 30.0, "chat": 60.0}


def latency_slo(calls: DataFrame, target: float | None = None, digits: int | None = None) -> DataFrame:
    """P50 and P95 per operation against the target.

    ``calls`` is (operation, seconds).  Latencies are counted per distinct value (map-side) and the
    percentiles are exact.  ``digits`` rounds the latencies first, which bounds the distinct values.
    """
    seconds = F.col("seconds") if digits is None else F.round("seconds", digits)
    targets = F.create_map(*[F.lit(x) for kv in SLO_P95.items() for x in kv])
    goal = F.lit(target) if target is not None else F.try_element_at(targets, F.col("operation"))
    histogram = calls.groupBy("operation", seconds.alias("s")).agg(F.count(F.lit(1)).alias("n"))
    quantiles = histogram.groupBy("operation").agg(
        F.percentile("s", 0.5, F.col("n")).alias("p50"), F.percentile("s", 0.95, F.col("n")).alias("p95"),
        F.sum("n").alias("calls"),
    )
    return quantiles.withColumn("target_p95", goal).withColumn("met", F.col("p95") <= F.col("target_p95"))


# Bits of a HyperLogLog sketch's size: an estimate is off by 1.6 % (one standard deviation); and the k of a KLL sketch: by about 1.3 % of the rank.
HLL_BITS = 12
KLL_K = 200


def usage_sketches(answers: DataFrame) -> DataFrame:
    """One mergeable sketch of the active learners of each day, to be stored: a few kB however many learners."""
    return answers.groupBy("day").agg(F.hll_sketch_agg("learner_id", HLL_BITS).alias("learners"), F.count(F.lit(1)).alias("answers"))


def active_learners(sketches: DataFrame, period: Column) -> DataFrame:
    """About how many learners were active in each ``period`` of the days, from the stored sketches alone."""
    merged = sketches.groupBy(period.alias("period")).agg(F.hll_union_agg("learners").alias("learners"), F.sum("answers").alias("answers"))
    return merged.select("period", F.hll_sketch_estimate("learners").alias("learners"), "answers")


def latency_sketches(calls: DataFrame) -> DataFrame:
    """One mergeable sketch of the latencies (operation, day, seconds) of each operation and day, to be stored."""
    return calls.groupBy("operation", "day").agg(F.kll_sketch_agg_double(F.col("seconds").cast("double"), KLL_K).alias("latency"))


def latency_from_sketches(sketches: DataFrame, target: float | None = None) -> DataFrame:
    """P50 and P95 per operation over all stored days, each about 1.3 % of the calls off its rank, against the target."""
    targets = F.create_map(*[F.lit(x) for kv in SLO_P95.items() for x in kv])
    goal = F.lit(target) if target is not None else F.try_element_at(targets, F.col("operation"))
    merged = sketches.groupBy("operation").agg(F.kll_merge_agg_double("latency").alias("s"))
    rows = merged.select(
        "operation", F.kll_sketch_get_quantile_double("s", F.lit(0.5)).alias("p50"), F.kll_sketch_get_quantile_double("s", F.lit(0.95)).alias("p95"),
        F.kll_sketch_get_n_double("s").alias("calls"),
    )
    return rows.withColumn("target_p95", goal).withColumn("met", F.col("p95") <= F.col("target_p95"))
