"""Mastery levels and the tables that follow from the answer log by plain aggregation."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from studylake.functions.rounding import level, ratio2

WEAK_BELOW = 0.6


def right() -> Column:
    return F.col("score") >= 1


def half() -> Column:
    return (F.col("score") > 0) & (F.col("score") < 1)


def wrong() -> Column:
    return F.col("score") <= 0


def clamp_score(answers: DataFrame) -> DataFrame:
    return answers.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score"))))


def _counts() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("total"),
        F.count_if(right()).alias("correct"),
        F.count_if(half()).alias("partial"),
        F.count_if(wrong()).alias("wrong"),
    ]


def mastery(answers: DataFrame, *more: Column) -> DataFrame:
    """Per (learner, knowledge point): ternary counts, ``more`` aggregates and the level.  Partial sums map-side."""
    return answers.groupBy("learner_id", "kp_id").agg(*_counts(), *more).withColumn("level", level())


def mastery_summary(levels: DataFrame) -> DataFrame:
    return levels.select(
        "learner_id", "kp_id", "level", "total", "correct", ratio2("correct", "total").alias("accuracy")
    )


def weak_points(levels: DataFrame, threshold: float = WEAK_BELOW) -> DataFrame:
    """Levels below the threshold, weakest first within each learner."""
    return (
        levels.filter((F.col("level") < threshold) & (F.col("total") > 0))
        .select("learner_id", "kp_id", "level", "total")
        .sort("learner_id", "level", "kp_id")
    )


def learner_summary(levels: DataFrame) -> DataFrame:
    """Totals, accuracy, mastered and touched knowledge points per learner."""
    return (
        levels.groupBy("learner_id")
        .agg(
            F.sum("total").alias("total_questions"),
            F.sum("correct").alias("_correct"),
            F.count_if(F.col("level") >= WEAK_BELOW).alias("mastered"),
            F.count(F.lit(1)).alias("total_kp"),
        )
        .withColumn("accuracy", ratio2("_correct", "total_questions"))
        .drop("_correct")
    )


def daily_stats(answers: DataFrame) -> DataFrame:
    """Per (learner, day): counts and the sorted set of points answered fully wrong."""
    return answers.groupBy("learner_id", "day").agg(
        *_counts(), F.array_sort(F.collect_set(F.when(wrong(), F.col("kp_id")))).alias("weak_points")
    )


def in_period(df: DataFrame, as_of: str, days: int) -> DataFrame:
    """``days`` back from ``as_of``, both ends included.

    The range is put on ``ts`` as well, in its own type: a condition on the derived day does not
    reach the scan, one on the stored column does.
    """
    end = date.fromisoformat(as_of)
    start, stop = end - timedelta(days=days), end + timedelta(days=1)
    df = df.filter(F.col("day").between(F.lit(start), F.lit(end)))
    if "ts" in df.columns:
        kind = df.schema["ts"].dataType
        low, high = (F.lit(d.isoformat()).cast(kind) for d in (start, stop))
        df = df.filter((F.col("ts") >= low) & (F.col("ts") < high))
    return df


def period_stats(answers: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    return (
        in_period(answers, as_of, days)
        .groupBy("learner_id")
        .agg(*_counts())
        .withColumn("accuracy", ratio2("correct", "total"))
    )


def weak_union(answers: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """Sorted set of points answered fully wrong in the period.

    Distinct pairs come first, so a hot learner ships each point once.
    """
    return (
        in_period(answers, as_of, days)
        .filter(wrong())
        .select("learner_id", "kp_id")
        .distinct()
        .groupBy("learner_id")
        .agg(F.array_sort(F.collect_list("kp_id")).alias("weak_points"))
    )


def daily_report(answers: DataFrame, levels: DataFrame, day: str) -> DataFrame:
    """The day's weak points with their current level, beside the day's totals."""
    today = in_period(answers, day, 0)
    totals = (
        today.groupBy("learner_id")
        .agg(*_counts())
        .select(
            "learner_id",
            F.col("total").alias("total_questions"),
            "correct",
            "wrong",
            ratio2("correct", "total").alias("accuracy"),
        )
    )
    weak = today.filter(wrong()).select("learner_id", "kp_id").distinct()
    weak = weak.join(levels.select("learner_id", "kp_id", "level", F.col("total").alias("kp_total")), ["learner_id", "kp_id"])
    return totals.join(weak, "learner_id", "left")


def rank_learners(totals: DataFrame) -> DataFrame:
    """Real learners by answers, most first.  ``totals`` is (learner_id, total)."""
    return (
        totals.groupBy("learner_id")
        .agg(F.max("total").alias("total_questions"))
        .filter("total_questions > 0")
        .sort(F.desc("total_questions"), "learner_id")
    )


def is_real_learner(learner: Column) -> Column:
    """Not a session file, a hidden entry or a test account."""
    name = F.trim(learner)
    return (name != "") & ~name.rlike("(^(_|e2e-|test))|(_session$)")


def dominant_weak_subject(weak: DataFrame, at_least: int = 3) -> DataFrame:
    """The subject most weak points belong to, for learners with enough of them; ties by name."""
    per = weak.groupBy("learner_id", F.split("kp_id", "/")[0].alias("subject")).agg(F.count(F.lit(1)).alias("n"))
    return (
        per.groupBy("learner_id")
        .agg(
            F.sum("n").alias("weak_total"),
            F.min_by(F.struct("subject", "n"), F.struct((-F.col("n")).alias("k"), "subject")).alias("top"),
        )
        .filter(F.col("weak_total") >= at_least)
        .select("learner_id", F.col("top.subject").alias("subject"), F.col("top.n").alias("n"), "weak_total")
    )


def exam_blueprint(weak: DataFrame, questions: int = 10) -> DataFrame:
    """Questions per weak point and the type and difficulty mix of a drill paper.

    The shares are split by largest remainder, ties to the earlier part.
    """
    n = weak.groupBy("learner_id").agg(F.count(F.lit(1)).alias("weak_count")).withColumn("questions", F.lit(questions))
    n = n.withColumn("per_kp", F.expr("greatest(2L, questions div greatest(weak_count, 1L))"))
    parts = [*(("choice", 40), ("fill_blank", 30), ("solution", 30)), *(("basic", 50), ("medium", 35), ("hard", 15))]
    for group in (parts[:3], parts[3:]):
        spare = questions - sum(questions * share // 100 for _, share in group)
        order = sorted(range(len(group)), key=lambda i: (-(questions * group[i][1] % 100), i))
        for i, (name, share) in enumerate(group):
            extra = 1 if order.index(i) < spare else 0
            n = n.withColumn(f"n_{name}", F.lit(questions * share // 100 + extra).cast("long"))
    return n.withColumn("questions", F.col("questions").cast("long"))


def mastery_rollup(answers: DataFrame) -> DataFrame:
    """Levels by subject, grade and chapter with all subtotals."""
    parts = F.split("kp_id", "/")
    return (
        answers.select("score", parts[0].alias("subject"), parts[1].alias("grade"), parts[2].alias("chapter"))
        .rollup("subject", "grade", "chapter")
        .agg(*_counts())
        .withColumn("level", level())
    )


def review_interval(lvl: Column) -> Column:
    """Days to the next review: the lower the level, the sooner."""
    return F.when(lvl < 0.3, 1).when(lvl < 0.6, 3).when(lvl < 0.8, 7).when(lvl < 0.9, 14).otherwise(30)


def mastery_band(lvl: Column) -> Column:
    return (
        F.when(lvl >= 0.9, "consolidated").when(lvl >= 0.8, "mastered").when(lvl >= 0.6, "progressing")
        .when(lvl >= 0.4, "learning").otherwise("weak")
    )


def mastery_guidance(lvl: Column, total: Column) -> Column:
    """Teaching advice code for a level and the number of answers behind it."""
    return (
        F.when((lvl < 0.3) & (total >= 2), "explain_basics")
        .when(lvl < 0.5, "more_practice")
        .when((lvl >= 0.8) & (total >= 3), "fewer_hints")
        .otherwise("")
    )


def mastery_with_last_day(answers: DataFrame) -> DataFrame:
    """Mastery with the day of the last answer."""
    per = answers.groupBy("learner_id", "kp_id").agg(*_counts(), F.max("day").alias("last_day"))
    return per.withColumn("level", level())


def review_schedule(answers: DataFrame) -> DataFrame:
    """Current due date per (learner, point).

    The last answer wins and is scheduled with the level after it, which is the final level, so
    one aggregation gives the schedule without ordering any rows.
    """
    per = mastery_with_last_day(answers)
    return per.withColumn("_days", review_interval(F.col("level"))).select(
        "learner_id", "kp_id", "level", F.expr("date_add(last_day, _days)").alias("due")
    )


def due_reviews(schedule: DataFrame, as_of: str) -> DataFrame:
    return schedule.filter(F.col("due") <= F.lit(as_of).cast("date")).sort("learner_id", "due", "kp_id")
