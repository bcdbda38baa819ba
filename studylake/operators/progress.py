"""Order-dependent analytics over the answer log: runs, hints, streaks, points, triggers.

Every running value goes through ``by_heat`` so a learner with a large share of the answers is
processed in time slices.  ``answer_id`` breaks ties of ``ts``.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from studylake.functions.rounding import level, ratio2
from studylake.operators import mastery as M
from studylake.operators.scan import Scan, by_heat, clock_slice, time_slice
from studylake.operators.throttle import throttle

ORDER = ["ts", "answer_id"]
LEARNER = ["learner_id"]
LEARNER_KP = ["learner_id", "kp_id"]


def _one() -> Column:
    return F.lit(1)


def _missed() -> Column:
    return F.col("score") < 0.5


def _by_learner(answers: DataFrame, body, hot_rows: int | None) -> DataFrame:
    return by_heat(answers, LEARNER, ORDER, time_slice("ts"), body, hot_rows)


def _level_before() -> Column:
    """Level of the point before the current answer, from the running counts after it."""
    return F.when(
        F.col("total") > 1,
        level(
            "(correct - CAST(score >= 1 AS BIGINT))",
            "(partial - CAST(score > 0 AND score < 1 AS BIGINT))",
            "(total - 1)",
        ),
    )


def _with_levels(df: DataFrame, scan: Scan) -> DataFrame:
    counts = {
        "total": ("count", _one()),
        "correct": ("sum", M.right().cast("long")),
        "partial": ("sum", M.half().cast("long")),
    }
    return scan(df, LEARNER_KP, counts).withColumns({"level": level(), "level_before": _level_before()})


def running_levels(answers: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """Each answer with the counts and level of its point after it, and the level before it.

    ``level_before`` is null on the first answer.  It equals an as-of lookup of the mastery table
    just before the event, without a join.
    """
    return _by_learner(answers, _with_levels, hot_rows)


def _with_runs(df: DataFrame, scan: Scan, number: str) -> DataFrame:
    """Runs from the row number and the number of the last row of the other kind."""
    n = F.col(number)
    df = scan(
        df, LEARNER_KP, {"_bad": ("max", F.when(~M.right(), n)), "_good": ("max", F.when(M.right(), n))}
    )
    return df.withColumns(
        {
            "consecutive_correct": n - F.coalesce("_bad", F.lit(0)),
            "consecutive_wrong": n - F.coalesce("_good", F.lit(0)),
        }
    ).drop("_bad", "_good")


def answer_runs(answers: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """Length of the current run of right and of not-right answers per point, at each answer."""

    def body(df: DataFrame, scan: Scan) -> DataFrame:
        return _with_runs(scan(df, LEARNER_KP, {"_n": ("count", _one())}), scan, "_n").drop("_n")

    return _by_learner(answers, body, hot_rows)


def adaptive_action(answers: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """Teaching decision after each answer from its run and the level known before it.

    The hint of a run is its length (at most 3), so "no hint yet" means the answer was right.
    """
    rows = _by_learner(answers, lambda df, scan: _with_runs(_with_levels(df, scan), scan, "total"), hot_rows)
    right, wrong = F.col("consecutive_correct"), F.col("consecutive_wrong")
    action = (
        F.when((right >= 3) & (F.col("level_before") >= 0.7), "skip_if_mastered")
        .when(wrong >= 3, "full_explain")
        .when(wrong >= 2, "needs_review")
        .when((F.col("level_before") < 0.3) & (F.col("total") > 2) & (wrong == 0), "more_hints")
        .otherwise("")
    )
    return rows.select(
        "answer_id", "learner_id", "kp_id", "level_before", right.alias("right_run"), wrong.alias("wrong_run"),
        action.alias("action"),
    )


def hint_level(answers: DataFrame, cap: int = 3, hot_rows: int | None = None) -> DataFrame:
    """Hint ladder per (learner, question): up on a miss, back to 0 on a right answer."""
    keys = ["learner_id", "question"]

    def body(df: DataFrame, scan: Scan) -> DataFrame:
        df = scan(df, keys, {"_misses": ("sum", _missed().cast("long"))})
        return scan(df, keys, {"_at_reset": ("max", F.when(M.right(), F.col("_misses")))})

    rows = _by_learner(answers, body, hot_rows)
    climbed = F.col("_misses") - F.coalesce("_at_reset", F.lit(0))
    return rows.select(
        "answer_id", "learner_id", "question", "score", F.least(F.lit(cap).cast("long"), climbed).alias("hint_level")
    )


def active_days(answers: DataFrame) -> DataFrame:
    return answers.select("learner_id", "day").distinct()


def day_runs(days: DataFrame) -> DataFrame:
    """Each active day with its position in the run of consecutive days it belongs to."""
    number = F.row_number().over(Window.partitionBy("learner_id").orderBy("day"))
    days = days.withColumn("_no", number).withColumn("_start", F.expr("date_sub(day, _no)")).drop("_no")
    run = Window.partitionBy("learner_id", "_start").orderBy("day")
    return days.withColumn("run", F.row_number().over(run).cast("long")).drop("_start")


def streaks(answers: DataFrame) -> DataFrame:
    """Current (as of the last active day) and longest run of active days per learner."""
    return (
        day_runs(active_days(answers))
        .groupBy("learner_id")
        .agg(
            F.max_by("run", "day").alias("current"),
            F.max("run").alias("longest"),
            F.max("day").alias("last_active"),
        )
    )


# Achievement ids and the points each gives.
ACHIEVEMENT_POINTS = {
    "first_answer": 10,
    "ten_answers": 20,
    "fifty_answers": 50,
    "streak_3": 30,
    "streak_7": 50,
    "weak_point_first": 40,
    "perfect_session": 30,
    "mastery_90": 50,
    "five_days_week": 60,
}


def achievements(answers: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """First unlock of each achievement per learner.

    Rules are looked at only on a learner's first answer of a day and on answers scoring at
    least one half, after the answer has been counted.  Day-based rules (streaks, days in the
    week) can only turn true on the first answer of a day, so they are found on the far smaller
    (learner, day) table.
    """
    prev_total = F.col("total") - 1

    def became(now: Column, before: Column) -> Column:
        return now.cast("long") - F.coalesce(before, F.lit(False)).cast("long")

    conquered = became(
        (F.col("level") >= 0.6) & (F.col("total") >= 3), (F.col("level_before") >= 0.6) & (prev_total >= 3)
    )
    high = became(F.col("level") >= 0.9, F.col("level_before") >= 0.9)

    def body(df: DataFrame, scan: Scan) -> DataFrame:
        df = _with_levels(df, scan).select(
            "answer_id", "learner_id", "ts", "day", "score", conquered.alias("_conq"), high.alias("_high")
        )
        df = scan(
            df, LEARNER, {"n": ("count", _one()), "conquered": ("sum", F.col("_conq")), "high": ("sum", F.col("_high"))}
        )
        return scan(
            df, ["learner_id", "day"], {"day_n": ("count", _one()), "day_right": ("sum", M.right().cast("long"))}
        )

    steps = _by_learner(answers, body, hot_rows)
    looked_at = steps.filter((F.col("day_n") == 1) | (F.col("score") >= 0.5))
    rules = {
        "first_answer": F.col("n") >= 1,
        "ten_answers": F.col("n") >= 10,
        "fifty_answers": F.col("n") >= 50,
        "weak_point_first": F.col("conquered") > 0,
        "perfect_session": (F.col("day_n") >= 3) & (F.col("day_right") == F.col("day_n")),
        "mastery_90": F.col("high") > 0,
    }
    by_answer = looked_at.groupBy("learner_id").agg(*[F.min(F.when(c, F.col("ts"))).alias(r) for r, c in rules.items()])

    first_of_day = answers.groupBy("learner_id", "day").agg(F.min("ts").alias("ts"))
    week = Window.partitionBy("learner_id", F.date_trunc("week", "day")).orderBy("day")
    days = day_runs(first_of_day).withColumn("week_days", F.row_number().over(week))
    day_rules = {
        "streak_3": F.col("run") >= 3,
        "streak_7": F.col("run") >= 7,
        "five_days_week": F.col("week_days") >= 5,
    }
    by_day = days.groupBy("learner_id").agg(*[F.min(F.when(c, F.col("ts"))).alias(r) for r, c in day_rules.items()])

    def long_form(df: DataFrame, names) -> DataFrame:
        pairs = ", ".join(f"'{n}', {n}" for n in names)
        return df.selectExpr("learner_id", f"stack({len(names)}, {pairs}) AS (achievement, unlocked_at)").filter(
            "unlocked_at IS NOT NULL"
        )

    return long_form(by_answer, list(rules)).unionByName(long_form(by_day, list(day_rules)))


def points_and_level(answers: DataFrame, unlocked: DataFrame) -> DataFrame:
    """Points (days, answers, achievements), the level they give and the points to the next one.

    Sums do not depend on order, so no window is needed for the standing of a learner.
    """
    per_day = answers.groupBy("learner_id", "day").agg(
        F.count_if(M.right()).alias("right"), F.count_if((F.col("score") >= 0.5) & ~M.right()).alias("half")
    )
    earned = per_day.groupBy("learner_id").agg(
        F.sum(F.lit(5) + 10 * F.col("right") + 5 * F.col("half")).alias("earned")
    )
    worth = F.create_map(*[F.lit(x) for kv in ACHIEVEMENT_POINTS.items() for x in kv])
    bonus = unlocked.groupBy("learner_id").agg(
        F.sum(worth[F.col("achievement")]).cast("long").alias("bonus"), F.count(_one()).alias("achievement_count")
    )
    both = earned.join(bonus, "learner_id", "left").na.fill(0, ["bonus", "achievement_count"])
    return both.withColumn("points", F.col("earned") + F.col("bonus")).select(
        "learner_id", "points", "achievement_count", level_of_points("points").alias("level"),
        (level_of_points("points") * level_of_points("points") * 100 - F.col("points")).alias("xp_to_next"),
    )


def level_of_points(points: str):
    """``floor(sqrt(points / 100)) + 1``, at most 100."""
    return F.least(F.lit(100).cast("long"), F.floor(F.sqrt(F.greatest(F.col(points), F.lit(0)) / 100)) + 1)


def _newest(df: DataFrame, keys, n: int) -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(F.desc("ts"), F.desc("answer_id"))
    return df.withColumn("rn", F.row_number().over(window)).filter(F.col("rn") <= n)


def wrong_book(answers: DataFrame, n: int = 50) -> DataFrame:
    """The last ``n`` misses (score below one half) per learner.

    ``row_number <= n`` lets Spark cut each partition to n rows per learner before the shuffle.
    """
    return _newest(answers.filter(_missed()), LEARNER, n)


def answer_history(answers: DataFrame, n: int = 200) -> DataFrame:
    return _newest(answers, LEARNER, n)


def recent_of(kept: DataFrame, limit: int, per_kp: bool = False) -> DataFrame:
    """Newest ``limit`` of an already cut book or history, overall or per point."""
    keys = LEARNER_KP if per_kp else LEARNER
    return _newest(kept.drop("rn"), keys, limit)


def review_history(answers: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """One row per scheduled review: the level after the answer and the date it led to."""
    rows = running_levels(answers, hot_rows).withColumn("_days", M.review_interval(F.col("level")))
    return rows.select("answer_id", "learner_id", "kp_id", "level", F.expr("date_add(day, _days)").alias("scheduled"))


def _at_s(df: DataFrame) -> DataFrame:
    return df.withColumn("at_s", F.unix_seconds(F.col("ts").cast("timestamp")))


def practice_trigger(
    answers: DataFrame, book: int | None = None, throttle_s: int = 21600, consecutive: bool = False, hot_rows: int | None = None
) -> DataFrame:
    """Misses that start a practice set: the point already has a miss in the book (the learner's last ``book`` misses;
    by default all), at most one start per (learner, point) in ``throttle_s``.  ``consecutive`` asks for two answers in a row
    that were not right instead."""

    def in_a_row(df: DataFrame, scan: Scan) -> DataFrame:
        df = _with_runs(scan(df, LEARNER_KP, {"_n": ("count", _one())}), scan, "_n")
        ready = _at_s(df.filter(_missed() & (F.col("consecutive_wrong") >= 2)))
        return throttle(ready, LEARNER_KP, "at_s", "answer_id", throttle_s, scan.sliced)

    if consecutive:
        return _by_learner(answers.select("answer_id", "learner_id", "kp_id", "ts", "score"), in_a_row, hot_rows)

    def body(df: DataFrame, scan: Scan) -> DataFrame:
        if book is None:
            ready = _at_s(scan(df, LEARNER_KP, {"_n": ("count", _one())}).filter("_n > 1"))
        else:
            df = scan(df, LEARNER, {"_no": ("count", _one())})
            df = scan(df, LEARNER_KP, {"_prev": ("prev_max", F.col("_no"))})
            ready = _at_s(df.filter(F.col("_no") - F.col("_prev") < book))
        return throttle(ready, LEARNER_KP, "at_s", "answer_id", throttle_s, scan.sliced)

    missed = answers.filter(_missed()).select("answer_id", "learner_id", "kp_id", "ts")
    return _by_learner(missed, body, hot_rows)


def exam_trigger(
    answers: DataFrame, weak_needed: int = 3, cooldown_s: int = 86400, hot_rows: int | None = None
) -> DataFrame:
    """Answers after which a subject has enough weak points for a drill exam, at most one exam
    per learner in ``cooldown_s``."""
    weak_now = (F.col("level") < M.WEAK_BELOW).cast("long")
    weak_before = F.coalesce((F.col("level_before") < M.WEAK_BELOW).cast("long"), F.lit(0))

    def body(df: DataFrame, scan: Scan) -> DataFrame:
        df = _with_levels(df, scan).select(
            "answer_id", "learner_id", "ts", F.split("kp_id", "/")[0].alias("subject"),
            (weak_now - weak_before).alias("_change"),
        )
        df = scan(df, ["learner_id", "subject"], {"weak": ("sum", F.col("_change"))})
        return throttle(
            _at_s(df.filter(F.col("weak") >= weak_needed)), LEARNER, "at_s", "answer_id", cooldown_s, scan.sliced
        )

    return _by_learner(answers, body, hot_rows)


# Minutes and answers after which a session of a grade band is tiring.
FATIGUE = {"primary_low": (15, 5), "primary_high": (25, 10), "middle": (35, 15)}


def fatigue_flag(
    answers: DataFrame, band: str = "primary_high", gap_s: int = 1800, hot_rows: int | None = None
) -> DataFrame:
    """Answers of a sitting (no pause over ``gap_s``) with elapsed minutes and the tired flag."""
    minutes, count = FATIGUE.get(band, FATIGUE["primary_high"])
    seconds = answers.withColumn("_s", F.unix_micros(F.col("ts").cast("timestamp")))

    def body(df: DataFrame, scan: Scan) -> DataFrame:
        df = scan(df, LEARNER, {"_n": ("count", _one()), "_prev": ("prev_max", F.col("_s"))})
        opens = F.col("_prev").isNull() | (F.col("_s") - F.col("_prev") > gap_s * 1_000_000)
        return scan(
            df,
            LEARNER,
            {"_start": ("max", F.when(opens, F.col("_s"))), "_before": ("max", F.when(opens, F.col("_n") - 1))},
        )

    rows = _by_learner(seconds, body, hot_rows)
    answered = F.col("_n") - F.col("_before")
    elapsed = (F.col("_s") - F.col("_start")) / 60_000_000
    return rows.select(
        "answer_id", "learner_id", answered.alias("answered"), F.floor(elapsed).alias("minutes"),
        ((elapsed >= minutes) | (answered >= count)).alias("tired"),
    )


def task_progress(reports: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """Counters of a task never go back: the running maximum of each report field."""
    fields = ("current_question", "correct_count", "wrong_count")

    def body(df: DataFrame, scan: Scan) -> DataFrame:
        return scan(df, ["task_id"], {f"_{f}": ("max", F.col(f)) for f in fields})

    rows = by_heat(reports, ["task_id"], ["at_s", "report_id"], clock_slice("at_s"), body, hot_rows)
    return rows.select("report_id", "task_id", *[F.col(f"_{f}").alias(f) for f in fields])


def week_over_week(answers: DataFrame, as_of: str, whole_week: bool = False) -> DataFrame:
    """Accuracy of the last 7 days beside that of the single day 7 days ago, both as ratios.

    ``whole_week`` compares with the period of the same length just before instead.
    """
    week = M.period_stats(answers, as_of, 7).select("learner_id", "total", F.col("accuracy").alias("week_accuracy"))
    back, length = (8, 7) if whole_week else (7, 0)
    before = (date.fromisoformat(as_of) - timedelta(days=back)).isoformat()
    day = (
        M.in_period(answers, before, length)
        .groupBy("learner_id")
        .agg(F.count(_one()).alias("t"), F.count_if(M.right()).alias("c"))
        .select("learner_id", ratio2("c", "t").alias("day_accuracy"))
    )
    return week.join(day, "learner_id", "left").na.fill(0.0, ["day_accuracy"])


def period_points(answers: DataFrame, as_of: str, days: int) -> DataFrame:
    """Per (learner, point): counts and level of all answers, and counts of the period (``p_total``, ``p_correct``,
    ``p_wrong``), in one scan of the answers."""
    end = date.fromisoformat(as_of)
    inside = F.col("day").between(F.lit(end - timedelta(days=days)), F.lit(end))
    period = [
        F.count_if(inside).alias("p_total"), F.count_if(inside & M.right()).alias("p_correct"), F.count_if(inside & M.wrong()).alias("p_wrong"),
    ]
    return M.mastery(answers, *period)


def parent_report(answers: DataFrame, as_of: str, days: int = 7, wrong: int = 5, points: Column | None = None) -> DataFrame:
    """Totals of the period, its weak points, its newest ``wrong`` misses and the points ever touched.

    One scan of all answers and one of the period.  ``points`` is what the list of weak points shows of each.
    """
    shown = F.col("kp_id") if points is None else points
    weak = F.array_sort(F.collect_list(F.when((F.col("p_wrong") > 0) & F.col("kp_id").isNotNull(), shown)))
    totals = (
        period_points(answers, as_of, days)
        .groupBy("learner_id")
        .agg(
            F.sum("p_total").alias("total_questions"), F.sum("p_correct").alias("correct_count"), F.sum("p_wrong").alias("wrong_count"),
            weak.alias("weak_points"), F.count("kp_id").alias("mastery_count"),
        )
        .filter("total_questions > 0")
        .withColumn("accuracy", ratio2("correct_count", "total_questions"))
    )
    recent = _newest(M.in_period(answers, as_of, days).filter(~M.right()), LEARNER, wrong)
    recent = recent.groupBy("learner_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rn", "question"))), lambda s: s["question"]).alias("recent_wrong")
    )
    rows = totals.join(recent, "learner_id", "left").withColumn("recent_wrong", F.coalesce("recent_wrong", F.array().cast("array<string>")))
    return rows.select(
        "learner_id", "total_questions", "correct_count", "wrong_count", "accuracy", "weak_points", "recent_wrong", "mastery_count"
    )
