"""Report texts and the scheduled report job."""

from __future__ import annotations

from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from studylake.operators import mastery as M
from studylake.operators.progress import parent_report
from studylake.sources.sinks import notifications

# Period length in days and label of each kind of report.
DAYS = {"daily": 1, "weekly": 7, "monthly": 30}
LABELS = {"daily": "今日", "weekly": "本周", "monthly": "本月"}
REPORT_HOUR = 20
ZONE = "Asia/Shanghai"


def report_rows(answers: DataFrame, as_of: str, days: int) -> DataFrame:
    """Everything a report text shows, one row per learner active in the period.

    Lists are bounded: days by the period, weak points by the curriculum, misses by five.
    """
    period = M.in_period(answers, as_of, days)
    per_day = (
        period.groupBy("learner_id", "day")
        .agg(F.count(F.lit(1)).alias("t"), F.count_if(M.right()).alias("c"))
        .groupBy("learner_id")
        .agg(F.array_sort(F.collect_list(F.struct("day", "t", "c"))).alias("per_day"))
    )
    base = parent_report(answers, as_of, days, points=F.struct("kp_id", "level", "total")).withColumnRenamed("weak_points", "weak")
    return base.join(per_day, "learner_id").withColumn("percent", F.round(F.col("accuracy") * 100).cast("int"))


def _day_percent(d: Column) -> Column:
    return F.bround(d["c"] * 100 / d["t"], 1)


def _month_day(d: Column) -> Column:
    return F.date_format(d["day"], "MM-dd")


def _text(c: Column) -> Column:
    return c.cast("string")


def _numbered(items: Column, width: int, start: int = 1) -> Column:
    return F.transform(
        items, lambda q, i: F.concat(F.lit("  "), _text(i + start), F.lit(". "), F.substring(q, 1, width))
    )


def _lines(*blocks: Column) -> Column:
    """Join lines; a null block is left out, an array block gives a line per item."""
    return F.concat_ws("\n", *blocks)


def _if(cond: Column, *blocks: Column) -> Column:
    return F.when(cond, F.concat_ws("\n", *blocks))


def parent_text(kind: str) -> Column:
    """Weekly (or daily) text for parents."""
    label = LABELS[kind]
    marks = lambda d: F.when(_day_percent(d) >= 80, "✅").when(_day_percent(d) >= 60, "📖").otherwise("⚠️")
    days = F.transform(
        "per_day",
        lambda d: F.concat(F.lit("  "), marks(d), F.lit(" "), _month_day(d), F.lit(": "), _text(d["t"]), F.lit("题 "), _text(_day_percent(d)), F.lit("%")),
    )
    weak = F.transform(
        "weak",
        lambda w: F.concat(F.lit("  • "), w["kp_id"], F.lit(" (掌握度 "), _text(F.round(w["level"] * 100).cast("int")), F.lit("%)")),
    )
    has_weak, has_wrong = F.size("weak") > 0, F.size("recent_wrong") > 0
    trend = (
        F.when(F.col("percent") >= 80, "⭐ 正确率优秀，继续保持！").when(F.col("percent") >= 60, "💪 进步空间很大，加油！")
        .otherwise("🎯 需要加强基础练习，家长多鼓励孩子！")
    )
    return _lines(
        F.concat(F.lit(f"📊 {label}学习报告 — "), _text(F.col("learner_id"))), F.lit("=" * 20), F.lit(f"📝 {label}学习概况"),
        F.concat(F.lit("  答题: "), _text(F.col("total_questions")), F.lit(" 题 (正确 "), _text(F.col("correct_count")), F.lit(" 题)")),
        F.concat(F.lit("  正确率: "), _text(F.col("percent")), F.lit("%")), F.lit(""),
        F.lit("📅 每日详情:"), days, F.lit(""),
        _if(has_weak, F.lit("⚠️ 薄弱知识点:"), weak, F.lit("")),
        _if(has_wrong, F.concat(F.lit("❌ 最近错题 ("), _text(F.size("recent_wrong")), F.lit(" 道):")), _numbered(F.col("recent_wrong"), 80), F.lit("")),
        trend,
    )


def monthly_text(as_of: str) -> Column:
    """Monthly text with daily bars and advice."""
    bar = lambda d: F.repeat(F.lit("█"), F.greatest(F.lit(1), F.floor(_day_percent(d) / 10).cast("int")))
    days = F.transform(
        "per_day",
        lambda d: F.concat(F.lit("  "), _month_day(d), F.lit(": "), bar(d), F.lit(" "), _text(_day_percent(d)), F.lit("% ("), _text(d["t"]), F.lit("题)")),
    )
    weak = F.transform(
        "weak",
        lambda w: F.concat(
            F.lit("  • "), w["kp_id"], F.lit(": 掌握度 "), _text(F.round(w["level"] * 100).cast("int")), F.lit("% (练习 "),
            _text(w["total"]), F.lit(" 题)"),
        ),
    )
    has_weak, has_wrong = F.size("weak") > 0, F.size("recent_wrong") > 0
    return _lines(
        F.concat(F.lit(f"📊 {as_of[:4]}年{as_of[5:7]}月学习报告 — "), _text(F.col("learner_id"))), F.lit("=" * 25), F.lit(""),
        F.lit("📝 本月学习概况"),
        F.concat(F.lit("  答题总数: "), _text(F.col("total_questions")), F.lit(" 题")),
        F.concat(F.lit("  正确数量: "), _text(F.col("correct_count")), F.lit(" 题")),
        F.concat(F.lit("  正确率: "), _text(F.col("percent")), F.lit("%")),
        F.concat(F.lit("  学习天数: "), _text(F.size("per_day")), F.lit(" 天")), F.lit(""),
        F.lit("📅 每日趋势:"), days, F.lit(""),
        F.lit("📖 知识掌握"), F.concat(F.lit("  已覆盖知识点: "), _text(F.col("mastery_count")), F.lit(" 个")),
        _if(has_weak, F.lit(""), F.lit("⚠️ 薄弱知识点 (需重点关注):"), weak),
        _if(has_wrong, F.lit(""), F.concat(F.lit("❌ 本月错题 ("), _text(F.size("recent_wrong")), F.lit(" 道):")), _numbered(F.col("recent_wrong"), 60)),
        F.lit(""), F.lit("🎯 下月建议"),
        F.when(has_weak, F.lit("  • 针对薄弱知识点加强练习")),
        F.when(F.col("percent") < 70, "  • 建议回顾错题, 巩固基础").otherwise("  • 继续保持, 挑战更高难度"),
        F.lit("  • 坚持每日练习, 积少成多"),
    )


def daily_text(as_of: str) -> Column:
    """Short text of one day for the learner."""
    wrong = F.col("wrong_count")
    return _lines(
        F.lit(f"📚 学习日报 ({as_of})"), F.lit("─" * 20),
        F.concat(F.lit("累计答题: "), _text(F.col("total_questions")), F.lit(" 题")),
        F.concat(F.lit("正确率: "), _text(F.col("percent")), F.lit("%")),
        F.concat(F.lit("知识点覆盖: "), _text(F.col("mastery_count")), F.lit(" 个")),
        F.concat(F.lit("薄弱点: "), _text(F.size("weak")), F.lit(" 个")),
        _if(wrong > 0, F.concat(F.lit("今日错题: "), _text(wrong), F.lit(" 道")), F.lit(""), F.lit("📝 今日错题:"), _numbered(F.col("recent_wrong"), 60)),
        F.lit(""), F.lit("💪 继续加油！"),
    )


def report_text(answers: DataFrame, kind: str, as_of: str) -> DataFrame:
    """Report of each learner with activity in the period of ``kind``."""
    text = monthly_text(as_of) if kind == "monthly" else daily_text(as_of) if kind == "daily" else parent_text(kind)
    return report_rows(answers, as_of, DAYS[kind]).select("learner_id", text.alias("content"))


def due_kinds(now_local) -> list[str]:
    """Kinds of report due at a local time: daily from 20:00, weekly on Mondays, monthly on the 1st."""
    if now_local.hour < REPORT_HOUR:
        return []
    kinds = ["daily"]
    if now_local.weekday() == 0:
        kinds.append("weekly")
    if now_local.day == 1:
        kinds.append("monthly")
    return kinds


#: Fixed value: weak points from which a learner is sent a drill exam.
EXAM_WEAK = 3


def exam_text(questions: int = 10) -> Column:
    """Text of a drill exam for the learner; ``n`` weak points of a subject are covered."""
    return _lines(F.lit("📝 强化训练"), F.lit("─" * 20), F.concat(F.lit("覆盖 "), _text(F.col("n")), F.lit(f" 个薄弱知识点，共 {questions} 道题")))


def scheduled_reports(answers: DataFrame, now, sent: DataFrame | None = None, zone: str = ZONE) -> DataFrame:
    """Notifications due now and not sent yet: reports to parents, and once a day drill exams to learners with enough weak points.

    ``now`` is the job's clock: with a time zone it is turned into ``zone``, without one it is taken to be there. ``sent`` is
    the ids already written; a second run in the same period adds nothing.
    """
    now_local = now.astimezone(ZoneInfo(zone)) if now.tzinfo else now
    as_of = now_local.strftime("%Y-%m-%d")
    out = None
    for kind in due_kinds(now_local):
        period = {"daily": as_of, "weekly": now_local.strftime("%Y-W%W"), "monthly": as_of[:7]}[kind]
        rows = report_text(answers, kind, as_of).select(
            "learner_id", F.lit(kind).alias("report_type"), F.lit(period).alias("period"), "content"
        )
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        return answers.sparkSession.createDataFrame(
            [], "notification_id string, type string, learner_id long, report_type string, period string, content string, target string"
        )
    weak = M.dominant_weak_subject(M.weak_points(M.mastery(answers)), EXAM_WEAK)
    exams = weak.select("learner_id", F.lit("exam").alias("report_type"), F.lit(as_of).alias("period"), exam_text().alias("content"))
    out = notifications(out).unionByName(notifications(exams, "child"))
    return out if sent is None else out.join(sent.select("notification_id"), "notification_id", "left_anti")
