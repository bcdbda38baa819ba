"""Jobs that rewrite stored tables, and mergeable sketches."""

import os

from pyspark.sql import functions as F

from studylake.operators import cohort as C
from studylake.operators import ops as O
from studylake.plans import reports as RP
from studylake.sources.sinks import rewrite_partitions
from studylake.sources.tables import view
from studylake.streaming.runs import scratch
from tests.conftest import rows


def test_only_partitions_that_lose_rows_are_written(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(i, "abc"[i % 3] if i < 30 else None if i < 33 else "sl/ash =d") for i in range(36)], "n long, k string")
    df.coalesce(1).write.partitionBy("k").parquet(path)
    files = lambda: {(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}
    before = files()
    # b loses some, c and the odd name all, a and null none.
    keep = lambda t: t.filter("k IS NULL OR k = 'a' OR k = 'b' AND n > 10")
    for _ in range(2):
        rewrite_partitions(spark, path, "k", keep, scratch(spark, "stage"))
        assert rows(spark.read.parquet(path).select("n", "k")) == rows(keep(df))
    after = files()
    same = lambda of: {f for f in of if "k=a" in f[0] or "HIVE_DEFAULT" in f[0]}
    assert same(before) == same(after) and not any("k=c" in d or "slash" in d for d, _ in after)
    rewrite_partitions(spark, path, "k", lambda t: t.limit(0), scratch(spark, "stage"), F.col("k") == "b")
    assert rows(spark.read.parquet(path).select("n", "k")) == rows(df.filter("k IS NULL OR k = 'a'"))


def test_sketches_of_days_merge(spark):
    a = spark.range(40_000).select((F.col("id") % 9000).alias("learner_id"), F.expr("date_add(DATE '2024-01-01', CAST(id % 60 AS INT))").alias("day"))
    stored = C.usage_sketches(a)
    assert stored.count() == 60
    got = {str(r.period): r.learners for r in C.active_learners(stored, F.date_trunc("month", "day").cast("date")).collect()}
    for month, n in got.items():
        exact = a.filter(F.date_trunc("month", "day").cast("date") == month).select("learner_id").distinct().count()
        assert abs(n - exact) <= 0.05 * exact
    calls = a.select(F.lit("ocr").alias("operation"), "day", F.col("learner_id").cast("double").alias("seconds"))
    row = C.latency_from_sketches(C.latency_sketches(calls)).first()
    assert row.calls == 40_000 and abs(row.p50 - 4000) < 360 and abs(row.p95 - 8500) < 360 and row.target_p95 == 10.0 and not row.met


def test_alert_peaks_dominate(spark):
    t = spark.createDataFrame([(1, "2024-01-01 00:00:01", 85.0), (2, "2024-01-01 00:09:59", 95.0), (3, "2024-01-01 00:10:00", 85.0)], "event_id long, ts string, used_percent double")
    t = t.selectExpr("event_id", "7 AS device_id", "CAST(ts AS TIMESTAMP) AS ts", "20.0 AS cpu", "used_percent", "CASE WHEN event_id = 2 THEN 5 ELSE 50 END AS ssd_life")
    got = rows(O.alert_peaks(t).select(F.date_format("start", "HH:mm").alias("at"), "type", "value"))
    assert got == sorted([("00:00", "storage_full", "95.0"), ("00:00", "ssd_life", "5.0"), ("00:10", "storage_high", "85.0")])


def test_reports_take_the_zone(spark, sf):
    """12:30 UTC is 20:30 in the report zone, 20:30 UTC the next morning there."""
    from datetime import datetime, timezone

    a = view(spark, sf, "answers")
    due = RP.scheduled_reports(a, datetime(2024, 1, 10, 12, 30, tzinfo=timezone.utc))
    assert {(r.report_type, r.target, r.period) for r in due.select("report_type", "target", "period").distinct().collect()} == {("daily", "parent", "2024-01-10"), ("exam", "child", "2024-01-10")}
    assert RP.scheduled_reports(a, datetime(2024, 1, 10, 20, 30, tzinfo=timezone.utc)).count() == 0
    assert RP.scheduled_reports(a, datetime(2024, 1, 10, 20, 30)).count() == due.count()
