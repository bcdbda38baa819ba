"""Streams that are incremental aggregations: mastery, daily counts, sittings, alerts."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from studylake.operators import mastery as M
from studylake.operators import ops as O
from studylake.sources.readers import read_answers
from studylake.streaming.store import BUCKETS, KeyedStore, upsert


def stream_mastery(answers: DataFrame) -> DataFrame:
    """Running mastery per (learner, point) with its due date; update mode.

    Counts are combined per task before the shuffle, so a hot learner costs one row per point and
    task in each micro-batch.
    """
    per = M.mastery_with_last_day(answers)
    return per.withColumn("_days", M.review_interval(F.col("level"))).select(
        "learner_id", "kp_id", "total", "correct", "partial", "wrong", "level", F.expr("date_add(last_day, _days)").alias("due")
    )


def sync_mastery(answers: DataFrame, path: str, checkpoint: str, buckets: int = BUCKETS) -> KeyedStore:
    """Drain answers into a store of the running mastery, one row per (learner, point)."""
    running = stream_mastery(answers)
    store = KeyedStore(answers.sparkSession, path, running.schema, ["learner_id", "kp_id"], buckets)
    upsert(running, store, checkpoint)
    return store


def stream_daily(answers: DataFrame, delay: str = "1 day") -> DataFrame:
    """Counts per (learner, day); late answers count until the watermark passes their day."""
    timed = answers.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    counts = timed.groupBy("learner_id", F.window("ts", "1 day")).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(M.right()).alias("correct"), F.count_if(M.half()).alias("partial"),
        F.count_if(M.wrong()).alias("wrong"),
    )
    return counts.select("learner_id", F.col("window.start").cast("date").alias("day"), "total", "correct", "partial", "wrong")


def stream_sessions(answers: DataFrame, gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """Sittings ended by inactivity; append mode emits each once it is closed."""
    timed = answers.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    sittings = timed.groupBy("learner_id", F.session_window("ts", gap)).agg(
        F.count(F.lit(1)).alias("answers"), F.sum("score").alias("score")
    )
    return sittings.select(
        "learner_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "answers", "score"
    )


def stream_alerts(telemetry: DataFrame) -> DataFrame:
    """Alerts are stateless; the batch rule runs on the stream as it is."""
    return O.device_alerts(telemetry)


def sync_quiz_batches(quiz: DataFrame, path: str, checkpoint: str, retries: int = 3) -> list[dict]:
    """Drain pending quiz rows into an answer table, each answer once, and return what each micro-batch of this run did:
    ``batch``, ``synced`` and ``errors`` (rejected rows), observed on the rows as they are written.

    A micro-batch writes to its own folder, so a retry replaces what the failed try left, and
    answers stored by earlier batches, in the range of its ids, are left out.  Rejected rows go to a sibling folder.
    """
    spark = quiz.sparkSession
    done: dict[int, dict] = {}

    def write(batch: DataFrame, batch_id: int) -> None:
        good, bad = read_answers(batch)
        # The first copy by content, so that a replay keeps the same one.
        rest = [c for c in good.columns if c != "answer_id"]
        good = good.groupBy("answer_id").agg(F.min(F.struct(*rest)).alias("r")).select("answer_id", "r.*")
        if batch_id > 0:
            schema = f"answer_id {batch.schema['answer_id'].dataType.simpleString()}, batch long"
            stored = spark.read.schema(schema).option("basePath", path).parquet(path).filter(F.col("batch") < batch_id)
            # Files keep the range of their ids: where ids grow, earlier batches are told apart by it and not read.
            low, high = good.agg(F.min("answer_id"), F.max("answer_id")).first()
            if low is not None:
                good = good.join(stored.filter(F.col("answer_id").between(low, high)).select("answer_id"), "answer_id", "left_anti")
        counts = {name: Observation(f"{name}-{batch_id}") for name in ("synced", "errors")}
        good.observe(counts["synced"], F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(os.path.join(path, f"batch={batch_id}"))
        bad.observe(counts["errors"], F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(os.path.join(path + "-rejected", f"batch={batch_id}"))
        done[batch_id] = {"batch": batch_id, **{name: seen.get["n"] for name, seen in counts.items()}}

    last = None
    for _ in range(retries):
        run = quiz.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()
        try:
            run.awaitTermination()
            return list(done.values())
        except Exception as exc:  # the checkpoint makes the next try resume at the failed batch
            last = exc
    raise last
