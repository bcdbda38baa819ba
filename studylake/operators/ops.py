"""Operational rules: outages, alerts, stuck ingests, retention, counters, progress."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from studylake.operators.scan import Scan, by_heat, clock_slice

# Failures that open a circuit, and seconds until it is tried again.
FAILURES_TO_OPEN = 3
RECOVERY_S = 60


def outage_windows(calls: DataFrame, threshold: int = FAILURES_TO_OPEN, hot_rows: int | None = None) -> DataFrame:
    """Runs of at least ``threshold`` failures of a backend with no success between.

    ``opened_at`` is the failure that opened the circuit, ``closed_at`` the success after the run
    (null while open), ``retries_from`` when it is half open for the first time.
    """

    def body(df: DataFrame, scan: Scan) -> DataFrame:
        return scan(df, ["backend"], {"_ok_before": ("count", F.when(F.col("ok"), 1)), "_n": ("count", F.lit(1))})

    order = ["at_s", "call_id"]
    rows = by_heat(calls, ["backend"], order, clock_slice("at_s"), body, hot_rows)
    runs = rows.groupBy("backend", F.col("_ok_before").alias("run")).agg(
        F.count_if(~F.col("ok")).alias("failures"),
        F.max(F.when(~F.col("ok"), F.col("at_s"))).alias("last_failure"),
        F.min("_n").alias("_first"),
        F.min(F.when(F.col("ok"), F.col("at_s"))).alias("_ok_at"),
    )
    # Position inside the run: the success that heads a run (all but run 0) is not a failure.
    opening = rows.join(
        runs.filter(F.col("failures") >= threshold).select("backend", F.col("run").alias("_ok_before"), "_first"),
        ["backend", "_ok_before"],
    ).filter(~F.col("ok"))
    nth = F.col("_n") - F.col("_first") + F.when(F.col("_ok_before") == 0, 1).otherwise(0)
    opening = opening.filter(nth == threshold).select(
        "backend", F.col("_ok_before").alias("run"), F.col("at_s").alias("opened_at")
    )
    healed = runs.select("backend", (F.col("run") - 1).alias("run"), F.col("_ok_at").alias("closed_at"))
    return (
        runs.drop("_first", "_ok_at")
        .join(opening, ["backend", "run"])
        .join(healed, ["backend", "run"], "left")
        .withColumn("retries_from", F.col("opened_at") + RECOVERY_S)
    )


# Alert limits.
CPU_WARN, STORAGE_WARN, STORAGE_CRITICAL, SSD_WARN = 75, 80, 90, 20


def device_alerts(telemetry: DataFrame) -> DataFrame:
    """Alerts of each reading; stateless, so the same code serves batch and stream."""

    def alert(cond: Column, severity: str, kind: str, value: str) -> Column:
        return F.when(
            cond, F.struct(F.lit(severity).alias("severity"), F.lit(kind).alias("type"), F.col(value).cast("double").alias("value"))
        )

    used = F.col("used_percent")
    found = F.array(
        alert(F.col("cpu") > CPU_WARN, "warning", "temp_high", "cpu"),
        alert(used > STORAGE_CRITICAL, "critical", "storage_full", "used_percent"),
        alert((used > STORAGE_WARN) & (used <= STORAGE_CRITICAL), "warning", "storage_high", "used_percent"),
        alert(F.col("ssd_life") < SSD_WARN, "warning", "ssd_life", "ssd_life"),
    )
    return telemetry.select("event_id", "device_id", "ts", F.explode(F.array_compact(found)).alias("a")).select(
        "event_id", "device_id", "ts", "a.*"
    )


def alert_peaks(telemetry: DataFrame, width: str = "10 minutes", delay: str | None = None) -> DataFrame:
    """One alert of each kind per device and tumbling window, of its worst reading: where storage is critical once, it is not merely high.

    ``delay`` is the watermark of a stream; readings combine map-side in both forms.
    """
    rows = telemetry.withColumn("ts", F.col("ts").cast("timestamp"))
    if delay:
        rows = rows.withWatermark("ts", delay)
    worst = rows.groupBy("device_id", F.window("ts", width)).agg(F.max("cpu").alias("cpu"), F.max("used_percent").alias("used_percent"), F.min("ssd_life").alias("ssd_life"))
    each = worst.select("device_id", F.lit(None).cast("long").alias("event_id"), F.col("window.start").alias("ts"), "cpu", "used_percent", "ssd_life")
    return device_alerts(each).drop("event_id").withColumnRenamed("ts", "start")


def orphaned_ingests(stages: DataFrame, as_of: Column, max_age_s: int = 3600) -> DataFrame:
    """Ingests whose latest stage is still processing after ``max_age_s``."""
    latest = stages.groupBy("trace_id").agg(F.max_by(F.struct("stage", "ts"), F.struct("ts", "event_id")).alias("s"))
    age = F.unix_micros(as_of) - F.unix_micros(F.col("s.ts").cast("timestamp"))
    return latest.filter((F.col("s.stage") == "processing") & (age > max_age_s * 1_000_000)).select(
        "trace_id", F.col("s.ts").alias("ts")
    )


def retain(files: DataFrame, as_of: Column, max_age_s: int, max_n: int | None = None) -> DataFrame:
    """Files young enough, and of those the newest ``max_n``."""
    age = F.unix_micros(as_of) - F.unix_micros(F.col("ts").cast("timestamp"))
    young = files.filter(age <= max_age_s * 1_000_000)
    return young if max_n is None else young.orderBy(F.desc("ts"), F.desc("event_id")).limit(max_n)


def ingest_counters(steps: DataFrame) -> DataFrame:
    """Files, pages and errors per ingest run."""

    def tally(kind: str) -> Column:
        return F.count_if(F.col("kind") == kind)

    return steps.groupBy("run_id").agg(
        F.countDistinct("file_id").alias("files_in"),
        tally("page_done").alias("pages_done"),
        tally("page_skipped").alias("pages_skipped"),
        tally("page_failed").alias("pages_failed"),
        tally("file_out").alias("files_out"),
        tally("error").alias("errors"),
    )


def collection_counts(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("kb_name", "subject", "type").agg(F.count(F.lit(1)).alias("chunks"))


def turn_duration(events: DataFrame) -> DataFrame:
    """Microseconds from the first to the last event of a turn, never negative."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return events.groupBy("turn_id").agg(F.greatest(F.lit(0).cast("long"), F.max(us) - F.min(us)).alias("duration_us"))


# Stages of book generation in order.
BOOK_STAGES = ["ideation", "exploration", "synthesis", "critique", "overview", "compilation"]


_PENDING, _RUNNING, _COMPLETED, _ERROR = "prce"
_STATE_NAMES = {"p": "pending", "r": "running", "c": "completed", "e": "error"}
_BOOK_START = _PENDING * len(BOOK_STAGES)


def _book_step(state: str, kind: str, rank: int) -> str:
    """State of the stages (one letter each) after an event."""
    if kind == "start":
        done = state[:rank].replace(_PENDING, _COMPLETED).replace(_RUNNING, _COMPLETED)
        return done + _RUNNING + state[rank + 1 :]
    if kind == "complete":
        return state[:rank] + _COMPLETED + state[rank + 1 :]
    return state.replace(_RUNNING, _ERROR, 1)


def _fold_books(events: DataFrame) -> DataFrame:
    """End state of each book by one fold over its ordered events; the state is six letters."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "kind", "rank")))

    def step(state: Column, e: Column) -> Column:
        before, after = F.substr(state, F.lit(1), e["rank"]), F.substr(state, e["rank"] + 2)
        running = F.locate(_RUNNING, state)
        return (
            F.when(e["kind"] == "start", F.concat(F.translate(before, _PENDING + _RUNNING, _COMPLETED * 2), F.lit(_RUNNING), after))
            .when(e["kind"] == "complete", F.concat(before, F.lit(_COMPLETED), after))
            .when(running > 0, F.concat(F.substr(state, F.lit(1), running - 1), F.lit(_ERROR), F.substr(state, running + 1)))
            .otherwise(state)
        )

    return events.groupBy("book_id").agg(F.aggregate(ordered, F.lit(_BOOK_START), step).alias("state"))


def _chain_books(events: DataFrame, per_slice: int) -> DataFrame:
    """The same for books with very many events.

    A slice of events is a function from entry state to end state.  Slices tabulate theirs in
    parallel (there are 4^6 states), and a book then looks its state up slice by slice.
    """
    states = ["".join(t) for t in itertools.product("prce", repeat=len(BOOK_STAGES))]
    number = {s: i for i, s in enumerate(states)}
    events = events.withColumn("slice", F.floor(F.col("pos") / per_slice))

    def tabulate(pdf: pd.DataFrame) -> pd.DataFrame:
        moves: dict[tuple[str, int], np.ndarray] = {}
        at = np.arange(len(states))
        pdf = pdf.sort_values("pos")
        for event in zip(pdf["kind"].tolist(), pdf["rank"].tolist()):
            if event not in moves:
                moves[event] = np.array([number[_book_step(s, *event)] for s in states])
            at = moves[event][at]
        return pd.DataFrame({"book_id": pdf["book_id"].iloc[:1], "slice": pdf["slice"].iloc[:1], "ends": [at.tolist()]})

    def follow(pdf: pd.DataFrame) -> pd.DataFrame:
        at = number[_BOOK_START]
        for ends in pdf.sort_values("slice")["ends"]:
            at = int(ends[at])
        return pd.DataFrame({"book_id": pdf["book_id"].iloc[:1], "state": [states[at]]})

    book = events.schema["book_id"].dataType.simpleString()
    tables = events.groupBy("book_id", "slice").applyInPandas(tabulate, f"book_id {book}, slice long, ends array<int>")
    return tables.groupBy("book_id").applyInPandas(follow, f"book_id {book}, state string")


def book_progress(events: DataFrame, per_slice: int = 100_000, hot_rows: int | None = None) -> DataFrame:
    """State of every stage of a book after its events.

    Starting a stage completes the earlier ones still pending or running; an error marks the
    first running stage.  ``events`` is (book_id, pos, kind, stage) with kind start, complete,
    error or anything else, which changes nothing.
    """
    rank = F.array_position(F.array(*[F.lit(s) for s in BOOK_STAGES]), F.col("stage")).cast("int") - 1
    marks = events.select("book_id", "pos", "kind", rank.alias("rank"))
    marks = marks.filter(F.col("kind").isin("start", "complete", "error"))

    def body(df: DataFrame, scan: Scan) -> DataFrame:
        return _chain_books(df, per_slice) if scan.sliced else _fold_books(df)

    ends = by_heat(marks, ["book_id"], ["pos"], F.lit(0), body, hot_rows)
    ends = events.select("book_id").distinct().join(ends, "book_id", "left")
    state = F.coalesce("state", F.lit(_BOOK_START))
    names = F.create_map(*[F.lit(x) for kv in _STATE_NAMES.items() for x in kv])
    views = [
        F.struct(F.lit(stage).alias("stage"), names[F.substr(state, F.lit(i + 1), F.lit(1))].alias("state"))
        for i, stage in enumerate(BOOK_STAGES)
    ]
    return ends.select("book_id", F.explode(F.array(*views)).alias("v")).select("book_id", "v.*")


def book_counters(events: DataFrame) -> DataFrame:
    """Counters of a book: rounds, pages and blocks."""

    def tally(*kinds: str) -> Column:
        return F.count_if(F.col("kind").isin(*kinds))

    return events.groupBy("book_id").agg(
        tally("page_planning").alias("pages_planned"),
        tally("page_compiled", "page_ready").alias("pages_ready"),
        tally("block_ready").alias("blocks_ready"),
        tally("block_error").alias("blocks_error"),
        F.max_by("chapter_count", F.when(F.col("kind").isin("spine_round", "spine_ready"), F.col("pos"))).alias("chapters"),
    )
