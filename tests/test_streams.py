"""Streams over several micro-batches must end where the batch operators end."""

import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from studylake.operators import mastery as M
from studylake.operators import ops as O
from studylake.operators import progress as P
from studylake.operators import sessions as S
from studylake.operators.throttle import throttle
from studylake.sources.tables import VIEWS, load, view
from studylake.streaming import aggregates as A
from studylake.streaming import stateful as ST
from studylake.streaming.runs import drain, ending, latest, scratch
from studylake.streaming.store import KeyedStore
from tests.conftest import rows


def in_files(spark, sf, path, order):
    """The events in files by time, read in the given order, one file per micro-batch."""
    events = load(spark, sf, "events")
    n = events.count()
    for place, i in enumerate(order):
        events.filter((F.col("event_id") >= n * i // len(order)) & (F.col("event_id") < n * (i + 1) // len(order))).coalesce(1).write.mode("append").parquet(path)
        for name in os.listdir(path):  # a file source reads the oldest file first
            if name.endswith(".parquet") and os.stat(f"{path}/{name}").st_mtime > 1_000_000_000 + 10 * len(order):
                os.utime(f"{path}/{name}", (1_000_000_000 + place, 1_000_000_000 + place))
    return path


@pytest.fixture(scope="module")
def split_events(spark, sf, tmp_path_factory):
    return in_files(spark, sf, str(tmp_path_factory.mktemp("events")), [0, 1, 2, 3])


@pytest.fixture(scope="module")
def shuffled_events(spark, sf, tmp_path_factory):
    """The files out of order, by no more than two files."""
    return in_files(spark, sf, str(tmp_path_factory.mktemp("shuffled")), [1, 0, 3, 2, 5, 4])


def stream(spark, path, schema, name):
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", "1").parquet(path)
    return spark.sql(VIEWS[name].replace("FROM events", "FROM {rows}"), rows=raw)


@pytest.fixture(scope="module")
def schema(spark, sf):
    return load(spark, sf, "events").schema


def test_mastery(spark, sf, split_events, schema):
    emitted = drain(A.stream_mastery(stream(spark, split_events, schema, "answers")), "m", "update")
    assert emitted.select("batch").distinct().count() == 4
    batch = M.mastery(view(spark, sf, "answers"))
    assert rows(latest(emitted, ["learner_id", "kp_id"]).drop("due")) == rows(batch)


def test_mastery_store(spark, sf, shuffled_events, schema):
    """One row per key over several merges; a replayed batch changes nothing; old versions can go."""
    store = A.sync_mastery(stream(spark, shuffled_events, schema, "answers"), scratch(spark, "store"), scratch(spark, "store-mark"), buckets=4)
    want = rows(M.mastery(view(spark, sf, "answers")))
    assert rows(store.read().drop("due")) == want
    last, _ = store._places()
    assert last == 5
    replay = store.read().limit(7).withColumn("total", F.lit(-1).cast("long"))
    store.merge(replay, 6)
    once = rows(store.read())
    store.merge(replay, 6)
    assert rows(store.read()) == once and len(once) == len(want) and store.read().filter("total = -1").count() == 7
    assert store.vacuum() > 0
    assert rows(store.read()) == once
    store.merge(replay.limit(0), 7)
    assert rows(store.read()) == once


def test_store_of_null_keys(spark):
    store = KeyedStore(spark, scratch(spark, "nulls"), StructType.fromDDL("k long, v string"), ["k"], 3)
    assert store.read().collect() == []
    store.merge(spark.createDataFrame([(None, "a"), (2**53, "b"), (2**53 + 1, "c")], "k long, v string"), 0)
    store.merge(spark.createDataFrame([(None, "d"), (2**53 + 1, "e")], "k long, v string"), 1)
    assert rows(store.read()) == sorted([("None", "d"), (str(2**53), "b"), (str(2**53 + 1), "e")])


DAYS = 12  # two of six files of a month of events


@pytest.mark.parametrize("files", ["split_events", "shuffled_events"])
def test_dedup(spark, sf, files, schema, request):
    events = stream(spark, request.getfixturevalue(files), schema, "uploads")
    got = drain(ST.stream_dedup(events, delay="400 seconds"), "d", "append").drop("batch")
    uploads = view(spark, sf, "uploads")
    want = throttle(uploads, ["learner_id", "file_hash"], "at_s", "upload_id", 1800)
    last = uploads.agg(F.max("at_s")).first()[0]
    assert rows(got) == rows(want.filter(F.col("at_s") <= last - 400))


@pytest.mark.parametrize("files", ["split_events", "shuffled_events"])
def test_triggers(spark, sf, files, schema, request):
    fired = drain(ST.stream_triggers(stream(spark, request.getfixturevalue(files), schema, "answers"), delay=f"{DAYS} days"), "t", "append")
    a = view(spark, sf, "answers")
    last = a.agg(F.max(F.unix_millis(F.col("ts").cast("timestamp")))).first()[0] - DAYS * 86_400_000
    judged = a.filter(F.unix_millis(F.col("ts").cast("timestamp")) <= last).select("answer_id")
    practice = fired.filter("trigger = 'practice'").select("learner_id", F.col("target").alias("kp_id"), "at_s", "answer_id")
    assert rows(practice) == rows(P.practice_trigger(a).join(judged, "answer_id", "left_semi"))
    assert rows(fired.filter("trigger = 'exam'").select("learner_id", "at_s", "answer_id")) == rows(P.exam_trigger(a).join(judged, "answer_id", "left_semi"))


def answers_of(spark, cases):
    """(learner, answer, point, score, second) as a table with timestamps."""
    df = spark.createDataFrame(cases, "learner_id long, answer_id long, kp_id string, score double, s long")
    return df.select("learner_id", "answer_id", "kp_id", "score", F.timestamp_seconds("s").alias("ts"))


def test_triggers_of_awkward_rows(spark, tmp_path):
    """A missing point and learner, large ids, and 59 other misses between two of one point: stream and batch agree."""
    big = 2**53 + 1
    cases = [(None, 1, None, 0.0, 10), (None, 2, None, 0.0, 20), (big, big, "math/a", 0.0, 10), (big - 1, 4, "math/a", 0.0, 15)]
    cases += [(big, 100 + i, f"math/p{i}", 0.0, 30 + i) for i in range(59)] + [(big, 300, "math/a", 0.0, 200), (5, 999, "x/y", 1.0, 10**6)]
    df = answers_of(spark, cases)
    path = str(tmp_path / "answers")
    df.coalesce(1).write.parquet(path)
    fired = drain(ST.stream_triggers(spark.readStream.schema(df.schema).parquet(path)), "awkward", "append")
    practice = fired.filter("trigger = 'practice'").select("learner_id", F.col("target").alias("kp_id"), "at_s", "answer_id")
    assert rows(practice) == rows(P.practice_trigger(df)) == sorted([("2", "20", "None", "None"), ("300", "200", "math/a", str(big))])
    assert rows(P.practice_trigger(df, book=50)) == [("2", "20", "None", "None")]
    assert rows(fired.filter("trigger = 'exam'").select("learner_id", "at_s", "answer_id")) == rows(P.exam_trigger(df))


@pytest.mark.parametrize("files", ["split_events", "shuffled_events"])
def test_guards(spark, sf, files, schema, request):
    got = drain(ST.stream_guarded_sessions(stream(spark, request.getfixturevalue(files), schema, "create_attempts"), 300, delay="400 seconds"), "g", "append")
    attempts = view(spark, sf, "create_attempts")
    last = attempts.agg(F.max("at_s")).first()[0]
    assert rows(got.select("attempt_id")) == rows(S.guarded_sessions(attempts, 300).filter(F.col("at_s") <= last - 400).select("attempt_id"))


def test_forgotten_state_is_cleared(spark, tmp_path):
    """A key that has been quiet for its gap has no state left."""
    path = str(tmp_path / "uploads")
    df = spark.createDataFrame([(i, i % 20, i, f"h{i % 20}") for i in range(200)] + [(9999, 1, 100_000, "new")], "upload_id long, learner_id long, at_s long, file_hash string")
    df.filter("at_s < 1000").coalesce(1).write.parquet(path)
    df.filter("at_s > 1000").coalesce(1).write.mode("append").parquet(path)
    query = (
        ST.stream_dedup(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", "1").parquet(path)).writeStream
        .option("checkpointLocation", scratch(spark, "quiet")).format("noop").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    states = {o["operatorName"]: o for o in query.lastProgress["stateOperators"]}
    known = states["transformWithStateInPandasExec"]
    # One key still waits for the watermark: its row, its timer and the timer's time.
    assert known["numRowsTotal"] <= 8


def test_outages(spark, sf, split_events, schema):
    got = drain(ST.stream_outages(stream(spark, split_events, schema, "backend_calls")), "o", "append")
    want = O.outage_windows(view(spark, sf, "backend_calls"))
    opened = want.select("backend", F.col("opened_at").alias("at_s"))
    assert rows(got.filter("change = 'opened'").select("backend", "at_s")) == rows(opened)
    closed = want.filter("closed_at IS NOT NULL").select("backend", F.col("closed_at").alias("at_s"))
    assert rows(got.filter("change = 'closed'").select("backend", "at_s")) == rows(closed)


def test_quiz_sync_is_idempotent(spark, split_events, schema):
    out, mark = scratch(spark, "quiz"), scratch(spark, "quiz-mark")
    for _ in range(2):
        A.sync_quiz_batches(stream(spark, split_events, schema, "quiz_raw"), out, mark)
    once = spark.read.parquet(out).count()
    # A second queue with the same answers, read from the start, adds nothing that is stored twice.
    stored = spark.read.parquet(out)
    assert once == stored.select("answer_id").distinct().count()


def test_alerts_and_deadlines(spark, sf, split_events, schema):
    got = drain(A.stream_alerts(stream(spark, split_events, schema, "telemetry")), "a", "append").drop("batch", "ts")
    assert rows(got) == rows(O.device_alerts(view(spark, sf, "telemetry")).drop("ts"))
    late = drain(ST.stream_deadlines(stream(spark, split_events, schema, "ingest_stages"), "trace_id", ["processing"], 3600), "l", "append")
    assert late.count() > 0


def drained_states(stream, label):
    """State rows that are left when ``stream`` is drained, and its state store's progress."""
    query = stream.writeStream.option("checkpointLocation", scratch(stream.sparkSession, label)).format("noop").trigger(availableNow=True).start()
    query.awaitTermination()
    return {o["operatorName"]: o for o in query.lastProgress["stateOperators"]}["transformWithStateInPandasExec"]["numRowsTotal"]


def test_open_keys_share_their_state(spark, tmp_path, monkeypatch):
    """Deadlines of 300 open keys are a few state rows, not some of each key."""
    monkeypatch.setattr(ST, "SHARDS", 4)
    path = str(tmp_path / "stages")
    cases = [(i, f"t{i}", "processing", i) for i in range(300)] + [(300 + i, f"t{i}", "embedded", 300 + i) for i in range(0, 300, 3)]
    cases += [(900, None, "processing", 5), (901, "t999", "received", 1500)]
    df = spark.createDataFrame(cases, "event_id long, trace_id string, stage string, s long").select("event_id", "trace_id", "stage", F.timestamp_seconds("s").alias("ts"))
    df.coalesce(1).write.parquet(path)
    stream = lambda: spark.readStream.schema(df.schema).parquet(path)
    assert drained_states(ST.stream_deadlines(stream(), "trace_id", ["processing"], 9000), "open") <= 12
    late = drain(ST.stream_deadlines(stream(), "trace_id", ["processing"], 800), "late", "append").drop("batch")
    # The watermark ends at second 900: those of up to second 100 are past their deadline.
    assert rows(late) == sorted([(str((i + 800) * 1000), f"t{i}") for i in range(101) if i % 3] + [("805000", "None")])


def test_expiry_of_large_and_missing_ids(spark, tmp_path, monkeypatch):
    """Session ids keep their type and value, and 400 open sessions stay within the state of the shards."""
    monkeypatch.setattr(ST, "SHARDS", 4)
    path, big, day = str(tmp_path / "sessions"), 2**53 + 1, 86_400
    cases = [(big, "active", 60), (big - 1, "completed", 60), (None, "pending", 60)] + [(i, "pending", 50 * day) for i in range(400)] + [(7000, "completed", 41 * day)]
    df = spark.createDataFrame(cases, "session_id long, stage string, s long").select("session_id", F.col("session_id").alias("event_id"), "stage", F.timestamp_seconds("s").alias("ts"))
    df.coalesce(1).write.parquet(path)
    stream = lambda: spark.readStream.schema(df.schema).parquet(path)
    assert drained_states(ST.stream_deadlines(stream(), "session_id", ["pending", "active"], 40 * day), "sessions") <= 12
    got = drain(ST.stream_deadlines(stream(), "session_id", ["pending", "active"], 40 * day), "expired", "append").drop("batch")
    assert got.schema["session_id"].dataType.simpleString() == "bigint"
    assert rows(got) == sorted([(str(40 * day * 1000 + 60_000), str(big)), (str(40 * day * 1000 + 60_000), "None")])


def shuffled_rows(spark, stream, label):
    """What ``stream`` emits, and the rows that were dealt out for it."""
    def stages():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        found = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
        return {found.apply(i).stageId(): found.apply(i).shuffleWriteRecords() for i in range(found.size())}

    before = stages()
    got = drain(stream, label, "append").drop("batch")
    return got, sum(n for stage, n in stages().items() if stage not in before)


def test_deadlines_are_packed_by_shard(spark, tmp_path, monkeypatch):
    """Rows are dealt out as one pack of a shard for each packed part of a scan, not one by one; the latest row of a key counts, wherever it is packed."""
    monkeypatch.setattr(ST, "SHARDS", 8)
    path, big = str(tmp_path / "stages"), 2**53
    cases = [(big + i, big + i, "processing", 1 + i % 50) for i in range(6000)]
    cases += [(7 * big, big + 1, "embedded", 2), (1, big + 2, "embedded", 3), (None, big + 3, "embedded", 3), (7 * big + 1, big + 4, None, 5)]
    cases += [(2, big + 5, "embedded", 1), (7 * big + 2, None, "embedded", 10), (7 * big + 1, None, "processing", 10), (3, 1, "received", 2000), (4, 2, "processing", None)]
    df = spark.createDataFrame(cases, "event_id long, trace_id long, stage string, s long").select("event_id", "trace_id", "stage", F.timestamp_seconds("s").alias("ts"))
    df.orderBy(F.hash("event_id")).coalesce(1).write.parquet(path)
    stream = lambda: ST.stream_deadlines(spark.readStream.schema(df.schema).parquet(path), "trace_id", ["processing"], 900)
    got, dealt = shuffled_rows(spark, stream(), "packed")
    want = sorted((str((i % 50 + 901) * 1000), str(big + i)) for i in range(6000) if i not in (1, 4))
    assert rows(got) == want
    assert dealt <= 8 * spark.sparkContext.defaultParallelism
    # Many small packs, which a shard puts together.
    monkeypatch.setattr(ST, "PACK_ROWS", 1)
    got, dealt = shuffled_rows(spark, stream(), "repacked")
    assert rows(got) == want and 8 * 2 < dealt < 6000


def test_deadlines_of_several_batches(spark, tmp_path, monkeypatch):
    """A later batch closes, reopens and moves the deadlines of keys that a shard holds with others, each once."""
    monkeypatch.setattr(ST, "SHARDS", 2)
    path = str(tmp_path / "stages")
    files = [
        [(i, f"t{i}", "processing", i) for i in range(100)] + [(100, None, "processing", 100)],
        [(200 + i, f"t{i}", "embedded" if i % 2 else "processing", 200 + i) for i in range(0, 100, 3)] + [(300, None, "embedded", 300), (301, "t3", "processing", 301)],
        [(900, "t999", "received", 1660)],
        [(901, "t999", "received", 5000)],
    ]
    for at, cases in enumerate(files):
        df = spark.createDataFrame(cases, "event_id long, trace_id string, stage string, s long").select("event_id", "trace_id", "stage", F.timestamp_seconds("s").alias("ts"))
        df.coalesce(1).write.mode("append").parquet(path)
        for name in os.listdir(path):
            if name.endswith(".parquet") and os.stat(f"{path}/{name}").st_mtime > 1_000_000_100:
                os.utime(f"{path}/{name}", (1_000_000_000 + at, 1_000_000_000 + at))
    stages = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", "1").parquet(path)
    got = drain(ST.stream_deadlines(stages, "trace_id", ["processing"], 1000), "batches", "append")
    last = {f"t{i}": i for i in range(100) if i % 3} | {f"t{i}": 200 + i for i in range(0, 100, 6)} | {"t3": 301}
    assert rows(got.drop("batch")) == sorted((str((s + 1000) * 1000), name) for name, s in last.items())
    # Those of up to second 60 are over at the watermark of the third file, the others at that of the last.
    assert got.select("batch").distinct().count() == 2
    assert drained_states(ST.stream_deadlines(stages, "trace_id", ["processing"], 1000), "left") == 0


def test_waiting_keys_share_their_state(spark, tmp_path, monkeypatch):
    """400 waiting keys are a few state rows; rows that come before the watermark passes them keep their order in a shard of many keys."""
    monkeypatch.setattr(ST, "SHARDS", 4)
    path = str(tmp_path / "uploads")
    cases = [(i, i, 1000 + i % 7, "h") for i in range(400)] + [(1000 + i, i, 1500 + i % 5, "h") for i in range(400)] + [(2000 + i, i, 3000, "h") for i in range(0, 400, 2)]
    df = spark.createDataFrame(cases, "upload_id long, learner_id long, at_s long, file_hash string")
    for part, low, high in ((0, 1000, 3000), (1, 0, 1000)):  # the middle rows first
        df.filter(f"upload_id >= {low} AND upload_id < {high}").coalesce(1).write.mode("append").parquet(path)
        for name in os.listdir(path):
            if name.endswith(".parquet") and os.stat(f"{path}/{name}").st_mtime > 1_000_000_100:
                os.utime(f"{path}/{name}", (1_000_000_000 + part, 1_000_000_000 + part))
    stream = lambda: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", "1").parquet(path)
    # A wait of an hour: nothing is judged yet.
    assert drained_states(ST.stream_dedup(stream(), delay="1 hour"), "wait") <= 20
    got = drain(ST.stream_dedup(stream(), delay="2100 seconds"), "judged", "append").drop("batch")
    want = throttle(df, ["learner_id", "file_hash"], "at_s", "upload_id", 1800)
    assert rows(got) == []
    got = drain(ST.stream_dedup(stream(), delay="2000 seconds"), "judged", "append").drop("batch")
    assert rows(got) == rows(want.filter("at_s <= 1000"))


def test_exams_of_the_last_hour(spark, tmp_path):
    """At the end of the input the answers after the last watermark are judged too, in order, and no earlier file is late by it."""
    cases = [(learner, 10 * learner + i, f"math/p{i % 4}", 0.0, at + i) for learner, at in ((1, 10), (2, 99_000), (3, 99_990)) for i in range(8)]
    df = answers_of(spark, cases)
    path = str(tmp_path / "answers")
    for at, ids in ((0, "learner_id = 3"), (1, "learner_id < 3")):
        df.filter(ids).coalesce(1).write.mode("append").parquet(path)
        for name in os.listdir(path):
            if name.endswith(".parquet") and os.stat(f"{path}/{name}").st_mtime > 1_000_000_100:
                os.utime(f"{path}/{name}", (1_000_000_000 + at, 1_000_000_000 + at))
    mark, ends = ending(spark, "answers-end")
    stream = ST.stream_triggers(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", "1").parquet(path), delay="30 hours", ends=ends)
    end = df.agg(F.max("ts").alias("end"))
    fired = drain(stream, "exams", "append", last=lambda: end.write.mode("append").parquet(mark))
    assert rows(fired.filter("trigger = 'exam'").select("learner_id", "at_s", "answer_id")) == rows(P.exam_trigger(df)) != []
    assert rows(fired.filter("trigger = 'practice'").select("learner_id", F.col("target").alias("kp_id"), "at_s", "answer_id")) == rows(P.practice_trigger(df))
