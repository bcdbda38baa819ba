"""Streams with state of their own per key, on ``transformWithStateInPandas``.

Throttles, triggers and session guards depend on the order of events. Their rows wait in the state until the watermark has passed
them and are then handed over in event order, so files may come in any order within ``delay``; what comes later than that is
dropped by the watermark and counted in the query's progress. A timer fires at the earliest waiting row, or
when what is remembered cannot matter any more and is cleared. Keys, rows and results travel as JSON, so nulls and large
numbers stay exact. A key's rows of one ``delay`` are in one task.

Keys are dealt to ``SHARDS`` groups, which share a state and a timer: a call of the state store costs more than the work on a key,
so there are a few calls for a shard and batch, however many keys it has. A shard's state is read and written as a whole.
Deadlines need no order of a key's rows but the last: they travel, and are kept, as Arrow tables.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from studylake.operators.sessions import GuardState, guard_rows
from studylake.streaming.runs import use_rocksdb


#: Groups of keys that share a state. Fixed for the life of a checkpoint.
SHARDS = 2048


#: Rows of a scan that are packed by shard at a time.
PACK_ROWS = 1 << 19


#: Key of the end of the input; it is no JSON, so no event has it.
END = ""


def _shard(key: str = "event_key") -> Column:
    return F.pmod(F.xxhash64(key), F.lit(SHARDS)).cast("int").alias("event_shard")


def _ordered(rows: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    return pd.concat(list(rows)).sort_values(by)


def _wake(handle: StatefulProcessorHandle, timer, at: int | None) -> None:
    """Let the shard's only timer fire at ``at``."""
    if timer.exists():
        if timer.get()[0] == at:
            return
        handle.deleteTimer(timer.get()[0])
        timer.clear()
    if at is not None:
        handle.registerTimer(at)
        timer.update((at,))


class OrderedProcessor(StatefulProcessor):
    """Holds rows of a shard back until the watermark has passed them; ``steps`` says what happens then, key by key."""

    def __init__(self, steps: Steps):
        self.steps = steps

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # Rows as they came, a frame an entry: lists of times, keys and rows, and the first of the times.
        self.waiting = handle.getListState("waiting", "first long, rows string")
        self.known = handle.getValueState("known", "doc string")
        self.timer = handle.getValueState("timer", "ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = []
        for pdf in rows:
            pdf = pdf[pdf["event_key"] != END]
            if len(pdf):
                new.append((int(pdf["event_ms"].min()), json.dumps([pdf[c].tolist() for c in ("event_ms", "event_key", "event_doc")])))
        if not new:
            return iter(())
        self.waiting.appendList(new)
        first = min(ms for ms, _ in new)
        # A wake-up for clearing gives way to one for rows; the next is set from all there is.
        _wake(self.handle, self.timer, min(first, self.timer.get()[0]) if self.timer.exists() else first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.timer.clear()
        mark = timerValues.getCurrentWatermarkInMs()
        packs = [tuple(r) for r in self.waiting.get()]
        due: dict[str, list[str]] = {}
        later = [p for p in packs if p[0] > mark]
        for _, pack in (p for p in packs if p[0] <= mark):
            rest = []
            for ms, name, doc in zip(*json.loads(pack)):
                if ms <= mark:
                    due.setdefault(name, []).append(doc)
                else:
                    rest.append((ms, name, doc))
            if rest:
                later.append((min(ms for ms, *_ in rest), json.dumps(list(zip(*rest)))))
        known = json.loads(self.known.get()[0]) if self.known.exists() else {}
        out: list[dict] = []
        for name, docs in due.items():
            parsed = sorted((self.steps.place(doc), i, doc) for i, doc in enumerate(map(json.loads, docs)))
            known[name] = self.steps.take(json.loads(name), known.get(name), [doc for *_, doc in parsed], out)
        if due and later:
            self.waiting.put(later)
        elif due:
            self.waiting.clear()
        ends = {name: self.steps.until(state) for name, state in known.items()}
        known = {name: state for name, state in known.items() if ends[name] is None or ends[name] > mark}
        if known:
            self.known.update((json.dumps(known),))
        else:
            self.known.clear()
        # With no row waiting, one wake-up clears all that is still known.
        last = [ends[name] for name in known if ends[name] is not None]
        _wake(self.handle, self.timer, min(first for first, _ in later) if later else max(last, default=None))
        yield pd.DataFrame({"event_doc": pd.Series([json.dumps(o) for o in out], dtype=object)})

    def close(self) -> None:
        pass


class Steps:
    """What is done with the rows of a key, in order."""

    def place(self, row: dict) -> tuple:
        """The place of a row among those of its key."""
        raise NotImplementedError

    def take(self, key: dict, state, rows: list[dict], out: list[dict]):
        """The state after ``rows``; results go to ``out``."""
        raise NotImplementedError

    def until(self, state) -> int | None:
        """Event time in ms after which ``state`` is as good as none; None: never."""
        return None


def in_order(
    events: DataFrame, keys: list[str], at: Column, row: list[str], steps: Steps, result: str, delay: str, ends: DataFrame | None = None
) -> DataFrame:
    """``result`` rows of ``steps`` over the rows of each key, in event order up to the watermark.

    ``ends`` is a stream (end) that gets the time of the last event when no more will come: then the watermark passes it.
    """
    use_rocksdb(events.sparkSession)
    # A first watermark is 0, and what is not after it is late: one millisecond more keeps an event of second 0 of a clock.
    at = at + F.expr("INTERVAL 1 MILLISECOND")
    rows = events.select(
        F.to_json(F.struct(*keys)).alias("event_key"), at.alias("event_ts"), F.unix_millis(at).alias("event_ms"), F.to_json(F.struct(*row)).alias("event_doc")
    ).filter("event_ts IS NOT NULL")
    if ends is not None:
        end = F.col("end") + F.expr("INTERVAL 1 MILLISECOND") + F.expr(f"INTERVAL {delay}")
        rows = rows.unionByName(ends.filter("end IS NOT NULL").select(F.lit(END).alias("event_key"), end.alias("event_ts"), F.unix_millis(end).alias("event_ms"), F.lit(END).alias("event_doc")))
    rows = rows.withWatermark("event_ts", delay)
    out = rows.select(_shard(), "*").groupBy("event_shard").transformWithStateInPandas(OrderedProcessor(steps), "event_doc string", "Append", "EventTime")
    return out.select(F.from_json("event_doc", result).alias("r")).select("r.*")


class Throttle(Steps):
    """Accept an event when ``gap`` seconds have passed since the last accepted one of the key; forgotten ``gap`` after it."""

    def __init__(self, at: str, event_id: str, gap: int):
        self.at, self.event_id, self.gap = at, event_id, gap

    def place(self, row: dict) -> tuple:
        return row[self.at], row[self.event_id]

    def take(self, key, state, rows, out):
        for row in rows:
            if state is None or row[self.at] - state >= self.gap:
                state = row[self.at]
                out.append({**key, self.at: state, self.event_id: row[self.event_id]})
        return state

    def until(self, state) -> int | None:
        return (state + self.gap) * 1000


def stream_throttle(events: DataFrame, keys: list[str], at: str, event_id: str, gap: int, delay: str = "10 minutes") -> DataFrame:
    """Streaming twin of ``throttle``: upload dedup and trigger cooldowns."""
    cols = [*keys, at, event_id]
    result = ", ".join(f"{c} {events.schema[c].dataType.simpleString()}" for c in cols)
    return in_order(events, keys, F.timestamp_seconds(F.col(at)), [at, event_id], Throttle(at, event_id, gap), result, delay)


def stream_dedup(uploads: DataFrame, ttl_s: int = 1800, approx: bool = False, delay: str = "10 minutes") -> DataFrame:
    """Drop repeats of (file, learner) within the TTL of the last processed one.

    ``approx`` uses the built-in watermark dedup, which may hold a key longer than the TTL.
    """
    keys = ["learner_id", "file_hash"]
    if approx:
        timed = uploads.withColumn("event_time", F.timestamp_seconds("at_s")).withWatermark("event_time", f"{ttl_s} seconds")
        return timed.dropDuplicatesWithinWatermark(keys).drop("event_time")
    return stream_throttle(uploads, keys, "at_s", "upload_id", ttl_s, delay)


class Triggers(Steps):
    """Practice and exam triggers of one learner.

    State: counts and missed answers of each point, weak points of each subject, the last firing times, and the points of the last
    ``book`` misses where the book is bounded. An answer changes one point and the count of its subject.
    """

    def __init__(self, book: int | None = None, practice_gap: int = 21600, exam_gap: int = 86400, weak_needed: int = 3):
        self.book, self.practice_gap, self.exam_gap, self.weak_needed = book, practice_gap, exam_gap, weak_needed

    def place(self, row: dict) -> tuple:
        return row["us"], row["answer_id"]

    @staticmethod
    def _weak(point: list[int]) -> bool:
        total, right, half, _ = point
        return bool(total) and round((right + 0.5 * half) / total, 2) < 0.6

    def take(self, key, state, rows, out):
        state = state or {"points": {}, "weak": {}, "fired": {}, "misses": []}
        points, weak, fired, misses = (state[n] for n in ("points", "weak", "fired", "misses"))

        def fire(kind: str, target: str | None, slot: str, gap: int, row: dict) -> None:
            if slot not in fired or row["at_s"] - fired[slot] >= gap:
                fired[slot] = row["at_s"]
                out.append({**key, "trigger": kind, "target": target, "at_s": row["at_s"], "answer_id": row["answer_id"]})

        for row in rows:
            kp, score = row.get("kp_id"), row.get("score")
            # A missing point is a point like any other, of no subject.
            name, subject = ("n", "n") if kp is None else (f"p{kp}", f"p{kp.split('/')[0]}")
            point = points.setdefault(name, [0, 0, 0, 0])
            before = self._weak(point)
            point[0] += 1
            if score is not None:
                point[1] += score >= 1
                point[2] += 0 < score < 1
            if score is not None and score < 0.5:
                again = point[3] > 0 if self.book is None else name in misses[-(self.book - 1):] and self.book > 1
                if again:
                    fire("practice", kp, f"practice|{name}", self.practice_gap, row)
                point[3] += 1
                if self.book is not None:
                    misses.append(name)
                    del misses[: -self.book]
            weak[subject] = weak.get(subject, 0) + self._weak(point) - before
            if weak[subject] >= self.weak_needed:
                fire("exam", None, "exam", self.exam_gap, row)
        return state


def stream_triggers(answers: DataFrame, delay: str = "1 hour", ends: DataFrame | None = None, **limits: int | None) -> DataFrame:
    """Practice sets and drill exams started by a stream of answers; with ``ends`` (see ``in_order``) up to its last."""
    ts = F.col("ts").cast("timestamp")
    rows = answers.select("learner_id", "answer_id", "kp_id", "score", "ts", F.unix_seconds(ts).alias("at_s"), F.unix_micros(ts).alias("us"))
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("learner_id", "answer_id")}
    result = f"learner_id {kinds['learner_id']}, trigger string, target string, at_s long, answer_id {kinds['answer_id']}"
    return in_order(rows, ["learner_id"], ts, ["answer_id", "kp_id", "score", "at_s", "us"], Triggers(**limits), result, delay, ends)


class OutageProcessor(StatefulProcessor):
    """Failures of a backend in a row: one event when the circuit opens, one when it closes."""

    def __init__(self, threshold: int = 3):
        self.threshold = threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.failures = handle.getValueState("failures", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = _ordered(rows, ["at_s", "call_id"])
        n = self.failures.get()[0] if self.failures.exists() else 0
        out = []
        for at, ok in zip(pdf["at_s"].tolist(), pdf["ok"].tolist()):
            if ok:
                if n >= self.threshold:
                    out.append((key[0], "closed", at))
                n = 0
            else:
                n += 1
                if n == self.threshold:
                    out.append((key[0], "opened", at))
        self.failures.update((n,))
        yield pd.DataFrame(out, columns=["backend", "change", "at_s"])

    def close(self) -> None:
        pass


def stream_outages(calls: DataFrame, threshold: int = 3) -> DataFrame:
    use_rocksdb(calls.sparkSession)
    rows = calls.select("backend", "call_id", "at_s", "ok")
    return rows.groupBy("backend").transformWithStateInPandas(
        OutageProcessor(threshold), "backend long, change string, at_s long", "Append", "None"
    )


class Guards(Steps):
    """Session guards of one learner; state is the last creation and the live sessions, forgotten when the last one has expired."""

    def __init__(self, ttl_s: int):
        self.ttl_s = ttl_s

    def place(self, row: dict) -> tuple:
        return row["at_s"], row["attempt_id"]

    def take(self, key, state, rows, out):
        guards = GuardState(self.ttl_s)
        if state:
            guards.last, guards.live = state["last"], [tuple(s) for s in state["live"]]
        for row in rows:
            if guards.offer(row["at_s"], row["guard_title"], row.get("source"), row["bypass"], row.get("left_s")):
                out.append({**key, **{c: v for c, v in row.items() if c not in ("guard_title", "bypass", "left_s")}})
        return {"last": guards.last, "live": guards.live}

    def until(self, state) -> int | None:
        return None if state["last"] is None else (state["last"] + max(self.ttl_s, GuardState(self.ttl_s).cooldown) + 1) * 1000


def stream_guarded_sessions(attempts: DataFrame, ttl_s: int, delay: str = "10 minutes") -> DataFrame:
    """Attempts that pass the guards, as ``guarded_sessions`` finds them."""
    cols = ["learner_id", "attempt_id", "at_s", "title", "source"]
    result = ", ".join(f"{c} {attempts.schema[c].dataType.simpleString()}" for c in cols)
    seen = guard_rows(attempts.withColumn("attempt_id", F.struct("attempt_id", "title")))
    rows = seen.select("learner_id", "at_s", "source", "bypass", "left_s", F.col("title").alias("guard_title"), "attempt_id.attempt_id", "attempt_id.title")
    return in_order(rows, ["learner_id"], F.timestamp_seconds("at_s"), [*cols[1:], "guard_title", "bypass", "left_s"], Guards(ttl_s), result, delay)


def _to_bytes(rows: pa.RecordBatch | pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as out:
        out.write(rows)
    return sink.getvalue().to_pybytes()


def _from_bytes(pack: bytes) -> pa.Table:
    return pa.ipc.open_stream(pack).read_all()


def _last(rows: pa.Table, by: list[str]) -> pa.Table:
    """The last row of each key, in the order of ``by``."""
    # As in SQL, a missing id is before all others.
    order = pc.sort_indices(rows, sort_keys=[(c, "ascending") for c in by], null_placement="at_start")
    rows = rows.take(order).combine_chunks()
    names = pc.dictionary_encode(rows["event_key"], null_encoding="encode").combine_chunks()
    last = np.zeros(len(names.dictionary), dtype=np.int64)
    last[names.indices.to_numpy()] = np.arange(len(rows))
    return rows if len(last) == len(rows) else rows.take(pa.array(np.sort(last))).combine_chunks()


def _pack(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    """One row per shard: its latest time, and the last rows of its keys."""
    rows = _last(pa.Table.from_batches(held), ["event_shard", "event_us", "event_id"])
    shards, (batch,) = rows["event_shard"].to_numpy(), rows.drop_columns("event_shard").to_batches()
    starts = np.flatnonzero(np.diff(shards, prepend=-1))
    ends = np.append(starts[1:], len(shards))
    packs = [_to_bytes(batch.slice(a, b - a)) for a, b in zip(starts.tolist(), ends.tolist())]
    latest = batch["event_us"].take(pa.array(ends - 1)).cast(pa.timestamp("us", tz="UTC"))
    return pa.RecordBatch.from_arrays([pa.array(shards[starts]), latest, pa.array(packs, pa.binary())], ["event_shard", "event_ts", "event_pack"])


def _packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= PACK_ROWS:
            yield _pack(held)
            held, n = [], 0
    if held:
        yield _pack(held)


class DeadlineProcessor(StatefulProcessor):
    """Emit a key that stays in an open stage past its deadline (event time).

    Serves both ingests stuck in processing and sessions that expire. State is the deadlines of a shard's open keys, in Arrow's
    format, and the time of its timer.
    """

    def __init__(self, after_ms: int):
        self.after_ms = after_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "ms long, due binary")

    def _keep(self, due: pa.Table, timer: int | None) -> None:
        """Keep the deadlines, and let the shard's only timer, now at ``timer``, fire at the first of them."""
        first = pc.min(due["deadline_ms"]).as_py()
        if timer is not None and timer != first:
            self.handle.deleteTimer(timer)
        if first is None:
            self.open.clear()
            return
        if timer != first:
            self.handle.registerTimer(first)
        self.open.update((first, _to_bytes(due)))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        packs = [_from_bytes(pack) for pdf in rows for pack in pdf["event_pack"]]
        last = _last(pa.concat_tables(packs), ["event_us", "event_id"])
        opened = last.filter(last["open"])
        ms = np.floor_divide(opened["event_us"].to_numpy(), 1000) + self.after_ms
        due = pa.table({"event_key": opened["event_key"], "deadline_ms": pa.array(ms, pa.int64())})
        known = self.open.get()
        if known:
            before = _from_bytes(known[1])
            gone = pc.is_in(before["event_key"], value_set=last["event_key"])
            due = pa.concat_tables([before.filter(pc.invert(gone)), due]).combine_chunks()
        if known or len(due):
            self._keep(due, known[0] if known else None)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = _from_bytes(self.open.get()[1])
        over = pc.less_equal(due["deadline_ms"], timerValues.getCurrentWatermarkInMs())
        self._keep(due.filter(pc.invert(over)), None)
        # Arrow's types keep large keys exact beside missing ones; Spark takes them in one chunk.
        yield due.filter(over).combine_chunks().to_pandas(types_mapper=pd.ArrowDtype)

    def close(self) -> None:
        pass


def stream_deadlines(
    stages: DataFrame, key: str, open_stages: list[str], after_s: int, delay: str = "10 minutes"
) -> DataFrame:
    """Keys whose latest stage is still open ``after_s`` seconds of event time later.

    Rows are packed by shard before they are dealt out, as Python takes the input of a state row by row. A pack is late when all
    its rows are; late rows of another one are judged.
    """
    use_rocksdb(stages.sparkSession)
    rows = stages.select(
        F.col(key).alias("event_key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("event_us"), "event_id",
        F.coalesce(F.col("stage").isin(open_stages), F.lit(False)).alias("open"),
    ).filter("event_us IS NOT NULL").select(_shard(), "*")
    packs = rows.mapInArrow(_packs, "event_shard int, event_ts timestamp, event_pack binary").withWatermark("event_ts", delay)
    out = packs.groupBy("event_shard").transformWithStateInPandas(
        DeadlineProcessor(after_s * 1000), f"event_key {stages.schema[key].dataType.simpleString()}, deadline_ms long", "Append", "EventTime"
    )
    return out.withColumnRenamed("event_key", key)
