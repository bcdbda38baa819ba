"""Teaching sessions: guarded creation, expiry, lookup and task lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from studylake.functions.text import strip

# Guards of session creation and the life of a session, in seconds.
COOLDOWN_S = 30
MAX_PENDING = 5
TITLE_WINDOW_S = 300
SESSION_TTL_S = 48 * 3600


class GuardState:
    """What the guards remember of one learner: the last creation and the pending sessions (created, title, source, last second)."""

    def __init__(self, ttl: int, cooldown: int = COOLDOWN_S, max_pending: int = MAX_PENDING, window: int = TITLE_WINDOW_S):
        self.ttl, self.cooldown, self.max_pending, self.window = ttl, cooldown, max_pending, window
        self.last: int | None = None
        self.live: list[tuple[int, str, str, int]] = []

    def open_from(self) -> int | None:
        """Earliest time cooldown and the pending limit allow a creation; None: at once."""
        if self.last is None:
            return None
        at = self.last + self.cooldown
        if len(self.live) >= self.max_pending:
            at = max(at, sorted(s[3] for s in self.live)[len(self.live) - self.max_pending] + 1)
        return at

    def offer(self, at: int, title: str, source: str, bypass: bool = False, left: int | None = None) -> bool:
        """Whether a session is created; it stays pending until it expires or, at ``left``, is taken up or finished."""
        self.live = [s for s in self.live if at <= s[3]]
        if not bypass:
            free = self.open_from()
            if free is not None and at < free:
                return False
            if title and any(t == title and s == source and at - c < self.window for c, t, s, _ in self.live):
                return False
        self.last = at
        self.live.append((at, title, source, at + self.ttl if left is None else min(at + self.ttl, left - 1)))
        return True


def guard_title(title: Column) -> Column:
    """Title as the guards compare it: lower case, without blanks of any script around it."""
    return F.lower(strip(F.coalesce(title, F.lit(""))))


def thin_attempts(attempts: DataFrame, max_pending: int = MAX_PENDING) -> DataFrame:
    """Drop attempts that cannot succeed whatever came before.

    At most one session starts per learner and second, and at most ``max_pending`` titles can be
    blocked, so of the attempts of one second only the first of each (title, source) and of
    those the first ``max_pending + 1`` can matter.  A hot learner shrinks to a few rows a second.
    """
    norm = guard_rows(attempts)
    # An attempt without a time is never accepted.
    timed = norm.filter("at_s IS NOT NULL")
    first = timed.filter("NOT bypass").groupBy("learner_id", "at_s", "title", "source").agg(F.min(F.struct("attempt_id", "left_s")).alias("_a"))
    first = first.select("learner_id", "at_s", "title", "source", F.lit(False).alias("bypass"), "_a.attempt_id", "_a.left_s")
    # Untitled attempts are never blocked by title, so the first of them stands for all.
    order = Window.partitionBy("learner_id", "at_s").orderBy("attempt_id")
    thin = first.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= max_pending + 1).drop("_rn")
    given = "bypass" in {c.lower() for c in attempts.columns}
    return thin.unionByName(timed.filter("bypass").select(thin.columns)) if given else thin


def guard_rows(attempts: DataFrame) -> DataFrame:
    """Attempts as the guards see them: ``bypass`` (the learner asked for it, no guard holds) and ``left_s`` (when a session created by it is
    no longer pending) are read where the table has them."""
    names = {c.lower() for c in attempts.columns}
    bypass = F.coalesce(F.col("bypass"), F.lit(False)) if "bypass" in names else F.lit(False)
    left = F.col("left_s").cast("long") if "left_s" in names else F.lit(None).cast("long")
    return attempts.select(
        "attempt_id", "learner_id", F.col("at_s").cast("long").alias("at_s"), guard_title(F.col("title")).alias("title"), "source",
        bypass.alias("bypass"), left.alias("left_s"),
    )


def guarded_sessions(attempts: DataFrame, ttl_s: int = SESSION_TTL_S) -> DataFrame:
    """Attempts that pass the guards, in order, per learner.

    Partitions are sorted by learner and time and streamed through one fold, so memory does not
    grow with a learner; the fold jumps over attempts made before the guards reopen.
    """
    # Learners are compared by their text in Spark and travel as Arrow values, so nulls and large numbers stay exact.
    thin = thin_attempts(attempts).withColumn("_key", F.to_json(F.struct("learner_id")))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learner, state = None, GuardState(ttl_s)
        for batch in batches:
            names = batch.column("_key").to_numpy(zero_copy_only=False)
            at = batch.column("at_s").to_numpy()
            titles, sources, bypass, left = (batch.column(c).to_pylist() for c in ("title", "source", "bypass", "left_s"))
            always = np.append(np.flatnonzero(np.array(bypass, bool)), len(at))
            ends = np.append(np.flatnonzero(names[1:] != names[:-1]) + 1, len(names)) if len(names) else []
            taken, start = [], 0
            for end in ends:
                if names[start] != learner:
                    learner, state = names[start], GuardState(ttl_s)
                row = start
                while row < end:
                    if state.offer(int(at[row]), titles[row], sources[row], bypass[row], left[row]):
                        taken.append(row)
                    free = state.open_from()
                    row += 1
                    if free is not None and row < end and at[row] < free:
                        jump = row + int(np.searchsorted(at[row:end], free))
                        row = min(jump, int(always[np.searchsorted(always, row)]))
                start = end
            yield batch.take(pa.array(taken, pa.int64()))

    passed = thin.repartition("_key").sortWithinPartitions("_key", "at_s", "attempt_id").mapInArrow(fold, thin.schema)
    return passed.drop("_key", "bypass", "left_s")


def live(as_of: Column) -> Column:
    return F.col("status").isin("pending", "active") & (as_of <= F.col("expires_at"))


def expire_sessions(sessions: DataFrame, as_of: Column) -> DataFrame:
    """Open sessions past their expiry become expired."""
    stale = F.col("status").isin("pending", "active") & (as_of > F.col("expires_at"))
    return sessions.withColumn("status", F.when(stale, "expired").otherwise(F.col("status")))


def sessions_for(sessions: DataFrame, chat_ids: DataFrame, as_of: Column) -> DataFrame:
    """Latest live session of each wanted chat.  ``max_by`` keeps one row per chat map-side."""
    wanted = sessions.filter(live(as_of)).join(chat_ids, "chat_id", "left_semi")
    row = F.struct("session_id", "title", "source", "status", "created_at")
    latest = wanted.groupBy("chat_id").agg(F.max_by(row, F.struct("created_at", "session_id")).alias("s"))
    return latest.select("chat_id", "s.*")


# Readable names of task sources.
SOURCE_LABELS = {
    "wechat": "微信上传", "web_upload": "网页上传", "auto_generated": "AI出题", "webui": "网页上传", "child_practice": "练习",
}


def task_title() -> Column:
    """Title, else the file name, else source label and task type."""
    label = F.col("source")
    names = F.create_map(*[F.lit(x) for kv in SOURCE_LABELS.items() for x in kv])
    label = F.coalesce(F.try_element_at(names, F.col("source")), label)
    kind = F.coalesce(F.nullif(F.col("task_type"), F.lit("")), F.lit("task"))
    return F.coalesce(
        F.nullif(F.col("title"), F.lit("")), F.nullif(F.col("source_file"), F.lit("")), F.concat(label, F.lit("-"), kind)
    )


def pending_tasks(sessions: DataFrame, as_of: Column, limit: int = 20) -> DataFrame:
    """Newest open tasks per learner."""
    newest = Window.partitionBy("learner_id").orderBy(F.desc("created_at"), F.desc("session_id"))
    return (
        sessions.filter(live(as_of))
        .withColumn("rn", F.row_number().over(newest))
        .filter(F.col("rn") <= limit)
        .select("session_id", "learner_id", task_title().alias("title"), "status", "created_at", F.col("rn").cast("long").alias("rn"))
    )
