"""Greedy throttles: accept an event only when ``gap`` has passed since the last accepted one.

Acceptance depends on earlier acceptances, so no single window expresses it.  Events of a key with
the same time collapse to the first id beforehand (later ones can never be accepted), with
map-side combine.

Keys of moderate size are streamed: partitioned by key, sorted by time, one pass with the next
acceptable row of every row found by binary search, so Python steps once per accepted event.

A hot key is cut into slices that Spark spreads.  A slice reacts to the past only through the moment
from which it may accept again, and that moment lies within ``gap`` of the slice start.  So:

1. every slice tabulates its answer to each possible entry moment (first acceptable row ->
   last accepted row), by pointer doubling over sorted times;
2. per key the tables are chained in slice order, carrying one number;
3. every slice marks its accepted rows from its now known entry moment.

A null key is a key like any other, in both forms; an event without a time is never accepted.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from studylake.operators.scan import null_safe

_NEVER = -(2**62)


def _next_row(at: np.ndarray, gap: int, strict: bool) -> np.ndarray:
    """Index of the first row that may follow each row; ``len(at)`` where there is none."""
    return np.searchsorted(at, at + gap, side="right" if strict else "left")


def _last_reached(nxt: np.ndarray) -> np.ndarray:
    """For each row the last row of the chain that starts there."""
    n = len(nxt)
    jump = np.append(np.where(nxt < n, nxt, np.arange(n)), n)
    while True:
        further = jump[jump]
        if np.array_equal(further, jump):
            return jump[:n]
        jump = further


def throttle(
    events: DataFrame,
    keys: Sequence[str],
    at: str,
    event_id: str,
    gap: int,
    sliced: bool = False,
    slice_width: int | None = None,
    strict: bool = False,
) -> DataFrame:
    """Accepted events (``keys``, ``at``, ``event_id``), at least ``gap`` apart per key.

    ``at`` is an integer clock.  ``strict`` asks for more than ``gap``.  ``sliced`` is for hot keys.
    """
    keys = list(keys)
    events = events.filter(F.col(at).isNotNull())
    first = events.groupBy(*keys, F.col(at).cast("long").alias("_at")).agg(F.min(event_id).alias("_id"))
    if sliced:
        picked = _in_slices(first, keys, gap, max(slice_width or 16 * gap, gap), strict)
    else:
        picked = _streamed(first, keys, gap, strict)
    return picked.withColumnsRenamed({"_at": at, "_id": event_id})


def _streamed(first: DataFrame, keys: list[str], gap: int, strict: bool) -> DataFrame:
    step = gap + (1 if strict else 0)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, free_from = None, _NEVER
        for batch in batches:
            if not batch.num_rows:
                continue
            times = batch.column("_at").to_numpy()
            names = batch.column("_key").to_numpy(zero_copy_only=False)
            fresh = np.append(False, names[1:] != names[:-1])
            run = np.cumsum(fresh)
            span = int(times.max() - times.min()) + step + 1
            place = run * span + (times - times.min())
            nxt = np.searchsorted(place, place + step)
            # A search may not leave the run: cap at the start of the next one.
            starts = np.append(np.flatnonzero(fresh), len(times))
            nxt = np.minimum(nxt, starts[run])
            row = 0
            if names[0] == open_key:
                row = min(int(np.searchsorted(times[: starts[0]], free_from)), int(starts[0]))
            picked = []
            while row < len(times):
                picked.append(row)
                row = int(nxt[row])
            last = [i for i in picked[-1:] if run[i] == run[-1]]
            if last:
                free_from = int(times[last[0]]) + step
            elif names[-1] != open_key:
                free_from = _NEVER
            open_key = names[-1]
            yield batch.take(pa.array(picked, pa.int64()))

    # Keys are compared by their text in Spark and travel as Arrow values, so nulls and large numbers stay exact.
    named = first.withColumn("_key", F.to_json(F.struct(*keys)))
    sorted_rows = named.repartition("_key").sortWithinPartitions("_key", "_at")
    return sorted_rows.mapInArrow(fold, named.schema).drop("_key")


def _in_slices(first: DataFrame, keys: list[str], gap: int, width: int, strict: bool) -> DataFrame:
    first = first.withColumn("_slice", F.floor(F.col("_at") / width).cast("long"))
    group = [*keys, "_slice"]
    key_fields = [first.schema[k] for k in keys]

    def tabulate(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_at")
        times = pdf["_at"].to_numpy()
        end = times[_last_reached(_next_row(times, gap, strict))]
        # Entry moments past the first ``gap`` of the slice cannot occur.
        start = int(pdf["_slice"].iloc[0]) * width
        reach = int(np.searchsorted(times, start + gap, side="right")) + 1
        times, end = times[:reach], end[:reach]
        keep = np.append(end[1:] != end[:-1], True)
        out = pd.DataFrame({"_entry": times[keep], "_end": end[keep]})
        for name in group:
            out.insert(0, name, pdf[name].iloc[0])
        return out

    long = T.LongType()
    table = first.groupBy(*group).applyInPandas(
        tabulate,
        T.StructType([*key_fields, T.StructField("_slice", long), T.StructField("_entry", long),
                      T.StructField("_end", long)]),
    )

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_slice", "_entry"])
        slices, starts = np.unique(pdf["_slice"].to_numpy(), return_index=True)
        entry, end = pdf["_entry"].to_numpy(), pdf["_end"].to_numpy()
        bounds = np.append(starts, len(entry))
        opens = np.empty(len(slices), dtype=np.int64)
        free_from = _NEVER
        for i in range(len(slices)):
            opens[i] = free_from
            lo, hi = bounds[i], bounds[i + 1]
            pos = lo + int(np.searchsorted(entry[lo:hi], free_from))
            if pos < hi:
                free_from = int(end[pos]) + gap + (1 if strict else 0)
        out = pd.DataFrame({"_slice": slices, "_open": opens})
        for name in reversed(keys):
            out.insert(0, name, pdf[name].iloc[0])
        return out

    opens = table.groupBy(*keys).applyInPandas(
        chain, T.StructType([*key_fields, T.StructField("_slice", long), T.StructField("_open", long)])
    )

    id_type = first.schema["_id"].dataType

    def mark(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_at")
        times = pdf["_at"].to_numpy()
        nxt = _next_row(times, gap, strict)
        picked = []
        row = int(np.searchsorted(times, int(pdf["_open"].iloc[0])))
        while row < len(times):
            picked.append(row)
            row = int(nxt[row])
        return pdf.iloc[picked][[*keys, "_at", "_id"]]

    return (
        null_safe(first, opens, group)
        .groupBy(*group)
        .applyInPandas(mark, T.StructType([*key_fields, T.StructField("_at", long), T.StructField("_id", id_type)]))
    )
