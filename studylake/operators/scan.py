"""Running (prefix) aggregates that survive hot keys.

A window over ``partitionBy(key)`` puts a whole key into one task.  That is right for almost all
keys and wrong for the few that hold a large share of the rows.  ``by_heat`` therefore treats
the two kinds apart:

* cold keys take the ordinary window: one shuffle on the key;
* hot keys (more than ``hot_rows`` rows) are cut into time slices.  Each slice is aggregated with
  map-side combine, the few slice totals are prefix-scanned per key, and rows only ever meet the
  other rows of their own slice.  The result is the same because sum, count, max and min combine.
  ``prev_max`` is ``max`` over the rows before the current one (the previous value of anything
  that only grows).

Hot keys are found by one aggregation over the key column alone; they stay a DataFrame, sent to the
tasks up to ``BROADCAST_KEYS`` of them and joined by shuffle beyond.  Where there is no hot key, the
plan is just the window plan.  All joins are null-safe: a null key is a key like any other, and a row
without a time belongs to the first slice of its key, as nulls sort first.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOT_ROWS = 1_000_000
SLICE_SECONDS = 3600
BROADCAST_KEYS = 50_000

Agg = tuple[str, Column]


def null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """``left.join(right, keys, how)`` in which null keys match each other; the keys are the left ones."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & left[k].eqNullSafe(renamed[f"_right_{k}"])
    return left.join(renamed, same, how).drop(*[f"_right_{k}" for k in keys])

_FUNCS = {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min, "prev_max": F.max}
_UP_TO = {"prev_max": -1}


def _over(window, aggs: dict[str, Agg], prefix: str) -> list[Column]:
    return [
        _FUNCS[f](c).over(window.rowsBetween(Window.unboundedPreceding, _UP_TO.get(f, 0))).alias(prefix + n)
        for n, (f, c) in aggs.items()
    ]


class PlainScan:
    """Ordinary windows, for keys of moderate size."""

    sliced = False

    def __init__(self, order: Sequence[str]):
        self.order = list(order)

    def __call__(self, df: DataFrame, keys: Sequence[str], aggs: dict[str, Agg]) -> DataFrame:
        return df.select("*", *_over(Window.partitionBy(*keys).orderBy(*self.order), aggs, ""))


class SlicedScan:
    """Two-level scan: totals per slice, prefix over slices, windows inside a slice."""

    sliced = True

    def __init__(self, order: Sequence[str], slice_: Column):
        self.order = list(order)
        self.slice = slice_

    def __call__(self, df: DataFrame, keys: Sequence[str], aggs: dict[str, Agg]) -> DataFrame:
        df = df.withColumn("_slice", self.slice)
        at = [*keys, "_slice"]
        totals = df.groupBy(*at).agg(*[_FUNCS[f](c).alias(f"_t_{n}") for n, (f, c) in aggs.items()])
        earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
        merge = {**_FUNCS, "count": F.sum}
        before = totals.select(
            *at, *[merge[f](f"_t_{n}").over(earlier).alias(f"_b_{n}") for n, (f, _) in aggs.items()]
        )
        rows = df.select("*", *_over(Window.partitionBy(*at).orderBy(*self.order), aggs, "_l_"))
        out = null_safe(rows, before, at)
        for name, (func, _) in aggs.items():
            here, base = F.col(f"_l_{name}"), F.col(f"_b_{name}")
            if func in ("count", "sum"):
                value = F.when(base.isNull(), here).when(here.isNull(), base).otherwise(here + base)
            else:
                value = F.least(here, base) if func == "min" else F.greatest(here, base)
            out = out.withColumn(name, value)
        return out.drop("_slice", *[f"_{k}_{n}" for n in aggs for k in "lb"])


Scan = PlainScan | SlicedScan


def time_slice(ts: str, seconds: int = SLICE_SECONDS) -> Column:
    """Slice number of a timestamp."""
    return F.floor(F.unix_seconds(F.col(ts).cast("timestamp")) / seconds)


def clock_slice(at_s: str, seconds: int = SLICE_SECONDS) -> Column:
    """Slice number of an integer clock in seconds."""
    return F.floor(F.col(at_s) / seconds)


def hot_keys(df: DataFrame, keys: Sequence[str], hot_rows: int) -> DataFrame | None:
    """The keys of more than ``hot_rows`` rows, or None where there are none."""
    hot = df.groupBy(*keys).count().filter(F.col("count") > hot_rows).select(*keys).persist()
    found = hot.limit(BROADCAST_KEYS + 1).count()
    if not found:
        hot.unpersist()
        return None
    return F.broadcast(hot) if found <= BROADCAST_KEYS else hot


def by_heat(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    slice_: Column,
    body: Callable[[DataFrame, Scan], DataFrame],
    hot_rows: int | None = None,
) -> DataFrame:
    """Run ``body(rows, scan)`` over cold keys with plain windows and over hot keys in slices.

    ``body`` may scan by any key list that includes ``keys``: such a group is never larger than
    the key it belongs to.
    """
    hot = hot_keys(df, keys, HOT_ROWS if hot_rows is None else hot_rows)
    if hot is None:
        return body(df, PlainScan(order))
    cold = body(null_safe(df, hot, keys, "left_anti"), PlainScan(order))
    warm = body(null_safe(df, hot, keys, "left_semi"), SlicedScan(order, slice_))
    return cold.unionByName(warm)
