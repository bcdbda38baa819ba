"""Two-decimal rounding of integer ratios.

A mastery level is ``round(x, 2)`` of a binary double, ties going to the even digit unless the
double itself lies off the tie.  Working on the integer numerator and denominator keeps that
exact: a tie is recognised in integers, and the side on which the double falls is read from an
error-free product (the float head and the rest of a double each multiply by 200 exactly).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _ratio2(num: str, den: str, div: str) -> str:
    q = f"((100 * ({num})) {div} ({den}))"
    r = f"((100 * ({num})) % ({den}))"
    d = f"(CAST(({num}) AS DOUBLE) / CAST(({den}) AS DOUBLE))"
    head = f"CAST(CAST({d} AS FLOAT) AS DOUBLE)"
    off = f"(({head} * 200 - (2 * {q} + 1)) + ({d} - {head}) * 200)"
    up = (
        f"CASE WHEN 2 * {r} > ({den}) THEN 1 WHEN 2 * {r} < ({den}) THEN 0 "
        f"WHEN {off} > 0 THEN 1 WHEN {off} < 0 THEN 0 ELSE {q} % 2 END"
    )
    return (
        f"(CASE WHEN ({den}) = 0 THEN CAST(0 AS DOUBLE) "
        f"ELSE CAST(({q} + {up}) AS DOUBLE) / CAST(100 AS DOUBLE) END)"
    )


def ratio2(num: str, den: str) -> Column:
    """``round(num / den, 2)`` for two integer SQL expressions; 0 where ``den`` is 0."""
    return F.expr(_ratio2(num, den, "div"))


def ratio2_oracle(num: str, den: str) -> str:
    """The same text for an engine that writes integer division as ``//``."""
    return _ratio2(num, den, "//")


def level(correct: str = "correct", partial: str = "partial", total: str = "total") -> Column:
    """Mastery level: a partial answer counts half."""
    return ratio2(f"2 * {correct} + {partial}", f"2 * {total}")


def level_oracle(correct: str = "correct", partial: str = "partial", total: str = "total") -> str:
    return ratio2_oracle(f"2 * {correct} + {partial}", f"2 * {total}")


def py_round(col: Column, digits: int) -> Column:
    """Round a measured double; used for distances and scores, where exact ties do not occur."""
    return F.round(col, digits)
