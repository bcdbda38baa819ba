"""Small tables with the awkward cases: nulls, empty and blank texts, long texts, copies, clashing columns."""

from __future__ import annotations

import random

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice("abcdefgh") for _ in range(n))


def edge_rows() -> list[tuple]:
    """(doc_id, text, extra ...): ids may be null or repeated."""
    long = prose(1, 60_000)
    return [
        (1, prose(2, 40)), (2, prose(2, 40)), (3, prose(2, 39) + " other"), (4, None), (5, ""), (6, " \t\n "), (7, "one two"), (8, "ONE  two"),
        (9, long), (10, long + " tail"), (None, prose(2, 40)), (1, prose(2, 40)), (11, "éß 你好 \U0001f600 12 34"), (12, "x" * 50_000), (None, None),
    ]


def edge(spark, clash: str = "n_chars int, score string"):
    """``edge_rows`` with extra columns, which may be named like outputs."""
    names = [c.split()[0] for c in clash.split(", ")]
    rows = [(*r, *[None] * len(names)) for r in edge_rows()]
    return spark.createDataFrame(rows, f"doc_id long, text string, {clash}")


def empty(spark, schema: str = "doc_id long, text string"):
    return spark.createDataFrame([], schema)
