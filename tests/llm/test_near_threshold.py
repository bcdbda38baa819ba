"""The pipeline's near_dedup stage links from 0.8 on, and the filters of near_duplicates follow per_cent."""

import pytest

import corpus_pipeline as P
from studylake.llm import minmax_dedup as M
from tests.llm.test_minmax_dedup import shingles


def text(n, swapped=()):
    words = [f"word{n}x{i}" for i in range(60)]
    for i in swapped:
        words[i] = f"other{n}x{i}"
    return " ".join(words)


def test_stage_drops_copies_under_85(spark, sf):
    rows = []
    for n in range(20):
        rows += [(2 * n, text(n), "en", None, None), (2 * n + 1, text(n, [30]), "en", None, None)]
    rows += [(100, text(99), "en", None, None), (101, text(99, [20, 40]), "en", None, None)]
    x, y, z = shingles(text(0)), shingles(text(0, [30])), shingles(text(0, [20, 40]))
    assert 80 <= 100 * len(x & y) / len(x | y) < 85 and 100 * len(x & z) < 80 * len(x | z)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in P.near_dedup(spark, docs, sf).collect()} == {2 * n for n in range(20)} | {100, 101}


def test_least_estimate_follows_the_threshold():
    assert abs(M.least_estimate(85) - 0.63) < 0.002 and 0.55 < M.least_estimate(80) < 0.56


@pytest.mark.parametrize("per_cent", [0, 79, 101])
def test_thresholds_out_of_reach_are_refused(spark, per_cent):
    with pytest.raises(ValueError):
        M.near_duplicates(spark.createDataFrame([], "doc_id long, text string"), per_cent=per_cent)
