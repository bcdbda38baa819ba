"""Tree search against brute force."""

import math

import numpy as np
import pytest

from studylake.llm import means_tree as M
from studylake.llm.common import settings

SCHEMA = "vec_id long, embedding array<double>, label int, rank int, score string"


def brute(rows, asked, k=10):
    ok = {(i, tuple(v)) for i, v, *_ in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    out = {}
    for q in ok:
        if asked(q[0]):
            near = sorted((math.dist(v, q[1]), i) for i, v in ok if (i, v) != q and len(v) == len(q[1]))
            out[q[0]] = near[:k]
    return out


def search(spark, rows, k=10):
    settings(spark)
    df = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SCHEMA)
    found = {}
    for r in M.search(df, df.where("vec_id % 20 = 0"), k).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["score"], r["vec_id"]))
    return found


def test_recall_and_order(spark):
    r = np.random.default_rng(3)
    centres = r.normal(size=(40, 16))
    rows = [(i, (centres[i % 40] + 0.4 * r.normal(size=16)).tolist()) for i in range(6000)]
    found, want = search(spark, rows), brute(rows, lambda i: i % 20 == 0)
    assert set(found) == set(want)
    hits = total = 0
    for q, near in want.items():
        got = found[q]
        assert [n for n, *_ in got] == list(range(1, 11)) and [(s, v) for _, s, v in got] == sorted((s, v) for _, s, v in got)
        exact = dict((v, s) for s, v in near)
        assert all(abs(exact[v] - s) < 1e-12 for _, s, v in got if v in exact)
        hits += len({v for _, v in near} & {v for *_, v in got})
        total += 10
    assert hits / total >= 0.9


def test_fewer_candidates_and_awkward_rows(spark):
    """So few rows that all are compared: equal to brute force, with copies, ties, zero, null and non-finite vectors, two dimensions."""
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, -1.0]), (3, [1.0, 0.0]), (20, [1.0, 0.0]), (4, None), (5, []), (6, [0.0, -0.0]), (40, [nan, 1.0]), (7, [inf, 1.0]),
            (8, [None, 1.0]), (None, [1.0, 1.0]), (60, [3.0]), (9, [5.0]), (0, [1.0, 0.0]), (80, [1e200, 1e200]), (10, [2.0, 2.0, 2.0]), (100, [4.0, 4.0, 4.0, 4.0])]
    found, want = search(spark, rows), brute(rows, lambda i: i % 20 == 0)
    assert {q: [v for *_, v in near] for q, near in found.items()} == {q: [v for _, v in near] for q, near in want.items() if near}
    assert all(np.isclose([s for _, s, _ in found[q]], [s for s, _ in want[q]], rtol=1e-12).all() for q in (0, 20, 60))
    assert np.isfinite([s for _, s, _ in found[80]]).all()


@pytest.mark.parametrize("near", [False, True])
def test_one_vector_a_third(spark, near, monkeypatch):
    """A third of the rows are copies, or near copies, of one vector; blocks and parts so small that they are split."""
    monkeypatch.setattr(M, "BLOCK", 100)
    monkeypatch.setattr(M, "PART", 7)
    r = np.random.default_rng(4)
    hot = r.normal(size=8)
    rows = [(i, (hot + (1e-3 * r.normal(size=8) if near else 0) if i % 3 == 0 else r.normal(size=8)).tolist()) for i in range(1500)]
    found, want = search(spark, rows), brute(rows, lambda i: i % 20 == 0)
    hits = sum(len({v for _, v in w} & {v for *_, v in found[q]}) for q, w in want.items())
    assert all(len(f) == 10 for f in found.values()) and hits >= 9 * len(want)
    if not near:
        assert [v for *_, v in found[0]] == [3, 6, 9, 12, 15, 18, 21, 24, 27, 30] and [v for *_, v in found[60]][:2] == [0, 3]


def test_empty(spark):
    assert search(spark, []) == {}
    assert search(spark, [(0, None), (20, [0.0])]) == {}
    assert search(spark, [(0, [1.0, 2.0])]) == {}


def test_tree_covers_all_leaves():
    r = np.random.default_rng(5)
    rows = r.normal(size=(3000, 6))
    tree = M.Tree(rows)
    order = list(tree.best_first(rows[0]))
    assert sorted(order) == list(range(len(tree.leaf))) and order[0] == tree.leaves_of(rows[:1])[0]
