import math

import numpy as np
import pytest

from studylake.llm import pivot_dedup as P
from tests.llm.helpers import empty

SCHEMA = "vec_id long, embedding array<float>, label int, near string"


def brute(rows, least=0.93):
    ok = [i for i, (v, e, lab, _) in enumerate(rows) if v is not None and lab is not None and P.valid(e)]
    links = {i: set() for i in range(len(rows))}
    for i in ok:
        for j in ok:
            a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
            if i != j and rows[i][2] == rows[j][2] and len(a) == len(b) and a @ b / math.sqrt((a @ a) * (b @ b)) >= least:
                links[i].add(j)
    low = {i: rows[i][0] for i in links}
    changed = True
    while changed:
        changed = False
        for i in links:
            for j in links[i]:
                if low[j] < low[i]:
                    low[i], changed = low[j], True
    return sorted((rows[i][0], len(links[i]), low[i]) for i in links if rows[i][0] is not None)


def vectors(n, dims=16, seed=0):
    r = np.random.default_rng(seed)
    centre = r.normal(size=(n // 4, dims))
    return [(int(i), [float(x) for x in np.float32(centre[i % len(centre)] + 0.08 * r.normal(size=dims) * (i // len(centre)))], int(i % 2), "x") for i in range(n)]


@pytest.mark.parametrize("block", [512, 3])
def test_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(P, "BLOCK", block)
    rows = vectors(60)
    rows += [(100 + i, rows[3][1], 1, None) for i in range(8)]  # copies
    rows += [(200, None, 1, None), (201, [], 1, None), (202, [0.0] * 16, 1, None), (203, [float("nan")] * 16, 1, None), (204, [None] * 16, 1, None)]
    rows += [(205, rows[3][1], None, None), (206, [1.0, 2.0], 1, None), (207, [2.0, 4.0], 1, None), (208, [x * 3 for x in rows[3][1]], 1, None), (None, rows[3][1], 1, None)]
    got = P.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got if r.vec_id is not None) == brute(rows)
    assert [(r.n_links, r.component_id, r.kept) for r in got if r.vec_id is None] == [(0, None, True)]


def test_empty(spark):
    assert P.near_duplicates(empty(spark, SCHEMA)).collect() == []


def test_recall_at_the_threshold(spark):
    """Pairs of cosine 0.93 to 0.95 in 64 dimensions: at least nine in ten are found, none below."""
    r = np.random.default_rng(4)
    rows = []
    for i in range(400):
        x, z = r.normal(size=64), r.normal(size=64)
        x /= np.linalg.norm(x)
        z -= (z @ x) * x
        c = 0.931 + 0.02 * r.random()
        y = c * x + math.sqrt(1 - c * c) * z / np.linalg.norm(z)
        rows += [(2 * i, x.tolist(), 0, None), (2 * i + 1, y.tolist(), 0, None)]
    rows += [(1000 + i, r.normal(size=64).tolist(), 0, None) for i in range(1500)]
    got = P.near_duplicates(spark.createDataFrame(rows, SCHEMA)).where("n_links > 0").collect()
    assert len(got) >= 0.9 * 800 and all(r.vec_id < 800 and r.component_id == r.vec_id // 2 * 2 for r in got)


def test_a_third_are_near_copies(spark):
    """A dense group must not take the pivots: each of its vectors is linked with all others."""
    r = np.random.default_rng(9)
    centre = r.normal(size=32)
    rows = [(i, (centre + 0.05 * r.normal(size=32)).tolist(), 0, None) for i in range(300)]
    rows += [(1000 + i, r.normal(size=32).tolist(), 0, None) for i in range(600)]
    got = {v.vec_id: (v.n_links, v.component_id) for v in P.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[i] == (299, 0) for i in range(300))
