import itertools
import random
import re

import pytest

from studylake.llm import minmax_dedup as M
from studylake.llm.common import components
from tests.llm.helpers import edge, edge_rows, empty, prose


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows, per_cent=85):
    """Expected (n_shingles, component) for rows whose ids are not null."""
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    reach = {i: {i} for i, _ in sets}
    for (a, x), (b, y) in itertools.combinations(sets, 2):
        if x and y and 100 * len(x & y) >= per_cent * len(x | y) and reach[a] is not reach[b]:
            both = reach[a] | reach[b]
            for i in both:
                reach[i] = both
    return sorted((i, len(s), min(reach[i])) for i, s in sets)


def check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = M.near_duplicates(df).where("doc_id IS NOT NULL").collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_edges(spark):
    check(spark, edge_rows())
    out = M.near_duplicates(edge(spark, "component_id string, digest int, bands string")).collect()
    assert len(out) == len(edge_rows()) and set(out[0].asDict()) == {"doc_id", "n_shingles", "component_id", "kept"}
    assert [(r.component_id, r.kept) for r in out if r.doc_id is None] == [(None, True)] * 2


def test_empty(spark):
    assert M.near_duplicates(empty(spark)).collect() == []


def test_edited_copies_in_chains(spark, monkeypatch):
    """Copies at every distance, and groups larger than a block, so that later rounds have work to do."""
    monkeypatch.setattr(M, "BLOCK", 4)
    r, rows = random.Random(5), []
    for group in range(6):
        words = prose(100 + group, 120).split()
        for copy in range(14):
            rows.append((len(rows) * 3 % 101, " ".join(words)))
            for _ in range(r.randrange(0, 4)):
                words[r.randrange(len(words))] = f"new{group}{copy}{r.random()}"
    check(spark, rows)


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, j) for j in range(101, 130)] + [(7, 7), (130, 99)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 1 for i in range(1, 41)} | {i: 100 for i in range(100, 130)} | {99: 99, 130: 99}
    assert got == want


@pytest.mark.parametrize("text, size", [("", 0), ("a", 1), ("a b c d e", 1), ("a b c d e f", 2), ("a a a a a a a", 1)])
def test_set_sizes(text, size):
    assert len(M.shingles(text.encode())) == size


def test_signature_estimates_similarity():
    import numpy as np

    r = np.random.default_rng(3)
    x = r.integers(0, 1 << 63, 2000, dtype=np.uint64)
    a, b = np.unique(x[:1850]), np.unique(x[150:])  # 1700 of 2000 shared
    same = [(M.signature(a * np.uint64(2 * k + 1)) == M.signature(b * np.uint64(2 * k + 1))).mean() for k in range(60)]
    assert abs(np.mean(same) - 0.85) < 0.02
