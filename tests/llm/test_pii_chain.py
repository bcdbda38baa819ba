"""Identifiers found in one round support patterns in the next."""

from studylake.llm import contextual_pii as C


def test_chain_through_a_pattern_without_seeds(spark):
    """Seeds teach "reach me on"; the looser numbers found there teach "my handset:", which no seed stands in."""
    rows = [(i, f"Please reach me on +1 (415) 555-{2000 + i} soon") for i in range(12)]
    rows += [(100 + i, f"Please reach me on (415) 555-{3000 + i} soon") for i in range(8)]
    rows += [(200 + i, f"my handset: (415) 555-{3000 + i}") for i in range(8)]
    rows += [(300, "my handset: (415) 555-4000"), (301, "order no. (415) 555-5000")]
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in C.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[300] == [("phone", 12, 26)] and got[301] == []
    assert all(got[i] for i, _ in rows if i < 300)
