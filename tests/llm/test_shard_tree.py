import zlib

from pyspark.sql import functions as F

from studylake.llm import shard_tree as S
from tests.llm.helpers import edge, edge_rows, empty


def test_edges_and_slots(spark):
    df = edge(spark, "shard string, slot string")
    got = S.with_slots(S.placed(df, S.tree_of(8)), "doc_id", ["doc_id", "text"], buckets=4).collect()
    assert len(got) == len(edge_rows())
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(slots) == list(range(len(slots))) for slots in by.values())
    assert len({r.shard for r in got if r.doc_id is None}) == 1
    assert S.with_slots(S.placed(empty(spark), S.tree_of(8)), "doc_id", ["doc_id"]).collect() == []


def test_growth_moves_rows_into_the_new_shard_only(spark):
    ids = spark.range(20_000)
    for n in (8, 9, 12):
        both = ids.select(S.shard_of(F.col("id"), S.tree_of(n)).alias("a"), S.shard_of(F.col("id"), S.tree_of(n + 1)).alias("b"))
        moved = both.where("a <> b").groupBy("b").count().collect()
        assert [r.b for r in moved] == [n] and 0.8 * 20_000 / (n + 1) < moved[0]["count"] < 1.2 * 20_000 / (n + 1)


def test_weights(spark):
    """Shares follow weights; a change inside a rack moves nothing outside it."""
    tree = [S.Leaf(0, "a", "x", 1.0), S.Leaf(1, "a", "x", 1.0), S.Leaf(2, "a", "y", 2.0), S.Leaf(3, "b", "z", 4.0)]
    swapped = [S.Leaf(0, "a", "x", 0.5), S.Leaf(1, "a", "x", 1.5), *tree[2:]]
    got = spark.range(16_000).select(S.shard_of(F.col("id"), tree).alias("a"), S.shard_of(F.col("id"), swapped).alias("b")).groupBy("a", "b").count().collect()
    share = {s: sum(r["count"] for r in got if r.a == s) / 16_000 for s in range(4)}
    assert all(abs(share[s] - w) < 0.02 for s, w in ((0, 0.125), (1, 0.125), (2, 0.25), (3, 0.5)))
    assert {(r.a, r.b) for r in got if r.a != r.b} == {(0, 1)}


def test_query_digests(spark, sf):
    from studylake.llm.queries import QUERIES

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in QUERIES["op6_hash_tree_shards"](spark, sf).collect():
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 1, zlib.crc32(raw)) and r.grown_shard in (r.shard, 8)
