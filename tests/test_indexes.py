"""Stored vector and lexical indexes against scans of everything."""

import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from studylake.catalog import QUERIES, load_all
from studylake.operators import lexical_index as L
from studylake.operators import retrieval as V
from studylake.operators import vector_index as I
from studylake.plans.ingest import context
from studylake.sources.tables import load
from tests.conftest import SF, rows

load_all()


def frame(spark, matrix, key, start=0):
    return spark.createDataFrame([(start + i, x.tolist()) for i, x in enumerate(matrix)], f"{key} long, embedding array<double>")


@pytest.fixture(scope="module")
def clustered(spark, tmp_path_factory):
    """6,000 vectors about 60 centres, a third of them about one; 80 queries near the rest and that one."""
    r = np.random.default_rng(1)
    centres = r.normal(size=(60, 12))
    of = np.where(np.arange(6000) % 3 == 0, 0, r.integers(0, 60, 6000))
    vectors = centres[of] + 0.15 * r.normal(size=(6000, 12))
    queries = centres[r.integers(0, 60, 80)] + 0.15 * r.normal(size=(80, 12))
    path = str(tmp_path_factory.mktemp("ivf"))
    I.build(frame(spark, vectors, "chunk_id"), path)
    return frame(spark, vectors, "chunk_id"), frame(spark, queries, "query_id", 9000), path


def test_recall_and_cells_read(spark, clustered):
    vectors, queries, path = clustered
    exact = V.vector_topk(queries, vectors, 10)
    found = I.search(queries, path, 10)
    hits = V.recall(found, exact).agg(F.sum("found"), F.sum("k")).first()
    assert hits[0] / hits[1] >= 0.9
    one = I.search(queries.filter("query_id = 9003"), path, 10)
    cells = len([d for d in os.listdir(f"{path}/vectors") if d.startswith("cell=")])
    scan = re.search(r"PartitionFilters: \[.*?cell#\d+ IN \(([\d,]+)\)", one._jdf.queryExecution().toString())
    assert len(scan[1].split(",")) < cells / 2
    # The same answer alone and in a batch.
    assert rows(one) == rows(found.filter("query_id = 9003"))


def test_certain_is_exact(spark, clustered, monkeypatch):
    monkeypatch.setattr(I, "BLOCK", 300)
    vectors, queries, path = clustered
    assert rows(I.nearest(queries, path, 10)) == rows(V.vector_topk(queries, vectors, 10))
    # Few stored: all of them, from however many cells.
    assert I.nearest(queries.limit(2), path, 6500).count() == 12000


def test_awkward_vectors(spark, tmp_path):
    bad = [(1, None), (2, []), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 0.0]), (None, [1.0, 1.0]), (6, [1.0, 2.0, 3.0])]
    good = [(10 + i, [float(i % 3), 1.0]) for i in range(9)]
    path = str(tmp_path / "a")
    I.build(spark.createDataFrame(bad + good, "chunk_id long, embedding array<double>"), path)
    asked = spark.createDataFrame([(1, [0.0, 1.0]), (2, None), (3, [1.0]), (None, [0.0, 1.0]), (4, [0.0, 1.0])], "query_id long, embedding array<double>")
    want = [(q, c, 0.0, n) for q in (1, 4) for n, c in enumerate((10, 13, 16), 1)]
    for of in (I.search, I.nearest):
        assert sorted(tuple(r) for r in of(asked, path, 3).select("query_id", "chunk_id", "distance", "rank").collect()) == want
    empty = str(tmp_path / "b")
    I.build(spark.createDataFrame([], "chunk_id long, embedding array<double>"), empty)
    assert I.search(asked, empty).collect() == [] and I.nearest(asked, empty).collect() == []
    assert I.search(asked.limit(0), path).collect() == [] and I.nearest(asked.limit(0), path).collect() == []


@pytest.fixture(scope="module")
def texts(spark, tmp_path_factory):
    r = random.Random(2)
    words = [f"w{i}" for i in range(400)]
    weight = [1 / (i + 1) for i in range(400)]
    docs = [(i, "the " + " ".join(r.choices(words, weight, k=r.randrange(1, 60)))) for i in range(900)]
    docs += [(900 + i, "the hot copy w399") for i in range(450)] + [(2000, None), (2001, ""), (None, "w1 w2"), (2002, "，。"), (-5, "w7 W7 w7")]
    df = spark.createDataFrame(docs, "chunk_id long, text string")
    path = str(tmp_path_factory.mktemp("bm25"))
    L.build(df.repartition(3), path)
    asked = [(1, "w399"), (2, "the w3 w50"), (3, "W7"), (4, "unknown"), (5, None), (6, " ".join(words[:80])), (7, "the")]
    return df.filter("chunk_id IS NOT NULL"), spark.createDataFrame(asked, "query_id long, text string"), path


@pytest.mark.parametrize("k, first", [(10, 8), (1, 1), (600, 2)])
def test_pruned_equals_scan(spark, texts, k, first):
    docs, asked, path = texts
    assert rows(L.search(asked, path, k, first=first)) == rows(V.bm25_topk(asked, docs, k))


def test_blocks_are_pruned(spark, texts):
    """A rare word's documents are few blocks; most blocks of a frequent one cannot reach the threshold."""
    docs, asked, path = texts
    seen = []

    def spy(blocks, *rest):
        seen.append(blocks.count())
        return scored(blocks, *rest)

    scored, L._scored = L._scored, spy
    try:
        L.search(asked.filter("query_id = 2"), path, 3, first=4).collect()
    finally:
        L._scored = scored
    assert seen[0] == 4 and seen[0] + seen[1] < 15 < 1350 / L.BLOCK


def test_empty_text_index(spark, tmp_path):
    path = str(tmp_path / "w")
    L.build(spark.createDataFrame([], "chunk_id long, text string"), path)
    assert L.search(spark.createDataFrame([(1, "a")], "query_id long, text string"), path).collect() == []


def test_ann_query_finds_every_neighbour(spark):
    """At a size where the fitted probes miss neighbours of a query, the query still returns all ten, and its recall says so."""
    found = QUERIES["t04_vector_topk_ann"](spark, SF)
    exact = V.vector_topk(V.profile_vectors(load(spark, SF, "embeddings")), load(spark, SF, "embeddings").withColumnRenamed("vec_id", "chunk_id"), 10)
    assert rows(found.select("query_id", "chunk_id", "rank")) == rows(exact.select("query_id", "chunk_id", "rank"))
    assert found.filter("found < k OR k < 10").count() == 0


def test_joined_words_stay_with_their_document(spark, texts, monkeypatch):
    """Any number of blocks of queries scores as the scan does, and only texts are dealt out, by id: no postings, no pairs."""
    docs, asked, _ = texts
    want = rows(V.bm25_topk(asked, docs, 10))
    for most in (V.MAX_WORDS, 9):
        monkeypatch.setattr(V, "MAX_WORDS", most)
        joined = V.bm25_topk(asked, docs, 10, max_cells=0)
        assert rows(joined) == want
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(chunk_id" in plan and not re.search(r"hashpartitioning\((chunk_id#\d+L?, term|query_id#\d+L?, chunk_id)", plan)


def test_postings_are_scored_in_their_block(spark, texts):
    """Postings are dealt out by block, not by query and document, in building and in searching; no pair is moved before it is ranked."""
    docs, asked, path = texts
    found = L.search(asked, path, 10)
    assert rows(found) == rows(V.bm25_topk(asked, docs, 10))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(block" in plan and not re.search(r"hashpartitioning\((query_id#\d+L?, chunk_id|bucket#\d+, term#\d+, block)", plan)


def moved(spark, job):
    """Bytes that the stages of ``job`` shuffle, spill and write."""
    sc = spark.sparkContext
    bus, store = sc._jsc.sc().listenerBus(), sc._jsc.sc().statusStore()

    def total():
        bus.waitUntilEmpty(30_000)
        stages = store.stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
        stages = [stages.apply(i) for i in range(stages.size())]
        return {s.stageId(): s.shuffleWriteBytes() + s.diskBytesSpilled() + s.outputBytes() for s in stages}

    before = total()
    job()
    return sum(n for stage, n in total().items() if stage not in before)


def test_index_and_search_take_little_disk(spark, tmp_path):
    """Texts are not moved, and postings are places and counts: making and searching an index moves and writes less than twice the texts."""
    r = random.Random(3)
    words = [f"word{i}" for i in range(20_000)]
    weight = [1 / (i + 1) for i in range(len(words))]
    docs = [(i, " ".join(r.choices(words, weight, k=r.randrange(100, 500)))) for i in range(2500)]
    df = spark.createDataFrame(docs, "chunk_id long, text string").repartition(4)
    df.write.parquet(str(tmp_path / "docs"))
    df = spark.read.parquet(str(tmp_path / "docs"))
    asked = spark.createDataFrame([(i, docs[i][1][:300]) for i in range(30)], "query_id long, text string")
    path = str(tmp_path / "w")
    found = []
    size = moved(spark, lambda: (L.build(df, path), found.extend(rows(L.search(asked, path, 10)))))
    assert found == rows(V.bm25_topk(asked, df, 10))
    assert size < 2 * sum(len(text) for _, text in docs)


def test_any_number_of_segments_and_rounds(spark, tmp_path, monkeypatch):
    """Small segments, few (query, document) pairs at once and several rounds of queries change nothing; nor do ids and queries that come twice."""
    r = random.Random(4)
    words = [f"w{i}" for i in range(80)]
    docs = [(r.randrange(-400, 2**61) if i % 3 else i, " ".join(r.choices(words, k=r.randrange(0, 60)))) for i in range(700)]
    docs += [(6, "w1 w2 w3"), (6, "w1 w2 w3"), (7, " ".join(["w5"] * 40_000)), (8, " ".join(words * 3))]
    df = spark.createDataFrame(docs, "chunk_id long, text string").repartition(3)
    asked = [(i, " ".join(r.choices(words, k=1 + i % 9))) for i in range(25)] + [(0, "w1"), (0, "w1 w2"), (2**62, "w1 w2 w3"), (30, "unknown")]
    asked = spark.createDataFrame(asked, "query_id long, text string")
    want = rows(V.bm25_topk(asked, df, 10))
    for docs_, words_, pairs, sent, block in ((4096, 2_000_000, 1_000_000, 1_000_000, 64), (100, 700, 90, 70, 7)):
        for name, value in (("PART_DOCS", docs_), ("PART_WORDS", words_), ("PART_PAIRS", pairs), ("SENT", sent)):
            monkeypatch.setattr(L, name, value)
        path = str(tmp_path / f"w{block}")
        L.build(df, path, block)
        assert rows(L.search(asked, path, 10, first=1)) == want


def test_context_moves_no_texts(spark, texts, clustered):
    """Hits go to the chunks, whatever the size of these."""
    docs, asked, path = texts
    vectors, queries, near = clustered
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        hits = context(asked, queries, docs, vectors, words=path, near=near)
        plan = hits._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    top = plan[: plan.index("Window")]
    assert "BroadcastHashJoin" in top and "SortMergeJoin" not in top
    assert set(hits.columns) == {"query_id", "chunk_id", "score", "rank", "text"}
