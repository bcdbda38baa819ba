"""Texts of some MB full of spans: found, masked and cut as by plain code, in time that grows with the text."""

import time

from pyspark.sql import functions as F

from studylake.llm import contextual_pii as C
from studylake.llm import decontaminate as D
from studylake.llm.common import settings
from tests.llm.test_contextual_pii import brute


def plain_mask(text, spans):
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], s[2], s[0])):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def test_identifiers_without_end(spark):
    settings(spark)
    long = " ".join(f"\U0001f600é user{i}@mail{i % 90}.example 10.0.{i % 256}.{i // 256 % 256} call {2000000 + i}," for i in range(70_000))
    assert len(long) > 3_500_000
    df = spark.createDataFrame([(1, long), (2, "a@b.cc"), (3, None)], "doc_id long, text string").repartition(3)
    start = time.time()
    found = C.find(df, keep_text=True).withColumn("masked", C.masked(F.col("text"), F.col("spans")))
    got = {r.doc_id: r for r in found.collect()}
    assert time.time() - start < 120
    base = [(s.kind, s.start, s.end) for s in got[1].base]
    assert base == brute(long) and len(base) == 140_000
    assert got[1].masked == plain_mask(long, [(s.kind, s.start, s.end) for s in got[1].spans])
    assert got[2].masked == "[EMAIL]" and got[3].masked is None


def test_overlapping_and_adjacent_masks(spark):
    text = "\U0001f600" * 200 + "abcdefghij" * 60
    cases = [[], [(0, 3)], [(0, 800)], [(5, 300), (10, 20), (300, 301), (301, 400)], [(250, 260), (255, 700), (600, 650), (700, 800)], [(799, 800)]]
    rows = [(i, text, [("ip" if a % 2 else "email", a, b) for a, b in spans]) for i, spans in enumerate(cases)]
    df = spark.createDataFrame(rows, "i int, text string, spans array<struct<kind: string, start: bigint, end: bigint>>")
    got = {r.i: r for r in df.withColumn("m", C.masked(F.col("text"), F.col("spans"))).collect()}
    for i, _, spans in rows:
        assert got[i].m == plain_mask(text, spans)


def test_cut_passages(spark):
    text = "0123456789" * 500
    cases = [[], [(0, 5000)], [(0, 10), (10, 20), (4990, 5000)], [(250, 260), (511, 513)]]
    df = spark.createDataFrame([(i, text, s) for i, s in enumerate(cases)] + [(9, None, None)], "i int, text string, spans array<struct<start: bigint, end: bigint>>")
    got = {r.i: r.text for r in D.without_spans(df).collect()}
    for i, spans in enumerate(cases):
        kept = [c for at, c in enumerate(text) if not any(a <= at < b for a, b in spans)]
        assert got[i] == "".join(kept)
    assert got[9] is None
