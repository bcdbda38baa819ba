import re

import pytest

from studylake.llm import decontaminate as D
from tests.llm.helpers import edge, edge_rows, empty, prose


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, items):
    doc, hit, found = words(text), set(), set()
    for item, value in items:
        own = words(value)
        n = min(10, len(own))
        for i in range(len(own) - n + 1 if own else 0):
            for j in range(len(doc) - n + 1):
                if doc[j : j + n] == own[i : i + n]:
                    hit |= set(range(j, j + n))
                    found.add(str(item))
    return len(doc), len(hit), sorted(found)


ITEMS = [(1, prose(2, 40)), (2, "One, TWO"), (3, None), (4, ""), (5, prose(9, 12)), (5, prose(9, 12)), (6, "你好 12"), (7, "kappaa " * 30)]


@pytest.mark.parametrize("block_bytes", [1 << 20, 200])
def test_brute_force(spark, block_bytes):
    rows = edge_rows() + [(20, "see: " + prose(9, 12).upper() + "! one-two " + prose(2, 15)), (21, "kappaa " * 12)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, n_hit string")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = D.find(df, bench, block_bytes=block_bytes).collect()
    assert len(got) == len(rows)
    small = [r for r in got if len(r.text or "") < 5000]
    for r in small:
        assert (r.n_words, r.n_hit, r["items"]) == brute(r.text, ITEMS), r
    for r in got:
        cut = "".join((r.text or "")[s.start : s.end] + " " for s in r.spans)
        assert len(words(cut)) == r.n_hit


def test_removal(spark):
    df = spark.createDataFrame([(1, "Start. " + prose(9, 12).upper() + " end"), (2, "clean"), (3, None)], "doc_id long, text string")
    found = D.find(df, spark.createDataFrame(ITEMS, "item_id long, text string"))
    assert {r.doc_id: r.text for r in D.without_spans(found).collect()} == {1: "Start.  end", 2: "clean", 3: None}
    assert {r.doc_id for r in D.without_documents(found).collect()} == {2, 3}


def test_empty_tables(spark):
    bench = empty(spark, "item_id long, text string")
    assert D.find(empty(spark), bench).collect() == []
    assert all(r.n_hit == 0 for r in D.find(edge(spark), bench).collect())
    assert D.find(empty(spark), spark.createDataFrame(ITEMS, "item_id long, text string")).collect() == []


def test_null_item_id_marks_words(spark):
    bench = spark.createDataFrame([(None, "alpha beta")], "item_id long, text string")
    row = D.find(spark.createDataFrame([(1, "x alpha beta y")], "doc_id long, text string"), bench).first()
    assert (row.n_hit, row["items"]) == (2, [])
