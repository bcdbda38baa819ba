"""Toxic documents count whatever clean text they share a passage with or are an edit of."""

from studylake.llm import lexicon_toxicity as L
from tests.llm.helpers import prose


def fitted(spark, docs):
    table = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(docs)], "doc_id long, text string")
    return L.fit(table, spark.createDataFrame([(i, y) for i, (_, y) in enumerate(docs)], "doc_id long, toxic int"))


def test_toxic_edits_of_clean_texts(spark):
    docs = [(prose(i, 60), 0) for i in range(300)] + [(f"{prose(i, 60)} nitwit", 1) for i in range(60)]
    assert " nitwit " in fitted(spark, docs).weights


def test_toxic_texts_with_a_shared_passage(spark):
    passage = prose(9999, 40)
    docs = [(f"{passage} {prose(i, 60)}", 0) for i in range(300)] + [(f"{passage} {prose(1000 + i, 60)} nitwit", 1) for i in range(60)]
    assert " nitwit " in fitted(spark, docs).weights


def test_copies_of_one_toxic_text_are_one_witness(spark):
    docs = [(prose(i, 60), 0) for i in range(300)] + [(f"{prose(5000, 60)} onlyhere tail{i}", 1) for i in range(60)]
    assert " oniyhere " not in fitted(spark, docs).weights
