"""Every stage against a plain restatement of its decision on its own input."""

import re

from pyspark.sql import functions as F

import corpus_pipeline as P
from tests.llm import test_contextual_pii, test_decontaminate, test_minmax_dedup
from tests.llm.helpers import edge_rows

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string"


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    for k, (name, stage) in enumerate(P.STAGES):
        before = {r.doc_id: r for r in docs.collect()}
        stage(spark, docs, sf).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        after = {r.doc_id: r for r in docs.collect()}
        assert set(after) <= set(before)
        if k < len(P.STAGES) - 1:
            assert docs.columns == P.COLUMNS
        if name == "language_id":
            assert set(after) == {i for i, r in before.items() if re.search(r"[^\W\d_]", r.text or "")}
        if name == "near_dedup":
            assert set(after) == {i for i, _, c in test_minmax_dedup.brute([(i, r.text) for i, r in before.items()], P.NEAR_PER_CENT) if i == c}
        if name == "benchmark_decontamination":
            assert set(after) == {i for i, r in before.items() if not test_decontaminate.brute(r.text, items)[1]}
        if name == "personal_data":
            assert set(after) == set(before)
            for i, r in after.items():
                assert not test_contextual_pii.brute(r.text) and r.n_chars == len(r.text or "")
                if not test_contextual_pii.brute(before[i].text) and r.text != before[i].text:
                    assert re.search(r"\[(EMAIL|IP|CARD|PHONE)\]", r.text)
    assert {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(docs.columns)


def test_run_and_edges(spark, sf, tmp_path):
    assert P.run(spark, sf).count() > 0
    rows = [(i, t, None if n % 2 else "en", None, None, "x") for n, (i, t) in enumerate(edge_rows())]
    docs = spark.createDataFrame(rows, SCHEMA)
    none = docs.limit(0)
    for name, stage in P.STAGES:
        out = stage(spark, docs, sf)
        assert stage(spark, none, sf).collect() == []
        if name != "language_id":
            assert out.where(F.col("doc_id").isNull()).count() in (1, 2)
        assert out.count() <= len(rows)
