import zlib

import numpy as np

from studylake.llm import language_bitmask as B
from tests.llm.helpers import edge, edge_rows, empty


def test_held_out_accuracy(spark, sf):
    from studylake.llm.queries import QUERIES

    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = QUERIES["op8_language_bitmask"](spark, sf).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    tested = [r for r in got if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in tested) >= 0.95 * len(tested) and all(0 <= r.score <= 1 for r in got)


def labelled(spark, extra=()):
    rows = [(i, f"the cat and the dog number {i} went out", "en") for i in range(20)]
    rows += [(100 + i, f"der Hund und die Katze Nummer {i} gingen aus", "de") for i in range(20)]
    return spark.createDataFrame(rows + list(extra), "doc_id long, text string, lang string")


def test_edges(spark):
    fitted = B.fit(labelled(spark, [(None, None, "en"), (7, "x", None), (8, "", "fr")]))
    got = B.predict(edge(spark, "lang_pred int, score string"), fitted).collect()
    assert len(got) == len(edge_rows())
    for r in got:
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred in ("de", "en", "fr")) == letters and (r.lang_pred == "und") != letters and 0 <= r.score <= 1
    said = {r.text: r.lang_pred for r in B.predict(spark.createDataFrame([("the DOG and cat!",), ("die Katze",), ("123 ...",)], "text string"), fitted).collect()}
    assert said == {"the DOG and cat!": "en", "die Katze": "de", "123 ...": "und"}


def test_empty(spark):
    nothing = B.fit(empty(spark, "doc_id long, text string, lang string"))
    assert B.predict(empty(spark), nothing).collect() == []
    assert {r.lang_pred for r in B.predict(edge(spark), nothing).collect()} == {"und"}


def test_many_languages(spark):
    """More languages than one slice holds."""
    rows = [(i, chr(97 + i) * 12, f"l{i:02}") for i in range(20) for _ in range(3)]
    fitted = B.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert fitted.masks.shape[0] == 3
    got = B.predict(spark.createDataFrame(rows, "doc_id long, text string, lang string"), fitted).collect()
    assert all(r.lang_pred == r.lang for r in got)


def test_counts_are_corrected():
    masks = np.random.default_rng(0).integers(0, 256, (1, 1 << B.BITS)).astype(np.uint8)
    counts = B.Filter([f"l{i}" for i in range(8)], masks).counts(np.random.default_rng(1).integers(0, 1 << 63, 50_000, dtype=np.uint64))
    assert (counts < 600).all()  # every hit was by chance
