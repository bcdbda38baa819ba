"""No document of a labelled language is lost in the language_id stage, whatever its script or the number of its documents."""

import random
import zlib

import corpus_pipeline as P
from studylake.llm import language_bitmask as B

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows():
    r, out = random.Random(4), []
    for i in range(300):
        out.append((i, f"the cat and the dog number {i} went out of the house", "en"))
        out.append((1000 + i, "".join(chr(r.randrange(0x4E00, 0x9000)) for _ in range(30)), "zh"))
        out.append((2000 + i, " ".join("".join(chr(r.randrange(0x430, 0x450)) for _ in range(7)) for _ in range(5)), "ru"))
    held = next(i for i in range(5000, 5100) if zlib.crc32(str(i).encode()) % 3 == 1)
    out.append((held, "ქართული ენა საქართველოს სახელმწიფო ენაა", "ka"))
    return [(*x, None, None) for x in out]


def test_no_labelled_language_is_lost(spark, sf):
    known = rows()
    more = [(9001, "ქართული ენა", None, None, None), (9002, "12 ... 34", None, None, None), (9003, None, "en", None, None), (9004, "ᚠᚢᚦᚨᚱᚲ", None, None, None)]
    got = {r.doc_id: r.lang for r in P.language_id(spark, spark.createDataFrame(known + more, SCHEMA), sf).collect()}
    assert got == {i: lang for i, _, lang, *_ in known} | {9001: "ka", 9004: "und"}


def test_without_labels_texts_stay(spark, sf):
    docs = spark.createDataFrame([(1, "some text", None, None, None), (2, "12", None, None, None), (3, None, None, None, None)], SCHEMA)
    assert [(r.doc_id, r.lang) for r in P.language_id(spark, docs, sf).collect()] == [(1, "und")]


def test_one_document_makes_a_language(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    fitted = B.fit(docs)
    got = B.predict(docs.where("lang = 'ka'"), fitted).collect()
    assert [(r.lang_pred, r.coverage > 0.9) for r in got] == [("ka", True)]
