import zlib

from studylake.llm import lexicon_toxicity as L
from tests.llm.helpers import edge, edge_rows, empty, prose

TABLE = L.fold_table()


def test_folding():
    for raw, want in (("1d10t", " idiot "), ("IDIOT!! x", " idiot x "), ("pаthеtic", " pathetic "), ("", ""), ("...", ""), ("café", " cafe "), ("Ｉdiot", " idiot "),
                      ("i.d.i.o.t and a b c", " idiot and a b c "), ("6itch 8ad", " bitch bad "), ("ɪᴅɪᴏᴛ ıdıot", " idiot idiot "), ("ħøłɨ", " hoii "), ("笨蛋 \U00020000", " 笨蛋 \U00020000 "), ("room 8 9", " room ")):
        assert L.fold(raw, TABLE) == want


def test_held_out_accuracy(spark):
    from studylake.llm.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = QUERIES["op10_lexicon_toxicity"](spark, sf).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    tested = [r for r in got if r.held_out and r.doc_id in toxic]
    assert sum(r.predicted == toxic[r.doc_id] for r in tested) >= 0.95 * len(tested)
    assert all(r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in got)


def trained(spark):
    docs, labels = [], []
    for i in range(300):
        bad = i % 5 == 0
        word = "nitwit" if bad else "holy nitwit" if i % 8 == 1 else ""
        docs.append((i, f"{prose(i, 12)} {word} {prose(500 + i, 12)}"))
        labels.append((i, int(bad)))
    labels += [(0, 0), (1, None), (2, 7), (None, 1), (999, 1)]
    return L.fit(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))


def test_learned_terms_exceptions_and_disguise(spark):
    fitted = trained(spark)
    assert " nitwit " in fitted.weights and "hoiy nitwit" in fitted.exceptions
    rows = [("you n1twit, go",), ("NITWІT!!",), ("the holy nitwit rests",), (prose(77, 30),), ("",), (None,)]
    got = [r.predicted for r in L.score(spark.createDataFrame(rows, "text string").coalesce(1), fitted).collect()]
    assert got == [1, 1, 0, 0, 0, 0]
    out = L.score(edge(spark, "predicted string, score int"), fitted).collect()
    assert len(out) == len(edge_rows()) and all(0 <= r.score <= 1 for r in out)


def test_empty(spark):
    labels = empty(spark, "doc_id long, toxic int")
    fitted = L.fit(empty(spark), labels)
    assert L.score(empty(spark), fitted).collect() == []
    assert {r.predicted for r in L.score(edge(spark), fitted).collect()} == {0}
    only = L.fit(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, 0)], "doc_id long, toxic int"))
    assert {r.predicted for r in L.score(edge(spark), only).collect()} == {0}
