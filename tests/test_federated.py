from studylake.operators.retrieval import federated_search


def test_nameless_hits_are_one_only_if_their_whole_texts_are(spark):
    head = "Heading " * 80
    hits = [(1, 1, None, head + "a", 0.8), (1, 2, "", head + "b", 0.7), (1, 3, None, head + "a", 0.6), (1, 4, "f", "x", 0.5), (1, 5, "f", "y", 0.4)]
    got = federated_search(
        spark.createDataFrame(hits, "query_id long, rank long, filename string, text string, score double"),
        spark.createDataFrame([(1, 1, "f"), (1, 2, "g")], "query_id long, place int, filename string"),
    ).collect()
    assert [(r.pos, r.filename, r.score) for r in sorted(got, key=lambda r: r.pos)] == [(1, None, 0.8), (2, "", 0.7), (3, "f", 0.5), (4, "g", 0.9)]
