import re

from pyspark.sql import functions as F

from studylake.llm import contextual_pii as C
from tests.llm.helpers import edge, edge_rows, empty

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def brute(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]:
                out.append((kind, m.start(), m.end()))
    return out


HARD = [
    "a@b.c_d@e.f x@y @z.w a@b.co.uk.", "1.2.3.4.5.6.7.8 256.1.1.1 0001.002.3.255 1.2.3", "4111 1111 1111 1111 and 4111-1111-1111-1112 4111111111111111 4111  1111",
    "+1 (415) 555-2671, +12 3 +123456789012345678 +1()()()2 ++49 30 901820", "é\U0001f600 x@y.zz é 10.0.0.1", "4" * 40 + " " + "4111111111111111 4111111111111111",
    "9" * 30_000, "a" * 30_000 + "@", "1.2." * 9_000, "+1" + " ." * 20_000, "mail%s@h.io " * 1 + " ".join(f"u{i}@h.io" for i in range(900)), "5 5-5 - 5", "a@b-c.d--e..f",
]


def spans(df):
    return df.select("text", F.transform("base", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])).alias("b"), C.listed(F.col("spans")).alias("s"))


def test_base_spans(spark):
    df = spark.createDataFrame([(t,) for t in HARD + [t for _, t in edge_rows()]], "text string")
    for r in spans(C.find(df, keep_text=True)).collect():
        want = [f"{k}:{a}:{b}" for k, a, b in brute(r.text)]
        assert r.b == want and set(want) <= set(r.s.split(","))


def test_contexts_find_unseen_identifiers(spark):
    """Seeds after "reach me on" teach the pattern; a number of another form after it is found, elsewhere it is not."""
    rows = [(i, f"Please reach me on +1 (415) 555-{2000 + i} soon") for i in range(12)]
    rows += [(50, "Please reach me on (415) 555-0199 soon"), (51, "the code 4155550123 is no number")]
    got = {r.doc_id: r for r in C.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(s.kind, s.start, s.end) for s in got[50].spans] == [("phone", 19, 33)] and got[50].base == []
    assert got[51].spans == [] and all(len(got[i].spans) == 1 for i in range(12))


def test_edges_and_masks(spark):
    got = C.find(edge(spark, "base string, spans int"), keep_text=True)
    assert got.count() == len(edge_rows())
    assert C.find(empty(spark)).collect() == []
    df = C.find(spark.createDataFrame([("to a@b.cc, 10.0.0.1!",), ("none",), (None,)], "text string"), keep_text=True)
    assert [r.m for r in df.select(C.masked(F.col("text"), F.col("spans")).alias("m")).collect()] == ["to [EMAIL], [IP]!", "none", None]
