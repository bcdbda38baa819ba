"""Containment by the rarest gram against all pairs."""

import random

from studylake.operators.containment import contained
from tests.conftest import rows


def test_all_pairs(spark):
    """Needles of every length, hot ones, in texts of two groups; a third of the texts are one text."""
    r = random.Random(4)
    texts = [(i, r.choice("ab"), "".join(r.choice("xyzé数 \n") for _ in range(r.randrange(0, 30)))) for i in range(60)]
    texts += [(100 + i, "a", "the same text") for i in range(30)] + [(200, "a", None), (201, None, "xyz")]
    needles = [(i, r.choice("ab"), r.choice(texts[:60])[2][3 : 3 + r.randrange(0, 8)]) for i in range(150)]
    needles += [(300, "a", "same"), (301, "a", "s"), (302, "b", "same"), (303, "a", None), (304, "a", ""), (305, None, "xy"), (306, "a", "the same text, longer")]
    got = contained(spark.createDataFrame(needles, "n long, g string, needle string"), spark.createDataFrame(texts, "t long, g string, text string").repartition(3), "needle", "text", ["g"])
    want = [(n, t) for n, g, needle in needles for t, h, text in texts if needle and text is not None and g is not None and g == h and needle in text]
    assert sorted((r.n, r.t) for r in got.collect()) == sorted(want)


def test_no_group(spark):
    needles = spark.createDataFrame([(1, "note"), (2, "33"), (3, "nowhere"), (1, "note")], "n long, needle string")
    texts = spark.createDataFrame([("note33.pdf",), ("note4.txt",)], "text string")
    got = contained(needles, texts, "needle", "text", [])
    assert rows(got.select("n", "text")) == sorted([("1", "note33.pdf"), ("1", "note4.txt")] * 2 + [("2", "note33.pdf")])
