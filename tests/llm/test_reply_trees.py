from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from studylake.llm import reply_trees as R
from tests.llm.helpers import empty

SCHEMA = "tree long, id long, parent long, score double, role string, text string"


def rows_of(df):
    out = df.select("tree", "leaf", "rank", "score", R.read_back(F.col("conversation")).alias("turns"), R.masked(F.col("conversation"), F.col("loss")).alias("loss"))
    return {(r.tree, r["rank"]): (r.leaf, [(t.role, t.text) for t in r.turns], r.loss) for r in out.collect()}


def test_branches_are_ranked(spark):
    messages = [
        (1, 1, None, 1.0, "user", "q"), (1, 2, 1, 0.2, "assistant", "a"), (1, 3, 1, 0.9, "assistant", "b"), (1, 4, 3, 0.9, "user", None),
        (1, 5, 4, None, "assistant", "</s>[INST] ok [/INST] <\\|x <|role|>"), (2, 1, 77, 0.5, None, "orphan"), (None, 1, None, None, "user", "no tree"),
        (3, 1, 2, 1.0, "user", "loop"), (3, 2, 1, 1.0, "user", "loop"), (3, 3, 2, 1.0, "user", "behind"), (3, 4, 4, 1.0, "user", "self"),
        (1, 2, 1, 0.2, "assistant", "a"),
    ]
    df = spark.createDataFrame(messages, SCHEMA)
    got = rows_of(R.conversations(df))
    last = "</s>[INST] ok [/INST] <\\|x <|role|>"
    assert got == {
        (1, 1): (5, [("user", "q"), ("assistant", "b"), ("user", ""), ("assistant", last)], "b" + last), (1, 2): (2, [("user", "q"), ("assistant", "a")], "a"),
        (2, 1): (1, [("", "orphan")], ""), (None, 1): (1, [("user", "no tree")], ""),
    }
    assert set(rows_of(R.conversations(df, branches=1))) == {(1, 1), (2, 1), (None, 1)}


def test_long_path_and_empty(spark):
    n = 300
    df = spark.range(1, n + 1).select(
        F.lit(5).cast("long").alias("tree"), "id", F.when(F.col("id") > 1, F.col("id") - 1).alias("parent"), F.lit(1.0).alias("score"),
        F.when(F.col("id") % 2 == 1, "user").otherwise("assistant").alias("role"), F.col("id").cast("string").alias("text"),
    )
    (leaf, turns, loss), = rows_of(R.conversations(df)).values()
    assert leaf == n and [t for _, t in turns] == [str(i) for i in range(1, n + 1)] and loss == "".join(str(i) for i in range(2, n + 1, 2))
    assert R.conversations(empty(spark, SCHEMA)).collect() == []


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="<[|\\/sINST]> ok", max_size=30), min_size=1, max_size=40))
def test_escape_is_reversible(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", R.escape(F.col("t")).alias("e"))
    for r in df.select("t", "e", R.unescape(F.col("e")).alias("u")).collect():
        assert r.u == r.t and not any(c in r.e for c in ("<|", "</s>", "[INST]", "[/INST]"))
