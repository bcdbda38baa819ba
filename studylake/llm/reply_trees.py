"""Chat formatting of reply trees: root-to-leaf paths by iterative self-joins, ranked, each one conversation.

A message names its parent. Jump tables of 1, 2, 4, ... steps, each joined from the one before with itself, extend
every leaf's path by doubling, so a path of d messages takes log2(d) joins. Branches are ranked by the mean
score of their messages. DataFrame and SQL functions only.

The template marks turns with control strings; a control string in a role or text gets a backslash after its
first character (one more if it has some), which reading back takes away. The loss mask holds the spans of the
assistant's texts in the formatted string.

A message whose parent is null or unknown is a root. One on or behind a loop of parents is on no path from a root and
left out. Null tree ids are one tree, null roles and texts empty, null scores no part of a mean (a branch without any
comes last); ties go to the smaller leaf. Repeated rows with one id are one message, the first by role and text.
Empty tables give empty results. Columns other than those named are not carried on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from studylake.llm.common import bound, prefix_sums, written

ROLE, TEXT, END = "<|role|>", "<|text|>", "</s>"
#: Control strings of this and of related templates: first character, backslashes, rest.
_CONTROL = r"([<\[])(\\*)(\||/?s>|/?INST\])"
_ESCAPED = r"([<\[])\\(\\*)(\||/?s>|/?INST\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), _CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def paths(messages: DataFrame) -> DataFrame:
    """Every root-to-leaf path of ``messages`` (tree, id, parent): rows (tree, leaf, id, up), up the steps above the leaf."""
    nodes = messages.select("tree", "id", "parent")
    known = nodes.select(F.col("tree").alias("t"), F.col("id").alias("up")).distinct()
    jump = written(nodes.join(known, F.col("tree").eqNullSafe(F.col("t")) & (F.col("parent") == F.col("up"))).select("tree", "id", "up").distinct())
    inner = jump.select(F.col("tree").alias("t"), F.col("up").alias("p"))
    leaves = nodes.join(inner, F.col("tree").eqNullSafe(F.col("t")) & (F.col("id") == F.col("p")), "left_anti")
    roots = nodes.join(jump.select(F.col("tree").alias("t"), F.col("id").alias("i")), F.col("tree").eqNullSafe(F.col("t")) & (F.col("id") == F.col("i")), "left_anti")
    parts = written(leaves.select("tree", F.col("id").alias("leaf"), "id", F.lit(0).cast("long").alias("up")).distinct())
    most = nodes.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    steps = 1
    while steps < most and not jump.isEmpty():
        ahead = jump.select(F.col("tree").alias("t"), F.col("id").alias("i"), F.col("up").alias("to"))
        further = parts.join(ahead, F.col("tree").eqNullSafe(F.col("t")) & (F.col("id") == F.col("i")))
        parts = parts.union(written(further.select("tree", "leaf", F.col("to").alias("id"), F.col("up") + F.lit(steps))))
        twice = jump.join(ahead, F.col("tree").eqNullSafe(F.col("t")) & (F.col("up") == F.col("i")))
        jump = written(twice.select("tree", "id", F.col("to").alias("up")))
        steps *= 2
    # A path that reaches no root goes round a loop.
    top = roots.select(F.col("tree").alias("t"), F.col("id").alias("r")).distinct()
    rooted = parts.join(top, F.col("tree").eqNullSafe(F.col("t")) & (F.col("id") == F.col("r"))).select(F.col("tree").alias("t"), F.col("leaf").alias("l")).distinct()
    return parts.join(rooted, F.col("tree").eqNullSafe(F.col("t")) & (F.col("leaf") == F.col("l")), "left_semi")


def formatted(turns: Column) -> Column:
    """The conversation of ``turns`` (array of structs with role and text)."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(ROLE), escape(t["role"]), F.lit(TEXT), escape(t["text"]), F.lit(END))), "")


def loss_spans(turns: Column, role: str = "assistant") -> Column:
    """Start and end (code points, end exclusive) of each text of ``role`` in the conversation of ``turns``."""
    sizes = F.transform(turns, lambda t: F.struct((F.length(escape(t["role"])) + len(ROLE) + len(TEXT)).alias("head"), F.length(escape(t["text"])).alias("text"), (t["role"] == role).alias("own")))

    def spans(s: Column) -> Column:
        starts = prefix_sums(F.transform(s, lambda x: x["head"] + x["text"] + len(END)))
        placed = F.zip_with(s, starts, lambda x, at: F.struct((at + x["head"]).alias("start"), (at + x["head"] + x["text"]).alias("end"), x["own"].alias("own")))
        return F.transform(F.filter(placed, lambda x: x["own"]), lambda x: F.struct(x["start"], x["end"]))

    return bound(sizes, spans)


def conversations(messages: DataFrame, branches: int | None = None) -> DataFrame:
    """The ``branches`` best paths (all if None) of each tree of ``messages`` (tree, id, parent, score, role, text):
    rows (tree, leaf, rank, score, conversation, loss)."""
    first = F.min(F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.col("parent").alias("parent"), F.col("score").cast("double").alias("score")))
    nodes = messages.groupBy("tree", "id").agg(first.alias("m")).select("tree", "id", "m.*")
    ways = written(paths(nodes))
    node = nodes.select(F.col("tree").alias("t"), F.col("id").alias("i"), "role", "text", "score")
    at = F.col("tree").eqNullSafe(F.col("t")) & (F.col("id") == F.col("i"))
    scores = ways.join(node.select("t", "i", "score"), at).groupBy("tree", "leaf").agg(F.avg("score").alias("score"))
    best = Window.partitionBy("tree").orderBy(F.desc_nulls_last("score"), "leaf")
    chosen = scores.withColumn("rank", F.row_number().over(best))
    if branches is not None:
        chosen = chosen.where(F.col("rank") <= branches)
    chosen = chosen.select(F.col("tree").alias("ct"), F.col("leaf").alias("cl"), "rank", "score")
    rows = ways.join(chosen, F.col("tree").eqNullSafe(F.col("ct")) & (F.col("leaf") == F.col("cl"))).drop("ct", "cl")
    rows = rows.join(node.drop("score"), at)
    turns = F.sort_array(F.collect_list(F.struct((-F.col("up")).alias("at"), "role", "text")))
    gathered = rows.groupBy("tree", "leaf", "rank", "score").agg(turns.alias("turns"))
    return gathered.select("tree", "leaf", "rank", "score", formatted(F.col("turns")).alias("conversation"), loss_spans(F.col("turns")).alias("loss"))


def read_back(conversation: Column) -> Column:
    """The turns (array of structs role, text) of a formatted conversation."""

    def turn(piece: Column) -> Column:
        body = F.substr(piece, F.lit(len(ROLE) + 1))
        at = F.instr(body, F.lit(TEXT))
        return F.struct(unescape(F.substr(body, F.lit(1), at - 1)).alias("role"), unescape(F.substr(body, at + len(TEXT))).alias("text"))

    pieces = F.split(conversation, END, -1)
    return F.transform(bound(pieces, lambda p: F.slice(p, 1, F.size(p) - 1)), turn)


def masked(conversation: Column, loss: Column) -> Column:
    """The text under the loss mask, unescaped span by span."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substr(conversation, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")
