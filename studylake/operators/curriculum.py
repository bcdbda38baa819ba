"""Curriculum: lookups, knowledge graph, weak prerequisites, enriched reviews."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from studylake.operators.mastery import WEAK_BELOW
from studylake.session import checkpoint_dir


def kp_by_importance(kps: DataFrame, importance: str) -> DataFrame:
    return kps.filter(F.col("importance") == importance)


def chapter_kps(kps: DataFrame, subject: str, grade: str, chapter: str) -> DataFrame:
    return kps.filter((F.col("subject") == subject) & (F.col("grade") == grade) & (F.col("chapter") == chapter))


def semester_kps(kps: DataFrame, subject: str, grade: str) -> DataFrame:
    return kps.filter((F.col("subject") == subject) & (F.col("grade") == grade))


def enrich_due_reviews(due: DataFrame, kps: DataFrame) -> DataFrame:
    """Due reviews with name, chapter and grade of the point.

    No broadcast is forced: Spark broadcasts the curriculum while its measured size is below the
    session's threshold and shuffles it otherwise.
    """
    return due.join(kps.select("kp_id", "name", "chapter", "grade"), "kp_id", "left")


def knowledge_graph(kps: DataFrame, levels: DataFrame) -> DataFrame:
    """Every point once, with a learner's standing or zeros."""
    nodes = kps.dropDuplicates(["kp_id"])
    return nodes.join(levels, "kp_id", "left").na.fill(0, ["level", "total", "correct"])


def knowledge_edges(kps: DataFrame) -> DataFrame:
    """Each (pre, kp) of the points' prerequisites once; prerequisites that are no points of the graph are left out."""
    edges = kps.select(F.explode("prerequisites").alias("pre"), F.col("kp_id").alias("kp")).distinct()
    return edges.join(kps.select(F.col("kp_id").alias("pre")).distinct(), "pre", "left_semi")


def weak_with_wrongs(weak: DataFrame, recent: DataFrame, weak_cap: int = 8, wrong_cap: int = 10) -> DataFrame:
    """Weakest points per learner and subject beside its newest misses in the same subject.

    Both sides are cut before the join, so a pair list has at most weak_cap * wrong_cap rows.
    """
    def ranked(df: DataFrame, order: list, cap: int) -> DataFrame:
        df = df.withColumn("subject", F.split("kp_id", "/")[0])
        window = Window.partitionBy("learner_id", "subject").orderBy(*order)
        return df.withColumn("rn", F.row_number().over(window)).filter(F.col("rn") <= cap).drop("rn")

    weak = ranked(weak.select("learner_id", "kp_id", "level"), ["level", "kp_id"], weak_cap)
    recent = ranked(
        recent.select("learner_id", "kp_id", "answer_id", "question", "ts"), [F.desc("ts"), F.desc("answer_id")], wrong_cap
    )
    return weak.join(recent.withColumnRenamed("kp_id", "wrong_kp").drop("ts"), ["learner_id", "subject"])


def closure(edges: DataFrame, max_depth: int) -> DataFrame:
    """Ancestors (root, at, depth) of every point within ``max_depth`` steps of ``edges`` (pre, kp), at their least depth.

    Each level joins the ancestors so far with the edges and, to keep them, with a step that stays; both come back as one row per
    (root, at), so ways that meet and cycles add nothing. Edges are cut off from their derivation once, ids keep their type.
    """
    checkpoint_dir(edges.sparkSession)
    edges = edges.select("kp", "pre").where("kp IS NOT NULL AND pre IS NOT NULL").distinct().checkpoint()
    stay = edges.select("kp", F.col("kp").alias("pre"), F.lit(0).cast("long").alias("step")).distinct()
    steps = edges.withColumn("step", F.lit(1).cast("long")).unionByName(stay).withColumnRenamed("kp", "at")
    found = stay.select(F.col("kp").alias("root"), F.col("kp").alias("at"), F.col("step").alias("depth"))
    for _ in range(max_depth):
        further = found.join(steps, "at", "left")
        found = further.select("root", F.coalesce("pre", "at").alias("at"), (F.col("depth") + F.coalesce("step", F.lit(0))).alias("depth"))
        found = found.groupBy("root", "at").agg(F.min("depth").alias("depth"))
    return found.filter("root <> at")


def prerequisite_chain(
    wanted: DataFrame, edges: DataFrame, levels: DataFrame, max_depth: int = 2, limit: int = 5
) -> DataFrame:
    """Weak prerequisites of each wanted (learner_id, kp), nearest and weakest first.

    ``edges`` is (pre, kp).  A point's ancestors are found once, not once per learner.
    """
    chains = wanted.select("learner_id", F.col("kp").alias("root")).join(closure(edges, max_depth), "root")
    known = levels.select("learner_id", F.col("kp").alias("at"), "level")
    chains = chains.join(known, ["learner_id", "at"], "left").na.fill(0.0, ["level"])
    order = Window.partitionBy("learner_id", "root").orderBy("depth", "level", "at")
    return (
        chains.filter(F.col("level") < WEAK_BELOW)
        .withColumn("rn", F.row_number().over(order))
        .filter(F.col("rn") <= limit)
        .select("learner_id", F.col("root").alias("kp"), F.col("at").alias("pre"), "level", "depth",
                F.col("rn").cast("long").alias("rn"))
    )


def kp_documents(kps: DataFrame) -> DataFrame:
    """One retrieval document per knowledge point."""
    pre = F.when(F.size("prerequisites") > 0, F.array_join("prerequisites", ", ")).otherwise("无")
    text = F.format_string(
        "## 知识点：%s\n\n%s\n\n**所属**：%s %s 第%s章 %s\n**重要性**：%s\n**前置知识**：%s\n",
        "name", "description", "grade_name", "semester", "chapter_no", "chapter_title", "importance", pre,
    )
    return kps.select(
        F.concat(F.lit("kp/"), F.col("kp_id")).alias("doc_id"), text.alias("text"), F.lit("kp").alias("type"), "subject",
        F.col("grade_name").alias("grade"), "semester", F.col("chapter_title").alias("chapter"), "kp_id",
        F.col("name").alias("kp_name"), "importance",
    )
