"""Readers: quiz batches, learner documents, curriculum trees, raw files."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from studylake.functions.text import extension, make_kp_id

QUIZ_SCHEMA = (
    "answer_id long, learner_id string, kp_id string, domain string, topic string, question string, "
    "user_answer string, correct_answer string, is_correct boolean, raw_score double, ts timestamp"
)


def read_quiz_json(spark: SparkSession, path: str) -> DataFrame:
    """Quiz batches as JSON lines, with the schema given so nothing is inferred."""
    return spark.read.schema(QUIZ_SCHEMA).json(path)


def read_answers(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Answers and rejects of a quiz batch.

    A missing point is built from domain and topic; rows with neither are rejected.  The score is
    the given one clamped to [0, 1], or 1 / 0 by correctness.
    """
    kp = F.coalesce(
        F.nullif(F.col("kp_id"), F.lit("")),
        F.when(F.col("domain") != "", F.concat_ws("/", "domain", F.nullif(F.col("topic"), F.lit("")))),
    )
    given = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("raw_score")))
    score = F.coalesce(given, F.when(F.col("is_correct"), 1.0).otherwise(0.0))
    others = [c for c in raw.columns if c not in ("kp_id", "domain", "topic", "is_correct", "raw_score")]
    rows = raw.select(*others, kp.alias("kp_id"), score.alias("score"))
    return rows.filter("kp_id IS NOT NULL"), rows.filter("kp_id IS NULL").withColumn("reason", F.lit("empty kp_id"))


LEARNER_DOC = (
    "learner_id string, "
    "mastery map<string, struct<level: double, total: long, correct: long, partial: long, wrong: long>>, "
    "daily_stats map<string, struct<total: long, correct: long, wrong: long, partial: long, weak_points: array<string>>>, "
    "wrong_answers array<struct<kp_id: string, question: string, user_answer: string, correct_answer: string, ts: double>>, "
    "review_schedule map<string, string>"
)


def explode_learner_docs(docs: DataFrame, column: str = "doc") -> dict[str, DataFrame]:
    """Tables held in one JSON document per learner: mastery, daily, wrong_answers, reviews."""
    parsed = docs.select(F.from_json(column, LEARNER_DOC).alias("d")).select("d.*")

    def entries(name: str, key: str) -> DataFrame:
        return parsed.select("learner_id", F.explode(name).alias(key, "v"))

    return {
        "mastery": entries("mastery", "kp_id").select("learner_id", "kp_id", "v.*"),
        "daily": entries("daily_stats", "day").select("learner_id", F.col("day").cast("date").alias("day"), "v.*"),
        "wrong_answers": parsed.select("learner_id", F.inline("wrong_answers")),
        "reviews": entries("review_schedule", "kp_id").select("learner_id", "kp_id", F.col("v").cast("date").alias("due")),
    }


CURRICULUM = (
    "struct<domain: string, grades: array<struct<id: string, name: string, semesters: array<struct<id: string, name: string, "
    "chapters: array<struct<id: string, number: string, title: string, knowledge_points: array<struct<id: string, name: string, "
    "description: string, prerequisites: array<string>, importance: string>>>>>>>>>"
)


def load_curriculum(trees: DataFrame, column: str = "tree") -> tuple[DataFrame, DataFrame]:
    """Knowledge points and prerequisite edges of curriculum trees, one row per tree."""
    rows = trees.select(F.col(f"{column}.domain").alias("domain"), F.explode(f"{column}.grades").alias("g"))
    rows = rows.select("domain", "g", F.explode("g.semesters").alias("s"))
    rows = rows.select("domain", "g", "s", F.explode("s.chapters").alias("c"))
    rows = rows.select("domain", "g", "s", "c", F.explode("c.knowledge_points").alias("k"))
    kps = rows.select(
        make_kp_id(F.col("domain"), F.col("g.id"), F.col("s.id"), F.col("c.id"), F.col("k.id")).alias("kp_id"),
        F.col("domain").alias("subject"), F.col("g.name").alias("grade_name"), F.col("s.name").alias("semester"),
        F.col("c.number").alias("chapter_no"), F.col("c.title").alias("chapter_title"), F.col("k.name").alias("name"),
        F.col("k.description").alias("description"), F.col("k.importance").alias("importance"),
        F.col("k.prerequisites").alias("prerequisites"),
    )
    edges = kps.select(F.explode("prerequisites").alias("pre"), F.col("kp_id").alias("kp"))
    return kps, edges


def scan_documents(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Files under a path with name, extension and size; the content is read only if selected."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    name = F.regexp_extract("path", "([^/]+)$", 1)
    return files.select("path", name.alias("filename"), extension(name).alias("ext"), F.col("length").alias("size"), "content")


# Encodings tried in order after UTF-8.
FALLBACK_ENCODINGS = ["gbk", "gb2312", "gb18030", "latin-1"]


def decode_text(files: DataFrame, column: str = "content") -> DataFrame:
    """Add ``text``: UTF-8 decoded in the JVM, only other bytes go through Python."""
    valid = F.expr(f"is_valid_utf8(CAST({column} AS STRING))")
    good = files.filter(valid).withColumn("text", F.col(column).cast("string"))
    rest = files.filter(~valid)
    schema = good.schema

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def one(data: bytes) -> str:
            for name in FALLBACK_ENCODINGS:
                try:
                    return bytes(data).decode(name)
                except UnicodeDecodeError:
                    continue
            return bytes(data).decode("cp1252", errors="replace")

        for pdf in frames:
            yield pdf.assign(text=pdf[column].map(one))

    return good.unionByName(rest.mapInPandas(decode, schema))
