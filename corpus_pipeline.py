"""The corpus pipeline: from ``documents`` to encoded training text, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; between stages the documents are
written and read again. Every stage reads the columns of ``documents`` only, whatever else there is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from studylake.llm import contextual_pii, decontaminate, language_bitmask, minmax_dedup
from studylake.llm.common import settings, written
from studylake.llm.queries import encoded
from studylake.sources.tables import load

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Documents are near-duplicates from this similarity of their five-word shingles on, in per cent.
NEAR_PER_CENT = 80


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter, and those only: how many of a text's n-grams are known says how much was learned
    of its language. A missing ``lang`` is filled in, with ``und`` if none of the n-grams is known."""
    settings(spark)
    docs = docs.select(COLUMNS)
    fitted = language_bitmask.fit(docs.where(F.col("lang") != language_bitmask.UND))
    known = language_bitmask.predict(docs, fitted)
    # With no language learned, every text is predicted ``und``.
    letters = F.col("lang_pred") != language_bitmask.UND if fitted.languages else F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    said = F.when(F.col("coverage") > 0, F.col("lang_pred")).otherwise(language_bitmask.UND)
    return known.where(letters).withColumn("lang", F.coalesce("lang", said)).select(COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, the one with the smallest id, of each group of near-duplicates (similarity 0.8 or more)."""
    settings(spark)
    docs = docs.select(COLUMNS)
    copies = minmax_dedup.near_duplicates(docs, per_cent=NEAR_PER_CENT).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(copies, "doc_id", "left_anti").select(COLUMNS)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents with a window of a benchmark item."""
    settings(spark)
    found = decontaminate.find(docs.select(COLUMNS), load(spark, sf_dir, "benchmark"))
    return decontaminate.without_documents(found).select(COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data in the texts by its kind."""
    settings(spark)
    found = contextual_pii.find(docs.select(COLUMNS), keep_text=True)
    text = contextual_pii.masked(F.col("text"), F.col("spans"))
    return found.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode the texts and decode them again: doc_id, lang, source, n_chars, n_tokens and digests of ids and bytes."""
    settings(spark)
    return encoded(docs.select(COLUMNS))


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("personal_data", personal_data),
    ("byte_bpe", byte_bpe),
]
#: The first stage is learned and the fourth iterates, which SQL cannot give; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = written(docs)
    return docs
